"""Statements, SQL rewrites and the choice of how a view is kept up to date."""
