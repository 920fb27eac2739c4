"""Versioned state, the engine that keeps views up to date, and the Structured Streaming driver."""
