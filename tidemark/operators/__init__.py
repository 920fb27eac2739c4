"""Weighted-row (Z-set) operators and joins that Spark lacks."""
