"""A search engine on Spark: full text, patterns, JSON and vectors over DataFrames, as Column expressions and as token indexes."""
