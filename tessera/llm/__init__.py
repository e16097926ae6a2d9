"""Training-data operators: search, counting, scoring, cleaning, mixing and sharding of text corpora."""
