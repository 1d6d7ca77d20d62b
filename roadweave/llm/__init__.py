"""Training-data operators: mixing, sharding, deduplication, scoring, tokens, search, extraction."""
