"""Training-data operators: filtering, deduplication, scoring, tokenising, packing and sharding of text."""
