"""Training-data operators: scoring, filtering, de-duplication, tokenisation and sharding of document tables."""
