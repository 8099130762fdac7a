"""Training-data operators: deduplication, quality, sharding, tokenisation, packing, language."""
