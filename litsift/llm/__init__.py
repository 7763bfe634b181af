"""Training-data operators: language ID, deduplication, toxicity, search, URL rules,
sharding, tokenising and packing. Nothing else in the library imports this subpackage."""
