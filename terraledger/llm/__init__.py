"""Training-data operators: dedup, search, tokenising, labelling, sharding, packing."""
