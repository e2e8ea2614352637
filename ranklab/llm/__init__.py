"""Training-data operators: mixing, filtering, deduplication, packing, search."""
