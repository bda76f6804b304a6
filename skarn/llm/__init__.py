"""Training-data operators: deduplication, filtering, scoring and packing."""
