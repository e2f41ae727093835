"""Training-data operators: sharding, decontamination, deduplication, quality, scoring, encoding and packing."""
