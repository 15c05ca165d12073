"""Training-data operators: formatting, counting, deduplication, scoring, mixing and packing."""
