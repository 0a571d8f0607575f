"""Training-data operators: filters, tokens, deduplication, scoring and packing."""
