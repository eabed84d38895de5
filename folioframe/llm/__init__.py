"""Training-data operators: filters, deduplication, tokenizing, mixing, quality."""
