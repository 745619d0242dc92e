"""Training-data operators: tokens, filters, near-duplicates, mixing and archives."""
