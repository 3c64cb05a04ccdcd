"""Training-data operators: tokenisation, filters, near-duplicates, packing, secrets, chat."""
