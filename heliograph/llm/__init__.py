"""Training-data operators: packing, deduplication, mixing, classification, chat and web archives."""
