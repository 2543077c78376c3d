"""Training-data operators: scoring, de-duplication, search, mixing, packing and token output."""
