"""Training-data operators: quality, dedup, decontamination, privacy, extraction, packing."""
