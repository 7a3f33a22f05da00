"""Training-data operators: quality, deduplication, token counts, extraction, packing, mixing, toxicity, language."""
