"""Training-data operators: quality, mixing, fingerprints, packing, rules, toxicity, URLs, secrets, token counts, near-duplicates."""
