"""Training-data operators: chat formatting, mixing, media, quality, packing, language ID, near-duplicates, LM scoring, secrets, token files."""
