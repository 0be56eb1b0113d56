"""Training-data operators: secret scan, mixing, chat formatting, near-dedup, quality,
decontamination, language identification, sharding, HTML extraction and token counts."""
