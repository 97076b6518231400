"""Training-data operators: dedup, decontamination, mixing, language ID, token counts, LM scoring."""
