"""Training-data operators: scoring, deduplication, language, search, packing, decontamination, token counts, chat and toxicity."""
