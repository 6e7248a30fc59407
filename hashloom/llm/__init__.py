"""Training-data operators: quality, near duplicates, toxicity, archives, token counts, language-model scores,
personal data, fingerprints, decontamination and SentencePiece coding. Nothing outside this package imports it."""
