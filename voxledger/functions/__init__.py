"""Column-level building blocks: text clean-up, word and character distance, BLEU."""
