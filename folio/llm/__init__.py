"""Training-data operators: dedup, tokens, media, language, LM scores, leaks, HTML, toxicity."""
