"""Training-data operators: URL, token, fingerprint, toxicity, language and duplicate work on documents."""
