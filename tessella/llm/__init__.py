"""Training-data operators: scans, tokenizers, classifiers, near duplicates, search, extraction."""
