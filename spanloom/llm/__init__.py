"""Training-data operators: deduplication, classifiers, scanners, tokenizers and packing."""
