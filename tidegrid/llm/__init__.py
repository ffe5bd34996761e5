"""Training-data operators: deduplication, mixing, redaction, packing, search, classifiers."""
