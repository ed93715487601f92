"""Training-data operators: extraction, deduplication, mixing, fingerprints, classifiers, packing, scoring, search."""
