"""Operators for training data: grouping, neighbours, survivorship, pairs, language, names, splitting, leakage, mixing, encodings."""
