"""Training-data operators: dedup, similarity joins, classifiers, packing, mixing, search, archives, scans.

Nothing outside this folder imports it; it imports nothing of the rest of the package.
"""
