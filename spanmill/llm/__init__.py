"""Training-data operators: archives, deduplication, scoring, filtering, tokenising, packing.

Nothing outside this subpackage imports it; it can be deleted as a whole.
"""
