"""Training-data operators: deduplication, decontamination, packing, scoring and counting.

Nothing outside this subpackage imports it.
"""
