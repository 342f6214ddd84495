"""Training-data operators: licence scan, decontamination, near-duplicates, line and
substring deduplication, tokenising, quality rules and classifier, URL filter, LM scoring.

Nothing else in ``bitloom`` imports this subpackage.
"""
