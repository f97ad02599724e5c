"""Training-data operators: filtering, deduplication, decontamination, tokenization.

Nothing else in the library imports this subpackage.
"""
