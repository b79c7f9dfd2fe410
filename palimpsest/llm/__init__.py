"""Training-data operators: mixing, tokenizing, scanning, deduplicating and searching a corpus.

Nothing else in the package imports this subpackage.
"""
