"""Training-data operators: filtering, scoring, deduplication and tokenisation of text corpora.

Nothing outside this package imports it; ``__spark_entry__`` registers its
queries only where the package is present.
"""
