"""Training-data operators: tokenising, filtering, de-duplicating and scoring text corpora.

Nothing else in the library imports this subpackage.
"""
