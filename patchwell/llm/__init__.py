"""Training-data operators: deduplication, language and quality scoring, tokenising, mixing, HTML extraction.

Nothing else in the library imports this subpackage.
"""
