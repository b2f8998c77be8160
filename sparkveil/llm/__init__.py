"""Training-data operators: formatting, language, deduplication, decontamination, tokens, privacy, quality, packing.

Nothing else in the library imports this subpackage.  Each operator lives in its own
module; ``queries.py`` registers the thin ``opN_<name>`` queries.
"""
