"""Operators of a training-data pipeline: deduplication, extraction, tokenised
output, language, archives, decontamination, toxicity and packing.

Nothing outside this subpackage imports it.  ``queries.py`` registers one query
per operator; ``corpus_pipeline.py`` at the repository top chains five of them.
"""
