"""Training-data operators: quality, near-duplicates, privacy, packing, sharding, secrets, contamination, language.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
