"""Training-data operators: sharding, de-duplication, scoring, packing, redaction, archives, search and mixing.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it. Every
operator takes and returns DataFrames; tasks use NumPy and Arrow where Spark has
already partitioned the work.
"""
