"""Training-data operators: packing, mixing, search, filters, dedup, classifiers, archives.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
