"""Training-data operators: deduplication, fingerprints, scans, scores, mixing and packing.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
