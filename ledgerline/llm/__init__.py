"""Training-data operators: dedup, mixing, scoring, filtering, media and tokens.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
