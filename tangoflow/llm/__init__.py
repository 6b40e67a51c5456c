"""Training-data operators: archives, private data, mixing, near-duplicates,
packing, quality, chat formatting and secrets.  Nothing outside this
subpackage (and ``corpus_pipeline.py``) imports it."""
