"""Training-data operators. Nothing outside this subpackage and corpus_pipeline.py imports it."""
