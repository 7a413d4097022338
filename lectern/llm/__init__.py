"""Training-data operators.

Nothing outside this subpackage (and corpus_pipeline.py, which counts as part
of it) imports from here, so it can be removed as a whole.
"""
