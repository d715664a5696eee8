"""Operators for large-scale training-data pipelines.

Each module holds one operator with a general interface; ``queries`` wires them to the
driver tables. Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
