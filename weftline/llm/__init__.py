"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it, apart from the guarded import in
``__spark_entry__.py`` and the top-level ``corpus_pipeline.py``.
"""
