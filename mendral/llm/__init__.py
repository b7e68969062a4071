"""Operators for preparing large text corpora.

Nothing outside this folder imports it, apart from the guarded lookup in
``__spark_entry__`` and the stage list in ``corpus_pipeline``.
"""
