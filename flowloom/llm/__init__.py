"""Operators for preparing training data, each a job over DataFrames.

Nothing outside this folder, its tests and `corpus_pipeline.py` imports it. Operators take
a DataFrame with the named columns, ignore any others and state in their docstrings what
becomes of nulls, empty texts, ties and repeated rows.
"""
