"""Operators for preparing text corpora for language-model training.

Nothing outside this folder imports it (the entry module and the pipeline
module add it when it is present).
"""
