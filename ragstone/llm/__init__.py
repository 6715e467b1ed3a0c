"""Operators for large-scale training-data preparation.

Nothing outside this folder imports it.  ``queries.py`` lists the thin
``opN_<name>`` queries, ``corpus_pipeline.py`` at the repository top chains
some of the operators.
"""
