"""Operators for preparing language-model training corpora.

Ten operators, one module each.  Nothing outside this subpackage (and the
top-level ``corpus_pipeline``) imports it.
"""
