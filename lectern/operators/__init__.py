"""Relational operators over the corpus: every one takes and returns DataFrames."""
