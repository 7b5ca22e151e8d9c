"""Corpus analytics on Spark: annotated token tables and the analyses of them, as DataFrame functions."""
