"""Readers and writers of corpora, hypotheses and result files."""
