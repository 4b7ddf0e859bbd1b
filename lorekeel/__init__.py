"""Corpus reconciliation and retrieval on Spark."""
