"""Claim checking and text retrieval over large corpora, written as Spark DataFrame jobs."""
