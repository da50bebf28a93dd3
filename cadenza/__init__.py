"""Cadenza: listening analytics, recommendation and corpus preparation as Spark jobs."""
