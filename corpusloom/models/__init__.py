"""Spark ML on corpus tables: vectors, clusters, topics, baseline, scoring, sweeps."""
