"""Composed jobs: corpus build, enrichment, processing, preparation, reports."""
