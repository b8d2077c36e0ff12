"""Entities and topics per row, and the topic summary."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from corpusloom.functions import entities as ent
from corpusloom.models import topics as tp
from corpusloom.operators import aggregates


def enrich(
    corpus: DataFrame, gazetteer: Mapping[str, str] | DataFrame, **topic_options
) -> DataFrame:
    """The corpus with ``entities`` and ``topic``."""
    return ent.extract_entities(tp.assign_topics(corpus, **topic_options), gazetteer)


def topic_summary(enriched: DataFrame) -> DataFrame:
    return aggregates.topic_label_summary(enriched)
