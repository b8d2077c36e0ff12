"""Very long texts and empty tables, for operators whose own tests do not hold them."""

import random

import corpus_pipeline
from corpusloom.llm import decontamination, licenses, surrogates


def words(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choices("abcdefghiklmnoprstuvw", k=draw.randint(2, 9))) for _ in range(n))


LONG = words(1, 40_000)


def test_one_very_long_text(spark):
    card, mail = "4111 1111 1111 1111", "jane.roe@example.com"
    text = f"{LONG} MIT License {card} {LONG} write to {mail} {words(9, 60)}"
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string").cache()
    found = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert found[1].n_words > 80_000 and found[1].base_labels == "mit" and found[2].base_labels == ""
    changed = {r.doc_id: r for r in surrogates.pseudonymise(docs, "k").collect()}
    assert changed[1].n_entities >= 2 and mail not in changed[1].text and card not in changed[1].text
    assert changed[1].text.startswith(LONG) and changed[2].text == "short"
    items = spark.createDataFrame([(5, words(9, 60)), (6, words(10, 60))], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.containment) for r in decontamination.contained(docs, items).collect()] == [(1, 5, 1.0)]


def test_pipeline_on_an_empty_table(spark, tmp_path, nothing):
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
