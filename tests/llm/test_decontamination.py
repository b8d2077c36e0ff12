import re

from corpusloom.llm import decontamination


def _runs(text):
    w = [x for x in re.split(r"[^\w]+|_", (text or "").lower()) if x]
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_pairs_against_brute_force(spark, docs, texts):
    items = [(i, " ".join((texts[k] or "").split()[a:b])) for i, (k, a, b) in enumerate([(11, 50, 80), (0, 90, 130), (3, 0, 40), (13, 2, 20), (0, 0, 4)])]
    items += [(10, items[0][1].upper().replace(" ", ", ")), (11, None), (12, ""), (None, "one two"), (13, "one two"), (14, items[1][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in decontamination.contained(docs, table).collect()}
    want = {}
    for i, t in enumerate(texts):
        for j, q in items:
            a, b = _runs(t), _runs(q)
            if j is not None and b and len(a & b) >= 0.8 * len(b):
                want[(i, j)] = (len(a & b), len(b))
    assert found == want and (11, 0) in want and (11, 10) in want and (9, 13) in want


def test_without_a_broadcast(spark, docs, texts, monkeypatch):
    from corpusloom import bounded

    items = spark.createDataFrame([(1, " ".join(texts[11].split()[5:60]))], "item_id long, text string")
    want = sorted(decontamination.contained(docs, items).collect())
    monkeypatch.setattr(bounded, "checked", lambda df, *a: df)
    assert sorted(decontamination.contained(docs, items).collect()) == want


def test_keep_clean_and_empty_sides(spark, docs, nothing, texts):
    items = spark.createDataFrame([(1, " ".join(texts[11].split()[5:60]))], "item_id long, text string")
    kept = decontamination.keep_clean(docs, items)
    assert kept.columns == docs.columns and docs.count() - kept.count() == 2
    assert decontamination.contained(nothing, items).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.keep_clean(docs, none).count() == docs.count()
