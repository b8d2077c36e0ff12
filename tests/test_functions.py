import hashlib
from collections import Counter
from math import prod

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import entities as ent
from corpusloom.functions import keys, lexical, scores, urls
from corpusloom.functions import text as tx

TRICKY = ["", "  lead", "a b", "a　b", "a\vb", "a\x1cb", "two 😀 w", None, "\x85x y "]


def test_word_counts_follow_python_split(one):
    got = one(TRICKY, lambda x: tx.text_length(x, "words"))
    assert got == [None if t is None else len(t.split()) for t in TRICKY]


def test_char_counts_are_code_points(one):
    got = one(TRICKY, lambda x: tx.text_length(x, "chars"))
    assert got == [None if t is None else len(t) for t in TRICKY]


def test_token_counts(one):
    assert one(["", "Hi, you!", "a_b 12", None], lambda x: tx.text_length(x, "tokens")) == [
        0, 4, 2, None,
    ]


def test_unknown_length_method():
    with pytest.raises(ValueError):
        tx.text_length(F.lit("x"), "lines")


def test_dateline(one):
    texts = [
        "PARIS (Reuters) - Body",
        "A (Reuters)- b (Reuters) -  tail",
        "first\nROME (Reuters) - kept",
        "x\ry (Reuters) - gone",
        "none",
    ]
    assert one(texts, tx.strip_dateline) == [
        "Body", "tail", "first\nROME (Reuters) - kept", "gone", "none",
    ]


def test_excerpt_and_first_words(one):
    assert [len(x) for x in one(["a" * 1000, "a" * 1001], tx.excerpt)] == [1000, 1000]
    texts = [" ".join(["w"] * n) for n in (499, 500, 501)]
    assert [len(x.split()) for x in one(texts, tx.first_words)] == [499, 500, 500]


def test_repair(one):
    pairs = [
        ("Tom &amp; Ann", "Tom & Ann"),
        ("<b>Tom &amp; Ann", "<b>Tom &amp; Ann"),
        ("“x” ‘y’", "\"x\" 'y'"),
        ("ﬁne ﬂow", "fine flow"),
        ("ＡＢ１　z", "AB1 z"),
        ("a\r\nb\rc d", "a\nb\nc\nd"),
        ("bell\x07 \x1b[31mred\x1b[0m", "bell red"),
        ("cafÃ©", "café"),
        ("itâ€™s", "it's"),
        ("mixed Ã© and ü", "mixed Ã© and ü"),
        ("already clean\ttext\n", "already clean\ttext\n"),
        ("très élevé", "très élevé"),
        (None, None),
    ]
    assert one([a for a, _ in pairs], tx.repair_text) == [b for _, b in pairs]


def test_clean_text_returns_after_repair(one):
    assert one(["  Big   CAT "], tx.clean_text) == ["  Big   CAT "]
    assert one(["  Big   CAT "], lambda x: tx.clean_text(x, repair=False)) == ["big cat"]
    keep = lambda x: tx.clean_text(x, repair=False, lowercase=False, strip_whitespace=False)
    assert one(["  Big "], keep) == ["  Big "]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=30))
def test_seed_equals_hashlib(one, texts):
    texts = [t.replace("\x00", "") for t in texts]
    want = [int(hashlib.sha256(t.encode()).hexdigest(), 16) % 10**8 for t in texts]
    assert one(texts, keys.text_seed) == want


def test_composite_key_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None), (None, "b")], "a int, b string")
    assert sorted(r[0] for r in df.select(keys.composite_key("a", "b")).collect()) == [
        "1__nan", "nan__b",
    ]


def test_url_host(one):
    texts = ["HTTP://WWW.A.com:80/x?q", "nonsense", None, "https://b.org"]
    assert one(texts, urls.url_host) == ["www.a.com:80", None, None, "b.org"]
    assert urls.normalise_hosts(["HTTPS://A.com", "a.com", "http://b.org"]) == ["a.com", "b.org"]


def test_wildcards(one):
    texts = ["https://a.com/news/1", "a.com/newsx", "http://a.com/n_ws/1", "http://a.com/n%x"]
    assert one(texts, lambda x: urls.matches_wildcard(x, "a.com", "news*")) == [
        True, True, False, False,
    ]
    assert one(texts, lambda x: urls.matches_wildcard(x, "a.com", "n_ws/*")) == [
        False, False, True, False,
    ]
    assert one(texts, lambda x: urls.matches_wildcard(x, " a.com ", "n%x")) == [
        False, False, False, True,
    ]


def _mask(spark, text, words):
    rows = spark.createDataFrame(
        [(text, [(w, "PER") for w in words])],
        "text string, e array<struct<word:string,entity_group:string>>",
    )
    return rows.select(ent.mask_entities(F.col("text"), F.col("e"))).first()[0]


def test_masks(spark):
    text = "C++ (US) beats C++ in New York and York"
    seed = int(hashlib.sha256(text.encode()).hexdigest(), 16) % 10**8
    ids = [1 + (seed + 7919 * r) % 99999 for r in range(3)]
    got = _mask(spark, text, ["York", "C++ (US)", "New York", "York"])
    # equal lengths keep their order: "C++ (US)" before "New York"
    assert got == f"<MASK_{ids[0]}> beats C++ in <MASK_{ids[1]}> and <MASK_{ids[2]}>"
    assert _mask(spark, text, []) == text
    assert _mask(spark, text, ["absent"]) == text
    assert _mask(spark, text, ["York"]) == _mask(spark, text, ["York"])


def test_short_entity_hits_inside_masks(spark):
    got = _mask(spark, "Mary M", ["Mary", "M"])
    assert "<<MASK_" in got and got.count("MASK") >= 2


def test_mask_entity_types(spark):
    rows = spark.createDataFrame(
        [("Ann in Rome", [("Ann", "PER"), ("Rome", "LOC")])],
        "text string, e array<struct<word:string,entity_group:string>>",
    )
    only = rows.select(ent.mask_entities(F.col("text"), F.col("e"), ["LOC"])).first()[0]
    assert only.startswith("Ann in <MASK_")


def test_gazetteer_table_equals_expression(spark, monkeypatch):
    docs = spark.createDataFrame(
        [(1, "Ann met Bob Ray in Rome."), (2, "nobody"), (3, None)], "row_id long, text string"
    )
    book = {"Ann": "PER", "Rome": "LOC"}
    table = spark.createDataFrame(list(book.items()), "word string, entity_group string")
    by_dict = ent.extract_entities(docs, book).orderBy("row_id").collect()
    assert [e["word"] for e in by_dict[0]["entities"]] == ["Ann", "Bob Ray", "Rome"]
    assert [e["entity_group"] for e in by_dict[0]["entities"]] == ["PER", "MISC", "LOC"]
    assert ent.extract_entities(docs, table).orderBy("row_id").collect() == by_dict
    monkeypatch.setattr(ent, "small_rows", lambda _df: None)
    assert ent.extract_entities(docs, table).orderBy("row_id").collect() == by_dict


def test_best_score_and_argmax(spark):
    rows = spark.createDataFrame(
        [([("a", 0.5), ("b", 0.5)],), ([("a", 0.1), ("b", 0.9)],)],
        "p array<struct<label:string,score:double>>",
    )
    got = [r[0]["label"] for r in rows.select(scores.best_score(F.col("p"))).collect()]
    assert got == ["a", "b"]
    logits = spark.createDataFrame([([1.0, 3.0, 3.0],)], "x array<double>")
    row = logits.select(
        scores.argmax(F.col("x")).alias("i"), scores.softmax(F.col("x")).alias("p")
    ).first()
    assert row["i"] == 1 and abs(sum(row["p"]) - 1) < 1e-12


def test_softmax_does_not_overflow(spark):
    rows = spark.createDataFrame([([1000.0, 0.0],)], "x array<double>")
    assert rows.select(scores.softmax(F.col("x"))).first()[0] == [1.0, 0.0]


def test_prediction_shapes(spark):
    single = spark.createDataFrame([(("x", 0.3),)], "prediction struct<label:string,score:double>")
    assert scores.normalise_scores(single).first()["prediction"][0]["label"] == "x"
    bare = spark.createDataFrame([(("x",),)], "prediction struct<label:string>")
    assert scores.normalise_scores(bare).first()["prediction"][0]["score"] is None
    with pytest.raises(ValueError):
        scores.normalise_scores(spark.createDataFrame([("x",)], "prediction string"))
    empty = spark.createDataFrame([([],)], "prediction array<struct<label:string,score:double>>")
    with pytest.raises(Exception, match="empty prediction"):
        scores.normalise_scores(empty).collect()


def _hdd(words):
    counts, n = Counter(words), len(words)
    d = min(42, max(1, int(0.8 * n)))
    miss = lambda c: prod(max(n - c - i, 0) / (n - i) for i in range(d))
    return sum((1 - miss(c)) / d for c in counts.values())


def _mtld(words):
    def walk(ws):
        factors, start = 0, 0
        for i in range(len(ws)):
            part = ws[start : i + 1]
            if len(set(part)) / len(part) <= 0.72:
                factors, start = factors + 1, i + 1
        rest = ws[start:]
        if rest:
            factors += (1 - len(set(rest)) / len(rest)) / (1 - 0.72)
        return len(ws) / (factors or 1)

    return (walk(words) + walk(words[::-1])) / 2


def _spell(n):
    return "".join(chr(97 + int(d)) for d in str(n))


LEXICAL = [
    "", "123 ...", "word", "same " * 30, " ".join(map(_spell, range(50))),
    *[" ".join(_spell(i * i % 17) for i in range(n)) for n in (42, 43, 52, 53, 300)],
]


def test_richness(spark):
    rows = spark.createDataFrame(list(enumerate(LEXICAL)), "row_id int, text string")
    got = lexical.add_richness(rows).orderBy("row_id").collect()
    for r in got:
        words = [w for w in r["text"].split() if w.isalpha()]
        if not words:
            assert (r["ttr"], r["mtld"], r["hdd"], r["terms"]) == (None, None, None, 0)
            continue
        assert r["terms"] == len(set(words))
        assert r["ttr"] == pytest.approx(len(set(words)) / len(words))
        assert r["hdd"] == pytest.approx(_hdd(words))
        assert r["mtld"] == pytest.approx(_mtld(words))
        assert 0 <= r["ttr"] <= 1 and 0 <= r["hdd"] <= 1 + 1e-9


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from("abcdefg"), min_size=1, max_size=80), min_size=1, max_size=20))
def test_richness_property(spark, texts):
    rows = spark.createDataFrame(
        [(i, " ".join(w)) for i, w in enumerate(texts)], "row_id int, text string"
    )
    for r in lexical.add_richness(rows, "text", ("hdd", "mtld")).collect():
        assert r["hdd"] == pytest.approx(_hdd(texts[r["row_id"]]))
        assert r["mtld"] == pytest.approx(_mtld(texts[r["row_id"]]))
