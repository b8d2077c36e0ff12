import numpy as np

from corpusloom.llm import toxicity


def _model(sample: str):
    s = np.frombuffer(sample.encode().translate(toxicity.CLASSES), np.uint8).astype(int)
    return toxicity.language_model(np.bincount((s[:-2] << 10) + (s[1:-1] << 5) + s[2:], minlength=32**3).astype(float))


def test_restores_disguised_words():
    restore = toxicity.restorer(_model(" you are an idiot and a moron such stupid trash and a loser here " * 50))
    assert restore("you are an 1d10t here") == "you are an idiot here"
    assert restore("a m0r0n and l o s e r here") == "a moron and loser here"
    assert restore("stuuuupid tr@sh") == "stupid trash"
    for plain in ("", "plain text", "call +1 (386) 555-8773 now", "a b", "x" * 500):
        assert restore(plain) == plain


def test_learns_without_the_held_out_rows_and_scores_all(spark, docs, nothing, texts):
    rows = [(1000 + i, f"some words {i} of a text and " + ("id1ot" if i % 3 == 0 else "friend") + f" again {i % 7}") for i in range(400)]
    corpus = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    labels = spark.createDataFrame(
        [(1000 + i, 1, int(i % 3 == 0)) for i in range(400)] + [(None, 1, 1), (5, 1, None)],
        "doc_id long, quality int, toxic int",
    )
    model = toxicity.fit(corpus, labels)
    scored = toxicity.score(corpus, model).collect()
    assert len(scored) == len(rows) + len(texts) + 2 and all(0 <= r.score <= 1 for r in scored)
    held = [r for r in toxicity.score(corpus, model).where(toxicity.held_out()).collect() if r.doc_id and r.doc_id >= 1000]
    assert held and all((r.score >= 0.5) == ((r.doc_id - 1000) % 3 == 0) for r in held)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    # labels of held-out rows change nothing
    flipped = spark.createDataFrame(
        [(r.doc_id, 1, 1 - r.toxic if r.held else r.toxic) for r in labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").withColumn("held", toxicity.held_out()).collect()],
        "doc_id long, quality int, toxic int",
    )
    again = toxicity.fit(corpus, flipped)
    assert np.allclose(again["beta"], model["beta"])
    assert toxicity.score(nothing, model).count() == 0


def test_without_labels(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.0}


def test_restores_long_disguises():
    restore = toxicity.restorer(_model(" you are an idiot and a moron such stupid trash and a loser here " * 50))
    spaced = " ".join("youareanidiotandamoronsuchstupidtrashandaloserhere")
    assert len(spaced) > 64 and restore(spaced) == "you are an idiot and a moron such stupid trash and a loser here"
    assert restore("st" + "u" * 100 + "pid trash") == "stupid trash"
    assert restore("such " + "1d10t" * 4000).startswith("such idiotidiot")


def test_restores_signs_at_the_end_of_words():
    model = _model(" such a cunt is an idiot and an ass this shit is stupid it is a friend, hello there! I am! " * 50)
    restore = toxicity.restorer(model)
    for written, meant in (("a$$", "ass"), ("a55", "ass"), ("shi7", "shit"), ("cun7", "cunt"), ("idi07", "idiot"), ("stupi|)", "stupid")):
        assert restore(written) == meant and restore(f"such {written} is") == f"such {meant} is"
    for plain in ("hello there!!", "a friend! an idiot!", "an ass! hello!!"):
        assert restore(plain) == plain


def test_places_miss_nothing(monkeypatch):
    model = _model(" you are an idiot and a moron such stupid trash and a loser here " * 50)
    restore = toxicity.restorer(model)
    monkeypatch.setattr(toxicity, "restore_stretch", lambda s, lm: f"<{s}>")
    draw = np.random.default_rng(7)
    kinds = ["ab  ", "a5$!|)  ", "éжa -", "日本 .a", "𐐀𐐁a ", "é e", "1 2a", "x"]
    marked = toxicity.restorer(model)
    for i in range(4000):
        parts = []
        for _ in range(int(draw.integers(1, 6))):
            parts.append("".join(draw.choice(list(kinds[draw.integers(len(kinds))]), int(draw.integers(1, 40)))))
            parts.append(draw.choice(["", " ", " " + "plain words " * 20]))
        text = "".join(parts)

        def mark(m):
            s = m[0]
            return s if len(s) > toxicity.LONGEST and toxicity.ONE_LETTER.fullmatch(s) else f"<{s}>"

        assert marked(text) == toxicity.SUSPICIOUS.sub(mark, text), text
    for text in ("é t é", "и д и о т", "日日日", "𐐀𐐀𐐀", "a5"):
        assert marked(text) == f"<{text}>"
    assert restore("") == ""
