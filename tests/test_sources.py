import pytest
from pyspark.sql import functions as F

from corpusloom.models import scoring, sweep
from corpusloom.sources import audit, fingerprint, feeds, files, pages, synthetic


def test_csv_round_trip_awkward_text(spark, tmp_path):
    data = [(1, 'say "hi"\nnext, line'), (2, None), (3, "back\\slash"), (4, "é 😀")]
    df = spark.createDataFrame(data, "row_id long, text string")
    files.write_csv(df, str(tmp_path / "t"))
    got = files.read_csv(spark, str(tmp_path / "t"), "row_id long, text string")
    assert sorted((r[0], r[1]) for r in got.collect()) == data


def test_csv_index_column(spark, tmp_path):
    (tmp_path / "x.csv").write_text(',text\n7,"a\nb"\n9,c\n')
    got = files.read_csv(spark, str(tmp_path / "x.csv"), "text string", index_col="idx")
    assert [tuple(r) for r in got.orderBy("idx").collect()] == [(7, "a\nb"), (9, "c")]


def test_json_cap(spark, tmp_path):
    spark.range(20).withColumnRenamed("id", "row_id").write.json(str(tmp_path / "j"))
    got = files.read_json_lines(spark, str(tmp_path / "j"), "row_id long", 3)
    assert [r[0] for r in got.collect()] == [0, 1, 2]


def test_split_writer_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"])], "row_id long, parts array<string>")
    files.write_split(df, df, str(tmp_path), "csv")
    got = files.read_csv(spark, f"{tmp_path}/test", "row_id long, parts string").first()
    assert got["parts"] == '["a","b"]'


RSS = """<rss><channel><title>feed</title>{}</channel></rss>"""
ITEM = "<item><title>T{0}</title><link>http://x/{0}</link><pubDate>d</pubDate><guid>{0}</guid><description>{1}</description></item>"
ATOM = """<feed><entry><title>A</title><link href="http://y/1"/><published>d</published><id>k</id><summary>{}</summary></entry></feed>"""


def test_feeds(spark, tmp_path):
    items = [ITEM.format(1, "s" * 201), ITEM.format(2, "short"), ITEM.format(10, "l" * 1500)]
    (tmp_path / "a.xml").write_text(RSS.format("".join(items)))
    (tmp_path / "b.xml").write_text(RSS.format(ITEM.format(5, "m" * 200)))
    entries = feeds.read_rss(spark, str(tmp_path))
    assert entries.count() == 4
    got = feeds.feed_articles(entries, max_articles=2)
    # the cap comes first, so entry 10 is not moved up; 200 characters are too short
    assert [(r["feed"], r["entry_id"]) for r in got.collect()] == [("a.xml", "1")]
    wide = feeds.feed_articles(entries, max_articles=9).orderBy(F.expr("int(entry_id)")).collect()
    assert [len(r["text"]) for r in wide] == [201, 1000]


def test_atom(spark, tmp_path):
    (tmp_path / "c.xml").write_text(ATOM.format("z" * 300))
    row = feeds.read_atom(spark, str(tmp_path)).first()
    assert (row["feed"], row["url"], row["title"], row["date"]) == ("c.xml", "http://y/1", "A", "d")
    assert feeds.feed_articles(feeds.read_atom(spark, str(tmp_path))).count() == 1


HTML = """<html><head><title>A &amp; B</title><style>p{}</style></head><body><nav>menu</nav>
<article><h1>Head</h1><p>One <b>two</b><br>three</p><!-- no --><script>var x="</p>";</script></article>
<footer>foot</footer></body></html>"""


def test_articles(spark):
    df = spark.createDataFrame(
        [(1, "u1", HTML), (2, "u2", None), (3, "u3", "<body>only body</body>"), (4, "u4", "<p></p>")],
        "page_id long, url string, html string",
    )
    got = {r["page_id"]: r for r in pages.extract_articles(df).collect()}
    assert set(got) == {1, 3}
    assert got[1]["title"] == "A & B" and got[1]["text"] == "Head One two three"
    assert got[3]["title"] is None and got[3]["text"] == "only body"
    assert pages.extract_articles(df, 2).orderBy("page_id").first()["text"] == "Head One"


def test_index_list_and_table_agree(spark):
    df = spark.createDataFrame(
        [(i, u) for i, u in enumerate(
            ["http://a.com/x/1", "https://a.com/y", "http://b.org/n_1", "http://b.org/nx1", None, "", "a.com"]
        )],
        "page_id long, url string",
    )
    entries = [
        {"domain": "a.com", "pattern": "*"},
        {"domain": "a.com", "pattern": "x/*"},
        {"domain": "b.org", "pattern": "n_*"},
    ]
    table = spark.createDataFrame([(e["domain"], e["pattern"]) for e in entries], "domain string, pattern string")
    got = sorted((r["page_id"], r["pattern"]) for r in pages.match_index(df, entries).collect())
    assert got == [(0, "*"), (0, "x/*"), (1, "*"), (2, "n_*")]
    assert sorted((r["page_id"], r["pattern"]) for r in pages.match_index(df, table).collect()) == got
    assert pages.match_index(df, entries, limit=1).count() == 3


def test_synthetic(spark):
    posts = synthetic.synthetic_posts(spark, 25)
    assert posts.groupBy("is_bs").count().collect()[0]["count"] == 25
    assert posts.select("row_id").distinct().count() == 50
    assert sorted(posts.collect()) == sorted(synthetic.synthetic_posts(spark, 25).collect())
    assert not posts.filter(F.contains("text", F.lit("%s"))).count()


def test_audit_tables(spark, tmp_path):
    path = str(tmp_path / "m")
    audit.log_metrics(spark, path, "r1", {"f1": 0.5, "n": 3, "note": "x", "flag": True}, step=2)
    audit.log_metrics(spark, path, "r2", {"f1": 0.7})
    got = sorted((r["run"], r["metric"], r["value"], r["step"]) for r in spark.read.parquet(path).collect())
    assert got == [("r1", "f1", 0.5, 2), ("r1", "n", 3.0, 2), ("r2", "f1", 0.7, 0)]
    (tmp_path / "one.bin").write_bytes(b"abc")
    row = fingerprint.file_fingerprint(spark, str(tmp_path), "*.bin").first()
    assert row["size_bytes"] == 3 and row["md5"] == "900150983cd24fb0d6963f7d28e17f72"
    df = spark.range(50).withColumn("t", F.lit("x"))
    assert (
        audit.content_fingerprint(df, ["id", "t"]).first()
        == audit.content_fingerprint(df.repartition(7), ["id", "t"]).first()
        != audit.content_fingerprint(df.filter("id > 0"), ["id", "t"]).first()
    )


def test_sweep_records_failures(spark, tmp_path):
    def run(config):
        if config["bad"]:
            raise RuntimeError("boom")
        return {"f1": 1.0}

    status = sweep.run_experiments(spark, {"a": {"bad": False}, "b": {"bad": True}}, str(tmp_path), run)
    assert sorted((r["run"], r["status"]) for r in status.collect()) == [("a", "finished"), ("b", "failed")]


def test_python_model_formats(spark):
    df = spark.createDataFrame([(1, "x"), (2, "yy")], "row_id long, text string")
    scored = scoring.score_with_function(df, lambda: lambda texts: [{"label": len(t)} for t in texts])
    minimal, full = scoring.label_outputs(scored)
    assert [tuple(r) for r in full.orderBy("row_id").collect()] == [(1, "x", "1", None), (2, "yy", "2", None)]
    assert minimal.columns == ["row_id", "text", "is_bs"]


def test_missing_schema_column(spark):
    with pytest.raises(ValueError):
        sweep.external_evaluation(None, {})


def test_newest_entries_first(spark, tmp_path):
    def item(guid, date):
        return f"<item><title>T</title><link>http://x/{guid}</link><pubDate>{date}</pubDate><guid>http://g/{guid}</guid><description>{'s' * 201}</description></item>"

    dates = {
        "a": "Fri, 01 Dec 2023 08:00:00 GMT", "b": "Wed, 03 Jan 2024 08:00:00 +0100",
        "c": "2024-01-02T10:00:00Z", "d": "no date", "e": "3 Jan 2024 07:30 GMT",
    }
    (tmp_path / "f.xml").write_text(RSS.format("".join(item(g, d) for g, d in dates.items())))
    entries = feeds.read_rss(spark, str(tmp_path))
    heads = [
        sorted(r["entry_id"][-1] for r in feeds.feed_articles(entries, max_articles=n).collect())
        for n in range(1, 6)
    ]
    assert heads == [["e"], ["b", "e"], ["b", "c", "e"], ["a", "b", "c", "e"], ["a", "b", "c", "d", "e"]]


def test_atom_takes_the_alternate_link(spark, tmp_path):
    links = '<link rel="replies" href="http://y/replies"/><link rel="alternate" href="http://y/page"/><link rel="self" href="http://y/self"/>'
    entry = "<entry><title>A</title>{}<published>2024-01-02T10:00:00Z</published><id>{}</id><summary>s</summary></entry>"
    text = entry.format(links, "1") + entry.format('<link href="http://y/bare"/>', "2") + entry.format("", "3")
    (tmp_path / "a.xml").write_text(f"<feed>{text}</feed>")
    got = {r["entry_id"]: r["url"] for r in feeds.read_atom(spark, str(tmp_path)).collect()}
    assert got == {"1": "http://y/page", "2": "http://y/bare", "3": None}


def test_index_hosts_in_any_case_with_wildcards_and_quotas(spark):
    rows = [(1, "http://A.com/x"), (2, "https://www.a.com/X"), (3, "http://b.org/x"), (4, "http://a.com/y")]
    df = spark.createDataFrame([(i, u, "<p>t</p>") for i, u in rows], "page_id long, url string, html string")
    entries = [{"domain": "a.com", "pattern": "*"}, {"domain": "*.a.com", "pattern": "*"}, {"domain": "a.com", "pattern": "*"}]
    for given in (entries, spark.createDataFrame([(e["domain"], e["pattern"]) for e in entries[:2]], "domain string, pattern string")):
        got = sorted((r["domain"], r["page_id"]) for r in pages.match_index(df, given, 5).collect())
        twice = 2 if given is entries else 1
        assert got == sorted([("*.a.com", 2)] + [("a.com", 1), ("a.com", 4)] * twice)
    one_each = pages.match_index(df, entries, 1).collect()
    assert sorted((r["entry_no"], r["page_id"]) for r in one_each) == [(0, 1), (1, 2), (2, 1)]


def test_wildcard_hosts_join_by_their_last_labels(spark, monkeypatch):
    import itertools
    import re

    from corpusloom import bounded

    hosts = ["a.com", "www.a.com", "x.y.a.com", "aa.com", "com", "news.b.org", "newsb.org", "b.org:80", "c.net"]
    rows = [(i, f"http://{h}/{p}", c) for i, (h, p, c) in enumerate(itertools.product(hosts, ["x", "n/a.com/q", ""], ["k", "l"]))]
    df = spark.createDataFrame([*rows, (900, "http://a.com", "k"), (901, "", "k"), (902, None, "k")], "page_id long, url string, crawl string")
    domains = ["*.a.com", "*a.com", "*", "news*", "*.b.org*", "www.*.com", "a.com", "A.com", "x.*.com", "*.*", "n%.org"]
    entries = [(d, p, c) for d in domains for p, c in (("*", None), ("n/*", "k"))]
    table = spark.createDataFrame(entries, "domain string, pattern string, index string")
    listed = [dict(zip(("domain", "pattern", "index"), e, strict=True)) for e in entries]

    def takes(star, text):
        return re.fullmatch(".*".join(map(re.escape, star.split("*"))), text) is not None

    want = []
    for i, url, crawl in [tuple(r) for r in df.where("url <> ''").collect()]:
        host, _, rest = url.removeprefix("http://").partition("/")
        slash = "/" if url.count("/") > 2 else ""
        for d, p, c in entries:
            if takes(d.lower(), host) and takes("/" + p, slash + rest) and c in (None, crawl):
                want.append((d, p, i))
    want.sort()
    assert len(want) > 150
    in_list = pages.match_index(df, listed, None, crawl_col="crawl").collect()
    assert sorted((r.domain, r.pattern, r.page_id) for r in in_list) == want
    for rows_at_most in (100_000, 0):
        monkeypatch.setattr(bounded, "MAX_ROWS", rows_at_most)
        monkeypatch.setattr(bounded.join_checked, "__defaults__", ("inner", rows_at_most))
        found = pages.match_index(df, table, None, crawl_col="crawl")
        assert sorted((r.domain, r.pattern, r.page_id) for r in found.collect()) == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_tree_hash_of_files_by_ranges(spark, tmp_path, monkeypatch):
    import hashlib
    import random

    monkeypatch.setattr(fingerprint, "LEAVES_IN_TASK", 3)
    draw = random.Random(4)
    (tmp_path / "deep").mkdir()
    contents = {f"deep/f{n}.bin": draw.randbytes(n) for n in (0, 1, 99, 100, 101, 900, 3333, 12_345)}
    contents |= {"other.txt": b"x", ".hidden.bin": b"y", "_SUCCESS": b""}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)

    def root(content, leaf, fan):
        level = [hashlib.sha256(content[i : i + leaf]).digest() for i in range(0, max(1, len(content)), leaf)]
        while len(level) > 1:
            groups = [level[i : i + fan] for i in range(0, len(level), fan)]
            level = [hashlib.sha256(b"".join(g)).digest() if len(g) > 1 else g[0] for g in groups]
        return level[0].hex()

    for leaf, fan in ((100, 4), (1 << 20, 4), (64, 1024)):
        found = fingerprint.tree_hashes(spark, str(tmp_path), "*.bin", leaf, fan).collect()
        got = {r.path.removeprefix(f"{tmp_path}/"): (r.size_bytes, r.tree_sha256) for r in found}
        assert got == {n: (len(c), root(c, leaf, fan)) for n, c in contents.items() if n.startswith("deep")}
    one = fingerprint.file_fingerprint(spark, str(tmp_path / "deep/f3333.bin"), None, 100).collect()
    assert [(r.size_bytes, r.md5) for r in one] == [(3333, hashlib.md5(contents["deep/f3333.bin"]).hexdigest())]
    assert fingerprint.tree_hashes(spark, str(tmp_path), "*.none").collect() == []


def test_feed_text_is_that_of_the_page_behind_the_link(spark):
    shape = "feed string, entry_id string, url string, title string, date string, text string"
    rows = [
        ("f", "1", "http://A.com/x/#c", "t", None, "<p>short</p>"),
        ("f", "2", "http://b.org/none", "t", None, "<b>R&amp;D</b><script>x()</script> of &#8220;own&#8221;<br>words"),
        ("f", "3", None, "t", None, None),
    ]
    page = "<html><body><nav>menu</nav><article><p>The {}</p></article></body></html>"
    pages_ = [("https://a.com/x", page.format("long article")), ("http://a.com/x", page.format("tale")), ("http://c.net/", None)]
    entries = spark.createDataFrame(rows, shape)
    stored = spark.createDataFrame(pages_, "url string, html string")
    got = {r.entry_id: r.text for r in feeds.article_texts(entries, stored).collect()}
    assert got == {"1": "The long article", "2": "R&D of \u201cown\u201d words", "3": None}
    assert {r.entry_id: r.text for r in feeds.article_texts(entries).collect()}["1"] == "short"
