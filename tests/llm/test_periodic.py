import hashlib
import random
import zlib

import pytest

from corpusloom.llm import periodic
from corpusloom.llm.queries import QUERIES, planted_repeats


def _brute(words, least=6, exponent=4):
    """All runs by trying every period at every place."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(least, exponent * p):
                # a stretch of several periods has the smallest one only
                if not any(s <= i and i + length <= s + m and p % q == 0 for s, m, q in found):
                    found[i, length, p] = True
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def _drawn(draw):
    words = [draw.randrange(draw.choice([1, 2, 3, 5])) for _ in range(draw.randint(0, 45))]
    if len(words) > 4 and draw.random() < 0.6:
        period, start = draw.randint(1, 5), draw.randint(0, len(words) - 1)
        for i in range(start + period, len(words)):
            words[i] = words[i - period]
    return words


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (2, 2), (4, 3), (5, 2.5)])
def test_runs_against_all_periods(least, exponent):
    draw = random.Random(7)
    for _ in range(800):
        words = _drawn(draw)
        want = _brute(words, least, exponent)
        assert periodic.runs_in(words, least, exponent) == want
        text = [b"w%d" % w for w in words]
        # texts side by side do not touch each other
        found = periodic._runs_of_texts([text, text, [b"w0"], text], least, exponent)
        assert [found.get(i, []) for i in (0, 1, 2, 3)] == [want, want, [], want]


def test_groups_are_equal_lyndon_words():
    draw = random.Random(2)
    for _ in range(300):
        w = [draw.randrange(3) for _ in range(draw.randint(1, 30))]
        length, group = periodic.lyndon_groups(w)
        n = len(w)
        for i in range(n):
            smaller = (j for j in range(i + 1, n) if w[j:] < w[i:])
            assert length[i] == next(smaller, n) - i
        words = [tuple(w[i : i + length[i]]) for i in range(n)]
        # the order of the groups is that of the words
        assert sorted(range(n), key=lambda i: (group[i], i)) == sorted(range(n), key=lambda i: (words[i], i))
        assert all((group[i] == group[j]) == (words[i] == words[j]) for i in range(n) for j in range(i))


def _planted(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def test_planted_repeats(docs):
    rows = {(r.doc_id, r.text) for r in planted_repeats(docs).collect()}
    for r in docs.collect():
        want = b" ".join(_planted(r.doc_id, r.text)).decode()
        assert any(i == r.doc_id and " ".join((t or "").encode().decode().split()) == " ".join(want.split()) for i, t in rows)


def test_query_against_brute_force(spark, tmp_path):
    draw = random.Random(4)
    rows = []
    for i in range(400):
        n = draw.choice([0, 1, 3, 8, 30, 90])
        text = " ".join(f"w{draw.randrange(draw.choice([1, 2, 40]))}" for _ in range(n))
        rows.append((i, draw.choice([text, text + "\n " + text, " \t" + text])))
    rows += [(1000, None), (1000, None), (None, "a a a a a a a"), (1001, "a b " * 4000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()), key=str)
    want = []
    for doc_id, text in rows:
        words = _planted(doc_id, text)
        runs = _brute(words)
        gone = {i for s, m, p in runs for i in range(s + p, s + m)}
        s, m, p = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        left = b" ".join(w for i, w in enumerate(words) if i not in gone)
        digests = [hashlib.sha256(x).hexdigest() for x in (listed.encode(), left)]
        want.append((doc_id, len(runs), s, m, p, 1000 * m // p if p else None, *digests))
    assert got == sorted(want, key=str)


def test_odd_texts_and_empty_table(docs, texts, nothing):
    found = periodic.find_runs(docs).collect()
    assert len(found) == len(texts) + 2
    assert all(r.runs == [] and r.collapsed == "" for r in found if r.n_words == 0)
    assert periodic.find_runs(nothing).collect() == []
