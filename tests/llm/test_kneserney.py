import math
from collections import Counter, defaultdict

import numpy as np

from corpusloom.llm import kneserney


def _tokens(text):
    return (text or "").encode().lower().split() + [b" end"]


def _brute(train, texts):
    c, pairs = Counter(), Counter()
    for t in train:
        w = _tokens(t)
        c.update(w)
        pairs.update(zip([b" start", *w], w))
    behind = Counter(v for _, v in pairs)
    context = defaultdict(lambda: [0, 0, 0, 0])
    for (u, _), k in pairs.items():
        context[u][0] += k
        context[u][min(k, 3)] += 1
    of = lambda counts: kneserney.discounts([sum(x == k for x in counts.values()) for k in (1, 2, 3, 4)])
    d, e, n, v1, s = of(pairs), of(behind), sum(c.values()), len(c), sum(behind.values())
    rest = sum(e[min(x, 3)] for x in behind.values()) / s

    def word(v):
        x = behind.get(v, 0)
        return max(x - e[min(x, 3)], 0) / s + rest / (v1 + 1)

    for t in texts:
        w, score, base = _tokens(t), 0.0, 0.0
        for u, v in zip([b" start", *w], w):
            base += math.log10((c.get(v, 0) + 0.5) / (n + 0.5 * (v1 + 1)))
            x, k = context.get(u), pairs.get((u, v), 0)
            p = word(v)
            if x:
                p = max(k - d[min(k, 3)], 0) / x[0] + sum(d[j] * x[j] for j in (1, 2, 3)) / x[0] * p
            score += math.log10(p)
        yield len(w), sum(v in c for v in w), base, score


def test_scores_against_brute_force(docs, texts):
    train = docs.where("doc_id IS NOT NULL AND doc_id NOT IN (3, 13)")
    model = kneserney.train(train)
    want = list(_brute([r.text for r in train.collect()], texts))
    found = kneserney.score(docs, model).collect()
    assert len(found) == len(texts) + 2
    for r in found:
        n, known, base, score = want[3 if r.doc_id is None else r.doc_id]
        assert (r.n_tokens, r.n_known) == (n, known)
        assert abs(r.base_score - base) < 1e-6 and abs(r.score - score) < 1e-6


def test_frequent_words_only_balance_the_work(docs, monkeypatch):
    plain = sorted(kneserney.score(docs, kneserney.train(docs)).collect(), key=str)
    hot = kneserney.word_hashes("one two " + " ".join(docs.where("doc_id = 0").first().text.split()[:50]))
    monkeypatch.setattr(kneserney, "frequent_words", lambda *a: np.unique(hot))
    other = sorted(kneserney.score(docs, kneserney.train(docs)).collect(), key=str)
    assert all(abs(a.score - b.score) < 1e-9 and a.n_known == b.n_known for a, b in zip(plain, other, strict=True))


def test_nothing_learned(nothing, docs):
    model = kneserney.train(nothing)
    assert kneserney.score(nothing, model).count() == 0
    assert all(math.isfinite(r.score) and r.n_known == 0 for r in kneserney.score(docs, model).collect())


def test_long_texts_are_cut_between_words(monkeypatch):
    text = " ".join(f"word{i}" for i in range(500))
    whole = kneserney.word_hashes(text)
    monkeypatch.setattr(kneserney, "SLICE", 64)
    assert np.array_equal(kneserney.word_hashes(text), whole)
