"""Interpolated modified Kneser-Ney language model of word pairs.

Spark counts the pairs: tasks count what they read, and sorted runs of hashed
pairs are brought together by bucket of their first word.  Each bucket becomes
sorted hash arrays in the shared folder, which workers map into memory, so the
pages of a model are shared by all workers of a machine and nothing of it
passes through the driver but a few sums.

    p(w | u) = max(c(u,w) - D(c), 0) / c(u) + g(u) p(w)
    p(w)     = max(n(w) - D'(n), 0) / sum n + g' / (V + 1)

c are pair counts, n(w) the number of different words in front of w, and the
three discounts of each level follow from its counts of counts.

The folder in ``spark.checkpoint.dir`` must be a mounted one (``file:`` or a
plain path): memory mapping needs files.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import materialise, work_path

# Bytes of text for each bucket of the model.
BUCKET_BYTES = 16 << 20
# Tokens counted together, and scored together.
CHUNK = 2_000_000
SCORE_CHUNK = 500_000
SLICE = 4 << 20
START, END = b" start", b" end"  # with a blank, which no word has
MIX = np.uint64(0x9E3779B97F4A7C15)
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
MOUNTED = re.compile(r"^(?:file:)?(/.*)$")


def word_hashes(text: str | None) -> np.ndarray:
    """START, every word of the lower-cased (A-Z) text, END; as 64-bit hashes."""
    from xxhash import xxh64_intdigest

    raw = (text or "").encode("utf-8", "replace").lower()
    parts, at = [np.array([xxh64_intdigest(START)], np.uint64)], 0
    while at < len(raw):  # very long texts are split in slices of whole words
        cut = _BLANK.search(raw, at + SLICE)
        stop = cut.start() if cut else len(raw)
        words = raw[at:stop].split()
        parts.append(np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)))
        at = stop
    parts.append(np.array([xxh64_intdigest(END)], np.uint64))
    return np.concatenate(parts)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


def pair_key(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mixed(mixed(u) * np.uint64(3) + v)


def bucket_of(u: np.ndarray, v: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a pair: that of its first word; pairs of a very frequent
    first word are dealt out by the second."""
    by = np.where(np.isin(u, hot), mixed(v), mixed(u)) if len(hot) else mixed(u)
    return (by % np.uint64(buckets)).astype(np.int64)


def frequent_words(docs: DataFrame, text_col: str, buckets: int) -> np.ndarray:
    """Words of more than a quarter of a bucket's share, in about a thousandth of
    the texts (all of few).  They only balance the work: results do not depend on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words, times = np.unique(word_hashes(text), return_counts=True)
                yield pa.record_batch([pa.array(words.view(np.int64)), pa.array(times)], names=["w", "n"])

    few = docs.where(F.pmod(F.xxhash64(text_col), F.lit(997)) == 0).select(text_col)
    counted = few.mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    counted = materialise(counted, "lm-frequent")
    total = counted.agg(F.sum("n")).first()[0] or 0
    often = counted.where(F.col("n") * 4 * buckets > total).where("n > 1")  # at most 4 * buckets rows
    return np.array([r.w for r in often.select("w").collect()], np.int64).view(np.uint64)


def _runs(u, v, buckets: int, hot) -> Iterator[tuple]:
    """Different pairs with their counts, cut by bucket."""
    _, first, times = np.unique(pair_key(u, v), return_index=True, return_counts=True)
    u, v = u[first], v[first]
    b = bucket_of(u, v, hot, buckets)
    order = np.argsort(b, kind="stable")
    b = b[order]
    cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    for start, stop in zip(cuts, np.r_[cuts[1:], len(b)], strict=True):
        at = order[start:stop]
        yield int(b[start]), u[at].tobytes(), v[at].tobytes(), times[at].astype(np.uint32).tobytes()


def _pairs_in_tasks(buckets: int, hot: np.ndarray):
    schema = pa.schema([("b", pa.int32()), ("u", pa.binary()), ("v", pa.binary()), ("c", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held):
            u = np.concatenate([w[:-1] for w in held])
            v = np.concatenate([w[1:] for w in held])
            columns = zip(*_runs(u, v, buckets, hot), strict=True)
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        held, size = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = word_hashes(text)
                held.append(words)
                size += len(words)
                if size >= CHUNK:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _save(folder: str, name: str, array: np.ndarray) -> None:
    """A task that runs twice leaves one whole file."""
    os.makedirs(folder, exist_ok=True)
    part = f"{folder}/.{name}-{uuid.uuid4().hex}.npy"
    np.save(part, array)
    os.replace(part, f"{folder}/{name}.npy")


def _counts_of_counts(c: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(c, 5), minlength=6)[1:5].tolist()


CONTEXT = np.dtype([("u", "<u8"), ("total", "<u8"), ("n1", "<u4"), ("n2", "<u4"), ("n3", "<u4")])


def _pair_bucket(folder: str, buckets: int, hot: np.ndarray):
    """Brings the runs of a bucket together, writes its arrays, and passes on, by
    bucket of the second word, in how many pairs it stands and how often."""

    def run(table: pa.Table) -> pa.Table:
        b = table.column("b")[0].as_py()
        u, v = _joined(table, "u", np.uint64), _joined(table, "v", np.uint64)
        c = _joined(table, "c", np.uint32).astype(np.uint64)
        key, first, inverse = np.unique(pair_key(u, v), return_index=True, return_inverse=True)
        c = np.bincount(inverse, weights=c, minlength=len(key)).astype(np.uint64)
        u, v = u[first], v[first]
        _save(folder, f"key-{b}", key)
        _save(folder, f"count-{b}", np.minimum(c, 0xFFFFFFFF).astype(np.uint32))
        who, at = np.unique(u, return_inverse=True)
        context = np.zeros(len(who), CONTEXT)
        context["u"] = who
        context["total"] = np.bincount(at, weights=c)
        for n, ok in (("n1", c == 1), ("n2", c == 2), ("n3", c > 2)):
            context[n] = np.bincount(at, weights=ok)
        spread = np.isin(who, hot)
        _save(folder, f"context-{b}", context[~spread])
        second, at = np.unique(v, return_inverse=True)
        n, total = np.bincount(at), np.bincount(at, weights=c).astype(np.uint64)
        target = (mixed(second) % np.uint64(buckets)).astype(np.int64)
        out = {"kind": [], "b": [], "w": [], "n": [], "c": []}

        def add(kind, b, w, n, c):
            for name, value in zip(out, (kind, b, w, n, c), strict=True):
                out[name].append(value)

        add("hot", b, context[spread].tobytes(), b"", b"")
        add("sums", b, np.array(_counts_of_counts(c), np.int64).tobytes(), b"", b"")
        order = np.argsort(target, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(target[order]) != 0])
        for i, j in zip(cuts, np.r_[cuts[1:], len(order)], strict=True):
            some = order[i:j]
            add("word", int(target[some[0]]), second[some].tobytes(), n[some].astype(np.uint32).tobytes(),
                total[some].astype("<u8").tobytes())
        return pa.table(
            {"kind": pa.array(out["kind"]), "b": pa.array(out["b"], pa.int32()),
             **{k: pa.array(out[k], pa.binary()) for k in "wnc"}}
        )

    return run


WORD = np.dtype([("w", "<u8"), ("c", "<u8"), ("n", "<u4")])


def _word_bucket(folder: str):
    def run(table: pa.Table) -> pa.Table:
        b = table.column("b")[0].as_py()
        w, at = np.unique(_joined(table, "w", np.uint64), return_inverse=True)
        words = np.zeros(len(w), WORD)
        words["w"] = w
        words["c"] = np.bincount(at, weights=_joined(table, "c", "<u8"))
        words["n"] = np.bincount(at, weights=_joined(table, "n", np.uint32))
        _save(folder, f"word-{b}", words)
        sums = [len(words), int(words["c"].sum()), int(words["n"].sum()), *_counts_of_counts(words["n"])]
        return pa.table({"sums": pa.array([sums], pa.list_(pa.int64()))})

    return run


def discounts(n: list[int]) -> np.ndarray:
    """Discounts of counts 1, 2 and 3 or more; 0 in front for the count 0.

    Tables too small to have counts of counts fall back to half an occurrence.
    """
    n1, n2, n3, n4 = map(float, n)
    if min(n1, n2) == 0:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2 - 3 * y * n3 / n2]
    return np.array([0.0, *(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))])


def train(docs: DataFrame, text_col: str = "text") -> dict:
    """Counts all texts (null: empty) and writes the model; returns where it is and its sums."""
    spark = docs.sparkSession
    root = work_path(spark, "lm")
    plain = MOUNTED.match(re.sub(r"^file:/+", "file:/", root))
    if not plain:
        raise ValueError("spark.checkpoint.dir must be a mounted folder for memory-mapped models")
    folder = plain[1]
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(16, 1 << (int(size) // BUCKET_BYTES).bit_length())
    hot = frequent_words(docs, text_col, buckets)
    pairs = docs.select(text_col).mapInArrow(
        _pairs_in_tasks(buckets, hot), "b int, u binary, v binary, c binary"
    )
    merged = materialise(
        pairs.groupBy("b").applyInArrow(
            _pair_bucket(folder, buckets, hot), "kind string, b int, w binary, n binary, c binary"
        ),
        "lm-pairs",
    )
    pair_sums = np.zeros(4, np.int64)
    contexts = []
    # one row for each bucket
    for r in merged.where("kind IN ('sums', 'hot')").select("kind", "w").toLocalIterator():
        if r.kind == "sums":
            pair_sums += np.frombuffer(bytes(r.w), np.int64)
        else:
            contexts.append(np.frombuffer(bytes(r.w), CONTEXT))
    parts = np.concatenate(contexts) if contexts else np.zeros(0, CONTEXT)
    who, at = np.unique(parts["u"], return_inverse=True)
    frequent = np.zeros(len(who), CONTEXT)
    frequent["u"] = who
    for n in CONTEXT.names[1:]:
        frequent[n] = np.bincount(at, weights=parts[n], minlength=len(who))
    words = merged.where("kind = 'word'").groupBy("b").applyInArrow(_word_bucket(folder), "sums array<long>")
    word_sums = np.zeros(7, np.int64)
    for r in materialise(words, "lm-words").collect():
        word_sums += np.array(r.sums)
    return {
        "folder": folder, "buckets": buckets, "hot": hot, "frequent": frequent,
        "vocabulary": int(word_sums[0]), "tokens": int(word_sums[1]), "continuations": int(word_sums[2]),
        "word_discounts": discounts(word_sums[3:].tolist()), "pair_discounts": discounts(pair_sums.tolist()),
        "word_counts": word_sums[3:].tolist(),
    }


class Arrays:
    """The model's arrays, mapped into memory when a bucket is first asked for."""

    def __init__(self, model: dict):
        self.model, self.open = model, {}

    def get(self, name: str) -> np.ndarray | None:
        if name not in self.open:
            path = f"{self.model['folder']}/{name}.npy"
            self.open[name] = np.load(path, mmap_mode="r") if os.path.exists(path) else None
        return self.open[name]

    def find(self, kind: str, field: str | None, keys: np.ndarray, bucket: np.ndarray, columns: list):
        """Values of ``columns`` for every key (0 where it is missing), bucket by bucket."""
        out = [np.zeros(len(keys)) for _ in columns]
        order = np.lexsort((keys, bucket))
        cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
        for i, j in zip(cuts, np.r_[cuts[1:], len(order)], strict=True):
            at = order[i:j]
            b = int(bucket[at[0]])
            stored = self.get(f"{kind}-{b}")
            if stored is None or not len(stored):
                continue
            known = stored if field is None else stored[field]
            place = np.minimum(np.searchsorted(known, keys[at]), len(known) - 1)
            hit = known[place] == keys[at]
            for o, column in zip(out, columns, strict=True):
                values = self.get(f"count-{b}") if column is None else stored[column]
                o[at[hit]] = values[place[hit]]
        return out


def log_probabilities(words: list[np.ndarray], arrays: Arrays):
    """(model log10 p, base log10 p, known) of every token of every text, in one row."""
    m = arrays.model
    u, v = np.concatenate([w[:-1] for w in words]), np.concatenate([w[1:] for w in words])
    buckets = np.uint64(m["buckets"])
    word, at = np.unique(v, return_inverse=True)
    c, n = (x[at] for x in arrays.find("word", "w", word, (mixed(word) % buckets).astype(np.int64), ["c", "n"]))
    size, vocabulary = m["tokens"], m["vocabulary"]
    base = np.log10((c + 0.5) / (size + 0.5 * (vocabulary + 1)))
    d = m["word_discounts"]
    if m["continuations"]:
        n1, n2 = m["word_counts"][:2]
        left = d[1] * n1 + d[2] * n2 + d[3] * (vocabulary - n1 - n2)
        lower = np.maximum(n - d[np.minimum(n, 3).astype(int)], 0) / m["continuations"]
        lower = lower + left / m["continuations"] / (vocabulary + 1)
    else:
        lower = np.full(len(v), 1.0 / (vocabulary + 1))
    key, first, at = np.unique(pair_key(u, v), return_index=True, return_inverse=True)
    (times,) = arrays.find("key", None, key, bucket_of(u[first], v[first], m["hot"], m["buckets"]), [None])
    times = times[at]
    who, at = np.unique(u, return_inverse=True)
    context = arrays.find(
        "context", "u", who, (mixed(who) % buckets).astype(np.int64), ["total", "n1", "n2", "n3"]
    )
    frequent = m["frequent"]
    if len(frequent):
        place = np.minimum(np.searchsorted(frequent["u"], who), len(frequent) - 1)
        hit = frequent["u"][place] == who
        for values, name in zip(context, CONTEXT.names[1:], strict=True):
            values[hit] = frequent[name][place[hit]]
    total, n1, n2, n3 = (x[at] for x in context)
    d = m["pair_discounts"]
    seen = total > 0
    total = np.where(seen, total, 1)
    upper = np.maximum(times - d[np.minimum(times, 3).astype(int)], 0) / total
    back = np.where(seen, (d[1] * n1 + d[2] * n2 + d[3] * n3) / total, 1.0)
    return np.log10(upper + back * lower), base, c > 0


def score(docs: DataFrame, model: dict, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, n_tokens, n_known, base_score, score)`` of every whole text (null: empty)."""
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = Arrays(model)

        def flush(ids, held):
            model_p, base_p, known = log_probabilities(held, arrays)
            sizes = np.array([len(w) - 1 for w in held])
            starts = np.cumsum(sizes) - sizes
            sums = [np.add.reduceat(x, starts) for x in (known.astype(np.int64), base_p, model_p)]
            return pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes), *map(pa.array, sums)], names=names)

        ids, held, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = word_hashes(text)
                ids.append(doc_id)
                held.append(words)
                size += len(words)
                if size >= SCORE_CHUNK:
                    yield flush(ids, held)
                    ids, held, size = [], [], 0
        if held:
            yield flush(ids, held)

    shape = "doc_id long, n_tokens long, n_known long, base_score double, score double"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, shape)


def held_out(id_col: str = "doc_id"):
    """Rows that are not learned from: crc32 of the id as text, modulo 5, is 1.
    Rows without an id are not learned from either."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1


def perplexity(scored: DataFrame) -> DataFrame:
    """Adds ``perplexity``: ten to the minus mean log10 probability of a token."""
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
