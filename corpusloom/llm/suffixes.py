"""Removal of long byte strings that occur more than once, by sorted suffixes.

Every string of ``LENGTH`` bytes holds an anchor near its start: the place of
the smallest hash of a few bytes among the first ``REACH`` + 1.  Equal strings
have equal anchors at equal places, so it is enough to sort the suffixes that
start at anchors.

Anchors whose surroundings (all strings they can stand for) occur twice are
decided at once.  Of those that share only the bytes behind them, one of each
kind goes on: suffixes are range-partitioned by their leading bytes with
sampled splitters, sorted in their bucket by multikey quicksort, and compared
with their neighbours; in runs that share enough, the strings around the
anchors are compared.  A splitter never cuts through suffixes that share all
bytes a string must have behind its anchor, so no run lies on both sides of a
boundary; runs too large for one bucket are dealt out by the strings themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import parts
from corpusloom.session import materialise

LENGTH = 400
# Bytes from the start of a string to its anchor, at most.
REACH = 256
GRAM = 16
# Different surroundings of one suffix beyond which they are dealt out by string.
GROUP = 20_000
LEAD = 32
# Rows of a bucket, about; one with a large run has up to GROUP more.
BUCKET = 32_768
# Rows of a bucket turned into arrays or compared at once.
SLICE = 4096
# Bytes of surroundings whose strings are written out at once, 257 strings of each at most.
STRINGS_BYTES = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of every ``GRAM`` bytes, by doubling."""
    h, size, power = raw.astype(np.uint64) + np.uint64(1), 1, BASE
    while size < GRAM:
        h = h[: len(h) - size] * power + h[size:]
        size, power = 2 * size, power * power
    h = (h ^ (h >> np.uint64(32))) * BASE
    return h >> np.uint64(32)


def anchors_of(raw: np.ndarray, length: int, reach: int) -> np.ndarray:
    """Anchors of all strings of ``length`` bytes; the leftmost of equal hashes."""
    starts = len(raw) - length + 1
    if starts < 1:
        return np.zeros(0, np.int64)
    h = _gram_hashes(raw)[: starts + reach]
    value = (h << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    width = reach + 1
    # sliding minimum: running minima of blocks from both sides
    n = -(-len(value) // width) * width
    padded = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(value)] = value
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:starts], ahead[reach : reach + starts])
    at = least & np.uint64(0xFFFFFFFF)
    return at[np.flatnonzero(np.r_[True, at[1:] != at[:-1]])].astype(np.int64)


def _find_anchors(length: int, reach: int):
    names = ["doc_id", "tx", "pos", "key", "ctx", "before", "after"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest, xxh64_intdigest

        for batch in parts(batches):
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = (text or "").encode("utf-8", "replace")
                at = anchors_of(np.frombuffer(data, np.uint8), length, reach)
                if not len(at):
                    continue
                at = np.unique(at)
                first, last = np.maximum(at - reach, 0), np.minimum(at + length, len(data))
                places = at.tolist()
                key = [xxh3_64_intdigest(data[p : p + length - reach]) for p in places]
                ctx = [
                    # where the anchor stands in its surroundings belongs to them
                    xxh3_64_intdigest(data[a:b], p - a)
                    for p, a, b in zip(places, first.tolist(), last.tolist(), strict=True)
                ]
                n = len(places)
                yield pa.record_batch(
                    [
                        pa.array([doc_id] * n, pa.int64()),
                        pa.array(np.full(n, xxh64_intdigest(data, 42), np.uint64).view(np.int64)),
                        pa.array(at),
                        pa.array(np.array(key, np.uint64).view(np.int64)),
                        pa.array(np.array(ctx, np.uint64).view(np.int64)),
                        pa.array((at - first).astype(np.int32)),
                        pa.array((last - at).astype(np.int32)),
                    ],
                    names=names,
                )

    return run


def _cut_out(length: int, reach: int):
    """Bytes around the wanted places of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # texts that repeat with their id would be cut out several times
        seen = set()
        for batch in parts(batches):
            for doc_id, tx, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (doc_id, tx) in seen:
                    continue
                seen.add((doc_id, tx))
                data, n = (text or "").encode("utf-8", "replace"), len(wanted)
                yield pa.record_batch(
                    [
                        pa.array([doc_id] * n, pa.int64()),
                        pa.array([tx] * n, pa.int64()),
                        pa.array([w["pos"] for w in wanted], pa.int64()),
                        pa.array([w["alone"] for w in wanted], pa.bool_()),
                        pa.array([w["key"] for w in wanted], pa.int64()),
                        pa.array([w["ctx"] for w in wanted], pa.int64()),
                        pa.array([data[max(0, w["pos"] - reach) : w["pos"]] for w in wanted], pa.binary()),
                        pa.array([data[w["pos"] : w["pos"] + length] for w in wanted], pa.binary()),
                    ],
                    names=["doc_id", "tx", "pos", "alone", "key", "ctx", "before", "behind"],
                )

    return run


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """Order of the rows of ``words``, compared word by word from the left.

    Rows are split in three by one word of a pivot; those equal to it go on
    with the next word, so no word is looked at again once it has told rows
    apart.  Parts are kept on a stack, small ones are sorted directly.
    """
    order = np.arange(len(words))
    stack = [(0, len(words), 0)]
    while stack:
        start, stop, depth = stack.pop()
        if stop - start < 2 or depth == words.shape[1]:
            continue
        rows = order[start:stop]
        if stop - start <= 48:
            rest = words[rows, depth:]
            order[start:stop] = rows[np.lexsort(rest.T[::-1])]
            continue
        column = words[rows, depth]
        pivot = np.sort(column[:: max(1, len(column) // 15)])[7 if len(column) > 15 else 0]
        less, equal = column < pivot, column == pivot
        parts = rows[less], rows[equal], rows[~(less | equal)]
        order[start:stop] = np.concatenate(parts)
        a, b = start + len(parts[0]), start + len(parts[0]) + len(parts[1])
        stack += [(start, a, depth), (a, b, depth + 1), (b, stop, depth)]
    return order


def _matrix(values: list[bytes], width: int, right: bool) -> np.ndarray:
    """Rows of bytes, filled up with zeros in front (``right``) or behind."""
    padded = b"".join(v.rjust(width, b"\0") if right else v.ljust(width, b"\0") for v in values)
    return np.frombuffer(padded, np.uint8).reshape(len(values), width)


class Surroundings:
    """Bytes around anchors as one matrix, with hashes of all strings through the anchors."""

    def __init__(self, table: pa.Table, length: int, reach: int):
        n = table.num_rows
        self.length, self.reach = length, reach
        self.key = table.column("key").to_numpy()
        self.left, self.right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.bytes = np.zeros((n, reach + length), np.uint8)
        self.behind = self.bytes[:, reach:]
        for at in range(0, n, SLICE):
            some, rows = table.slice(at, SLICE), slice(at, at + SLICE)
            before, behind = some.column("before").to_pylist(), some.column("behind").to_pylist()
            self.left[rows] = [len(b) for b in before]
            self.right[rows] = [len(b) for b in behind]
            self.bytes[rows, :reach] = _matrix(before, reach, True)
            self.behind[rows] = _matrix(behind, length, False)

    def strings(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each number of bytes before the anchor, most first: the number, the rows that
        have the string starting there, and its hash.

        The hash rolls on by a byte, so only one of each row is held.
        """
        rolled, power = np.zeros(len(self.key), np.uint64), np.uint64(1)
        for j in range(self.length):
            rolled = rolled * BASE + self.bytes[:, j] + np.uint64(1)
            power *= BASE
        for ahead in range(self.reach, -1, -1):
            rows = np.flatnonzero((self.left >= ahead) & (self.right >= self.length - ahead))
            h = rolled[rows]
            yield ahead, rows, (h ^ (h >> np.uint64(31))) * BASE + self.key.view(np.uint64)[rows]
            if ahead:
                start = self.reach - ahead
                gone = (self.bytes[:, start] + np.uint64(1)) * power
                rolled = rolled * BASE + self.bytes[:, start + self.length] + np.uint64(1) - gone


def _sort_bucket(length: int, reach: int):
    """Sorts the suffixes of a bucket and compares the strings of neighbours that share enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        del held
        n = table.num_rows
        if n < 2:
            return
        around = Surroundings(table, length, reach)
        places = table.select(["doc_id", "tx", "pos", "alone"]).combine_chunks()
        del table
        # a worker outlives its task, and would keep that beside later stages
        pa.default_memory_pool().release_unused()
        words = np.ascontiguousarray(around.behind).view(">u8").astype(np.uint64)
        order = multikey_quicksort(words)
        del words
        # bytes that sorted neighbours share
        shared = np.zeros(n - 1, np.int64)
        for at in range(0, n - 1, SLICE):
            one, other = order[:-1][at : at + SLICE], order[1:][at : at + SLICE]
            differ = around.behind[other] != around.behind[one]
            alike = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
            shared[at : at + SLICE] = np.minimum(alike, np.minimum(around.right[other], around.right[one]))
        best = np.zeros(n, np.int64)
        best[order[1:]] = shared
        best[order[:-1]] = np.maximum(best[order[:-1]], shared)
        most, least = np.full(n, -1), np.full(n, reach + 1)
        for ahead, rows, h in around.strings():
            # a string must end within what the suffix shares with a neighbour
            able = best[rows] >= length - ahead
            rows, h = rows[able], h[able]
            if len(rows) < 2:
                continue
            by = np.argsort(h, kind="stable")
            same = h[by[1:]] == h[by[:-1]]
            twice = rows[by[np.r_[same, False] | np.r_[False, same]]]
            most[twice] = np.maximum(most[twice], ahead)
            least[twice] = np.minimum(least[twice], ahead)
        # surroundings that occur twice are covered whole anyway
        hit = (most >= 0) & places.column("alone").to_numpy()
        places = places.filter(pa.array(hit))
        pos = places.column("pos").to_numpy()
        yield pa.record_batch(
            [
                places.column("doc_id").combine_chunks(),
                places.column("tx").combine_chunks(),
                pa.array(pos - most[hit]),
                pa.array(pos + length - least[hit]),
            ],
            names=["doc_id", "tx", "start", "stop"],
        )

    return run


def _all_strings(length: int, reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, STRINGS_BYTES):
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            around, ctx = Surroundings(table, length, reach), table.column("ctx").to_numpy()
            found = [
                (h.view(np.int64), around.key[rows], ctx[rows], np.full(len(rows), ahead))
                for ahead, rows, h in around.strings()
            ]
            yield pa.record_batch(
                [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["h", "key", "ctx", "ahead"]
            )

    return run


def _dealt(around: DataFrame, n: int) -> DataFrame:
    """Rows in ``n`` ranges of their leading bytes; many rows of equal leading bytes are dealt
    out by their key, which stands for all bytes that strings through them share."""
    return around.repartitionByRange(n, F.substring("behind", 1, LEAD), "key")


def _keep_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the removed places of each text and keeps what is left."""
    for batch in parts(batches):
        out = []
        for doc_id, text, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = (text or "").encode("utf-8", "replace")
            spans: list[list[int]] = []
            for p in sorted((p["start"], p["stop"]) for p in places or []):
                if spans and p[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], p[1])
                else:
                    spans.append([*p])
            digest, at = hashlib.sha256(), 0
            for start, stop in spans:
                digest.update(data[at:start])
                at = stop
            digest.update(data[at:])
            removed = sum(b - a for a, b in spans)
            out.append((doc_id, len(data), removed, len(spans), digest.hexdigest(), spans))
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))]
        columns = list(zip(*out, strict=True)) or [()] * 6
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def repeated_spans(docs: DataFrame, length: int = LENGTH, reach: int = REACH, group: int = GROUP) -> DataFrame:
    """``(doc_id, tx, start, stop)``: byte ranges that strings of ``length`` bytes cover
    which also start anywhere else; ranges of a text may overlap."""
    found = materialise(
        docs.select("doc_id", "text").mapInArrow(
            _find_anchors(length, reach),
            "doc_id long, tx long, pos long, key long, ctx long, before int, after int",
        ),
        "suffix-anchors",
    )
    kinds = materialise(
        found.groupBy("key", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "tx", "pos")).alias("one")),
        "suffix-kinds",
        keep_shuffles=False,
    )
    several = materialise(
        kinds.groupBy("key").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 AND least = 1"),
        "suffix-several",
        keep_shuffles=False,
    )
    # surroundings that occur twice are covered whole, wherever they stand
    whole = found.join(kinds.where("n > 1").select("key", "ctx"), ["key", "ctx"]).select(
        "doc_id", "tx", (F.col("pos") - F.col("before")).alias("start"), (F.col("pos") + F.col("after")).alias("stop")
    )
    open_ = kinds.join(several.select("key"), "key")
    wanted = open_.groupBy("one.doc_id", "one.tx").agg(
        F.collect_list(F.struct("key", "ctx", "one.pos", (F.col("n") == 1).alias("alone"))).alias("wanted")
    )
    wanted = wanted.withColumnsRenamed({"doc_id": "_doc", "tx": "_tx"})
    cut = docs.select("doc_id", "text").withColumn("tx", F.xxhash64(F.coalesce("text", F.lit(""))))
    around = materialise(
        cut.join(wanted, cut.doc_id.eqNullSafe(F.col("_doc")) & (F.col("tx") == F.col("_tx")))
        .select("doc_id", "tx", "text", "wanted")
        .mapInArrow(
            _cut_out(length, reach),
            "doc_id long, tx long, pos long, alone boolean, key long, ctx long, before binary, behind binary",
        ),
        "suffix-surroundings",
        keep_shuffles=False,
    )
    large = materialise(several.where(F.col("m") > group).select("key"), "suffix-large")
    small = around.join(large, "key", "left_anti") if not large.isEmpty() else around
    # by rows, as bytes in a shuffle tell little of what a bucket of like rows takes
    partly = _dealt(small, -(-around.count() // BUCKET) or 1).mapInArrow(
        _sort_bucket(length, reach), "doc_id long, tx long, start long, stop long"
    )
    if not large.isEmpty():
        strings = materialise(
            around.join(large, "key", "left_semi").select("key", "ctx", "before", "behind").mapInArrow(
                _all_strings(length, reach), "h long, key long, ctx long, ahead long"
            ),
            "suffix-strings",
            keep_shuffles=False,
        )
        twice = strings.groupBy("h").agg(F.min("ctx").alias("a"), F.max("ctx").alias("b")).where("a <> b")
        decided = (
            strings.join(twice.select("h"), "h")
            .groupBy("key", "ctx")
            .agg(F.max("ahead").alias("most"), F.min("ahead").alias("least"))
        )
        partly = partly.unionByName(
            around.where("alone").join(decided, ["key", "ctx"]).select(
                "doc_id", "tx",
                (F.col("pos") - F.col("most")).alias("start"),
                (F.col("pos") + length - F.col("least")).alias("stop"),
            )
        )
    return whole.unionByName(partly)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans)`` of every document.

    Texts are UTF-8 bytes (null: empty) and judged as they come in; spans are
    maximal.  Texts shorter than ``length`` lose nothing; repeated rows and
    rows without an id are judged like any others.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    of_text = materialise(
        repeated_spans(docs, length)
        .groupBy("doc_id", "tx")
        .agg(F.collect_set(F.struct("start", "stop")).alias("places")),
        "suffix-spans",
        keep_shuffles=False,
    )
    of_text = of_text.withColumnsRenamed({"doc_id": "_doc", "tx": "_tx"})
    marked = docs.withColumn("tx", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = marked.join(
        of_text, marked.doc_id.eqNullSafe(F.col("_doc")) & (F.col("tx") == F.col("_tx")), "left"
    )
    return joined.select("doc_id", "text", "places").mapInArrow(
        _keep_rest,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>",
    )
