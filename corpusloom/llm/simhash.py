"""SimHash near-duplicates, compared on vertical bit planes.

Fingerprints that differ in at most ``RADIUS`` bits agree on two of five
blocks of bits, so they meet in one of ten tables keyed by two blocks.  Within
a table the members of a key are stored as bit planes, one word for 64
members, and a member's distances to 64 others are counted at once by
carry-save counters; a word is abandoned when all its lanes exceed the radius.

A key with very many members is dealt out again by the bits that its table
leaves open; four levels leave at most 256 different fingerprints, so no group
is ever compared whole and nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import parts
from corpusloom.llm.components import connected
from corpusloom.session import materialise

RADIUS = 3
SHINGLE = 3
SEED = 42
# Members of a key beyond which it is dealt out by further bits.
GROUP = 4096
LEVELS = 4
FULL = (1 << 64) - 1
# Words of 64 comparisons handled together.
CHUNK = 1 << 16


def _lanes() -> np.ndarray:
    """For each byte its eight bits, spread over the eight bytes of a word."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
    return np.ascontiguousarray(bits).view(np.uint64).ravel()


def fingerprint_of(text: str | None, shingle: int, lanes: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    n = max(1, len(words) - shingle + 1)
    last = end[-n:] if n > 1 else end[-1:]
    hashes = np.fromiter(
        (xxh64_intdigest(joined[a:b], SEED) for a, b in zip(start[:n].tolist(), last.tolist())),
        np.uint64,
        n,
    )
    total = np.zeros(64, np.int64)
    for at in range(0, n, 65_025):  # 255 * 255
        spread = lanes[hashes[at : at + 65_025].astype(">u8").view(np.uint8).reshape(-1, 8)]
        # bytes of a word hold up to 255, so that many rows are summed as words
        sums = np.add.reduceat(spread, np.arange(0, len(spread), 255), axis=0)
        total += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    bits = (2 * total > n).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(
    docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text",
    more: tuple[str, ...] = (),
) -> DataFrame:
    """``(doc_id, fp)`` and the columns ``more``: the 64-bit SimHash of every whole text, as a signed long.

    A null, empty or blank text has fingerprint zero; a text of fewer words
    than a shingle is one shingle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes = _lanes()
        for batch in parts(batches):
            values = [fingerprint_of(t, shingle, lanes) for t in batch.column(1).to_pylist()]
            fps = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.record_batch([batch.column(0), fps, *batch.columns[2:]], names=["doc_id", "fp", *more])

    shape = ", ".join(["doc_id long", "fp long", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in more)])
    return docs.select(docs[id_col].cast("long"), docs[text_col], *more).mapInArrow(run, shape)


def block_masks(free: int, radius: int = RADIUS) -> list[int]:
    """Masks of two of five blocks of the free bits: ``radius`` 3 touches three at most."""
    places = [i for i in range(64) if free >> i & 1]
    blocks = [
        sum(1 << p for p in places[len(places) * k // (radius + 2) : len(places) * (k + 1) // (radius + 2)])
        for k in range(radius + 2)
    ]
    return [a | b for a, b in combinations(blocks, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def within(
    queries: np.ndarray, planes: np.ndarray, word: np.ndarray, member: np.ndarray, radius: int = RADIUS
) -> np.ndarray:
    """Lanes at most ``radius`` bits away: one word of answers for each (query, word of members).

    ``planes[b, w]`` has bit b of the 64 members of word w.  ``member`` says
    which query meets which ``word``.  The bits of the counts and an overflow
    are carry-save counters; words whose lanes have all overflowed are left out
    from then on.
    """
    n, digits = len(word), radius.bit_length()
    alive = np.arange(n)
    count = [np.zeros(n, np.uint64) for _ in range(digits)]
    over = np.zeros(n, np.uint64)
    q, w = queries[member], word
    answer = np.zeros(n, np.uint64)
    for bit in range(64):
        carry = planes[bit][w] ^ (np.uint64(0) - (q >> np.uint64(bit) & np.uint64(1)))
        for k in range(digits):
            count[k], carry = count[k] ^ carry, count[k] & carry
        over |= carry
        if bit % 8 == 7:
            open_ = over != np.uint64(FULL)
            if not open_.all():
                alive, over, q, w = (v[open_] for v in (alive, over, q, w))
                count = [c[open_] for c in count]
            if not len(alive):
                return answer
    # lanes whose count is larger than the radius, compared from the highest digit
    larger, equal = np.zeros(len(alive), np.uint64), np.full(len(alive), FULL, np.uint64)
    for k in reversed(range(digits)):
        if radius >> k & 1:
            equal &= count[k]
        else:
            larger |= equal & count[k]
            equal &= ~count[k]
    answer[alive] = ~(over | larger)
    return answer


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of a and b; every tree is flat before and after."""
    while len(a):
        ra, rb = parent[a], parent[b]
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def linked_within(keys: np.ndarray, fps: np.ndarray, radius: int = RADIUS, confirm=None) -> np.ndarray:
    """For each row the first row of its own key that links of at most ``radius`` bits lead to.

    Rows of a key are neighbours in ``keys``.  ``confirm`` may turn down links:
    it takes two arrays of rows.
    """
    n = len(fps)
    parent = np.arange(n)
    head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[head, n])
    head, size = head[size > 1], size[size > 1]
    if not len(head):
        return parent
    words = (size + 63) // 64
    first_word = np.cumsum(words) - words
    # rows that have company, and their word and lane
    run = np.repeat(np.arange(len(head)), size)
    inside = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
    row = head[run] + inside
    word, lane = first_word[run] + inside // 64, inside % 64
    total = int(words.sum())
    planes = np.zeros((64, total), np.uint64)
    valid = np.zeros(total, np.uint64)
    starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    shift = lane.astype(np.uint64)
    for bit in range(64):
        planes[bit] = np.bitwise_or.reduceat((fps[row] >> np.uint64(bit) & np.uint64(1)) << shift, starts)
    valid[:] = np.bitwise_or.reduceat(np.uint64(1) << shift, starts)
    first_row = row[starts]
    # every row meets the words of its run up to its own
    meets = inside // 64 + 1
    until = np.cumsum(meets)
    at = 0
    while at < len(row):
        stop = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + CHUNK, "right")))
        part = np.arange(at, stop)
        member = np.repeat(part, meets[part])
        which = np.arange(len(member)) - np.repeat(np.cumsum(meets[part]) - meets[part], meets[part])
        w = first_word[run[member]] + which
        near = within(fps[row], planes, w, member, radius) & valid[w]
        hit = np.flatnonzero(near)
        bits = np.unpackbits(near[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        i, k = np.nonzero(bits)
        a, b = row[member[hit[i]]], first_row[w[hit[i]]] + k
        if confirm is not None:
            # rows that earlier links have joined need no more
            a, b = (x[parent[a] != parent[b]] for x in (a, b))
            good = confirm(a, b)
            a, b = a[good], b[good]
        _join(parent, a, b)
        at = stop
    return parent


def _star_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition has its keys whole; it is sorted here and each key compared."""
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    mask, key, fp, rep = (table.column(c).to_numpy() for c in ("mask", "key", "fp", "rep"))
    order = np.lexsort((fp, key, mask))
    mask, key, fp, rep = mask[order], key[order], fp[order], rep[order]
    change = np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])]
    parent = linked_within(np.cumsum(change), fp.view(np.uint64))
    far = parent != np.arange(len(parent))
    yield pa.record_batch([pa.array(rep[far]), pa.array(rep[parent[far]])], names=["u", "v"])


def links(distinct: DataFrame, group: int = GROUP) -> DataFrame:
    """Edges ``(u, v)`` between ``rep`` of ``(fp, rep)`` that join all fingerprints
    linked by chains of at most three differing bits: for each key a star per chain."""
    spark = distinct.sparkSession
    open_masks, found = {0: FULL}, None
    rows = distinct.select("fp", "rep", F.lit(0).cast("long").alias("mask"))
    for level in range(LEVELS):
        deeper = {}
        for mask, free in open_masks.items():
            for more in block_masks(free):
                deeper[(mask, mask | more)] = free & ~more
        if level == 0:
            listed = F.array(*[F.lit(_signed(m)).cast("long") for _, m in deeper])
            keyed = rows.select("fp", "rep", F.explode(listed).alias("mask"))
        else:
            steps = spark.createDataFrame(
                [(_signed(a), _signed(b)) for a, b in deeper], "mask long, next long"
            )
            keyed = rows.join(F.broadcast(steps), "mask").select(
                "fp", "rep", F.col("next").alias("mask")
            )
        open_masks = {m: free for (_, m), free in deeper.items()}
        keyed = keyed.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        hot = None
        if level < LEVELS - 1:
            counted = keyed.groupBy("mask", "key").count().where(F.col("count") > group)
            hot = materialise(counted.drop("count"), "hot-keys")
            if hot.isEmpty():
                hot = None
        cold = keyed if hot is None else keyed.join(hot, ["mask", "key"], "left_anti")
        edges = cold.repartition("mask", "key").mapInArrow(_star_links, "u long, v long")
        found = edges if found is None else found.unionByName(edges)
        if hot is None:
            break
        rows = materialise(
            keyed.join(hot, ["mask", "key"], "left_semi").select("fp", "rep", "mask"), "hot-rows"
        )
    return found


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text",
    more: tuple[str, ...] = (),
) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every document, and its columns ``more``.

    ``component_id`` is the smallest id that links reach.  Equal fingerprints
    (all empty texts among them) are linked.  A row without an id is returned
    with its fingerprint and the component of equal fingerprints, if they have one.
    Other columns are ignored, whatever their names.
    """
    marked = materialise(fingerprints(docs, shingle, id_col, text_col, more), "simhash")
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    known = distinct.where("rep IS NOT NULL")
    found = connected(links(known))
    placed = distinct.join(found, F.col("rep") == F.col("node"), "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return marked.join(placed, "fp").select("doc_id", "fp", "component_id", *more)


def keep_one(
    docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of each component: that of the smallest id, all its columns.

    Rows without an id come last; without any in the component, equal fingerprints
    are a group.  An id names one document: of the rows that share an id a single one stays.
    """
    text = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    keyed = docs.select(id_col, text_col, text.alias("_text_key"))
    found = near_duplicates(keyed, shingle, id_col, text_col, ("_text_key",))
    alone = F.when(F.col("component_id").isNull(), F.col("fp"))
    rows = found.withColumn("alone", alone).groupBy("component_id", "alone", "doc_id", "_text_key").agg(
        F.count("*").alias("copies")
    )
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_text_key", "copies")
    kept = rows.groupBy("component_id", "alone").agg(F.min(first).alias("first"))
    kept = kept.select(
        F.col("first.doc_id").alias("_kept_id"), F.col("first._text_key").alias("_kept_text"), "first.copies"
    )
    kept = materialise(kept, "simhash-kept")

    def held(chosen: DataFrame) -> DataFrame:
        same = F.col(id_col).cast("long").eqNullSafe(F.col("_kept_id")) & (text == F.col("_kept_text"))
        return docs.join(chosen, same, "left_semi")

    single, several = kept.where("copies = 1"), kept.where("copies > 1")
    if several.isEmpty():
        return held(single)
    return held(single).unionByName(held(several).dropDuplicates([id_col, text_col]))
