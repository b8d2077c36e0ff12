"""Near-duplicate texts by b-bit MinHash.

A text's set of shingles is reduced to the minima of 128 hash functions.  Bands
of three minima give candidates; of all minima only the lowest four bits are
kept, packed into 64 bytes.  Two signatures are compared by the bits of their
difference: nibbles that differ are folded to one bit and counted, and the count
is corrected for nibbles that are equal by chance (Li and Koenig), which gives
an estimate of the similarity with a standard error below 0.037.  A pair estimated
far below the threshold is turned down; every other one is confirmed on the full
sets.

No group is compared with itself as a whole, and no pairs of a group are written.
First each text of a band meets one text of that band only, its hub, and what the
full sets confirm joins up; then so do the texts outside the largest component.
Most bands are of one component then.  In the others the texts outside the
largest component meet all texts of other components, in tiles of at most
``GROUP`` texts a side.  Tiles with near pairs get the full sets and return a
forest of the confirmed links.  A band that very many texts share is thus the work
of many tasks, each of which returns no more rows than it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import parts
from corpusloom.llm.components import connected
from corpusloom.session import materialise

SHINGLE = 4
# Similarity in hundredths, so that the comparison is one of whole numbers.
PERCENT = 80
HASHES, BITS = 128, 4
# At 0.8 a pair misses all bands with probability (1 - 0.8 ** 3) ** 20, about 6e-7.
BANDS, ROWS = 20, 3
# Estimates this far below the threshold turn a pair down: over 4.8 standard errors.
MARGIN = 0.18
# Texts of a band on one side of a tile.
GROUP = 1024
# Texts of a band up to which any of them is as good a hub; twice as many are the sample of a larger one.
FEW = 16
# Times that bands meet a hub; after more turns less is left to compare in tiles.
HUB_TURNS = 2
# Comparisons handled together.
CHUNK = 1 << 17
# Different words whose hashes a task remembers, besides those of one text.
WORDS_HELD = 1 << 16
SEED = 42
SHAPE = "doc_id long, text_key long, text_size int, tx binary, n_shingles long, signature binary, bands array<long>"


class Shingles:
    """Hashes of the different shingles of lower-cased (A-Z) texts.

    The hash of a shingle mixes those of its words, in their order.
    """

    def __init__(self, size: int = SHINGLE):
        self.size, self.known = size, {}
        draw = np.random.default_rng(SEED)
        self.factors = draw.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, text: bytes) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > WORDS_HELD:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxh3_64_intdigest(w)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        wide = min(self.size, len(words))
        n = len(words) - wide + 1
        mixed = np.full(n, wide, np.uint64)
        for j in range(wide):
            mixed += hashes[j : j + n] * self.factors[j]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return np.unique(mixed ^ (mixed >> np.uint64(29)))


def minima(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set, its bits mixed."""
    least = np.full(len(factors), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 256):
        np.minimum(least, (shingles[at : at + 256, None] * factors).min(axis=0), out=least)
    return least ^ (least >> np.uint64(32))


def packed(least: np.ndarray) -> bytes:
    """The lowest four bits of each of the minima, two in a byte."""
    low = (least & np.uint64(15)).astype(np.uint8)
    return (low[::2] | (low[1::2] << 4)).tobytes()


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities of rows of signatures (as words of 64 bits), free of chance matches."""
    differ = a ^ b
    differ |= differ >> np.uint64(2)
    differ |= differ >> np.uint64(1)
    differ &= np.uint64(0x1111111111111111)
    equal = 1 - np.bitwise_count(differ).sum(axis=1, dtype=np.int64) / HASHES
    chance = 1 / (1 << BITS)
    return (equal - chance) / (1 - chance)


def _marks(shingle: int):
    """Signatures and bands of texts beside their ids and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        factors = np.random.default_rng(SEED).integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        mix = np.uint64(0x9E3779B97F4A7C15)
        shingles_of = Shingles(shingle)
        for batch in parts(batches):
            tx, size, signature, bands = [], [], [], []
            for text in batch.column(3).cast(pa.binary()).fill_null(b"").to_pylist():
                found = shingles_of(text)
                size.append(len(found))
                if not len(found):
                    tx.append(None), signature.append(None), bands.append(None)
                    continue
                least = minima(found, factors)
                keys = np.zeros(BANDS, np.uint64)
                for row in least[: BANDS * ROWS].reshape(BANDS, ROWS).T:
                    keys = (keys + row) * mix
                    keys ^= keys >> np.uint64(31)
                tx.append(xxh3_128_digest(found.tobytes()))
                signature.append(packed(least))
                bands.append(keys.view(np.int64))
            yield pa.record_batch(
                [
                    batch.column(0), batch.column(1), batch.column(2),
                    pa.array(tx, pa.binary()), pa.array(size, pa.int64()),
                    pa.array(signature, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_key", "text_size", "tx", "n_shingles", "signature", "bands"],
            )

    return run


def marked(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document; ``tx`` names its set of shingles, and is null where that is empty."""
    text = F.col(text_col).cast("string")
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), *_text_key(text), text.alias("text")
    ).mapInArrow(_marks(shingle), SHAPE)


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("text_key"), F.coalesce(F.octet_length(text), F.lit(0)).alias("text_size")]


class Tile:
    """Rows of some tiles, sorted so that in each the rows of side 0 come before those of side 1."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        held = list(batches)
        self.size = sum(b.num_rows for b in held)
        if not self.size:
            return
        # one piece for each column, whatever the size of a batch
        table = pa.Table.from_batches(held).combine_chunks()
        del held
        order = np.lexsort([table.column(c).to_numpy() for c in ("side", "j", "i", "key", "band")])
        self.table = table.take(pa.array(order))
        for c in ("band", "key", "i", "j", "side", "node", "n_shingles", "component"):
            setattr(self, c, self.table.column(c).to_numpy())
        values = self.table.column("signature").to_pylist()
        self.signature = np.frombuffer(b"".join(values), np.uint64).reshape(self.size, -1)

    def _bands(self) -> np.ndarray:
        """Their bands, a row each."""
        return self.table.column("bands").combine_chunks().flatten().to_numpy().reshape(self.size, -1)

    def met(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of rows of side 0 and of rows of side 1 that they meet, some at a time."""
        if not self.size:
            return
        tile = np.zeros(self.size - 1, bool)
        for c in (self.band, self.key, self.i, self.j):
            tile |= np.diff(c) != 0
        head = np.flatnonzero(np.r_[True, tile])
        tile = np.cumsum(np.r_[False, tile])
        zeros = np.add.reduceat((self.side == 0).astype(np.int64), head)
        ones = np.diff(np.r_[head, self.size]) - zeros
        left = np.flatnonzero(self.side == 0)
        meets, first = ones[tile[left]], (head + zeros)[tile[left]]
        until = np.cumsum(meets)
        at = 0
        while at < len(left):
            done = until[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(until, done + CHUNK, "right")))
            many = meets[at:stop]
            skip = np.cumsum(many) - many
            rows = np.repeat(left[at:stop], many)
            yield rows, np.repeat(first[at:stop] - skip, many) + np.arange(len(rows))
            at = stop

    def near(self, least: float, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of those the pairs of different components estimated at ``least`` or more, and the estimates.

        Sizes that alone rule out the similarity do so.  Where rows have their bands, a
        pair counts in the first band that it shares only.
        """
        bands = self._bands() if self.size and "bands" in self.table.column_names else None
        for rows, others in self.met():
            small = np.minimum(self.n_shingles[rows], self.n_shingles[others])
            large = np.maximum(self.n_shingles[rows], self.n_shingles[others])
            good = (self.component[rows] != self.component[others]) & (100 * small >= percent * large)
            rows, others = rows[good], others[good]
            guess = estimate(self.signature[rows], self.signature[others])
            good = guess >= least
            rows, others, guess = rows[good], others[good], guess[good]
            if bands is not None and len(rows):
                good = np.argmax(bands[rows] == bands[others], axis=1) == self.band[rows]
                rows, others, guess = rows[good], others[good], guess[good]
            yield rows, others, guess


def _pairs_of_tiles(least: float, percent: int):
    """``(u, v)`` of the near pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = Tile(batches)
        for rows, others, _ in tile.near(least, percent):
            u, v = tile.node[rows], tile.node[others]
            yield pa.record_batch([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    return run


def _scores_of_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(band, key, node, score)``: how similar a row of side 0 is to those of side 1, summed up."""
    tile = Tile(batches)
    for rows, others in tile.met():
        if len(rows):
            guess = estimate(tile.signature[rows], tile.signature[others])
            head = np.flatnonzero(np.r_[True, np.diff(rows) != 0])
            of, score = rows[head], np.add.reduceat(guess, head)
            columns = [pa.array(c[of]) for c in (tile.band, tile.key, tile.node)]
            yield pa.record_batch([*columns, pa.array(score)], names=["band", "key", "node", "score"])


def _rows_in_near_pairs(least: float, percent: int):
    """The rows that are in any near pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = Tile(batches)
        if not tile.size:
            return
        seen = np.zeros(tile.size, bool)
        for rows, others, _ in tile.near(least, percent):
            seen[rows] = True
            seen[others] = True
        yield from tile.table.filter(pa.array(seen)).to_batches()

    return run


def _links_of_tiles(least: float, percent: int):
    """``(u, v)``: a forest of the links that the full sets confirm, of rows with their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = Tile(batches)
        if not tile.size:
            return
        sets = tile.table.column("shingles").combine_chunks()
        flat, starts = sets.flatten().to_numpy(), np.asarray(sets.offsets) - sets.offsets[0].as_py()
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        u, v = [], []
        for rows, others, guess in tile.near(least, percent):
            likely = np.argsort(-guess, kind="stable")
            for a, b in zip(rows[likely].tolist(), others[likely].tolist(), strict=True):
                x, y = root(int(tile.component[a])), root(int(tile.component[b]))
                if x == y:
                    continue
                one, other = flat[starts[a] : starts[a + 1]], flat[starts[b] : starts[b + 1]]
                both = np.concatenate([one, other])
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * shared >= percent * (len(both) - shared):
                    parent[max(x, y)] = min(x, y)
                    u.append(int(tile.node[a])), v.append(int(tile.node[b]))
        yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


TILE = "band int, key long, i int, j int, side int, node long, n_shingles long, component long, signature binary"


def _tiles(rows: DataFrame, zero: Column, one: Column, n_zero: Column, n_one: Column, *more: str) -> DataFrame:
    """Rows of condition ``zero`` to meet those of ``one`` of their band, in tiles of bounded sides."""
    tiles_zero = F.greatest(F.lit(1), F.ceil(n_zero / GROUP)).cast("int")
    tiles_one = F.greatest(F.lit(1), F.ceil(n_one / GROUP)).cast("int")
    mixed = F.xxhash64("node", "band")

    def dealt(side: int, held: Column, own: Column, other: Column) -> DataFrame:
        block, every = F.pmod(mixed, own).cast("int"), F.explode(F.sequence(F.lit(0), other - 1))
        i, j = (block, every) if side == 0 else (every, block)
        return rows.where(held).select(
            "band", "key", i.alias("i"), j.alias("j"), F.lit(side).alias("side"),
            "node", "n_shingles", "component", "signature", *more,
        )

    both = dealt(0, zero, tiles_zero, tiles_one).unionByName(dealt(1, one, tiles_one, tiles_zero))
    return both.repartition("band", "key", "i", "j")


def _hubs(rows: DataFrame) -> DataFrame:
    """``(band, key, hub)``: a text of each band to which the others are similar.

    In a family of edited copies the copies may be similar to their origin only.  So in
    larger bands it is the text most similar to a sample of the band; the sample
    only chooses whom all meet first.
    """
    small = rows.where(F.col("n") <= FEW).groupBy("band", "key").agg(F.min("node").alias("hub"))
    large = rows.where(F.col("n") > FEW)
    sampled = F.pmod(F.xxhash64("key", "node"), "n") < 2 * FEW
    scores = _tiles(large, F.lit(True), sampled, F.col("n"), F.lit(2 * FEW)).mapInArrow(
        _scores_of_tiles, "band int, key long, node long, score double"
    )
    best = scores.groupBy("band", "key").agg(F.max(F.struct("score", "node")).alias("best"))
    return small.unionByName(best.select("band", "key", F.col("best.node").alias("hub")))


def _sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, text_col: str) -> DataFrame:
    """``(node, shingles)``: the full sets of some classes, each from one of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles_of = Shingles(shingle)
        for batch in parts(batches):
            texts = batch.column(1).cast(pa.binary()).fill_null(b"").to_pylist()
            sets = [shingles_of(t).view(np.int64) for t in texts]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    wanted = classes.join(nodes, "node", "left_semi").select("node", "text_key", "text_size")
    texts = docs.select(*_text_key(F.col(text_col)), F.col(text_col).cast("string").alias("_text"))
    one = texts.join(wanted.select("text_key", "text_size"), ["text_key", "text_size"], "left_semi")
    one = one.dropDuplicates(["text_key", "text_size"]).join(wanted, ["text_key", "text_size"])
    return materialise(one.select("node", "_text").mapInArrow(run, "node long, shingles array<long>"), "bbit-sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the different pairs ``(u, v)`` of ``node`` whose full sets are similar."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(
        sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v"
    )
    shared, total = F.size(F.array_intersect("a", "b")).cast("long"), F.size("a") + F.size("b")
    both = both.select("u", "v", shared.alias("s"), total.cast("long").alias("n"))
    return both.where(100 * F.col("s") >= percent * (F.col("n") - F.col("s"))).select("u", "v")


def _with_components(rows: DataFrame, links: DataFrame) -> DataFrame:
    found = connected(links).withColumnRenamed("component", "_component")
    placed = rows.join(found, "node", "left").withColumn("component", F.coalesce("_component", "node"))
    return placed.drop("_component")


def _open_bands(placed: DataFrame) -> DataFrame:
    """The rows of bands of several components, with the largest one and its number of texts."""
    parts = placed.groupBy("band", "key", "component").agg(F.count("*").alias("c"))
    parts = parts.groupBy("band", "key").agg(
        F.max(F.struct("c", "component")).alias("most"), F.count("*").alias("parts")
    )
    parts = parts.where("parts > 1").select("band", "key", F.col("most.c").alias("c"), F.col("most.component").alias("main"))
    return placed.join(parts, ["band", "key"])


def near_duplicates(
    docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row.

    Documents are linked when their sets of shingles share at least ``percent``
    in a hundred of their union; ``component_id`` is the smallest id that links
    reach, and ``kept`` marks the document that has it.  A text of fewer words than
    a shingle is one shingle.  Null, empty and blank texts have no shingles and are
    linked with nothing, not with each other either; they are kept.

    Equal sets are one class from the start, however many rows have it.  Rows with
    the same id give a row each (all are kept or none); a row without an id takes
    part, never names a component, and is kept only if its component has no id.
    A text is one piece of work, however long.  Other columns are ignored.
    """
    each = materialise(marked(docs, shingle, id_col, text_col), "bbit-marked")
    full = each.where("tx IS NOT NULL")
    classes = full.groupBy("tx").agg(
        F.min("doc_id").alias("first_id"),
        F.min(F.struct("text_key", "text_size", "n_shingles", "signature", "bands")).alias("one"),
    )
    classes = classes.select("tx", "first_id", "one.*", F.monotonically_increasing_id().alias("node"))
    classes = materialise(classes, "bbit-classes")
    # most texts meet no other one, so signatures go only to bands that are shared
    keyed = classes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = keyed.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(shared, ["band", "key"])
    rows = materialise(met.join(classes.select("node", "n_shingles", "signature", "bands"), "node"), "bbit-met")
    placed, links = rows.withColumn("component", F.col("node")), None
    least = percent / 100 - MARGIN
    for turn in range(HUB_TURNS):
        open_ = placed
        if turn:
            # a band's texts outside its largest component
            outside = _open_bands(placed).where(F.col("component") != F.col("main"))
            open_ = outside.withColumn("n", F.col("n") - F.col("c")).where("n > 1")
        hubs = materialise(_hubs(open_), "bbit-hubs")
        met, is_hub = open_.join(hubs, ["band", "key"]), F.col("node") == F.col("hub")
        stars = _tiles(met, ~is_hub, is_hub, F.col("n"), F.lit(1)).mapInArrow(
            _pairs_of_tiles(least, percent), "u long, v long"
        )
        stars = materialise(stars.distinct(), "bbit-stars")
        sets = _sets(stars.select(F.explode(F.array("u", "v")).alias("node")).distinct(), classes, docs, shingle, text_col)
        good = _confirmed(stars, sets, percent)
        links = materialise(good if links is None else links.unionByName(good), "bbit-links")
        placed = materialise(_with_components(rows, links), "bbit-placed")
    open_ = _open_bands(placed)
    tiles = _tiles(
        open_, F.col("component") != F.col("main"), F.lit(True), F.col("n") - F.col("c"), F.col("n"), "bands"
    )
    rest = tiles.mapInArrow(_rows_in_near_pairs(least, percent), TILE + ", bands array<long>")
    rest = materialise(rest, "bbit-rest")
    sets = _sets(rest.select("node").distinct(), classes, docs, shingle, text_col)
    more = rest.join(sets, "node").repartition("band", "key", "i", "j").mapInArrow(
        _links_of_tiles(least, percent), "u long, v long"
    )
    placed = _with_components(classes.select("node", "tx", "first_id"), links.unionByName(more))
    placed = materialise(placed, "bbit-components")
    first = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    found = placed.join(first, "component").select("tx", "component_id")
    named = each.select("doc_id", "n_shingles", "tx").join(found, "tx", "left")
    # an empty set is a component of its own
    component = F.when(F.col("tx").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return named.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )

