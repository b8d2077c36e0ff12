"""Packing of documents into fixed windows by best-fit decreasing.

A document becomes its token ids and one closing id.  Overlong documents are
first cut into full windows; what remains of them, and every shorter document,
is an item of a bin-packing problem.  Items are taken by falling length, and a
segment tree over remaining capacities finds the tightest open window.

A task packs the documents it reads in blocks of bounded size, so texts and
ids are never shuffled and no task holds more than one block.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from corpusloom.llm.batches import parts

WINDOW = 1024
CLOSING_ID = 0
VOCABULARY = "byte_bpe_50k.json"
# The split in front of the merges, as the vocabulary's documentation gives it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# A block closes at whichever bound it meets first.
BLOCK_PIECES = 16_384
BLOCK_IDS = 8_000_000

SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)
DDL = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, "
    "sequence_id long, offset long"
)


class Capacities:
    """Open windows by remaining capacity: a segment tree of counts."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(self.size)]

    def _change(self, capacity: int, by: int) -> None:
        node = capacity + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        self._change(capacity, 1)

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Takes out the window with the least capacity of at least ``length``."""
        count, node = self.count, length + self.size
        if not count[node]:
            # climb to the first ancestor with something to the right, then descend left
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.size
        self._change(capacity, -1)
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int], int]:
    """(window number, offset) of each item, and how many windows were opened."""
    tree = Capacities(window)
    where, offset, opened = [0] * len(lengths), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.tightest(lengths[i])
        if found is None:
            found = (window, opened)
            opened += 1
        capacity, number = found
        where[i], offset[i] = number, window - capacity
        if capacity > lengths[i]:
            tree.add(capacity - lengths[i], number)
    return where, offset, opened


def load_encoder(path: str | None):
    """Ids of a byte-level BPE file; the merge order of such a file is the id order.

    The file is read on the executor; ``None`` takes the public one.
    """
    import tiktoken

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model = whole["model"]
    # added tokens are found in a text before anything else
    added = {}
    for token in whole.get("added_tokens") or []:
        if token.get("lstrip") or token.get("rstrip") or token.get("single_word"):
            raise ValueError(f"added token {token['content']!r} takes its surroundings, which is not supported")
        added[token["content"]] = token["id"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    merged = {left + right for left, right in (
        m.split(" ") if isinstance(m, str) else m for m in model["merges"]
    )}
    ranks = {
        bytes(byte_of[c] for c in token): number
        for token, number in model["vocab"].items()
        if token not in added and (len(token) == 1 or token in merged)
    }
    encoding = tiktoken.Encoding(
        "packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added
    )
    return lambda text: encoding.encode_to_numpy(text, allowed_special="all")


class Block:
    """Items waiting to be packed, and pieces that already fill a window."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.next = window, first_sequence
        self.full: list[tuple] = []
        self.items: list[tuple] = []
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        for start in range(0, len(ids), self.window):
            piece = ids[start : start + self.window]
            row = (doc_id, start, len(piece), piece.astype("<u4").tobytes(), len(ids))
            (self.full if len(piece) == self.window else self.items).append(row)
        self.held += len(ids)

    def ready(self) -> bool:
        return len(self.full) + len(self.items) >= BLOCK_PIECES or self.held >= BLOCK_IDS

    def drain(self) -> Iterator[pa.RecordBatch]:
        where, offset, opened = best_fit_decreasing([r[2] for r in self.items], self.window)
        rows = [(*r, self.next + w, o) for r, w, o in zip(self.items, where, offset, strict=True)]
        self.next += opened
        rows += [(*r, self.next + i, 0) for i, r in enumerate(self.full)]
        self.next += len(self.full)
        self.full, self.items, self.held = [], [], 0
        for at in range(0, len(rows), 2048):
            columns = zip(*rows[at : at + 2048], strict=True)
            yield pa.record_batch(
                [pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA
            )


def pack(
    docs: DataFrame,
    window: int = WINDOW,
    vocabulary: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of every document and their places in sequences of at most ``window`` ids.

    ``ids`` are unsigned 32-bit little-endian.  A null or empty text is its
    closing id alone; a null ``doc_id`` stays null; repeated rows are packed
    each for itself; an empty table gives no rows; other columns are ignored.
    ``sequence_id`` is unique: the task's number in the upper bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(vocabulary)
        block = Block(window, TaskContext.get().partitionId() << 36)
        closing = np.array([CLOSING_ID], dtype=np.uint32)
        for batch in parts(batches):
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block.add(doc_id, np.concatenate([encode(text or ""), closing]))
                if block.ready():
                    yield from block.drain()
        yield from block.drain()

    return docs.select(docs[id_col].cast("long"), docs[text_col]).mapInArrow(run, DDL)


def sequences(pieces: DataFrame) -> DataFrame:
    """The windows themselves: ids of the pieces of each, joined in order of offset."""
    return pieces.groupBy("sequence_id").agg({"length": "sum"}).select(
        "sequence_id", "`sum(length)`"
    ).toDF("sequence_id", "length").join(
        pieces.selectExpr("sequence_id", "struct(offset, ids) AS piece")
        .groupBy("sequence_id")
        .agg({"piece": "collect_list"})
        .selectExpr(
            "sequence_id",
            "aggregate(array_sort(`collect_list(piece)`), X'', (a, p) -> concat(a, p.ids)) AS ids",
        ),
        "sequence_id",
    )
