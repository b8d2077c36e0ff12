"""Runs (maximal periodic stretches) of words, by Lyndon groups.

The first phase of Baier's suffix sorter visits groups of suffixes from the
largest down and lets each group extend the suffix before it.  When it ends,
two positions are in one group exactly if the longest Lyndon words that start
there are equal, so it yields the Lyndon array without sorting any suffixes.
Every run has a Lyndon root under the order of the words or under the reversed
one, and inside the run that root is the longest Lyndon word at each of its
places.  So runs are found by chains of places of one group, each a root behind
the other, extended to both sides by the longest common extension.

Only stretches in which a run may lie reach the sorter.  A run of at least
``e`` periods repeats each of its ``k``-grams (``gram_size``), so k-grams that
occur once part the text; the parts are looked at again, as often as this parts
them further.  A run lies in one such stretch as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_LENGTH, MIN_EXPONENT = 6, 4
# Words of texts that are looked at together; a longer text is alone.
PORTION = 1 << 18
# Times that stretches are parted; fewer only leave more to the sorter.
PARTINGS = 8
RUN = "struct<start:long,length:long,period:long>"
SHAPE = f"doc_id long, n_words long, runs array<{RUN}>, collapsed string"


def gram_size(min_length: int, min_exponent: float) -> int:
    """The largest k such that each k-gram of a run occurs in it at least twice.

    A run of period q and length m has m - k + 1 of them, and needs 2q.
    """
    short = floor(min_length / min_exponent)
    longer = floor(min_exponent * (short + 1)) - 2 * (short + 1) + 1
    return max(1, min(longer, min_length - 2 * short + 1 if short else longer))


def stretches(
    words: np.ndarray, doc: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: float = MIN_EXPONENT
) -> list[tuple[int, int]]:
    """Ranges of ``words`` (numbers of words; ``doc`` tells documents apart) that may hold runs."""
    k = gram_size(min_length, min_exponent)
    if len(words) < min_length:
        return []
    draw = np.random.default_rng(1).integers(1, 1 << 62, k + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    n = len(words) - k + 1
    grams = np.zeros(n, np.uint64)
    for j in range(k):
        grams += words[j : j + n].astype(np.uint64) * draw[j]
    start = np.flatnonzero(doc[:n] == doc[k - 1 :])
    part = doc[start]
    grams = grams[start]
    for _ in range(PARTINGS):
        # equal hashes of different k-grams only leave more to the sorter
        mixed = (grams + part.astype(np.uint64) * draw[k]) * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(mixed)
        same = np.diff(mixed[order]) == 0
        twice = np.zeros(len(start), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        before = len(start)
        start, part, grams = start[twice], part[twice], grams[twice]
        if not len(start):
            return []
        head = np.r_[True, (np.diff(start) != 1) | (np.diff(part) != 0)]
        number = np.cumsum(head) - 1
        enough = (np.bincount(number) >= min_length - k + 1)[number]
        start, grams, part = start[enough], grams[enough], number[enough]
        if len(start) in (0, before):
            break
    if not len(start):
        return []
    head = np.flatnonzero(np.r_[True, np.diff(part) != 0])
    last = np.r_[head[1:], len(start)] - 1
    return list(zip(start[head].tolist(), (start[last] + k).tolist(), strict=True))


def lyndon_groups(ranks: list[int]) -> tuple[list[int], list[int]]:
    """(length of the longest Lyndon word, group) of each place: equal groups are equal words.

    A group is named by its first place in the order of suffixes.  Groups are
    visited from the last to the first; each place i of the group hangs on the
    nearest place before it whose group is smaller, which grows by the word of
    the group.  Places that grow leave their group for one right behind it,
    those that grow more often first, so a group only ever loses its end.
    """
    n = len(ranks)
    places: dict[int, list[int]] = {}
    for i, r in enumerate(ranks):
        places.setdefault(r, []).append(i)
    group, length, hangs_on = [0] * n, [1] * n, [-1] * n
    members, end, ending_at = {}, {}, {}
    at = 0
    for r in sorted(places):
        held = places[r]
        for i in held:
            group[i] = at
        members[at], end[at] = held, at + len(held)
        ending_at[end[at]] = at
        at = end[at]
    while at:
        g = ending_at[at]
        # places in ascending order, so those of the group before i are done
        held = [i for i in members[g] if group[i] == g]
        grown: dict[tuple[int, int], list[int]] = {}
        last, times = -1, 0
        for i in held:
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = hangs_on[p]
            hangs_on[i] = p
            if p == last:
                times += 1
                continue
            if last >= 0:
                grown.setdefault((times, group[last]), []).append(last)
            last, times = p, 1
        if last >= 0:
            grown.setdefault((times, group[last]), []).append(last)
        word = length[held[0]]
        for times, old in sorted(grown, reverse=True) if len(grown) > 1 else grown:
            moved = grown[times, old]
            new = end[old] - len(moved)
            for i in moved:
                length[i] += times * word
            if new != old:
                for i in moved:
                    group[i] = new
                members[new], end[new] = moved, end[old]
                ending_at[end[old]], ending_at[new] = new, old
                end[old] = new
        at = g
    return length, group


def _same_ahead(words: list[int], at: int, period: int) -> int:
    """How many words from ``at`` on equal those a period before."""
    a, step, n = at, 16, len(words)
    while a < n and words[a : a + step] == words[a - period : min(a + step, n) - period]:
        a, step = min(a + step, n), 2 * step
    while a < n and words[a] == words[a - period]:
        a += 1
    return a - at


def _same_behind(words: list[int], at: int, period: int) -> int:
    """How many words before ``at`` equal those a period later."""
    a, step = at, 16
    while a > 0 and words[max(0, a - step) : a] == words[max(0, a - step) + period : a + period]:
        a, step = max(0, a - step), 2 * step
    while a > 0 and words[a - 1] == words[a - 1 + period]:
        a -= 1
    return at - a


def runs_in(
    words: list[int], min_length: int = MIN_LENGTH, min_exponent: float = MIN_EXPONENT
) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a list of numbers, by start and period."""
    n, found = len(words), set()
    # a run of e periods holds this many whole roots
    roots = floor(min_exponent) - 1
    top = max(words, default=0)
    for ranks in (words, [top - w for w in words]):
        length, group = lyndon_groups(ranks)
        for i, p in enumerate(length):
            g = group[i]
            if i >= p and group[i - p] == g:
                continue
            stop = i + p
            while stop < n and group[stop] == g:
                stop += p
            if stop - i < roots * p:
                continue
            start = i - _same_behind(words, i, p)
            stop += _same_ahead(words, stop, p)
            if stop - start >= max(min_length, min_exponent * p):
                found.add((start, stop - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _portions(texts: list[bytes]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(number of the first text, words of some texts that follow each other)."""
    held, first, total = [], 0, 0
    for no, text in enumerate(texts):
        held.append(text.split())
        total += len(held[-1])
        if total >= PORTION:
            yield first, held
            held, first, total = [], no + 1, 0
    if held:
        yield first, held


def _runs_of_texts(texts: list[list[bytes]], min_length: int, min_exponent: float) -> dict[int, list]:
    """The runs of those texts that have any."""
    number: dict[bytes, int] = {}
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    words = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), np.int64, int(sizes.sum()))
    first = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(texts)), sizes)
    found: dict[int, list] = {}
    for a, b in stretches(words, doc, min_length, min_exponent):
        inside = runs_in(words[a:b].tolist(), min_length, min_exponent)
        if inside:
            no = int(doc[a])
            shift = a - int(first[no])
            found.setdefault(no, []).extend((s + shift, n, p) for s, n, p in inside)
    return {no: sorted(runs, key=lambda r: (r[0], r[2])) for no, runs in found.items()}


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but those that a run holds behind its first period."""
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def find_runs(
    docs: DataFrame,
    min_length: int = MIN_LENGTH,
    min_exponent: float = MIN_EXPONENT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` of every row, whole texts, in the order of the input.

    ``runs`` are all stretches of words (``[^\\x20\\x09-\\x0D]+``) with a smallest
    period q and at least max(``min_length``, ``min_exponent`` * q) words that no
    neighbouring word extends, by start and period.  ``collapsed`` has the words
    but those that any run holds behind its first q, joined by one space.

    Null, empty and blank texts have no words, no runs and an empty ``collapsed``.
    A text of any length is one piece of work (linear but for the sorting of
    k-grams); rows are independent, so nothing is shuffled, and repeated rows and
    ids, also null ones, give a row each.  Other columns are ignored.
    """
    if min_exponent < 2 or min_length < 2:
        raise ValueError("a run has at least two periods and two words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            texts = batch.column(1).cast(pa.binary()).fill_null(b"").to_pylist()
            for first, portion in _portions(texts):
                found = _runs_of_texts(portion, min_length, min_exponent)
                left = [b" ".join(_collapsed(t, found[no]) if no in found else t) for no, t in enumerate(portion)]
                runs = [
                    [{"start": s, "length": n, "period": p} for s, n, p in found.get(no, ())]
                    for no in range(len(portion))
                ]
                yield pa.record_batch(
                    [
                        ids.slice(first, len(portion)),
                        pa.array([len(t) for t in portion], pa.int64()),
                        pa.array(runs, pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))),
                        pa.array(left, pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, SHAPE)
