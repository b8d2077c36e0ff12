"""Toxicity scores of deobfuscated text.

Disguised writing (digits and signs for letters, letters set apart, letters
repeated) is a noisy channel.  Every suspicious stretch becomes a lattice of
the letters each character may stand for, with the choice to drop separators
and repeats, and a Viterbi search takes the path that a character language
model of the whole corpus finds most likely.  The restored text is then scored
by the byte n-grams whose rates differ most between the labelled classes.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import parts
from corpusloom.session import materialise

# Labelled rows that the fit looks at, at most.
FIT_ROWS = 20_000
GRAMS = (5, 6, 7)
BITS = 19
THRESHOLD = 0.5
SYMBOLS = 32
OTHER_LETTER, SPACE, SIGN = 27, 0, 28
D = 4

# What a sign may stand for.
READINGS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t",
    "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c",
}
# Log10 costs of the channel: a disguise, a dropped separator, a dropped repeat.
DISGUISE, APART, REPEAT = -0.3, -0.2, -0.2
LEAVE = -3.0
# What may follow a word and stand for itself at no cost.
CLOSING = "!(+|"

_LEET = "".join(map(re.escape, READINGS))
_L = r"[^\W\d_]"
SUSPICIOUS = re.compile(
    rf"(?<!\w){_L}(?:[ .\-_*](?:{_L}|[{_LEET}])){{2,}}(?!\w)"  # letters set apart
    rf"|(?<!\w)(?=\w*?(?:({_L})\1\1)|\w*(?:[{_LEET}]+{_L}|{_L}[{_LEET}]))[\w{_LEET}]*{_L}[\w{_LEET}]*"
    rf"(?:(?<=\|)\)[\w{_LEET}]*)*"
)
# Longer stretches are not remembered, and one letter written more often is not a word.
LONGEST = 64
ONE_LETTER = re.compile(rf"({_L})\1*")


def _symbols() -> bytes:
    table = bytearray([SIGN] * 256)
    for i in range(26):
        table[97 + i] = table[65 + i] = i + 1
    for b in b" \t\n\r\x0b\x0c":
        table[b] = SPACE
    for b in range(128, 256):
        table[b] = OTHER_LETTER
    return bytes(table)


CLASSES = _symbols()


def _symbol(char: str) -> int:
    return CLASSES[ord(char)] if ord(char) < 128 else OTHER_LETTER


def character_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of three successive symbols over all texts, ``SYMBOLS`` cubed.

    Each task adds up its own texts; at most 32 768 sums reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in parts(batches):
            for text in batch.column(0).to_pylist():
                if text:
                    s = (b" " + text.encode("utf-8", "replace") + b" ").translate(CLASSES)
                    s = np.frombuffer(s, np.uint8).astype(np.int32)
                    total += np.bincount((s[:-2] << 10) + (s[1:-1] << 5) + s[2:], minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.record_batch([pa.array(found), pa.array(total[found])], names=["i", "n"])

    rows = docs.select(text_col).mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n")).collect()
    total = np.zeros(SYMBOLS**3)
    for i, n in rows:
        total[i] = n
    return total


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log10 of p(third | two before), each order backed by the next lower one."""
    tri = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    p1 = (uni + 1) / (uni.sum() + SYMBOLS)
    p2 = (bi + 5 * p1) / (bi.sum(1, keepdims=True) + 5)
    p3 = (tri + 5 * p2) / (tri.sum(2, keepdims=True) + 5)
    return np.log10(p3)


def restore_stretch(stretch: str, lm: list) -> str:
    """The most likely writing of one suspicious stretch, surrounded by spaces."""
    # state: the last two symbols -> (score, letters written: the last one and those before it)
    states: dict = {(SPACE, SPACE): (0.0, None)}
    before = ""
    words_end = len(stretch.rstrip(CLOSING))
    for i, char in enumerate(stretch):
        low = char.lower()
        choices = []  # letter written, cost; "" drops the character
        if low in READINGS:
            choices += [(x, DISGUISE) for x in READINGS[low]] + [(char, LEAVE if i < words_end else 0.0)]
            if stretch.startswith("|)", i):
                choices.append(("d", DISGUISE))
        elif char == ")":  # a bar that was read as d has taken it
            choices.append((char, LEAVE))
        elif char in " .-_*":
            choices += [("", APART), (char, LEAVE)]
        else:
            choices.append((char, 0.0))
        if low == before and (low.isalpha() or low in READINGS) and i < words_end:
            choices.append(("", REPEAT))
        before = low
        nxt: dict = {}
        for (a, b), (score, written) in states.items():
            for x, cost in [("", 0.0)] if char == ")" and b == D else choices:
                if x:
                    c = _symbol(x.lower())
                    key, value = (b, c), score + cost + lm[a][b][c]
                else:
                    key, value = (a, b), score + cost
                if key not in nxt or value > nxt[key][0]:
                    nxt[key] = (value, (x, written) if x else written)
        states = nxt
    ends = [(score + lm[a][b][SPACE], written) for (a, b), (score, written) in states.items()]
    best = max(score for score, _ in ends)
    text = max(_text(written) for score, written in ends if score == best)
    closing = stretch[words_end:]
    if closing and text.endswith(closing) and not SUSPICIOUS.search(stretch[:words_end]):
        return stretch  # a plain word before signs that stand for themselves
    return text


def _text(written: tuple | None) -> str:
    out = []
    while written is not None:
        x, written = written
        out.append(x)
    return "".join(reversed(out))


def _kinds() -> np.ndarray:
    """Of every byte: 1 letter, 2 sign that may stand for one, 4 what may set letters apart."""
    kinds = np.zeros(256, np.uint8)
    kinds[65:91] |= 1
    kinds[97:123] |= 1
    kinds[128:] |= 1
    for c in READINGS:
        kinds[ord(c)] |= 2
    for c in b" .-_*":
        kinds[c] |= 4
    return kinds


KINDS = _kinds()
# Bytes on both sides of a suspicious place that are looked at with it, up to white space.
AROUND = 96


def suspicious_places(raw: np.ndarray) -> np.ndarray:
    """Where a letter stands three times, a sign next to a letter, or letters apart.

    Wherever ``SUSPICIOUS`` matches there is a place, and all along letters set apart.
    """
    if len(raw) < 3:
        kind = KINDS[raw]
        return np.flatnonzero((kind[:-1] | kind[1:]) & 3 == 3)
    kind = KINDS[raw]
    letter, sign = kind & 1 > 0, kind & 2 > 0
    low = raw | np.uint8(32)
    same = low[1:] == low[:-1]
    found = [np.flatnonzero(same[1:] & same[:-1] & letter[2:])]
    found.append(np.flatnonzero(sign[:-1] & letter[1:] | letter[:-1] & sign[1:]))
    lead = None
    if raw.max() >= 128:
        # letters of two to four bytes repeat at that distance
        for width, first in ((2, 0xC0), (3, 0xE0), (4, 0xF0)):
            if len(raw) >= 3 * width:
                run = np.r_[0, np.cumsum(raw[width:] == raw[:-width])]
                whole = run[2 * width :] - run[: -2 * width] == 2 * width
                found.append(np.flatnonzero(whole & (raw[: len(whole)] >= first)))
        lead = np.flatnonzero(raw & 0xC0 != 0x80)
        kind = kind[lead]
    if len(kind) >= 4:
        one, apart = kind & 3 > 0, kind & 4 > 0
        at = np.flatnonzero(apart[:-3] & one[1:-2] & apart[2:-1] & one[3:])
        found.append(at if lead is None else lead[at])
    return np.unique(np.concatenate(found))


def restorer(lm: np.ndarray):
    """``text -> restored text``; only the surroundings of suspicious places are
    searched, and short stretches already seen are looked up."""
    table = lm.tolist()
    remembered = lru_cache(maxsize=50_000)(lambda s: restore_stretch(s, table))

    def one(match: re.Match) -> str:
        stretch = match[0]
        if len(stretch) <= LONGEST:
            return remembered(stretch)
        return stretch if ONE_LETTER.fullmatch(stretch) else restore_stretch(stretch, table)

    def restore(text: str) -> str:
        raw = text.encode("utf-8", "replace")
        places = suspicious_places(np.frombuffer(raw, np.uint8))
        if not len(places):
            return text
        gap = np.flatnonzero(np.diff(places) > 2 * AROUND)
        out, done = [], 0
        for first, last in zip(
            places[np.r_[0, gap + 1]].tolist(), places[np.r_[gap, len(places) - 1]].tolist(), strict=True
        ):
            start = max(done, raw.rfind(b" ", 0, max(0, first - AROUND)) + 1)
            stop = raw.find(b" ", last + AROUND)
            stop = len(raw) if stop < 0 else stop
            if stop <= start:
                continue
            out.append(raw[done:start].decode("utf-8", "replace"))
            out.append(SUSPICIOUS.sub(one, raw[start:stop].decode("utf-8", "replace")))
            done = stop
        out.append(raw[done:].decode("utf-8", "replace"))
        return "".join(out)

    return restore


def _grams(text: str) -> list[np.ndarray]:
    """For each gram length the bucket of every run of so many bytes of the lower-cased text."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8)
    b = np.concatenate([b, np.zeros(max(0, GRAMS[-1] - len(b)), np.uint8)]).astype(np.uint32)
    h, out = np.zeros(len(b) + 1, np.uint32), []
    for n in range(1, GRAMS[-1] + 1):
        # a gram of n bytes is one of n - 1 bytes and the next byte
        h = h[:-1] * np.uint32(0x01000193) + b[n - 1 :]
        if n in GRAMS:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            out.append(mixed >> np.uint32(32 - BITS))
    return out


def _packed(sums: np.ndarray) -> bytes:
    return zlib.compress(sums.astype("<i8").tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), "<i8")


def class_counts(labelled: DataFrame, lm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each gram length and class: texts that hold a bucket once and twice at least,
    and the grams there are.

    The sums travel as fixed slices, so what is shuffled depends on the number
    of tasks, not on the texts.
    """
    slices, width = 64, (1 << BITS) // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = restorer(lm)
        total = np.zeros((len(GRAMS), 2, 2, 1 << BITS), np.int32)
        length = np.zeros((len(GRAMS), 2), np.int64)
        for batch in parts(batches):
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                restored = restore(text)
                for k, g in enumerate(_grams(restored)):
                    found, times = np.unique(g, return_counts=True)
                    total[k, toxic, 0, found] += 1
                    total[k, toxic, 1, found[times > 1]] += 1
                    length[k, toxic] += len(g)
        sums = [*total.reshape(-1, width), length]
        yield pa.record_batch(
            [pa.array(range(len(sums))), pa.array([_packed(p) for p in sums])],
            names=["part", "sums"],
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for part, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[part] = sums.get(part, 0) + _unpacked(raw)
        if sums:
            yield pa.record_batch(
                [pa.array(list(sums)), pa.array([_packed(v) for v in sums.values()])],
                names=["part", "sums"],
            )

    shape = "part long, sums binary"
    rows = labelled.mapInArrow(run, shape).repartition(8, "part").mapInArrow(add, shape).collect()
    found = {part: _unpacked(raw) for part, raw in rows}
    lengths = found.pop(max(found)).reshape(len(GRAMS), 2)
    counts = np.stack([found[i] for i in range(len(found))]).reshape(len(GRAMS), 2, 2, 1 << BITS)
    return counts.astype(np.int32), lengths


def _presence(one, zero, n_one: float, n_zero: float):
    """Log ratio of the shares of texts that hold a gram, weak where class 1 rarely does."""
    ratio = np.log((one + 0.1) / (n_one + 0.2)) - np.log((zero + 0.5) / (n_zero + 1.0))
    return np.maximum(ratio, 0) * (one / (one + 2.0))


def _rates(one, zero, l_one: float, l_zero: float):
    """(log ratio, difference) of the rates of a gram in both classes, each drawn
    towards the common rate by one occurrence."""
    common = (one + zero + 0.1) / (l_one + l_zero)
    r0, r1 = (zero + 1) / (l_zero + 1 / common), (one + 1) / (l_one + 1 / common)
    return np.log(r1 / r0), r1 - r0


# Grams that tell less than this of class 1 are not looked at.
TELLING = 0.5


def _summary(weight, ratio, evidence) -> list[float]:
    """Strongest presence, weight of all strong ones, strongest evidence, three strongest;
    all of the telling grams."""
    telling = (weight > TELLING) | (ratio > TELLING)
    weight, evidence = weight[telling], evidence[telling]
    if not len(weight):
        return [0.0] * 4
    strong = min(20.0, float(weight[weight > 2].sum()) / 2)
    top = np.sort(evidence)[-3:]
    return [
        float(weight.max()),
        math.log1p(strong),
        math.log1p(max(0.0, float(top[-1]))),
        math.log1p(max(0.0, float(top.sum()))),
    ]


def own_features(text: str, counts: np.ndarray, totals: np.ndarray, lengths: np.ndarray, toxic: int):
    """Features of a labelled text, with itself taken out of the counts: a text must
    not vouch for itself."""
    out = []
    for k, g in enumerate(_grams(text)):
        found, times = np.unique(g, return_counts=True)
        times = np.minimum(times, 2)
        held = counts[k][:, 0, found].astype(float)
        tf = held + counts[k][:, 1, found]
        texts, length = totals.astype(float), lengths[k].astype(float)
        held[toxic] -= 1
        tf[toxic] -= times
        texts[toxic] -= 1
        length[toxic] = max(1.0, length[toxic] - len(g))
        ratio, more = _rates(tf[1], tf[0], length[1], length[0])
        weight = _presence(held[1], held[0], texts[1], texts[0])
        out += _summary(weight, ratio, times * ratio - len(g) * more)
    return out


def text_features(text: str, tables: list[tuple]) -> list[float]:
    """Features of any text; ``tables`` hold weight, log ratio, difference and whether
    a bucket is telling."""
    out = []
    for g, (weight, ratio, more, telling) in zip(_grams(text), tables, strict=True):
        found, times = np.unique(g[telling[g]], return_counts=True)
        times = np.minimum(times, 2)
        out += _summary(weight[found], ratio[found], times * ratio[found] - len(g) * more[found])
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last entry is the intercept."""
    x = np.c_[x, np.ones(len(x))]
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 0.01 * np.eye(len(beta))
        step = np.linalg.solve(hessian, x.T @ (y - p) - 0.01 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def held_out(id_col: str = "doc_id"):
    """Rows of which no label is looked at: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    """A scorer: the character model of all texts, and what at most ``fit_rows``
    labelled rows outside the held-out part say about the grams.

    Labels of null rows, and ids labelled both ways, are not used.
    """
    spark = docs.sparkSession
    lm = language_model(character_counts(docs))
    chosen = (
        labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other"))
        .where("toxic = other")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(fit_rows)
        .select("doc_id", "toxic")
        .collect()
    )
    model = {"lm": lm, "weights": None, "beta": None, "rate": 0.0}
    if not chosen:
        return model
    few = F.broadcast(spark.createDataFrame(chosen, "doc_id long, toxic int"))
    labelled = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .join(few, "doc_id")
        .select("text", "toxic")
    )
    # the scan has all its tasks; the rows it finds are few and the restoring of each is long
    labelled = materialise(labelled, "toxicity-labelled").repartition(12)
    n_pos = sum(r.toxic for r in chosen)
    model["rate"] = n_pos / len(chosen)
    if n_pos in (0, len(chosen)):
        return model
    counts, lengths = class_counts(labelled, lm)
    totals = np.array([len(chosen) - n_pos, n_pos])
    if not lengths.all():
        return model
    shared = spark.sparkContext.broadcast((counts, totals, lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = restorer(lm)
        for batch in parts(batches):
            texts, toxic = (c.to_pylist() for c in batch.columns)
            x = [own_features(restore(t), *shared.value, y) for t, y in zip(texts, toxic, strict=True)]
            yield pa.record_batch([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    rows = labelled.mapInArrow(run, "x array<double>, y int").collect()
    shared.unpersist()
    model["beta"] = _logistic(np.array([r.x for r in rows]), np.array([r.y for r in rows], float))
    model["weights"] = []
    for k in range(len(GRAMS)):
        zero, one = counts[k][:, 0].astype(float)
        zero2, one2 = zero + counts[k][0, 1], one + counts[k][1, 1]
        weight = _presence(one, zero, totals[1], totals[0]).astype(np.float32)
        ratio, more = (t.astype(np.float32) for t in _rates(one2, zero2, lengths[k][1], lengths[k][0]))
        model["weights"].append((weight, ratio, more, (weight > TELLING) | (ratio > TELLING)))
    return model


def _scorer(model: dict, weights):
    """``text -> (score, whether it was rewritten)`` within a task."""
    restore, beta = restorer(model["lm"]), model["beta"]

    def one(text: str | None) -> tuple[float, bool]:
        text = text or ""
        clear = restore(text)
        if beta is None:
            return model["rate"], clear != text
        z = float(np.dot(beta[:-1], text_features(clear, weights.value)) + beta[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), clear != text

    return one


def keep_clean(docs: DataFrame, model: dict, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores below ``threshold``."""
    small = {k: v for k, v in model.items() if k != "weights"}
    weights = docs.sparkSession.sparkContext.broadcast(model["weights"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_of = _scorer(small, weights)
        for batch in parts(batches):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array([score_of(t)[0] < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``(doc_id, score, restored)``: the score from 0 to 1 of every whole text, and
    whether stretches of it were rewritten.

    A null text is scored as an empty one; ids may be null or repeated.  Without
    labels of both classes every score is the share of class 1 among those there are, or 0.
    """
    small = {k: v for k, v in model.items() if k != "weights"}
    weights = docs.sparkSession.sparkContext.broadcast(model["weights"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_of = _scorer(small, weights)
        for batch in parts(batches):
            found = [score_of(t) for t in batch.column(1).to_pylist()]
            scores, changed = zip(*found, strict=True) if found else ((), ())
            yield pa.record_batch(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(changed, pa.bool_())],
                names=["doc_id", "score", "restored"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, score double, restored boolean"
    )
