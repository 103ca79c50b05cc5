"""Toxic passages as maximal scoring segments of token log-odds.

A word's weight is its log-odds between toxic and clean labelled texts, under a
Dirichlet prior in proportion to its overall use; words whose weight isn't
significant share one weight, that of their pool. Each text is cut, in time
linear in its words, into all its maximal scoring segments. A segment's
significance is its extreme-value expectation K * n * exp(-lambda * score) among
n words of clean text, and a logistic curve on the best expectation and on the
share of significant words gives the text's score.

Defined cases: a null text is an empty one, which gets the score of a text
without any segment; rows with a null id or repeated ids are scored row by row;
labelled texts that are near copies of each other share the weight of one; without labelled texts of both kinds no word has a weight and every score is the
share of toxic labels, 0 without labels. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.llm.stored import stored
from tradewind.llm.text import ALNUM, Words, hashes, mixed, slices, texts, tidied, windows, words

#: Prior observations of a word for each of its observations.
PRIOR = 0.01
#: Least absolute z-score of a word that keeps its own weight.
SIGNIFICANT_Z = 2.0
#: At most so many words keep their own weight: those with the largest |z|.
LEXICON = 50_000
#: Segments with a larger expectation in clean text of this length don't count.
EXPECTED = 0.01
#: Independent least hashes that near copies have in common.
SKETCH = 3
#: Units of a text's weight, so that weights are summed as integers.
WHOLE = 1 << 20
#: Steps in which expectations and shares are counted for the curve.
GRID = (0.02, 0.002)


@dataclass
class Model:
    key: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    other: float = -1.0
    decay: float = 1.0
    k: float = 1.0
    curve: tuple[float, float, float] = (-30.0, 0.0, 0.0)


def held_out(folds: int) -> Column:
    """The rows that no label is learned from; a null id is in none."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))


def maximal_segments(position: np.ndarray, weight: np.ndarray, other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a text of weight `other` but for some
    words, in order: first word, last word, score. Linear in those words."""
    first, last, low, high, smaller = [], [], [], [], []
    total, before = 0.0, -1
    for p, w in zip(position.tolist(), weight.tolist(), strict=True):
        total += other * (p - before - 1)
        before = p
        if w <= 0:
            total += w
            continue
        start, left, right = p, total, total + w
        total = right
        while True:
            j = len(low) - 1
            while j >= 0 and low[j] >= left:
                j = smaller[j]
            if j < 0 or high[j] >= right:
                break
            start, left = first[j], low[j]
            del first[j:], last[j:], low[j:], high[j:], smaller[j:]
        first.append(start)
        last.append(p)
        low.append(left)
        high.append(right)
        smaller.append(j)
    return [(a, b, h - g) for a, b, g, h in zip(first, last, low, high, strict=True)]


def _hits(piece: pa.RecordBatch, model: Model) -> tuple[Words, np.ndarray, dict[int, list]]:
    """Words, words by text, and the segments of texts that have weighted words."""
    t = texts(piece.column("text"))
    w = words(t, ALNUM)
    n = np.bincount(w.owner, minlength=piece.num_rows)
    found: dict[int, list] = {}
    if len(model.key) and len(w.start):
        h = hashes(t.data, w, fold=True)
        at = np.minimum(np.searchsorted(model.key, h), len(model.key) - 1)
        hit = np.flatnonzero(model.key[at] == h)
        owners, begin = np.unique(w.owner[hit], return_index=True)
        origin = np.searchsorted(w.owner, owners)
        for owner, o, a, b in zip(owners.tolist(), origin, begin, np.append(begin, len(hit))[1:], strict=True):
            found[owner] = maximal_segments(hit[a:b] - o, model.weight[at[hit[a:b]]], model.other)
    return w, n, found


def _features(n: np.ndarray, found: dict[int, list], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: -log10 of the best segment's expectation, share of words in
    significant segments, number of those segments."""
    best, share, count = np.full(len(n), -2.0), np.zeros(len(n)), np.zeros(len(n), np.int64)
    for owner, segments in found.items():
        if segments:
            log_e = np.log10(model.k * n[owner]) - model.decay * np.array([s for _, _, s in segments]) / np.log(10)
            best[owner] = np.clip(-log_e.min(), -2, 12)
            real = [(b - a + 1) for (a, b, _), e in zip(segments, log_e, strict=True) if e <= np.log10(EXPECTED)]
            share[owner], count[owner] = sum(real) / n[owner], len(real)
    return best, share, count


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Weights, expectations and curve from all labelled texts that aren't held out."""
    marked = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(5))
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    # Spark broadcasts the labels if their files are small.
    train = _weighted(docs.select("doc_id", "text").join(stored(marked), "doc_id").select("text", "toxic"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            t = texts(piece.column("text"))
            w = words(t, ALNUM)
            toxic, weight = (np.asarray(piece.column(c), np.int64) for c in ("toxic", "weight"))
            pair = np.unique(np.stack([w.owner.astype(np.uint64), hashes(t.data, w, fold=True)]), axis=1)
            owner = pair[0].astype(np.int64)
            for label in (0, 1):
                mine = toxic[owner] == label
                key, of = np.unique(pair[1][mine], return_inverse=True)
                n = np.bincount(of, weight[owner[mine]], minlength=len(key)).astype(np.int64)
                yield pa.record_batch({"key": key.view(np.int64), "clean": n * (1 - label), "toxic": n * label})

    counted = (
        train.mapInArrow(tidied(count), "key long, clean long, toxic long")
        .groupBy("key")
        .agg((F.sum("clean") / WHOLE).alias("clean"), (F.sum("toxic") / WHOLE).alias("toxic"))
    )
    total = counted.agg(F.sum("clean"), F.sum("toxic")).first()
    n0, n1 = float(total[0] or 0), float(total[1] or 0)
    if not n0 or not n1:
        return Model(curve=(_logit(float(bool(n1))), 0.0, 0.0))
    prior = PRIOR * (F.col("clean") + F.col("toxic"))
    scale = PRIOR * (n0 + n1)
    in0, in1 = F.col("clean") + prior, F.col("toxic") + prior
    odds = F.log(in1 / (n1 + scale - in1)) - F.log(in0 / (n0 + scale - in0))
    weighted = counted.select("key", "clean", "toxic", odds.alias("weight"), (odds / F.sqrt(1 / in0 + 1 / in1)).alias("z"))
    rows = (
        weighted.where(F.abs("z") >= SIGNIFICANT_Z)
        .orderBy(F.abs("z").desc(), "key")
        .limit(LEXICON)
        .toArrow()
        .to_pydict()
    )
    key, weight = np.array(rows["key"], np.int64).view(np.uint64), np.array(rows["weight"], float)
    clean, toxic = np.array(rows["clean"], float), np.array(rows["toxic"], float)
    pool0, pool1 = (max(n0 - clean.sum(), 1.0) / n0, max(n1 - toxic.sum(), 1.0) / n1)
    order = np.argsort(key)
    model = Model(key[order], weight[order], min(float(np.log(pool1 / pool0)), -1e-3))
    p0 = (clean + PRIOR * (clean + toxic)) / (n0 + scale)
    model.decay = _decay(np.append(p0, max(1 - p0.sum(), 1e-9)), np.append(weight, model.other))
    return _calibrated(train, model)


def _weighted(train: DataFrame) -> DataFrame:
    """Every different text of each label, with its weight: WHOLE, shared among those that are alike
    by SKETCH independent least hashes of five words. Else the words of one text that was copied often would look like
    evidence. Texts that merely share a passage seldom have all of them in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            t = texts(piece.column("text"))
            w = words(t, ALNUM)
            h = hashes(t.data, w, fold=True)
            alike = np.zeros(piece.num_rows, np.uint64)
            for _ in range(SKETCH):
                h, least = mixed(h), np.zeros(piece.num_rows, np.uint64)
                for k in (1, 5):  # five words where the text has them
                    got, first = windows(h, w.owner, k)
                    owner, at = np.unique(w.owner[first], return_index=True)
                    if len(got):
                        least[owner] = np.minimum.reduceat(got, at)
                alike = mixed(alike + mixed(least))
            yield pa.record_batch({"toxic": piece.column("toxic"), "text": piece.column("text"), "alike": alike.view(np.int64)})

    every = train.select("toxic", "text").distinct()
    sketched = stored(every.mapInArrow(tidied(run), "toxic int, text string, alike long"))
    alike = ["toxic", "alike"]
    # Few rows as a rule; Spark broadcasts the table if its files are small.
    shared = stored(sketched.groupBy(*alike).agg(F.count("*").alias("n")).where("n > 1"))
    weight = F.greatest(F.lit(1), F.coalesce(F.floor(F.lit(WHOLE) / F.col("n")), F.lit(WHOLE))).cast("long")
    return stored(sketched.join(shared, alike, "left").select("text", "toxic", weight.alias("weight")))


def _logit(p: float) -> float:
    p = min(max(p, 1e-9), 1 - 1e-9)
    return float(np.log(p / (1 - p)))


def _decay(p: np.ndarray, weight: np.ndarray) -> float:
    """The positive root of sum p exp(x * weight) = 1, between 0.05 and 2."""
    if weight.max() <= 0:
        return 1.0
    low, high = 0.05, 2.0
    for _ in range(60):
        x = (low + high) / 2
        low, high = (low, x) if np.exp(np.log(p) + x * weight).sum() > 1 else (x, high)
    return low


def _calibrated(train: DataFrame, model: Model) -> Model:
    """K from how often clean texts reach a score, then the logistic curve."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            _, n, found = _hits(piece, model)
            top = np.zeros(len(n))
            number = np.zeros(len(n), np.int64)
            for owner, segments in found.items():
                top[owner], number[owner] = max((s for *_, s in segments), default=0.0), len(segments)
            yield pa.record_batch({"weight": piece.column("weight"), "n": n, "top": top, "number": number})

    clean = train.where("toxic = 0").mapInArrow(tidied(measure), "weight long, n long, top double, number long")
    each = [F.sum(F.col("weight") * F.col(c)) / WHOLE for c in ("n", "number")]
    seen = clean.agg(*each, F.min(F.when(F.col("top") > 0, F.col("top")))).first()
    model.k = float(min((seen[1] + 0.5) * np.exp(min(model.decay * (seen[2] or 0.0), 20.0)) / max(seen[0], 1), 1.0))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            _, n, found = _hits(piece, model)
            best, share, _ = _features(n, found, model)
            yield pa.record_batch({"toxic": piece.column("toxic"), "weight": piece.column("weight"), "best": best, "share": share})

    # All texts, counted in cells of a grid: its size bounds the rows, not the texts.
    cells = [F.round(F.col(c) / step).cast("long").alias(c) for c, step in zip(("best", "share"), GRID, strict=True)]
    measured = train.mapInArrow(tidied(features), "toxic int, weight long, best double, share double")
    rows = measured.groupBy("toxic", *cells).agg((F.sum("weight") / WHOLE).alias("n")).toArrow()
    y, n = np.asarray(rows["toxic"], float), np.asarray(rows["n"], float)
    best, share = (np.asarray(rows[c], float) * step for c, step in zip(("best", "share"), GRID, strict=True))
    x = np.stack([np.ones(len(y)), best, 10 * share], axis=1)
    order = np.lexsort((x[:, 2], x[:, 1], y))
    model.curve = tuple(_logistic(x[order], y[order], n[order]))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Logistic regression over rows that occur n times, with a small ridge on the slopes, by Newton's steps."""
    b = np.array([_logit((y * n).sum() / n.sum()), 0.0, 0.0])
    ridge = np.diag([1e-6, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (n * (y - p)) - ridge @ b)
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return b


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_passages (significant segments) and best (-log10 of
    the best segment's expectation) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            _, n, found = _hits(piece, model)
            best, share, count = _features(n, found, model)
            a, b, c = model.curve
            p = 1 / (1 + np.exp(-np.clip(a + b * best + c * 10 * share, -30, 30)))
            yield pa.record_batch({"doc_id": piece.column("doc_id"), "score": p, "n_passages": count, "best": best})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        tidied(run), "doc_id long, score double, n_passages long, best double"
    )


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """Every significant passage: doc_id, first_word, last_word, score,
    expectation, and the passage's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            t = texts(piece.column("text"))
            w, n, found = _hits(piece, model)
            origin = np.searchsorted(w.owner, np.arange(piece.num_rows))
            rows = []
            for owner, segments in found.items():
                for a, b, s in segments:
                    e = model.k * n[owner] * np.exp(-model.decay * s)
                    if e <= EXPECTED:
                        span = t.data[w.start[origin[owner] + a] : w.end[origin[owner] + b]].tobytes()
                        rows.append((owner, a, b, s, e, span.decode("utf-8", "replace")))
            owner, a, b, s, e, span = map(list, zip(*rows, strict=True)) if rows else ([],) * 6
            yield pa.record_batch(
                {
                    "doc_id": piece.column("doc_id").take(pa.array(owner, pa.int64())),
                    "first_word": pa.array(a, pa.int64()),
                    "last_word": pa.array(b, pa.int64()),
                    "score": pa.array(s, pa.float64()),
                    "expectation": pa.array(e, pa.float64()),
                    "passage": pa.array(span, pa.string()),
                }
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        tidied(run), "doc_id long, first_word long, last_word long, score double, expectation double, passage string"
    )
