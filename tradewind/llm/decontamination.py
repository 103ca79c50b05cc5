"""Benchmark passages in documents, found by winnowed fingerprints.

A window is WINDOW consecutive words of an item, or a shorter item as a whole.
Of any run of t words, winnowing keeps the least hash of k words in each row
of t - k + 1 of them, with k = (t + 1) // 2; two texts that share t words in a
row thus keep one hash in common inside them. Documents are winnowed for
t = WINDOW and for each shorter length that an item has. Hashes that a bitmap
of the items' hashes rules out go no further; the others are joined
with the items' hashes. A hit names a diagonal of document and item, along which
words are compared both ways to the full extent of every shared run.

Defined cases: a null text has no words; an item without words or with a null id
never occurs; items that share an id are one item; rows of documents with null
or repeated ids are treated row by row. Words are compared as 64-bit
hashes. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.stored import stored
from tradewind.llm.text import ALNUM, Words, hashes, mixed, slices, texts, tidied, windows, words

WINDOW = 10
#: Slots of the bitmap; more hashes of items fill it up, and it then rules out less.
SLOTS = 1 << 22


def _words(piece: pa.RecordBatch) -> tuple[Words, np.ndarray]:
    t = texts(piece.column("text"))
    w = words(t, ALNUM)
    return w, hashes(t.data, w, fold=True)


def winnowed(h: np.ndarray, owner: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes for runs of t words, and the word each begins with."""
    k = (t + 1) // 2
    w = t - k + 1
    gram, first = windows(h, owner, k)
    by = owner[first]
    if len(gram) < w:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row = np.flatnonzero(by[: len(by) - w + 1] == by[w - 1 :])
    best, at = gram[row], row
    for i in range(1, w):
        other = gram[row + i]
        better = other <= best  # the last of equal ones
        best, at = np.where(better, other, best), np.where(better, row + i, at)
    at = np.unique(at)
    return mixed(gram[at] + np.uint64(t)), first[at]


def _items(benchmark: DataFrame) -> DataFrame:
    """One row per different word sequence: item (a number), words, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            w, h = _words(piece)
            cut = np.searchsorted(w.owner, np.arange(piece.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(h.view(np.int64)))
            yield pa.record_batch({"item_id": piece.column("item_id"), "words": lists})

    return (
        benchmark.select(F.col("item_id").cast("string"), "text")
        .where("item_id is not null")
        .mapInArrow(tidied(run), "item_id string, words array<bigint>")
        .where(F.size("words") > 0)
        .groupBy("words")
        .agg(F.collect_set("item_id").alias("ids"))
        .withColumn("item", F.monotonically_increasing_id())
    )


def _item_prints(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for item, row in zip(batch.column("item").to_pylist(), batch.column("words"), strict=True):
                h = np.asarray(row.values, np.int64).view(np.uint64)
                print_, at = winnowed(h, np.zeros(len(h), np.int64), min(len(h), WINDOW))
                found.append((print_, at, np.full(len(at), item)))
            print_, at, item = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.record_batch({"print": print_.view(np.int64), "item_at": at, "item": item})

    return items.select("item", "words").mapInArrow(tidied(run), "print long, item_at long, item long")


def _document_prints(docs: DataFrame, lengths: list[int], bitmap: np.ndarray) -> DataFrame:
    """Each row with its number of words, and, where a hash may be an item's, the
    hashes with their places and the hashes of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            w, h = _words(piece)
            n = piece.num_rows
            cut = np.searchsorted(w.owner, np.arange(n + 1))
            found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
            for t in lengths:
                print_, at = winnowed(h, w.owner, t)
                slot = (print_ % np.uint64(SLOTS)).astype(np.int64)
                may = (bitmap[slot >> 3] >> (slot & 7)) & 1 == 1
                found.append((print_[may], at[may]))
            print_, at = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(w.owner[at], kind="stable")
            print_, at = print_[order], at[order]
            owner = w.owner[at]
            prints = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()),
                pa.StructArray.from_arrays([pa.array(print_.view(np.int64)), pa.array(at - cut[owner])], ["print", "at"]),
            )
            size = np.where(np.bincount(owner, minlength=n) > 0, np.diff(cut), 0)
            taken = np.repeat(size > 0, np.diff(cut))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(h[taken].view(np.int64)))
            yield pa.record_batch({"row": piece.column("row"), "doc_id": piece.column("doc_id"), "n_words": np.diff(cut), "prints": prints, "words": lists})

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(
        tidied(run), "row long, doc_id long, n_words long, prints array<struct<print:bigint,at:bigint>>, words array<bigint>"
    )


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared runs of at least a window along diagonals: first word and the one after the last."""
    for batch in batches:
        out = []
        columns = [batch.column(c) for c in ("row", "item", "offset")]
        for row, item, offset, mine, its in zip(*(c.to_pylist() for c in columns), batch.column("here"), batch.column("words"), strict=True):
            mine, its = np.asarray(mine.values), np.asarray(its.values)
            skip = max(0, -offset)
            same = np.zeros(len(mine) + 2, np.int8)
            same[1:-1] = mine == its[skip : skip + len(mine)]
            turn = np.flatnonzero(np.diff(same))
            for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
                if b - a >= min(len(its), WINDOW):
                    out.append((row, item, offset + skip + a, offset + skip + b))
        row, item, begin, end = zip(*out, strict=True) if out else ((),) * 4
        yield pa.record_batch({k: pa.array(v, pa.int64()) for k, v in (("row", row), ("item", item), ("begin", begin), ("end", end))})


def runs(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of docs (row, doc_id, n_words); every run of words (row, item, begin,
    end) that a document shares with an item over a window at least; and the
    items (item, ids)."""
    items = stored(_items(benchmark))
    prints = stored(_item_prints(items))
    # At most WINDOW lengths and SLOTS slots.
    lengths = [r[0] for r in items.select(F.least(F.size("words"), F.lit(WINDOW))).distinct().collect()]
    slots = prints.select(F.pmod(F.col("print"), F.lit(SLOTS)).alias("slot")).distinct()
    set_ = np.asarray(slots.toArrow()["slot"], np.int64)
    bitmap = np.zeros(SLOTS >> 3, np.uint8)
    np.bitwise_or.at(bitmap, set_ >> 3, (1 << (set_ & 7)).astype(np.uint8))
    rows = stored(_document_prints(docs, sorted(lengths), bitmap))
    met = rows.select("row", F.explode("prints").alias("p")).select("row", "p.print", "p.at").join(prints, "print")
    diagonals = met.select("row", "item", (F.col("at") - F.col("item_at")).alias("offset")).distinct()
    here = F.slice("words", F.greatest("offset", F.lit(0)) + 1, F.col("length") + F.least("offset", F.lit(0)))
    placed = (
        diagonals.join(items.select("item", F.size("words").alias("length")), "item")
        .join(rows.where(F.size("words") > 0).select("row", "words"), "row")
        .select("row", "item", "offset", here.alias("here"))
    )
    found = placed.join(items.select("item", "words"), "item").mapInArrow(tidied(_extended), "row long, item long, begin long, end long")
    return rows.select("row", "doc_id", "n_words"), stored(found.distinct()), items.select("item", "ids")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids (sorted strings) and contaminated for each row of docs."""
    rows, found, items = runs(docs, benchmark)
    before = F.max("end").over(Window.partitionBy("row").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("begin", F.coalesce(before, F.lit(0))))
    hit = found.select("row", new.alias("new")).groupBy("row").agg(F.sum("new").alias("n_hit"))
    named = (
        found.select("row", "item").distinct().join(items, "item").select("row", F.explode("ids").alias("id"))
        .groupBy("row").agg(F.array_sort(F.collect_set("id")).alias("item_ids"))
    )
    none = F.array().cast("array<string>")
    return rows.join(hit.join(named, "row"), "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", none).alias("item_ids"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
