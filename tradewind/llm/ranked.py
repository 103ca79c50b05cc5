"""The documents that score highest for each item, each distinct bag of terms scored once.

A document is restricted to the vocabulary of the items: its bag holds (term,
occurrences) by ascending term. Only the bag and the document's length class m
enter a score, so documents that share both form a class: found by a 64-bit hash,
verified by grouping on the bag itself. Each class is scored once against all
items, by postings from terms to items. An item's first DEPTH documents lie in
its first DEPTH classes by descending score, then ascending least doc_id: each of
those holds a document that goes before all of any later class. Their members
follow by ascending doc_id, again no more than DEPTH of a class.

Items are taken in blocks of about BLOCK_TERMS terms, dealt by a hash of the
item, so the vocabulary and postings that tasks hold don't grow with the number
of items; each block is ranked against all documents.

Defined cases: a null text has no terms; rows of documents with null or repeated
ids are documents of their own, null ids go last among equal scores and rows that
share score and id are in any order; rows of items that share an id (null too)
are one item, with the terms of all of them; an item without terms, or without
documents above 0, has no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.stored import stored
from tradewind.llm.terms import numbered
from tradewind.llm.text import ALNUM, LOWER, slices, texts, words

DEPTH = 50
#: Terms of items in a block, about; a single item may have more.
BLOCK_TERMS = 1 << 18
#: Cells of a table of classes and items, and entries of its postings, at a time.
CELLS = 1 << 20
LAST = np.iinfo(np.int64).max


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and term, each pair once."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            t = texts(piece.column("text"))
            w = words(t, ALNUM)
            dictionary, at = numbered(t, w, LOWER)
            pairs = np.unique(w.owner * max(len(dictionary), 1) + at)
            owner, term = np.divmod(pairs, max(len(dictionary), 1))
            yield pa.record_batch({"item_id": piece.column("item_id").take(pa.array(owner)), "term": dictionary.take(pa.array(term)).cast(pa.binary())})

    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, term binary").distinct()


def bags(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """doc_id, n (terms) and bag (little-endian 32-bit pairs of term and occurrences) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            t = texts(piece.column("text"))
            w = words(t, ALNUM)
            dictionary, at = numbered(t, w, LOWER)
            known = pc.index_in(dictionary, value_set=vocabulary).fill_null(-1)
            term = np.asarray(known, np.int64)[at]
            mine = term >= 0
            pair, tf = np.unique(w.owner[mine] * len(vocabulary) + term[mine], return_counts=True)
            owner, term = np.divmod(pair, max(len(vocabulary), 1))
            ends = np.append(0, np.searchsorted(owner, np.arange(piece.num_rows), side="right")) * 8
            data = np.column_stack([term, tf]).astype("<i4")
            column = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), piece.num_rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
            )
            n = np.bincount(w.owner, minlength=piece.num_rows).astype(np.int64)
            yield pa.record_batch({"doc_id": piece.column("doc_id"), "n": n, "bag": column.cast(pa.binary())})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, bag binary")


def _entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and occurrences of all entries of a column of bags."""
    column = pa.concat_arrays([column.cast(pa.large_binary())])
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], "<i4")[offsets[0] // 4 : offsets[-1] // 4].reshape(-1, 2) if offsets[-1] else np.zeros((0, 2), "<i4")
    return np.repeat(np.arange(len(column)), np.diff(offsets) // 8), data[:, 0].astype(np.int64), data[:, 1].astype(np.int64)


def frequencies(rows: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(_entries(batch.column("bag"))[1], minlength=size)
        term = np.flatnonzero(df)
        yield pa.record_batch({"term": term, "df": df[term]})

    found = rows.select("bag").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(size, np.int64)
    df[np.asarray(found["term"], np.int64)] = np.asarray(found["df"], np.int64)
    return df


class Scorer:
    """Scores of bags against the items of a block."""

    def __init__(self, weight: np.ndarray, item: np.ndarray, term: np.ndarray, n_items: int, depth: int) -> None:
        """item, term: the pairs, by ascending term."""
        self.weight, self.item, self.n_items, self.depth = weight, item, n_items, depth
        self.first = np.searchsorted(term, np.arange(len(weight)))
        self.many = np.searchsorted(term, np.arange(len(weight)), side="right") - self.first

    def scores(self, row: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Rows by items."""
        gain = self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
        out = np.zeros(len(m) * self.n_items, np.int64)
        many = self.many[term]
        cut = np.cumsum(many)
        begin = 0
        while begin < len(term):  # postings of at most CELLS entries, or of one term
            end = max(begin + 1, int(np.searchsorted(cut, (cut[begin - 1] if begin else 0) + CELLS, side="right")))
            per = many[begin:end]
            at = np.repeat(self.first[term[begin:end]] - (np.cumsum(per) - per), per) + np.arange(per.sum())
            np.add.at(out, np.repeat(row[begin:end] * self.n_items, per) + self.item[at], np.repeat(gain[begin:end], per))
            begin = end
        return out.reshape(len(m), self.n_items)

    def first_ones(self, item: np.ndarray, score: np.ndarray, least: np.ndarray, class_: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each item, the depth first by descending score and ascending least id."""
        order = np.lexsort((class_, least, -score, item))
        sorted_ = item[order]
        keep = order[np.arange(len(item)) - np.searchsorted(sorted_, sorted_) < self.depth]
        return item[keep], score[keep], least[keep], class_[keep]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first classes of each item in this task."""
        none = np.zeros(0, np.int64)
        held = [(none, none, none, none)]
        waiting = 0
        bar = np.ones(self.n_items, np.int64)  # the least score that can still be among the first
        step = max(1, CELLS // max(self.n_items, 1))
        for batch in batches:
            for begin in range(0, batch.num_rows, step):
                piece = batch.slice(begin, step)
                least = np.asarray(piece.column("least").fill_null(int(LAST)), np.int64)
                found = self.scores(*_entries(piece.column("bag")), np.asarray(piece.column("m"), np.int64))
                at, item = np.nonzero(found >= bar)
                held.append((item, found[at, item], least[at], np.asarray(piece.column("class"), np.int64)[at]))
                waiting += len(at)
                if waiting > CELLS:
                    held = [self.first_ones(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    waiting = 0
                    full = np.bincount(held[0][0], minlength=self.n_items) >= self.depth
                    worst = np.full(self.n_items, LAST)
                    np.minimum.at(worst, held[0][0], held[0][1])
                    bar = np.where(full, worst, 1)
        item, score, least, class_ = self.first_ones(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.record_batch({"item": item, "score": score, "least": pa.array(least, mask=least == LAST), "class": class_})


def _first(rows: DataFrame, by: list[str], order: list, depth: int, name: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= depth)


def _block(docs: DataFrame, pairs: DataFrame, depth: int) -> DataFrame | None:
    """Ranks of all documents for a block of items: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    mine = pairs.toArrow()  # a block has a bounded number of terms
    if not mine.num_rows:
        return None
    coded = pc.dictionary_encode(mine["term"].combine_chunks())
    items = mine["item_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    vocabulary, term, item = coded.dictionary.cast(pa.large_binary()), np.asarray(coded.indices, np.int64), np.asarray(items.indices, np.int64)
    order = np.argsort(term, kind="stable")
    rows = stored(bags(docs, vocabulary))
    n_docs, n_terms = rows.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    df = frequencies(rows, len(vocabulary))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    # Documents without any of the terms score 0.
    keyed = (
        rows.where("octet_length(bag) > 0")
        .withColumn("m", F.expr(f"100 - 50 + (50 * n * {n_docs}L) div {n_terms or 1}L"))
        .withColumn("key", F.xxhash64("bag", "m"))
    )
    class_ = stored(
        keyed.groupBy("key", "bag", "m").agg(F.min("doc_id").alias("least")).withColumn("class", F.monotonically_increasing_id())
    )
    scorer = Scorer(weight, item[order], term[order], len(items.dictionary), depth)
    scored = class_.select("class", "bag", "m", "least").mapInArrow(scorer, "item long, score long, least long, class long")
    best = stored(_first(scored, ["item"], [F.desc("score"), F.asc_nulls_last("least"), "class"], depth, "place"))
    # At most depth classes of each item of the block.
    picked = class_.join(F.broadcast(best.select("class").distinct()), "class").select("class", "key", "bag", "m")
    members = keyed.join(F.broadcast(picked.select("key").distinct()), "key", "left_semi")
    members = _first(members, ["key", "bag", "m"], [F.asc_nulls_last("doc_id")], depth, "place").select("key", "bag", "m", "doc_id")
    expanded = members.join(picked, ["key", "bag", "m"]).select("class", "doc_id").join(best.select("item", "score", "class"), "class")
    ranked = _first(expanded, ["item"], [F.desc("score"), F.asc_nulls_last("doc_id")], depth, "rank")
    table = pa.table({"item": np.arange(len(items.dictionary)), "item_id": items.dictionary})
    names = spark.createDataFrame(table).select("item", F.col("item_id").cast(pairs.schema["item_id"].dataType))
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, depth: int = DEPTH, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the depth best documents of each item."""
    pairs = stored(item_terms(items))
    blocks = -(-pairs.count() // block_terms)
    shares = (pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else pairs for k in range(blocks))
    found = [f for share in shares if (f := _block(docs, share, depth)) is not None]
    if not found:
        kind = items.schema["item_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionAll, found)
