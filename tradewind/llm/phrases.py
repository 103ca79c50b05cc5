"""Collocations per language, their phrases counted by dynamic itemset counting.

Rows are dealt to SHARDS shards by a hash of the text. Shards are scanned in turn
and round again. Words count from the first scan on; a longer phrase is active
from the scan after both of its subphrases (all but its last, all but its first
word) have reached LEAST, so lengths are counted interleaved, and it is counted
in each shard once, until it has completed one full cycle. One that completes its cycle below LEAST
is forgotten. Scanning ends when no shard has anything left to count: after
three cycles at most for phrases of three words, two of them with little to count.

Scans count 64-bit keys of (language, words). What is active is told to tasks by
bitmaps of the frequent keys' slots, sixteen slots a key up to MOST_SLOTS; a slot
shared by two keys makes a phrase active too soon, which costs a count and changes
none. Counts of keys are never below those of their phrases, so every phrase
that reaches LEAST is among the frequent keys; a last scan counts the words
themselves of what may be among them. All results come from those exact counts.

Defined cases: a null text is empty, a null language is `und`; a language without
candidates has no rows; rows with null or repeated ids count as any other.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.stored import stored
from tradewind.llm.terms import numbered
from tradewind.llm.text import LOWER, Words, hashes, mixed, slices, texts, tidied, words

LEAST, FIRST, SHARDS = 10, 2000, 2
LONGEST = 3
MOST_SLOTS = 1 << 28
#: Parts of a language's candidates that are ranked apart before the language is.
PARTS = 64
_codes = np.arange(256)
_SPLIT = np.isin(_codes, np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
_WORD = ~_SPLIT & (_codes != 32) & (_codes != 9)
_STEP, _LENGTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(3)


class Known(NamedTuple):
    """Slots of frequent keys and how many keys there are."""

    bits: np.ndarray
    size: int

    def may(self, key: np.ndarray) -> np.ndarray:
        slot = (key >> np.uint64(2)) & np.uint64(len(self.bits) * 64 - 1)
        return (self.bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


NONE = Known(np.zeros(1, np.uint64), 0)


def _key(raw: np.ndarray, length: int) -> np.ndarray:
    """Keys end in two bits that say how many words there are."""
    return (raw & ~_LENGTH) | np.uint64(length)


class Pieces:
    """Words of a slice in a row, with where a phrase may go on.

    word: each word's place among the pairs (language, word) of the slice; at[k]: the
    first words of phrases of k words; keys of phrases by their first word.
    """

    def __init__(self, piece: pa.RecordBatch) -> None:
        t = texts(piece.column("text"))
        w = words(t, _WORD)
        dictionary, at = numbered(t, w, LOWER)
        lang = piece.column("lang").dictionary_encode()
        self.langs, self.dictionary = lang.dictionary, dictionary
        pair = np.asarray(lang.indices, np.int64)[w.owner] * max(len(dictionary), 1) + at
        pairs, self.word, self.many = np.unique(pair, return_inverse=True, return_counts=True)
        self.lang, self.term = np.divmod(pairs, max(len(dictionary), 1))
        own = self._hashes(dictionary)[self.term] + mixed(self._hashes(self.langs)[self.lang] + np.uint64(1))
        self.keys = {1: _key(mixed(own), 1)}
        # Words go on where no text ends and no mark splits.
        split = np.append(0, np.cumsum(_SPLIT[t.data], dtype=np.int64))[w.start] if len(t.data) else w.start
        joined = (w.owner[1:] == w.owner[:-1]) & (split[1:] == split[:-1])
        self.at = {1: np.arange(len(w.start)), 2: np.flatnonzero(joined), 3: np.flatnonzero(joined[:-1] & joined[1:])}
        self.starts = w.start

    @staticmethod
    def _hashes(column: pa.Array) -> np.ndarray:
        t = texts(column.cast(pa.string()))
        one = Words(t.offsets[:-1], t.offsets[1:], t.offsets[:-1])
        return hashes(t.data, one, fold=False)

    def pair_keys(self) -> np.ndarray:
        """Of every word and the next one, whether they are a phrase or not."""
        own = self.keys[1][self.word]
        return _key(mixed(own[:-1] * _STEP + own[1:]), 2)

    def triple_keys(self, pairs: np.ndarray, at: np.ndarray) -> np.ndarray:
        return _key(mixed(pairs[at] * _STEP + self.keys[1][self.word[at + 2]]), 3)

    def phrases(self, at: np.ndarray, length: int) -> pa.Array:
        parts = [self.dictionary.take(pa.array(self.term[self.word[at + i]])).cast(pa.binary()) for i in range(length)]
        return pc.binary_join_element_wise(*parts, b" ") if length > 1 else parts[0]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _scan(rows: DataFrame, words_too: bool, before: tuple[Broadcast, ...], step: int) -> DataFrame:
    """key, since (the scan from which it is active) and n of what is counted in this scan.

    before: frequent words and pairs as known in the scans from this shard's last one to
    this one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[tuple[Known, Known]] = [b.value for b in before]

        def since(both: list[np.ndarray]) -> np.ndarray:
            """The scan from which phrases are active; 0 where they have been counted here, or are not active."""
            out = np.zeros(len(both[0]), np.int64)
            for back, is_known in enumerate(reversed(both[1:])):
                out[is_known] = step - back
            out[both[0]] = 0
            return out

        for piece in slices(batches, "text"):
            p = Pieces(piece)
            found = []
            if words_too:
                found.append((p.keys[1], np.zeros(len(p.many), np.int64), p.many))
            if len(p.word) > 1:
                pairs = p.pair_keys()
                at, tri = p.at[2], p.at[3]
                word = [w.may(p.keys[1])[p.word] for w, _ in known]
                when = since([k[at] & k[at + 1] for k in word])
                keys = [(pairs[at[when > 0]], when[when > 0])]
                if len(tri) and known[-1][1].size:
                    pair = [k.may(pairs) for _, k in known]
                    when = since([k[tri] & k[tri + 1] for k in pair])
                    tri, when = tri[when > 0], when[when > 0]
                    keys.append((p.triple_keys(pairs, tri), when))
                for key, when in keys:
                    key, one, many = np.unique(key, return_index=True, return_counts=True)
                    found.append((key, when[one], many))
            if found:
                key, when, many = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.record_batch({"key": key.view(np.int64), "since": when.astype(np.int32), "n": many})

    return rows.mapInArrow(tidied(run), "key long, since int, n long")


def _known(counted: DataFrame, lengths: tuple[int, ...], least: int) -> Known:
    """Slots of the frequent keys of some lengths; what comes to the driver is bounded by MOST_SLOTS bits."""
    frequent = counted.where((F.col("n") >= least) & F.col("key").bitwiseAND(3).isin(*lengths)).select("key")
    size = frequent.count()
    if not size:
        return NONE
    slots = min(MOST_SLOTS, max(64, 1 << (16 * size - 1).bit_length()))
    slot = F.shiftrightunsigned("key", 2).bitwiseAND(slots - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))
    found = frequent.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(slots >> 6, np.uint64)
    bits[np.asarray(found["at"], np.int64)] = np.asarray(found["bits"], np.int64).view(np.uint64)
    return Known(bits, size)


def frequent(docs: DataFrame, least: int = LEAST, shards: int = SHARDS) -> Known:
    """Keys of all phrases of one to three words that occur least times in a language."""
    spark = docs.sparkSession
    rows = _rows(docs).withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(shards)))
    counted: DataFrame | None = None
    seen: list[tuple[Known, Known]] = [(NONE, NONE)] * shards  # before the first scan of each shard
    sent = [spark.sparkContext.broadcast(seen[0])] * shards
    for step in range(LONGEST * shards):
        if counted is None:
            now = (NONE, NONE)
        else:
            now = (_known(counted, (1,), least), _known(counted, (2,), least))
        seen.append(now)
        sent.append(spark.sparkContext.broadcast(now))
        last = seen[-1 - shards]
        if step >= shards and all(a.size == b.size for a, b in zip(now, last, strict=True)):
            continue  # nothing is active that this shard hasn't counted
        found = _scan(rows.where(F.col("shard") == step % shards).drop("shard"), step < shards, tuple(sent[-1 - shards :]), step)
        total = (found if counted is None else counted.unionAll(found)).groupBy("key").agg(F.min("since").alias("since"), F.sum("n").alias("n"))
        # What has completed its cycle below the bar is forgotten.
        counted = stored(total.where((F.col("n") >= least) | (F.col("since") > step - shards + 1)).select("key", "since", "n"))
    return _known(counted, (1, 2, 3), least)


def counts(docs: DataFrame, known: Known) -> DataFrame:
    """lang, phrase, size and f of phrases whose key may be known; words of a language as the phrase of size 0."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            p = Pieces(piece)
            pairs = p.pair_keys() if len(p.word) > 1 else np.zeros(0, np.uint64)
            total = np.bincount(p.lang, p.many, minlength=len(p.langs)).astype(np.int64)
            out = [(p.langs, pa.array([b""] * len(p.langs), pa.binary()), np.zeros(len(p.langs), np.int64), total)]
            for length in (1, 2, 3):
                at = p.at[length]
                key = p.keys[1][p.word[at]] if length == 1 else pairs[at] if length == 2 else p.triple_keys(pairs, at)
                at = at[sent.value.may(key)]
                # Exact numbers of the phrases of this slice.
                number = p.word[at]
                for i in range(1, length):
                    number = np.unique(number * len(p.many) + p.word[at + i], return_inverse=True)[1]
                _, one, many = np.unique(number, return_index=True, return_counts=True)
                at = at[one]
                langs = p.langs.take(pa.array(p.lang[p.word[at]]))
                out.append((langs, p.phrases(at, length), np.full(len(at), length, np.int64), many))
            for langs, phrase, size, many in out:
                yield pa.record_batch({"lang": langs, "phrase": phrase.cast(pa.string()), "size": size, "f": many})

    found = _rows(docs).mapInArrow(tidied(run), "lang string, phrase string, size long, f long")
    return found.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f"))


def _exact(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)); counts below 10^13 keep every product below 38 digits."""
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    return F.call_function("div", wide(F.lit(1_000_000), 7) * wide(a, 13) * wide(a, 13), wide(left, 13) * wide(right, 13))


def collocations(docs: DataFrame, least: int = LEAST, first: int = FIRST, shards: int = SHARDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first phrases."""
    counted = stored(counts(docs, frequent(docs, least, shards)))
    f = counted.where("size > 0")
    phrase = f.where((F.col("size") > 1) & (F.col("f") >= least)).select("lang", "phrase", "size", F.col("f").alias("a"))
    head = F.substring_index("phrase", " ", 1)
    tail = F.substring_index("phrase", " ", -1)
    # Cuts after the first word, and before the last one where that is another cut.
    rest = F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)")
    body = F.expr("substring_index(phrase, ' ', cast(size as int) - 1)")
    cut = F.explode(
        F.when(F.col("size") == 2, F.array(F.struct(F.lit(1).alias("k"), head.alias("left"), tail.alias("right")))).otherwise(
            F.array(
                F.struct(F.lit(1).alias("k"), head.alias("left"), rest.alias("right")),
                F.struct(F.lit(2).alias("k"), body.alias("left"), tail.alias("right")),
            )
        )
    )
    cuts = phrase.select("lang", "phrase", "size", "a", cut.alias("cut")).select("lang", "phrase", "size", "a", "cut.*")
    of = f.where(f"f >= {least}")
    scored = (
        cuts.join(of.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
        .join(of.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
        .withColumn("score", _exact(F.col("a"), F.col("l"), F.col("r")))
        .groupBy("lang", "phrase", "size", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "a", "size", "cut.score", "cut.l", "cut.r")
    )
    inside = (
        phrase.where(f"size = {LONGEST}")
        .select("lang", F.explode(F.array(body, rest)).alias("phrase"), F.col("a").alias("longer"))
        .groupBy("lang", "phrase")
        .agg(F.max("longer").alias("longer"))
    )
    alone = scored.join(inside, ["lang", "phrase"], "left").where("longer is null or 100 * longer < 50 * a")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    best = alone.withColumn("place", F.row_number().over(part)).where(F.col("place") <= first)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    total = counted.where("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
