"""Quality rules: how far a document's characters and words are from its language.

Reference histograms of a language are counted over all its documents: classes of
characters, and the language's COMMON most frequent words with one bin for all
others. A document's histograms are compared with them by the Jensen-Shannon
distance (base 2, from 0 to 1). Short documents are guarded: a distance counts
only from a least number of words on. The largest distance of words in a kept document
comes from the distances of its language's documents of about its length, as
short texts are farther from their language by chance (see limits).

Base figures: words are runs without white space; word_chars counts their code
points; n_symbols the characters of #*$%&|<>; n_dup_lines lines with a word that
equal an earlier line; n_repeat_words words in windows of five that occur twice
or more in the text. Words are compared as 64-bit hashes.

Defined cases: a null text has no words and fails the base rule; a null language
is a language of its own, and every language has its own reference: those with RARE of
all words or more, at most 1 / RARE, go to the tasks, those of others are joined with
their documents, which are too few to be hot. In a language with fewer than LEAST_WORDS words
distances are told but don't count; without a reference they are null. Rows
with null or repeated ids are judged row by row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.stored import stored
from tradewind.llm.text import NOT_SPACE, Texts, Words, slices, spread_hashes, texts, tidied, windows, words

#: Base rule.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Words of each language's histogram.
COMMON = 100
#: Share of all words under which a language's reference is joined, not held by tasks.
RARE = 0.001
#: Words of a language from which on its documents are judged by distances.
LEAST_WORDS = 2000
#: Guards: distances count from so many words on.
CHAR_WORDS = 40
WORD_WORDS = 40
#: Largest distances of a kept document; that of words may be less.
CHAR_DISTANCE = 0.3
WORD_DISTANCE = 0.5
#: From the median on, a limit is REACH times as far as the lower decile, or LEAST_REACH;
#: what lies within SURE times that is clean.
REACH = 3.5
LEAST_REACH = 0.06
SURE = 2
#: Different distances of a class of lengths from which on it has a limit of its own.
LEAST_DOCS = 30
#: Distances are counted in steps of this size.
STEP = 1e-3
#: Counted words of a task are summed so many at a time.
SUMMED = 1 << 20

#: Character classes: small letters by themselves, then capitals, digits, space,
#: line ends, other control, sentence marks, brackets and quotes, symbols, other marks, beyond ASCII.
CLASSES = 36
_CLASS = np.full(256, 34, np.uint8)
_CLASS[97:123] = np.arange(26)
_CLASS[65:91] = 26
_CLASS[48:58] = 27
_CLASS[:32] = 30
_CLASS[32] = 28
_CLASS[[10, 13]] = 29
_CLASS[list(b".,;:!?-")] = 31
_CLASS[list(b"()[]{}'\"`")] = 32
_CLASS[list(b"#*$%&|<>")] = 33
_CLASS[128:] = 35


def _classes(t: Texts) -> np.ndarray:
    """Characters of each class in each text; a character beyond ASCII is counted by its first byte."""
    n = len(t.offsets) - 1
    kept = np.flatnonzero((t.data < 128) | (t.data >= 192))
    owner = np.searchsorted(t.offsets, kept, side="right") - 1
    return np.bincount(owner * CLASSES + _CLASS[t.data[kept]], minlength=n * CLASSES).reshape(n, CLASSES)


def _language(piece: pa.RecordBatch) -> tuple[np.ndarray, list]:
    coded = piece.column("lang").dictionary_encode(null_encoding="encode")
    return np.asarray(coded.indices, np.int64), coded.dictionary.to_pylist()


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text")


class References(tuple):
    """Classes and words by language, as references() returns them; enough: the languages
    of those with LEAST_WORDS words; rest: lang, classes, words, shares and enough
    of all other languages, or None."""

    enough: frozenset = frozenset()
    rest: DataFrame | None = None


def references(docs: DataFrame) -> References:
    """Histograms by language, and of all documents under the key (): classes as
    shares, and (hashes of words in order, shares with that of the others last)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[object, list] = {}
        rows = 0

        def summed() -> Iterator[pa.RecordBatch]:
            for lang, found in parts.items():
                key, n = (np.concatenate(x) for x in zip(*found, strict=True))
                key, back = np.unique(key, return_inverse=True)
                n = np.bincount(back, n).astype(np.int64)
                yield pa.record_batch({"lang": pa.array([lang] * len(key), pa.string()), "word": key.view(np.int64), "n": n})

        for piece in slices(batches, "text"):
            t = texts(piece.column("text"))
            w = words(t, NOT_SPACE)
            h = spread_hashes(t.data, w, fold=True)
            code, names = _language(piece)
            of = code[w.owner]
            for i, lang in enumerate(names):
                key, n = np.unique(h[of == i], return_counts=True)
                parts.setdefault(lang, []).append((key, n))
                rows += len(key)
            if rows >= SUMMED:
                yield from summed()
                parts.clear()
                rows = 0
        yield from summed()

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[object, np.ndarray] = {}
        for piece in slices(batches, "text"):
            found = _classes(texts(piece.column("text")))
            code, names = _language(piece)
            for i, lang in enumerate(names):
                total[lang] = total.get(lang, 0) + found[code == i].sum(axis=0)
        for lang, n in total.items():
            yield pa.record_batch({"lang": pa.array([lang] * CLASSES, pa.string()), "class": np.arange(CLASSES), "n": n.astype(np.int64)})

    counted = stored(
        _rows(docs).mapInArrow(tidied(count), "lang string, word long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    )
    sizes = counted.groupBy("lang").agg(F.sum("n").alias("size"))
    whole = counted.agg(F.sum("n")).first()[0] or 0
    own = stored(sizes.where(F.col("size") >= RARE * whole))  # 1 / RARE rows at most
    frequent = counted.join(F.broadcast(own.select(F.col("lang").alias("of"), "size")), F.col("lang").eqNullSafe(F.col("of")))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = frequent.withColumn("rank", first).where(F.col("rank") <= COMMON).select("lang", "word", "n", "size")
    every = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(COMMON).toArrow()
    by_class = _rows(docs).mapInArrow(tidied(classes), "lang string, class long, n long").groupBy("lang", "class").agg(F.sum("n").alias("n"))
    by_class = stored(by_class)
    of_words, of_classes = {}, {}

    def shares(n: np.ndarray, size: float) -> np.ndarray:
        return np.append(n, size - n.sum()) / max(size, 1)

    rows = top.toArrow().to_pandas()  # COMMON rows of each language in own
    for lang, part in rows.groupby("lang", dropna=False):
        key, n = part["word"].to_numpy(np.int64).view(np.uint64), part["n"].to_numpy(float)
        order = np.argsort(key)
        of_words[lang if isinstance(lang, str) else None] = key[order], shares(n[order], float(part["size"].iloc[0]))
    key, n = np.asarray(every["word"], np.int64).view(np.uint64), np.asarray(every["n"], float)
    order = np.argsort(key)
    of_words[()] = key[order], shares(n[order], float(whole))
    kept = by_class.join(F.broadcast(own.select(F.col("lang").alias("of"))), F.col("lang").eqNullSafe(F.col("of")), "left_semi")
    for r in kept.collect():
        of_classes.setdefault(r["lang"], np.zeros(CLASSES))[r["class"]] = r["n"]
    of_classes[()] = np.zeros(CLASSES)
    for r in by_class.groupBy("class").agg(F.sum("n").alias("n")).collect():
        of_classes[()][r["class"]] = r["n"]
    out = References(({k: v / max(v.sum(), 1) for k, v in of_classes.items()}, of_words))
    out.enough = frozenset(r["lang"] for r in own.where(F.col("size") >= LEAST_WORDS).collect())
    rare = stored(sizes.where(F.col("size") < RARE * whole))
    if not rare.isEmpty():
        out.rest = _rest(rare.withColumnRenamed("lang", "of"), counted, by_class)
    return out


def _rest(rare: DataFrame, counted: DataFrame, by_class: DataFrame) -> DataFrame:
    """The references of the languages in rare (of, size), a row each."""
    same = F.col("lang").eqNullSafe(F.col("of"))
    first = F.row_number().over(Window.partitionBy("of").orderBy(F.desc("n"), "word"))
    share = F.struct("word", (F.col("n") / F.col("size")).alias("share"))
    found = counted.join(rare, same).withColumn("rank", first).where(F.col("rank") <= COMMON)
    found = found.groupBy("of", "size").agg(F.collect_list(share).alias("found"))  # COMMON at most
    classes = by_class.join(rare.select("of"), same).groupBy("of").agg(F.collect_list(F.struct("class", "n")).alias("classes"))  # CLASSES at most
    classes = classes.select(F.col("of").alias("lang"), "classes")
    return stored(
        found.join(classes, same).select("lang", "classes", F.col("found.word").alias("words"), F.col("found.share").alias("shares"), (F.col("size") >= LEAST_WORDS).alias("enough"))
    )


Found = tuple[np.ndarray, np.ndarray, np.ndarray, bool]


def _joined(piece: pa.RecordBatch, row: int) -> Found | None:
    """The reference that was joined with a row."""
    if not piece.column("words")[row].is_valid:
        return None
    classes = np.zeros(CLASSES)
    for x in piece.column("classes")[row].as_py():
        classes[x["class"]] = x["n"]
    key = np.array(piece.column("words")[row].as_py(), np.int64).view(np.uint64)
    share = np.array(piece.column("shares")[row].as_py())
    order = np.argsort(key)
    return classes / max(classes.sum(), 1), key[order], np.append(share[order], max(1 - share.sum(), 0)), piece.column("enough")[row].as_py()


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of p from q or its row of q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=-1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=-1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def _base(t: Texts, w: Words, h: np.ndarray) -> dict[str, np.ndarray]:
    n = len(t.offsets) - 1
    chars = np.append(0, np.cumsum((t.data < 128) | (t.data >= 192)))
    symbols = np.append(0, np.cumsum(_CLASS[t.data] == 33))
    found = {"n_words": np.bincount(w.owner, minlength=n)}
    found["word_chars"] = np.bincount(w.owner, chars[w.end] - chars[w.start], minlength=n).astype(np.int64)
    found["n_symbols"] = symbols[t.offsets[1:]] - symbols[t.offsets[:-1]]
    # Lines: the bytes between line ends, whatever they are.
    line = words(t, np.arange(256) != 10)
    cut = np.append(0, np.cumsum(NOT_SPACE[t.data]))
    with_word = cut[line.end] > cut[line.start]
    line = Words(line.start[with_word], line.end[with_word], line.owner[with_word])
    key = spread_hashes(t.data, line, fold=False)
    order = np.lexsort((key, line.owner))
    same = (key[order][1:] == key[order][:-1]) & (line.owner[order][1:] == line.owner[order][:-1])
    found["n_dup_lines"] = np.bincount(line.owner[order][1:][same], minlength=n)
    # Words inside windows that occur twice.
    value, first = windows(h, w.owner, 5)
    by = w.owner[first]
    order = np.lexsort((value, by))
    same = (value[order][1:] == value[order][:-1]) & (by[order][1:] == by[order][:-1])
    twice = np.zeros(len(value), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(h) + 1, np.int64)
    np.add.at(step, first[twice], 1)
    np.add.at(step, first[twice] + 5, -1)
    found["n_repeat_words"] = np.bincount(w.owner[np.cumsum(step[:-1]) > 0], minlength=n)
    return found


def judge(docs: DataFrame, reference: References) -> DataFrame:
    """doc_id, base figures, base_failed, both distances (null where guarded) and kept for each row."""
    of_classes, of_words = reference
    enough = reference.enough

    def find(piece: pa.RecordBatch, lang: str | None, row: int) -> Found | None:
        if lang in of_words:
            return of_classes[lang], *of_words[lang], lang in enough
        return _joined(piece, row) if "words" in piece.schema.names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            t = texts(piece.column("text"))
            n = piece.num_rows
            w = words(t, NOT_SPACE)
            exact, folded = spread_hashes(t.data, w, fold=False), spread_hashes(t.data, w, fold=True)
            found = _base(t, w, exact)
            histogram = _classes(t).astype(float)
            histogram /= np.maximum(histogram.sum(axis=1, keepdims=True), 1)
            by_char, by_word = np.full(n, np.nan), np.full(n, np.nan)
            counts, without = np.zeros(n, bool), np.full(n, np.nan)
            code, names = _language(piece)
            for i, lang in enumerate(names):
                mine = code == i
                found_ = find(piece, lang, int(np.argmax(mine)))
                if found_ is None:
                    continue
                classes, key, share, counts[mine] = found_
                by_char[mine] = distance(histogram[mine], classes)
                without[mine] = distance(np.append(np.zeros(len(key)), 1.0), share)
                some = np.flatnonzero(mine[w.owner])
                at = np.minimum(np.searchsorted(key, folded[some]), max(len(key) - 1, 0))
                bin_ = np.where(key[at] == folded[some], at, len(key)) if len(key) else at
                place = np.cumsum(mine) - 1
                size = len(key) + 1
                count = np.bincount(place[w.owner[some]] * size + bin_, minlength=mine.sum() * size).reshape(-1, size).astype(float)
                by_word[mine] = distance(count / np.maximum(count.sum(axis=1, keepdims=True), 1), share)
            failed = (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > MAX_REPEAT_PERCENT * found["n_words"])
            short_char, short_word = found["n_words"] < CHAR_WORDS, found["n_words"] < WORD_WORDS
            yield pa.record_batch(
                {
                    "doc_id": piece.column("doc_id"),
                    **{k: v.astype(np.int64) for k, v in found.items()},
                    "base_failed": failed,
                    "char_distance": pa.array(by_char, mask=short_char | np.isnan(by_char)),
                    "word_distance": pa.array(by_word, mask=short_word | np.isnan(by_word)),
                    "lang": piece.column("lang"),
                    "without": pa.array(without, mask=np.isnan(without)),
                    "enough": counts,
                }
            )

    schema = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
        " base_failed boolean, char_distance double, word_distance double, lang string, without double, enough boolean"
    )
    rows = _rows(docs)
    if reference.rest is None:
        return _kept(stored(rows.mapInArrow(tidied(run), schema)))
    held = F.col("lang").isin([x for x in of_words if isinstance(x, str)])
    held = F.when(F.col("lang").isNull(), F.lit(None in of_words)).otherwise(held)
    rest = reference.rest.select(F.col("lang").alias("of"), "classes", "words", "shares", "enough")
    others = rows.where(~held).join(rest, F.col("lang").eqNullSafe(F.col("of")), "left").drop("of")
    return _kept(stored(rows.where(held).mapInArrow(tidied(run), schema).unionAll(others.mapInArrow(tidied(run), schema))))


def _length() -> Column:
    """The class of a text's length: two for each doubling of its words."""
    return F.floor(2 * F.log2(F.greatest("n_words", F.lit(1))))


def limits(measured: DataFrame) -> DataFrame:
    """of, of_length and limit: the largest distance of words, by language and class of lengths.

    Exact copies count once; the lower half of the distances tells how far clean
    documents spread. Where those stay below the distance of a text
    without any common word (without), so does the limit. A class of few documents
    takes the limit of the next shorter one that has one."""
    known = measured.where(F.col("enough") & F.col("word_distance").isNotNull()).select("lang", _length().alias("length"), "word_distance", "without")
    bins = known.distinct().groupBy("lang", "length", F.round(F.col("word_distance") / STEP).alias("bin")).agg(F.count("*").alias("n"), F.max("without").alias("without"))
    each = Window.partitionBy("lang", "length")
    upto = F.sum("n").over(each.orderBy("bin")) / F.sum("n").over(each)
    at = lambda share: STEP * F.min(F.when(F.col("upto") >= share, F.col("bin")))
    spread = F.col("median") - F.col("decile")
    reached = F.col("median") + F.greatest(REACH * spread, F.lit(LEAST_REACH))
    below = F.col("without") - STEP
    limit = F.least(F.lit(WORD_DISTANCE), F.when(below >= F.col("median") + SURE * spread, F.least(reached, below)).otherwise(reached))
    shorter = Window.partitionBy("lang").orderBy("length")
    return (
        bins.withColumn("upto", upto)
        .groupBy("lang", "length")
        .agg(F.sum("n").alias("n"), F.max("without").alias("without"), at(0.5).alias("median"), at(0.1).alias("decile"))
        .withColumn("own", F.when(F.col("n") >= LEAST_DOCS, limit))
        .select(F.col("lang").alias("of"), F.col("length").alias("of_length"), F.last("own", ignorenulls=True).over(shorter).alias("limit"))
    )


def _kept(measured: DataFrame) -> DataFrame:
    bounds = stored(limits(measured))  # a few rows a language; Spark joins them as their size asks for
    far = (F.col("char_distance") > CHAR_DISTANCE) | (F.col("word_distance") > F.coalesce("limit", F.lit(WORD_DISTANCE)))
    kept = ~F.col("base_failed") & ~(F.col("enough") & F.coalesce(far, F.lit(False)))
    joined = measured.join(bounds, F.col("lang").eqNullSafe(F.col("of")) & (_length() == F.col("of_length")), "left")
    return joined.select(*(c for c in measured.columns if c not in ("lang", "without", "enough")), kept.alias("kept"))
