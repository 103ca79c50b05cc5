"""A quality classifier: perplexity under an interpolated modified Kneser-Ney model.

The model is learned from trusted texts only. Its symbols are classes of UTF-8
bytes (small letters, capitals, digits, kinds of white space and punctuation,
hashed classes of bytes beyond ASCII), one for every byte. N-gram counts are summed per
task, then by Spark over hash shards; continuation counts, discounts and back-off weights are
joined from those tables, level by level. ALPHABET ** ORDER bounds those of up to ORDER
symbols at any size of input, so each task looks them up in an array. Longer n-grams, up to LONGEST
symbols, are tables: the logarithm of a symbol's probability over that of order ORDER is
a sum, of the back-off weight of each longer context before it, and, of each longer n-gram that ends
at it, what it has over its suffix and that weight. So a text's n-grams are joined with those numbers in a shuffle and
summed by text. Only n-grams with TASK_SHARE of all symbols, of which there are at most 1 / TASK_SHARE of a
length, are looked up in the task instead: none of those joined is hot. A text is
rejected if its perplexity lies outside the quantiles that trusted texts of its
language reach, held-out ones, which the model hasn't seen.

Defined cases: a null text is an empty one; texts of fewer than MIN_SYMBOLS
symbols are kept without a verdict; a null language is a language of its own;
a language with fewer than MIN_TRUSTED held-out trusted texts has limits from the
quartiles of all its texts (see fences), with fewer than MIN_TRUSTED texts none, and they are kept;
without any trusted text everything is kept. Rows with a null or repeated id are
judged one by one. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradewind.llm.stored import stored
from tradewind.llm.suffixtree import _bitmap, _find, _may
from tradewind.llm.text import slices, texts, tidied
from tradewind.llm.toxicity import held_out

ALPHABET = 64
#: Symbols of the n-grams whose table is an array, and of the longest; their codes must stay below 2 ** 40.
ORDER, LONGEST = 4, 5
#: Share of all symbols from which on a longer n-gram is looked up in the task, not joined.
TASK_SHARE = 2.0**-23
#: Counted n-grams of a task are summed so many at a time.
SUMMED = 1 << 22
MIN_SYMBOLS = 40
MIN_TRUSTED = 30
#: Share of held-out trusted texts below the lower and below the upper limit.
QUANTILES = (0.001, 0.99)
#: The limits are moved outwards by these shares of the mean log-perplexity.
MARGINS = (0.03, 0.08)
#: Without trusted texts, limits lie so many times the quartiles' distance beyond them.
FENCE = 2.0
#: Log-perplexities are counted in steps of this size.
STEP = 1e-3

_SYMBOL = np.full(256, 3, np.uint8)
_SYMBOL[97:123] = np.arange(4, 30)
_SYMBOL[65:91] = 30
_SYMBOL[48:58] = 31
for _i, _c in enumerate(b"\n \t"):
    _SYMBOL[_c] = _i
for _i, _c in enumerate(b".,'\"-!?:;()"):
    _SYMBOL[_c] = 32 + _i
for _c in b"#$%&*+/<=>@[\\]^_`{|}~":
    _SYMBOL[_c] = 43 + _c % 5
_SYMBOL[128:] = 48 + (np.arange(128) * 7) % 16

#: Codes and probabilities by order, and the longer n-grams (see _extended).
Model = dict[str, Any]


def _grams(piece: pa.RecordBatch, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The code of each byte's symbol with the order - 1 before it, and its text.
    Before a text stand newlines."""
    t = texts(piece.column("text"))
    owner = np.repeat(np.arange(piece.num_rows), np.diff(t.offsets))
    symbol = _SYMBOL[t.data].astype(np.int64)
    code = symbol.copy()
    for back in range(1, order):
        same = owner[back:] == owner[:-back]
        code[back:] += np.where(same, symbol[:-back], 0) * ALPHABET**back
    return code, owner


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """From all trusted texts that aren't held out, log probabilities by order: codes and values of the n-grams seen, and
    back-off weights by context."""
    trusted = (
        labels.where(F.col("doc_id").isNotNull() & ~held_out(5))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .where("quality = 1")
        .select("doc_id")
    )
    # Spark broadcasts the ids if their files are small.
    train = docs.select("doc_id", "text").join(stored(trusted), "doc_id").select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0

        def summed() -> pa.RecordBatch:
            code, back = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            return pa.record_batch({"code": code, "n": np.bincount(back, np.concatenate([n for _, n in parts])).astype(np.int64)})

        for piece in slices(batches, "text"):
            parts.append(np.unique(_grams(piece, LONGEST)[0], return_counts=True))
            rows += len(parts[-1][0])
            if rows >= SUMMED:
                yield summed()
                parts, rows = [], 0
        if rows:
            yield summed()

    return _extended(stored(train.mapInArrow(tidied(count), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))))


def _key(length: int, last: Any, code: Any) -> Any:
    """Keys of n-grams of so many symbols, from a column or an array of codes; others if they end their text.
    A bijection, whose last bits vary."""
    if isinstance(code, Column):
        code = code + F.lit(2 * length + last << 40)
        return code.bitwiseXOR(F.shiftright(code, 17))
    code = code + (2 * length + last << 40)
    return (code ^ (code >> 17)).view(np.uint64)


def _extended(counts: DataFrame) -> Model:
    """The model from the count (n) of each n-gram (code) of LONGEST symbols. Beside that of order ORDER
    it has context and weight: contexts of ORDER symbols, and log10 of their back-off weights; key and value: what n-grams that
    tasks hold add to a text's score, with their weights as the next symbol's context unless they end the text;
    rest: those of all others, and bitmap: the slots of their keys; start: what the context before a text adds."""
    levels = {LONGEST: counts.withColumn("whole", F.col("n"))}
    for order in range(LONGEST - 1, ORDER - 1, -1):
        code = (F.col("code") % ALPHABET**order).alias("code")
        levels[order] = stored(levels[order + 1].groupBy(code).agg(F.count("*").alias("n"), F.sum("whole").alias("whole")))
    model: Model = _smoothed(levels[ORDER].select("code", "n"))
    short = dict(model)

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logp = table(short)
        for batch in batches:
            yield batch.append_column("low", pa.array(10.0 ** logp[np.asarray(batch.column("suffix"))].astype(float)))

    adds, backs = {}, {}
    for order in range(ORDER + 1, LONGEST + 1):
        discount = _discount(levels[order])
        context = F.floor(F.col("code") / ALPHABET).alias("context")
        sums = [F.sum("n").alias("total"), F.sum(discount).alias("spared"), F.sum("whole").alias("whole")]
        totals = stored(levels[order].groupBy(context).agg(*sums).withColumn("back", F.col("spared") / F.col("total")))
        backs[order - 1] = totals.select(F.col("context").alias("code"), "whole", F.log10("back").alias("back"))
        suffix = (F.col("code") % ALPHABET ** (order - 1)).alias("suffix")
        own = levels[order].select("code", suffix, context, "whole", (F.col("n") - discount).alias("own"))
        own = own.join(totals.select("context", "total", "back"), "context").select("code", "suffix", "whole", (F.col("own") / F.col("total")).alias("own"), "back")
        if order == ORDER + 1:
            own = own.mapInArrow(tidied(looked_up), "code long, suffix long, whole long, own double, back double, low double")
        else:
            own = own.join(adds[order - 1].select(F.col("code").alias("suffix"), F.col("p").alias("low")), "suffix")
        backed = F.col("back") * F.col("low")
        adds[order] = stored(own.select("code", "whole", (F.col("own") + backed).alias("p"), F.log10(1 + F.col("own") / backed).alias("value")))
    rows = backs[ORDER].toArrow()  # bounded by the alphabet and the order, not by the texts
    at = np.argsort(rows["code"].to_numpy())
    model["context"], model["weight"] = rows["code"].to_numpy()[at], rows["back"].to_numpy()[at]
    model["start"] = sum(r.back for x in backs.values() for r in x.where("code = 0").collect())
    parts = []
    for order in range(ORDER + 1, LONGEST):
        none = F.lit(0.0)
        both = adds[order].select("code", "whole", "value", none.alias("back")).unionAll(backs[order].select("code", "whole", none.alias("value"), "back"))
        summed = stored(both.groupBy("code").agg(F.max("whole").alias("whole"), F.sum("value").alias("value"), F.sum("back").alias("back")))
        parts.append(summed.select(_key(order, 0, F.col("code")).alias("key"), "whole", (F.col("value") + F.col("back")).alias("value")))
        parts.append(summed.select(_key(order, 1, F.col("code")).alias("key"), "whole", "value"))
    parts.append(adds[LONGEST].select(_key(LONGEST, 0, F.col("code")).alias("key"), "whole", "value"))
    every = reduce(DataFrame.unionAll, parts)
    hot = (counts.agg(F.sum("n")).first()[0] or 0) * TASK_SHARE
    rows = every.where(F.col("whole") >= hot).select("key", "value").toArrow()  # a few / TASK_SHARE at most
    key = rows["key"].to_numpy().view(np.uint64)
    at = np.argsort(key)
    model["key"], model["value"] = key[at], rows["value"].to_numpy()[at].astype(np.float32)
    model["rest"] = every.where(F.col("whole") < hot).select("key", "value") if hot > 1 else None
    model["bitmap"] = _bitmap(model["rest"]) if hot > 1 else None
    return model


def _discount(level: DataFrame) -> Column:
    """What modified Kneser-Ney smoothing takes off a count n of this level."""
    freq = {r[0]: r[1] for r in level.groupBy(F.least("n", F.lit(4))).count().collect()}
    n1, n2, n3, n4 = (float(freq.get(i, 0)) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    cut = [
        min(max(i - (i + 1) * y * b / a, 0.05), i - 0.05) if a else i / 2
        for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))
    ]
    return F.when(F.col("n") == 1, cut[0]).when(F.col("n") == 2, cut[1]).otherwise(cut[2])


def _smoothed(counts: DataFrame) -> dict[str, np.ndarray]:
    """Interpolated modified Kneser-Ney from counts of the highest order; lower
    orders count the different symbols that precede an n-gram."""
    model: dict[str, np.ndarray] = {}
    level = counts
    parts = []
    for order in range(ORDER, 0, -1):
        discount = _discount(level)
        context = F.floor(F.col("code") / ALPHABET)
        totals = level.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.sum(discount).alias("spared"))
        joined = level.withColumn("context", context).join(totals, "context")
        parts.append(joined.select(F.lit(order).alias("order"), "code", ((F.col("n") - discount) / F.col("total")).alias("p")))
        parts.append(totals.select(F.lit(-order).alias("order"), F.col("context").alias("code"), (F.col("spared") / F.col("total")).alias("p")))
        level = level.groupBy((F.col("code") % ALPHABET ** (order - 1)).alias("code")).agg(F.count("*").alias("n"))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionAll(part)
    rows = union.toArrow()  # bounded by the alphabet and the order, not by the texts
    order, code, p = (np.asarray(rows[c]) for c in ("order", "code", "p"))
    for k in range(-ORDER, ORDER + 1):
        model[f"code{k}"], model[f"p{k}"] = code[order == k], p[order == k].astype(np.float64)
    return model


def table(model: dict[str, np.ndarray]) -> np.ndarray:
    """log10 probability of each n-gram of the highest order, seen or not."""
    p = np.full((1, ALPHABET), 1.0 / ALPHABET, np.float32)
    for order in range(1, ORDER + 1):
        back = np.ones(ALPHABET ** (order - 1), np.float32)
        back[model[f"code{-order}"]] = model[f"p{-order}"]
        # A context's weight times the distribution without the context's first symbol.
        p = (p[None] * back.reshape(-1, len(p), 1)).reshape(-1)
        p[model[f"code{order}"]] += model[f"p{order}"]
        p = p.reshape(-1, ALPHABET)
    return np.log10(p, out=p).reshape(-1)


def _listed(key: np.ndarray, owner: np.ndarray, rows: int) -> pa.Array:
    """The different keys of each row, and how often it has each."""
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(new)
    times = np.diff(np.append(start, len(key))).astype(np.int32)
    found = pa.StructArray.from_arrays([pa.array(key[start].view(np.int64)), pa.array(times)], ["key", "times"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[start], np.arange(rows + 1)), pa.int32()), found)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, n_symbols and log10 perplexity of each row; null without symbols."""
    rest = model["rest"]
    model = {name: part for name, part in model.items() if name != "rest"}  # tasks take no table along
    joins = rest is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logp = table(model)  # of this task only: idle workers keep nothing
        logp[model["context"]] += model["weight"]
        for piece in slices(batches, "text"):
            code, owner = _grams(piece, LONGEST)
            rows = piece.num_rows
            n = np.bincount(owner, minlength=rows)
            total = np.bincount(owner, logp[code % ALPHABET**ORDER], minlength=rows) + model["start"] * (n > 0)
            last = np.ones(len(code), np.int64)
            last[:-1] = owner[1:] != owner[:-1]
            # The last symbol of a text is no context.
            ends = np.flatnonzero(last)
            place = _find(model["context"], code[ends] % ALPHABET**ORDER)
            ends, place = ends[place >= 0], place[place >= 0]
            total -= np.bincount(owner[ends], model["weight"][place], minlength=rows)
            at, keys, of = np.arange(len(code)), [], []
            for order in range(ORDER + 1, LONGEST + 1):
                key = _key(order, last[at] if order < LONGEST else 0, code[at] % ALPHABET**order)
                place = _find(model["key"], key)
                held = place >= 0
                total += np.bincount(owner[at[held]], model["value"][place[held]], minlength=rows)
                if joins:
                    may = ~held & _may(model["bitmap"], key)
                    keys.append(key[may])
                    of.append(owner[at[may]])
                    held |= may
                at = at[held]  # n-grams whose suffix wasn't seen weren't either
            found = {"doc_id": piece.column("doc_id"), "lang": piece.column("lang"), "n_symbols": n, "total": total}
            if joins:
                found |= {"row": piece.column("row"), "rare": _listed(np.concatenate(keys), np.concatenate(of), rows)}
            yield pa.record_batch(found)

    columns = [F.col("doc_id").cast("long"), "text", F.col("lang").cast("string")]
    schema = "doc_id long, lang string, n_symbols long, total double"
    if rest is None:
        found = docs.select(*columns).mapInArrow(tidied(run), schema)
    else:
        rows = docs.select(F.monotonically_increasing_id().alias("row"), *columns)
        listed = stored(rows.mapInArrow(tidied(run), f"{schema}, row long, rare array<struct<key:bigint,times:int>>"))
        joined = listed.select("row", F.explode("rare").alias("r")).select("row", "r.key", "r.times").join(rest, "key")
        more = joined.groupBy("row").agg(F.sum(F.col("times") * F.col("value")).alias("more"))
        found = listed.drop("rare").join(more, "row", "left").withColumn("total", F.col("total") + F.coalesce("more", F.lit(0.0)))
    per_symbol = F.when(F.col("n_symbols") > 0, -F.col("total") / F.col("n_symbols"))
    return found.select("doc_id", "lang", "n_symbols", per_symbol.alias("log_perplexity"))


def limits(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """lang, low and high: quantiles of held-out trusted texts. Exact to STEP and
    summable, however the rows are dealt. The lower one is no higher than that of all trusted
    texts: those that the model has seen aren't rejected for being known."""
    trusted = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    each = scores.where(F.col("n_symbols") >= MIN_SYMBOLS).join(trusted, "doc_id")
    bins = each.groupBy("lang", F.round(F.col("log_perplexity") / STEP).alias("bin")).agg(
        F.count("*").alias("every"), F.count(F.when(held_out(5), 1)).alias("held")
    )
    of = Window.partitionBy("lang")
    upto = lambda n: F.sum(n).over(of.orderBy("bin")) / F.nullif(F.sum(n).over(of), F.lit(0))
    low, high = QUANTILES
    reached = bins.select("lang", "bin", "held", upto("every").alias("of_every"), upto("held").alias("of_held"))
    at = lambda share, of: F.min(F.when(F.col(of) >= share, F.col("bin")))
    mean = F.sum(F.col("bin") * F.col("held")) / F.nullif(F.sum("held"), F.lit(0))
    return (
        reached.groupBy("lang")
        .agg(
            F.sum("held").alias("n_trusted"),
            (STEP * (F.least(at(low, "of_held"), at(low, "of_every")) - MARGINS[0] * mean)).alias("low"),
            (STEP * (at(high, "of_held") + MARGINS[1] * mean)).alias("high"),
        )
        .where(F.col("n_trusted") >= MIN_TRUSTED)
    )


def fences(scores: DataFrame) -> DataFrame:
    """lang, low and high from all texts of a language: FENCE times the distance of the quartiles beyond those."""
    bins = scores.where(F.col("n_symbols") >= MIN_SYMBOLS).groupBy("lang", F.round(F.col("log_perplexity") / STEP).alias("bin")).count()
    each = Window.partitionBy("lang")
    upto = F.sum("count").over(each.orderBy("bin")) / F.sum("count").over(each)
    at = lambda share: STEP * F.min(F.when(F.col("upto") >= share, F.col("bin")))
    found = bins.withColumn("upto", upto).groupBy("lang").agg(F.sum("count").alias("n"), at(0.25).alias("first"), at(0.75).alias("third"))
    reach = FENCE * (F.col("third") - F.col("first"))
    return found.where(F.col("n") >= MIN_TRUSTED).select("lang", (F.col("first") - reach).alias("low"), (F.col("third") + reach).alias("high"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, low, high and kept for each row of docs."""
    spark: SparkSession = docs.sparkSession
    scores = stored(score(docs, fit(docs, labels)))
    # Languages with MIN_TRUSTED texts each; Spark joins them as their size asks for.
    trusted = stored(limits(scores, labels))
    every = fences(scores).where(F.lit(not labels.where("quality = 1").isEmpty()))
    others = every.join(trusted.select(F.col("lang").alias("of")), F.col("lang").eqNullSafe(F.col("of")), "left_anti")
    own = stored(trusted.select("lang", "low", "high").unionAll(others)).withColumnRenamed("lang", "of")
    low, high = F.col("low"), F.col("high")
    fits = F.col("log_perplexity").between(low, high)
    return scores.join(own, F.col("lang").eqNullSafe(F.col("of")), "left").select(
        "doc_id",
        "lang",
        "n_symbols",
        F.pow(F.lit(10.0), "log_perplexity").alias("perplexity"),
        F.pow(F.lit(10.0), low).alias("low"),
        F.pow(F.lit(10.0), high).alias("high"),
        F.coalesce((F.col("n_symbols") < MIN_SYMBOLS) | fits, F.lit(True)).alias("kept"),
    )
