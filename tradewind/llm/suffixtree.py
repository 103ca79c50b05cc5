"""Language model scores by a probabilistic suffix tree over words.

The root is the smoothed distribution of single tokens. A state is a context of
words that occurs LEAST_COUNT times or more, at any size of the corpus. It lists the symbols that
follow it as often and that it makes likelier by RATIO than its longest proper suffix does, discounted; the mass left
goes to all others in proportion to that suffix's distribution. It is retained if
its divergence from that distribution, times its count, reaches DIVERGENCE. A
token is scored in the longest retained suffix of the words before it.

Contexts grow by a word a level, each level counted over all training texts. A context is
extended only if the symbols it may list cost DIVERGENCE or more, in all their occurrences, as
they are predicted now. That cut loses nothing: a longer context gains at most what its own
occurrences of those symbols cost, and they are some of these. So well-predicted
passages, however often copied, end after few words. Nor is a context extended that occurs as
often as its suffix does: its first word was always there and tells nothing. This is part of what the tree is:
where copied passages go on in different ways, it doesn't look for words before the passage. The levels end
when no context is left; where few are, several lengths are counted in one reading of the texts. From
four words on contexts that end in the same shorter one (their root) need nothing of others: where these occur, the
words before are dealt to tasks by root, which work out several lengths at once. Passages with such contexts are stored once few are
left, so that no other text is read again. Only where a root occurs more than ROOTED times are the lengths joined one after the other.

Counts, probabilities and states are tables, joined level by level. The logarithm of a
token's probability over that at the root is a sum: the weight of each retained
context before it, and of each n-gram listed there that ends at it what it
has over its suffix and that weight. So a text's n-grams are joined with those numbers
in a shuffle and summed by text. Only n-grams with TASK_SHARE of all tokens, of
which there are at most 1 / TASK_SHARE of a length, are looked up in the task instead:
none of those joined is hot. A bitmap of fixed size keeps n-grams that aren't in a table from
leaving their task. Exact counts of all tokens are joined the same way for the base score.

Defined cases: a null text is an empty one, whose only token is its end; a null id is
not held out; rows with null or repeated ids are scored, and learned from,
row by row; without training texts each token has probability 1 in base and
score. Words and n-grams are compared as 64-bit hashes. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.llm.stored import stored
from tradewind.llm.text import NOT_SPACE, eight_hashes, mixed, slices, texts, words

#: Least count of a context, and of a context with a listed symbol.
LEAST_COUNT = 4
#: Share of all tokens from which on an n-gram is looked up in the task, not joined.
TASK_SHARE = 2.0**-20
DISCOUNT = 0.75
RATIO = 1.2
#: Least divergence of a state, in nats over all its occurrences.
DIVERGENCE = 10.0
#: Several levels are counted at once if that takes at most one n-gram for so many tokens,
#: or AT_ONCE in all: however deep the tree, texts are read few times.
READ_AHEAD = 4
AT_ONCE = 1 << 20
#: The passages that are left are stored by themselves where at most one token in so many ends an open context.
NARROW = 32
#: Counted n-grams of a task are summed so many at a time.
SUMMED = 1 << 21
#: N-grams of a root, and about those of a task, that are worked out together.
ROOTED = 1 << 19
#: Slots of a bitmap; more n-grams fill it up, and it then rules out less.
SLOTS = 1 << 26
END = np.uint64(0xE2D0E2D0E2D0E2D1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def learned() -> Column:
    """The rows that the model learns from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, F.lit(True))


def _tokens(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts in a row, each with its end, and their owners."""
    t = texts(piece.column("text"))
    w = words(t, NOT_SPACE)
    last = np.searchsorted(w.owner, np.arange(piece.num_rows), side="right")
    return np.insert(eight_hashes(t.data, w, fold=True), last, END), np.insert(w.owner, last, np.arange(piece.num_rows))


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places in ascending keys, -1 where there is none."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class Tree:
    """The words and n-grams with TASK_SHARE of all tokens: hash and count of words; key and
    value (what it adds to a score) of n-grams, ascending. Of all n-grams, longest: words of the longest,
    rest: key and value of the others, bitmap: the slots of all keys,
    inner: those of n-grams and contexts that longer ones may end in."""

    word: np.ndarray
    count: np.ndarray
    tokens: int
    types: int
    gram: np.ndarray
    value: np.ndarray
    longest: int = 1
    rest: DataFrame | None = None
    bitmap: np.ndarray | None = None
    inner: np.ndarray | None = None


def _gram(shorter: np.ndarray, word: np.ndarray, k: int) -> np.ndarray:
    """Keys of n-grams of k words, of the key of the words after the first and of that."""
    return mixed(shorter * _STEP + word + np.uint64(k))


def _before(owner: np.ndarray) -> np.ndarray:
    """How many tokens of its text are before each."""
    start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    return np.arange(len(owner)) - np.repeat(start, np.diff(np.append(start, len(owner))))


def _runs(key: np.ndarray, kind: str = "quicksort") -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys, and where in it each key's run starts."""
    order = np.argsort(key, kind=kind)
    ascending = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ascending[1:] != ascending[:-1]
    return order, np.flatnonzero(new)


def _grouped(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each different key a place and the sum of n; and the number of each place's key."""
    order, start = _runs(key)
    of = np.empty(len(key), np.int64)
    of[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key))))
    return order[start], np.add.reduceat(n[order], start), of


def _bitmap(keys: DataFrame) -> np.ndarray:
    """The slots of a column key, 64 in a number; halved while most would be empty, as each
    bitmap is sent to all executors and lies on their disks."""
    block = F.shiftright(F.col("key").bitwiseAND(SLOTS - 1), 6).alias("block")
    rows = keys.groupBy(block).agg(F.expr("bit_or(shiftleft(1L, cast(key & 63 as int)))").alias("bits")).toArrow()  # SLOTS / 64 at most
    out = np.zeros(SLOTS >> 6, np.uint64)
    out[np.asarray(rows["block"], np.int64)] = np.asarray(rows["bits"], np.int64).view(np.uint64)
    filled = int(np.bitwise_count(out).sum())
    while len(out) > 1024 and filled * 32 < len(out) * 64:
        out = out[: len(out) // 2] | out[len(out) // 2 :]
    return out


def _may(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    slot = key & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


#: Arrays of an n-gram; the first tells the others.
GRAM = ("key", "size", "context", "suffix")


def _counted(docs: DataFrame, columns: list[str], keys: Callable[[pa.RecordBatch], list[np.ndarray]]) -> DataFrame:
    """n: how often each n-gram of keys (arrays as in GRAM) occurs, by those of them that tell it.
    Summed in tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0

        def summed() -> pa.RecordBatch:
            n, key, *more = (np.concatenate(x) for x in zip(*parts, strict=True))
            order, start = _runs(key, "stable")  # parts are ascending already
            at = order[start]
            found = {c: x[at].view(np.int64) for c, x in zip(GRAM, [key, *more]) if c in columns}
            return pa.record_batch({**found, "n": np.add.reduceat(n[order], start)})

        for piece in slices(batches, "text"):
            key, *more = keys(piece)
            if not len(key):
                continue
            order, start = _runs(key)
            at = order[start]
            parts.append((np.diff(np.append(start, len(key))), key[at], *(x[at] for x in more)))
            rows += len(at)
            if rows >= SUMMED:
                yield summed()
                parts, rows = [], 0
        if parts:
            yield summed()

    train = docs.where(learned()).select("text")
    return train.mapInArrow(run, ", ".join(f"{c} long" for c in [*columns, "n"])).groupBy(*columns).agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """key (a hash) and n of all training tokens."""
    return stored(_counted(docs, ["key"], lambda piece: [_tokens(piece)[0]]))


@dataclass
class Open:
    """What may be extended, as bitmaps by length: n-grams that a longer context may list, and contexts.
    pairs: all frequent n-grams of two words, once they are known."""

    grams: dict[int, np.ndarray]
    contexts: dict[int, np.ndarray]
    pairs: np.ndarray | None = None


def _grown(docs: DataFrame, first: int, last: int, to: Open) -> DataFrame:
    """The frequent n-grams of these lengths that end in an open one: key, size, context (the key without
    the last word), suffix (without the first), n; and the contexts of three words or more that they
    may have, with context and suffix 0 and all bits of the key turned."""

    def run(piece: pa.RecordBatch) -> list[np.ndarray]:
        token, owner = _tokens(piece)
        before = _before(owner)
        begins = np.ones(len(token), bool)  # whether the pair that ends here is frequent, or may be
        if to.pairs is not None:
            begins[1:] = _may(to.pairs, _gram(token[1:], token[:-1], 2))
        else:
            begins[1:] = _may(to.grams[1], token[:-1])
        out: list[list[np.ndarray]] = []

        def grow(at: np.ndarray, longest: int, bitmaps: dict[int, np.ndarray], listing: bool) -> None:
            key = token[at]
            context = token[at - 1]
            for k in range(1, longest + 1):
                if k > 1:
                    suffix = key
                    word = token[at - (k - 1)]
                    key = _gram(suffix, word, k)
                    if listing:
                        context = _gram(context, word, k - 1) if k > 2 else word
                        if k >= first:
                            out.append([key, np.full(len(at), k, np.uint64), context, suffix])
                    elif k >= max(3, first - 1):
                        none = np.zeros(len(at), np.uint64)
                        out.append([~key, np.full(len(at), k, np.uint64), none, none])  # not to be one with the n-gram
                go = before[at] >= k
                if k in bitmaps:
                    go &= _may(bitmaps[k], key)
                go &= begins[at - (k - 1)]  # the first pair of one that is a word longer
                at, key, context = at[go], key[go], context[go]

        every = np.arange(len(token))
        grow(every, last, to.grams, True)
        if last > 3 or first > 3:
            grow(every, last - 1, to.contexts, False)
        if not out:
            return [np.zeros(0, np.uint64)] * len(GRAM)
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    enough = F.col("n") >= LEAST_COUNT
    if last > 2:
        return _counted(docs, [*GRAM], run).where(enough)
    # Pairs, the most numerous by far, are shuffled as their two words.
    pairs = _counted(docs, ["context", "suffix"], run).where(enough)
    return pairs.mapInArrow(_named_pairs, "key long, size long, context long, suffix long, n long")


def _named_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        word, context = (np.asarray(batch.column(c), np.int64) for c in ("suffix", "context"))
        key = _gram(word.view(np.uint64), context.view(np.uint64), 2).view(np.int64)
        size = np.full(len(key), 2, np.int64)
        yield pa.record_batch({"key": key, "size": size, "context": context, "suffix": word, "n": batch.column("n")})


def _smoothed(grown: DataFrame, whole: DataFrame, below: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The n-grams with the log10 probability of the last word (logp), whether their context may
    be extended (open), and value where listed in a retained state; and the contexts, with their
    count and, if retained, weight (back). whole: key and n of contexts; below: key and logp of suffixes, and n of
    the context there (whole)."""
    own = F.log10((F.col("n") - DISCOUNT) / F.col("whole"))
    grams = stored(
        grown.join(whole.select(F.col("key").alias("context"), F.col("n").alias("whole")), "context")
        .join(below.select(F.col("key").alias("suffix"), F.col("logp").alias("parent"), F.col("whole").alias("around")), "suffix")
        .select("key", "context", "n", "whole", "around", "parent", own.alias("own"))
        .withColumn("listed", F.col("own") - F.col("parent") >= F.log10(F.lit(RATIO)))
    )
    total = lambda x: F.sum(F.when(F.col("listed"), x).otherwise(0.0))
    other = lambda x: F.sum(F.when(F.col("listed"), 0.0).otherwise(x))
    ten, nats = F.lit(10.0), float(np.log(10))
    left = lambda c: F.greatest(1 - F.col(c), F.lit(1e-9))
    n, gain = F.col("n"), F.col("n") * (F.col("own") - F.col("parent"))
    weight = F.log10(left("mass") / left("before"))
    retained = (F.col("gain") + (n - F.col("inside")) * weight) * nats >= DIVERGENCE
    kept = F.col("own_sum") + F.col("other_sum") + F.col("outside") * F.col("back")
    contexts = stored(
        grams.groupBy("context")
        .agg(
            F.max("whole").alias("n"),
            F.max("around").alias("around"),
            total(F.pow(ten, "own")).alias("mass"),
            total(F.pow(ten, "parent")).alias("before"),
            total(gain).alias("gain"),
            total(n).alias("inside"),
            other(n).alias("outside"),
            total(n * F.col("own")).alias("own_sum"),
            other(n * F.col("parent")).alias("other_sum"),
            F.sum(n * F.col("parent")).alias("parent_sum"),
        )
        .withColumn("back", F.when(retained, weight))
        .withColumn("cost", -F.coalesce(kept, F.col("parent_sum")) * nats)
        .select("context", "n", "back", ((F.col("cost") >= DIVERGENCE) & (n < F.col("around"))).alias("open"))
    )
    listed = F.col("listed") & F.col("back").isNotNull()
    value = F.when(listed, F.col("own") - F.col("parent") - F.col("back"))
    smooth = grams.join(contexts.select("context", "back", "open"), "context").select(
        "key",
        "context",
        "n",
        "whole",
        "open",
        F.when(listed, F.col("own")).otherwise(F.col("parent") + F.coalesce("back", F.lit(0.0))).alias("logp"),
        value.alias("value"),
    )
    return stored(smooth), contexts


def _row_tokens(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Token hashes and owners of texts, or of rows of `_narrowed`, with the places those name."""
    if "text" in piece.schema.names:
        return *_tokens(piece), None
    token, many = _unpacked(piece.column("tokens"), np.uint64)
    at, ends = _unpacked(piece.column("ends"), np.int32)
    return token, np.repeat(np.arange(len(many)), many), at + np.repeat(np.cumsum(many) - many, ends)


def _unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a binary column, and how many each row has."""
    column = pa.concat_arrays([column.cast(pa.large_binary())])
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].copy().view(kind) if data is not None else np.zeros(0, kind)
    return flat, np.diff(offsets) // size


def _packed(flat: np.ndarray, many: np.ndarray) -> pa.Array:
    """A binary column of numbers, so many a row."""
    offsets = np.append(0, np.cumsum(many)) * flat.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(many), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]).cast(
        pa.binary()
    )


class _Ends:
    """Where in texts a context of so many words ends that may be open, and has a token after it: at, the keys of
    the context and of the n-gram it makes with that token."""

    def __init__(self, piece: pa.RecordBatch, size: int, to: Open) -> None:
        self.token, self.owner, at = _row_tokens(piece)
        token, before = self.token, _before(self.owner)
        self.begins = before > 0  # whether the pair that ends here is frequent, or may be
        self.begins[1:] &= _may(to.pairs, _gram(token[1:], token[:-1], 2))
        follows = np.append(before[1:] > 0, False)
        named = at is not None
        at = at if named else np.flatnonzero(follows & _may(to.contexts[1], token) if 1 in to.contexts else follows)
        key, gram = token[at], _gram(token[at + 1], token[at], 2)
        for k in range(2, size + 1):
            if not named:  # else each length is known to go on
                go = self.begins[at - (k - 2)]
                at, key, gram = at[go], key[go], gram[go]
            word = token[at - (k - 1)]
            key, gram = _gram(key, word, k), _gram(gram, word, k + 1)
            if k in to.contexts and (not named or k == size):
                go = _may(to.contexts[k], key)
                at, key, gram = at[go], key[go], gram[go]
        self.at, self.key, self.gram = at, key, gram


def _narrowed(docs: DataFrame, size: int, to: Open) -> DataFrame:
    """Of texts, or rows of this: the passages with open contexts of so many words, up to the token after the last, and the
    places where these end. A passage begins after a rare pair, as no frequent context goes beyond one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text" if "text" in columns else "tokens"):
            found = _Ends(piece, size, to)
            at = np.sort(found.at)
            rows, first, of, ends = np.unique(np.cumsum(~found.begins)[at] - 1, return_index=True, return_inverse=True, return_counts=True)
            begin = np.flatnonzero(~found.begins)[rows]
            many = at[first + ends - 1] + 2 - begin
            token = found.token[np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
            yield pa.record_batch({"tokens": _packed(token, many), "ends": _packed((at - begin[of]).astype(np.int32), ends)})

    columns = docs.columns
    return stored(docs.mapInArrow(run, "tokens binary, ends binary"))


def _occurrences(docs: DataFrame, first: int, last: int, to: Open) -> DataFrame:
    """Where the open contexts of first - 2 words go on to the left: root (its key), gram (the key with the next token),
    before (the words before it, the nearest first, as many as n-grams of the last length have; none beyond a
    pair that is rare), and n, how often that was found alike."""
    size, most = first - 2, last - first + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text" if "text" in columns else "tokens"):
            found = _Ends(piece, size, to)
            rare = np.maximum.accumulate(np.where(found.begins, -1, np.arange(len(found.begins))))
            nearest = found.at - size
            length = np.minimum(found.at - size + 1 - rare[nearest + 1], most)
            going = length > 0
            nearest, length, root, gram = nearest[going], length[going], found.key[going], found.gram[going]
            if not len(length):
                continue
            start = np.cumsum(length) - length
            depth = np.arange(int(length.sum())) - np.repeat(start, length)
            word = found.token[np.repeat(nearest, length) - depth]
            whole = np.add.reduceat(mixed(word + depth.astype(np.uint64) * _STEP), start) + gram
            at, n, _ = _grouped(mixed(whole + length.astype(np.uint64)), np.ones(len(length), np.int64))
            chosen = np.zeros(len(length), bool)
            chosen[at] = True
            order = np.argsort(at)
            at, n = at[order], n[order]
            word = word[np.repeat(chosen, length)]
            yield pa.record_batch(
                {"root": root[at].view(np.int64), "gram": gram[at].view(np.int64), "n": n, "before": _packed(word, length[at])}
            )

    columns = docs.columns
    return docs.mapInArrow(run, "root long, gram long, n long, before binary")


#: What a row of `_rooted` is: the value of an n-gram or state; an n-gram or a context that longer ones may
#: end in; and those of the last length: contexts, and n-grams with their logarithm and the count of their context.
VALUE, INNER, CONTEXT, BELOW = range(4)


def _rooted(occurring: DataFrame, below: DataFrame, first: int, last: int, rows: int) -> DataFrame:
    """`_smoothed` of all these lengths: kind (see above), size, key, context, n, number and whole.
    occurring: `_occurrences`, below: the open n-grams a word shorter than first; rows: about how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches, schema=schema).combine_chunks()
        if not held.num_rows:
            return
        root, gram, n, whole = (held.column(c).to_numpy() for c in ("root", "gram", "n", "whole"))
        root, gram = root.view(np.uint64), gram.view(np.uint64)
        start = np.flatnonzero(whole > 0)
        start = start[np.argsort(gram[start])]
        opened, at = np.unique(root[start], return_index=True)
        around = whole[start][at]
        in_open, under = _find(opened, root), _find(gram[start], gram)
        logp = np.append(held.column("logp").to_numpy()[start], np.nan)[under]
        flat, length = _unpacked(held.column("before").combine_chunks().fill_null(b""), np.uint64)
        place = np.cumsum(length) - length
        at = np.flatnonzero((whole == 0) & (in_open >= 0))
        around, context = around[in_open[at]], root[at]
        gram, n, logp, place, length = gram[at], n[at], logp[at], place[at], length[at]
        for k in range(first, last + 1):
            go = length > k - first
            context, gram, n, logp, around, place, length = (x[go] for x in (context, gram, n, logp, around, place, length))
            if not len(context):
                return
            word = flat[place + (k - first)]
            context, gram = _gram(context, word, k - 1), _gram(gram, word, k)
            held_at, total, of = _grouped(context, n)
            gram_at, count, gram_of = _grouped(gram, n)
            frequent = np.flatnonzero((count >= LEAST_COUNT) & ~np.isnan(logp[gram_at]))
            if not len(frequent):
                return
            count, parent, inside = count[frequent], logp[gram_at[frequent]], of[gram_at[frequent]]
            places, back_to = np.unique(inside, return_inverse=True)
            held_in, whole_of, before = context[held_at[places]], total[places], around[held_at[places]]
            own = np.log10((count - DISCOUNT) / whole_of[back_to])
            listed = own - parent >= np.log10(RATIO)
            summed = lambda x, back_to=back_to, places=places: np.bincount(back_to, x, minlength=len(places))
            only, other = np.where(listed, count, 0), np.where(listed, 0, count)
            weight = np.log10(
                np.maximum(1 - summed(np.where(listed, 10.0**own, 0.0)), 1e-9) / np.maximum(1 - summed(np.where(listed, 10.0**parent, 0.0)), 1e-9)
            )
            nats = float(np.log(10))
            retained = (summed(only * (own - parent)) + (whole_of - summed(only)) * weight) * nats >= DIVERGENCE
            kept = summed(only * own) + summed(other * parent) + summed(other) * weight
            cost = -np.where(retained, kept, summed(count * parent)) * nats
            opens = (cost >= DIVERGENCE) & (whole_of < before)
            listed &= retained[back_to]
            back = np.where(retained, weight, 0.0)
            logs = np.where(listed, own, parent + back[back_to])
            go = opens[back_to]
            keys = gram[gram_at[frequent]]

            def made(kind: int, of: np.ndarray, inside: np.ndarray, n: np.ndarray, number: np.ndarray, whole: np.ndarray, k: int = k) -> pa.RecordBatch:
                kinds = np.full(len(of), kind, np.int32)
                signed = {"key": of.view(np.int64), "context": inside.view(np.int64)}
                return pa.record_batch({"kind": kinds, "size": np.full(len(of), k, np.int32), **signed, "n": n, "number": number, "whole": whole})

            none, no_number = np.zeros(len(places), np.int64), np.zeros(len(places))
            yield made(VALUE, held_in[retained], none[retained], whole_of[retained], back[retained], none[retained])
            value = (own - parent - back[back_to])[listed]
            yield made(VALUE, keys[listed], held_in[back_to][listed], count[listed], value, whole_of[back_to][listed])
            yield made(BELOW if k == last else INNER, keys[go], held_in[back_to][go], count[go], logs[go], whole_of[back_to][go])
            yield made(CONTEXT if k == last else INNER, held_in[opens], none[opens], whole_of[opens], no_number[opens], whole_of[opens])
            # On to the longer ones: what is after open contexts.
            found = np.full(len(gram_at), np.nan)
            found[frequent] = logs
            logp, around = found[gram_of], total[of]
            longer = np.zeros(len(total), bool)
            longer[places] = opens
            go = longer[of]
            context, gram, n, logp, around, place, length = (x[go] for x in (context, gram, n, logp, around, place, length))

    schema = pa.schema([*((c, pa.int64()) for c in ("root", "gram", "n")), ("before", pa.binary()), ("logp", pa.float64()), ("whole", pa.int64())])
    zero = F.lit(0).cast("long")
    grams = occurring.select("root", "gram", "n", "before", F.lit(0.0).alias("logp"), zero.alias("whole"))
    start = below.select(F.col("context").alias("root"), F.col("key").alias("gram"), "n", F.lit(None).cast("binary").alias("before"), "logp", "whole")
    dealt = grams.unionByName(start).repartition(rows // ROOTED + 1, "root")
    return stored(dealt.mapInArrow(run, "kind int, size int, key long, context long, n long, number double, whole long"))


def _hot(parts: list[DataFrame], hot: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys, ascending, and values of the n-grams that tasks hold."""
    found = [part.where(F.col("n") >= hot).select("key", "value").toArrow() for part in parts]  # 2 / TASK_SHARE a length at most
    keys = np.concatenate([np.zeros(0, np.int64), *(x["key"].to_numpy() for x in found)]).view(np.uint64)
    values = np.concatenate([np.zeros(0), *(x["value"].to_numpy() for x in found)])
    key, at = np.unique(keys, return_inverse=True)  # an n-gram may be listed and a state as well
    return key, np.bincount(at, values, minlength=len(key))


def _ahead(done: int, tokens: int, left: int) -> int:
    """How many lengths to count at once after so many, if the open n-grams occur left times."""
    return int(min(done, max(1, max(tokens // READ_AHEAD, AT_ONCE) // left)))


def fit(docs: DataFrame, counts: DataFrame) -> Tree:
    """The tree of the texts learned from; counts: vocabulary(docs)."""
    tokens, types = counts.agg(F.sum("n"), F.count("*")).first()
    tokens = tokens or 0
    hot = max(LEAST_COUNT, tokens * TASK_SHARE)
    rows = counts.where(F.col("n") >= hot).select("key", "n").toArrow()
    word, count = rows["key"].to_numpy().astype(np.int64).view(np.uint64), rows["n"].to_numpy().astype(np.int64)
    order = np.argsort(word)
    tree = Tree(word[order], count[order], tokens, types, np.zeros(0, np.uint64), np.zeros(0))
    if not tokens:
        return tree
    root = F.log10((F.col("n") + 1) / F.lit(float(tokens + types + 1)))
    below = stored(counts.where(F.col("n") >= LEAST_COUNT).select("key", "n", F.lit(tokens).alias("whole"), root.alias("logp")))
    parts, extended = [], [below.select("key")]
    whole, to = below, Open({1: _bitmap(below)}, {})
    k, ahead = 2, 1
    left = below.agg(F.sum("n")).first()[0]
    read, narrow = docs.where(learned()).select("text"), tokens // NARROW
    while left:
        most, every = below.groupBy("context").agg(F.max("whole").alias("whole")).agg(F.max("whole"), F.sum("whole")).first() if k > 3 else (None, 0)
        if k > 3 and most <= ROOTED:
            last = k + max(1, max(tokens // READ_AHEAD, AT_ONCE) // every) - 1
            if every <= narrow:  # few passages are left, and fewer than when they were last stored
                read, narrow = _narrowed(read, k - 2, to), every // READ_AHEAD
            made = _rooted(_occurrences(read, k, last, to), below, k, last, max(every, every * (last - k + 1) // 8))
            parts.append(made.where(F.col("kind") == VALUE).select("key", "n", F.col("number").alias("value")))
            extended.append(made.where(F.col("kind") != VALUE).select("key"))
            below = made.where(F.col("kind") == BELOW).select("key", "context", "n", F.col("number").alias("logp"), "whole")
            left, longest = made.agg(F.sum(F.when(F.col("kind") == BELOW, F.col("n"))), F.max("size")).first()
            if left:
                to.grams[last], to.contexts[last - 1] = _bitmap(below), _bitmap(made.where(F.col("kind") == CONTEXT))
                ahead = _ahead(last, tokens, left)
            k = last + 1 if left else longest or k
            continue
        last = k + ahead - 1
        counted = stored(_grown(docs, k, last, to))
        for k in range(k, last + 1):
            sized = counted.where(F.col("size") == k)
            if k > 3:
                held = counted.where((F.col("size") == k - 1) & (F.col("suffix") == 0))
                whole = held.select(F.bitwise_not("key").alias("key"), "n")
            level, found = _smoothed(sized.where(F.col("suffix") != 0), whole, below)
            states = found.where(F.col("back").isNotNull())
            parts.append(states.select(F.col("context").alias("key"), "n", F.col("back").alias("value")))
            parts.append(level.where(F.col("value").isNotNull()).select("key", "n", "value"))
            below = level.where("open")
            contexts = found.where("open").select(F.col("context").alias("key"))
            extended += [below.select("key"), contexts]
            left = below.agg(F.sum("n")).first()[0]
            if not left:
                break
            if k == 2:  # all frequent pairs are here, and so are the contexts of the next level
                whole, to.pairs = level, _bitmap(level)
        else:
            to.grams[k], to.contexts[k - 1] = _bitmap(below), _bitmap(contexts)
            k += 1
            ahead = _ahead(k - 1, tokens, left)
    tree.longest = k
    tree.gram, tree.value = _hot(parts, hot)
    every = reduce(DataFrame.unionAll, parts)
    tree.bitmap, tree.inner = _bitmap(every), _bitmap(reduce(DataFrame.unionAll, extended))
    if hot > LEAST_COUNT:
        tree.rest = every.where(F.col("n") < hot).select("key", "value")
    return tree


def score(docs: DataFrame, tree: Tree, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    denominator = np.log10(tree.tokens + tree.types + 1)
    rest, tree = tree.rest, replace(tree, rest=None)  # tasks take no table along
    more = rest is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            n = piece.num_rows
            token, owner = _tokens(piece)
            place = _find(tree.word, token)
            known = place >= 0
            base = np.where(known, np.log10(tree.count[place] + 1) if len(tree.count) else 0.0, 0.0)
            gain = np.zeros(n)
            # Rare words and n-grams, by text; what the others add is summed here.
            rare = np.flatnonzero(~known)
            keys, of = [token[rare]], [owner[rare]]
            if tree.bitmap is not None:
                before = _before(owner)
                at, key = np.arange(len(token)), token
                for k in range(1, tree.longest + 1):
                    if k > 1:
                        key = _gram(key, token[at - (k - 1)], k)
                    there = np.flatnonzero(_may(tree.bitmap, key))
                    held = _find(tree.gram, key[there])
                    here = held >= 0
                    gain += np.bincount(owner[at[there[here]]], tree.value[held[here]], minlength=n)
                    if more and k > 1:  # rare words are there already
                        keys.append(key[there[~here]])
                        of.append(owner[at[there[~here]]])
                    go = (before[at] >= k) & _may(tree.inner, key)
                    at, key = at[go], key[go]
                    if not len(at):
                        break
            key, of = np.concatenate(keys), np.concatenate(of)
            order = np.lexsort((key, of))
            key, of = key[order], of[order]
            new = np.ones(len(order), bool)
            new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
            start = np.flatnonzero(new)
            times = np.diff(np.append(start, len(order)))
            cut = np.searchsorted(of[start], np.arange(n + 1))
            words_ = pa.StructArray.from_arrays([pa.array(key[start].view(np.int64)), pa.array(times.astype(np.int32))], ["key", "times"])
            yield pa.record_batch(
                {
                    "row": piece.column("row"),
                    "doc_id": piece.column("doc_id"),
                    "held_out": piece.column("held_out"),
                    "n_tokens": np.bincount(owner, minlength=n),
                    "known": np.bincount(owner[known], minlength=n),
                    "base": np.bincount(owner, base, minlength=n),
                    "gain": gain,
                    "rare": pa.ListArray.from_arrays(pa.array(cut, pa.int32()), words_),
                }
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), (~learned()).alias("held_out"), "text")
    found = stored(
        rows.mapInArrow(
            run,
            "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, gain double,"
            " rare array<struct<key:bigint,times:int>>",
        )
    )
    hot = max(LEAST_COUNT, tree.tokens * TASK_SHARE)
    # None of these words and n-grams holds more than TASK_SHARE of the tokens, or LEAST_COUNT.
    values = counts.where(F.col("n") < hot).select("key", "n", F.lit(0.0).alias("value"))
    if rest is not None:
        values = values.unionAll(rest.select("key", F.lit(None).cast("long").alias("n"), "value"))
    joined = found.select("row", F.explode("rare").alias("r")).select("row", "r.key", "r.times").join(values, "key")
    by_row = joined.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("more_known"),
        F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_base"),
        F.sum(F.col("times") * F.col("value")).alias("more_gain"),
    )
    base = F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(denominator))
    return (
        found.drop("rare")
        .join(by_row, "row", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
            F.lit(int(tree.tokens)).cast("long").alias("train_tokens"),
            base.alias("base_score"),
            (base + F.col("gain") + F.coalesce("more_gain", F.lit(0.0))).alias("score"),
        )
    )
