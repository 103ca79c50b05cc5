"""Documents with every defined case, and plain versions of words and sets."""

from __future__ import annotations

import random
import re

from pyspark.sql import types as T

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that the operators use for themselves.
        T.StructField("score", T.StringType()),
        T.StructField("row", T.StringType()),
        T.StructField("component", T.StringType()),
        T.StructField("words", T.StringType()),
    ]
)


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def space_words(text: str | None) -> list[str]:
    return SPACE_WORDS.findall(text or "")


def item_words(text: str | None) -> list[str]:
    return ITEM_WORDS.findall(lower(text or ""))


def sentence(chance: random.Random, n: int, size: int = 300) -> list[str]:
    return [f"w{chance.randrange(size)}" for _ in range(n)]


def odd_texts() -> list[str | None]:
    chance = random.Random(5)
    long = " ".join(sentence(chance, 30_000, 5000))
    words = sentence(chance, 80)
    near = words.copy()
    near[40] = "other"
    return [
        None, "", " \n\t", "one", "one", "One  two\nthree", "one two three", "x" * 100_000, long, long + " end",
        " ".join(words), " ".join(near), " ".join(words).upper(), "é à ü " * 30, "日本語 テキスト " * 20, "a\x00b \x01 c\x01d <|endoftext|> <|ENDOFTEXT|>",
        "line\nline\nline\n\n line\nother", "repeat after me now please " * 20, "!!! *** ### $$$ " * 10, "it's we'll  don't '' 's\u0338 =\u0338 ,'s 1234 a1b2",
    ]


def documents(spark, texts=None, ids=None):
    texts = odd_texts() if texts is None else texts
    ids = ids or [3 * i for i in range(len(texts))]
    langs = ["en", "de", None]
    return spark.createDataFrame(
        [(i, t, langs[k % 3], "s", len(t or ""), "x", "y", "z", "w") for k, (i, t) in enumerate(zip(ids, texts, strict=True))], DOCUMENTS
    )


def with_odd_ids(spark):
    """Every odd text, some rows twice, one under two ids, some without an id."""
    texts = odd_texts()
    ids = [3 * i for i in range(len(texts))]
    return documents(spark, texts + texts[8:12] + texts[:12:3], ids + ids[8:12] + [None] * 4)


def shingles(text: str | None) -> set[tuple[str, ...]]:
    words = space_words(lower(text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def linked(sets: dict[int, set]) -> dict[int, int]:
    """Least id that links reach, by comparing all pairs."""
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}
