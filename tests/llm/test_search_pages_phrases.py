"""Ranked search, HTML extraction and collocations against plain versions."""

import math
import random
import re
from collections import Counter

import pytest
from cases import documents, item_words, lower, odd_texts, sentence, with_odd_ids
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.llm import phrases, ranked, tagpaths
from tradewind.llm.stored import ship

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType())])


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [], [])


# 11. Ranked lexical search


def terms(text):
    return TERMS.findall(lower(text or ""))


def plain_ranks(docs, items, depth=50):
    """(item, rank, score) and, by item, the (score, id) of all documents above 0."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = {}
    for item, wanted in asked.items():
        scored = []
        for i, c, n in counted:
            m = 50 + (50 * n * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                for t in wanted
                if c[t]
            )
            if score > 0:
                scored.append((-score, i is None, i or 0))
        if scored:
            out[item] = [(-s, None if no_id else i) for s, no_id, i in sorted(scored)][:depth]
    return out


def check_ranks(spark, docs, items, **settings):
    frame = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    got = {}
    for r in ranked.search(docs, frame, **settings).collect():
        got.setdefault(r.item_id, []).append((r["rank"], r.score, r.doc_id))
    plain = plain_ranks([(r.doc_id, r.text) for r in docs.collect()], items, settings.get("depth", 50))
    assert {k: [(s, i) for _, s, i in sorted(v, key=lambda x: x[0])] for k, v in got.items()} == plain
    assert all(sorted(r for r, *_ in v) == list(range(1, len(v) + 1)) for v in got.values())


def test_ranks_of_odd_documents(spark, none):
    items = [(1, "w1 w2 w3 W4"), (1, "w5"), (2, None), (3, "!!!"), (None, "one two w7"), (4, "one"), (5, "日本語 é nothere"), (6, "line other me")]
    check_ranks(spark, with_odd_ids(spark), items)
    assert ranked.search(none, spark.createDataFrame([(1, "one", "x")], ITEMS)).count() == 0
    empty = ranked.search(documents(spark), spark.createDataFrame([], ITEMS))
    assert empty.columns == ["item_id", "rank", "doc_id", "score"] and empty.count() == 0


def test_ranks_with_many_copies_ties_and_blocks(spark, monkeypatch):
    """Classes larger than the depth, equal scores of different classes, several blocks, small tables of scores."""
    chance = random.Random(11)
    texts = [" ".join(sentence(chance, chance.randrange(1, 40), 60)) for _ in range(150)]
    texts += [texts[0]] * 70 + [" ".join(sorted(texts[1].split()))] * 30 + ["zz yy w1", "w1 aa bb"] * 20
    ids = list(range(len(texts)))
    chance.shuffle(ids)
    items = [(i, " ".join(sentence(chance, chance.randrange(1, 12), 70))) for i in range(40)]
    docs = documents(spark, texts, ids).repartition(5)
    check_ranks(spark, docs, items, depth=12, block_terms=60)
    monkeypatch.setattr(ranked, "CELLS", 64)
    check_ranks(spark, docs, items, depth=7)


# 12. HTML extraction


PAGE = """<!DOCTYPE html><html><head><title>Title, long. Long; title.</title><style>p{x:y}</style></head><body class="has-sidebar">
<header><h1>Site name</h1><nav><ul><li><a href="/">Home</a></ul></nav></header><!-- <p>no, no.</p> -->
<div class="cookie-notice">We use cookies, as all do. Agree?</div><aside>Aside, a long one. Really long, it is.</aside>
%s
<section id="comments"><p>First! What an article, what a day, what a site. I can only agree, and do.</p></section>
<form action="x"><label>Mail</label><input><button>Send</button></form><script>var a = "<p>script, text.</p>";</script>
<div class="related"><a href="a">More, and more.</a></div><footer>&copy; Site, all rights. Reserved.</footer></body></html>"""
BODY = """<h1>Head &amp; line</h1><p>First  para,\n with <b>bo</b>ld, <a href="x">a link</a> and&nbsp;more.<p>Second&#x2C; without an end; it goes on.<br>New
 line.</p><ul><li>One item.<li>Two items, <i>really</i>.</ul><table><tr><td>a<td>b<tr><td>c</table>"""
TEXT = "Head & line First para, with bold, a link and more. Second, without an end; it goes on. New line. One item. Two items, really. a b c"


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main id='main'><div>%s</div></main>", "<article class='post'>%s"])
def test_marked_article(wrap):
    tail = "" if wrap.endswith(">") else "</article>"
    assert tagpaths.main_text(PAGE % (wrap % BODY + tail)) == TEXT


def test_article_without_a_landmark():
    """By ratios alone: what has many words and marks per block of its path, and what stands in its container."""
    prose = "".join(f"<p>Paragraph {i} of the article, which is long enough; it says a lot, and more. Does it end?</p>" for i in range(6))
    body = f"<div id='story'><h2>A heading here</h2>{prose}</div><div class='box'>Copyright line</div><ul><li><a href='a'>Link, one.</a><li><a href='b'>Two.</a></ul>"
    got = tagpaths.main_text(PAGE % body)
    assert got == "A heading here " + " ".join(re.findall("<p>(.*?)</p>", prose))


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), (" \n", ""), ("plain, <i>te</i>xt &lt;b&gt; &am &amp", "plain, text <b> &am &"), ("<script>x, y.", ""),
        ("<article>One", "One"), ("<article><header><h1>Head</h1></header><p>One.</article>", "Head One."), ("<p>cut, off <a href='x", "cut, off"),
        ("<div hidden>No, no.</div><p>Yes, yes.", "Yes, yes."), ("<p>a, b</div></span></p>c, d", "a, b c, d"), ("<!-- open, comment", ""),
        ("<p title='a>b'>x, <q title=it's>y</q>.</p>", "x, y."), ("<nav>Only, a menu.</nav>", ""), ("1 < 2, 3 > 2.", "1 < 2, 3 > 2."),
        ("<textarea><p>No.</p></textarea><p>Yes.</p>", "Yes."), ("<P>Upper, case.</P><BR/><hr>x, y.", "Upper, case. x, y."),
    ],
)
def test_small_pages(html, text):
    assert tagpaths.main_text(html) == text


def test_deep_and_long_pages_end():
    assert tagpaths.main_text("<div>" * 50_000 + "deep, text") == "deep, text"
    long = "".join(f"<p>Word {i}, and more.</p>" for i in range(30_000))
    assert tagpaths.main_text(f"<article>{long}</article>").count("and more.") == 30_000
    assert tagpaths.main_text("<li>" * 20_000 + "x, y") == "x, y" and tagpaths.main_text('<a "' * 5_000) == ""


def test_pages_as_rows(spark):
    data = [(1, "u", PAGE % f"<article>{BODY}</article>", "x"), (1, None, None, "y"), (None, "u", "<p>a, b.</p>", None), (2, "v", "", "z")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, text string")
    got = tagpaths.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = {(1, "u", TEXT, len(TEXT)), (1, None, "", 0), (None, "u", "a, b.", 5), (2, "v", "", 0)}
    assert {tuple(r) for r in got.collect()} == want and tagpaths.extract(pages.limit(0)).count() == 0


# 13. Phrase collocations


def plain_collocations(rows, least, first):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                f.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    longer = Counter()
    for (lang, words), a in candidates.items():
        for inner in (words[:2], words[1:]) if len(words) == 3 else ():
            longer[lang, inner] = max(longer[lang, inner], a)
    out = []
    for (lang, words), a in candidates.items():
        if 100 * longer[lang, words] >= 50 * a:
            continue
        cuts = [(1000000 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, " ".join(words), a, f[lang, words[:k]], f[lang, words[k:]], n[lang], score))
    ranked_ = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked_ += [(lang, i + 1, *r[1:]) for i, r in enumerate(mine[:first])]
    return sorted(ranked_)


def check_collocations(docs, least, first, shards):
    got = sorted(tuple(r) for r in phrases.collocations(docs, least, first, shards).collect())
    assert got == plain_collocations([(r.lang, r.text) for r in docs.collect()], least, first)
    return got


def test_collocations_of_odd_documents(spark, none):
    assert check_collocations(with_odd_ids(spark), 3, 50, 2)
    assert phrases.collocations(none).count() == 0


@pytest.mark.parametrize("shards", [1, 3])
def test_collocations_at_any_number_of_shards(spark, shards):
    """Phrases that become frequent in any scan, some in the last one only."""
    chance = random.Random(13)
    texts = [" ".join(sentence(chance, chance.randrange(1, 30), 25)).replace("w7", "w7,").replace("w9", "W9\t") for _ in range(90)]
    texts += ["new york city hall", "New York\tCity. Hall"] * 6 + ["late pair here"] * 5
    docs = documents(spark, texts).repartition(3)
    check_collocations(docs, 5, 30, shards)
    assert phrases.frequent(docs, 5, shards).size >= 25


def test_scans_count_each_phrase_once(spark, monkeypatch):
    """Also where the bitmaps are so small that they rule nothing out."""
    monkeypatch.setattr(phrases, "MOST_SLOTS", 64)
    chance = random.Random(14)
    docs = documents(spark, [" ".join(sentence(chance, 20, 12)) for _ in range(40)])
    check_collocations(docs, 4, 100, 2)


def test_scores_are_exact():
    """Products beyond 64 bits."""
    a, left, right = 9_000_000_000_000, 9_100_000_000_001, 9_200_000_000_003
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    row = spark.range(1).select(phrases._exact(F.lit(a), F.lit(left), F.lit(right)).alias("s")).first()
    assert row.s == 1_000_000 * a * a // (left * right)


def test_item_words_and_terms_differ_only_in_digits():
    """The two contracts' classes: digits count in both."""
    assert all(terms(t) == item_words(t) for t in odd_texts() if t)
