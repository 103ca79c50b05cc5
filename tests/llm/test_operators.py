"""Each operator against a plain version, on small fixtures with every defined case."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow as pa
import pytest
from cases import documents, item_words, linked, lower, odd_texts, sentence, shingles, space_words, with_odd_ids
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tradewind.llm import bpe, chat, decontamination, divergence, jaccard, licenses, perplexity, suffixtree, tokenfile, toxicity
from tradewind.llm.components import _large_star, _small_star, components
from tradewind.llm.queries import BYTE_BPE, CONTROL, WORD_BPE
from tradewind.llm.stored import shared_folder, ship, stored


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [], [])


# Components


def test_components(spark):
    chance = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(chance.randrange(100, 200), chance.randrange(100, 200)) for _ in range(90)] + [(7, 7), (None, 3)]
    frame = spark.createDataFrame(edges, "a long, b long")
    parent = {x: x for e in edges for x in e if None not in e and e[0] != e[1]}
    for _ in range(len(parent)):
        for a, b in edges:
            if a is not None and a != b:
                parent[a] = parent[b] = min(parent[a], parent[b])
    assert {r.id: r.component for r in components(frame).collect()} == parent
    assert components(frame.limit(0)).count() == 0


# 8. N-gram Jaccard join


def check_groups(spark, docs, texts_by_id):
    sets = {i: shingles(t) for i, t in texts_by_id.items()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.groups(docs).collect()}
    want = linked(sets)
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_groups_of_odd_documents(spark, none):
    texts = odd_texts()
    check_groups(spark, documents(spark, texts), {3 * i: t for i, t in enumerate(texts)})
    assert jaccard.groups(none).count() == 0
    got = jaccard.groups(with_odd_ids(spark))
    assert got.count() == len(texts) + 4 and got.where("doc_id is null").count() == 0


def test_groups_near_the_threshold(spark):
    """Chains of copies with a few words changed, at sizes around every class's bounds."""
    chance = random.Random(2)
    texts = {}
    for size in (5, 7, 9, 20, 33, 36, 40, 44, 66, 70, 80, 131, 160, 260, 520, 700, 1100):
        for _ in range(3):
            words = sentence(chance, size, 3000)
            for _ in range(5):
                texts[len(texts)] = " ".join(words)
                for _ in range(chance.randrange(1, 2 + size // 45)):
                    words[chance.randrange(len(words))] = f"n{chance.randrange(10**6)}"
                words = words[: max(5, len(words) - chance.randrange(1 + size // 12))]
    check_groups(spark, documents(spark, list(texts.values()), list(texts)), texts)


def test_groups_with_a_common_passage_and_many_copies(spark, monkeypatch):
    """Lots larger than a block, and signatures that are frequent in a task."""
    chance = random.Random(3)
    passage = sentence(chance, 60, 10**6)
    base = sentence(chance, 90, 10**6)
    texts = {i: " ".join(sentence(chance, 90, 10**6) + passage) for i in range(60)}
    for i in range(60, 160):
        copy = base.copy()
        for _ in range(chance.randrange(3)):
            copy[chance.randrange(90)] = f"n{chance.randrange(20)}"
        texts[i] = " ".join(copy)
    for i in range(160, 200):
        texts[i] = " ".join(passage)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    check_groups(spark, documents(spark, list(texts.values()), list(texts)).repartition(2), texts)


def test_tables_that_grow_with_the_documents_are_not_broadcast(spark):
    edges = stored(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long"))
    for frame in (jaccard.groups(documents(spark)), _large_star(edges), _small_star(edges)):
        assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString()


# 1. Benchmark decontamination


def plain_report(text, items):
    words = item_words(text)
    hit, met = set(), set()
    for item, other in items:
        other = item_words(other)
        k = min(10, len(other))
        windows = {tuple(other[i : i + k]) for i in range(len(other) - k + 1)} if k and item is not None else set()
        for p in range(len(words) - k + 1):
            if tuple(words[p : p + k]) in windows:
                hit |= set(range(p, p + k))
                met.add(str(item))
    return len(words), len(hit), len(met), sorted(met), bool(hit)


def test_decontamination(spark, none):
    chance = random.Random(4)
    items = [(i, " ".join(sentence(chance, n, 4 if n > 12 else 40))) for i, n in enumerate((0, 1, 2, 3, 6, 9, 10, 11, 25, 40, 60))]
    items += [(50, items[8][1]), (50, items[9][1]), (51, None), (None, items[7][1]), (52, "ß 9, " + items[10][1].upper())]
    texts = odd_texts()
    for i, text in items[5:]:
        words = item_words(text)
        texts.append(" ".join(sentence(chance, 15, 40) + words[chance.randrange(2) :] + sentence(chance, 5, 40)))
        texts.append(", ".join(words[3:12]))
        texts.append(". ".join(words[2:13]).upper())
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    docs = documents(spark, texts)
    got = {r.doc_id: tuple(r)[1:] for r in decontamination.report(docs, benchmark).collect()}
    assert got == {3 * i: plain_report(t, items) for i, t in enumerate(texts)}
    assert sum(x[4] for x in got.values()) > 10
    assert decontamination.report(none, benchmark).count() == 0
    assert decontamination.report(docs, benchmark.limit(0)).where("contaminated or n_items > 0").count() == 0
    assert decontamination.report(with_odd_ids(spark), benchmark).count() == len(odd_texts()) + 8


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 10), st.lists(st.integers(0, 2), min_size=10, max_size=60), st.integers(0, 50), st.randoms(use_true_random=False))
def test_winnowing_keeps_one_hash_of_each_shared_run(t, shared, at, chance):
    left = np.array([chance.randrange(3, 9) for _ in range(at)] + shared, np.uint64)
    right = np.array(shared + [chance.randrange(10, 20) for _ in range(9)], np.uint64)
    start = chance.randrange(len(shared) - t + 1)
    sides = []
    for words, offset in ((left, at), (right, 0)):
        value, first = decontamination.winnowed(words, np.zeros(len(words), np.int64), t)
        k = (t + 1) // 2
        sides.append({(v, f - offset) for v, f in zip(value.tolist(), first.tolist(), strict=True) if start <= f - offset and f - offset + k <= start + t})
    assert sides[0] & sides[1]


# 9. BPE


def test_bpe_equals_the_library(spark, none):
    library = Tokenizer.from_file(BYTE_BPE)
    texts = odd_texts()
    encoded = bpe.encode(documents(spark, texts), BYTE_BPE, ("lang",))
    for r in bpe.decode(encoded, BYTE_BPE, ("lang",)).collect():
        want = library.encode(texts[r.doc_id // 3] or "", add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids)) == want
        assert r.text == library.decode(want, skip_special_tokens=False) == (texts[r.doc_id // 3] or "")
    assert bpe.encode(none, BYTE_BPE).count() == 0
    assert bpe.encode(with_odd_ids(spark), BYTE_BPE).count() == len(texts) + 8


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(open(BYTE_BPE, encoding="utf-8").read())


@settings(max_examples=300, deadline=None)
@given(
    st.one_of(
        st.text(max_size=60),
        st.text("theinrasTION '\n\t  1", max_size=80),
        st.text("=-*#\\/", max_size=60),
        st.text("aé\u0085\u00a0\u1680\u2003\u2028\u202f\u205f\u3000\x1c\x7f  \n中\u2014", max_size=40),
        st.lists(st.sampled_from(["<|endoftext|>", " ", "a b", "<|", "\n"]), max_size=12).map("".join),
    )
)
def test_bpe_cuts(vocabulary, text):
    library = test_bpe_cuts.__dict__.setdefault("library", Tokenizer.from_file(BYTE_BPE))
    ids, length = vocabulary.encode(pa.array([text, None, text]))
    want = library.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want + want and length.tolist() == [len(want), 0, len(want)]


def test_bpe_verifies(vocabulary):
    """Some greedy cuts are wrong; none of them survives."""
    words = [w.encode() for t in odd_texts() for w in space_words(t)[:300]]
    words += [a + b for a, b in zip(list(vocabulary.id)[2000:9000:7], list(vocabulary.id)[3000:10000:7], strict=True)]
    flat, length = vocabulary.cut(words)
    exact = [vocabulary.merged(w) for w in words]
    assert np.split(flat, np.cumsum(length)[:-1])[5].tolist() == exact[5]
    assert flat.tolist() == [i for e in exact for i in e]
    assert any(vocabulary.proposed(w) != e for w, e in zip(words, exact, strict=True))


# 5. Token ids in files


def test_token_files(spark, none):
    library = Tokenizer.from_file(WORD_BPE)
    texts = odd_texts()
    folder = shared_folder(spark)
    tokenfile.write(documents(spark, texts).repartition(3), WORD_BPE, folder)
    got = {r.doc_id: r for r in tokenfile.checksums(tokenfile.read(spark, folder)).collect()}
    at = 0
    for i, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, tokenfile.END]
        assert tuple(got[3 * i]) == (3 * i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    ranks = spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()
    assert [r.n for r in ranks] == sorted((r.n for r in ranks), reverse=True) and sum(r.n for r in ranks) == at
    for docs, n in ((none, 0), (with_odd_ids(spark), len(texts) + 8)):
        folder = shared_folder(spark)
        tokenfile.write(docs, WORD_BPE, folder)
        rows = tokenfile.read(spark, folder).orderBy("start").collect()
        assert len(rows) == n and [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[: len(rows)].tolist()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300) | st.integers(0, 70_000), max_size=50))
def test_packing(ranks):
    control, data = tokenfile.packed(np.array(ranks, np.int64))
    assert len(control) == -(-len(ranks) // 4)
    assert tokenfile.unpacked(control, data, len(ranks)).tolist() == ranks


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40) | st.text("aZ.,'’ \n1é\u0338=<|", max_size=40), min_size=1, max_size=5))
def test_chunks_are_encoded_as_texts(texts):

    store = test_chunks_are_encoded_as_texts.__dict__
    encoder = store.setdefault("encoder", tokenfile.Encoder(open(WORD_BPE, encoding="utf-8").read()))
    library = store.setdefault("library", Tokenizer.from_file(WORD_BPE))
    ids, size = encoder.encode(pa.array(texts))
    want = [[*library.encode(t, add_special_tokens=False).ids, tokenfile.END] for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and size.tolist() == [len(w) for w in want]


# 6. Chat formatting

TEXTS = st.text(max_size=30) | st.text("\\#</turn> :\nA", max_size=40) | st.just(CONTROL)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a: b", "###", "\\"]) | st.text(max_size=5), TEXTS), max_size=6))
def test_marked_turns_are_read_back(turns):
    pieces = [chat.marked(*t) for t in turns]
    assert chat.parsed("".join(p[0] for p in pieces)) == turns
    for (role, said), (text, begin, end) in zip(turns, pieces, strict=True):
        assert chat.unescape(text[begin:end]) == (said if role == "assistant" else "")
        assert "###" not in text[1:] and text.count("</turn>") == 1


def test_layouts(spark):
    records = [
        ('{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}', [("user", "a"), ("assistant", "b")]),
        ('{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": null}]}', [("user", "a"), ("assistant", "")]),
        ('{"completion": "b", "prompt": "a"}', [("user", "a"), ("assistant", "b")]),
        ('{"instruction": "a", "input": "", "output": "b"}', [("user", "a"), ("assistant", "b")]),
        ('{"instruction": "a", "input": "c", "output": "b"}', [("user", "a\n\nc"), ("assistant", "b")]),
        ('{"prompt": {"text": "a"}, "response": {"text": "b"}}', [("user", "a"), ("assistant", "b")]),
        ('{"system": "s", "messages": [{"role": "user", "content": "a"}]}', [("system", "s"), ("user", "a")]),
        ('{"else": 1}', []), ("[1]", []), ("not json", []), (None, []), ("{}", []), ('{"messages": []}', []),
    ]
    frame = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(records)], "conv_id long, record string")
    got = {}
    for r in chat.turns(frame).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {i: t for i, (_, t) in enumerate(records) if t}
    assert {r.conv_id for r in chat.unknown(frame).collect()} == {i for i, (_, t) in enumerate(records) if not t}
    assert chat.digests(chat.formatted(chat.turns(frame.limit(0)))).count() == 0


def test_digests_of_odd_turns(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (None, 0, None, None), (None, None, "assistant", "x"), (2, 0, "assistant", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r.conv_id: r for r in chat.digests(stored(chat.formatted(turns))).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == (3, sha("user\na\nassistant\nb\nassistant\nb\n"), 2, sha("bb"))
    assert got[None].turns_sha256 == sha("assistant\nx\n\n\n") and got[2].loss_sha256 == sha("")


# 7. Quality rules


def plain_base(text):
    words = space_words(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    repeated = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    lines, seen, again = (text or "").split("\n"), set(), 0
    for line in lines:
        if space_words(line):
            again += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return len(words), sum(map(len, words)), symbols, again, len(repeated), failed


def test_quality_rules(spark, none):
    texts = [*odd_texts(), "a b c d e a b c d e f", "a\r\na\r\na", "x y\nx y \nx y"]
    docs = documents(spark, texts)
    rows = divergence.judge(docs, divergence.references(docs)).collect()
    for r in rows:
        assert tuple(r)[1:7] == plain_base(texts[r.doc_id // 3])
        assert (r.char_distance is None) == (r.n_words < divergence.CHAR_WORDS)
        assert (r.word_distance is None) == (r.n_words < divergence.WORD_WORDS)
        assert not (r.kept and r.base_failed)
    assert len(rows) == len(texts)
    assert divergence.judge(none, divergence.references(none)).count() == 0
    assert divergence.judge(docs, divergence.references(none)).count() == len(texts)
    again = with_odd_ids(spark)
    assert divergence.judge(again, divergence.references(again)).count() == len(odd_texts()) + 8


def test_distance_and_references(spark):
    assert divergence.distance(np.array([1.0, 0]), np.array([0, 1.0])) == 1 and divergence.distance(np.array([0.3, 0.7]), np.array([0.3, 0.7])) == 0
    texts = ["aa bb aa A1", "bb cc", None, "dd"]
    of_classes, of_words = divergence.references(documents(spark, texts))
    assert set(of_words) == {"en", "de", ()}  # the null language has no words
    assert of_classes["en"][0] == 4 / 13 and of_classes["en"][28] == 3 / 13
    assert sorted(of_words["en"][1][:-1].tolist()) == [0.2, 0.2, 0.2, 0.4] and of_words["en"][1][-1] == 0


def test_rare_languages_have_their_own_reference(spark, monkeypatch):
    """Clean documents of a language stay, whatever its share of all words."""
    chance = random.Random(9)
    russian = [" ".join(chance.choice("и в не на что он как это по но из у за от до мы вы они".split()) for _ in range(120)) for _ in range(30)]
    tiny = ["κ" * 3 + " " + " ".join(chance.choice("και το να του η της με".split()) for _ in range(60))]
    # Words spread evenly over letters, far from the language.
    odd = " ".join(f"{i:05d}" for i in range(100))
    texts = [*russian, *tiny, odd, *(" ".join(sentence(chance, 200, 90)) for _ in range(100))]
    docs = documents(spark, texts).withColumn("lang", F.expr("case when doc_id < 90 or doc_id = 93 then 'ru' when doc_id = 90 then 'el' else 'en' end"))
    whole = {tuple(r) for r in divergence.judge(docs, divergence.references(docs)).collect()}
    monkeypatch.setattr(divergence, "RARE", 0.5)
    reference = divergence.references(docs)
    assert set(reference[1]) == {"en", ()} and reference.rest.count() == 2
    rows = {r.doc_id: r for r in divergence.judge(docs, reference).collect()}
    assert all(rows[3 * i].kept == (not rows[3 * i].base_failed) for i in range(len(russian)))
    assert rows[90].char_distance is not None and rows[90].kept == (not rows[90].base_failed)
    assert rows[93].char_distance > divergence.CHAR_DISTANCE and not rows[93].kept and not rows[93].base_failed
    as_told = lambda r: (*r[:7], round(r[7], 9), round(r[8], 9), r[9])
    assert {as_told(tuple(r)) for r in rows.values()} == {as_told(r) for r in whole}


def test_texts_without_common_words_go(spark):
    chance = random.Random(10)
    common = [f"c{i}" for i in range(100)]
    def text(n, share):
        return " ".join(chance.choice(common) if chance.random() < share else f"r{chance.randrange(20_000)}" for _ in range(n))
    clean = [text(chance.choice([150, 170, 300, 700]), 0.4) for _ in range(240)]
    without = [text(150, 0), text(300, 0), text(700, 0), text(3000, 0)]  # the last one is longer than any clean text
    docs = documents(spark, [*clean, *without]).withColumn("lang", F.lit("en"))
    rows = sorted(divergence.judge(docs, divergence.references(docs)).collect(), key=lambda r: r.doc_id)
    assert all(r.kept for r in rows[: len(clean)])
    assert all(not r.base_failed and r.char_distance <= divergence.CHAR_DISTANCE for r in rows[len(clean) :])
    assert all(r.word_distance < divergence.WORD_DISTANCE and not r.kept for r in rows[len(clean) :])


def test_bpe_merges_short_words_as_long_ones(vocabulary, monkeypatch):
    chance = random.Random(12)
    tokens = list(vocabulary.id)
    made = [b"".join(chance.choices(tokens, k=chance.randint(1, 5)))[: bpe.SHORT] for _ in range(3000)]
    made += [b"", b"\xff\xfe", *(b"ab"[:n % 3] * n for n in range(1, 25))]
    short = [vocabulary.merged(w) for w in made]
    monkeypatch.setattr(bpe, "SHORT", -1)
    assert short == [vocabulary.merged(w) for w in made]


# 10. Licence scans


def test_licenses(spark, none):
    mit = licenses.KNOWN["MIT"][0]
    texts = [
        *odd_texts(), mit, "Copyright (c) 2020 Some One\n\n" + mit.upper(), "The MIT Licence\n\n/* copyright 2020 x */".replace("/* copyright 2020 x */", "") + licenses.KNOWN["MIT"][3],
        "# " + mit.replace("\n", "\n# "), mit + " more", "  Released under the MIT Licence!", licenses.KNOWN["Zlib"][1].replace("acknowledgment", "acknowledgement"),
    ]
    got = {r.doc_id // 3: r for r in licenses.scan(documents(spark, texts)).collect()}
    n = len(odd_texts())
    assert [got[i].license for i in range(n, n + 7)] == ["MIT", "MIT", "MIT", "MIT", None, "notice:MIT", "Zlib"]
    assert all(got[i].license is None for i in range(n)) and got[0].digest is None and got[1].digest is not None
    assert licenses.scan(none).count() == 0 and licenses.scan(with_odd_ids(spark)).count() == n + 8
    assert licenses.scan(documents(spark, [mit]), {}).first().license is None
    assert all(licenses.known(spark).where(f"license = '{k}'").count() == len(set(v)) for k, v in licenses.KNOWN.items())


def test_license_plan_is_native(spark):
    plan = licenses.scan(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


# 2. Quality classifier


def plain_kneser_ney(counts, order, code):
    """Probability of a code's last symbol by the textbook recursion."""
    size = perplexity.ALPHABET
    levels = {perplexity.ORDER: counts}
    for n in range(perplexity.ORDER - 1, 0, -1):
        levels[n] = Counter(c % size**n for c in levels[n + 1])
    def p(n, c):
        if n == 0:
            return 1 / size
        level = levels[n]
        freq = Counter(min(v, 4) for v in level.values())
        n1, n2, n3, n4 = (freq[i] for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        cut = [min(max(i - (i + 1) * y * b / a, 0.05), i - 0.05) if a else i / 2 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        cut = lambda v, cut=cut: cut[min(v, 3) - 1]
        same = {k: v for k, v in level.items() if k // size == c // size}
        lower = p(n - 1, c % size ** (n - 1))
        if not same:
            return lower
        total = sum(same.values())
        own = same.get(c, 0)
        return (own - cut(own) if own else 0) / total + sum(map(cut, same.values())) / total * lower
    return p(order, code)


def test_kneser_ney(spark):
    chance = random.Random(6)
    words = ["the cat", "a dog. ", "it ran", "\nBy 12"]
    codes = Counter()
    text = " ".join(chance.choice(words) for _ in range(200))

    code, _ = perplexity._grams(pa.record_batch({"text": pa.array([text])}))
    codes.update(code.tolist())
    model = perplexity._smoothed(spark.createDataFrame(list(codes.items()), "code long, n long"))
    table = perplexity.table(model)
    for c in [*list(codes)[:40], 0, 5, 64**4 - 1, *(chance.randrange(64**4) for _ in range(10))]:
        assert 10 ** table[c] == pytest.approx(plain_kneser_ney(codes, perplexity.ORDER, c), rel=1e-4)
    for context in list(codes)[:5]:
        assert (10.0 ** table[context // 64 * 64 : context // 64 * 64 + 64]).sum() == pytest.approx(1, abs=1e-5)


def test_every_byte_is_a_symbol():
    """Characters that differ only in the first byte are told apart."""
    one, other = (perplexity._grams(pa.record_batch({"text": pa.array(["a " + c, None, "b"])})) for c in "\u00e9\u0129")
    assert one[1].tolist() == other[1].tolist() == [0, 0, 0, 0, 2]
    assert one[0][2:4].tolist() != other[0][2:4].tolist()


def test_longer_n_grams_are_joined(spark, monkeypatch):
    """Perplexities are those of a plain model of LONGEST symbols, whatever part of it tasks hold."""
    chance = random.Random(13)
    words = ["the cat", "a dog. ", "it ran", "\nBy 12", "\u00e9t\u00e9", "\u0434\u0430"]
    learned = [" ".join(chance.choice(words) for _ in range(25)) for _ in range(8)]
    counts = Counter(perplexity._grams(pa.record_batch({"text": pa.array(learned)}), perplexity.LONGEST)[0].tolist())
    scored = [learned[0], "the dog ran by the cat", "\u0434\u0436 xyz", "t", "", None, learned[0]]
    with monkeypatch.context() as longest:
        longest.setattr(perplexity, "ORDER", perplexity.LONGEST)
        plain = lambda c, known={}: known.setdefault(c, math.log10(plain_kneser_ney(counts, perplexity.LONGEST, c)))  # noqa: B006, E731
        codes = [perplexity._grams(pa.record_batch({"text": pa.array([t], pa.string())}), perplexity.LONGEST)[0].tolist() for t in scored]
        want = {3 * i: -sum(map(plain, c)) / len(c) if c else None for i, c in enumerate(codes)}
    assert perplexity.LONGEST > perplexity.ORDER
    table = spark.createDataFrame(list(counts.items()), "code long, n long")
    for share in (perplexity.TASK_SHARE, 0.01, 1.0):
        monkeypatch.setattr(perplexity, "TASK_SHARE", share)
        model = perplexity._extended(table)
        assert len(model["key"]) if model["rest"] is None else model["rest"].count()
        got = {r.doc_id: r.log_perplexity for r in perplexity.score(documents(spark, scored), model).collect()}
        assert {i: pytest.approx(p, rel=1e-5) for i, p in got.items() if p is not None} == {i: p for i, p in want.items() if p is not None}
        assert got[12] is None and got[15] is None and len(got) == len(scored)


def test_trusted_texts_that_were_learned_from_stay(spark):
    """A small model knows the texts it has seen too well; they are no worse for that."""
    chance = random.Random(14)
    texts = ["".join(chance.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300)) for _ in range(300)]
    docs = documents(spark, texts).withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(3 * i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    assert sum(r.kept for r in perplexity.classify(docs, labels).collect()) >= 295


def test_classifier_of_odd_documents(spark, none):
    docs = with_odd_ids(spark)
    labels = spark.createDataFrame([(3 * i, 1, 0) for i in range(20)] + [(3, 0, 1), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    got = perplexity.classify(docs, labels).collect()
    assert len(got) == len(odd_texts()) + 8
    assert all(r.kept for r in got if r.n_symbols < perplexity.MIN_SYMBOLS)
    assert perplexity.classify(none, labels).count() == 0
    assert perplexity.classify(docs, labels.limit(0)).where("not kept").count() == 0


def test_languages_without_trusted_texts_have_limits_of_their_own(spark):
    """Clean texts of a language that the model hasn't seen stay."""
    chance = random.Random(11)
    english = [" ".join(chance.choice("the cat ran and a dog saw it by the door".split()) for _ in range(60)) for _ in range(400)]
    russian = [" ".join(chance.choice("и в не на что он как это по но из у за".split()) for _ in range(60)) for _ in range(40)]
    bad = "#$%&* 0x99 ZZQ! " * 20
    docs = documents(spark, [*english, *russian, bad]).withColumn("lang", F.expr("case when doc_id >= 1200 and doc_id < 1320 then 'ru' else 'en' end"))
    labels = spark.createDataFrame([(3 * i, 1, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in perplexity.classify(docs, labels).collect()}
    assert all(r.kept for r in rows.values() if r.lang == "ru")
    assert max(r.perplexity for r in rows.values() if r.lang == "ru") > rows[0].high > rows[0].low
    assert not rows[1320].kept and sum(r.kept for r in rows.values()) >= 435


# 3. LM scoring


def plain_tree(texts, longest=16):
    """The probability of a word after others, and the retained states, by definition: every
    context is looked at, up to this many words with the next, whose suffixes are all rarer than their own."""
    grams = Counter(tuple(ws[i:j]) for ws in texts for i in range(len(ws)) for j in range(i + 1, min(len(ws), i + longest) + 1))
    n = sum(map(len, texts))
    types = sum(len(g) == 1 for g in grams)
    after = {}
    for gram, times in grams.items():
        if len(gram) > 1 and times >= suffixtree.LEAST_COUNT:
            after.setdefault(gram[:-1], {})[gram[-1]] = times
    states = {}

    def chance(context, word):
        context = tuple(context)
        while context and context not in states:
            context = context[1:]
        if not context:
            return (grams[(word,)] + 1) / (n + types + 1)
        listed, back = states[context]
        return listed[word] if word in listed else chance(context[1:], word) * back

    looked = {()}
    for context in sorted(after, key=len):
        whole = grams[context]
        suffix = context[1:]
        if suffix not in looked or (suffix and grams[suffix] == (grams[suffix[1:]] if suffix[1:] else n)):
            continue
        looked.add(context)
        own = {w: (times - suffixtree.DISCOUNT) / whole for w, times in after[context].items()}
        before = {w: chance(context[1:], w) for w in own}
        listed = {w: p for w, p in own.items() if math.log10(p) - math.log10(before[w]) >= math.log10(suffixtree.RATIO)}
        back = max(1 - sum(listed.values()), 1e-9) / max(1 - sum(before[w] for w in listed), 1e-9)
        inside = sum(after[context][w] for w in listed)
        gain = sum(after[context][w] * math.log(p / before[w]) for w, p in listed.items()) + (whole - inside) * math.log(back)
        if gain >= suffixtree.DIVERGENCE:
            states[context] = listed, back
    return chance, states


def test_suffix_tree(spark, none):
    chance = random.Random(7)
    passage = " ".join(sentence(chance, 40, 10**6))
    # What follows "mid" depends on the word before it.
    pairs = [" ".join(chance.choice(["ka mid ra", "ko mid ro", "ke mid re"]) for _ in range(8)) for _ in range(60)]
    texts = [*odd_texts(), *(" ".join([*sentence(chance, 30, 50), passage, p]) for p in pairs)]
    docs = documents(spark, texts)
    counts = suffixtree.vocabulary(docs)
    tree = suffixtree.fit(docs, counts)
    tokens = {3 * i: [*space_words(lower(t or "")), None] for i, t in enumerate(texts)}
    out = {i for i in tokens if zlib.crc32(str(i).encode()) % 7 == 2}
    seen = Counter(w for i, ws in tokens.items() if i not in out for w in ws)
    n, v = sum(seen.values()), len(seen)
    assert (tree.tokens, tree.types) == (n, v) and tree.longest <= 16
    rows = suffixtree.score(docs, tree, counts).collect()
    for r in rows:
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id in out, len(ws), sum(seen[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in ws))
    held = [r for r in rows if r.held_out and r.doc_id >= 3 * len(odd_texts())]
    assert held and all(r.score > r.base_score + 50 for r in held)
    chances, states = plain_tree([ws for i, ws in tokens.items() if i not in out])
    assert {len(c) for c in states} >= {1, 2}
    for r in rows:
        ws = tokens[r.doc_id]
        assert r.score == pytest.approx(sum(math.log10(chances(ws[max(0, i - 16) : i], w)) for i, w in enumerate(ws)))
    # Each state's distribution over all tokens, the unseen ones included, sums to one.
    for state in [*states][::7]:
        unseen = chances(state, "unseen") / chances((), "unseen") * (1 - sum(chances((), w) for w in seen))
        assert sum(chances(state, w) for w in seen) + unseen == pytest.approx(1)
    empty = suffixtree.vocabulary(none)
    assert suffixtree.score(none, suffixtree.fit(none, empty), empty).count() == 0
    assert all(r.score == 0 == r.base_score for r in suffixtree.score(docs, suffixtree.fit(none, empty), empty).collect())
    again = with_odd_ids(spark)
    counts = suffixtree.vocabulary(again)
    assert suffixtree.score(again, suffixtree.fit(again, counts), counts).count() == len(odd_texts()) + 8


def test_longer_contexts_are_found_beyond_a_level_without_states(spark):
    """What follows "a b" and "b" alike depends on the word before: only three words tell."""
    chance = random.Random(9)
    runs = [f"{x} {y} mid {'one' if (x == 'p') == (y == 'q') else 'two'}" for x in "pr" for y in "qs"]
    texts = [" ".join(chance.choice(runs) for _ in range(12)) for _ in range(60)]
    docs = documents(spark, texts)
    counts = suffixtree.vocabulary(docs)
    ids = {r.doc_id: r.text for r in docs.collect()}
    learned = [[*ids[i].split(), None] for i in ids if zlib.crc32(str(i).encode()) % 7 != 2]
    chances, states = plain_tree(learned)
    assert ("p", "q", "mid") in states and not any(len(c) == 2 for c in states)
    for r in suffixtree.score(docs, suffixtree.fit(docs, counts), counts).collect():
        ws = [*ids[r.doc_id].split(), None]
        assert r.score == pytest.approx(sum(math.log10(chances(ws[max(0, i - 16) : i], w)) for i, w in enumerate(ws)))


def test_suffix_tree_does_not_depend_on_what_tasks_hold(spark, monkeypatch):
    """States and n-grams of any share of the corpus count, and contexts of any length."""
    chance = random.Random(8)
    # What follows "mid", "of the" or "by and to" depends on the word before it.
    runs = [f"k{i} {mid} r{i}" for mid in ("mid", "of the", "by and to") for i in range(3)]
    texts = [" ".join([*sentence(chance, 60, 3000), *(chance.choice(runs) for _ in range(15))]) for _ in range(80)]
    docs = documents(spark, texts)
    counts = suffixtree.vocabulary(docs)
    tree = suffixtree.fit(docs, counts)
    assert tree.rest is None and tree.longest >= 5
    want = {r.doc_id: r.score for r in suffixtree.score(docs, tree, counts).collect()}
    for share in (0.003, 0.03, 1.0):  # some, few and no n-grams in the task
        monkeypatch.setattr(suffixtree, "TASK_SHARE", share)
        other = suffixtree.fit(docs, counts)
        assert len(other.word) < len(tree.word) and other.rest.count()
        got = suffixtree.score(docs, other, counts).collect()
        assert {r.doc_id: pytest.approx(r.score) for r in got} == want
    assert all(r.score > r.base_score + 20 for r in got)


def test_long_contexts_are_looked_for_in_few_passages(spark, monkeypatch):
    """Texts without an open context, and words beyond a rare pair, aren't read again; scores are those of the whole."""
    chance = random.Random(11)
    runs = [" ".join(f"{chance.choice('ab')} {' '.join(['x'] * chance.randint(1, 14))} y" for _ in range(6)) for _ in range(40)]
    texts = [f"{' '.join(sentence(chance, 30, 10**6))} {t} {' '.join(sentence(chance, 30, 10**6))}" for t in runs]
    docs = documents(spark, [*texts, *(" ".join(sentence(chance, 60, 10**6)) for _ in range(60)), "", None])
    counts = suffixtree.vocabulary(docs)
    want = {r.doc_id: r.score for r in suffixtree.score(docs, suffixtree.fit(docs, counts), counts).collect()}
    left = []
    narrowed = suffixtree._narrowed
    monkeypatch.setattr(suffixtree, "_narrowed", lambda *given: left.append(narrowed(*given)) or left[-1])
    monkeypatch.setattr(suffixtree, "AT_ONCE", 1)
    monkeypatch.setattr(suffixtree, "NARROW", 1)
    got = suffixtree.score(docs, suffixtree.fit(docs, counts), counts).collect()
    assert {r.doc_id: pytest.approx(r.score) for r in got} == want
    tokens = [sum(len(r.tokens) // 8 for r in rows.collect()) for rows in left]
    whole = counts.agg(F.sum("n")).first()[0]
    assert len(tokens) > 1 and tokens[-1] <= tokens[0] < whole / 2


def test_long_contexts_are_worked_out_several_lengths_at_once(spark, monkeypatch):
    """Runs of one word end after few or many: each length of context tells something."""
    chance = random.Random(10)
    texts = [" ".join(f"{chance.choice('ab')} {' '.join(['x'] * chance.randint(1, 18))} y" for _ in range(10)) for _ in range(60)]
    docs = documents(spark, texts)
    counts = suffixtree.vocabulary(docs)
    ids = {r.doc_id: r.text for r in docs.collect()}
    chances, states = plain_tree([[*ids[i].split(), None] for i in ids if zlib.crc32(str(i).encode()) % 7 != 2], 24)
    assert max(map(len, states)) > 8
    want = {i: sum(math.log10(chances(([*t.split(), None])[max(0, j - 24) : j], w)) for j, w in enumerate([*t.split(), None])) for i, t in ids.items()}
    levels = []
    joined = suffixtree._smoothed
    monkeypatch.setattr(suffixtree, "_smoothed", lambda *tables: levels.append(1) or joined(*tables))
    for rooted in (suffixtree.ROOTED, 1):  # together, and where a root has too many n-grams for that
        monkeypatch.setattr(suffixtree, "ROOTED", rooted)
        levels.clear()
        got = suffixtree.score(docs, suffixtree.fit(docs, counts), counts).collect()
        assert {r.doc_id: pytest.approx(r.score) for r in got} == want
        assert len(levels) <= 3 if rooted > 1 else len(levels) > 8


# 4. Toxicity


def plain_segments(scores):
    """Maximal scoring segments by definition: the best segment, then the same left and right of it."""
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 0 and (best is None or total > best[2] + 1e-12 or (abs(total - best[2]) <= 1e-12 and j - i < best[1] - best[0])):
                best = (i, j, total)
    if best is None:
        return []
    i, j, total = best
    return plain_segments(scores[:i]) + [best] + [(a + j + 1, b + j + 1, s) for a, b, s in plain_segments(scores[j + 1 :])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-3, 4).map(lambda x: round(x, 3) + 0.0001)), max_size=25))
def test_segments(weights):
    other = -0.317
    scores = [other if w is None else w for w in weights]
    at = np.array([i for i, w in enumerate(weights) if w is not None], np.int64)
    got = toxicity.maximal_segments(at, np.array([w for w in weights if w is not None], float), other)
    want = plain_segments(scores)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert [s for *_, s in got] == pytest.approx([s for *_, s in want])


def test_toxicity(spark, none):
    chance = random.Random(8)
    texts, toxic = [], []
    for i in range(300):
        words = sentence(chance, 60, 400)
        if i % 4 == 0:
            for _ in range(4):
                words[chance.randrange(20, 40)] = chance.choice(["vile", "Rot", "scum"])
        texts.append(" ".join(words))
        toxic.append(int(i % 4 == 0))
    docs = documents(spark, texts, list(range(300)))
    labels = spark.createDataFrame(list(zip(range(300), [1] * 300, toxic, strict=True)), "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).withColumn("held_out", toxicity.held_out(5)).collect()}
    assert all((got[i].score >= 0.5) == bool(toxic[i]) for i in range(300) if got[i].held_out)
    assert {r.doc_id for r in toxicity.passages(docs, model).collect()} == {i for i in range(300) if toxic[i]}
    one = toxicity.passages(docs.where("doc_id = 0"), model).first()
    assert one.passage == " ".join(texts[0].split()[one.first_word : one.last_word + 1])
    odd = with_odd_ids(spark)
    assert toxicity.score(odd, model).where("score between 0 and 1").count() == len(odd_texts()) + 8
    assert toxicity.score(none, model).count() == 0
    unlabelled = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, unlabelled).where("score > 0.001").count() == 0
    flipped = labels.withColumn("toxic", F.lit(1))
    assert toxicity.score(docs, toxicity.fit(docs, flipped)).where("score < 0.5").count() == 0


def test_texts_that_share_a_passage_are_all_learned_from(spark):
    """A word of many toxic texts counts in each, though they have a long passage in common; copies share one weight."""
    chance = random.Random(15)
    passage = " ".join(sentence(chance, 30, 10**6))

    def least(text):
        t = toxicity.texts(pa.array([text]))
        w = toxicity.words(t, toxicity.ALNUM)
        return toxicity.windows(toxicity.hashes(t.data, w, fold=True), w.owner, 5)[0].min()

    # The least hash of each of these texts is one of the passage.
    toxic = [t for t in (f"{passage} scum {' '.join(sentence(chance, 100, 10**6))}" for _ in range(6000)) if least(t) == least(passage)][:60]
    assert len(toxic) == 60
    clean = [" ".join(sentence(chance, 60, 10**6)) for _ in range(200)]
    labels = spark.createDataFrame([(3 * i, 1, int(i < 60)) for i in range(260)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(documents(spark, toxic + clean), labels)
    t = toxicity.texts(pa.array(["scum"]))
    assert toxicity.hashes(t.data, toxicity.words(t, toxicity.ALNUM), fold=True)[0] in model.key
    copies = [clean[0], clean[0], clean[0] + " .", clean[0] + " !", clean[1], "", None]
    train = spark.createDataFrame([(t, 0) for t in [*copies, *toxic]], "text string, toxic int")
    weights = {r.text: r.weight for r in toxicity._weighted(train).collect()}
    assert len(weights) == len({*copies, *toxic}) and weights[clean[1]] == toxicity.WHOLE
    assert all(weights[t] == toxicity.WHOLE // 3 for t in copies[1:4])
    assert sum(weights[t] for t in toxic) > 40 * toxicity.WHOLE


def last_by_hash(spark, n):
    """The rows of 0 to n - 1 outside the held-out fold, least hash of the id first."""
    ids = spark.range(n).withColumnRenamed("id", "doc_id").where(~toxicity.held_out(5))
    return [r.doc_id for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]


def test_fits_learn_from_every_labelled_text(spark):
    """What only the last texts in the order of their hashes hold is learned too, beyond 50,000 texts."""
    ids = last_by_hash(spark, 64_000)
    assert len(ids) > 50_500
    late = F.col("doc_id").isin(ids[-300:])
    own = F.translate(F.col("doc_id").cast("string"), "0123456789", "abcdefghij")
    words = [F.concat(own, F.lit(c)) for c in "klmnop"]
    docs = spark.range(64_000).withColumnRenamed("id", "doc_id").select(
        "doc_id", F.concat_ws(" ", F.when(late, "vile 7 scum rot").otherwise("a fine day"), *words).alias("text"), F.lit("en").alias("lang")
    )
    labels = docs.select("doc_id", F.lit(1).alias("quality"), late.cast("int").alias("toxic"))
    digit = int(perplexity._SYMBOL[ord("7")])
    assert digit in perplexity.fit(docs, labels)["code1"]
    model = toxicity.fit(docs, labels)
    scores = {r.doc_id: r.score for r in toxicity.score(docs.where(F.col("doc_id").isin(ids[0], ids[-1])), model).collect()}
    assert len(model.key) and scores[ids[-1]] > scores[ids[0]]
