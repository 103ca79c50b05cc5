"""Words, hashes and windows against plain Python."""

import pyarrow as pa
import pytest
from cases import item_words, lower, odd_texts, space_words
from hypothesis import given, settings
from hypothesis import strategies as st

from tradewind.llm import text as X


def found(texts, keep, fold):
    t = X.texts(pa.array(texts, pa.string()))
    w = X.words(t, keep)
    raw = t.data.tobytes()
    out = [[] for _ in texts]
    for a, b, o in zip(w.start, w.end, w.owner, strict=True):
        out[o].append(raw[a:b].decode())
    return out, X.hashes(t.data, w, fold).tolist(), w.owner.tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30), st.text(" aB.'é\n", max_size=30)), max_size=6))
def test_words(texts):
    assert found(texts, X.NOT_SPACE, False)[0] == [space_words(t) for t in texts]
    assert [[lower(w) for w in ws] for ws in found(texts, X.ALNUM, True)[0]] == [item_words(t) for t in texts]


def test_hashes_tell_words_apart_and_fold_ascii():
    words, hashed, _ = found(odd_texts()[:16], X.NOT_SPACE, True)
    by_word = {}
    for word, h in zip([w for ws in words for w in ws], hashed, strict=True):
        assert by_word.setdefault(lower(word), h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_windows_stay_inside_texts():
    _, h, owner = found(["a b c", "a b", "a b c d"], X.NOT_SPACE, False)
    import numpy as np

    value, first = X.windows(np.array(h, np.uint64), np.array(owner), 3)
    assert first.tolist() == [0, 5, 6] and value[0] == value[1] != value[2]


def test_slices_and_offsets():
    batch = pa.record_batch({"text": pa.array(["aa", None, "b" * 10, ""])}).slice(1)
    got = [p.column("text").to_pylist() for p in X.slices([batch, batch.slice(0, 0)], "text", 4)]
    assert [x for p in got for x in p] == [None, "b" * 10, ""] and len(got) > 1


def _structured(n, flip=False):
    """A Thue-Morse word of n letters: every polynomial hash modulo 2^64 meets its complement."""
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_spread_hashes_see_structured_words(n):
    one, other = _structured(n), _structured(n, True)
    t = X.texts(pa.array([f"{one} {other} {one} x{one[1:]}", "ab ba a b AB", "z" * 70 + " " + "z" * 71 + " " + "z" * 64]))
    w = X.words(t, X.NOT_SPACE)
    h = X.spread_hashes(t.data, w, fold=False).tolist()
    assert h[0] == h[2] and len({h[0], h[1], h[3], *h[4:]}) == len(h) - 1
    folded = X.spread_hashes(t.data, w, fold=True).tolist()
    assert folded[4] == folded[8] and len(set(folded)) == len(folded) - 2


def test_structured_words_are_encoded_as_the_library_has_it():
    from tokenizers import Tokenizer

    from tradewind.llm import tokenfile
    from tradewind.llm.queries import WORD_BPE

    both = f"{_structured(1024)} {_structured(1024, True)}"
    with open(WORD_BPE, encoding="utf-8") as source:
        ids, _ = tokenfile.Encoder(source.read()).encode(pa.array([both]))
    assert ids[:-1].tolist() == Tokenizer.from_file(WORD_BPE).encode(both, add_special_tokens=False).ids


def test_structured_lines_are_no_copies(spark):
    from cases import documents

    from tradewind.llm import divergence
    from tradewind.llm.stored import ship

    ship(spark)
    docs = documents(spark, [f"{_structured(2048)}\n{_structured(2048, True)}\n{_structured(2048)}"])
    assert divergence.judge(docs, divergence.references(docs)).first()["n_dup_lines"] == 1
