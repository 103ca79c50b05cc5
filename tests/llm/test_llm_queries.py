"""Registered queries against SQL or held-out labels, and the pipeline against a plain version."""

import struct
import sys
from pathlib import Path

import duckdb
import pytest
from cases import linked, shingles, with_odd_ids
from conftest import TABLES, rows
from test_operators import plain_report
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from tradewind.llm import oracle, perplexity, queries, toxicity  # noqa: E402

QUERIES, SQL = queries.registered(), oracle.statements()
NAMES = ("documents", "benchmark", "labels", "conversations", "pages")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in NAMES:
        connection.execute(f"create view {name} as select * from '{TABLES}/{name}.parquet'")
    return connection


def test_every_query_and_the_pipeline():
    import __spark_entry__ as driver

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(driver.queries()) and set(SQL) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, duck, name):
    want = duck.execute(SQL[name])
    columns = sorted(c[0] for c in want.description)
    places = [[c[0] for c in want.description].index(c) for c in columns]
    expected = sorted((tuple(r[i] for i in places) for r in want.fetchall()), key=lambda r: tuple(map(str, r)))
    assert rows(QUERIES[name](spark, TABLES).select(*columns)) == expected


def test_held_out_labels(spark):
    """Accuracy on labels that nothing was learned from."""
    larger = TABLES.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    scored = [r for r in QUERIES["op4_toxicity"](spark, larger).collect() if r.held_out and r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id].toxic for r in scored)
    assert right >= 0.93 * len(scored)
    judged = [r for r in QUERIES["op2_quality_classifier"](spark, larger).collect() if r.doc_id in labels]
    good = [r.kept for r in judged if labels[r.doc_id].quality == 1]
    bad = [r.kept for r in judged if labels[r.doc_id].quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.3 * len(bad)


def test_pipeline(spark):
    """Stage by stage: what each rejects, worked out plainly where the stage has a plain version."""
    tables = {n: spark.read.parquet(f"{TABLES}/{n}.parquet") for n in NAMES}
    docs = tables["documents"]
    toxic = {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, tables["labels"])).where("score >= 0.5").collect()}
    left = docs.where(~docs.doc_id.isin(toxic)) if toxic else docs
    bad = {r.doc_id for r in perplexity.classify(left, tables["labels"]).where("not kept").collect()}
    texts = {r.doc_id: r.text for r in left.collect() if r.doc_id not in bad}
    least = linked({i: shingles(t) for i, t in texts.items()})
    items = [tuple(r) for r in tables["benchmark"].select("item_id", "text").collect()]
    kept = {i: t for i, t in texts.items() if least[i] == i and not plain_report(t, items)[4]}
    assert 0 < len(kept) < len(texts)
    library = Tokenizer.from_file(queries.BYTE_BPE)
    got = corpus_pipeline.run(spark, TABLES).collect()
    assert {r.doc_id: list(struct.unpack(f"<{r.n_tokens}I", r.ids)) for r in got} == {
        i: library.encode(t, add_special_tokens=False).ids for i, t in kept.items()
    }
    assert len(got) == len(kept)


def test_stages_take_odd_documents(spark):
    docs = with_odd_ids(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, TABLES)
        assert out.columns == corpus_pipeline.COLUMNS and 0 < out.count() <= docs.count()
        assert stage(spark, docs.limit(0), TABLES).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, TABLES).count() == docs.count()


def test_near_copies_without_ids_stay_once_per_text(spark):
    out = corpus_pipeline.drop_near_copies(spark, with_odd_ids(spark), TABLES)
    assert out.where("doc_id = 33").count() == 0  # a near copy of 30
    left = [(r.doc_id, r.text) for r in out.collect()]
    assert len(set(left)) == len(left)


def test_near_copies_judge_rows_of_one_id_by_their_texts(spark):
    prose = " ".join(f"word{i}" for i in range(80))
    other = " ".join(f"thing{i}" for i in range(80))
    rows_ = [(None, prose), (None, prose), (5, other), (5, other), (5, other + " end"), (5, "something else"), (6, None), (6, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", "web", 1, "x") for i, t in rows_], "doc_id long, text string, lang string, source string, n_chars long, own_id string")
    left = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, TABLES).collect()]
    assert sorted(left, key=str) == sorted([(None, prose), next(x for x in left if (x[1] or "").startswith("thing")), (5, "something else"), (6, None), (7, "")], key=str)
