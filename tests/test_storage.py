import pytest
from conftest import day, rows
from pyspark.sql import functions as F

from tradewind.sources import schemas, storage


def _skus(spark, *data):
    return spark.createDataFrame(list(data), schemas.SKUS)


def test_csv_roundtrip_with_declared_schema(spark, tmp_path):
    skus = _skus(spark, ("AUR-001", "Aurora", 19.99, 9.0), ("KES-001", "a, \"b\"", 20.0, 9.0))
    storage.write_csv(skus, f"{tmp_path}/skus")
    back = storage.read_table(spark, f"{tmp_path}/skus", schemas.SKUS)
    assert [f.dataType for f in back.schema] == [f.dataType for f in schemas.SKUS]
    assert rows(back) == rows(skus)


def test_malformed_csv_fails(spark, tmp_path):
    (tmp_path / "t.csv").write_text("sku_id,brand,base_price,unit_cost\nx,A,abc,1.0\n")
    with pytest.raises(Exception, match="FAILED_READ_FILE|MALFORMED_RECORD"):
        storage.read_table(spark, str(tmp_path / "t.csv"), schemas.SKUS).collect()


def test_loading_replaces_the_whole_table(spark, tmp_path):
    path = f"{tmp_path}/skus"
    storage.replace_table(_skus(spark, ("a", "A", 1.0, 0.5), ("b", "B", 1.0, 0.5)), path)
    storage.replace_table(_skus(spark, ("c", "C", 1.0, 0.5)), path)
    assert [r.sku_id for r in spark.read.parquet(path).collect()] == ["c"]


def test_runs_are_kept_and_one_run_is_replaced(spark, tmp_path):
    root = str(tmp_path)
    first, second = day("2026-09-20"), day("2026-09-21")
    storage.land_run(_skus(spark, ("a", "A", 1.0, 0.5)), root, "skus", first)
    storage.land_run(_skus(spark, ("b", "B", 1.0, 0.5)), root, "skus", second)
    storage.land_run(_skus(spark, ("c", "C", 1.0, 0.5)), root, "skus", second)
    assert [r.sku_id for r in storage.read_run(spark, root, "skus", schemas.SKUS, first).collect()] == ["a"]
    assert [r.sku_id for r in storage.read_run(spark, root, "skus", schemas.SKUS, second).collect()] == ["c"]
    storage.write_manifest(spark, root, second, {"end_date": second, "seed": 42})
    assert rows(storage.read_manifest(spark, root)) == [("end_date", "2026-09-21", second), ("seed", "42", second)]


def test_missing_manifest_is_a_clear_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="run the refresh first"):
        storage.read_manifest(spark, f"{tmp_path}/nothing")


def test_ddl_creates_the_declared_table(spark):
    declared = schemas.schema(order_id="STRING", returned="BOOL", n="INT64", x="FLOAT64", d="DATE")
    ddl = storage.create_table_ddl("default", "returns", declared)
    assert ddl.startswith("CREATE TABLE IF NOT EXISTS default.returns (")
    spark.sql(ddl)
    spark.sql(ddl)
    assert [f.dataType for f in spark.table("default.returns").schema] == [f.dataType for f in declared]


def test_declared_columns_and_name_clash(spark):
    frame = spark.createDataFrame([(1, True, "x")], "noise int, returned boolean, order_id string")
    declared = schemas.schema(order_id="STRING", returned="BOOL")
    assert storage.declared_columns(frame, declared).columns == ["order_id", "returned"]
    with pytest.raises(ValueError, match="orders"):
        storage.with_extra_tables({"orders": frame}, {"orders": frame})
    assert set(storage.with_extra_tables({"orders": frame}, {"returns": frame})) == {"orders", "returns"}


def test_reconciliation(spark):
    two, three = spark.range(2), spark.range(3)
    storage.verify_load({"a": two, "b": three}, {"a": two, "b": three})
    with pytest.raises(storage.LoadMismatch, match="b: expected 3, found 2"):
        storage.verify_load({"a": two, "b": three}, {"a": two, "b": two})
    got = storage.reconcile({"a": two}, {"b": two})
    assert rows(got) == [("a", 2, None, False), ("b", None, 2, False)]


def test_materialized_rows_are_a_table_in_the_shared_folder(spark):
    frame = spark.range(10).withColumn("x", F.rand())
    stored = storage.materialize(frame)
    assert rows(stored) == rows(stored)
    assert all(f.startswith(f"file:{spark.conf.get('spark.checkpoint.dir')}") or spark.conf.get("spark.checkpoint.dir") in f for f in stored.inputFiles())
