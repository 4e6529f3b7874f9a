import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from claimloom.sources import store

SCHEMA = "id long, kind string, v long"


@pytest.fixture
def rows(spark):
    return lambda *ids: spark.createDataFrame([(i, "ab"[i % 2], i * i) for i in ids], SCHEMA)


def digests(folder):
    return {p: hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(Path(folder).rglob("*.parquet"))}


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_a_batch_counts_once_and_older_ones_stay(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    assert ids(store.read(spark, path, rows(1).schema)) == []
    assert store.append(rows(1, 2, 3), path, "2024/01 a", ["kind"])
    before = digests(path)
    assert store.append(rows(4, 5), path, "next", ["kind"])
    assert not store.append(rows(4, 5), path, "next", ["kind"]) and not store.append(rows(1, 2, 3), path, "2024/01 a", ["kind"])
    got = store.read(spark, path, rows(1).schema)
    assert ids(got) == [1, 2, 3, 4, 5] and before.items() <= digests(path).items()
    assert ids(got.filter("batch = '2024/01 a'")) == [1, 2, 3]
    with pytest.raises(ValueError):
        store.append(rows(1), path, "")


def test_a_lost_batch_is_passed_over_and_written_again(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    store.append(rows(1), path, "a", ["kind"])
    store.append(rows(2, 3), path, "b", ["kind"])
    (tmp_path / "t" / "batch=b" / "_SUCCESS").unlink()
    assert ids(store.read(spark, path, rows(1).schema)) == [1]
    assert store.append(rows(2, 4), path, "b", ["kind"])
    assert ids(store.read(spark, path, rows(1).schema)) == [1, 2, 4]


def test_empty_batches_and_nulls(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    assert store.append(rows(1).limit(0), path, "none", ["kind"]) and not store.append(rows(1), path, "none", ["kind"])
    assert ids(store.read(spark, path, rows(1).schema)) == []
    store.append(spark.createDataFrame([(7, None, None), (7, None, None)], SCHEMA), path, "nulls", ["kind"])
    assert [tuple(r) for r in store.read(spark, path, rows(1).schema).select("id", "kind", "v").collect()] == [(7, None, None)] * 2


def test_reads_are_pruned(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    for name in "abc":
        store.append(rows(1, 2, 3, 4), path, name, ["kind"])
    part = store.read(spark, path, rows(1).schema).filter((F.col("batch") == "b") & (F.col("kind") == "a"))
    assert len(part.select(F.input_file_name().alias("f")).distinct().collect()) <= 4 and ids(part) == [2, 4]
    plan = part._jdf.queryExecution().executedPlan().toString()
    told = next(x for x in plan.split("PartitionFilters: ")[1:])
    assert "batch" in told.split("]")[0] and "kind" in told.split("PushedFilters")[0]


def test_partitions_are_replaced_one_by_one(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    store.replace(rows(1, 2, 3, 4), path, ["kind"])
    before = {p: d for p, d in digests(path).items() if "kind=a" in str(p)}
    table = spark.read.schema(rows(1).schema).parquet(path)
    odd = table.filter("kind = 'b'").withColumn("v", F.col("v") + 100)
    store.replace(odd, path, ["kind"])
    got = {r["id"]: r["v"] for r in spark.read.schema(rows(1).schema).parquet(path).collect()}
    assert got == {1: 101, 2: 4, 3: 109, 4: 16} and before.items() <= digests(path).items()


def test_parts(spark):
    got = spark.range(1000).select(store.part_of("id", 8).alias("p")).groupBy("p").count().collect()
    assert {r["p"] for r in got} == set(range(8))
