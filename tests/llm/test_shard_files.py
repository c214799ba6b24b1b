"""Shards as files, with clashing columns, repeated and missing ids."""

from jobloom.llm import sharding


def test_shards_hold_every_row_once(spark, tmp_path):
    rows = [(None if i % 5 == 0 else i % 7, f"text {i}", f"s{i % 2}", i, i, "r", "k") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int, slot int, row string, key string").repartition(3)
    name = sharding.write_shards(docs, f"{tmp_path}/out")
    read = spark.read.parquet(f"{tmp_path}/out")
    assert name not in docs.columns and set(read.columns) == {*docs.columns, name}
    assert sorted(r["text"] for r in read.collect()) == sorted(r[1] for r in rows)
    assert {r["count"] for r in read.groupBy(name).count().collect()} == {10}
    assert sharding.write_shards(docs.drop("shard").limit(0), f"{tmp_path}/none") == "shard"
