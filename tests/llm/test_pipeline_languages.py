"""The first stage's languages reach the last: a sequence holds texts of one predicted language."""

from collections import defaultdict

from pyspark.sql import functions as F


def test_sequences_hold_one_predicted_language(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("lang", F.when(F.col("doc_id") % 7 != 0, F.col("lang")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language(spark, docs, str(tmp_path)).collect()}
    assert None not in lang.values() and len(set(lang.values())) > 1
    held, pieces = defaultdict(set), 0
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        held[r["sequence_id"]].add(lang[r["doc_id"]])
        pieces += 1
    assert all(len(x) == 1 for x in held.values()) and len(held) < pieces
    assert {x for own in held.values() for x in own} == set(lang.values())


def test_groups_are_packed_apart_and_null_is_one(spark):
    from jobloom.llm import packing
    from jobloom.llm.queries import BYTE_VOCABULARY, vocabulary_path

    rows = [(i, "word " * (i % 5), (None, "", "a")[i % 3]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    group, held = {r[0]: r[2] for r in rows}, defaultdict(set)
    got = packing.pack(docs, vocabulary_path(BYTE_VOCABULARY), group_col="lang").collect()
    for r in got:
        held[r["sequence_id"]].add(group[r["doc_id"]])
    assert len(got) == 60 and sorted(map(str, held.values())) == sorted(map(str, ({None}, {""}, {"a"})))
