"""The stages one by one against brute force, and as a whole."""

import random

import corpus_pipeline
from clickloom.llm import mixing, toxicity
from clickloom.llm.common import saved, table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_only_remove(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, docs, SF)
        assert kept.columns == columns and kept.join(docs, columns, "left_anti").count() == 0, name
        assert 0 < kept.count() <= docs.count()
        docs = kept.persist()
    mixed = corpus_pipeline.mix(spark, docs, SF)
    assert mixed.columns == columns
    words = mixed.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    whole = docs.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert abs(words / whole - 1.5) < 0.2


def test_toxic_documents_go(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.fitted(docs, labels)
    scored = toxicity.score_toxicity(docs, model, "_s")
    expected = {r.doc_id for r in scored.where("_s < 0.7").select("doc_id").collect()}
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, sf).select("doc_id").collect()}
    assert kept == expected


def test_unlike_texts_go(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rng = random.Random(3)
    # A script that isn't learned, letter noise, and a long text of each.
    unlike = [
        (-i - 1, " ".join("".join(chr(rng.randrange(*letters)) for _ in range(rng.randint(2, 8))) for _ in range(n)), None, "a", n)
        for i, (letters, n) in enumerate((a, n) for a in ((0x430, 0x450), (0x3041, 0x3097), (97, 123)) for n in (10, 200, 20_000))
    ]
    mixed = docs.unionByName(spark.createDataFrame(unlike, "doc_id long, text string, lang string, source string, n_chars long"))
    kept = {r.doc_id for r in corpus_pipeline.drop_unknown_language(spark, mixed, "").select("doc_id").collect()}
    assert not {i for i in kept if i < 0}
    clean = {r.doc_id for r in docs.where("text rlike '[A-Za-z]' and lang is not null").select("doc_id").collect()}
    assert len(clean - kept) <= 0.002 * len(clean)


def test_stages_with_nulls_repeats_and_clashing_names(spark):
    docs = table(spark, SF, "documents").limit(150)
    extra = spark.createDataFrame([(None, None, None, None, None), (900001, None, "en", "a", 0), (900002, "", None, None, 0), (900002, "", None, None, 0)], docs.schema)
    docs = saved(docs.unionByName(extra).unionByName(docs.limit(3)), "clash")
    clashing = docs
    for name in ("_toxicity", "_Language", "_digest", "_turn", "_id", "_keep", "target", "source_size"):
        clashing = clashing.withColumn(name, F.lit("own"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, clashing, SF)
        assert kept.columns == clashing.columns, name
        plain = stage(spark, docs, SF)
        assert sorted(map(str, kept.select(*docs.columns).collect())) == sorted(map(str, plain.collect())), name
        assert {tuple(r) for r in kept.select(*clashing.columns[len(docs.columns) :]).distinct().collect()} == {("own",) * 8}, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_run(spark):
    pieces = corpus_pipeline.run(spark, SF)
    total = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n"), F.count(F.lit(1)), F.sum("n")).first()
    assert total[0] <= 2048 and total[1] <= total[2] / 2048 + 2
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_dedup", "mixing", "packing"] and corpus_pipeline.ORACLE_SQL is None
