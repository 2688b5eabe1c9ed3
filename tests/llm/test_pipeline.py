"""The pipeline on a small table, stage by stage."""

import random

import corpus_pipeline


def _documents(spark):
    random.seed(2)
    vocabulary = [f"w{i}" for i in range(2000)]
    rows = []
    for i in range(60):
        words = random.choices(vocabulary, k=random.randint(60, 120))
        rows.append((i, " ".join(words), "en", f"s{i % 3}"))
    rows.append((100, rows[5][1].upper(), "en", "s0"))
    rows.append((101, rows[6][1] + " token = abcdefghijklmnop", "en", "s0"))
    rows.append((102, "too short", "en", "s0"))
    rows.append((103, None, None, None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string") \
        .selectExpr("*", "cast(length(text) as bigint) AS n_chars")


def test_stages(spark, tmp_path):
    docs = _documents(spark)
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "near-dedup", "secret scan", "source mixing", "byte-pair encoding"]
    columns = docs.columns
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if number < 4:
            assert docs.columns == columns
        if number == 0:
            assert {102, 103}.isdisjoint(ids) and set(range(60)) <= ids
        elif number == 1:
            assert 100 not in ids and 101 not in ids and 5 in ids and 6 in ids
        elif number == 2:
            assert docs.filter("text LIKE '%token = abc%'").count() == 0
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_run_reads_documents(spark, tmp_path):
    _documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).filter("n_tokens > 0").count() > 0
