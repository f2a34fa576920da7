"""Settings of tables that are written on the way."""

import pyarrow as pa

from plotweave.plans.durable import Scratch

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["size", "n"])


def largest(spark, name):
    texts = spark.range(0, 8000, 1, 1).selectExpr("repeat('word ', 400) AS text")
    got = Scratch(spark, "test").write(texts.mapInArrow(sizes, "size long, n long"), name)
    rows = got.collect()
    assert sum(r["n"] for r in rows) == 8000
    return max(r["size"] for r in rows)


def test_tables_send_small_batches_to_python(spark):
    assert spark.conf.get(BATCH, None) is None
    assert largest(spark, "small") < 6_000_000  # 16 MB as one batch
    assert spark.conf.get(BATCH, None) is None
    spark.conf.set(BATCH, "1m")
    try:
        assert largest(spark, "own") < 1_500_000
        assert spark.conf.get(BATCH) == "1m"
    finally:
        spark.conf.unset(BATCH)


def test_texts_stay_where_they_are_while_few_rows_go(spark, monkeypatch):
    from plotweave.llm import exact_dedup

    rows = [(i % 40 if i % 9 else None, f"Text {i % 25}".upper() if i % 2 else f"text {i % 25}", i) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # sizes at which Spark itself broadcasts nothing
    try:
        few = exact_dedup.keep_exact(docs)
        assert "SortMergeJoin" not in few._jdf.queryExecution().executedPlan().toString()
        got = sorted((str(r["doc_id"]), r["text"].lower()) for r in few.collect())
        monkeypatch.setattr(exact_dedup, "BROADCAST", 0)
        many = exact_dedup.keep_exact(docs)
        assert "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString()
        assert got == sorted((str(r["doc_id"]), r["text"].lower()) for r in many.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    best = {}
    for i, t, _ in rows:
        best[t.lower()] = max(best.get(t.lower(), -1), -1 if i is None else i)
    assert got == sorted((str(i), t) for t, i in best.items())
