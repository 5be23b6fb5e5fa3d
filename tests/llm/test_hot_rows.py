"""Rows that repeat an id or everything, by the ten thousands: no task and no driver gets them all."""

from pyspark.sql import functions as F

from lodestrata.llm import packing, suffix, toxicity


def test_equal_rows_are_dealt_to_all_partitions(spark):
    import public_tokenizers

    docs = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
        rows = got.groupBy(F.shiftright("sequence_id", 40).alias("task")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in rows) == 30_000 and len(rows) == 4 and max(r["count"] for r in rows) < 9_000
    assert got.agg(F.count_distinct("sequence_id", "offset")).first()[0] == 30_000


def test_labels_of_ids_with_many_rows_give_a_bounded_sample(spark, monkeypatch):
    docs = spark.range(30_000).select((F.col("id") % 2).alias("doc_id"), F.when(F.col("id") % 2 == 1, "some vile words here").otherwise("some fine words here").alias("text"))
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int")
    sizes = []
    fitted = toxicity._fitted
    monkeypatch.setattr(toxicity, "_fitted", lambda found, *rest: (sizes.append({bool(r[0]): r[1] for r in found.groupBy(F.col("grade") > 0).count().collect()}), fitted(found, *rest))[1])
    model = toxicity.fit(docs, labels, per_class=100)
    assert sizes == [{False: 100, True: 100}]
    rejected = toxicity.score(docs.limit(2000), model).groupBy("doc_id").agg(F.max("rejected").alias("r")).collect()
    assert {r.doc_id: r.r for r in rejected} == {0: False, 1: True}


def test_columns_lie_outside_only_where_python_reaches_the_folder(spark):
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    try:
        conf.set("fs.defaultFS", "file:///")
        assert suffix.reachable(spark, "/ckpt/a") == "/ckpt/a" == suffix.reachable(spark, "file:///ckpt/a")
        conf.set("fs.defaultFS", "hdfs://names:8020")
        assert suffix.reachable(spark, "/ckpt/a") is None and suffix.reachable(spark, "file:///ckpt/a") == "/ckpt/a"
        assert suffix.reachable(spark, "s3a://b/a") is None
    finally:
        conf.set("fs.defaultFS", before) if before else conf.unset("fs.defaultFS")


def test_what_no_other_string_shares_stays_out_of_the_transform(monkeypatch):
    """Strings with one anchor: those that agree around it for less than a window don't enter, of the others what they share."""
    import numpy as np
    import pyarrow as pa

    from lodestrata.llm import textscan as ts
    from lodestrata.llm.common import delta, pack
    from lodestrata.llm.repeats import Spec

    spec, draw, entered = Spec("bytes", 50, 25), np.random.default_rng(3), []
    monkeypatch.setattr(suffix, "shared_windows", lambda rid, data, off, *a, real=suffix.shared_windows: entered.extend(zip(rid.tolist(), np.diff(off).tolist(), strict=True)) or real(rid, data, off, *a))
    some = lambda n: draw.integers(97, 123, n).astype(np.uint8)
    gram, none = some(25), some(0)
    least = lambda text: ts.superwindows(ts.spans(pre := ts.prefix(ts.BYTE_A[text]), at := np.arange(len(text) - 24), at + 25), spec.grams, 50, np.array([0, len(text)]))

    def around(left, right):
        """left, gram, right, with other bytes further out, so that the gram is the least one of the whole."""
        while True:
            text = np.r_[some(25 - len(left)), left, gram, right, some(25 - len(right))]
            if len(least(text)[3]) == 1 and least(text)[3][0] == 25:
                return text

    while True:  # a gram that mostly is the least
        if sum(len(least(t)[3]) == 1 and least(t)[3][0] == 25 for t in (np.r_[some(25), gram, some(25)] for _ in range(50))) > 10:
            break
        gram = some(25)
    left, right = around(none, none)[13:25], around(none, none)[50:68]
    texts = [around(left, none), around(left, right), around(none, right[:12]), around(left, right), around(none, none)]
    meta = pack(delta(np.arange(5)), np.zeros(5, np.uint32), np.full(5, 26, np.uint8), np.ones(5, np.uint32))
    got = suffix._transform(spec, 12, None)(pa.table({"bucket": [0], "payload": pa.array([meta + np.concatenate(texts).tobytes()], pa.binary())}))
    assert sorted(entered) == [(1, 55), (3, 55)]
    assert got.num_rows == 1
