"""Streams against batches, sources, and the two pipelines."""

from functools import partial

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import embedding as V
from lodestrata.functions import html as H
from lodestrata.functions import text as X
from lodestrata.functions.embedding import hash_embedding, hash_vectors
from lodestrata.operators import retrieval as R
from lodestrata.operators import store as S
from lodestrata.plans.pipeline import NO_ANSWER, RAW_ANSWER, Retriever, chunks_of, filings_to_chunks
from lodestrata.sources import submissions
from lodestrata.streaming import events as E
from lodestrata.streaming.keyed import alerts

EVENTS = "/root/testdata/sf0.001/events.parquet"


def drained(stream, name, mode="complete"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_stream_windows_equal_batch(spark, tmp_path):
    batch = spark.read.parquet(EVENTS)
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    error = F.col("event_type") == "error"
    live = drained(E.window_error_rates(E.timed(E.read(spark, str(tmp_path / "in"), batch.schema, 1)), error, "1 hour"), "w")
    whole = E.window_error_rates(batch.withColumn("ts", F.col("ts").cast("timestamp")), error, "1 hour")
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, whole.collect()))


def test_stream_ingest_is_idempotent(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, text string")
    for part in ("one", "two"):
        docs.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        E.run_available(E.new_documents(E.read(spark, str(tmp_path / "in"), docs.schema), "text"), str(tmp_path / "out"), str(tmp_path / "check"))
        assert spark.read.parquet(str(tmp_path / "out")).count() == 2, part


def test_stream_cache_keeps_the_last_value(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "key string, value string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = E.live_entries(E.read(spark, str(tmp_path / "in"), rows.schema), 3_600_000)
    # one batch: a stream that waits for times to run out is never done
    stream.writeStream.format("memory").queryName("c").outputMode("append").trigger(once=True).start().awaitTermination(60)
    assert sorted(map(tuple, spark.table("c").collect())) == [("a", "2", "set"), ("b", "3", "set")]


def test_stream_rate_limit(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:00:01", "x")] * 3 + [("2024-01-01 00:00:02", "y")], "t string, who string").select(F.col("t").cast("timestamp").alias("ts"), "who")
    rows.write.parquet(str(tmp_path / "in"))
    out = drained(E.over_limit(E.timed(E.read(spark, str(tmp_path / "in"), rows.schema)), "who", "1 minute", 2), "l")
    assert [(r.who, r.n) for r in out.collect()] == [("x", 3)]


def test_stream_alert_needs_windows_in_a_row(spark, tmp_path):
    def hours(folder, *counts):
        rows = [(f"2024-01-01 {h:02}:{m:02}:00", "error" if m < n else "ok") for h, n in counts for m in range(10)]
        spark.createDataFrame(rows, "t string, event_type string").select(F.col("t").cast("timestamp").alias("ts"), "event_type").coalesce(1).write.mode("append").parquet(folder)

    source, schema = str(tmp_path / "in"), "ts timestamp, event_type string"
    for part in ([(0, 9), (1, 1), (2, 8)], [(3, 9), (4, 9), (5, 0), (6, 9), (8, 0)], [(12, 0)]):
        hours(source, *part)
        live = alerts(E.timed(E.read(spark, source, schema), late="1 minute"), F.lit("all"), F.col("event_type") == "error", 0.5, 2, 3600)
        E.run_available(live, str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.alert_start.hour, r.alert_end.hour, r.n_windows) for r in got if r.state == "resolved"] == [(2, 4, 3)]
    assert [(r.alert_start.hour, r.alert_end.hour) for r in got if r.state == "firing"] == [(2, 3)]


def test_filings_of_submissions(spark):
    rows = [("1", ((["1-1", "1-2", "1-3", "1-4", "1-5"], ["10-K", "10-K", "8-K", "10-K", "10-K"], ["2024-03-01", "2024-01-01", "2023-05-05", "bad", "2022-02-02"], ["a", "b", "c", "d", "e"]),))]
    got = submissions.filings(spark.createDataFrame(rows, submissions.SUBMISSIONS), "10-K", 3).orderBy("fiscal_year").collect()
    assert [(r.fiscal_year, r.accession, r.document) for r in got] == [(2022, "15", "e"), (2024, "11", "a")]
    known = spark.createDataFrame([("abc", 320)], "ticker string, cik long")
    assert submissions.resolve(spark.createDataFrame([("Abc",), ("zz",)], "ticker string"), known).first().cik == "0000000320"


def test_landed(spark, tmp_path):
    (tmp_path / "x.html").write_bytes(b"<p>hi \xc3\xa9</p>")
    row = submissions.landed(spark, str(tmp_path)).first()
    assert row.html == "<p>hi é</p>" and len(row.file_hash) == 64


def test_pages_to_context(spark):
    body = "Risk Factors\n" + "Total revenue was $394.3 billion and then some more words follow here. " * 3
    pages = spark.createDataFrame([(1, f"<html><p>{body}</p></html>"), (2, f"<html><p>{body}</p></html>"), (3, "<html><p>nothing of interest</p></html>"), (4, None)], "page_id long, html string")
    none = spark.createDataFrame([], "file_hash string")
    chunks = filings_to_chunks(pages.filter("html is not null"), none, hash_embedding(F.col("chunk_text")))
    rows = chunks.orderBy("filing_id").collect()
    assert [(r.filing_id, r.section, r.chunk_index) for r in rows] == [(1, "Risk Factors", 0), (3, "General", 0)]
    assert rows[0].metrics["revenue"] == pytest.approx(3.943e11)
    again = filings_to_chunks(pages.filter("html is not null"), pages.filter("html is not null").select(S.content_hash(F.col("html")).alias("file_hash")))
    assert again.count() == 0
    table = chunks.select("id", "embedding", "chunk_text", F.lit("AAA").alias("ticker"), F.lit("10-K").alias("filing_type"), F.lit(2024).alias("fiscal_year"), "section").cache()
    r = Retriever(table, threshold=0.2)
    words = "total revenue was"
    q = hash_vectors([words])[0].tolist()
    for kind in ("similarity", "mmr", "hybrid"):
        found = r.search(q, words, kind, 2, ticker="aaa").orderBy("rank").collect()
        assert found and found[0]["rank"] == 1, kind
    assert "FY2024 — Risk Factors" in r.context(r.search(q, words, ticker="aaa", fiscal_year=2024)).first().context
    assert r.search(q, words, ticker="zzz").count() == 0
    with pytest.raises(ValueError):
        r.search(q, words, "best")
    index = R.trigram_postings(table, "id", "chunk_text")
    for t in (r, Retriever(table, threshold=0.99, index=index), Retriever(table, threshold=0.99)):
        row = t.ask(words, q, ticker="aaa", style="poet").first()
        cited = 1 if t is r else 2  # the other chunk is below the threshold of a similarity search
        assert row.answer.startswith(RAW_ANSWER) and row.analysis_style == "analyst" and len(row.source_chunk_ids) == cited
        assert row.search_type == ("similarity" if t is r else "hybrid")
    assert r.ask(words, q, answer=lambda question, style, context: f"{style}: {len(context) > 0}", style="risk").first().answer == "risk: True"
    nothing = r.ask(words, q, ticker="zzz").first()
    assert nothing.answer == NO_ANSWER and nothing.source_chunk_ids == []
    with pytest.raises(ValueError):
        r.ask("  ", q)


def test_questions_keep_to_the_threshold(spark):
    rows = [(f"{i:064x}", v, f"text {i}", "AAA", "10-K", 2023 + i % 2, None) for i, v in enumerate(([1.0, 0.0], [0.5, 0.75**0.5], [0.0, 1.0]))]
    table = spark.createDataFrame(rows, "id string, embedding array<double>, chunk_text string, ticker string, filing_type string, fiscal_year int, section string").cache()
    r, q = Retriever(table, threshold=0.7), [1.0, 0.0]
    ids = [row[0] for row in rows]
    assert [x.id for x in r.search(q, "text").collect()] == ids[:1]
    assert [(x.id, x.search_type) for x in r.found(q, "text").collect()] == [(ids[0], "similarity")]
    answer = r.ask("text", q).first()
    assert answer.source_chunk_ids == ids[:1] and "text 0" in answer.answer and "text 1" not in answer.answer
    assert [x.id for x in R.mmr(table, q, 3).orderBy("rank").collect()] == ids  # of equal values the one of the better score comes first
    assert [x.id for x in r.search(q, "text", "mmr").collect()] == ids[:1]
    both = Retriever(table, threshold=0.4)
    context, sources = both.compare(q, "text", [])
    head = "[Source: AAA 10-K FY{} — General (score={})]\ntext {}"
    assert context.first().context == head.format(2023, "1.000", 0) + "\n\n" + head.format(2024, "0.500", 1)
    assert sorted(x.id for x in sources.collect()) == ids[:2]
    context, _ = both.compare(q, "text", [2024, 2019, 2023])
    assert context.first().context == "=== FY2024 ===\n" + head.format(2024, "0.500", 1) + "\n\n=== FY2023 ===\n" + head.format(2023, "1.000", 0)
    for years in ([], [2019]):
        context, sources = r.compare(q, "text", years, ticker="zzz")
        assert context.first().context == "No comparative data found." and sources.count() == 0
    context, sources = r.tool_search(q, "text", {"ticker": "zzz"}, {})
    assert context.first().context == "No relevant information found for this query." and sources.count() == 0


def parsed(spark, *sections):
    return spark.createDataFrame([(1, "AAA", "10-K", 2024, list(sections))], "filing_id int, ticker string, filing_type string, fiscal_year int, sections array<struct<name:string,text:string>>")


def test_chunks_have_sequential_indices(spark):
    long = " ".join(f"word{i}" for i in range(1200))
    rows = chunks_of(parsed(spark, ("A", long), ("blank", " \n "), ("B", "a\nshort one"), ("C", long)), model_version="m1").orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(7)) and [r.section for r in rows] == ["A"] * 3 + ["B"] + ["C"] * 3
    assert rows[3].chunk_text == "a\nshort one" and {(r.ticker, r.filing_type, r.fiscal_year, r.model_version) for r in rows} == {("AAA", "10-K", 2024, "m1")}


def test_a_filing_without_sections_is_an_error(spark):
    with pytest.raises(Exception, match="no sections"):
        chunks_of(parsed(spark)).collect()


def test_vocabulary_tokens_make_the_text_again(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    own = X.vocabulary_tokenizer(path)
    texts = ["Total revenue was $394.3 billion", "é 😀 日本語", "", None, "a\nb  c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    rows = df.select("t", own.split(F.col("t")).alias("w")).select("t", F.size("w").alias("n"), own.join(F.col("w")).alias("again")).collect()
    from tokenizers import Tokenizer

    file = Tokenizer.from_file(path)
    assert [(r.n, r.again) for r in rows] == [(len(file.encode(t or "", add_special_tokens=False).ids), t or "") for t in texts]
    chunks = chunks_of(parsed(spark, ("A", "one two three four. " * 300)), own).collect()
    assert len(chunks) > 1 and max(c.token_count for c in chunks) == 512


def test_providers_are_checked_and_called_again(spark):
    calls = []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise OSError("busy")
        return V.hash_vectors(texts, 8)

    waits = []
    again = submissions.retried(flaky, 3, sleep=waits.append)
    assert again(["a"]).shape == (1, 8) and waits == [2.0]
    with pytest.raises(OSError):
        submissions.retried(lambda: (_ for _ in ()).throw(OSError()), 2, sleep=waits.append)()
    good = V.Provider("p", 8, partial(V.hash_vectors, dimensions=8), batch=2)
    assert V.checked(good, ["a", "b", "c"]).shape == (3, 8) and V.checked(good, []).shape == (0, 8)
    with pytest.raises(V.EmbeddingError, match="2 vectors for 1"):
        V.checked(V.Provider("p", 8, lambda texts: V.hash_vectors(texts * 2, 8)), ["a"])
    with pytest.raises(V.EmbeddingError, match="not 8"):
        V.checked(V.Provider("p", 8, lambda texts: V.hash_vectors(texts, 4)), ["a"])
    row = spark.createDataFrame([("a b",), (None,)], "t string").select(V.embedding(good)(F.col("t")).alias("v")).collect()
    assert len(row[0].v) == 8 and set(row[1].v) == {0.0}


def test_unclosed_elements_and_line_ends():
    assert H.read_html("<html><head><title>t</title><body><p>kept?").strip() == "kept?"
    assert H.read_html("<head><meta x><p>kept") == "kept" and H.read_html("<script>a</script>b<style>c") == "b"


def test_all_line_ends_count(spark):
    ends = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
    page = spark.createDataFrame([("<p>" + "x".join(ends) + "</p>",)], "h string")
    assert page.select(H.html_text(F.col("h")).alias("t")).first().t == "\n".join("x" * 10)


def test_sections_by_name(spark):
    text = "Risk Factors\n" + "much can go wrong. " * 5 + "\nProperties\n" + "we have some houses. " * 5
    row = H.section_arrays(spark.createDataFrame([(1, text)], "id int, text string"), "text").select(H.section_text(F.col("sections"), "Properties").alias("p"), H.section_text(F.col("sections"), "Business").alias("b")).first()
    assert row.p.startswith("Properties\nwe have") and row.b is None


def test_repeated_keys_in_a_batch(spark):
    stored = spark.createDataFrame([(1, "a", 0)], "id int, v string, at int")
    batch = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "d", 1), (3, None, 1)], "id int, v string, at int")
    with pytest.raises(Exception, match="repeats id"):
        S.upsert(stored, batch, "id", ("v",)).collect()
    assert sorted(map(tuple, S.upsert(stored, batch, "id", ("v",), order="at").collect()), key=repr) == [(1, "c", 0), (2, "d", 1), (3, None, 1)]
    got = S.insert_ignore(stored, batch.withColumn("id", F.col("id") + 5), "id", ["at"])
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, "a", 0), (6, "b", 1), (7, "d", 1), (8, None, 1)]


def test_audit_log(spark, tmp_path):
    now = F.current_timestamp()
    row = S.audit(spark, now, question="q", answer="a", agent_type="x", latency_ms=320, ticker="aapl")
    assert S.append(row, str(tmp_path / "h")) == 1 and S.append(row, str(tmp_path / "h")) == 1 and S.append(row.limit(0), str(tmp_path / "h")) == 0
    log = spark.read.parquet(str(tmp_path / "h")).collect()
    assert len(log) == 2 and {(r.ticker, r.analysis_style, r.search_type) for r in log} == {("AAPL", "analyst", "similarity")} and all(r.created_at and r.id for r in log)
    for bad in ({"question": "q"}, {"question": "q", "answer": "a", "agent_type": "x", "latency_ms": 1, "colour": "red"}):
        with pytest.raises(ValueError):
            S.audit(spark, now, **bad)


def test_cache_entries(spark):
    at = lambda hour: F.lit(f"2024-01-01 {hour:02}:00:00").cast("timestamp")
    cache = spark.createDataFrame([], "key string, value string, expires_at timestamp")
    cache = S.cache_set(cache, spark.createDataFrame([("q:a", '{"x": 1}'), ("q:b", "bad"), ("r:c", "{}")], "key string, value string"), at(0), 7200)
    keys = spark.createDataFrame([("q:a",), ("z",)], "key string")
    assert [r.key for r in S.cache_exists(cache, keys, at(1)).collect()] == ["q:a"] and S.cache_exists(cache, keys, at(3)).count() == 0
    assert [r.key for r in S.cache_exists(S.cache_touch(cache, "q:a", at(1), 36000), keys, at(3)).collect()] == ["q:a"]
    left, existed = S.cache_delete(cache, keys)
    assert left.count() == 2 and {r.key: r.existed for r in existed.collect()} == {"q:a": True, "z": False}
    assert {r.key: r.parsed and r.parsed.x for r in S.cache_get(cache, at(1), "x int").collect()} == {"q:a": 1, "q:b": None, "r:c": None}
    assert S.cache_clear(cache, "q").count() == 1


def test_filings_that_are_not_landed_yet(spark, tmp_path):
    known = spark.createDataFrame([("Abc", 320)], "ticker string, cik long")
    lists = [("320", ((["1-1", "2-2", "3-3"], ["10-K", "10-K", "10-K"], ["2024-03-01", "2023-05-05", ""], ["a.htm", "b.htm"]),))]
    (tmp_path / "json").mkdir()
    spark.createDataFrame(lists, submissions.SUBMISSIONS).coalesce(1).write.mode("overwrite").json(str(tmp_path / "json"))
    landed = submissions.read_submissions(spark, str(tmp_path / "json"))
    listed = submissions.list_filings(spark.createDataFrame([("ABC",)], "ticker string"), "10-K", known, landed).cache()
    assert sorted((r.fiscal_year or 0, r.source_url) for r in listed.collect()) == [(0, f"{submissions.ARCHIVES}/320/33/"), (2023, f"{submissions.ARCHIVES}/320/22/b.htm"), (2024, f"{submissions.ARCHIVES}/320/11/a.htm")]
    root = str(tmp_path / "raw")
    submissions.land(spark.createDataFrame([("ABC", "10-K", 2024, "<p>x</p>")], "ticker string, filing_type string, fiscal_year int, html string"), root)
    assert sorted(r.fiscal_year or 0 for r in submissions.not_landed(listed, spark, root).collect()) == [0, 2023]
    fetched = spark.createDataFrame([("file:/x/320/22/b.htm", "<p>y</p>", "h")], "path string, html string, file_hash string")
    assert [(r.fiscal_year, r.html) for r in submissions.with_documents(listed, fetched).collect()] == [(2023, "<p>y</p>")]
    for kind, years in (("10-X", 3), ("10-K", 0)):
        with pytest.raises(submissions.SourceError):
            submissions.list_filings(listed, kind, known, landed, years)
    with pytest.raises(Exception, match="unknown ticker"):
        submissions.list_filings(spark.createDataFrame([("zz",)], "ticker string"), "10-K", known, landed).collect()


def test_indexed_trigrams_are_those_of_the_scan(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["the ending", "nation", None, "", "THE end", "zzz", "the the the"])], "id long, text string")
    R.write_trigram_index(R.trigram_postings(docs), str(tmp_path / "i"), 2)
    index = spark.read.parquet(str(tmp_path / "i"))
    for words in ("the ending", "", "qqq"):
        for k in (2, 5, 20):
            assert list(map(tuple, R.indexed_trigram_topk(index, docs, words, k).orderBy("rank").collect())) == list(map(tuple, R.trigram_topk(docs, words, k).orderBy("rank").collect()))
    some = docs.filter("id > 0")
    assert [tuple(r) for r in R.indexed_trigram_topk(index, docs, "the ending", 3, among=some).orderBy("rank").collect()] == [tuple(r) for r in R.trigram_topk(some, "the ending", 3).orderBy("rank").collect()]


def test_blocks_of_trigrams_are_the_postings_without_an_exchange(spark, tmp_path, monkeypatch):
    texts = ["the ending", "nation", None, "", "THE end", "zzz zzz", "the the the", "É̀ü ß İstanbul 東京 x \U0001d54f\U0001d54f 12,5", "a", "...", "x" * 40]
    docs = spark.createDataFrame([(f"{i:03d}", t) for i, t in enumerate(texts * 5)], "id string, text string").coalesce(2)
    monkeypatch.setattr(R, "BLOCK_BYTES", 100)
    R.write_trigram_blocks(docs, str(tmp_path / "b"))
    index = R.open_trigram_blocks(spark, str(tmp_path / "b"))
    assert sorted(map(tuple, index.collect())) == sorted(map(tuple, R.trigram_postings(docs).collect()))
    plan = index.filter(F.col("gram") == "the")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(gram,the)" in plan and "Exchange" not in plan
    for words in ("the ending", "", "東京"):
        assert list(map(tuple, R.indexed_trigram_topk(index, docs, words, 9).orderBy("rank").collect())) == list(map(tuple, R.trigram_topk(docs, words, 9).orderBy("rank").collect()))
    R.write_trigram_blocks(docs.limit(0), str(tmp_path / "none"))
    assert R.open_trigram_blocks(spark, str(tmp_path / "none")).count() == 0


def test_blocks_read_the_found_ids_only(spark, tmp_path):
    """Both tables that the chunks are joined from get the ids as a condition, so no other text moves."""
    from lodestrata.plans.pipeline import Retriever

    spark.createDataFrame([(i, [1.0, float(i)]) for i in range(9)], "id long, embedding array<double>").write.parquet(str(tmp_path / "v"))
    spark.createDataFrame([(i, f"text {i}", "AAA", "10-K", 2024, None) for i in range(9)], "id long, chunk_text string, ticker string, filing_type string, fiscal_year int, section string").write.parquet(str(tmp_path / "t"))
    chunks = spark.read.parquet(str(tmp_path / "v")).join(spark.read.parquet(str(tmp_path / "t")), "id")
    r = Retriever(chunks, 0.0)
    blocks = r.blocks(r.found([1.0, 0.0], "text", k=2))
    assert sorted(x["chunk_text"] for x in blocks.collect()) == ["text 0", "text 1"]
    scans = [x for x in blocks._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x]
    assert len(scans) >= 2 and all(" IN (0,1)" in x for x in scans)
    assert r.blocks(r.found([1.0, 0.0], "text", ticker="none")).count() == 0


def test_vector_cells(spark, tmp_path):
    import numpy as np

    from lodestrata.operators import vector_index as C

    rng = np.random.default_rng(6)
    middles = rng.normal(size=(40, 16))
    v = middles[rng.integers(0, 40, 3000)] + 0.5 * rng.normal(size=(3000, 16))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(3000, None), (3001, [0.0] * 16)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    C.write_index(df, C.Cells.fit(df, 50, sample=1000), str(tmp_path / "i"))
    index, cells = C.open_index(spark, str(tmp_path / "i"))
    assert index.count() == len(rows) and len(cells.centres) == 50
    queries = [x.tolist() for x in v[::500]]
    assert C.recall(index, cells, queries, 5, 10) >= 0.9 and C.recall(index, cells, queries, 5, 50) == 1.0
    plan = C.search(index, cells, queries[0], 5, 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    assert C.search(index, cells, queries[0], 5, 3).first().id == 0
    none = spark.createDataFrame([], df.schema)
    C.write_index(none, C.Cells.fit(none), str(tmp_path / "e"))
    empty, nothing = C.open_index(spark, str(tmp_path / "e")) if (tmp_path / "e" / "cells").exists() and any((tmp_path / "e" / "cells").glob("cell=*")) else (none.withColumn("cell", F.lit(0)), C.Cells.fit(none))
    assert C.search(empty, nothing, queries[0]).count() == 0
