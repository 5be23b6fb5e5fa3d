"""Lookups, aggregates and writes of the store over orders, parts and documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import layout as L
from ..operators import store as S
from ..session import prepared_path, scratch_root
from ..sources import submissions as U
from .registry import query


@query("SELECT doc_id, sha256(text) AS file_hash FROM documents")
def content_hash(t):
    return t.documents.select("doc_id", S.content_hash(F.col("text")).alias("file_hash"))


@query("SELECT doc_id, source FROM documents WHERE sha256(text) = (SELECT min(sha256(text)) FROM documents)")
def hash_lookup(t):
    hashed = t.documents.select("doc_id", "source", S.content_hash(F.col("text")).alias("file_hash"))
    least = hashed.agg(F.min("file_hash").alias("file_hash"))
    return hashed.join(F.broadcast(least), "file_hash", "left_semi").select("doc_id", "source")


@query("SELECT item_id, sha256(text) IN (SELECT sha256(text) FROM documents) AS found FROM benchmark")
def exists_by_hash(t):
    wanted = t.benchmark.select("item_id", S.content_hash(F.col("text")).alias("file_hash"))
    return S.exists_by_hash(wanted, t.documents.select(S.content_hash(F.col("text")).alias("file_hash"))).select("item_id", "found")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def point_lookup(t):
    return S.point(t.orders, "o_orderkey", 7).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = 10 AND o_orderstatus <> 'P' ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey LIMIT 50")
def list_by_key(t):
    rows = S.point(t.orders, "o_custkey", 10).filter("o_orderstatus <> 'P'").select("o_orderkey", "o_orderdate")
    return S.page(rows, (F.col("o_orderdate").desc_nulls_first(), "o_orderkey"), 50)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = 10 AND o_orderstatus = 'O'")
def list_by_key_type(t):
    rows = S.point(S.point(t.orders, "o_custkey", 10), "o_orderstatus", "O").select("o_orderkey", "o_orderdate")
    return rows.orderBy(F.col("o_orderdate").desc_nulls_first(), "o_orderkey")


@query("SELECT o_custkey, o_orderstatus, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey) = 1")
def latest_per_key(t):
    rows = t.orders.select("o_custkey", "o_orderstatus", "o_orderkey", "o_orderdate")
    return S.newest_per_key(rows, ("o_custkey", "o_orderstatus"), "o_orderdate", "o_orderkey")


@query(
    """WITH a AS (SELECT o_custkey, o_orderkey, year(o_orderdate) AS year, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS pos FROM orders),
    f AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY o_custkey, year ORDER BY pos) = 1)
    SELECT o_custkey, o_orderkey, year FROM f QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY pos) <= 3"""
)
def latest_per_year(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate")
    return S.first_per_year(rows, "o_custkey", "o_orderdate", (F.desc("o_orderdate"), "o_orderkey"), 3).select("o_custkey", "o_orderkey", "year")


_FORM = "CASE o_orderstatus WHEN 'F' THEN '10-K' WHEN 'O' THEN '10-Q' ELSE '8-K' END"


def _known(t):
    """Every customer as a company: its ticker and number."""
    return t.customer.select(F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("ticker"), F.col("c_custkey").alias("cik"))


@query("SELECT 'T' || c_custkey AS ticker, lpad(c_custkey::VARCHAR, 10, '0') AS cik FROM customer WHERE c_custkey % 3 = 0")
def lpad_lookup(t):
    """Tickers in another case than the known ones, and one that nobody knows."""
    wanted = t.customer.filter("c_custkey % 3 = 0").select(F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("ticker"))
    return U.resolve(wanted.unionByName(t.spark.createDataFrame([("nobody",)], "ticker string")), _known(t))


@query(
    f"""WITH f AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS pos FROM orders WHERE {_FORM} = '10-K' AND o_custkey % 3 = 0),
    y AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY pos) = 1),
    n AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY pos) <= 5)
    SELECT 'T' || o_custkey AS ticker, '10-K' AS filing_type, lpad(o_custkey::VARCHAR, 10, '0') AS cik, year(o_orderdate)::INT AS fiscal_year, o_orderdate::DATE AS filed_at, '77' || o_orderkey AS accession, 'd' || o_orderkey || '.htm' AS document,
    'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/77' || o_orderkey || '/d' || o_orderkey || '.htm' AS source_url FROM n"""
)
def list_filings(t):
    """Seven years are asked for, five are listed."""
    form = F.expr(_FORM)
    entry = F.struct((-F.unix_date(F.col("o_orderdate").cast("date"))).alias("newest"), F.col("o_orderkey").alias("key"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filed"), form.alias("form"))
    lists = t.orders.groupBy(F.col("o_custkey").cast("string").alias("cik")).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    each = lambda f: F.transform("e", f)
    key = lambda x: x["key"].cast("string")
    recent = F.struct(each(lambda x: F.concat(F.lit("7-7-"), key(x))).alias("accessionNumber"), each(lambda x: x["form"]).alias("form"), each(lambda x: x["filed"]).alias("filingDate"), each(lambda x: F.concat(F.lit("d"), key(x), F.lit(".htm"))).alias("primaryDocument"))
    tickers = t.orders.filter("o_custkey % 3 = 0 and o_orderstatus = 'F'").select(F.concat(F.lit("T"), F.col("o_custkey").cast("string")).alias("ticker")).distinct()
    return U.list_filings(tickers, "10-K", _known(t), lists.select("cik", F.struct(recent.alias("recent")).alias("filings")), 7)


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 50")
def paginate(t):
    return S.page(t.orders.select("o_orderkey", "o_custkey"), ("o_orderkey",), 25, 50)


@query("SELECT o_orderkey, o_orderdate, l_linenumber, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def chunks_by_filing(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    return t.orders.select("o_orderkey", "o_orderdate").join(lines, "o_orderkey")


@query("SELECT l_linenumber AS chunk_index, l_quantity, l_returnflag AS section FROM lineitem WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem WHERE l_returnflag = 'N' AND l_linenumber = 3) AND l_returnflag = 'N' ORDER BY l_linenumber")
def chunks_in_order(t):
    chunks = t.lineitem.select(F.col("l_orderkey").alias("filing_id"), F.col("l_linenumber").alias("chunk_index"), "l_quantity", F.col("l_returnflag").alias("section"))
    filing = chunks.filter("section = 'N' AND chunk_index = 3").agg(F.min("filing_id")).first()[0]
    return S.chunks_of_filing(chunks, filing, "N").drop("filing_id")


def _laid_out(t):
    """Orders as filings and their lines as chunks, laid out together once per version of the files."""
    chunks = t.lineitem.select(F.col("l_orderkey").alias("filing_id"), F.col("l_linenumber").alias("chunk_index"), "l_quantity", F.col("l_returnflag").alias("section"))
    filings = t.orders.select(F.col("o_orderkey").alias("filing_id"), "o_custkey", "o_orderstatus")
    n = L.buckets_for(chunks)

    def table(kind, rows, order):
        def write(source, path):
            L.lay_out(source, path.rsplit("/", 1)[1].replace("-", "_"), path, "filing_id", order, n)

        return t.spark.table(prepared_path(f"{kind}-by-filing-{n}", rows, write).rsplit("/", 1)[1].replace("-", "_"))

    return table("filings", filings, ()), table("chunks", chunks, ("chunk_index",))


@query(
    """SELECT o_orderkey AS filing_id, o_custkey, count(*) AS n_chunks, sum(l_quantity)::DOUBLE AS quantity, min(l_linenumber) AS first_chunk FROM orders JOIN lineitem ON l_orderkey = o_orderkey
    WHERE o_orderstatus = 'F' GROUP BY ALL"""
)
def filings_with_chunks(t):
    """A parent-child join and aggregation in which nothing is exchanged."""
    filings, chunks = _laid_out(t)
    both = L.together(filings.filter("o_orderstatus = 'F'"), chunks, "filing_id")
    return both.groupBy("filing_id", "o_custkey").agg(F.count("*").alias("n_chunks"), F.sum("l_quantity").cast("double").alias("quantity"), F.min("chunk_index").alias("first_chunk"))


@query("SELECT l_linenumber AS chunk_index, l_quantity, l_returnflag AS section FROM lineitem WHERE l_orderkey = (SELECT max(l_orderkey) FROM lineitem WHERE l_linenumber = 5) ORDER BY l_linenumber")
def laid_out_chunks_in_order(t):
    _, chunks = _laid_out(t)
    filing = chunks.filter("chunk_index = 5").agg(F.max("filing_id")).first()[0]
    return L.rows_of(chunks, "filing_id", filing, ["chunk_index"]).drop("filing_id")


@query("SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS step FROM conversations")
def session_history(t):
    from pyspark.sql import Window

    step = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return t.conversations.select("conv_id", "turn", "role", "text", step.alias("step"))


@query("SELECT DISTINCT source FROM documents ORDER BY source")
def list_keys(t):
    return t.documents.select("source").distinct().orderBy("source")


@query("SELECT count(*) AS n FROM lineitem")
def global_count(t):
    return t.lineitem.agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def count_by_key(t):
    return t.documents.groupBy("source").agg(F.count("*").alias("n"))


@query(
    """SELECT source, count(*) FILTER (lang <> 'fr') AS n_active, least(count(*) FILTER (lang <> 'fr'), 50) AS n_listed, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY source
    UNION ALL SELECT NULL, count(*) FILTER (lang <> 'fr'), count(*), sum(n_chars)::BIGINT FROM documents"""
)
def store_stats(t):
    """French documents stand for inactive ones; the row without a source is the whole store, with all its rows."""
    return S.stats(t.documents.withColumn("is_active", F.col("lang") != "fr"), "source", "n_chars")


@query("SELECT count(*) AS n_texts, count(DISTINCT sha256(text)) AS n_distinct, count(*) - count(DISTINCT sha256(text)) AS n_skipped, sum(n_chars)::BIGINT AS n_chars FROM documents")
def ingest_summary(t):
    h = F.count_distinct(S.content_hash(F.col("text")))
    return t.documents.agg(F.count("*").alias("n_texts"), h.alias("n_distinct"), (F.count("*") - h).alias("n_skipped"), F.sum("n_chars").alias("n_chars"))


@query(
    """SELECT doc_id, array_to_string(list_filter([CASE WHEN lang NOT IN ('en', 'de') THEN 'lang' END, CASE WHEN n_chars < 100 THEN 'n_chars' END, CASE WHEN trim(text) = '' THEN 'text' END], lambda x: x IS NOT NULL), ',') AS violations
    FROM documents WHERE lang NOT IN ('en', 'de') OR n_chars < 100 OR trim(text) = ''"""
)
def check_constraints(t):
    from ..schemas import validate

    checks = {"lang": F.col("lang").isin("en", "de"), "n_chars": F.col("n_chars") >= 100, "text": F.trim("text") != ""}
    return validate(t.documents, checks)[1].select("doc_id", F.array_join("violations", ",").alias("violations"))


_BATCH = "SELECT p_partkey + CASE WHEN p_size > 40 THEN 1000000 ELSE 0 END AS p_partkey, upper(p_name) AS p_name, p_size + 1 AS p_size, p_retailprice FROM part WHERE p_size > 20"


def _parts(t):
    """Stored parts, and a batch of the larger ones with changed values, the largest under keys that are new unless a part has them: then the batch may repeat one, and each of its rows counts."""
    stored = t.part.select("p_partkey", "p_name", "p_size", "p_retailprice")
    key = F.col("p_partkey") + F.when(F.col("p_size") > 40, 1000000).otherwise(0)
    batch = stored.filter("p_size > 20").select(key.alias("p_partkey"), F.upper("p_name").alias("p_name"), (F.col("p_size") + 1).alias("p_size"), "p_retailprice")
    return stored, batch


@query(
    f"""SELECT coalesce(s.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN b.p_partkey IS NULL THEN s.p_name ELSE b.p_name END AS p_name, CASE WHEN s.p_partkey IS NULL THEN b.p_size ELSE s.p_size END AS p_size,
    CASE WHEN b.p_partkey IS NULL THEN s.p_retailprice ELSE b.p_retailprice END AS p_retailprice
    FROM part s FULL JOIN (SELECT p_partkey, p_name, p_size, CASE WHEN p_size % 2 = 0 THEN p_retailprice END AS p_retailprice FROM ({_BATCH})) b ON s.p_partkey = b.p_partkey"""
)
def bulk_upsert(t):
    """Half of the batch sets the price to null, which an upsert writes."""
    stored, batch = _parts(t)
    return S.upsert(stored, batch.withColumn("p_retailprice", F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice"))), "p_partkey", ("p_name", "p_retailprice"), each=True)


@query(f"SELECT p_partkey, p_name, p_size, p_retailprice FROM part UNION ALL SELECT b.* FROM ({_BATCH}) b WHERE b.p_partkey NOT IN (SELECT p_partkey FROM part)")
def insert_ignore(t):
    return S.insert_ignore(*_parts(t), "p_partkey")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS file_hash FROM documents WHERE lang = 'en' AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang <> 'en') GROUP BY sha256(text)")
def ingest_dedup(t):
    hashed = t.documents.select("doc_id", "lang", S.content_hash(F.col("text")).alias("file_hash"))
    fresh = S.ingest(hashed.filter("lang = 'en'"), hashed.filter("lang <> 'en'"), order="doc_id")
    return fresh.select("doc_id", "file_hash")


@query("SELECT o_orderkey, o_orderstatus <> 'F' AS is_active FROM orders")
def soft_delete(t):
    return S.soft_delete(t.orders.select("o_orderkey", "o_orderstatus", F.lit(True).alias("is_active")), F.col("o_orderstatus") == "F").drop("o_orderstatus")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def cascade_delete(t):
    gone = t.orders.filter("o_orderstatus = 'F'")
    return S.cascade_delete(t.orders, t.lineitem.select("l_orderkey", "l_linenumber"), gone, "o_orderkey", "l_orderkey")[1]


@query("SELECT event_id::VARCHAR AS key, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE ts + INTERVAL 1 DAY > TIMESTAMP '2024-01-15'")
def cache_get(t):
    now = F.lit("2024-01-15").cast("timestamp_ntz")
    cache = t.events.select(F.col("event_id").cast("string").alias("key"), F.col("props").alias("value"), (F.col("ts") + F.expr("interval 1 day")).alias("expires_at"))
    return S.cache_get(cache, now, "k bigint").select("key", F.col("parsed.k").alias("k"))


@query("SELECT k.key, coalesce(k.key LIKE 'view:%', false) AND e.event_id IS NOT NULL AS existed FROM (SELECT event_type || ':' || event_id AS key FROM events WHERE event_id % 5 = 0 UNION ALL SELECT 'none:1') k LEFT JOIN events e ON k.key = e.event_type || ':' || e.event_id")
def cache_delete(t):
    """The cache holds views only."""
    key = F.concat_ws(":", "event_type", "event_id").alias("key")
    wanted = t.events.filter("event_id % 5 = 0").select(key).unionByName(t.spark.createDataFrame([("none:1",)], "key string"))
    return S.cache_delete(t.events.filter("event_type = 'view'").select(key), wanted)[1]


@query("SELECT event_type || ':' || event_id AS key FROM events WHERE event_id % 5 = 0 AND ts + INTERVAL 1 DAY > TIMESTAMP '2024-01-15'")
def cache_exists(t):
    key = F.concat_ws(":", "event_type", "event_id").alias("key")
    cache = t.events.select(key, (F.col("ts") + F.expr("interval 1 day")).alias("expires_at"))
    return S.cache_exists(cache, t.events.filter("event_id % 5 = 0").select(key), F.lit("2024-01-15").cast("timestamp_ntz"))


@query("SELECT event_type || ':' || event_id AS key FROM events WHERE event_type <> 'view'")
def cache_clear(t):
    return S.cache_clear(t.events.select(F.concat_ws(":", "event_type", "event_id").alias("key")), "view")


@query("SELECT doc_id, 'query:' || sha256('{\"l\": 5, \"q\": \"' || source || '\", \"t\": \"' || lang || '\"}') AS key FROM documents")
def cache_key(t):
    return t.documents.select("doc_id", S.cache_key(t=F.col("lang"), q=F.col("source"), l=5).alias("key"))


@query("SELECT item_id, text FROM benchmark UNION ALL SELECT item_id, text FROM benchmark WHERE item_id % 2 = 0")
def bulk_append(t):
    rows, path = t.benchmark.select("item_id", "text"), f"{scratch_root(t.spark)}/appended-{uuid.uuid4().hex}"
    S.append(rows, path)
    S.append(rows.filter("item_id % 2 = 0"), path)
    S.append(rows.limit(0), path)
    return t.spark.read.parquet(path)


@query("SELECT page_id % 3 AS k, sha256(html) AS file_hash FROM pages WHERE page_id % 3 = 1 AND page_id % 2 = 0")
def landing(t):
    """Pages written to folders of ticker, type and year; one folder of each is read back."""
    path = f"{scratch_root(t.spark)}/landing-{uuid.uuid4().hex}"
    U.land(t.pages.select(F.concat(F.lit("A/"), F.col("page_id") % 3).alias("ticker"), F.lit("10-K").alias("filing_type"), (2020 + F.col("page_id") % 2).cast("int").alias("fiscal_year"), "html"), path)
    return U.landed_pages(t.spark, path).filter("ticker = 'A_1' and fiscal_year = 2020").select(F.lit(1).cast("long").alias("k"), "file_hash")


_REQUESTS = """SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN ' ' WHEN turn % 7 = 2 THEN NULL ELSE text END AS question, CASE role WHEN 'user' THEN 'analyst' WHEN 'assistant' THEN 'poet' END AS analysis_style,
    CASE conv_id % 4 WHEN 0 THEN 'best' WHEN 1 THEN NULL WHEN 2 THEN 'mmr' ELSE 'hybrid' END AS search_type, length(text) % 25 AS most, conv_id % 8 AS years FROM conversations"""


@query(
    f"""SELECT * FROM (SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN coalesce(trim(question), '') = '' THEN 'question' END, CASE WHEN analysis_style NOT IN ('analyst', 'executive', 'risk') THEN 'analysis_style' END,
    CASE WHEN search_type NOT IN ('similarity', 'mmr', 'hybrid') THEN 'search_type' END, CASE WHEN most NOT BETWEEN 1 AND 20 THEN 'limit' END, CASE WHEN years NOT BETWEEN 1 AND 5 THEN 'years' END], lambda x: x IS NOT NULL), ',') AS violations
    FROM ({_REQUESTS})) WHERE violations <> ''"""
)
def request_checks(t):
    """Turns of conversations as requests, some of whose fields are absent or not allowed."""
    from ..schemas import request_checks, validate

    t.conversations.createOrReplaceTempView("conversations")
    rows = t.spark.sql(_REQUESTS).withColumnRenamed("most", "limit")
    return validate(rows, request_checks())[1].select("conv_id", "turn", F.array_join("violations", ",").alias("violations"))


# --- the stored table with versions ---


def _stored(t, rows, key: str, buckets: int = 16):
    from ..operators.versioned import VersionedTable

    return VersionedTable.create(rows, f"{scratch_root(t.spark)}/table-{uuid.uuid4().hex}", key, buckets)


_MERGED = f"""SELECT coalesce(s.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN b.p_partkey IS NULL THEN s.p_name ELSE b.p_name END AS p_name, CASE WHEN s.p_partkey IS NULL THEN b.p_size ELSE s.p_size END AS p_size,
    CASE WHEN s.p_partkey IS NULL THEN b.p_retailprice ELSE s.p_retailprice END AS p_retailprice FROM part s FULL JOIN ({_BATCH}) b ON s.p_partkey = b.p_partkey"""


def _changed(t):
    """Parts after an upsert, a soft delete by size and a delete of keys: four versions."""
    stored, batch = _parts(t)
    table = _stored(t, stored, "p_partkey")
    table.upsert(batch, ("p_name",), each=True)
    table.update(F.col("p_size") < 5, p_retailprice=0.0)
    table.delete(stored.filter("p_partkey % 10 = 3"))
    return table


@query(f"SELECT p_partkey, p_name, p_size, CASE WHEN p_size < 5 THEN 0 ELSE p_retailprice END AS p_retailprice FROM ({_MERGED}) WHERE p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 10 = 3)")
def table_changes(t):
    return _changed(t).read()


@query(f"SELECT * FROM ({_MERGED})")
def table_as_of(t):
    """The second version, after three more changes."""
    return _changed(t).read(1)


@query(
    """SELECT 'customers' AS kind, (SELECT count(*) FROM customer WHERE c_custkey % 7 <> 0) AS n UNION ALL SELECT 'orders', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0))
    UNION ALL SELECT 'bought', (SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 7 <> 0)"""
)
def table_cascade(t):
    """Customers go with their orders."""
    from ..operators.versioned import cascade_delete

    customers = _stored(t, t.customer.select("c_custkey", "c_name"), "c_custkey")
    orders = _stored(t, t.orders.select("o_orderkey", "o_custkey"), "o_orderkey")
    cascade_delete(customers, orders, t.customer.filter("c_custkey % 7 = 0").select("c_custkey"), "o_custkey")
    left, of_left = customers.read(), orders.read()
    both = of_left.join(left, F.col("o_custkey") == F.col("c_custkey"))
    counted = [x.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, x in (("customers", left), ("orders", of_left), ("bought", both))]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])
