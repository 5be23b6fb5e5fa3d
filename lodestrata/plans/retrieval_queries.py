"""Ranked retrieval over ``embeddings`` and ``documents``; the query is the vector with id 0, which is no candidate itself, and a fixed text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph_index as G
from ..operators import retrieval as R
from ..operators import vector_index as V
from ..session import prepared_path
from .registry import query

TEXT = "the ending of the nation and other errors"
TRIGRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 3), lambda i: substring('  ' || w || ' ', i, 3)))))"
SCORES = "SELECT e.vec_id AS id, e.label, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id <> 0"


def _ranked(scores: str, k: int) -> str:
    return f"SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ({scores}) ORDER BY score DESC, id LIMIT {k}"


_TEXT_SCORES = f"SELECT doc_id AS id, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE AS score FROM (SELECT doc_id, {TRIGRAMS.format('text')} AS a, {TRIGRAMS.format(repr(TEXT))} AS b FROM documents)"
VECTOR_TOP, TEXT_TOP = _ranked(SCORES, 15), _ranked(_TEXT_SCORES, 15)


def _query(t) -> list[float]:
    """The one query vector."""
    return t.embeddings.filter("vec_id = 0").select("embedding").first()[0]


def _candidates(t):
    return t.embeddings.filter("vec_id <> 0")


def _vector(t, k: int):
    return R.cosine_topk(_candidates(t), _query(t), k, "vec_id")


def _postings(t):
    """The documents' trigram index, made once, as at ingest."""
    docs = t.documents.select("doc_id", "text")
    return R.open_trigram_blocks(t.spark, prepared_path("trigrams", docs, lambda df, path: R.write_trigram_blocks(df, path, "doc_id")))


def _text(t, k: int):
    return R.indexed_trigram_topk(_postings(t), t.documents, TEXT, k, "doc_id")


def _mixed(t, k: int):
    return R.hybrid(_candidates(t), t.documents, _query(t), TEXT, k, "vec_id", "embedding", "doc_id", index=_postings(t))


def _rounded(df):
    return df.withColumn("score", F.round("score", 6))


@query(f"SELECT id, rank, round(score, 6) AS score FROM ({_ranked(SCORES, 5)})")
def cosine_topk(t):
    return _rounded(_vector(t, 5))


@query(f"SELECT id, rank, round(score, 6) AS score FROM ({_ranked(SCORES, 5)})")
def cell_topk(t):
    """From the table by cells, made once, as at ingest; all cells are probed, so that the rows are the exact ones."""
    index, cells = _cells(t)
    return _rounded(V.search(index.filter("vec_id <> 0"), cells, _query(t), 5, len(cells.centres), "vec_id"))


def _cells(t):
    rows = t.embeddings.select("vec_id", "embedding")
    return V.open_index(t.spark, prepared_path("cells", rows, lambda df, path: V.write_index(df, V.Cells.fit(df, id_col="vec_id"), path)))


def _graphs(t):
    """The graphs of all vectors but the query's, made once, as at ingest."""
    rows = t.embeddings.filter("vec_id <> 0").select("vec_id", "embedding")
    return G.open_graphs(t.spark, prepared_path("graphs", rows, lambda df, path: G.write_graphs(df, path, id_col="vec_id")))


@query(f"SELECT id, rank, round(score, 6) AS score FROM ({_ranked(SCORES, 5)})")
def graph_topk(t):
    """By layered graphs: a search that compares a part of the vectors, here with the exact rows."""
    return _rounded(G.search(_graphs(t), _query(t), 5))


def _asked_vectors(t):
    """Vectors whose ids are divisible by 50, as queries: at most as many as a search takes."""
    return [r[0] for r in t.embeddings.filter("vec_id % 50 = 0").orderBy("vec_id").limit(G.QUERIES).select("embedding").collect()]


@query()
def index_recall(t):
    """Of both approximate indexes: the share of the five nearest that they find by default, over some of the vectors whose ids are divisible by 50."""
    queries, rows = _asked_vectors(t)[:20], t.embeddings.filter("vec_id <> 0")
    index, cells = _cells(t)
    graph, compared = G.recall(_graphs(t), rows, queries, id_col="vec_id")
    by_cells = V.recall(index.filter("vec_id <> 0"), cells, queries, id_col="vec_id")
    found = [("graphs", graph, compared), ("cells", by_cells, cells.probes / len(cells.centres))]
    return t.spark.createDataFrame(found, "kind string, recall double, compared double")


@query(f"SELECT id, rank, round(score, 6) AS score FROM ({_ranked(SCORES + ' AND e.label = 1', 5)})")
def filtered_topk(t):
    return _rounded(R.cosine_topk(R.where(_candidates(t), label=1), _query(t), 5, "vec_id"))


@query(f"SELECT id, round(score, 6) AS score FROM ({SCORES}) WHERE score >= 0.25")
def threshold_filter(t):
    return _rounded(R.above(R.cosine_scores(_candidates(t), _query(t), "vec_id", "embedding"), 0.25))


@query(
    """WITH RECURSIVE c AS (SELECT e.vec_id AS id, e.embedding::DOUBLE[] AS v, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s
        FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id <> 0 ORDER BY s DESC, id LIMIT 20),
    m AS (SELECT 1 AS k, [f] AS ids FROM (SELECT arg_max(id, (s, -id)) AS f FROM c)
        UNION ALL
        SELECT g.k + 1, list_append(g.ids, g.best) FROM (SELECT k, ids, arg_max(id, (0.5 * s - 0.5 * alike, s, -id)) AS best FROM (
            SELECT m.k, m.ids, c.id, c.s, max(list_cosine_similarity(c.v, d.v)) AS alike
            FROM m JOIN c ON NOT list_contains(m.ids, c.id) JOIN c d ON list_contains(m.ids, d.id) WHERE m.k < 5 GROUP BY m.k, m.ids, c.id, c.s) GROUP BY k, ids) g)
    SELECT u.id, u.rank, round(c.s, 6) AS score FROM (SELECT unnest(ids) AS id, unnest(range(1, 6)) AS rank FROM m WHERE k = 5) u JOIN c ON c.id = u.id"""
)
def mmr(t):
    return _rounded(R.mmr(_candidates(t), _query(t), id_col="vec_id"))


@query(f"SELECT id, rank, round(score, 6) AS score FROM ({TEXT_TOP})")
def trigram_topk(t):
    return _rounded(_text(t, 15))


@query(f"SELECT id, rank, round(score, 6) AS score FROM ({TEXT_TOP})")
def trigram_topk_scan(t):
    """Without an index: every text is cut into trigrams."""
    return _rounded(R.trigram_topk(t.documents, TEXT, 15, "doc_id"))


def _fused(k: int) -> str:
    scores = f"SELECT coalesce(v.id, t.id) AS id, v.rank AS vector_rank, t.rank AS text_rank, coalesce(0.7 / (60 + v.rank), 0) + coalesce((1 - 0.7) / (60 + t.rank), 0) AS score FROM ({VECTOR_TOP}) v FULL JOIN ({TEXT_TOP}) t ON v.id = t.id"
    return f"SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ({scores}) ORDER BY score DESC, id LIMIT {k}"


@query(f"SELECT id, vector_rank, text_rank, round(score, 6) AS score, rank FROM ({_fused(30)})")
def rrf_fusion(t):
    return _rounded(R.fuse(_vector(t, 15), _text(t, 15), 30))


@query(f"SELECT id, rank, round(score, 6) AS score FROM ({_fused(5)})")
def hybrid_search(t):
    return _rounded(_mixed(t, 5)).select("id", "rank", "score")


@query(f"SELECT id FROM ({VECTOR_TOP}) UNION SELECT id FROM ({TEXT_TOP})")
def candidate_union(t):
    return _vector(t, 15).select("id").union(_text(t, 15).select("id")).distinct()


@query(f"SELECT r.id AS doc_id, r.rank, round(r.score, 6) AS score, d.text, d.lang, d.source FROM ({TEXT_TOP}) r JOIN documents d ON d.doc_id = r.id")
def late_materialize(t):
    return _rounded(R.late(_text(t, 15), t.documents.select("doc_id", "text", "lang", "source"), "doc_id")).select("doc_id", "rank", "score", "text", "lang", "source")


_RETRIEVED = f"SELECT r.id, r.rank, r.score, d.text AS chunk_text, d.source AS ticker, d.lang AS filing_type FROM ({_ranked(SCORES, 15)}) r JOIN documents d ON d.doc_id = r.id WHERE r.score >= 0.25"


def _retrieved(t):
    kept = R.above(_vector(t, 15), 0.25)
    rows = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("chunk_text"), F.col("source").alias("ticker"), F.col("lang").alias("filing_type"))
    return R.late(kept, rows)


@query(f"SELECT id, rank, round(score, 6) AS score FROM ({_RETRIEVED})")
def retrieve(t):
    return _rounded(_retrieved(t)).select("id", "rank", "score")


@query(f"SELECT id, rank, round(score, 6) AS score, chunk_text AS content, upper(ticker) AS ticker, filing_type, length(chunk_text) AS n_chars FROM ({_RETRIEVED})")
def retrieve_project(t):
    return _rounded(_retrieved(t)).select("id", "rank", "score", F.col("chunk_text").alias("content"), F.upper("ticker").alias("ticker"), "filing_type", F.length("chunk_text").cast("long").alias("n_chars"))


@query(
    f"""WITH s AS ({_ranked(SCORES, 5)}), h AS ({_fused(5)}), b AS (SELECT max(score) AS best FROM s)
    SELECT id, rank, round(score, 6) AS score, search_type FROM (
        SELECT id, rank, score, 'similarity' AS search_type FROM s, b WHERE best >= 0.7 AND score >= 0.7 UNION ALL SELECT id, rank, score, 'hybrid' FROM h, b WHERE best < 0.7 OR best IS NULL)"""
)
def auto_upgrade(t):
    return _rounded(R.upgraded(_vector(t, 5), lambda: _mixed(t, 5), R.THRESHOLD))


@query(f"SELECT id, label, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS rank FROM ({SCORES}) WHERE label IN (0, 1, 2)) WHERE rank <= 2")
def compare_years(t):
    scored = _candidates(t).filter(F.col("label").isin(0, 1, 2))
    scored = scored.select(F.col("vec_id").alias("id"), "label", R.cosine(F.col("embedding"), _query(t)).alias("score"))
    return _rounded(R.per_group_topk(scored, "label", 2))


_COUNT = "len(list_filter(regexp_split_to_array(d.text, '\\s+'), lambda w: w <> ''))"
_PACKED = f"SELECT * FROM (SELECT r.id, r.rank, r.score, d.text, d.source, d.lang, {_COUNT} AS n_tokens, sum({_COUNT}) OVER (ORDER BY r.rank ROWS UNBOUNDED PRECEDING)::BIGINT AS used_tokens FROM ({TEXT_TOP}) r JOIN documents d ON d.doc_id = r.id) WHERE used_tokens <= 1000"


def _packed(t):
    from ..functions.text import tokens

    rows = R.late(_text(t, 15), t.documents.select("doc_id", "text", "source", "lang"), "doc_id").withColumn("n_tokens", F.size(tokens(F.col("text"))).cast("long"))
    return R.within_budget(rows, "n_tokens", 1000)


@query(f"SELECT id AS doc_id, rank, n_tokens, used_tokens FROM ({_PACKED})")
def context_budget(t):
    return _packed(t).select("doc_id", "rank", "n_tokens", "used_tokens")


@query(f"SELECT string_agg('[Source: ' || source || ' ' || lang || ' FYNone — General (score=' || format('{{:.3f}}', score) || ')]' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM ({_PACKED})")
def context_string(t):
    none = F.lit(None).cast("string")
    head = R.header(F.col("source"), F.col("lang"), none, none, F.col("score"))
    return R.joined_context(_packed(t).withColumn("block", F.concat(head, F.lit("\n"), F.col("text"))), "block")


_HEAD = "'[Source: ' || ticker || ' ' || filing_type || ' FY' || fiscal_year || ' — General (score=' || format('{:.3f}', score) || ')]' || chr(10) || chunk_text"
_OWN_CHUNKS = "SELECT doc_id AS id, text AS chunk_text, upper(source) AS ticker, lang AS filing_type, label AS fiscal_year FROM documents JOIN embeddings ON vec_id = doc_id WHERE vec_id <> 0"


def _chunks(t):
    """Documents with the vector of their number as chunks; the label stands for the year."""
    vectors = _candidates(t).select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("fiscal_year"))
    texts = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("chunk_text"), F.upper("source").alias("ticker"), F.col("lang").alias("filing_type"), F.lit(None).cast("string").alias("section"))
    return vectors.join(texts, "id")


def _answers(ranked: str, search_type: str, budget: int) -> str:
    used = f"SELECT * FROM (SELECT r.id, r.rank, r.score, c.chunk_text, c.ticker, c.filing_type, c.fiscal_year, sum({_COUNT.replace('d.text', 'c.chunk_text')}) OVER (ORDER BY r.rank ROWS UNBOUNDED PRECEDING) AS used FROM ({ranked}) r JOIN ({_OWN_CHUNKS}) c ON c.id = r.id) WHERE used <= {budget}"
    return f"""SELECT '{TEXT}' AS question, '[LLM unavailable — returning raw context]' || chr(10) || chr(10) || (SELECT coalesce(string_agg({_HEAD}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank), '') FROM ({used})) AS answer,
    'analyst' AS analysis_style, '{search_type}' AS search_type, 'query_engine' AS agent_type, (SELECT string_agg(id::VARCHAR, ',' ORDER BY rank) FROM ({ranked})) AS sources"""


def _asked(t, threshold: float, budget: int, **filters):
    from .pipeline import Retriever

    out = Retriever(_chunks(t), threshold, budget, _postings(t)).ask(TEXT, _query(t), style="poet", **filters)
    return out.withColumn("sources", F.array_join(F.transform("source_chunk_ids", lambda x: x.cast("string")), ",")).drop("source_chunk_ids")


_IN_CHUNKS = f"SELECT id, score FROM ({SCORES}) WHERE id IN (SELECT id FROM ({_OWN_CHUNKS}))"


@query(_answers(_ranked(_IN_CHUNKS, 5), "similarity", 1500))
def full_query(t):
    """A question, answered with its context: the best similarity is enough."""
    return _asked(t, 0.1, 1500)


_MIDDLE = f"SELECT avg(score) FROM (SELECT score FROM ({_ranked(_IN_CHUNKS, 5)}) WHERE rank IN (3, 4))"


def _middle(t) -> float:
    """A threshold that parts the five best: halfway between the third and the fourth."""
    return R.cosine_topk(_chunks(t), _query(t), 5).filter("rank IN (3, 4)").agg(F.avg("score")).first()[0]


@query(_answers(f"SELECT * FROM ({_ranked(_IN_CHUNKS, 5)}) WHERE score >= ({_MIDDLE})", "similarity", 6000))
def full_query_threshold(t):
    """The best similarities are enough, those of lower ranks are not: only the former are cited and in the context."""
    return _asked(t, _middle(t), 6000)


@query(f"SELECT id, rank, round(score, 6) AS score, 'similarity' AS search_type FROM ({_ranked(_IN_CHUNKS, 5)}) WHERE score >= ({_MIDDLE})")
def auto_upgrade_threshold(t):
    """The list of a question that stays a similarity search, cut at the threshold."""
    from .pipeline import Retriever

    return _rounded(Retriever(_chunks(t), _middle(t)).found(_query(t), TEXT))


_SHA_CHUNKS = f"SELECT sha256(c.id::VARCHAR) AS id, e.embedding::DOUBLE[] AS v FROM ({_OWN_CHUNKS}) c JOIN embeddings e ON e.vec_id = c.id"
_SHA_MMR = f"""WITH RECURSIVE c AS (SELECT x.id, x.v, list_cosine_similarity(x.v, q.embedding::DOUBLE[]) AS s FROM ({_SHA_CHUNKS}) x, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY s DESC, id LIMIT 20),
    m AS (SELECT 1 AS k, [f] AS ids FROM (SELECT arg_max(id, s) AS f FROM c)
        UNION ALL
        SELECT g.k + 1, list_append(g.ids, g.best) FROM (SELECT k, ids, arg_max(id, (0.5 * s - 0.5 * alike, s)) AS best FROM (
            SELECT m.k, m.ids, c.id, c.s, max(list_cosine_similarity(c.v, d.v)) AS alike
            FROM m JOIN c ON NOT list_contains(m.ids, c.id) JOIN c d ON list_contains(m.ids, d.id) WHERE m.k < 5 GROUP BY m.k, m.ids, c.id, c.s) GROUP BY k, ids) g),
    u AS (SELECT u.id, u.rank, c.s AS score FROM (SELECT unnest(ids) AS id, unnest(range(1, 6)) AS rank FROM m WHERE k = 5) u JOIN c ON c.id = u.id)"""


@query(f"{_SHA_MMR} SELECT id, rank, round(score, 6) AS score FROM u WHERE score >= (SELECT median(score) FROM u)")
def mmr_search(t):
    """A diversified search of chunks whose ids are SHA-256 strings, as chunk rows have; the threshold is the median of the five."""
    from .pipeline import Retriever

    chunks = _chunks(t).withColumn("id", F.sha2(F.col("id").cast("string"), 256))
    five = R.mmr(chunks, _query(t))
    return _rounded(Retriever(chunks, five.agg(F.median("score")).first()[0]).search(_query(t), TEXT, "mmr"))


_IN_POOL = f"id IN (SELECT id FROM ({_OWN_CHUNKS}) WHERE fiscal_year = 1)"
_POOL_FUSED = f"""SELECT coalesce(v.id, t.id) AS id, coalesce(0.7 / (60 + v.rank), 0) + coalesce((1 - 0.7) / (60 + t.rank), 0) AS score
    FROM ({_ranked(f"SELECT id, score FROM ({SCORES}) WHERE {_IN_POOL}", 15)}) v FULL JOIN ({_ranked(f"SELECT id, score FROM ({_TEXT_SCORES}) WHERE {_IN_POOL}", 15)}) t ON v.id = t.id"""


@query(_answers(_ranked(_POOL_FUSED, 5), "hybrid", 3000))
def full_query_upgraded(t):
    """The same within a year, where no similarity reaches the threshold: the search becomes hybrid."""
    return _asked(t, 0.99, 3000, fiscal_year=1)


@query(
    f"""WITH r AS (SELECT s.id, s.score, c.fiscal_year, c.chunk_text, c.ticker, c.filing_type, row_number() OVER (PARTITION BY c.fiscal_year ORDER BY s.score DESC, s.id) AS rank FROM ({SCORES}) s JOIN ({_OWN_CHUNKS}) c ON c.id = s.id WHERE c.fiscal_year IN (2, 1, 3)),
    y AS (SELECT fiscal_year, '=== FY' || fiscal_year || ' ===' || chr(10) || string_agg({_HEAD}, chr(10) ORDER BY rank) AS part FROM r WHERE rank <= 2 GROUP BY fiscal_year)
    SELECT string_agg(part, chr(10) || chr(10) ORDER BY list_position([2, 1, 3], fiscal_year)) AS context, (SELECT string_agg(id::VARCHAR, ',' ORDER BY id) FROM r WHERE rank <= 5) AS sources FROM y"""
)
def compare_contexts(t):
    """Four years are asked for, three are compared, two chunks of each are shown, five are sources."""
    from .pipeline import Retriever

    context, sources = Retriever(_chunks(t), -1.0).compare(_query(t), TEXT, [2, 1, 3, 4])
    ids = sources.agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("sources"))
    return context.crossJoin(ids)


@query(f"SELECT coalesce(string_agg({_HEAD}, chr(10) || chr(10) ORDER BY rank), 'No comparative data found.') AS context FROM (SELECT r.*, c.chunk_text, c.ticker, c.filing_type, c.fiscal_year FROM ({_ranked(_IN_CHUNKS, 5)}) r JOIN ({_OWN_CHUNKS}) c ON c.id = r.id WHERE r.score >= ({_MIDDLE}))")
def compare_without_years(t):
    """One search, whose blocks above the threshold are the context."""
    from .pipeline import Retriever

    return Retriever(_chunks(t), _middle(t)).compare(_query(t), TEXT, [])[0]


@query("SELECT 'search' AS tool, 'No relevant information found for this query.' AS context UNION ALL SELECT 'compare', 'No comparative data found.' UNION ALL SELECT 'compare years', 'No comparative data found.' WHERE (SELECT count(*) FROM embeddings WHERE label = -1) = 0")
def tools_without_hits(t):
    """A ticker that nobody has: the tools say so."""
    from .pipeline import Retriever

    r, q = Retriever(_chunks(t)), _query(t)
    found = (("search", r.tool_search(q, TEXT, {"ticker": "nobody"}, {})), ("compare", r.compare(q, TEXT, [], ticker="nobody")), ("compare years", r.compare(q, TEXT, [-1, -2])))
    out = None
    for tool, (context, _) in found:
        one = context.select(F.lit(tool).alias("tool"), "context")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT string_agg({_HEAD}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)[:500] AS result FROM (SELECT s.*, row_number() OVER (ORDER BY score DESC, s.id) AS rank FROM (SELECT s.id, s.score, c.chunk_text, c.ticker, c.filing_type, c.fiscal_year FROM ({SCORES}) s JOIN ({_OWN_CHUNKS}) c ON c.id = s.id WHERE c.fiscal_year = 1) s) WHERE rank <= 5")
def tool_search(t):
    """The year is the default's, as the arguments leave it empty; the result is cut to 500 characters."""
    from .pipeline import Retriever

    context, _ = Retriever(_chunks(t), -1.0).tool_search(_query(t), TEXT, {"fiscal_year": 0}, {"fiscal_year": 1})
    return context.select(R.shortened(F.col("context")).alias("result"))


@query(
    """SELECT h.source AS session_id, count(*) AS n_sources, sum(l.toxic)::BIGINT AS n_toxic
    FROM (SELECT source, unnest(ids) AS id FROM (SELECT source, list(doc_id) AS ids FROM documents GROUP BY source)) h JOIN labels l ON l.doc_id = h.id GROUP BY h.source"""
)
def provenance_join(t):
    """Beyond the surveyed operators: an audit log's lists of source ids, joined to what is known of the sources."""
    log = t.documents.groupBy("source").agg(F.collect_list("doc_id").alias("source_chunk_ids"))
    cited = log.select(F.col("source").alias("session_id"), F.explode("source_chunk_ids").alias("doc_id"))
    return cited.join(t.labels, "doc_id").groupBy("session_id").agg(F.count("*").alias("n_sources"), F.sum("toxic").alias("n_toxic"))
