"""The two pipelines of the store: filings to chunks, questions to context."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as X
from ..operators import retrieval as R
from ..operators import store as S
from ..schemas import STYLES
from .text_queries import chunked


def chunks_of(filings: DataFrame, tokenizer: X.Tokenizer = X.WHITE_SPACE, size: int = 512, overlap: int = 50, model_version: str | None = None) -> DataFrame:
    """Chunk rows of parsed filings (filing_id, sections array of (name, text), and ticker, filing_type, fiscal_year where known).

    chunk_index counts through the whole filing; blank sections are skipped; a section
    that is one chunk keeps its text as it is.  A filing without sections is an error
    when its rows are read.  Chunk ids follow from filing and index, so a filing that
    comes again upserts its own chunks.
    """
    none = F.raise_error(F.concat(F.lit("no sections in filing "), F.col("filing_id").cast("string")))
    some = F.when(F.coalesce(F.size("sections"), F.lit(0)) < 1, none).otherwise(F.col("sections"))
    parts = filings.select(_about(filings, F.col("filing_id")).alias("__of"), F.posexplode(some).alias("pos", "s"))
    return _chunk_rows(parts.select("__of", "pos", F.col("s.name").alias("section"), F.col("s.text").alias("text")), tokenizer, size, overlap, model_version)


def _about(filings: DataFrame, filing_id: Column) -> Column:
    """What every chunk says about its filing."""
    known = (("ticker", "string"), ("filing_type", "string"), ("fiscal_year", "int"))
    return F.struct(filing_id.alias("filing_id"), *((F.col(c) if c in filings.columns else F.lit(None)).cast(kind).alias(c) for c, kind in known))


def _chunk_rows(parts: DataFrame, tokenizer: X.Tokenizer, size: int, overlap: int, model_version: str | None) -> DataFrame:
    """Chunk rows of sections (__of, pos, section, text); only chunks move, to be counted through their filing."""
    some = parts.filter(F.regexp_replace("text", r"(?U)\s", "") != "").select(F.struct("__of", "pos", "section").alias("__part"), "text")
    cut = chunked(some, "__part", "text", size, overlap, tokenizer=tokenizer)
    through = Window.partitionBy("__part.__of.filing_id").orderBy("__part.pos", "chunk_index")
    index = (F.row_number().over(through) - 1).cast("long").alias("chunk_index")
    out = cut.select("__part.__of.*", "__part.pos", "__part.section", index, "chunk_text", "token_count", X.extract_metrics(F.col("chunk_text")).alias("metrics"), F.lit(model_version).cast("string").alias("model_version"))
    return out.withColumn("id", F.sha2(F.concat_ws("|", "filing_id", "chunk_index"), 256))


def filings_to_chunks(pages: DataFrame, stored_hashes: DataFrame, embed: Column | Callable | None = None, id_col: str = "page_id", html_col: str = "html", size: int = 512, overlap: int = 50, tokenizer: X.Tokenizer = X.WHITE_SPACE, model_version: str | None = None) -> DataFrame:
    """chunks_of() pages that are new by content; known pages leave before anything is parsed.  embed: a function of a text column, or a column over chunk_text."""
    hashed = pages.withColumn("file_hash", S.content_hash(F.col(html_col)))
    fresh = S.ingest(hashed, stored_hashes, order=id_col)
    read = fresh.select(_about(fresh, F.col(id_col)).alias("__of"), H.html_text(F.col(html_col)).alias("text"))
    parts = H.section_arrays(read, "text").select("__of", F.posexplode("sections").alias("pos", "s"))
    cleaned = parts.select("__of", "pos", F.col("s.name").alias("section"), X.clean(F.col("s.text")).alias("text"))
    out = _chunk_rows(cleaned, tokenizer, size, overlap, model_version)
    if embed is None:
        return out
    return out.withColumn("embedding", embed(F.col("chunk_text")) if not isinstance(embed, Column) else embed)


#: Answers without a language model, and without sources.
RAW_ANSWER = "[LLM unavailable — returning raw context]\n\n"
NO_ANSWER = "I could not find relevant information in the available financial documents to answer this question. Please ensure the relevant filings have been ingested."
#: What the tools say where nothing is found.
NOTHING_FOUND, NOTHING_TO_COMPARE = "No relevant information found for this query.", "No comparative data found."
STYLE = "analyst"


class Retriever:
    """Questions over a table of chunks (id, embedding, chunk_text, ticker, filing_type, fiscal_year, section).

    index: postings of the chunks' trigrams (see retrieval.trigram_postings), which spare
    a hybrid search the scan of all texts; tokenizer: what the budget is counted in.
    """

    def __init__(self, chunks: DataFrame, threshold: float = R.THRESHOLD, budget: int = R.BUDGET, index: DataFrame | None = None, tokenizer: X.Tokenizer = X.WHITE_SPACE) -> None:
        self.chunks, self.threshold, self.budget, self.index, self.tokenizer = chunks, threshold, budget, index, tokenizer

    def _pool(self, ticker: str = "", filing_type: str = "", fiscal_year: int = 0, section: str = "") -> DataFrame:
        return R.where(self.chunks, upper_ticker=ticker, filing_type=filing_type, fiscal_year=fiscal_year, section=section)

    def _hybrid(self, pool: DataFrame, query: Sequence[float], words: str, k: int) -> DataFrame:
        among = None if pool is self.chunks else pool.select("id")
        return R.hybrid(pool, pool, query, words, k, text_col="chunk_text", index=self.index, among=among).select("id", "rank", "score")

    def search(self, query: Sequence[float], words: str, search_type: str = "similarity", k: int = R.TOP_K, **filters: object) -> DataFrame:
        """(id, rank, score): similarity and the diversified mmr keep what reaches the threshold, hybrid fuses with trigrams; filters hold for all three."""
        pool = self._pool(**filters)
        if search_type == "mmr":
            return R.above(R.mmr(pool, query, k), self.threshold)
        if search_type == "hybrid":
            return self._hybrid(pool, query, words, k)
        if search_type != "similarity":
            raise ValueError(f"search_type: similarity, mmr or hybrid, not {search_type}")
        return R.above(R.cosine_topk(pool, query, k), self.threshold)

    def found(self, query: Sequence[float], words: str, search_type: str = "similarity", k: int = R.TOP_K, **filters: object) -> DataFrame:
        """(id, rank, score, search_type): search(), but a similarity search whose best score is below the threshold becomes a hybrid one."""
        if search_type != "similarity":
            return self.search(query, words, search_type, k, **filters).select("id", "rank", "score", F.lit(search_type).alias("search_type"))
        pool = self._pool(**filters)
        return R.upgraded(R.cosine_topk(pool, query, k), lambda: self._hybrid(pool, query, words, k), self.threshold)

    @staticmethod
    def _few(found: DataFrame) -> DataFrame:
        """What was found, a few rows by the searches' limits, so that what uses it doesn't search again."""
        return found.sparkSession.createDataFrame(found.collect(), found.schema)

    def blocks(self, found: DataFrame) -> DataFrame:
        """The found chunks with ``block``, their texts under their headers; only the found ids leave the tables that the chunks are joined from."""
        few = self._few(found)
        own = self.chunks.filter(F.col("id").isin([r["id"] for r in few.select("id").distinct().collect()]))
        rows = R.late(few, own.select("id", "chunk_text", "ticker", "filing_type", "fiscal_year", "section"))
        head = R.header(F.col("ticker"), F.col("filing_type"), F.col("fiscal_year"), F.col("section"), F.col("score"))
        return rows.withColumn("block", F.concat(head, F.lit("\n"), F.col("chunk_text")))

    def context(self, found: DataFrame) -> DataFrame:
        """One row: the blocks of what was found, as many as the budget takes."""
        rows = self.blocks(found).withColumn("n", F.size(self.tokenizer.split(F.col("chunk_text"))))
        return R.joined_context(R.within_budget(rows, "n", self.budget), "block")

    def ask(self, question: str, query: Sequence[float], search_type: str = "similarity", style: str = STYLE, k: int = R.TOP_K, answer: Callable[[str, str, str], str] | None = None, **filters: object) -> DataFrame:
        """One row: question, answer, analysis_style, search_type, agent_type, source_chunk_ids.

        query: the question's vector; answer: a function of question, style and context
        (without one the context is the answer); an unknown style is the analyst's.
        """
        if not question or not question.strip():
            raise ValueError("a question is needed")
        style = style if style in STYLES else STYLE
        found = self._few(self.found(query, question, search_type, k, **filters))
        by_rank = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "search_type"))), lambda x: x["id"])
        used = found.agg(by_rank.alias("source_chunk_ids"), F.max("search_type").alias("search_type"))
        context = self.context(found)
        if answer is not None:
            text = F.lit(answer(question, style, context.first()[0]))
        else:
            text = F.concat(F.lit(RAW_ANSWER), F.col("context"))
        out = used.crossJoin(context)  # one row each
        return out.select(
            F.lit(question).alias("question"), F.when(F.size("source_chunk_ids") > 0, text).otherwise(F.lit(NO_ANSWER)).alias("answer"), F.lit(style).alias("analysis_style"),
            F.coalesce("search_type", F.lit(search_type)).alias("search_type"), F.lit("query_engine").alias("agent_type"), "source_chunk_ids",
        )

    def tool_search(self, query: Sequence[float], words: str, args: dict, defaults: dict) -> tuple[DataFrame, DataFrame]:
        """(one row ``context`` of all that a similarity search finds, its sources): a filter that args leave out or empty is the default's, sections have none."""
        filters = {c: args.get(c) or defaults.get(c) for c in ("ticker", "fiscal_year")} | {"section": args.get("section")}
        found = self.found(query, words, **{c: v for c, v in filters.items() if v})
        return R.joined_context(self.blocks(found), "block", nothing=NOTHING_FOUND), found

    def compare(self, query: Sequence[float], words: str, years: Sequence[int], most: int = 3, **filters: object) -> tuple[DataFrame, DataFrame]:
        """(one row ``context`` with the two best of each of the first ``most`` years, all sources): at most that many searches; without years one search, all of whose blocks are the context."""
        out = None
        for nth, year in enumerate(years[:most]):
            one = self.found(query, words, fiscal_year=year, **filters).withColumn("nth", F.lit(nth))
            out = one if out is None else out.unionByName(one)
        if out is None:
            found = self.found(query, words, **filters)
            return R.joined_context(self.blocks(found), "block", "\n\n", NOTHING_TO_COMPARE), found
        return R.year_context(self.blocks(out), "block", nothing=NOTHING_TO_COMPARE), out
