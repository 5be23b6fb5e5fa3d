"""Text, HTML and chunk queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as X
from .registry import query

#: Sentences with figures, as the documents hardly have any; joined to the documents where a query is about numbers.
SAMPLES = (
    (-1, "Total revenue was $394.3 billion, up 12.5 % from $1,234,567 million."),
    (-2, "Earnings per diluted share was $6.13 and net income of $96.2 billion."),
    (-3, "Revenue of $"),
    (-4, "Revenue, then none"),
    (-5, "The operating margin of 30.1 % held; net loss $12 thousand."),
    (-6, "head\n - 42 - \nContents.......... 17\n==========\ntail----------"),
)
_VALUES = ", ".join(f"({i}, '{s}')" for i, s in SAMPLES).replace("\n", "' || chr(10) || '")
_TEXTS = f"(SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {_VALUES}) v(doc_id, text))"


def _texts(t):
    return t.documents.select("doc_id", "text").unionByName(t.spark.createDataFrame(list(SAMPLES), "doc_id long, text string"))


@query(f"SELECT doc_id, regexp_replace(replace(regexp_replace(text, '\\$\\s*', '', 'g'), ',', ''), '(\\d)\\s+%', '\\1%', 'g') AS text FROM {_TEXTS}")
def normalise_numbers(t):
    return _texts(t).select("doc_id", X.normalise_numbers(F.col("text")).alias("text"))


def _metric_sql(name: str) -> str:
    pattern = X.METRICS[name].removeprefix("(?i)")
    number = f"TRY_CAST(nullif(replace(regexp_extract(text, '{pattern}', 1, 'i'), ',', ''), '') AS DOUBLE)"
    if "billion" not in pattern:
        return f"{number} AS {name}"
    word = f"lower(regexp_extract(text, '{pattern}', 2, 'i'))"
    return f"{number} * CASE {word} WHEN 'billion' THEN 1e9 WHEN 'million' THEN 1e6 WHEN 'thousand' THEN 1e3 ELSE 1 END AS {name}"


@query(f"SELECT doc_id, {', '.join(map(_metric_sql, X.METRICS))} FROM {_TEXTS}")
def extract_metrics(t):
    found = _texts(t).select("doc_id", X.extract_metrics(F.col("text")).alias("m"))
    return found.select("doc_id", *(F.col("m")[name].alias(name) for name in X.METRICS))


def _boilerplate_sql() -> str:
    out = "text"
    for pattern in X.BOILERPLATE:
        out = f"regexp_replace({out}, '{pattern.removeprefix('(?s)')}', chr(10), 'gs')"
    return f"regexp_replace({out}, '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT doc_id, {_boilerplate_sql()} AS text FROM {_TEXTS}")
def boilerplate(t):
    return _texts(t).select("doc_id", X.drop_boilerplate(F.col("text")).alias("text"))


#: Texts with headings, as the documents have none.
REPORTS = (
    (-1, "intro\nItem 7. Management's Discussion and Analysis\nwe did well and will do better than ever before, we think\n  RISK   FACTORS  \ntoo short\nRisk Factors\nmany things can go wrong, and some of them will, as they always do\nproperties\nnone"),
    (-2, "Cash flow and balance sheet\n" + "cash came in and went out again. " * 3 + "\nLegal proceedings\n" + "we are sued by many. " * 4 + "\ncash flow\n" + "again, but the first counts. " * 3),
    (-3, "no heading at all"),
    (-4, "x" * 600 + " risk factors " + "\n" + "a line of more than 500 characters is no heading. " * 2),
)


def _reports(t):
    return t.documents.select("doc_id", "text").unionByName(t.spark.createDataFrame(list(REPORTS), "doc_id long, text string"))


def _section_sql() -> str:
    quoted = lambda x: x.replace("'", "''")
    values = ", ".join("(%d, '%s')" % (i, quoted(x)) for i, x in REPORTS)
    cases = " ".join(f"WHEN regexp_matches(trim(line), '{quoted(p)}', 'i') THEN '{quoted(n)}'" for n, p in H.SECTIONS)
    return f"""WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {values}) v(doc_id, text))),
    l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS line_no FROM d),
    h AS (SELECT doc_id, line_no, CASE {cases} END AS name FROM l WHERE length(trim(line)) BETWEEN 1 AND 500),
    s AS (SELECT doc_id, name, line_no, coalesce(lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no), 1000000000) AS stop FROM h WHERE name IS NOT NULL),
    x AS (SELECT s.doc_id, s.name, s.line_no, regexp_replace(string_agg(line, chr(10) ORDER BY l.line_no), '^\\s+|\\s+$', '', 'g') AS body FROM s JOIN l ON l.doc_id = s.doc_id AND l.line_no >= s.line_no AND l.line_no < s.stop GROUP BY ALL),
    k AS (SELECT * FROM x WHERE length(body) >= 50 QUALIFY row_number() OVER (PARTITION BY doc_id, name ORDER BY line_no) = 1)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS pos, name, body AS section_text FROM k UNION ALL SELECT doc_id, 0, 'General', text FROM d WHERE doc_id NOT IN (SELECT doc_id FROM k)"""


_SECTIONS = _section_sql()


@query(_SECTIONS)
def section_detect(t):
    return H.sections(_reports(t), "doc_id", "text")


@query(f"SELECT r.doc_id, s.section_text AS risks FROM (SELECT DISTINCT doc_id FROM ({_SECTIONS})) r LEFT JOIN ({_SECTIONS}) s ON s.doc_id = r.doc_id AND s.name = 'Risk Factors'")
def section_by_name(t):
    return H.section_arrays(_reports(t), "text").select("doc_id", H.section_text(F.col("sections"), "Risk Factors").alias("risks"))


@query(f"SELECT name, count(*) AS n, sum(length(section_text))::BIGINT AS n_chars, max(length(section_text)) AS longest FROM ({_SECTIONS}) GROUP BY name")
def section_stats(t):
    n = F.length("section_text").cast("long")
    return H.sections(_reports(t), "doc_id", "text").groupBy("name").agg(F.count("*").alias("n"), F.sum(n).alias("n_chars"), F.max(n).alias("longest"))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n_tokens FROM documents")
def token_count(t):
    return t.documents.select("doc_id", F.size(X.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query(
    """SELECT source, n_tokens, round(n_tokens / 1e6 * 0.02, 4) AS cost_small, round(n_tokens / 1e6 * 0.13, 4) AS cost_large FROM (
    SELECT source, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')))::BIGINT AS n_tokens FROM documents GROUP BY source)"""
)
def token_cost(t):
    n = t.documents.groupBy("source").agg(F.sum(F.size(X.tokens(F.col("text")))).alias("n_tokens"))
    cost = lambda rate: F.round(F.col("n_tokens") / 1e6 * rate, 4)
    return n.select("source", "n_tokens", cost(0.02).alias("cost_small"), cost(0.13).alias("cost_large"))


_CHUNKS = """WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM documents),
    s AS (SELECT doc_id, text, ws, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) <= 512 THEN [0] ELSE range(0, len(ws), 462) END) AS st FROM w),
    c AS (SELECT doc_id, st // 462 AS chunk_index, list_slice(ws, st + 1, st + 512) AS part, text, len(ws) <= 512 AS whole FROM s),
    t AS (SELECT doc_id, chunk_index, CASE WHEN whole THEN text ELSE array_to_string(part, ' ') END AS chunk_text, len(part) AS token_count, whole FROM c),
    k AS (SELECT *, min(CASE WHEN length(chunk_text) < 50 AND NOT whole THEN chunk_index END) OVER (PARTITION BY doc_id) AS stop FROM t)
    SELECT doc_id, chunk_index, token_count, chunk_text FROM k WHERE stop IS NULL OR chunk_index < stop"""


def chunked(docs, id_col: str, text_col: str, size: int = 512, overlap: int = 50, least: int = 50, tokenizer: X.Tokenizer = X.WHITE_SPACE):
    """(id, chunk_index, token_count, chunk_text): windows of tokens; in longer texts the first of under ``least`` characters ends the list, a text of one window stays as it is."""
    windows = F.transform(X.token_windows(F.col("ws"), size, overlap), lambda w: F.struct(tokenizer.join(w).alias("text"), F.size(w).alias("n")))
    split = docs.select(id_col, F.col(text_col).alias("__text"), tokenizer.split(F.col(text_col)).alias("ws"))
    one = F.array(F.struct(F.col("__text").alias("text"), F.size("ws").alias("n")))
    cut = split.select(id_col, F.when((F.size("ws") > 0) & (F.size("ws") <= size), one).otherwise(windows).alias("c"), (F.size("ws") <= size).alias("whole"))
    short = F.array_position(F.transform("c", lambda x: F.length(F.regexp_replace(x["text"], r"(?U)^\s+|\s+$", "")) < least), F.lit(True))
    kept = F.when(F.col("whole") | (short == 0), F.col("c")).otherwise(F.slice("c", F.lit(1), (short - 1).cast("int")))
    out = cut.select(id_col, F.posexplode(kept).alias("pos", "x"))
    return out.select(id_col, F.col("pos").cast("long").alias("chunk_index"), F.col("x.n").cast("long").alias("token_count"), F.col("x.text").alias("chunk_text"))


@query(_CHUNKS)
def chunk_tokens(t):
    return chunked(t.documents, "doc_id", "text")


def _tidy_sql(text: str) -> str:
    """Single blanks, stripped lines, at most two blank ones in a row: the white space of these tables is blanks and newlines."""
    out = f"regexp_replace({text}, ' +', ' ', 'g')"
    out = f"regexp_replace({out}, ' ?\\n ?', chr(10), 'g')"
    out = "regexp_replace(" + out + ", '\\n{4,}', repeat(chr(10), 3), 'g')"
    return f"regexp_replace({out}, '^\\s+|\\s+$', '', 'g')"


def _html_sql() -> str:
    """Well-formed pages as the table has them: what has no readable text goes with all it holds, other elements end text nodes."""
    out = "regexp_replace(html, '^.*?(<html)', '\\1', 'is')"
    for tag in ("head", "script", "style", "noscript", "svg", "figure"):
        out = f"regexp_replace({out}, '<{tag}\\b.*?</{tag}\\s*>', '<>', 'gis')"
    out = f"regexp_replace({out}, '<!--.*?-->', '<>', 'gs')"
    out = f"regexp_replace({out}, '(<[^>]*>)+', chr(10), 'g')"
    out = f"regexp_replace({out}, '^\\n|\\n$', '', 'g')"  # before the first and after the last element there is no node
    for name, char in (("middot", "·"), ("copy", "©"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        out = f"replace({out}, '&{name};', '{char}')"
    return f"SELECT page_id, {_boilerplate_sql().replace('regexp_replace(text,', f'regexp_replace({_tidy_sql(out)},', 1)} AS text FROM pages"


_HTML = _html_sql()


def _clean_sql() -> str:
    """Composition suffices here, as no text of the table has characters that are only compatible with others."""
    out = "nfc_normalize(text)"
    for pattern in X.NOISE:
        out = f"regexp_replace({out}, '{pattern}', ' ', 'g')"
    return f"SELECT doc_id, {_tidy_sql(out)} AS text FROM documents"


#: CRC-32 with its table made by eight halvings a byte (reversed polynomial), per distinct word; then signed counts and their length.
_EMBED = """WITH t AS (SELECT list(list_reduce(list_concat([b::UBIGINT], range(8)::UBIGINT[]), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS tab FROM range(256) r(b)),
    w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM documents),
    c AS (SELECT doc_id, word, count(*) AS n FROM w WHERE word <> '' GROUP BY ALL),
    x AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM c)),
    y AS (SELECT word, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::UBIGINT) AS bytes FROM x),
    z AS (SELECT word, xor(list_reduce(list_concat([4294967295::UBIGINT], bytes), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255)::BIGINT + 1])), 4294967295) AS crc FROM y, t),
    v AS (SELECT doc_id, (crc % 64)::BIGINT AS pos, sum(CASE WHEN crc // 64 % 2 = 1 THEN n ELSE -n END)::DOUBLE AS value FROM c JOIN z USING (word) GROUP BY ALL),
    l AS (SELECT doc_id, sqrt(sum(value * value)) AS size FROM v GROUP BY doc_id),
    g AS (SELECT d.doc_id, r.pos FROM documents d, range(64) r(pos))
    SELECT g.doc_id, list(CASE WHEN coalesce(size, 0) = 0 THEN 0 ELSE coalesce(value, 0) / size END::FLOAT ORDER BY g.pos) AS embedding FROM g LEFT JOIN v USING (doc_id, pos) LEFT JOIN l USING (doc_id) GROUP BY g.doc_id"""


@query(_HTML)
def html_text(t):
    return t.pages.select("page_id", H.html_text(F.col("html")).alias("text"))


def _page_sections_sql() -> str:
    start = _SECTIONS.index("FROM (SELECT doc_id, text FROM documents")
    end = _SECTIONS.index("v(doc_id, text))", start) + len("v(doc_id, text))")
    return (_SECTIONS[:start] + f"FROM ({_HTML})" + _SECTIONS[end:]).replace("doc_id", "page_id")


@query(_page_sections_sql())
def page_sections(t):
    return H.sections(t.pages.select("page_id", H.html_text(F.col("html")).alias("text")), "page_id", "text")


def _filing_chunks_sql() -> str:
    """Each text is a filing of three sections: itself, a blank one, and its first 100 characters."""
    parts = "(SELECT doc_id, 0 AS pos, 'A' AS section, text FROM documents UNION ALL SELECT doc_id, 2, 'B', text[:100] FROM documents)"
    cut = _CHUNKS.replace("FROM documents)", f"FROM (SELECT (doc_id, pos, section) AS doc_id, text FROM {parts} WHERE regexp_replace(text, '\\s', '', 'g') <> ''))")
    return f"SELECT doc_id[1] AS filing_id, doc_id[3] AS section, row_number() OVER (PARTITION BY doc_id[1] ORDER BY doc_id[2], chunk_index) - 1 AS chunk_index, token_count, chunk_text, 'T' AS ticker FROM ({cut})"


@query(_filing_chunks_sql())
def filing_chunks(t):
    from .pipeline import chunks_of

    section = lambda name, text: F.struct(F.lit(name).alias("name"), text.alias("text"))
    sections = F.array(section("A", F.col("text")), section("blank", F.lit(" \n")), section("B", F.substring("text", 1, 100)))
    filings = t.documents.select(F.col("doc_id").alias("filing_id"), F.lit("T").alias("ticker"), sections.alias("sections"))
    return chunks_of(filings).select("filing_id", "section", "chunk_index", "token_count", "chunk_text", "ticker")


@query(_clean_sql())
def clean_text(t):
    return t.documents.select("doc_id", X.clean(F.col("text")).alias("text"))


@query(_EMBED)
def embed_hash(t):
    from ..functions.embedding import hash_embedding

    return t.documents.select("doc_id", hash_embedding(F.col("text")).alias("embedding"))


@query("SELECT count(DISTINCT lower(w)) AS exact, true AS close FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM documents) WHERE w <> ''")
def extra_distinct(t):
    """Beyond the surveyed operators: an approximate count of distinct words beside the exact one."""
    words = t.documents.select(F.explode(X.tokens(F.col("text"))).alias("w")).select(F.lower("w").alias("w"))
    out = words.agg(F.count_distinct("w").alias("exact"), F.approx_count_distinct("w", 0.02).alias("about"))
    return out.select("exact", (F.abs(F.col("about") - F.col("exact")) <= 0.1 * F.col("exact")).alias("close"))
