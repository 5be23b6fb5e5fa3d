"""Golden cases of text, HTML, retrieval and store functions."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata import schemas
from lodestrata.functions import html as H
from lodestrata.functions import text as X
from lodestrata.functions.embedding import hash_vectors
from lodestrata.functions.vectors import cosine
from lodestrata.operators import monitoring as M
from lodestrata.operators import retrieval as R
from lodestrata.operators import store as S


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items()) or "x int"
    row = tuple(v for _, v in values.values()) or (1,)
    return spark.createDataFrame([row], schema).select(column.alias("r")).first()[0]


def text_of(spark, f, text):
    return one(spark, f(F.col("t")), t=("string", text))


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Total revenue was $394.3 billion", {"revenue": 3.943e11}),
        ("Earnings per diluted share was $6.13", {"eps": 6.13}),
        ("Revenue of $", {}),
        ("Revenue, then none", {}),
        ("net loss of 12 thousand; operating margin 30.1 %", {"net_income": 12000.0, "margin_pct": 30.1}),
        ("", {}),
    ],
)
def test_metrics(spark, text, expected):
    assert text_of(spark, X.extract_metrics, text) == pytest.approx(expected)


def test_numbers(spark):
    assert text_of(spark, X.normalise_numbers, "$1,234,567 million") == "1234567 million"
    assert text_of(spark, X.normalise_numbers, "12.5 %") == "12.5%"


@pytest.mark.parametrize(
    "text, expected",
    [
        ("see https://example.org/x now", "see now"),
        ("mail a@b.example now", "mail now"),
        ("a\r\nb\rc", "a\nb\nc"),
        ("a\n\n\n\n\nb", "a b"),
        ("a\n \n \n \n \nb", "a\n\n\nb"),
        ("   x  ", "x"),
        ("ﬁn \x07 y", "fin y"),
        ("", ""),
    ],
)
def test_clean(spark, text, expected):
    assert text_of(spark, X.clean, text) == expected
    assert unicodedata.is_normalized("NFKC", expected)


@pytest.mark.parametrize("n, sizes", [(0, []), (1, [1]), (512, [512]), (513, [512, 51]), (924, [512, 462]), (925, [512, 463, 1]), (974, [512, 512, 50]), (1000, [512, 512, 76])])
def test_windows(spark, n, sizes):
    windows = X.token_windows(F.split(F.col("t"), " ") if n else F.array().cast("array<string>"))
    assert one(spark, F.transform(windows, F.size), t=("string", " ".join(["w"] * n))) == sizes


@settings(max_examples=15, deadline=None)
@given(st.integers(1, 60), st.integers(2, 20), st.integers(0, 30))
def test_windows_cover_all_words(spark, n, size, overlap):
    words = [str(i) for i in range(n)]
    got = one(spark, X.token_windows(F.split(F.col("t"), " "), size, overlap), t=("string", " ".join(words)))
    assert overlap >= size or {w for g in got for w in g} == set(words)
    assert overlap < size or len(got) == 1


def test_html(spark):
    page = "<SEC-HEADER>x</SEC-HEADER><HTML><head><title>no</title></head><body><script>var a='</p>';</script><p>One  two<br>three</p>&amp;<style>p{}</style></body></HTML>"
    assert text_of(spark, H.html_text, page) == "One two\nthree\n&"
    for odd in ("", "<p>unclosed <b>bold", "plain"):
        assert isinstance(text_of(spark, H.html_text, odd), str)
    assert text_of(spark, H.html_text, None) is None


def test_sections(spark):
    long = "x" * 60
    text = f"before\nItem 1A. Risk Factors\n{long}\nManagement's Discussion and Analysis\nshort\nRISK FACTORS\nagain {long}\nManagement's Discussion and Analysis\n{long}"
    rows = H.sections(spark.createDataFrame([(1, text), (2, "nothing here"), (3, "")], "id long, t string"), "id", "t").orderBy("id", "pos").collect()
    assert [(r.id, r.name) for r in rows] == [(1, "Risk Factors"), (1, "MD&A"), (2, "General"), (3, "General")]
    assert rows[0].section_text == f"Item 1A. Risk Factors\n{long}"


def test_cosine(spark):
    f = lambda a, b: one(spark, cosine(F.col("a"), F.col("b")), a=("array<float>", a), b=("array<float>", b))
    assert f([1.0, 0.0], [1.0, 1.0]) == pytest.approx(0.5**0.5)
    assert f([0.0, 0.0], [1.0, 1.0]) == 0.0


def test_threshold_drops_nan(spark):
    rows = spark.createDataFrame([(1, 0.9), (2, float("nan")), (3, 0.1), (4, None)], "id long, score double")
    assert [r.id for r in R.above(rows).collect()] == [1]


def test_fusion(spark):
    v = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, rank long")
    t = spark.createDataFrame([("b", 1), ("d", 2)], "id string, rank long")
    got = [(r.id, round(r.score, 6)) for r in R.fuse(v, t, 10).orderBy("rank").collect()]
    assert got == [("b", 0.016208), ("a", 0.011475), ("c", 0.011111), ("d", 0.004839)]


def test_budget_stops_at_the_first_overflow(spark):
    rows = spark.createDataFrame([(1, 3000), (2, 2500), (3, 900), (4, 100)], "rank int, n int")
    assert [r["rank"] for r in R.within_budget(rows, "n").orderBy("rank").collect()] == [1, 2]


def test_header(spark):
    none = F.lit(None).cast("string")
    got = one(spark, R.header(F.lit("AAA"), F.lit("10-K"), none, none, F.lit(0.85)))
    assert got == "[Source: AAA 10-K FYNone — General (score=0.850)]"


def test_mmr_golden(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = e.filter("vec_id = 0").first()["embedding"]
    rows = R.mmr(e.filter("vec_id <> 0"), q, id_col="vec_id").orderBy("rank").collect()
    assert [r.id for r in rows] == [365, 344, 483, 165, 388]


def test_optional_filters(spark):
    rows = spark.createDataFrame([("AB", 2020), ("AB", 0), ("CD", 2020)], "ticker string, year int")
    assert R.where(rows, upper_ticker="ab", year=0).count() == 2
    assert R.where(rows, ticker="", year=2020).count() == 2


def test_newest_first_with_null(spark):
    rows = spark.createDataFrame([(1, 2020), (2, None), (3, 2023)], "id long, y int")
    assert [r.y for r in S.page(rows, (F.col("y").desc_nulls_first(), "id"), 3).collect()] == [None, 2023, 2020]


def test_upsert_keeps_other_columns(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id long, t string, n int")
    new = spark.createDataFrame([(2, "B", 99), (3, "c", 30)], "id long, t string, n int")
    assert sorted(map(tuple, S.upsert(old, new, "id", ("t",)).collect())) == [(1, "a", 10), (2, "B", 20), (3, "c", 30)]


def test_store_errors(spark):
    rows = spark.createDataFrame([(1, True)], "id long, is_active boolean")
    with pytest.raises(S.NotFound):
        S.point_or_raise(rows, "id", 2)
    with pytest.raises(ValueError):
        S.update(rows, F.lit(True), nothing=1)
    assert S.soft_delete(rows, F.col("id") == 1).first().is_active is False


def test_cache(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    cache = spark.createDataFrame([("a:1", '{"k": 1}', "2024-01-02"), ("a:2", "bad", "2024-01-02"), ("b:1", '{"k": 3}', "2023-01-02")], "key string, value string, e string").select("key", "value", F.col("e").cast("timestamp").alias("expires_at"))
    assert sorted((r.key, r.parsed.k if r.parsed else None) for r in S.cache_get(cache, now, "k int").collect()) == [("a:1", 1), ("a:2", None)]
    more = S.cache_set(cache, spark.createDataFrame([("b:1", '{"k": 4}')], "key string, value string"), now)
    assert S.cache_get(more, now, "k int").count() == 3
    assert [r.key for r in S.cache_clear(cache, "a").collect()] == ["b:1"]
    k = lambda **p: one(spark, S.cache_key(**p))
    assert k(q="x", t=None) == k(t=None, q="x") != k(q="y", t=None)


def test_checks(spark):
    rows = spark.createDataFrame([("10-K", 1), ("bad", 5), (None, None)], "filing_type string, fiscal_quarter int")
    good, bad = schemas.validate(rows, schemas.filing_checks())
    assert good.count() == 2 and bad.first().violations == ["filing_type", "fiscal_quarter"]


def test_quantile_beyond_the_last_bound(spark):
    rows = spark.createDataFrame([(1.0, 0), (2.0, 0), (float("inf"), 5)], "le double, n long")
    assert M.quantile(rows, 0.95).first()["quantile"] == 2.0


def test_error_rate_of_nothing(spark):
    empty = spark.createDataFrame([], "e string")
    assert M.error_rate(empty, F.col("e") == "error").first().error_rate == 0.0


def test_hash_vectors():
    v = hash_vectors(["a b c", "", "a b c"])
    assert (v[0] == v[2]).all() and not v[1].any() and abs((v[0] ** 2).sum() - 1) < 1e-6
