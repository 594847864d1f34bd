import re
import unicodedata

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import html as H
from corvane.functions import rules as R
from corvane.functions import text as X


def one(spark, function, *values):
    df = spark.createDataFrame([values], [f"c{k}" for k in range(len(values))]) if None not in values else spark.sql("SELECT CAST(NULL AS STRING) AS c0")
    return df.select(function(*[F.col(c) for c in df.columns]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("тепло-\nобмен", "теплообмен"),
        ("a- b- c", "ab- c"),
        ("x ( y ) , z !", "x (y), z!"),
        ("« т »", '" т "'),
        ("é", "é"),
        ("A　.B", "A.B"),
        ("", ""),
        ("  \n ", ""),
        ("a  b\x1cc", "a b c"),
        (None, None),
    ],
)
def test_clean_text(spark, text, expected):
    assert one(spark, X.clean_text, text) == expected


def python_clean(s):
    for pattern, new in ((r"(\w+)-\s+(\w+)", r"\1\2"), (r"\s+", " "), (r"\s+([,.;:!?])", r"\1"), (r"\(\s+", "("), (r"\s+\)", ")")):
        s = re.sub(pattern, new, s)
    return unicodedata.normalize("NFC", s.replace("«", '"').replace("»", '"')).strip()


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab1-_ \n\t  ,.;()«»é́жЖ²'", max_size=60), min_size=1, max_size=40))
def test_clean_text_equals_python(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: r.x for r in df.select("k", X.clean_text(F.col("t")).alias("x")).collect()}
    assert got == {k: python_clean(t) for k, t in enumerate(texts)}


def test_normalize_whitespace(spark):
    assert one(spark, X.normalize_whitespace, "a\n\n\n\nb") == "a\nb"
    assert one(spark, X.normalize_whitespace, " a\t  b \n c ") == "a b\n c"


@pytest.mark.parametrize(("line", "year"), [("М.: Недра, 1987 г.", 1987), ("Недра 1987г. 1990 г.", 1987), ("без года", None), (None, None)])
def test_year(spark, line, year):
    assert one(spark, X.year, line) == year


def test_author_and_answer(spark):
    assert one(spark, X.author, "Автор(ы): Иванов ") == "Иванов"
    assert one(spark, X.answer_after, "p.* x p.* y", "p.*") == " y"
    assert one(spark, X.answer_after, "abc", "") == "abc"


def test_sentinel_and_backticks(spark):
    assert one(spark, X.blank_sentinel, "x NOTHING y") == ""
    assert one(spark, X.blank_sentinel, "nothing") == "nothing"
    assert one(spark, X.strip_backticks, " ```a`b``` \n") == "a`b"


@pytest.mark.parametrize(
    ("href", "url"),
    [("/node/1", "https://example.org/node/1"), ("https://a.b/c", "https://a.b/c"), ("//a.b/c", "https://a.b/c"), ("x.pdf", "https://example.org/books/x.pdf"), ("", "https://example.org/books/list")],
)
def test_absolute_url(spark, href, url):
    assert one(spark, lambda c: X.absolute_url("https://example.org/books/list", c), href) == url


def test_references_resolve_as_the_standard_says(spark):
    from urllib.parse import urljoin

    base = "http://a/b/c/d;p?q"
    # the examples of RFC 3986, 5.4
    refs = "g:h g ./g g/ /g //g ?y g?y #s g#s g?y#s ;x g;x g;x?y#s . ./ .. ../ ../g ../.. ../../ ../../g ../../../g ../../../../g /./g /../g g. .g g.. ..g ./../g ./g/. g/./h g/../h g;x=1/./y g;x=1/../y g?y/./x g?y/../x g#s/./x g#s/../x".split() + [""]
    got = {r.x: r.u for r in spark.createDataFrame([(x,) for x in refs], "x string").select("x", X.absolute_url(base, F.col("x")).alias("u")).collect()}
    assert got == {x: urljoin(base, x) for x in refs}
    for other in ("http://a", "http://a/", "http://a/b/", "http://a/b?x=/c/d"):
        got = {r.x: r.u for r in spark.createDataFrame([(x,) for x in ("g", "/g", "../g", "?y", "")], "x string").select("x", X.absolute_url(other, F.col("x")).alias("u")).collect()}
        assert {k: v for k, v in got.items() if k not in ("g", "../g") or other != "http://a"} == {x: urljoin(other, x) for x in got if x not in ("g", "../g") or other != "http://a"}
    assert one(spark, lambda c: X.absolute_url("http://a", c), "g") == "http://a/g"


def test_html_references_and_unclosed_elements(spark):
    import time

    assert one(spark, H.html_to_text, "<p>&#1072;&#x431; &#38;lt; &#65 &#0;&#xD800;&#9999999; &#; &#x; &amp;#65;</p>") == "аб &lt; A \ufffd\ufffd\ufffd &#; &#x; &#65;"
    assert one(spark, H.html_to_text, "a<!-- b <p>c") == one(spark, H.html_to_text, "a<script>b</p>c") == "a"
    assert one(spark, H.html_to_text, "a<script>x</script >b<style>y</style>c<!-- - -- -->d") == "abcd"
    began = time.monotonic()
    for unit in ("<script>", "<!-", "<!--", "<style><", "&#", "<template></templat"):
        assert spark.range(1).select(F.length(H.html_to_text(F.repeat(F.lit(unit), 50_000)))).first()[0] is not None
    assert time.monotonic() - began < 60


@pytest.mark.parametrize(
    ("path", "stem", "ext", "out"),
    [("/in/a/b.c.PDF", "b.c", ".pdf", "/out/a/b.c.json"), ("/in/noext", "noext", "", "/out/noext.json"), ("/in/.hidden", ".hidden", "", "/out/.hidden.json"), ("/in/v1.2/readme", "readme", "", "/out/v1.2/readme.json")],
)
def test_paths(spark, path, stem, ext, out):
    assert one(spark, X.stem, path) == stem
    assert one(spark, X.extension, path) == ext
    assert one(spark, lambda c: X.output_path(c, "/in", "/out"), path) == out


def test_names(spark):
    assert one(spark, X.sanitized_model_name, "org/My:model.v1%\"'") == "Mymodelv1"
    assert one(spark, lambda m, t: X.experiment_name(m, "IT", t), "org/m", "tag") == "tag-IT-m"
    assert one(spark, lambda m, t: X.experiment_name(m, "CPT", t), "org/m", "") == "CPT-m"
    assert spark.range(1).select(X.chunk_id(F.lit(7)).alias("a"), X.chunk_id(F.lit(123456)).alias("b")).first() == ("chunk_00007", "chunk_123456")


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("проба воды [7] и глина [31; 48]", "проба воды и глина"),
        ("по кривой (табл. 6. 1) видно", "по кривой видно"),
        ("в реках (Озеров, 2003) и", "в реках и"),
        ("итог. * * * Начало", "итог. Начало"),
        ("стало\n 58 \nтеплее", "стало теплее"),
        ("тепло-\nобмен", "теплообмен"),
        ("о з е р о полно", "озеро полно"),
        ("ряд 1,5 22,75 0,3 14.02 7,7 600,1 конец", "ряд конец"),
        ("ﬁ “x”", 'fi "x"'),
        ("", ""),
    ],
)
def test_rules(spark, text, expected):
    assert one(spark, R.rule_clean, text) == expected


def test_html_queries_equal_their_sql_on_cut_entities(spark, tmp_path):
    import duckdb

    from corvane.plans.queries import ORACLES, QUERIES

    pages = ["<title>the&amp;&amp</title><p>a &amp; b &amp;lt; &copy; &copy c", "<p>&lt &gt &quot &#39 &nbsp &middot &am &amp", "<a href='?a=1&lt=2'>x</a>&lt;b&gt;", "a & b &; &&amp;"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("html_to_text", "html_to_text_parsed"):
        got = sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()))
        assert got == sorted(con.execute(f"SELECT page_id, text FROM ({ORACLES[name]})").fetchall())
    assert one(spark, H.html_to_text, pages[0]) == "the&& a & b &lt; © © c"  # by default as browsers read them


def test_ship_bounds_arrow_batches(spark):
    from corvane.session import BATCHES, ship

    old = {setting: spark.conf.get(setting) for setting, _, _ in BATCHES}
    try:
        for setting, *_ in BATCHES:
            spark.conf.unset(setting)
        ship(spark)
        assert [spark.conf.get(setting) for setting, _, _ in BATCHES] == [own for _, _, own in BATCHES]
        spark.conf.set(BATCHES[0][0], "77")
        ship(spark)
        assert spark.conf.get(BATCHES[0][0]) == "77"  # what the session says stays
    finally:
        for setting, value in old.items():
            spark.conf.set(setting, value)


@pytest.mark.parametrize("name", ["makedataset_chunks", "clean_text_full", "chunk_offsets", "rule_cleaner_all"])
def test_python_batches_of_queries_are_bounded(spark, tmp_path, monkeypatch, name):
    """What a worker holds at a time doesn't grow with its partition: here 1,600 texts of 4,000 letters a core."""
    from __spark_entry__ import queries
    from corvane.session import BATCHES

    @F.pandas_udf("string")
    def probe(s: pd.Series) -> pd.Series:
        return pd.Series(["x" * (int(s.str.len().sum()) // 10_000)] * len(s))

    monkeypatch.setattr(X, "_nfc", probe)
    monkeypatch.setattr(X, "_nfkc", probe)
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, 1_600 * cores, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("b"), 4_000).alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    old = {setting: spark.conf.get(setting) for setting, _, _ in BATCHES}
    try:
        for setting in old:
            spark.conf.unset(setting)
        rows = queries()[name](spark, str(tmp_path))
        length = F.col("end") - F.col("start") if "end" in rows.columns else F.length("text")
        most, n = rows.select(F.max(length), F.count_distinct("doc_id")).first()
        assert n == 1_600 * cores
        assert 10 < most <= 106  # in 10,000 letters: 1 MB and a text
    finally:
        for setting, value in old.items():
            spark.conf.set(setting, value)
