import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from corvane.operators import chunk


def sentences(spark, text, limit, **more):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [r.text for r in chunk.chunk_by_sentences(df, limit=limit, **more).orderBy("chunk_idx").collect()]


@pytest.mark.parametrize(
    ("text", "limit", "expected"),
    [
        ("aaaa. bbbb", 10, ["aaaa. bbbb."]),
        ("3.14", 1200, ["3. 14."]),
        ("...", 1200, []),
        (None, 1200, []),
        ("", 1200, []),
        ("aaaaaaaaaaaaaaa. b", 10, ["aaaaaaaaaaaaaaa.", "b."]),
    ],
)
def test_sentences(spark, text, limit, expected):
    assert sentences(spark, text, limit) == expected


def test_oversized_first_sentence_leaves_an_empty_chunk(spark):
    assert sentences(spark, "aaaaaaaaaaaaaaa. b", 10, keep_empty=True) == ["", "aaaaaaaaaaaaaaa.", "b."]


def python_sentences(text, limit):
    out, now = [], ""
    for s in (p.strip() for p in text.split(".")):
        if s:
            if len(now) + len(s) + 1 > limit:
                out.append(now)
                now = s + "."
            else:
                now = f"{now} {s}." if now else s + "."
    return [c for c in [*out, now] if c]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="abж. \n", max_size=120), min_size=1, max_size=30), st.integers(3, 40))
def test_sentences_equal_python(spark, texts, limit):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in chunk.chunk_by_sentences(df, limit=limit).orderBy("doc_id", "chunk_idx").collect():
        got.setdefault(r.doc_id, []).append(r.text)
        assert len(r.text) <= limit + 1 or r.text.count(".") == 1
    assert got == {k: c for k, t in enumerate(texts) if (c := python_sentences(t, limit))}


def overlapping(spark, text, limit, overlap):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [r.text for r in chunk.chunk_with_overlap(df, limit=limit, overlap=overlap).orderBy("chunk_idx").collect()]


def test_overlap(spark):
    assert overlapping(spark, "aa bb cc dd ee", 10, 1) == ["aa bb cc", "cc dd ee"]
    assert overlapping(spark, "aa bb cc", 6, 0) == ["aa bb", "cc"]
    assert overlapping(spark, "  \n", 6, 0) == []
    assert overlapping(spark, "a bbbbbbbbbbbb c", 4, 2) == ["a", "bbbbbbbbbbbb", "c"]


def test_ids_and_offsets(spark):
    df = spark.createDataFrame([(1, "One two. Three four. Five.")], "doc_id long, text string")
    rows = chunk.with_offsets(chunk.chunk_by_sentences(df, limit=12)).orderBy("chunk_idx").collect()
    whole = " ".join(r.text for r in rows)
    assert [whole[r.start : r.end] for r in rows] == [r.text for r in rows]
    assert chunk.chunk_with_overlap(df, limit=9, overlap=0).orderBy("chunk_idx").first().id == "chunk_00000"


@pytest.mark.parametrize(("limit", "overlap"), [(0, 1), (-5, 0), (10, -1)])
def test_arguments(spark, limit, overlap):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        chunk.chunk_with_overlap(df, limit=limit, overlap=overlap)


def test_clashing_column_names(spark):
    df = spark.createDataFrame([(1, "a. b", 9, "x")], "doc_id long, text string, chunk_idx int, id string")
    assert chunk.chunk_by_sentences(df).columns == ["doc_id", "id", "chunk_idx", "text"]
    assert chunk.chunk_with_overlap(df).columns == ["doc_id", "chunk_idx", "id", "text"]
