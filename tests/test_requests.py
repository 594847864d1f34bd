"""Batches of like length, and whole documents in requests under a budget."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import batching, requests
from corvane.plans import makedataset


def test_packed_batches():
    rnd = random.Random(2)
    for _ in range(200):
        lengths = [rnd.randrange(0, 40) for _ in range(rnd.randrange(0, 60))]
        batches = list(batching.packed(lengths, 100, 8))
        assert sorted(k for b in batches for k in b) == list(range(len(lengths)))
        assert all(len(b) <= 8 and (len(b) == 1 or len(b) * max(lengths[k] for k in b) <= 100) for b in batches)


def test_batches_equal_one_by_one(spark):
    rnd = random.Random(3)
    texts = [None if k % 11 == 0 else "FAIL x" if k % 13 == 0 else " ".join(["w"] * rnd.randrange(0, 200)) + f"  {k}" for k in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(3).withColumn("value", F.lit("clash"))
    got = batching.generate_in_batches(df, batching.EchoBatchBackend("FAIL"), budget=600, pause=(0, 0, 0))
    rows = {r.k: r for r in got.collect()}
    for k, text in enumerate(texts):
        want = (None, None) if text is None else (None, "RuntimeError: the model failed") if "FAIL" in text else (" ".join(text.split()), None)
        assert (rows[k].value, rows[k].error) == want and rows[k].n_tokens == (None if text is None else len(text.split()) + 1)
    sorted_share = batching.padding_share(got).first()
    assert 0 <= sorted_share.padding < 0.25 and sorted_share.tokens == sum(len(t.split()) + 1 for t in texts if t is not None)
    assert batching.padding_share(got.limit(0)).first().padding is None
    with pytest.raises(ValueError):
        batching.generate_in_batches(df, batching.EchoBatchBackend(), budget=0)


def test_every_byte_once(spark):
    rnd = random.Random(4)
    files = [(f"/d/{k}.pdf", bytes(rnd.randrange(256) for _ in range(rnd.choice([0, 1, 63, 64, 65, 200])))) for k in range(12)] + [("/d/file only", b"x" * 130), ("/d/null", None)]
    pages = [(f"/d/{k}.pdf", n, rnd.choice(["", "short", "ж" * 50, "long " * 40])) for k in range(12) for n in range(1, rnd.randrange(2, 6))] + [("/d/pages only", 2, "b"), ("/d/pages only", 1, "a"), ("/d/null", 1, None)]
    packed = requests.packed_requests(spark.createDataFrame(pages, "path string, page_no int, text string"), spark.createDataFrame(files, "path string, content binary"), budget=64)
    found = {}
    for r in packed.collect():
        assert len(r.content or b"") + len(r.text.encode()) <= 64
        found.setdefault(r.path, []).append(r)
    for path in {p for p, *_ in pages} | {p for p, _ in files}:
        rows = sorted(found.get(path, []), key=lambda r: r.request)
        assert [r.request for r in rows] == list(range(len(rows))) and all(r.requests == len(rows) for r in rows)
        assert b"".join(bytes(r.content or b"") for r in rows) == (dict(files).get(path) or b"")
        text = "".join(f"\n\n<<<PAGE {n}>>>\n{t.strip()}\n" for p, n, t in sorted(pages, key=lambda x: x[:2]) if p == path and t is not None)
        assert "".join(r.text for r in rows) == text
    assert len(found["/d/file only"]) == 3 and "/d/null" not in found
    assert requests.greedy([5, 5, 1, 10, 9, 1, 1], 10) == [0, 0, 1, 2, 3, 3, 4]


def test_a_book_of_three_requests(spark):
    pages = spark.createDataFrame([("/d/b.pdf", 1, "one " * 10), ("/d/b.pdf", 2, "two"), ("/d/bad.pdf", 1, "MARK")], "path string, page_no int, text string")
    files = spark.createDataFrame([("/d/b.pdf", bytes(150)), ("/d/bad.pdf", b"x")], "path string, content binary")
    docs, chunks = makedataset.extract_files(pages, files, requests.EchoFileBackend("MARK"), budget=100, pause=(0, 0, 0))
    rows = {r.path: r for r in docs.collect()}
    assert rows["/d/b.pdf"].error is None and rows["/d/b.pdf"].markdown.endswith("[100]\n\n[50]<<<PAGE 1>>> one one one one one one one one one\n\n[0]one <<<PAGE 2>>> two")
    assert rows["/d/bad.pdf"].error == "part 1: RuntimeError: the model failed" and rows["/d/bad.pdf"].markdown is None
    assert {r.path for r in chunks.collect()} == {"/d/b.pdf"}
    assert requests.instruction(0, 1) == requests.EXTRACTION_PROMPT and "part 2 of 3" in requests.instruction(1, 3)
