import json

import pytest
from pyspark.sql import functions as F

from corvane import schemas
from corvane.functions import text as X
from corvane.operators import catalogue, chunk, dataset, model
from corvane.plans import makedataset
from corvane.sources import files, sinks
from corvane.streaming import incremental


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text("Первая строка.\nВторая.", encoding="utf-8")
    (root / "sub" / "b.c.HTML").write_text("<html><title>T</title><script>x</script><p>Hello &amp; <b>bye</b></p></html>", encoding="utf-8")
    (root / "empty.txt").write_text(" . ", encoding="utf-8")
    (root / "bad.html").write_bytes(b"\xff\xfe\xfa")
    (root / "no.docx").write_text("x")
    (root / "scan.djvu").write_bytes(b"AT&TFORM")
    return root


def test_extract_isolates_errors(spark, folder):
    got = {r.path.rsplit("/", 1)[1]: r for r in files.extract(files.scan_folder(spark, str(folder))).collect()}
    assert set(got) == {"a.txt", "b.c.HTML", "empty.txt", "bad.html", "scan.djvu"}
    assert got["b.c.HTML"].text == "T Hello & bye" and got["a.txt"].text == "Первая строка.\nВторая."
    assert got["bad.html"].text is None and "Unicode" in got["bad.html"].error and got["scan.djvu"].error


def test_make_dataset_and_resume(spark, folder, tmp_path):
    chunks, rejected = makedataset.make_dataset(spark, str(folder))
    rows = {r.path.rsplit("/", 1)[1]: r.text for r in chunks.collect()}
    assert rows == {"a.txt": "Первая строка. Вторая.", "b.c.HTML": "T Hello & bye."}
    assert {r.path.rsplit("/", 1)[1] for r in rejected.collect()} == {"empty.txt", "bad.html", "scan.djvu"}
    again, _ = makedataset.make_dataset(spark, str(folder), done=chunks.filter(F.col("path").endswith("a.txt")).select("path"))
    assert [r.path.rsplit("/", 1)[1] for r in again.collect()] == ["b.c.HTML"]
    out = chunks.withColumn("out_path", X.output_path(F.regexp_replace("path", "^file:", ""), str(folder), str(tmp_path / "out")))
    assert sorted(r.n for r in sinks.export_json(out).collect()) == [1, 1]
    raw = (tmp_path / "out" / "sub" / "b.c.json").read_text(encoding="utf-8")
    assert json.loads(raw) == [{"text": "T Hello & bye."}] and raw.startswith("[\n  {")


def test_model_cleaner(spark, folder):
    chunks, rejected = makedataset.make_dataset(spark, str(folder), cleaner="model", backend=model.EchoBackend("Hello"), limit=1000)
    assert [r.text for r in chunks.collect()] == ["Первая строка. Вторая."]
    assert any("RuntimeError" in r.error for r in rejected.collect())
    with pytest.raises(ValueError):
        makedataset.make_dataset(spark, str(folder), cleaner="model")
    with pytest.raises(ValueError):
        makedataset.make_dataset(spark, str(folder), cleaner="other")


def test_json_dataset(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "one.json").write_text(json.dumps([{"text": "a"}, {"text": "б"}], ensure_ascii=False, indent=2), encoding="utf-8")
    (tmp_path / "d" / "e" / "two.json").write_text('[{"text": "c"}]')
    (tmp_path / "d" / "none.json").write_text("[]")
    (tmp_path / "d" / "x.txt").write_text("no")
    assert sorted(r.text for r in files.read_json_dataset(spark, str(tmp_path / "d")).collect()) == ["a", "c", "б"]
    (tmp_path / "f").mkdir()
    with pytest.raises(FileNotFoundError):
        files.read_json_dataset(spark, str(tmp_path / "f"))


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "One. Two. Three.")], "doc_id long, text string")
    chunks = chunk.with_offsets(chunk.chunk_with_overlap(docs, limit=8, overlap=0)).withColumn("source", F.lit("a.pdf"))
    sinks.write_chunks_jsonl(chunks, str(tmp_path / "j"))
    back = spark.read.schema(schemas.CHUNK_META).json(str(tmp_path / "j")).orderBy("id").collect()
    assert back[1].meta.asDict() == {"source": "a.pdf", "start": 5, "end": 9} and back[1].id == "chunk_00001"
    sinks.write_chunks(chunks, str(tmp_path / "t"), "parquet")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    md = sinks.write_markdown(spark.createDataFrame([("a", "# x")], "stem string, markdown string"), str(tmp_path / "md")).first()
    assert md.n == 3 and (tmp_path / "md" / "a__extracted.md").read_text() == "# x"
    books = spark.createDataFrame([("т", 1987, "А", "u", "x")], schemas.CATALOGUE)
    path = sinks.write_catalogue(books, str(tmp_path / "books"))
    assert path.endswith(".json") and files.read_catalogue(spark, path).collect() == books.collect()


def test_texts(spark, folder):
    assert files.read_texts(spark, str(folder / "a.txt")).first().text == "Первая строка.\nВторая."


LIST = '<div class="book_body_title"><a href="/n/1"> Т1 </a></div><div class="book_body_title">x</div><div class="book_body_author">Автор(ы): А &amp; Б</div><div class="book_body_author">-</div><div class="book_body_izdat_full">М., 1987 г.</div><div class="book_body_annot"> про </div>'
BOOK = '<a href="/f/a.djvu">d</a> <a href="/f/b.pdf">p</a> <a href="/f/c.pdf">q</a>'


def test_catalogue(spark, tmp_path):
    stored = {"https://e.org/books?page=0": LIST.encode(), "https://e.org/n/1": BOOK.encode(), "https://e.org/f/b.pdf": b"%PDF"}
    fake_fetch = lambda url: stored[url]
    pages = catalogue.fetch_pages(spark, "https://e.org/books?page=%d", 2, fake_fetch, delay=0)
    assert sorted((r.page, r.error is None) for r in pages.collect()) == [(0, True), (1, False)]
    books = catalogue.listing(pages.filter("error IS NULL"), "https://e.org")
    assert [tuple(r) for r in books.collect()] == [(0, 0, "Т1", 1987, "А & Б", "https://e.org/n/1", " про ")]
    got = catalogue.download(books.unionByName(books.withColumn("url", F.lit("https://e.org/none"))), str(tmp_path / "dl"), "https://e.org", fake_fetch, delay=(0, 0)).collect()
    assert {(r.status == "ok", r.bytes) for r in got} == {(True, 4), (False, 0)} and (tmp_path / "dl" / "b.pdf").read_bytes() == b"%PDF"


def test_retries():
    pauses, calls = [], []

    def flaky(text):
        calls.append(text)
        if len(calls) < 3:
            raise RuntimeError
        return "ok"

    assert model.with_retries(flaky, sleep=pauses.append)("x") == "ok" and pauses == [2.0, 2.0]
    with pytest.raises(ZeroDivisionError):
        model.with_retries(lambda t: 1 / 0, attempts=2, sleep=pauses.append)("x")


def test_extract_markdown(spark):
    pages = spark.createDataFrame([("/d/book.pdf", 1, "One two"), ("/d/book.pdf", 2, "three")], schemas.PAGE_TEXT)
    docs, chunks = makedataset.extract_markdown(pages, model.EchoBackend(), limit=40, overlap=1, pause=(0, 0, 0))
    row = docs.first()
    assert row.stem == "book" and row.markdown.startswith("# Complete structured extraction: book\n\n")
    assert chunks.count() >= 2


def test_incremental(spark, folder, tmp_path):
    out, state = str(tmp_path / "o"), str(tmp_path / "s")
    incremental.run_incremental(spark, str(folder), out, state)
    first = spark.read.parquet(out)
    assert first.filter("text IS NOT NULL").count() == 2 and first.filter("error IS NOT NULL").count() == 3
    (folder / "new.txt").write_text("Новый файл.", encoding="utf-8")
    incremental.run_incremental(spark, str(folder), out, state)
    assert spark.read.parquet(out).filter("text IS NOT NULL").count() == 3


def test_no_needless_python_or_shuffle(spark, sf_dir):
    from corvane.plans.queries import QUERIES

    plan = lambda name: QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for name in ("clean_dehyphenate", "chunk_overlap", "html_links", "append_eos", "instruct_format"):
        assert "Python" not in plan(name) and "Arrow" not in plan(name)
    for name in ("html_to_text", "model_lookup", "html_links"):
        assert "Exchange" not in plan(name)
    # a table with enough partitions is chunked where it is read
    many = makedataset.clean_and_chunk(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    assert "Exchange" not in many._jdf.queryExecution().executedPlan().toString()
    assert dataset.train_test_split(spark.range(100), "id", 0.1)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0


def test_command_line(spark, folder, tmp_path):
    from corvane.__main__ import main

    out = tmp_path / "out"
    assert main(["makedataset", str(folder), str(out)]) == 0
    assert json.loads((out / "sub" / "b.c.HTML.json").read_text(encoding="utf-8")) == [{"text": "T Hello & bye."}]
    stamp = (out / "a.txt.json").stat().st_mtime_ns
    assert main(["makedataset", str(folder), str(out)]) == 0 and (out / "a.txt.json").stat().st_mtime_ns == stamp
    assert main(["trainset", "qwen3-14b", str(out), str(tmp_path / "train"), "--test-size", "0.5"]) == 0
    rows = spark.read.parquet(str(tmp_path / "train" / "table")).collect()
    assert sorted(r.split for r in rows) == ["test", "train"] and all(r.text.endswith("</s>") for r in rows)
    assert main(["health"]) == 0
    with pytest.raises(ValueError):
        main(["makedataset", str(tmp_path / "nothing")])


def test_settings_and_logs(tmp_path, monkeypatch):
    from corvane.logs import get_logger
    from corvane.operators.runs import settings_from_env

    (tmp_path / ".env").write_text("# c\nKEY_ONE='a'\nexport KEY_TWO=b\n")
    monkeypatch.setenv("KEY_TWO", "set")
    assert settings_from_env(("KEY_ONE", "KEY_TWO"), {"KEY_THREE": "d"}, str(tmp_path / ".env")) == {"KEY_ONE": "a", "KEY_TWO": "set", "KEY_THREE": "d"}
    with pytest.raises(ValueError):
        settings_from_env(("KEY_NONE",))
    get_logger("corvane-test", str(tmp_path)).info("hello")
    assert "hello" in (tmp_path / "corvane-test.log").read_text()


class FakePage:
    def __init__(self, text):
        self.text = text

    def extract_text(self):
        if self.text == "bad":
            raise ValueError("no text")
        return self.text


def test_pdf_pages_with_a_stand_in_reader(monkeypatch):
    import sys
    import types

    reader = types.SimpleNamespace(PdfReader=lambda f: types.SimpleNamespace(pages=[FakePage(t) for t in f.read().decode().split("|")]))
    monkeypatch.setitem(sys.modules, "PyPDF2", reader)
    assert files._pdf_pages(b"one  two|bad||three") == ["one  two", "", "", "three"]
    assert files._pdf(b"one  two|bad||three\nfour") == "one two three four"
    assert files._pdf(b"") == ""


def test_djvu_with_a_stand_in_tool(monkeypatch, tmp_path):
    tool = tmp_path / "djvutxt"
    tool.write_text("#!/bin/sh\ncase $(head -c 3 $1) in BAD) exit 3;; esac\ntr a-z A-Z < $1 > $2\n")
    tool.chmod(0o755)
    monkeypatch.setenv("PATH", f"{tmp_path}:/usr/bin:/bin")
    assert files._djvu(b"page  one\n\x0cpage two") == "PAGE ONE PAGE TWO"
    with pytest.raises(Exception, match="status 3"):
        files._djvu(b"BAD")


def test_contents_of_pending_files_alone_are_read(spark, folder):
    todo = makedataset.pending(spark, str(folder), files.listed(spark, str(folder)).filter("path LIKE '%a.txt'").select("path"))
    plan = todo._jdf.queryExecution().executedPlan().toString()
    assert "content:binary" not in plan and "content#" not in plan
    assert {r.path.rsplit("/", 1)[1] for r in todo.collect()} == {"b.c.HTML", "empty.txt", "bad.html", "scan.djvu"}
    read = files.opened(spark, todo)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "a.txt" not in "".join(read.inputFiles()) and len(read.inputFiles()) == 4
    assert files.extract(files.opened(spark, todo.filter("false"))).count() == 0


def test_names_that_look_like_patterns(spark, tmp_path):
    for name in ("a[1].txt", "b{c,d}.txt", "e*.TXT", "a1.txt"):
        (tmp_path / name).write_text(name)
    todo = files.listed(spark, str(tmp_path)).filter("path NOT LIKE '%a1.txt'")
    assert sorted(r.text for r in files.extract(files.opened(spark, todo)).collect()) == ["a[1].txt", "b{c,d}.txt", "e*.TXT"]


def test_chunks_json(spark, tmp_path):
    chunks = spark.createDataFrame([("/x/b.pdf", 1, "two"), ("/x/b.pdf", 0, "один"), ("/x/a.txt", 0, "")], "source string, chunk_idx int, text string")
    sinks.write_chunks_json(chunks, str(tmp_path)).collect()
    assert json.loads((tmp_path / "b__chunks.json").read_text(encoding="utf-8")) == [{"text": "один"}, {"text": "two"}]
    assert json.loads((tmp_path / "a__chunks.json").read_text()) == []


def test_download_in_blocks(spark, tmp_path):
    page = b'<a href="/f/x.pdf">x</a>'
    books = spark.createDataFrame([("http://e.org/1",)], "url string")

    def whole(url):
        yield b"abc"
        yield b"def"

    def broken(url):
        yield b"abc"
        raise OSError("gone")

    ok = catalogue.download(books, str(tmp_path / "ok"), "http://e.org", lambda u: page, delay=(0, 0), blocks=whole).collect()
    assert [(r.status, r.bytes) for r in ok] == [("ok", 6)] and (tmp_path / "ok" / "x.pdf").read_bytes() == b"abcdef"
    bad = catalogue.download(books, str(tmp_path / "bad"), "http://e.org", lambda u: page, delay=(0, 0), blocks=broken).collect()
    assert "gone" in bad[0].status and not list((tmp_path / "bad").iterdir())


def test_pending_files_are_read_in_tasks(spark, folder):
    (folder / "a b%20c#d.txt").write_text("Имя с пробелом.", encoding="utf-8")
    todo = files.listed(spark, str(folder)).union(spark.createDataFrame([("file:/nowhere/x.txt", 5), (str(folder / "a.txt"), 40), ("odd://host/x.txt", 1 << 31)], "path string, length long"))
    rows = files.extract_pending(spark, todo).collect()
    got = {r.path.rpartition("/")[2]: r for r in rows if not r.path.startswith("/") and "x.txt" not in r.path}
    assert set(got) == {"a.txt", "a b%20c#d.txt", "b.c.HTML", "empty.txt", "bad.html", "scan.djvu"} and all(r.part == 0 for r in rows)
    assert got["a b%20c#d.txt"].text == "Имя с пробелом." and got["b.c.HTML"].text == "T Hello & bye" and "Unicode" in got["bad.html"].error
    assert [r.text for r in rows if r.path == str(folder / "a.txt")] == [got["a.txt"].text]
    assert sorted(bool(r.error) for r in rows if "x.txt" in r.path) == [True, True]
    assert files.extract_pending(spark, todo.limit(0)).collect() == []


def test_large_files_come_in_parts(spark, tmp_path):
    text = "".join(f"Предложение {k}.\r\n" for k in range(2000))
    (tmp_path / "t.txt").write_bytes(text.encode())
    (tmp_path / "h.html").write_text("<html><script>x</script>" + "".join(f"<p>Абзац {k}.</p>" for k in range(60_000)), encoding="utf-8")
    (tmp_path / "bad.txt").write_bytes(b"good. " * 200 + b"\xff")
    (tmp_path / "dotless.txt").write_text("слово " * 1000, encoding="utf-8")
    rows = files.extract_pending(spark, files.listed(spark, str(tmp_path)), whole=1000, piece=500).collect()
    parts = {}
    for r in sorted(rows, key=lambda r: r.part):
        parts.setdefault(r.path.rpartition("/")[2], []).append(r)
    assert "".join(r.text for r in parts["t.txt"]) == text.replace("\r\n", "\n") and "".join(r.text for r in parts["dotless.txt"]) == "слово " * 1000
    assert " ".join("".join(r.text for r in parts["h.html"]).split()) == " ".join(f"Абзац {k}." for k in range(60_000)) and len(parts["h.html"]) > 1
    assert [r.text for r in parts["bad.txt"]] == [None] and all(r.text.endswith(".") for r in parts["h.html"][:-1])
    assert list(files.pieces_of(iter(["a.b", "cdef", "gh", ". x"]), 3)) == ["a.", "bcdefgh.", " x"] and list(files.pieces_of(iter([]))) == [""]
