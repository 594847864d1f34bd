import base64
import gzip
import hashlib
import html
import random
import re
import time
from collections import Counter
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import html_extract, langid, media, warc
from corvane.llm.queries import QUERIES

# -- media


def test_companding_tables():
    # known values of G.711
    assert media.MU_TABLE[[0xFF, 0x7F, 0x80, 0x00]].tolist() == [0, 0, 32124, -32124]
    assert media.A_TABLE[[0xD5, 0x55, 0xAA, 0x2A]].tolist() == [8, -8, 32256, -32256]
    assert len(set(media.MU_TABLE.tolist())) == 255 and len(set(media.A_TABLE.tolist())) == 256


def slow_adpcm(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), block[2]
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            change = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                change += part if code & bit else 0
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(media.INDEX_CHANGE[code & 7])))
            out.append(value)
    return out


def test_adpcm_equals_scalar_decoder():
    rnd = np.random.default_rng(1)
    blocks = rnd.integers(0, 256, (50, 68), dtype=np.uint8)
    blocks[:, 2] %= 89
    assert media.decode_adpcm(blocks).tolist() == [slow_adpcm(b.tobytes()) for b in blocks]


@pytest.mark.parametrize("kind", [media.PCM, media.A_LAW, media.MU_LAW])
@pytest.mark.parametrize("n", [2, 64])
def test_wav_round_trip(kind, n):
    data = bytes(range(n))
    assert bytes(media.parse_wav(media.wav(kind, data))[3]) == data


def test_resample():
    assert media.resample(np.array([0, 10, 20], np.int16), 8000).tolist() == [0, 5, 10, 15, 20, 20]
    assert len(media.resample(np.arange(100, dtype=np.int16), 8000, 11025)) == 137


def test_op5_is_lossless(spark, sf_dir):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op5_media_columns"](spark, sf_dir).collect()
    assert len(rows) == len(texts) and {r.feature[:5] for r in rows} == {"fmt=6", "fmt=7", "fmt=1"}
    for r in rows:
        raw = texts[r.doc_id]
        payload = raw + b"\0" * (-len(raw) % 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = media.store(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_media_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "", 1), (2, "é" * 2_000_000, 1), (3, "a" * 64, 1), (3, "a" * 64, 1)], "doc_id long, text string, feature int")
    rows = media.media_columns(docs).collect()
    assert sorted((r.n_bytes, r.payload_bytes) for r in rows) == [(0, 64), (0, 64), (64, 64), (64, 64), (4_000_000, 4_000_000)]
    assert len({tuple(r)[1:] for r in rows}) == 3
    assert media.media_columns(docs.limit(0)).count() == 0
    files = spark.createDataFrame([(1, media.wav(media.MU_LAW, b"\x00" * 10)), (2, b"no"), (3, None)], "id long, media binary")
    got = {r.id: r.pcm for r in media.expand_column(files).collect()}
    assert got[2] is None and got[3] is None and len(bytes(media.parse_wav(bytes(got[1]))[3])) == 40


# -- language


def test_op7_held_out_accuracy(spark, sf_dir):
    rows = QUERIES["op7_language_id"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97


def test_language_edges(spark):
    rows = [(k, t, lang) for k in range(40) for t, lang in ((f"the cat and the dog number {k}", "en"), (f"die katze und der hund nummer {k}", "de"))]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string").union(spark.createDataFrame([(99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string"))
    model = langid.fit(labelled)
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "12 ²³ ½ Ⅷ _!"), (4, "the dog " * 200_000), (5, "der hund"), (5, "der hund")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict_columns(docs, model).orderBy("doc_id").collect()]
    assert [x[1] for x in got] == ["und", "und", "und", "en", "de", "de"] and [x[2] for x in got[:3]] == [0.0] * 3 and got[3][2] > 0.8
    assert langid.predict_columns(docs.limit(0), model).count() == 0
    none = langid.fit(labelled.limit(0))
    assert none.predict("text") == ("und", 0.0)


def test_many_languages_and_rare_ones(spark):
    """More languages than a mask has bits, one of them with two texts among thousands."""
    rnd = random.Random(5)
    words = {f"l{k:03}": ["".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(12)] for k in range(140)}
    text = lambda lang: " ".join(rnd.choice(words[lang]) for _ in range(30))
    rows = [(k, text(lang), lang) for k, lang in enumerate([*list(words) * 4, *["l000"] * 3000, "rare", "rare"]) if lang != "rare"]
    words["rare"] = ["zzyzx", "qqwrt", "vvnmk"]
    rows += [(10**6 + k, text("rare"), "rare") for k in range(2)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), train_docs=50)
    assert len(model.languages) == 141 and len(model.slots) == 3 and model.prior[0] == 50
    assert [model.predict(text(lang))[0] for lang in words] == list(words)


def test_filter_equals_exact_sets():
    """The languages of an n-gram's mask are those that hold it, but for false positives at about the rate that the fill predicts."""
    rnd = np.random.default_rng(2)
    sets = {lang: rnd.integers(0, 2**64, 60_000, dtype=np.uint64) for lang in range(5)}
    grams = np.unique(np.concatenate(list(sets.values())))
    mask = np.zeros(len(grams), np.uint64)
    for lang, own in sets.items():
        mask |= np.isin(grams, own).astype(np.uint64) << np.uint64(lang)
    model = langid.filled(list("abcde"), [1.0] * 5, grams, [mask])
    (got,) = model.masks(grams)
    assert (got & mask.astype(np.uint8) == mask).all()
    strangers = rnd.integers(0, 2**64, 200_000, dtype=np.uint64)
    for lang in range(5):
        rate = (model.masks(strangers)[0] >> np.uint8(lang) & 1).mean()
        assert abs(rate - model.false_rate[0][lang]) < 0.001


def test_scores_equal_exact_shares(spark):
    """Language and score of texts from exact sets of n-grams: the filter's corrected counts are within its chance hits."""
    rows = [(k, " ".join(np.random.default_rng(k).choice(words.split(), 40)), lang) for k in range(40) for lang, words in (("en", "the cat sat on that mat with many other cats"), ("de", "die katze lag auf jener matte mit vielen anderen"))]
    model = langid.fit(spark.createDataFrame([(2 * k + (lang == "de"), t, lang) for k, t, lang in rows], "doc_id long, text string, lang string"))
    least = max(2, int(langid.LEAST_SHARE * 40))
    sets = []
    for size in langid.SIZES:
        counts = {lang: Counter(g for _, t, own in rows if own == lang for g in set(langid.gram_hashes(langid.codes_of(t), size).tolist())) for lang in ("en", "de")}
        sets.append({lang: {g for g, n in c.items() if n >= least} for lang, c in counts.items()})
    for text in ("the cats sat", "jener katze", "other matte words", "zzz qqq"):
        shares = {}
        for lang in ("en", "de"):
            total = 0.0
            for size, known in zip(langid.SIZES, sets, strict=True):
                grams = langid.gram_hashes(langid.codes_of(text), size).tolist()
                total += size * sum(g in known[lang] for g in grams) / len(grams)
            shares[lang] = total / sum(langid.SIZES)
        lang, score = model.predict(text)
        assert abs(score - max(shares.values())) < 0.01 and (max(shares.values()) == 0 or lang == max(shares, key=shares.get))


def test_blocks_of_long_texts_hold_all_grams():
    text = "abc def, ghi " * 60_000
    whole = langid.gram_hashes(langid.codes_of(text), 4)
    assert len(text) > langid.BLOCK_CHARS and len(set(whole.tolist())) < 15
    assert np.concatenate([langid.gram_hashes(c, 4) for c in langid.blocks_of(text)]).tolist() == whole.tolist()


def test_false_positive_correction():
    slots = np.zeros(1 << langid.SLOT_BITS, np.uint8)
    rnd = np.random.default_rng(1)
    slots[rnd.random(len(slots)) < 0.3] |= 1
    rate = np.tile(np.array([(slots & 1).mean(), 0.0]) ** langid.HASHES, (len(langid.SIZES), 1))
    model = langid.LanguageFilter(["a", "b"], [1.0, 1.0], [slots], rate)
    _, score = model.predict("".join(chr(97 + int(x)) for x in rnd.integers(0, 26, 20_000)))
    assert score < 0.05  # hits by chance are taken off


# -- HTML


def test_op9_equals_articles(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = QUERIES["op9_html_extraction"](spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        m = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id], re.S)
        text = re.sub(r"<[^>]*>?", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", m[1])) if m else ""
        assert r.text == " ".join(html.unescape(text).split()) and r.n_chars == len(r.text)


PARAGRAPH = "The quick brown fox is in the house of the old man and it was there for a long time with all of the others that had come before, and so it went on and on until the end of the day came."


def test_block_rules():
    page = f"""<html><head><title>T</title><style>x</style></head><body>
    <header class="site"><a href=/>Home</a> The site of the day</header><div id="sidebar"><p>{PARAGRAPH}</p></div>
    <div class="post"><h2>A  heading &amp; more</h2><p>{PARAGRAPH}</p><p>Short one.</p><p>{PARAGRAPH} {PARAGRAPH}<br>x<b>y</b>z</p>
    <ul><li><a href=1>one link</a></li><li><a href=2>two links</a></li></ul></div>
    <div class="comments"><p>{PARAGRAPH} says a reader</p></div><form><p>{PARAGRAPH}</p></form>
    <div class="cookie-notice">{PARAGRAPH}</div><script>var a = "<p>{PARAGRAPH}</p>";</script><footer>© the owner</footer></body></html>"""
    assert html_extract.main_text(page) == f"A heading & more {PARAGRAPH} Short one. {PARAGRAPH} {PARAGRAPH} xyz"


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!-- open", "<script>never closed", "<a href='x>y</a>", "</div></p>", "\0", "<nav>only</nav>"])
def test_odd_pages(page):
    assert html_extract.main_text(page) == ""


ARTICLE = f"<article><p>{PARAGRAPH}</p></article>"


@pytest.mark.parametrize(
    "page",
    ["<video-player></video-player>" + ARTICLE, "<svg-icon></svg-icon>" + ARTICLE, "<button-group>" + ARTICLE, "<svg viewBox='0'/>" + ARTICLE, "<div><button>Go</div>" + ARTICLE, "<select>" + ARTICLE, "<object>" + ARTICLE + "<object>x</object>"]
    + ["<audio src=a>" + ARTICLE, "<div><button></div>" + ARTICLE + "</button>", f"<div class='sidebar-layout'>{ARTICLE}</div>", f"<div class='overflow-hidden'>{ARTICLE}</div>", "<svg><title>t</title><text>no</text></svg>" + ARTICLE + "<button>no</button>"],
)
def test_nothing_of_an_article_is_cut(page):
    assert PARAGRAPH in html_extract.main_text(page) and "no</" not in html_extract.main_text(page) and " no" not in html_extract.main_text(page).removeprefix(PARAGRAPH)


def test_hidden_and_skipped():
    assert all(html_extract.main_text(x) == "" for x in (f"<div hidden>{ARTICLE}</div>", f"<div style='display: none'>{ARTICLE}</div>", f"<button>{ARTICLE}</button>", f"<div class=comments><article class=comment><p>{PARAGRAPH}</p></article></div>"))
    assert html_extract.main_text("<button>" * 50_000 + ARTICLE) == PARAGRAPH


RUSSIAN = "Это длинный абзац статьи, в котором достаточно много слов, чтобы его можно было считать основным текстом страницы, и он продолжается ещё некоторое время, чтобы длина была больше двухсот знаков, а потом заканчивается точкой, как и всякий абзац."
CHINESE = "这是一个很长的段落，包含了许多文字，所以它应该被视为页面的主要内容，而不是菜单或者广告。" * 5
POLISH = "Jest to długi akapit artykułu, w którym znajduje się wiele słów. Dlatego powinien zostać uznany za główny tekst strony. Nie jest to menu ani reklama, lecz zwykły tekst, który ma więcej niż dwieście znaków i kończy się kropką."


@pytest.mark.parametrize("text", [RUSSIAN, CHINESE, POLISH])
def test_other_languages_outside_articles(text):
    page = f"<nav><a href=1>a</a><a href=2>b</a></nav><div class=post><p>{text}</p><p>{text}</p></div><div class=footer>{text}</div>"
    assert html_extract.main_text(page) == f"{text} {text}"


@pytest.mark.parametrize("mark", ["class='elementor-widget'", "class='post social-science'", "class='has-sidebar content'", "class=no-comments", "aria-hidden=false", "data-x='no hidden fee'", "class='overflow-hidden'"])
def test_marks_that_say_nothing_against_an_element(mark):
    assert html_extract.main_text(f"<div {mark}><p>{PARAGRAPH}</p></div>") == html_extract.main_text(f"<article {mark}><p>{PARAGRAPH}</p></article>") == PARAGRAPH


@pytest.mark.parametrize("mark", ["class=widget", "class='social-links'", "class=siteFooter", "id='related_posts'", "class='x comment-body'", "role=navigation", "class='share-buttons'", "hidden", "aria-hidden=true"])
def test_marks_of_boilerplate(mark):
    assert html_extract.main_text(f"<div {mark}><p>{PARAGRAPH}</p></div><div><p>{PARAGRAPH} {PARAGRAPH}</p></div>") == f"{PARAGRAPH} {PARAGRAPH}"


@pytest.mark.parametrize("other", ["<aside>x</aside>", "<nav>Contents</nav>", "<form><p>Mail me</p></form>", "<div class=ad>Buy now</div>"])
def test_what_is_out_decides_nothing(other):
    assert html_extract.main_text(f"<article><p>{PARAGRAPH}</p>{other}</article>") == PARAGRAPH
    long, ad = f"{PARAGRAPH} {PARAGRAPH}", "<div class='ad'>Buy now</div>"
    assert html_extract.main_text(f"<article><p>{long}</p>{ad}<p>Yes.</p>{ad}{other}<p>{long}</p></article>") == f"{long} Yes. {long}"
    assert html_extract.main_text(f"<div><p>{PARAGRAPH}</p>{other}</div>") == PARAGRAPH


def test_links_in_articles():
    assert html_extract.main_text(f"<article><p>{PARAGRAPH}</p><p><a href=x>The whole report of the year can be read on another page.</a></p></article>") == f"{PARAGRAPH} The whole report of the year can be read on another page."
    menu = "".join(f"<li><a href={k}>Chapter {k}</a></li>" for k in range(4))
    assert html_extract.main_text(f"<article><ul>{menu}</ul><p>{PARAGRAPH}</p></article>") == PARAGRAPH


@pytest.mark.parametrize("inner", [f"<article><p>{PARAGRAPH}</p></article>", f"<main><p>{PARAGRAPH}</p></main>", f"<div><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div>"])
def test_a_form_around_the_page(inner):
    got = html_extract.main_text(f"<body><form action=/><nav>Home</nav>{inner}<footer>the end</footer></form></body>")
    assert got.replace(PARAGRAPH, "").strip() == "" and PARAGRAPH in got


@pytest.mark.parametrize("mark", ["class='layout-sidebar-left'", "class='content-with-sidebar'", "class='page modal-open'", "id='menu-planning-guide'"])
def test_names_of_wrappers(mark):
    page = f"<div {mark}><h1>A guide</h1><p>{PARAGRAPH}</p></div><div class=sidebar>{PARAGRAPH}</div>"
    assert html_extract.main_text(page) == f"A guide {PARAGRAPH}"


@pytest.mark.parametrize("element", [f"<p class='ad-hoc'>{PARAGRAPH}</p>", f"<section id='informed-consent'><p>{PARAGRAPH}</p></section>", f"<div class='newsletter-issue'>{PARAGRAPH}</div>"])
def test_names_within_articles(element):
    assert html_extract.main_text(f"<article><p>{PARAGRAPH}</p>{element}</article>") == f"{PARAGRAPH} {PARAGRAPH}"


@pytest.mark.parametrize("mark", ["class='sidebar-left'", "id=page-footer", "class='wp-block-navigation'", "class='td-sidebar'", "class='main-nav__items'", "class=cookie-banner"])
def test_sure_names_hold_however_much_they_have(mark):
    assert html_extract.main_text(f"<div><p>{PARAGRAPH}</p></div><div {mark}><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div>") == PARAGRAPH


def test_pages_without_article_tags(spark, sf_dir):
    pages = [r.html for r in spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/pages.parquet").select("html").collect()]
    same = [html_extract.main_text(p.replace("<article>", "<div>").replace("</article>", "</div>")) == html_extract.main_text(p) for p in pages]
    assert sum(same) >= 0.95 * len(same) and all(html_extract.main_text(p.replace("article>", "div>")) for p in pages)


def test_nesting_is_linear():
    def took(n):
        began = time.perf_counter()
        html_extract.main_text("<div><b class=x>" * n + "x" + "</i>" * n)
        return time.perf_counter() - began

    assert took(20_000) < 12 * max(took(4_000), 0.01)


def test_comments_in_articles_and_quotes_in_values():
    assert html_extract.main_text(f"{ARTICLE}<article class='comment even'><p>{PARAGRAPH} says a reader</p></article>") == PARAGRAPH
    assert html_extract.main_text(f"<article><p title=it's>{PARAGRAPH}</p></article><div>it's</div>") == PARAGRAPH
    assert html_extract.main_text(f"<article><p title=\"a > b\" data-x='1>2'>{PARAGRAPH}</p></article>") == PARAGRAPH


def test_html_edges(spark):
    pages = spark.createDataFrame([(1, None, None, "c"), (2, "u", "<p>" * 50_000, "c"), (3, "u", f"<article><p>{PARAGRAPH * 500}</article>", "c"), (3, "u", "", "c")], "page_id long, url string, html string, text string")
    out = html_extract.extract_columns(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"] and sorted(r.n_chars for r in out.collect()) == [0, 0, 0, len(PARAGRAPH) * 500]
    assert html_extract.extract_columns(pages.limit(0)).count() == 0


# -- WARC


def test_derivatives():
    page = '<html lang="de"><title>A &amp; B</title><script>x</script><p>Hällo</p><a href="/">l</a></html>'
    data = warc.response_record("http://e.org/", page)
    source, block, after = warc.parse(data)
    assert after == len(data) and source["warc-block-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
    (meta, meta_record), (text, text_record) = warc.derive(data)
    for headers, record, kind in ((meta, meta_record, "metadata"), (text, text_record, "conversion")):
        parsed, body, end = warc.parse(record)
        assert end == len(record) and parsed["warc-type"] == kind == headers["warc-type"]
        assert parsed["warc-refers-to"] == source["warc-record-id"] and parsed["warc-target-uri"] == "http://e.org/" and parsed["warc-date"] == source["warc-date"]
        assert parsed["warc-block-digest"] == warc.digest(body)
    assert warc.parse(text_record)[1].decode() == "A & B Hällo l"
    body = warc.parse(meta_record)[1].decode()
    assert "title: A & B\r\n" in body and "language: de\r\n" in body and "links: 1\r\n" in body and f"source-payload-digest: {source['warc-payload-digest']}" in body and "http-content-type: text/html; charset=utf-8" in body


def test_all_source_headers():
    block = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\n\r\n<p>x</p>"
    data = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-IP-Address", "192.0.2.1"), ("WARC-Concurrent-To", "<urn:y>"), ("WARC-Concurrent-To", "<urn:z>")], block)
    body = warc.parse(warc.derive(data)[0][1])[1].decode()
    assert "http-set-cookie: a=1\r\nhttp-set-cookie: b=2\r\n" in body
    assert "source-warc-ip-address: 192.0.2.1\r\nsource-warc-concurrent-to: <urn:y>\r\nsource-warc-concurrent-to: <urn:z>\r\n" in body


def test_warc_edges(spark, tmp_path):
    pages = spark.createDataFrame([(1, None, None, "c"), (2, "u\r\nX: y", "x" * 1_000_000, "c"), (3, "u", "", "c"), (3, "u", "", "c")], "page_id long, url string, html string, record string")
    made = warc.derive_records(warc.responses(pages))
    assert made.count() == 8 and made.filter("warc_type = 'error'").isEmpty()
    broken = spark.createDataFrame([(1, None), (2, b"WARC/1.0\r\nContent-Length: 9\r\n\r\nx"), (3, b"")], "page_id long, record binary")
    assert sorted((r.page_id, r.warc_type) for r in warc.derive_records(broken).collect()) == [(1, "error"), (2, "error"), (3, "error")]
    assert warc.derive_records(broken.limit(0)).count() == 0
    records = [bytes(r.record) for r in warc.responses(pages).collect()]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "c.warc.gz").write_bytes(b"".join(map(gzip.compress, records))[:-60])
    read = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted(bytes(r.record) for r in read if "c.warc" not in r.path) == sorted(records * 2)
    assert sorted(r.warc_type for r in read if "c.warc" in r.path) == ["error", "response", "response", "response"]
    again = warc.derive_records(warc.read_warc(spark, str(tmp_path / "a.warc")), key_col="place")
    assert again.count() == 8


@pytest.mark.parametrize("length", ["-60", "-1", "+4", "1_0", "", "x", "9" * 30, str(2**40), "9" * 5000])
def test_lengths_that_are_none(length):
    good = warc.response_record("http://e.org/", "<p>x</p>")
    bad = f"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: {length}\r\n\r\nlost\r\n\r\n".encode()
    with pytest.raises(ValueError):
        warc.parse(bad)
    for data in (good + bad + good, gzip.compress(good + bad + good)):
        assert list(warc.records_of(data)) == [("response", good), ("error", None), ("response", good)]
    assert list(warc.records_of(bad)) == [("error", None)] and list(warc.records_of(bad[:-8])) == [("error", None)]


def test_files_in_pieces(spark, tmp_path, monkeypatch):
    """Whole and in pieces of any size, with damage anywhere, the same records come out."""
    records = [warc.response_record(f"http://e.org/{k}", "<p>x</p>" * (k * 7)) for k in range(12)]
    rnd = np.random.default_rng(4)
    for packed in (False, True):
        data = bytearray(b"".join(map(gzip.compress, records) if packed else records))
        for k in rnd.integers(0, len(data), 3):
            data[k] ^= 0x55
        (tmp_path / "x.warc").write_bytes(data)
        whole = list(warc.records_of(bytes(data)))
        assert sum(r in records for _, r in whole) >= 8
        for read, piece in ((1, 1), (7, 3), (100, 64), (4096, 1000)):
            monkeypatch.setattr(warc, "READ", read)
            monkeypatch.setattr(warc, "PIECE", piece)
            assert list(warc.records_of(bytes(data))) == whole == list(warc.records_of(warc.StoredFile(f"file://{tmp_path}/x.warc")))
        rows = [sorted((r.place, r.warc_type, r.record) for r in warc.read_warc(spark, str(tmp_path / "x.warc"), most).collect()) for most in (1 << 30, 10)]
        assert rows[0] == rows[1] == [(k, kind, r) for k, (kind, r) in enumerate(whole)]


def test_one_member_for_a_whole_file(tmp_path):
    records = [warc.response_record("u", "x" * n) for n in (0, 5, 300_000)]
    assert [r for _, r in warc.records_of(gzip.compress(b"".join(records)))] == records


def test_query_values(spark, sf_dir):
    """Every value of the query from a plain reading of the pages."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = QUERIES["op3_warc_derivatives"](spark, sf_dir).collect()
    assert len(rows) == 2 * len(pages)
    for r in rows:
        page = pages[r.page_id]
        whole = warc.response_record(page.url, page.html, key=str(page.page_id))
        assert r.refers_to.encode() in whole and r.target_uri == page.url and f"WARC-Date: {r.date}".encode() in whole
        if r.warc_type == "conversion":
            seen = re.sub(r"(?s)<(style|script)>.*?</\1>|<!--.*?-->", " ", page.html)
            text = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", seen)).split()).encode()
            assert r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(text).digest()).decode()
            fields = [("WARC-Type", "conversion"), ("WARC-Record-ID", r.record_id), ("WARC-Refers-To", r.refers_to), ("WARC-Target-URI", r.target_uri), ("WARC-Date", r.date), ("WARC-Block-Digest", r.block_digest), ("Content-Type", r.content_type), ("Content-Length", str(len(text)))]
            data = b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + text + b"\r\n\r\n"
            assert r.record_bytes == len(data) and r.record_sha256 == hashlib.sha256(data).hexdigest()


def hand_made_crawl():
    """Records as crawlers write them, and the text and the facts that each response must give."""

    def response(name, head, body, **more):
        block = b"HTTP/1.1 200 OK\r\n" + head + b"\r\n" + body
        fields = b"".join(b"%s: %s\r\n" % (k.replace("_", "-").encode(), v) for k, v in more.items())
        return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:%s>\r\nWARC-Date: 2020-02-02T02:02:02Z\r\n%sContent-Length: %d\r\n\r\n%s\r\n\r\n" % (name, fields, len(block), block)

    page, sha = b"<html><title>Caf\xe9</title><body><p>one &amp; two</p></body></html>", lambda x: b"sha1:" + base64.b32encode(hashlib.sha1(x).digest())
    packed = gzip.compress(page)
    chunked = b"5;x=y\r\n" + packed[:5] + b"\r\n" + b"%X\r\n" % (len(packed) - 5) + packed[5:] + b"\r\n0\r\n\r\n"
    html_head = b"Content-Type: text/html; charset=iso-8859-1\r\n"
    yield b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:info>\r\nContent-Length: 4\r\n\r\na: b\r\n\r\n", None, None
    yield b"WARC/1.0\r\nWARC-Type: request\r\nWARC-Record-ID: <urn:ask>\r\nContent-Length: 18\r\n\r\nGET / HTTP/1.1\r\n\r\n\r\n\r\n", None, None
    yield response(b"plain", html_head, page, WARC_Payload_Digest=sha(page)), "Café one & two", ["payload-coding: none", "source-payload-digest-check: right", "title: Café"]
    yield response(b"both", html_head + b"Transfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n", chunked, WARC_Payload_Digest=sha(b"other")), "Café one & two", ["payload-coding: decoded", "source-payload-digest-check: wrong", "source-block-digest-check: absent"]
    yield response(b"dechunked", html_head + b"Transfer-Encoding: chunked\r\n", page), "Café one & two", ["payload-coding: not chunked"]
    yield response(b"zlib", html_head + b"Content-Encoding: deflate\r\n", zlib.compress(page), WARC_Block_Digest=b"md9:AA"), "Café one & two", ["source-block-digest-check: unknown"]
    yield response(b"torn", html_head + b"Content-Encoding: gzip\r\n", packed[:-9]), "", ["payload-coding: damaged gzip"]
    yield response(b"odd", html_head + b"Content-Encoding: br\r\n", b"\x8b\x00"), "", ["payload-coding: unknown coding br"]
    yield response(b"image", b"Content-Type: image/png\r\n", b"\x89PNG\r\n\x1a\n<p>no text</p>"), None, ["http-content-type: image/png", "characters: 0"]


def test_a_crawl_file(spark, tmp_path):
    crawl = list(hand_made_crawl())
    damage = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: x\r\n\r\nlost\r\n\r\n"
    raw = [r for r, _, _ in crawl]
    (tmp_path / "a.warc").write_bytes(b"".join([*raw[:3], damage, *raw[3:]]))
    torn = gzip.compress(b"x" * 1000 + bytes(range(256)) * 40)
    (tmp_path / "b.warc.gz").write_bytes(b"".join([*map(gzip.compress, raw[:3]), torn[:30] + b"\xff" * 8 + torn[38:-8], *map(gzip.compress, raw[3:])]))
    for name in ("a.warc", "b.warc.gz"):
        rows = sorted(warc.read_warc(spark, str(tmp_path / name)).collect(), key=lambda r: r.place)
        assert [bytes(r.record)[:-4] if r.record else None for r in rows] == [*(r[:-4] for r in raw[:3]), None, *(r[:-4] for r in raw[3:])]
        assert [r.warc_type for r in rows][:4] == ["warcinfo", "request", "response", "error"]
        made = warc.derive_records(warc.read_warc(spark, str(tmp_path / name)).filter("record IS NOT NULL"), key_col="place").collect()
        place = {r.place: bytes(r.record) for r in rows if r.record}
        for at, (_, text, facts) in zip(sorted(place), crawl, strict=True):
            own = {r.warc_type: r for r in made if r.place == at}
            if facts is None:
                assert not own
                continue
            assert set(own) == ({"metadata"} if text is None else {"metadata", "conversion"})
            assert {r.refers_to for r in own.values()} == {warc.parse(place[at])[0]["warc-record-id"]}
            body = warc.parse(bytes(own["metadata"].record))[1].decode()
            assert all(f in body for f in facts), (facts, body)
            assert text is None or warc.parse(bytes(own["conversion"].record))[1].decode() == text


def test_op3_links_all_pages(spark, sf_dir):
    out = QUERIES["op3_warc_derivatives"](spark, sf_dir)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert out.count() == 2 * pages.count() and out.select("record_id").distinct().count() == out.count()
    assert out.join(pages, (out.page_id == pages.page_id) & (out.target_uri == pages.url)).count() == out.count()
