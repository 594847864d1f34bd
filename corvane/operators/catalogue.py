"""Book catalogue pages: listing, link choice and download."""

from __future__ import annotations

import os
import random
import time
import urllib.request
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import schemas
from corvane.functions import html as H
from corvane.functions import text as X

CONCURRENT = 3
DOWNLOAD_BLOCK = 1 << 16
DELAY_BETWEEN_PAGES, DELAY_BEFORE_DOWNLOAD = 2.0, (1.5, 4.0)


def _divs(page: Column, css_class: str) -> Column:
    return F.regexp_extract_all(page, F.lit(rf'(?is)<div\b[^>]*class="[^"]*\b{css_class}\b[^"]*"[^>]*>(.*?)</div>'), F.lit(1))


def _inner_text(c: Column) -> Column:
    c = F.regexp_replace(c, H.TAG, "")
    for pattern, character in H.ENTITIES:
        c = F.regexp_replace(c, pattern, character)
    return c


def listing(pages: DataFrame, base_url: str, page_col: str = "page", html_col: str = "html") -> DataFrame:
    """Catalogue records of listing pages with page and idx: the i-th title goes with the i-th author, publisher's line and annotation.

    Entries without a link are left out; a missing year, author or annotation is null.
    """
    p = F.col(html_col)
    zipped = F.arrays_zip(_divs(p, "book_body_title").alias("title"), _divs(p, "book_body_author").alias("author"), _divs(p, "book_body_izdat_full").alias("izdat"), _divs(p, "book_body_annot").alias("annot"))
    rows = pages.select(page_col, F.posexplode(zipped).alias("idx", "z"))
    link = r'(?is)<a\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'
    has = F.rlike(F.col("z.title"), F.lit(link))
    return rows.filter(has).select(
        page_col, F.col("idx").cast("long").alias("idx"), X.strip(_inner_text(F.regexp_extract("z.title", link, 2))).alias("title"), X.year(_inner_text(F.col("z.izdat"))).alias("year"),
        X.author(_inner_text(F.col("z.author"))).alias("author"), X.absolute_url(base_url, F.regexp_extract("z.title", link, 1)).alias("url"), _inner_text(F.col("z.annot")).alias("abstract"),
    )


def zipped(df: DataFrame, key_col: str, **lists: Column) -> DataFrame:
    """A row per position of several lists; shorter lists give nulls."""
    named = F.arrays_zip(*[c.alias(n) for n, c in lists.items()])
    return df.select(key_col, F.posexplode(named).alias("idx", "z")).select(key_col, F.col("idx").cast("long").alias("idx"), *[F.col(f"z.{n}").alias(n) for n in lists])


def download_link(page: Column, base_url: str) -> Column:
    """The absolute URL of the preferred file of a book's page; null without one."""
    found = H.preferred(H.link_urls(page))
    return F.when(found.isNotNull(), X.absolute_url(base_url, found))


def fetch_http(url: str, timeout: float = 60.0) -> bytes:
    with urllib.request.urlopen(url, timeout=timeout) as response:  # noqa: S310
        return response.read()


def fetch_blocks(url: str, size: int = DOWNLOAD_BLOCK, timeout: float = 60.0) -> Iterator[bytes]:
    """A body in blocks, so that a book never is in memory as a whole."""
    with urllib.request.urlopen(url, timeout=timeout) as response:  # noqa: S310
        while block := response.read(size):
            yield block


def fetch_pages(spark: SparkSession, template: str, max_pages: int, fetch: Callable[[str], bytes] = fetch_http, delay: float = DELAY_BETWEEN_PAGES) -> DataFrame:
    """(page, url, html, error): listing pages 0 to max_pages - 1, fetched one by one in a single polite task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for batch in batches:
            for page, url in zip(batch["page"], batch["url"], strict=True):
                if not first:
                    time.sleep(delay)
                first = False
                try:
                    yield pd.DataFrame({"page": [page], "url": [url], "html": [fetch(url).decode("utf-8", "replace")], "error": [None]})
                except Exception as e:  # noqa: BLE001  a page that fails is a row with its error
                    yield pd.DataFrame({"page": [page], "url": [url], "html": [None], "error": [repr(e)]})

    pages = spark.range(0, max_pages, 1, 1).select(F.col("id").alias("page"), X.listing_url(F.col("id"), template).alias("url"))
    return pages.mapInPandas(run, "page long, url string, html string, error string")


def download(books: DataFrame, folder: str, base_url: str, fetch: Callable[[str], bytes] = fetch_http, concurrent: int = CONCURRENT, delay: tuple[float, float] = DELAY_BEFORE_DOWNLOAD, blocks: Callable[[str], Iterator[bytes]] | None = None) -> DataFrame:
    """(url, path, status, bytes): each book's preferred file, stored in folder under its base name.

    ``folder`` must be shared by all executors. At most ``concurrent`` downloads run at once; a book that fails is a row with its error.
    """
    pattern = H.LINK
    blocks = blocks or (fetch_blocks if fetch is fetch_http else lambda url: [fetch(url)])

    def one(url: str) -> tuple[str | None, str, int]:
        import re

        hrefs = [m.group(1) for m in re.finditer(pattern.replace("(?is)", ""), fetch(url).decode("utf-8", "replace"), re.I | re.S)]
        link = next((h for s in (".pdf", ".djvu") for h in hrefs if h.endswith(s)), None)
        if link is None:
            return None, "no file", 0
        from urllib.parse import urljoin

        target = urljoin(base_url, link)
        time.sleep(random.uniform(*delay))  # noqa: S311
        path = os.path.join(folder, os.path.basename(target))
        os.makedirs(folder, exist_ok=True)
        part, n = f"{path}.part{uuid.uuid4().hex}", 0
        try:
            with open(part, "wb") as f:
                for block in blocks(target):
                    n += f.write(block)
            os.replace(part, path)  # a download that breaks off leaves no file of that name
        finally:
            if os.path.exists(part):
                os.remove(part)
        return path, "ok", n

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for url in batch["url"]:
                try:
                    path, status, n = one(url)
                except Exception as e:  # noqa: BLE001
                    path, status, n = None, repr(e), 0
                yield pd.DataFrame({"url": [url], "path": [path], "status": [status], "bytes": [n]})

    return books.select("url").repartition(concurrent).mapInPandas(run, schemas.DOWNLOAD)
