"""Listing pages of catalogue sites as a data source: one partition for a host, polite within it, filters sent along.

    listing = read_listing(spark, ["https://a.org/books", "https://b.org/list"], pages=20)
    listing.filter("language IN ('de', 'fr') AND topic = '1'")

asks for ``https://a.org/books?page=0&language=de&topic=1`` and so on. Filters on language, topic, page and host are turned into
requests (Spark's filter pushdown for Python data sources); without one a page is asked for with the source's default languages and topics, or once without the parameter.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: Seconds between two requests to a host, attempts at a page, and bytes of a page at most.
DELAY, ATTEMPTS, MOST_BYTES = 2.0, 3, 1 << 26
FORMAT = "catalogue_listing"


def request_url(base: str, page: int, **parameters: str | None) -> str:
    """The URL of a listing page; parameters without a value are left out."""
    given = "".join(f"&{quote(k)}={quote(v, safe='')}" for k, v in parameters.items() if v is not None)
    return f"{base}{'&' if '?' in base else '?'}page={page}{given}"


@dataclass
class HostPartition(InputPartition):
    """All requests to a host, in order: (base, page, language, topic)."""

    host: str
    requests: list[tuple[str, int, str | None, str | None]]

    def __post_init__(self) -> None:
        super().__init__(self.host)


class ListingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.bases = json.loads(options["urls"])
        self.pages, self.delay, self.attempts = int(options.get("pages", "1")), float(options.get("delay", DELAY)), int(options.get("attempts", ATTEMPTS))
        if not self.bases or self.pages < 0 or self.delay < 0 or self.attempts < 1:
            raise ValueError("a listing needs urls, and no negative numbers")
        self.names = {k: options.get(f"{k}_parameter", k) for k in ("language", "topic")}
        # what to ask for by column; None: any page or host, or no parameter
        self.wanted: dict[str, list] = {k: json.loads(options.get(f"{k}s", "[]")) or [None] for k in self.names}
        self.allowed: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if column not in ("language", "topic", "page", "host"):
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.allowed[column] = self.allowed.get(column, values) & values

    def partitions(self) -> list[InputPartition]:
        def values(column: str) -> list[str | None]:
            if column not in self.allowed:
                return self.wanted[column]
            # a default list bounds what can be asked for
            return sorted(v for v in self.allowed[column] if v is not None and (self.wanted[column] == [None] or v in self.wanted[column]))

        hosts: dict[str, list[tuple[str, int, str | None, str | None]]] = {}
        for base in self.bases:
            host = urlsplit(base).netloc
            if host in self.allowed.get("host", {host}):
                pages = [p for p in range(self.pages) if p in self.allowed.get("page", {p})]
                hosts.setdefault(host, []).extend((base, p, lang, topic) for lang in values("language") for topic in values("topic") for p in pages)
        return [HostPartition(host, requests) for host, requests in hosts.items() if requests] or [HostPartition("", [])]

    def read(self, partition: HostPartition) -> Iterator[tuple]:
        free_at = 0.0  # when the host may be asked next
        for base, page, language, topic in partition.requests:
            url = request_url(base, page, **{self.names["language"]: language, self.names["topic"]: topic})
            html = error = None
            for _ in range(self.attempts):
                time.sleep(max(0.0, free_at - time.monotonic()))
                try:
                    with urllib.request.urlopen(url, timeout=60) as response:  # noqa: S310
                        html, error = response.read(MOST_BYTES).decode("utf-8", "replace"), None
                    break
                except Exception as e:  # noqa: BLE001  a page that fails is a row with its error
                    error = f"{type(e).__name__}: {e}"
                    if 400 <= getattr(e, "code", 0) < 500:
                        break  # asking again won't help
                finally:
                    free_at = time.monotonic() + self.delay
            yield partition.host, page, language, topic, url, html, error


class ListingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "host string, page long, language string, topic string, url string, html string, error string"

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(dict(self.options))


def read_listing(spark: SparkSession, urls: list[str], pages: int, delay: float = DELAY, attempts: int = ATTEMPTS, languages: list[str] | None = None, topics: list[str] | None = None, language_parameter: str = "language", topic_parameter: str = "topic") -> DataFrame:
    """host, page, language, topic, url, html, error of the pages 0 to pages - 1 of each listing URL.

    A host is one partition, so its requests keep delay seconds apart whatever the number of executors, and hosts are asked side by side. A page that fails after
    all attempts is a row with its error; a client error (404, say) is not asked for again. Pushdown for Python sources is switched on in the session, as Spark refuses such a source otherwise.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ListingSource)
    options = {"urls": json.dumps(urls), "pages": pages, "delay": delay, "attempts": attempts, "languages": json.dumps(languages or []), "topics": json.dumps(topics or []), "language_parameter": language_parameter, "topic_parameter": topic_parameter}
    return spark.read.format(FORMAT).options(**options).load()


def listing_requests(sites: DataFrame, base: Column, pages: Column, **parameters: Column) -> DataFrame:
    """sites with page and url: a row per listing page, for as many pages as the column pages says; parameters without a value are left out."""
    given = [F.coalesce(F.concat(F.lit(f"&{quote(k)}="), F.url_encode(v)), F.lit("")) for k, v in parameters.items()]
    joint = F.when(F.contains(base, F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    rows = sites.withColumn("page", F.explode(F.when(pages > 0, F.sequence(F.lit(0).cast("long"), pages.cast("long") - 1))))
    return rows.withColumn("url", F.concat(base, joint, F.lit("page="), F.col("page").cast("string"), *given))
