"""Running heads: lines that come back at the edges of a document's pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of text at each edge of a page that may be heads; pages that must hold one, at least, and as a share of the document's odd or even pages.
EDGE_LINES, LEAST_PAGES, LEAST_SHARE = 3, 3, 0.5


def head_key(line: Column) -> Column:
    """A line without its case, its spaces' lengths and its numbers' digits: a running number is one key."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, r"\s+", " "), "[0-9]+", "#")))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _edges(lines: Column, edge_lines: int) -> Column:
    """(edge, i, key) of the first and the last lines that aren't blank."""
    full = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.trim(F.element_at(lines, i + 1)) != "")
    first = F.slice(full, 1, edge_lines)
    last = F.slice(full, F.greatest(F.size(full) - edge_lines + 1, F.lit(1)), edge_lines)

    def entries(places: Column, edge: str) -> Column:
        return F.transform(places, lambda i: F.struct(F.lit(edge).alias("edge"), i.alias("i"), head_key(F.element_at(lines, i + 1)).alias("key")))

    return F.concat(entries(first, "top"), entries(last, "bottom"))


def running_heads(pages: DataFrame, doc_col: str, page_col: str, text_col: str = "text", edge_lines: int = EDGE_LINES, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(doc, odd, edge, key, pages): the heads of each document's odd and even pages, at the top or at the bottom.

    A head's key stands at that edge of at least least_pages pages and of least_share of the pages with the same parity. Pages are counted by their
    numbers, so a repeated row counts once; pages without a number are a kind of their own. A page sends a row for each edge line at most, summed before the shuffle.
    """
    own = pages.select(F.col(doc_col).alias("doc"), F.col(page_col).alias("page"), (F.col(page_col) % 2 != 0).alias("odd"), _lines(F.col(text_col)).alias("lines"))
    totals = own.groupBy("doc", "odd").agg(F.count_distinct("page").alias("of"))
    entries = own.select("doc", "page", "odd", F.explode(_edges(F.col("lines"), edge_lines)).alias("x")).select("doc", "page", "odd", "x.edge", "x.key")
    counts = entries.groupBy("doc", "odd", "edge", "key").agg(F.count_distinct("page").alias("pages")).filter(F.col("pages") >= least_pages)
    known = counts.withColumnsRenamed({"doc": "d", "odd": "o"})
    return known.join(totals, known["d"].eqNullSafe(totals["doc"]) & known["o"].eqNullSafe(totals["odd"])).filter(F.col("pages") >= least_share * F.col("of")).select("doc", "odd", "edge", "key", "pages")


def drop_running_heads(pages: DataFrame, doc_col: str, page_col: str, text_col: str = "text", edge_lines: int = EDGE_LINES, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """pages without the lines at their edges that are running heads; all else stays, a like line within a page too.

    The heads of a document are a bounded list (2 edges x edge_lines / least_share a parity), so each page meets one row. Null texts stay null; an empty
    table gives an empty result; other columns pass through.
    """
    heads = running_heads(pages, doc_col, page_col, text_col, edge_lines, least_pages, least_share)
    by_doc = heads.groupBy(F.col("doc").alias("__doc")).agg(F.collect_list(F.struct("odd", "edge", "key")).alias("__heads"))
    lines = _lines(F.col(text_col))
    odd = F.col(page_col) % 2 != 0
    own = F.transform(F.filter("__heads", lambda h: h["odd"].eqNullSafe(odd)), lambda h: F.concat_ws("\n", h["edge"], h["key"]))
    gone = F.transform(F.filter(_edges(lines, edge_lines), lambda e: F.array_contains(own, F.concat_ws("\n", e["edge"], e["key"]))), lambda e: e["i"])
    kept = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains(gone, i)), "\n")
    joined = pages.join(by_doc, pages[doc_col].eqNullSafe(by_doc["__doc"]), "left")
    text = F.when(F.col("__heads").isNull() | F.col(text_col).isNull(), F.col(text_col)).otherwise(kept)
    return joined.select(*[text.alias(c) if c == text_col else pages[c] for c in pages.columns])
