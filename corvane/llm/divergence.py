"""Audit of how far the sources of a language diverge in their vocabulary, by joint count histograms.

Terms are counted by (language, source) in Arrow batches, summed before the shuffle. A language keeps the terms of at least
``least_docs`` of its documents. For each pair of its sources the distinct (count, count) combinations of the kept terms are
tallied: cells where both sources have the term come from the terms' rows, cells with a zero on one side or on both are implied by the
sources' own histograms of counts and by the number of kept terms. The divergence of a combination is evaluated once and taken
times its multiplicity, so a pair costs its combinations, not its vocabulary.

With N the occurrences of kept terms in a source and V the kept terms of its language, a term with ``count`` occurrences weighs
p = 1 + floor(UNIT * (count + 2) / (N + 2 V)); two weights diverge by floor((p - q)^2 / (p + q)). Arithmetic is in integers throughout.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.shared import LETTERS, pieces, stage, text_or_empty

#: Documents of a language that must hold a term, and how many diverging terms a source reports.
LEAST_DOCS, TOP_TERMS = 10, 10
#: What the weights of a source sum up to, about.
UNIT = 1_000_000_000
#: Distinct (group, term) entries that a task holds, and cells and pairs tallied at once.
ENTRIES, CELLS, PAIRS = 1 << 18, 1 << 18, 1 << 21
#: Rows of an Arrow batch of counts.
ROWS = 1 << 15

def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, text -> lang, source, term, occurrences, documents; summed over at least ENTRIES entries or the task."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, docs) in held.items():
            terms = list(counts)
            for k in range(0, len(terms), ROWS):
                own = terms[k : k + ROWS]
                columns = [pa.array([lang] * len(own)), pa.array([source] * len(own)), pa.array(own, pa.string())]
                columns += [pa.array([of[t] for t in own], pa.int64()) for of in (counts, docs)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        langs, sources = (batch.column(k).to_pylist() for k in range(2))
        for lang, source, raw in zip(langs, sources, batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            if (lang, source) not in held:
                held[lang, source] = Counter(), Counter()
            counts, docs = held[lang, source]
            seen: set[bytes] = set()
            for piece in pieces(raw, LETTERS):
                terms = piece.split()
                counts.update(terms)
                seen.update(terms)
            docs.update(seen)
        if sum(len(docs) for _, docs in held.values()) >= ENTRIES:
            yield from flushed()
    yield from flushed()


def kept_terms(documents: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term, total, cells (source, n; by source) of each term that at least least_docs documents of its language hold.

    documents has lang, source and text without nulls. One shuffle, of sums: a frequent term has a row for each task and source.
    """
    counts = documents.select("lang", "source", "text").mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    by_source = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    cells = F.sort_array(F.collect_list(F.struct("source", "n")))
    return by_source.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), cells.alias("cells")).filter(F.col("docs") >= least_docs).drop("docs")


def _first_of_runs(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def joint_tallies(lang: np.ndarray, term: np.ndarray, source: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Cells in order of term and source -> (lang, source, source, count, count, terms) of each combination that pairs of cells of a term have.

    lang and source are small codes. Combinations may come again in a later tuple, after each PAIRS pairs or so.
    """
    values, place = np.unique(count, return_inverse=True)
    sources, n = int(source.max(initial=0)) + 1, len(values)
    held, size = [], 0

    def summed() -> tuple[np.ndarray, ...]:
        who, what = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((what, who))
        who, what = who[order], what[order]
        first = _first_of_runs(who, what)
        times = np.diff(first, append=len(who))
        who, what = who[first], what[first]
        return who // sources**2, who // sources % sources, who % sources, values[what // n], values[what % n], times

    far = 1
    while True:
        one = np.flatnonzero(term[:-far] == term[far:])
        if not len(one):  # no term has so many cells
            break
        other = one + far
        held.append(((lang[one] * sources + source[one]) * sources + source[other], place[one] * n + place[other]))
        size += len(one)
        if size >= PAIRS:
            yield summed()
            held, size = [], 0
        far += 1
    if held:
        yield summed()


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, cells -> lang, a, b, count_a, count_b, terms."""

    def tally(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held).combine_chunks()
        cells = whole.column(1).combine_chunks()
        lengths = np.diff(cells.offsets.to_numpy())
        flat = cells.flatten()
        names, langs = flat.field("source").dictionary_encode(), whole.column(0).combine_chunks().dictionary_encode()
        sources = np.array(names.dictionary.to_pylist(), object)
        order = np.array(sorted(range(len(sources)), key=lambda k: sources[k].encode()), np.int64)
        rank = np.argsort(order)
        term = np.repeat(np.arange(len(lengths)), lengths)
        found = joint_tallies(np.repeat(langs.indices.to_numpy().astype(np.int64), lengths), term, rank[names.indices.to_numpy()], flat.field("n").to_numpy())
        for lang, a, b, count_a, count_b, times in found:
            for k in range(0, len(lang), ROWS):
                at = slice(k, k + ROWS)
                columns = [langs.dictionary.take(pa.array(lang[at])), *(names.dictionary.take(pa.array(order[x[at]])) for x in (a, b)), *(pa.array(x[at]) for x in (count_a, count_b, times))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "a", "b", "count_a", "count_b", "terms"])

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += len(batch.column(1).flatten())
        if size >= CELLS:
            yield from tally(held)
            held, size = [], 0
    if held:
        yield from tally(held)


def weight(count: Column, mass: Column, terms: Column) -> Column:
    """p of a term with count occurrences in a group with mass occurrences of the kept terms, exact; null if the language keeps none."""
    whole = F.lit(UNIT).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    return 1 + F.call_function("div", whole, F.nullif(mass + 2 * terms, F.lit(0)).cast("decimal(20,0)"))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pair_values(kept: DataFrame, cells: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b, value for each two sources a < b of a language."""
    g = groups.select("lang", "source", "mass", "terms")
    a, b = g.withColumnsRenamed({"source": "a", "mass": "mass_a"}), g.select("lang", F.col("source").alias("b"), F.col("mass").alias("mass_b"))
    pairs = a.join(b, "lang").filter("a < b")
    combination = "lang string, a string, b string, count_a long, count_b long, terms long"
    zero = F.lit(0).cast("long")

    def cell(count_a: Column, count_b: Column, terms: Column) -> Column:
        return F.struct(count_a.alias("count_a"), count_b.alias("count_b"), terms.alias("terms"))

    # both have the term: such a term is no longer one that only a, only b, or neither has
    both = kept.select("lang", "cells").mapInArrow(_tallied, combination)
    x, y, n = F.col("count_a"), F.col("count_b"), F.col("terms")
    both = both.select("lang", "a", "b", F.explode(F.array(cell(x, y, n), cell(x, zero, -n), cell(zero, y, -n), cell(zero, zero, n))).alias("c")).select("lang", "a", "b", "c.*")
    # each source's histogram, against each other source as if that had none of the terms
    histogram = cells.groupBy("lang", "source", F.col("n").alias("count")).agg(F.count("*").alias("n"))
    other = histogram.join(g.select("lang", F.col("source").alias("other")), "lang").filter("source != other")
    first, c = F.col("source") < F.col("other"), F.col("count")
    one = other.select("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), F.explode(F.array(cell(F.when(first, c).otherwise(zero), F.when(first, zero).otherwise(c), F.col("n")), cell(zero, zero, -F.col("n")))).alias("c")).select("lang", "a", "b", "c.*")
    neither = pairs.select("lang", "a", "b", zero.alias("count_a"), zero.alias("count_b"), "terms")
    tallies = both.unionByName(one).unionByName(neither).groupBy("lang", "a", "b", "count_a", "count_b").agg(F.sum("terms").alias("times")).filter("times != 0")
    known = tallies.join(a, ["lang", "a"]).join(b, ["lang", "b"])
    value = F.col("times") * divergence(weight(x, F.col("mass_a"), n), weight(y, F.col("mass_b"), n))
    values = known.groupBy("lang", "a", "b").agg(F.sum(value).alias("value"))
    return pairs.select("lang", "a", "b").join(values, ["lang", "a", "b"], "left").select("lang", "a", "b", F.coalesce("value", zero).alias("value"))


def audit_sources(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank for each (language, source) that occurs.

    Part ``pair``: the divergence from each other source of the language, summed over all kept terms (0 without any), all ranks.
    Part ``term``: the top_terms terms that the source has with more weight than its language, by divergence.

    Null texts, languages and sources count as empty ones, and so does a text without terms, whose group still is compared. Repeated
    rows count as often as they are there. Ties go to the item that is first in UTF-8 order. An empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    rows = documents.select(*(text_or_empty(F.col(name)).alias(alias) for name, alias in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    kept = stage(kept_terms(rows, least_docs), "divergence-terms")
    cells = kept.select("lang", "term", "total", F.explode("cells").alias("cell")).select("lang", "term", "total", "cell.*")
    mass = cells.groupBy("lang", "source").agg(F.sum("n").alias("mass"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_mass"))
    found = rows.select("lang", "source").distinct().join(mass, ["lang", "source"], "left").join(terms, "lang", "left")
    groups = stage(found.na.fill(0, ["mass", "terms", "lang_mass"]), "divergence-groups", narrow=True)

    values = stage(_pair_values(kept, cells, groups), "divergence-pairs", narrow=True)
    pairs = values.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value").select("lang", "x.*", "value")

    p, q = weight(F.col("n"), F.col("mass"), F.col("terms")), weight(F.col("total"), F.col("lang_mass"), F.col("terms"))
    weighed = cells.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    diverging = weighed.select("lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    all_pairs = pairs.withColumns({"part": F.lit("pair"), "rank": rank}).select(columns)
    top = diverging.withColumns({"part": F.lit("term"), "rank": rank}).filter(F.col("rank") <= top_terms).select(columns)
    return all_pairs.unionByName(top)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
#: The same by evaluating every term of every pair.
ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_WORDS} AS words FROM documents),
g AS (SELECT DISTINCT lang, source FROM docs),
occurs AS (SELECT r, lang, source, unnest(words) AS term FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM occurs GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS lang_mass FROM kept GROUP BY ALL),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM occurs JOIN kept USING (lang, term) GROUP BY ALL),
mass AS (SELECT lang, source, sum(n)::HUGEINT AS mass FROM c GROUP BY ALL),
weighed AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + ({UNIT}::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(mass, 0) + 2 * v) AS p, 1 + ({UNIT}::HUGEINT * (k.total + 2)) // (lang_mass + 2 * v) AS q
  FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN mass ON mass.lang = g.lang AND mass.source = g.source),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM weighed a JOIN weighed b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
both_parts AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pairs ON pairs.lang = x.lang AND pairs.source = x.source AND pairs.item = y.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM weighed WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM both_parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
