"""Exact dedup by a tree-merge of sorted digest runs (DataFrame functions only).

Every row gets a leaf bucket from its id. A leaf's run holds one row per digest: the smallest
identifier and the number of rows. In each round ``fan_in`` runs are exchanged and merged into one
(with a fan-in of 16, four binomial rounds at once), until the root has one row per text. The minimum
over a struct is no hash-aggregate type, so Spark merges with SortAggregate: runs stay sorted by digest.
The root's verdict then goes down to the leaf runs and from those to the rows. A text that a third of
all rows share is one row per task after the map-side merge, at most ``fan_in ** rounds`` rows at the
root, and spread over as many keys where it meets its rows.

A run's key is the SHA-256 with the length in bytes and a second, independent hash, so that each merge
verifies that the identifiers it joins belong to the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import ASCII_WS, stage, text_or_empty

FAN_IN = 16
ROUNDS = 3
_KEY = ["__digest", "__bytes", "__check"]


def normalised(text_col: str):
    return F.regexp_replace(text_or_empty(F.col(text_col)), ASCII_WS, " ")


def digest_rows(docs: DataFrame, id_col: str, text_col: str, leaves: int) -> DataFrame:
    norm = docs.select(F.col(id_col).alias("__id"), normalised(text_col).alias("__norm"))
    return norm.select(
        "__id",
        F.monotonically_increasing_id().alias("__row"),
        F.pmod(F.xxhash64("__id"), F.lit(leaves)).alias("__bucket"),
        F.unhex(F.sha2("__norm", 256)).alias("__digest"),
        F.octet_length("__norm").cast("long").alias("__bytes"),
        F.xxhash64("__norm").alias("__check"),
    )


def merge_tree(rows: DataFrame, fan_in: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """The leaf runs, and the root run: one row per text with its smallest identifier and row count."""
    first = F.struct(F.col("__id").isNull().alias("missing"), F.col("__id").alias("id"), F.col("__row").alias("row"))
    leaf = run = rows.groupBy("__bucket", *_KEY).agg(F.min(first).alias("__best"), F.count(F.lit(1)).alias("__n"))
    for _ in range(rounds):
        run = (
            run.withColumn("__bucket", F.floor(F.col("__bucket") / fan_in))
            .groupBy("__bucket", *_KEY)
            .agg(F.min("__best").alias("__best"), F.sum("__n").alias("__n"))
        )
    return leaf, run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space becomes one space; null counts as
    empty, so null and empty texts are one group. The smallest id stays. A null id loses against any other
    (a group of null ids alone has a null keep_id). Of repeated rows with the same id and text exactly one
    is kept. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    leaves = fan_in**rounds
    rows = stage(digest_rows(docs, id_col, text_col, leaves), "dedup-digests")
    leaf, root = merge_tree(rows, fan_in, rounds)
    verdict = root.select(*_KEY, F.col("__best").alias("__keep"), F.col("__n").alias("__size"))
    down = leaf.select("__bucket", *_KEY).join(verdict, _KEY)
    return rows.join(down, ["__bucket", *_KEY]).select(
        F.col("__id").alias(id_col),
        F.col("__keep.id").alias("keep_id"),
        F.col("__size").cast("long").alias("group_size"),
        (F.col("__row") == F.col("__keep.row")).alias("kept"),
        F.lower(F.hex("__digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all its columns, without the rows that exact_dedup() doesn't keep.

    Null counts as empty, as there, and a null id stays only where no other row has the text. Of repeated rows with the same id and text
    one stays. An empty table gives an empty result; names of other columns don't matter.
    """
    found = exact_dedup(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.unhex("text_sha256").alias("sha"), "keep_id", "kept")
    found = stage(found, "dedup-verdicts")
    # a text's own keeper loses only as a repeated row, which goes by its rank below
    lost = found.filter(~F.col("id").eqNullSafe(F.col("keep_id"))).select("id", "sha").distinct()
    twice = found.filter(F.col("id").eqNullSafe(F.col("keep_id")) & ~F.col("kept")).select("id", "sha").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("own"), F.unhex(F.sha2(normalised(text_col), 256)).alias("digest"))
    meets = lambda other: rows["own"].eqNullSafe(other["id"]) & (rows["digest"] == other["sha"])
    kept = rows.join(lost, meets(lost), "left_anti")
    single = kept.join(twice, meets(twice), "left_anti").select("row")
    if twice.isEmpty():
        return single.select("row.*")
    # repeated rows: equal ones are one row after the map-side part of the aggregate
    repeated = kept.join(twice, meets(twice), "left_semi").groupBy("own", "digest").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row")
    return single.union(repeated).select("row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""
