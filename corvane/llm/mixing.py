"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

A source with n rows and the target weight w gets a mean repetition rate total * w / n. Each row draws its
number of copies by inverting the Poisson distribution of that rate at a uniform number hashed from seed
and id; the row is exploded by that number, and the copies are shuffled globally by a hashed key.

The inversion reads a table of cumulative probabilities per source. Rates above ``PIECE`` are split
into equal pieces with a draw for each (a sum of Poissons is Poisson), so the tables stay short and
exp(-rate) never underflows. The rates meet the rows by source and salt: a source with at least one in ``HOT`` of all
rows (so there are ``HOT`` of them at most) is spread over ``SALTS`` keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import hashed_uniform, stage

PIECE = 16.0
SALTS = 256
HOT = 1000
ALPHA = 0.5
SEED = 20


def source_rates(docs: DataFrame, source_col: str = "source", weights: DataFrame | None = None, alpha: float = ALPHA, total_rows: int | None = None) -> DataFrame:
    """source, n, rate, pieces, cdf: one row per source of docs.

    weights: (source, weight) with weights of 0 or more, relative to each other; sources without one get 0.
    Without weights a source of n rows has the weight n ** alpha (alpha 1 keeps the shares, 0 makes them equal).
    total_rows is the expected number of rows out, by default the number in. A null source is a source.
    """
    n = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        sized = n.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(float(alpha))))
    else:
        w = weights.select(F.col("source").alias("__source"), F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("__w"))
        w = w.groupBy("__source").agg(F.sum("__w").alias("weight"))
        sized = n.join(w, n["source"].eqNullSafe(w["__source"]), "left").select("source", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    rows, mass = sized.agg(F.sum("n"), F.sum("weight")).first()  # one row, whatever the number of sources
    total = float(total_rows if total_rows is not None else rows or 0)
    rate = F.lit(total) * F.col("weight") / F.lit(float(mass or 1.0)) / F.col("n")
    piece = F.col("rate") / F.col("pieces")
    steps = F.sequence(F.lit(1), (F.ceil(piece + 12 * F.sqrt(piece)) + 24).cast("int"))
    grown = F.aggregate(
        steps,
        F.struct(F.exp(-piece).alias("p"), F.array(F.exp(-piece)).alias("cdf")),
        lambda a, k: F.struct((a["p"] * piece / k).alias("p"), F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + a["p"] * piece / k)).alias("cdf")),
        lambda a: a["cdf"],
    )
    return (
        sized.withColumn("rate", rate)
        .withColumn("pieces", F.greatest(F.ceil(F.col("rate") / PIECE), F.lit(1)).cast("int"))
        .withColumn("cdf", grown)
        .select("source", "n", "rate", "pieces", "cdf")
    )


def with_copies(docs: DataFrame, rates: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """row (all columns of docs), id and n_copies (long) of each row."""
    rates = stage(rates, "mixing-rates", narrow=True)
    total = rates.agg(F.sum("n")).first()[0] or 0  # one number
    is_hot = F.col("n") * HOT >= total
    salted = rates.select("source", "pieces", "cdf", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("to"))
    hot = rates.filter(is_hot).select(F.col("source").alias("hot"), F.lit(True).alias("is_hot"))  # HOT rows at most
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("own"))
    salt = F.when(F.col("is_hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0).cast("int")
    rows = rows.join(F.broadcast(hot), rows["own"].eqNullSafe(hot["hot"]), "left").select("row", "id", "own", salt.alias("salt"))
    joined = rows.join(salted, rows["own"].eqNullSafe(salted["source"]) & (rows["salt"] == salted["to"])).select("row", "id", "pieces", "cdf")
    of_id = F.coalesce(F.col("id").cast("string"), F.lit(""))
    draw = F.aggregate(
        F.sequence(F.lit(1), F.col("pieces")),
        F.lit(0),
        lambda a, j: a + F.size(F.filter("cdf", lambda c: c <= hashed_uniform(F.lit(seed), of_id, j))),
    )
    joined = joined.withColumn("u", F.when(F.col("pieces") == 1, hashed_uniform(F.lit(seed), of_id, F.lit(1))))
    copies = F.when(F.col("pieces") == 1, F.size(F.filter("cdf", lambda c: c <= F.col("u")))).otherwise(draw)
    return joined.select("row", "id", copies.cast("long").alias("n_copies"))


def poisson_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: DataFrame | None = None, alpha: float = ALPHA, total_rows: int | None = None, seed: int = SEED) -> DataFrame:
    """docs with n_copies, copy_no (from 1) and order_key, each row as often as it was drawn, in a global random order.

    Rows with equal ids (repeated rows) draw the same number; a null id draws as the empty one. A source of
    weight 0 vanishes; a null source is a source like the others. Null, empty and long texts are carried as they are. An empty table
    gives an empty result. The result's columns replace columns of docs with the same names; other columns pass through, whatever their names.
    """
    kept = [c for c in docs.columns if c not in ("n_copies", "copy_no", "order_key")]
    rates = source_rates(docs, source_col, weights, alpha, total_rows)
    drawn = with_copies(docs.select(kept), rates, id_col, source_col, seed)
    copies = drawn.filter("n_copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("long"), "n_copies")))
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"order{seed}"), F.col("id").cast("string"), F.col("copy_no").cast("string"))), 1, 15), 16, 10).cast("long")
    ordered = copies.select("row", "n_copies", "copy_no", key.alias("order_key")).repartition("order_key").sortWithinPartitions("order_key")
    return ordered.select(*(F.col("row").getField(c).alias(c) for c in kept), "n_copies", "copy_no", "order_key")


ORACLE = f"""
WITH s AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {ALPHA}) AS weight FROM documents GROUP BY source),
t AS (SELECT sum(n)::DOUBLE AS total, sum(weight) AS mass FROM s),
r AS (SELECT source, total * weight / mass / n AS rate, greatest(ceil(total * weight / mass / n / {PIECE}), 1)::INT AS pieces FROM s, t),
q AS (SELECT source, pieces, rate / pieces AS piece FROM r),
c AS (SELECT source, pieces, list_reduce(
        list_prepend({{'p': exp(-piece), 'cdf': [exp(-piece)]}}, list_transform(generate_series(1, (ceil(piece + 12 * sqrt(piece)) + 24)::INT), lambda k: {{'p': piece / k, 'cdf': [0.0::DOUBLE]}})),
        lambda a, b: {{'p': a.p * b.p, 'cdf': list_append(a.cdf, a.cdf[-1] + a.p * b.p)}}).cdf AS cdf FROM q),
d AS (SELECT doc_id, text, documents.source, list_sum(list_transform(generate_series(1, pieces), lambda j:
        len(list_filter(cdf, lambda x: x <= ('0x' || substr(md5('{SEED}|' || doc_id || '|' || j), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0))))::BIGINT AS n_copies
      FROM documents JOIN c ON documents.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, source, sha256(coalesce(text, '')) AS text_sha256, n_copies, copy_no, ('0x' || substr(md5('order{SEED}|' || doc_id || '|' || copy_no), 1, 15))::BIGINT AS order_key
FROM (SELECT *, unnest(generate_series(1, n_copies)) AS copy_no FROM d WHERE n_copies > 0)
"""
