"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import shared_dir, spread

#: Bytes of a text that pieces() hands out at once, about.
PIECE = 1 << 20
#: For each byte of a UTF-8 text: A-Z lower-cased, a-z and all beyond ASCII as they are, a space for others; and the same with digits.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LETTERS_DIGITS = bytes(b if 48 <= b <= 57 else c for b, c in enumerate(LETTERS))

#: ASCII white space as the contracts define it.
ASCII_WS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


class Tables:
    """The tables that stage() has written within a scope, in order."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def drop(self, *keep: str) -> None:
        """Deletes the tables of the scope, but for the last one of each of these names. What reads the others must have run by then."""
        last = {path.rpartition("/")[2].rpartition("-")[0]: path for path in self.paths}
        kept = {last[name] for name in keep if name in last}
        gone = {path for path in self.paths if path not in kept}
        for path in gone:
            delete(self.spark, path)
        for tables in {self, *_scope.get()}:
            tables.paths[:] = [path for path in tables.paths if path not in gone]


_scope: ContextVar[tuple[Tables, ...]] = ContextVar("scope", default=())


@contextmanager
def scope(spark: SparkSession) -> Iterator[Tables]:
    """Notes the tables that the operators called within it write; a scope within another one belongs to both."""
    tables = Tables(spark)
    before = _scope.set((*_scope.get(), tables))
    try:
        yield tables
    finally:
        _scope.reset(before)


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, noted in the scopes."""
    path = f"{shared_dir(spark)}/corvane/{name}-{uuid.uuid4().hex}"
    for tables in _scope.get():
        tables.paths.append(path)
    return path


def stage(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it again.

    It cuts the lineage, survives lost executors, and freezes values that depend on the partitioning. narrow: for tables of a
    few numbers a row, which are written by two tasks a core at most, so that they don't become many tiny files.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    written = df.coalesce(2 * spark.sparkContext.defaultParallelism) if narrow else df
    written.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def hashed_uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits from the md5 of the parts, the same in every engine."""
    key = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def pieces(raw: bytes, table: bytes) -> Iterator[bytes]:
    """A UTF-8 text by one of the tables above, in pieces of PIECE bytes and as many more as end the last word."""
    at = 0
    while at < len(raw):
        end = at + PIECE
        while end < len(raw) and table[raw[end]] != 32:
            end += 1
        yield raw[at:end].translate(table)
        at = end
