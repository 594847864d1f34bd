"""Answers that a model streams in pieces, joined by request.

Pieces come in any order, and again after a retry or a restart. An answer is complete when its last piece and all before it are there; empty pieces count for that and
add nothing. A request that stays incomplete until its time is up gives an error row with what there is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ANSWER = "request string, answer string, pieces int, error string"
TIMED_OUT = "the answer is incomplete"


class Joiner(StatefulProcessor):
    """Keeps a request's pieces by number; repeated pieces change nothing."""

    def __init__(self, timeout_ms: int) -> None:
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getMapState("pieces", "number int", "text string")
        self.state = handle.getValueState("state", "last int, done boolean, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, done, due = self.state.get() if self.state.exists() else (-1, False, 0)
        if done:
            for _ in rows:
                pass
            return
        seen = timerValues.getCurrentWatermarkInMs()
        for batch in rows:
            seen = max(seen, int(batch["at"].max().timestamp() * 1000))
            for number, text, is_last in zip(batch["number"], batch["text"], batch["is_last"], strict=True):
                if not self.pieces.containsKey((int(number),)):
                    self.pieces.updateValue((int(number),), (text or "",))
                if is_last:
                    last = max(last, int(number))
        if due:
            self.handle.deleteTimer(due)
        due = seen + self.timeout_ms
        self.handle.registerTimer(due)
        if last >= 0 and all(self.pieces.containsKey((k,)) for k in range(last + 1)):
            text = "".join(self.pieces.getValue((k,))[0] for k in range(last + 1))
            self.pieces.clear()
            self.state.update((last, True, due))  # late copies are known until the time is up
            yield pd.DataFrame({"request": [key[0]], "answer": [text.strip()], "pieces": [last + 1], "error": [None]})
        else:
            self.state.update((last, False, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, done, _ = self.state.get() if self.state.exists() else (-1, True, 0)
        if not done:
            found = sorted((k[0], v[0]) for k, v in self.pieces.iterator())
            yield pd.DataFrame({"request": [key[0]], "answer": ["".join(text for _, text in found)], "pieces": [len(found)], "error": [TIMED_OUT]})
        self.pieces.clear()
        self.state.clear()

    def close(self) -> None:
        pass


def join_stream(pieces: DataFrame, timeout: str = "10 minutes") -> DataFrame:
    """(request, answer, pieces, error) of a stream of (request, number from 0, text, is_last, at): complete answers, and after timeout of event time incomplete ones with an error.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass = PROVIDER), and a watermark is set on ``at``. The state of a request is its pieces, until
    the answer is out, and then a mark against late copies, until the time is up.
    """
    if pieces.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be {PROVIDER}")
    own = pieces.select(F.col("request").cast("string").alias("request"), F.col("number").cast("int").alias("number"), "text", F.col("is_last").cast("boolean").alias("is_last"), "at").withWatermark("at", timeout)
    return own.groupBy("request").transformWithStateInPandas(Joiner(_milliseconds(timeout)), outputStructType=ANSWER, outputMode="Append", timeMode="EventTime")


def _milliseconds(text: str) -> int:
    number, _, unit = text.partition(" ")
    return int(float(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1000)


def join_batch(pieces: DataFrame) -> DataFrame:
    """The same of a table of all pieces: an answer without its last piece or with a gap is incomplete.

    Repeated pieces count once (of unlike ones with a number the first in order of text). Pieces without a request or number are left out.
    """
    own = pieces.select(F.col("request").cast("string").alias("request"), F.col("number").cast("int").alias("number"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("is_last").cast("boolean"), F.lit(False)).alias("is_last")).filter("request IS NOT NULL AND number >= 0")
    once = own.groupBy("request", "number").agg(F.min("text").alias("text"), F.max("is_last").alias("is_last"))
    found = once.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("number", "text"))).alias("parts"), F.max(F.when(F.col("is_last"), F.col("number"))).alias("last"), F.count("*").cast("int").alias("n"))
    complete = F.coalesce(F.size(F.filter("parts", lambda p: p["number"] <= F.col("last"))) == F.col("last") + 1, F.lit(False))
    needed = F.filter("parts", lambda p: ~complete | (p["number"] <= F.col("last")))
    text = F.array_join(F.transform(needed, lambda p: p["text"]), "")
    return found.select("request", F.when(complete, F.trim(text)).otherwise(text).alias("answer"), F.when(complete, F.col("last") + 1).otherwise(F.col("n")).alias("pieces"), F.when(~complete, F.lit(TIMED_OUT)).alias("error"))
