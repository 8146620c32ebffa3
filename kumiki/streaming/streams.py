"""Streams: a sliding rate limit by key, an append-only vocabulary, and the sentence plan on a stream of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kumiki.operators.analyze import analyze

WINDOW_S = 60


def admit(times: list[float], held: list[float], limit: int, window: float = WINDOW_S) -> tuple[list[bool], list[float]]:
    """Which calls pass a sliding limit; only admitted calls count against later ones."""
    out = []
    for t in times:
        held = [h for h in held if h > t - window]
        ok = len(held) < limit
        out.append(ok)
        if ok:
            held = [*held, t]
    return out, held


def rate_limit(calls: DataFrame, limit: int, window: float = WINDOW_S) -> DataFrame:
    """key, ts, admitted of a batch of calls (key string, ts double): exact replay, by key."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        return pdf[["key", "ts"]].assign(admitted=admit(pdf["ts"].tolist(), [], limit, window)[0])

    return calls.groupBy("key").applyInPandas(run, "key string, ts double, admitted boolean")


def rate_limit_stream(calls: DataFrame, limit: int, window: float = WINDOW_S) -> DataFrame:
    """The same on a stream: the state of a key is the times of its admitted calls within the window."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values("ts", kind="stable")
        ok, held = admit(pdf["ts"].tolist(), held, limit, window)
        state.update((held,))
        yield pd.DataFrame({"key": key[0], "ts": pdf["ts"].to_numpy(), "admitted": ok})

    return calls.groupBy("key").applyInPandasWithState(
        run, "key string, ts double, admitted boolean", "held array<double>", "append", "NoTimeout"
    )


def vocab_sink(texts: DataFrame, path: str, pieces: Column, checkpoint: str):
    """A streaming query that appends new pieces of each micro-batch to a Parquet vocabulary; known ids never change."""
    from kumiki.operators.vocab import FIRST_ID, ranked

    def grow(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        met = batch.select(F.explode(pieces).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("freq"))
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        known = spark.read.parquet(path) if there else spark.createDataFrame([], "piece string, id long, freq long")
        last = known.agg(F.coalesce(F.max("id"), F.lit(FIRST_ID - 1))).first()[0]
        fresh = ranked(met.join(known.select("piece"), "piece", "left_anti"), [F.desc("freq"), F.asc("piece")])
        fresh.select("piece", (F.col("rank") + F.lit(last)).cast("long").alias("id"), "freq").write.mode("append").parquet(path)

    return texts.writeStream.foreachBatch(grow).option("checkpointLocation", checkpoint)


def analyze_stream(texts: DataFrame, id_col: str, text_col: str, **how) -> DataFrame:
    """The sentence plan keeps no state between texts, so it runs on a stream as it is."""
    return analyze(texts, id_col, text_col, **how)


def windowed_counts(events: DataFrame, ts_col: str, key: str, every: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by time window and key; rows later than the watermark are dropped by the engine."""
    w = F.window(ts_col, every)
    counted = events.withWatermark(ts_col, late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), key, "n")
