"""Exact dedup by a tree-merge of sorted digest runs.

A run is what a partition of the input holds: an entry for each digest, with the identifier that stays and the number
of rows, sorted by digest. In each round ``fan_in`` runs are exchanged: the entries of runs ``i * fan_in`` to
``i * fan_in + fan_in - 1`` meet, dealt by (new run, digest), are merged in the order of (run, digest, identifier), and
of each stretch of equal digests the first entry stays, with the sum of the rows. So a group of copies is never more
than ``fan_in`` entries for a task. The last round leaves one run with an entry for each distinct text. A SHA-256, the
length in bytes and an independent 64-bit hash form the digest at every level: entries merge only when all three agree.

The way back takes the entries of the first level: at most one for each run and digest, so that no copy group meets in
a task; rows look up the entry of their own run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kumiki.llm.shared import ascii_lower, without, without_repeats, written

KEY = ["__sha", "__len", "__check"]


def runs_for(df: DataFrame, fan_in: int) -> int:
    """Rounds of the tree: fan_in ** rounds is at least the number of shuffle partitions."""
    wanted, rounds = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 3
    while fan_in**rounds < wanted:
        rounds += 1
    return rounds


def digest_runs(docs: DataFrame, rounds: int, fan_in: int, id_col: str, text_col: str) -> DataFrame:
    """The key of each row and its run, which follows the partition that read it; a null text counts as empty."""
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(
        F.col(id_col).alias("__id"),
        F.xxhash64(text_col).alias("__tx"),
        F.pmod(F.spark_partition_id(), F.lit(fan_in**rounds)).alias("__run"),
        norm.alias("__norm"),
    ).select(
        "__id",
        "__tx",
        "__run",
        F.unhex(F.sha2(F.col("__norm").cast("binary"), 256)).alias("__sha"),
        F.octet_length("__norm").alias("__len"),
        F.xxhash64("__norm").alias("__check"),
    )


def merge_tree(level: DataFrame, rounds: int, fan_in: int, keep: str) -> DataFrame:
    """Merges runs round by round; each level keeps the smallest (or largest) identifier and the sum of rows."""
    by_id = F.col("__keep").asc_nulls_last() if keep == "smallest" else F.col("__keep").desc_nulls_last()
    stretch = Window.partitionBy("__run", *KEY).orderBy(by_id)
    whole = stretch.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def merge(runs: DataFrame, _: int) -> DataFrame:
        moved = runs.withColumn("__run", F.floor(F.col("__run") / fan_in).cast("int"))
        dealt = moved.repartition("__run", *KEY).sortWithinPartitions("__run", *KEY, by_id)
        merged = dealt.withColumn("__first", F.row_number().over(stretch)).withColumn("__n", F.sum("__n").over(whole))
        return merged.filter("__first = 1").drop("__first")

    return reduce(merge, range(rounds), level)


def row_verdicts(
    docs: DataFrame, id_col: str, text_col: str, keep: str = "smallest", fan_in: int = 4, rounds: int | None = None
) -> DataFrame:
    """__id, __tx (xxhash64 of the text), keep_id, group_size, kept, text_sha256, a row for each row of docs."""
    rounds = rounds or runs_for(docs, fan_in)
    best = F.min if keep == "smallest" else F.max
    rows = written(digest_runs(docs, rounds, fan_in, id_col, text_col), "digests")
    first = rows.groupBy("__run", *KEY).agg(best("__id").alias("__keep"), F.count(F.lit(1)).alias("__n"))
    first = written(first.sortWithinPartitions("__run", *KEY), "runs")
    whole = merge_tree(first, rounds, fan_in, keep).select(
        *KEY, F.col("__keep").alias("keep_id"), F.col("__n").alias("group_size")
    )
    # An identifier may have equal texts in several runs; of those the first run's counts.
    entries = first.join(whole, KEY).withColumn("__holds", F.when(F.col("__keep").eqNullSafe(F.col("keep_id")), F.col("__run")))
    lead = F.min("__holds").over(Window.partitionBy(*KEY))
    entries = entries.select("__run", *KEY, "keep_id", "group_size", lead.alias("__lead"))
    entries = written(entries, "entries")
    same = Window.partitionBy("__run", *KEY, "__id").orderBy("__tx")
    held = rows.join(entries, ["__run", *KEY]).withColumn("__nth", F.row_number().over(same))
    return held.select(
        "__id",
        "__tx",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("__id").eqNullSafe(F.col("keep_id")) & (F.col("__nth") == 1) & (F.col("__run") == F.col("__lead"))).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. keep names the identifier of a group
    that stays. Of repeated rows with one id and equal texts exactly one is kept. A null id loses against any other;
    a group of null ids alone keeps one of its rows. Other columns of docs are not looked at, whatever their names.
    An empty table gives an empty result. how: as of row_verdicts.
    """
    found = row_verdicts(docs, id_col, text_col, **how)
    return found.select(F.col("__id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def dedup_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group of equal texts one row.

    A null text is an empty one. Of repeated rows with one id and equal texts one stays, and one of a group without
    ids. Columns of any name may be present. An empty table gives an empty result.
    """
    found = row_verdicts(docs, id_col, text_col, keep).groupBy("__id", "__tx")
    found = written(found.agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("times")), "verdict")
    left = without(docs, found.filter("NOT stays").select("__id", "__tx"), id_col, text_col)
    return without_repeats(left, found.filter("stays AND times > 1").select("__id", "__tx"), id_col, text_col)
