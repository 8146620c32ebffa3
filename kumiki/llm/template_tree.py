"""Line dedup by a log-template tree.

Lines are parsed into a tree of fixed depth: the number of tokens, then the first ``depth`` tokens, with runs of digits
read as a wildcard. Within a leaf every position is generalised: a token stays if at least ``min_docs`` lines of the
leaf have it there (over distinct lines, weighted by the documents that hold them), any other becomes a wildcard. A
line's template is what remains. A template counts if at least ``constant`` of its tokens stay, and it recurs if
``min_docs`` documents hold a line of it. Lines of recurring templates are dropped.

Only leaves that enough documents reach are generalised; most lines of prose stand alone in theirs. Lines are
pre-aggregated before tokens are looked at, so a line that a third of the documents share is one row by then. All steps
are DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kumiki.llm.shared import bounded, written

WILD = "<*>"


def line_rows(docs: DataFrame, depth: int) -> DataFrame:
    """id, tx, line number, leaf and hash of each line with a token."""
    lines = docs.select("id", "tx", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    masked = F.regexp_replace("line", "[0-9]+", WILD)
    lines = lines.withColumn("tokens", F.array_remove(F.split(masked, "[\\x20\\x09-\\x0D]+"), ""))
    return lines.filter(F.size("tokens") > 0).select(
        "id",
        "tx",
        "no",
        F.xxhash64(F.size("tokens"), F.slice("tokens", 1, depth)).alias("leaf"),
        F.xxhash64("tokens").alias("hash"),
        "tokens",
    )


def template_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = 3,
    min_docs: int = 10,
    constant: float = 0.7,
    max_lines: int = 400_000,
) -> DataFrame:
    """One row for each row of docs: id, n_lines, n_removed, and the kept text.

    A line ends at a newline; lines without a token are never dropped. A null text is an empty one, and an empty text
    is one line. Rows that repeat an id and text count as one document and give equal rows. Other columns are not
    looked at. An empty table gives an empty result. The lines to drop are broadcast if they are no more than
    max_lines, else joined by a shuffle.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.select("id", F.xxhash64("text").alias("tx"), "text")
    lines = line_rows(base, depth)
    place = written(lines.select("id", "tx", "no", "leaf", "hash"), "lines")
    held = place.select("id", "tx", "leaf", "hash").distinct()
    per_line = written(held.groupBy("leaf", "hash").agg(F.count(F.lit(1)).alias("docs")), "line-counts")
    busy = per_line.groupBy("leaf").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).select("leaf")
    busy = bounded(written(busy, "leaves"), max_lines)
    distinct_lines = (
        lines.select("leaf", "hash", "tokens").join(busy, "leaf", "left_semi").dropDuplicates(["leaf", "hash"])
    )
    tokens = distinct_lines.join(per_line, ["leaf", "hash"]).select(
        "leaf", "hash", "docs", F.posexplode("tokens").alias("at", "token")
    )
    tokens = written(tokens, "line-tokens")
    support = tokens.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("support"))
    general = tokens.join(support, ["leaf", "at", "token"]).select(
        "leaf", "hash", "at", F.when(F.col("support") >= min_docs, F.col("token")).otherwise(WILD).alias("token"),
        (F.col("support") >= min_docs).cast("int").alias("stays"),
    )
    templates = (
        general.groupBy("leaf", "hash")
        .agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("t"), F.avg("stays").alias("share"))
        .filter(F.col("share") >= constant)
        .select("leaf", "hash", F.xxhash64("leaf", "t.token").alias("template"))
    )
    templates = written(templates, "templates")
    mine = bounded(templates, max_lines)
    recurring = (
        held.join(mine, ["leaf", "hash"])
        .select("template", "id", "tx")
        .distinct()
        .groupBy("template")
        .count()
        .filter(F.col("count") >= min_docs)
    )
    drop = bounded(written(templates.join(recurring, "template", "left_semi").select("leaf", "hash"), "dropped"), max_lines)
    gone = (
        place.join(drop, ["leaf", "hash"], "left_semi").groupBy("id", "tx").agg(F.collect_set("no").alias("gone"))
    ).withColumnsRenamed({"id": "__id", "tx": "__tx"})
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("tx") == F.col("__tx"))
    # Lines are split below the join, so that what is kept of them is looked up by number.
    split = base.select("id", "tx", F.split("text", "\n").alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda i: F.get("lines", i)))
    return split.join(bounded(written(gone, "gone")), same, "left").select(
        F.col("id").alias(id_col),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.array_join(kept, "\n").alias("kept"),
    )
