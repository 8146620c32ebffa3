"""Benchmark decontamination by a prefix-filtered set join.

An item's window (10 words, or a shorter item as a whole) is the set of its shingles: pairs of neighbouring words, or
the word itself for a window of one. A document contains the window only if it has all of its shingles, so a prefix of
one shingle is enough to find it. Shingles are ordered by rarity over the whole corpus, and each window is indexed
under its rarest one. A document's position that carries such a shingle fixes where the window would have to lie:
the positional bound (it starts at or after the first word) and the length bound (it ends at or before the last)
drop the rest, and the words are compared exactly.

The index of windows is broadcast if it has no more than max_index rows; a larger one is joined by a shuffle on the
shingle. All steps are DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kumiki.llm.shared import ascii_lower, bounded, without, written

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def word_list(text: Column) -> Column:
    """Lower-cased (A-Z) words: runs of digits, letters a-z and anything beyond ASCII. A null text has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def windows(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """__item, __win (words) of each window; an item of fewer words is one window, one without words has none."""
    rows = items.select(F.col(id_col).cast("string").alias("__item"), word_list(F.col(text_col)).alias("__w"))
    rows = rows.filter(F.size("__w") > 0).withColumn("__item", F.coalesce("__item", F.lit("")))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("__w") - size + 1))
    return (
        rows.withColumn("__s", F.explode(starts)).select("__item", F.slice("__w", F.col("__s"), size).alias("__win"))
    ).distinct()


def shingle(words: Column, at: Column) -> Column:
    """Hash of the pair of words that begins at the 0-based position."""
    return F.xxhash64(F.get(words, at), F.get(words, at + 1))


def positions(docs: DataFrame, keep: list[str], pairs: bool) -> DataFrame:
    """Every position of __w with the hash of its shingle."""
    out = docs.select(*keep, "__w", F.posexplode("__w").alias("__p", "__word"))
    key = F.xxhash64("__word", F.get("__w", F.col("__p") + 1)) if pairs else F.xxhash64("__word")
    return out.withColumn("__key", key)


def hits(docs: DataFrame, wins: DataFrame, max_index: int) -> DataFrame:
    """__id, __tx, __start, __win of every occurrence of a window in docs (__id, __tx, __w)."""
    found = None
    for pairs in (True, False):
        own = wins.filter(F.size("__win") > 1 if pairs else F.size("__win") == 1).select("__win").distinct()
        if own.isEmpty():
            continue
        at = F.posexplode("__win").alias("__off", "__word")
        # An item's last word has no pair of its own: the pair would need the word after the window.
        grams = own.select("__win", at).withColumn(
            "__key", F.xxhash64("__word", F.get("__win", F.col("__off") + 1)) if pairs else F.xxhash64("__word")
        )
        if pairs:
            grams = grams.filter(F.col("__off") < F.size("__win") - 1)
        keys = bounded(grams.select("__key").distinct(), max_index)
        rarity = written(
            positions(docs, [], pairs).select("__key").join(keys, "__key", "left_semi").groupBy("__key").count(), "rarity"
        )
        rank = Window.partitionBy("__win").orderBy("count", "__key", "__off")
        index = (
            grams.join(rarity, "__key")  # a window with a shingle that no document has occurs nowhere
            .withColumn("__have", F.count(F.lit(1)).over(Window.partitionBy("__win")))
            .withColumn("__rank", F.row_number().over(rank))
            .filter((F.col("__rank") == 1) & (F.col("__have") == F.size("__win") - int(pairs)))
            .select("__key", "__off", "__win")
        )
        index = written(index, "prefixes")
        start = F.col("__p") - F.col("__off")
        inside = (start >= 0) & (start + F.size("__win") <= F.size("__w"))
        exact = F.slice("__w", start + 1, F.size("__win")) == F.col("__win")
        if index.count() <= max_index:
            some = positions(docs, ["__id", "__tx"], pairs).join(bounded(index, max_index), "__key")
        else:  # positions are shuffled without the words, which are fetched for those that match
            places = positions(docs, ["__id", "__tx"], pairs).select("__id", "__tx", "__p", "__key").join(index, "__key")
            places = places.withColumnsRenamed({"__id": "__pid", "__tx": "__ptx"})
            here = F.col("__id").eqNullSafe(F.col("__pid")) & (F.col("__tx") == F.col("__ptx"))
            some = docs.select("__id", "__tx", "__w").distinct().join(places, here)
        some = some.filter(inside & exact).select("__id", "__tx", start.alias("__start"), "__win")
        found = some if found is None else found.unionByName(some)
    return found


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row for each row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null text has no words. Rows that repeat an id and text give equal rows. Items without words (null or empty
    text) have no window; items that repeat an id count once, and a null item id counts as the empty string. An empty
    table of documents gives an empty result, one of items leaves everything clean. Other columns are not looked at.
    how: as of verdicts.
    """
    found = verdicts(docs, items, id_col, text_col, **how)
    return found.select(F.col("__id").alias(id_col), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def verdicts(
    docs: DataFrame,
    items: DataFrame,
    id_col: str,
    text_col: str,
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    size: int = 10,
    max_index: int = 400_000,
) -> DataFrame:
    """The result of decontaminate with __id and __tx, the xxhash64 of the text."""
    base = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    base = base.select("__id", F.xxhash64("__text").alias("__tx"), word_list(F.col("__text")).alias("__w"))
    wins = written(windows(items, item_id_col, item_text_col, size), "windows")
    counts = base.select("__id", "__tx", F.size("__w").cast("long").alias("n_words"))
    found = hits(base, wins, max_index)
    if found is None:
        agg = counts.select("__id", "__tx").limit(0).selectExpr("*", "0L AS n_hit", "0L AS n_items", "'' AS __items")
    else:
        found = written(found.distinct(), "hits")
        before = Window.partitionBy("__id", "__tx").orderBy("__start", "__end").rowsBetween(Window.unboundedPreceding, -1)
        spans = found.select("__id", "__tx", "__start", (F.col("__start") + F.size("__win")).alias("__end")).distinct()
        covered = F.greatest(F.lit(0), F.col("__end") - F.greatest("__start", F.coalesce("__till", F.lit(0))))
        n_hit = (
            spans.withColumn("__till", F.max("__end").over(before))
            .groupBy("__id", "__tx")
            .agg(F.sum(covered).cast("long").alias("n_hit"))
        )
        listed = (
            found.select("__id", "__tx", "__win")
            .distinct()
            .join(bounded(wins, max_index), "__win")
            .groupBy("__id", "__tx")
            .agg(F.array_sort(F.collect_set("__item")).alias("__list"))
        )
        agg = n_hit.join(
            listed.select(
                F.col("__id").alias("__id2"),
                F.col("__tx").alias("__tx2"),
                F.size("__list").cast("long").alias("n_items"),
                F.array_join("__list", ",").alias("__items"),
            ),
            F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__tx") == F.col("__tx2")),
        ).drop("__id2", "__tx2")
    agg = agg.withColumnsRenamed({"__id": "__aid", "__tx": "__atx"})
    same = F.col("__id").eqNullSafe(F.col("__aid")) & (F.col("__tx") == F.col("__atx"))
    zero = F.lit(0).cast("long")
    return counts.join(agg, same, "left").select(
        "__id",
        "__tx",
        "n_words",
        F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce("n_items", zero).alias("n_items"),
        F.sha2(F.coalesce("__items", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
    )


def clean_rows(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that contain no window of an item, with all their columns.

    Each row is judged by its own text: other rows of its id, or without an id, stay. Null and empty texts stay.
    Columns of any name may be present. An empty table gives an empty result, one of items leaves all rows.
    """
    bad = verdicts(docs, items, id_col, text_col, **how).filter("contaminated").select("__id", "__tx")
    return without(docs, bad, id_col, text_col)
