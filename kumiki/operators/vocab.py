"""Vocabulary: counting pieces, building, extending, encoding, decoding and reporting, all on (text_id, pos, piece) tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kumiki.functions.text import BLANKS, chars, contamination, piece_flags

# The special pieces, ids 0 to 9.
SPECIAL = ["<pad>", "<unk>", "<bos>", "<eos>", "<sep>", "<mask>", "<cls>", "<nl>", "<sp>", "<reserved>"]
UNK, BOS, EOS, NL, SP, FIRST_ID = 1, 2, 3, 7, 8, 10
FORMAT = "1.0"


def met_chars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """piece: each character but white space that occurs in a task's texts, once."""
    seen = np.zeros(0x110000, bool)
    for batch in batches:
        for text in batch.column(0):
            if text.is_valid:
                seen[np.frombuffer(text.as_py().encode("utf-32-le"), np.uint32)] = True
    seen[[ord(c) for c in BLANKS]] = False
    yield pa.RecordBatch.from_arrays([pa.array([chr(c) for c in np.flatnonzero(seen)], pa.string())], ["piece"])


def count_pieces(texts: DataFrame, text_col: str, pieces: Column) -> DataFrame:
    """piece, freq: how often each piece occurs; every character of a text is there too, with 0 if it is no piece."""
    met = texts.select(F.explode(pieces).alias("piece")).withColumn("freq", F.lit(1).cast("long"))
    single = texts.select(text_col).mapInArrow(met_chars, "piece string").withColumn("freq", F.lit(0).cast("long"))
    return met.unionByName(single).groupBy("piece").agg(F.sum("freq").alias("freq"))


def ranked(counts: DataFrame, order: list[Column]) -> DataFrame:
    """Dense ranks over the whole table without one task: ranks within key ranges, moved by the sizes before them.

    The offsets are one row for each partition of the range sort, so they are few whatever the table's size. The dealt
    table is kept, so that both its readers see the same partitions.
    """
    dealt = counts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    dealt = dealt.persist(StorageLevel.MEMORY_AND_DISK)
    own = Window.partitionBy("__part").orderBy(*order)
    dealt = dealt.withColumn("__n", F.row_number().over(own))
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    return dealt.join(F.broadcast(offsets), "__part").withColumn("rank", F.col("__n") + F.col("__before")).drop("__part", "__n", "__size", "__before")


def vocab_pieces(counts: DataFrame, min_freq: int = 2, max_size: int | None = None) -> DataFrame:
    """piece, freq, is_char of the pieces of a vocabulary, without ids: frequent longer ones and all characters."""
    single = F.char_length("piece") == 1
    if max_size is None:
        return counts.filter(single | (F.col("freq") >= min_freq)).withColumn("is_char", single)
    words = counts.filter(~single & (F.col("freq") >= min_freq)).orderBy(F.desc("freq"), "piece").limit(max_size)
    return words.withColumn("is_char", F.lit(False)).unionByName(counts.filter(single).withColumn("is_char", F.lit(True)))


def build_vocab(counts: DataFrame, min_freq: int = 2, max_size: int | None = None) -> DataFrame:
    """piece, id, freq, flags: frequent longer pieces first by (-freq, piece), then all characters; ids from 10."""
    whole = vocab_pieces(counts, min_freq, max_size)
    out = ranked(whole, [F.col("is_char").asc(), F.col("freq").desc(), F.col("piece").asc()])
    return out.select("piece", (F.col("rank") + FIRST_ID - 1).cast("long").alias("id"), "freq", piece_flags(F.col("piece")).alias("flags"))


def extend_vocab(vocab: DataFrame, counts: DataFrame, min_freq: int = 2) -> DataFrame:
    """Known pieces keep their ids and gain the new counts; new ones follow by (-freq, piece) from the largest id on."""
    old = vocab.join(counts.withColumnRenamed("freq", "more"), "piece", "left").select(
        "piece", "id", (F.col("freq") + F.coalesce("more", F.lit(0))).alias("freq")
    )
    fresh = counts.join(vocab, "piece", "left_anti").filter((F.char_length("piece") == 1) | (F.col("freq") >= min_freq))
    last = vocab.agg(F.coalesce(F.max("id"), F.lit(FIRST_ID - 1)).alias("last"))
    fresh = ranked(fresh, [F.col("freq").desc(), F.col("piece").asc()]).crossJoin(F.broadcast(last))  # last is one row
    return old.unionByName(fresh.select("piece", (F.col("rank") + F.col("last")).cast("long").alias("id"), "freq"))


def encode(tokens: DataFrame, vocab: DataFrame, bos_eos: bool = False) -> DataFrame:
    """text_id, pos, sub, id of tokens (text_id, pos, piece): a piece's id, else those of its characters, else 1."""
    known = vocab.select("piece", "id")
    hit = tokens.join(known, "piece", "left")
    whole = hit.filter(F.col("id").isNotNull()).select("text_id", "pos", F.lit(0).alias("sub"), "id")
    parts = hit.filter(F.col("id").isNull()).select("text_id", "pos", F.posexplode(chars(F.col("piece"))).alias("sub", "piece"))
    parts = parts.join(known, "piece", "left").select("text_id", "pos", "sub", F.coalesce("id", F.lit(UNK).cast("long")).alias("id"))
    out = whole.unionByName(parts)
    if bos_eos:
        ends = tokens.groupBy("text_id").agg(F.max("pos").alias("last"))
        marks = F.array(F.struct(F.lit(-1).alias("p"), F.lit(BOS).alias("i")), F.struct((F.col("last") + 1).alias("p"), F.lit(EOS).alias("i")))
        ends = ends.select("text_id", F.explode(marks).alias("m"))
        out = out.unionByName(ends.select("text_id", F.col("m.p").alias("pos"), F.lit(0).alias("sub"), F.col("m.i").cast("long").alias("id")))
    return out


def decode(encoded: DataFrame, vocab: DataFrame) -> DataFrame:
    """text_id, text: pieces in order, ``<nl>`` and ``<sp>`` as white space, other special pieces left out."""
    piece = F.when(F.col("id") == NL, "\n").when(F.col("id") == SP, " ").when(F.col("id") < FIRST_ID, "").otherwise(F.col("piece"))
    rows = encoded.join(vocab.select("piece", "id"), "id", "left").select("text_id", "pos", "sub", F.coalesce(piece, F.lit("")).alias("p"))
    gathered = rows.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("pos", "sub", "p"))).alias("s"))
    return gathered.select("text_id", F.array_join("s.p", "").alias("text"))


def check_version(found: str) -> None:
    """A vocabulary of another major format isn't read."""
    if found.split(".")[0] != FORMAT.split(".")[0]:
        raise ValueError(f"E601: vocabulary format {found}, this engine reads {FORMAT}")


def vocab_report(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row: tokens, coverage, out-of-vocabulary and unknown shares, pieces, singletons, unused pieces, doubtful ones.

    Of the vocabulary the pieces alone are looked at, so it may come without ids."""
    known = tokens.groupBy("piece").agg(F.count(F.lit(1)).alias("uses")).join(vocab.select("piece", F.lit(1).alias("id")), "piece", "full_outer")
    n = F.sum(F.coalesce("uses", F.lit(0)))
    inside = F.sum(F.when(F.col("id").isNotNull(), F.coalesce("uses", F.lit(0))).otherwise(0))
    return known.agg(
        n.alias("tokens"),
        F.round(inside / n, 6).alias("coverage"),
        F.round(1 - inside / n, 6).alias("oov"),
        F.count("id").alias("pieces"),
        F.sum((F.coalesce("uses", F.lit(0)) == 1).cast("long")).alias("singletons"),
        F.sum((F.col("id").isNotNull() & F.col("uses").isNull()).cast("long")).alias("unused"),
        F.sum((F.col("id").isNotNull() & (F.size(contamination(F.col("piece"))) > 0)).cast("long")).alias("doubtful"),
    )


def report_markdown(report: DataFrame) -> str:
    """The one-row report as a Markdown table."""
    row = report.first().asDict()
    return "| measure | value |\n|---|---|\n" + "".join(f"| {k} | {v} |\n" for k, v in row.items())
