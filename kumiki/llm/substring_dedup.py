"""Substring dedup with a log-structured fingerprint index.

A window is ``size`` consecutive words of one document. Of each window's runs of ``gram`` words, the one of the
smallest hash (the first on ties) is its fingerprint: equal windows have equal fingerprints, so a window can only occur
twice if its fingerprint does. Neighbouring windows mostly share one, which leaves about a twelfth of the positions.

The index is a folder of immutable runs of the window hashes met so far, each bucketed and sorted by fingerprint, so that
runs are merge-joined bucket by bucket without another exchange. A batch of documents becomes a new run; it is joined
with the runs of earlier batches, which tells the fingerprints that recur; when ``fan_in`` runs have gathered they are
compacted into one. Documents of old batches are matched by later ones in the same way. A folder can be opened again
and added to by a later call.

Verification: the windows whose fingerprint recurs are looked at as a whole, by a 64-bit hash and 64 bits of a BLAKE2b
digest of their words, and only those whose whole sequence recurs count. Documents with equal word sequences are told
by their SHA-256 beforehand: one of them stands for all, with a weight of two, so that a large group of copies doesn't
multiply its windows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kumiki.llm.kernel import texts_of, window_hashes, windows_per_text, word_hashes, words
from kumiki.llm.shared import bounded, new_path, released, small_batches, written

SIZE, GRAM = 35, 12


def anchors(h: np.ndarray, w, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of a chunk: its first word and the word where its fingerprint begins; and all gram hashes."""
    from kumiki.llm.kernel import ragged

    first = ragged(w.offs[:-1], windows_per_text(w, size))
    grams = window_hashes(h, gram)
    if not len(first):
        return first, first, grams
    wide = size - gram + 1
    # Smallest of each wide grams, by doubling: the pair (hash, -position) is compared as hash, then the first one.
    best = np.arange(len(grams))
    done = 1
    while done < wide:
        step = min(done, wide - done)
        left, right = best[:-step], best[step:]
        best = np.where(grams[right] < grams[left], right, left)
        done += step
    return first, best[first], grams


def fingerprint_rows(batches, size: int, gram: int):
    """A row for each document (kind 0: its words and their SHA-256) and for each fingerprint (kind 1)."""
    for batch in batches:
        ids, tx = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        for t in texts_of(batch.column(2)):
            w = words(t)
            h = word_hashes(t, w)
            _, at, grams = anchors(h, w, size, gram)
            at = np.unique(at)
            doc = t.first + np.searchsorted(w.offs, at, side="right") - 1
            n = w.counts()
            sha = [kept_sha(t, w, i, None) for i in range(len(t))]
            me = np.arange(t.first, t.first + len(t))
            yield pa.record_batch(
                [
                    pa.array(np.append(ids[me], ids[doc])),
                    pa.array(np.append(tx[me], tx[doc])),
                    pa.array(np.append(n, at - w.offs[doc - t.first]), pa.int64()),
                    pa.array(np.append(np.zeros(len(t), np.int64), grams[at].astype(np.int64))),
                    pa.array(sha + [None] * len(at), pa.binary()),
                ],
                ["id", "tx", "n", "fp", "sha"],
            )


def kept_sha(t, w, i: int, keep: np.ndarray | None) -> bytes:
    """SHA-256 of the kept words of text i joined by a space."""
    b, e = w.begin[w.offs[i] : w.offs[i + 1]], w.end[w.offs[i] : w.offs[i + 1]]
    if keep is not None:
        b, e = b[keep], e[keep]
    if not len(b):
        return hashlib.sha256(b"").digest()
    # Bytes of the words and of one space after each.
    size = e - b + 1
    stop = np.cumsum(size)
    at = np.arange(int(stop[-1])) + np.repeat(b - (stop - size), size)
    out = t.data[np.minimum(at, len(t.data) - 1)].copy()
    out[stop - 1] = 32
    return hashlib.sha256(out[:-1].tobytes()).digest()


def spaced_words(t, w) -> tuple[bytes, np.ndarray]:
    """The words of a chunk with one space after each, and where each begins; one more entry for the end."""
    size = w.end - w.begin + 1
    stop = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(int(stop[-1])) + np.repeat(w.begin - stop[:-1], size)
    out = t.data[np.minimum(at, max(0, len(t.data) - 1))].copy()
    out[stop[1:] - 1] = 32
    return out.tobytes(), stop


def window_rows(batches, size: int, gram: int):
    """Whole hashes of the windows whose fingerprint is listed; input: id, tx, text, spots, weight."""
    for batch in batches:
        ids, tx = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        spots = batch.column(3)
        weight = batch.column(4).to_numpy(zero_copy_only=False)
        offs, flat = spots.offsets.to_numpy(), spots.values.to_numpy(zero_copy_only=False)
        for t in texts_of(batch.column(2)):
            w = words(t)
            h = word_hashes(t, w)
            first, at, _ = anchors(h, w, size, gram)
            listed = np.zeros(len(h) + 1, bool)
            mine = slice(offs[t.first], offs[t.first + len(t)])
            listed[flat[mine] + np.repeat(w.offs[:-1], np.diff(offs[t.first : t.first + len(t) + 1]))] = True
            first = first[listed[at]]
            doc = t.first + np.searchsorted(w.offs, first, side="right") - 1
            whole = window_hashes(h, size)
            spaced, begin = spaced_words(t, w)
            other = [
                int.from_bytes(hashlib.blake2b(spaced[b:e], digest_size=8).digest(), "little", signed=True)
                for b, e in zip(begin[first].tolist(), begin[first + size].tolist(), strict=True)
            ]
            yield pa.record_batch(
                [
                    pa.array(whole[first].astype(np.int64)),
                    pa.array(other, pa.int64()),
                    pa.array(ids[doc]),
                    pa.array(tx[doc]),
                    pa.array((first - w.offs[doc - t.first]).astype(np.int32)),
                    pa.array(weight[doc].astype(np.int32)),
                ],
                ["h", "v", "id", "tx", "start", "weight"],
            )


def removal_rows(batches, size: int):
    """What is left of each document; input: id, tx, text, starts of the windows that recur."""
    for batch in batches:
        spots = batch.column(3)
        offs, flat = spots.offsets.to_numpy(), spots.values.to_numpy(zero_copy_only=False)
        removed, sha = [], []
        for t in texts_of(batch.column(2)):
            w = words(t)
            for i in range(len(t)):
                n = int(w.offs[i + 1] - w.offs[i])
                edge = np.zeros(n + size + 1, np.int64)
                start = np.unique(flat[offs[t.first + i] : offs[t.first + i + 1]])
                edge[start] += 1
                edge[start + size] -= 1
                keep = np.cumsum(edge)[:n] == 0
                removed.append(n - int(keep.sum()))
                sha.append(kept_sha(t, w, i, keep))
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(sha, pa.binary())],
            ["id", "tx", "n_removed", "sha"],
        )


class FingerprintIndex:
    """Runs of (fp, n) in a folder, bucketed and sorted by fp: how often each fingerprint has been met so far.

    A run's folder is named by the first and last batch that it covers and its number of buckets. A run that another
    complete run covers, left behind by a compaction that was cut short, doesn't count.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, fan_in: int = 4):
        self.spark, self.fan_in = spark, fan_in
        self.folder = (folder or new_path(spark, "index")).rstrip("/")
        spans = sorted(self._spans(), key=lambda x: (x[0], -x[1]))
        spans = [s for i, s in enumerate(spans) if not any(o[0] <= s[0] and s[1] <= o[1] for o in spans[:i])]
        self.buckets = spans[0][2] if spans else int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs = {s[:2]: self._open(*s) for s in spans}
        self.recurring: list[DataFrame] = []

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _spans(self) -> list[tuple[int, int, int]]:
        fs, at = self._fs(self.folder)
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        found = [(name, re.fullmatch(r"run-(\d+)-(\d+)-(\d+)", name)) for name in names]
        done = [m for name, m in found if m and fs.exists(self._fs(f"{self.folder}/{name}/_SUCCESS")[1])]
        return [(int(m[1]), int(m[2]), int(m[3])) for m in done]

    def _path(self, first: int, last: int, buckets: int) -> str:
        return f"{self.folder}/run-{first}-{last}-{buckets}"

    def _open(self, first: int, last: int, buckets: int) -> DataFrame:
        name = f"kumiki_run_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {name} (fp BIGINT, n BIGINT) USING parquet CLUSTERED BY (fp) SORTED BY (fp)"
            f" INTO {buckets} BUCKETS LOCATION '{self._path(first, last, buckets)}'"
        )
        return self.spark.table(name)

    def _write(self, run: DataFrame, first: int, last: int) -> DataFrame:
        """Writes a run and opens it. Counts are summed by each task before they are dealt, so a very common fingerprint is
        a row a task; where the session shuffles into as many partitions as there are buckets, each is one sorted file."""
        name = f"kumiki_run_{uuid.uuid4().hex}"
        dealt = run.groupBy("fp").agg(F.sum("n").alias("n"))
        path = self._path(first, last, self.buckets)
        dealt.write.bucketBy(self.buckets, "fp").sortBy("fp").format("parquet").option("path", path).saveAsTable(name)
        return self.spark.table(name)

    def add(self, occurrences: DataFrame) -> DataFrame:
        """Adds a batch's fingerprints (fp) as a new run; returns those of it that recur in it or in history."""
        at = 1 + max((last for _, last in self.runs), default=-1)
        run = self._write(occurrences.select("fp", F.lit(1).cast("long").alias("n")), at, at)
        twice = run.filter("n > 1").select("fp")
        for old in self.runs.values():
            met = run.filter("n = 1").select("fp").hint("merge").join(old.select("fp"), "fp", "left_semi")
            twice = twice.unionByName(met)
        found = written(twice.distinct(), "recurring")
        self.recurring.append(found)
        self.runs[at, at] = run
        if len(self.runs) >= self.fan_in:
            self.compact()
        return found

    def compact(self) -> None:
        """Merges all runs into one, and deletes them once it is complete."""
        old = dict(self.runs)
        first, last = min(a for a, _ in old), max(b for _, b in old)
        self.runs = {(first, last): self._write(reduce(DataFrame.unionByName, old.values()), first, last)}
        for a, b in old:
            fs, p = self._fs(self._path(a, b, self.buckets))
            fs.delete(p, True)

    def repeated(self) -> DataFrame:
        """All fingerprints that recur in the batches added here, or between them and history."""
        return reduce(DataFrame.unionByName, self.recurring).distinct()


def substring_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SIZE,
    gram: int = GRAM,
    batches: int = 5,
    fan_in: int = 4,
) -> DataFrame:
    """One row for each row of docs: id, n_words, n_removed, kept_sha256.

    Every word covered by a window whose word sequence also starts elsewhere is removed, all occurrences alike. A null
    text has no words; a text of fewer words than a window loses none; rows that repeat an id and text are occurrences
    of their own and give equal rows. The id is a whole number or null. Other columns are not looked at. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"),
        F.xxhash64(text_col).alias("tx"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    made = base.mapInArrow(lambda it: fingerprint_rows(it, size, gram), "id long, tx long, n long, fp long, sha binary")
    part = F.pmod(F.xxhash64("id", "tx"), F.lit(batches)).cast("int")
    path = new_path(spark, "fingerprints")
    made.withColumn("part", part).write.partitionBy("part").parquet(path)
    rows = spark.read.schema(T.StructType([*made.schema.fields, T.StructField("part", T.IntegerType())])).parquet(path)
    index = FingerprintIndex(spark, fan_in=fan_in)
    for b in range(batches):
        index.add(rows.filter((F.col("part") == b) & F.col("sha").isNull()).select("fp"))
    per_doc = rows.filter("sha IS NOT NULL").select("id", "tx", F.col("n").alias("n_words"), "sha")

    # Documents of equal word sequences: the first stands for all of them.
    copies = per_doc.filter(F.col("n_words") >= size).groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("of"))
    copies = written(copies.filter("copies > 1"), "copies")
    role = written(
        per_doc.filter(F.col("n_words") >= size)
        .join(bounded(copies), "sha")
        .groupBy("id", "tx")
        .agg(F.first("of").alias("of"), F.first("sha").alias("sha")),
        "roles",
    )
    lead = role.filter("id = of").groupBy("id").agg(F.min("tx").alias("lead_tx"))
    aside = role.join(bounded(lead), "id", "left").select("id", "tx", (F.col("tx") == F.col("lead_tx")).alias("leads"))
    aside = released(written(aside.withColumn("leads", F.coalesce("leads", F.lit(False))), "aside"))

    # Copies go first, so that a large group of them isn't a hot key; written, the fingerprints leave the join free to
    # split the one of a very common passage.
    repeated = written(index.repeated(), "repeated")
    spots = (
        rows.filter("sha IS NULL")
        .select("id", "tx", F.col("n").cast("int").alias("at"), "fp")
        .join(bounded(written(aside.filter("NOT leads").select("id", "tx"), "copies")), ["id", "tx"], "left_anti")
        .join(repeated, "fp", "left_semi")
        .groupBy("id", "tx")
        .agg(F.collect_set("at").alias("spots"))
        .join(bounded(written(aside.filter("leads"), "leads")), ["id", "tx"], "left")
        .select("id", "tx", "spots", F.when(F.col("leads"), 2).otherwise(1).alias("weight"))
    )
    spots = released(written(spots, "spots"))
    found = base.join(bounded(spots, 150_000), ["id", "tx"]).select("id", "tx", "text", "spots", "weight")
    found = found.mapInArrow(
        lambda it: window_rows(it, size, gram), "h long, v long, id long, tx long, start int, weight int"
    )
    found = released(written(found, "windows"))
    twice = found.groupBy("h", "v").agg(F.sum("weight").alias("n")).filter("n > 1").select("h", "v")
    starts = (
        found.filter("weight = 1")
        .select("h", "v", "id", "tx", "start")
        .join(written(twice, "twice"), ["h", "v"], "left_semi")
        .groupBy("id", "tx")
        .agg(F.collect_set("start").alias("starts"))
    )
    starts = released(written(starts, "starts"))
    left = base.join(bounded(starts, 100_000), ["id", "tx"]).select("id", "tx", "text", "starts").mapInArrow(
        lambda it: removal_rows(it, size), "id long, tx long, n_removed long, sha binary"
    )
    left = left.groupBy("id", "tx").agg(F.first("n_removed").alias("n_removed"), F.first("sha").alias("left_sha"))
    gone = aside.select("id", "tx", F.lit(True).alias("gone"))
    none = F.unhex(F.sha2(F.lit("").cast("binary"), 256))
    return (
        per_doc.join(left, ["id", "tx"], "left")
        .join(gone, ["id", "tx"], "left")
        .select(
            F.nullif(F.col("id"), F.lit(-(1 << 63))).alias(id_col),
            "n_words",
            F.when(F.col("gone"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.lower(F.hex(F.when(F.col("gone"), none).otherwise(F.coalesce("left_sha", "sha")))).alias("kept_sha256"),
        )
    )
