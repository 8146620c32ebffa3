"""Toxicity by a chain of linear models.

Categories are predicted one after another: each model is a logistic regression on the words of a text and on the
probabilities of the categories before it. For training, those probabilities are out-of-fold predictions, so a later
model sees earlier ones as wrong as they will be on new texts.

Features are the distinct words of a text and their beginnings of 4 to 6 bytes, hashed to ``1 << BITS`` places; each
model uses all places whose presence differs significantly between its classes. Models are fitted on a sample of
labelled rows, chosen by a hash of their id: about ``sample / 2`` documents that have the last category and as many
that don't. A row counts for as many as its kind was cut to, in the loss and in what features are chosen, so that
probabilities and the threshold keep the scale of all labelled rows. Every document is scored as a whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kumiki.llm.kernel import FOLD, U, _B, _byte_values, byte_table, powers, splitmix, texts_of, trimmed, words
from kumiki.llm.shared import bounded, small_batches, trim_memory, without, written

BITS, FOLDS, SAMPLE_DOCS = 20, 4, 6_000
#: A feature is used if the likelihood ratio statistic of its presence and the class is at least this (about 1 in 200
#: by chance).
SIGNIFICANT = 8.0
PREFIXES = (4, 5, 6)
WORD = byte_table(lambda b: b >= 0x80 or chr(b).isalnum())


def places(t) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature places of each text of a chunk, and where each text begins among them."""
    w = words(t, WORD)
    n = len(t.data)
    up, down = powers(_B, n + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, U)
        sums[0] = 0
        np.cumsum(_byte_values(7)[FOLD][t.data] * up[:n], out=sums[1:])
        size = w.end - w.begin
        owner = np.repeat(np.arange(len(t), dtype=np.int64), w.counts())
        keys = []
        for k in (None, *PREFIXES):
            own = slice(None) if k is None else size > k
            b = w.begin[own]
            e = w.end[own] if k is None else b + k
            h = splitmix((sums[e] - sums[b]) * down[b] + U(k or 99))
            keys.append((owner[own] << BITS) | (h >> U(64 - BITS)).astype(np.int64))
    flat = np.unique(np.concatenate(keys))
    return flat & ((1 << BITS) - 1), np.searchsorted(flat >> BITS, np.arange(len(t) + 1))


def feature_rows(batches):
    for batch in batches:
        lists, offs = [], [np.zeros(1, np.int64)]
        for t in texts_of(batch.column(1)):
            flat, cut = places(t)
            lists.append(flat)
            offs.append(cut[1:] + offs[-1][-1])
        values = pa.array(np.concatenate(lists).astype(np.int32) if lists else [], pa.int32())
        col = pa.ListArray.from_arrays(pa.array(np.concatenate(offs).astype(np.int32)), values)
        yield pa.record_batch([batch.column(0), batch.column(2), col], ["id", "tx", "places"])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def likelihood_ratio(with_one: np.ndarray, with_zero: np.ndarray, ones: int, zeros: int) -> np.ndarray:
    """Of each place: twice the log of how much likelier its presence is if it depends on the class than if not."""
    met = with_one + with_zero
    out = np.zeros(len(met))
    for seen, size in ((with_one, ones), (with_zero, zeros)):
        for count, all_of in ((seen, met), (size - seen, ones + zeros - met)):
            expected = all_of * (size / (ones + zeros))
            out += 2 * np.where(count > 0, count * np.log(np.maximum(count, 1) / np.maximum(expected, 1e-9)), 0)
    return out


class Linear:
    """Logistic regression on chosen places and dense columns, of rows with weights."""

    def __init__(
        self, rows: np.ndarray, flat: np.ndarray, dense: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 150
    ):
        n, one = len(y), int((y > 0).sum())
        ones, zeros = weight[y > 0].sum(), weight[y == 0].sum()
        met = np.bincount(flat, minlength=1 << BITS)
        places = np.flatnonzero(met)
        with_one = np.bincount(flat[(y > 0)[rows]], minlength=1 << BITS)[places].astype(float)
        best = places[likelihood_ratio(with_one, met[places] - with_one, one, n - one) >= SIGNIFICANT]
        del met, with_one
        self.column = np.full(1 << BITS, -1, np.int32)
        self.column[best] = np.arange(len(best))
        rows, cols = self._chosen(rows, flat)
        w, v, b = np.zeros(len(best)), np.zeros(dense.shape[1]), np.log(ones / zeros)
        m, s = np.zeros(len(w) + len(v) + 1), np.zeros(len(w) + len(v) + 1)
        share = weight / weight.sum()
        for step in range(1, steps + 1):
            p = sigmoid(np.bincount(rows, w[cols], n) + dense @ v + b)
            err = (p - y) * share
            g = np.concatenate([np.bincount(cols, err[rows], len(w)) + 1e-5 * w, dense.T @ err + 1e-3 * v, [err.sum()]])
            m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
            move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
            w, v, b = w - move[: len(w)], v - move[len(w) : -1], b - move[-1]
        self.w, self.v, self.b = w, v, b

    def _chosen(self, rows: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cols = self.column[flat]
        return rows[cols >= 0], cols[cols >= 0]

    def predict(self, rows: np.ndarray, flat: np.ndarray, dense: np.ndarray) -> np.ndarray:
        rows, cols = self._chosen(rows, flat)
        return sigmoid(np.bincount(rows, self.w[cols], len(dense)) + dense @ self.v + self.b)


class Chain:
    """Models of the categories in order; a category without examples of both kinds has a constant instead."""

    def __init__(self, rows: np.ndarray, flat: np.ndarray, labels: list[np.ndarray], fold: np.ndarray, weight: np.ndarray):
        self.models: list[Linear | float] = []
        n = len(fold)
        dense = np.zeros((n, 0))
        for y in labels:
            known = ~np.isnan(y)
            y0 = np.nan_to_num(y)
            self.models.append(self._fit(rows, flat, dense, y0, known, weight))
            out = np.zeros(n)
            for f in range(FOLDS):
                model = self._fit(rows, flat, dense, y0, known & (fold != f), weight)
                out[fold == f] = self._of(model, rows, flat, dense)[fold == f]
            dense = np.column_stack([dense, out])

    @staticmethod
    def _fit(rows, flat, dense, y, use, weight) -> Linear | float:
        if not use.any() or y[use].min() == y[use].max():
            return float(y[use].mean()) if use.any() else 0.0
        place = (np.cumsum(use) - 1).astype(np.int32)
        own = use[rows]
        return Linear(place[rows[own]], flat[own], dense[use], y[use], weight[use])

    @staticmethod
    def _of(model, rows, flat, dense) -> np.ndarray:
        return np.full(len(dense), model) if isinstance(model, float) else model.predict(rows, flat, dense)

    def predict(self, rows: np.ndarray, flat: np.ndarray, n: int) -> np.ndarray:
        """Probability of each category (a column each)."""
        dense = np.zeros((n, 0))
        for model in self.models:
            dense = np.column_stack([dense, self._of(model, rows, flat, dense)])
        return dense


def score_rows(batches, chain: Chain, names: list[str], threshold: float):
    for batch in batches:
        parts = []
        for t in texts_of(batch.column(1)):
            flat, cut = places(t)
            parts.append(chain.predict(np.repeat(np.arange(len(t)), np.diff(cut)), flat, len(t)))
        p = np.concatenate(parts) if parts else np.zeros((0, len(chain.models)))
        cols = [pa.array(p[:, i]) for i in range(p.shape[1])]
        yield pa.record_batch([batch.column(0), *cols, pa.array(p[:, -1] >= threshold), *batch.columns[2:]], names)


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str, text_col: str, sample: int) -> Chain:
    """The chain, from a bounded sample of the rows of docs that have a label."""
    tags = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        *(F.max(F.col(c).cast("double")).alias(f"y{i}") for i, c in enumerate(categories))
    )
    part = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20))
    last = F.coalesce(F.col(f"y{len(categories) - 1}") > 0, F.lit(False))
    many = {r["kind"]: r["count"] for r in tags.groupBy(last.alias("kind")).count().collect()}
    share = {k: min(1.0, sample / 2 / n) for k, n in many.items()}
    kept = F.when(last, F.lit(share.get(True, 1.0))).otherwise(F.lit(share.get(False, 1.0)))
    tags = tags.filter(part < kept * (1 << 20)).withColumn("weight", 1 / kept)
    tags = bounded(written(tags, "labels"))
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tx")
    ).join(tags.select("id"), "id", "left_semi")
    kind = docs.schema[id_col].dataType.simpleString()
    found = rows.mapInArrow(feature_rows, f"id {kind}, tx long, places array<int>").join(tags, "id").toArrow()
    found = found.sort_by([("id", "ascending"), ("tx", "ascending")])
    lists = found["places"].combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    size = np.array(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    # Equal texts share a fold, so that no model of a fold has seen a text that it is asked about.
    fold = (splitmix(found["tx"].to_numpy().astype(U)) % U(FOLDS)).astype(int)
    ys = [found[f"y{i}"].to_numpy().astype(float) for i in range(len(categories))]
    weight = found["weight"].to_numpy().astype(float)
    del found, lists
    chain = Chain(np.repeat(np.arange(len(size), dtype=np.int32), size), flat, ys, fold, weight)
    del flat, size
    trim_memory()
    return chain


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    categories: tuple[str, ...] = ("low_quality", "toxic"),
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.5,
    sample: int = SAMPLE_DOCS,
) -> DataFrame:
    """One row for each row of docs: id, p_<category> of each category in order, and whether the last is rejected.

    labels has the id and a column of 0, 1 or null for each category; of repeated ids the largest value counts. A null
    or empty text has no features and gets the models' constant. A category without both kinds of examples gets their
    share (0 without any), so without labels nothing is rejected. Repeated rows give equal rows. Other columns are not
    looked at. An empty table gives an empty result.
    """
    return scored(docs, labels, list(categories), id_col, text_col, threshold, sample)


def scored(
    docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str, text_col: str, threshold: float, sample: int, *more: str
) -> DataFrame:
    """The result of toxicity, with more columns of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    chain = spark.sparkContext.broadcast(fit(docs, labels, categories, id_col, text_col, sample))
    source = docs.select(id_col, text_col, *more)
    schema = T.StructType(
        [source.schema[0]]
        + [T.StructField(f"p_{c}", T.DoubleType()) for c in categories]
        + [T.StructField(f"is_{categories[-1]}", T.BooleanType())]
        + source.schema.fields[2:]
    )
    return source.mapInArrow(lambda it: trimmed(score_rows(it, chain.value, schema.names, threshold)), schema)


def with_categories(labels: DataFrame) -> DataFrame:
    """The labels table as categories: low_quality is what isn't of quality."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), F.col("toxic").alias("toxic"))


def fit_rows(
    docs: DataFrame,
    labels: DataFrame,
    categories: tuple[str, ...] = ("low_quality", "toxic"),
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.5,
    sample: int = SAMPLE_DOCS,
) -> DataFrame:
    """The rows of docs that aren't rejected, with all their columns.

    Each row is judged by its own text: other rows of its id, or without an id, stay. A null or empty text gets the
    models' constants, which reject it only if most labelled documents are toxic. Columns of any name may be present.
    Without labels all rows stay; an empty table gives an empty result.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tx"))
    tags = labels.select(F.col(id_col).alias("id"), *categories)
    found = scored(plain, tags, list(categories), "id", "text", threshold, sample, "tx")
    return without(docs, found.filter(F.col(f"is_{categories[-1]}")).select("id", "tx"), id_col, text_col)
