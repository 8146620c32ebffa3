"""Language identification by prediction by partial matching.

Each language has a context tree of bytes up to ``ORDER`` deep (escape probabilities by method C, with exclusion), its
statistics frozen after training. A text's score under a language is its exact code length in bits, and the language
of the shortest code wins. All 256 bytes are symbols of their own, but for A-Z, which are folded. The trees are sparse:
sorted tables of the contexts with a symbol that have been met, with the bits under each language, and of the contexts
with the bits of an escape from them.

Every value of the language column is learnt, from a bounded sample of whole texts: about ``sample`` documents of each
language, chosen by a hash of their id. Languages are taken in blocks whose tables fit in ``TABLE_BYTES``; with more than
one block, texts pass through one after another. Nothing else of a document but its text is looked at when it is scored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kumiki.llm.bpe import held
from kumiki.llm.kernel import FOLD, texts_of
from kumiki.llm.shared import bounded, small_batches, written

ORDER, SAMPLE_DOCS = 3, 3000
SYMBOLS = len(np.unique(FOLD))
#: Bytes of the deepest table of code lengths of a block of languages; one language is a block at any size.
TABLE_BYTES = 96 << 20
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123)]] = True


def grams(t) -> np.ndarray:
    """For each byte of a chunk the ORDER bytes before it and itself as one number; each text begins after white space."""
    n = len(t.data)
    size = np.diff(t.offs)
    at = np.arange(n) + ORDER * np.repeat(np.arange(1, len(t) + 1), size)
    wide = np.full(n + ORDER * len(t), 32, np.uint32)
    wide[at] = FOLD[t.data]
    out = np.zeros(n, np.uint32)
    for back in range(ORDER, -1, -1):
        out <<= np.uint32(8)
        out |= wide[at - back]
    return out


def gram_counts(batches):
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for lang in sorted(set(langs)):
            own = batch.column(1).filter(pa.array(langs == lang))
            parts = [grams(t) for t in texts_of(own)]
            key, n = np.unique(np.concatenate(parts), return_counts=True) if parts else ([], [])
            cols = [pa.array([lang] * len(key), pa.string()), pa.array(key, pa.int64()), pa.array(n, pa.int64())]
            yield pa.record_batch(cols, ["lang", "gram", "n"])


def place(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """1 + the place of each wanted number among sorted keys, or 0."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at + 1, 0)


class Level:
    """Contexts of one depth: bits of the symbols met after them and of escapes from them, a row for each language."""

    def __init__(self, depth: int, counts: list[tuple[np.ndarray, np.ndarray]], below: Level | None):
        self.mask = np.uint32((1 << 8 * (depth + 1)) - 1)
        met = []
        for key, n in counts:
            own, where = np.unique(key & self.mask, return_inverse=True)
            met.append((own, np.bincount(where, n, len(own))))
        self.keys = np.unique(np.concatenate([own for own, _ in met]))
        self.contexts = np.unique(self.keys >> np.uint32(8))
        of = np.searchsorted(self.contexts, self.keys >> np.uint32(8))
        at = None if below is None else place(below.keys, self.keys & below.mask)
        self.bits = np.zeros((len(met), len(self.keys) + 1), np.float32)
        self.escape = np.zeros((len(met), len(self.contexts) + 1), np.float32)
        self.exact = []  # in double precision, for the level above
        for i, (own, n) in enumerate(met):
            lower = np.full(len(self.keys), np.log2(SYMBOLS)) if below is None else below.exact[i][at - 1]
            mine = np.searchsorted(self.keys, own)
            c = of[mine]
            total, kinds = (np.bincount(c, w, len(self.contexts)) for w in (n, None))
            unseen = 1 - np.bincount(c, np.exp2(-lower[mine]), len(self.contexts))
            full = kinds >= SYMBOLS  # every symbol has been seen: nothing to escape to
            left = (kinds > 0) & ~full
            out = np.zeros(len(self.contexts))
            out[left] = -np.log2(kinds[left] / (total + kinds)[left] / np.maximum(unseen[left], 1e-12))
            bits = lower + out[of]
            bits[mine] = -np.log2(n / (total + np.where(full, 0, kinds))[c])
            self.bits[i, 1:], self.escape[i, 1:] = bits, out
            self.exact.append(bits)


class Model:
    """The code lengths under each language of a block, from the counts of its grams."""

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        self.langs, self.levels = langs, []
        for depth in range(ORDER + 1 if langs else 0):
            self.levels.append(Level(depth, counts, self.levels[-1] if self.levels else None))
        for level in self.levels:
            del level.exact

    def bits(self, t) -> np.ndarray:
        """Code length of each text of a chunk under each language."""
        out = np.zeros((len(t), len(self.langs)))
        full = np.flatnonzero(np.diff(t.offs))
        if not len(full) or not self.langs:
            return out
        gram, left, found = grams(t), None, []
        for level in reversed(self.levels):
            key = (gram if left is None else gram[left]) & level.mask
            at = place(level.keys, key)
            miss = np.flatnonzero(at == 0)
            found.append((left, level.bits, at))
            now = miss if left is None else left[miss]
            found.append((now, level.escape, place(level.contexts, key[miss] >> np.uint32(8))))
            left = now
        for i in range(len(self.langs)):
            cost = found[0][1][i][found[0][2]]
            for where, table, at in found[1:]:
                cost[where] += table[i][at]
            cost[left] += np.float32(np.log2(SYMBOLS))
            out[full, i] = np.add.reduceat(cost, t.offs[full], dtype=np.float64)
        return out


def has_letter(raw: np.ndarray) -> bool:
    return bool(LETTERS[raw].any()) or any(c.isalpha() for c in raw.tobytes().decode())


def predictions(batches, model: Model, names: list[str], first: bool, last: bool):
    """Texts with the best language so far, its bits, and the sum of the languages' probabilities over the best one's;
    after the last block the language and its share."""
    for batch in batches:
        n = batch.num_rows
        bits = np.concatenate([np.zeros((0, len(model.langs))), *(model.bits(t) for t in texts_of(batch.column(2)))])
        letters = [has_letter(t.data[t.offs[i] : t.offs[i + 1]]) for t in texts_of(batch.column(2)) for i in range(len(t))] if last else []
        lang = ["und"] * n if first else batch.column(3).to_pylist()
        best = np.full(n, np.inf) if first else batch.column(4).to_numpy()
        total = np.zeros(n) if first else batch.column(5).to_numpy()
        if model.langs and n:
            own = bits.min(1)
            share = np.exp2(np.maximum(own[:, None] - bits, -1000)).sum(1)
            less = own < best
            lang = [model.langs[k] if new else old for k, new, old in zip(bits.argmin(1), less, lang, strict=True)]
            with np.errstate(under="ignore"):
                move = np.exp2(-np.minimum(np.abs(own - best), 1000))
            total = np.where(less, share + total * move, total + share * move)
            best = np.minimum(own, best)
        if last:
            known = [bool(model.langs) and x for x in letters]
            lang = [x if k else "und" for x, k in zip(lang, known, strict=True)]
            score = np.where(known, 1 / np.where(total > 0, total, 1), 0.0) if n else np.zeros(0)
            cols = [pa.array(lang, pa.string()), pa.array(score, pa.float64())]
        else:
            cols = [batch.column(2), pa.array(lang, pa.string()), pa.array(best, pa.float64()), pa.array(total, pa.float64())]
        yield pa.record_batch([batch.column(0), batch.column(1), *cols], names)


def train(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str, sample: int, table_bytes: int):
    """Blocks of languages by name with the counts of their grams, from a bounded sample of the rows where learn holds."""
    rows = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    part = F.pmod(F.xxhash64(id_col, F.lit("sample")), F.lit(1 << 20)) / (1 << 20)
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), part.alias("part"))
    many = written(rows.groupBy("lang").agg(F.count("*").alias("many")), "langs")
    chosen = rows.join(bounded(many), "lang").filter(F.col("part") < sample / F.col("many")).select("lang", "text")
    met = chosen.mapInArrow(gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    met = written(met, "grams")
    sizes = dict(met.groupBy("lang").count().collect())
    langs = sorted(r["lang"] for r in many.select("lang").collect())
    blocks: list[list[str]] = []
    held_grams = 0
    for lang in langs:
        size = sizes.get(lang, 0)
        if not blocks or 4 * (held_grams + size) * (len(blocks[-1]) + 1) > table_bytes:
            blocks.append([])
            held_grams = 0
        blocks[-1].append(lang)
        held_grams += size
    for block in blocks:
        own = (met if len(blocks) == 1 else met.filter(F.col("lang").isin(block))).toPandas()
        counts = {x: (g["gram"].to_numpy(np.uint32), g["n"].to_numpy(np.int64)) for x, g in own.groupby("lang")}
        empty = (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        yield block, [counts.get(x, empty) for x in block], block is blocks[-1]
    if not blocks:
        yield [], [], True


def identify(
    docs: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample: int = SAMPLE_DOCS,
    flag: Column | None = None,
    table_bytes: int = TABLE_BYTES,
) -> DataFrame:
    """One row for each row of docs: id, flag (held_out), lang_pred, score.

    Only rows where learn holds, with a language and a text, are learnt from. score is the winner's share of the
    probabilities that the code lengths stand for. A null, empty or letterless text gives ``und`` and 0, as does every
    text if there is nothing to learn from; of equal code lengths the first language by name wins. Repeated rows give
    equal rows. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(
        F.col(id_col), (F.lit(False) if flag is None else F.coalesce(flag, F.lit(False))).alias("held_out"), F.col(text_col)
    )
    keys = [source.schema[0], T.StructField("held_out", T.BooleanType())]
    lang = T.StructField("lang_pred", T.StringType())
    so_far = T.StructType([*keys, source.schema[2], lang, *(T.StructField(c, T.DoubleType()) for c in ("best", "total"))])
    schema = T.StructType([*keys, lang, T.StructField("score", T.DoubleType())])
    first = True
    for langs, counts, last in train(docs, learn, id_col, text_col, lang_col, sample, table_bytes):
        out = schema if last else so_far
        source = source.mapInArrow(_scorer(spark.sparkContext.broadcast((langs, counts)), out.names, first, last), out)
        source = source if last else written(source, "languages")
        first = False
    return source


def _scorer(sent, names: list[str], first: bool, last: bool):
    made = uuid.uuid4().hex
    return lambda it: predictions(it, held(("langid", made), lambda: Model(*sent.value)), names, first, last)
