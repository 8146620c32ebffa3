"""BPE encoding and decoding with a lexicon of frequent words; results equal the tokenizers library's.

Pieces of all texts are counted (in each task a bounded table of those that recur, then summed), the most frequent ones
are compiled into a minimal acyclic transducer (kumiki.llm.lexicon), and every executor memory-maps it. A piece that it
lacks is merged exactly by the library. Texts that hold the string of a special token, or a code point that the
pre-tokeniser has no data of, go to the library as a whole.
"""

from __future__ import annotations

import hashlib
import unicodedata
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kumiki.llm.lexicon import Lexicon, build
from kumiki.llm.pretokens import CHUNK_CHARS, GAP, Encoder, classify, span_hashes, spans
from kumiki.llm.shared import small_batches

#: Words that are compiled; pieces that a task counts at once, and those that it hands on.
LEXICON_WORDS, TASK_PIECES, TASK_WORDS = 50_000, 300_000, 25_000

_held: dict = {}


def held(key, make):
    """A worker's own object, made once; only one of a kind is kept."""
    if _held.get(key[0], (None,))[0] != key:
        _held[key[0]] = (key, make())
    return _held[key[0]][1]


def count_pieces(batches, rule: str):
    """Pieces of a task with their counts; when the table is full, those met once are let go."""
    counts: Counter = Counter()

    def take(texts: list[str]) -> None:
        joined, cps, cls = classify("\0".join(texts), rule)
        if not len(cps):
            return
        cls = cls.copy()
        cls[np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)[:-1] - 1] = GAP
        begin, end = spans(cps, cls, rule)
        _, where, n = np.unique(span_hashes(cps, begin, end), return_index=True, return_counts=True)
        more = n > 1
        pieces = zip(begin[where[more]].tolist(), end[where[more]].tolist(), n[more].tolist(), strict=True)
        for b, e, k in pieces:
            counts[joined[b:e]] += k
        if len(counts) > TASK_PIECES:
            for piece, _ in counts.most_common()[TASK_PIECES // 2 :]:
                del counts[piece]

    for batch in batches:
        texts: list[str] = []
        size = 0
        for text in batch.column(0).to_pylist():
            if text:
                texts.append(text if rule == "pieces" or text.isascii() else unicodedata.normalize("NFC", text))
                size += len(text)
                if size > CHUNK_CHARS:
                    take(texts)
                    texts, size = [], 0
        if texts:
            take(texts)
    best = counts.most_common(TASK_WORDS)
    yield pa.record_batch([pa.array([w for w, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], ["piece", "n"])


def compile_lexicon(docs: DataFrame, tokenizer: str, rule: str, text_col: str, words: int) -> bytes:
    """The transducer of the most frequent pieces; it has no more than words entries, whatever the input."""
    counted = docs.select(text_col).mapInArrow(lambda it: count_pieces(it, rule), "piece string, n long")
    best = counted.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(words).collect()
    pieces = [r.piece for r in best]
    encoder = Encoder(tokenizer, rule)
    return build(dict(zip(pieces, encoder.merge(pieces), strict=True)) if pieces else {})


class Decoder:
    """decode(ids) as the library does it, special tokens included."""

    def __init__(self, tok):
        self.tok = tok
        self.table = None
        if tok.decoder is None:  # tokens joined by a space
            self.table = [(tok.id_to_token(i) or "").encode() for i in range(tok.get_vocab_size())]

    def decode(self, ids: list[int]) -> bytes:
        if self.table is None:
            return self.tok.decode(ids, skip_special_tokens=False).encode()
        return b" ".join(map(self.table.__getitem__, ids))


OUTPUTS = {
    "n_tokens": T.LongType(),
    "ids": T.ArrayType(T.IntegerType()),
    "decoded": T.StringType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def bpe(
    docs: DataFrame,
    tokenizer: str,
    rule: str = "words",
    id_col: str = "doc_id",
    text_col: str = "text",
    outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"),
    words: int = LEXICON_WORDS,
) -> DataFrame:
    """One row for each row of docs: its id and the outputs asked for, of n_tokens, ids, decoded and digests of both.

    A null text is encoded as an empty one, which has no ids and decodes to the empty string. Repeated rows give equal
    rows, ids may be null or of any type, other columns are not looked at, and an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    blob = docs.sparkSession.sparkContext.broadcast(compile_lexicon(docs, tokenizer, rule, text_col, words))
    made = uuid.uuid4().hex
    source = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    schema = T.StructType([source.schema[0], *[T.StructField(c, OUTPUTS[c]) for c in outputs]])

    def run(batches):
        key = ("encoder", tokenizer, rule, made)
        encoder = held(key, lambda: Encoder(tokenizer, rule, Lexicon.of(blob.value)))
        decoder = held(("decoder", tokenizer), lambda: Decoder(encoder.tok))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i in range(0, len(texts), 200):
                found = encoder.encode(texts[i : i + 200])
                cols: dict[str, list] = {c: [] for c in outputs}
                for ids in found:
                    if "n_tokens" in cols:
                        cols["n_tokens"].append(len(ids))
                    if "ids" in cols:
                        cols["ids"].append(ids.astype(np.int32))
                    if "ids_sha256" in cols:
                        cols["ids_sha256"].append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    if "decoded" in cols or "decoded_sha256" in cols:
                        raw = decoder.decode(ids.tolist())
                        if "decoded" in cols:
                            cols["decoded"].append(raw.decode())
                        if "decoded_sha256" in cols:
                            cols["decoded_sha256"].append(hashlib.sha256(raw).hexdigest())
                kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
                arrays = [pa.array(cols[c], kinds.get(c, pa.string())) for c in outputs]
                yield pa.record_batch([batch.column(0).slice(i, len(found)), *arrays], schema.names)

    return source.mapInArrow(run, schema)
