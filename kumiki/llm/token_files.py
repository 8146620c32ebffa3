"""Token ids in flat binary files.

Documents are dealt by ranges of their id and sorted, each partition writes three files, and the manifest of all
partitions (a row each) gives every partition's base by prefix sums:

- ``part-N.ids``: the ids of its documents end to end, unsigned 16-bit where the vocabulary fits, else 32-bit;
- ``part-N.idx``: 64-bit offsets of its documents in that file, in ids, one more than documents;
- ``part-N.doc``: their 64-bit document ids (the smallest 64-bit number stands for null).

The files lie in a folder that driver and executors share. A file is written under a name of its attempt and then
renamed, so a repeated or speculative task leaves the same file. Readers map the files into memory.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kumiki.llm.bpe import held
from kumiki.llm.pretokens import Encoder
from kumiki.llm.shared import small_batches

NULL_ID = -(1 << 63)


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path)


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    rule: str = "pieces",
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    partitions: int | None = None,
) -> dict:
    """Writes the files and ``manifest.json``; returns the manifest.

    A null text is an empty one: its document has the end id alone. Documents are in ascending order of their (whole
    number) id, nulls first; rows that repeat an id follow one another in the order of their texts. Other columns are
    not looked at. An empty table gives a manifest without parts.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(parts, "id").sortWithinPartitions("id", "text")
    vocab = Encoder(tokenizer, rule).tok.get_vocab_size()
    width = 2 if max(vocab, end_id + 1) <= 1 << 16 else 4
    store, root = _fs(folder)
    store.create_dir(root)

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = held(("writer", tokenizer, rule), lambda: Encoder(tokenizer, rule))
        out, top = _fs(folder)
        temp = f"{top}/.{part}-{uuid.uuid4().hex}"
        ids, sizes = [], []
        total = 0
        with out.open_output_stream(f"{temp}.ids") as f:
            for batch in batches:
                ids.append(batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype("<i8"))
                for found in encoder.encode(batch.column(1).to_pylist()):
                    f.write(np.append(found, np.uint32(end_id)).astype(f"<u{width}").tobytes())
                    sizes.append(len(found) + 1)
                    total += len(found) + 1
        if not sizes:
            out.delete_file(f"{temp}.ids")
            return
        for kind, data in (("idx", np.append(0, np.cumsum(sizes)).astype("<u8")), ("doc", np.concatenate(ids))):
            with out.open_output_stream(f"{temp}.{kind}") as f:
                f.write(data.tobytes())
        for kind in ("ids", "idx", "doc"):
            out.move(f"{temp}.{kind}", f"{top}/part-{part}.{kind}")
        yield pa.record_batch([pa.array([x], pa.int64()) for x in (part, len(sizes), total)], ["part", "docs", "tokens"])

    found = sorted(rows.mapInArrow(write, "part long, docs long, tokens long").collect())  # a row for each partition
    base, first, listed = 0, 0, []
    for part, n, tokens in found:
        listed.append({"part": part, "docs": n, "tokens": tokens, "base": base, "first": first})
        base, first = base + tokens, first + n
    manifest = {"width": width, "docs": first, "tokens": base, "parts": listed}
    with store.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def mapped(folder: str, part: int, kind: str, dtype: str) -> np.ndarray:
    """A file of a part as an array: a memory map where the folder is a mounted one, else its bytes."""
    store, top = _fs(folder)
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(f"{top}/part-{part}.{kind}", dtype, "r")
    with store.open_input_file(f"{top}/part-{part}.{kind}") as f:
        return np.frombuffer(f.read(), dtype)


def read_token_files(spark: SparkSession, folder: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row for each document in the files: id, start, n_tokens, ids_crc32, and ids if asked for."""
    store, root = _fs(folder)
    with store.open_input_file(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    width = manifest["width"]
    schema = f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = mapped(folder, row["part"], "ids", f"<u{width}")
                offs = mapped(folder, row["part"], "idx", "<u8").astype(np.int64)
                doc = mapped(folder, row["part"], "doc", "<i8")
                for i in range(0, len(doc), 5000):
                    cut = offs[i : i + 5001]
                    own = [np.asarray(ids[a:b]).astype("<u4") for a, b in zip(cut[:-1], cut[1:], strict=True)]
                    key = np.asarray(doc[i : i + 5000])
                    cols = [
                        pa.array(key, pa.int64(), mask=key == NULL_ID),
                        pa.array(cut[:-1] + row["base"], pa.int64()),
                        pa.array(np.diff(cut), pa.int64()),
                        pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()),
                    ]
                    if with_ids:
                        cols.append(pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64())))
                    yield pa.record_batch(cols, [id_col, "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    listed = [(p["part"], p["base"]) for p in manifest["parts"]]
    rows = spark.createDataFrame(listed, "part long, base long")
    return rows.repartition(max(1, len(listed)), "part").mapInArrow(read, schema)
