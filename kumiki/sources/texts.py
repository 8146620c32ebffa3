"""Text sources and result sinks."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kumiki.operators.vocab import FORMAT, SPECIAL, check_version


def read_documents(spark: SparkSession, path: str, pattern: str = "*.{txt,md}") -> DataFrame:
    """path, text of whole files below a folder."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_lines(spark: SparkSession, path: str, pattern: str = "*.{txt,md}") -> DataFrame:
    """path, text of the lines of files below a folder, without blank ones."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    return lines.select(F.input_file_name().alias("path"), F.make_valid_utf8("value").alias("text")).filter(F.trim("text") != "")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def save_vocab(vocab: DataFrame, path: str, granularity: str = "coarse", min_freq: int = 2) -> None:
    """A vocabulary (piece, id, freq) as Parquet with its header beside it."""
    vocab.write.mode("overwrite").parquet(f"{path}/pieces")
    head = {"version": FORMAT, "granularity": granularity, "min_freq": min_freq, "special": SPECIAL}
    vocab.sparkSession.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


def load_vocab(spark: SparkSession, path: str, granularity: str | None = None) -> tuple[DataFrame, dict]:
    head = json.loads(spark.read.text(f"{path}/header").first()[0])
    check_version(head["version"])
    if granularity and head["granularity"] != granularity:
        raise ValueError(f"E601: vocabulary of granularity {head['granularity']}, asked for {granularity}")
    return spark.read.parquet(f"{path}/pieces"), head


def find_config(explicit: str | None = None, env: str | None = None, folder: str = ".") -> Path | None:
    """The first that is there: an explicit file, the one an environment variable names, kumiki.json in the folder or home."""
    import os

    for p in (explicit, os.environ.get(env) if env else None, f"{folder}/kumiki.json", str(Path.home() / "kumiki.json")):
        if p and Path(p).is_file():
            return Path(p)
    if explicit:
        raise FileNotFoundError(explicit)
    return None


def load_config(path: Path | None) -> dict:
    """dictionaries: a list of folders, relative to the file."""
    if path is None:
        return {"dictionaries": []}
    raw = json.loads(path.read_text())
    listed = raw.get("dictionaries", [])
    listed = [listed] if isinstance(listed, str) else listed
    if not isinstance(listed, list) or not all(isinstance(x, str) for x in listed):
        raise ValueError(f"{path}: dictionaries must be a list of folders")
    return raw | {"dictionaries": [str((path.parent / x).resolve()) for x in listed]}
