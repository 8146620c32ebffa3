"""Readers of lexicon files: typed CSV and TSV with checks that name the file and the row."""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kumiki.operators.lexicons import split_list, with_precedence

# Columns of each lexicon, and of each column that isn't text its kind.
LEXICONS = {
    "slang": ["surface", "normalized", "meaning", "emotion", "category", "intensity", "keep_as_unit"],
    "emotion": ["surface", "base_emotion", "polarity", "intensity", "keep_as_unit"],
    "emotion_examples": ["surface", "base_emotion", "plutchik_emotion", "polarity", "intensity", "example", "example_id", "priority"],
    "entity": ["surface", "type", "normalized", "aliases", "priority", "keep_as_unit"],
    "intent_rules": ["intent", "pattern", "score", "priority"],
    "stopwords": ["surface", "category"],
    "normalization": ["source", "target", "type"],
    "synonym": ["canonical", "synonyms", "domain"],
    "sentiment": ["surface", "polarity", "intensity"],
    "okurigana": ["canonical", "variants", "pos", "domain"],
}
KINDS = {"intensity": "unit", "score": "unit", "priority": "int", "keep_as_unit": "bool", "aliases": "list", "synonyms": "list", "variants": "list"}
TRUE, FALSE = ("true", "1", "yes", "y"), ("false", "0", "no", "n", "")


class LexiconError(ValueError):
    """A lexicon that can't be read: a missing file or column, or a cell of the wrong kind."""


def typed(name: str, kind: str | None) -> tuple[Column, Column]:
    """The value of a text cell, and whether it is wrong."""
    c = F.trim(F.coalesce(F.col(name), F.lit("")))
    if kind == "unit":
        v = c.try_cast("double")
        return v, v.isNull() | (v < 0) | (v > 1)
    if kind == "int":
        v = c.try_cast("int")
        return v, v.isNull()
    if kind == "bool":
        low = F.lower(c)
        return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False), ~low.isin(*TRUE, *FALSE)
    if kind == "list":
        return split_list(c), F.lit(False)
    return c, F.lit(False)


def numbered(df: DataFrame) -> DataFrame:
    """seq: the order of the rows of a small file."""
    return df.withColumn("__id", F.monotonically_increasing_id()).withColumn("seq", F.row_number().over(Window.orderBy("__id"))).drop("__id")


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    try:
        return spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"')
    except Exception as e:
        raise LexiconError(f"{path}: {str(e).splitlines()[0]}") from e


def load(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A lexicon with its columns typed and ``seq``; raises LexiconError with the first wrong row."""
    rows = read_csv(spark, path)
    lacking = [c for c in LEXICONS[name] if c not in rows.columns]
    if lacking and rows.columns:
        raise LexiconError(f"{path}: missing columns {', '.join(lacking)}")
    rows = numbered(rows)
    parts = {c: typed(c, KINDS.get(c)) for c in LEXICONS[name]}
    wrong = F.array_compact(F.array(*(F.when(bad, c) for c, (_, bad) in parts.items())))
    if name == "sentiment":
        wrong = F.when(F.col("polarity").isin("positive", "negative"), wrong).otherwise(F.array_append(wrong, F.lit("polarity")))
    first = rows.select("seq", wrong.alias("wrong")).filter(F.size("wrong") > 0).orderBy("seq").first()
    if first:
        raise LexiconError(f"{path}: row {first.seq}: bad {', '.join(first.wrong)}")
    return rows.select(*(v.alias(c) for c, (v, _) in parts.items()), "seq")


def load_user_entities(spark: SparkSession, path: str) -> DataFrame:
    """User entities: only the surface is required, rows without one are skipped."""
    rows = numbered(read_csv(spark, path))
    if "surface" not in rows.columns:
        raise LexiconError(f"{path}: missing columns surface")

    def cell(name: str, instead: Column) -> Column:
        return F.coalesce(F.nullif(F.trim(name), F.lit("")), instead) if name in rows.columns else instead

    out = rows.select(
        F.trim("surface").alias("surface"), cell("type", F.lit("TERM")).alias("type"), cell("normalized", F.trim("surface")).alias("normalized"),
        split_list(cell("aliases", F.lit(""))).alias("aliases"), cell("priority", F.lit("100")).cast("int").alias("priority"),
        F.lower(cell("keep_as_unit", F.lit("true"))).isin(*TRUE).alias("keep_as_unit"), "seq",
    )
    return out.filter("surface <> ''")


def load_set(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All lexicons of a folder; files that aren't there are left out."""
    out = {}
    for name in LEXICONS:
        try:
            out[name] = load(spark, f"{folder.rstrip('/')}/{name}.csv", name)
        except LexiconError as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return out


# Labels of the intensity lexicon.
BASE_EMOTION = {"joy": "joy", "trust": "trust", "fear": "anxiety", "surprise": "surprise", "sadness": "sadness", "disgust": "disgust", "anger": "anger", "anticipation": "anticipation"}


def load_intensity_tsv(spark: SparkSession, path: str, least: float = 0.5) -> DataFrame:
    """English word, emotion, score, translation -> emotion rows of the translations that score enough and differ."""
    rows = read_csv(spark, path, sep="\t")
    if not rows.columns or not rows.columns[0].lower().startswith("english") or len(rows.columns) < 4:
        raise LexiconError(f"{path}: no intensity lexicon")
    rows = numbered(rows.toDF("english", "emotion", "score", "surface", *rows.columns[4:]))
    label = F.create_map(*(F.lit(x) for kv in BASE_EMOTION.items() for x in kv))[F.lower("emotion")]
    good = F.col("score").try_cast("double") >= least
    polarity = F.when(label.isin("joy", "trust", "anticipation"), "positive").when(label == "surprise", "neutral").otherwise("negative")
    return rows.filter(good & label.isNotNull() & (F.lower("english") != F.lower("surface")) & (F.trim("surface") != "")).select(
        F.trim("surface").alias("surface"), label.alias("base_emotion"), polarity.alias("polarity"),
        F.col("score").cast("double").alias("intensity"), F.lit(False).alias("keep_as_unit"), "seq",
    )


def load_examples_csv(spark: SparkSession, path: str, labels: dict[str, str], prefix: str) -> DataFrame:
    """word, emotion, intensity, examples (、-separated) -> a row for each example with an id; unknown labels are skipped."""
    rows = numbered(read_csv(spark, path))
    label = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))[F.trim("emotion")]
    each = rows.filter(label.isNotNull()).select(
        F.trim("word").alias("surface"), label.alias("base_emotion"), F.col("intensity").try_cast("double").alias("intensity"), "seq",
        F.posexplode(F.split("examples", "、")).alias("nth", "example"),
    )
    each = each.filter(F.trim("example") != "")
    return each.withColumn("example_id", F.format_string(f"{prefix}-%05d-%02d", F.col("seq"), F.col("nth") + 1)).drop("nth")


def with_external(internal: DataFrame, external: DataFrame, key: str = "surface") -> DataFrame:
    return with_precedence(internal, external, key)


def apply_user_entities(base: DataFrame, user: DataFrame) -> DataFrame:
    """User rows first; rows of base with their surface go."""
    return with_precedence(user, base, "surface")


def load_examples_dir(spark: SparkSession, folder: str, labels: dict[str, str], pattern: str = "*.csv") -> DataFrame:
    """The example files of a folder in the order of their names; each file's ids begin with the last part of its name."""
    found = sorted(Path(folder).glob(pattern)) if "://" not in folder else []
    if not found:
        raise LexiconError(f"{folder}: no file matches {pattern}")
    parts = [load_examples_csv(spark, str(p), labels, p.stem.rsplit("-", 1)[-1]) for p in found]
    return reduce(DataFrame.unionByName, parts)


def resolve_dictionary(entry: str, base: str | None = None, domains: dict[str, str] | None = None) -> str:
    """The folder of a dictionary: ``builtin:NAME`` by the given domains, a relative path from base."""
    if entry.startswith("builtin:"):
        name = entry.removeprefix("builtin:")
        if name not in (domains or {}):
            raise LexiconError(f"unknown built-in dictionary {name!r} (available: {', '.join(sorted(domains or {})) or 'none'})")
        return domains[name]
    path = Path(entry.strip()).expanduser()
    return str(path if path.is_absolute() or base is None else Path(base) / path)


def manifest(lexicons: dict[str, DataFrame], expected: dict[str, int] | None = None) -> DataFrame:
    """name, rows, expected, matches: the rows of each lexicon against those that a manifest names."""
    spark = next(iter(lexicons.values())).sparkSession
    counts = [(name, df.count(), (expected or {}).get(name)) for name, df in sorted(lexicons.items())]
    out = spark.createDataFrame(counts, "name string, rows long, expected long")
    return out.withColumn("matches", F.col("expected").isNull() | (F.col("rows") == F.col("expected")))
