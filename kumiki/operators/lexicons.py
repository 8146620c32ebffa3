"""Lexicons as relations: precedence of user and external rows, kana twins, and the derived lookup views.

Each lexicon carries ``seq``, the order of its rows; every collision is settled by it, never by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kumiki.functions.text import HIRAGANA, KATAKANA

HIRA = "".join(chr(c) for c in range(0x3041, 0x3097))
KATA = "".join(chr(c + 0x60) for c in range(0x3041, 0x3097))


def one_per_key(df: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__nth", F.row_number().over(w)).filter("__nth = 1").drop("__nth")


def last_wins(df: DataFrame, key: str = "surface") -> DataFrame:
    return one_per_key(df, key, F.desc("seq"))


def with_precedence(first: DataFrame, second: DataFrame, key: str = "surface") -> DataFrame:
    """Rows of first, and those of second whose key first lacks."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def kana_twins(df: DataFrame, least: int = 3) -> DataFrame:
    """df and the hiragana or katakana twin of every surface of one kana script, unless it is there already."""
    hira, kata = F.col("surface").rlike(f"^[{HIRAGANA}]+$"), F.col("surface").rlike(f"^[{KATAKANA}]+$")
    twin = F.when(hira, F.translate("surface", HIRA, KATA)).when(kata, F.translate("surface", KATA, HIRA))
    more = df.filter((hira | kata) & (F.char_length("surface") >= least)).withColumn("surface", twin)
    return with_precedence(df, last_wins(more))


def split_list(c: Column) -> Column:
    """Entries of a ``|`` list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, "\\|"), F.trim), lambda x: x != "")


def entity_by_surface(entities: DataFrame) -> DataFrame:
    """surface -> entity row: aliases first, surfaces override them, the later row wins within each."""
    alias = entities.select(F.explode("aliases").alias("key"), "seq", "surface", "type", "normalized", F.lit(0).alias("own"))
    own = entities.select(F.col("surface").alias("key"), "seq", "surface", "type", "normalized", F.lit(1).alias("own"))
    return one_per_key(alias.unionByName(own), "key", F.desc("own"), F.desc("seq")).drop("own")


def entity_canonical(entities: DataFrame) -> DataFrame:
    """surface or alias -> canonical form: the earliest row wins, surfaces beat aliases; no identity pairs."""
    alias = entities.select(F.explode("aliases").alias("key"), F.col("normalized").alias("canonical"), "seq", F.lit(0).alias("own"))
    own = entities.select(F.col("surface").alias("key"), F.col("normalized").alias("canonical"), "seq", F.lit(1).alias("own"))
    pairs = alias.unionByName(own).filter("key <> canonical AND key <> '' AND canonical <> ''")
    return one_per_key(pairs, "key", F.desc("own"), "seq").select("key", "canonical")


def canonical_map(groups: DataFrame) -> DataFrame:
    """word -> canonical of synonym or spelling groups (canonical, synonyms, seq): a canonical stands for itself,
    other words go to the first group that has them."""
    own = groups.select(F.col("canonical").alias("word"), "canonical", "seq", F.lit(1).alias("own"))
    other = groups.select(F.explode("synonyms").alias("word"), "canonical", "seq", F.lit(0).alias("own"))
    return one_per_key(own.unionByName(other), "word", F.desc("own"), "seq").select("word", "canonical")


def synonym_groups(groups: DataFrame) -> DataFrame:
    """canonical -> the whole group, canonical first."""
    return groups.select("canonical", F.array_distinct(F.concat(F.array("canonical"), "synonyms")).alias("words"))


def examples_by_surface(examples: DataFrame) -> DataFrame:
    """surface -> its examples in file order."""
    rows = examples.groupBy("surface").agg(F.array_sort(F.collect_list(F.struct("seq", "example", "base_emotion"))).alias("examples"))
    return rows.select("surface", "examples")


def compact_okurigana(groups: DataFrame) -> DataFrame:
    """spelling with kana -> the group's first form of kanji alone (canonical, synonyms); groups without one are left out."""
    forms = F.concat(F.array("canonical"), "synonyms")
    kanji = F.filter(forms, lambda f: ~f.rlike(f"[{HIRAGANA}]"))
    rows = groups.select("seq", forms.alias("forms"), F.get(kanji, F.lit(0)).alias("to")).filter("to IS NOT NULL")
    pairs = rows.select("seq", F.explode("forms").alias("word"), "to").filter("word <> to")
    return one_per_key(pairs, "word", "seq").select("word", F.col("to").alias("canonical"))


def keep_as_unit(slang: DataFrame, emotion: DataFrame, entity: DataFrame) -> DataFrame:
    """surface -> part of speech of the rows to keep whole; entities override the others."""
    def part(df: DataFrame, pos: str, rank: int) -> DataFrame:
        return df.filter("keep_as_unit").select("surface", F.lit(pos).alias("pos"), F.lit(rank).alias("rank"), "seq")

    rows = part(slang, "感動詞-SNS表現", 0).unionByName(part(emotion, "感動詞-SNS表現", 0)).unionByName(part(entity, "名詞-固有名詞", 1))
    return one_per_key(rows, "surface", F.desc("rank"), F.desc("seq")).select("surface", "pos")


def known_hiragana(*lexicons: DataFrame) -> DataFrame:
    """Surfaces of hiragana alone, of two characters or more."""
    rows = [d.select("surface").filter(F.col("surface").rlike(f"^[{HIRAGANA}]{{2,}}$")) for d in lexicons]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out.distinct()


def attested_words(tokens: DataFrame, least: int = 3) -> DataFrame:
    """word, n: pieces of two kanji or more that occur so often, for the splitting of compounds."""
    kanji = tokens.filter(F.col("piece").rlike("^[\\u4E00-\\u9FFF\\u3005]{2,}$"))
    return kanji.groupBy(F.col("piece").alias("word")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


# How lexicons weigh in the scoring of affect.
SOURCE_WEIGHT = {"emotion": 1.0, "slang": 0.9, "external": 0.5, "sentiment": 1.0, "example": 0.3}


def affect_candidates(emotion: DataFrame, slang: DataFrame, external: DataFrame, sentiment: DataFrame, examples: DataFrame) -> DataFrame:
    """surface, base_emotion, polarity, intensity, source, weight, rank: longest first, then by source and seq.

    Sentiment rows give way to any emotion row of their surface, examples to one of their surface and emotion.
    """
    order = {name: i for i, name in enumerate(SOURCE_WEIGHT)}

    def part(df: DataFrame, source: str) -> DataFrame:
        return df.select("surface", "base_emotion", "polarity", "intensity", "seq", F.lit(source).alias("source"),
                         F.lit(SOURCE_WEIGHT[source]).alias("weight"), F.lit(order[source]).alias("__o"))

    base = part(emotion, "emotion").unionByName(part(slang, "slang")).unionByName(part(external.filter(F.char_length("surface") >= 2), "external"))
    rated = part(sentiment.withColumn("base_emotion", F.lit("evaluation")), "sentiment").join(base.select("surface").distinct(), "surface", "left_anti")
    shown = part(examples, "example").join(base.select("surface", "base_emotion").distinct(), ["surface", "base_emotion"], "left_anti")
    whole = base.unionByName(rated).unionByName(shown)
    w = Window.orderBy(F.desc(F.char_length("surface")), "__o", "seq", "surface")  # a lexicon, small by its nature
    return whole.withColumn("rank", F.row_number().over(w)).drop("__o", "seq")
