"""Document layer: coreference as edges and components, nearest antecedents, semantic chunks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kumiki.operators.arrow import each

# Chunk sizes and the likeness of topics below which a chunk may end.
MAX_CHARS, MIN_CHARS, TOPIC_SHIFT = 400, 80, 0.05
HONORIFICS = "(さん|様|氏|君|ちゃん|先生|社長|部長|課長)$"
LEGAL = "^(株式会社|有限会社|合同会社)|(株式会社|有限会社|合同会社|[ ,]*(Inc|Ltd|GmbH|Corp)\\.?)$"


def core_form(kind: Column, surface: Column) -> Column:
    """A mention without honorifics (persons), legal forms (organisations) or administrative endings (places)."""
    person = F.regexp_replace(F.regexp_replace(surface, HONORIFICS, ""), HONORIFICS, "")
    return (
        F.when(kind == "PERSON", person)
        .when(kind == "ORGANIZATION", F.regexp_replace(surface, LEGAL, ""))
        .when(kind == "LOCATION", F.regexp_replace(surface, "(?<=.)[都道府県市区町村]$", ""))
        .otherwise(surface)
    )


def mention_links(mentions: DataFrame) -> DataFrame:
    """Edges (text_id, a, b) between mentions (text_id, mention_id, type, surface) of one core form or a prefix of it.

    Mentions are blocked by the first two characters of their core, so no pairs of a whole document are formed.
    """
    m = mentions.withColumn("core", core_form(F.col("type"), F.col("surface"))).withColumn("block", F.substring("core", 1, 2))
    names = m.groupBy("text_id", "type", "block", "core").agg(F.min("mention_id").alias("first"))
    same = m.join(names, ["text_id", "type", "block", "core"]).select("text_id", F.col("mention_id").alias("a"), F.col("first").alias("b"))
    x = names.select("text_id", "type", "block", F.col("core").alias("x"), F.col("first").alias("a"))
    y = names.select("text_id", "type", "block", F.col("core").alias("y"), F.col("first").alias("b"))
    prefix = x.join(y, ["text_id", "type", "block"]).filter((F.col("x") != F.col("y")) & F.startswith("x", F.col("y")) & (F.char_length("y") >= 2))
    return same.unionByName(prefix.select("text_id", "a", "b")).filter("a <> b").distinct()


def mention_components(links: DataFrame, nodes: DataFrame, key: str = "text_id") -> DataFrame:
    """key, node, label: the smallest node of each component, by rounds of least labels until none changes.

    Each round is checkpointed to the folder of spark.checkpoint.dir; where that is unset, one is made only if the
    session runs on this machine alone.
    """
    spark = links.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kumiki-"))
    both = links.select(key, "a", "b").unionByName(links.select(key, F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = nodes.select(key, "node", F.col("node").alias("label")).distinct().checkpoint()
    moved = True
    while moved:
        near = both.join(labels.select(key, F.col("node").alias("b"), "label"), [key, "b"]).groupBy(key, F.col("a").alias("node")).agg(F.min("label").alias("low"))
        step = labels.join(near, [key, "node"], "left").select(key, "node", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        far = step.select(key, F.col("node").alias("label"), F.col("label").alias("to"))
        step = step.join(far, [key, "label"], "left").select(key, "node", "old", F.least("label", "to").alias("label")).checkpoint()
        labels = step.select(key, "node", "label")
        moved = not step.filter("old <> label").isEmpty()
    return labels


def nearest_before(df: DataFrame, by: str, order: list[str], value: Column, name: str) -> DataFrame:
    """The last non-null value of an earlier row of the group: an as-of join backwards."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def anaphora(mentions: DataFrame, pronouns: dict[str, str]) -> DataFrame:
    """text_id, mention_id, surface, antecedent, confidence: for each mention that is a pronoun the nearest mention
    before it of the type that the pronoun stands for; mentions: text_id, mention_id, surface, type (null for none)."""
    stands = F.create_map(*(F.lit(x) for pair in pronouns.items() for x in pair))[F.col("surface")]
    rows = mentions.withColumn("stands", stands).withColumn("kind", F.coalesce("stands", "type")).filter("kind IS NOT NULL")
    w = Window.partitionBy("text_id", "kind").orderBy("mention_id").rowsBetween(Window.unboundedPreceding, -1)
    name = F.when(F.col("stands").isNull(), F.col("mention_id"))
    found = rows.withColumn("antecedent", F.last(name, ignorenulls=True).over(w)).filter("stands IS NOT NULL AND antecedent IS NOT NULL")
    return found.select("text_id", "mention_id", "surface", "antecedent", F.lit(0.5).alias("confidence"))


def pack(pieces: list[tuple[str, bool, frozenset]], max_chars: int, min_chars: int) -> list[list[int]]:
    """Groups of pieces (text, heading, topics) in order: a heading begins a group, a group ends at the size limit, or
    when it is twice the least size and the topics change."""
    groups: list[list[int]] = []
    size, seen = 0, set()
    for i, (text, heading, topics) in enumerate(pieces):
        likeness = len(seen & topics) / len(seen | topics) if seen and topics else 1.0
        full = size + len(text) > max_chars and size
        shifted = size >= 2 * min_chars and likeness < TOPIC_SHIFT
        if not groups or heading or full or shifted:
            groups.append([])
            size, seen = 0, set()
        groups[-1].append(i)
        size += len(text)
        seen |= topics
    # A group of too few characters joins the one before it, unless a heading begins it.
    out: list[list[int]] = []
    for g in groups:
        short = sum(len(pieces[i][0]) for i in g) < min_chars
        if out and short and not pieces[g[0]][1] and sum(len(pieces[i][0]) for i in out[-1] + g) <= max_chars:
            out[-1] += g
        else:
            out.append(g)
    return out


def chunks(sentences: DataFrame, max_chars: int = MAX_CHARS, min_chars: int = MIN_CHARS) -> DataFrame:
    """text_id, chunk_id, begin, end, text, hint of sentences (text_id, sent_id, begin, end, text).

    The packer is sequential, so it runs by document; a sentence is heading if it looks like one, its topics are its
    longer words.
    """
    gathered = sentences.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("sent_id", "begin", "end", "text"))).alias("s"))

    head = re.compile(r"^(#{1,6}\s|[■□◆◇●▼【])")

    def one(ss):
        pieces = [(s["text"], bool(head.match(s["text"])), frozenset(w for w in re.findall(r"\w+", s["text"].lower()) if len(w) > 3)) for s in ss]
        return [
            {"begin": ss[g[0]]["begin"], "end": ss[g[-1]]["end"], "text": "\n".join(ss[i]["text"] for i in g), "hint": ss[g[0]]["text"][:60]}
            for g in pack(pieces, max_chars, min_chars)
        ]

    packed = each(one, "array<struct<begin:int,end:int,text:string,hint:string>>")
    out = gathered.select("text_id", F.posexplode(packed("s")).alias("chunk_id", "c"))
    return out.select("text_id", "chunk_id", "c.begin", "c.end", "c.text", "c.hint")
