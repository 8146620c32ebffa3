"""Query understanding and reranking signals: query records, chunk views, search terms, and evaluation measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kumiki.functions.text import LATIN, category_runs, query_intent, time_compatible

# The constraint that each entity type stands for, and the entity types that answer each question.
CONSTRAINT = {"DATE": "time", "TIME": "time", "LOCATION": "location", "MONEY": "quantity", "QUANTITY": "quantity", "ORGANIZATION": "organization", "PERSON": "person", "PRODUCT": "product", "SERVICE": "product", "BRAND": "product", "EVENT": "event"}
ANSWERS = {"MONEY": ["MONEY"], "DATE": ["DATE", "TIME"], "LOCATION": ["LOCATION"], "PERSON": ["PERSON"], "NUMBER": ["QUANTITY", "MONEY"]}
EXPANSION_WEIGHT = 0.15


def label_map(pairs: dict) -> Column:
    return F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v))))


def query_records(queries: DataFrame, id_col: str, text_col: str, entities: DataFrame, synonyms: DataFrame, words: Column) -> DataFrame:
    """query_id, text, intent, answer_type, keywords, expanded, constraints of queries.

    entities: query_id, type, surface; synonyms: word, synonym, seq (at most two of a word are taken).
    """
    intent, answer = query_intent(F.col(text_col))
    base = queries.select(F.col(id_col).alias("query_id"), F.col(text_col).alias("text"), intent.alias("intent"), answer.alias("answer_type"), F.array_distinct(words).alias("keywords"))
    two = synonyms.withColumn("n", F.row_number().over(Window.partitionBy("word").orderBy("seq", "synonym"))).filter("n <= 2")
    more = base.select("query_id", F.posexplode("keywords").alias("pos", "word")).join(F.broadcast(two), "word")
    more = more.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "synonym"))).alias("s"))
    more = more.select("query_id", F.array_distinct("s.synonym").alias("expanded"))
    kinds = entities.withColumn("key", label_map(CONSTRAINT)[F.col("type")]).filter("key IS NOT NULL")
    kinds = kinds.groupBy("query_id", "key").agg(F.array_sort(F.collect_set("surface")).alias("v"))
    kinds = kinds.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "v")))).alias("constraints"))
    out = base.join(more, "query_id", "left").join(kinds, "query_id", "left")
    none = F.array().cast("array<string>")
    return out.withColumn("expanded", F.array_except(F.coalesce("expanded", none), "keywords"))


def rerank_features(pairs: DataFrame) -> DataFrame:
    """The six signals of pairs of a query and a chunk; a signal is null where the query asks for nothing of its kind.

    pairs: keywords, expanded, topics, entities, times, sentiment, answer_type of the query, and c_keywords, c_topics,
    c_entities, c_times, c_sentiment, c_types of the chunk (arrays but for the sentiments and the answer type).
    """
    q, c = F.col, lambda n: F.col(f"c_{n}")
    overlap = lambda a, b: F.size(F.array_intersect(a, b))
    weight = F.size("keywords") + EXPANSION_WEIGHT * F.size("expanded")
    words = (overlap(q("keywords"), c("keywords")) + EXPANSION_WEIGHT * overlap(q("expanded"), c("keywords"))) / weight
    asked = label_map(ANSWERS)[F.coalesce("answer_type", F.lit(""))]
    fits = F.exists("times", lambda w: F.exists(c("times"), lambda v: time_compatible(w, v)))
    topic = F.when(overlap(q("topics"), c("topics")) > 0, 1.0).when(F.exists("topics", lambda t: F.exists(c("topics"), lambda u: F.contains(u, t) | F.contains(t, u))), 0.5).otherwise(0.0)
    return pairs.withColumns({
        "entity_match": F.when(F.size("entities") > 0, overlap(q("entities"), c("entities")) / F.size("entities")),
        "keyword_overlap": F.when(weight > 0, words),
        "intent_match": F.when(asked.isNotNull(), F.arrays_overlap(asked, c("types")).cast("double")),
        "time_match": F.when(F.size("times") > 0, fits.cast("double")),
        "topic_match": F.when(F.size("topics") > 0, topic),
        "sentiment_match": F.when(F.col("sentiment").isNotNull(), (F.col("sentiment") == c("sentiment")).cast("double")),
    })


def chunk_views(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """chunks with the entities that lie within them (text_id, begin, end): types and surfaces as sorted sets."""
    e = entities.select("text_id", F.col("begin").alias("__b"), F.col("end").alias("__e"), "type", "surface")
    inside = chunks.join(e, "text_id", "left").filter(F.col("__b").isNull() | ((F.col("__b") >= F.col("begin")) & (F.col("__e") <= F.col("end"))))
    sets = inside.groupBy("text_id", "chunk_id").agg(F.array_sort(F.collect_set("type")).alias("types"), F.array_sort(F.collect_set("surface")).alias("entities"))
    none = F.array().cast("array<string>")
    return chunks.join(sets, ["text_id", "chunk_id"], "left").withColumns({c: F.coalesce(c, none) for c in ("types", "entities")})


def search_terms(tokens: DataFrame, synonyms: DataFrame, skip: tuple[str, ...] = ("助詞", "助動詞", "記号")) -> DataFrame:
    """text_id, token_id, term, kind of tokens (text_id, token_id, surface, lemma, pos): the token in lower case, its
    surface, its lemma, the runs of one script in it, and its synonyms; a term of a token is listed once."""
    own = tokens.filter(~F.col("pos").isin(*skip) & F.col("surface").rlike(f"[{LATIN}0-9\\u3040-\\u30FF\\u3400-\\u9FFF\\u00C0-\\u024F]"))
    key = F.lower("surface")
    parts = F.when(F.size(category_runs(F.col("surface"))) > 1, category_runs(key)).otherwise(F.array().cast("array<string>"))

    def pair(kind: str, term: Column, rank: int) -> Column:
        return F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), term.alias("term"))

    fixed = F.array(pair("token", key, 0), pair("surface", F.col("surface"), 1), pair("lemma", F.lower("lemma"), 2))
    listed = own.select("text_id", "token_id", "surface", F.explode(F.concat(fixed, F.transform(parts, lambda p: pair("part", p, 3)))).alias("t"))
    listed = listed.select("text_id", "token_id", "t.rank", "t.kind", "t.term")
    more = own.select("text_id", "token_id", key.alias("word")).join(F.broadcast(synonyms.select("word", "synonym")), "word")
    listed = listed.unionByName(more.select("text_id", "token_id", F.lit(4).alias("rank"), F.lit("synonym").alias("kind"), F.lower("synonym").alias("term")))
    first = Window.partitionBy("text_id", "token_id", "term").orderBy("rank")
    return listed.filter(F.length("term") > 0).withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n", "rank")


def combine_intents(sentences: DataFrame) -> DataFrame:
    """Intents of a document from those of its sentences (text_id, sent_id, intent, score): sums, ranked; a request in
    one sentence and a negative evaluation (intent feedback_negative) in another make a complaint."""
    sums = sentences.groupBy("text_id", "intent").agg(F.round(F.sum("score"), 6).alias("score"))
    both = sums.groupBy("text_id").agg(F.max(F.when(F.col("intent") == "request", F.col("score"))).alias("r"), F.max((F.col("intent") == "feedback_negative").cast("int")).alias("n"))
    more = both.filter("r IS NOT NULL AND n = 1").select("text_id", F.lit("complaint").alias("intent"), (F.col("r") + 0.01).alias("score"))
    order = Window.partitionBy("text_id").orderBy(F.desc("score"), "intent")
    return sums.unionByName(more).withColumn("rank", F.row_number().over(order))


def document_votes(sentences: DataFrame) -> DataFrame:
    """text_id, emotion: the primary emotion by votes of at least .1 each (text_id, sent_id, emotion, confidence)."""
    votes = sentences.filter("emotion IS NOT NULL").groupBy("text_id", "emotion").agg(F.round(F.sum(F.greatest("confidence", F.lit(0.1))), 6).alias("v"), F.min("sent_id").alias("first"))
    order = Window.partitionBy("text_id").orderBy(F.desc("v"), "first")
    return votes.withColumn("n", F.row_number().over(order)).filter("n = 1").select("text_id", "emotion", F.col("v").alias("votes"))


def keyword_union(sentences: DataFrame, k: int = 8) -> DataFrame:
    """text_id, keywords in order of first appearance and the search query of the first k (text_id, sent_id, pos, word)."""
    first = sentences.groupBy("text_id", "word").agg(F.min(F.struct("sent_id", "pos")).alias("at"))
    listed = first.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("s"))
    return listed.select("text_id", F.col("s.word").alias("keywords"), F.array_join(F.slice("s.word", 1, k), " ").alias("search_query"))


def span_scores(gold: DataFrame, found: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 of found rows against gold ones by their keys, as a whole or by groups."""
    by = by or []
    both = gold.select(*by, *keys).distinct().withColumn("g", F.lit(1)).join(found.select(*by, *keys).distinct().withColumn("f", F.lit(1)), [*by, *keys], "full_outer")
    hit = F.sum((F.col("g").isNotNull() & F.col("f").isNotNull()).cast("int"))
    out = both.groupBy(*by).agg(hit.alias("hits"), F.count("g").alias("gold"), F.count("f").alias("found"))
    p, r = F.try_divide("hits", "found"), F.try_divide("hits", "gold")
    return out.select(*by, "hits", "gold", "found", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(2 * F.col("hits") / F.nullif(F.col("gold") + F.col("found"), F.lit(0)), F.lit(0.0)), 6).alias("f1"))


def confusion(pairs: DataFrame, gold: str, found: str) -> DataFrame:
    return pairs.groupBy(gold, found).agg(F.count(F.lit(1)).alias("n"))
