"""Queries over query records, search terms, reranking signals and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from kumiki.operators import queryir as q
from kumiki.operators import retrieval as r
from kumiki.plans import retrieval
from kumiki.plans.registry import query, sql_values, table, values

SYN = [("the", "a", 1), ("the", "an", 2), ("the", "that", 3), ("of", "from", 4)]
WORDS = "regexp_extract_all(lower(text), '[a-z]+')"


def words():
    return F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))


@query(
    "query_records",
    f"""WITH b AS (SELECT item_id AS query_id, list_distinct({WORDS}) AS kw FROM benchmark),
    s AS (SELECT word, synonym FROM {sql_values('word, synonym, seq', SYN)} WHERE seq <> 3),
    m AS (SELECT query_id, count(DISTINCT synonym) FILTER (NOT list_contains(kw, synonym)) AS n FROM b JOIN s ON list_contains(kw, word) GROUP BY 1)
    SELECT query_id, len(kw)::BIGINT AS keywords, coalesce(n, 0)::BIGINT AS expanded FROM b LEFT JOIN m USING (query_id)""",
)
def query_records(spark, d):
    syn = values(spark, "word string, synonym string, seq int", SYN)
    none = spark.createDataFrame([], "query_id long, type string, surface string")
    out = q.query_records(table(spark, d, "benchmark"), "item_id", "text", none, syn, words())
    return out.select("query_id", F.size("keywords").cast("long").alias("keywords"), F.size("expanded").cast("long").alias("expanded"))


@query(
    "search_terms",
    f"""WITH t AS (SELECT item_id AS text_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS surface,
        generate_subscripts(regexp_extract_all(text, '[A-Za-z]+'), 1) - 1 AS token_id FROM benchmark),
    s AS (SELECT word, synonym FROM {sql_values('word, synonym, seq', SYN)}),
    a AS (SELECT text_id, token_id, lower(surface) AS term, 0 AS r, 'token' AS kind FROM t UNION ALL SELECT text_id, token_id, surface, 1, 'surface' FROM t
          UNION ALL SELECT text_id, token_id, synonym, 4, 'synonym' FROM t JOIN s ON lower(surface) = word)
    SELECT text_id, token_id, term, kind FROM a QUALIFY row_number() OVER (PARTITION BY text_id, token_id, term ORDER BY r) = 1""",
)
def search_terms(spark, d):
    t = table(spark, d, "benchmark").select(F.col("item_id").alias("text_id"), F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("token_id", "surface"))
    t = t.withColumns({"lemma": F.col("surface"), "pos": F.lit("名詞"), "token_id": F.col("token_id").cast("long")})
    return q.search_terms(t, values(spark, "word string, synonym string, seq int", SYN))


@query(
    "rerank_features",
    f"""WITH b AS (SELECT item_id, list_distinct({WORDS}) AS kw FROM benchmark),
    p AS (SELECT x.item_id AS a, y.item_id AS b, x.kw AS k, y.kw AS c, len(list_intersect(x.kw, y.kw)) AS o FROM b x, b y WHERE x.item_id % 100 = 0)
    SELECT a, b, round(o / len(k), 6) AS keyword_overlap, CASE WHEN a % 2 = 0 THEN CASE WHEN b % 3 = 0 THEN 1.0 ELSE 0.0 END END::DOUBLE AS time_match,
        CASE WHEN a % 200 = 100 THEN CASE WHEN b % 2 = 1 THEN 1.0 ELSE 0.0 END END::DOUBLE AS intent_match FROM p""",
)
def rerank_features(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.array_distinct(words()).alias("kw"))
    none = F.array().cast("array<string>")
    x = b.filter("item_id % 100 = 0").select(  # the stated queries, against all items
        F.col("item_id").alias("a"), F.col("kw").alias("keywords"), none.alias("expanded"), none.alias("topics"), none.alias("entities"),
        F.when(F.col("item_id") % 2 == 0, F.array(F.lit("FY2026"))).otherwise(none).alias("times"), F.lit(None).cast("string").alias("sentiment"),
        F.when(F.col("item_id") % 200 == 100, "DATE").alias("answer_type"),
    )
    y = b.select(
        F.col("item_id").alias("b"), F.col("kw").alias("c_keywords"), none.alias("c_topics"), none.alias("c_entities"), F.lit("x").alias("c_sentiment"),
        F.when(F.col("item_id") % 3 == 0, F.array(F.lit("2026-05-01"))).otherwise(F.array(F.lit("2025"))).alias("c_times"),
        F.when(F.col("item_id") % 2 == 1, F.array(F.lit("TIME"))).otherwise(F.array(F.lit("PERSON"))).alias("c_types"),
    )
    out = q.rerank_features(y.join(F.broadcast(x)))
    return out.select("a", "b", F.round("keyword_overlap", 6).alias("keyword_overlap"), "time_match", "intent_match")


@query(
    "rerank_features_topk",
    f"""WITH {retrieval.BM25},
    p AS (SELECT query_id, doc_id, list_distinct({retrieval.WORDS.format('b.text')}) AS k, list_distinct({retrieval.WORDS.format('d.text')}) AS c
          FROM bm JOIN benchmark b ON item_id = query_id JOIN documents d USING (doc_id) WHERE rank <= 20)
    SELECT query_id, doc_id, round(len(list_intersect(k, c)) / len(k), 6) AS keyword_overlap,
        CASE WHEN query_id % 2 = 0 THEN CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0.0 END END::DOUBLE AS time_match,
        CASE query_id % 3 WHEN 1 THEN (doc_id % 2 = 1)::INT WHEN 2 THEN (doc_id % 2 = 0)::INT END::DOUBLE AS intent_match FROM p""",
)
def rerank_features_topk(spark, d):
    """Signals of every item and its 20 best documents of the whole table."""
    none = F.array().cast("array<string>")
    kind = F.col("item_id") % 3
    x = table(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"), F.array_distinct(retrieval.words("text")).alias("keywords"), none.alias("expanded"), none.alias("topics"), none.alias("entities"),
        F.when(F.col("item_id") % 2 == 0, F.array(F.lit("FY2026"))).otherwise(none).alias("times"), F.lit(None).cast("string").alias("sentiment"),
        F.when(kind == 1, "DATE").when(kind == 2, "PERSON").alias("answer_type"),
    )
    top = retrieval.ranking(spark, d, 20)[0].select("query_id", "doc_id")
    held = table(spark, d, "documents").join(r.few(top.select("doc_id").distinct()), "doc_id", "left_semi")  # texts that are looked at
    y = held.select(
        "doc_id", F.array_distinct(retrieval.words("text")).alias("c_keywords"), none.alias("c_topics"), none.alias("c_entities"), F.lit("x").alias("c_sentiment"),
        F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("2026-05-01"))).otherwise(F.array(F.lit("2025"))).alias("c_times"),
        F.when(F.col("doc_id") % 2 == 1, F.array(F.lit("TIME"))).otherwise(F.array(F.lit("PERSON"))).alias("c_types"),
    )
    out = q.rerank_features(r.few(top).join(x, "query_id").join(y, "doc_id"))
    return out.select("query_id", "doc_id", F.round("keyword_overlap", 6).alias("keyword_overlap"), "time_match", "intent_match")


@query(
    "document_votes",
    """WITH v AS (SELECT user_id AS text_id, event_type AS emotion, round(sum(greatest(value / 1000, 0.1)), 6) AS v, min(event_id) AS f FROM events GROUP BY ALL)
    SELECT text_id, emotion, v AS votes FROM v QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY v DESC, f) = 1""",
)
def document_votes(spark, d):
    e = table(spark, d, "events")
    return q.document_votes(e.select(F.col("user_id").alias("text_id"), F.col("event_id").alias("sent_id"), F.col("event_type").alias("emotion"), (F.col("value") / 1000).alias("confidence")))


@query(
    "document_intents",
    """WITH s AS (SELECT user_id AS text_id, CASE event_type WHEN 'purchase' THEN 'request' WHEN 'click' THEN 'feedback_negative' ELSE event_type END AS intent, round(sum(value), 6) AS score FROM events GROUP BY ALL),
    c AS (SELECT text_id, max(score) FILTER (intent = 'request') + 0.01 AS score FROM s GROUP BY text_id HAVING count(*) FILTER (intent = 'feedback_negative') > 0 AND count(*) FILTER (intent = 'request') > 0),
    u AS (SELECT text_id, intent, score FROM s UNION ALL SELECT text_id, 'complaint', score FROM c)
    SELECT text_id, intent, round(score, 4) AS score, row_number() OVER (PARTITION BY text_id ORDER BY score DESC, intent) AS rank FROM u""",
)
def document_intents(spark, d):
    kind = F.when(F.col("event_type") == "purchase", "request").when(F.col("event_type") == "click", "feedback_negative").otherwise(F.col("event_type"))
    e = table(spark, d, "events").select(F.col("user_id").alias("text_id"), kind.alias("intent"), F.col("value").alias("score"))
    return q.combine_intents(e).select("text_id", "intent", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    "keyword_union",
    f"""WITH t AS (SELECT conv_id, turn, unnest({WORDS}) AS word, generate_subscripts({WORDS}, 1) AS pos FROM conversations),
    f AS (SELECT conv_id, word, min(turn * 100000 + pos) AS o FROM t GROUP BY ALL),
    l AS (SELECT conv_id AS text_id, list(word ORDER BY o) AS k FROM f GROUP BY 1)
    SELECT text_id, array_to_string(k, ' ') AS keywords, array_to_string(k[1:8], ' ') AS search_query FROM l""",
)
def keyword_union(spark, d):
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("text_id"), F.col("turn").alias("sent_id"), F.posexplode(words()).alias("pos", "word"))
    return q.keyword_union(t).select("text_id", F.array_join("keywords", " ").alias("keywords"), "search_query")


@query(
    "span_scores",
    """WITH g AS (SELECT DISTINCT lang, doc_id AS k FROM documents WHERE n_chars % 3 = 0), f AS (SELECT DISTINCT lang, doc_id AS k FROM documents WHERE n_chars % 2 = 0),
    j AS (SELECT coalesce(g.lang, f.lang) AS lang, g.k AS a, f.k AS b FROM g FULL OUTER JOIN f ON g.lang = f.lang AND g.k = f.k),
    s AS (SELECT lang, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS hits, count(a) AS gold, count(b) AS found FROM j GROUP BY lang)
    SELECT lang, hits, gold, found, round(hits / found, 6) AS precision, round(hits / gold, 6) AS recall, round(2 * hits / (gold + found), 6) AS f1 FROM s""",
)
def span_scores(spark, d):
    x = table(spark, d, "documents").select("lang", F.col("doc_id").alias("k"), "n_chars")
    return q.span_scores(x.filter("n_chars % 3 = 0"), x.filter("n_chars % 2 = 0"), ["k"], ["lang"])
