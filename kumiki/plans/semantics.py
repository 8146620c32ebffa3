"""Queries over lexicons, affect, intents, topics, keywords and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kumiki.operators import document as doc
from kumiki.operators import lexicons as lx
from kumiki.operators import semantic as sm
from kumiki.plans.registry import query, sql_values, table, values

# Small lexicons over the words of the test tables.
SLANG = [("ed", "joy", 0.7, 1), ("on", "anger", 0.9, 2), ("ed", "moved", 0.4, 3)]
EMOTION = [("in", "joy", "positive", 0.8, 1), ("the", "sadness", "negative", 0.5, 2), ("ed", "trust", "positive", 0.6, 3), ("of", "anger", "negative", 0.9, 4)]
ENTITY = [("and", "PLACE", 1), ("a", "PERSON", 2), ("in", "TOPIC", 3)]
SLANG_C, EMOTION_C, ENTITY_C = "surface, emotion, intensity, seq", "surface, base_emotion, polarity, intensity, seq", "surface, type, seq"
SLANG_T, EMOTION_T, ENTITY_T = "surface string, emotion string, intensity double, seq int", "surface string, base_emotion string, polarity string, intensity double, seq int", "surface string, type string, seq int"
WORDS = "regexp_extract_all(lower(text), '[a-z]+')"
TOKENS = f"t AS (SELECT conv_id * 1000 + turn AS text_id, unnest({WORDS}) AS piece, generate_subscripts({WORDS}, 1) - 1 AS pos FROM conversations)"


def tokens(spark, d) -> DataFrame:
    c = table(spark, d, "conversations").withColumn("text_id", F.col("conv_id") * 1000 + F.col("turn"))
    return c.select("text_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("pos", "piece"))


def lexicons(spark):
    return values(spark, SLANG_T, SLANG), values(spark, EMOTION_T, EMOTION), values(spark, ENTITY_T, ENTITY)


@query(
    "semantic_tokens",
    f"""WITH {TOKENS},
    s AS (SELECT surface, arg_max(emotion, seq) AS v FROM {sql_values(SLANG_C, SLANG)} GROUP BY 1),
    e AS (SELECT surface, arg_max(base_emotion, seq) AS v FROM {sql_values(EMOTION_C, EMOTION)} GROUP BY 1),
    n AS (SELECT surface, arg_max(type, seq) AS v FROM {sql_values(ENTITY_C, ENTITY)} GROUP BY 1)
    SELECT CASE WHEN s.v IS NOT NULL THEN 'slang' WHEN e.v IS NOT NULL THEN 'emotion' WHEN n.v IS NOT NULL THEN 'entity' END AS semantic_type,
        coalesce(s.v, e.v, n.v) AS label, CASE WHEN s.v IS NOT NULL OR e.v IS NOT NULL THEN 0.85 WHEN n.v IS NOT NULL THEN 0.9 ELSE 0.0 END::DOUBLE AS confidence,
        count(*) AS tokens FROM t LEFT JOIN s ON piece = s.surface LEFT JOIN e ON piece = e.surface LEFT JOIN n ON piece = n.surface GROUP BY ALL""",
)
def semantic_tokens(spark, d):
    out = sm.semantic_tokens(tokens(spark, d), *lexicons(spark))
    return out.groupBy("semantic_type", "label", "confidence").agg(F.count(F.lit(1)).alias("tokens"))


@query(
    "user_dict_precedence",
    f"""WITH u AS {sql_values(EMOTION_C, EMOTION[:2])}, b AS {sql_values(EMOTION_C, [("in", "fear", "negative", 0.1, 9), ("to", "joy", "positive", 0.2, 10)])}
    SELECT * FROM u UNION ALL SELECT * FROM b WHERE surface NOT IN (SELECT surface FROM u)""",
)
def user_dict(spark, d):
    base = values(spark, EMOTION_T, [("in", "fear", "negative", 0.1, 9), ("to", "joy", "positive", 0.2, 10)])
    return lx.with_precedence(values(spark, EMOTION_T, EMOTION[:2]), base).withColumn("seq", F.col("seq").cast("int"))


SYN = [("car", "auto|vehicle", 1), ("bike", "cycle|auto", 2), ("cycle", "wheel", 3)]


@query(
    "canonical_synonyms",
    f"""WITH g AS {sql_values("canonical, synonyms, seq", SYN)},
    p AS (SELECT canonical AS word, canonical, seq, 1 AS own FROM g UNION ALL SELECT unnest(string_split(synonyms, '|')), canonical, seq, 0 FROM g)
    SELECT word, canonical FROM p QUALIFY row_number() OVER (PARTITION BY word ORDER BY own DESC, seq) = 1""",
)
def canonical(spark, d):
    g = values(spark, "canonical string, synonyms string, seq int", SYN).withColumn("synonyms", lx.split_list(F.col("synonyms")))
    return lx.canonical_map(g)


@query(
    "affect_candidates",
    f"""WITH e AS {sql_values(EMOTION_C, EMOTION)}, s AS {sql_values(SLANG_C, SLANG)},
    b AS (SELECT surface, base_emotion, 'emotion' AS source, 1.0 AS weight FROM e UNION ALL SELECT surface, emotion, 'slang', 0.9 FROM s),
    r AS (SELECT * FROM (VALUES ('good', 'positive', 0.5), ('the', 'negative', 0.5)) AS v(surface, polarity, intensity))
    SELECT surface, base_emotion, source, CAST(weight AS DOUBLE) AS weight FROM b
    UNION ALL SELECT surface, 'evaluation', 'sentiment', 1.0 FROM r WHERE surface NOT IN (SELECT surface FROM b)""",
)
def affect_candidates(spark, d):
    slang, emotion, _ = lexicons(spark)
    slang = slang.withColumn("base_emotion", F.col("emotion")).withColumn("polarity", F.lit("positive"))
    none = emotion.limit(0)
    rated = values(spark, "surface string, polarity string, intensity double, seq int", [("good", "positive", 0.5, 1), ("the", "negative", 0.5, 2)])
    return lx.affect_candidates(emotion, slang, none, rated, none).select("surface", "base_emotion", "source", "weight")


def hits(spark, d) -> DataFrame:
    e = lx.last_wins(values(spark, EMOTION_T, EMOTION)).withColumnRenamed("surface", "piece").drop("seq")
    h = tokens(spark, d).join(F.broadcast(e), "piece")
    weight = F.when(F.col("pos") % 7 < 5, 0.7).otherwise(1.2)
    return h.withColumn("confidence", sm.confidence(F.lit(1.0), (F.col("pos") % 3) / 2, F.col("intensity"))).withColumn("clause_weight", weight).withColumn("plutchik", F.col("base_emotion"))


HITS = f"""{TOKENS}, e AS (SELECT surface, arg_max(base_emotion, seq) AS plutchik, arg_max(polarity, seq) AS polarity, arg_max(intensity, seq)::DOUBLE AS intensity
        FROM {sql_values(EMOTION_C, EMOTION)} GROUP BY 1),
    h AS (SELECT text_id, pos, plutchik, polarity, intensity, 0.5 + 0.3 * (pos % 3) / 2 + 0.2 * intensity AS confidence,
                 CASE WHEN pos % 7 < 5 THEN 0.7 ELSE 1.2 END::DOUBLE AS cw FROM t JOIN e ON piece = surface)"""


@query(
    "affect_confidence",
    f"""WITH {HITS} SELECT text_id, count(*) AS n, round(sum(intensity * confidence) / greatest(1.0, sum(confidence)), 4)::DOUBLE AS intensity,
        round(avg(confidence), 4)::DOUBLE AS confidence FROM h GROUP BY text_id""",
)
def affect_confidence(spark, d):
    return sm.affect_summary(hits(spark, d))


@query(
    "polarity_vote",
    f"""WITH {HITS}, w AS (SELECT *, round(intensity * confidence * cw, 9) AS w FROM h),
    p AS (SELECT text_id, polarity AS prim FROM w QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY w DESC, pos) = 1),
    v AS (SELECT text_id, polarity, round(sum(w), 6) AS v, min(pos) AS f FROM w GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY v DESC, f) AS n FROM v),
    b AS (SELECT text_id, max(polarity) FILTER (n = 1) AS top, max(v) FILTER (n = 1) AS v1, max(v) FILTER (n = 2) AS v2 FROM r GROUP BY 1)
    SELECT text_id, CASE WHEN v2 IS NOT NULL AND (v1 = 0 OR (v1 - v2) / v1 < 0.2) THEN prim ELSE top END AS polarity FROM b JOIN p USING (text_id)""",
)
def polarity_vote(spark, d):
    return sm.polarity_votes(hits(spark, d))


@query(
    "plutchik_norm",
    f"""WITH {HITS}, s AS (SELECT text_id, plutchik, round(sum(intensity * confidence * cw), 9) AS v FROM h GROUP BY ALL)
    SELECT text_id, plutchik, round(v / max(v) OVER (PARTITION BY text_id), 4)::DOUBLE AS share FROM s""",
)
def plutchik(spark, d):
    return sm.emotion_distribution(hits(spark, d))


RULES = [("request", "the|on a", 0.5, 100), ("question", "what|tion", 0.25, 80), ("thanks", "ing", 0.125, 50)]


@query(
    "intent_rule_scores",
    f"""WITH r AS (SELECT intent, score * greatest(priority, 1) / 100 AS w, unnest(string_split(pattern, '|')) AS term FROM {sql_values("intent, pattern, score, priority", RULES)}),
    x AS (SELECT conv_id * 1000 + turn AS text_id, text FROM conversations),
    s AS (SELECT text_id, intent, sum(w * (length(text) - length(replace(text, term, ''))) / length(term)) AS v FROM x JOIN r ON contains(text, term) GROUP BY ALL
          UNION ALL SELECT text_id, 'question', 0.35 FROM x WHERE regexp_matches(rtrim(text), '[?？]$'))
    SELECT text_id, intent, round(least(sum(v), 1.0), 4)::DOUBLE AS score,
        row_number() OVER (PARTITION BY text_id ORDER BY round(least(sum(v), 1.0), 4) DESC, intent) AS rank FROM s GROUP BY text_id, intent""",
)
def intent_scores(spark, d):
    x = table(spark, d, "conversations").withColumn("text_id", F.col("conv_id") * 1000 + F.col("turn"))
    rules = values(spark, "intent string, pattern string, score double, priority int", RULES)
    return sm.intent_scores(x, rules, "text_id", "text").select("text_id", "intent", "score", F.col("rank").cast("long").alias("rank"))


TOPICS = f"""{TOKENS}, st AS (SELECT * FROM (VALUES ('the'), ('of'), ('and')) AS v(piece)), en AS {sql_values(ENTITY_C, ENTITY)},
    ent AS (SELECT text_id, piece AS label, count(*) AS count, min(type) AS type FROM t JOIN en ON piece = surface GROUP BY ALL),
    e2 AS (SELECT text_id, label, least(CASE type WHEN 'TOPIC' THEN 1.0 WHEN 'PERSON' THEN 0.8 ELSE 0.6 END::DOUBLE + 0.1::DOUBLE * (count - 1), 1.0) AS score, count FROM ent),
    nn AS (SELECT text_id, piece AS label, count(*) AS count, count(*) * (1 + 0.1::DOUBLE * least(length(piece), 6)) AS raw FROM t
           WHERE piece NOT IN (SELECT piece FROM st) AND piece NOT IN (SELECT surface FROM en) GROUP BY text_id, piece),
    tp AS (SELECT text_id, label, round(score, 6) AS score, count FROM e2 UNION ALL
           SELECT text_id, label, round(0.7::DOUBLE * raw / max(raw) OVER (PARTITION BY text_id), 6)::DOUBLE, count FROM nn),
    tr AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY score DESC, count DESC, label) AS rank FROM tp)"""


def topic_rows(spark, d) -> DataFrame:
    t = tokens(spark, d)
    e = t.join(F.broadcast(values(spark, ENTITY_T, ENTITY).withColumnRenamed("surface", "piece")), "piece")
    return sm.topics(t, e, values(spark, "surface string", [("the",), ("of",), ("and",)]))


@query("topics_topn", f"WITH {TOPICS} SELECT text_id, label, score, count, rank FROM tr WHERE rank <= 5")
def topics_topn(spark, d):
    return topic_rows(spark, d).select("text_id", "label", "score", "count", F.col("rank").cast("long").alias("rank"))


@query(
    "merge_topics",
    f"""WITH {TOPICS}, m AS (SELECT text_id // 1000 AS conv_id, label, round(sum(score), 6) AS raw, sum(count) AS count FROM tr WHERE rank <= 5 GROUP BY ALL),
    k AS (SELECT conv_id, label, CAST(count AS BIGINT) AS count, round(raw / max(raw) OVER (PARTITION BY conv_id), 4)::DOUBLE AS score,
        row_number() OVER (PARTITION BY conv_id ORDER BY raw DESC, count DESC, label) AS rank FROM m)
    SELECT * FROM k WHERE rank <= 10""",
)
def merge_topics(spark, d):
    parts = topic_rows(spark, d).withColumn("conv_id", F.floor(F.col("text_id") / 1000))
    out = sm.merge_topics(parts, "conv_id")
    return out.select("conv_id", "label", "count", "score", F.col("rank").cast("long").alias("rank"))


@query(
    "keyword_tiers",
    f"""WITH {TOKENS}, c AS (SELECT text_id, piece AS word, CASE WHEN length(piece) > 8 THEN 1 WHEN length(piece) > 5 THEN 3 ELSE 5 END AS tier FROM t),
    b AS (SELECT text_id, word, min(tier) AS tier FROM c GROUP BY ALL)
    SELECT text_id, word, tier, row_number() OVER (PARTITION BY text_id ORDER BY tier, length(word) DESC, word) AS rank FROM b""",
)
def keyword_tiers(spark, d):
    n = F.char_length("piece")
    c = tokens(spark, d).select("text_id", F.col("piece").alias("word"), F.when(n > 8, 1).when(n > 5, 3).otherwise(5).alias("tier"))
    return sm.keyword_tiers(c).withColumn("rank", F.col("rank").cast("long"))


@query(
    "mention_components",
    """WITH RECURSIVE n AS (SELECT n_regionkey AS g, n_nationkey AS k, n_name FROM nation),
    e AS (SELECT x.g, x.k AS a, y.k AS b FROM n x JOIN n y ON x.g = y.g AND x.k <> y.k AND substr(x.n_name, length(x.n_name), 1) = substr(y.n_name, length(y.n_name), 1)),
    r AS (SELECT g, k AS node, k AS label FROM n UNION SELECT e.g, e.a, r.label FROM r JOIN e ON r.g = e.g AND r.node = e.b)
    SELECT g, node, min(label) AS label FROM r GROUP BY ALL""",
)
def mention_components(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("g"), F.col("n_nationkey").alias("node"), F.substring("n_name", -1, 1).alias("c"))
    x, y = n.select("g", "c", F.col("node").alias("a")), n.select("g", "c", F.col("node").alias("b"))
    return doc.mention_components(x.join(y, ["g", "c"]).filter("a <> b").select("g", "a", "b"), n.select("g", "node"), "g")


@query("chunk_pack_sizes")
def chunk_pack(spark, d):
    from kumiki.operators.segment import sentences

    return doc.chunks(sentences(table(spark, d, "documents"), "doc_id", "text"))


@query(
    "grouping_sets_eval",
    """SELECT lang, source, count(*) AS n, round(avg(quality), 6) AS quality, sum(toxic)::BIGINT AS toxic, grouping(lang, source)::BIGINT AS level
    FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((), (lang), (source))""",
)
def grouping_sets(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    j.createOrReplaceTempView("labelled_documents")
    return spark.sql(
        "SELECT lang, source, count(*) AS n, round(avg(quality), 6) AS quality, sum(toxic) AS toxic, grouping_id(lang, source) AS level "
        "FROM labelled_documents GROUP BY GROUPING SETS ((), (lang), (source))"
    )


STOP = [("the",), ("of",), ("and",)]


def plan_lexicons(spark):
    from kumiki.operators.plan import Lexicons

    _, emotion, entity = lexicons(spark)
    rules = values(spark, "intent string, pattern string, score double, priority int", RULES)
    return Lexicons(emotion, entity, rules, values(spark, "surface string", STOP))


#: Tokens of Latin text: words, digits and single symbols.
PIECES = "regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_\\-]*|[0-9]+|[^\\sA-Za-z0-9]')"
EMO = f"SELECT surface, arg_max(base_emotion, seq) AS base, arg_max(polarity, seq) AS tone, arg_max(intensity, seq)::DOUBLE AS intensity FROM {sql_values(EMOTION_C, EMOTION)} GROUP BY 1"


@query(
    "full_analyze",
    f"""WITH d AS (SELECT conv_id * 1000 + turn AS text_id, text, {PIECES} AS t FROM conversations),
    w AS (SELECT text_id, unnest(t) AS piece FROM d),
    h AS (SELECT text_id, base, tone, intensity, 0.5 + 0.2 * intensity AS conf FROM w JOIN ({EMO}) e ON lower(piece) = e.surface),
    a AS (SELECT text_id, count(*) AS hits, round(sum(intensity * conf) / greatest(1.0, sum(conf)), 4)::DOUBLE AS intensity FROM h GROUP BY 1),
    s AS (SELECT text_id, base, round(sum(intensity * conf), 9) AS v FROM h GROUP BY ALL),
    g AS (SELECT text_id, string_agg(base, ',' ORDER BY base) AS felt FROM s GROUP BY 1)
    SELECT d.text_id, CAST(len(t) AS BIGINT) AS tokens, md5(array_to_string(t, ' ')) AS pieces, coalesce(hits, 0) AS hits, intensity, felt
    FROM d LEFT JOIN a USING (text_id) LEFT JOIN g USING (text_id)""",
)
def full_analyze(spark, d):
    from kumiki.operators.plan import sentence_plan

    texts = table(spark, d, "conversations").withColumn("text_id", F.col("conv_id") * 1000 + F.col("turn"))
    found = sentence_plan(texts, "text_id", "text", plan_lexicons(spark))
    a = F.col("analysis")
    return found.select(
        "text_id", F.size(a["tokens"]).cast("long").alias("tokens"), F.md5(F.array_join(a["tokens"]["surface"], " ").cast("binary")).alias("pieces"),
        F.coalesce("affect.n", F.lit(0)).cast("long").alias("hits"), F.col("affect.intensity").alias("intensity"),
        F.array_join(F.array_sort(F.map_keys("emotion")), ",").alias("felt"),
    )
