"""Queries over retrieval operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kumiki.functions import text as tx
from kumiki.operators import retrieval as r
from kumiki.plans.registry import query, table

WORDS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
BM25 = f"""
    dl AS MATERIALIZED (SELECT doc_id, {WORDS.format('text')} AS ws FROM documents),
    tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM dl) GROUP BY ALL),
    ln AS MATERIALIZED (SELECT doc_id, len(ws) AS len FROM dl),
    df AS MATERIALIZED (SELECT term, count(*) AS df FROM tf GROUP BY term),
    qt AS MATERIALIZED (SELECT item_id AS query_id, term, count(*) AS qtf
           FROM (SELECT item_id, unnest({WORDS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
    qi AS MATERIALIZED (SELECT query_id, term, qtf, df, ln(1 + ((SELECT count(*) FROM dl) - df + 0.5) / (df + 0.5)) AS idf
           FROM qt JOIN df USING (term)),
    bs AS MATERIALIZED (SELECT query_id, doc_id, round(sum(idf * tf * 2.5
               / (tf + 1.5 * (0.25 + 0.75 * len / (SELECT avg(len) FROM ln))) * qtf), 6) AS score
           FROM tf JOIN qi USING (term) JOIN ln USING (doc_id) GROUP BY query_id, doc_id),
    bm AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bs)"""
TFIDF = f"""
    tf2 AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf
            FROM (SELECT doc_id, unnest({WORDS.format('text')}) AS term FROM documents) GROUP BY ALL),
    id2 AS MATERIALIZED (SELECT term, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1 AS idf FROM tf2 GROUP BY term),
    w2 AS MATERIALIZED (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM tf2 JOIN id2 USING (term)),
    no2 AS MATERIALIZED (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w2 GROUP BY doc_id),
    q2 AS MATERIALIZED (SELECT query_id, term, (1 + ln(qtf)) * coalesce(idf, ln((SELECT count(*) FROM documents) + 1) + 1) AS qw
           FROM (SELECT item_id AS query_id, term, count(*) AS qtf
                 FROM (SELECT item_id, unnest({WORDS.format('text')}) AS term FROM benchmark) GROUP BY ALL)
           LEFT JOIN id2 USING (term)),
    qn AS MATERIALIZED (SELECT query_id, sqrt(sum(qw * qw)) AS qnorm FROM q2 GROUP BY query_id),
    dp AS MATERIALIZED (SELECT query_id, doc_id, sum(w * qw) AS dot FROM w2 JOIN q2 USING (term) GROUP BY query_id, doc_id),
    ts AS MATERIALIZED (SELECT query_id, doc_id, round(dot / (norm * qnorm), 6) AS score
           FROM dp JOIN no2 USING (doc_id) JOIN qn USING (query_id)),
    tm AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ts)"""
MM = """
    m AS (SELECT query_id, doc_id,
                 CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0
                      ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s
          FROM {0} WHERE rank <= {1} WINDOW w AS (PARTITION BY query_id))"""


def words(c: str):
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def collection(spark, d) -> r.Collection:
    return r.Collection(table(spark, d, "documents"), "doc_id", words("text"))


def ranking(spark, d, k: int, kinds=("bm25",)) -> list[DataFrame]:
    """The k best documents of every item by each kind of score."""
    return r.rankings(collection(spark, d), table(spark, d, "benchmark"), "item_id", words("text"), k, kinds)


def both_rankings(spark, d, k: int) -> list[DataFrame]:
    """The best by BM25 and by TF-IDF, made in one pass."""
    return ranking(spark, d, k, ("bm25", "tfidf"))


@query("bm25_topk", f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM bm WHERE rank <= 10")
def bm25_topk(spark, d):
    return ranking(spark, d, 10)[0].select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query("tfidf_cosine_topk", f"WITH {TFIDF} SELECT query_id, doc_id, score, rank FROM tm WHERE rank <= 10")
def tfidf_topk(spark, d):
    top = ranking(spark, d, 10, ("tfidf",))[0]
    return top.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


COS = """
    cs AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id,
                  round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score
           FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id),
    cm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM cs)"""


@query("cosine_topk", f"WITH {COS} SELECT query_id, doc_id, score, rank FROM cm WHERE rank <= 5")
def cosine_topk(spark, d):
    vectors = table(spark, d, "embeddings")
    top = r.cosine_topk(vectors, vectors.filter("vec_id % 100 = 0"), "vec_id", "embedding", 5)
    return top.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(
    "rrf_fusion",
    f"""WITH {BM25}, {TFIDF},
    u AS (SELECT query_id, doc_id, rank FROM bm WHERE rank <= 50 UNION ALL SELECT query_id, doc_id, rank FROM tm WHERE rank <= 50),
    f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM u GROUP BY query_id, doc_id),
    g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f)
    SELECT query_id, doc_id, score, rank FROM g WHERE rank <= 10""",
)
def rrf_fusion(spark, d):
    return r.top_k(r.rrf(both_rankings(spark, d, 50)), 10).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(
    "hybrid_minmax_fusion",
    f"""WITH {BM25}, {TFIDF}, {MM.format('bm', 50).replace(' m AS', ' a AS')}, {MM.format('tm', 50).replace(' m AS', ' b AS')},
    f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id,
                 round(0.3 * coalesce(a.s, 0) + 0.7 * coalesce(b.s, 0), 6) AS score
          FROM a FULL OUTER JOIN b ON a.query_id = b.query_id AND a.doc_id = b.doc_id),
    g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f)
    SELECT query_id, doc_id, score, rank FROM g WHERE rank <= 10""",
)
def hybrid_fusion(spark, d):
    fused = r.hybrid(*both_rankings(spark, d, 50), 0.3)
    return r.top_k(fused, 10).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def signals(spark, d) -> DataFrame:
    """Candidate pairs with signals derived from the tables; some are null on purpose."""
    top = r.few(ranking(spark, d, 20)[0].drop("rank").withColumnRenamed("score", "bm"))
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return top.join(docs, "doc_id").select(
        "query_id",
        "doc_id",
        F.when(F.col("lang") == "en", 1.0).when(F.col("lang") == "de", 0.0).alias("entity_match"),
        F.least(F.col("bm") / 100, F.lit(1.0)).alias("keyword_overlap"),
        F.when(F.col("doc_id") % 3 == 0, 0.5).alias("intent_match"),
        F.when(F.col("doc_id") % 5 == 0, 1.0).alias("time_match"),
        F.lit(None).cast("double").alias("topic_match"),
        F.lit(0.25).alias("sentiment_match"),
        (F.col("n_chars") % 100 / 100).alias("semantic_similarity"),
        F.lit(0.5).alias("lexical_similarity"),
        F.least(F.col("bm") / 50, F.lit(1.0)).alias("retrieval_score"),
    )


SIGNALS = """
    sg AS MATERIALIZED (SELECT query_id, doc_id, CASE lang WHEN 'en' THEN 1.0 WHEN 'de' THEN 0.0 END AS em, least(score / 100, 1.0) AS ko,
                  CASE WHEN doc_id % 3 = 0 THEN 0.5 END AS im, CASE WHEN doc_id % 5 = 0 THEN 1.0 END AS tmm,
                  (n_chars % 100) / 100 AS ss, least(score / 50, 1.0) AS rs
           FROM (SELECT * FROM bm WHERE rank <= 20) JOIN documents USING (doc_id)),
    sc AS MATERIALIZED (SELECT query_id, doc_id,
        round((coalesce(em * .1, 0) + ko * .2 + coalesce(im * .1, 0) + coalesce(tmm * .1, 0) + ss * .4)
            / (CASE WHEN em IS NULL THEN 0 ELSE .1 END + .2 + CASE WHEN im IS NULL THEN 0 ELSE .1 END
               + CASE WHEN tmm IS NULL THEN 0 ELSE .1 END + .4), 4) AS lex,
        round((rs * .35 + ss * .1 + ko * .15 + coalesce(im * .05, 0)) / (.35 + .1 + .15 + CASE WHEN im IS NULL THEN 0 ELSE .05 END), 4) AS hyb
        FROM sg)"""


@query("rerank_score_lexical", f"WITH {BM25}, {SIGNALS} SELECT query_id, doc_id, CAST(lex AS DOUBLE) AS score FROM sc")
def rerank_lexical(spark, d):
    return signals(spark, d).select("query_id", "doc_id", r.rerank_score().alias("score"))


@query("rerank_score_hybrid", f"WITH {BM25}, {SIGNALS} SELECT query_id, doc_id, CAST(hyb AS DOUBLE) AS score FROM sc")
def rerank_hybrid(spark, d):
    return signals(spark, d).select("query_id", "doc_id", r.rerank_score(hybrid_set=True).alias("score"))


@query(
    "soft_filter_fallback",
    f"""WITH {BM25}, c AS (SELECT b.*, lang = 'fr' AS ok FROM bm b JOIN documents USING (doc_id) WHERE rank <= 3)
    SELECT query_id, doc_id, score FROM c QUALIFY ok OR NOT bool_or(ok) OVER (PARTITION BY query_id)""",
)
def soft_filter(spark, d):
    top = r.few(ranking(spark, d, 3)[0]).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return r.soft_filter(top, F.col("lang") == "fr").select("query_id", "doc_id", "score")


@query(
    "retrieval_metrics",
    f"""WITH {BM25}, gold AS (SELECT item_id AS query_id, (item_id * 7) % (SELECT count(*) FROM documents) AS doc_id FROM benchmark),
    f AS (SELECT gold.query_id, min(rank) AS first FROM gold LEFT JOIN (SELECT * FROM bm WHERE rank <= 200) USING (query_id, doc_id) GROUP BY 1)
    SELECT count(*) AS queries, round(avg(CASE WHEN first <= 1 THEN 1 ELSE 0 END), 6) AS recall_1,
           round(avg(CASE WHEN first <= 3 THEN 1 ELSE 0 END), 6) AS recall_3,
           round(avg(CASE WHEN first <= 5 THEN 1 ELSE 0 END), 6) AS recall_5,
           round(avg(CASE WHEN first <= 10 THEN 1.0 / first ELSE 0 END), 6) AS mrr FROM f""",
)
def metrics(spark, d):
    n = table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"))
    gold = table(spark, d, "benchmark").crossJoin(F.broadcast(n)).select(  # n is one row
        F.col("item_id").alias("query_id"), (F.col("item_id") * 7 % F.col("n")).alias("doc_id")
    )
    return r.retrieval_metrics(ranking(spark, d, 200)[0], gold)


@query(
    "jaccard_bigram_pairs",
    """WITH g AS (SELECT item_id, list_distinct(list_transform(range(1, greatest(length(text), 2)), lambda i: substring(text, i, 2))) AS b
                  FROM benchmark)
    SELECT x.item_id AS a, y.item_id AS b,
           round(len(list_intersect(x.b, y.b)) / len(list_distinct(list_concat(x.b, y.b))), 6) AS jaccard
    FROM g x JOIN g y ON x.item_id < y.item_id""",
)
def jaccard_pairs(spark, d):
    g = table(spark, d, "benchmark").select("item_id", F.array_distinct(tx.ngrams(F.col("text"))).alias("b"))
    x, y = g.select(F.col("item_id").alias("a"), F.col("b").alias("xb")), g.select(F.col("item_id").alias("b"), F.col("b").alias("yb"))
    pairs = x.join(F.broadcast(y), F.col("a") < F.col("b"))  # the benchmark is small by its nature
    return pairs.select("a", "b", F.round(tx.jaccard(F.col("xb"), F.col("yb")), 6).alias("jaccard"))


@query(
    "rerank_weight_grid",
    f"""WITH {BM25}, {SIGNALS}, gr AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS alpha),
    s AS (SELECT alpha, query_id, doc_id, round(alpha * ko + (1 - alpha) * ss, 6) AS v FROM sg, gr),
    k AS (SELECT *, row_number() OVER (PARTITION BY alpha, query_id ORDER BY v DESC, doc_id) AS rank FROM s)
    SELECT CAST(alpha AS DOUBLE) AS alpha, count(*) AS pairs, round(avg(CASE WHEN doc_id % 2 = 0 THEN 1.0 / rank ELSE 0 END), 6) AS gain
    FROM k GROUP BY alpha""",
)
def weight_grid(spark, d):
    from pyspark.sql import Window

    grid = spark.range(5).select((F.col("id") / 4).alias("alpha"))
    pairs = signals(spark, d).crossJoin(F.broadcast(grid))  # a grid of five
    v = F.round(F.col("alpha") * F.col("keyword_overlap") + (1 - F.col("alpha")) * F.col("semantic_similarity"), 6)
    order = Window.partitionBy("alpha", "query_id").orderBy(F.desc("v"), "doc_id")
    ranked = pairs.withColumn("v", v).withColumn("rank", F.row_number().over(order))
    gain = F.when(F.col("doc_id") % 2 == 0, 1.0 / F.col("rank")).otherwise(0.0)
    return ranked.groupBy("alpha").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(gain), 6).alias("gain"))
