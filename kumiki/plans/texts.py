"""Queries over tokens, segmentation, dates and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kumiki.functions import text as tx
from kumiki.operators import normalize
from kumiki.operators import vocab as v
from kumiki.plans.registry import query, sql_values, table, values

CATS = {
    "KANJI": "\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{3005}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{2A6DF}",
    "KATAKANA": "\\x{30A0}-\\x{30FF}\\x{31F0}-\\x{31FF}\\x{FF65}-\\x{FF9F}",
    "HIRAGANA": "\\x{3040}-\\x{309F}",
    "LATIN": "A-Za-z\\x{FF21}-\\x{FF3A}\\x{FF41}-\\x{FF5A}",
    "DIGIT": "0-9\\x{FF10}-\\x{FF19}",
    "SPACE": " \\t\\n\\r\\x{3000}\\x{00A0}",
}
RUN = "|".join(f"[{c}]+" for c in CATS.values()) + "|[^" + "".join(CATS.values()) + "]+"
CASE = "CASE " + " ".join(f"WHEN regexp_matches(s, '^[{c}]') THEN '{n}'" for n, c in CATS.items()) + " ELSE 'SYMBOL' END"


@query(
    "category_run_tokens",
    f"""WITH r AS (SELECT unnest(regexp_extract_all(text, '{RUN}')) AS s FROM documents)
    SELECT {CASE} AS category, count(*) AS n, CAST(sum(length(s)) AS BIGINT) AS chars, count(DISTINCT s) AS kinds
    FROM r WHERE {CASE} <> 'SPACE' GROUP BY 1""",
)
def category_run_tokens(spark, d):
    runs = table(spark, d, "documents").select(F.explode(tx.category_runs(F.col("text"))).alias("s"))
    return runs.groupBy(tx.char_category(F.col("s")).alias("category")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.char_length("s")).cast("long").alias("chars"), F.countDistinct("s").alias("kinds")
    )


@query(
    "char_fallback_tokens",
    """SELECT conv_id, turn, count(*) AS tokens, count(DISTINCT c) AS kinds
    FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[^ \\t\\n\\r\\x{3000}\\x{00A0}]')) AS c FROM conversations) GROUP BY ALL""",
)
def char_tokens(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.explode(tx.chars(F.col("text"))).alias("c"))
    return c.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("tokens"), F.countDistinct("c").alias("kinds"))



@query(
    "sentence_split_native",
    """WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '([。！？!?]+[」』）)"'']*|\\n)', '\\1' || chr(1), 'g'),
                         '(^|[^0-9])\\.(\\s|$)', '\\1.' || chr(1) || '\\2', 'g') AS t FROM documents),
    s AS (SELECT doc_id, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS s FROM (SELECT doc_id, unnest(string_split(t, chr(1))) AS x FROM a))
    SELECT doc_id, count(*) AS sentences, CAST(sum(length(s)) AS BIGINT) AS chars, max(length(s)) AS longest
    FROM s WHERE s <> '' GROUP BY doc_id""",
)
def sentence_split(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.explode(tx.sentences(F.col("text"))).alias("s"))
    n = F.char_length("s")
    return s.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("sentences"), F.sum(n).cast("long").alias("chars"), F.max(n).cast("long").alias("longest")
    )


@query(
    "line_paragraphs",
    """SELECT doc_id, count(*) AS lines, count(*) FILTER (regexp_matches(l, '^#{1,6}\\s')) AS headings,
           count(*) FILTER (regexp_matches(l, '^\\s*([-*+・‣]|[0-9]+[.)])\\s*\\S')) AS bullets, max(length(l)) AS longest
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE trim(l) <> '' GROUP BY doc_id""",
)
def line_paragraphs(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l")).filter(F.trim("l") != "")
    head = F.col("l").rlike("^#{1,6}\\s")
    return lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(head.cast("long")).alias("headings"),
        F.sum(F.col("l").rlike("^\\s*([-*+・‣]|[0-9]+[.)])\\s*\\S").cast("long")).alias("bullets"),
        F.max(F.char_length("l")).cast("long").alias("longest"),
    )


@query(
    "contact_lines",
    """SELECT doc_id, no, l AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l,
        generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents)
    WHERE regexp_matches(l, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+|[0-9]{2,4}-[0-9]{2,4}-[0-9]{3,4}|https?://')""",
)
def contact_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return lines.filter(tx.contact_line(F.col("line"))).select("doc_id", (F.col("no") + 1).cast("long").alias("no"), "line")


@query(
    "clause_weights",
    """WITH s AS (SELECT conv_id, turn, unnest(string_split_regex(text, '[.!?\\n]+')) AS s FROM conversations),
    c AS (SELECT conv_id, turn, s, string_split(s, ' the ') AS c FROM s WHERE trim(s) <> '')
    SELECT conv_id, turn, count(*) AS sentences, CAST(sum(len(c)) AS BIGINT) AS clauses,
           round(sum(CASE WHEN len(c) = 1 THEN 1.0 ELSE 0.7 * (len(c) - 1) + 1.2 END), 4)::DOUBLE AS weight FROM c GROUP BY ALL""",
)
def clause_weights(spark, d):
    from kumiki.operators.segment import clauses

    s = table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.split("text", "[.!?\n]+")).alias("s")).filter(F.trim("s") != "")
    c = s.withColumn("c", clauses(F.col("s"), " the "))
    return c.groupBy("conv_id", "turn").agg(
        F.count(F.lit(1)).alias("sentences"), F.sum(F.size("c")).cast("long").alias("clauses"),
        F.round(F.sum(F.aggregate("c", F.lit(0.0), lambda a, x: a + x["weight"])), 4).alias("weight"),
    )


@query(
    "time_compatible_fy",
    """WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS v,
        year(o_orderdate) - CASE WHEN month(o_orderdate) < 4 THEN 1 ELSE 0 END AS fy FROM orders)
    SELECT o_orderkey, 'FY' || fy AS fy, fy = 1995 AS in_fy, v[:4] = '1996' AS in_year, v[:7] = '1996-02' AS in_month, v = '1996-02-03' AS on_day
    FROM o""",
)
def time_compatible(spark, d):
    v = F.date_format("o_orderdate", "yyyy-MM-dd")
    ok = lambda want: tx.time_compatible(F.lit(want), v)
    return table(spark, d, "orders").select(
        "o_orderkey", tx.fiscal_year(v).alias("fy"), ok("FY1995").alias("in_fy"), ok("1996").alias("in_year"),
        ok("1996-02").alias("in_month"), ok("1996-02-03").alias("on_day"),
    )


@query(
    "relative_dates",
    """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS r, CAST(o_orderkey % 5 AS INT) - 2 AS n FROM orders)
    SELECT o_orderkey, strftime(r + n, '%Y-%m-%d') AS day, strftime(date_trunc('week', r + n * 7), '%Y-%m-%d') AS week,
           strftime(r + to_months(n), '%Y-%m') AS month, CAST(year(r) + n AS VARCHAR) AS year,
           'FY' || CAST(year(r) - CASE WHEN month(r) < 4 THEN 1 ELSE 0 END + n AS VARCHAR) AS fiscal FROM o""",
)
def relative_dates(spark, d):
    ref, n = F.to_date("o_orderdate"), (F.col("o_orderkey") % 5 - 2).cast("int")
    units = {"day": "day", "week": "week", "month": "month", "year": "year", "fiscal": "fiscal_year"}
    return table(spark, d, "orders").select("o_orderkey", *(tx.shift_date(ref, n, u).alias(c) for c, u in units.items()))


@query(
    "query_intent_case",
    "SELECT item_id, "
    + ", ".join(
        "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{r[i]}'" for p, *r in tx.INTENT_RULES) + f" ELSE '{e}' END AS {c}"
        for i, (c, e) in enumerate((("intent", "lookup"), ("answer_type", "NULL")))
    )
    + " FROM benchmark",
)
def query_intent(spark, d):
    intent, answer = tx.query_intent(F.col("text"))
    return table(spark, d, "benchmark").select("item_id", intent.alias("intent"), answer.alias("answer_type"))


WORDS = "regexp_extract_all(text, '[A-Za-z]+')"
COUNTS = f"""
    w AS (SELECT p AS piece, count(*) AS freq FROM (SELECT unnest({WORDS}) AS p FROM documents) GROUP BY 1),
    c AS (SELECT DISTINCT c AS piece, 0 AS freq FROM (SELECT unnest(regexp_extract_all(text, '[^ \\t\\n\\r\\x{{3000}}\\x{{00A0}}]')) AS c FROM documents)),
    n AS (SELECT piece, max(freq) AS freq FROM (SELECT * FROM w UNION ALL SELECT * FROM c) GROUP BY piece),
    b AS (SELECT piece, freq, row_number() OVER (ORDER BY length(piece) = 1, freq DESC, piece) + 9 AS id
          FROM n WHERE length(piece) = 1 OR freq >= 2)"""


def word_list(c="text"):
    return F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0))


def counted(docs: DataFrame) -> DataFrame:
    return v.count_pieces(docs, "text", word_list())


@query("vocab_build", f"WITH {COUNTS} SELECT piece, id, CAST(freq AS BIGINT) AS freq FROM b")
def vocab_build(spark, d):
    return v.build_vocab(counted(table(spark, d, "documents"))).select("piece", "id", "freq")


CONV = COUNTS.replace("documents", "conversations").replace(" w AS", " w2 AS").replace(" c AS (", " c2 AS (").replace(" n AS", " n2 AS").replace(
    "FROM w UNION ALL SELECT * FROM c)", "FROM w2 UNION ALL SELECT * FROM c2)").split(",\n    b AS")[0]


@query(
    "vocab_extend",
    f"""WITH {COUNTS}, {CONV},
    f AS (SELECT piece, freq, row_number() OVER (ORDER BY freq DESC, piece) + (SELECT max(id) FROM b) AS id
          FROM n2 WHERE piece NOT IN (SELECT piece FROM b) AND (length(piece) = 1 OR freq >= 2))
    SELECT piece, id, CAST(b.freq + coalesce(n2.freq, 0) AS BIGINT) AS freq FROM b LEFT JOIN n2 USING (piece)
    UNION ALL SELECT piece, id, CAST(freq AS BIGINT) FROM f""",
)
def vocab_extend(spark, d):
    built = v.build_vocab(counted(table(spark, d, "documents"))).select("piece", "id", "freq")
    return v.extend_vocab(built, counted(table(spark, d, "conversations")))


def conversation_tokens(spark, d) -> DataFrame:
    c = table(spark, d, "conversations").withColumn("text_id", F.col("conv_id") * 1000 + F.col("turn"))
    return c.select("text_id", F.posexplode(word_list()).alias("pos", "piece"))


@query(
    "vocab_encode",
    f"""WITH {COUNTS},
    t AS (SELECT conv_id * 1000 + turn AS text_id, unnest({WORDS}) AS piece, generate_subscripts({WORDS}, 1) - 1 AS pos FROM conversations),
    h AS (SELECT t.*, id FROM t LEFT JOIN b USING (piece)),
    p AS (SELECT text_id, pos, unnest(string_split(piece, '')) AS piece, generate_subscripts(string_split(piece, ''), 1) - 1 AS sub FROM h WHERE id IS NULL)
    SELECT text_id, pos, 0 AS sub, id FROM h WHERE id IS NOT NULL
    UNION ALL SELECT text_id, pos, sub, coalesce(id, 1) FROM p LEFT JOIN b USING (piece)""",
)
def vocab_encode(spark, d):
    built = v.build_vocab(counted(table(spark, d, "documents")))
    e = v.encode(conversation_tokens(spark, d), built)
    return e.select("text_id", F.col("pos").cast("long").alias("pos"), F.col("sub").cast("long").alias("sub"), "id")


@query(
    "vocab_decode",
    f"SELECT conv_id * 1000 + turn AS text_id, array_to_string({WORDS}, '') AS text FROM conversations WHERE len({WORDS}) > 0",
)
def vocab_decode(spark, d):
    built = v.build_vocab(counted(table(spark, d, "documents").select("text").unionByName(table(spark, d, "conversations").select("text"))), min_freq=1)
    return v.decode(v.encode(conversation_tokens(spark, d), built), built)


@query(
    "vocab_report",
    f"""WITH {COUNTS}, u AS (SELECT p AS piece, count(*) AS uses FROM (SELECT unnest({WORDS}) AS p FROM conversations) GROUP BY 1),
    k AS (SELECT coalesce(b.piece, u.piece) AS piece, id, uses FROM b FULL OUTER JOIN u ON b.piece = u.piece)
    SELECT CAST(sum(coalesce(uses, 0)) AS BIGINT) AS tokens,
        round(sum(CASE WHEN id IS NOT NULL THEN coalesce(uses, 0) ELSE 0 END) / sum(coalesce(uses, 0)), 6) AS coverage,
        round(1 - sum(CASE WHEN id IS NOT NULL THEN coalesce(uses, 0) ELSE 0 END) / sum(coalesce(uses, 0)), 6) AS oov,
        count(id) AS pieces, count(*) FILTER (uses = 1) AS singletons, count(*) FILTER (id IS NOT NULL AND uses IS NULL) AS unused,
        count(*) FILTER (id IS NOT NULL AND (regexp_matches(piece, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\x{{FFFD}}\\x{{FEFF}}]')
            OR regexp_matches(piece, '{"|".join(c * 4 for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")}'))) AS doubtful FROM k""",
)
def vocab_report(spark, d):
    pieces = v.vocab_pieces(counted(table(spark, d, "documents")))
    return v.vocab_report(conversation_tokens(spark, d), pieces)


@query(
    "contamination_flags",
    """SELECT piece, regexp_matches(piece, '[^A-Za-z0-9_\\x{00C0}-\\x{024F}\\s\\x{3040}-\\x{30FF}\\x{3400}-\\x{9FFF}]{3,}') AS symbol_run,
        length(piece) >= 12 AND NOT regexp_matches(piece, '^[\\x00-\\x7F]+$') AS abnormal_length
    FROM (SELECT DISTINCT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS piece FROM documents) WHERE piece <> ''""",
)
def contamination_flags(spark, d):
    p = table(spark, d, "documents").select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("piece")).filter("piece <> ''").distinct()
    why = tx.contamination(F.col("piece"))
    return p.select("piece", F.array_contains(why, "symbol_run").alias("symbol_run"), F.array_contains(why, "abnormal_length").alias("abnormal_length"))


TERMS = [(1, "AP"), (2, "the"), (3, "on"), (4, "é"), (5, "re.")]


@query(
    "contains_term",
    f"""SELECT item_id, term_id, CASE WHEN regexp_matches(term, '^[A-Za-z0-9_]+$')
            THEN regexp_matches(text, '(^|[^A-Za-z0-9_])' || term || '([^A-Za-z0-9_]|$)') ELSE contains(text, term) END AS found
    FROM benchmark, {sql_values('term_id, term', TERMS)}""",
)
def contains_term(spark, d):
    t = values(spark, "term_id int, term string", TERMS)
    pairs = table(spark, d, "benchmark").join(F.broadcast(t))  # a list of five
    return pairs.select("item_id", "term_id", tx.contains_term(F.col("term"), F.col("text")).alias("found"))


@query(
    "sliding_rate_limit",
    """SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS recent
    FROM events""",
)
def rate_limit(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(-60_000_000, 0)
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select("user_id", "event_id", F.count(F.lit(1)).over(w).alias("recent"))


@query(
    "anaphora_asof",
    """SELECT event_id, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER
            (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT NULL AS has_antecedent,
        last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER
            (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS antecedent FROM events""",
)
def anaphora(spark, d):
    from kumiki.operators.document import nearest_before

    e = table(spark, d, "events")
    found = nearest_before(e, "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("event_id")), "antecedent")
    return found.select("event_id", F.col("antecedent").isNotNull().alias("has_antecedent"), "antecedent")


SURFACES = ["of the", "the", "in the", "that", "de la", "de", "der", "und der", "ción", "for"]


def claims_sql() -> str:
    """Claims of the longest surface first: what has been claimed is blanked out before the next one is looked for."""
    steps, found = ["d0 AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"], []
    for i, surface in enumerate(sorted(set(SURFACES), key=lambda x: (-len(x), x))):
        n = len(surface)
        steps.append(f"d{i + 1} AS (SELECT doc_id, replace(t, '{surface}', repeat(chr(1), {n})) AS t FROM d{i})")
        steps.append(
            f"p{i} AS (SELECT doc_id, unnest(string_split(t, '{surface}')) AS part, generate_subscripts(string_split(t, '{surface}'), 1) AS i,"
            f" len(string_split(t, '{surface}')) AS n FROM d{i} WHERE contains(t, '{surface}'))"
        )
        end = f"sum(length(part) + {n}) OVER (PARTITION BY doc_id ORDER BY i)"
        found.append(f"SELECT doc_id, '{surface}' AS surface, CAST({end} - {n} AS INT) AS begin, CAST({end} AS INT) AS \"end\" FROM p{i} QUALIFY i < n")
    return f"WITH {', '.join(steps)} {' UNION ALL '.join(found)}"


@query("longest_match_lexicon", claims_sql())
def longest_match_lexicon(spark, d):
    """Claimed occurrences of a lexicon in whole documents."""
    hits = F.explode(normalize.lexicon_hits(SURFACES)(F.col("text")))
    return table(spark, d, "documents").select("doc_id", hits.alias("hit")).select("doc_id", "hit.surface", "hit.begin", "hit.end")
