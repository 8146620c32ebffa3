"""Queries over evaluation measures, spans, mails, mentions and the lexicon views."""

from __future__ import annotations

from pyspark.sql import functions as F

from kumiki.functions import text as tx
from kumiki.operators import document as doc
from kumiki.operators import lexicons as lx
from kumiki.operators import measure as ms
from kumiki.operators import normalize as nm
from kumiki.operators import queryir as q
from kumiki.operators import segment as sg
from kumiki.operators import semantic as sm
from kumiki.plans import retrieval
from kumiki.plans.registry import query, sql_values, table, values


@query("mode_by_group", "SELECT * FROM (SELECT lang, source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) = 1")
def mode_by_group(spark, d):
    return ms.mode(table(spark, d, "documents"), "lang", "source")


@query("length_histogram", "SELECT CAST(n_chars // 250 * 250 AS DOUBLE) AS low, count(*) AS n FROM documents GROUP BY 1")
def length_histogram(spark, d):
    return ms.histogram(table(spark, d, "documents"), "n_chars", 250.0)


@query(
    "latency_percentiles",
    """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median,
        round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value)::DOUBLE AS max FROM events GROUP BY 1""",
)
def latency_percentiles(spark, d):
    return ms.latencies(table(spark, d, "events"), "event_type", "value")


@query(
    "span_overlaps",
    """WITH s AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS b, CAST(epoch_us(ts) // 1000000 + 1 + floor(value * 10) AS BIGINT) AS e, event_type FROM events)
    SELECT x.user_id, x.event_id AS a, y.event_id AS b FROM s x JOIN s y ON x.user_id = y.user_id AND x.b < y.e AND y.b < x.e
    WHERE x.event_type = 'error' AND y.event_type = 'click'""",
)
def span_overlaps(spark, d):
    e = table(spark, d, "events")
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    s = e.select("user_id", "event_id", at.alias("begin"), (at + 1 + F.floor(F.col("value") * 10)).alias("end"), "event_type")
    pairs = ms.overlaps(s.filter("event_type = 'error'"), s.filter("event_type = 'click'"), "user_id")
    return pairs.select("user_id", F.col("a_event_id").alias("a"), F.col("b_event_id").alias("b"))


GOLDEN = [(0, "en|de"), (1, "fr"), (2, "en"), (3, ""), (10**9, "en")]


@query(
    "golden_rows",
    f"""SELECT g.doc_id, expected, lang, CASE WHEN expected = '' THEN lang IS NULL ELSE coalesce(list_contains(string_split(expected, '|'), lang), false) END AS passed
    FROM {sql_values("doc_id, expected", GOLDEN)} g LEFT JOIN documents d ON d.doc_id = g.doc_id""",
)
def golden(spark, d):
    return ms.golden_rows(table(spark, d, "documents"), values(spark, "doc_id long, expected string", GOLDEN), "doc_id", "expected", "lang")


@query(
    "gold_chunks",
    """WITH c AS (SELECT conv_id, turn, lower(regexp_replace(text, '\\s+', '', 'g')) AS t FROM conversations),
    a AS (SELECT conv_id AS query_id, conv_id, lower(regexp_replace(substr(text, 11, 40), '\\s+', '', 'g')) AS a FROM conversations WHERE turn = 1
          UNION ALL SELECT conv_id + 1000000, conv_id, lower(regexp_replace(substr(text, 11, 20) || 'zzzz', '\\s+', '', 'g')) FROM conversations WHERE turn = 0),
    p AS (SELECT query_id, turn, contains(t, a) AS whole, CASE WHEN contains(t, a) THEN length(a) WHEN length(a) < 4 THEN 0
              ELSE coalesce(list_max(list_filter(range(4, length(a) + 1), lambda k: contains(t, a[1:k]) OR contains(t, a[length(a) - k + 1:]))), 0) END AS part
          FROM c JOIN a USING (conv_id)),
    r AS (SELECT *, bool_or(whole) OVER (PARTITION BY query_id) AS any_, row_number() OVER (PARTITION BY query_id ORDER BY part DESC, turn) AS nth FROM p)
    SELECT query_id, turn AS chunk_id FROM r WHERE whole OR (NOT any_ AND nth = 1 AND part > 0)""",
)
def gold_chunk_rows(spark, d):
    c = table(spark, d, "conversations")
    chunks = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_id"), "text")
    one = c.filter("turn = 1").select(F.col("conv_id").alias("query_id"), F.col("conv_id").alias("doc_id"), F.substring("text", 11, 40).alias("answer"))
    two = c.filter("turn = 0").select((F.col("conv_id") + 1000000).alias("query_id"), F.col("conv_id").alias("doc_id"), F.concat(F.substring("text", 11, 20), F.lit("zzzz")).alias("answer"))
    return ms.gold_chunks(chunks, one.unionByName(two))


ALPHAS = [0.0, 0.3, 0.7, 1.0]
GOLD = "gold AS (SELECT item_id AS query_id, (item_id * 7) % (SELECT count(*) FROM documents) AS doc_id FROM benchmark)"
FUSED = f"""{retrieval.BM25}, {retrieval.TFIDF}, {retrieval.MM.format('bm', 50).replace(' m AS', ' a AS')}, {retrieval.MM.format('tm', 50).replace(' m AS', ' b AS')}, {GOLD},
    f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.s, 0) AS x, coalesce(b.s, 0) AS y
          FROM a FULL OUTER JOIN b ON a.query_id = b.query_id AND a.doc_id = b.doc_id),
    w AS (SELECT alpha, query_id, doc_id, round(alpha * x + (1 - alpha) * y, 6) AS score FROM f, (SELECT unnest({ALPHAS!r}::DOUBLE[]) AS alpha)),
    k AS (SELECT *, row_number() OVER (PARTITION BY alpha, query_id ORDER BY score DESC, doc_id) AS rank FROM w),
    h AS (SELECT alpha, query_id, rank FROM k JOIN gold USING (query_id, doc_id) WHERE rank <= 10)"""


def gold_of(spark, d):
    n = table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "benchmark").crossJoin(F.broadcast(n)).select(  # n is one row
        F.col("item_id").alias("query_id"), (F.col("item_id") * 7 % F.col("n")).alias("doc_id")
    )


@query(
    "alpha_grid",
    f"""WITH {FUSED}, g AS (SELECT alpha, gold.query_id, rank AS first FROM gold CROSS JOIN (SELECT unnest({ALPHAS!r}::DOUBLE[]) AS alpha) LEFT JOIN h USING (alpha, query_id))
    SELECT alpha, count(*) AS queries, round(avg(CASE WHEN first <= 1 THEN 1 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN first <= 3 THEN 1 ELSE 0 END), 6) AS recall_3,
        round(avg(CASE WHEN first <= 5 THEN 1 ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN first <= 10 THEN 1.0 / first ELSE 0 END), 6) AS mrr FROM g GROUP BY alpha""",
)
def alpha_grid(spark, d):
    return ms.alpha_grid(*retrieval.both_rankings(spark, d, 50), gold_of(spark, d), ALPHAS)


@query("alpha_by_query", f"WITH {FUSED} SELECT query_id, alpha, rank FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, alpha) = 1")
def alpha_by_query(spark, d):
    best = ms.best_alpha(*retrieval.both_rankings(spark, d, 50), gold_of(spark, d), ALPHAS)
    return best.withColumn("rank", F.col("rank").cast("long"))


@query(
    "lexical_anchors",
    """SELECT item_id, CASE WHEN regexp_matches(t, '[A-Za-z][A-Za-z0-9_.\\-/]{2,}') THEN 'identifier' WHEN item_id % 5 = 0 THEN 'product' ELSE 'none' END AS anchor,
        CASE item_id % 2 WHEN 0 THEN 0.5 ELSE 0.3 END::DOUBLE AS alpha
    FROM (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN text ELSE '質問' END AS t FROM benchmark)""",
)
def lexical_anchors(spark, d):
    b = table(spark, d, "benchmark")
    text = F.when(F.col("item_id") % 3 == 0, F.col("text")).otherwise("質問")
    kinds = F.when(F.col("item_id") % 5 == 0, F.array(F.lit("PRODUCT"))).otherwise(F.array(F.lit("DATE")))
    weight = ms.fusion_weight(F.when(F.col("item_id") % 2 == 0, 0.5))
    return b.select("item_id", ms.lexical_anchor(text, kinds).alias("anchor"), weight.alias("alpha"))


@query(
    "answer_form",
    """SELECT doc_id, least(1.0, len(list_distinct(regexp_extract_all(t, '違い|違う|一方|に対して|比較|vs|対比|より|差|メリット|デメリット|長所|短所|利点|欠点|同じ|異なる'))) / 2)::DOUBLE AS compare,
        NULL::DOUBLE AS lookup FROM (SELECT doc_id, replace(replace(text, ' the ', '違い'), ' of ', 'より') AS t FROM documents)""",
)
def answer_forms(spark, d):
    t = F.replace(F.replace("text", F.lit(" the "), F.lit("違い")), F.lit(" of "), F.lit("より"))
    return table(spark, d, "documents").select(
        "doc_id", ms.answer_form(F.lit("compare"), t).alias("compare"), ms.answer_form(F.lit("lookup"), t).alias("lookup")
    )


@query(
    "mention_links",
    """WITH m AS (SELECT p_size AS text_id, p_partkey AS mention_id, regexp_replace(p_name, '^(株式会社|有限会社|合同会社)|(株式会社|有限会社|合同会社|[ ,]*(Inc|Ltd|GmbH|Corp)\\.?)$', '', 'g') AS core
                  FROM (SELECT p_size, p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || ' Inc.' WHEN 1 THEN split_part(p_name, ' ', 1) ELSE p_name END AS p_name FROM part)),
    n AS (SELECT text_id, core, min(mention_id) AS first FROM m GROUP BY ALL)
    SELECT text_id, mention_id AS a, first AS b FROM m JOIN n USING (text_id, core) WHERE mention_id <> first
    UNION SELECT x.text_id, x.first, y.first FROM n x JOIN n y ON x.text_id = y.text_id AND x.core <> y.core AND starts_with(x.core, y.core) AND length(y.core) >= 2 AND substr(x.core, 1, 2) = substr(y.core, 1, 2)""",
)
def mention_link_rows(spark, d):
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" Inc."))).when(F.col("p_partkey") % 3 == 1, F.split("p_name", " ")[0]).otherwise(F.col("p_name"))
    return doc.mention_links(table(spark, d, "part").select(F.col("p_size").alias("text_id"), F.col("p_partkey").alias("mention_id"), F.lit("ORGANIZATION").alias("type"), name.alias("surface")))


@query(
    "chunk_views",
    """SELECT conv_id AS text_id, turn AS chunk_id, coalesce(array_to_string(list_sort(list_distinct(list(l) FILTER (l IS NOT NULL))), ','), '') AS types,
        coalesce(array_to_string(list_sort(list_distinct(list(s) FILTER (s IS NOT NULL))), ','), '') AS entities
    FROM (SELECT c.conv_id, c.turn, e.l, e.s FROM conversations c LEFT JOIN
          (SELECT conv_id, turn * 10 + 2 AS b, turn * 10 + 4 + turn % 2 * 20 AS e, role AS l, substr(text, 1, 3) AS s FROM conversations) e
          ON c.conv_id = e.conv_id AND e.b >= c.turn * 10 AND e.e <= c.turn * 10 + 10) GROUP BY ALL""",
)
def chunk_view_rows(spark, d):
    c = table(spark, d, "conversations")
    at = F.col("turn") * 10
    chunks = c.select(F.col("conv_id").alias("text_id"), F.col("turn").alias("chunk_id"), at.alias("begin"), (at + 10).alias("end"))
    found = c.select(F.col("conv_id").alias("text_id"), (at + 2).alias("begin"), (at + 4 + F.col("turn") % 2 * 20).alias("end"), F.col("role").alias("type"), F.substring("text", 1, 3).alias("surface"))
    v = q.chunk_views(chunks, found)
    return v.select("text_id", "chunk_id", F.array_join("types", ",").alias("types"), F.array_join("entities", ",").alias("entities"))


@query(
    "phrase_runs",
    """WITH t AS (SELECT conv_id * 1000 + turn AS text_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS piece, generate_subscripts(regexp_extract_all(text, '[A-Za-z]+'), 1) - 1 AS pos FROM conversations),
    m AS (SELECT *, regexp_matches(piece, '^[A-Z]') AS noun, sum(CASE WHEN regexp_matches(piece, '^[A-Z]') THEN 0 ELSE 1 END) OVER (PARTITION BY text_id ORDER BY pos) AS island FROM t),
    r AS (SELECT text_id, island, min(pos) AS b, max(pos) AS e, count(*) AS n, string_agg(piece, '' ORDER BY pos) AS text FROM m WHERE noun GROUP BY ALL)
    SELECT text_id, b::BIGINT AS begin, e::BIGINT AS end, text, CASE WHEN n >= 2 THEN 'compound_noun' ELSE 'topic' END AS type, CASE WHEN n >= 2 THEN 0.7 ELSE 0.6 END::DOUBLE AS score
    FROM r WHERE n >= 2 OR length(text) >= 3""",
)
def phrase_run_rows(spark, d):
    c = table(spark, d, "conversations").withColumn("text_id", F.col("conv_id") * 1000 + F.col("turn"))
    t = c.select("text_id", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("pos", "piece"))
    return sm.phrase_runs(t, F.col("piece").rlike("^[A-Z]")).withColumns({x: F.col(x).cast("long") for x in ("begin", "end")})


MAIL = """WITH x AS (SELECT conv_id * 1000 + turn AS text_id, CASE turn % 4
        WHEN 0 THEN 'Dear Bob,' || chr(10) || text || chr(10) || 'Best regards' || chr(10) || 'Ann' || chr(10) || 'ann@example.com'
        WHEN 1 THEN text || chr(10) || '> old' || chr(10) || 'more' WHEN 2 THEN text || chr(10) || '-----' || chr(10) || 'https://a.example' ELSE text END AS t FROM conversations),
    l AS (SELECT text_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS no FROM x),
    k AS (SELECT *, CASE WHEN regexp_matches(line, '^\\s*>') THEN 'quote' WHEN regexp_matches(line, '^\\s*(Dear|Hi|Hello)\\b') THEN 'salutation'
                         WHEN regexp_matches(line, '^(Best|Kind|Warm) regards') THEN 'closing' END AS k0,
                 regexp_matches(line, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+|[0-9]{2,4}-[0-9]{2,4}-[0-9]{3,4}|https?://') AS contact FROM l),
    s AS (SELECT *, (regexp_matches(line, '^\\s*[-=*_]{4,}\\s*$') OR (coalesce(lag(k0) OVER w = 'closing', false) AND trim(line) <> ''))
             AND coalesce(max(contact::INT) OVER (w ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING), 0) = 1
             AND count(*) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) <= 15 AS starts FROM k WINDOW w AS (PARTITION BY text_id ORDER BY no)),
    f AS (SELECT text_id, no, line, CASE WHEN max((k0 = 'quote')::INT) OVER w = 1 THEN 'quote' WHEN max(starts::INT) OVER w = 1 THEN 'signature' ELSE k0 END AS kind
          FROM s WINDOW w AS (PARTITION BY text_id ORDER BY no))"""


def mails(spark, d):
    turn = F.col("turn") % 4
    text = (
        F.when(turn == 0, F.concat(F.lit("Dear Bob,\n"), "text", F.lit("\nBest regards\nAnn\nann@example.com")))
        .when(turn == 1, F.concat("text", F.lit("\n> old\nmore")))
        .when(turn == 2, F.concat("text", F.lit("\n-----\nhttps://a.example")))
        .otherwise(F.col("text"))
    )
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("text_id"), text.alias("text"))


@query("mail_labels", f"{MAIL} SELECT text_id, no, kind FROM f WHERE kind IS NOT NULL")
def mail_label_rows(spark, d):
    found = sg.mail_labels(mails(spark, d), "text_id", "text").filter("kind IS NOT NULL")
    return found.select("text_id", F.col("no").cast("long").alias("no"), "kind")


@query("mail_body", f"{MAIL} SELECT text_id, string_agg(line, chr(10) ORDER BY no) AS text FROM f WHERE kind IS NULL GROUP BY text_id")
def mail_body_rows(spark, d):
    return sg.mail_body(sg.mail_labels(mails(spark, d), "text_id", "text"))


@query(
    "paragraph_blocks",
    """WITH x AS (SELECT doc_id, '# T ' || doc_id || chr(10) || text || chr(10) || '```' || chr(10) || '# no' || chr(10) || chr(10) || 'x' || chr(10) || '```' || chr(10) || 'end' AS t FROM documents),
    l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS no FROM x),
    a AS (SELECT *, regexp_matches(line, '^\\s*(```|~~~)') AS fence FROM l),
    o AS (SELECT *, coalesce(sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS open FROM a),
    h AS (SELECT *, open OR fence AS fenced, regexp_matches(line, '^#{1,6}\\s') AND NOT (open OR fence) AS head FROM o),
    b AS (SELECT *, trim(line, ' ') = '' AND NOT fenced AS blank FROM h),
    s AS (SELECT *, head OR coalesce(lag(head) OVER w, false) OR (fence AND NOT open) OR coalesce(lag(blank) OVER w, true) AS start FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY no)),
    g AS (SELECT *, sum(start::INT) OVER (PARTITION BY doc_id ORDER BY no) AS block FROM s),
    p AS (SELECT doc_id, block, string_agg(line, chr(10) ORDER BY no) AS text, bool_or(head) AS heading, min(no) AS no FROM g WHERE NOT blank GROUP BY ALL)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS para_id, md5(text) AS text_md5, heading FROM p""",
)
def paragraph_blocks(spark, d):
    text = F.concat(F.lit("# T "), "doc_id", F.lit("\n"), "text", F.lit("\n```\n# no\n\nx\n```\nend"))
    p = sg.paragraphs(table(spark, d, "documents").withColumn("text", text), "doc_id", "text")
    return p.select(F.col("text_id").alias("doc_id"), F.col("para_id").cast("long").alias("para_id"), F.md5(F.col("text").cast("binary")).alias("text_md5"), "heading")


@query(
    "adversative_clauses",
    """WITH s AS (SELECT conv_id, turn, string_split(replace(text, ' the ', 'けれど'), 'けれど') AS c FROM conversations)
    SELECT conv_id, turn, len(c)::BIGINT AS clauses, round(CASE WHEN len(c) = 1 THEN 1.0 ELSE 0.7 * (len(c) - 1) + 1.2 END, 4)::DOUBLE AS weight FROM s""",
)
def adversative_clauses(spark, d):
    c = table(spark, d, "conversations").withColumn("c", sg.clauses(F.replace("text", F.lit(" the "), F.lit("けれど"))))
    return c.select("conv_id", "turn", F.size("c").cast("long").alias("clauses"), F.round(F.aggregate("c", F.lit(0.0), lambda a, x: a + x["weight"]), 4).alias("weight"))


@query(
    "search_keys",
    """SELECT item_id, lower(regexp_replace(text, '[\\s。、！？!?「」『』（）()・…,.:;]+', '', 'g')) AS key, coalesce(len(list_distinct(list_transform(range(1, greatest(length(text), 2)), lambda i: substring(text, i, 2)))), 0)::BIGINT AS bigrams FROM benchmark""",
)
def search_keys(spark, d):
    return table(spark, d, "benchmark").select("item_id", tx.search_key(F.col("text")).alias("key"), F.size(F.array_distinct(tx.ngrams(F.col("text")))).cast("long").alias("bigrams"))


@query("confusion_counts", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def confusion_counts(spark, d):
    return q.confusion(table(spark, d, "documents"), "lang", "source")


@query(
    "line_labels",
    """SELECT doc_id, count(*) AS lines, count(*) FILTER (regexp_matches(l, '^\\s*([-*+・‣]|[0-9]+[.)])\\s*\\S')) AS bullets,
        count(*) FILTER (regexp_matches(l, '^\\s*(```|~~~)')) AS fences FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY 1""",
)
def line_label_counts(spark, d):
    rows = sg.line_labels(table(spark, d, "documents"), "doc_id", "text")
    n = lambda c: F.sum(F.col(c).cast("long"))
    return rows.groupBy(F.col("text_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("lines"), n("bullet").alias("bullets"), n("fence").alias("fences"))


@query(
    "normalized_spans",
    """WITH t AS (SELECT item_id, 'ｱ' || chr(13) || chr(10) || text || chr(8203) || '㌔ end' AS t, length(text) AS n FROM benchmark)
    SELECT item_id, 'ア' || chr(10) || (SELECT text FROM benchmark b WHERE b.item_id = t.item_id) || 'キロ end' AS normalized,
        (n + 4)::BIGINT AS begin, (n + 5)::BIGINT AS end FROM t""",
)
def normalized_spans(spark, d):
    """The span of the last compatibility character, found in the normalised text and told in the original."""
    t = F.concat(F.lit("ｱ\r\n"), "text", F.lit("​㌔ end"))
    b = table(spark, d, "benchmark").select("item_id", F.char_length("text").alias("n"), nm.normalizer()(t).alias("x"))
    begin, end = nm.original_span(F.col("x.origin"), F.col("n") + 2, F.col("n") + 4)
    return b.select("item_id", F.col("x.normalized").alias("normalized"), begin.cast("long").alias("begin"), end.cast("long").alias("end"))


@query("decoded_texts", "SELECT item_id, text || CASE WHEN item_id % 2 = 0 THEN chr(65533) ELSE '' END AS text, CASE WHEN item_id % 2 = 0 THEN 'E101' END AS code FROM benchmark")
def decoded_texts(spark, d):
    b = table(spark, d, "benchmark")
    raw = F.when(F.col("item_id") % 2 == 0, F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF")))).otherwise(F.col("text").cast("binary"))
    text, error = nm.decode_utf8(raw)
    return b.select("item_id", text.alias("text"), error["code"].alias("code"))


SPELL = [("申し込み", "申込|申込み", 1), ("ひらがな", "かな", 2), ("受け付け", "受付", 3)]


@query(
    "compact_okurigana",
    f"""WITH g AS (SELECT list_concat([canonical], string_split(synonyms, '|')) AS f, seq FROM {sql_values("canonical, synonyms, seq", SPELL)}),
    k AS (SELECT f, seq, list_filter(f, lambda x: NOT regexp_matches(x, '[\\x{{3040}}-\\x{{309F}}]'))[1] AS "to" FROM g)
    SELECT word, "to" AS canonical FROM (SELECT unnest(f) AS word, "to", seq FROM k WHERE "to" IS NOT NULL) WHERE word <> "to" """,
)
def compact(spark, d):
    g = values(spark, "canonical string, synonyms string, seq int", SPELL).withColumn("synonyms", lx.split_list(F.col("synonyms")))
    return lx.compact_okurigana(g)


@query("synonym_groups", f"SELECT canonical, list_concat([canonical], string_split(synonyms, '|')) AS words FROM {sql_values('canonical, synonyms, seq', SPELL)}")
def groups(spark, d):
    return lx.synonym_groups(values(spark, "canonical string, synonyms string, seq int", SPELL).withColumn("synonyms", lx.split_list(F.col("synonyms"))))


WORDS = [("すごい", 1), ("猫", 2), ("やばい", 3), ("あ", 4), ("すごい", 5)]


@query("known_hiragana", f"SELECT DISTINCT surface FROM {sql_values('surface, seq', WORDS)} WHERE regexp_full_match(surface, '[\\x{{3040}}-\\x{{309F}}]{{2,}}')")
def hiragana(spark, d):
    return lx.known_hiragana(values(spark, "surface string, seq int", WORDS[:3]), values(spark, "surface string, seq int", WORDS[3:]))


@query("examples_by_surface", "SELECT event_type AS surface, count(*) AS n, arg_min(event_id, event_id) AS first FROM events GROUP BY 1")
def examples(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("surface"), F.col("event_id").alias("seq"), F.col("props").alias("example"), F.col("event_type").alias("base_emotion"))
    return lx.examples_by_surface(e).select("surface", F.size("examples").cast("long").alias("n"), F.col("examples")[0]["seq"].alias("first"))


@query(
    "complaints",
    """WITH s AS (SELECT user_id AS text_id, CASE event_type WHEN 'purchase' THEN 'request' ELSE event_type END AS intent, round(max(value) / 1000, 6) AS score FROM events GROUP BY ALL),
    u AS (SELECT * FROM s UNION ALL SELECT text_id, 'complaint', score + 0.01 FROM s WHERE intent = 'request' AND text_id % 2 = 0)
    SELECT text_id, intent, round(score, 6) AS score, row_number() OVER (PARTITION BY text_id ORDER BY score DESC, intent) AS rank FROM u""",
)
def complaint_rows(spark, d):
    kind = F.when(F.col("event_type") == "purchase", "request").otherwise(F.col("event_type"))
    e = table(spark, d, "events").select(F.col("user_id").alias("text_id"), kind.alias("intent"), "value")
    s = e.groupBy("text_id", "intent").agg(F.round(F.max("value") / 1000, 6).alias("score"))
    polarity = s.select("text_id").distinct().withColumn("polarity", F.when(F.col("text_id") % 2 == 0, "negative").otherwise("positive"))
    return sm.complaints(s, polarity).select("text_id", "intent", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    "rate_limit_admission",
    """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) / 1e6 AS ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
    r AS (SELECT key, n, ts, true AS admitted, [ts] AS held FROM e WHERE n = 1
          UNION ALL SELECT key, n, ts, len(h) < 3, CASE WHEN len(h) < 3 THEN list_append(h, ts) ELSE h END
          FROM (SELECT e.key, e.n, e.ts, list_filter(r.held, lambda x: x > e.ts - 60) AS h FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1))
    SELECT key, ts, admitted FROM r""",
)
def rate_limit_admission(spark, d):
    """Which events pass a limit of three a minute for each user, replayed: admitted calls alone count."""
    from kumiki.streaming.streams import rate_limit

    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    return rate_limit(e, 3)


def analysed(spark, d, text, kept=False, **how):
    """The plan of a text made from each event; kept is for one that is read more than once."""
    from kumiki.operators.analyze import analyze
    from kumiki.operators.plan import kept_analysis

    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return (kept_analysis if kept else analyze)(e.select("event_id", text.alias("text")), "event_id", "text", **how)


@query(
    "time_entities",
    """WITH e AS (SELECT event_id, ts, event_id % 12 + 1 AS m, event_id % 8 + 1 AS r FROM events)
    SELECT event_id, 'DATE' AS type, strftime(ts, '%Y-%m-%d') AS value, 3::BIGINT AS begin FROM e
    UNION ALL SELECT event_id, 'DATE', printf('--%02d', m), 3 + length(strftime(ts, '%Y年%-m月%-d日、')) FROM e
    UNION ALL SELECT event_id, 'TIME', strftime(ts, '%H:%M'), 3 + length(strftime(ts, '%Y年%-m月%-d日、')) + length(m || '月と') FROM e
    UNION ALL SELECT event_id, 'DATE', 'FY' || (2018 + r), 3 + length(strftime(ts, '%Y年%-m月%-d日、')) + length(m || '月と') + length(strftime(ts, '%-H時%-M分。')) FROM e""",
)
def time_entities(spark, d):
    from kumiki.operators.analyze import child

    text = F.concat(
        F.lit("取引は"), F.date_format("ts", "y年M月d日、"), (F.col("event_id") % 12 + 1).cast("string"), F.lit("月と"), F.date_format("ts", "H時m分。"),
        F.lit("令和"), (F.col("event_id") % 8 + 1).cast("string"), F.lit("年度。"),
    )
    found = child(analysed(spark, d, text, need=("entities",)), "entities").filter("source = 'time'")
    return found.select(F.col("text_id").alias("event_id"), "type", F.col("value_str").alias("value"), F.col("begin").cast("long").alias("begin"))


@query(
    "money_entities",
    """WITH e AS (SELECT event_id, event_id % 900 + 1 AS n, event_id % 9 + 1 AS k FROM events)
    SELECT event_id, 'MONEY' AS type, (n * 10000 + k * 1000)::DOUBLE AS value, 'JPY' AS currency, 3::BIGINT AS begin FROM e
    UNION ALL SELECT event_id, 'MONEY', n + 0.5, 'USD', 3 + length(n || '万' || k || '千円と') FROM e
    UNION ALL SELECT event_id, 'QUANTITY', k * 1000000.0, NULL, 3 + length(n || '万' || k || '千円と$' || n || '.5、') FROM e""",
)
def money_entities(spark, d):
    from kumiki.operators.analyze import child

    n, k = (F.col("event_id") % 900 + 1).cast("string"), (F.col("event_id") % 9 + 1).cast("string")
    text = F.concat(F.lit("価格は"), n, F.lit("万"), k, F.lit("千円と$"), n, F.lit(".5、"), k, F.lit("00万人。"))
    found = child(analysed(spark, d, text, need=("entities",)), "entities").filter("source = 'quantity'")
    return found.select(F.col("text_id").alias("event_id"), "type", F.col("value_num").alias("value"), "currency", F.col("begin").cast("long").alias("begin"))


NAMES, THINGS = ["東京", "会社", "ネコ"], ["手紙", "データ"]


@query(
    "predicate_arguments",
    f"""WITH e AS (SELECT event_id, {NAMES!r}[event_id % 3 + 1] AS s, {THINGS!r}[event_id % 2 + 1] AS o, event_id % 5 = 0 AS neg FROM events)
    SELECT event_id, 'subject' AS role, s AS text, 0::BIGINT AS begin, neg AS negated, s AS subject, o AS object FROM e
    UNION ALL SELECT event_id, 'object', o, length(s) + 1, neg, s, o FROM e""",
)
def predicate_arguments(spark, d):
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % n + 1).cast("int"))
    text = F.concat(pick(NAMES, 3), F.lit("が"), pick(THINGS, 2), F.lit("を"), F.when(F.col("event_id") % 5 == 0, "買わない").otherwise("買った"), F.lit("。"))
    a = analysed(spark, d, text, need=("predicates", "relations")).select("text_id", "analysis.predicates", F.col("analysis.relations")[0].alias("r"))
    p = a.select("text_id", "r", F.explode("predicates").alias("p")).select("text_id", "r", "p.negated", F.explode("p.arguments").alias("x"))
    return p.select(
        F.col("text_id").alias("event_id"), "x.role", "x.text", F.col("x.begin").cast("long").alias("begin"), "negated", "r.subject", "r.object"
    )


@query(
    "attribution",
    f"""WITH e AS (SELECT event_id, {NAMES!r}[event_id % 3 + 1] AS s, event_id % 2 AS way FROM events)
    SELECT event_id, CASE way WHEN 0 THEN s ELSE '手紙' END AS target, CASE way WHEN 0 THEN 1.0 ELSE 1.2 END::DOUBLE AS weight FROM e""",
)
def attributions(spark, d):
    from kumiki.operators.plan import affect_hits, attribution

    s = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("event_id") % 3 + 1).cast("int"))
    text = F.when(F.col("event_id") % 2 == 0, F.concat(s, F.lit("は嬉しい"))).otherwise(F.concat(s, F.lit("だけれど手紙が嬉しい")))
    a = analysed(spark, d, text, kept=True, need=("tokens", "entities", "clauses", "chunks"), dictionary={"嬉しい": "形容詞"})
    words = values(spark, "surface string, base_emotion string, polarity string, intensity double, seq int", [("嬉しい", "joy", "positive", 0.8, 1)])
    hits = affect_hits(a, words)
    found = attribution(a, hits).join(hits.select("text_id", "pos", "clause_weight"), ["text_id", "pos"])
    return found.select(F.col("text_id").alias("event_id"), "target", F.col("clause_weight").alias("weight"))


@query(
    "sentence_intents",
    """WITH e AS (SELECT event_id, event_id % 4 AS way, event_id % 3 AS felt FROM events)
    SELECT event_id, CASE way WHEN 0 THEN 'question' WHEN 1 THEN CASE felt WHEN 0 THEN 'negative_feedback' ELSE 'request' END
            WHEN 2 THEN CASE felt WHEN 0 THEN 'negative_feedback' ELSE 'inform' END ELSE CASE felt WHEN 0 THEN 'negative_feedback' ELSE 'unknown' END END AS label,
        CASE way WHEN 0 THEN 'question' WHEN 1 THEN 'request' ELSE 'statement' END AS speech_act, CASE felt WHEN 0 THEN 'negative' ELSE 'none' END AS evaluation FROM e""",
)
def sentence_intents(spark, d):
    from kumiki.operators.intent import classify

    way = F.col("event_id") % 4
    text = F.when(way == 0, "どう使うのか").when(way == 1, "連絡ください").when(way == 2, "商品が届く。").otherwise("商品X")
    sure = F.when(F.col("event_id") % 3 == 0, 0.5)
    e = table(spark, d, "events").select(
        F.col("event_id").alias("text_id"), text.alias("text"), F.array().cast("array<string>").alias("quoted"), F.array().cast("array<string>").alias("types"),
        F.when(sure.isNotNull(), "negative").alias("evaluation"), sure.alias("evaluation_confidence"),
        *(F.lit(None).cast("string").alias(c) for c in ("emotion", "affect")), F.lit(None).cast("double").alias("affect_confidence"),
    )
    rules = values(spark, "intent string, pattern string, score double, priority int", [("question", "どう|いつ", 0.5, 100), ("request", "ください", 0.9, 100)])
    return classify(e, rules).select(F.col("text_id").alias("event_id"), "label", "axes.speech_act", "axes.evaluation")


@query(
    "conjugations",
    """WITH v AS (SELECT * FROM (VALUES ('書', 'き', 'く'), ('話', 'し', 'す'), ('読', 'み', 'む'), ('死', 'に', 'ぬ'), ('泳', 'ぎ', 'ぐ')) AS t(k, i, u)),
    f AS (SELECT * FROM (VALUES ('ます', '丁寧'), ('ました', '丁寧過去'), ('ません', '丁寧否定'), ('たい', '希望')) AS t(e, form))
    SELECT k || i || e AS surface, k || u AS lemma, form FROM v, f""",
)
def conjugations(spark, d):
    from kumiki.operators.tokenizer import conjugation

    verbs = values(spark, "k string, i string", [("書", "き"), ("話", "し"), ("読", "み"), ("死", "に"), ("泳", "ぎ")])
    ends = values(spark, "e string", [("ます",), ("ました",), ("ません",), ("たい",)])
    whole = verbs.crossJoin(F.broadcast(ends)).select(F.concat("k", "i", "e").alias("surface"))  # five verbs, four endings

    @F.pandas_udf("lemma string, form string")
    def run(surfaces):
        import pandas as pd

        found = [conjugation(x, "動詞") for x in surfaces]
        return pd.DataFrame({"lemma": [f[0] for f in found], "form": [f[2] for f in found]})

    return whole.select("surface", run("surface").alias("x")).select("surface", "x.lemma", "x.form")


PEOPLE = {"彼": "PERSON", "同社": "ORGANIZATION", "同地": "LOCATION"}


@query(
    "anaphora_types",
    """WITH m AS (SELECT user_id AS text_id, event_id AS mention_id, CASE event_id % 7 WHEN 0 THEN '彼' WHEN 1 THEN '同社' WHEN 2 THEN '同地' ELSE event_type END AS surface,
        CASE event_id % 7 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ORGANIZATION' WHEN 2 THEN 'LOCATION' WHEN 3 THEN 'PERSON' WHEN 4 THEN 'ORGANIZATION' WHEN 5 THEN 'LOCATION' END AS type,
        event_id % 7 < 3 AS pro FROM events),
    a AS (SELECT *, last_value(CASE WHEN NOT pro THEN mention_id END IGNORE NULLS) OVER (PARTITION BY text_id, type ORDER BY mention_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS antecedent
          FROM m WHERE type IS NOT NULL)
    SELECT text_id, mention_id, antecedent FROM a WHERE pro AND antecedent IS NOT NULL""",
)
def anaphora_types(spark, d):
    way = F.col("event_id") % 7
    surface = F.when(way == 0, "彼").when(way == 1, "同社").when(way == 2, "同地").otherwise(F.col("event_type"))
    kind = F.when(way == 3, "PERSON").when(way == 4, "ORGANIZATION").when(way == 5, "LOCATION")
    m = table(spark, d, "events").select(F.col("user_id").alias("text_id"), F.col("event_id").alias("mention_id"), surface.alias("surface"), kind.alias("type"))
    return doc.anaphora(m, PEOPLE).select("text_id", "mention_id", "antecedent")


@query(
    "template_corpus",
    """WITH p AS (SELECT range AS id, ['{who}は{what}を買った', '{what}が{who}に届く', '{who}'][range % 3 + 1] AS t,
        ['田中', '佐藤', '鈴木', '高橋', '伊藤'][(range * 7 + 1 * 31 + 20) % 5 + 1] AS who, ['本', '車'][(range * 7 + 0 * 31 + 20) % 2 + 1] AS what FROM range(500))
    SELECT id, id % 3 AS template, replace(replace(t, '{who}', who), '{what}', what) AS text FROM p""",
)
def template_corpus(spark, d):
    found = ms.template_corpus(spark, ["{who}は{what}を買った", "{what}が{who}に届く", "{who}"], {"what": ["本", "車"], "who": ["田中", "佐藤", "鈴木", "高橋", "伊藤"]}, 500, 20)
    return found


OVERLAY = [("期待外れ", 1), ("外れ", 2), ("課金高すぎ", 3), ("高すぎ", 4), ("高", 5)]


@query(
    "evaluation_overlay",
    f"""WITH o AS {sql_values("surface, seq", OVERLAY)}, h AS (SELECT DISTINCT surface FROM o)
    SELECT h.surface, o.surface AS evaluation, substr(h.surface, 1, strpos(h.surface, o.surface) - 1) AS target FROM h JOIN o ON contains(h.surface, o.surface) AND h.surface <> o.surface
    QUALIFY row_number() OVER (PARTITION BY h.surface ORDER BY length(o.surface) DESC, o.surface) = 1""",
)
def evaluation_overlay(spark, d):
    words = values(spark, "surface string, seq int", OVERLAY)
    return sm.evaluation_overlay(words.select("surface").distinct(), words)


@query(
    "attested_words",
    """WITH w AS (SELECT CASE event_type WHEN 'click' THEN '東京' WHEN 'error' THEN '大阪市' WHEN 'purchase' THEN '買う' ELSE '京' END AS piece FROM events)
    SELECT piece AS word, count(*) AS n FROM w WHERE regexp_full_match(piece, '[\\x{4E00}-\\x{9FFF}\\x{3005}]{2,}') GROUP BY 1 HAVING count(*) >= 3""",
)
def attested_words(spark, d):
    kind = F.col("event_type")
    piece = F.when(kind == "click", "東京").when(kind == "error", "大阪市").when(kind == "purchase", "買う").otherwise("京")
    return lx.attested_words(table(spark, d, "events").select(piece.alias("piece")), 3)


@query(
    "vector_search",
    """WITH c AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, v.label, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS s
               FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0),
    t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS n FROM c),
    r AS (SELECT query_id, doc_id, round((s * 0.4 + (label % 3) / 2 * 0.2 + CASE WHEN label % 2 = 0 THEN 0.05 ELSE 0 END) / (0.6 + CASE WHEN label % 2 = 0 THEN 0.1 ELSE 0 END), 4) AS score FROM t WHERE n <= 50)
    SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r QUALIFY rank <= 5""",
)
def vector_search(spark, d):
    """The 50 nearest of every vector whose id is divisible by 100, reranked with two more signals."""
    from kumiki.operators.retrieval import search

    e = table(spark, d, "embeddings")
    none = F.lit(None).cast("double")
    index = e.select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), none.alias("entity_match"), (F.col("label") % 3 / 2).alias("keyword_overlap"),
        F.when(F.col("label") % 2 == 0, 0.5).alias("intent_match"), none.alias("time_match"), none.alias("topic_match"), none.alias("sentiment_match"),
    )
    found = search(index, e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")))
    return found.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


CANON = [("猫", "ねこ|ネコ", 1), ("犬", "いぬ", 2)]


@query(
    "normalised_by_rules",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN '猫と' WHEN 1 THEN '犬が' ELSE 'イヌが' END || event_id || 'km' AS normalized,
        CASE event_id % 3 WHEN 2 THEN 3 ELSE 2 END + length(event_id::VARCHAR)::BIGINT AS km_at FROM events""",
)
def normalised_by_rules(spark, d):
    """Rewriting by the spellings of a group, after compatibility forms; the place of the unit in the normalised text."""
    g = values(spark, "canonical string, synonyms string, seq int", CANON).withColumn("synonyms", lx.split_list(F.col("synonyms")))
    rules = {r["word"]: r["canonical"] for r in lx.canonical_map(g).collect()}  # a lexicon of two groups
    way = F.col("event_id") % 3
    text = F.concat(F.when(way == 0, "ﾈｺと").when(way == 1, "いぬが").otherwise("ｲﾇが"), F.col("event_id").cast("string"), F.lit("㎞"))
    x = table(spark, d, "events").select("event_id", nm.normalizer(rules)(text).alias("x"))
    return x.select("event_id", "x.normalized", (F.locate("km", "x.normalized") - 1).cast("long").alias("km_at"))


@query(
    "chunk_lines",
    """WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
    s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS i, t, length(t) AS n, regexp_matches(t, '^(#{1,6}\\s|[■□◆◇●▼【])') AS head,
              list_distinct(list_filter(regexp_extract_all(lower(t), '[\\p{L}\\p{N}_]+'), lambda w: length(w) > 3)) AS topics FROM l WHERE trim(t, ' ') <> ''),
    g AS (SELECT doc_id, i, 1 AS grp, n AS size, topics AS seen FROM s WHERE i = 1
          UNION ALL SELECT doc_id, i, CASE WHEN fresh THEN grp + 1 ELSE grp END, CASE WHEN fresh THEN n ELSE size + n END, CASE WHEN fresh THEN topics ELSE list_distinct(list_concat(seen, topics)) END
          FROM (SELECT s.*, g.grp, g.size, g.seen, s.head OR (g.size + s.n > 400 AND g.size > 0) OR (g.size >= 160 AND len(g.seen) > 0 AND len(s.topics) > 0
                    AND len(list_intersect(g.seen, s.topics)) / len(list_distinct(list_concat(g.seen, s.topics))) < 0.05) AS fresh
                FROM g JOIN s ON s.doc_id = g.doc_id AND s.i = g.i + 1)),
    q AS (SELECT doc_id, grp, sum(n) AS size, arg_min(head, i) AS head FROM s JOIN g USING (doc_id, i) GROUP BY ALL),
    o AS (SELECT doc_id, grp, 0 AS chunk, size FROM q WHERE grp = 1
          UNION ALL SELECT doc_id, grp, CASE WHEN joins THEN chunk ELSE chunk + 1 END, CASE WHEN joins THEN size + own ELSE own END
          FROM (SELECT o.doc_id, q.grp, o.chunk, o.size, q.size AS own, q.size < 80 AND NOT q.head AND o.size + q.size <= 400 AS joins
                FROM o JOIN q ON q.doc_id = o.doc_id AND q.grp = o.grp + 1))
    SELECT doc_id, chunk AS chunk_id, count(*) AS lines, md5(string_agg(t, chr(10) ORDER BY i)) AS text_md5 FROM s JOIN g USING (doc_id, i) JOIN o USING (doc_id, grp) GROUP BY ALL""",
)
def chunk_lines(spark, d):
    """Chunks of whole documents packed from their lines."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), F.posexplode(F.split("text", "\n")).alias("sent_id", "text")).filter(F.trim("text") != "")
    found = doc.chunks(lines.select("text_id", "sent_id", F.lit(0).alias("begin"), F.lit(0).alias("end"), "text"))
    return found.select(
        F.col("text_id").alias("doc_id"), F.col("chunk_id").cast("long").alias("chunk_id"), (F.size(F.split("text", "\n"))).cast("long").alias("lines"),
        F.md5(F.col("text").cast("binary")).alias("text_md5"),
    )
