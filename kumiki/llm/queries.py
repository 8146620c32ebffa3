"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kumiki.llm.bpe import bpe
from kumiki.llm.chat import format_chats, read_back, turns_as_events
from kumiki.llm.decontaminate import decontaminate
from kumiki.llm.exact_dedup import exact_dedup
from kumiki.llm.jaccard_join import jaccard_components
from kumiki.llm.langid import identify
from kumiki.llm.shared import new_path, table
from kumiki.llm.substring_dedup import substring_dedup
from kumiki.llm.template_tree import template_dedup
from kumiki.llm.token_files import read_token_files, write_token_files
from kumiki.llm.toxicity import toxicity, with_categories


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ("n_tokens", "ids_sha256", "decoded_sha256")
    return bpe(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), "words", outputs=out)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return read_back(format_chats(turns_as_events(chats)))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    return identify(table(spark, sf_dir, "documents"), learn=part != 2, flag=part == 2)


def op4_template_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = template_dedup(table(spark, sf_dir, "documents"))
    sha = F.sha2(F.col("kept").cast("binary"), 256)
    return found.select("doc_id", "n_lines", "n_removed", sha.alias("kept_sha256"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), with_categories(table(spark, sf_dir, "labels")))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer_file("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, folder)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_chat": op2_chat,
        "op3_langid": op3_langid,
        "op4_template_dedup": op4_template_dedup,
        "op5_decontaminate": op5_decontaminate,
        "op6_toxicity": op6_toxicity,
        "op7_token_files": op7_token_files,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_exact_dedup": op10_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    norm = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ws = f"regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    odd = "\\### Assistant: </turn> ok"
    return {
        "op2_chat": f"""
            WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                       UNION ALL SELECT -7, 0, 'user', '{odd}' UNION ALL SELECT -7, 1, 'assistant', '{odd}'),
            e AS (SELECT *, length(regexp_replace(text, '\\\\|</turn>|: ', '', 'g')) AS short FROM c)
            SELECT conv_id, count(*) AS n_turns,
                   sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
                   CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
                   sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
                   CAST(sum(length(role) + length(text) + length('### :  </turn>') + 1
                       + length(regexp_replace(text, '[^\\\\]', '', 'g'))
                       + len(regexp_extract_all(text, ': '))
                       + len(regexp_extract_all(text, '</turn>'))
                       + len(list_filter(range(1, length(text) + 1), lambda i: substring(text, i, 3) = '###'))
                   ) AS BIGINT) AS formatted_chars
            FROM e GROUP BY conv_id""",
        "op4_template_dedup": """
            WITH l AS (SELECT doc_id, md5(text) AS tx, no, list_filter(string_split_regex(regexp_replace(line, '[0-9]+', '<*>', 'g'),
                              '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS t
                       FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
                                    generate_subscripts(string_split(text, chr(10)), 1) AS no
                             FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))),
            p AS (SELECT doc_id, tx, no, t, len(t) || ' ' || array_to_string(t[1:3], ' ') AS leaf FROM l WHERE len(t) > 0),
            c AS (SELECT leaf, t, count(*) AS docs FROM (SELECT DISTINCT doc_id, tx, leaf, t FROM p) GROUP BY leaf, t),
            b AS (SELECT leaf FROM c GROUP BY leaf HAVING sum(docs) >= 10),
            k AS (SELECT leaf, t, docs, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM c JOIN b USING (leaf)),
            s AS (SELECT leaf, pos, token, sum(docs) AS support FROM k GROUP BY leaf, pos, token),
            g AS (SELECT leaf, t, string_agg(CASE WHEN support >= 10 THEN token ELSE '<*>' END, ' ' ORDER BY pos) AS tp,
                         avg(CASE WHEN support >= 10 THEN 1 ELSE 0 END) AS share
                  FROM k JOIN s USING (leaf, pos, token) GROUP BY leaf, t HAVING share >= 0.7),
            r AS (SELECT leaf, tp FROM (SELECT DISTINCT leaf, tp, doc_id, tx FROM p JOIN g USING (leaf, t))
                  GROUP BY leaf, tp HAVING count(*) >= 10),
            d AS (SELECT DISTINCT doc_id, tx, no FROM p JOIN g USING (leaf, t) JOIN r USING (leaf, tp)),
            x AS (SELECT l.doc_id, l.tx, l.no, line FROM (
                    SELECT doc_id, md5(text) AS tx, unnest(string_split(text, chr(10))) AS line,
                           generate_subscripts(string_split(text, chr(10)), 1) AS no
                    FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)) l)
            SELECT x.doc_id, count(*) AS n_lines, count(d.no) AS n_removed,
                   sha256(coalesce(string_agg(line, chr(10) ORDER BY x.no) FILTER (d.no IS NULL), '')) AS kept_sha256
            FROM x LEFT JOIN d ON x.doc_id = d.doc_id AND x.tx = d.tx AND x.no = d.no GROUP BY x.doc_id""",
        "op5_decontaminate": f"""
            WITH d AS (SELECT doc_id, {ws} AS w FROM documents),
            i AS (SELECT CAST(item_id AS VARCHAR) AS item, {ws} AS w FROM benchmark),
            iw AS (SELECT DISTINCT item, len(w[s:s + 9]) AS n, array_to_string(w[s:s + 9], ' ') AS t
                   FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM i WHERE len(w) > 0)),
            ns AS (SELECT DISTINCT n FROM iw),
            dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS t
                   FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, ns)),
            h AS (SELECT doc_id, s, n, item FROM dw JOIN iw USING (n, t)),
            p AS (SELECT doc_id, count(DISTINCT p) AS n_hit
                  FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
            q AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
                  FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
            SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
                   coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
                   coalesce(n_hit, 0) > 0 AS contaminated
            FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN q ON d.doc_id = q.doc_id""",
        "op8_substring_dedup": """
            WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
            s AS (SELECT doc_id, s, array_to_string(w[s:s + 34], ' ') AS t
                  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d)),
            r AS (SELECT doc_id, s FROM s JOIN (SELECT t FROM s GROUP BY t HAVING count(*) > 1) USING (t)),
            g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM r),
            k AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
            x AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.p) AS kept, count(*) AS n
                  FROM k LEFT JOIN g ON k.doc_id = g.doc_id AND k.p = g.p WHERE g.p IS NULL GROUP BY k.doc_id)
            SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
                   sha256(coalesce(kept, '')) AS kept_sha256
            FROM d LEFT JOIN x ON d.doc_id = x.doc_id""",
        "op9_jaccard_join": f"""
            WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({low}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
            g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                      ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END)) AS s FROM d),
            c AS (SELECT min(doc_id) AS rep, s, len(s) AS n FROM g WHERE len(s) > 0 GROUP BY s),
            t AS (SELECT rep, n, unnest(s) AS token FROM c),
            o AS (SELECT x.rep AS a, y.rep AS b, x.n + y.n AS n, count(*) AS hit FROM t x JOIN t y ON x.token = y.token AND x.rep < y.rep
                  AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n) GROUP BY x.rep, y.rep, x.n, y.n),
            e AS (SELECT a, b FROM o WHERE 100 * hit >= 90 * (n - hit)),
            l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
            r AS (SELECT rep AS node, rep AS label FROM c UNION SELECT l.a, r.label FROM r JOIN l ON r.node = l.b),
            m AS (SELECT node, min(label) AS label FROM r GROUP BY node)
            SELECT doc_id, CAST(len(g.s) AS BIGINT) AS n_shingles, coalesce(label, doc_id) AS component_id
            FROM g LEFT JOIN c ON g.s = c.s LEFT JOIN m ON c.rep = m.node""",
        "op10_exact_dedup": f"""
            WITH n AS (SELECT doc_id, {norm} AS t FROM documents),
            g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
            SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept,
                   sha256(t) AS text_sha256
            FROM n JOIN g USING (t)""",
    }
