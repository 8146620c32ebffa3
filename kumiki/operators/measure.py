"""Evaluation over relations: modes, histograms, latencies, golden rows, gold chunks and weights of a fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kumiki.operators.retrieval import hybrid, retrieval_metrics, top_k


def mode(df: DataFrame, by: str | list[str], value: str) -> DataFrame:
    """by, value, n: the most frequent value of each group, of equally frequent ones the smallest; nulls don't count."""
    keys = [by] if isinstance(by, str) else by
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col(value)))
    return counts.groupBy(*keys).agg(best.alias("best")).select(*keys, f"best.{value}", "best.n")


def histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    """low, n: how many values fall into [low, low + width)."""
    low = F.floor(F.col(value) / width) * width
    return df.filter(F.col(value).isNotNull()).groupBy(low.alias("low")).agg(F.count(F.lit(1)).alias("n"))


def latencies(df: DataFrame, by: str, value: str) -> DataFrame:
    """by, n, mean, median, p95, p99, max: exact percentiles with linear interpolation."""
    p = F.percentile(value, [0.5, 0.95, 0.99])
    found = df.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), p.alias("p"), F.max(value).alias("max"))
    rounded = lambda c: F.round(c, 6)
    return found.select(
        by, "n", rounded(F.col("mean")).alias("mean"), rounded(F.col("p")[0]).alias("median"), rounded(F.col("p")[1]).alias("p95"),
        rounded(F.col("p")[2]).alias("p99"), F.col("max").cast("double").alias("max"),
    )


def golden_rows(found: DataFrame, gold: DataFrame, key: str, expected: str, value: str) -> DataFrame:
    """key, expected, value, passed: whether a found value is one of the alternatives (a|b) of its golden row.

    A golden row without a found one has not passed; an empty expectation asks for no value.
    """
    joined = gold.select(key, expected).join(found.select(key, value), key, "left")
    ways = F.transform(F.split(expected, "\\|"), F.trim)
    passed = F.when(F.coalesce(F.trim(expected), F.lit("")) == "", F.col(value).isNull()).otherwise(F.array_contains(ways, F.col(value)))
    return joined.withColumn("passed", F.coalesce(passed, F.lit(False)))


def gold_chunks(chunks: DataFrame, answers: DataFrame, squeezed=None) -> DataFrame:
    """query_id, chunk_id: the chunks of the answer's document that hold the answer; if none does, the chunk that holds
    its longest beginning or end of four characters or more, the first of equal ones.

    chunks: doc_id, chunk_id, text; answers: query_id, doc_id, answer. Texts are compared lower-cased, without white space.
    """
    plain = squeezed or (lambda c: F.lower(F.regexp_replace(c, "\\s+", "")))
    c = chunks.select("doc_id", "chunk_id", plain(F.col("text")).alias("t"))
    a = answers.select("query_id", "doc_id", plain(F.col("answer")).alias("a"))
    pairs = c.join(a, "doc_id")
    n = F.char_length("a")
    sizes = F.when(n >= 4, F.sequence(n, F.lit(4))).otherwise(F.array(n))
    fits = lambda k: F.col("t").contains(F.substring("a", F.lit(1), k)) | F.col("t").contains(F.substring("a", n - k + 1, k))
    held = pairs.withColumn("whole", F.col("t").contains(F.col("a")))
    part = F.when(F.col("whole"), n).when(n >= 4, F.coalesce(F.get(F.filter(sizes, fits), F.lit(0)), F.lit(0))).otherwise(0)
    scored = held.withColumn("part", part)
    w = Window.partitionBy("query_id")
    order = w.orderBy(F.desc("part"), "chunk_id")
    ranked = scored.withColumn("any", F.max(F.col("whole").cast("int")).over(w)).withColumn("nth", F.row_number().over(order))
    return ranked.filter(F.col("whole") | ((F.col("any") == 0) & (F.col("nth") == 1) & (F.col("part") > 0))).select("query_id", "chunk_id")


def alpha_grid(lexical: DataFrame, semantic: DataFrame, gold: DataFrame, alphas: list[float], depth: int = 10) -> DataFrame:
    """alpha, queries, recalls and mean reciprocal rank of the fusion at each weight."""
    parts = []
    for alpha in alphas:
        ranking = top_k(hybrid(lexical, semantic, alpha), depth)
        parts.append(retrieval_metrics(ranking, gold, depth=depth).withColumn("alpha", F.lit(float(alpha))))
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more)
    return whole


def best_alpha(lexical: DataFrame, semantic: DataFrame, gold: DataFrame, alphas: list[float], depth: int = 10) -> DataFrame:
    """query_id, alpha, rank: the weight that ranks a query's gold document best, of equal ones the smallest."""
    parts = None
    for alpha in alphas:
        ranked = top_k(hybrid(lexical, semantic, alpha), depth).join(gold, ["query_id", "doc_id"])
        one = ranked.groupBy("query_id").agg(F.min("rank").alias("rank")).withColumn("alpha", F.lit(float(alpha)))
        parts = one if parts is None else parts.unionByName(one)
    best = F.min(F.struct("rank", "alpha"))
    return parts.groupBy("query_id").agg(best.alias("b")).select("query_id", "b.alpha", "b.rank")


def overlaps(a: DataFrame, b: DataFrame, by: str, cell: int = 1000) -> DataFrame:
    """Pairs of spans (by, begin, end, and the rest of each side with a_ and b_ before it) that overlap.

    Spans are half-open. Each is dealt to the cells of its group that it touches, and a pair is made in the first cell
    that both touch, so that a long group is split and no pair is made twice.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        cells = F.sequence(F.floor(F.col("begin") / cell), F.floor((F.col("end") - 1) / cell))
        renamed = df.filter("begin < end").select(by, *(F.col(c).alias(f"{name}_{c}") for c in df.columns if c != by), cells.alias(f"{name}_cells"))
        return renamed.withColumn("cell", F.explode(f"{name}_cells"))

    x, y = side(a, "a"), side(b, "b")
    meet = (F.col("a_begin") < F.col("b_end")) & (F.col("b_begin") < F.col("a_end"))
    first = F.col("cell") == F.greatest(F.col("a_cells")[0], F.col("b_cells")[0])
    return x.join(y, [by, "cell"]).filter(meet & first).drop("cell", "a_cells", "b_cells")


def template_corpus(spark: SparkSession, templates: list[str], slots: dict[str, list[str]], n: int, seed: int) -> DataFrame:
    """id, template, text: n texts of templates in turn, each {slot} filled from its pool by the id and the seed."""
    rows = spark.range(n).withColumn("template", F.col("id") % len(templates))
    text = F.element_at(F.array(*map(F.lit, templates)), (F.col("template") + 1).cast("int"))
    for i, (slot, pool) in enumerate(sorted(slots.items())):
        at = (F.col("id") * 7 + i * 31 + seed) % len(pool) + 1
        text = F.replace(text, F.lit(f"{{{slot}}}"), F.element_at(F.array(*map(F.lit, pool)), at.cast("int")))
    return rows.select("id", "template", text.alias("text"))


# What the text of an answer to each kind of question looks like, and the hits that make a full score.
STEPS = (
    "```|^\\s*[$#>] |^\\s*(?:\\d+[.)]|[①-⑩]|[-*] )|→|"
    "手順|対処|対応|方法|やり方|手続|設定|再起動|再初期化|初期化|実行|削除|インストール|登録|切り替え|切替|変更|"
    "してください|して下さい|すること|する場合|した場合|ときは|時は|コマンド|クリック|選択|入力|押す|押して"
)
ANSWER_FORMS = {
    "how_to": STEPS,
    "reason": "ため|原因|理由|背景|なぜ|から|ので|により|によって|起因|要因|狙い|目的|きっかけ|経緯",
    "compare": "違い|違う|一方|に対して|比較|vs|対比|より|差|メリット|デメリット|長所|短所|利点|欠点|同じ|異なる",
    "definition": "とは|である|を指す|の略|意味|定義|と呼ぶ|というのは|とも言う|略称|正式名称|概要|とは何",
    "condition": "場合|とき|時|条件|禁止|必須|必ず|してはならない|不可|可能|できる|できない|限り|以上|以下|未満|超え|除く|対象",
    "procedure": STEPS,
    "specification": "\\|.*\\||仕様|形式|フォーマット|構成|項目|カラム|フィールド|型|単位|byte|バイト|文字|桁",
}
FULL_HITS = 2
IDENTIFIER, ANCHOR_TYPES, HYBRID_ALPHA = "[A-Za-z][A-Za-z0-9_.\\-/]{2,}", ["PRODUCT", "SERVICE", "BRAND"], 0.3


def answer_form(intent: Column, text: Column) -> Column:
    """How far a text reads like an answer to the intent: its distinct cues, two make 1; null for other intents."""
    out = F.lit(None).cast("double")
    for name, pattern in ANSWER_FORMS.items():
        hits = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?m){pattern}"), F.lit(0))))
        out = F.when(intent == name, F.least(F.lit(1.0), hits / FULL_HITS)).otherwise(out)
    return out


def lexical_anchor(text: Column, entity_types: Column) -> Column:
    """What ties a query to words: identifier, product or none."""
    wanted = F.array(*map(F.lit, ANCHOR_TYPES))
    return F.when(text.rlike(IDENTIFIER), "identifier").when(F.arrays_overlap(entity_types, wanted), "product").otherwise("none")


def fusion_weight(policy: Column | None = None) -> Column:
    """Share of the lexical score in a fusion: a caller's policy where it has a value, else the constant."""
    return F.lit(HYBRID_ALPHA) if policy is None else F.coalesce(policy, F.lit(HYBRID_ALPHA))
