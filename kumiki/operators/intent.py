"""Intent of a text from rule hits and signals of affect and evaluation, with independent axes: one row a text, by CASE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kumiki.operators.semantic import lookup

# Scores, thresholds, entity types that can be reviewed, tails that negate a hit, and longer words that a
# rule's word may be the head of.
QUESTION, FELT, LEAST, TOLD = 0.35, 0.4, 0.45, 0.3
OBJECT_TYPES = ["PRODUCT", "SERVICE", "BRAND", "ORGANIZATION", "WORK"]
NEGATIVE_EMOTIONS = ["refusal", "irritation", "anger", "disgust", "sadness", "anxiety"]
NEGATING = "しない|しなかった|しません|じゃない|ではない|くない|くなかった|ない|なかった|ません|ず|ぬ"
HEADS = {"いつ": "いつも|いつか|いつまでも", "どう": "どうぞ|どうか|どうも|どうしても", "何": "何卒|何とぞ|何分|何より|何かと", "なに": "なにとぞ|なにより|なにかと"}
# What a text looks like that is personal, speaks of others, reports own business facts, or only seems to ask.
PERSONAL = (
    "私|俺|僕|ぼく|うち|自分|今日|昨日|今朝|今夜|さっき|先週|先日|週末|久しぶり|初めて|てきた|ちゃった|しちゃ|てしまった|できた|"
    "泣い|笑っ|焦っ|疲れ|眠|やった|ゲット|突破|作った|買った|行った|帰った|届いた|届か|落とした|消えた|空いた|驚いた|泣きそう|"
    "乗り換えた|戻した|積んだ|減らしたら|したら|してみた|覚えて|迷う|お金ない|しかない|"
    "母|父|祖母|祖父|おばあちゃん|おじいちゃん|家族|弟|妹|兄|姉|"
    "[wｗ]{1,}$|[!！…〜～]|[\\x{1F300}-\\x{1FAFF}☀-➿]"
)
FIRST_PERSON = "私|俺|僕|ぼく|うち|自分|わたし"
THIRD_PERSON = "(?:部長|課長|社長|先生|上司|同僚|彼女|彼|老人|少年|少女|青年|男|女|母|父|村人たち|皆|みんな|一同|田中|[一-龥]{1,3}(?:さん|氏|様|君|くん))(?:は|が|も)"
OWN_REPORT = "弊社|当社|我が社|売上|出荷|受注|利益|株価|市場|カバレッジ|稼働|目標未達"
FORMAL_END = "(?:ました|しております|いたしました|でした|ております|おります)[。]?$"
BUSINESS = "提案|見積|採用|契約|対応|納期|音響|請求|サーバー|価格|品質|スケジュール|会場|コスト|見送"
RHETORICAL = "すぎ(?:ん|る)[？?]|くない[？?]|ないの[？?]|何回|何度|なんで|なぜ|どこまでも|何も|じゃん[？?]?$|とか[？?]$|では[？?]$|かよ[？?]?$"
DECLARATIVE_END = "(?:[。．.!！]|です|ます|ました|でした|た|だ|る|い|ない|ね|よ|う|す|む|く|ぐ|ぶ|つ|ん|ろ|かった|ている|てる)$"


def rule_hits(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """text_id, intent, score: hits of each alternative times score and priority. Hits that a tail negates, that are the
    head of a longer word, or whose word the text quotes as a name (quoted, an array) don't count."""
    head = F.lit("")
    for word, longer in HEADS.items():
        head = F.when(F.col("term") == word, f"(?!{longer})").otherwise(head)
    each = rules.select("intent", (F.col("score") * F.greatest("priority", F.lit(1)) / 100).alias("w"), F.explode(F.split("pattern", "\\|")).alias("term"))
    each = each.withColumn("term", F.trim("term")).filter("term <> ''")
    each = each.withColumn("p", F.concat(head, F.lit("\\Q"), "term", F.lit(f"\\E(?!{NEGATING})")))
    pairs = texts.select("text_id", "text", "quoted").join(lookup(each), F.col("text").contains(F.col("term")))
    pairs = pairs.filter(~F.coalesce(F.array_contains("quoted", F.col("term")), F.lit(False)))
    hits = pairs.withColumn("n", F.regexp_count("text", F.col("p"))).filter("n > 0")
    return hits.groupBy("text_id", "intent").agg(F.round(F.sum(F.col("w") * F.col("n")), 9).alias("score"))


def shape(text: Column) -> dict[str, Column]:
    """What a text looks like, as flags."""
    t = F.trim(text)
    third = text.rlike(THIRD_PERSON)
    bare = F.regexp_replace(t, "[」』）)\"']+$", "")
    return {
        "personal": text.rlike(PERSONAL), "third_any": third, "third": third & ~text.rlike(FIRST_PERSON), "business": text.rlike(BUSINESS),
        "own": text.rlike(OWN_REPORT) & t.rlike(FORMAL_END) & ~text.rlike(PERSONAL), "formal": t.rlike(FORMAL_END), "rhetorical": text.rlike(RHETORICAL),
        "asked": F.rtrim(text).rlike("[?？]$"), "declarative": (F.char_length(t) >= 4) & ~t.rlike("[?？]$") & bare.rlike(DECLARATIVE_END),
    }


def classify(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """text_id, label, confidence, candidates (label, confidence; best first), axes (speech_act, evaluation, target, holder).

    texts: text_id, text, quoted (names in quotes), types (entity types), evaluation and evaluation_confidence (of words
    that evaluate), emotion, affect and affect_confidence (of words of emotion); any but the first two may be null.
    """
    named = ["question", "request", "support_request", "positive_feedback", "negative_feedback", "share_experience", "inform"]
    hits = rule_hits(texts, rules)
    wide = hits.groupBy("text_id").agg(
        *(F.max(F.when(F.col("intent") == i, F.col("score"))).alias(i) for i in named),
        F.collect_list(F.when(~F.col("intent").isin(named), F.struct(F.col("intent").alias("label"), F.col("score").alias("score")))).alias("others"),
    )
    rows = texts.join(wide, "text_id", "left").withColumns(shape(F.col("text")))
    zero = F.lit(0.0)
    c = F.col
    plus = lambda name, when, more: F.when(when, F.coalesce(c(name), zero) + more).otherwise(c(name))
    judged = F.coalesce(c("evaluation").isin("positive", "negative") & (c("evaluation_confidence") >= LEAST), F.lit(False))
    felt = ~judged & F.coalesce(c("affect").isin("positive", "negative", "mixed") & (c("affect_confidence") >= LEAST) & c("emotion").isNotNull(), F.lit(False))
    rows = rows.withColumns({
        "judged": judged, "felt": felt, "ruled": c("positive_feedback").isNotNull() | c("negative_feedback").isNotNull(),
        "object": F.coalesce(F.arrays_overlap("types", F.array(*map(F.lit, OBJECT_TYPES))), F.lit(False)),
        "stance": F.coalesce(c("evaluation").isin("positive", "negative"), F.lit(False)) | c("emotion").isNotNull(),
    })
    # Evaluation first; else affect: of others it is told, about business it is negative, about an object it is feedback.
    own = c("judged") & c("personal") & ~c("object")
    review = c("judged") & ~own
    told = c("felt") & c("third")
    refuses = c("felt") & ~told & c("emotion").isin(NEGATIVE_EMOTIONS) & ~c("personal") & c("business")
    about = c("felt") & ~told & ~refuses & c("object") & c("affect").isin("positive", "negative")
    shared = c("felt") & ~told & ~refuses & ~about & c("personal")
    plain = c("felt") & ~told & ~refuses & ~about & ~c("personal")
    rows = rows.withColumns({"own_": own, "review": review, "told": told, "refuses": refuses, "about": about, "shared": shared, "plain": plain})
    ev, af = FELT * c("evaluation_confidence"), FELT * c("affect_confidence")
    rows = rows.withColumns({
        "question": plus("question", c("asked"), F.lit(QUESTION)),
        "share_experience": plus("share_experience", c("own_") | c("shared"), F.when(c("own_"), ev).otherwise(af)),
        "positive_feedback": plus("positive_feedback", (c("review") & (c("evaluation") == "positive")) | (c("about") & (c("affect") == "positive")), F.when(c("review"), ev).otherwise(af)),
        "negative_feedback": plus("negative_feedback", (c("review") & (c("evaluation") == "negative")) | c("refuses") | (c("about") & (c("affect") == "negative")), F.when(c("review"), ev).otherwise(af)),
        "inform": plus("inform", c("told") | c("plain"), F.lit(TOLD)),
    })
    rows = rows.withColumn("question", F.when(c("stance") & c("rhetorical"), None).otherwise(c("question")))
    # Feedback that is a report, or a personal post without an object, moves.
    best = F.greatest("positive_feedback", "negative_feedback")
    to_inform = best.isNotNull() & (c("third") | c("own"))
    to_share = best.isNotNull() & ~to_inform & c("personal") & ~c("object") & ~c("business") & ~c("ruled")
    rows = rows.withColumns({"best": best, "to_inform": to_inform, "to_share": to_share})
    rows = rows.withColumns({
        "inform": plus("inform", c("to_inform"), c("best")),
        "share_experience": plus("share_experience", c("to_share"), c("best")),
        "positive_feedback": F.when(c("to_inform") | c("to_share"), None).otherwise(c("positive_feedback")),
        "negative_feedback": F.when(c("to_inform") | c("to_share"), None).otherwise(c("negative_feedback")),
    })
    # A request that leads and comes with a negative evaluation is a complaint, which ranks just above it.
    rest = F.greatest(*(F.coalesce(c(i), F.lit(-1.0)) for i in named if i != "request"), F.coalesce(F.array_max(F.transform("others", lambda o: o["score"])), F.lit(-1.0)))
    complains = (c("request") > rest) & c("judged") & (c("evaluation") == "negative") & ~c("third")
    rows = rows.withColumn("negative_feedback", F.when(complains, F.greatest(F.coalesce("negative_feedback", zero), c("request") + 0.01)).otherwise(c("negative_feedback")))
    own_scores = F.array_compact(F.array(*(F.when(c(i).isNotNull(), F.struct(F.lit(i).alias("label"), c(i).alias("score"))) for i in named)))
    scores = F.concat(own_scores, F.coalesce("others", F.array().cast("array<struct<label:string,score:double>>")))
    one = lambda name, v: F.array(F.struct(F.lit(name).alias("label"), F.lit(v).alias("score")))
    alone = (
        F.when(~c("declarative"), one("unknown", 0.0))
        .when(c("personal") & ~c("third_any") & ~c("formal"), one("share_experience", TOLD))
        .otherwise(one("inform", TOLD))
    )
    rows = rows.withColumn("scores", F.when(F.size(scores) > 0, scores).otherwise(alone))
    ordered = F.transform(F.array_sort(F.transform("scores", lambda s: F.struct((-s["score"]).alias("k"), s["label"].alias("l")))), lambda s: F.struct(s["l"].alias("label"), F.round(F.least(-s["k"], F.lit(1.0)), 3).alias("confidence")))
    rows = rows.withColumn("candidates", ordered).withColumn("label", c("candidates")[0]["label"])
    asks, wants = F.coalesce("question", zero), F.coalesce("request", zero) + F.coalesce("support_request", zero)
    speech = F.when((asks > 0) & (asks >= wants), "question").when(wants > 0, "request").otherwise("statement")
    evaluation = F.when(c("judged"), c("evaluation")).otherwise("none")
    reviews = c("label").isin("positive_feedback", "admiration", "negative_feedback", "pricing_complaint")
    target = F.when(~c("judged"), "none").when(c("object"), "object").when((c("label") == "share_experience") | (c("personal") & ~reviews), "self").otherwise("object")
    holder = F.when(c("third"), "third_party").otherwise("speaker")
    axes = F.struct(speech.alias("speech_act"), evaluation.alias("evaluation"), target.alias("target"), holder.alias("holder"))
    return rows.select("text_id", "label", c("candidates")[0]["confidence"].alias("confidence"), "candidates", axes.alias("axes"))
