"""op2 to op6: round trips, held-out accuracy, brute force, and odd inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kumiki.llm import chat
from kumiki.llm.decontaminate import clean_rows, decontaminate
from kumiki.llm.langid import identify
from kumiki.llm.queries import op3_langid, op6_toxicity
from kumiki.llm.template_tree import template_dedup
from kumiki.llm.toxicity import fit_rows, toxicity

SF = "/root/testdata/sf0.01"


@given(st.text(alphabet="\\#</turn>: \nab", max_size=40), st.text(alphabet="us:# \\", max_size=8))
def test_segments_round_trip(text, role):
    segment = f"### {chat.escape(role)}: {chat.escape(text)} </turn>\n"
    assert chat.parse_segment(segment) == (role, text)
    assert not re.search(r"(?<!\\)</turn>", chat.escape(text).replace("\\\\", ""))


def test_events_fold(spark):
    log = [
        (1, 1, "delta", 0, 1, "user", "hi"), (1, 2, "delta", 1, 1, "assistant", "he"), (1, 3, "delta", 1, 1, None, "llo"),
        (1, 4, "edit", 0, 1, None, "hey"), (1, 5, "delta", 2, 1, "user", "gone"), (1, 6, "regenerate", 1, 1, None, None),
        (1, 7, "delta", 1, 1, "assistant", "new"), (2, 1, "delta", 0, 1, None, None),
    ]
    events = spark.createDataFrame(log, chat.EVENTS).withColumn("segment", F.lit("clash"))
    got = [(r.conv_id, r.turn, r.role, r.text) for r in chat.messages(events).orderBy("conv_id", "turn").collect()]
    assert got == [(1, 0, "user", "hey"), (1, 1, "assistant", "new"), (2, 0, "", "")]


def test_chat_of_finished_turns(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (None, None, "user", "### x"), (3, 0, None, "")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(chat.turns_as_events(t))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_turns, got[1].loss_chars, got[1].turns_sha256) == (3, 2, sha("user\n\nassistant\nb\nassistant\nb\n"))
    assert got[1].loss_sha256 == sha("bb") and got[None].n_turns == 1 and got[3].n_turns == 1
    assert chat.read_back(chat.format_chats(chat.turns_as_events(t.limit(0)))).count() == 0


def test_language_is_told_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = op3_langid(spark, SF).join(docs, "doc_id").filter("held_out")
    assert found.filter("lang = lang_pred").count() >= 0.99 * found.count() > 0


def test_language_of_odd_texts(spark, docs_of):
    d = docs_of([(1, "the cat sat", "en", None, None), (2, "el gato está", "es", None, None), (3, None, None, None, None), (4, "123 !", "en", None, None), (None, "the cat", None, None, None), (2, "el gato está", "es", None, None)], extra=True)
    got = {(r.doc_id, r.lang_pred) for r in identify(d, F.col("doc_id").isNotNull()).collect()}
    assert {(1, "en"), (2, "es"), (3, "und"), (4, "und"), (None, "en")} == got
    assert {r.lang_pred for r in identify(d, F.lit(False)).collect()} == {"und"}
    assert identify(docs_of([]), F.lit(True)).count() == 0


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


@pytest.mark.parametrize("most", [10**6, 0])
def test_decontamination_equals_brute_force(spark, docs_of, most):
    items = [(1, "A b, c d e f g h i j k l"), (2, "short item"), (3, "x"), (4, None), (5, "..."), (6, "k l m n o p q r s t u"), (1, "short item")]
    texts = ["zz a b c d e f g h i J k zz", "b c d e f g h i j k l and short item", "short", "X x-x", None, "", "k l m n o p q r s t u " * 3, "a b c d e f g h i", "q " * 3000 + "short ITEM"]
    wins = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[s : s + 10]), set()).add(str(i))
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(0, texts[0], None, None, None), (None, "short item", None, None, None)]
    want = []
    for i, t, *_ in rows:
        w, hit, found = words(t), set(), set()
        for win, own in wins.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit.update(range(s, s + len(win)))
                    found |= own
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(docs_of(rows, extra=True), b, max_index=most).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert {r.doc_id for r in clean_rows(docs_of(rows), b).collect()} == {x[0] for x in want if not x[5]}
    assert not any(r.contaminated for r in decontaminate(docs_of(rows), b.limit(0)).collect())
    assert decontaminate(docs_of([]), b).count() == 0


def name(i: int) -> str:
    return "".join(chr(97 + int(c)) for c in str(i * 7919))


def test_templates_are_dropped_and_prose_stays(docs_of):
    rows = [(i, f"Page {i} of 90\nprose {name(i)} with {name(i + 7)} {name(i * i)}\nAll rights reserved by X{chr(97 + i % 26)}", None, None, None) for i in range(30)]
    rows += [(100, None, None, None, None), (101, "", None, None, None), (102, "Page 7 of 90", None, None, None), (102, "Page 7 of 90", None, None, None), (None, "x\n\ny", None, None, None)]
    got = defaultdict(list)
    for r in template_dedup(docs_of(rows, extra=True)).collect():
        got[r.doc_id].append((r.n_lines, r.n_removed, r.kept))
    assert got[5] == [(3, 2, f"prose {name(5)} with {name(12)} {name(25)}")]
    assert got[100] == got[101] == [(1, 0, "")] and got[102] == [(1, 1, "")] * 2 and got[None] == [(3, 0, "x\n\ny")]
    assert template_dedup(docs_of([])).count() == 0


def test_toxic_documents_are_told(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = op6_toxicity(spark, SF).join(labels, "doc_id")
    toxic = found.filter("toxic = 1")
    assert toxic.filter("is_toxic").count() >= 0.95 * toxic.count() > 0
    assert found.filter("toxic = 0 AND is_toxic").count() <= 0.01 * found.count()


def test_toxicity_of_odd_tables(spark, docs_of):
    labels = spark.createDataFrame([], "doc_id long, low_quality int, toxic int")
    d = docs_of([(1, None, None, None, None), (2, "", None, None, None), (None, "you fool", None, None, None)], extra=True)
    assert [(r.p_toxic, r.is_toxic) for r in toxicity(d, labels).collect()] == [(0.0, False)] * 3
    one = spark.createDataFrame([(1, 0, None), (2, None, 1), (2, 1, 0)], "doc_id long, low_quality int, toxic int")
    assert toxicity(d, one).count() == 3 and toxicity(docs_of([]), one).count() == 0
    assert fit_rows(d, labels).columns == d.columns


def test_toxicity_keeps_its_scale_in_a_sample(spark, docs_of):
    kinds = [("hmm maybe", 0, 280), ("hmm maybe", 1, 120), ("vile rubbish", 1, 180), ("good morning", 0, 2420)]
    rows = [(t, y) for t, y, n in kinds for _ in range(n)]
    d = docs_of([(i, t, None, None, None) for i, (t, _) in enumerate(rows)])
    labels = spark.createDataFrame([(i, i % 2, y) for i, (_, y) in enumerate(rows)], "doc_id long, low_quality int, toxic int")
    for sample in (10**6, 400):  # at a natural share of 0.1, three in ten of the borderline texts are toxic
        got = {r.text: r for r in toxicity(d, labels, sample=sample).join(d, "doc_id").groupBy("text").agg(F.avg("p_toxic").alias("p"), F.max("is_toxic").alias("most"), F.min("is_toxic").alias("least")).collect()}
        assert not got["hmm maybe"].most and 0.2 < got["hmm maybe"].p < 0.42
        assert got["vile rubbish"].least and not got["good morning"].most


def ppm_bits(train, text):
    """Code length of a text by the definition: method C with exclusion, contexts of 0 to 3 bytes over 230 symbols."""
    fold = lambda t: b"   " + "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).encode()
    alphabet = [b for b in range(256) if not 65 <= b <= 90]
    seen = defaultdict(Counter)
    for t in map(fold, train):
        for i in range(3, len(t)):
            for k in range(4):
                seen[t[i - k : i]][t[i]] += 1

    def p(context, depth):
        lower = p(context[1:], depth - 1) if depth else dict.fromkeys(alphabet, 1 / 230)
        c = seen[context]
        if not c:
            return lower
        n, rest = sum(c.values()), sum(v for b, v in lower.items() if b not in c)
        return {b: c[b] / (n + len(c)) if b in c else len(c) / (n + len(c)) * v / rest for b, v in lower.items()}

    t = fold(text)
    return -sum(math.log2(p(t[i - 3 : i], 3)[t[i]]) for i in range(3, len(t)))


@pytest.mark.parametrize("table_bytes", [96 << 20, 600])
def test_language_is_that_of_the_shortest_code(spark, docs_of, table_bytes):
    texts = {"el": ["το σπίτι", "ένα βιβλίο"], "en": ["The cat sat", "a mat"], "ja": ["猫が座る", "本"], "ru": ["кошка сидит", "дом"]}
    asked = ["cat", "βιβλίο", "дом кота", "猫の本", "zß", "Ünï сat", "cat дом", "q"]
    rows = [(None, t, k, None, None) for k, own in texts.items() for t in own]
    d = docs_of([(i, *r[1:]) for i, r in enumerate(rows)] + [(100 + i, t, None, None, None) for i, t in enumerate(asked)])
    got = {r.doc_id: r for r in identify(d, F.lit(True), table_bytes=table_bytes).collect()}
    for i, t in enumerate(asked):
        bits = {k: ppm_bits(own, t) for k, own in texts.items()}
        best = min(bits, key=bits.get)
        assert got[100 + i].lang_pred == best
        assert got[100 + i].score == pytest.approx(1 / sum(2 ** (bits[best] - b) for b in bits.values()), abs=1e-4)


def test_every_language_is_learnt(spark, docs_of):
    own = lambda k: " ".join(chr(0x4E00 + 40 * k + j) for j in range(12))
    rows = [(100 * k + j, own(k), f"l{k:03}", None, None) for k in range(90) for j in range(2 if k < 80 else 1)]
    for table_bytes in (96 << 20, 40_000):
        got = identify(docs_of(rows), F.lit(True), table_bytes=table_bytes)
        assert got.filter("lang_pred = format_string('l%03d', doc_id div 100)").count() == len(rows) == got.count()
