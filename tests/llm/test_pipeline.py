"""The whole pipeline against a brute-force version, and the fingerprint index over several calls."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from kumiki.llm.chat import escape, format_chats, parse_segment
from kumiki.llm.queries import tokenizer_file
from kumiki.llm.substring_dedup import FingerprintIndex, fingerprint_rows
from kumiki.llm.template_tree import template_dedup

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
BARE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
INSULTS = ("vermin", "scumbag", "filth")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    vocab = [f"{a}{b}{c}" for a in "bdgklmnprst" for b in "aeiou" for c in ("", "n", "r", "ll")]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    texts = [" ".join(prose(rng.randint(20, 120))) for _ in range(160)]
    for i in range(40):  # toxic ones
        words = prose(rng.randint(30, 90))
        for insult in INSULTS:
            words.insert(rng.randrange(len(words)), insult)
        texts.append(" ".join(words))
    texts += [t.upper() for t in texts[:10]] + texts[10:16]  # exact copies
    for t in texts[20:50]:  # near copies
        for _ in range(2):
            words = t.split()
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            texts.append(" ".join(words))
    items = [" ".join(prose(n)) for n in (25, 10, 4)]
    texts += [f"{' '.join(prose(30))}, {' '.join(items[0].split()[5:17]).title()}! {' '.join(prose(20))}", f"{' '.join(prose(9))} {items[1]}", f"x {items[2]}. y"]
    texts += ["", None, "   ", "naïve 日本語 текст"]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    toxic = [(i, 1, int(any(w in (t or "") for w in INSULTS))) for i, t in enumerate(texts)]
    spark.createDataFrame(toxic, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs, items


def brute_force(docs, items):
    left = {i: t for i, t, *_ in docs if not any(w in (t or "") for w in INSULTS)}
    best = {}
    for i, t in left.items():
        best[low(t)] = max(i, best.get(low(t), i))
    left = {i: left[i] for i in best.values()}

    def shingles(t):
        w = SPACED.findall(low(t))
        return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets, root = {i: shingles(t) for i, t in left.items()}, {i: i for i in left}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    left = {i: t for i, t in left.items() if find(i) == i}
    windows = set()
    for item in items:
        w = BARE.findall(low(item))
        windows |= {tuple(w[j : j + 10]) for j in range(max(1, len(w) - 9))}
    for n in {len(w) for w in windows}:
        for i in list(left):
            w = BARE.findall(low(left[i]))
            if any(tuple(w[j : j + n]) in windows for j in range(len(w) - n + 1)):
                del left[i]
    tok = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    tok.no_padding()
    tok.no_truncation()
    out = {}
    for i, t in left.items():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        out[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    return out


def test_run_equals_brute_force(spark, corpus):
    folder, docs, items = corpus
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect()}
    want = brute_force(docs, items)
    assert got == want and 150 < len(want) < len(docs) - 60


def fingerprints(spark, docs):
    d = spark.createDataFrame([(i, i, t or "") for i, t, *_ in docs], "id long, tx long, text string")
    return d.mapInArrow(lambda it: fingerprint_rows(it, 12, 5), "id long, tx long, n long, fp long, sha binary").filter("sha IS NULL").select("fp")


def test_index_opened_again_tells_what_recurs(spark, corpus, tmp_path):
    _, docs, _ = corpus
    parts = [docs[k::7] for k in range(7)]
    whole = FingerprintIndex(spark, fan_in=99)
    want = {r.fp for r in whole.add(fingerprints(spark, docs)).collect()}
    got = set()
    for k, part in enumerate(parts):  # a new index object for each batch, over one folder
        index = FingerprintIndex(spark, str(tmp_path / "index"), fan_in=3)
        assert sum(last - first + 1 for first, last in index.runs) == k
        got |= {r.fp for r in index.add(fingerprints(spark, part)).collect()}
        assert len(index.runs) < 3
    assert got == want and want


def test_a_merge_join_of_runs_needs_no_exchange(spark, corpus, tmp_path):
    _, docs, _ = corpus
    index = FingerprintIndex(spark, str(tmp_path / "index"), fan_in=9)
    for k in range(2):
        index.add(fingerprints(spark, docs[k::2]))
    a, b = index.runs.values()
    joined = a.select("fp").hint("merge").join(b.select("fp"), "fp", "left_semi")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_long_chats_and_many_lines(spark, docs_of):
    long = "a\\b ### </turn> : x " * 250_000
    segment = f"### user: {escape(long)} </turn>\n"
    assert parse_segment(segment) == ("user", long)
    with pytest.raises(ValueError):
        parse_segment("### user: a </turn>\n</turn>\n")
    events = spark.createDataFrame([(1, 0, "delta", 0, 1, "user", long)], "conv_id long, seq long, kind string, turn long, nth int, role string, text string")
    assert [parse_segment(r.segment)[1] for r in format_chats(events).collect()] == [long]
    lines = "\n".join(["Page 1 of 9"] * 60_000 + ["only here, and nothing else"])
    d = docs_of([(i, lines, None, None, None) for i in range(12)])
    found = template_dedup(d.withColumn("text", F.concat("text", F.lit("\nown "), "doc_id")))
    got = {(r.n_lines, r.n_removed, len(r.kept.split("\n"))) for r in found.collect()}
    assert {n for n, *_ in got} == {60_002} and all(removed >= 60_000 for _, removed, _ in got)
