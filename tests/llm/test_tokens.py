"""op1 and op7 against the tokenizers library, and the lexicon against a dictionary."""

import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kumiki.llm.bpe import bpe
from kumiki.llm.lexicon import Lexicon, build
from kumiki.llm.pretokens import Encoder
from kumiki.llm.queries import tokenizer_file
from kumiki.llm.token_files import mapped, read_token_files, write_token_files

FILES = {"words": "word_bpe_49k.json", "pieces": "byte_bpe_50k.json"}
ODD = [
    None, "", " ", "\n\n", "It's we'll I'VE 'S ''s x'sy", "naïve ÉCOLE İ ſ K ẞ Σας", "漢字 かな 12½ ²", "<|endoftext|>a <|startoftext|>", "a\u00a0b\u0085c\x1cd\x00e",
    "“x” — y… e\u0301 ", "tab\t\t x  y   \n z", "9" * 50, "word " * 5000, "\U0001f600 ok",
]


@settings(deadline=None, max_examples=150)
@given(st.lists(st.text(max_size=40), max_size=8), st.sampled_from(sorted(FILES)))
def test_encoder_equals_the_library(texts, rule):
    e = ENCODERS.setdefault(rule, Encoder(tokenizer_file(FILES[rule]), rule))
    assert [x.tolist() for x in e.encode(texts)] == [x.ids for x in e.tok.encode_batch(texts, add_special_tokens=False)]


ENCODERS: dict = {}


@settings(deadline=None, max_examples=60)
@given(st.dictionaries(st.text(min_size=1, max_size=8), st.lists(st.integers(0, 2**31 - 1), max_size=4), max_size=40), st.lists(st.text(max_size=9), max_size=20))
def test_lexicon_is_a_dictionary(words, others):
    words = {w: v for w, v in words.items() if w.isprintable()}
    lex = Lexicon.of(build(words))
    asked = [*words, *others]
    assert lex.lookup(asked) == [words.get(w) for w in asked] if asked else True


def test_lexicon_shares_suffixes():
    words = {a + b: [1] for a in "abcdefgh" for b in ("ing", "ed", "er")}
    assert Lexicon.of(build(words)).states < 12


def expected(rule, texts):
    t = Tokenizer.from_file(tokenizer_file(FILES[rule]))
    return t, [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("words", [0, 500])
def test_bpe(docs_of, words):
    rng = random.Random(1)
    texts = ODD + [" ".join(rng.choice(["the", "Of", "zxq", "größe", "it's"]) for _ in range(rng.randint(0, 80))) for _ in range(40)]
    d = docs_of([(i if i != 3 else None, t, None, None, None) for i, t in enumerate(texts)], extra=True)
    got = bpe(d, tokenizer_file(FILES["words"]), outputs=("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"), words=words).collect()
    t, ids = expected("words", texts)
    want = []
    for i, x in zip([i if i != 3 else None for i in range(len(texts))], ids, strict=True):
        text = t.decode(x, skip_special_tokens=False)
        sha = hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()
        want.append((i, len(x), x, text, sha, hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_token_files(spark, docs_of, tmp_path):
    texts = ODD * 2
    rows = [(i * 7 % 29, t, None, None, None) for i, t in enumerate(texts)] + [(None, "null id", None, None, None)]
    folder = str(tmp_path / "out")
    manifest = write_token_files(docs_of(rows, extra=True), folder, tokenizer_file(FILES["pieces"]), end_id=2, partitions=3)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    _, ids = expected("pieces", [r[1] for r in order])
    want, at = [], 0
    for r, x in zip(order, ids, strict=True):
        x = [*x, 2]
        want.append((r[0], at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in read_token_files(spark, folder).collect()), key=lambda r: r[1])
    assert got == want and manifest["tokens"] == at and manifest["width"] == 2
    flat = np.concatenate([mapped(folder, p["part"], "ids", "<u2") for p in manifest["parts"]])
    assert flat.tolist() == [k for x in ids for k in [*x, 2]]
    assert json.loads((tmp_path / "out" / "manifest.json").read_text()) == manifest


def test_empty_tables(spark, docs_of, tmp_path):
    assert bpe(docs_of([]), tokenizer_file(FILES["words"])).count() == 0
    write_token_files(docs_of([]), str(tmp_path / "o"), tokenizer_file(FILES["pieces"]))
    assert read_token_files(spark, str(tmp_path / "o")).count() == 0


@pytest.mark.parametrize("rule", sorted(FILES))
def test_scripts_of_all_planes_take_the_fast_way(rule):
    e = Encoder(tokenizer_file(FILES[rule]), rule)
    own = [*range(0x250, 0x800, 3), *range(0x900, 0x1200, 7), *range(0x3040, 0x3100), *range(0x4E00, 0x4F00), *range(0xAC00, 0xAC80), 0x1F600, 0x20000]
    texts = [f"a{chr(c)}b {chr(c)} 1{chr(c)}'s {chr(c)}'t" for c in own]
    got = e.encode(texts)
    assert [x.tolist() for x in got] == [x.ids for x in e.tok.encode_batch(texts, add_special_tokens=False)]
    assert sum(x is None for x in e._fast(["Привет, мир!", "γειά σου", "日本語のテスト", "안녕 하세요", "😀 €5"])) == 0
