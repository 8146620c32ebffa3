"""op10, op9 and op8 against brute force, with nulls, empty and very long texts, ties and repeated rows."""

import hashlib
import random
import re

import pytest

from kumiki.llm import jaccard_join as jj
from kumiki.llm.exact_dedup import dedup_rows, exact_dedup
from kumiki.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def corpus(seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(3, 200))) for _ in range(40)]
    texts = list(base)
    for t in base[:20]:
        w = t.split()
        for _ in range(3):
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = rng.choice(vocab).upper()
            texts.append(" ".join(v))
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    texts += [f"{a} {passage}\n{b}" for a, b in zip(base[20:30], base[30:40], strict=True)]
    texts += [None, "", " \t\n", "one", "One", "one two", "ONE two", "É é", "é É", passage, passage, " ".join(vocab) * 30]
    return [(i, t, "en", "s", 0) for i, t in enumerate(texts)]


def test_exact_dedup(docs_of):
    rows = corpus() + [(None, "one", None, None, None), (3, corpus()[3][1], "en", "s", 0)]
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(low(t), []).append(i)
    found = exact_dedup(docs_of(rows, extra=True), keep="largest").collect()
    assert len(found) == len(rows)
    for r in found:
        (text,) = [t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256]
        own = groups[text]
        assert (r.keep_id, r.group_size) == (max(x for x in own if x is not None), len(own))
    for text, own in groups.items():
        assert sum(r.kept for r in found if r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()) == 1, own


@pytest.mark.parametrize("fan_in", [2, 3])
def test_exact_dedup_smallest_and_rounds(docs_of, fan_in):
    found = exact_dedup(docs_of([(i, "same" if i % 2 else f"t{i}", None, None, None) for i in range(60)]), fan_in=fan_in, rounds=4)
    assert {(r.keep_id, r.group_size) for r in found.collect() if r.doc_id % 2} == {(1, 30)}


def test_exact_dedup_keeps_columns_and_one_of_repeated_rows(docs_of):
    d = docs_of([(1, "a", "en", "s", 1), (1, "a", "en", "s", 1), (2, "A", "de", "t", 2), (3, None, None, None, None), (4, "", None, None, None), (5, "b", None, None, None), (5, "b", None, None, None)])
    kept = dedup_rows(d)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5]


def shingles(t, k):
    w = WORD.findall(low(t))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(rows, k, percent):
    sets = {i: shingles(t, k) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and find(a) != find(b):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("k", "percent", "frequent"), [(3, 90, (4, 2)), (5, 80, (2, 1)), (3, 80, (10**9, 2))])
def test_jaccard_components(docs_of, monkeypatch, k, percent, frequent):
    monkeypatch.setattr(jj, "FREQUENT_DOCS", frequent[0])
    monkeypatch.setattr(jj, "BLOCK_COUNT", frequent[1])
    rows = corpus()
    found = jj.jaccard_components(docs_of([*rows, (None, "one two three", None, None, None)], extra=True), k=k, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == components(rows, k, percent)
    assert [r.component_id for r in found if r.doc_id is None] == [None]


def test_jaccard_pairs_with_much_in_common_meet_few_times(docs_of, monkeypatch):
    """Texts that share most of their signatures but no link: they meet in a few groups, not in each signature they share."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = []
    for _ in range(6):
        passage = [word() for _ in range(400)]
        for _ in range(5):
            rows.append((len(rows), " ".join(passage + [word() for _ in range(rng.choice((60, 110)))]), None, None, None))
    held = {}
    monkeypatch.setattr(jj, "written", lambda df, name, write=jj.written: held.setdefault(name, write(df, name)) if name == "members" else write(df, name))
    monkeypatch.setattr(jj, "dropped", lambda *tables: None)
    found = jj.jaccard_components(docs_of(rows), k=3, percent=80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == components(rows, 3, 80)
    members = held["members"]
    assert 0 < members.count() <= 2 ** 5 * len(rows) / 2


def test_jaccard_components_after_one_round(docs_of):
    """With fewer rounds of leaders more is left to the pairing of open members, which must find every link."""
    rows = corpus(8)
    found = jj.jaccard_components(docs_of(rows), k=3, percent=80, rounds=1).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == components(rows, 3, 80)


def test_one_of_each_keeps_columns(docs_of):
    d = docs_of([(1, "a b c d", "en", "s", 1), (2, "A B c d", "en", "s", 1), (3, "x y", None, None, None), (4, None, None, None, None)])
    kept = jj.one_of_each(d, k=3, percent=90)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def removed(rows, size):
    seen = {}
    words = [WORD.findall(t or "") for _, t, *_ in rows]
    for i, w in enumerate(words):
        for s in range(len(w) - size + 1):
            seen.setdefault(tuple(w[s : s + size]), []).append((i, s))
    hit = [set() for _ in words]
    for spots in seen.values():
        if len(spots) > 1:
            for i, s in spots:
                hit[i].update(range(s, s + size))
    return [(len(w), len(h), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in h).encode()).hexdigest()) for w, h in zip(words, hit, strict=True)]


@pytest.mark.parametrize("batches", [1, 3])
def test_substring_dedup(docs_of, batches):
    rows = corpus() + [(900, "a b c " * 40, None, None, None), corpus()[0]]
    found = substring_dedup(docs_of(rows, extra=True), size=35, batches=batches).collect()
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found)
    assert got == sorted((r[0], *x) for r, x in zip(rows, removed(rows, 35), strict=True))


def test_empty_tables(docs_of):
    d = docs_of([])
    assert exact_dedup(d).count() == dedup_rows(d).count() == substring_dedup(d).count() == jj.jaccard_components(d).count() == 0


def test_substring_dedup_past_compaction(docs_of):
    rows = corpus()
    found = substring_dedup(docs_of(rows), size=35, batches=6).collect()
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found)
    assert got == sorted((r[0], *x) for r, x in zip(rows, removed(rows, 35), strict=True))
