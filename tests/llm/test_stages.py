"""The stages' row filters on odd tables: null and repeated ids, clashing columns, empty tables; and held-out toxicity."""

import random

import pytest

from kumiki.llm import jaccard_join as jj
from kumiki.llm.decontaminate import clean_rows
from kumiki.llm.exact_dedup import dedup_rows, exact_dedup
from kumiki.llm.queries import table, with_categories
from kumiki.llm.toxicity import fit_rows, toxicity

SF = "/root/testdata/sf0.1"
CLASH = ("__kid", "__sha", "__bad", "bad_id", "bad_text", "twice_id", "text_hash", "id", "tx", "__id", "sig", "stays", "one")


@pytest.fixture(scope="module")
def odd(spark):
    def make(rows):
        d = spark.createDataFrame(rows, "doc_id long, text string")
        for c in CLASH:
            d = d.selectExpr("*", f"'x' AS `{c}`")
        return d

    return make


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_clean_rows_judges_rows_by_their_own_text(spark, odd):
    items = spark.createDataFrame([(1, "bad words here")], "item_id long, text string")
    d = odd([(None, "bad words here"), (None, "fine text"), (1, "bad words here"), (1, "fine"), (2, None), (2, ""), (2, "")])
    kept = clean_rows(d, items)
    assert kept.columns == d.columns
    assert rows_of(kept) == sorted([(None, "fine text"), (1, "fine"), (2, None), (2, ""), (2, "")], key=str)
    assert clean_rows(odd([]), items).count() == 0 and clean_rows(d, items.limit(0)).count() == 7


def test_fit_rows_judges_rows_by_their_own_text(spark, odd):
    train = [(i, "vile rubbish" if i % 2 else "good morning") for i in range(100)]
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(100)], "doc_id long, low_quality int, toxic int")
    more = [(None, "vile rubbish"), (None, "good morning"), (0, "vile rubbish"), (1000, None), (1001, "")]
    d = odd(train + more)
    kept = fit_rows(d, labels)
    assert kept.columns == d.columns
    told = [r for r in rows_of(kept) if r[1]]
    assert told == sorted([r for r in train + more if r[1] == "good morning"], key=str)
    assert fit_rows(odd([]), labels).count() == 0 and fit_rows(d, labels.limit(0)).count() == len(train + more)


def test_dedup_rows_keeps_clashing_columns(odd):
    rows = [(1, "a"), (1, "A"), (1, "a"), (2, "b"), (2, "b"), (None, "c"), (None, "C"), (None, "c"), (3, None), (None, ""), (1, "z")]
    kept = dedup_rows(odd(rows))
    assert kept.columns == odd(rows).columns
    got = rows_of(kept)
    assert len(got) == 5 and {(i, (t or "").lower()) for i, t in got} == {(1, "a"), (2, "b"), (None, "c"), (3, ""), (1, "z")}
    assert all(r["__sha"] == "x" for r in kept.collect())
    assert dedup_rows(odd([])).count() == 0


def test_exact_dedup_keeps_one_row_over_many_partitions(odd):
    d = odd([(i % 7, "same") for i in range(400)]).repartition(40)
    found = exact_dedup(d, keep="largest").collect()
    assert sum(r.kept for r in found) == 1 and {(r.keep_id, r.group_size) for r in found} == {(6, 400)}


def test_one_of_each_keeps_one_row_of_repeated_ids(odd):
    near = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(1, near), (1, near + " 1"), (1, near), (2, near + " 2"), (1, "other words"), (None, near), (None, near), (3, None), (3, None)]
    kept = jj.one_of_each(odd(rows), k=3, percent=80)
    got = rows_of(kept)
    assert kept.columns == odd(rows).columns and len(got) == 6
    assert [r for r in got if r[0] == 1 and r[1] != "other words"] in ([(1, near)], [(1, near + " 1")])
    assert jj.one_of_each(odd([])).count() == 0


def test_links_of_repeated_ids(odd):
    w = "a b c d e f g h i j k l m n o p q r s t"
    found = jj.jaccard_components(odd([(1, w), (1, "v"), (2, w + " u")]), k=3, percent=90).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == [(1, 1, 1), (1, 18, 1), (2, 19, 1)]


@pytest.mark.parametrize(("rounds", "base"), [(1, True), (2, False)])
def test_a_large_group_of_near_copies(spark, rounds, base):
    rng = random.Random(rounds)
    own = [f"w{rng.randrange(3000)}" for _ in range(120)]
    rows = [(0, " ".join(own))] if base else []
    for i in range(1, 250):
        words = list(own)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    found = jj.jaccard_components(d, k=5, percent=80, rounds=rounds).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: find(i) for i in sets}


def test_toxicity_of_documents_that_were_not_learnt_from(spark):
    docs, labels = table(spark, SF, "documents"), with_categories(table(spark, SF, "labels"))
    found = toxicity(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1").withColumnRenamed("toxic", "y"), "doc_id")
    toxic, clean = found.filter("y = 1"), found.filter("y = 0")
    assert toxic.filter("is_toxic").count() >= 0.8 * toxic.count() > 0
    assert clean.filter("is_toxic").count() <= 0.01 * clean.count()
