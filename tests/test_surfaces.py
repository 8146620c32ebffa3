"""The cascade, the command line, the HTTP service and small sources."""

import json
import threading
import urllib.error
import urllib.request

import pytest
from hypothesis import given
from hypothesis import strategies as st

from kumiki import api, cli
from kumiki.operators.cascade import cascade
from kumiki.operators.retrieval import vector_candidates_sql, vector_ddl, vector_upsert
from kumiki.sources import lexicons as src


@given(st.text(alphabet="受け付申し込みドッキアーァネコ東京は行った猫 a1。っょ", max_size=24))
def test_cascade_spans_are_slices_in_order(text):
    found = cascade(text, {"東京": "名詞-固有名詞", "ネコ": "名詞-普通名詞"})
    assert all(text[b:e] == s for s, _, b, e, _ in found)
    assert all(x[3] <= y[2] for x, y in zip(found, found[1:], strict=False))
    assert "".join(t[0] for t in found) == text.replace(" ", "")


def test_cascade_steps():
    surfaces = lambda t, d=None: [x[0] for x in cascade(t, d)]
    assert surfaces("自然言語処理学", {"自然言語": "名詞-固有名詞"})[0] == "自然言語"
    assert [(x[0], x[4]) for x in cascade("ドッキドキ")] == [("ドッキドキ", "ドキドキ")]
    assert surfaces("受け付けは東京から") == ["受け付け", "は", "東京", "から"]
    assert [(x[0], x[1], x[4]) for x in cascade("美しかった")] == [("美しかった", "形容詞", "美しい")]


def test_commands(capsys, tmp_path):
    assert cli.run(["version"])["schema"]
    assert cli.run(["normalize", "ｶﾞ"]) == "ガ"
    assert [t["surface"] for t in cli.run(["tokenize", "東京は"])] == ["東京", "は"]
    assert [t["surface"] for t in cli.run(["tokenize", "--cascade", "東京は"])] == ["東京", "は"]
    assert cli.run(["terms", "東京はAB"]) == ["東京", "ab"]
    assert cli.run(["analyze", "3日前", "--reference-date", "2026-09-08"])["entities"][0]["value_str"] == "2026-09-05"
    assert cli.run(["query", "東京の店"])["keywords"] == ["東京", "店"]
    assert cli.run(["chunk", "a. b."])[0]["text"] == "a. b."
    config = tmp_path / "k.json"
    config.write_text('{"dictionaries": ["d"]}')
    assert cli.run(["config", "--file", str(config)])["dictionaries"] == [str(tmp_path / "d")]
    assert cli.main(["version"]) == 0 and "schema" in json.loads(capsys.readouterr().out)


def test_vocabulary_commands(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("the cat the dog\nthe cat\n")
    v = str(tmp_path / "v")
    assert cli.run(["vocab-build", "--vocab", v, str(tmp_path / "in")])["pieces"] > 2
    ids = cli.run(["vocab-encode", "--vocab", v, "the cat"])
    assert cli.run(["vocab-decode", "--vocab", v, *map(str, ids)]) == "thecat"
    assert cli.run(["vocab-report", "--vocab", v, str(tmp_path / "in")])["tokens"] == 6
    assert cli.run(["eval", "/root/testdata/sf0.001", "golden_rows"]) == {"golden_rows": 5}


def test_service():
    http = api.server(api.Service(token="t", per_minute=5, max_chars=50), port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{http.server_address[1]}"

    def call(path, body=None, token="t"):
        raw = body if isinstance(body, bytes) else None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(url + path, raw, {"Authorization": f"Bearer {token}"})
        try:
            with urllib.request.urlopen(request) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    assert call("/health", token="no") == (200, {"status": "ok"})
    assert call("/version", token="no")[0] == 401
    assert call("/tokenize", {"text": "東京は"})[1]["tokens"][0]["surface"] == "東京"
    assert call("/analyze", {"text": "x" * 51})[0] == 413
    assert call("/analyze", b"{")[0] == 400
    assert call("/none", {"text": "x"})[0] == 404
    assert call("/query", {"text": "a", "reference_date": "x"})[0] == 422
    assert call("/version")[0] == 429
    http.shutdown()


def test_limiter_counts_admitted_calls():
    limit = api.Limiter(2)
    assert [limit.allow("a", t) for t in (0, 1, 2, 60, 60.5, 61)] == [True, True, False, True, False, True]


def test_sources(spark, tmp_path):
    for name in ("x-2", "x-1"):
        (tmp_path / f"{name}.csv").write_text("word,emotion,intensity,examples\nw,喜び,0.5,a\n")
    found = src.load_examples_dir(spark, str(tmp_path), {"喜び": "joy"}, "x-*.csv")
    assert sorted(r.example_id for r in found.collect()) == ["1-00001-01", "2-00001-01"]
    with pytest.raises(src.LexiconError):
        src.load_examples_dir(spark, str(tmp_path), {}, "none-*")
    assert src.resolve_dictionary("a", "/b") == "/b/a" and src.resolve_dictionary("builtin:it", None, {"it": "/d"}) == "/d"
    with pytest.raises(src.LexiconError):
        src.resolve_dictionary("builtin:no")
    m = src.manifest({"a": spark.range(3), "b": spark.range(2)}, {"a": 3, "b": 5}).collect()
    assert [(r.name, r.rows, r.matches) for r in m] == [("a", 3, True), ("b", 2, False)]


def test_vector_statements():
    assert "vector(3)" in vector_ddl("t", 3)[0] and "hnsw" in vector_ddl("t", 3)[1]
    assert "ON CONFLICT (doc_id, chunk_id)" in vector_upsert("t") and "dates && %(dates)s" in vector_candidates_sql("t", 5, True)


def test_schemas():
    found = api.openapi()["paths"]["/analyze"]["post"]["responses"]["200"]["content"]["application/json"]["schema"]
    assert found["properties"]["tokens"]["items"]["properties"]["begin"] == {"type": ["integer", "null"]}
    assert "| tokens | list of struct |" in api.schema_markdown(api.ANALYSIS) and "## analysis.tokens" in api.schema_markdown(api.ANALYSIS)


def test_stages_can_be_left_out_and_tokenisers_given(spark):
    from kumiki.operators.analyze import analyze

    d = spark.createDataFrame([(1, "東京は 3日前")], "id int, text string")
    a = analyze(d, "id", "text", off=("entities", "chunks"), tokens=lambda t: [(t[:2], "名詞", 0, 2)]).first().analysis
    assert a.entities == [] and a.chunks == [] and [t.surface for t in a.tokens] == ["東京"]
    b = analyze(d, "id", "text", tokens=lambda t: 1 / 0).first().analysis
    assert [e.code for e in b.errors] == ["E201"] and len(b.tokens) == 6
