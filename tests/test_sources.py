"""Readers, sinks and streams."""

import pytest
from pyspark.sql import functions as F

from kumiki.operators import lexicons as lx
from kumiki.sources import lexicons as src
from kumiki.sources import texts
from kumiki.streaming import streams


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_typed_lexicon(spark, tmp_path):
    p = put(tmp_path / "emotion.csv", "surface,base_emotion,polarity,intensity,keep_as_unit\n嬉しい,joy,positive,0.8,true\n")
    row = src.load(spark, p, "emotion").first()
    assert (row.surface, row.intensity, row.keep_as_unit, row.seq) == ("嬉しい", 0.8, True, 1)


@pytest.mark.parametrize("cell", ["1.5", "x"])
def test_bad_cell_names_the_row(spark, tmp_path, cell):
    p = put(tmp_path / "e.csv", f"surface,base_emotion,polarity,intensity,keep_as_unit\na,joy,positive,0.5,true\nb,joy,positive,{cell},true\n")
    with pytest.raises(src.LexiconError, match="row 2: bad intensity"):
        src.load(spark, p, "emotion")


def test_missing_column_and_file(spark, tmp_path):
    with pytest.raises(src.LexiconError, match="missing columns"):
        src.load(spark, put(tmp_path / "s.csv", "surface\na\n"), "stopwords")
    with pytest.raises(src.LexiconError):
        src.load(spark, str(tmp_path / "none.csv"), "stopwords")
    assert src.load_set(spark, str(tmp_path)) == {}


def test_user_entities_have_defaults_and_go_first(spark, tmp_path):
    user = src.load_user_entities(spark, put(tmp_path / "u.csv", "surface,type\nAP,\n ,X\nBQ,PRODUCT\n"))
    assert [(r.surface, r.type, r.priority) for r in user.orderBy("seq").collect()] == [("AP", "TERM", 100), ("BQ", "PRODUCT", 100)]
    base = user.filter("surface = 'AP'").withColumn("type", F.lit("OLD")).unionByName(user.filter("surface = 'BQ'").withColumn("surface", F.lit("CR")))
    assert {(r.surface, r.type) for r in src.apply_user_entities(base, user).collect()} == {("AP", "TERM"), ("BQ", "PRODUCT"), ("CR", "PRODUCT")}


def test_intensity_and_examples(spark, tmp_path):
    p = put(tmp_path / "n.tsv", "English Word\tEmotion\tScore\tJapanese\nhappy\tjoy\t0.9\t幸せ\nlow\tjoy\t0.1\t低い\nok\tjoy\t0.9\tOK\n")
    assert [r.surface for r in src.load_intensity_tsv(spark, p).collect()] == ["幸せ"]
    p = put(tmp_path / "x.csv", "word,emotion,intensity,examples\nw,喜び,0.5,a、b\nv,?,0.5,c\n")
    found = src.load_examples_csv(spark, p, {"喜び": "joy"}, "ex").orderBy("example_id").collect()
    assert [(r.example, r.example_id) for r in found] == [("a", "ex-00001-01"), ("b", "ex-00001-02")]


def test_kana_twins_and_views(spark):
    d = spark.createDataFrame([("ねこね", 1), ("イヌイ", 2), ("かき", 3)], "surface string, seq int")
    assert {r.surface for r in lx.kana_twins(d).collect()} == {"ねこね", "ネコネ", "イヌイ", "いぬい", "かき"}
    e = spark.createDataFrame([("A", "T", "x", ["B"], 1), ("B", "U", "y", [], 2), ("A", "V", "z", [], 3)], "surface string, type string, normalized string, aliases array<string>, seq int")
    assert {(r.key, r.type) for r in lx.entity_by_surface(e).collect()} == {("A", "V"), ("B", "U")}
    assert {(r.key, r.canonical) for r in lx.entity_canonical(e).collect()} == {("A", "x"), ("B", "y")}


def test_text_files_and_vocabulary_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in" / "a.txt", "one\n\ntwo\n")
    put(tmp_path / "in" / "b.csv", "no")
    assert sorted(r.text for r in texts.read_lines(spark, str(tmp_path / "in")).collect()) == ["one", "two"]
    assert texts.read_documents(spark, str(tmp_path / "in")).first().text == "one\n\ntwo\n"
    v = spark.createDataFrame([("a", 10, 3)], "piece string, id long, freq long")
    texts.save_vocab(v, str(tmp_path / "v"))
    back, head = texts.load_vocab(spark, str(tmp_path / "v"), "coarse")
    assert back.collect() == v.collect() and head["version"] == "1.0"
    with pytest.raises(ValueError, match="E601"):
        texts.load_vocab(spark, str(tmp_path / "v"), "fine")


def test_batch_and_stream_rate_limits_agree(spark, tmp_path):
    calls = spark.createDataFrame([("k", float(t)) for t in (0, 1, 2, 61, 62)] + [("j", 5.0)], "key string, ts double")
    batch = {(r.key, r.ts, r.admitted) for r in streams.rate_limit(calls, 2).collect()}
    calls.coalesce(1).write.parquet(str(tmp_path / "calls"))
    stream = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "calls"))
    q = streams.rate_limit_stream(stream, 2).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.key, r.ts, r.admitted) for r in spark.table("limited").collect()} == batch


def test_vocabulary_stream_only_appends(spark, tmp_path):
    rows = spark.createDataFrame([("a b a",), ("c",)], "text string")
    rows.write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema("text string").parquet(str(tmp_path / "t"))
    for _ in range(2):
        q = streams.vocab_sink(stream, str(tmp_path / "v"), F.split("text", " "), str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert {(r.piece, r.freq) for r in spark.read.parquet(str(tmp_path / "v")).collect()} == {("a", 2), ("b", 1), ("c", 1)}
