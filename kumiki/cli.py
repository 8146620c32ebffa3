"""Command line: single texts without a Spark session, vocabularies and evaluation of queries with one."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import date
from pathlib import Path

from kumiki.operators.analyze import VERSION, Plan
from kumiki.operators.normalize import normalize
from kumiki.operators.tokenizer import tokenize


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kumiki")
    sub = p.add_subparsers(dest="command", required=True)
    for name, about in {
        "version": "the schema's version", "analyze": "the plan of a text", "tokenize": "tokens of a text", "terms": "search terms of a text",
        "config": "the configuration in force", "normalize": "the normalised text", "query": "keywords and entities of a query", "chunk": "chunks of a document",
        "vocab-build": "a vocabulary of files", "vocab-encode": "ids of a text", "vocab-decode": "text of ids", "vocab-report": "coverage of a vocabulary",
        "serve": "the HTTP service", "eval": "run registered queries",
    }.items():
        one = sub.add_parser(name, help=about)
        if name in ("analyze", "tokenize", "terms", "normalize", "query", "chunk", "vocab-encode"):
            one.add_argument("text", help="the text, or - for standard input")
        if name in ("analyze", "query"):
            one.add_argument("--reference-date", type=date.fromisoformat)
        if name == "tokenize":
            one.add_argument("--fine", action="store_true")
            one.add_argument("--cascade", action="store_true")
        if name == "chunk":
            one.add_argument("--max-chars", type=int, default=400)
            one.add_argument("--min-chars", type=int, default=80)
        if name == "config":
            one.add_argument("--file")
        if name in ("vocab-build", "vocab-report"):
            one.add_argument("paths", nargs="+")
        if name.startswith("vocab-"):
            one.add_argument("--vocab", required=True)
        if name == "vocab-build":
            one.add_argument("--min-freq", type=int, default=2)
        if name == "vocab-decode":
            one.add_argument("ids", nargs="+", type=int)
        if name == "serve":
            one.add_argument("--port", type=int, default=8000)
            one.add_argument("--token")
        if name == "eval":
            one.add_argument("folder")
            one.add_argument("queries", nargs="*")
    return p


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("kumiki").getOrCreate()


def pieces_of(spark, paths: list[str]):
    from pyspark.sql import functions as F

    from kumiki.sources.texts import read_lines

    texts = [read_lines(spark, p) for p in paths]
    whole = texts[0]
    for more in texts[1:]:
        whole = whole.unionByName(more)
    return whole, F.split(F.trim("text"), "\\s+")


def vocab(a, spark) -> object:
    from pyspark.sql import functions as F

    from kumiki.operators import vocab as v
    from kumiki.sources.texts import load_vocab, save_vocab

    if a.command == "vocab-build":
        texts, pieces = pieces_of(spark, a.paths)
        built = v.build_vocab(v.count_pieces(texts, "text", pieces), a.min_freq)
        save_vocab(built.select("piece", "id", "freq"), a.vocab, min_freq=a.min_freq)
        return {"pieces": built.count()}
    known, _ = load_vocab(spark, a.vocab)
    if a.command == "vocab-encode":
        rows = [(0, i, w) for i, w in enumerate(a.text.split())]
        ids = v.encode(spark.createDataFrame(rows, "text_id long, pos int, piece string"), known).orderBy("pos", "sub")
        return [r["id"] for r in ids.collect()]
    if a.command == "vocab-decode":
        rows = spark.createDataFrame([(0, i, 0, k) for i, k in enumerate(a.ids)], "text_id long, pos int, sub int, id long")
        return v.decode(rows, known).first()["text"]
    texts, pieces = pieces_of(spark, a.paths)
    tokens = texts.select(F.monotonically_increasing_id().alias("text_id"), F.posexplode(pieces).alias("pos", "piece"))
    return v.vocab_report(tokens, known).first().asDict()


def run(argv: list[str] | None = None):
    """The result of a command, to be printed as JSON."""
    a = parser().parse_args(argv)
    if getattr(a, "text", None) == "-":
        a.text = sys.stdin.read()
    if a.command == "version":
        return {"schema": VERSION}
    if a.command == "config":
        from kumiki.sources.texts import find_config, load_config

        found = find_config(a.file)
        return {"file": str(found) if found else None, **load_config(found)}
    if a.command == "normalize":
        return normalize(a.text)[0]
    if a.command == "tokenize" and a.cascade:
        from kumiki.operators.cascade import cascade

        return [{"surface": s, "pos": p, "lemma": k} for s, p, _, _, k in cascade(normalize(a.text)[0])]
    if a.command in ("tokenize", "terms"):
        found = tokenize(normalize(a.text)[0], fine=getattr(a, "fine", False))
        if a.command == "terms":
            return list(dict.fromkeys(s.lower() for s, p, *_ in found if p not in ("助詞", "助動詞", "記号")))
        return [{"surface": s, "pos": p, "begin": b, "end": e} for s, p, b, e in found]
    if a.command in ("analyze", "query", "chunk", "serve"):
        from kumiki import api

        if a.command == "serve":
            api.server(api.Service(token=a.token), port=a.port).serve_forever()
        if a.command == "chunk":
            return api.chunked(a.text, a.max_chars, a.min_chars)
        if a.command == "query":
            return api.Service().post("/query", {"text": a.text, "reference_date": a.reference_date.isoformat() if a.reference_date else None})
        return Plan({}, {}, {}, a.reference_date, False)(a.text)
    spark = session()
    if a.command == "eval":
        from kumiki.plans import queries as plans

        known = plans.queries()
        folder = str(Path(a.folder).resolve()) if "://" not in a.folder else a.folder
        return {name: known[name](spark, folder).count() for name in a.queries or sorted(known)}
    return vocab(a, spark)


def main(argv: list[str] | None = None) -> int:
    print(json.dumps(run(argv), ensure_ascii=False, indent=2))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
