"""Commands: fetch collections, ingest them into an index, search it, evaluate it with a report, serve it."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from mathloom.functions.reader import reader_maker
from mathloom.operators import evaluate
from mathloom.operators.index import Index, source_counts
from mathloom.operators.search import prepare_queries, search
from mathloom.serve import server
from mathloom.sources import fetch, files
from mathloom.sources.records import first_of_each
from mathloom.tables import ship_package

SOURCES = ("ape", "cm17k", "geometry3k", "math")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="mathloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest")
    for s in SOURCES:
        ingest.add_argument(f"--{s}", metavar="PATH")
    ingest.add_argument("--input", metavar="PATH", help="a path whose layout is recognised")
    ingest.add_argument("--limit", type=int)
    ingest.add_argument("--limit-each", type=int, help="items of each source at most")
    ingest.add_argument("--index", required=True)
    for name in ("search", "eval"):
        c = commands.add_parser(name)
        c.add_argument("--index", required=True)
        c.add_argument("--no-formula", action="store_true")
        c.add_argument(*(["text"] if name == "search" else ["--limit"]), **({} if name == "search" else {"type": int, "default": 200}))
    commands.choices["eval"].add_argument("--images", metavar="DIR", help="a folder of question images with a manifest")
    commands.choices["eval"].add_argument("--ocr", default="auto", help="reader of the images: auto, none, or an engine")
    serve = commands.add_parser("serve")
    serve.add_argument("--index", required=True)
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=8000)
    fetched = commands.add_parser("fetch")
    fetched.add_argument("folder")
    fetched.add_argument("addresses", nargs="+", metavar="NAME=URL")
    args = parser.parse_args(argv)
    if args.command == "fetch":
        print(fetch.fetch(dict(a.split("=", 1) for a in args.addresses), args.folder))
        return 0
    spark = SparkSession.builder.getOrCreate()
    ship_package(spark)
    if args.command == "ingest":
        named = [(getattr(args, s), s) for s in SOURCES if getattr(args, s)] + ([(args.input, None)] if args.input else [])
        items = first_of_each([files.read_source(spark, p, s, args.limit_each) for p, s in named], args.limit)
        Index.build(items).save(args.index)
        source_counts(spark.read.parquet(f"{args.index}/items")).show()
    elif args.command == "search":
        query = prepare_queries(spark.createDataFrame([(0, args.text)], "qid int, text string"), not args.no_formula)
        search(Index.load(spark, args.index), query, not args.no_formula).orderBy("place").show(truncate=80)
    elif args.command == "eval":
        index = Index.load(spark, args.index)
        evaluate.run_eval(index, args.limit, use_formula=not args.no_formula).show(vertical=True)
        if args.images:
            flags = evaluate.run_image_eval(index, spark, args.images, reader_maker(args.ocr), not args.no_formula)
            evaluate.summary(flags.selectExpr("*", "0.0 AS elapsed_s")).show(vertical=True)
    else:
        web = server(spark, Index.load(spark, args.index), args.host, args.port)
        print(f"http://{args.host}:{web.server_port}")
        web.serve_forever()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
