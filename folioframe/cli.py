"""Commands over a library: ``python -m folioframe.cli --library PATH COMMAND``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .enrich import CONTENTS_ROLE, FakeClient, HttpClient
from .library import Library
from .operators import pages as P
from .operators.search import NOTHING, Filters, report
from .sources import paged


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="folioframe")
    parser.add_argument("--library", required=True)
    parser.add_argument("--host", help="a local model server; a deterministic stand-in without it")
    parser.add_argument("--models", nargs=2, default=("context", "embedding"), metavar=("GENERATE", "EMBED"))
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("ingest")
    one.add_argument("path")
    one.add_argument("--name")
    one.add_argument("--force", action="store_true")
    commands.add_parser("list")
    commands.add_parser("status")
    one = commands.add_parser("delete")
    one.add_argument("slug")
    one.add_argument("--yes", action="store_true")
    one = commands.add_parser("query")
    one.add_argument("question")
    one.add_argument("--book")
    one.add_argument("--author")
    one.add_argument("--source-type")
    one.add_argument("--mode", default="hybrid")
    one.add_argument("--top-k", type=int)
    one.add_argument("--expand", action="store_true")
    one = commands.add_parser("reindex")
    one.add_argument("--book")
    one = commands.add_parser("outline")
    one.add_argument("book_id", type=int)
    one = commands.add_parser("section")
    for name in ("book_id", "chapter_index", "section_index"):
        one.add_argument(name, type=int)
    for name in ("dump-toc", "extract-toc", "resolve-toc"):  # looks into a paged file's contents pages
        one = commands.add_parser(name)
        one.add_argument("path")
        one.add_argument("--out")
        one.add_argument("--entries", help="a JSON file of [title, declared page] pairs")
    return parser


def _book_id(library: Library, slug: str | None) -> int | None:
    if slug is None:
        return None
    row = library.table("books").where(F.col("slug") == slug).first()
    if row is None:
        raise KeyError(f"no book is called {slug!r}")
    return row["book_id"]


def _toc(spark: SparkSession, args, client) -> str:
    """The contents pages' text, a model's entries for them, or the physical pages of entries."""
    books = paged.decoded(spark.read.format("binaryFile").load(args.path))
    raw = books.select(F.col("path").alias("doc_id"), F.posexplode("pages").alias("_i", "text")).select("doc_id", (F.col("_i") + 1).alias("page_no"), "text")
    stripped = P.strip_running_lines(raw)
    region = P.toc_region(stripped)
    if args.command == "dump-toc":
        inside = stripped.join(region, "doc_id").where(F.col("page_no").between(F.col("first"), F.col("last")))
        return "\n\n".join(r["text"] for r in inside.orderBy("page_no").collect())
    if args.entries:
        with open(args.entries) as file:
            entries = [(str(t), int(p)) for t, p in json.load(file)]
        toc = raw.select("doc_id").distinct().withColumn("entries", F.from_json(F.lit(json.dumps([{"title": t, "declared_page": p} for t, p in entries])), "array<struct<title:string,declared_page:int>>"))
    else:
        model = args.models[0]
        toc = P.model_toc(stripped, region, lambda: lambda text: client().generate(model, CONTENTS_ROLE, text))
    if args.command == "extract-toc":
        return json.dumps([[e["title"], e["declared_page"]] for r in toc.collect() for e in r["entries"]], ensure_ascii=False)
    asked = toc.join(region, "doc_id").select("doc_id", "entries", (F.col("last") + 1).alias("search_from"))
    rows = P.resolve_pages(stripped, asked).orderBy("chapter_index").collect()
    return "\n".join(f"{r['page_start']}-{r['page_end']}\t{r['title']}" for r in rows)


def run(argv: list[str], spark: SparkSession) -> int:
    args = _parser().parse_args(argv)
    library, host = Library(spark, args.library), args.host
    client = (lambda: HttpClient(host)) if host else FakeClient
    try:
        if host and args.command in ("ingest", "query"):
            HttpClient(host).require(*args.models)
        if args.command == "ingest":
            print(library.ingest(args.path, client, args.name, args.force, models=tuple(args.models)))
        elif args.command in ("list", "status"):
            rows = library.status().orderBy("book_id").collect()
            for r in rows:
                shown = [r["book_id"], r["slug"], r["name"], r["source_type"]] if args.command == "list" else [r["slug"], r["n_chapters"], r["n_sections"], r["n_pending"], r["n_contextualized"], r["n_embedded"]]
                print(*shown, sep="\t")
        elif args.command == "delete":
            if not args.yes and input(f"delete {args.slug}? [y/N] ").strip().lower() != "y":
                return 1
            library.delete(args.slug)
        elif args.command == "query":
            filters = Filters(_book_id(library, args.book), args.author, args.source_type)
            found = report(library.search([args.question], client, args.models[1], args.mode, filters, args.top_k, args.expand)).first()
            print(NOTHING if found is None else found["report"])
        elif args.command == "reindex":
            print(library.rebuild_keyword_index(_book_id(library, args.book)))
        elif args.command == "outline":
            for c in library.outline(args.book_id).collect():
                print(c["chapter_index"], c["title"], sep="\t")
                for s in c["sections"]:
                    print("", s["section_index"], s["title"], s["page_start"], s["approx_tokens"], sep="\t")
        elif args.command == "section":
            print(library.section(args.book_id, args.chapter_index, args.section_index)["text"])
        else:
            text = _toc(spark, args, client)
            if args.out:
                with open(args.out, "w") as file:
                    file.write(text)
            else:
                print(text)
    except (KeyError, ValueError, RuntimeError) as e:
        print(f"error: {e.args[0] if e.args else e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:], SparkSession.builder.appName("folioframe").getOrCreate()))
