"""Command line: python -m canopy --store FOLDER [--catalogue PATH] COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from canopy.plans import tools
from canopy.plans.engine import CollectionExists, CollectionNotFound, Engine
from canopy.session import build_session
from canopy.sources.export import FORMATS, render
from canopy.sources.http import LiveCatalogue
from canopy.sources.store import Store
from canopy.sources.works import Snapshot, read_raw


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="canopy")
    p.add_argument("--store", required=True, help="folder of the stored collections")
    p.add_argument("--catalogue", help="folder of raw records, or the address of a live catalogue (http...)")
    p.add_argument("--email", default="", help="contact that requests to a live catalogue name")
    p.add_argument("--catalogue-format", default="json", choices=["json", "parquet", "orc"])
    p.add_argument("--master", help="Spark master, by default that of the environment")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("inquire", help="build or find the collection of a query")
    c.add_argument("query")
    c.add_argument("--limit", type=int, default=tools.INQUIRE[0])
    c.add_argument("--force", action="store_true")
    c.add_argument("--name")
    c = sub.add_parser("query", help="the best works of a category")
    c.add_argument("category", choices=["root", "trunk", "leaf"])
    c.add_argument("--limit", type=int, default=5)
    c = sub.add_parser("search", help="matches and what connects them")
    c.add_argument("query")
    c.add_argument("--limit", type=int, default=tools.SEARCH[0])
    for name in ("show", "delete", "view"):
        sub.add_parser(name)
    sub.add_parser("list")
    sub.add_parser("export")
    for name, c in sub.choices.items():
        if name not in ("inquire", "list"):
            c.add_argument("--collection", default="", help="id or name; by default the latest")
        if name in ("query", "search", "export"):
            c.add_argument("--format", choices=FORMATS, default="json" if name == "export" else "simple")
        c.add_argument("--output", help="a file instead of standard output")
    return p


def run(engine: Engine, args: argparse.Namespace) -> str:
    show = lambda x: json.dumps(x, indent=2, ensure_ascii=False, default=str) + "\n"
    if args.command == "inquire":
        return show(tools.inquire(engine, args.query, args.limit, args.force, args.name))
    if args.command == "list":
        return show(tools.list_collections(engine))
    if args.command == "show":
        return show(tools.show_collection(engine, args.collection))
    if args.command == "delete":
        return show(tools.delete_collection(engine, args.collection))
    if args.command == "view":
        return show(tools.viewer_data(engine, args.collection))
    if args.command == "export":
        return tools.export_collection(engine, args.format, args.collection)
    id = engine.resolve(args.collection)["id"]
    tools.check_limit(args.limit)
    if args.command == "query":
        rows = engine.query_category(id, args.category, args.limit)
    else:
        found = engine.search(id, args.query, args.limit)
        if found is None:
            return ""
        rows = found.nodes
    return render(rows.withColumnRenamed("work_label", "label"), args.format)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = build_session("canopy", args.master)
    if args.catalogue and args.catalogue.startswith("http"):
        catalogue = LiveCatalogue(spark, args.catalogue, email=args.email)
    else:
        catalogue = Snapshot(read_raw(spark, args.catalogue, args.catalogue_format)) if args.catalogue else None
    try:
        text = run(Engine(spark, Store(spark, args.store), catalogue), args)
    except (CollectionNotFound, CollectionExists, ValueError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    if args.output:
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        sys.stdout.write(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
