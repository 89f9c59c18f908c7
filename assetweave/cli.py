"""Command line: ``python -m assetweave.cli <command>``. One JSON document, or lines for people, on standard output."""

from __future__ import annotations

import argparse
import json
import sys

from .errors import EXIT_CODES, AssetError


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="assetweave")
    out.add_argument("--json", action="store_true")
    out.add_argument("--project", default=".")
    commands = out.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index")
    index.add_argument("roots", nargs="*")
    index.add_argument("--retry-failed", action="store_true")
    for name, what in (("search", "text"), ("similar", "reference")):
        c = commands.add_parser(name)
        c.add_argument(what)
        c.add_argument("--type", dest="kind")
        c.add_argument("--limit", type=int, default=10)
        c.add_argument("--in", dest="within")
    commands.add_parser("inspect").add_argument("path")
    commands.add_parser("status").add_argument("--no-check", action="store_true")
    sheet = commands.add_parser("contact-sheet")
    sheet.add_argument("items", nargs="*")
    sheet.add_argument("--search")
    sheet.add_argument("--type", dest="kind", default="image")
    sheet.add_argument("--limit", type=int, default=20)
    sheet.add_argument("--thumb", type=int)
    sheet.add_argument("--columns", type=int)
    sheet.add_argument("--output")
    commands.add_parser("models")
    return out


def run(args: argparse.Namespace, project) -> dict:
    match args.command:
        case "index":
            return project.index(*args.roots, retry_failed=args.retry_failed)
        case "search":
            return project.search(args.text, kind=args.kind, limit=args.limit, within=args.within)
        case "similar":
            return project.similar(args.reference, kind=args.kind, limit=args.limit, within=args.within)
        case "inspect":
            return project.inspect(args.path)
        case "status":
            return project.status(check=not args.no_check)
        case "contact-sheet":
            return project.contact_sheet(args.items, search=args.search, kind=args.kind, limit=args.limit, thumb=args.thumb, columns=args.columns, output=args.output)
        case _:
            return project.model_status()


def human(document: dict) -> str:
    if "results" in document:
        return "\n".join(f"{r['rank']:>3}  {r['score']:.4f}  {r['path']}  {r['summary']}" for r in document["results"]) or "No results"
    return "\n".join(f"{k}: {v}" for k, v in document.items() if k != "schemaVersion")


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return 0 if e.code == 0 else EXIT_CODES["USAGE_ERROR"]
    from pyspark.sql import SparkSession

    from .plans.commands import Project

    spark = SparkSession.builder.appName("assetweave").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        document, code = run(args, Project(spark, args.project)), EXIT_CODES["OK"]
        if document.get("failed") and args.command == "index":
            code = EXIT_CODES["PARTIAL_FAILURE"]
    except AssetError as e:
        document, code = e.document(), e.exit_code
        if not args.json:
            print(e, file=sys.stderr)
            return code
    except KeyboardInterrupt:
        return EXIT_CODES["INTERRUPTED"]
    print(json.dumps(document) if args.json else human(document))
    return code


if __name__ == "__main__":
    sys.exit(main())
