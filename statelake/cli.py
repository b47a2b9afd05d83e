"""Command line: ``python -m statelake.cli --root DIR COMMAND ...``"""

from __future__ import annotations

import argparse
import json
import sys
from contextlib import nullcontext

from statelake.dataset import ARTIFACTS, EXPORTS, Catalog, Dataset
from statelake.plans.query import parse
from statelake.session import build_session


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="statelake")
    parser.add_argument("--root", required=True, help="folder or URI of the catalog")
    parser.add_argument("--dataset", "-d", help="dataset name")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("datasets")
    configure = commands.add_parser("configure")
    configure.add_argument("--title")
    configure.add_argument("--shards", type=int)
    configure.add_argument("--compression", choices=["gz", "zst"])
    for name in ("entities", "statements"):
        show = commands.add_parser(name)
        show.add_argument("--query", "-q", help="filter:schema=Person&...")
        show.add_argument("--rql", help="or(eq(schema,Company),...)")
        load = commands.add_parser(f"import-{name}")
        load.add_argument("path")
        load.add_argument("--origin")
    sql = commands.add_parser("sql")
    sql.add_argument("text")
    crawl = commands.add_parser("crawl")
    crawl.add_argument("source")
    crawl.add_argument("--policy", default="skip-path")
    crawl.add_argument("--glob")
    crawl.add_argument("--exclude-glob")
    for name in ("flush", "optimize", "unlock", "make", "files"):
        commands.add_parser(name)
    export = commands.add_parser("export")
    export.add_argument("kind", choices=EXPORTS)
    stream = commands.add_parser("stream", help="an export as one plain text")
    stream.add_argument("kind", choices=list(ARTIFACTS))
    stream.add_argument("--out", "-o", help="a local file; else standard output")
    for name in ("delete-entity", "delete-statement"):
        commands.add_parser(name).add_argument("id")
    for name in ("archive-head", "archive-get"):
        commands.add_parser(name).add_argument("checksum")
    commands.add_parser("archive-download").add_argument("target")
    return parser


def _lines(df) -> None:
    for row in df.toJSON().toLocalIterator():
        print(row)


def run(args: argparse.Namespace, catalog: Catalog) -> None:
    if args.command == "datasets":
        print("\n".join(catalog.names()))
        return
    if not args.dataset:
        raise SystemExit("--dataset is required")
    if args.command == "configure":
        print(catalog.update(args.dataset, title=args.title, shards=args.shards, compression=args.compression))
        return
    dataset: Dataset = catalog.dataset(args.dataset)
    if args.command in ("entities", "statements"):
        query = parse(args.query, args.rql)
        _lines(dataset.query(query) if args.command == "entities" else dataset.query_statements(query))
    elif args.command == "import-entities":
        dataset.import_entities(args.path, args.origin)
    elif args.command == "import-statements":
        dataset.import_statements(args.path, args.origin)
    elif args.command == "sql":
        _lines(dataset.sql(args.text))
    elif args.command == "crawl":
        print(dataset.archive.crawl(args.source, policy=args.policy, glob=args.glob, exclude_glob=args.exclude_glob).count())
    elif args.command == "files":
        _lines(dataset.archive.files())
    elif args.command == "export":
        print("made" if dataset.export(args.kind) else "fresh")
    elif args.command == "stream":
        with open(args.out, "wb") if args.out else nullcontext(sys.stdout.buffer) as out:
            dataset.stream_export(args.kind, out)
    elif args.command == "delete-entity":
        print(dataset.delete_entity(args.id))
    elif args.command == "delete-statement":
        print(dataset.delete_statement(args.id))
    elif args.command == "archive-head":
        print(json.dumps(dataset.archive.records(args.checksum)))
    elif args.command == "archive-get":
        for chunk in dataset.archive.stream(args.checksum):
            sys.stdout.buffer.write(chunk)
    elif args.command == "archive-download":
        print(dataset.archive.download(args.target).count())
    else:
        print(getattr(dataset, args.command)())


def main(argv: list[str] | None = None) -> None:
    args = build_parser().parse_args(argv)
    run(args, Catalog(build_session(), args.root))


if __name__ == "__main__":
    main(sys.argv[1:])
