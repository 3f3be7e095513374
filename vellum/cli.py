"""Command line: index a repository, list the catalog, add to it."""

from __future__ import annotations

import argparse
import os
import sys

import yaml

from vellum.errors import VellumError
from vellum.logs import Console, JsonLines, Logger
from vellum.operators import events, sinks
from vellum.plans import index
from vellum.sources import catalog


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("vellum").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _parser() -> argparse.ArgumentParser:
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("-v", "--verbose", action="store_true", default=argparse.SUPPRESS)
    shared.add_argument("--config-dir", default=argparse.SUPPRESS)
    parser = argparse.ArgumentParser(prog="vellum", description="Index repositories of notes.", parents=[shared])
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("index", parents=[shared], help="index a repository")
    one.add_argument("repo")
    many = commands.add_parser("list", aliases=["ls"], parents=[shared], help="list repositories")
    many.add_argument("-j", "--json", action="store_true", help="enable JSON output")
    repo = commands.add_parser("repo", parents=[shared], help="work with repositories")
    below = repo.add_subparsers(dest="repo_command")
    init = below.add_parser("init", parents=[shared], help="initialize a repository in a directory")
    init.add_argument("directory")
    init.add_argument("-n", "--name", default="", help="name for the repo")
    init.add_argument("-a", "--application", default=catalog.DEFAULT_APPLICATION, help="application the repo belongs to")
    repo.set_defaults(show=repo.print_help)
    return parser


def _index(args, folder: str, log: Logger, out) -> None:
    repo = catalog.load(folder, args.repo)
    log.debug("cmd: index", **{"repo dir": repo.directory})
    plan = index.strategy(repo.application)
    found = index.index_directory(session(), repo, plan)
    try:
        texts = {r["path"]: r["json"] for r in found.documents.select("path", sinks.document_json(found.documents).alias("json")).toLocalIterator()} if args.verbose else {}

        def show(event) -> None:
            if event["kind"] == "file-indexed":
                out.write(f" - {event['kind']} {event['path']}\n" + (f"{texts[event['path']]}\n" if args.verbose else ""))

        events.deliver(found.events, show)
        log.info("indexed", **found.stats.first().asDict())
        for text in texts.values():
            log.debug("document", json=text)
    finally:
        found.close()


def _list(args, folder: str, log: Logger, out) -> None:
    if not catalog.names(folder) and not args.json:
        log.warning("no repos found", **{"config dir": folder})
        return
    repos = catalog.repos(session(), folder, log)
    out.write(sinks.repos_json(repos).first()[0] + "\n" if args.json else sinks.repos_table(repos))


def main(argv: list[str] | None = None, out=None) -> int:
    try:
        args = _parser().parse_args(argv)
    except SystemExit as e:
        return 0 if e.code in (0, None) else 1
    out, args.verbose, given = out or sys.stdout, getattr(args, "verbose", False), getattr(args, "config_dir", None)
    folder = catalog.config_dir(given)
    log = Logger(Console(level="DEBUG" if args.verbose else "INFO"))
    try:
        log.handlers.append(JsonLines(os.path.join(folder, "vellum.log")))
    except OSError as e:
        log.warning("could not open log file", err=str(e))
    log.debug(f"cmd: {args.command}", **{"config dir": folder})
    try:
        if args.command == "index":
            _index(args, folder, log, out)
        elif args.command in ("list", "ls"):
            _list(args, folder, log, out)
        elif args.repo_command == "init":
            log.debug("cmd: repo init", wrote=catalog.init(folder, args.directory, args.name, args.application).config)
        else:
            args.show()
    except (VellumError, OSError, ValueError, yaml.YAMLError) as e:
        log.error(str(e))
        return 1
    finally:
        for h in log.handlers[1:]:
            h.close()
    return 0


if __name__ == "__main__":
    sys.exit(main())
