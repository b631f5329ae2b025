"""Command line: loc, context and graph, of a folder or a repository's URL."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from . import server
from .functions.tokens import parse_budget
from .plans import context, graph, loc
from .render import context as render_context
from .render import graph as render_graph
from .render import loc as render_loc
from .sources import config, corpus, git
from .sources.tables import checkouts


def emit(text: str, output: str | None) -> None:
    """Write to a file, whose folders are made, or to standard output."""
    if output is None:
        sys.stdout.write(text if text.endswith("\n") else text + "\n")
        return
    to = Path(output)
    to.parent.mkdir(parents=True, exist_ok=True)
    to.write_text(text)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lignum", description="Analyses of source trees on Spark.")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("mcp", help="serve the analyses as tools on standard input and output")
    made = commands.add_parser("corpus", help="write made-up source trees to be measured on")
    made.add_argument("--output", default="generated_corpus", metavar="FOLDER")
    made.add_argument("--clean", action="store_true", help="remove the folder first")
    made.add_argument("--datasets", nargs="+", choices=tuple(corpus.DATASETS))
    for name, text in (("loc", "count lines"), ("context", "build a context pack"), ("graph", "map dependencies")):
        p = commands.add_parser(name, help=text)
        p.add_argument("--path", help="folder; the working one by default")
        p.add_argument("--url", help="repository to clone")
        p.add_argument("--ref", help="branch, tag or commit of the URL")
        p.add_argument("--ignore", action="append", default=[], metavar="PATTERN", help="glob on file names or regex on paths; may be repeated")
        if name == "loc":
            continue
        p.add_argument("--focus", action="append", default=[], metavar="PATH")
        p.add_argument("--output", metavar="FILE")
        if name == "context":
            p.add_argument("--config", metavar="FILE")
            p.add_argument("--no-config", action="store_true")
            p.add_argument("--profile")
            p.add_argument("--list-profiles", action="store_true")
            p.add_argument("--diff", metavar="SPEC", help="working-tree, staged, unstaged or a base ref")
            p.add_argument("--budget", type=parse_budget, metavar="TOKENS", help="like 128000, 128k or 1m")
            p.add_argument("--compress", choices=("none", "signatures", "skeleton"))
            p.add_argument("--format", choices=tuple(render_context.FORMATS))
        else:
            p.add_argument("--depth", type=int)
            p.add_argument("--what-depends-on", metavar="PATH")
            p.add_argument("--format", choices=tuple(render_graph.FORMATS), default="json")
            p.add_argument("--extended-languages", action="store_true", help="also Go, C and C++ headers, JSX and TSX")
    return top


def _context(spark: SparkSession, args: argparse.Namespace, source: git.Source) -> None:
    found = config.find(source.path, args.config, args.no_config)
    if args.list_profiles:
        emit(render_context.profiles(found and source.display(found.path), list(found.profiles) if found else []), None)
        return
    given = config.Context(args.ignore, args.focus, args.diff, args.budget, args.compress, args.format, args.output)
    settings = config.merge(given, found, args.profile)
    output = settings.output
    if output and source.is_remote and not args.output and not args.config:
        output = config.rebased(output, source.root, Path.cwd())
    emit(render_context.FORMATS[settings.format or "markdown"](context.build(spark, source, settings)), output)


def run(args: argparse.Namespace, spark: SparkSession) -> None:
    if args.command == "mcp":
        server.serve(spark, sys.stdin, sys.stdout)
        return
    if args.command == "corpus":
        for path in corpus.write(args.output, args.datasets, args.clean):
            emit(str(path), None)
        return
    source = git.resolve(args.path, args.url, args.ref, checkouts(spark))
    if args.command == "loc":
        emit(render_loc.table(loc.analyze(spark, source.path, args.ignore, source.shown)), None)
    elif args.command == "context":
        _context(spark, args, source)
    else:
        if args.depth is not None and args.depth < 0:
            raise ValueError("the depth must be 0 or more")
        made = graph.build(spark, source.path, args.ignore, args.focus, args.depth, args.what_depends_on, args.extended_languages, source.shown)
        emit(render_graph.FORMATS[args.format](made), args.output)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        run(args, spark or SparkSession.builder.appName("lignum").getOrCreate())
    except (ValueError, OSError, git.GitError) as e:
        sys.stderr.write(f"error: {e}\n")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
