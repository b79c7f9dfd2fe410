"""The command line: init, index, search, status, errors, migrate, verify, types, graph and forget."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import os
import shlex
import subprocess
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from . import __version__, tools
from .operators import ops
from .plans.match import MatchError
from .sources import config
from .store import Store

COMMANDS = ("init", "index", "search", "status", "errors", "migrate", "verify", "types", "graph", "forget")
DEFAULT_STORE = "~/.local/share/palimpsest"


def with_command(argv: Sequence[str]) -> list[str]:
    """Put `search` before a bare query."""
    argv, i = list(argv), 0
    while i < len(argv) and argv[i].startswith("-"):
        i += 2 if argv[i] in ("--config", "--db") else 1
    if i < len(argv) and argv[i] not in COMMANDS:
        argv.insert(i, "search")
    return argv


def epoch(day: str | None, last_second: bool = False) -> int | None:
    if day is None:
        return None
    start = dt.datetime.strptime(day, "%Y-%m-%d").replace(tzinfo=dt.UTC)
    return int(start.timestamp()) + (86_399 if last_second else 0)


def human_bytes(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024:
            return f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} TB"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="palimpsest")
    p.add_argument("--version", action="version", version=f"%(prog)s {__version__}")
    p.add_argument("--config")
    p.add_argument("--db", default=os.environ.get("PALIMPSEST_DB"))
    sub = p.add_subparsers(dest="command")

    def command(name: str, *arguments: tuple) -> None:
        own = sub.add_parser(name)
        for names, options in arguments:
            own.add_argument(*names.split(), **options)

    flag = {"action": "store_true"}
    command("init", ("--non-interactive", flag), ("--out", {}), ("--force", flag))
    command("index", ("--quick", flag), ("--bg", flag))
    command(
        "search", ("query", {"nargs": "*"}), ("--mode", {"choices": ["bm25"], "default": "bm25"}), ("--source", {"action": "append"}), ("--since", {}), ("--until", {}), ("--register", {}), ("--role", {}),
        ("--limit", {"type": int, "default": 10}), ("--full", flag), ("--json", flag), ("--raw", flag), ("--open", {"metavar": "UID"}),
    )
    command("status", ("--json", flag))
    command("errors", ("--limit", {"type": int, "default": 50}), ("--json", flag))
    command("migrate", ("--status", flag), ("--baseline-from-existing", flag))
    command("verify", ("--deep", flag))
    command("types", ("action", {"choices": ["list"]}))
    command("graph", ("action", {"choices": ["entity"]}), ("name", {}), ("--limit", {"type": int, "default": 20}))
    command("forget", ("uid", {}), ("--dry-run", flag), ("--reason", {}), ("--json", flag))
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """Exit codes: 0 done, 1 nothing found or broken, 2 a bad request or no store."""
    own = list(sys.argv[1:] if argv is None else argv)
    args = parser().parse_args(with_command(own))
    args.own = own
    if not args.command:
        parser().print_help()
        return 0
    try:
        return run(args, spark)
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        return 130
    except Exception as e:
        if os.environ.get("PALIMPSEST_DEBUG"):
            raise
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


def run(args: argparse.Namespace, spark: SparkSession | None) -> int:
    if args.command == "init":
        out = Path(args.out or Path.home() / ".config" / config.FOLDER / config.FILE)
        if out.exists() and not args.force:
            print(f"{out} exists; --force overwrites it", file=sys.stderr)
            return 1
        out.parent.mkdir(parents=True, exist_ok=True)
        out.write_text(config.render(args.db or DEFAULT_STORE, config.suggestions(Path.home(), Path.cwd())), "utf-8")
        print(out)
        return 0
    if args.command == "index" and args.bg:
        # the same run in a process of its own, which outlives this one
        own = [a for a in args.own if a != "--bg"]
        print(subprocess.Popen([sys.executable, "-m", __spec__.name, *own], stdin=subprocess.DEVNULL, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True).pid)
        return 0
    sources = config.load(args.config) if args.command == "index" or args.config else {"database": None, "sources": []}
    spark = spark or SparkSession.builder.appName("palimpsest").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = Store(spark, os.path.expanduser(args.db or sources["database"] or DEFAULT_STORE))
    if args.command == "index":
        done = store.index_all(sources["sources"], args.quick)
        print(json.dumps(done, indent=1))
        return int(any(isinstance(v, str) for v in done.values()))
    if not store.exists():
        print(f"no store at {store.path}", file=sys.stderr)
        return 2 if args.command == "search" else 1
    return globals()[f"_{args.command}"](store, args)


def _open(store: Store, uid: str) -> int:
    """Show the file of a drawer in $EDITOR, or print its path where there is none."""
    try:
        found = store.searcher().fetch(ops.resolve(store.read("drawers"), uid)).first()
    except (ops.NotFound, ops.Ambiguous) as e:
        print(e, file=sys.stderr)
        return 2
    if not found["source_path"]:
        print(f"{found['drawer_uid']} is of no file", file=sys.stderr)
        return 1
    editor = os.environ.get("EDITOR")
    if editor and sys.stdout.isatty():
        return subprocess.call([*shlex.split(editor), found["source_path"]])
    print(found["source_path"])
    return 0


def _search(store: Store, args: argparse.Namespace) -> int:
    if args.open:
        return _open(store, args.open)
    query = " ".join(args.query)
    if not query.strip():
        return 2
    color = not args.json and sys.stdout.isatty() and not os.environ.get("NO_COLOR")
    try:
        found = store.searcher(color=color).search(query, limit=args.limit, raw=args.raw, full=args.full, source=args.source, since=epoch(args.since), until=epoch(args.until, True), register=args.register, role=args.role)
    except MatchError as e:
        print(e, file=sys.stderr)
        return 2
    columns = ("drawer_uid", "source", "source_id", "source_path", "role", "register", "thread_id", "parent_uid", "position_in_thread", "created_at", "content_hash", "score", "rank", "snippet", "content")
    rows = [r.asDict() for r in found.select(*columns).collect()]
    if args.json:
        print(json.dumps(rows, ensure_ascii=False, indent=1))
    for r in () if args.json else rows:
        day = dt.datetime.fromtimestamp(r["created_at"], dt.UTC).strftime("%Y-%m-%d")
        print(f"{r['rank']:>3}  {r['score']:.3f}  {day}  {r['drawer_uid']}\n     {r['snippet']}")
    return 0 if rows else 1


def _status(store: Store, args: argparse.Namespace) -> int:
    found = tools.status(store)
    print(json.dumps(found, indent=1) if args.json else "\n".join(f"{k}: {v}" for k, v in found.items()))
    return 0


def _errors(store: Store, args: argparse.Namespace) -> int:
    found = tools.errors(store, args.limit)
    print(json.dumps(found, indent=1) if args.json else "\n".join(f"{e['source']}  {e['source_path']}  {e['reason']}  {e['fix_hint'] or ''}" for e in found))
    return 0


def _migrate(store: Store, args: argparse.Namespace) -> int:
    if args.baseline_from_existing:
        store.baseline()
    elif not args.status:
        with store.writing():
            store.create()
    print(store.read("schema_version").orderBy("version").toPandas().to_string(index=False))
    return 0


def _verify(store: Store, args: argparse.Namespace) -> int:
    tables = {t: store.read(t) for t in ("drawers", "entities", "entity_types", "predicates", "relationships", "drawer_entity_mentions", "extract_pending", "extraction_runs")}
    found = ops.verify(tables["drawers"], store.index().lengths, tables if args.deep else None).where("n > 0").collect()
    for r in found:
        print(f"{r['check']}: {r['n']}")
    return int(bool(found))


def _types(store: Store, args: argparse.Namespace) -> int:
    for r in store.read("entity_types").orderBy("name").collect():
        print(f"{r['name']}  {r['status']}  {r['description'] or ''}")
    return 0


def _graph(store: Store, args: argparse.Namespace) -> int:
    found = tools.graph_query(store, args.name, limit=args.limit)
    print(json.dumps(found["entities"], indent=1))
    return 0 if found["ok"] else 1


def _forget(store: Store, args: argparse.Namespace) -> int:
    found = tools.forget(store, args.uid, args.dry_run, args.reason)
    print(json.dumps(found, indent=1) if args.json else found)
    return 0 if found["ok"] else 2


if __name__ == "__main__":
    sys.exit(main())
