"""The command line: clean, restore, map, review, hook, serve, doctor."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from palimpsest import config as conf
from palimpsest.operators.vault import Vault
from palimpsest.plans import clean as plans
from palimpsest.plans import files, tools
from palimpsest.plans.rpc import Roots, Server


def session():
    """A session whose shuffle and spill files are encrypted."""
    from pyspark.sql import SparkSession

    s = SparkSession.builder.appName("palimpsest").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.io.encryption.enabled", "true").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def parser() -> argparse.ArgumentParser:
    home = Path.home() / ".palimpsest"
    p = argparse.ArgumentParser(prog="palimpsest", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, about: str) -> argparse.ArgumentParser:
        q = sub.add_parser(name, help=about)
        q.add_argument("--config")
        q.add_argument("--vault", default=str(home / "vault"))
        q.add_argument("--key", default=str(home / "key"))
        return q

    for name, about in (("clean", "write cleaned copies of files and folders, or clean standard input"), ("review", "write the decisions of a cleaning, or apply edited ones")):
        q = add(name, about)
        q.add_argument("paths", nargs="*" if name == "clean" else "+")
        q.add_argument("-r", "--recursive", action="store_true")
        g = q.add_mutually_exclusive_group()
        g.add_argument("-o", "--output-dir")
        if name == "clean":
            g.add_argument("--stdout", action="store_true")
        else:
            q.add_argument("--decisions", required=True, help="a JSON lines file: written if it isn't there, applied if it is")
    q = add("restore", "put the values back")
    q.add_argument("file", nargs="?")
    q.add_argument("--stdout", action="store_true")
    q = add("map", "the mappings of the vault")
    q.add_argument("action", choices=("list", "purge"))
    q.add_argument("--reveal", action="store_true")
    q.add_argument("--yes", action="store_true")
    add("hook", "reply to a tool call on standard input").add_argument("event", choices=("post-tool-use", "pre-tool-use"))
    q = add("serve", "answer JSON-RPC on standard input")
    g = q.add_mutually_exclusive_group(required=True)
    g.add_argument("--root", action="append")
    g.add_argument("--unconfined", action="store_true")
    add("doctor", "report what would be used")
    return p


def clean(a, spark, cfg, store) -> int:
    if not a.paths or a.paths == ["-"]:
        from palimpsest.functions.text import tidy_text

        df = spark.createDataFrame([(0, tidy_text(sys.stdin.read()))], "doc_id int, text string")
        sys.stdout.write(plans.clean(df, cfg, store).first().text)
        return 0
    if a.stdout:
        parts = files.parts_of(spark, a.paths, a.recursive)[0].select(files.F.struct("input_ord", "part_ord").alias("doc_id"), "text").collect()
        if len(parts) != 1:
            sys.exit("--stdout takes one document of one part")
        sys.stdout.write(plans.clean(spark.createDataFrame([(0, parts[0].text)], "doc_id int, text string"), cfg, store).first().text)
        return 0
    done, skipped = files.clean_files(spark, a.paths, cfg, store, a.output_dir, a.recursive)
    for r in done.orderBy("destination").toLocalIterator():
        print(f"{r.path} -> {r.destination}", file=sys.stderr)
    print(plans.summary(done).first()[0] + (f"; {skipped} skipped" if skipped else ""), file=sys.stderr)
    return 0


def review(a, spark, cfg, store) -> int:
    keys = ["id", "start", "end", "tag", "value", "context", "accepted"]
    if not Path(a.decisions).exists():
        found = files.review(files.parts_of(spark, a.paths, a.recursive)[0], cfg).select(*keys)
        with open(os.open(a.decisions, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w", encoding="utf-8") as f:
            for line in found.toJSON().toLocalIterator():
                f.write(line + "\n")
        return 0
    schema = "id struct<input_ord: long, part_ord: int, source: int>, start int, end int, accepted boolean"
    edited = spark.read.schema(schema).json(a.decisions)
    files.clean_files(spark, a.paths, cfg, store, a.output_dir, a.recursive, decisions=edited)
    return 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    cfg = conf.load(a.config)
    spark = session()
    store = Vault(spark, a.vault, a.key)
    if a.command == "clean":
        return clean(a, spark, cfg, store)
    if a.command == "review":
        return review(a, spark, cfg, store)
    if a.command == "restore":
        if a.file:
            text, _, unknown = files.restore_file(spark, a.file, store, in_place=not a.stdout)
        else:
            r = plans.restore(spark.createDataFrame([(0, sys.stdin.read())], "doc_id int, text string"), store).first()
            text, unknown = r.text, r.unknown
        if a.stdout or not a.file:
            sys.stdout.write(text)
        if unknown:
            print(f"{unknown} unknown placeholder(s) were left in place", file=sys.stderr)
    elif a.command == "map" and a.action == "list":
        rows = store.values().orderBy("tag", "seq") if a.reveal else store.entries()
        for r in rows.toLocalIterator():
            print(f"[[{r.tag}_{r.seq}]]\t{r.value if a.reveal else r.created_at}")
    elif a.command == "map":
        if not a.yes:
            sys.exit("purging forgets every value for good: add --yes")
        print(f"{store.purge()} mappings removed")
    elif a.command == "hook":
        message = sys.stdin.read()
        reply = tools.reply_after(spark, message, cfg, store) if a.event == "post-tool-use" else tools.reply_before(spark, message, store)
        print(reply or "", end="\n" if reply else "")
    elif a.command == "serve":
        for answer in Server(spark, cfg, store, Roots(a.root)).serve(sys.stdin):
            print(answer, flush=True)
    else:
        print(json.dumps({"config": str(a.config or conf.discover() or "defaults"), "vault": a.vault, "key": a.key, "mappings": store.entries().count(), "regions": cfg.regions}, indent=1))
    return 0


if __name__ == "__main__":
    sys.exit(main())
