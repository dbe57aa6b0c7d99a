"""Command line and functions of a tool surface: python -m kbforge.cli {search,index,vacuum,rebuild,stats}.

Exit codes: 0 done, 1 the store or configuration can't be used, 2 the work failed or is incomplete.
"""

from __future__ import annotations

import argparse
import glob
import json
import sys
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbforge import config as settings
from kbforge import notify
from kbforge.operators import index, kb, output, search
from kbforge.operators.embed import HashedEmbedder
from kbforge.sources import files

MOST_RESULTS = 20


def _now() -> str:
    return datetime.now().isoformat(timespec="seconds")


def store_of(spark: SparkSession, config: dict, path: str | None = None) -> kb.Store:
    path = path or settings.section(config, "database").get("path")
    if not path:
        raise ValueError("no database path is configured")
    return kb.Store(spark, path)


def word_index(store: kb.Store) -> search.Bm25Index:
    """The word index of the store's current version, built once."""
    base = store.read().select(F.col("chunk_id").alias("id"), F.col("contextual_chunk").alias("text"))
    return search.Bm25Index.build(base, f"{store.path}/_words-{store.version()}")


def search_kb(store: kb.Store, questions: list[str], config: dict | None = None, top_k: int | None = None, hybrid: bool = True, reranking: bool = True, filters: dict | None = None) -> DataFrame:
    """Results of questions as rows (query_id, position, score, ...); top_k is held between 1 and MOST_RESULTS."""
    spark, limits = store.spark, settings.limits(config or {})
    base = store.read()
    if base is None:
        raise ValueError("the store is empty")
    embedder = HashedEmbedder(len(base.where("vector is not null").select("vector").first()[0]))
    asked = spark.createDataFrame(list(enumerate(questions)), "query_id long, text string").withColumn("qvec", embedder.column(F.col("text")))
    rows = base.withColumnRenamed("chunk_id", "id")
    return search.search(
        search.with_signals(asked), rows.drop("vector", "chunk_index"), rows.select("id", F.col("vector").alias("vec")), word_index(store) if hybrid else None,
        max(1, min(top_k or limits["default_top_k"], MOST_RESULTS)), limits["vector_limit"], limits["bm25_limit"], limits["fusion_limit"], reranking, filters,
    )


def index_paths(store: kb.Store, paths: list[str], project: str, config: dict, force: bool = False, anew: bool = False, notifier: notify.Notifier | None = None) -> dict:
    """Files, folders and globs into the store; paths outside the allowed folders raise SecurityError."""
    notifier = notifier or notify.from_config(config.get("notifications"))
    bases = settings.allowed_bases(config)
    found = [files.guarded(p, bases) for x in paths for p in (sorted(glob.glob(x, recursive=True)) or [x])]
    notifier.start(", ".join(paths))
    try:
        parts = [files.load(store.spark, p, project) for p in found]
        docs = parts[0]
        for p in parts[1:]:
            docs = docs.unionByName(p)
        docs = store.scratch(docs, "loaded")
        notifier.notify(notify.Progress("LOADING", "documents loaded"))
        rules = settings.tiers(config)
        good = docs.where("content is not null").dropDuplicates(["file_path"])
        work = {"rows": index.rebuild(store, good, _now(), **rules)} if anew else index.index(store, good, _now(), force=force, **rules)
        dead = {r["file_path"]: r["error"] for r in docs.where("error is not null").select("file_path", "error").limit(1000).collect()}  # shown to a person
        notifier.finish(True, json.dumps(work))
        return work | {"failed": dead}
    except Exception as e:
        notifier.finish(False, str(e))
        raise


def _human(report: dict) -> str:
    lines = [f"Scanned paths: {report['scanned_paths']}", f"Orphan paths: {len(report['orphan_paths'])} ({report['orphan_chunk_count']} chunks)"]
    lines += [f"  {p}" for p in report["orphan_paths"]]
    return "\n".join([*lines, f"Deleted paths: {len(report['deleted_paths'])} ({report['deleted_chunk_count']} chunks)"])


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kbforge")
    p.add_argument("--config")
    p.add_argument("--db-path")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--top-k", type=int)
    for flag in ("hybrid", "rerank", "no-context", "json"):
        s.add_argument(f"--{flag}", action="store_true")
    s.add_argument("--project")
    for name in ("index", "rebuild"):
        s = sub.add_parser(name)
        s.add_argument("paths", nargs="+")
        s.add_argument("--project", default="default")
        s.add_argument("--force", action="store_true")
    s = sub.add_parser("vacuum")
    mode = s.add_mutually_exclusive_group()
    mode.add_argument("--delete", action="store_true")
    mode.add_argument("--dry-run", action="store_true")
    s.add_argument("--match")
    s.add_argument("--json", action="store_true")
    s.add_argument("--live", help="folder whose files are live; without it every stored path is looked up")
    s = sub.add_parser("stats")
    return p


def live_files(store: kb.Store, folder: str | None = None) -> DataFrame:
    """(file_path) of live files: those of a folder, else the stored paths that exist, looked up on the executors."""
    if folder:
        reader = store.spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        return reader.load(folder).select(F.regexp_replace("path", r"^file:/*", "/").alias("file_path"))
    base = store.read()
    if base is None:
        return store.spark.createDataFrame([], "file_path string")

    @F.pandas_udf("boolean")
    def there(p):
        import os

        return p.map(os.path.exists).astype(bool)

    return base.where("file_path is not null").select("file_path").distinct().where(there("file_path"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        config = settings.load(args.config)
        spark = spark or SparkSession.builder.appName("kbforge").getOrCreate()
        store = store_of(spark, config, args.db_path)
    except Exception as e:
        print(f"ERROR: {e}", file=sys.stderr)
        return 1
    try:
        if args.command == "search":
            got = search_kb(store, [args.query], config, args.top_k, args.hybrid or args.rerank, args.rerank or settings.section(config, "retrieval").get("enable_reranking", True), {"source_project": args.project} if args.project else None).orderBy("position")
            if args.json:
                shown = got.drop("generated_context") if args.no_context else got
                print(json.dumps([json.loads(r[0]) for r in shown.select(F.to_json(F.struct("*"))).collect()], indent=2))  # at most MOST_RESULTS
            else:
                print("\n".join(r[0] for r in got.select(output.human(got, not args.no_context)).collect()) or "No results found.")
        elif args.command in ("index", "rebuild"):
            print(json.dumps(index_paths(store, args.paths, args.project, config, args.force, args.command == "rebuild")))
        elif args.command == "stats":
            print(json.dumps(output.stats(store, HashedEmbedder())))
        else:
            report = index.vacuum_report(store, live_files(store, args.live), args.delete, args.match)
            print(json.dumps(report, indent=2, sort_keys=True) if args.json else _human(report))
            if report["error"]:
                print(f"WARNING: {report['error']}", file=sys.stderr)
                return 2
    except Exception as e:
        print(f"ERROR: {args.command} failed: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
