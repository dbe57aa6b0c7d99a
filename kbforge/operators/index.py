"""The index flow as one plan over all documents: redact, scan, quote, hash, chunk, add context, embed; provenance, audit and vacuum reports.

Null or blank contents give no rows; documents that strict mode blocks are quarantined, not indexed; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbforge.operators import chunk, context, kb, sanitize
from kbforge.operators.embed import Embedder, HashedEmbedder

#: Columns of the knowledge base.
COLUMNS = [
    "chunk_id", "chunk_index", "original_chunk", "contextual_chunk", "generated_context", "vector", "source_file", "source_project", "file_path", "file_type",
    "content_hash", "indexed_at", "last_updated", "token_count", "trust_level", "trust_score", "security_risk",
]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("category", T.StringType()), T.StructField("severity", T.StringType()), T.StructField("description", T.StringType()), T.StructField("matched_text", T.StringType()), T.StructField("position", T.IntegerType())])))
def injections(s):
    """All matches of injection patterns in a normalised text."""
    names = ("category", "severity", "description", "matched_text", "position")
    return s.map(lambda t: [dict(zip(names, m, strict=True)) for m in sanitize.matches_of(t or "")])


def scanned(docs: DataFrame, rules: list[dict] | None = None, default: str = "strict", strict: bool = False) -> DataFrame:
    """Add to documents (file_path, project, content): tier, content (redacted and with injections quoted), original_hash, content_hash, patterns, risk, blocked, trust."""
    d = docs.where("content is not null").withColumn("tier", sanitize.resolve_tier(F.col("file_path"), rules or [], default))
    d = d.withColumn("_clean", sanitize.redact(F.col("content"), F.col("tier"))).where(F.trim("_clean") != "")
    d = d.withColumn("_counts", sanitize.injection_counts(sanitize.normalize(F.col("_clean")))).withColumn("security_risk", sanitize.risk_level(F.col("_counts")))
    # Quoting and positions need Python; texts without a match skip both.
    bad = F.col("security_risk") != "CLEAN"
    d = d.withColumn("patterns", F.when(bad, injections(F.when(bad, sanitize.normalize(F.col("_clean"))))).otherwise(F.array()))
    d = d.withColumn("content", F.when(bad, sanitize.neutralized(F.when(bad, F.col("_clean")))).otherwise(F.col("_clean")))
    level = sanitize.trust_level(F.col("file_path"))
    d = d.withColumns({"original_hash": kb.content_hash(F.col("_clean")), "trust_level": level, "trust_score": sanitize.trust_score(level, F.col("security_risk"))})
    return d.withColumn("content_hash", kb.content_hash(F.col("content"))).withColumn("blocked", F.lit(strict) & F.col("security_risk").isin("CRITICAL", "HIGH")).drop("_clean", "_counts")


def rows_of(scan: DataFrame, at: str, embedder: Embedder | None = None, generate: Callable[[str], str] | None = None) -> DataFrame:
    """Knowledge-base rows of scanned documents that aren't blocked; chunks without a vector are left out."""
    embedder = embedder or HashedEmbedder()
    embedder.validate()
    d = scan.where(~F.col("blocked")).withColumn("file_type", chunk.suffix_of(F.col("file_path")))
    keep = ["file_path", "project", "file_type", "content_hash", "trust_level", "trust_score", "security_risk"]
    c = chunk.chunked(d.select(F.struct(*keep).alias("doc"), "content", "file_type"), "doc", "content", "file_type").select("doc.*", "chunk_index", F.col("text").alias("original_chunk"), "token_count")
    c = context.contextualised(c, "original_chunk", generate=generate).withColumn("vector", embedder.column(F.col("contextual_chunk"))).where("vector is not null")
    ident = F.sha2(F.concat_ws("|", "file_path", "content_hash", F.col("chunk_index").cast("string")), 256)
    return c.withColumns({"chunk_id": ident, "source_file": F.substring_index("file_path", "/", -1), "source_project": F.col("project"), "indexed_at": F.lit(at), "last_updated": F.lit(at)}).select(*COLUMNS)


def provenance(scan: DataFrame, at: str, indexer: str, source_type: str = "FILE") -> DataFrame:
    """One record a document: where it came from, its hashes, trust and scan result."""
    level = sanitize.trust_level(F.col("file_path"), F.lit(source_type))
    return scan.select(
        F.col("file_path").alias("source_path"), F.lit(source_type).alias("source_type"), F.lit(indexer).alias("indexer_id"), F.lit(at).alias("indexed_at"), level.alias("trust_level"),
        sanitize.trust_score(level, F.col("security_risk")).alias("trust_score"), F.col("original_hash").alias("content_hash"), F.col("content_hash").alias("sanitized_hash"),
        F.struct(F.col("security_risk").alias("risk_level"), (~F.col("blocked")).alias("is_safe"), F.col("patterns").alias("detected_patterns")).alias("security_scan_result"),
        F.create_map().cast("map<string,string>").alias("metadata"),
    )


def audit_rows(records: DataFrame) -> DataFrame:
    """Audit rows of provenance records: shortened hashes, patterns by category and severity; write them as appended JSON."""
    scan = F.col("security_scan_result")
    return records.select(
        F.col("indexed_at").alias("timestamp"), "source_path", scan["risk_level"].alias("risk_level"), F.size(scan["detected_patterns"]).alias("pattern_count"), scan["is_safe"].alias("is_safe"),
        "trust_level", "trust_score", F.substring("content_hash", 1, 16).alias("content_hash"), F.substring("sanitized_hash", 1, 16).alias("sanitized_hash"),
        F.transform(scan["detected_patterns"], lambda p: F.struct(p["category"].alias("category"), p["severity"].alias("severity"))).alias("patterns"),
    )


def write_audit(records: DataFrame, path: str) -> None:
    audit_rows(records).write.mode("append").json(path)


def index(store: kb.Store, docs: DataFrame, at: str, rules: list[dict] | None = None, default: str = "strict", strict: bool = False, embedder: Embedder | None = None, generate: Callable[[str], str] | None = None, force: bool = False, cap: int | None = None) -> dict[str, int]:
    """Documents (file_path, project, content) into the store as one commit; returns the number of documents by action.

    The lock is held from reading to committing. Of equal contents in a batch the last path owns the rows. force indexes unchanged documents again.
    """
    with store.lock():
        base = store.read()
        scan = scanned(docs, rules, default, strict)
        one = scan.groupBy("content_hash").agg(F.max_by(F.struct(*[c for c in scan.columns if c != "content_hash"]), "file_path").alias("d")).select("content_hash", "d.*")
        if base is None:
            known = one.withColumn("action", F.lit("new"))
        else:
            known = kb.classify(one, base, cap)
            if force:
                known = known.withColumn("action", F.when(F.col("action") == "unchanged", "changed").otherwise(F.col("action")))
        known = store.scratch(known, "classified")
        fresh = rows_of(known.where("action in ('new', 'changed')"), at, embedder, generate)
        store.write(fresh if base is None else kb.reconcile(base, known, at).unionByName(fresh.select(*base.columns)))
        return {r["action"]: r["n"] for r in known.where("not blocked").groupBy("action").agg(F.count("*").alias("n")).collect()}


def rebuild(store: kb.Store, docs: DataFrame, at: str, **options) -> int:
    """The whole table anew from documents, redacted like any other; returns the number of rows."""
    with store.lock():
        scan = scanned(docs, options.get("rules"), options.get("default", "strict"), options.get("strict", False))
        store.write(rows_of(scan, at, options.get("embedder"), options.get("generate")))
        return store.read().count()


def expanded(listing: DataFrame, wanted: list[str], suffixes: list[str] | None = None) -> DataFrame:
    """Paths of a file listing (file_path) to be indexed: those named in `wanted`, or below a folder named there, with one of the suffixes; once each, in order."""
    p = F.col("file_path")
    inside, ends = F.lit(False), F.lit(False)
    for w in wanted:
        w = w.rstrip("/")
        inside = inside | (p == w) | p.startswith(w + "/")
    for x in suffixes or [".md"]:
        ends = ends | p.endswith(x)
    return listing.where(inside & ends).select("file_path").distinct().orderBy("file_path")


def vacuum_report(store: kb.Store, live: DataFrame, delete: bool = False, match: str | None = None, most: int = 1_000_000) -> dict:
    """Orphans of the store, deleted if asked for; `match` restricts deletion only. Failures are named in `error`, with what was found until then."""
    out = {"orphan_paths": [], "orphan_chunk_count": 0, "deleted_paths": [], "deleted_chunk_count": 0, "scanned_paths": 0, "match_filter": match, "error": None}
    try:
        base = store.read()
        if base is None:
            return out | {"error": "table_not_initialized"}
        out["scanned_paths"] = base.where("file_path is not null").select("file_path").distinct().count()
        gone = kb.orphans(base, live, match)
        total = gone.agg(F.count("*"), F.coalesce(F.sum("chunks"), F.lit(0))).first()
        out["orphan_chunk_count"] = total[1]
        if total[0] > most:  # a report on the driver must stay bounded
            return out | {"error": "scan_row_limit_reached"}
        rows = gone.orderBy("file_path").collect()  # at most `most` paths
        out["orphan_paths"] = [r["file_path"] for r in rows]
        doomed = [r for r in rows if r["deletable"]]
        if delete and doomed:
            with store.lock():
                store.write(kb.vacuum(store.read(), live, match))
            out |= {"deleted_paths": [r["file_path"] for r in doomed], "deleted_chunk_count": sum(r["chunks"] for r in doomed)}
    except TimeoutError:
        out["error"] = "write_lock_timeout"
    except Exception as e:
        out["error"] = f"exception: {type(e).__name__}"
    return out


def entities(text: Column, gazetteer: dict[str, str]) -> Column:
    """Default recogniser: struct<text, label> of the listed names that the text holds."""
    found = [F.when(F.contains(text, F.lit(n)), F.struct(F.lit(n).alias("text"), F.lit(label).alias("label"))) for n, label in sorted(gazetteer.items())]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<struct<text:string,label:string>>")


def without_names(text: Column, path: Column, tier: Column, gazetteer: dict[str, str], allowed: list[str], skip_paths: list[str] | None = None) -> Column:
    """Names of people, organisations and places redacted in tier strict, but for allowed terms and skipped paths."""
    low = {a.lower() for a in allowed}
    keep = {n: label for n, label in gazetteer.items() if n not in allowed and n.lower() not in low}
    skip = F.lit(False)
    for p in skip_paths or []:
        skip = skip | F.contains(path, F.lit(p))
    return F.when((tier != "strict") | skip, text).otherwise(sanitize.redact_entities(text, entities(text, keep)))
