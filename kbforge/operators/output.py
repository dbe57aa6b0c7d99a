"""Results for people and for citing models; statistics and health of a store.

A null file or project is shown as Unknown, a null content as empty; fields that a result lacks are left out of its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbforge.operators import kb
from kbforge.operators.embed import Embedder

SHOWN = 500


def shown(content: Column, n: int = SHOWN) -> Column:
    c = F.coalesce(content, F.lit(""))
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def human(results: DataFrame, context: bool = True, scores: bool = True) -> Column:
    """One text per result (source_file, source_project, file_type, original_chunk and, if there, scores and generated_context); `position` numbers it."""
    rule = "=" * 80
    have = lambda c: F.col(c) if c in results.columns else F.lit(None).cast("double")
    named = lambda c: F.coalesce(F.col(c), F.lit("Unknown"))
    lines = [F.lit("\n" + rule), F.concat(F.lit("Result #"), F.col("position").cast("string")), F.lit(rule)]
    lines += [F.concat(F.lit("Source: "), named("source_file")), F.concat(F.lit("Project: "), named("source_project")), F.concat(F.lit("Type: "), named("file_type"))]
    if scores:
        lines += [F.lit(""), F.lit("Scores:")]
        lines += [F.when(have(c).isNotNull(), F.format_string(f"   {t}: %.4f", have(c).cast("double"))) for c, t in (("rerank_score", "Rerank"), ("rrf_score", "RRF"))]
        lines += [F.when(have(c).isNotNull(), F.concat(F.lit(f"   {t}: "), have(c).cast("int").cast("string"))) for c, t in (("vector_rank", "Vector rank"), ("bm25_rank", "BM25 rank"))]
    if context and "generated_context" in results.columns:
        lines += [F.lit(""), F.lit("Context:"), F.concat(F.lit("   "), F.coalesce("generated_context", F.lit("")))]
    lines += [F.lit(""), F.lit("Content:"), F.concat(F.lit("   "), shown(F.col("original_chunk")))]
    return F.concat_ws("\n", *lines)


def citation(results: DataFrame, context: bool = True) -> Column:
    """JSON document with citations enabled: the whole original chunk as data, "file (project)" as title, the context if there is one."""
    title = F.concat(F.coalesce("source_file", F.lit("Unknown")), F.lit(" ("), F.coalesce("source_project", F.lit("Unknown")), F.lit(")"))
    source = F.struct(F.lit("text").alias("type"), F.lit("text/plain").alias("media_type"), F.coalesce("original_chunk", F.lit("")).alias("data"))
    fields = [F.lit("document").alias("type"), source.alias("source"), title.alias("title"), F.struct(F.lit(True).alias("enabled")).alias("citations")]
    if context and "generated_context" in results.columns:
        fields.append(F.col("generated_context").alias("context"))
    return F.to_json(F.struct(*fields))


def stats(store: kb.Store, embedder: Embedder) -> dict:
    """Numbers and settings of a store's components."""
    base = store.read()
    row = {"total_chunks": 0, "files": 0, "projects": 0} if base is None else kb.stats(base).first().asDict()
    return row | {"path": store.path, "version": store.version(), "embedder": embedder.name, "dimension": embedder.dim, "reranker": "lexical"}


def health(store: kb.Store, index_path: str | None = None) -> dict[str, bool]:
    """Whether a row with a vector can be read, and whether the word index is complete."""
    base = store.read()
    vector = base is not None and not base.where("vector is not null").limit(1).isEmpty()
    words = False
    if index_path:
        mark = store.spark._jvm.org.apache.hadoop.fs.Path(f"{index_path}/_ok")
        words = mark.getFileSystem(store.spark._jsc.hadoopConfiguration()).exists(mark)
    return {"vector_search": vector, "word_index": words}
