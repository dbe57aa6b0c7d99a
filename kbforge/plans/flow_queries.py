"""Queries of whole flows: dispatching chunkers, embedding, context, index rows, the search funnel, output forms; with the equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbforge.operators import chunk, context, index, logs, output, search
from kbforge.operators.embed import HashedEmbedder
from kbforge.plans import reference_queries as ref
from kbforge.runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
AT = "2026-01-01T00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- chunkers by suffix ---

_SUFFIX = "coalesce(nullif(regexp_extract(file_path, '(\\.[^./]+)$', 1), ''), '')"
_MD, _CODE = "('.md', '.txt')", "('.py', '.ts', '.js', '.sh')"
_P = ref._P
_LINE_STRIP = ref._STRIP


def _fold(name: str, source: str, where: str, parts: str, joint: str, kind: str) -> str:
    """Recursive fold of one chunker over `source` (doc_id, text, file_path), with first places of pieces, as `name` (doc_id, chunk_index, text, start_char)."""
    both = f"CASE WHEN cur = '' THEN {_P} ELSE cur || {joint} || {_P} END"
    brk = f"length({both}) // 4 > 384" + (f" AND cur <> '' AND {ref._GOOD}" if kind == "code" else "")
    restart = {
        "md": f"CASE WHEN contains(cur, chr(10) || chr(10)) THEN string_split(cur, chr(10) || chr(10))[-1] || {joint} || {_P} ELSE {_P} END",
        "code": f"array_to_string(string_split(cur, chr(10))[-3:], chr(10)) || chr(10) || {_P}",
        "generic": _P,
    }[kind]
    find, first = f"strpos(text, {_P}) - 1", "cur = '' OR start = 0" if kind == "generic" else "cur = ''"
    start = "0" if kind == "code" else f"CASE WHEN i = len(parts) THEN 0 WHEN ({brk}) OR {first} THEN {find} ELSE start END"
    out = f"(i = len(parts) OR ({brk})) AND length(cur) // 4 >= 100"
    return f"""{name}_s AS (SELECT doc_id, text, {parts} AS parts FROM {source} WHERE text <> '' AND {where}),
{name}_f AS (SELECT doc_id, text, parts, 0 AS i, '' AS cur, 0::BIGINT AS start, NULL::VARCHAR AS emit, 0::BIGINT AS emit_start, 0 AS k FROM {name}_s UNION ALL
SELECT doc_id, text, parts, i + 1, CASE WHEN i = len(parts) THEN '' WHEN {brk} THEN {restart} ELSE {both} END, {start}, CASE WHEN {out} THEN cur END, start, k + CASE WHEN {out} THEN 1 ELSE 0 END FROM {name}_f WHERE i <= len(parts)),
{name} AS (SELECT doc_id, CAST(k - 1 AS INTEGER) AS chunk_index, emit AS text, CAST(emit_start AS INTEGER) AS start_char FROM {name}_f WHERE emit IS NOT NULL)"""


def _chunk_sql(source: str) -> str:
    """CTEs ending in `chunked` (doc_id, chunk_index, text, start_char) of all three chunkers."""
    filtered = lambda x: f"list_filter(list_transform({x}, lambda x: {_LINE_STRIP}), lambda x: x <> '')"
    md = filtered("string_split_regex(text, '\\n\\n+')")
    gen = filtered(f"string_split(regexp_replace(text, '([.!?]){ref.WS}+', '\\1' || chr(1), 'g'), chr(1))")
    folds = [
        _fold("md", source, f"{_SUFFIX} IN {_MD}", md, "chr(10) || chr(10)", "md"),
        _fold("code", source, f"{_SUFFIX} IN {_CODE}", "string_split(text, chr(10))", "chr(10)", "code"),
        _fold("gen", source, f"{_SUFFIX} NOT IN {_MD} AND {_SUFFIX} NOT IN {_CODE}", gen, "' '", "generic"),
    ]
    return ",\n".join(folds) + ",\nchunked AS (SELECT * FROM md UNION ALL SELECT * FROM code UNION ALL SELECT * FROM gen)"


@query(f"WITH RECURSIVE {_chunk_sql('documents')} SELECT doc_id, chunk_index, text, start_char, CAST(start_char + length(text) AS INTEGER) AS end_char, CAST(length(text) // 4 AS INTEGER) AS token_count FROM chunked")
def chunk_dispatch(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id", "text", chunk.suffix_of(F.col("file_path")).alias("suffix"))
    return chunk.chunked(x, "doc_id", "text", "suffix")


# --- embedding and context ---

_HASHED = """h AS (SELECT doc_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS dim, CASE WHEN ('0x' || substr(md5(term), 9, 1))::BIGINT % 2 = 0 THEN 1 ELSE -1 END AS s FROM t),
v AS (SELECT doc_id, dim, sum(s) AS x FROM h GROUP BY ALL), n AS (SELECT doc_id, sqrt(sum(x * x)) AS l FROM v GROUP BY 1)"""


@query(f"WITH t AS (SELECT doc_id, unnest({ref._TERMS.format(c='text')}) AS term FROM documents), {_HASHED} SELECT doc_id, CAST(dim AS INTEGER) AS dim, round(x / l, 6) AS value FROM v JOIN n USING (doc_id) WHERE x <> 0 AND l > 0")
def embed_hashed(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "documents").select("doc_id", HashedEmbedder().column(F.col("text")).alias("v"))
    return v.select("doc_id", F.posexplode("v").alias("dim", "value")).where("value <> 0").withColumn("value", F.round("value", 6))


_CONTEXT = "'This is from ' || coalesce(file_path, 'Unknown') || ' in the ' || coalesce(project, 'Unknown') || ' project.'"
_NEEDED = ref._NEEDS.split("SELECT doc_id, chunk_index, ")[-1].rsplit(" AS needed", 1)[0]


@query(f"""WITH t AS (SELECT c.doc_id, chunk_index, c.text, file_path, project, regexp_replace(c.text, '^{ref.WS}+|{ref.WS}+$', '', 'g') AS x FROM chunks c JOIN documents d ON c.doc_id = d.doc_id),
n AS (SELECT *, {_NEEDED} AS needed FROM t)
SELECT doc_id, chunk_index, needed, CASE WHEN needed THEN {_CONTEXT} ELSE '' END AS generated_context, CASE WHEN needed THEN {_CONTEXT} || chr(10) || chr(10) || text ELSE text END AS contextual_chunk FROM n""")
def contextualised(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("doc_id", "chunk_index", "text").join(table(spark, d, "documents").select("doc_id", "file_path", "project"), "doc_id")
    return context.contextualised(c).select("doc_id", "chunk_index", "needed", "generated_context", "contextual_chunk")


# --- the index flow ---

_CLEAN = ref._redact_sql("strict").replace("FROM documents)", "FROM documents WHERE text IS NOT NULL)", 1)
_RISKS = ref._INJ_COUNTS.replace(ref._TEXT2, "sanitized")
_SCANNED = f"""z AS ({_CLEAN}), r0 AS (SELECT doc_id, sanitized, {_RISKS} FROM z WHERE trim(sanitized, ' ') <> ''),
scanned AS (SELECT r0.doc_id, sanitized AS text, d.file_path, d.project, {ref._RISK} AS security_risk, {ref._LEVEL.replace('file_path', 'd.file_path')} AS trust_level, sha256(sanitized) AS content_hash FROM r0 JOIN documents d ON r0.doc_id = d.doc_id)"""
_SCORE = "round(greatest(0.1, CASE trust_level WHEN 'TRUSTED' THEN 1.0 WHEN 'UNTRUSTED' THEN 0.5 ELSE 0.75 END - CASE security_risk WHEN 'CRITICAL' THEN 0.5 WHEN 'HIGH' THEN 0.3 WHEN 'MEDIUM' THEN 0.15 WHEN 'LOW' THEN 0.05 ELSE 0.0 END), 4)::DOUBLE"


def _scan(spark: SparkSession, d: str) -> DataFrame:
    return index.scanned(table(spark, d, "documents").select("file_path", "project", F.col("text").alias("content")))


@query(f"WITH {_SCANNED} SELECT file_path AS source_path, trust_level, {_SCORE} AS trust_score, content_hash, security_risk AS risk_level FROM scanned")
def provenance_records(spark: SparkSession, d: str) -> DataFrame:
    p = index.provenance(_scan(spark, d), AT, "engine")
    return p.select("source_path", "trust_level", "trust_score", "content_hash", F.col("security_scan_result.risk_level").alias("risk_level"))


@query(f"""WITH RECURSIVE {_SCANNED}, {_chunk_sql('scanned')},
t AS (SELECT c.doc_id, c.chunk_index, c.text, s.file_path, s.project, s.content_hash, s.trust_level, s.security_risk, regexp_replace(c.text, '^{ref.WS}+|{ref.WS}+$', '', 'g') AS x FROM chunked c JOIN scanned s ON c.doc_id = s.doc_id),
n AS (SELECT *, {_NEEDED} AS needed FROM t)
SELECT sha256(file_path || '|' || content_hash || '|' || chunk_index) AS chunk_id, chunk_index, text AS original_chunk, CASE WHEN needed THEN {_CONTEXT} || chr(10) || chr(10) || text ELSE text END AS contextual_chunk,
string_split(file_path, '/')[-1] AS source_file, project AS source_project, file_path, {_SUFFIX} AS file_type, content_hash, CAST(length(text) // 4 AS INTEGER) AS token_count, trust_level, {_SCORE} AS trust_score, security_risk FROM n""")
def index_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = index.rows_of(_scan(spark, d), AT)
    return rows.select("chunk_id", "chunk_index", "original_chunk", "contextual_chunk", "source_file", "source_project", "file_path", "file_type", "content_hash", "token_count", "trust_level", "trust_score", "security_risk")


@query("SELECT DISTINCT file_path FROM documents WHERE (file_path = 'docs' OR starts_with(file_path, 'docs/') OR starts_with(file_path, 'output/research/')) AND (ends_with(file_path, '.md') OR ends_with(file_path, '.txt'))")
def path_expansion(spark: SparkSession, d: str) -> DataFrame:
    return index.expanded(table(spark, d, "documents").select("file_path"), ["docs", "output/research/"], [".md", ".txt"])


# --- the search funnel ---

#: What is asked besides the words that are searched, by the query's number modulo the list's length; the SQL has the signals written out.
ASKED = ["What did I like in March 2025", 'notes on "Harbor Lantern" or the index Atlas', "last june, how do I feel about it", "", "changed on March 15, 2024"]


@query(ref._RERANK + f""", bb AS (SELECT query_id, id, rerank_score, final_rank, (query_id // 20) % 5 AS a, coalesce(content, '') || ' ' AS content FROM fin),
bo AS (SELECT *, CASE a WHEN 0 THEN CASE WHEN contains(lower(content), 'mar') THEN CASE WHEN contains(content, '2025') THEN 1.0 ELSE 0.8 END ELSE 0 END WHEN 2 THEN CASE WHEN contains(lower(content), 'jun') THEN 0.8 ELSE 0 END
WHEN 4 THEN CASE WHEN contains(lower(content), 'mar') THEN CASE WHEN contains(content, '15') THEN 1.0 ELSE 0.8 END ELSE 0 END ELSE 0 END::DOUBLE * 0.4::DOUBLE AS t,
CASE WHEN a IN (0, 2) THEN 0.5::DOUBLE * {ref._PREF} ELSE 0 END AS p, CASE a WHEN 0 THEN CASE WHEN contains(lower(content), 'march') THEN 0.4 ELSE 0 END WHEN 1 THEN CASE WHEN contains(lower(content), 'harbor lantern') THEN 0.6 WHEN contains(lower(content), 'atlas') THEN 0.4 ELSE 0 END
WHEN 4 THEN CASE WHEN contains(lower(content), 'march') THEN 0.4 ELSE 0 END ELSE 0 END::DOUBLE AS e FROM bb),
sc2 AS (SELECT query_id, id, final_rank, t AS temporal_boost, p AS preference_boost, CASE WHEN a IN (0, 4) THEN 0 ELSE e END AS entity_boost, round(rerank_score * (1 + t) * (1 + p) * (1 + CASE WHEN a IN (0, 4) THEN 0 ELSE e END), 6) AS score FROM bo)
SELECT query_id, id, final_rank, temporal_boost, preference_boost, entity_boost::DOUBLE AS entity_boost, score::DOUBLE AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, final_rank) AS INTEGER) AS position FROM sc2""")
def search_full(spark: SparkSession, d: str) -> DataFrame:
    asked = F.element_at(F.array(*map(F.lit, ASKED)), (F.floor(F.col("query_id") / 20) % len(ASKED) + 1).cast("int"))
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    # A query has words, a vector or both; without words it has no terms, and without a vector no neighbours.
    words = ref._queries(spark, d)
    q = words.join(e.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("qvec")), "query_id", "left").withColumn("asked", asked)
    q = search.with_signals(q, "asked").drop("asked")
    base = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("original_chunk"), F.lit(None).cast("string").alias("contextual_chunk"), F.lit("").alias("generated_context"))
    out = search.search(q, base, e, ref._index(spark, d))
    return out.select("query_id", "id", "final_rank", "temporal_boost", "preference_boost", "entity_boost", "score", "position")


# --- output ---


@query("""SELECT chunk_id, chr(10) || repeat('=', 80) || chr(10) || 'Result #' || (chunk_index + 1) || chr(10) || repeat('=', 80) || chr(10) || 'Source: ' || coalesce(source_file, 'Unknown') || chr(10) || 'Project: ' || coalesce(source_project, 'Unknown') || chr(10) || 'Type: ' || coalesce(file_type, 'Unknown')
|| chr(10) || chr(10) || 'Scores:' || coalesce(chr(10) || printf('   Rerank: %.4f', trust_score::DOUBLE), '') || chr(10) || chr(10) || 'Context:' || chr(10) || '   ' || coalesce(generated_context, '') || chr(10) || chr(10) || 'Content:' || chr(10) || '   '
|| CASE WHEN length(coalesce(original_chunk, '')) > 500 THEN original_chunk[1:500] || '...' ELSE coalesce(original_chunk, '') END AS shown FROM knowledge_base""")
def format_human(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "knowledge_base").withColumn("position", F.col("chunk_index") + 1).withColumn("rerank_score", F.col("trust_score").cast("double"))
    return r.select("chunk_id", output.human(r).alias("shown"))


@query("""SELECT chunk_id, CASE WHEN generated_context IS NULL THEN to_json({'type': 'document', 'source': {'type': 'text', 'media_type': 'text/plain', 'data': coalesce(original_chunk, '')}, 'title': coalesce(source_file, 'Unknown') || ' (' || coalesce(source_project, 'Unknown') || ')', 'citations': {'enabled': true}})
ELSE to_json({'type': 'document', 'source': {'type': 'text', 'media_type': 'text/plain', 'data': coalesce(original_chunk, '')}, 'title': coalesce(source_file, 'Unknown') || ' (' || coalesce(source_project, 'Unknown') || ')', 'citations': {'enabled': true}, 'context': generated_context}) END::VARCHAR AS doc FROM knowledge_base""")
def format_citations(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "knowledge_base")
    return r.select("chunk_id", output.citation(r).alias("doc"))


# --- logs ---


@query("SELECT sum(coalesce(tokens.total, 0))::BIGINT AS total_tokens, round(sum(cost_usd), 6) AS total_cost, CAST(floor(sum(coalesce(tokens.total, 0)) / 30.0) AS BIGINT) AS tokens_per_day, floor(round(sum(cost_usd), 6) / 30 * 100) / 100 AS cost_per_day FROM token_usage")
def log_daily_average(spark: SparkSession, d: str) -> DataFrame:
    t = logs.daily_average(logs.token_totals(table(spark, d, "token_usage")), "2025-06")
    return t.select("total_tokens", "total_cost", "tokens_per_day", "cost_per_day")


@query("SELECT row_id, severity, error_message FROM (SELECT * FROM errors ORDER BY row_id DESC LIMIT 10) ORDER BY row_id")
def log_last_errors(spark: SparkSession, d: str) -> DataFrame:
    return logs.last(table(spark, d, "errors").select("row_id", "severity", "error_message"), "row_id", 10)


@query("SELECT source, row_id, CAST(row_number() OVER (PARTITION BY source ORDER BY row_id) AS INTEGER) AS rn, count(*) OVER (PARTITION BY source) AS n FROM errors QUALIFY rn <= 5")
def log_first_per_source(spark: SparkSession, d: str) -> DataFrame:
    return logs.first_per_group(table(spark, d, "errors").select("source", "row_id"), "source", "row_id", 5).select("source", "row_id", "rn", "n")


@query("SELECT row_id, (row_id * 2000007 - 1) // 1000000 AS duration_ms FROM traces")
def log_duration(spark: SparkSession, d: str) -> DataFrame:
    start = F.col("row_id") * 1_000_003 + 1
    return table(spark, d, "traces").select("row_id", logs.duration_ms(start, F.col("row_id") * 3_000_010).alias("duration_ms"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
