"""Views of the test tables that stand for an archive, its index, notes and events.

Each is SQL that Spark and DuckDB read alike, so a query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_event": """
SELECT 'user-' || CAST(user_id AS STRING) AS project, event_type AS subfolder, CAST(ts AS DATE) AS event_date,
       CAST(CAST(ts AS DATE) AS STRING) || ' ' || event_type || '-' || CAST(event_id AS STRING) AS note_filename,
       'p' || CAST(CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) % 7 AS STRING) AS party, event_id AS ord
FROM events""",
    "v_file": """
SELECT '/archive/' || source || '/' || lang || '/' || CAST(doc_id AS STRING) || CASE WHEN doc_id % 5 = 0 THEN '.pdf' WHEN doc_id % 5 = 1 THEN '.mp4' WHEN doc_id % 5 = 2 THEN '.xyz' ELSE '.txt' END AS path,
       CAST(octet_length(encode(text)) AS BIGINT) AS size, 1700000000 + doc_id * 3600 AS mtime, substr(sha256(text), 1, 16) AS fingerprint, text, doc_id AS ord, source, lang
FROM documents""",
    "v_index": """
SELECT CASE WHEN ord % 5 = 0 THEN '/moved' || path ELSE path END AS source_path,
       CASE WHEN ord % 7 = 0 THEN 'x' || substr(fingerprint, 2, 15) ELSE fingerprint END AS fingerprint,
       'arch/' || source || '/' || lang || '/2024-01-' || lpad(CAST(ord % 28 + 1 AS STRING), 2, '0') || ' note-' || CAST(ord AS STRING) || '.md' AS note_path, ord
FROM v_file WHERE ord % 4 <> 0""",
    "v_sample": """
SELECT source AS folder, ord, fingerprint, '/archive2' AS parent FROM v_file WHERE ord % 3 = 0""",
    "v_old": """
SELECT '/archive/' || o_orderstatus || '/' || CAST(o_orderkey AS STRING) AS path, CAST(o_totalprice AS BIGINT) AS size, o_orderkey AS mtime FROM orders WHERE o_orderkey % 10 <> 0""",
    "v_new": """
SELECT '/archive/' || o_orderstatus || CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE '' END || '/' || CAST(o_orderkey AS STRING) AS path,
       CAST(o_totalprice AS BIGINT) + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS size, o_orderkey AS mtime FROM orders WHERE o_orderkey % 10 <> 1""",
    "v_note": """
SELECT 'n' || CAST(event_id AS STRING) AS stem, 'text [[n' || CAST(event_id * 4 % 5000 AS STRING) || ']] more' AS body FROM events""",
    "v_log": """
SELECT conv_id, turn, role, text, conv_id * 1000 + turn AS ord FROM conversations""",
}
NEEDS = {"v_index": ["v_file"], "v_sample": ["v_file"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    words = set(sql.replace("\n", " ").split())
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "documents", "orders", "conversations") if t in words}
    tables |= {v: view(spark, sf_dir, v) for v in NEEDS.get(name, [])}
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    sql = sql.replace("octet_length(encode(text))", "octet_length(text)").replace("sha256(text)", "sha2(text, 256)")
    return spark.sql(sql, **tables)


def with_views(*names: str) -> str:
    """The start of an oracle: WITH of the views and what they need."""
    wanted: list[str] = []
    for name in names:
        wanted += [n for n in [*NEEDS.get(name, []), name] if n not in wanted]
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in wanted)
