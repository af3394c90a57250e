"""Registered queries over note texts and files that are written from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliary import model, session
from foliary.bindings import view, with_views
from foliary.catalog import ORACLE_SQL, TODAY, events, query, table
from foliary.functions import frontmatter, text
from foliary.operators import reports, validate
from foliary.plans import scan
from foliary.sources import archive, note_files, writers
from foliary.streaming import logbook

#: A note for each document, in the forms that people and programs write frontmatter in; the document's text is the body.
NOTE_TEXT = """SELECT doc_id, CASE WHEN doc_id % 29 = 7 THEN 'no fence' || chr(10) ELSE '---' || chr(10)
  || 'schema_version: ' || CASE WHEN doc_id % 11 = 1 THEN '3' WHEN doc_id % 11 = 2 THEN '"2"' WHEN doc_id % 11 = 3 THEN '1' ELSE '2   # of the schema' END || chr(10)
  || 'plugin: ' || CASE WHEN doc_id % 31 = 1 THEN 'other' ELSE 'kit' END || chr(10)
  || CASE WHEN doc_id % 13 = 2 THEN 'domain: a/b' || chr(10) WHEN doc_id % 13 = 3 THEN 'domain:' || chr(10) WHEN doc_id % 11 = 3 THEN '' ELSE 'domain: ''arch''' || chr(10) END
  || '# where it is from' || chr(10) || 'project: "' || source || ' # 1"' || chr(10) || 'source_path: /archive/' || source || chr(10)
  || 'file_type: ' || CASE WHEN doc_id % 17 = 3 THEN 'weird' ELSE 'pdf' END || chr(10) || 'captured_date: 2024-01-01' || chr(10)
  || CASE WHEN doc_id % 19 = 5 THEN '' ELSE 'event_date: "2024-01-02"' || chr(10) END || 'event_date_source: mtime' || chr(10) || 'scan_type: retro' || chr(10)
  || CASE WHEN n_chars % 3 = 0 THEN 'sources_read: []' WHEN n_chars % 3 = 1 THEN 'sources_read:' || chr(10) || '  - ' || source || chr(10) || '  # and' || chr(10) || '  - "' || lang || ', b"' ELSE 'sources_read: [' || source || ', "x, y"]  # two' END || chr(10)
  || 'read_bytes: ' || CASE WHEN doc_id % 23 = 5 THEN 'true' WHEN n_chars % 3 = 0 AND doc_id % 7 <> 4 THEN '0' ELSE CAST(n_chars AS STRING) END || chr(10)
  || 'content_confidence: ' || CASE WHEN n_chars % 3 = 0 THEN 'metadata-only' ELSE 'high' END || chr(10)
  || CASE WHEN doc_id % 5 = 1 THEN 'tags:' || chr(10) || '- t' || CAST(doc_id % 3 AS STRING) || chr(10) || '- ' || lang || chr(10) WHEN doc_id % 5 = 2 THEN 'tags: one' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 6 = 1 THEN 'attachments: [a.png]' || chr(10) || 'images_embedded: ' || CAST(doc_id % 2 + 1 AS STRING) || chr(10) ELSE '' END
  || CASE WHEN doc_id % 37 = 3 THEN 'remark: |' || chr(10) || '  first: line' || chr(10) || '  second' || chr(10) ELSE '' END
  || 'cssclasses:' || chr(10) || '- wide' || chr(10) || '---' || chr(10) END || text AS note FROM {}"""

# Lines of a fence, each with the key it belongs to; then a value for each key.
PARSED = f"""WITH t AS ({NOTE_TEXT.format("documents")}),
f AS (SELECT doc_id, string_split(regexp_extract(note, '^---\\n(.*?\\n)---\\n', 1, 's'), chr(10)) AS ls FROM t WHERE starts_with(note, '---')),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM f),
k AS (SELECT *, nullif(regexp_extract(line, '^([a-z_]+):', 1), '') AS own FROM l WHERE line <> '' AND NOT regexp_matches(line, '^\\s*#')),
c AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS key FROM k),
r AS (SELECT doc_id, key, min(pos) AS pos, max(CASE WHEN own IS NOT NULL THEN trim(regexp_replace(regexp_replace(line, '^[a-z_]+:', ''), '^("[^"]*"|[^"#]*(?:"[^"]*"[^"#]*)*?)\\s+#.*$', '\\1')) END) AS head,
  list(trim(regexp_replace(line, '^\\s*-', '')) ORDER BY pos) FILTER (own IS NULL AND regexp_matches(line, '^\\s*- ')) AS items, string_agg(trim(line), chr(10) ORDER BY pos) FILTER (own IS NULL) AS more FROM c GROUP BY doc_id, key),
v AS (SELECT doc_id, key, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos,
  CASE WHEN head = '' AND items IS NOT NULL OR starts_with(head, '[') THEN 'list' WHEN head = '|' OR starts_with(head, '"') OR starts_with(head, '''') THEN 'str' WHEN regexp_matches(head, '^-?[0-9]+$') THEN 'int'
    WHEN head IN ('true', 'false') THEN 'bool' WHEN regexp_matches(head, '^\\d{{4}}-\\d\\d-\\d\\d$') THEN 'date' WHEN head = '' THEN 'null' ELSE 'str' END AS kind,
  CASE WHEN head = '' AND items IS NOT NULL OR starts_with(head, '[') THEN CAST(to_json(list_transform(CASE WHEN starts_with(head, '[') THEN regexp_extract_all(head, '"[^"]*"|[^\\[\\], "]+') ELSE items END, lambda x: trim(x, '"'))) AS VARCHAR)
    WHEN head = '|' THEN more || chr(10) WHEN starts_with(head, '"') OR starts_with(head, '''') THEN substr(head, 2, len(head) - 2) WHEN head = '' THEN NULL ELSE head END AS value,
  CASE WHEN starts_with(head, '[') THEN len(regexp_extract_all(head, '"[^"]*"|[^\\[\\], "]+')) ELSE coalesce(len(items), 0) END AS n FROM r)"""


def note_texts(spark, sf_dir):
    rows = spark.sql(NOTE_TEXT.format("{documents}"), documents=table(spark, sf_dir, "documents"))
    return rows.select(F.col("doc_id").cast("string").alias("note_path"), F.col("note").alias("text"))


@query("a16_frontmatter", PARSED + "\nSELECT CAST(doc_id AS VARCHAR) AS note_path, CAST(pos AS INTEGER) AS pos, key, kind, value FROM v")
def a16_frontmatter(spark, sf_dir):
    rows = validate.read_notes(note_texts(spark, sf_dir))
    return rows.select("note_path", F.posexplode("entries").alias("pos", "e")).select("note_path", "pos", "e.key", "e.kind", "e.value")


@query("f30_keys_of_notes", PARSED + "\nSELECT CAST(doc_id AS VARCHAR) AS note_path, string_agg(key, ',' ORDER BY pos) AS keys FROM v GROUP BY doc_id")
def f30_keys_of_notes(spark, sf_dir):
    fence = frontmatter.fence_of(F.col("text"))
    return note_texts(spark, sf_dir).where(fence.isNotNull()).select("note_path", F.array_join(text.key_order(fence), ",").alias("keys"))


def _text_rules() -> str:
    """The rules on what PARSED found: v holds a row for each key."""
    has = lambda f: f"list_contains(keys, '{f}')"
    val, kind = (lambda f: f"vals[list_position(keys, '{f}')]"), (lambda f: f"kinds[list_position(keys, '{f}')]")
    count = lambda f: f"coalesce(ns[list_position(keys, '{f}')], 0)"
    no = lambda x: f"NOT coalesce({x}, false)"
    listing = lambda xs: ", ".join(f"'{x}'" for x in xs)
    first = f"coalesce({val('schema_version')} = '1', false)"
    out = [("version", f"{no(val('schema_version') + " IN ('1', '2')")} OR {kind('schema_version')} <> 'int'")]
    out += [("unknown-field", f"len(list_filter(keys, lambda x: x NOT IN ({listing(model.FIELD_ORDER)}))) > 0 OR {first} AND len(list_filter(keys, lambda x: x IN ({listing(set(model.FIELD_ORDER) - set(model.V1_FIELDS))}))) > 0")]
    for f in model.FIELD_ORDER:
        if f in model.REQUIRED and f in model.V1_REQUIRED:
            out.append((f"missing:{f}", f"NOT {has(f)}"))
        elif f in model.REQUIRED or f in model.V1_REQUIRED:
            out.append((f"missing:{f}", f"NOT {has(f)} AND {'NOT ' if f in model.REQUIRED else ''}{first}"))
    said = [f for f in model.FIELD_ORDER if f not in model.INTEGERS + model.LISTS]
    out += [(f"type:{f}", f"{has(f)} AND {kind(f)} <> 'int'") for f in model.INTEGERS] + [(f"type:{f}", f"{has(f)} AND {kind(f)} <> 'list'") for f in model.LISTS]
    out += [(f"type:{f}", f"{has(f)} AND {kind(f)} NOT IN ('str'{', ' + listing(['date']) if f in model.DATES else ''})") for f in said]
    out += [(f"enum:{f}", f"{has(f)} AND {no(f'{val(f)} IN ({listing(xs)})')}") for f, xs in model.ENUMS.items()]
    out += [("literal:plugin", f"{val('plugin')} IS DISTINCT FROM 'kit'")]
    sources, confidence, embedded = count("sources_read"), f"coalesce({val('content_confidence')}, '')", f"coalesce(try_cast({val('images_embedded')} AS INTEGER), 0)"
    out += [
        ("sources-without-confidence", f"{sources} > 0 AND {confidence} NOT IN ('high', 'low')"), ("confidence-without-sources", f"{sources} = 0 AND {confidence} <> 'metadata-only'"),
        ("bytes-without-sources", f"{sources} = 0 AND coalesce({val('read_bytes')}, '0') <> '0'"), ("domain-path", f"coalesce(regexp_matches({val('domain')}, '/|^$'), false)"),
        ("images-without-attachments", f"{embedded} > 0 AND {count('attachments')} <> {embedded}"),
    ]
    return ",\n    ".join(f"CASE WHEN {bad} THEN '{code}' END" for code, bad in out)


@query("k1_from_text", PARSED + f""",
g AS (SELECT doc_id, list(key ORDER BY pos) AS keys, list(value ORDER BY pos) AS vals, list(kind ORDER BY pos) AS kinds, list(n ORDER BY pos) AS ns FROM v GROUP BY doc_id),
b AS (SELECT doc_id, list_filter([{_text_rules()}], lambda x: x IS NOT NULL) AS codes FROM g UNION ALL SELECT doc_id, ['no-frontmatter'] FROM t WHERE NOT starts_with(note, '---'))
SELECT CAST(doc_id AS VARCHAR) AS note_path, CAST(i - 1 AS INTEGER) AS pos, codes[i] AS violation FROM (SELECT *, unnest(range(1, len(codes) + 1)) AS i FROM b)""")
def k1_from_text(spark, sf_dir):
    return validate.violations_of_text(note_texts(spark, sf_dir), plugin="kit")


# --- files that are written and read back -----------------------------------------------


LINES = """lines AS (SELECT ord, row_number() OVER (ORDER BY ord) - 1 AS line, CASE WHEN ord % 10 = 3 THEN '' WHEN ord % 10 = 5 THEN source_path || chr(9) || 'two fields'
  ELSE source_path || chr(9) || fingerprint || chr(9) || note_path || CASE WHEN ord % 10 = 7 THEN chr(9) || 'four' ELSE '' END END AS value FROM v_index)"""


def index_files(spark, sf_dir):
    """An index as text files, with empty lines and lines of two or four fields."""
    root = session.fresh_dir(spark, "index")
    rows = view(spark, sf_dir, "v_index").orderBy("ord")
    three = F.concat_ws("\t", "source_path", "fingerprint", "note_path")
    line = F.when(F.col("ord") % 10 == 3, "").when(F.col("ord") % 10 == 5, F.concat("source_path", F.lit("\ttwo fields"))).otherwise(F.concat(three, F.when(F.col("ord") % 10 == 7, "\tfour").otherwise("")))
    rows.select(line.alias("value")).write.text(root)
    return root


@query("a12_index_rows", with_views("v_index") + f""", {LINES}
SELECT source_path, fingerprint, note_path, line AS ord FROM lines JOIN v_index USING (ord) WHERE ord % 10 NOT IN (3, 5, 7)""")
def a12_index_rows(spark, sf_dir):
    good, _ = archive.tab_rows(spark, index_files(spark, sf_dir), ["source_path", "fingerprint", "note_path"], across=True)
    return good


@query("a12_rejected_lines", with_views("v_index") + f""", {LINES} SELECT line AS ord, value AS line FROM lines WHERE ord % 10 IN (5, 7)""")
def a12_rejected_lines(spark, sf_dir):
    _, bad = archive.tab_rows(spark, index_files(spark, sf_dir), ["source_path", "fingerprint", "note_path"], across=True)
    return bad.select("ord", "line")


@query("a23_attachment_rows", with_views("v_index") + f""", {LINES} SELECT split_part(value, chr(9), 1) AS sha256, split_part(value, chr(9), 2) AS filename, line AS ord FROM lines WHERE value <> '' AND NOT starts_with(value, '/moved')""")
def a23_attachment_rows(spark, sf_dir):
    good, _ = archive.tab_rows(spark, index_files(spark, sf_dir), ["sha256", "filename"], comment="/moved", more=True, across=True)
    return good


@query("a14_newest_manifest", with_views("v_new") + "\nSELECT path, mtime, 3 AS snapshot FROM v_new")
def a14_newest_manifest(spark, sf_dir):
    root = session.fresh_dir(spark, "manifests")
    for k, name in enumerate(["v_new", "v_old", "v_new"]):
        writers.write_manifest(view(spark, sf_dir, name), root, k + 1)
    return writers.newest_manifest(spark, root).select("path", "mtime", "snapshot")


# Texts of documents as files: of every seventh there is an older one, which is kept or replaced; every fifth has a wrong digest.
@query("b9_files_written", with_views("v_file") + """
SELECT substr(path, 10) AS path, CASE WHEN ord % 7 = 0 THEN 3 ELSE size END AS bytes_written, sha256(CASE WHEN ord % 7 = 0 THEN 'old' ELSE text END) AS sha256, ord % 7 <> 0 AND ord % 5 <> 0 AS ok FROM v_file""")
def b9_files_written(spark, sf_dir):
    root = session.fresh_dir(spark, "files")
    files = view(spark, sf_dir, "v_file").select(F.expr("substr(path, 10)").alias("path"), "ord", "text", F.when(F.col("ord") % 5 == 0, "x").otherwise(F.sha2(F.col("text").cast("binary"), 256)).alias("expected"))
    note_files.write(files.where("ord % 7 = 0").select("path", F.lit("old").alias("text")), root)
    return note_files.write_acknowledged(files, root).select("path", "bytes_written", "sha256", "ok")


@query("b8_notes_replaced", with_views("v_file") + "\nSELECT substr(path, 10) AS path, text FROM v_file WHERE text <> ''")
def b8_notes_replaced(spark, sf_dir):
    root = session.fresh_dir(spark, "notes")
    files = view(spark, sf_dir, "v_file").select(F.expr("substr(path, 10)").alias("path"), "ord", "text")
    note_files.write(files.where("ord % 7 = 0").select("path", F.lit("old").alias("text")), root)
    note_files.write(files, root, overwrite=True)
    return note_files.read(spark, root).select("path", F.col("content").cast("string").alias("text"))


@query("b10_sections_appended", with_views("v_file") + """
SELECT substr(path, 10) AS path, CASE WHEN ord % 3 = 0 THEN regexp_replace(text, '\\s+$', '') || chr(10) || chr(10) || '## From ' || source || chr(10) ELSE text END AS text FROM v_file WHERE text <> ''""")
def b10_sections_appended(spark, sf_dir):
    root = session.fresh_dir(spark, "appended")
    files = view(spark, sf_dir, "v_file").select(F.expr("substr(path, 10)").alias("path"), "ord", "text", "source")
    note_files.write(files.where("text <> ''"), root)
    note_files.append_sections(files.where("ord % 3 = 0 AND text <> ''").select("path", F.concat(F.lit("## From "), "source").alias("section")), root)
    return note_files.read(spark, root).select("path", F.col("content").cast("string").alias("text"))


# --- streams ---------------------------------------------------------------------------------


def log_stream(spark, sf_dir):
    """Turns of conversations as three batches of a file stream, each logged; the log holds 200 entries."""
    source, root, checkpoint = (session.fresh_dir(spark, name) for name in ("turns", "logbook", "checkpoint"))
    rows = view(spark, sf_dir, "v_log")
    for k in range(3):
        rows.where(F.col("conv_id") % 3 == k).coalesce(1).write.mode("append").parquet(source)
    entries = lambda batch, _: batch.select(F.lit("2024-01-01").alias("timestamp"), F.col("role").alias("event_type"), F.concat_ws("-", "conv_id", "turn").alias("summary"), F.lit(None).cast("string").alias("details"), "ord")
    later = lambda batch, _: batch.where("turn = 0").select(F.col("conv_id").cast("string").alias("path"), F.lit("new").alias("action"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    run = stream.writeStream.foreachBatch(logbook.record(root, entries, later)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return root


@query("t7_log_stream", with_views("v_log") + "\nSELECT role AS event_type, conv_id || '-' || turn AS summary FROM v_log ORDER BY conv_id % 3 DESC, ord DESC LIMIT 200")
def t7_log_stream(spark, sf_dir):
    return logbook.log(spark, log_stream(spark, sf_dir)).select("event_type", "summary")


@query("t7_counters", with_views("v_log") + "\nSELECT role AS event_type, count(*) AS n FROM v_log GROUP BY role")
def t7_counters(spark, sf_dir):
    return logbook.counters(spark, log_stream(spark, sf_dir))


@query("t5_deferred", with_views("v_log") + "\nSELECT CAST(conv_id AS VARCHAR) AS path, 'new' AS action, conv_id % 3 AS batch FROM v_log WHERE turn = 0")
def t5_deferred(spark, sf_dir):
    return logbook.deferred(spark, log_stream(spark, sf_dir))


# --- pages and reports in parts, put together by the file sink ----------------------------------


@query("r1_pages_written", ORACLE_SQL["r1_project_pages"])
def r1_pages_written(spark, sf_dir):
    root = session.fresh_dir(spark, "pages")
    parts = scan.page_parts(events(spark, sf_dir), TODAY)
    note_files.write(parts.select(F.concat("project", F.lit(".md")).alias("path"), "part", "text"), root)
    return note_files.read(spark, root).select(F.regexp_replace("path", r"\.md$", "").alias("project"), F.col("content").cast("string").alias("page"))


@query("r18_reports_written", f"SELECT report || '/' || file_name AS path, body FROM ({ORACLE_SQL['r18_scan_reports']})")
def r18_reports_written(spark, sf_dir):
    root = session.fresh_dir(spark, "reports")
    at = lambda hour: F.lit(f"2024-08-01 {hour}:00:00").cast("timestamp_ntz")
    own = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("report"), F.lit("retro").alias("kind"), at("09").alias("started"), at("10").alias("finished"))
    notes = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("report"), F.col("c_custkey").alias("ord"), F.col("c_name").alias("path"))
    counts = notes.groupBy("report").agg(F.count("*").alias("value")).select("report", F.lit(0).alias("ord"), F.lit("notes").alias("name"), "value")
    warnings = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("report"), F.col("s_suppkey").alias("ord"), F.col("s_name").alias("text"))
    parts = reports.scan_report_parts(own, counts, notes, warnings)
    note_files.write(parts.select(F.concat_ws("/", F.col("report").cast("string"), "path").alias("path"), "part", "text"), root)
    return note_files.read(spark, root).select("path", F.col("content").cast("string").alias("body"))


# Pages of which every other project has one already, with a section of the user's own.
@query("r6_pages_updated", f"""WITH g AS ({ORACLE_SQL["r1_project_pages"]}), m AS (SELECT project, '<!-- auto-start -->' || chr(10) || page || chr(10) || '<!-- auto-end -->' AS page FROM g)
SELECT project, CASE WHEN CAST(substr(project, 6) AS BIGINT) % 2 = 0 THEN page || chr(10) || chr(10) || '## Parties' || chr(10) || chr(10) || 'People of ' || project || chr(10) || chr(10) || '## Mine' || chr(10) || project ELSE page END AS page FROM m""")
def r6_pages_updated(spark, sf_dir):
    root, own = session.fresh_dir(spark, "vault"), events(spark, sf_dir)
    old = own.select("project").distinct().where("CAST(substr(project, 6) AS BIGINT) % 2 = 0")
    page = F.concat(F.lit("# old\n\n## Parties\n\nPeople of "), "project", F.lit("\n\n## Mine\n"), "project", F.lit("\n\n## Timeline\n\nold"))
    note_files.write(old.select(F.concat("project", F.lit(".md")).alias("path"), page.alias("text")), root)
    scan.update_pages(own, root, TODAY)
    return note_files.read(spark, root).select(F.regexp_replace("path", r"\.md$", "").alias("project"), F.col("content").cast("string").alias("page"))
