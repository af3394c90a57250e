"""Registered queries of column functions and small operators, over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliary import session
from foliary.bindings import view, with_views
from foliary.catalog import query, table
from foliary.functions import dates, paths, text
from foliary.operators import config, detect
from foliary.sources import archive, formats, writers


@query("f4_join_path", """SELECT doc_id, array_to_string(list_filter([regexp_replace(trim(x), '^/+|/+$', '', 'g') FOR x IN ['/' || source || '//', ' ' || lang || ' ', CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'n/' || doc_id END, '/']], lambda x: x <> ''), '/') AS path FROM documents""")
def f4_join_path(spark, sf_dir):
    own = F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.concat(F.lit("n/"), "doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", paths.join_path(F.concat(F.lit("/"), "source", F.lit("//")), F.concat(F.lit(" "), "lang", F.lit(" ")), own, F.lit("/")).alias("path"))


@query("f7_attachments_root", with_views("v_index") + """
SELECT ord, CASE WHEN contains(p, '/') THEN left(p, len(p) - strpos(reverse(p), '/')) ELSE p END AS root FROM (SELECT ord, CASE WHEN ord % 3 = 0 THEN split_part(note_path, '/', 1) ELSE note_path END AS p FROM v_index)""")
def f7_attachments_root(spark, sf_dir):
    path = F.when(F.col("ord") % 3 == 0, F.substring_index("note_path", "/", 1)).otherwise(F.col("note_path"))
    return view(spark, sf_dir, "v_index").select("ord", paths.attachments_root(path).alias("root"))


@query("f8_batch_slug", """SELECT p_partkey, regexp_replace(left(regexp_replace(lower(p_type || ' & ' || p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), 30), '^-+|-+$', '', 'g') AS slug FROM part""")
def f8_batch_slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", paths.batch_slug(F.concat("p_type", F.lit(" & "), "p_name", F.lit(" "), "p_brand")).alias("slug"))


KINDS = ["image-folder", "folder", "pdf", "docx", "pptx", "xlsx", "dwg", "psd", "jpg", "mov", "zip", "url", "eml", "txt", "odd", ""]


@query("f22_fallback_hint", f"""WITH k AS (SELECT p_partkey, {KINDS}[p_partkey % {len(KINDS)} + 1] AS kind, p_size % 3 AS n, CASE WHEN p_partkey % 5 = 0 THEN '2024-01-01' ELSE '' END AS day, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name END AS base FROM part)
SELECT p_partkey, CASE WHEN kind = 'image-folder' AND n > 0 THEN 'image folder, ' || n || ' file' || CASE WHEN n = 1 THEN '' ELSE 's' END WHEN kind = 'folder' THEN 'folder event' WHEN kind = 'pdf' AND n > 0 THEN 'pdf, ' || n || ' page' || CASE WHEN n = 1 THEN '' ELSE 's' END
  WHEN kind = 'pdf' THEN 'pdf document' WHEN kind = 'docx' THEN 'docx document' WHEN kind = 'pptx' THEN 'pptx presentation' WHEN kind = 'xlsx' AND n > 0 THEN 'spreadsheet, ' || n || ' sheet' || CASE WHEN n = 1 THEN '' ELSE 's' END WHEN kind = 'xlsx' THEN 'xlsx spreadsheet'
  WHEN kind = 'dwg' THEN 'dwg cad model' WHEN kind = 'psd' THEN 'psd artwork' WHEN kind = 'jpg' THEN 'single image' WHEN kind = 'mov' THEN 'video, not read' WHEN kind = 'zip' THEN 'archive, not read' WHEN kind = 'url' THEN 'link shortcut' WHEN kind = 'eml' THEN 'email message'
  WHEN kind = 'txt' THEN 'txt text' WHEN day <> '' THEN CASE WHEN kind = '' THEN 'file' ELSE kind END || ' captured ' || day WHEN base <> '' THEN CASE WHEN kind = '' THEN 'file' ELSE kind END || ': ' || base ELSE '' END AS hint FROM k""")
def f22_fallback_hint(spark, sf_dir):
    n = F.col("p_size") % 3
    kind = F.get(F.array(*map(F.lit, KINDS)), (F.col("p_partkey") % len(KINDS)).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", text.fallback_hint(kind, n, n, n, F.when(F.col("p_partkey") % 5 == 0, "2024-01-01").otherwise(""), F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.col("p_name"))).alias("hint"))


TOPIC = "p_name || CASE p_partkey % 4 WHEN 0 THEN ' 中' WHEN 1 THEN ' 㐀' WHEN 2 THEN ' ア' ELSE '' END"


@query("f24_has_han", f"SELECT p_partkey, regexp_matches({TOPIC}, '[\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}]') AS han FROM part")
def f24_has_han(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.has_han(F.expr(TOPIC)).alias("han"))


@query("f25_chinese_mode", """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN page_id % 2 = 0 ELSE page_id % 3 = 0 OR regexp_matches(lower(u), '\\.cn(/|:|$)|weixin|zhihu') END AS chinese
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN replace(url, '.com', '.CN') WHEN 1 THEN url || '/Zhihu' ELSE url END AS u FROM pages)""")
def f25_chinese_mode(spark, sf_dir):
    url = F.expr("CASE page_id % 4 WHEN 0 THEN replace(url, '.com', '.CN') WHEN 1 THEN url || '/Zhihu' ELSE url END")
    explicit = F.when(F.col("page_id") % 5 == 0, F.col("page_id") % 2 == 0)
    return table(spark, sf_dir, "pages").select("page_id", text.chinese_mode(explicit, F.when(F.col("page_id") % 3 == 0, "题").otherwise("topic"), F.array(F.lit("http://a.b"), url)).alias("chinese"))


@query("f28_source_of_body", with_views("v_file") + """, b AS (SELECT ord, string_split(CASE ord % 3 WHEN 0 THEN text || chr(10) || 'NAS: `' || path || '`' || chr(10) || 'NAS: `/second`' WHEN 1 THEN 'NAS:   ' || path || ' ' || chr(10) || text ELSE text END, chr(10)) AS lines FROM v_file)
SELECT ord, coalesce(trim(string_split(trim(list_filter(lines, lambda x: starts_with(x, 'NAS:'))[1][5:], ' `'), '`')[1]), '') AS source_path FROM b""")
def f28_source_of_body(spark, sf_dir):
    body = F.expr("CASE ord % 3 WHEN 0 THEN text || chr(10) || 'NAS: `' || path || '`' || chr(10) || 'NAS: `/second`' WHEN 1 THEN 'NAS:   ' || path || ' ' || chr(10) || text ELSE text END")
    return view(spark, sf_dir, "v_file").select("ord", text.source_path_of_body(body).alias("source_path"))


HEADS = ["89504E470D0A1A0A", "FFD8FFE0", "474946383961", "424D3A", "49492A00", "4D4D002A", "524946460000000057454250", "524946460000000057415645", "", "0089504E47"]


@query("f31_image_kind", f"""WITH h AS (SELECT p_partkey, {HEADS}[p_partkey % {len(HEADS)} + 1] || hex(encode(p_name)) AS h FROM part)
SELECT p_partkey, CASE WHEN starts_with(h, '89504E470D0A1A0A') THEN 'png' WHEN starts_with(h, 'FFD8FF') THEN 'jpg' WHEN starts_with(h, '47494638') THEN 'gif' WHEN starts_with(h, '424D') THEN 'bmp' WHEN starts_with(h, '49492A00') OR starts_with(h, '4D4D002A') THEN 'tiff'
  WHEN starts_with(h, '52494646') AND substr(h, 17, 8) = '57454250' THEN 'webp' ELSE 'bin' END AS kind FROM h""")
def f31_image_kind(spark, sf_dir):
    head = F.get(F.array(*map(F.lit, HEADS)), (F.col("p_partkey") % len(HEADS)).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", formats.image_kind(F.unhex(F.concat(head, F.hex("p_name")))).alias("kind"))


@query("f56_stale", "SELECT event_id, t IS NULL OR TIMESTAMP '2024-02-01 00:00:00' - t > INTERVAL 36 HOURS AS stale FROM (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN ts END AS t FROM events)")
def f56_stale(spark, sf_dir):
    at = F.when(F.col("event_id") % 9 != 0, F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", dates.is_stale(at, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"), 36).alias("stale"))


@query("k7_coding_overlay", """WITH k AS (SELECT p_partkey, map {'project': p_brand, 'tags': p_type} AS fm, CASE WHEN p_partkey % 2 = 0 THEN map {'tags': p_name, 'language': p_brand} ELSE map {'odd': p_name, 'language': p_brand} END AS own FROM part)
SELECT p_partkey, array_to_string(list_filter(map_keys(own), lambda x: x NOT IN ('language', 'tags')), ',') AS unknown, fm['project'] AS project, coalesce(own['tags'], fm['tags']) AS tags, own['language'] AS language FROM k""")
def k7_coding_overlay(spark, sf_dir):
    fm = F.create_map(F.lit("project"), "p_brand", F.lit("tags"), "p_type")
    own = F.create_map(F.when(F.col("p_partkey") % 2 == 0, "tags").otherwise("odd"), "p_name", F.lit("language"), "p_brand")
    rows = config.coding_overlay(table(spark, sf_dir, "part").select("p_partkey", fm.alias("fm"), own.alias("overlay")), ["language", "tags"])
    return rows.select("p_partkey", F.array_join("unknown", ",").alias("unknown"), *[F.col("fm")[k].alias(k) for k in ("project", "tags", "language")])


@query("k12_installed_hashes", """SELECT p_partkey, array_to_string(list_filter([h, p_name, upper(h), h || 'a'], lambda x: regexp_full_match(x, '[0-9a-f]{12}')), ',') AS kept FROM (SELECT p_partkey, p_name, substr(sha256(p_name), 1, CASE WHEN p_partkey % 3 = 0 THEN 11 ELSE 12 END) AS h FROM part)""")
def k12_installed_hashes(spark, sf_dir):
    digest = F.expr("substr(sha2(p_name, 256), 1, CASE WHEN p_partkey % 3 = 0 THEN 11 ELSE 12 END)")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", digest.alias("h"))
    found = config.installed_hashes(F.create_map(F.lit("a"), "h", F.lit("b"), "p_name", F.lit("c"), F.upper("h"), F.lit("d"), F.concat("h", F.lit("a"))))
    return rows.select("p_partkey", F.array_join(F.map_values(found), ",").alias("kept"))


@query("k12_version_notice", "SELECT o_orderkey, previous IS NOT NULL AND previous IS DISTINCT FROM o_orderstatus AS notice FROM (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM orders)")
def k12_version_notice(spark, sf_dir):
    previous = F.expr("lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)")
    return table(spark, sf_dir, "orders").withColumn("previous", previous).select("o_orderkey", config.version_notice(F.col("previous"), F.col("o_orderstatus")).alias("notice"))


@query("c20_needs_update", """SELECT p_partkey FROM part WHERE p_partkey % 4 <> 0 AND (p_partkey % 3 = 0 OR p_size > 24) AND contains('please use brand#12 and brand#3 for this', lower(p_brand))""")
def c20_needs_update(spark, sf_dir):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    checked = F.when(F.col("p_partkey") % 3 != 0, now - F.make_dt_interval(hours=F.col("p_size")))
    entries = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("repo"), checked.alias("checked_at"), now.alias("now"), (F.col("p_partkey") % 4 == 0).alias("disabled"))
    return config.needs_update(entries, "Please use Brand#12 and Brand#3 for this").select("p_partkey")


STUBS = """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text || ' TODO' WHEN 1 THEN 'def read_text(p):' || chr(10) || '    return ""' || chr(10) || chr(10) || 'def extract_images(p, o):' || chr(10) || '    # none' || chr(10) || '    return []' || chr(10)
  WHEN 2 THEN 'def read_text(p):' || chr(10) || '    return None' || chr(10) || 'def extract_images(p, o):' || chr(10) || '    return list(p)' ELSE text END AS value FROM {}"""


@query("c21_stub", f"""WITH s AS ({STUBS.format("documents")}), d AS (SELECT doc_id, value, [string_split(x, chr(10)) FOR x IN string_split(chr(10) || value, chr(10) || 'def ')] AS fs FROM s),
f AS (SELECT doc_id, value, [[split_part(x[1], '(', 1), trim(list_filter(x[2:], lambda l: NOT starts_with(trim(l), '#'))[1])] FOR x IN fs] AS named FROM d),
t AS (SELECT doc_id, value, [x[1] FOR x IN named IF x[2] IN ('return ""', 'return ''''', 'return []', 'return None')] AS trivial FROM f)
SELECT doc_id, contains(value, 'TODO') OR contains(value, 'NotImplementedError') OR (list_contains(trivial, 'read_text') AND list_contains(trivial, 'extract_images')) AS stub FROM t""")
def c21_stub(spark, sf_dir):
    rows = spark.sql(STUBS.format("{documents}"), documents=table(spark, sf_dir, "documents"))
    return detect.is_stub(rows).select("doc_id", "stub")


@query("u2_legacy_lists", "SELECT p_partkey, array_to_string([p_brand, p_type] || CASE WHEN p_size > 25 THEN [p_type, p_name] ELSE [] END || [p_name, p_name], '|') AS merged FROM part")
def u2_legacy_lists(spark, sf_dir):
    middle = F.when(F.col("p_size") > 25, F.array("p_type", "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(config.merged_list_legacy(F.array("p_name", "p_name"), middle, F.array("p_brand", "p_type")), "|").alias("merged"))


@query("b5_attachment_index", with_views("v_file") + "\nSELECT fingerprint AS sha256, path AS filename, ord, hits FROM (SELECT *, count(*) OVER (PARTITION BY fingerprint) AS hits FROM v_file QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY ord) = 1)")
def b5_attachment_index(spark, sf_dir):
    path = session.fresh_dir(spark, "attachments")
    writers.write_attachments(view(spark, sf_dir, "v_file").select(F.col("fingerprint").alias("sha256"), F.col("path").alias("filename"), "ord"), path)
    return spark.read.parquet(path)


@query("b12_edit_guard", """WITH p AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_type END AS was, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type END AS hashed FROM part WHERE p_partkey % 7 <> 0)
SELECT r.p_name || r.p_partkey AS name, CASE WHEN p.was = r.p_name THEN 'none' WHEN sha256(p.was) <> sha256(p.hashed) THEN 'sidecar' ELSE 'file' END AS target FROM part r LEFT JOIN p USING (p_partkey)""")
def b12_edit_guard(spark, sf_dir):
    own = table(spark, sf_dir, "part").withColumn("name", F.concat("p_name", F.col("p_partkey").cast("string")))
    hashed = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.col("p_type"))
    present = own.where("p_partkey % 7 <> 0").select("name", F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.col("p_type")).alias("text"), F.sha2(hashed.cast("binary"), 256).alias("stored_hash"))
    return writers.guarded(own.select("name", F.col("p_name").alias("text")), present)


META_PAGES = """SELECT page_id, replace(html, '<title>', CASE page_id % 4 WHEN 0 THEN '<meta name="author" content=" Ann > Bo ">' WHEN 1 THEN '<META content="Cy" property="article:author"/><meta name=date content=2024-01-02>' WHEN 2 THEN '<meta name="author" content=""><meta name="dc.creator" content="Di">' ELSE '' END || '<title>') AS html FROM {}"""


@query("a22_page_property", f"""WITH p AS ({META_PAGES.format("pages")}), m AS (SELECT page_id, html, [x FOR x IN string_split(html, '<') IF starts_with(lower(x), 'meta ')] AS tags FROM p)
SELECT page_id, trim(split_part(split_part(html, '<title>', 2), '</title>', 1)) AS title, split_part(split_part(html, '<html lang="', 2), '"', 1) AS language, split_part(split_part(html, 'charset="', 2), '"', 1) AS charset,
  CASE WHEN contains(array_to_string(tags, '|'), 'Ann') THEN 'Ann > Bo' WHEN len(list_filter(tags, lambda x: contains(x, 'article:author'))) > 0 THEN split_part(split_part(list_filter(tags, lambda x: contains(x, 'article:author'))[1], 'content="', 2), '"', 1)
    WHEN len(list_filter(tags, lambda x: contains(x, 'dc.creator'))) > 0 THEN split_part(split_part(list_filter(tags, lambda x: contains(x, 'dc.creator'))[1], 'content="', 2), '"', 1) END AS author,
  CASE WHEN len(list_filter(tags, lambda x: contains(x, 'name=date'))) > 0 THEN '2024-01-02' END AS published FROM m""")
def a22_page_property(spark, sf_dir):
    rows = spark.sql(META_PAGES.format("{pages}"), pages=table(spark, sf_dir, "pages"))
    return rows.select("page_id", *[archive.page_property(F.col("html"), n).alias(n) for n in ("title", "language", "charset", "author", "published")])
