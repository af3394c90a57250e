"""The registered queries of the archive operators, each with the SQL that must give the same rows."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary import model, session
from foliary.bindings import view, with_views
from foliary.functions import dates, paths, scoring, text, urls
from foliary.operators import audit, clusters, config, detect, duplicates, links, lookup, pages, reports, research, routing, rows, templates, validate, votes
from foliary.plans import scan
from foliary.sources import archive, note_files, writers
from foliary.streaming import deltas

TODAY = datetime.date(2024, 8, 1)
SKIPS = ["src1*", "*9", "e[sn]"]
RULES = [("steel", "Metal"), ("brass", "Metal"), ("small", "Small"), ("promo", "Promo")]
OVERRIDES = [("nickel", "Nickel")]
TIERS = {1: ["example.com"], 2: ["example.net"], 4: ["example.org"]}
HANDLERS = ", ".join(f"('{e}', '{c}')" for c, own in model.CATEGORIES.items() for e in own)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spelled(df: DataFrame) -> DataFrame:
    """Dates as text, which every client reads alike."""
    return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows_ = view(spark, sf_dir, "v_event")
    return rows_.select("project", "subfolder", "event_date", "note_filename", "ord", F.array("party").alias("parties"), F.lit("").alias("summary_hint"), F.lit("").alias("fallback_hint"))


ISLANDS = with_views("v_event") + """,
gaps AS (SELECT *, CASE WHEN date_diff('day', lag(event_date) OVER w, event_date) > {gap} THEN 1 ELSE 0 END AS g FROM v_event WINDOW w AS (PARTITION BY project, subfolder ORDER BY event_date, note_filename, ord)),
runs AS (SELECT *, sum(g) OVER (PARTITION BY project, subfolder ORDER BY event_date, note_filename, ord ROWS UNBOUNDED PRECEDING) AS island FROM gaps)"""


@query("w1_gap_clusters", ISLANDS.format(gap=7) + """
SELECT project, subfolder AS folder, island, CAST(min(event_date) AS VARCHAR) AS start, CAST(max(event_date) AS VARCHAR) AS "end", count(*) AS n_events,
       count(*) OVER (PARTITION BY project, subfolder) AS n_islands FROM runs GROUP BY project, subfolder, island""")
def w1_gap_clusters(spark, sf_dir):
    return spelled(clusters.clusters(events(spark, sf_dir)))


@query("e2_status", with_views("v_event") + """
SELECT project, CASE WHEN DATE '2024-08-01' - max(event_date) <= 180 THEN 'active' WHEN DATE '2024-08-01' - max(event_date) <= 730 THEN 'on-hold' ELSE 'completed' END AS status,
       CAST(min(event_date) AS VARCHAR) AS timeline_start, CAST(CASE WHEN DATE '2024-08-01' - max(event_date) > 730 THEN max(event_date) END AS VARCHAR) AS timeline_end, count(*) AS n_events
FROM v_event GROUP BY project""")
def e2_status(spark, sf_dir):
    return spelled(clusters.status(events(spark, sf_dir), TODAY))


@query("e3_parties", with_views("v_event") + """, f AS (SELECT project, party, min(ord) AS o FROM v_event GROUP BY 1, 2)
SELECT project, string_agg(party, ', ' ORDER BY o) AS parties FROM f GROUP BY project""")
def e3_parties(spark, sf_dir):
    return clusters.parties(events(spark, sf_dir))


@query("w2_prev_next", with_views("v_event") + """, k AS (SELECT DISTINCT project, subfolder, event_date, note_filename AS name FROM v_event)
SELECT project, subfolder, CAST(event_date AS VARCHAR) AS event_date, name, lag(name) OVER w AS prev, lead(name) OVER w AS next FROM k WINDOW w AS (PARTITION BY project, subfolder ORDER BY event_date, name)""")
def w2_prev_next(spark, sf_dir):
    return spelled(links.neighbours(events(spark, sf_dir)))


# Tokens of a note are its type (unless a stop word), and its id where it has two digits or more.
PAIRS = with_views("v_event") + """, s AS (
SELECT a.project, a.note_filename AS name, b.note_filename AS peer, b.ord,
  5.0 * CASE WHEN a.subfolder = b.subfolder THEN 1 ELSE 0 END + CASE WHEN a.subfolder = b.subfolder THEN 3.0 ELSE 0 END + CASE WHEN a.party = b.party THEN 2.0 ELSE 0 END
  + CASE WHEN abs(a.event_date - b.event_date) <= 14 THEN 4.0 * (1.0::DOUBLE - abs(a.event_date - b.event_date)::DOUBLE / 14) ELSE 0 END AS score
FROM v_event a JOIN v_event b ON a.project = b.project AND a.note_filename <> b.note_filename)"""


@query("w3_related_topk", PAIRS + """
SELECT project, name, peer, round(score, 6)::DOUBLE AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY project, name ORDER BY round(score, 9) DESC, ord) AS rank FROM s WHERE score >= 4) WHERE rank <= 3""")
def w3_related_topk(spark, sf_dir):
    return links.related(events(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("f60_pair_scores", PAIRS + "\nSELECT project, count(*) AS n_pairs, round(sum(score), 3)::DOUBLE AS total FROM s WHERE score >= 4 GROUP BY project")
def f60_pair_scores(spark, sf_dir):
    return links.pair_scores(events(spark, sf_dir)).groupBy("project").agg(F.count("*").alias("n_pairs"), F.round(F.sum("score"), 3).alias("total"))


@query("d1j_lookup", with_views("v_file", "v_index") + """,
bp AS (SELECT * FROM v_index QUALIFY row_number() OVER (PARTITION BY source_path ORDER BY ord DESC) = 1),
bf AS (SELECT * FROM v_index QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY ord DESC) = 1)
SELECT path, CASE WHEN bp.fingerprint = f.fingerprint THEN 'skip' WHEN bp.fingerprint IS NOT NULL THEN 'rescan' WHEN bf.ord IS NOT NULL THEN 'rename' ELSE 'new' END AS action,
  CASE WHEN bp.ord IS NOT NULL THEN bp.note_path ELSE bf.note_path END AS existing_note_path, CASE WHEN bp.ord IS NULL THEN bf.source_path END AS old_source_path
FROM v_file f LEFT JOIN bp ON bp.source_path = f.path LEFT JOIN bf ON bf.fingerprint = f.fingerprint""")
def d1j_lookup(spark, sf_dir):
    return lookup.lookup(view(spark, sf_dir, "v_file"), view(spark, sf_dir, "v_index"))


@query("d2j_manifest_diff", with_views("v_old", "v_new") + """
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM v_old o FULL JOIN v_new n ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR o.size <> n.size OR o.mtime <> n.mtime""")
def d2j_manifest_diff(spark, sf_dir):
    return lookup.diff(view(spark, sf_dir, "v_old"), view(spark, sf_dir, "v_new"))


@query("c18_escalation", with_views("v_old", "v_new") + """,
d AS (SELECT n.path, split_part(n.path, '/', 2) || '' AS a, regexp_extract(n.path, '^/?([^/]+)/', 1) AS top FROM v_new n LEFT JOIN v_old o ON o.path = n.path WHERE o.path IS NULL OR o.size <> n.size OR o.mtime <> n.mtime),
t AS (SELECT top FROM d WHERE top NOT IN (SELECT regexp_extract(path, '^/?([^/]+)/', 1) FROM v_old) GROUP BY top HAVING count(*) > 20)
SELECT (SELECT count(*) FROM d) AS n_delta, (SELECT count(*) FROM t) AS n_new_folders, (SELECT count(*) FROM d) > 50 OR (SELECT count(*) FROM t) > 0 AS escalate""")
def c18_escalation(spark, sf_dir):
    old = view(spark, sf_dir, "v_old")
    return lookup.escalation(lookup.diff(old, view(spark, sf_dir, "v_new")), old)


@query("d3j_ghosts", with_views("v_index") + "\nSELECT DISTINCT note_path FROM v_index WHERE note_path NOT IN (SELECT note_path FROM v_index WHERE ord % 9 <> 1)")
def d3j_ghosts(spark, sf_dir):
    index = view(spark, sf_dir, "v_index")
    return lookup.ghosts(index, index.where("ord % 9 <> 1").select("note_path"))


@query("a13_verified_index", with_views("v_index") + "\nSELECT source_path, fingerprint, note_path, ord FROM v_index WHERE note_path IN (SELECT note_path FROM v_index WHERE ord % 9 <> 1)")
def a13_verified_index(spark, sf_dir):
    index = view(spark, sf_dir, "v_index")
    return lookup.verified_index(index, index.where("ord % 9 <> 1").select("note_path"))


@query("w4_last_wins", with_views("v_index") + "\nSELECT source_path, fingerprint, note_path, ord FROM v_index QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY ord DESC) = 1")
def w4_last_wins(spark, sf_dir):
    return lookup.last_by(view(spark, sf_dir, "v_index"), "fingerprint")


@query("d6j_duplicates", with_views("v_index") + """,
p AS (SELECT DISTINCT split_part(note_path, '/', 2) AS project, fingerprint FROM v_index),
l AS (SELECT split_part(note_path, '/', 2) AS project, max(substr(split_part(note_path, '/', -1), 1, 10)) AS latest, count(DISTINCT fingerprint) AS n FROM v_index GROUP BY 1),
s AS (SELECT a.project AS a, b.project AS b, count(*) AS overlap FROM p a JOIN p b ON a.fingerprint = b.fingerprint AND a.project < b.project GROUP BY 1, 2)
SELECT CASE WHEN second THEN b ELSE a END AS canonical, CASE WHEN second THEN a ELSE b END AS alias, overlap, round(confidence, 6) AS confidence FROM (
  SELECT a, b, overlap, overlap / (la.n + lb.n - overlap)::DOUBLE AS confidence, len(b) > len(a) OR (len(a) = len(b) AND lb.latest > la.latest) AS second
  FROM s JOIN l la ON la.project = a JOIN l lb ON lb.project = b)""")
def d6j_duplicates(spark, sf_dir):
    return duplicates.duplicates(view(spark, sf_dir, "v_index"), "arch", 1, 0.0).withColumn("confidence", F.round("confidence", 6))


BY_FP = """, bf AS (SELECT * FROM v_index QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY ord DESC) = 1),
m AS (SELECT s.folder, s.ord, bf.note_path, split_part(bf.note_path, '/', {part}) AS project, bf.source_path FROM v_sample s LEFT JOIN bf USING (fingerprint)),
t AS (SELECT folder, count(*) AS total_checked FROM m GROUP BY folder)"""


@query("d7j_rename_vote", with_views("v_sample", "v_index") + BY_FP.format(part=1) + """,
v AS (SELECT folder, project, count(*) AS n, min(ord) AS f FROM m WHERE note_path IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY folder ORDER BY count(*) DESC, min(ord)) = 1)
SELECT folder, project AS old_name, n AS match_count, total_checked, round(n / total_checked::DOUBLE, 6) AS confidence FROM v JOIN t USING (folder) WHERE n >= 3 AND n / total_checked::DOUBLE >= 0.5 AND project <> folder""")
def d7j_rename_vote(spark, sf_dir):
    return votes.renames(view(spark, sf_dir, "v_sample"), view(spark, sf_dir, "v_index")).withColumn("confidence", F.round("confidence", 6))


@query("d8j_move_vote", with_views("v_sample", "v_index") + BY_FP.format(part=2) + """,
q AS (SELECT *, CASE WHEN starts_with(source_path, '/moved') THEN '/moved/archive' ELSE '/archive' END AS parent FROM m WHERE note_path IS NOT NULL AND split_part(source_path, '/', CASE WHEN starts_with(source_path, '/moved') THEN 4 ELSE 3 END) = project),
v AS (SELECT folder, project, parent, count(*) AS n FROM q GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY folder ORDER BY count(*) DESC, min(ord)) = 1)
SELECT folder, parent AS old_parent, '/archive2' AS new_parent, n AS match_count, total_checked, round(n / total_checked::DOUBLE, 6) AS confidence FROM v JOIN t USING (folder) WHERE project = folder AND n >= 3 AND n / total_checked::DOUBLE >= 0.3""")
def d8j_move_vote(spark, sf_dir):
    return votes.moves(view(spark, sf_dir, "v_sample"), view(spark, sf_dir, "v_index"), threshold=0.3).withColumn("confidence", F.round("confidence", 6))


@query("d9j_vote_tally", with_views("v_sample", "v_index") + BY_FP.format(part=2) + "\nSELECT folder, count(*) AS total_checked, count(note_path) AS matched FROM m GROUP BY folder")
def d9j_vote_tally(spark, sf_dir):
    return votes.matched(view(spark, sf_dir, "v_sample"), view(spark, sf_dir, "v_index")).groupBy("folder").agg(F.count("*").alias("total_checked"), F.count("note_path").alias("matched"))


@query("b4_prefix_rewrite", with_views("v_index") + """
SELECT CASE WHEN starts_with(source_path, '/archive/src1/') THEN '/archive/new' || substr(source_path, 14) ELSE source_path END AS source_path, starts_with(source_path, '/archive/src1/') AS changed, ord FROM v_index""")
def b4_prefix_rewrite(spark, sf_dir):
    return duplicates.apply_prefix(view(spark, sf_dir, "v_index"), "source_path", "/archive/src1", "/archive/new").select("source_path", "changed", "ord")


@query("d13j_affected_notes", with_views("v_index") + "\nSELECT DISTINCT note_path FROM v_index WHERE starts_with(source_path, '/archive/src2/')")
def d13j_affected_notes(spark, sf_dir):
    return duplicates.affected_notes(view(spark, sf_dir, "v_index"), "/archive/src2")


@query("r13_merge_plan", with_views("v_index") + """
SELECT DISTINCT note_path, 'arch/src3/' || substr(note_path, 11) AS target, 'arch/src3/' || substr(note_path, 11) IN (SELECT note_path FROM v_index) AS collides FROM v_index WHERE starts_with(note_path, 'arch/src2/')""")
def r13_merge_plan(spark, sf_dir):
    return duplicates.merge_plan(view(spark, sf_dir, "v_index"), "arch", "src3", "src2")


@query("d10j_orphans", with_views("v_note") + """
SELECT stem, body FROM v_note WHERE stem NOT IN (SELECT DISTINCT regexp_extract(body, '\\[\\[([^\\[\\]]+)\\]\\]', 1) FROM v_note WHERE stem <> regexp_extract(body, '\\[\\[([^\\[\\]]+)\\]\\]', 1))""")
def d10j_orphans(spark, sf_dir):
    return links.orphans(view(spark, sf_dir, "v_note"))


@query("f61_orphan_candidates", with_views("v_file") + """, s AS (
SELECT a.path AS orphan, b.path AS candidate, 3.0 + CASE WHEN abs(a.d - b.d) <= 3 THEN 10.0 - abs(a.d - b.d) ELSE 0 END + CASE WHEN a.path LIKE '%.mp4' THEN 1.0 ELSE 0 END AS score
FROM (SELECT *, make_timestamp(mtime * 1000000)::DATE AS d FROM v_file WHERE ord % 50 = 1) a JOIN (SELECT *, make_timestamp(mtime * 1000000)::DATE AS d FROM v_file) b ON a.source = b.source AND a.path <> b.path)
SELECT orphan, candidate, score::DOUBLE AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY orphan ORDER BY score DESC, candidate) AS rank FROM s) WHERE rank <= 20""")
def f61_orphan_candidates(spark, sf_dir):
    files = view(spark, sf_dir, "v_file").select(F.col("source").alias("project"), F.to_date(F.timestamp_seconds("mtime")).alias("event_date"), paths.extension(F.col("path")).alias("file_type"), F.col("path").alias("source_path"), F.col("path").alias("vault_path"), "ord")
    return links.candidates(files.where("ord % 50 = 1"), files)


@query("c4_confidence", "SELECT doc_id, CASE WHEN length(text) = 0 THEN 'none' WHEN length(text) <= 100 THEN 'low' ELSE 'high' END AS confidence, strlen(text) AS read_bytes FROM documents")
def c4_confidence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.confidence(F.col("text")).alias("confidence"), F.octet_length("text").cast("long").alias("read_bytes"))


@query("c1_handler_category", with_views("v_file") + f""", h(ext, category) AS (VALUES {HANDLERS})
SELECT path, h.category, CASE WHEN h.category IS NULL THEN 'unknown' WHEN h.category IN ('video', 'audio', 'archive') THEN h.category END AS skip_reason FROM v_file LEFT JOIN h ON h.ext = regexp_extract(path, '\\.([^./]+)$', 1)""")
def c1_handler_category(spark, sf_dir):
    return routing.handler(view(spark, sf_dir, "v_file")).select("path", "category", "skip_reason")


PARTS = """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '2024-02-30 ' WHEN 1 THEN '240815-' WHEN 2 THEN '2023-11-05_' WHEN 3 THEN '991231.' WHEN 4 THEN '2024-02-3x' ELSE '' END || p_name AS name,
  CASE p_partkey % 4 WHEN 0 THEN '230101 folder' ELSE 'plain' END AS parent, p_partkey * 86400 AS mtime FROM {}"""


@query("f50_event_date", f"""WITH p AS ({PARTS.format("part")}),
d AS (SELECT *, CASE WHEN regexp_matches(name, '^\\d{{4}}-\\d{{2}}-\\d{{2}}([\\s\\-_.]|$)') THEN try_cast(substr(name, 1, 10) AS DATE)
  WHEN regexp_matches(name, '^\\d{{6}}([\\s\\-_.]|$)') THEN try_cast((CASE WHEN substr(name, 1, 2) < '70' THEN '20' ELSE '19' END) || substr(name, 1, 2) || '-' || substr(name, 3, 2) || '-' || substr(name, 5, 2) AS DATE) END AS own,
  CASE WHEN parent = '230101 folder' THEN DATE '2023-01-01' END AS above FROM p)
SELECT p_partkey, CAST(coalesce(own, above, make_timestamp(mtime * 1000000)::DATE) AS VARCHAR) AS event_date, CASE WHEN own IS NOT NULL THEN 'filename-prefix' WHEN above IS NOT NULL THEN 'parent-folder-prefix' ELSE 'mtime' END AS source FROM d""")
def f50_event_date(spark, sf_dir):
    rows_ = spark.sql(PARTS.format("{part}"), part=table(spark, sf_dir, "part"))
    return spelled(rows_.select("p_partkey", dates.event_date(F.col("name"), F.col("parent"), F.col("mtime")).alias("d")).select("p_partkey", "d.*"))


@query("f63_fingerprint", with_views("v_file") + "\nSELECT path, substr(sha256(split_part(path, '/', -1) || chr(9) || size || chr(9) || mtime), 1, 16) AS fingerprint FROM v_file")
def f63_fingerprint(spark, sf_dir):
    return view(spark, sf_dir, "v_file").select("path", scoring.file_fingerprint(paths.basename(F.col("path")), F.col("size"), F.col("mtime")).alias("fingerprint"))


@query("e12_folder_fingerprint", with_views("v_file") + """, e AS (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, split_part(path, '/', -1) AS name, size FROM v_file)
SELECT folder, substr(sha256(string_agg(name || chr(9) || size, chr(10) ORDER BY name)), 1, 16) AS fingerprint FROM e GROUP BY folder""")
def e12_folder_fingerprint(spark, sf_dir):
    files = view(spark, sf_dir, "v_file").select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), paths.basename(F.col("path")).alias("name"), "size")
    return rows.folder_fingerprint(files)


@query("f1_project_of_path", with_views("v_index") + "\nSELECT note_path, split_part(note_path, '/', 2) AS project, split_part(note_path, '/', 1) AS first FROM v_index")
def f1_project_of_path(spark, sf_dir):
    note = F.col("note_path")
    return view(spark, sf_dir, "v_index").select("note_path", paths.project_of_note(note).alias("project"), paths.project_of_note(note, "legacy").alias("first"))


@query("f3_archive_parent", with_views("v_file") + "\nSELECT path, '/archive' AS parent, '/archive/' || source AS grandparent FROM v_file")
def f3_archive_parent(spark, sf_dir):
    return view(spark, sf_dir, "v_file").select("path", paths.archive_parent(F.col("path"), F.col("source")).alias("parent"), paths.archive_parent(F.col("path"), F.lit("none")).alias("grandparent"))


@query("f13_tokens", """WITH w AS (SELECT p_partkey, unnest(list_distinct(list_filter(regexp_extract_all(lower(p_name || ' the ' || p_type), '[\\p{L}\\p{N}_]+'), lambda t: len(t) >= 2 AND NOT list_contains(['the', 'of', 'and', 'a', 'an', 'to', 'for', 'with'], t)))) AS t FROM part)
SELECT p_partkey, string_agg(t, ' ' ORDER BY t) AS tokens FROM w GROUP BY p_partkey""")
def f13_tokens(spark, sf_dir):
    said = F.concat_ws(" the ", "p_name", "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(text.tokens(said)), " ").alias("tokens"))


DOMAIN = "regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1)"
SOURCES = f"""s AS (SELECT page_id, url, array_to_string(list_slice(string_split({DOMAIN}, '.'), -2, -1), '.') AS domain FROM pages),
t AS (SELECT *, CASE domain WHEN 'example.com' THEN 1 WHEN 'example.net' THEN 2 WHEN 'example.org' THEN 4 ELSE 3 END AS tier FROM s)"""


@query("f41_source_tier", f"WITH {SOURCES} SELECT page_id, domain, tier FROM t")
def f41_source_tier(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.registered_domain(F.col("url")).alias("domain"), urls.tier(F.col("url"), tiers=TIERS).alias("tier"))


@query("e8_tier_counts", f"WITH {SOURCES} SELECT page_id % 7 AS report, count(*) FILTER (tier = 1) AS tier1, count(*) FILTER (tier = 2) AS tier2, count(*) FILTER (tier = 3) AS tier3, count(*) FILTER (tier = 4) AS tier4 FROM t GROUP BY 1")
def e8_tier_counts(spark, sf_dir):
    return research.tier_counts(table(spark, sf_dir, "pages").select((F.col("page_id") % 7).alias("report"), urls.tier(F.col("url"), tiers=TIERS).alias("tier")))


@query("w10_footnotes", f"WITH {SOURCES} SELECT page_id % 7 AS report, url, tier, page_id AS ord, row_number() OVER (PARTITION BY page_id % 7 ORDER BY tier, page_id) AS footnote FROM t")
def w10_footnotes(spark, sf_dir):
    return research.footnotes(table(spark, sf_dir, "pages").select((F.col("page_id") % 7).alias("report"), "url", urls.tier(F.col("url"), tiers=TIERS).alias("tier"), F.col("page_id").alias("ord")))


@query("u10_source_filter", f"""WITH {SOURCES}, one AS (SELECT url, domain, tier, page_id AS ord FROM t WHERE tier < 4 QUALIFY row_number() OVER (PARTITION BY domain ORDER BY tier, page_id) = 1),
k AS (SELECT *, count(*) OVER () AS n, row_number() OVER (PARTITION BY tier ORDER BY ord) AS r FROM (SELECT * FROM one ORDER BY tier, ord LIMIT 10))
SELECT url, domain, tier, ord FROM k WHERE tier < 3 OR r <= floor(n * 0.3)""")
def u10_source_filter(spark, sf_dir):
    return research.choose(table(spark, sf_dir, "pages").select("url", F.col("page_id").alias("ord")), tiers=TIERS)


@query("d4j_domain", with_views("v_file") + """
SELECT path, CASE WHEN starts_with(path, '/archive/src1/en/') THEN 'b' WHEN starts_with(path, '/archive/src1/') THEN 'a' WHEN starts_with(path, '/archive/src2/') THEN 'c' END AS domain FROM v_file""")
def d4j_domain(spark, sf_dir):
    return routing.domain_of(view(spark, sf_dir, "v_file"), [("a", "/archive/src1"), ("b", "/archive/src1/en"), ("c", "/archive/src2")]).select("path", "domain")


@query("d5j_first_domain", with_views("v_file") + "\nSELECT path, CASE WHEN starts_with(path, '/archive/src1') THEN 'a' WHEN starts_with(path, '/archive/src2') THEN 'c' END AS domain FROM v_file")
def d5j_first_domain(spark, sf_dir):
    return routing.first_domain(view(spark, sf_dir, "v_file"), [("a", "/archive/src1"), ("b", "/archive/src1/en"), ("c", "/archive/src2")]).select("path", "domain")


@query("d14j_routing", """SELECT p_partkey, CASE WHEN contains(lower(p_type), 'nickel') THEN 'Nickel' WHEN contains(lower(p_name || p_type), 'steel') THEN 'Metal' WHEN contains(lower(p_name || p_type), 'brass') THEN 'Metal'
  WHEN contains(lower(p_name || p_type), 'small') THEN 'Small' WHEN contains(lower(p_name || p_type), 'promo') THEN 'Promo' ELSE 'Admin' END AS subfolder FROM part""")
def d14j_routing(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", "p_type").alias("name"), F.col("p_type").alias("text"))
    return routing.route(parts, RULES, OVERRIDES).select("p_partkey", "subfolder")


@query("a2_skip_globs", with_views("v_file") + "\nSELECT path FROM v_file WHERE NOT (source LIKE 'src1%' OR source LIKE '%9' OR lang IN ('es', 'en'))")
def a2_skip_globs(spark, sf_dir):
    return routing.keep_segments(view(spark, sf_dir, "v_file"), SKIPS).select("path")


STRUCTURE = with_views("v_file") + """, f AS (SELECT source AS name, count(*) AS child_count, false AS has_files_directly, true AS has_subfolders, bool_or(path LIKE '%.pdf' OR path LIKE '%.txt') AS scannable FROM v_file GROUP BY source)"""


@query("a10_structure", STRUCTURE + "\nSELECT * FROM f")
def a10_structure(spark, sf_dir):
    files = view(spark, sf_dir, "v_file").select(F.expr("substr(path, 10)").alias("path"))
    return routing.structure(files)


@query("c9_new_subfolder", STRUCTURE + "\nSELECT name FROM f WHERE NOT (contains(name, 'rc1') OR name LIKE '%9') AND (child_count >= 3 OR scannable)")
def c9_new_subfolder(spark, sf_dir):
    files = view(spark, sf_dir, "v_file").select(F.expr("substr(path, 10)").alias("path"))
    return routing.new_subfolders(routing.structure(files), ["RC1"], ["*9"]).select("name")


@query("w5_first_seen", with_views("v_file") + "\nSELECT fingerprint, path, ord, hits FROM (SELECT fingerprint, path, ord, count(*) OVER (PARTITION BY fingerprint) AS hits, row_number() OVER (PARTITION BY fingerprint ORDER BY ord) AS r FROM v_file) WHERE r = 1")
def w5_first_seen(spark, sf_dir):
    return rows.first_seen(view(spark, sf_dir, "v_file"), "fingerprint", "path")


@query("w6_read_budget", with_views("v_file") + """
SELECT path, spent FROM (SELECT path, coalesce(sum(CASE WHEN size > 500 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent FROM v_file) WHERE spent < 10""")
def w6_read_budget(spark, sf_dir):
    return rows.within_budget(view(spark, sf_dir, "v_file"), F.col("size") > 500, 10, "source").select("path", "spent")


@query("w7_log_cap", with_views("v_log") + "\nSELECT ord, role FROM v_log ORDER BY ord DESC LIMIT 200")
def w7_log_cap(spark, sf_dir):
    return rows.newest(view(spark, sf_dir, "v_log"), 200).select("ord", "role")


@query("e6_counters", with_views("v_log") + "\nSELECT role, count(*) AS n FROM v_log GROUP BY role")
def e6_counters(spark, sf_dir):
    return rows.counters(view(spark, sf_dir, "v_log"), "role")


@query("e9_median", """WITH u AS (SELECT o_orderpriority AS archive, o_totalprice / (1 + o_custkey % 9) AS speed FROM orders WHERE o_totalprice >= 65536 QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) <= 5)
SELECT archive, count(*) AS n_samples, round(median(speed), 6) AS bytes_per_second, CASE WHEN count(*) >= 3 THEN 'high' ELSE 'low' END AS confidence FROM u GROUP BY archive""")
def e9_median(spark, sf_dir):
    samples = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("archive"), F.col("o_totalprice").alias("size"), (1 + F.col("o_custkey") % 9).alias("seconds"), F.col("o_orderkey").alias("ord"))
    return rows.throughput(samples).withColumn("bytes_per_second", F.round("bytes_per_second", 6))


@query("c6_slow_reads", with_views("v_file") + "\nSELECT path, round(size / 100.0::DOUBLE, 4) AS seconds, size / 100.0::DOUBLE > 30 AS slow FROM v_file")
def c6_slow_reads(spark, sf_dir):
    return rows.slow_reads(view(spark, sf_dir, "v_file"), 100.0).select("path", F.round("seconds", 4).alias("seconds"), "slow")


@query("e10_duplicate_events", with_views("v_index") + """
SELECT 'path' AS kind, source_path AS key, count(*) AS n FROM v_index GROUP BY source_path HAVING count(*) > 1
UNION ALL SELECT 'fingerprint', fingerprint, count(DISTINCT source_path) FROM v_index GROUP BY fingerprint HAVING count(DISTINCT source_path) > 1""")
def e10_duplicate_events(spark, sf_dir):
    return rows.repeated(view(spark, sf_dir, "v_index"))


@query("c7_images_to_embed", with_views("v_file") + """, f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ord) AS k FROM v_file), g AS (SELECT * FROM f WHERE k <= 10 AND (size >= 1000 OR size = 0) QUALIFY row_number() OVER (PARTITION BY source, fingerprint ORDER BY ord) = 1)
SELECT source AS note, path, ((row_number() OVER (PARTITION BY source ORDER BY ord) - 1) // 3)::INT AS "row" FROM g""")
def c7_images_to_embed(spark, sf_dir):
    images = view(spark, sf_dir, "v_file").select(F.col("source").alias("note"), "path", "size", F.col("fingerprint").alias("sha256"), "ord")
    return rows.images_to_embed(images, least_bytes=1000).select("note", "path", "row")


@query("u1_layered", with_views("v_index") + """, u AS (SELECT source_path, note_path, ord, 0 AS layer FROM v_index WHERE ord % 3 = 0 UNION ALL SELECT source_path, 'base', ord, 1 FROM v_index WHERE ord % 2 = 0)
SELECT source_path, note_path, ord, layer FROM u QUALIFY row_number() OVER (PARTITION BY source_path ORDER BY layer, ord) = 1""")
def u1_layered(spark, sf_dir):
    index = view(spark, sf_dir, "v_index").select("source_path", "note_path", "ord")
    return rows.layered([index.where("ord % 3 = 0"), index.where("ord % 2 = 0").withColumn("note_path", F.lit("base"))], "source_path")


@query("d17j_missing_attachments", with_views("v_event") + "\nSELECT note_filename AS note, party AS attachment FROM v_event WHERE party NOT IN ('p0', 'p1', 'p2', 'p3')")
def d17j_missing_attachments(spark, sf_dir):
    notes = events(spark, sf_dir).select(F.col("note_filename").alias("note"), F.col("parties").alias("attachments"))
    return audit.missing_attachments(notes, spark.createDataFrame([(f"p{k}",) for k in range(4)], "name string"))


@query("d18j_broken_sources", with_views("v_file", "v_index") + "\nSELECT source_path, note_path, ord FROM v_index WHERE source_path NOT IN (SELECT path FROM v_file)")
def d18j_broken_sources(spark, sf_dir):
    return audit.broken_sources(view(spark, sf_dir, "v_index"), view(spark, sf_dir, "v_file")).select("source_path", "note_path", "ord")


@query("d16j_stale_renames", with_views("v_index") + "\nSELECT note_path, source_path, substr(source_path, 7) AS own FROM v_index WHERE starts_with(source_path, '/moved')")
def d16j_stale_renames(spark, sf_dir):
    index = view(spark, sf_dir, "v_index")
    return audit.stale_renames(index, index.select("note_path", F.regexp_replace("source_path", "^/moved", "").alias("source_path")))


# Frontmatter with planted faults: by doc_id modulo.
FM = """SELECT '2024-01-0' || CAST(doc_id % 9 + 1 AS STRING) || ' n' || CAST(doc_id AS STRING) || '.md' AS note_path, doc_id AS k,
  CASE WHEN doc_id % 11 = 1 THEN '3' ELSE '2' END AS schema_version, CASE WHEN doc_id % 13 = 2 THEN 'a/b' ELSE 'arch' END AS domain, source AS project, '/archive/' || source AS source_path,
  CASE WHEN doc_id % 17 = 3 THEN 'weird' ELSE 'pdf' END AS file_type, '2024-01-01' AS event_date, CASE WHEN n_chars % 2 = 0 THEN '["a"]' ELSE '[]' END AS sources_read,
  CASE WHEN n_chars % 2 = 0 OR doc_id % 19 = 4 THEN '7' ELSE '0' END AS read_bytes, CASE WHEN n_chars % 2 = 0 THEN 'high' ELSE 'metadata-only' END AS content_confidence, CASE WHEN doc_id % 23 = 5 THEN '2' ELSE '0' END AS images_embedded FROM {}"""


def frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.sql(FM.format("{documents}"), documents=table(spark, sf_dir, "documents"))
    names = ["schema_version", "domain", "project", "source_path", "file_type", "event_date", "sources_read", "read_bytes", "content_confidence", "images_embedded"]
    fixed = [F.lit("plugin"), F.lit("p"), F.lit("captured_date"), F.lit("2024-01-01"), F.lit("event_date_source"), F.lit("mtime"), F.lit("scan_type"), F.lit("retro")]
    fm = F.create_map(*[c for n in names for c in (F.lit(n), F.col(n))], *fixed)
    return raw.select("note_path", "k", fm.alias("fm"), F.lit("").alias("body"), F.lit("p").alias("project"), F.lit("d").alias("domain"), (F.col("k") * 86400).alias("mtime"))


@query("k1_violations", f"""WITH f AS ({FM.format("documents")}), c AS (SELECT note_path, list_filter([CASE WHEN schema_version = '3' THEN 'version' END, CASE WHEN file_type = 'weird' THEN 'enum:file_type' END,
  CASE WHEN sources_read = '[]' AND read_bytes <> '0' THEN 'bytes-without-sources' END, CASE WHEN domain = 'a/b' THEN 'domain-path' END, CASE WHEN images_embedded = '2' THEN 'images-without-attachments' END], lambda x: x IS NOT NULL) AS v FROM f)
SELECT note_path, (i - 1)::INT AS pos, v[i] AS violation FROM (SELECT note_path, v, unnest(range(1, len(v) + 1)) AS i FROM c)""")
def k1_violations(spark, sf_dir):
    return validate.violations(frontmatter(spark, sf_dir))


@query("k3_invariants", f"""WITH f AS ({FM.format("documents")}), c AS (SELECT note_path, list_filter([
  CASE WHEN sources_read = '[]' AND read_bytes <> '0' THEN 'bytes-without-sources' END, CASE WHEN domain = 'a/b' THEN 'domain-path' END, CASE WHEN images_embedded = '2' THEN 'images-without-attachments' END], lambda x: x IS NOT NULL) AS v FROM f)
SELECT note_path, (i - 1)::INT AS pos, v[i] AS violation FROM (SELECT note_path, v, unnest(range(1, len(v) + 1)) AS i FROM c)""")
def k3_invariants(spark, sf_dir):
    return validate.violations(frontmatter(spark, sf_dir), only_invariants=True)


@query("k5_upgrade", f"""WITH f AS ({FM.format("documents")})
SELECT note_path, 2 AS schema_version, CASE WHEN file_type = 'weird' THEN 'folder' ELSE file_type END AS file_type, event_date, sources_read, CAST(read_bytes AS BIGINT) AS read_bytes, content_confidence FROM f""")
def k5_upgrade(spark, sf_dir):
    return validate.upgrade(frontmatter(spark, sf_dir), "2024-08-01").select("note_path", "schema_version", "file_type", "event_date", "sources_read", "read_bytes", "content_confidence")


@query("k6_audit", f"""WITH f AS ({FM.format("documents")})
SELECT field, n_changed FROM (SELECT 'schema_version' AS field, count(*) FILTER (schema_version <> '2') AS n_changed FROM f UNION ALL SELECT 'file_type', count(*) FILTER (file_type = 'weird') FROM f UNION ALL SELECT 'cssclasses', count(*) FROM f) WHERE n_changed > 0""")
def k6_audit(spark, sf_dir):
    return validate.upgrade_audit(frontmatter(spark, sf_dir), "2024-08-01")


LABELLED = ISLANDS.format(gap=7) + """,
c AS (SELECT project, subfolder AS folder, island, min(event_date) AS s, max(event_date) AS e, count(*) AS n, count(*) OVER (PARTITION BY project, subfolder) AS k FROM runs GROUP BY 1, 2, 3),
ids AS (SELECT project, subfolder AS folder, island, any_value(ord) AS id FROM runs GROUP BY 1, 2, 3 HAVING count(*) = 1 AND len(CAST(any_value(ord) AS VARCHAR)) >= len(any_value(subfolder))),
l AS (SELECT c.*, coalesce(CAST(id AS VARCHAR), folder) || CASE WHEN n > 1 THEN ' ×' || n ELSE '' END || CASE WHEN k > 1 THEN ' (' || (island + 1)::BIGINT || ')' ELSE '' END AS label FROM c LEFT JOIN ids USING (project, folder, island))"""


@query("f14_cluster_labels", LABELLED + "\nSELECT project, folder, island, label FROM l")
def f14_cluster_labels(spark, sf_dir):
    return clusters.labels(events(spark, sf_dir)).select("project", "folder", "island", "label")


@query("r3_gantt", LABELLED + """,
b AS (SELECT project, folder, min(s) AS s, string_agg('        ' || label || ' :' || s || CASE WHEN s = e THEN ', 1d' ELSE ', ' || e END, chr(10) ORDER BY island) AS bars FROM l GROUP BY 1, 2)
SELECT project, '```mermaid' || chr(10) || 'gantt' || chr(10) || '    title ' || project || chr(10) || '    dateFormat YYYY-MM-DD' || chr(10) || string_agg('    section ' || folder || chr(10) || bars, chr(10) ORDER BY s, folder) || chr(10) || '```' AS block FROM b GROUP BY project""")
def r3_gantt(spark, sf_dir):
    return clusters.gantt(events(spark, sf_dir))


@query("r2_navigation", with_views("v_event") + """, p AS (SELECT project, subfolder, '### ' || subfolder || '/' || chr(10) || string_agg('- ==' || event_date || '== — [[' || note_filename || ']]', chr(10) ORDER BY event_date, note_filename) AS part FROM v_event GROUP BY 1, 2)
SELECT project, string_agg(part, chr(10) || chr(10) ORDER BY subfolder) AS block FROM p GROUP BY project HAVING count(*) > 1""")
def r2_navigation(spark, sf_dir):
    return clusters.navigation(events(spark, sf_dir))


@query("r7_inter_event", PAIRS + """, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, name ORDER BY round(score, 9) DESC, ord) AS rank FROM s WHERE score >= 4) WHERE rank <= 3),
r AS (SELECT project, name, '## Related' || chr(10) || chr(10) || string_agg('- [[' || peer || ']]', chr(10) ORDER BY rank) AS related FROM top GROUP BY 1, 2),
n AS (SELECT project, note_filename AS name, subfolder, lag(note_filename) OVER w AS p, lead(note_filename) OVER w AS x FROM (SELECT DISTINCT project, subfolder, event_date, note_filename FROM v_event) WINDOW w AS (PARTITION BY project, subfolder ORDER BY event_date, note_filename)),
m AS (SELECT project, name, nullif(concat_ws(chr(10), '← Previous in ' || subfolder || ': [[' || p || ']]  ', '→ Next in ' || subfolder || ': [[' || x || ']]'), '') AS near FROM n)
SELECT project, name, '<!-- related-start -->' || chr(10) || concat_ws(chr(10) || chr(10), related, near) || chr(10) || '<!-- related-end -->' AS section FROM m LEFT JOIN r USING (project, name) WHERE related IS NOT NULL OR near IS NOT NULL""")
def r7_inter_event(spark, sf_dir):
    return links.sections(events(spark, sf_dir))


LINKED = PAIRS + """, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, name ORDER BY round(score, 9) DESC, ord) AS rank FROM s WHERE score >= 4) WHERE rank <= 3),
r AS (SELECT project, name, '## Related' || chr(10) || chr(10) || string_agg('- [[' || peer || ']]', chr(10) ORDER BY rank) AS related FROM top GROUP BY 1, 2),
n AS (SELECT project, note_filename AS name, subfolder, lag(note_filename) OVER w AS p, lead(note_filename) OVER w AS x FROM (SELECT DISTINCT project, subfolder, event_date, note_filename FROM v_event) WINDOW w AS (PARTITION BY project, subfolder ORDER BY event_date, note_filename)),
m AS (SELECT project, name, nullif(concat_ws(chr(10), '← Previous in ' || subfolder || ': [[' || p || ']]  ', '→ Next in ' || subfolder || ': [[' || x || ']]'), '') AS near FROM n),
z AS (SELECT project, name, '<!-- related-start -->' || chr(10) || concat_ws(chr(10) || chr(10), related, near) || chr(10) || '<!-- related-end -->' AS section FROM m LEFT JOIN r USING (project, name) WHERE related IS NOT NULL OR near IS NOT NULL)"""


@query("r8_linked_bodies", LINKED + """
SELECT v.project, note_filename AS name, CASE WHEN ord % 10 = 0 THEN 'Error: no such note' ELSE 'text ' || ord || coalesce(chr(10) || chr(10) || section || chr(10), CASE WHEN ord % 10 = 1 THEN chr(10) ELSE '' END) END AS body
FROM v_event v LEFT JOIN z ON z.project = v.project AND z.name = v.note_filename""")
def r8_linked_bodies(spark, sf_dir):
    own = events(spark, sf_dir)
    old = F.when(F.col("ord") % 10 == 1, F.lit(f"\n\n{text.MARKER_START}\nold\n{text.MARKER_END}\n")).otherwise("")
    body = F.when(F.col("ord") % 10 == 0, "Error: no such note").otherwise(F.concat(F.lit("text "), F.col("ord").cast("string"), old))
    return scan.linked_bodies(own, own.select("project", F.col("note_filename").alias("name"), body.alias("body")))


@query("t1_sessions", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 7 DAY THEN 1 ELSE 0 END AS g FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts)),
r AS (SELECT *, sum(g) OVER (PARTITION BY user_id, event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g)
SELECT user_id, event_type, min(ts) AS start, max(ts) AS "end", count(*) AS n_events FROM r GROUP BY user_id, event_type, i""")
def t1_sessions(spark, sf_dir):
    return deltas.sessions(table(spark, sf_dir, "events"))


@query("a7_folder_sample", with_views("v_file") + "\nSELECT source AS folder, path, k FROM (SELECT source, path, row_number() OVER (PARTITION BY source ORDER BY path) AS k FROM v_file) WHERE k <= 20")
def a7_folder_sample(spark, sf_dir):
    return detect.folder_sample(view(spark, sf_dir, "v_file").select(F.col("source").alias("folder"), "path"))


PLACES = """SELECT source AS project, CASE doc_id % 5 WHEN 0 THEN '240101 visit/' || CAST(doc_id AS STRING) || '.jpg' WHEN 1 THEN 'SD/' || CAST(doc_id AS STRING) || '.pdf' WHEN 2 THEN 'SD/' || CAST(doc_id AS STRING) || '.jpg'
  WHEN 3 THEN 'SD/' || CAST(doc_id AS STRING) || '.dwg' ELSE '_Attachments/' || CAST(doc_id AS STRING) || '.pdf' END AS path, doc_id % 5 AS k FROM {}"""


@query("c17_detect_events", f"""WITH f AS ({PLACES.format("documents")}), d AS (SELECT DISTINCT project FROM f WHERE k = 0)
SELECT f.project, path, CASE k WHEN 0 THEN '240101 visit' WHEN 1 THEN path WHEN 3 THEN path ELSE CASE WHEN d.project IS NOT NULL THEN '240101 visit' END END AS event,
  CASE k WHEN 0 THEN 'folder' WHEN 1 THEN 'document' WHEN 3 THEN 'metadata-only' ELSE CASE WHEN d.project IS NOT NULL THEN 'linked-image' ELSE 'skip' END END AS kind FROM f LEFT JOIN d ON d.project = f.project WHERE k < 4""")
def c17_detect_events(spark, sf_dir):
    return detect.detect_events(spark.sql(PLACES.format("{documents}"), documents=table(spark, sf_dir, "documents")).drop("k"))


@query("c15_compose_gate", """SELECT doc_id, n_chars > 0 AS compose, substr(text, 1, 4000) AS excerpt, CASE WHEN contains(lower(text), 'token') THEN 'stop word: token' ELSE '' END AS reasons FROM documents""")
def c15_compose_gate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(0).alias("images"), F.lit(None).cast("array<string>").alias("captions"), F.col("text").alias("body"))
    return detect.compose_gate(docs, ["token"]).select("doc_id", "compose", "excerpt", F.array_join("reasons", ",").alias("reasons"))


@query("w12_note_body", """SELECT n_nationkey, n_name || chr(10) || chr(10) || 'e1' || chr(10) || 'e2' || chr(10) || 'e3' || chr(10) || chr(10) || 'e4' AS body FROM nation""")
def w12_note_body(spark, sf_dir):
    notes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("note"), F.col("n_name").alias("prose"), F.array(*[F.lit(f"e{k}") for k in (1, 2, 3, 4)]).alias("embeds"))
    return detect.note_body(notes).withColumnRenamed("note", "n_nationkey")


@query("b9_write_acknowledgement", with_views("v_file") + "\nSELECT path, size AS bytes_written, sha256(text) AS sha256, ord % 2 = 0 AS ok FROM v_file")
def b9_write_acknowledgement(spark, sf_dir):
    good = F.sha2(F.col("text").cast("binary"), 256)
    files = view(spark, sf_dir, "v_file").select(F.expr("substr(path, 2)").alias("path"), F.col("text").cast("binary").alias("content"), F.when(F.col("ord") % 2 == 0, good).otherwise("x").alias("expected"))
    told = note_files.write_acknowledged(files, session.fresh_dir(spark, "binaries"))
    return told.select(F.concat(F.lit("/"), "path").alias("path"), "bytes_written", "sha256", "ok")


@query("b8_new_notes", with_views("v_index") + "\nSELECT note_path FROM v_index WHERE note_path NOT IN (SELECT note_path FROM v_index WHERE ord % 3 = 0)")
def b8_new_notes(spark, sf_dir):
    index = view(spark, sf_dir, "v_index").select("note_path", "ord")
    return writers.new_notes(index.select("note_path"), index.where("ord % 3 = 0"))


@query("e13_coverage", """WITH c AS (SELECT DISTINCT p_type AS category FROM part), h AS (SELECT p_type AS category, bool_or(p_size = 1) AS stub FROM part WHERE p_size < 10 GROUP BY 1)
SELECT category, CASE WHEN stub IS NULL THEN 'missing' WHEN stub THEN 'stub' ELSE 'real' END AS state FROM c LEFT JOIN h USING (category)""")
def e13_coverage(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_type").alias("category"), (F.col("p_size") == 1).alias("stub"), "p_size")
    return detect.coverage(parts.where("p_size < 10"), parts.select("category").distinct())


@query("k9_reconcile", with_views("v_file", "v_index") + """
SELECT note_path, lang <> 'en' AS misrouted, ord % 2 = 0 AS unverified, source_path NOT IN (SELECT path FROM v_file) AS source_missing FROM (SELECT *, split_part(note_path, '/', 3) AS lang FROM v_index)""")
def k9_reconcile(spark, sf_dir):
    notes = view(spark, sf_dir, "v_index").select("note_path", "source_path", F.get(F.split("note_path", "/"), F.lit(2)).alias("subfolder"), F.lit("en").alias("routed"), F.when(F.col("ord") % 2 == 0, "low").otherwise("high").alias("confidence"))
    return config.reconcile(notes, view(spark, sf_dir, "v_file"))


@query("c19_auto_applied", with_views("v_sample", "v_index") + BY_FP.format(part=1) + """,
v AS (SELECT folder, project, count(*) AS n, min(ord) AS f FROM m WHERE note_path IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY folder ORDER BY count(*) DESC, min(ord)) = 1)
SELECT folder, project AS old_name, n AS match_count, total_checked FROM v JOIN t USING (folder) WHERE n >= 5 AND n / total_checked::DOUBLE >= 0.8 AND project <> folder""")
def c19_auto_applied(spark, sf_dir):
    return detect.auto_applied(votes.renames(view(spark, sf_dir, "v_sample"), view(spark, sf_dir, "v_index"))).drop("confidence")


@query("f26_calendar", with_views("v_index") + """
SELECT note_path, '2024-01-02T00:00:00' AS start, '2024-01-02T23:59:59' AS "end", 'Note: ' || note_path || chr(10) || 'Source: ' || source_path AS description FROM v_index""")
def f26_calendar(spark, sf_dir):
    return detect.calendar(view(spark, sf_dir, "v_index").withColumn("event_date", F.lit("2024-01-02")))


@query("f42_source_plan", """SELECT n_name AS topic, '"' || n_name || '" recent news' AS news, n_regionkey = 2 AS chinese, 'https://en.wikipedia.org/wiki/' || replace(n_name, ' ', '_') AS page FROM nation""")
def f42_source_plan(spark, sf_dir):
    plan = detect.source_plan(table(spark, sf_dir, "nation").select(F.col("n_name").alias("topic"), (F.col("n_regionkey") == 2).alias("chinese")))
    return plan.select("topic", F.get("english", F.lit(3)).alias("news"), (F.size("chinese") == 5).alias("chinese"), F.get("urls", F.lit(0)).alias("page"))


@query("a21_page_text", """WITH p AS (SELECT page_id, html, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\\b.*?</(script|style)\\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages)
SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, text, length(text) < 500 AS stub FROM p""")
def a21_page_text(spark, sf_dir):
    return archive.page_fields(table(spark, sf_dir, "pages"))


SLUG = "trim(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '-')"


@query("f9_stem_normalize", f"""WITH s AS (SELECT doc_id, CASE WHEN {SLUG} = '' THEN 'image' ELSE {SLUG} END AS stem FROM documents)
SELECT doc_id, stem, CASE WHEN len(stem) <= 60 THEN stem WHEN substr(stem, 61, 1) = '-' THEN left(stem, 60) ELSE rtrim(CASE WHEN contains(left(stem, 60), '-') THEN left(stem, 60 - strpos(reverse(left(stem, 60)), '-')) ELSE left(stem, 60) END, '-') END AS slug FROM s""")
def f9_stem_normalize(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", text.normalized_stem("text").alias("stem"), text.topic_slug(F.col("text")).alias("slug"))


@query("r22_scan", with_views("v_file", "v_index") + f""", h(ext, category) AS (VALUES {HANDLERS}),
bp AS (SELECT * FROM v_index QUALIFY row_number() OVER (PARTITION BY source_path ORDER BY ord DESC) = 1), bf AS (SELECT * FROM v_index QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY ord DESC) = 1),
d AS (SELECT f.*, CASE WHEN bp.fingerprint = f.fingerprint THEN 'skip' WHEN bp.fingerprint IS NOT NULL THEN 'rescan' WHEN bf.ord IS NOT NULL THEN 'rename' ELSE 'new' END AS action,
  CASE WHEN bp.ord IS NOT NULL THEN bp.note_path ELSE bf.note_path END AS existing_note_path, CASE WHEN bp.ord IS NULL THEN bf.source_path END AS old_source_path, CASE WHEN length(text) = 0 THEN 'none' WHEN length(text) <= 100 THEN 'low' ELSE 'high' END AS confidence
  FROM v_file f LEFT JOIN bp ON bp.source_path = f.path LEFT JOIN bf ON bf.fingerprint = f.fingerprint WHERE NOT (source LIKE 'src1%' OR source LIKE '%9' OR lang IN ('es', 'en')))
SELECT path, action, existing_note_path, old_source_path, CAST(make_timestamp(mtime * 1000000)::DATE AS VARCHAR) AS event_date, 'mtime' AS event_date_source, category, size AS read_bytes, confidence,
  CASE WHEN category IS NULL THEN 'unknown' WHEN category IN ('video', 'audio', 'archive') THEN category WHEN confidence = 'none' THEN 'no_content' END AS skip_reason
FROM d LEFT JOIN h ON h.ext = regexp_extract(path, '\\.([^./]+)$', 1) WHERE action <> 'skip'""")
def r22_scan(spark, sf_dir):
    return spelled(scan.scan(view(spark, sf_dir, "v_file"), view(spark, sf_dir, "v_index"), SKIPS))


@query("r1_project_pages", LABELLED + """,
b AS (SELECT project, folder, min(s) AS s, string_agg('        ' || label || ' :' || s || CASE WHEN s = e THEN ', 1d' ELSE ', ' || e END, chr(10) ORDER BY island) AS bars FROM l GROUP BY 1, 2),
g AS (SELECT project, '```mermaid' || chr(10) || 'gantt' || chr(10) || '    title ' || project || chr(10) || '    dateFormat YYYY-MM-DD' || chr(10) || string_agg('    section ' || folder || chr(10) || bars, chr(10) ORDER BY s, folder) || chr(10) || '```' AS block FROM b GROUP BY project),
p AS (SELECT project, subfolder, '### ' || subfolder || '/' || chr(10) || string_agg('- ==' || event_date || '== — [[' || note_filename || ']]', chr(10) ORDER BY event_date, note_filename) AS part FROM v_event GROUP BY 1, 2),
n AS (SELECT project, string_agg(part, chr(10) || chr(10) ORDER BY subfolder) AS nav FROM p GROUP BY project HAVING count(*) > 1),
o AS (SELECT project, party, min(ord) AS o FROM v_event GROUP BY 1, 2), q AS (SELECT project, string_agg(party, ', ' ORDER BY o) AS parties FROM o GROUP BY project),
h AS (SELECT project, CASE WHEN DATE '2024-08-01' - max(event_date) <= 180 THEN 'active' WHEN DATE '2024-08-01' - max(event_date) <= 730 THEN 'on-hold' ELSE 'completed' END AS status, min(event_date) AS s FROM v_event GROUP BY project)
SELECT project, concat_ws(chr(10) || chr(10), '---' || chr(10) || 'project: ' || project || chr(10) || 'status: ' || status || chr(10) || 'timeline_start: ' || h.s || chr(10) || '---', '# ' || project,
  '## Parties' || chr(10) || chr(10) || parties, '## Timeline' || chr(10) || chr(10) || block, '## Substructures' || chr(10) || chr(10) || nav) AS page FROM h LEFT JOIN q USING (project) LEFT JOIN g USING (project) LEFT JOIN n USING (project)""")
def r1_project_pages(spark, sf_dir):
    return scan.project_pages(events(spark, sf_dir), TODAY)


@query("r10_research_report", f"""WITH {SOURCES}, n AS (SELECT *, page_id % 7 AS report, row_number() OVER (PARTITION BY page_id % 7 ORDER BY tier, page_id) AS k FROM t)
SELECT report, 'tier 1: ' || count(*) FILTER (tier = 1) || ', tier 2: ' || count(*) FILTER (tier = 2) || ', tier 3: ' || count(*) FILTER (tier = 3) || ', tier 4: ' || count(*) FILTER (tier = 4) || chr(10) || chr(10)
  || string_agg('[^' || k || ']: ' || url || ' (tier ' || tier || ')', chr(10) ORDER BY k) AS block FROM n GROUP BY report""")
def r10_research_report(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") % 7).alias("report"), "url", urls.tier(F.col("url"), tiers=TIERS).alias("tier"), F.col("page_id").alias("ord"))
    return research.report(pages)


HEALTH = f"""n AS (SELECT note_path, 'n' || k AS stem, 'n' || (k * 4 % 500) AS target, k FROM ({FM.format("documents")})),
v AS (SELECT note_path, CASE WHEN schema_version = '3' THEN 'version' WHEN file_type = 'weird' THEN 'enum:file_type' WHEN sources_read = '[]' AND read_bytes <> '0' THEN 'bytes-without-sources' WHEN domain = 'a/b' THEN 'domain-path' WHEN images_embedded = '2' THEN 'images-without-attachments' END AS violation FROM ({FM.format("documents")})),
h AS (SELECT 'orphan' AS "check", stem AS note, '' AS detail FROM n WHERE stem NOT IN (SELECT target FROM n WHERE target <> stem)
UNION ALL SELECT 'broken-source', note_path, f.path || 'x' FROM n JOIN v_file f ON f.ord = n.k WHERE f.path || 'x' NOT IN (SELECT path FROM v_file) AND n.k % 3 = 0
UNION ALL SELECT 'schema', note_path, violation FROM v WHERE violation IS NOT NULL
UNION ALL SELECT 'repeated', source_path, 'path' FROM v_index GROUP BY source_path HAVING count(*) > 1
UNION ALL SELECT 'repeated', fingerprint, 'fingerprint' FROM v_index GROUP BY fingerprint HAVING count(DISTINCT source_path) > 1
UNION ALL SELECT 'body', note_path, 'stop word: [[n12' FROM n WHERE starts_with(target, 'n12')
UNION ALL SELECT 'missing-attachment', note_path, 'a' || k % 5 FROM n WHERE k % 5 > 2)"""


def health(spark, sf_dir):
    own = frontmatter(spark, sf_dir).join(view(spark, sf_dir, "v_file").select(F.col("ord").alias("k"), "path"), "k")
    body = F.concat(F.lit("[[n"), (F.col("k") * 4 % 500).cast("string"), F.lit("]]"))
    source = F.when(F.col("k") % 3 == 0, F.concat("path", F.lit("x"))).otherwise(F.col("path"))
    notes = own.select("note_path", F.concat(F.lit("n"), "k").alias("stem"), body.alias("body"), source.alias("source_path"), "fm", F.array(F.concat(F.lit("a"), (F.col("k") % 5).cast("string"))).alias("attachments"))
    files = spark.createDataFrame([(f"a{k}",) for k in range(3)], "name string")
    return audit.health(notes, view(spark, sf_dir, "v_index"), view(spark, sf_dir, "v_file"), files, ["[[n12"])


@query("r11_health", with_views("v_file", "v_index") + ",\n" + HEALTH + '\nSELECT "check", note, detail FROM h')
def r11_health(spark, sf_dir):
    return health(spark, sf_dir)


@query("e11_health_counts", with_views("v_file", "v_index") + ",\n" + HEALTH + """
SELECT c AS "check", count(h.note) AS n FROM (VALUES ('orphan'), ('broken-source'), ('schema'), ('repeated'), ('stale-rename'), ('missing-attachment'), ('body')) t(c) LEFT JOIN h ON h."check" = c GROUP BY c""")
def e11_health_counts(spark, sf_dir):
    return reports.check_counts(health(spark, sf_dir), audit.CHECKS)


FLAGS = """SELECT source AS project, doc_id % 3 = 0 AS needs_fix, doc_id % 4 = 0 AS misrouted, doc_id % 5 = 0 AS source_missing, doc_id % 7 = 0 AS source_unknown, doc_id % 2 = 0 AS unverified FROM {}"""


@query("r12_reconcile_counts", f"""WITH f AS ({FLAGS.format("documents")})
SELECT project, count(*) AS notes, count(*) FILTER (NOT (needs_fix OR misrouted OR source_missing)) AS valid, count(*) FILTER (needs_fix) AS needs_fix, count(*) FILTER (misrouted) AS misrouted,
  count(*) FILTER (source_missing) AS source_missing, count(*) FILTER (source_unknown) AS source_unknown, count(*) FILTER (unverified) AS unverified FROM f GROUP BY project""")
def r12_reconcile_counts(spark, sf_dir):
    return reports.reconcile_counts(spark.sql(FLAGS.format("{documents}"), documents=table(spark, sf_dir, "documents")))


# Pages with frontmatter, an overview, a kept section, one of the user's own, and markers on every other one.
PAGES = """SELECT CAST(p_partkey AS STRING) AS project, p_partkey, p_name, p_type, p_size, '---' || chr(10) || 'project: ' || p_name || chr(10) || 'status: "active"' || chr(10) || '---' || chr(10) || '# ' || p_name || chr(10) || chr(10)
  || '> [!abstract] Overview' || chr(10) || '> ' || p_type || chr(10) || '> second' || chr(10) || chr(10) || '## Parties' || chr(10) || chr(10) || p_name || chr(10) || chr(10) || '## Mine' || chr(10) || p_type || chr(10) || chr(10)
  || CASE WHEN p_partkey % 2 = 0 THEN '<!-- auto-start -->' || chr(10) || '## Timeline' || chr(10) || 'x' || chr(10) || '<!-- auto-end -->' || chr(10) || 'tail' ELSE '## Budget' || chr(10) || CAST(p_size AS STRING) END AS page FROM {}"""


def page_rows(spark, sf_dir):
    return spark.sql(PAGES.format("{part}"), part=table(spark, sf_dir, "part"))


@query("a17_existing_pages", f"""WITH p AS ({PAGES.format("part")})
SELECT project, p_name AS name, 'active' AS status, p_type || chr(10) || 'second' AS overview, p_name AS parties, CASE WHEN p_partkey % 2 = 1 THEN CAST(p_size AS VARCHAR) ELSE '' END AS budget,
  '## Mine' || chr(10) || p_type || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || chr(10) || '<!-- auto-start -->' ELSE '' END AS user_sections, p_partkey % 2 = 0 AS has_markers,
  CASE WHEN p_partkey % 2 = 0 THEN regexp_replace(split_part(split_part(page, chr(10) || '---' || chr(10), 2), chr(10) || chr(10) || '<!-- auto-start', 1), '\\s+$', '') ELSE '' END AS marker_head, CASE WHEN p_partkey % 2 = 0 THEN 'tail' ELSE '' END AS marker_tail FROM p""")
def a17_existing_pages(spark, sf_dir):
    found = pages.existing(page_rows(spark, sf_dir))
    return found.select("project", F.col("frontmatter")["project"].alias("name"), F.col("frontmatter")["status"].alias("status"), "overview", "parties", "budget", "user_sections", "has_markers", "marker_head", "marker_tail")


@query("r6_regenerated_pages", f"""WITH p AS ({PAGES.format("part")}), g AS (SELECT *, '<!-- auto-start -->' || chr(10) || 'new' || chr(10) || '<!-- auto-end -->' AS body, chr(10) || chr(10) AS br FROM p)
SELECT project, CASE WHEN p_partkey % 2 = 0 THEN '# ' || p_name || br || '> [!abstract] Overview' || chr(10) || '> ' || p_type || chr(10) || '> second' || br || '## Parties' || br || p_name || br || '## Mine' || chr(10) || p_type || br || body || br || 'tail'
  ELSE '> [!abstract] Overview' || chr(10) || '> ' || p_type || chr(10) || '> second' || br || body || br || '## Parties' || br || p_name || br || '## Budget' || br || p_size || br || '## Mine' || chr(10) || p_type END AS page FROM g""")
def r6_regenerated_pages(spark, sf_dir):
    old = page_rows(spark, sf_dir)
    return pages.regenerated(old.select("project", F.lit("new").alias("page")), old)


@query("r16_index_events", with_views("v_index") + """
SELECT split_part(note_path, '/', 2) AS project, split_part(note_path, '/', 3) AS subfolder, substr(split_part(note_path, '/', 4), 1, 10) AS event_date, regexp_replace(split_part(note_path, '/', 4), '\\.md$', '') AS note_filename FROM (SELECT DISTINCT note_path FROM v_index)""")
def r16_index_events(spark, sf_dir):
    return spelled(pages.events_of_index(view(spark, sf_dir, "v_index")).select("project", "subfolder", "event_date", "note_filename"))


@query("r5_compose_tasks", with_views("v_event") + """
SELECT project, string_agg(note_filename, '|' ORDER BY event_date, note_filename) AS notes, (SELECT string_agg(s, '|' ORDER BY s) FROM (SELECT DISTINCT subfolder AS s FROM v_event b WHERE b.project = a.project)) AS subfolders, CAST(NULL AS VARCHAR) AS kept FROM v_event a GROUP BY project""")
def r5_compose_tasks(spark, sf_dir):
    tasks = pages.compose_tasks(events(spark, sf_dir), page_rows(spark, sf_dir))
    return tasks.select("project", F.array_join("notes", "|").alias("notes"), F.array_join("subfolders", "|").alias("subfolders"), F.array_join(F.map_keys("preserved"), "|").alias("kept"))


@query("r9_table_view", with_views("v_index") + """
SELECT split_part(note_path, '/', 2) AS project, split_part(note_path, '/', 4) AS file, '2024-01-01' AS event_date, 'high' AS content_confidence, 'retro' AS scan_type FROM v_index WHERE ord % 6 <> 1""")
def r9_table_view(spark, sf_dir):
    notes = view(spark, sf_dir, "v_index").select(paths.project_of_note(F.col("note_path")).alias("project"), "note_path", F.lit("2024-01-01").alias("event_date"), F.lit("high").alias("content_confidence"), F.lit("retro").alias("scan_type"), F.when(F.col("ord") % 6 == 1, "project-index").alias("note_type"))
    return pages.table_view(notes)


@query("r18_scan_reports", """WITH w AS (SELECT c_nationkey AS report, c_name, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
l AS (SELECT report, string_agg('- `' || c_name || '`', chr(10) ORDER BY k) || CASE WHEN max(n) > 50 THEN chr(10) || '- …and ' || (max(n) - 50) || ' more' ELSE '' END AS lines, max(n) AS n FROM w WHERE k <= 50 GROUP BY report),
g AS (SELECT n_nationkey AS report, string_agg('- ' || s_name, chr(10) ORDER BY s_suppkey) AS warned FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1)
SELECT n_nationkey AS report, '2024-08-01_10-00-00_retro.md' AS file_name, '# retro report' || chr(10) || chr(10) || '- **Scan type:** retro' || chr(10) || '- **Started:** 2024-08-01T09:00:00' || chr(10) || '- **Finished:** 2024-08-01T10:00:00'
  || coalesce(chr(10) || chr(10) || '## Counts' || chr(10) || chr(10) || '- **notes:** ' || l.n, '') || coalesce(chr(10) || chr(10) || '## Notes written' || chr(10) || chr(10) || lines, '') || coalesce(chr(10) || chr(10) || '## Warnings' || chr(10) || chr(10) || warned, '') || chr(10) AS body
FROM nation LEFT JOIN l ON l.report = n_nationkey LEFT JOIN g ON g.report = n_nationkey""")
def r18_scan_reports(spark, sf_dir):
    at = lambda hour: F.lit(f"2024-08-01 {hour}:00:00").cast("timestamp_ntz")
    own = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("report"), F.lit("retro").alias("kind"), at("09").alias("started"), at("10").alias("finished"))
    notes = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("report"), F.col("c_custkey").alias("ord"), F.col("c_name").alias("path"))
    counts = notes.groupBy("report").agg(F.count("*").alias("value")).select("report", F.lit(0).alias("ord"), F.lit("notes").alias("name"), "value")
    return reports.scan_reports(own, counts, notes, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("report"), F.col("s_suppkey").alias("ord"), F.col("s_name").alias("text")))


@query("r19_log_text", with_views("v_log") + """, t AS (SELECT * FROM v_log ORDER BY ord DESC LIMIT 200), c AS (SELECT role, count(*) AS n FROM t GROUP BY role)
SELECT '## Counters' || chr(10) || chr(10) || (SELECT string_agg('- ' || role || ': ' || n, chr(10) ORDER BY role) FROM c) || chr(10) || chr(10) || '## Entries' || chr(10) || chr(10)
  || (SELECT string_agg('- **' || conv_id || '** · `' || role || '` · turn ' || turn || CASE WHEN turn = 0 THEN '' ELSE chr(10) || '  - details: `' || turn || '`' END, chr(10) ORDER BY ord DESC) FROM t) AS body""")
def r19_log_text(spark, sf_dir):
    log = view(spark, sf_dir, "v_log")
    return reports.log_text(log.select("ord", F.col("conv_id").cast("string").alias("timestamp"), F.col("role").alias("type"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("summary"), F.when(F.col("turn") != 0, F.col("turn").cast("string")).alias("details")))


@query("a15_note_search", with_views("v_note") + "\nSELECT stem AS vault_path FROM v_note WHERE contains(body, 'n12') OR contains(stem, 'n12') ORDER BY stem LIMIT 500")
def a15_note_search(spark, sf_dir):
    return links.search_notes(view(spark, sf_dir, "v_note").withColumnRenamed("stem", "vault_path"), "N12").select("vault_path")


@query("c11_since", with_views("v_event") + "\nSELECT note_filename FROM v_event WHERE event_date BETWEEN DATE '2024-01-10' AND DATE '2024-02-10'")
def c11_since(spark, sf_dir):
    return rows.between(events(spark, sf_dir), "event_date", "2024-01-10", "2024-02-10").select("note_filename")


BANK = with_views("v_file") + """, b AS (SELECT substr(path, 10) AS path, source AS category, regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', '') AS stem, substr(sha256(text), 1, 12) AS hash, ord FROM v_file)"""


def bank(spark, sf_dir):
    return templates.bank(view(spark, sf_dir, "v_file").select(F.expr("substr(path, 10)").alias("path"), F.col("text").alias("content")))


@query("a24_template_bank", BANK + "\nSELECT path, category, stem, hash FROM b")
def a24_template_bank(spark, sf_dir):
    return bank(spark, sf_dir)


@query("b13_templates_to_install", BANK + "\nSELECT path, hash FROM b WHERE ord % 3 <> 0")
def b13_templates_to_install(spark, sf_dir):
    had = view(spark, sf_dir, "v_file").where("ord % 3 = 0").select(F.expr("substr(path, 10)").alias("path"), F.substring("fingerprint", 1, 12).alias("hash"))
    return templates.to_install(bank(spark, sf_dir), had).select("path", "hash")


@query("e16_family_index", BANK + "\nSELECT category, '## ' || replace(category, '_', ' ') || chr(10) || chr(10) || string_agg('- [[' || stem || ']]', chr(10) ORDER BY path) AS block FROM b GROUP BY category")
def e16_family_index(spark, sf_dir):
    return templates.family_index(bank(spark, sf_dir))


@query("e14_last_release", "SELECT o_custkey AS package, strftime(max(o_orderdate), '%Y-%m-%d') AS last_release FROM orders GROUP BY o_custkey")
def e14_last_release(spark, sf_dir):
    each = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("package"), "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("at"))
    files = each.groupBy("package", "o_orderpriority").agg(F.collect_list("at").alias("l"))
    return templates.last_release(files.groupBy("package").agg(F.collect_list("l").alias("releases")))


@query("e15_missing_tools", "SELECT p_brand AS tool, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS categories FROM part WHERE p_size % 3 <> 0 AND p_brand NOT LIKE '%1' GROUP BY p_brand")
def e15_missing_tools(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    needs = parts.select(F.col("p_brand").alias("tool"), F.col("p_type").alias("category"), F.when(F.col("p_size") % 3 != 0, "get").alias("install"))
    return templates.missing_tools(needs, parts.where("p_brand LIKE '%1'").select(F.col("p_brand").alias("tool")).distinct())


@query("e17_unknown_counts", STRUCTURE + "\nSELECT 'd' || len(name) AS domain, count(*) AS unknown_subfolders FROM f WHERE child_count >= 3 OR scannable GROUP BY 1")
def e17_unknown_counts(spark, sf_dir):
    files = view(spark, sf_dir, "v_file").select(F.expr("substr(path, 10)").alias("path"))
    found = routing.new_subfolders(routing.structure(files), [], [])
    return routing.unknown_counts(found.withColumn("domain", F.concat(F.lit("d"), F.char_length("name").cast("string"))))


@query("f27_project_renamed", f"""WITH p AS ({PAGES.format("part")}) SELECT project, replace(page, chr(10) || 'project: ' || p_name || chr(10), chr(10) || 'project: "New $1"' || chr(10)) AS page FROM p""")
def f27_project_renamed(spark, sf_dir):
    return page_rows(spark, sf_dir).select("project", text.with_project(F.col("page"), "New $1").alias("page"))


@query("f30_key_order", "SELECT p_partkey, p_brand || ',b,c' AS keys FROM part")
def f30_key_order(spark, sf_dir):
    fence = F.concat("p_brand", F.lit(": 1\n# note: x\n- item: y\nb:\n  nested: z\n\nc: d: e\nplain"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.key_order(fence), ",").alias("keys"))


@query("f11_research_name", "SELECT n_nationkey, '2024-08-01 ' || regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g') || '.md' AS name FROM nation")
def f11_research_name(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", text.research_name(F.col("n_name"), F.lit("2024-08-01")).alias("name"))


@query("c8_type_predicates", with_views("v_file") + "\nSELECT path, path LIKE '%.mp4' AS metadata_only, path LIKE '%.pdf' OR path LIKE '%.txt' AS readable FROM v_file")
def c8_type_predicates(spark, sf_dir):
    kind = paths.extension(F.col("path"))
    return view(spark, sf_dir, "v_file").select("path", scoring.is_metadata_only(kind).alias("metadata_only"), scoring.is_readable(kind).alias("readable"))


@query("r14_move_repairs", with_views("v_index") + """
SELECT note_path, '/new/' || substr(source_path, 10) AS source_path FROM v_index WHERE starts_with(source_path, '/archive/src')""")
def r14_move_repairs(spark, sf_dir):
    index = view(spark, sf_dir, "v_index")
    moved = index.select(paths.project_of_note(F.col("note_path")).alias("folder")).distinct().select("folder", F.lit("/archive").alias("old_parent"), F.lit("/new/").alias("new_parent"))
    return votes.repairs(moved, index)


@query("r15_project_notes", with_views("v_index") + "\nSELECT DISTINCT note_path FROM v_index WHERE starts_with(note_path, 'arch/')")
def r15_project_notes(spark, sf_dir):
    return votes.project_notes(view(spark, sf_dir, "v_index"), "arch")


@query("t2_merge", with_views("v_file", "v_index") + """,
bp AS (SELECT * FROM v_index QUALIFY row_number() OVER (PARTITION BY source_path ORDER BY ord DESC) = 1), bf AS (SELECT * FROM v_index QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY ord DESC) = 1),
d AS (SELECT path, f.fingerprint, CASE WHEN bp.ord IS NOT NULL THEN bp.note_path ELSE bf.note_path END AS note, bp.fingerprint = f.fingerprint AS same FROM v_file f LEFT JOIN bp ON bp.source_path = f.path LEFT JOIN bf ON bf.fingerprint = f.fingerprint),
m AS (SELECT path AS source_path, fingerprint, coalesce(note, '') AS note_path FROM d WHERE same IS NOT TRUE)
SELECT source_path, fingerprint, note_path, 1000 AS least_ord, (SELECT count(*) FROM m) AS ords FROM m""")
def t2_merge(spark, sf_dir):
    files, index = view(spark, sf_dir, "v_file"), view(spark, sf_dir, "v_index")
    new = lookup.merge(index, lookup.lookup(files, index), files, 999)
    sums = new.agg(F.min("ord").alias("least_ord"), F.count_distinct("ord").alias("ords"))
    return new.drop("ord").crossJoin(sums)  # one row


@query("a18_log_entries", with_views("v_log") + """
SELECT CAST(conv_id AS VARCHAR) AS file, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS entry, '## ' || turn || ' | ' || role AS header, 'turn ' || turn || chr(10) || '- ' || length(text) AS body FROM v_log""")
def a18_log_entries(spark, sf_dir):
    said = [F.concat(F.lit("## "), F.col("turn").cast("string"), F.lit(" | "), "role"), F.concat(F.lit("turn "), F.col("turn").cast("string")), F.concat(F.lit("- "), F.char_length("text").cast("string"))]
    lines = view(spark, sf_dir, "v_log").select(F.col("conv_id").cast("string").alias("file"), "turn", F.posexplode(F.array(*said)).alias("k", "line"))
    first = lines.select("file").distinct().select("file", F.lit(-1).cast("long").alias("pos"), F.lit("before any entry").alias("line"))
    return rows.log_entries(lines.select("file", (F.col("turn") * 3 + F.col("k")).cast("long").alias("pos"), "line").unionByName(first))


@query("a25_image_urls", with_views("v_file") + """
SELECT path AS note, 'http://x/' || (ord % 3) || '.png' AS url, 1 AS k FROM v_file UNION ALL SELECT path, 'http://x/' || (ord % 5 + 10) || '.png', 2 FROM v_file""")
def a25_image_urls(spark, sf_dir):
    image = lambda n: F.concat(F.lit("![a](http://x/"), n.cast("string"), F.lit(".png) "))
    body = F.concat(image(F.col("ord") % 3), image(F.col("ord") % 5 + 10), image(F.col("ord") % 3), F.lit("[no](http://x/z.png)"))
    return research.image_urls(view(spark, sf_dir, "v_file").select(F.col("path").alias("note"), body.alias("body")))


@query("f17_abstracts", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'said ' || p_name ELSE p_name || ' is a part of some kind.' END AS abstract FROM part")
def f17_abstracts(spark, sf_dir):
    marked = F.concat(F.lit("# T\n> [!abstract] Overview\n> said\n> "), "p_name", F.lit("\n\ntext"))
    plain = F.concat(F.lit("# T\n\n- "), "p_name", F.lit(" is a part of some kind. More of it.\n"))
    return table(spark, sf_dir, "part").select("p_partkey", text.abstract(F.when(F.col("p_partkey") % 2 == 0, marked).otherwise(plain)).alias("abstract"))


@query("k2_index_notes", """WITH f AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'lost' ELSE 'active' END AS status, CASE WHEN c_custkey % 4 = 0 THEN '2024-1-1' ELSE '2024-01-01' END AS s, CASE WHEN c_custkey % 5 = 0 THEN 'a/b' ELSE 'a' END AS domain FROM customer),
c AS (SELECT c_custkey, list_filter([CASE WHEN status = 'lost' THEN 'enum:status' END, CASE WHEN s = '2024-1-1' THEN 'date:timeline_start' END, CASE WHEN domain = 'a/b' THEN 'domain-path' END], lambda x: x IS NOT NULL) AS v FROM f)
SELECT CAST(c_custkey AS VARCHAR) AS note_path, (i - 1)::INT AS pos, v[i] AS violation FROM (SELECT c_custkey, v, unnest(range(1, len(v) + 1)) AS i FROM c)""")
def k2_index_notes(spark, sf_dir):
    own = {"status": F.when(F.col("c_custkey") % 3 == 0, "lost").otherwise("active"), "timeline_start": F.when(F.col("c_custkey") % 4 == 0, "2024-1-1").otherwise("2024-01-01"), "domain": F.when(F.col("c_custkey") % 5 == 0, "a/b").otherwise("a"), "note_type": F.lit(model.INDEX_NOTE_TYPE)}
    own |= {f: F.lit("x") for f in model.INDEX_NOTE_REQUIRED if f not in own}
    own |= {f: F.lit("") for f in ("timeline_end",)}
    fm = F.create_map(*[x for k, v in own.items() for x in (F.lit(k), v)])
    return validate.violations(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("note_path"), fm.alias("fm")))


@query("k10_effective", """SELECT n_name AS name, 'p,d' || n_regionkey || ',t' AS skip_patterns, CASE WHEN n_nationkey % 2 = 0 THEN 'own' ELSE 'all' END AS fallback, 'd' || n_nationkey AS tone, 't' AS font FROM nation""")
def k10_effective(spark, sf_dir):
    none = F.array().cast("array<string>")
    style = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v)])
    lists = lambda own: [(own if c == "skip_patterns" else none).alias(c) for c in config.LISTS]
    nation = table(spark, sf_dir, "nation")
    domains = nation.select(F.col("n_name").alias("name"), F.lit("t1").alias("template"), F.lit("/a").alias("archive_root"), *lists(F.array(F.concat(F.lit("d"), F.col("n_regionkey").cast("string")), F.lit("t"))), F.when(F.col("n_nationkey") % 2 == 0, "own").otherwise("").alias("fallback"), style(tone=F.concat(F.lit("d"), F.col("n_nationkey").cast("string"))).alias("style"))
    one = spark.range(1)
    templates_ = one.select(F.lit("t1").alias("name"), *lists(F.array(F.lit("t"))), F.lit(None).cast("string").alias("fallback"), style(tone=F.lit("t"), font=F.lit("t")).alias("style"))
    project = one.select(*lists(F.array(F.lit("p"))), F.lit(None).cast("string").alias("fallback"), F.lit(None).cast("map<string,string>").alias("style"), F.lit(None).cast("map<string,string>").alias("global_style"))
    found = config.effective(domains, templates_, project)
    return found.select("name", F.array_join("skip_patterns", ",").alias("skip_patterns"), F.when(F.col("fallback") == "Inbox", "all").otherwise(F.col("fallback")).alias("fallback"), F.col("style")["tone"].alias("tone"), F.col("style")["font"].alias("font"))


@query("b3_newest_snapshots", "SELECT o_orderkey, o_orderstatus AS snapshot FROM orders WHERE o_orderstatus IN (SELECT DISTINCT o_orderstatus FROM orders ORDER BY 1 DESC LIMIT 2)")
def b3_newest_snapshots(spark, sf_dir):
    return lookup.newest_snapshots(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("snapshot")))


@query("f16_yaml_quote", """SELECT doc_id, CASE WHEN regexp_matches(source, '[0-9]') AND lang = 'en' THEN '"' || source || ': x"' ELSE source END AS quoted FROM documents""")
def f16_yaml_quote(spark, sf_dir):
    risky = F.when(F.col("lang") == "en", F.concat("source", F.lit(": x"))).otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", text.yaml_quote(risky).alias("quoted"))


from foliary import catalog_columns, catalog_notes  # noqa: E402, F401  they add their queries to these
