"""Queries over journals, events, files and run histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, text, timefmt
from ..operators import graph, journal, review, rollup
from ..sources import listing
from ..sources.tables import upsert
from ..streaming import streams

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark, d, t):
    return spark.read.parquet(f"{d}/{t}.parquet")


# Events as a state journal: a user is the item, the event id the line number.
STATUS = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' ELSE 'queued' END"
LOG = f"log AS (SELECT user_id AS item, event_id AS line_no, {STATUS} AS status, event_id % 3 AS batch, value FROM events)"


def _log(spark, d):
    return read(spark, d, "events").selectExpr("user_id AS item", "event_id AS line_no", f"{STATUS} AS status", "event_id % 3 AS batch", "value")


@query(f"WITH {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY line_no DESC) AS k FROM log) SELECT item, line_no, status, batch, value FROM r WHERE k = 1")
def last_write_wins(spark, d):
    return journal.last_per_key(_log(spark, d), ["item"], "line_no")


@query(f"WITH {LOG}, l AS (SELECT item, arg_max(status, line_no) AS s FROM log GROUP BY 1) SELECT count_if(s = 'done') AS processed, count_if(s = 'failed') AS failed, count(*) AS keys FROM l")
def progress_counts(spark, d):
    return journal.progress(_log(spark, d), "item", "status", "line_no")


@query(f"WITH {LOG} SELECT c_custkey AS item, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT item FROM log)")
def resume_pending(spark, d):
    m = read(spark, d, "customer").selectExpr("c_custkey AS item", "c_mktsegment")
    return journal.pending(m, _log(spark, d), "item")


@query(
    f"""WITH {LOG}, l AS (SELECT item, arg_max(status, line_no) AS s, arg_max(batch, line_no) AS b FROM log GROUP BY 1),
f AS (SELECT item AS photo_id, batch, item || '_' || (line_no % 7) AS face_id, line_no, value FROM log), ok AS (SELECT f.* FROM f JOIN l ON f.photo_id = l.item AND f.batch = l.b AND l.s = 'done'),
r AS (SELECT *, row_number() OVER (PARTITION BY face_id ORDER BY line_no DESC) AS k FROM ok) SELECT photo_id, batch, face_id, line_no, value FROM r WHERE k = 1"""
)
def consolidate_commit(spark, d):
    log = _log(spark, d)
    faces = log.selectExpr("item AS photo_id", "batch", "concat(item, '_', line_no % 7) AS face_id", "line_no", "value")
    return journal.committed(faces, log.selectExpr("item AS photo_id", "batch", "line_no", "status"))


@query("WITH j AS (SELECT event_id AS record_id, event_id % 5 = 0 AS retracted, event_id // 2 AS subject, event_type AS kind FROM events) SELECT record_id, kind FROM j WHERE NOT retracted AND record_id NOT IN (SELECT subject FROM j WHERE retracted)")
def retract_live(spark, d):
    j = read(spark, d, "events").selectExpr("event_id AS record_id", "event_id % 5 = 0 AS retracted", "event_id div 2 AS subject", "event_type AS kind")
    return journal.live(j).select("record_id", "kind")


@query("SELECT * FROM (SELECT conv_id, turn AS a, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b IS NOT NULL")
def adjacent_turn_pairs(spark, d):
    return journal.neighbours(read(spark, d, "conversations"), "turn", "turn", "conv_id")


@query("WITH l AS (SELECT user_id, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS new FROM events) SELECT user_id, count_if(new) AS changes, count(*) AS rows FROM l GROUP BY 1")
def log_change_count(spark, d):
    return journal.changes(read(spark, d, "events"), "event_type", "event_id", "user_id")


@query("SELECT user_id, back::INT AS back, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events) WHERE back <= 60")
def last_sixty(spark, d):
    return journal.latest(read(spark, d, "events").select("user_id", "event_id"), 60, "event_id", "user_id").select("user_id", "back", "event_id")


@query(
    """WITH l AS (SELECT user_id, list(value ORDER BY event_id) AS v FROM events GROUP BY 1)
SELECT user_id, round(list_reduce(v, lambda s, x: 0.7 * s + (1 - 0.7) * x), 6) AS smoothed FROM l"""
)
def smoothed_rate(spark, d):
    return journal.smoothed(read(spark, d, "events"), "value", "event_id", "user_id").select("user_id", F.round("smoothed", 6).alias("smoothed"))


@query("SELECT DISTINCT least(user_id, event_id % 150) AS a, greatest(user_id, event_id % 150) AS b FROM events WHERE user_id <> event_id % 150")
def distinct_unordered_pairs(spark, d):
    return journal.distinct_pairs(read(spark, d, "events").selectExpr("user_id AS a", "event_id % 150 AS b"))


RUNS = """runs AS (SELECT (o_custkey % 40)::BIGINT AS event_id, o_orderkey AS ord, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END AS reviewer, o_orderstatus AS phase, o_orderdate AS stamp,
  CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE o_orderkey % 500 END AS photos, floor(o_totalprice / 100)::DOUBLE AS seconds, CASE WHEN o_orderkey % 9 = 0 THEN 0.0 ELSE floor(o_totalprice / 90) END AS total FROM orders)"""


def _runs(spark, d):
    return read(spark, d, "orders").selectExpr(
        "cast(o_custkey % 40 as bigint) AS event_id", "o_orderkey AS ord", "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END AS reviewer", "o_orderstatus AS phase", "o_orderdate AS stamp",
        "CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE o_orderkey % 500 END AS photos", "double(floor(o_totalprice / 100)) AS seconds", "CASE WHEN o_orderkey % 9 = 0 THEN 0D ELSE double(floor(o_totalprice / 90)) END AS total",
    )


@query(
    f"""WITH {RUNS}, r AS (SELECT *, CASE WHEN photos > 0 AND seconds > 0 THEN seconds / photos END AS rate FROM runs)
SELECT count(*) AS runs, count(rate) AS samples, round(sum(seconds) FILTER (rate IS NOT NULL) / sum(photos) FILTER (rate IS NOT NULL), 6) AS weighted_rate, round(min(rate), 6) AS min_rate, round(max(rate), 6) AS max_rate,
  round(sum(total) FILTER (total > 0), 2) AS total_seconds, sum(photos)::BIGINT AS photos FROM r"""
)
def run_rollup(spark, d):
    return rollup.run_rollup(_runs(spark, d))


@query(
    f"""WITH {RUNS}, r AS (SELECT *, CASE WHEN photos > 0 AND seconds > 0 THEN seconds / photos END AS rate FROM runs)
SELECT event_id, round(sum(total) FILTER (total > 0), 2) AS total_seconds, round(avg(rate), 6) AS mean_rate, arg_max(reviewer, ord) FILTER (reviewer <> '') AS reviewer, arg_max(phase, ord) AS phase, max(stamp) AS last_stamp FROM r GROUP BY 1"""
)
def event_timing(spark, d):
    return rollup.event_timing(_runs(spark, d))


EVENTS = "ev AS (SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE 'f' || (o_custkey % 90) END AS folder, o_orderkey % 700 AS processed, o_orderkey % 1300 AS faces, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 50 END AS people FROM orders)"


@query(
    f"""WITH {EVENTS}, f AS (SELECT coalesce(nullif(folder, ''), '?' || event_id) AS k, max(processed) AS dist, count(*) AS n, sum(processed) AS p, sum(faces) AS faces, sum(people) AS people, count_if(people IS NULL) AS u FROM ev GROUP BY 1)
SELECT sum(n)::BIGINT AS events, sum(p)::BIGINT AS processed, sum(dist)::BIGINT AS distinct_photos, sum(greatest(0, p - dist))::BIGINT AS reprocessed, count_if(n > 1) AS shared_folders, sum(faces)::BIGINT AS faces, sum(people)::BIGINT AS people, sum(u)::BIGINT AS unmeasured FROM f"""
)
def dashboard_totals(spark, d):
    e = read(spark, d, "orders").selectExpr("o_orderkey AS event_id", "CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE concat('f', o_custkey % 90) END AS folder", "o_orderkey % 700 AS processed", "o_orderkey % 1300 AS faces", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 50 END AS people")
    return rollup.dashboard(e)


@query(
    f"""WITH {RUNS}, n AS (SELECT event_id, sum(photos) AS p, count(*) AS c FROM runs GROUP BY 1) SELECT event_id, CASE WHEN greatest(p, c) >= 500 THEN 'large' WHEN greatest(p, c) >= 100 THEN 'medium' ELSE 'small' END AS size_class,
  round(CASE WHEN p > 0 THEN least(100.0, c / p * 100) ELSE 0.0 END, 4) AS pct FROM n"""
)
def event_sizes(spark, d):
    n = _runs(spark, d).groupBy("event_id").agg(F.sum("photos").alias("p"), F.count("*").alias("c"))
    return n.select("event_id", rollup.size_class(F.col("p"), F.col("c")).alias("size_class"), F.round(rollup.progress_pct(F.col("c"), F.col("p")), 4).alias("pct"))


SECONDS = "s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN 0.4 ELSE (o_orderkey * 37 % 20000) / 2 END AS x FROM orders)"


def _seconds(spark, d):
    x = F.expr("CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN 0.4D ELSE (o_orderkey * 37 % 20000) / 2D END")
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), x.alias("x"))


@query(
    f"""WITH {SECONDS}, w AS (SELECT *, round_even(x, 0)::BIGINT AS s FROM s) SELECT k, CASE WHEN x IS NULL OR x <= 0 THEN 'not recorded' WHEN x < 1 THEN 'under 1s' WHEN s < 60 THEN printf('%ds', s) WHEN s < 3600 THEN printf('%dm %02ds', s // 60, s % 60)
  ELSE printf('%dh %02dm', s // 3600, s % 3600 // 60) END AS duration FROM w"""
)
def duration_texts(spark, d):
    """A third of the seconds lie halfway between two whole ones: they go to the even one."""
    return _seconds(spark, d).select("k", timefmt.duration_text(F.col("x")).alias("duration"))


@query(
    f"""WITH {SECONDS}, w AS (SELECT k, x, floor(x)::BIGINT AS s, floor(coalesce(x, 0))::BIGINT AS z FROM s)
SELECT k, CASE WHEN s < 60 THEN printf('%ds', s) WHEN s < 3600 THEN printf('%dm', s // 60) WHEN s >= 3600 THEN printf('%dh %dm', s // 3600, s % 3600 // 60) END AS spent,
  CASE WHEN z < 60 THEN printf('%ds', z) WHEN z < 3600 THEN printf('%d min', round_even(z / 60, 0)::BIGINT) ELSE printf('%dh %dm', z // 3600, round_even((z % 3600) / 60, 0)::BIGINT) END AS remaining FROM w"""
)
def job_clock_texts(spark, d):
    x = F.col("x")
    return _seconds(spark, d).select("k", timefmt.spent_text(x).alias("spent"), timefmt.left_text(x).alias("remaining"))


RATE = "CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 2.5 ELSE 0.75 END"


@query(
    f"""WITH s AS (SELECT o_orderkey AS k, least(greatest(o_orderkey * 13 % 9000 - 20, 0), 2000000) * coalesce({RATE}, 2.27)::DOUBLE AS x FROM orders), w AS (SELECT *, round_even(x, 0)::BIGINT AS s, round_even(round_even(x, 0) / 60, 0)::BIGINT AS m FROM s)
SELECT k, round(x, 2) AS seconds, CASE WHEN x <= 0 THEN 'no time at all' WHEN s < 60 THEN printf('%d seconds', s) WHEN m < 60 THEN printf('%d min', m) ELSE printf('%dh %02dm', m // 60, m % 60) END AS forecast FROM w"""
)
def forecast_texts(spark, d):
    x = timefmt.forecast_seconds(F.expr("o_orderkey * 13 % 9000 - 20"), F.expr(f"cast({RATE} as double)"))
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.round(x, 2).alias("seconds"), timefmt.forecast_text(x).alias("forecast"))


@query(
    """WITH t AS (SELECT event_id, ts, datediff('day', ts::DATE, DATE '2024-01-20') AS n FROM events) SELECT event_id, CASE WHEN n = 0 THEN 'Today' WHEN n = 1 THEN 'Yesterday' ELSE day(ts) || ' ' || strftime(ts, '%b %Y') END || ', ' ||
  printf('%d:%02d %s', CASE WHEN hour(ts) % 12 = 0 THEN 12 ELSE hour(ts) % 12 END, minute(ts), CASE WHEN hour(ts) < 12 THEN 'am' ELSE 'pm' END) AS shown FROM t"""
)
def relative_dates(spark, d):
    return read(spark, d, "events").select("event_id", timefmt.relative_date(F.col("ts"), F.lit("2024-01-20").cast("date")).alias("shown"))


@query("SELECT event_id, ts::TIMESTAMP(0) AS taken_at FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events) WHERE event_id % 3 < 2 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 3 = 2")
def exif_stamps(spark, d):
    shown = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy:MM:dd HH:mm:ss")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("about noon")
    return read(spark, d, "events").select("event_id", timefmt.exif_stamp(shown).alias("taken_at"))


# Every kind of name there is: known and unknown extensions in either case, none, and names that are nothing but one.
ENDS = [".jpg", ".JPEG", ".png", ".webp", ".bmp", ".tif", ".tiff", ".heic", ".HEIF", ".cr2", ".CR3", ".nef", ".arw", ".dng", ".orf", ".rw2", ".raf", ".srw", ".PEF",
        ".mp4", ".mov", ".avi", ".mkv", ".m4v", ".mts", ".M2TS", ".wmv", ".webm", ".3gp", ".txt", ".jpg.bak", ".tar.jpg", ".", ""]
_NAME = "CASE WHEN page_id % 41 = 3 THEN '' WHEN page_id % 41 = 4 THEN '..' ELSE 'img' || page_id END"
_FOLDER = "CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'trip/album' || (page_id % 7) || '/' WHEN 2 THEN 'v1.2/' ELSE 'album' || (page_id % 7) || '/' END"
PATHS = f"paths AS (SELECT page_id, {_FOLDER} || {_NAME} || {ENDS}[page_id % {len(ENDS)} + 1] AS path, length(html) AS size FROM pages)"
KIND = """CASE WHEN NOT regexp_matches(string_split(path, '/')[-1], '^[.]*[^.].*[.]') THEN 'other' ELSE CASE lower(string_split(path, '.')[-1])
  WHEN 'jpg' THEN 'image' WHEN 'jpeg' THEN 'image' WHEN 'png' THEN 'image' WHEN 'webp' THEN 'image' WHEN 'bmp' THEN 'image' WHEN 'tif' THEN 'image' WHEN 'tiff' THEN 'image' WHEN 'heic' THEN 'image' WHEN 'heif' THEN 'image'
  WHEN 'cr2' THEN 'raw' WHEN 'cr3' THEN 'raw' WHEN 'nef' THEN 'raw' WHEN 'arw' THEN 'raw' WHEN 'dng' THEN 'raw' WHEN 'orf' THEN 'raw' WHEN 'rw2' THEN 'raw' WHEN 'raf' THEN 'raw' WHEN 'srw' THEN 'raw' WHEN 'pef' THEN 'raw'
  WHEN 'mp4' THEN 'video' WHEN 'mov' THEN 'video' WHEN 'avi' THEN 'video' WHEN 'mkv' THEN 'video' WHEN 'm4v' THEN 'video' WHEN 'mts' THEN 'video' WHEN 'm2ts' THEN 'video' WHEN 'wmv' THEN 'video' WHEN 'webm' THEN 'video' WHEN '3gp' THEN 'video'
  ELSE 'other' END END"""
ALBUM = "coalesce(string_split(path, '/')[-2], '')"


def _files(spark, d):
    end = F.element_at(F.array(*map(F.lit, ENDS)), (F.col("page_id") % len(ENDS) + 1).cast("int"))
    path = F.concat(F.expr(_FOLDER), F.expr(_NAME), end)
    p = read(spark, d, "pages").select("page_id", path.alias("path"), F.length("html").alias("size"))
    return p.select("page_id", "path", "size", text.file_kind(F.col("path")).alias("kind"), text.sub_album(F.col("path")).alias("sub_album"))


@query(f"WITH {PATHS} SELECT page_id, path, {KIND} AS kind FROM paths")
def file_classify(spark, d):
    return _files(spark, d).select("page_id", "path", "kind")


@query(f"WITH {PATHS} SELECT page_id, {ALBUM} AS sub_album FROM paths")
def sub_albums(spark, d):
    return _files(spark, d).select("page_id", "sub_album")


@query(f"WITH {PATHS}, k AS (SELECT *, {KIND} AS kind FROM paths) SELECT count_if(kind = 'image') AS n_image, count_if(kind = 'raw') AS n_raw, count_if(kind = 'video') AS n_video, count_if(kind = 'other') AS n_other, sum(size)::BIGINT AS bytes FROM k")
def scan_stats(spark, d):
    return listing.scan_stats(_files(spark, d))


@query(f"WITH {PATHS}, k AS (SELECT *, {KIND} AS kind FROM paths) SELECT CASE WHEN contains(path, '/') THEN {ALBUM} ELSE '(root)' END AS album, count(*) AS n FROM k WHERE kind = 'image' GROUP BY 1")
def album_counts(spark, d):
    return listing.album_counts(_files(spark, d))


@query(f"WITH {PATHS}, k AS (SELECT *, {KIND} AS kind FROM paths) SELECT path, lpad((row_number() OVER (ORDER BY string_split(path, '/')) - 1)::VARCHAR, 6, '0') AS photo_id FROM k WHERE kind = 'image'")
def manifest_ids(spark, d):
    return listing.manifest(_files(spark, d)).select("path", "photo_id")


@query(
    f"""WITH {PATHS}, p AS (SELECT CASE WHEN path LIKE '%/%' THEN page_id % 4 ELSE page_id % 2 END AS event_id, {ALBUM} AS album FROM paths), c AS (SELECT event_id, album, count(*) AS n FROM p GROUP BY 1, 2)
SELECT event_id, count(*) AS albums, round(max(n) / sum(n), 6) AS top_share, count(*) >= 2 AND count_if(album = '') = 0 AND max(n) / sum(n) <= 0.9 AS usable FROM c GROUP BY 1"""
)
def album_truth(spark, d):
    """Files at the root are in two of the four events only."""
    event = F.when(F.col("path").contains("/"), F.col("page_id") % 4).otherwise(F.col("page_id") % 2)
    return rollup.album_truth(_files(spark, d).select(event.alias("event_id"), F.col("sub_album").alias("album")))


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'gdrive' WHEN page_id % 4 = 1 THEN 'unsupported' WHEN page_id % 4 = 2 THEN 'local' ELSE 'dropbox' END AS source, CASE WHEN page_id % 4 = 0 THEN 'id_' || page_id END AS folder_id FROM pages")
def source_dispatch(spark, d):
    link = F.when(F.col("page_id") % 4 == 0, F.format_string("https://drive.google.com/drive/u/1/folders/id_%d?x=1", "page_id")).when(F.col("page_id") % 4 == 1, F.col("url")).when(F.col("page_id") % 4 == 2, F.format_string("/data/%d", "page_id")).otherwise(F.format_string("https://www.dropbox.com/sh/%d", "page_id"))
    p = read(spark, d, "pages").select("page_id", link.alias("link"))
    return p.select("page_id", text.source_type(F.col("link")).alias("source"), text.folder_link_id(F.col("link")).alias("folder_id"))


@query("SELECT page_id, split_part(url, '://', 1) AS scheme, split_part(split_part(url, '://', 2), '/', 1) AS bucket, substr(split_part(url, '://', 2), length(split_part(split_part(url, '://', 2), '/', 1)) + 2) AS key, true AS valid FROM pages")
def object_uris(spark, d):
    p = read(spark, d, "pages")
    return p.select("page_id", *[c.alias(n) for c, n in zip(text.uri_parts(F.col("url")), ("scheme", "bucket", "key", "valid"))])


@query("SELECT DISTINCT split_part(substr(split_part(url, '://', 2), length(split_part(split_part(url, '://', 2), '/', 1)) + 2), '/', 1) AS name FROM pages WHERE url LIKE 'https://%'")
def prefix_children(spark, d):
    keys = read(spark, d, "pages").where("url like 'https://%'").select(F.concat(F.lit("all/"), F.regexp_extract("url", "^https://[^/]+/(.*)$", 1)).alias("key"))
    return listing.children(keys, "all/")


# Names with what can't be printed: line ends, a control character, a byte order mark, spaces of other widths.
ODD = "'x\\n\\t' || chr(1) || chr(8203) || chr(65279) || 'y' || chr(160) || chr(12288) || '  z '"


@query(
    f"""WITH n AS (SELECT doc_id, source, lang, CASE WHEN doc_id % 7 = 0 THEN {ODD.replace("'x\\n\\t'", "'x' || chr(10) || chr(9)")} || text ELSE text END AS t FROM documents),
c AS (SELECT *, regexp_replace(regexp_replace(coalesce(t, ''), '[\\r\\n\\t]', ' ', 'g'), '[\\x{{00}}-\\x{{1F}}\\x{{7F}}-\\x{{A0}}\\x{{AD}}\\x{{1680}}\\x{{2000}}-\\x{{200F}}\\x{{2028}}-\\x{{202F}}\\x{{205F}}-\\x{{206F}}\\x{{3000}}\\x{{FEFF}}]', '', 'g') AS s FROM n)
SELECT doc_id, trim(left(trim(regexp_replace(s, ' +', ' ', 'g'), ' '), 40), ' ') AS name, trim(regexp_replace(lower(source || ' / ' || lang), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM c"""
)
def names_and_slugs(spark, d):
    odd = F.concat(F.lit("x\n\t\x01\u200b\ufeffy\u00a0\u3000  z "), F.col("text"))
    x = read(spark, d, "documents")
    named = F.when(F.col("doc_id") % 7 == 0, odd).otherwise(F.col("text"))
    return x.select("doc_id", text.clean_name(named, 40).alias("name"), text.slug(F.concat(F.col("source"), F.lit(" / "), F.col("lang"))).alias("slug"))


LINKS = """links AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'C:\\\\My Photos\\\\Trip ' || (page_id % 9) || '\\\\' WHEN 2 THEN '/data/' || repeat('Long Name ', 5) || (page_id % 4) WHEN 3 THEN '///' ELSE '/' || (page_id % 11) END AS link FROM pages)"""
TAKEN = "taken AS (SELECT 'ev-trip-' || (p_partkey % 6) || CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN '-0812' ELSE '-0812-' || (p_partkey % 4) END AS event_id FROM part UNION SELECT 'ev-event' UNION SELECT 'ev-' || (p_partkey % 5) FROM part)"


@query(
    f"""WITH {LINKS.replace(chr(92) * 4, chr(92))}, {TAKEN}, t AS (SELECT page_id, link, list_filter(string_split_regex(regexp_replace(link, '[/\\\\]+$', ''), '[/\\\\]'), lambda x: true)[-1] AS tail FROM links),
b AS (SELECT page_id, link, 'ev-' || coalesce(nullif(left(lower(trim(regexp_replace(coalesce(nullif(tail, ''), 'event'), '[^A-Za-z0-9]+', '-', 'g'), '-')), 28), ''), 'event') AS base FROM t),
n AS (SELECT page_id, base, min(k) AS k FROM b, range(1, 1000) AS r(k) WHERE base || '-0812' || CASE WHEN k = 1 THEN '' ELSE '-' || k END NOT IN (SELECT event_id FROM taken) GROUP BY 1, 2)
SELECT page_id, CASE WHEN base NOT IN (SELECT event_id FROM taken) THEN base WHEN k = 1 THEN base || '-0812' ELSE base || '-0812-' || k END AS event_id FROM n"""
)
def suggested_ids(spark, d):
    from ..operators.events import free_ids

    taken = read(spark, d, "part").selectExpr("concat('ev-trip-', p_partkey % 6, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN '-0812' ELSE concat('-0812-', p_partkey % 4) END) AS event_id")
    taken = taken.unionAll(spark.sql("select 'ev-event' AS event_id")).unionAll(read(spark, d, "part").selectExpr("concat('ev-', p_partkey % 5) AS event_id"))
    link = F.expr("CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN concat('C:\\\\My Photos\\\\Trip ', page_id % 9, '\\\\') WHEN 2 THEN concat('/data/', repeat('Long Name ', 5), page_id % 4) WHEN 3 THEN '///' ELSE concat('/', page_id % 11) END")
    links = read(spark, d, "pages").select("page_id", link.alias("link"))
    return links.join(free_ids(links.select("link").distinct(), taken, "0812"), "link").select("page_id", "event_id")


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def json_fields(spark, d):
    return read(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'renamed' ELSE c_name END AS c_name FROM customer")
def label_upsert(spark, d):
    t = read(spark, d, "customer").select("c_custkey", "c_name")
    new = t.where("c_custkey % 3 = 0 or c_custkey % 5 = 0").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, "").otherwise("renamed").alias("c_name"))
    return upsert(t, new, "c_custkey")


CLAIMS = "claims AS (SELECT DISTINCT user_id AS a, (user_id * 7 + 3) % 150 AS b FROM events)"


def _claims(spark, d):
    return read(spark, d, "events").selectExpr("user_id AS a", "(user_id * 7 + 3) % 150 AS b").distinct()


# Each round takes the least node reached so far from a node's neighbours; nodes stop changing after as many rounds as their chain is long.
CLOSED = f"""{CLAIMS}, both_ways AS (SELECT a, b FROM claims WHERE a <> b UNION SELECT b, a FROM claims WHERE a <> b), reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT w.b, r.b FROM reach r JOIN both_ways w ON r.a = w.a AND r.b < w.b),
comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a)"""


@query(f"WITH RECURSIVE {CLOSED} SELECT node, component FROM comp")
def components_same_group(spark, d):
    return graph.components(_claims(spark, d))


@query(
    f"""WITH RECURSIVE {CLOSED}, kept AS (SELECT * FROM comp WHERE node % 11 <> 0), sizes AS (SELECT component, count(*) AS n, min(node) AS f FROM kept GROUP BY 1 HAVING count(*) > 1)
SELECT node, label FROM kept JOIN (SELECT component, 'T' || row_number() OVER (ORDER BY n DESC, f) AS label FROM sizes) USING (component)"""
)
def truth_labels(spark, d):
    c = _claims(spark, d)
    return graph.truth(c, c.selectExpr("a AS node").union(c.select("b")).distinct().where("node % 11 = 0"))


@query(f"WITH RECURSIVE {CLOSED}, diff AS (SELECT DISTINCT user_id AS a, (user_id * 3 + 1) % 150 AS b FROM events) SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM diff JOIN comp x ON x.node = a JOIN comp y ON y.node = b WHERE x.component = y.component")
def contradictions(spark, d):
    diff = read(spark, d, "events").selectExpr("user_id AS a", "(user_id * 3 + 1) % 150 AS b").distinct()
    return graph.contradictions(graph.components(_claims(spark, d)), diff)


@query("SELECT o_custkey % 20 AS event_id, count(*) AS piles, count_if(o_orderstatus = 'F') AS answered, sum(o_orderkey % 4)::BIGINT AS fixed, round(100.0 * count_if(o_orderstatus = 'F') / count(*), 1) AS pct FROM orders GROUP BY 1")
def review_progress(spark, d):
    return review.review_progress(read(spark, d, "orders").selectExpr("o_custkey % 20 AS event_id", "o_orderstatus = 'F' AS approved", "o_orderkey % 4 AS fixed"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def page_slice(spark, d):
    return review.page(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), "o_orderkey"], 3, 25)


SIZES = "photos AS (SELECT p_partkey AS photo_id, 1000 + p_partkey * 37 % 9000 AS width, 900 + p_partkey * 53 % 7000 AS height FROM part)"


@query(
    f"""WITH {SIZES}, n AS (SELECT *, greatest(1, least(4, ceil((width / 2560.0 - 0.2) / 0.8)))::INT AS nx, greatest(1, least(4, ceil((height / 2560.0 - 0.2) / 0.8)))::INT AS ny FROM photos WHERE least(width, height) >= 1600),
t AS (SELECT *, ceil(width / (nx - (nx - 1) * 0.2))::INT AS w, ceil(height / (ny - (ny - 1) * 0.2))::INT AS h FROM n WHERE nx * ny > 1)
SELECT photo_id, tx::INT AS tx, ty::INT AS ty, (CASE WHEN tx = nx - 1 THEN width - w ELSE floor(tx * w * 0.8) END)::INT AS x0, (CASE WHEN ty = ny - 1 THEN height - h ELSE floor(ty * h * 0.8) END)::INT AS y0, w, h FROM t, unnest(range(nx)) AS a(tx), unnest(range(ny)) AS b(ty)"""
)
def tile_plan(spark, d):
    p = read(spark, d, "part").selectExpr("p_partkey AS photo_id", "1000 + p_partkey * 37 % 9000 AS width", "900 + p_partkey * 53 % 7000 AS height")
    return geometry.tile_grid(p, 2560.0)


CUTS = """tiles AS (SELECT p.photo_id, width, height, x0 AS tx0, y0 AS ty0, w, h, (photo_id * 31 + tx * 7 + ty * 13) % 97 AS r FROM ({}) t JOIN photos p USING (photo_id)),
raw AS (SELECT *, r * 40 - 300 AS x0, r * 23 % 900 - 200 AS y0, r * 40 - 300 + r * 9 AS x1, r * 23 % 900 - 200 + r * 11 AS y1 FROM tiles)"""


def _tile_boxes(spark, d):
    """A box in every tile of `tile_plan`: small and large ones, within, over and beyond the edges."""
    photos = read(spark, d, "part").selectExpr("p_partkey AS photo_id", "1000 + p_partkey * 37 % 9000 AS width", "900 + p_partkey * 53 % 7000 AS height")
    tiles = geometry.tile_grid(photos, 2560.0).withColumn("r", F.expr("(photo_id * 31 + tx * 7 + ty * 13) % 97")).withColumnsRenamed({"x0": "tx0", "y0": "ty0"})
    box = {"x0": "r * 40 - 300", "y0": "r * 23 % 900 - 200", "x1": "r * 40 - 300 + r * 9", "y1": "r * 23 % 900 - 200 + r * 11"}
    return tiles.join(photos, "photo_id").withColumns({k: F.expr(f"double({v})") for k, v in box.items()})


@query(
    f"""WITH {SIZES}, {CUTS.format(ORACLES["tile_plan"])},
m AS (SELECT *, 0.12 * greatest(1, x1 - x0) AS mx, 0.12 * greatest(1, y1 - y0) AS my FROM raw),
k AS (SELECT * FROM m WHERE NOT (x0 < -mx AND tx0 > 0) AND NOT (y0 < -my AND ty0 > 0) AND NOT (x1 > w + mx AND tx0 + w < width) AND NOT (y1 > h + my AND ty0 + h < height)),
c AS (SELECT photo_id, tx0, ty0, greatest(0, x0 + tx0)::DOUBLE AS x0, greatest(0, y0 + ty0)::DOUBLE AS y0, least(width, x1 + tx0)::DOUBLE AS x1, least(height, y1 + ty0)::DOUBLE AS y1 FROM k)
SELECT * FROM c WHERE x1 - x0 > 1 AND y1 - y0 > 1"""
)
def tile_boxes(spark, d):
    placed = geometry.within_photo(geometry.on_photo(_tile_boxes(spark, d)))
    return placed.select("photo_id", "tx0", "ty0", "x0", "y0", "x1", "y1")


CELLS = "cells AS (SELECT l_orderkey AS id, l_linenumber AS line, CASE l_linenumber % 4 WHEN 0 THEN 8 WHEN 1 THEN 16 WHEN 2 THEN 32 ELSE 64 END AS stride, 20 + l_orderkey % 60 AS cols, l_partkey % 3000 AS cell, l_quantity / 50 AS score, [l_discount, l_tax, l_quantity, l_suppkey % 7 + 0.5] AS box FROM lineitem)"


@query(
    f"""WITH {CELLS}, p AS (SELECT *, (cell // 2 % cols * stride)::DOUBLE AS x, (cell // 2 // cols * stride)::DOUBLE AS y FROM cells WHERE score >= 0.5 AND stride < 64)
SELECT id, line, round((x - box[1] * stride) / 0.25, 4) AS x0, round((y - box[2] * stride) / 0.25, 4) AS y0, round((x + box[3] * stride) / 0.25, 4) AS x1, round((y + box[4] * stride) / 0.25, 4) AS y1,
  round((x + (box[1] - box[2]) * stride) / 0.25, 4) AS px, round((y + box[3] * stride) / 0.25, 4) AS py FROM p"""
)
def anchor_boxes(spark, d):
    cells = read(spark, d, "lineitem").selectExpr(
        "l_orderkey AS id", "l_linenumber AS line", "CASE l_linenumber % 4 WHEN 0 THEN 8 WHEN 1 THEN 16 WHEN 2 THEN 32 ELSE 64 END AS stride", "20 + l_orderkey % 60 AS columns", "l_partkey % 3000 AS cell", "double(l_quantity) / 50 AS score",
        "array(double(l_discount), double(l_tax), double(l_quantity), double(l_suppkey % 7 + 0.5)) AS box", "array(double(l_discount) - double(l_tax), double(l_quantity)) AS points",
    )
    out = geometry.decoded(cells, F.lit(0.25))
    return out.select("id", "line", *[F.round(F.element_at(c, k), 4).alias(n) for c, k, n in (("box", 1, "x0"), ("box", 2, "y0"), ("box", 3, "x1"), ("box", 4, "y1"), ("points", 1, "px"), ("points", 2, "py"))])


BOXES = "boxes AS (SELECT l_orderkey AS photo_id, l_linenumber AS box_id, (l_partkey % 40)::DOUBLE AS x0, (l_suppkey % 30)::DOUBLE AS y0, (l_partkey % 40 + 20 + l_quantity)::DOUBLE AS x1, (l_suppkey % 30 + 30)::DOUBLE AS y1, l_discount AS score FROM lineitem)"


def _boxes(spark, d):
    return read(spark, d, "lineitem").selectExpr("l_orderkey AS photo_id", "l_linenumber AS box_id", "double(l_partkey % 40) AS x0", "double(l_suppkey % 30) AS y0", "double(l_partkey % 40 + 20 + l_quantity) AS x1", "double(l_suppkey % 30 + 30) AS y1", "l_discount AS score")


@query(
    f"""WITH RECURSIVE {BOXES}, r AS (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY score DESC, box_id, x0, y0, x1, y1) AS k FROM boxes),
pass(photo_id, k, kept) AS (SELECT photo_id, k, [{{'i': box_id, 'a': x0, 'b': y0, 'c': x1, 'd': y1, 's': score}}] FROM r WHERE k = 1 UNION ALL
  SELECT r.photo_id, r.k, CASE WHEN len(list_filter(kept, lambda o: (greatest(0, least(o.c, x1) - greatest(o.a, x0)) * greatest(0, least(o.d, y1) - greatest(o.b, y0)))
      > 0.4 * ((o.c - o.a) * (o.d - o.b) + (x1 - x0) * (y1 - y0) - greatest(0, least(o.c, x1) - greatest(o.a, x0)) * greatest(0, least(o.d, y1) - greatest(o.b, y0)))
    OR greatest(0, least(o.c, x1) - greatest(o.a, x0)) * greatest(0, least(o.d, y1) - greatest(o.b, y0)) > 0.8 * least((o.c - o.a) * (o.d - o.b), (x1 - x0) * (y1 - y0)))) > 0
    THEN kept ELSE list_append(kept, {{'i': box_id, 'a': x0, 'b': y0, 'c': x1, 'd': y1, 's': score}}) END FROM pass p JOIN r ON r.photo_id = p.photo_id AND r.k = p.k + 1),
last AS (SELECT photo_id, unnest(kept) AS o FROM (SELECT photo_id, arg_max(kept, k) AS kept FROM pass GROUP BY photo_id))
SELECT photo_id, o.i AS box_id, o.a AS x0, o.b AS y0, o.c AS x1, o.d AS y1, o.s AS score FROM last"""
)
def box_suppression(spark, d):
    return geometry.suppress(_boxes(spark, d))


@query(
    f"""WITH {BOXES}, p AS (SELECT a.photo_id, a.box_id AS a, b.box_id AS b, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i,
  (a.x1 - a.x0) * (a.y1 - a.y0) AS sa, (b.x1 - b.x0) * (b.y1 - b.y0) AS sb FROM boxes a JOIN boxes b ON a.photo_id = b.photo_id AND a.box_id < b.box_id)
SELECT photo_id, a, b, round(i / (sa + sb - i) + 1e-9, 6) AS iou, round(i / least(sa, sb) + 1e-9, 6) AS containment FROM p"""
)
def box_overlaps(spark, d):
    x = _boxes(spark, d)
    a = x.selectExpr("photo_id", "box_id AS a", "x0 AS ax0", "y0 AS ay0", "x1 AS ax1", "y1 AS ay1")
    b = x.selectExpr("photo_id", "box_id AS b", "x0 AS bx0", "y0 AS by0", "x1 AS bx1", "y1 AS by1")
    box = lambda k: tuple(F.col(k + c) for c in ("x0", "y0", "x1", "y1"))
    iou, cont = geometry.overlap_measures(box("a"), box("b"))
    return a.join(b, "photo_id").where("a < b").select("photo_id", "a", "b", F.round(iou + 1e-9, 6).alias("iou"), F.round(cont + 1e-9, 6).alias("containment"))


# Streams, each against the SQL of its batch twin.
def _follow(spark, d):
    e = read(spark, d, "events")
    return streams.follow(spark, f"{d}/event[s].parquet", e.schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query(ORACLES["progress_counts"])
def stream_progress(spark, d):
    log = _follow(spark, d).selectExpr("user_id AS item", "event_id AS line_no", f"{STATUS} AS status")
    return streams.progress(spark, log, "item", "status", "line_no")


@query("SELECT event_type, count(*) AS rows, round(sum(value), 4) AS total, max(value) AS largest FROM events GROUP BY 1")
def stream_tail_totals(spark, d):
    return streams.drain(streams.totals(_follow(spark, d), "value", "event_type"))


# Windows and sessions come out when the watermark, an hour behind the latest event, has passed their end.
CLOSED_AT = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query(f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= {CLOSED_AT}")
def tumbling(spark, d):
    return streams.drain(streams.windowed(_follow(spark, d), "ts", "event_type", "1 hour"), "append").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"WITH w AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS start, event_type FROM events, range(2) AS r(k)) SELECT start, event_type, count(*) AS n FROM w WHERE start + INTERVAL 1 HOUR <= {CLOSED_AT} GROUP BY 1, 2")
def sliding(spark, d):
    return streams.drain(streams.windowed(_follow(spark, d), "ts", "event_type", "1 hour", "30 minutes"), "append").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    f"""WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 1 HOUR, true) AS new FROM events), s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 1 HOUR <= {CLOSED_AT}"""
)
def session_bursts(spark, d):
    out = streams.drain(streams.sessions(_follow(spark, d), "ts", "user_id", "1 hour"), "append")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))
