"""Text functions, record linkage and the pages of integrations, over names of the library, customers and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import fuzzy, text
from ..operators import documents as json_documents, linking, scoring
from . import canonical as c
from .queries import query

documents = lambda s, d: c.read(s, d, "documents")
pages = lambda s, d: c.read(s, d, "pages")


def credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What another server calls the library's tracks: names vary by the turn of an id, and some ids are known."""
    p = c.read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    pick = lambda *xs: F.element_at(F.array(*xs), (k % len(xs) + 1).cast("int"))
    name = F.col("p_name")
    return p.select(
        F.concat(F.lit("s"), k.cast("string")).alias("server_id"),
        pick(name, F.upper(name), F.concat(name, F.lit(" (feat. Someone)")), F.concat(F.lit("  The "), name)).alias("title"),
        pick(F.col("p_brand"), F.concat_ws(" & ", "p_brand", F.lit("Guest")), F.concat_ws(", ", F.lit("Guest"), F.col("p_brand"))).alias("artist"),
        F.concat_ws(" ", "p_brand", "p_type").alias("album"),
        F.when(k % 3 == 0, F.concat(F.lit("m"), k.cast("string"))).alias("mbid"),
        (F.floor(F.col("p_retailprice") / 5) + k % 3).cast("long").alias("duration"),
        F.concat(F.lit("\\\\NAS\\Music\\"), F.col("p_brand"), F.lit("\\"), F.col("p_type"), F.lit("\\"), k.cast("string"), F.lit(".MP3")).alias("path"),
    )


CREDITS = r"""credits AS (SELECT 's' || p_partkey AS server_id, [p_name, upper(p_name), p_name || ' (feat. Someone)', '  The ' || p_name][p_partkey % 4 + 1] AS title,
  [p_brand, p_brand || ' & Guest', 'Guest, ' || p_brand][p_partkey % 3 + 1] AS artist, p_brand || ' ' || p_type AS album, CASE WHEN p_partkey % 3 = 0 THEN 'm' || p_partkey END AS mbid,
  (floor(p_retailprice / 5) + p_partkey % 3)::BIGINT AS duration, '\\NAS\Music\' || p_brand || '\' || p_type || '\' || p_partkey || '.MP3' AS path FROM part)"""
_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '^the ', ''), '[^\w\s]', '', 'g'), '\s+', ' ', 'g'))"
norm = _NORM.format


@query("F02_weak_names", f"{CREDITS} SELECT server_id, lower(trim(title, ' ')) AS name FROM credits", credits)
def _(x):
    return x.select("server_id", text.weakly_normalised(F.col("title")).alias("name"))


@query("F03_spaced_names", f"{CREDITS} SELECT server_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS name FROM credits", credits)
def _(x):
    return x.select("server_id", text.spaced(F.col("title")).alias("name"))


@query("F04_without_featured", rf"{CREDITS} SELECT server_id, trim(regexp_replace(title, '(?i)\s*[\(\[]?\b(?:feat|ft|featuring)\b\.?.*$', '')) AS title FROM credits", credits)
def _(x):
    return x.select("server_id", text.without_featured(F.col("title")).alias("title"))


@query("F05_canonical_names", rf"{CREDITS} SELECT server_id, trim(regexp_replace(lower(title), '\s+', ' ', 'g')) AS name FROM credits", credits)
def _(x):
    return x.select("server_id", text.canonical(F.col("title")).alias("name"))


_ARTISTS = r"array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(lower(artist), '\s*(?:,|;|&|/| and | feat\.? )\s*'), lambda x: trim(x)), lambda x: x != ''))), '|')"


@query("F06_artist_sets", f"{CREDITS} SELECT server_id, {_ARTISTS} AS artists FROM credits", credits)
def _(x):
    return x.select("server_id", text.artist_set(F.col("artist")).alias("artists"))


@query("F07_relative_paths", r"""%s SELECT server_id, regexp_replace(replace(lower(replace(path, '\', '/')), '//nas/music', ''), '^/+', '') AS path FROM credits""" % CREDITS, credits)
def _(x):
    return x.select("server_id", text.relative_path(F.col("path"), "//nas/music").alias("path"))


@query("F09_file_formats", rf"{CREDITS} SELECT upper(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1)) AS format, count(*) AS n FROM credits GROUP BY ALL", credits)
def _(x):
    return x.groupBy(text.format_of_path(F.col("path")).alias("format")).agg(F.count(F.lit(1)).alias("n"))


@query("F10_fuzzy_ratio", None, credits, c.track_features)
def _(x, t):
    own = x.join(t.select("track_id", F.col("title").alias("own")), F.substring("server_id", 2, 20) == F.substring("track_id", 2, 20))
    return own.select("server_id", fuzzy.ratio("title", "own").alias("ratio"))


@query("F12_years", "SELECT o_orderkey AS id, regexp_extract(strftime(o_orderdate, '%Y-%m-%d'), '^([0-9]{4})', 1)::INT AS year FROM orders", lambda s, d: c.read(s, d, "orders"))
def _(o):
    return o.select(F.col("o_orderkey").alias("id"), text.year(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("year"))


_POST = "posts AS (SELECT doc_id AS id, '[' || source || '] ' || lang || ' - ' || left(regexp_replace(text, '[^A-Za-z ]', '', 'g'), 40) || CASE WHEN doc_id % 3 = 0 THEN ' [FRESH]' ELSE '' END AS title, doc_id % 500 AS score, doc_id % 90 AS comments, 1700000000 - doc_id * 600 AS created, source FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL)"


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of a news feed, from documents."""
    d = documents(spark, sf_dir).filter("text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL")
    k = F.col("doc_id")
    title = F.concat(F.lit("["), F.col("source"), F.lit("] "), F.col("lang"), F.lit(" - "), F.left(F.regexp_replace("text", "[^A-Za-z ]", ""), F.lit(40)), F.when(k % 3 == 0, " [FRESH]").otherwise(""))
    return d.select(k.alias("id"), title.alias("title"), (k % 500).alias("score"), (k % 90).alias("comments"), (1700000000 - k * 600).alias("created"), "source")


@query("F13_title_parse", rf"{_POST} SELECT id, list_transform(regexp_extract_all(title, '\[([^\]]*)\]', 1), lambda x: lower(x)) AS tags, trim(regexp_replace(split_part(title, ' - ', 1), '\[[^\]]*\]', '', 'g')) AS artist, regexp_matches(title, '(?i)\[fresh\]') AS fresh FROM posts", posts)
def _(p):
    tags = F.transform(F.regexp_extract_all("title", F.lit(r"\[([^\]]*)\]"), F.lit(1)), F.lower)
    artist = F.trim(F.regexp_replace(F.split_part("title", F.lit(" - "), F.lit(1)), r"\[[^\]]*\]", ""))
    return p.select("id", tags.alias("tags"), artist.alias("artist"), F.exists(tags, lambda x: x == "fresh").alias("fresh"))


@query("F14_lyric_times", "SELECT track_id, '[' || lpad((duration_ms // 60000)::VARCHAR, 2, '0') || ':' || lpad((duration_ms // 1000 % 60)::VARCHAR, 2, '0') || '.' || lpad((duration_ms // 10 % 100)::VARCHAR, 2, '0') || ']' AS stamp, true AS synced, title AS line FROM track_features", c.track_features)
def _(t):
    stamp = text.lyric_time(F.col("duration_ms"))
    line = F.concat(stamp, F.lit(" "), F.col("title"))
    return t.select("track_id", stamp.alias("stamp"), text.has_lyric_times(line).alias("synced"), text.without_lyric_times(line).alias("line"))


_AGENT = "['Mozilla/5.0 Firefox', 'okhttp/4 Android', 'Player iOS', 'curl/8', NULL][page_id % 5 + 1]"


@query("F15_user_agents", f"SELECT page_id, CASE WHEN a IS NULL THEN 'unknown' WHEN a LIKE '%Mozilla%' THEN 'browser' WHEN a LIKE '%Android%' OR a LIKE '%iOS%' THEN 'mobile' ELSE 'script' END AS kind FROM (SELECT page_id, {_AGENT} AS a FROM pages)", pages)
def _(p):
    agents = F.array(F.lit("Mozilla/5.0 Firefox"), F.lit("okhttp/4 Android"), F.lit("Player iOS"), F.lit("curl/8"), F.lit(None))
    a = F.element_at(agents, (F.col("page_id") % 5 + 1).cast("int"))
    return p.select("page_id", F.when(a.isNull(), "unknown").when(a.contains("Mozilla"), "browser").when(a.contains("Android") | a.contains("iOS"), "mobile").otherwise("script").alias("kind"))


@query("F16_client_address", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '10.0.0.' || page_id % 250 ELSE '192.168.1.1' END AS client FROM pages", pages)
def _(p):
    header = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" 10.0.0."), (F.col("page_id") % 250).cast("string"), F.lit(", 172.16.0.1")))
    return p.select("page_id", F.coalesce(F.trim(F.split_part(header, F.lit(","), F.lit(1))), F.lit("192.168.1.1")).alias("client"))


_PATHS = {"$.user": "user_id", "$.context.device": "device_type", "$.context.Token": None, "$.items[0].track": "track_id", "$.items[0].api_key": None, "$.items[1].track": "surface"}


@query("F17_any_depth", " UNION ALL ".join(f"SELECT id, '{p}' AS path, '{'string' if c_ else 'redacted'}' AS kind, {c_ or repr(json_documents.MARK)} AS value FROM listen_events" for p, c_ in _PATHS.items()), c.listen_events)
def _(e):
    """Documents made of events, walked to any depth: secrets are hidden wherever they stand."""
    item = lambda track, key: F.struct(F.col(track).alias("track"), key.alias("api_key"))
    made = F.struct(F.col("user_id").alias("user"), F.struct(F.col("device_type").alias("device"), F.concat(F.lit("t"), "id").alias("Token")).alias("context"), F.array(item("track_id", F.lit("k")), item("surface", F.lit(None).cast("string"))).alias("items"))
    return json_documents.leaves(e.select("id", F.to_json(made).alias("json")))


@query("F17_redacted", "SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN '[redacted]' ELSE (props->>'k') END AS k, event_id % 4 = 0 AS hidden FROM events", lambda s, d: c.read(s, d, "events"))
def _(e):
    """Flat keys of a document whose names tell of secrets are hidden."""
    name = F.when(F.col("event_id") % 4 == 0, "api_token").otherwise("k")
    flat = F.create_map(name, F.get_json_object("props", "$.k"))
    shown = F.transform_values(flat, lambda k, v: F.when(k.rlike("(?i)token|password|secret"), "[redacted]").otherwise(v))
    return e.select(F.col("event_id").alias("id"), F.map_values(shown)[0].alias("k"), F.map_contains_key(shown, F.lit("api_token")).alias("hidden"))


@query("F28_days", "SELECT id, make_date((DATE '1970-01-01' + (ts // 86400)::INT)::DATE) AS day, ts // 86400 AS number, DATE '1970-01-01' + (ts // 86400)::INT - 7 AS week_before FROM listen_events".replace("make_date((DATE '1970-01-01' + (ts // 86400)::INT)::DATE)", "DATE '1970-01-01' + (ts // 86400)::INT"), c.listen_events)
def _(e):
    day = F.to_date(F.timestamp_seconds("ts"))
    return e.select("id", day.alias("day"), F.floor(F.col("ts") / 86400).alias("number"), F.date_sub(day, 7).alias("week_before"))


@query("F29_time_buckets", "SELECT id, ts // 900 * 900 AS bucket FROM listen_events", c.listen_events)
def _(e):
    return e.select("id", (F.col("ts") - F.pmod(F.col("ts"), F.lit(900))).alias("bucket"))


@query("F34_key_wheel", f"w AS (SELECT track_id, mode, CASE WHEN mode = 'minor' THEN {list(text.WHEEL_MINOR)}[list_position({list(text.PITCHES)}, key)] ELSE {list(text.WHEEL_MAJOR)}[list_position({list(text.PITCHES)}, key)] END AS place FROM track_features) SELECT a.track_id, a.place, CASE WHEN a.mode = b.mode THEN ((a.place - b.place) % 12 + 12) % 12 IN (0, 1, 11) ELSE a.place = b.place END AS fits FROM w a, w b WHERE b.track_id = 'p7'", c.track_features)
def _(t):
    w = t.select("track_id", "mode", text.wheel_place(F.col("key"), F.col("mode")).alias("place"))
    seed = w.filter("track_id = 'p7'").select(F.col("mode").alias("m"), F.col("place").alias("p"))
    return w.join(F.broadcast(seed)).select("track_id", "place", text.compatible(F.col("place"), F.col("mode"), F.col("p"), F.col("m")).alias("fits"))


@query("F39_canonical_key", """SELECT track_id, sha256('{"k":"' || key || '","m":"' || mode || '","n":' || track_number || '}') AS digest FROM track_features""", c.track_features)
def _(t):
    return t.select("track_id", F.sha2(F.to_json(F.struct(F.col("key").alias("k"), F.col("mode").alias("m"), F.col("track_number").alias("n"))), 256).alias("digest"))


@query("F40_cache_key", "SELECT track_id, concat_ws(':', artist, mode, 'any', track_number) AS key FROM track_features", c.track_features)
def _(t):
    return t.select("track_id", F.concat_ws(":", "artist", "mode", F.lit("any"), F.col("track_number").cast("string")).alias("key"))


@query("F41_track_keys", "SELECT track_id, substr(sha256(file_path), 1, 16) AS key FROM track_features", c.track_features)
def _(t):
    return t.select("track_id", text.track_key(F.col("file_path")).alias("key"))


@query("F42_quality_tiers", "SELECT l_orderkey, l_linenumber, list_position(['low', 'standard', 'high', 'lossless'], q) - 1 >= 2 AS meets FROM (SELECT *, ['low', 'standard', 'high', 'lossless'][l_linenumber % 4 + 1] AS q FROM lineitem)", lambda s, d: c.read(s, d, "lineitem"))
def _(l):
    tiers = F.array(*map(F.lit, ("low", "standard", "high", "lossless")))
    q = F.element_at(tiers, (F.col("l_linenumber") % 4 + 1).cast("int"))
    return l.select("l_orderkey", "l_linenumber", (F.array_position(tiers, q) - 1 >= 2).alias("meets"))


@query("F49_id_of_links", "SELECT track_id, CASE WHEN track_number % 2 = 0 THEN '0000' || substr(sha256(track_id), 1, 4) END AS mbid FROM track_features", c.track_features)
def _(t):
    """The identifier in the first link of a list that holds one."""
    links = F.array(F.lit("imdb://tt1"), F.when(F.col("track_number") % 2 == 0, F.concat(F.lit("mbid://0000"), F.substring(F.sha2("track_id", 256), 1, 4))).otherwise(F.lit("other://x")))
    found = F.filter(F.transform(links, lambda x: F.regexp_extract(x, "^mbid://([0-9a-f]+)$", 1)), lambda x: x != "")
    return t.select("track_id", F.get(found, F.lit(0)).alias("mbid"))


# Linkage

_LIB = "lib AS (SELECT track_id, title, artist, album, file_path, duration_ms // 1000 AS duration, CASE WHEN track_number % 2 = 0 THEN 'm' || substr(track_id, 2) END AS mbid, 's' || substr(track_id, 2) AS server_id, track_id AS legacy FROM track_features)"


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = c.track_features(spark, sf_dir)
    own = F.substring("track_id", 2, 20)
    return t.select("track_id", "title", "artist", "album", "file_path", F.floor(F.col("duration_ms") / 1000).alias("duration"), F.when(F.col("track_number") % 2 == 0, F.concat(F.lit("m"), own)).alias("mbid"), F.concat(F.lit("s"), own).alias("server_id"), F.col("track_id").alias("legacy"))


@query("J16_by_any_id", f"{_LIB}, ids AS (SELECT mbid AS external_id, track_id, 0 AS p FROM lib WHERE mbid IS NOT NULL UNION ALL SELECT server_id, track_id, 1 FROM lib UNION ALL SELECT legacy, track_id, 2 FROM lib), asked AS (SELECT id, [replace(track_id, 'p', 'm'), replace(track_id, 'p', 's'), track_id, 'none'][id % 4 + 1] AS external_id FROM listen_events) SELECT id, external_id, arg_min(track_id, p) AS track_id FROM asked LEFT JOIN ids USING (external_id) GROUP BY id, external_id", c.listen_events, library)
def _(e, lib):
    name = lambda x: F.regexp_replace("track_id", "p", x)
    asked = e.select("id", F.element_at(F.array(name("m"), name("s"), F.col("track_id"), F.lit("none")), (F.col("id") % 4 + 1).cast("int")).alias("external_id"))
    return linking.by_any_id(asked, lib, ["mbid", "server_id", "legacy"]).select("id", "external_id", "track_id")


@query("J17_external_lookup", f"{_LIB} SELECT asked.external_id, track_id FROM (SELECT 's' || (k * 3) AS external_id FROM range(200) r(k)) asked LEFT JOIN lib ON server_id = asked.external_id", library)
def _(lib):
    asked = lib.sparkSession.range(200).select(F.concat(F.lit("s"), (F.col("id") * 3).cast("string")).alias("external_id"))
    return asked.join(lib.select(F.col("server_id").alias("external_id"), "track_id"), "external_id", "left")


_LINKED = rf"""{_LIB}, {CREDITS},
l AS (SELECT track_id, mbid, {_ARTISTS} AS artists, lower(album) AS album, lower(title) AS title, duration, lower(replace(file_path, '/music/', '')) AS path FROM lib),
r AS (SELECT server_id, mbid, {_ARTISTS} AS artists, lower(album) AS album, trim(regexp_replace(lower(title), '\s*[\(\[]?\bfeat\b.*$', '')) AS title, duration, regexp_replace(replace(lower(replace(path, '\', '/')), '//nas/music', ''), '^/+', '') AS path FROM credits),
s1 AS (SELECT r.server_id, any_value(u) AS m FROM r JOIN (SELECT mbid, min(track_id) AS u FROM l GROUP BY mbid HAVING count(*) = 1 AND mbid IS NOT NULL) x ON x.mbid = r.mbid GROUP BY ALL),
s2 AS (SELECT r.server_id, any_value(u) AS m FROM r JOIN (SELECT artists, album, title, min(track_id) AS u FROM l GROUP BY ALL HAVING count(*) = 1) x ON x.artists = r.artists AND x.album = r.album AND x.title = r.title GROUP BY r.server_id),
s3 AS (SELECT r.server_id, any_value(u) AS m FROM r JOIN (SELECT album, title, duration, min(track_id) AS u FROM l GROUP BY ALL HAVING count(*) = 1) x ON x.album = r.album AND x.title = r.title AND x.duration = r.duration GROUP BY r.server_id),
s4 AS (SELECT r.server_id, any_value(u) AS m FROM r JOIN (SELECT path, min(track_id) AS u FROM l GROUP BY ALL HAVING count(*) = 1) x ON x.path = r.path GROUP BY r.server_id),
linked AS (SELECT r.server_id, coalesce(s1.m, s2.m, s3.m, s4.m) AS "match", CASE WHEN s1.m IS NOT NULL THEN 1 WHEN s2.m IS NOT NULL THEN 2 WHEN s3.m IS NOT NULL THEN 3 WHEN s4.m IS NOT NULL THEN 4 END AS step
  FROM r LEFT JOIN s1 USING (server_id) LEFT JOIN s2 USING (server_id) LEFT JOIN s3 USING (server_id) LEFT JOIN s4 USING (server_id))"""


def linked(x: DataFrame, lib: DataFrame) -> DataFrame:
    """server_id, match, step: by identifier, by artists, album and title, by album, title and length, by path."""
    left = x.select("server_id", "mbid", text.artist_set(F.col("artist")).alias("artists"), F.lower("album").alias("album"), F.trim(F.regexp_replace(F.lower("title"), r"\s*[\(\[]?\bfeat\b.*$", "")).alias("title"), "duration", text.relative_path(F.col("path"), "//nas/music").alias("path"))
    right = lib.select("track_id", "mbid", text.artist_set(F.col("artist")).alias("artists"), F.lower("album").alias("album"), F.lower("title").alias("title"), "duration", F.lower(F.replace("file_path", F.lit("/music/"), F.lit(""))).alias("path"))
    return linking.cascade(left, right, [["mbid"], ["artists", "album", "title"], ["album", "title", "duration"], ["path"]], "server_id", "track_id")


@query("J18_cascade", f"{_LINKED} SELECT * FROM linked", credits, library)
def _(x, lib):
    return linked(x, lib)


@query("D46_sync_summary", f"{_LINKED} SELECT coalesce(step::VARCHAR, 'unmatched') AS step, count(*) AS n FROM linked GROUP BY ALL", credits, library)
def _(x, lib):
    return linked(x, lib).groupBy(F.coalesce(F.col("step").cast("string"), F.lit("unmatched")).alias("step")).agg(F.count(F.lit(1)).alias("n"))


@query("J19_winner_per_server_id", "SELECT server_id, track_id FROM (SELECT 's' || track_number AS server_id, track_id, row_number() OVER (PARTITION BY track_number ORDER BY analysis_version DESC, track_id) AS n FROM track_features) WHERE n = 1", c.track_features)
def _(t):
    rows = t.select(F.concat(F.lit("s"), F.col("track_number").cast("string")).alias("server_id"), "track_id", "analysis_version")
    return scoring.top_per(rows, ["server_id"], [F.desc("analysis_version"), F.col("track_id")], 1).select("server_id", "track_id")


_CHARTED = rf"{CREDITS}, lib AS (SELECT {norm('title')} AS t, {norm('artist')} AS a, min(track_id) AS track_id FROM track_features GROUP BY ALL)"


def charted(x: DataFrame, t: DataFrame) -> DataFrame:
    """Entries by normalised artist and title, else by the title without its featured artists."""
    names = t.groupBy(text.normalised(F.col("title")).alias("t"), text.normalised(F.col("artist")).alias("a")).agg(F.min("track_id").alias("track_id"))
    x = x.withColumn("a", text.normalised(F.col("artist"))).withColumn("t1", text.normalised(F.col("title"))).withColumn("t2", text.normalised(text.without_featured(F.col("title"))))
    first = names.select("a", F.col("t").alias("t1"), F.col("track_id").alias("m1"))
    second = names.select("a", F.col("t").alias("t2"), F.col("track_id").alias("m2"))
    return x.join(first, ["a", "t1"], "left").join(second, ["a", "t2"], "left").withColumn("track_id", F.coalesce("m1", "m2"))


_CHART_MATCH = _CHARTED + rf", matched AS (SELECT server_id, c.artist, coalesce(x.track_id, y.track_id) AS track_id FROM credits c LEFT JOIN lib x ON x.a = {norm('c.artist')} AND x.t = {norm('c.title')} LEFT JOIN lib y ON y.a = {norm('c.artist')} AND y.t = " + norm(r"regexp_replace(c.title, '(?i)\s*[\(\[]?\b(?:feat|ft|featuring)\b\.?.*$', '')") + ")"


@query("J20_chart_to_library", f"{_CHART_MATCH} SELECT server_id, track_id FROM matched", credits, c.track_features)
def _(x, t):
    return charted(x, t).select("server_id", "track_id")


@query("J21_artist_tracks", f"{CREDITS}, names AS (SELECT DISTINCT {norm('artist')} AS artist FROM credits), own AS (SELECT {norm('artist')} AS artist, count(*) AS tracks, min(track_id) AS first_track FROM track_features GROUP BY 1) SELECT artist, tracks, first_track FROM names JOIN own USING (artist)", credits, c.track_features)
def _(x, t):
    own = t.groupBy(text.normalised(F.col("artist")).alias("artist")).agg(F.count(F.lit(1)).alias("tracks"), F.min("track_id").alias("first_track"))
    return x.select(text.normalised(F.col("artist")).alias("artist")).distinct().join(own, "artist")


@query("J22_annotated_hits", rf"{CREDITS}, lib AS (SELECT DISTINCT trim(regexp_replace(lower(artist), '[^a-z0-9]+', ' ', 'g')) AS a, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS t FROM track_features) SELECT server_id, lib.a IS NOT NULL AS in_library FROM credits c LEFT JOIN lib ON lib.a = trim(regexp_replace(lower(c.artist), '[^a-z0-9]+', ' ', 'g')) AND lib.t = trim(regexp_replace(lower(c.title), '[^a-z0-9]+', ' ', 'g'))", credits, c.track_features)
def _(x, t):
    key = lambda df: df.withColumn("a", text.spaced(F.col("artist"))).withColumn("t", text.spaced(F.col("title")))
    return linking.with_flag(key(x), key(t), ["a", "t"], "in_library").select("server_id", "in_library")


@query("J23_external_similar", "SELECT source, track_id, max(score) AS score FROM similar_edges JOIN track_features USING (track_id) WHERE source != track_id GROUP BY ALL".replace("max(score)", "round(max(score), 6)"), c.similar_edges, c.track_features)
def _(x, t):
    return x.join(t.select("track_id"), "track_id").filter("source != track_id").groupBy("source", "track_id").agg(F.max("score").alias("score"))


@query("J28_new_artists", f"{CREDITS}, asked AS (SELECT DISTINCT {norm('artist')} AS artist FROM track_features WHERE track_number % 9 = 0) SELECT DISTINCT {norm('artist')} AS artist FROM credits WHERE {norm('artist')} NOT IN (SELECT {norm('artist')} FROM track_features) AND {norm('artist')} NOT IN (SELECT artist FROM asked)", credits, c.track_features)
def _(x, t):
    name = text.normalised(F.col("artist")).alias("artist")
    asked = t.filter("track_number % 9 = 0").select(name)
    return x.select(name).distinct().join(t.select(name), "artist", "left_anti").join(asked, "artist", "left_anti")


@query("X10_chart_build", f"{_CHART_MATCH}, scopes AS (SELECT 'global' AS scope, * FROM matched UNION ALL SELECT 'tag', * FROM matched WHERE server_id LIKE '%1' UNION ALL SELECT 'geo', * FROM matched WHERE server_id LIKE '%2') SELECT scope, count(*) AS entries, count(track_id) AS in_library, count(DISTINCT CASE WHEN track_id IS NULL THEN artist END) AS new_artists FROM scopes GROUP BY scope", credits, c.track_features)
def _(x, t):
    m = charted(x, t)
    scope = lambda name, part: part.withColumn("scope", F.lit(name))
    every = scope("global", m).unionByName(scope("tag", m.filter("server_id LIKE '%1'"))).unionByName(scope("geo", m.filter("server_id LIKE '%2'")))
    return every.groupBy("scope").agg(F.count(F.lit(1)).alias("entries"), F.count("track_id").alias("in_library"), F.countDistinct(F.when(F.col("track_id").isNull(), F.col("artist"))).alias("new_artists"))


@query("X11_artist_page", f"own AS (SELECT DISTINCT artist FROM track_features), pairs AS (SELECT a.artist, b.artist AS other, max(score) AS score FROM similar_edges e JOIN track_features a ON a.track_id = e.source JOIN track_features b ON b.track_id = e.track_id WHERE a.artist != b.artist GROUP BY ALL) SELECT artist, other, round(score, 6) AS score, n FROM (SELECT *, row_number() OVER (PARTITION BY artist ORDER BY score DESC, other)::INT AS n FROM pairs) WHERE n <= 5", c.similar_edges, c.track_features)
def _(x, t):
    a = t.select(F.col("track_id").alias("source"), "artist")
    b = t.select("track_id", F.col("artist").alias("other"))
    pairs = x.join(a, "source").join(b, "track_id").filter("artist != other").groupBy("artist", "other").agg(F.max("score").alias("score"))
    return scoring.top_per(pairs, ["artist"], [F.desc("score"), F.col("other")], 5).withColumnRenamed("rank", "n")


@query("X18_onboarding_match", f"asked AS (SELECT 'u' || c_custkey AS user_id, ['Brand#' || (c_custkey % 60), 'brand#' || (c_custkey % 25)] AS artists FROM customer), long AS (SELECT user_id, {norm('unnest(artists)')} AS artist FROM asked), lib AS (SELECT DISTINCT {norm('artist')} AS artist FROM track_features) SELECT user_id, count(*) AS asked, count(lib.artist) AS found FROM long LEFT JOIN lib USING (artist) GROUP BY user_id", lambda s, d: c.read(s, d, "customer"), c.track_features)
def _(u, t):
    k = F.col("c_custkey")
    long = u.select(F.concat(F.lit("u"), k.cast("string")).alias("user_id"), F.explode(F.array(F.concat(F.lit("Brand#"), (k % 60).cast("string")), F.concat(F.lit("brand#"), (k % 25).cast("string")))).alias("name"))
    lib = t.select(text.normalised(F.col("artist")).alias("artist"), F.lit(1).alias("hit")).distinct()
    return long.withColumn("artist", text.normalised(F.col("name"))).join(lib, "artist", "left").groupBy("user_id").agg(F.count(F.lit(1)).alias("asked"), F.count("hit").alias("found"))


@query("X27_duplicate_ids", f"{_LIB} SELECT a.track_id, b.track_id AS other FROM lib a JOIN lib b ON b.duration = a.duration AND b.album = a.album AND b.track_id > a.track_id", library)
def _(lib):
    other = lib.select("duration", "album", F.col("track_id").alias("other"))
    return lib.join(other, ["duration", "album"]).filter("other > track_id").select("track_id", "other")


# Candidates of integrations


@query("X01_peer_files", rf"{CREDITS} SELECT server_id, round(CASE WHEN lower(path) LIKE '%.flac' THEN 40 WHEN duration > 250 THEN 25 ELSE 10 END + CASE WHEN mbid IS NOT NULL THEN 10 ELSE 0 END - least(duration % 20, 10) + 15.0::DOUBLE * len(list_filter(['widget', 'bolt', 'large'], lambda w: contains(lower(title), w))) / 3, 6) AS score FROM credits", credits)
def _(x):
    words = F.array(*map(F.lit, ("widget", "bolt", "large")))
    ladder = F.when(F.lower("path").endswith(".flac"), 40).when(F.col("duration") > 250, 25).otherwise(10)
    share = F.size(F.filter(words, lambda w: F.contains(F.lower("title"), w))) / F.size(words)
    return x.select("server_id", (ladder + F.when(F.col("mbid").isNotNull(), 10).otherwise(0) - F.least(F.col("duration") % 20, F.lit(10)) + 15.0 * share).alias("score"))


@query("X02_clean_queries", rf"{CREDITS} SELECT server_id, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(title, '(?i)\s*[\(\[](?:feat|live|remaster)[^\)\]]*[\)\]]', '', 'g'), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')), ''), title) AS query FROM credits", credits)
def _(x):
    s = F.regexp_replace("title", r"(?i)\s*[\(\[](?:feat|live|remaster)[^\)\]]*[\)\]]", "")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r"[^\w\s]", " "), r"\s+", " "))
    return x.select("server_id", F.coalesce(F.nullif(s, F.lit("")), F.col("title")).alias("query"))


def tiered(t: DataFrame, x: DataFrame) -> DataFrame:
    """track_id, server_id, tier: the first credit of a track's album by artist and title, by artist, or of all; the least of each group is enough."""
    tracks = t.select("track_id", "album", F.lower("artist").alias("a"), F.lower("title").alias("n"))
    named = x.select("album", F.lower("artist").alias("a"), F.lower(F.trim("title")).alias("n"), F.struct(F.col("server_id").isNull().alias("none"), "server_id").alias("s"))
    found = tracks
    for tier, keys in ((2, ["album"]), (1, ["album", "a"]), (0, ["album", "a", "n"])):
        found = found.join(named.groupBy(*keys).agg(F.min("s").alias(f"s{tier}")), keys, "inner" if tier == 2 else "left")
    best = F.coalesce(*[F.when(F.col(f"s{n}").isNotNull(), F.struct(F.lit(n).alias("tier"), f"s{n}.none", f"s{n}.server_id")) for n in range(3)])
    return found.groupBy("track_id").agg(F.min(best).alias("x")).select("track_id", "x.server_id", "x.tier")


def closest_duration(t: DataFrame, x: DataFrame) -> DataFrame:
    """track_id, server_id: of the credits of a track's album that of the least distance in seconds times a million plus number.

    Of shorter credits that is the least of number less duration, of longer ones of number plus
    duration; both are running minima along the durations of an album, so that no pairs are made.
    """
    number = F.substring("server_id", 2, 20).cast("long")
    scale = F.lit(1_000_000)
    asks = t.select("album", F.floor(F.col("duration_ms") / 1000).cast("long").alias("d"), "track_id", F.lit(None).cast("string").alias("server_id"), F.lit(None).cast("long").alias("number"))
    has = x.select("album", F.col("duration").cast("long").alias("d"), F.lit(None).cast("string").alias("track_id"), "server_id", number.alias("number"))
    rows = asks.withColumn("credit", F.lit(False)).unionByName(has.withColumn("credit", F.lit(True)))
    up, down = Window.partitionBy("album").orderBy(F.asc("d")), Window.partitionBy("album").orderBy(F.desc("d"))
    key = lambda sign: F.min(F.when(F.col("credit") & (F.col("d") * F.col("number")).isNotNull(), F.struct((F.col("number") + sign * scale * F.col("d")).alias("key"), "number", "server_id")))
    met = rows.withColumn("below", key(-1).over(up)).withColumn("n", F.count_if("credit").over(up)).withColumn("above", key(1).over(down)).withColumn("m", F.count_if("credit").over(down))
    near = lambda c, sign: F.when(F.col("d").isNotNull() & F.col(c).isNotNull(), F.struct((F.col(f"{c}.key") - sign * scale * F.col("d")).alias("key"), f"{c}.number", f"{c}.server_id"))
    best = met.filter("NOT credit AND n + m > 0").select("track_id", F.least(near("below", -1), near("above", 1)).alias("x"))
    return best.groupBy("track_id").agg(F.min("x").alias("x")).select("track_id", "x.server_id")


@query("X03_tiered_pick", f"{CREDITS}, tiers AS (SELECT t.track_id, server_id, CASE WHEN lower(c.artist) = lower(t.artist) AND lower(trim(c.title)) = lower(t.title) THEN 0 WHEN lower(c.artist) = lower(t.artist) THEN 1 ELSE 2 END AS tier FROM track_features t JOIN credits c USING (album)) SELECT track_id, server_id, tier FROM tiers QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY tier, server_id) = 1", c.track_features, credits)
def _(t, x):
    return tiered(t, x)


@query("X04_closest_duration", f"{CREDITS} SELECT t.track_id, arg_min(server_id, abs(duration - duration_ms // 1000) * 1000000 + substr(server_id, 2)::BIGINT) AS server_id FROM track_features t JOIN credits c USING (album) GROUP BY t.track_id", c.track_features, credits)
def _(t, x):
    return closest_duration(t, x)


@query("X14_service_priority", "hits AS (SELECT o_custkey AS target, list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], o_orderpriority) AS priority, o_totalprice AS score, o_orderkey AS id FROM orders WHERE o_totalprice > 100000) SELECT target, id, priority::INT AS priority FROM hits QUALIFY row_number() OVER (PARTITION BY target ORDER BY priority, score DESC, id) = 1", lambda s, d: c.read(s, d, "orders"))
def _(o):
    services = F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))
    hits = o.filter("o_totalprice > 100000").select(F.col("o_custkey").alias("target"), F.array_position(services, F.col("o_orderpriority")).cast("int").alias("priority"), F.col("o_totalprice").alias("score"), F.col("o_orderkey").alias("id"))
    return scoring.top_per(hits, ["target"], [F.col("priority"), F.desc("score"), F.col("id")], 1).select("target", "id", "priority")


@query("D44_download_cascade", "SELECT l_orderkey AS target, arg_min(l_linenumber, l_linenumber) AS service, count(*) AS tried FROM lineitem WHERE l_linestatus = 'O' AND l_quantity >= 10 GROUP BY ALL", lambda s, d: c.read(s, d, "lineitem"))
def _(l):
    """The first service that is on and meets the quality."""
    return l.filter("l_linestatus = 'O' AND l_quantity >= 10").groupBy(F.col("l_orderkey").alias("target")).agg(F.min("l_linenumber").alias("service"), F.count(F.lit(1)).alias("tried"))


@query("D45_lyrics_cascade", "SELECT doc_id, CASE WHEN n_chars < 60 THEN 'instrumental' WHEN doc_id % 4 = 0 THEN 'synced' WHEN doc_id % 4 = 1 THEN 'plain' WHEN doc_id % 4 = 2 AND n_chars > 500 THEN 'guessed' ELSE 'deferred' END AS kind, CASE WHEN n_chars < 60 THEN -1 WHEN doc_id % 4 = 0 THEN 4 WHEN doc_id % 4 = 1 THEN 3 WHEN doc_id % 4 = 2 AND n_chars > 500 THEN 1 ELSE 0 END AS quality FROM documents", documents)
def _(d):
    """The best of what the sources offer; texts too short are instrumental."""
    k, n = F.col("doc_id") % 4, F.col("n_chars")
    offers = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(q).alias("quality"), F.lit(kind).alias("kind"))) for cond, q, kind in ((k == 0, 4, "synced"), (k == 1, 3, "plain"), ((k == 2) & (n > 500), 1, "guessed"), (F.lit(True), 0, "deferred"))]))
    best = F.when(n < 60, F.struct(F.lit(-1).alias("quality"), F.lit("instrumental").alias("kind"))).otherwise(F.array_max(offers))
    return d.select("doc_id", best["kind"].alias("kind"), best["quality"].alias("quality"))


@query("A33_albums_of_hits", "SELECT album, count(*) AS matched, round(avg(abs(bpm - 120)), 6) AS mean_distance, round(min(abs(bpm - 120)), 6) AS best_distance FROM track_features WHERE energy > 0.3 GROUP BY album ORDER BY matched DESC, mean_distance, album LIMIT 50", c.track_features)
def _(t):
    apart = F.abs(F.col("bpm") - 120)
    return t.filter("energy > 0.3").groupBy("album").agg(F.count(F.lit(1)).alias("matched"), F.avg(apart).alias("mean_distance"), F.min(apart).alias("best_distance")).orderBy(F.desc("matched"), F.round("mean_distance", 6), "album").limit(50)


@query("A34_first_of_album", "SELECT album, arg_min(track_id, track_number * 1000000 + substr(track_id, 2)::BIGINT) AS first_track, count(*) AS tracks FROM track_features GROUP BY album", c.track_features)
def _(t):
    return t.groupBy("album").agg(F.min_by("track_id", F.struct("track_number", F.substring("track_id", 2, 20).cast("long"))).alias("first_track"), F.count(F.lit(1)).alias("tracks"))


@query("D40_fill_library", "SELECT artist, album, count(*) AS matched, round(avg(abs(energy - 0.6)), 6) AS distance FROM track_features GROUP BY ALL HAVING count(*) >= 1 ORDER BY matched DESC, distance, album LIMIT 40", c.track_features)
def _(t):
    return t.groupBy("artist", "album").agg(F.count(F.lit(1)).alias("matched"), F.round(F.avg(F.abs(F.col("energy") - 0.6)), 6).alias("distance")).orderBy(F.desc("matched"), "distance", "album").limit(40)


_RELEVANT = f"{_POST}, scored AS (SELECT *, 0.20::DOUBLE * least(ln(1 + score) / ln(501), 1) + 0.25::DOUBLE * exp(-(1700000000 - created) / 86400.0 / 3) + 0.55::DOUBLE * (CASE WHEN source IN ('web', 'news') THEN 1 ELSE 0 END) AS value FROM posts)"


def valued(p: DataFrame) -> DataFrame:
    relevant = F.when(F.col("source").isin("web", "news"), 1).otherwise(0)
    return p.withColumn("value", 0.20 * F.least(F.log1p("score") / F.log(F.lit(501.0)), F.lit(1.0)) + 0.25 * F.exp(-(1700000000 - F.col("created")) / 86400.0 / 3) + 0.55 * relevant)


@query("F25_post_score", f"{_RELEVANT} SELECT id, round(value, 6) AS value FROM scored", posts)
def _(p):
    return valued(p).select("id", "value")


@query("T11_recent_posts", f"{_POST} SELECT id, title FROM posts WHERE created > 1700000000 - 86400 QUALIFY row_number() OVER (PARTITION BY title ORDER BY score DESC, id) = 1 ORDER BY created DESC, id LIMIT 30", posts)
def _(p):
    fresh = p.filter("created > 1700000000 - 86400")
    return scoring.top_per(fresh, ["title"], [F.desc("score"), F.col("id")], 1).orderBy(F.desc("created"), "id").limit(30).select("id", "title")


@query("D42_news_feed", f"{_RELEVANT} SELECT id, round(value, 6) AS value FROM scored WHERE created > 1700000000 - 86400 * 5 QUALIFY row_number() OVER (PARTITION BY title ORDER BY value DESC, id) = 1 ORDER BY round(value, 9) DESC, id LIMIT 25", posts)
def _(p):
    fresh = valued(p).filter("created > 1700000000 - 86400 * 5")
    return scoring.top_per(fresh, ["title"], [F.desc("value"), F.col("id")], 1).orderBy(F.desc(F.round("value", 9)), "id").limit(25).select("id", "value")


@query("X28_relevance_reasons", f"{_POST} SELECT id, list_filter([CASE WHEN source = 'web' THEN 'source' END, CASE WHEN score > 250 THEN 'popular' END, CASE WHEN id % 3 = 0 THEN 'fresh' END], lambda x: x IS NOT NULL) AS reasons FROM posts", posts)
def _(p):
    return p.select("id", F.array_compact(F.array(F.when(F.col("source") == "web", "source"), F.when(F.col("score") > 250, "popular"), F.when(F.col("id") % 3 == 0, "fresh"))).alias("reasons"))
