"""Playlists, radio, cascades of matches, and what is left of the survey's composite queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import fuzzy, text
from ..operators import chains, linking, radio, scoring, sessions, vectors
from ..sources import shared
from . import canonical as c, matching, recommend
from .canonical import NOW
from .queries import SESSIONS, query

events, tracks, plays, library_vectors = c.listen_events, c.track_features, c.interactions, c.track_vectors


#: The playlists asked for, as a listener would: by a first track, by curves, by two ends.
SEEDS, CURVES, ENDS = ["p0", "p20", "p60", "p700"], ["ramp_up", "ramp_up_cool_down", "steady_low"], [("p0", "p60"), ("p20", "p140")]
_LIB = f"""{recommend._UNIT}, wheel AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {text.WHEEL_MAJOR[n]}, {text.WHEEL_MINOR[n]})" for n, k in enumerate(text.PITCHES))}) AS w(key, major, minor)),
lib AS (SELECT track_id, CASE WHEN coalesce(bpm, 0) = 0 THEN 120.0::DOUBLE ELSE bpm END AS bpm, CASE WHEN coalesce(energy, 0) = 0 THEN 0.5::DOUBLE ELSE energy END AS energy, CASE WHEN mode = 'minor' THEN minor ELSE major END AS place, mode, u FROM track_features LEFT JOIN wheel USING (key) LEFT JOIN units USING (track_id))"""
_LIKE = "coalesce(list_dot_product(t.u, n.u), 0.5)"


def _chain_sql(score: str, fits: str) -> str:
    """A chain from each seed; the key of the last track that has one holds on."""
    return f"""{_LIB}, chain(chain, position, track_id, place, mode, used) AS (SELECT track_id, 0, track_id, place, mode, [track_id] FROM lib WHERE track_id IN {tuple(SEEDS)}
UNION ALL SELECT chain, position + 1, b.id, coalesce(b.place, place), CASE WHEN b.place IS NULL THEN mode ELSE b.mode END, list_append(used, b.id) FROM (SELECT c.chain, c.position, c.used, c.place, c.mode, min({{'cost': -round({score}, 9), 'id': t.track_id, 'place': t.place, 'mode': t.mode}}) AS b
  FROM chain c JOIN lib n ON n.track_id = c.track_id JOIN lib t ON NOT list_contains(c.used, t.track_id) WHERE c.position < 19 AND {fits} GROUP BY c.chain, c.position, c.used, c.place, c.mode) WHERE b.cost < 1)
SELECT chain, position, track_id FROM chain"""


_STEP = "least((t.place - c.place + 12) % 12, (c.place - t.place + 12) % 12)"
_APART = f"CASE WHEN t.mode = c.mode THEN {_STEP} WHEN {_STEP} = 0 THEN 0 WHEN {_STEP} IS NULL THEN NULL ELSE 99 END"


@query("D21_flow_playlist", _chain_sql(f"{_LIKE} * CASE WHEN abs(t.bpm - n.bpm) <= 8 THEN 1 ELSE 0.7::DOUBLE END * CASE WHEN abs(t.energy - n.energy) <= 0.15::DOUBLE THEN 1 ELSE 0.7::DOUBLE END", "abs(t.bpm - n.bpm) <= 15 AND abs(t.energy - n.energy) <= 0.25::DOUBLE"), tracks, library_vectors)
def _(t, v):
    return chains.flow(chains.library(t, v), SEEDS)


@query("D25_key_playlist", _chain_sql(f"{_LIKE} * CASE WHEN {_APART} IS NULL THEN 0.3::DOUBLE WHEN {_APART} <= 1 THEN 1 ELSE 0.6::DOUBLE END", f"({_APART} IS NULL OR {_APART} <= 2)"), tracks, library_vectors)
def _(t, v):
    return chains.keys(chains.library(t, v), SEEDS)


_TARGETS = ", ".join(f"('{c}', {k}, {x!r}::DOUBLE)" for c in CURVES for k, x in enumerate(chains.targets(c, 20)))


@query("D24_energy_curve_playlist", f"""{_LIB}, wanted AS (SELECT * FROM (VALUES {_TARGETS}) AS w(chain, k, target)), line(chain, position, track_id, used) AS (SELECT chain, -1, ''::VARCHAR, []::VARCHAR[] FROM wanted WHERE k = 0
UNION ALL SELECT chain, position + 1, b.id, list_append(used, b.id) FROM (SELECT c.chain, c.position, c.used, min({{'cost': round(abs(t.energy - w.target) - 0.1::DOUBLE * coalesce(list_dot_product(t.u, n.u), 0), 9), 'id': t.track_id}}) AS b
  FROM line c JOIN wanted w ON w.chain = c.chain AND w.k = c.position + 1 LEFT JOIN lib n ON n.track_id = c.track_id JOIN lib t ON NOT list_contains(c.used, t.track_id) GROUP BY c.chain, c.position, c.used))
SELECT chain, position, track_id FROM line WHERE position >= 0""", tracks, library_vectors)
def _(t, v):
    return chains.curve(chains.library(t, v), CURVES)


_ENDS = ", ".join(f"('{a}', '{b}')" for a, b in ENDS)


@query("D22_path_playlist", f"""{_LIB}, ends AS (SELECT e.a || '>' || e.b AS chain, e.a, e.b, x.u AS ua, y.u AS ub, acos(list_dot_product(x.u, y.u)) AS angle FROM (VALUES {_ENDS}) AS e(a, b) JOIN lib x ON x.track_id = e.a JOIN lib y ON y.track_id = e.b),
points AS (SELECT chain, a, b, k, list_transform(list_zip(ua, ub), lambda z: (sin((1 - k / 11.0::DOUBLE) * angle) * z[1] + sin(k / 11.0::DOUBLE * angle) * z[2]) / sin(angle)) AS p FROM ends, range(1, 11) AS r(k)),
line(chain, position, track_id, used) AS (SELECT chain, 0, a, [a, b] FROM ends
UNION ALL SELECT chain, position + 1, b.id, list_append(used, b.id) FROM (SELECT c.chain, c.position, c.used, min({{'cost': -round(list_dot_product(t.u, w.p), 9), 'id': t.track_id}}) AS b
  FROM line c JOIN points w ON w.chain = c.chain AND w.k = c.position + 1 JOIN lib t ON t.u IS NOT NULL AND NOT list_contains(c.used, t.track_id) GROUP BY c.chain, c.position, c.used))
SELECT chain, position, track_id FROM line UNION ALL SELECT chain, 11, b FROM ends""", tracks, library_vectors)
def _(t, v):
    return chains.path(chains.library(t, v), ENDS)


@query("D26_text_playlist", f"{recommend._UNIT} SELECT a.track_id, row_number() OVER (ORDER BY round(list_dot_product(a.u, b.u), 9) DESC, a.track_id)::INT AS position FROM units a, units b WHERE b.track_id = 'p5' QUALIFY position <= 20", library_vectors)
def _(v):
    best = vectors.nearest(v, v.filter("track_id = 'p5'"), 20)
    return best.select("track_id", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "track_id")).alias("position"))


@query("W16_no_runs_of_an_artist", None, plays, tracks, c.similar_edges, library_vectors, events)
def _(i, t, x, v, e):
    shown = recommend.reranked(i, t, x, v, e).filter("slot <= 40").select("user_id", "track_id", "artist", "slot")
    return shown.groupBy("user_id").applyInPandas(lambda p: chains.without_runs(p), "user_id string, track_id string, spot int")


_FEEDBACK = f"{recommend._UNIT}, fb AS (SELECT user_id, track_id, CASE event_type WHEN 'like' THEN 1.0::DOUBLE ELSE -0.5 END * power(0.85::DOUBLE, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) - 1) AS w FROM listen_events WHERE event_type IN ('like', 'skip')), long AS (SELECT user_id, w, unnest(v) AS x, generate_subscripts(v, 1) AS nth FROM fb JOIN track_vectors USING (track_id)), drift AS (SELECT user_id, list(s ORDER BY nth) AS d FROM (SELECT user_id, nth, sum(w * x) AS s FROM long GROUP BY ALL) GROUP BY user_id)"


def drift(e: DataFrame, v: DataFrame) -> DataFrame:
    """user_id, v: likes pull and skips push, the newest most, as one vector of length 1."""
    back = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("id"))) - 1
    w = F.when(F.col("event_type") == "like", 1.0).otherwise(-0.5) * F.pow(F.lit(0.85), back)
    weighted = e.filter("event_type IN ('like', 'skip')").select("user_id", "track_id", w.alias("w")).join(v.select("track_id", "v"), "track_id")
    long = weighted.select("user_id", "w", F.posexplode("v").alias("at", "x")).groupBy("user_id", "at").agg(F.sum(F.col("w") * F.col("x")).alias("s"))
    lists = long.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("at", "s"))).alias("p"))
    return lists.select("user_id", text.unit(F.col("p.s")).alias("v"))


#: How far discovery goes on each device, as a listener would set the dial.
_DIAL = {"phone": radio.BALANCED, "car": 0.0, "speaker": 0.6}
_RADIO = f"""kinds AS (SELECT *, CASE event_type WHEN 'like' THEN 1.5::DOUBLE WHEN 'dislike' THEN -0.5 WHEN 'skip' THEN -0.25 END AS weight, CASE device_type WHEN 'car' THEN 0.0::DOUBLE WHEN 'speaker' THEN 0.6 ELSE 0.3 END AS dial FROM listen_events WHERE event_type IN ('play_start', 'like', 'dislike', 'skip')),
fresh AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, id) <= 14400 THEN 0 ELSE 1 END AS begins FROM kinds),
own AS (SELECT *, (sum(begins) OVER (PARTITION BY user_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING))::BIGINT AS session_no FROM fresh),
aged AS (SELECT *, weight * power(0.9::DOUBLE, count(weight) OVER (PARTITION BY user_id, session_no ORDER BY ts DESC, id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS w FROM own),
heard AS (SELECT user_id, session_no, list(track_id ORDER BY ts, id) AS heard FROM (SELECT * FROM own WHERE event_type = 'play_start' QUALIFY row_number() OVER (PARTITION BY user_id, session_no ORDER BY ts DESC, id DESC) <= 50) GROUP BY ALL),
header AS (SELECT user_id, session_no, max(ts) AS last_active, count(weight)::BIGINT AS feedback, greatest(0, 1 + arg_max(dial, ts * 10000000 + id) - 0.3) AS scale FROM own GROUP BY ALL),
base AS (SELECT user_id, session_no, arg_min(u, ts * 10000000 + id) AS b FROM own JOIN units USING (track_id) WHERE event_type = 'play_start' GROUP BY ALL),
long AS (SELECT user_id, session_no, w, unnest(u) AS x, generate_subscripts(u, 1) AS nth FROM aged JOIN units USING (track_id) WHERE w IS NOT NULL),
moved AS (SELECT user_id, session_no, list(s ORDER BY nth) AS m FROM (SELECT user_id, session_no, nth, sum(w * x) AS s FROM long GROUP BY ALL) GROUP BY ALL),
sums AS (SELECT user_id, session_no, last_active, feedback, heard, CASE WHEN m IS NULL OR b IS NULL THEN b ELSE list_transform(list_zip(b, m), lambda z: z[1] + z[2] * 0.3 * scale) END AS d FROM header LEFT JOIN heard USING (user_id, session_no) LEFT JOIN base USING (user_id, session_no) LEFT JOIN moved USING (user_id, session_no)),
drifts AS (SELECT *, list_transform(d, lambda x: x / sqrt(list_dot_product(d, d))) AS v FROM sums)"""


def radio_sessions(e: DataFrame, v: DataFrame) -> DataFrame:
    dial = F.coalesce(*[F.when(F.col("device_type") == d, F.lit(x)) for d, x in _DIAL.items()], F.lit(radio.BALANCED))
    return radio.fold(e, v, dial)


@query("ST10_drift", f"{recommend._UNIT}, {_RADIO} SELECT user_id, session_no, round(v[1], 5) AS head, round(v[2], 5) AS second FROM drifts", events, library_vectors)
def _(e, v):
    """Where feedback has moved each radio session, from its first track with a vector on."""
    return radio_sessions(e, v).select("user_id", "session_no", F.round(F.get("v", F.lit(0)), 5).alias("head"), F.round(F.get("v", F.lit(1)), 5).alias("second"))


@query("ST09_radio_state", f"{recommend._UNIT}, {_RADIO} SELECT user_id, session_no, last_active, feedback, coalesce(heard, []) AS heard FROM drifts", events, library_vectors)
def _(e, v):
    """What a radio session holds: its last event, feedback, and the last fifty tracks heard in order."""
    return radio_sessions(e, v).select("user_id", "session_no", "last_active", "feedback", "heard")


@query("ST09_open_sessions", f"{recommend._UNIT}, {_RADIO} SELECT user_id, session_no, last_active FROM drifts WHERE last_active >= {NOW} - 14400 ORDER BY last_active DESC, user_id LIMIT 50", events, library_vectors)
def _(e, v):
    """The sessions that are still open, at most fifty: those active last."""
    return radio_sessions(e, v).filter(F.col("last_active") >= NOW - radio.TTL_S).orderBy(F.desc("last_active"), "user_id").limit(50).select("user_id", "session_no", "last_active")


def radio_batch(e: DataFrame, v: DataFrame, k: int = 10) -> DataFrame:
    """What was not served counts in full, so the first k of a user are among the k + m nearest, where m were served, and those m."""
    u = shared.stored(v.select("track_id", text.unit(F.col("v")).alias("u")).filter("u IS NOT NULL"), "units")
    asked = shared.stored(drift(e, v).select("user_id", F.col("v").alias("d")), "drifts")
    d = asked.filter("d IS NOT NULL")
    served = e.filter("event_type = 'reco_impression'").groupBy("user_id", "track_id").agg(F.count(F.lit(1)).alias("n"))
    served = shared.stored(served.join(u.select("track_id"), "track_id", "left_semi"), "served")
    most = d.join(served.groupBy("user_id").agg(F.count(F.lit(1)).alias("m")), "user_id", "left").select("user_id", "d", (F.coalesce("m", F.lit(0)) + k).alias("k"))
    own = served.join(d, "user_id").join(u, "track_id").select("user_id", "track_id", text.dot(F.col("d"), F.col("u")).alias("s"), "n")
    other = vectors.best_of_all(most, u).join(served, ["user_id", "track_id"], "left_anti").select("user_id", "track_id", "s", F.lit(0).cast("long").alias("n"))
    score = F.round(F.round("s", 9) * F.greatest(1 - F.col("n") / 6.0, F.lit(0.5)), 8)
    anywhere = asked.filter("d IS NULL").select("user_id").join(F.broadcast(v.select("track_id").orderBy("track_id").limit(k))).select("user_id", "track_id", F.lit(None).cast("double").alias("s"), F.lit(0).cast("long").alias("n"))
    return scoring.top_per(own.unionByName(other).unionByName(anywhere).withColumn("score", score), ["user_id"], [F.desc("score"), F.col("track_id")], k).select("user_id", "track_id", F.col("rank").alias("place"))


@query("D18_radio_batch", f"{_FEEDBACK}, near AS (SELECT user_id, track_id, round(list_dot_product(d, u) / sqrt(list_dot_product(d, d)), 9) AS s FROM drift, units), cool AS (SELECT user_id, track_id, count(*) AS n FROM listen_events WHERE event_type = 'reco_impression' GROUP BY ALL), blended AS (SELECT near.user_id, near.track_id, round(s * greatest(1 - coalesce(n, 0) / 6.0::DOUBLE, 0.5), 8) AS score FROM near LEFT JOIN cool USING (user_id, track_id)) SELECT user_id, track_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, track_id)::INT AS place FROM blended QUALIFY place <= 10", events, library_vectors)
def _(e, v):
    """The ten next of each asked session: likeness to its drift, less for what was served before."""
    return radio_batch(e, v)


@query("X25_radio_sessions", f"SELECT user_id, session_id, min(ts) AS started_at, count(*) AS events FROM listen_events WHERE surface = 'radio' AND session_id IS NOT NULL AND user_id = 'u1' GROUP BY ALL", events)
def _(e):
    return e.filter("surface = 'radio' AND session_id IS NOT NULL AND user_id = 'u1'").groupBy("user_id", "session_id").agg(F.min("ts").alias("started_at"), F.count(F.lit(1)).alias("events"))


@query("F33_decoded_vectors", None, library_vectors)
def _(v):
    """Vectors stored as base64 of little-endian 32-bit floats, decoded in batches."""
    import base64

    import numpy as np
    import pandas as pd

    def encode(x):
        return x.map(lambda a: base64.b64encode(np.asarray(a, "<f4").tobytes()).decode())

    def decode(batches):
        for b in batches:
            yield pd.DataFrame({"track_id": b["track_id"], "head": b["raw"].map(lambda s: float(np.frombuffer(base64.b64decode(s), "<f4")[0]))})

    stored = v.mapInPandas(lambda bs: (pd.DataFrame({"track_id": b["track_id"], "raw": encode(b["v"])}) for b in bs), "track_id string, raw string")
    return stored.mapInPandas(decode, "track_id string, head double")


def match_score(artist: F.Column, album: F.Column, tracks_apart: F.Column, years_apart: F.Column) -> F.Column:
    """Half the artist, two fifths the album, a twentieth each for the count of tracks and the year; null where too far off."""
    close = lambda x: F.greatest(1 - x / 5.0, F.lit(0.0))
    score = 0.50 * artist + 0.40 * album + 0.05 * close(tracks_apart) + 0.05 * close(years_apart)
    return F.when((artist >= ARTIST) & (album >= ALBUM), score)


ARTIST, ALBUM = 0.85, 0.80


def matches(t: DataFrame, x: DataFrame) -> DataFrame:
    """target, server_id, score of hits for each album of the library: names that can be like enough are found by their rare character pairs."""
    albums = t.groupBy("artist", "album").agg(F.count(F.lit(1)).alias("tracks"))
    hits = x.select("server_id", F.col("artist").alias("hit_artist"), F.col("album").alias("hit_album"), "duration")
    like = lambda name, least: fuzzy.joined(albums.select(F.col(name).alias("s")), hits.select(F.col(f"hit_{name}").alias("s")), least).toDF(name, f"hit_{name}", f"{name}_ratio")
    both = albums.join(like("album", ALBUM), "album").join(hits, "hit_album").join(like("artist", ARTIST), ["artist", "hit_artist"])
    score = match_score(F.col("artist_ratio"), F.col("album_ratio"), F.abs(F.col("tracks") - F.col("duration") % 12), F.col("duration") % 3)
    return both.select(F.concat_ws("/", "artist", "album").alias("target"), "server_id", score.alias("score"))


@query("F11_match_score", None, tracks, matching.credits)
def _(t, x):
    return matches(t, x).filter("score IS NOT NULL")


@query("D43_best_match", None, tracks, matching.credits)
def _(t, x):
    return scoring.top_per(matches(t, x).filter("score IS NOT NULL"), ["target"], [F.desc(F.round("score", 9)), F.col("server_id")], 1).select("target", "server_id", "score")


@query("D39_new_artist_discovery", f"{matching.CREDITS}, pos AS (SELECT {matching.norm('artist')} AS artist, row_number() OVER (PARTITION BY album ORDER BY server_id) AS p FROM credits), scores AS (SELECT artist, sum(1.0::DOUBLE / p) AS s FROM pos GROUP BY artist) SELECT artist, round(s, 6) AS score FROM scores WHERE artist NOT IN (SELECT {matching.norm('artist')} FROM track_features) ORDER BY round(s, 6) DESC, artist LIMIT 15", matching.credits, tracks)
def _(x, t):
    """Unknown artists by how high they stand in lists, up to a day's budget."""
    place = F.row_number().over(Window.partitionBy("album").orderBy("server_id"))
    listed = x.select(text.normalised(F.col("artist")).alias("artist"), place.alias("p"))
    scores = listed.groupBy("artist").agg(F.round(F.sum(1.0 / F.col("p")), 6).alias("score"))
    return scores.join(t.select(text.normalised(F.col("artist")).alias("artist")), "artist", "left_anti").orderBy(F.desc("score"), "artist").limit(15)


@query("D38_library_health", "checks AS (SELECT unnest([{'name': 'bpm', 'bad': count_if(bpm NOT BETWEEN 40 AND 220)}, {'name': 'energy', 'bad': count_if(energy NOT BETWEEN 0 AND 1)}, {'name': 'failed', 'bad': count_if(analysis_error IS NOT NULL)}, {'name': 'stale', 'bad': count_if(analysis_version < 2)}]) AS x, count(*) AS n FROM track_features) SELECT x.name AS name, x.bad::BIGINT AS bad, CASE WHEN x.bad = 0 THEN 'ok' WHEN x.bad < n * 0.1 THEN 'warn' ELSE 'fail' END AS status FROM checks", tracks)
def _(t):
    bad = {"bpm": ~F.col("bpm").between(40, 220), "energy": ~F.col("energy").between(0, 1), "failed": F.col("analysis_error").isNotNull(), "stale": F.col("analysis_version") < 2}
    counts = t.agg(F.array(*[F.struct(F.lit(n).alias("name"), F.count_if(x).alias("bad")) for n, x in bad.items()]).alias("checks"), F.count(F.lit(1)).alias("n"))
    return counts.select(F.explode("checks").alias("x"), "n").select("x.name", "x.bad", F.when(F.col("x.bad") == 0, "ok").when(F.col("x.bad") < F.col("n") * 0.1, "warn").otherwise("fail").alias("status"))


@query("D49_mix_shelf", "SELECT mode AS mix, count(*) AS tracks, min(title) AS first_title FROM track_features GROUP BY mode", tracks)
def _(t):
    return t.groupBy(F.col("mode").alias("mix")).agg(F.count(F.lit(1)).alias("tracks"), F.min("title").alias("first_title"))


@query("E09_preset_report", "presets AS (SELECT unnest([0.0, 0.3, 0.6, 1.0])::DOUBLE AS dial), pop AS (SELECT track_id, sum(play_count) AS p FROM interactions GROUP BY track_id), scored AS (SELECT dial, i.user_id, i.track_id, p, row_number() OVER (PARTITION BY dial, i.user_id ORDER BY round((1 - dial) * satisfaction + dial / (1 + p), 9) DESC, i.track_id) AS n FROM interactions i JOIN pop USING (track_id), presets) SELECT dial, round(avg(1.0::DOUBLE / (1 + p)), 6) AS novelty, count(DISTINCT track_id) AS tracks FROM scored WHERE n <= 5 GROUP BY dial", plays)
def _(i):
    """Novelty and reach of the first five at each preset of the discovery dial."""
    pop = i.groupBy("track_id").agg(F.sum("play_count").alias("p"))
    # dealt by user before the presets multiply the rows
    own = i.join(pop, "track_id").select("user_id", "track_id", "satisfaction", "p").repartition("user_id")
    each = own.withColumn("dial", F.explode(F.array(*map(F.lit, (0.0, 0.3, 0.6, 1.0)))))
    score = F.round((1 - F.col("dial")) * F.col("satisfaction") + F.col("dial") / (1 + F.col("p")), 9)
    top = scoring.top_per(each, ["dial", "user_id"], [F.desc(score), F.col("track_id")], 5)
    return top.groupBy("dial").agg(F.avg(1.0 / (1 + F.col("p"))).alias("novelty"), F.countDistinct("track_id").alias("tracks"))


@query("D15_dial_presets", "presets AS (SELECT * FROM (VALUES (0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE), (0.3, 0.10, 0.8), (0.6, 0.25, 0.5), (1.0, 0.50, 0.2)) x(dial, novelty, familiar)), asked AS (SELECT k / 10.0::DOUBLE AS d FROM range(11) r(k)), pair AS (SELECT d, (SELECT max(dial) FROM presets WHERE dial <= d) AS low, (SELECT min(dial) FROM presets WHERE dial >= d) AS high FROM asked) SELECT d AS dial, round(a.novelty + CASE WHEN high > low THEN (d - low) / (high - low) ELSE 0 END * (b.novelty - a.novelty), 6) AS novelty, round(a.familiar + CASE WHEN high > low THEN (d - low) / (high - low) ELSE 0 END * (b.familiar - a.familiar), 6) AS familiar FROM pair JOIN presets a ON a.dial = low JOIN presets b ON b.dial = high", tracks)
def _(t):
    """Settings between the presets of the discovery dial, by straight lines."""
    # Dial, weight of novelty, weight of what is familiar.
    presets = ((0.0, 0.0, 1.0), (0.3, 0.10, 0.8), (0.6, 0.25, 0.5), (1.0, 0.50, 0.2))

    def at(k: int) -> F.Column:
        out = F.lit(presets[-1][k])
        for (low, *a), (high, *b) in reversed(list(zip(presets[:-1], presets[1:], strict=True))):
            line = a[k - 1] + (F.col("dial") - low) / (high - low) * (b[k - 1] - a[k - 1])
            out = F.when(F.col("dial") < high, line).otherwise(out)
        return out

    asked = t.sparkSession.range(11).select((F.col("id") / 10.0).alias("dial"))
    return asked.select("dial", at(1).alias("novelty"), at(2).alias("familiar"))


@query("T07_random_sample", None, tracks)
def _(t):
    """A random order is the feature; a seed makes it repeatable."""
    return t.orderBy(F.rand(7), "track_id").limit(20).select("track_id")


@query("A01_session_rollup", f"""{SESSIONS} SELECT user_id, session_no, min(ts) AS started_at, max(ts) AS ended_at, max(ts) - min(ts) AS duration_s, count(*) AS events, count(DISTINCT track_id) AS tracks,
  count_if(event_type = 'play_start')::BIGINT AS plays, count_if(event_type = 'skip')::BIGINT AS skips, count_if(event_type = 'like')::BIGINT AS likes,
  round(count_if(event_type = 'skip') / greatest(count_if(event_type = 'play_start'), 1), 6) AS skip_rate, round(avg(CASE WHEN event_type = 'play_end' THEN value END), 6) AS avg_completion,
  sum(dwell_ms)::BIGINT AS dwell_ms, arg_min(hour_of_day, ts * 1000000 + id) AS hour_of_day, arg_min(surface, ts * 1000000 + id) AS surface, count_if(event_type = 'pause')::BIGINT AS pauses, count_if(event_type = 'reco_impression')::BIGINT AS impressions FROM numbered GROUP BY user_id, session_no""", events)
def _(e):
    return sessions.rollup(e)
