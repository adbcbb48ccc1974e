"""Queries over frames: slices, series, cycles, divergence and flicker."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.functions.luminance import tile_luminance
from kinetable.operators import cycles, flicker, frames
from kinetable.plans.registry import query, r6
from kinetable.plans.shapes import Shapes

EP = ("dataset_key", "episode_index")
VIDEO = ("dataset_key", "episode_index", "camera")


@query("""SELECT dataset_key, episode_index, frame_index FROM frames WHERE index >= 1200 AND index < 3400""")
def index_range_slice(s: Shapes):
    return frames.index_range_slice(s.frames, 1200, 3400).select(*EP, "frame_index")


@query("""SELECT dataset_key, episode_index, frame_index FROM frames WHERE frame_index % 1000 >= 100 AND frame_index % 1000 < 250""")
def index_slice_by_position(s: Shapes):
    return frames.index_range_slice(s.frames.drop("index"), 100, 250).select(*EP, "frame_index")


@query("""SELECT dataset_key, episode_index, frame_index, 'observation.state[' || (k - 1) || ']' AS series,
  round(CAST(embedding[k] AS DOUBLE), 6) AS value FROM vectors, range(1, 33) r(k)
UNION ALL SELECT dataset_key, episode_index, frame_index, 'action[' || (k - 33) || ']', round(CAST(embedding[k] AS DOUBLE), 6)
FROM vectors, range(33, 65) r(k)""")
def explode_series(s: Shapes):
    v = s.vectors
    features = {"observation.state": "float32", "action": "float32", "observation.images.cam_head": "video"}
    states, actions = frames.series_columns(features, v.schema)
    return frames.explode_series(v, [*states, *actions]).withColumn("value", r6("value"))


_PAIRS = """SELECT dataset_key, episode_index, frame_index, '[' || (k - 1) || ']' AS key,
  CAST(embedding[k] AS DOUBLE) AS obs, CAST(embedding[k + 32] AS DOUBLE) AS act FROM vectors, range(1, 33) r(k)"""


@query(f"SELECT dataset_key, episode_index, frame_index, key, round(obs, 6) AS obs, round(act, 6) AS act FROM ({_PAIRS})")
def pair_state_action(s: Shapes):
    out = frames.pair_state_action(s.vectors, ["observation.state"], ["action"])
    return out.withColumns({"obs": r6("obs"), "act": r6("act")})


@query("""SELECT dataset_key, episode_index, frame_index, key, round(obs, 6) AS obs, round(act, 6) AS act FROM (
  SELECT dataset_key, episode_index, frame_index, key,
    CAST(CASE key WHEN 'left' THEN left_arm WHEN 'right' THEN right_arm END AS DOUBLE) AS obs,
    CAST(CASE key WHEN 'left' THEN right_arm WHEN 'right' THEN left_arm END AS DOUBLE) AS act
  FROM frames, (VALUES ('left'), ('right')) k(key))""")
def pair_named_series(s: Shapes):
    state = F.col("`observation.state`")
    f = s.frames.select(
        *EP, "frame_index", F.get(state, F.lit(7)).alias("observation.state.left"),
        F.get(state, F.lit(15)).alias("observation.right"), F.get(state, F.lit(0)).alias("action.left"),
        F.get(state, F.lit(7)).alias("action.right"), F.get(state, F.lit(15)).alias("actionleft"))
    out = frames.pair_state_action(
        f, ["observation.state.left", "observation.right"], ["action.left", "action.right", "actionleft"])
    return out.withColumns({"obs": r6("obs"), "act": r6("act")})


# bands by walking the runs: level per frame, islands, soften, islands again
_BANDS = f"""
WITH pairs AS ({_PAIRS}),
ranged AS (SELECT *, greatest(max(obs) OVER w - min(obs) OVER w, max(act) OVER w - min(act) OVER w) AS rng
  FROM pairs WINDOW w AS (PARTITION BY dataset_key, episode_index, key)),
leveled AS (SELECT dataset_key, episode_index, key, frame_index AS pos,
  CASE WHEN abs(act - obs) / rng > 0.30 THEN 'severe' WHEN abs(act - obs) / rng > 0.15 THEN 'moderate' END AS level
  FROM ranged WHERE rng > 0),
first_runs AS (SELECT dataset_key, episode_index, key, level, min(pos) AS a, max(pos) AS z FROM (
  SELECT *, pos - row_number() OVER (PARTITION BY dataset_key, episode_index, key, level ORDER BY pos) AS g
  FROM leveled WHERE level IS NOT NULL) GROUP BY dataset_key, episode_index, key, level, g),
softened AS (SELECT dataset_key, episode_index, key, unnest(range(a, z + 1)) AS pos,
  CASE WHEN level = 'severe' AND z - a + 1 < 5 THEN 'moderate' ELSE level END AS level FROM first_runs)
SELECT dataset_key, episode_index, key, level, min(pos) AS start, max(pos) AS "end" FROM (
  SELECT *, pos - row_number() OVER (PARTITION BY dataset_key, episode_index, key, level ORDER BY pos) AS g FROM softened)
GROUP BY dataset_key, episode_index, key, level, g"""


@query(_BANDS)
def divergence_bands(s: Shapes):
    return frames.vector_divergence_bands(s.vectors, "observation.state", "action")


@query(_BANDS, name="divergence_bands_of_pairs")
def _divergence_of_pairs(s: Shapes):
    return frames.divergence_bands(frames.pair_vectors(s.vectors, "observation.state", "action"))


@query("""SELECT dataset_key, episode_index, frame_index, round(left_arm, 6) AS a, round(right_arm, 6) AS b, CAST(1.0 AS FLOAT) AS c FROM frames""")
def robot_layout(s: Shapes):
    state = F.col("`observation.state`")
    joints = F.create_map(
        F.lit("left_gripper"), F.get(state, F.lit(7)), F.lit("right_gripper"), F.get(state, F.lit(15)))
    layout = frames.robot_layout(joints, [
        {"name": "left_gripper", "selector": "left_gripper"},
        {"name": "right_gripper", "selector": "right_gripper"}, {"name": "available", "constant": 1.0}])
    return s.frames.select(*EP, "frame_index", layout.alias("v")).select(
        *EP, "frame_index", *[r6(F.col("v")[i]).alias(n) for i, n in enumerate("abc")])


# an arm ends a cycle where it is open and the closest earlier reading outside
# the dead band was closed
_ENDS = """
WITH arms AS (SELECT dataset_key, episode_index, frame_index, left_arm AS v, 'l' AS arm FROM frames
  UNION ALL SELECT dataset_key, episode_index, frame_index, right_arm, 'r' FROM frames),
outside AS (SELECT *, v > CAST(0.8 AS FLOAT) AS opened,
  lag(v < CAST(0.5 AS FLOAT)) OVER (PARTITION BY dataset_key, episode_index, arm ORDER BY frame_index) AS was_closed
  FROM arms WHERE v < CAST(0.5 AS FLOAT) OR v > CAST(0.8 AS FLOAT)),
ends AS (SELECT DISTINCT dataset_key, episode_index, frame_index FROM outside WHERE opened AND was_closed)"""


@query(f"{_ENDS} SELECT * FROM ends")
def cycle_ends(s: Shapes):
    return cycles.cycle_ends(s.frames).where("is_cycle_end").select(*EP, "frame_index")


@query(f"""{_ENDS} SELECT f.dataset_key, f.episode_index, f.frame_index, e.frame_index IS NOT NULL AS is_terminal,
  f.frame_index = max(f.frame_index) OVER (PARTITION BY f.dataset_key, f.episode_index) AS is_last
FROM frames f LEFT JOIN ends e ON e.dataset_key = f.dataset_key AND e.episode_index = f.episode_index AND e.frame_index = f.frame_index""")
def stamp_cycles(s: Shapes):
    return cycles.stamp_cycles(s.frames).select(*EP, "frame_index", "is_terminal", "is_last")


@query(f"""{_ENDS} SELECT f.dataset_key, count(DISTINCT f.episode_index) AS episodes_processed,
  count(e.frame_index) AS is_terminal_count, count(DISTINCT f.episode_index) AS is_last_count
FROM frames f LEFT JOIN ends e ON e.dataset_key = f.dataset_key AND e.episode_index = f.episode_index AND e.frame_index = f.frame_index
GROUP BY f.dataset_key""")
def stamp_counts(s: Shapes):
    return cycles.stamp_counts(cycles.stamp_cycles(s.frames))


@query(f"""{_ENDS}, sharded AS (SELECT f.dataset_key, f.frame_index // 1000 AS shard, e.frame_index IS NOT NULL AS t
  FROM frames f LEFT JOIN ends e ON e.dataset_key = f.dataset_key AND e.episode_index = f.episode_index AND e.frame_index = f.frame_index)
SELECT dataset_key, bool_or(shard >= 3) AS stamped, count(*) FILTER (t AND shard = first_stamped) AS terminal_sample FROM (
  SELECT *, min(shard) FILTER (shard >= 3) OVER (PARTITION BY dataset_key) AS first_stamped FROM sharded) GROUP BY dataset_key""")
def stamp_state(s: Shapes):
    late = F.col("frame_index") >= 3000
    stamped = cycles.stamp_cycles(s.frames).withColumns({
        c: F.when(late, F.col(c)) for c in cycles.STAMPS})
    return cycles.stamp_state(stamped)


@query(f"""{_ENDS}, placed AS (SELECT *, row_number() OVER (PARTITION BY dataset_key, episode_index ORDER BY frame_index) - 1 AS position FROM frames)
SELECT p.dataset_key, p.episode_index, p.position, round(p.timestamp, 6) AS timestamp FROM placed p
JOIN ends e ON e.dataset_key = p.dataset_key AND e.episode_index = p.episode_index AND e.frame_index = p.frame_index""")
def terminal_frames(s: Shapes):
    return frames.terminal_frames(cycles.stamp_cycles(s.frames)).withColumn("timestamp", r6("timestamp"))


# --- flicker --------------------------------------------------------------------

_DELTAS = """
WITH deltas AS (SELECT * FROM (SELECT dataset_key, episode_index, camera, frame_no, tile,
  abs(luminance - lag(luminance) OVER (PARTITION BY dataset_key, episode_index, camera, tile ORDER BY frame_no)) AS delta
  FROM tiles) WHERE delta IS NOT NULL),
med AS (SELECT dataset_key, episode_index, camera, median(CAST(delta AS DOUBLE)) AS median, CAST(max(delta) AS DOUBLE) AS max_delta
  FROM deltas GROUP BY ALL),
lim AS (SELECT m.dataset_key, m.episode_index, m.camera, any_value(m.median) AS median, any_value(m.max_delta) AS max_delta,
  CASE WHEN median(abs(CAST(delta AS DOUBLE) - m.median)) = 0 THEN 1e-6 ELSE median(abs(CAST(delta AS DOUBLE) - m.median)) END AS mad
  FROM med m JOIN deltas d ON d.dataset_key = m.dataset_key AND d.episode_index = m.episode_index AND d.camera = m.camera
  GROUP BY m.dataset_key, m.episode_index, m.camera),
thr AS (SELECT *, greatest(12.0, median + 8 * mad) AS threshold FROM lim),
spikes AS (SELECT d.dataset_key, d.episode_index, d.camera, d.frame_no, count(*) AS spiking_tiles
  FROM deltas d JOIN thr t ON t.dataset_key = d.dataset_key AND t.episode_index = d.episode_index AND t.camera = d.camera
  WHERE d.delta > t.threshold GROUP BY ALL HAVING count(*) <= 8)"""


@query(f"{_DELTAS} SELECT dataset_key, episode_index, camera, frame_no, CAST(tile AS INTEGER) AS tile, round(delta, 4) AS delta FROM deltas")
def frame_delta(s: Shapes):
    return flicker.frame_delta(s.tiles).withColumn("delta", F.round("delta", 4))


@query(f"""{_DELTAS} SELECT dataset_key, episode_index, camera, round(median, 6) AS median, round(mad, 6) AS mad,
  round(max_delta, 6) AS max_delta, round(threshold, 6) AS threshold FROM thr""")
def flicker_median_mad(s: Shapes):
    out = flicker.flicker_threshold(flicker.frame_delta(s.tiles))
    return out.select(*VIDEO, *[r6(c).alias(c) for c in ("median", "mad", "max_delta", "threshold")])


@query(f"{_DELTAS} SELECT * FROM spikes")
def flicker_spikes(s: Shapes):
    deltas = flicker.frame_delta(s.tiles)
    return flicker.flicker_spikes(deltas, flicker.flicker_threshold(deltas), 16)


@query(f"""{_DELTAS} SELECT t.dataset_key, t.episode_index, t.camera, count(s.frame_no) > 0 AS matched,
  count(s.frame_no) AS spike_count, min(s.frame_no) AS first_spike, max(s.frame_no) AS last_spike,
  round(any_value(t.max_delta), 6) AS max_delta FROM thr t
LEFT JOIN spikes s ON s.dataset_key = t.dataset_key AND s.episode_index = t.episode_index AND s.camera = t.camera
GROUP BY t.dataset_key, t.episode_index, t.camera""")
def flicker_verdict(s: Shapes):
    return flicker.flicker_verdict(s.tiles).withColumn("max_delta", r6("max_delta"))


def _videos(s: Shapes):
    """Episodes of the tiles with a head camera, and a ZED camera on the even ones."""
    place = lambda: F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("file"))
    i = F.col("episode_index")
    videos = F.when(i % 5 == 4, F.create_map(F.lit("wrist"), place())).when(
        i % 2 == 0, F.create_map(F.lit("observation.images.ZED_left"), place(),
                                 F.lit("observation.images.cam_head"), place())
    ).otherwise(F.create_map(F.lit("observation.images.cam_head"), place()))
    episodes = s.vectors.select(*EP).distinct().withColumn("videos", videos)
    feature = lambda dtype: F.struct(F.lit(dtype).alias("dtype"))
    catalog = s.vectors.select("dataset_key").distinct().withColumn("features", F.create_map(
        F.lit("observation.images.ZED_left"), feature("video"),
        F.lit("observation.images.cam_head"), feature("video"),
        F.lit("observation.images.wrist"), feature("video"),
        F.lit("observation.images.head_depth"), feature("image")))
    errors = s.vectors.select(*EP).distinct().where("episode_index % 4 = 0").select(
        *EP, F.lit("observation.images.ZED_left").alias("camera"), F.lit("truncated stream").alias("error"))
    return episodes, catalog, errors


@query(f"""{_DELTAS}, eps AS (SELECT DISTINCT dataset_key, episode_index FROM vectors),
cams AS (SELECT e.*, c.camera, c.rank, CASE WHEN episode_index % 5 = 4 THEN false WHEN c.rank = 1 THEN true ELSE episode_index % 2 = 0 END AS here
  FROM eps e, (VALUES ('observation.images.ZED_left', 0), ('observation.images.cam_head', 1)) c(camera, rank)),
looked AS (SELECT c.*, here AND rank = 0 AND episode_index % 4 = 0 AS broken,
  here AND rank = 1 AND EXISTS (SELECT 1 FROM spikes s WHERE s.episode_index = c.episode_index) AS matched FROM cams c)
SELECT dataset_key, episode_index, camera, CAST(rank AS INTEGER) AS rank, matched,
  CASE WHEN NOT here THEN 'episode ' || episode_index || ': missing video location for ' || camera
    WHEN broken THEN 'episode ' || episode_index || ': cannot decode ' || camera || ': truncated stream' END AS warning
FROM looked""")
def flicker_scan(s: Shapes):
    episodes, catalog, errors = _videos(s)
    return flicker.flicker_scan(
        flicker.expected_cameras(episodes, catalog), flicker.flicker_verdict(s.tiles), errors)


@query(f"""{_DELTAS}, eps AS (SELECT DISTINCT dataset_key, episode_index FROM vectors)
SELECT dataset_key, count(*) AS inspected,
  count(*) FILTER (episode_index % 5 <> 4 AND episode_index IN (SELECT episode_index FROM spikes)) AS matched,
  CAST(sum(CASE WHEN episode_index % 5 = 4 THEN 2 WHEN episode_index % 2 = 1 THEN 1 WHEN episode_index % 4 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS warnings
FROM eps GROUP BY dataset_key""")
def flicker_scan_summary(s: Shapes):
    return flicker.flicker_scan_summary(flicker_scan(s))


@query(f"""{_DELTAS}, matched AS (SELECT DISTINCT dataset_key, episode_index FROM spikes),
graded AS (SELECT m.*, CASE episode_index % 4 WHEN 0 THEN 'Normal' WHEN 1 THEN 'good' WHEN 2 THEN 'bad' END AS grade FROM matched m)
SELECT dataset_key, episode_index, coalesce(lower(grade) = 'normal', false) AS eligible,
  CASE WHEN lower(grade) = 'normal' THEN 'bad' ELSE grade END AS grade,
  CASE WHEN coalesce(lower(grade) = 'normal', false) THEN NULL ELSE 'grade ' || coalesce(grade, 'None') || ' is not eligible' END AS skipped_reason
FROM graded""")
def flicker_mark_bad(s: Shapes):
    i = F.col("episode_index")
    episodes = s.vectors.select(*EP).distinct().withColumn(
        "grade", F.when(i % 4 == 0, "Normal").when(i % 4 == 1, "good").when(i % 4 == 2, "bad"))
    matched = flicker.flicker_verdict(s.tiles).where("matched")
    return flicker.flicker_mark_bad(matched, episodes)


@query("""
WITH px AS (SELECT dataset_key, episode_index, frame_index AS frame_no, k // 8 AS y, k % 8 AS x,
  CAST(floor(abs(CAST(embedding[k + 1] AS DOUBLE)) * 500) AS BIGINT) % 256 AS v FROM vectors, range(64) r(k))
SELECT dataset_key, episode_index, frame_no, CAST((y // 4) * 2 + x // 4 AS INTEGER) AS tile,
  round(avg(v), 4) AS luminance FROM px GROUP BY ALL""")
def tile_luminance_gray(s: Shapes):
    vector = F.concat("`observation.state`", "action")
    hexed = F.array_join(F.transform(vector, lambda x: F.lpad(F.hex(
        F.floor(F.abs(x.cast("double")) * 500) % 256), 2, "0")), "")
    images = s.vectors.select(
        *EP, F.col("frame_index").alias("frame_no"), F.lit(8).alias("height"), F.lit(8).alias("width"),
        F.lit(1).alias("channels"), F.unhex(hexed).alias("pixels"))
    out = tile_luminance(images, keys=[*EP, "frame_no"], rows=2, cols=2)
    return out.select(*EP, "frame_no", "tile", F.round(F.col("luminance").cast("double"), 4).alias("luminance"))
