"""Cycles, divergence, slices and flicker against vectors and plain loops."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.functions.luminance import tile_luminance, tile_means
from kinetable.operators import cycles, flicker, frames

VIDEO = ["dataset_key", "episode_index", "camera"]


def _arm_frames(spark, left, right):
    data = [("d", 0, i, float(a), float(b)) for i, (a, b) in enumerate(zip(left, right))]
    return spark.createDataFrame(data, "dataset_key string, episode_index long, frame_index long, l float, r float")


def _ends(spark, left, right):
    out = cycles.cycle_ends(_arm_frames(spark, left, right), left=F.col("l"), right=F.col("r"))
    return sorted(r.frame_index for r in out.where("is_cycle_end").collect())


@pytest.mark.parametrize("left,right,want", [
    ([.9, .4, .3, .4, .81, .2, .1, .3, .81], [.9] * 9, [4, 8]),
    ([.4, .3, .81, .2, .3, .81], [.9] * 6, [2, 5]),
    ([.9, .4, .81, .9, .9], [.9, .9, .9, .2, .81], [2, 4]),
    ([.9, .4, .81], [.9, .4, .81], [2]),
    ([.9] * 4, [.9] * 4, []),
    ([.1] * 4, [.1] * 4, []),
    ([.5, .79, .8, .6, .5], [.9] * 5, []),
    ([.4, float("nan"), .8, .81], [.9] * 4, [3]),
])
def test_cycle_vectors(spark, left, right, want):
    assert _ends(spark, left, right) == want


def _loop(values):
    ends, closed = [], False
    for i, v in enumerate(values):
        if np.float32(v) > np.float32(0.8) and closed:
            ends.append(i)
        closed = bool(np.float32(v) < np.float32(0.5)) or (closed and not np.float32(v) > np.float32(0.8))
    return ends


def test_cycles_equal_a_loop(spark, monkeypatch):
    from kinetable.operators import ordered

    monkeypatch.setattr(cycles, "int_block", lambda c: ordered.int_block(c, 6))
    rng = random.Random(7)
    traces = [[round(rng.random(), 2) for _ in range(40)] for _ in range(60)]
    data = [("d", e, i, v) for e, t in enumerate(traces) for i, v in enumerate(t)]
    df = spark.createDataFrame(data, "dataset_key string, episode_index long, frame_index long, v float")
    out = cycles.cycle_ends(df, left=F.col("v"), right=F.lit(0.9)).where("is_cycle_end").collect()
    got = {e: [] for e in range(60)}
    for r in out:
        got[r.episode_index].append(r.frame_index)
    assert {e: sorted(v) for e, v in got.items()} == {e: _loop(t) for e, t in enumerate(traces)}


def test_stamps_cross_shards_and_are_not_repeated(spark):
    state = lambda v: [0.9] * 7 + [v] + [0.9] * 8
    data = [("d", 0, i, state(v), f"file-{i % 2}", i // 2) for i, v in enumerate([.9, .4, .3, .81, .9, .9])]
    data += [("d", 1, i, state(.9), "file-2", i) for i in range(4)]
    df = spark.createDataFrame(data, "dataset_key string, episode_index long, frame_index long, "
                                     "`observation.state` array<float>, shard_path string, shard_row long")
    out = cycles.stamp_cycles(df)
    flag = lambda c: sorted((r.episode_index, r.frame_index) for r in out.where(c).collect())
    assert flag("is_terminal") == [(0, 3)] and flag("is_last") == [(0, 5), (1, 3)]
    assert tuple(cycles.stamp_counts(out).first()) == ("d", 2, 1, 2)
    with pytest.raises(ValueError):
        cycles.stamp_cycles(out)
    again = cycles.stamp_cycles(out, overwrite=True)
    assert again.columns == out.columns and again.where("is_terminal").count() == 1
    assert tuple(cycles.stamp_state(df).first()) == ("d", False, 0)
    assert cycles.stamp_state(out).first().stamped


def test_slice_terminal_and_series(spark):
    data = [("d", 7, 120036 + k, k, k / 10 + 0.1, k == 2, [1.0 + 2 * k, 2.0 + 2 * k], [1.0, 2.0], k, "f") for k in (2, 0, 1)]
    df = spark.createDataFrame(data, "dataset_key string, episode_index long, index long, frame_index long, timestamp double, "
                                     "is_terminal boolean, `observation.state` array<float>, action array<float>, shard_row long, shard_path string")
    hit = frames.index_range_slice(df, 120036, 120039)
    assert hit.count() == 3 and frames.index_range_slice(df, 120037, 120038).count() == 1
    assert [r.frame_index for r in frames.sort_frames(hit).collect()] == [0, 1, 2]
    # nothing in the range: positions in the file count
    assert sorted(r.frame_index for r in frames.index_range_slice(df, -5, 2).collect()) == [0, 1]
    series = frames.explode_series(hit, ["observation.state"])
    values = {}
    for r in series.orderBy("frame_index").collect():
        values.setdefault(r.series, []).append(r.value)
    assert values == {"observation.state[0]": [1, 3, 5], "observation.state[1]": [2, 4, 6]}
    terminal = frames.terminal_frames(hit).collect()
    assert [(r.position, round(r.timestamp, 6)) for r in terminal] == [(2, 0.3)]


def test_single_element_vectors_keep_their_name(spark):
    df = spark.createDataFrame([("d", 0, 0, [5.0], 2.0)], "dataset_key string, episode_index long, frame_index long, a array<float>, b double")
    assert sorted((r.series, r.value) for r in frames.explode_series(df, ["a", "b"]).collect()) == [("a", 5.0), ("b", 2.0)]


def test_pairing_takes_the_last_action(spark):
    df = spark.createDataFrame([("d", 0, 0, [1.0, 2.0], [3.0, 4.0], [9.0])],
                               "dataset_key string, episode_index long, frame_index long, `observation.state` array<float>, action array<float>, `action.extra` array<float>")
    df = df.withColumn("action.extra", F.array(F.lit(9.0), F.lit(8.0)))
    out = frames.pair_state_action(df, ["observation.state"], ["action", "action.extra"]).collect()
    assert sorted((r.key, r.obs, r.act) for r in out) == [("[0]", 1.0, 9.0), ("[1]", 2.0, 8.0)]


def _bands(obs, act):
    spread = max(max(obs) - min(obs), max(act) - min(act))
    if spread == 0:
        return []
    names = ["severe" if abs(a - o) / spread > 0.30 else "moderate" if abs(a - o) / spread > 0.15 else None
             for o, a in zip(obs, act)]
    spans = lambda marks: [
        [i, next((k for k in range(i, len(marks)) if marks[k] != m), len(marks)) - 1, m]
        for i, m in enumerate(marks) if m and (i == 0 or marks[i - 1] != m)]
    for a, z, m in spans(names):
        if m == "severe" and z - a + 1 < 5:
            names[a:z + 1] = ["moderate"] * (z - a + 1)
    return sorted(map(tuple, spans(names)))


def test_divergence_equals_a_loop(spark):
    rng = random.Random(11)
    series, data = {}, []
    for e in range(40):
        drift = 0.0
        obs, act = [], []
        for i in range(60):
            drift = drift if rng.random() < 0.8 else rng.choice([0, 0.2, 0.5, 0.9])
            obs.append(rng.random() if e else 1.0)
            act.append(obs[-1] + drift if e else 1.0)
        series[e] = (obs, act)
        data += [("d", e, "k", i, o, a) for i, (o, a) in enumerate(zip(obs, act))]
    df = spark.createDataFrame(data, "dataset_key string, episode_index long, key string, frame_index long, obs double, act double")
    got = {e: [] for e in series}
    for r in frames.divergence_bands(df).collect():
        got[r.episode_index].append((r.start, r.end, r.level))
    assert {e: sorted(v) for e, v in got.items()} == {e: _bands(*s) for e, s in series.items()}


def test_robot_layout(spark):
    arms = [{"arm_joints": ["l0", "l1"], "gripper_joints": ["lg"]}, {"arm_joints": ["r0"], "gripper_joints": ["rg"]}]
    assert frames.layout_order(arms, exclude=["l1"]) == ["l0", "lg", "r0", "rg"]
    df = spark.sql("select map('l0', 1.0D, 'lg', 2.0D) as j")
    v = df.select(frames.robot_layout(F.col("j"), [{"selector": "lg"}, {"constant": 0.5}, {"selector": "none"}])).first()[0]
    assert v == [2.0, 0.5, None]


def _video(spark, images, episode=0):
    data = [("d", episode, "observation.images.cam_head", n, *im.shape[:2], 1 if im.ndim == 2 else im.shape[2], bytearray(im.tobytes()))
            for n, im in enumerate(images)]
    df = spark.createDataFrame(data, "dataset_key string, episode_index long, camera string, frame_no long, height int, width int, channels int, pixels binary")
    return tile_luminance(df, keys=[*VIDEO, "frame_no"])


def _flat(v):
    return np.full((8, 8), v, np.uint8)


def test_flicker_corner_flash(spark):
    images = [_flat(30) for _ in range(6)]
    images[3] = images[3].copy()
    images[3][:4, :4] = 220
    out = flicker.flicker_verdict(_video(spark, images)).first()
    assert out.matched and out.first_spike <= 3 <= out.last_spike and out.max_delta >= 100


def test_uniform_change_is_no_flicker(spark):
    out = flicker.flicker_verdict(_video(spark, [_flat(v) for v in (30, 30, 220, 220)])).first()
    assert not out.matched and out.spike_count == 0
    assert not flicker.flicker_verdict(_video(spark, [_flat(3)])).first().matched


def test_small_frames_are_reported(spark):
    rows = _video(spark, [np.zeros((2, 2), np.uint8)]).collect()
    assert rows[0].tile == -1 and "smaller" in rows[0].error


def test_frame_delta_crosses_blocks(spark, monkeypatch):
    monkeypatch.setattr(flicker, "FRAMES_PER_BLOCK", 3)
    df = spark.createDataFrame([("d", 0, "c", n, 0, float(n * n)) for n in range(10)],
                               "dataset_key string, episode_index long, camera string, frame_no long, tile int, luminance float")
    assert sorted(r.delta for r in flicker.frame_delta(df).collect()) == [float(2 * n - 1) for n in range(1, 10)]


def test_tile_means_of_colour_and_uneven_tiles():
    rng = np.random.default_rng(5)
    image = rng.integers(0, 255, (7, 9, 3)).astype(np.uint8)
    gray = image.astype(np.float32) @ np.array([0.299, 0.587, 0.114], np.float32)
    want = [gray[r * 7 // 2:(r + 1) * 7 // 2, c * 9 // 4:(c + 1) * 9 // 4].mean() for r in range(2) for c in range(4)]
    assert np.allclose(tile_means(image, 2, 4).ravel(), want, rtol=1e-5)
    with pytest.raises(ValueError):
        tile_means(np.zeros((4, 4, 2)), 1, 1)


def test_scan_stops_at_the_first_match(spark):
    place = "named_struct('chunk', 0L, 'file', 0L)"
    eps = spark.sql(f"""select 'd' dataset_key, e episode_index, map('head_a', {place}, 'zed_b', {place}) videos from values (0L), (1L) t(e)
        union all select 'd', 2L, map('zed_b', {place})""")
    catalog = spark.sql("""select 'd' dataset_key, map('head_a', named_struct('dtype', 'video'), 'zed_b', named_struct('dtype', 'video'),
        'wrist', named_struct('dtype', 'video'), 'head_c', named_struct('dtype', 'image')) features""")
    verdicts = spark.createDataFrame([("d", 0, "head_a", True), ("d", 1, "zed_b", False)], "dataset_key string, episode_index long, camera string, matched boolean")
    errors = spark.createDataFrame([("d", 1, "head_a", "bad stream")], "dataset_key string, episode_index long, camera string, error string")
    scan = flicker.flicker_scan(flicker.expected_cameras(eps, catalog), verdicts, errors)
    assert sorted((r.episode_index, r.camera, r.matched, r.warning) for r in scan.collect()) == [
        (0, "head_a", True, None), (1, "head_a", False, "episode 1: cannot decode head_a: bad stream"),
        (1, "zed_b", False, None), (2, "head_a", False, "episode 2: missing video location for head_a"), (2, "zed_b", False, None)]
    assert tuple(flicker.flicker_scan_summary(scan).first()) == ("d", 3, 1, 2)


def test_mark_bad_respects_grades(spark):
    matched = spark.createDataFrame([("d", 0), ("d", 1), ("d", 2)], "dataset_key string, episode_index long")
    eps = spark.createDataFrame([("d", 0, "Normal"), ("d", 1, "good"), ("d", 2, None)], "dataset_key string, episode_index long, grade string")
    out = {r.episode_index: r for r in flicker.flicker_mark_bad(matched, eps).collect()}
    assert out[0].grade == "bad" and out[0].skipped_reason is None
    assert out[1].skipped_reason == "grade good is not eligible" and out[2].skipped_reason == "grade None is not eligible"
