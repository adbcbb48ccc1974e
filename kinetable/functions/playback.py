"""Where a video starts, ends and may be played."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOUNDARY_EPSILON = 0.002
FRAME_EPSILON = 1e-4


def finite(value: Column) -> Column:
    """The value, or NULL when it is not a finite number."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def window_start(from_ts: Column) -> Column:
    v = from_ts.cast("double")
    return F.coalesce(F.when(~F.isnan(v), v), F.lit(0.0))


def window_end(from_ts: Column, to_ts: Column) -> Column:
    """End of an episode's window; NULL when missing, NaN or not after the start."""
    v = to_ts.cast("double")
    return F.when(~F.isnan(v) & (v > window_start(from_ts)), v)


def boundary(start: Column, end: Column, frames: Column, fps: Column, duration: Column) -> Column:
    """Explicit end, else start + frames / fps, else the duration; each only if it makes sense."""
    s = F.coalesce(finite(start), F.lit(0.0))
    by_frames = F.when((finite(frames) > 0) & (finite(fps) > 0), s + finite(frames) / finite(fps))
    return F.coalesce(
        F.when(finite(end) > s, finite(end)), by_frames, F.when(finite(duration) > s, finite(duration))
    )


def playable_end(start: Column, bound: Column, fps: Column) -> Column:
    """One frame before the boundary, never before the start."""
    s = F.coalesce(finite(start), F.lit(0.0))
    f = finite(fps)
    one_back = F.greatest(s, bound - F.lit(1.0) / f)
    return F.when(bound.isNull(), None).when(f > 0, one_back).otherwise(bound)


def clamp_time(time: Column, start: Column, last: Column) -> Column:
    s = F.coalesce(finite(start), F.lit(0.0))
    t = F.coalesce(finite(time), s)
    return F.greatest(s, F.least(t, F.coalesce(last, t)))


def crossed(time: Column, bound: Column) -> Column:
    return F.coalesce(finite(time) >= bound - F.lit(BOUNDARY_EPSILON), F.lit(False))


def frame_at(time: Column, start: Column, fps: Column, epsilon: float = FRAME_EPSILON) -> Column:
    return F.greatest(F.lit(0), F.floor((time - start) * fps + F.lit(epsilon))).cast("bigint")


def camera_label(camera: Column) -> Column:
    return F.replace(
        F.replace(camera, F.lit("observation.images."), F.lit("")),
        F.lit("observation.image."), F.lit(""),
    )


def video_path(camera: Column, chunk: Column, file: Column) -> Column:
    return F.format_string("videos/%s/chunk-%03d/file-%03d.mp4", camera, chunk, file)
