"""Mean luminance per tile of decoded frames, the one Arrow batch function.

Frames of one shape are one tensor: their bytes lie end to end in the batch, so they are reduced by array operations
over all frames at once. What is looped over is the shapes of a batch, which are few.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# fixed values: luminance weights of red, green, blue
RGB_WEIGHTS = (0.299, 0.587, 0.114)
TENSOR_BYTES = 32 << 20  # bytes of frames that are reduced at once


def tile_edges(size: int, tiles: int) -> np.ndarray:
    """Start of each tile plus the end, by integer division."""
    return np.arange(tiles + 1) * size // tiles


def stack_means(frames: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Mean per tile of each frame of a stack, gray (N, H, W) or colour (N, H, W, C>=3), as (N, rows, cols)."""
    if frames.ndim == 4:
        if frames.shape[3] < 3:
            raise ValueError("colour frames need three channels")
        frames = frames[..., :3].astype(np.float32) @ np.asarray(RGB_WEIGHTS, dtype=np.float32)
    elif frames.ndim != 3:
        raise ValueError("frames are gray or colour images")
    height, width = frames.shape[1:]
    if height < rows or width < cols:
        raise ValueError("frame is smaller than the tile grid")
    ys, xs = tile_edges(height, rows), tile_edges(width, cols)
    sums = np.add.reduceat(np.add.reduceat(frames, ys[:-1], axis=1, dtype=np.float64), xs[:-1], axis=2)
    return (sums / np.outer(np.diff(ys), np.diff(xs))).astype(np.float32)


def tile_means(frame: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Mean per tile, row by row, of one frame."""
    return stack_means(np.asarray(frame)[None], rows, cols)[0]


def _stacks(batch: pa.RecordBatch, rows: int, cols: int) -> Iterator[tuple[np.ndarray, np.ndarray | None, str | None]]:
    """Places of the frames of each shape with their means, or with what is wrong with them."""
    height, width, channels = (batch.column(n).fill_null(-1).cast(pa.int64()).to_numpy() for n in ("height", "width", "channels"))
    pixels = batch.column("pixels").cast(pa.large_binary())
    sizes = np.where(pixels.is_null().to_numpy(zero_copy_only=False), -1, np.diff(np.frombuffer(
        pixels.buffers()[1], np.int64)[pixels.offset:pixels.offset + len(pixels) + 1])) if len(pixels) else np.zeros(0, np.int64)
    shapes, which = np.unique(np.stack([height, width, channels, sizes], axis=1), axis=0, return_inverse=True)
    for k, (h, w, c, size) in enumerate(shapes.tolist()):
        at = np.flatnonzero(which.ravel() == k)
        if size < 0:
            yield at, None, "no pixels"
        elif min(h, w, c) < 1:
            yield at, None, "frames need a height, a width and channels"
        elif size != h * w * c:
            yield at, None, f"cannot reshape array of size {size} into shape {(h, w) if c == 1 else (h, w, c)}"
        else:
            step = max(1, TENSOR_BYTES // size)
            for begin in range(0, len(at), step):
                part = at[begin:begin + step]
                data = pixels.take(pa.array(part)).buffers()[2]
                stack = np.frombuffer(data, np.uint8, len(part) * size).reshape((len(part), h, w, *(() if c == 1 else (c,))))
                try:
                    yield part, stack_means(stack, rows, cols).reshape(len(part), -1), None
                except ValueError as problem:
                    yield part, None, str(problem)


def tile_luminance(
    frames: DataFrame, *, keys: Sequence[str], rows: int = 4, cols: int = 4
) -> DataFrame:
    """Tile rows ``(keys, tile, luminance)`` from frames with height, width, channels, pixels.

    ``pixels`` is the row-major uint8 image. A frame that cannot be used gives
    one row with ``tile`` -1 and the reason in ``error``, so the scan goes on.
    """
    key_types = ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in frames.schema if f.name in keys
    )
    chosen = frames.select(*keys, "height", "width", "channels", "pixels")
    names = [*keys, "tile", "luminance", "error"]
    tiles = rows * cols

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, means, error in _stacks(batch, rows, cols):
                many = 1 if means is None else tiles
                place = pa.array(np.repeat(at, many))
                key = [batch.column(k).take(place) for k in keys]
                n = len(at) * many
                tile = np.full(n, -1, np.int32) if means is None else np.tile(np.arange(tiles, dtype=np.int32), len(at))
                value = pa.nulls(n, pa.float32()) if means is None else pa.array(means.ravel(), pa.float32())
                yield pa.RecordBatch.from_arrays([*key, pa.array(tile), value, pa.array([error] * n, pa.string())], names=names)

    return chosen.mapInArrow(run, f"{key_types}, tile int, luminance float, error string")
