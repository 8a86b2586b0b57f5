"""Solid regions: holes filled and gaps closed in the masks of frames.

How many steps a fill takes depends on the picture, which column expressions can't follow; each frame is one row and
one small array, so this is an Arrow-batched function over rows, without a shuffle. Masks of one size are worked on together.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from floeline.session import reachable


def ellipse(size: int) -> list[int]:
    """Half widths of the rows of an elliptic kernel of odd `size`, from the middle row on."""
    half = size // 2
    return [round(half * (1 - (dy / half) ** 2) ** 0.5) if half else 0 for dy in range(half + 1)]


def _walked(reached: np.ndarray, free: np.ndarray) -> np.ndarray:
    """All free pixels of a row that are joined to a reached one within the row."""
    stops = ~free
    stops[..., 0] = True
    runs = np.cumsum(stops.ravel(), dtype=np.int32)
    hit = np.zeros(runs[-1] + 1, dtype=bool)
    hit[runs[reached.ravel()]] = True
    return hit[runs].reshape(free.shape) & free


def filled(regions: np.ndarray) -> np.ndarray:
    """The regions (the last two axes are rows and columns) with all that is not joined to the border over edges of pixels outside."""
    shape = regions.shape
    free = ~regions.reshape(-1, *shape[-2:])
    reached = np.zeros_like(free)
    for side in (np.s_[:, 0, :], np.s_[:, -1, :], np.s_[:, :, 0], np.s_[:, :, -1]):
        reached[side] = free[side]
    open_ = np.arange(len(free))  # pictures in which the last round still reached something
    while len(open_):
        outside, before = free[open_], reached[open_]
        now = _walked(before, outside)
        now = _walked(now.swapaxes(1, 2), outside.swapaxes(1, 2)).swapaxes(1, 2)
        reached[open_] = now
        open_ = open_[(now != before).any(axis=(1, 2))]
    return ~reached.reshape(shape)


def _spread(regions: np.ndarray, half_widths: list[int]) -> np.ndarray:
    """Every pixel from which the kernel meets the region."""
    h, w = regions.shape[-2:]
    sums = np.zeros((*regions.shape[:-1], w + 1), dtype=np.int32)
    np.cumsum(regions, axis=-1, out=sums[..., 1:])
    out = np.zeros_like(regions)
    at = np.arange(w)
    for dy, dx in enumerate(half_widths):
        wide = sums[..., np.minimum(at + dx + 1, w)] > sums[..., np.maximum(at - dx, 0)]
        for step in {dy, -dy}:
            if abs(step) < h:
                out[..., max(step, 0) : h + min(step, 0), :] |= wide[..., max(-step, 0) : h + min(-step, 0), :]
    return out


def closed(regions: np.ndarray, size: int) -> np.ndarray:
    """Widened by the kernel and narrowed again; what lies outside the frame neither adds nor takes away."""
    kernel = ellipse(size)
    return ~_spread(~_spread(regions, kernel), kernel)


#: Pixels that are worked on at once: many small masks, or one large one.
PIXELS = 2**18


def solid(codes: np.ndarray, width: int, classes: dict[int, int], blocked: int) -> np.ndarray:
    """Codes after each class was filled and closed by its kernel; blocked pixels stay, of two classes the first counts.

    One row of `codes` is one mask.
    """
    grids = codes.reshape(len(codes), -1, width)
    out = np.where(grids == blocked, blocked, 0)
    for code, size in classes.items():
        some = np.flatnonzero((grids == code).any(axis=(1, 2)))
        own = closed(filled(grids[some] == code), size)
        out[some] = np.where(own & (out[some] == 0), code, out[some])
    return out.reshape(codes.shape)


def solid_batch(masks: pa.ListArray, width: int, classes: dict[int, int], blocked: int) -> pa.ListArray:
    """Solid codes of a batch of masks: those of one length together, in pieces of PIXELS."""
    sizes = pc.fill_null(pc.list_value_length(masks), 0).to_numpy()
    codes = pc.fill_null(masks.flatten(), 0).to_numpy()
    ends = np.cumsum(sizes, dtype=np.int64)
    out = np.zeros(len(codes), dtype=np.int32)
    for length in np.unique(sizes[sizes > 0]).tolist():
        starts = (ends - sizes)[sizes == length]
        step = max(1, PIXELS // length)
        for first in range(0, len(starts), step):
            places = starts[first : first + step, None] + np.arange(length)
            out[places] = solid(codes[places], width, classes, blocked)
    offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(out), mask=masks.is_null() if masks.null_count else None)


def solid_mask(mask: Column, width: int, classes: dict[int, int], blocked: int) -> Column:
    """A row-major array of codes with solid regions; NULL and empty masks stay."""
    reachable()

    @F.arrow_udf("array<int>")
    def run(masks: pa.Array) -> pa.Array:
        return solid_batch(masks, width, classes, blocked)

    return run(mask)
