"""Motion between consecutive frames: phase shifts, and corners that are matched and fitted by a similarity.

Every frame is read once. What leaves it is a small grey image, or at most ``MOST``
corners of 40 bytes; that is saved once and meets the next frame's by a join on the
frame's number, so a video is spread over many tasks and images are never shuffled.

A frame without a next one gives no row. Missing or unreadable images give a row
with an error; images without corners (blank or very small ones) match nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framestride.operators import kernels
from framestride.operators.overlay import image_array
from framestride.storage import Scratch

# Corners of a frame, share of the second best distance, matches a fit needs, pixels of its error, bounds of what counts as geometry.
MOST, RATIO, LEAST, REACH, SCALES, COVERAGE = 2000, 0.75, 12, 3.0, (0.5, 2.0), 0.03
#: Fixed value: height that frames are reduced to before their shift is taken.
SHIFT_HEIGHT = 180
#: Levels, a quarter of an octave from one to the next, radius of a described patch, compared pairs of points, trials of a fit.
LEVELS, STEP, RADIUS, BITS, TRIALS, SEED = 7, 2**0.25, 12, 256, 600, 11

_rng = np.random.default_rng(SEED)
_angle, _away = _rng.uniform(0, 2 * np.pi, (2, BITS)), RADIUS * np.sqrt(_rng.uniform(0, 1, (2, BITS)))
#: Points that are compared, as places in the complex plane around a corner.
PAIRS = _away * np.exp(1j * _angle)
_y, _x = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
DISC = (_x + 1j * _y)[_x**2 + _y**2 <= RADIUS**2]


def equalized(g: np.ndarray) -> np.ndarray:
    """A grey image whose values are spread evenly; one of a single value stays."""
    n = np.cumsum(np.bincount(g.ravel(), minlength=256))
    low = n[n > 0][0]
    return g if n[-1] == low else np.rint((n - low) * 255 / (n[-1] - low)).clip(0, 255).astype(np.uint8)[g]


def corners(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners of one level, as places in the complex plane, and their strength: the smaller eigenvalue of the gradients' moments."""
    dy, dx = np.gradient(g)
    a, b, c = kernels.gaussian(dx * dx), kernels.gaussian(dy * dy), kernels.gaussian(dx * dy)
    strength = (a + b) / 2 - np.hypot((a - b) / 2, c)
    inner = strength[1:-1, 1:-1]
    near = np.lib.stride_tricks.sliding_window_view(strength, (3, 3)).max(axis=(2, 3))
    y, x = np.nonzero((inner == near) & (inner > max(1.0, 0.01 * strength.max())))
    y, x = y + 1, x + 1
    ok = (y > RADIUS) & (x > RADIUS) & (y < g.shape[0] - RADIUS - 1) & (x < g.shape[1] - RADIUS - 1)
    y, x = y[ok], x[ok]
    # the top of a parabola through the neighbours, along each axis
    def top(lo: np.ndarray, mid: np.ndarray, hi: np.ndarray) -> np.ndarray:
        bend = lo - 2 * mid + hi
        return np.where(bend < 0, (lo - hi) / np.where(bend < 0, 2 * bend, 1), 0.0).clip(-0.5, 0.5)

    s = strength
    return x + top(s[y, x - 1], s[y, x], s[y, x + 1]) + 1j * (y + top(s[y - 1, x], s[y, x], s[y + 1, x])), s[y, x]


def sampled(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values at places in the complex plane, between pixels by their distance; beyond the border that of the border."""
    x, y = at.real.clip(0, g.shape[1] - 1.001), at.imag.clip(0, g.shape[0] - 1.001)
    i, j = y.astype(int), x.astype(int)
    v, u = y - i, x - j
    return (g[i, j] * (1 - u) + g[i, j + 1] * u) * (1 - v) + (g[i + 1, j] * (1 - u) + g[i + 1, j + 1] * u) * v


def described(rgb: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """The strongest corners of all levels: places (complex64) and descriptors (rows of ``BITS`` bits)."""
    g = equalized(kernels.grey(rgb)).astype(np.float64)
    at, bits, power = [np.zeros(0, complex)], [np.zeros((0, BITS // 8), np.uint8)], [np.zeros(0)]
    for level in range(LEVELS):
        h, w = (round(n / STEP**level) for n in g.shape)
        if min(h, w) < 3 * RADIUS:
            break
        small = kernels.area_resize(g, h, w) if level else g
        z, s = corners(small)
        smooth = kernels.gaussian(small)
        # a patch points to where its weight lies, so turned images give the same bits
        turn = (sampled(smooth, z[:, None] + DISC) * DISC).sum(1)
        turn = np.where(np.abs(turn) > 0, turn / np.maximum(np.abs(turn), 1e-12), 1)
        one, two = (sampled(smooth, z[:, None] + turn[:, None] * p) for p in PAIRS)
        bits.append(np.packbits(one < two, axis=1))
        at.append(((z.real + 0.5) * g.shape[1] / w - 0.5) + 1j * ((z.imag + 0.5) * g.shape[0] / h - 0.5))
        power.append(s)
    z, d, s = np.concatenate(at), np.concatenate(bits), np.concatenate(power)
    best = np.lexsort((z.real, z.imag, -s))[:most]
    return z[best].astype(np.complex64), d[best]


def matches(a: np.ndarray, b: np.ndarray, ratio: float = RATIO) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and of ``b`` that match: the nearest by differing bits, clearly nearer than the second."""
    if len(a) == 0 or len(b) < 2:
        return np.zeros(0, int), np.zeros(0, int)
    one, two = (np.unpackbits(x, axis=1).astype(np.float32) * 2 - 1 for x in (a, b))
    apart = (BITS - one @ two.T) / 2
    nearest = apart.argmin(1)
    least = apart[np.arange(len(a)), nearest]
    apart[np.arange(len(a)), nearest] = np.inf
    i = np.nonzero(least < ratio * apart.min(1))[0]
    return i, nearest[i]


def similarity(a: np.ndarray, b: np.ndarray, reach: float = REACH) -> tuple[complex, complex, np.ndarray] | None:
    """``m, c, fits`` so that ``m * a + c`` is within ``reach`` of ``b`` for as many places as trials find; least squares over those."""
    rng = np.random.default_rng(SEED)
    i, j = rng.integers(0, len(a), (2, TRIALS))
    i, j = i[a[i] != a[j]], j[a[i] != a[j]]
    if not len(i):
        return None
    m = (b[j] - b[i]) / (a[j] - a[i])
    c = b[i] - m * a[i]
    fits = max((np.abs(p * a + q - b) <= reach for p, q in zip(m, c, strict=True)), key=np.count_nonzero)
    for _ in range(3):
        p, q = a[fits] - a[fits].mean(), b[fits] - b[fits].mean()
        size = (np.abs(p) ** 2).sum()
        if size == 0:
            return None
        m1 = (np.conj(p) * q).sum() / size
        c1 = b[fits].mean() - m1 * a[fits].mean()
        wider = np.abs(m1 * a + c1 - b) <= reach
        if not wider.any():
            break
        fits = wider
    return complex(m1), complex(c1), fits


def geometry(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], height: int, width: int) -> dict:
    """Matches of two frames' corners and the similarity that carries the first to the second."""
    i, j = matches(a[1], b[1])
    out = {"matches": len(i), "inliers": 0.0, "coverage": 0.0, "scale": None, "angle": None, "dx": None, "dy": None}
    if len(i) < LEAST:
        return out
    p, q = a[0][i].astype(complex), b[0][j].astype(complex)
    found = similarity(p, q)
    if found is None:
        return out
    m, c, fits = found
    box = [int(np.floor(v.max()) - np.floor(v.min())) + 1 for v in (p.real, p.imag)]
    centre = (width - 1) / 2 + 1j * (height - 1) / 2
    moved = m * centre + c - centre
    return out | {"inliers": float(fits.mean()), "coverage": box[0] * box[1] / (height * width), "scale": abs(m), "angle": float(np.degrees(np.angle(m))), "dx": moved.real, "dy": moved.imag}


def following(frames: DataFrame, key: str = "video", index: str = "idx") -> DataFrame:
    """Each frame beside the next one of its video, whose columns are called ``next_...``; what was made of the images is saved first."""
    frames = Scratch(frames.sparkSession, "following").save(frames)
    rest = [c for c in frames.columns if c not in (key, index)]
    after = frames.select(key, (F.col(index) - 1).alias(index), *[F.col(c).alias(f"next_{c}") for c in rest])
    return frames.join(after, [key, index])


SEEN = "video string, idx long, height int, width int, places binary, bits binary, error string"
MOVED = "video string, idx long, matches long, inliers double, coverage double, scale double, angle double, dx double, dy double, error string"


def frame_corners(frames: DataFrame) -> DataFrame:
    """``SEEN`` for each of ``video, idx, image``."""
    def one(image: dict | None) -> dict:
        try:
            if image is None:
                raise ValueError("not a readable image")
            rgb = image_array(image)
            places, bits = described(rgb)
            return {"height": rgb.shape[0], "width": rgb.shape[1], "places": places.tobytes(), "bits": bits.tobytes(), "error": None}
        except Exception as e:
            return {"error": f"{type(e).__name__}: {e}"}

    return _mapped(frames.select(F.col("video").cast("string"), F.col("idx").cast("long"), "image"), SEEN, lambda r: one(r["image"]))


def geometry_changes(corners_of: DataFrame) -> DataFrame:
    """``MOVED`` for each frame and the next, from ``SEEN``: ungated figures, ``gated`` keeps what counts as geometry."""
    def one(r: dict) -> dict:
        bad = r["error"] or r["next_error"]
        if bad:
            return {"error": bad}
        sides = [(np.frombuffer(r[f"{s}places"], np.complex64), np.frombuffer(r[f"{s}bits"], np.uint8).reshape(-1, BITS // 8)) for s in ("", "next_")]
        return geometry(*sides, r["height"], r["width"])

    return _mapped(following(corners_of), MOVED, one)


def gated(moved: DataFrame) -> DataFrame:
    """Figures of a fit only where the scale is plausible and the matches cover enough of the frame; otherwise none."""
    ok = F.col("scale").between(*SCALES) & (F.col("coverage") >= COVERAGE) & (F.col("matches") >= LEAST)
    return moved.withColumns({"matches": F.when(ok, F.col("matches")).otherwise(F.lit(0).cast("long")), "inliers": F.when(ok, F.col("inliers")).otherwise(0.0)} | {c: F.when(ok, F.col(c)) for c in ("scale", "angle", "dx", "dy")})


SMALL = "video string, idx long, height int, width int, grey binary, error string"


def small_frames(frames: DataFrame, height: int = SHIFT_HEIGHT) -> DataFrame:
    """``SMALL``: grey images (float32) of one height, from ``video, idx, image``; lower ones stay as they are."""
    def one(r: dict) -> dict:
        try:
            if r["image"] is None:
                raise ValueError("not a readable image")
            g = kernels.grey(image_array(r["image"])).astype(np.float64)
            if g.shape[0] > height:
                g = kernels.area_resize(g, height, max(1, round(g.shape[1] * height / g.shape[0])))
            return {"height": g.shape[0], "width": g.shape[1], "grey": g.astype("<f4").tobytes(), "error": None}
        except Exception as e:
            return {"error": f"{type(e).__name__}: {e}"}

    return _mapped(frames.select(F.col("video").cast("string"), F.col("idx").cast("long"), "image"), SMALL, one)


SHIFT = "video string, idx long, difference double, dx double, dy double, movement double, response double, error string"


def phase_shifts(small: DataFrame) -> DataFrame:
    """``SHIFT`` for each frame and the next, from ``SMALL``; two sizes are an error of the row."""
    def one(r: dict) -> dict:
        bad = r["error"] or r["next_error"]
        if not bad and (r["height"], r["width"]) != (r["next_height"], r["next_width"]):
            bad = "two sizes"
        if bad:
            return {"error": bad}
        a, b = (np.frombuffer(r[c], "<f4").reshape(r["height"], r["width"]).astype(np.float64) for c in ("grey", "next_grey"))
        dx, dy, response = kernels.phase_shift(a, b)
        return {"difference": float(np.abs(a - b).mean()), "dx": dx, "dy": dy, "movement": float(np.hypot(dx, dy)), "response": response}

    return _mapped(following(small), SHIFT, one)


def _mapped(df: DataFrame, schema: str, fn) -> DataFrame:
    """``video, idx`` and what ``fn`` makes of each row; columns it leaves out are null."""
    kind = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 64):
                rows = [{"video": r["video"], "idx": r["idx"], **fn(r)} for r in b.slice(start, 64).to_pylist()]
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in kind.names} for r in rows], schema=kind)

    return df.mapInArrow(run, schema)
