"""NumPy kernels for whole images, run in Arrow batches: filters, morphology, components, shifts.

Each takes arrays of one image (height x width, or x 3) and is used inside
``map_images``; nothing here keeps state between images.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# The level-1 high-pass filter of the db2 wavelet, and the quantile that turns a median into a deviation.
DB2_HIGH = np.array([-0.48296291314469025, 0.836516303737469, -0.22414386804185735, -0.12940952255092145])
NORMAL_QUARTILE = 0.6744897501960817


def to_uint8(x: np.ndarray) -> np.ndarray:
    """0..255, half to even; NaN is 0, infinities are the bounds; images in -0.1..1.5 are scaled first."""
    x = np.asarray(x)
    if x.dtype == np.uint8:
        return x
    decimal = np.issubdtype(x.dtype, np.floating)
    x = np.nan_to_num(x.astype(np.float64), nan=0.0, posinf=255.0, neginf=0.0)
    if decimal and x.size and x.min() >= -0.1 and x.max() <= 1.5:
        x = x * 255.0
    return np.rint(np.clip(x, 0, 255)).astype(np.uint8)


def to_rgb(image: np.ndarray) -> np.ndarray:
    """Three channels in RGB order from grey, BGR or BGRA bytes."""
    if image.ndim == 2 or image.shape[2] == 1:
        return np.repeat(image.reshape(*image.shape[:2], 1), 3, axis=2)
    return image[:, :, 2::-1]


def grey(rgb: np.ndarray) -> np.ndarray:
    return np.rint(rgb[..., 0] * 0.299 + rgb[..., 1] * 0.587 + rgb[..., 2] * 0.114).astype(np.uint8)


def hsv(rgb: np.ndarray) -> np.ndarray:
    """Hue 0..179, saturation and value 0..255."""
    c = rgb.astype(np.float64)
    v, low = c.max(-1), c.min(-1)
    d = v - low
    s = np.where(v > 0, 255 * d / np.where(v > 0, v, 1), 0)
    r, g, b = c[..., 0], c[..., 1], c[..., 2]
    safe = np.where(d > 0, d, 1)
    h = np.where(v == r, 60 * (g - b) / safe, np.where(v == g, 120 + 60 * (b - r) / safe, 240 + 60 * (r - g) / safe))
    h = np.where(d > 0, h, 0) % 360 / 2
    return np.stack([np.rint(h) % 180, np.rint(s), v], axis=-1).astype(np.uint8)


def hue_mask(hsv_image: np.ndarray, ranges, saturation: int = 60, value: int = 60) -> np.ndarray:
    h, s, v = (hsv_image[..., i] for i in range(3))
    hit = np.zeros(h.shape, dtype=bool)
    for low, high in ranges:
        hit |= (h >= low) & (h <= high)
    return hit & (s >= saturation) & (v >= value)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the covered area of each target pixel, along one axis after the other."""

    def weights(n: int, m: int) -> np.ndarray:
        edges = np.linspace(0, n, m + 1)
        low, high = np.arange(n), np.arange(1, n + 1)
        part = np.minimum(high, edges[1:, None]) - np.maximum(low, edges[:-1, None])
        return np.clip(part, 0, None) * m / n

    out = np.tensordot(weights(image.shape[0], height), image.astype(np.float64), axes=(1, 0))
    return np.moveaxis(np.tensordot(weights(image.shape[1], width), out, axes=(1, 1)), 0, 1)


def convolve_axis(x: np.ndarray, taps: np.ndarray, axis: int) -> np.ndarray:
    r = len(taps) // 2
    pad = [(0, 0)] * x.ndim
    pad[axis] = (r, r)
    p = np.pad(x, pad, mode="reflect") if x.shape[axis] > r else np.pad(x, pad, mode="symmetric" if x.shape[axis] > 1 else "edge")
    return sum(t * np.take(p, np.arange(i, i + x.shape[axis]), axis=axis) for i, t in enumerate(taps))


def gaussian(x: np.ndarray, sigma: float = 1.5) -> np.ndarray:
    """Separable blur; mirrored borders; as many taps as 4 sigma to each side take."""
    r = int(round(sigma * 8 + 1) | 1) // 2
    taps = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    taps /= taps.sum()
    return convolve_axis(convolve_axis(x.astype(np.float64), taps, 0), taps, 1)


def noise_sigma(x: np.ndarray) -> float:
    """Deviation of the noise from the diagonal details of one wavelet level."""

    def high(a: np.ndarray, axis: int) -> np.ndarray:
        pad = [(0, 0)] * a.ndim
        pad[axis] = (3, 3)
        p = np.pad(a, pad, mode="symmetric")
        n = (a.shape[axis] + 3) // 2
        return sum(t * np.take(p, 1 + 2 * np.arange(n) + 3 - i, axis=axis) for i, t in enumerate(DB2_HIGH))

    d = high(high(x.astype(np.float64), 0), 1).ravel()
    d = d[d != 0]
    return float(np.median(np.abs(d)) / NORMAL_QUARTILE) if d.size else 0.0


def ellipse(radius: int) -> np.ndarray:
    y = np.arange(-radius, radius + 1)
    half = np.rint(np.sqrt(radius * radius - y * y))
    return np.abs(y)[None, :] <= half[:, None]


def dilate(mask: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """True wherever the shape, centred there, meets the mask."""
    ry, rx = shape.shape[0] // 2, shape.shape[1] // 2
    p = np.pad(mask.astype(bool), ((ry, ry), (rx, rx)))
    out = np.zeros(mask.shape, dtype=bool)
    for dy, dx in np.argwhere(shape):
        out |= p[dy : dy + mask.shape[0], dx : dx + mask.shape[1]]
    return out


def erode(mask: np.ndarray, shape: np.ndarray) -> np.ndarray:
    return ~dilate(~mask.astype(bool), shape[::-1, ::-1])


def close(mask: np.ndarray, shape: np.ndarray) -> np.ndarray:
    return erode(dilate(mask, shape), shape)


def box_mean(x: np.ndarray, size: int) -> np.ndarray:
    """Mean of a square window with repeated borders, by cumulative sums."""
    r = size // 2
    p = np.pad(x.astype(np.float64), r, mode="edge")
    s = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return (s[size:, size:] - s[:-size, size:] - s[size:, :-size] + s[:-size, :-size]) / (size * size)


def components(mask: np.ndarray) -> np.ndarray:
    """Numbers from 1 of the 8-connected parts of a mask, 0 outside.

    Runs of each row are joined with those they touch in the row above.
    """
    h, w = mask.shape
    out = np.zeros((h, w), dtype=np.int64)
    if not mask.any():
        return out
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, first = np.nonzero(edge == 1)
    past = np.nonzero(edge == -1)[1]
    root = np.arange(len(rows))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    begin = np.searchsorted(rows, np.arange(h + 1))
    for y in range(1, h):
        i, j = begin[y - 1], begin[y]
        while i < begin[y] and j < begin[y + 1]:
            if first[i] <= past[j] and first[j] <= past[i]:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
            if past[i] < past[j]:
                i += 1
            else:
                j += 1
    roots = np.array([find(i) for i in range(len(rows))])
    number = np.unique(roots, return_inverse=True)[1] + 1
    for y, a, b, n in zip(rows, first, past, number, strict=True):
        out[y, a:b] = n
    return out


def drop_small(mask: np.ndarray, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """The parts of at least so many pixels, and their areas."""
    parts = components(mask)
    area = np.bincount(parts.ravel())
    area[0] = 0
    keep = area >= least
    return keep[parts] & mask.astype(bool), area[keep]


def canny(image: np.ndarray, low: float = 60, high: float = 160) -> np.ndarray:
    """Edges: Sobel gradients, thinned along their direction, kept where linked to a strong one."""
    x = image.astype(np.float64)
    p = np.pad(x, 1, mode="edge")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    m = np.abs(gx) + np.abs(gy)
    q = np.pad(m, 1)
    mid = lambda dy, dx: q[1 + dy : q.shape[0] - 1 + dy, 1 + dx : q.shape[1] - 1 + dx]
    slope = np.abs(gy) / np.where(gx == 0, 1e-12, np.abs(gx))
    flat, steep = slope < np.tan(np.pi / 8), slope > np.tan(3 * np.pi / 8)
    same = np.sign(gx) == np.sign(gy)
    a = np.where(flat, mid(0, -1), np.where(steep, mid(-1, 0), np.where(same, mid(-1, -1), mid(-1, 1))))
    b = np.where(flat, mid(0, 1), np.where(steep, mid(1, 0), np.where(same, mid(1, 1), mid(1, -1))))
    thin = (m > a) & (m >= b) & (m > low)
    parts = components(thin)
    strong = np.unique(parts[thin & (m > high)])
    return thin & np.isin(parts, strong[strong > 0])


def phase_shift(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """Shift from a to b (x, y) by phase correlation, to parts of a pixel, and the response of the peak."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    f = np.conj(np.fft.fft2(a)) * np.fft.fft2(b)
    c = np.fft.fftshift(np.real(np.fft.ifft2(f / np.maximum(np.abs(f), 1e-12))))
    y, x = np.unravel_index(np.argmax(c), c.shape)
    ys, xs = slice(max(0, y - 2), y + 3), slice(max(0, x - 2), x + 3)
    w = np.clip(c[ys, xs], 0, None)
    total = w.sum()
    if total <= 0:
        return 0.0, 0.0, 0.0
    cy = (w.sum(1) * np.arange(c.shape[0])[ys]).sum() / total
    cx = (w.sum(0) * np.arange(c.shape[1])[xs]).sum() / total
    return float(cx - c.shape[1] // 2), float(cy - c.shape[0] // 2), float(total)


def frame_metrics(rgb: np.ndarray) -> dict:
    """Quality figures of one frame: noise, signal to noise, unbiased kurtosis, intensity, contrast, sharpness, edges."""
    g = grey(rgb).astype(np.float64)
    smooth = gaussian(g)
    noise = (g - smooth).ravel()
    eps = np.finfo(float).eps
    n, d = noise.size, noise - noise.mean()
    m2 = (d**2).mean()
    kurtosis = ((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * ((d**4).mean() / m2**2 - 3) + 6)) if n > 3 and m2 > 0 else None
    p = np.pad(g, 1, mode="reflect") if min(g.shape) > 1 else np.pad(g, 1, mode="edge")
    lap = 2 * (p[:-2, :-2] + p[:-2, 2:] + p[2:, :-2] + p[2:, 2:]) - 8 * g
    return {
        "noise_sigma": noise_sigma(g), "snr_db": float(10 * np.log10(max((smooth**2).mean(), eps) / max((noise**2).mean(), eps))), "kurtosis": kurtosis,
        "intensity": float(g.mean()), "contrast": float(g.std()), "sharpness": float(lap.var()), "edge_density": float(canny(g).mean())}


METRICS = "noise_sigma double, snr_db double, kurtosis double, intensity double, contrast double, sharpness double, edge_density double"


def map_images(df: DataFrame, fn: Callable[[np.ndarray], dict], schema: str, key: str = "frame", image: str = "image") -> DataFrame:
    """Apply a kernel to each image (Spark's image struct); failures become the ``error`` text of their row.

    The binary data goes no further than the kernel: only its figures leave.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    kind = to_arrow_schema(StructType.fromDDL(f"{key} string, {schema}, error string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    if i is None:
                        raise ValueError("not a readable image")
                    data = np.frombuffer(i["data"], dtype=np.uint8).reshape(i["height"], i["width"], i["nChannels"])
                    rows.append({key: k, **fn(to_rgb(data)), "error": None})
                except Exception as e:
                    rows.append({key: k, **dict.fromkeys(names), "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return df.select(key, image).mapInArrow(run, f"{key} string, {schema}, error string")
