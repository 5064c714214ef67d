"""Tile-local numeric kernels (numpy only), and the ways to run them: the pixels of a raster or of a tile in, rows out."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_raster(pixels: DataFrame, kernel, schema: str) -> DataFrame:
    """kernel(raster_id, image) -> DataFrame of the schema, for each raster (raster_id, y, x, value)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return kernel(int(pdf["raster_id"].iloc[0]), image_of(pdf))

    return pixels.groupBy("raster_id").applyInPandas(run, schema)


def per_tile(pixels: DataFrame, size: int, halo: int, kernel, schema: str, values: tuple[str, ...] = ("value",)) -> DataFrame:
    """kernel(raster_id, row, column, own, *images) for each tile of size x size pixels with ``halo`` pixels around it.

    row and column are the place of the images' first pixel; own are the slices of the tile inside its halo; there is
    an image of each of the values.  A pixel goes to every tile whose halo it lies in, so no task holds more than one tile.
    """
    def tiles(axis: str):
        at = lambda shift: F.greatest(F.lit(0), F.expr(f"({axis} + {shift} - pmod({axis} + {shift}, {size})) div {size}"))
        return F.sequence(at(-halo).cast("int"), at(halo).cast("int"))

    dealt = pixels.select("raster_id", "y", "x", *values).withColumn("ty", F.explode(tiles("y"))).withColumn("tx", F.explode(tiles("x")))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        raster, ty, tx = (int(k) for k in key)
        y, x = int(pdf["y"].min()), int(pdf["x"].min())
        if y + len(pdf["y"].unique()) <= ty * size or x + len(pdf["x"].unique()) <= tx * size:  # only the halo of a tile beyond the border
            return pd.DataFrame({c.split(" ")[0]: pd.Series(dtype=object) for c in schema.split(", ")})
        at = {"y": pdf["y"] - y, "x": pdf["x"] - x}
        images = [image_of(pdf.assign(**at, value=pdf[v])) for v in values]
        h, w = images[0].shape
        own = (slice(ty * size - y, min(h, ty * size - y + size)), slice(tx * size - x, min(w, tx * size - x + size)))
        return kernel(raster, y, x, own, *images)

    return dealt.groupBy("raster_id", "ty", "tx").applyInPandas(run, schema)


def image_of(pdf: pd.DataFrame) -> np.ndarray:
    """Dense image of a raster's pixels; what is missing is the median."""
    image = np.full((pdf["y"].max() + 1, pdf["x"].max() + 1), np.nan)
    image[pdf["y"], pdf["x"]] = pdf["value"]
    return np.where(np.isnan(image), np.nanmedian(image) if np.isfinite(image).any() else 0.0, image)


def mirrored(image: np.ndarray, r: int) -> np.ndarray:
    """With r pixels around it that mirror the image without repeating its edge."""
    for axis in (0, 1):
        n = image.shape[axis]
        at = np.abs(np.arange(-r, n + r)) % max(1, 2 * n - 2)
        image = np.take(image, np.where(at >= n, 2 * n - 2 - at, at) if n > 1 else np.zeros(n + 2 * r, int), axis)
    return image


@functools.lru_cache(maxsize=64)
def _mixing(n: int, k: tuple[float, ...]) -> np.ndarray:
    """What each place of a mirrored line of n takes from each other one under a kernel, as a matrix."""
    r = len(k) // 2
    at = np.abs(np.arange(n)[:, None] + np.arange(-r, r + 1)) % max(1, 2 * n - 2)
    out = np.zeros((n, n))
    np.add.at(out, (np.arange(n)[:, None], np.where(at >= n, 2 * n - 2 - at, at) if n > 1 else 0 * at), np.array(k))
    return out


def convolved(image: np.ndarray, k: np.ndarray) -> np.ndarray:
    """A symmetric kernel along rows and columns, borders mirrored."""
    r = len(k) // 2
    if r > 8:
        k = tuple(k.tolist())
        return _mixing(image.shape[0], k) @ image @ _mixing(image.shape[1], k).T
    wide = mirrored(image, r)
    rows = sum(w * wide[:, i:i + image.shape[1]] for i, w in enumerate(k))
    return sum(w * rows[i:i + image.shape[0]] for i, w in enumerate(k))


def gaussian_kernel(sigma: float) -> np.ndarray:
    """2 * ceil(2 sigma) + 1 weights."""
    r = int(np.ceil(2 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return k / k.sum()


def gaussian(image: np.ndarray, sigma: float) -> np.ndarray:
    return convolved(image, gaussian_kernel(sigma))


def stretched(image: np.ndarray, low: float, high: float) -> np.ndarray:
    """To [0, 1] between two percentiles, or between the extremes where these are equal."""
    a, b = np.percentile(image, [low, high])
    if b <= a:
        a, b = image.min(), image.max()
    return np.clip((image - a) / (b - a), 0, 1) if b > a else np.zeros_like(image)


def retinex(image: np.ndarray, sigmas: tuple[float, ...] = (15.0, 80.0, 250.0)) -> np.ndarray:
    """Mean over scales of log image minus log surround, stretched from its 2nd to its 98th percentile."""
    base = np.maximum(image, 1e-4)
    return stretched(np.mean([np.log(base) - np.log(np.maximum(gaussian(base, s), 1e-4)) for s in sigmas], 0), 2, 98)


def equalised(image: np.ndarray, tiles: int = 8, clip: float = 2.5, bins: int = 256) -> np.ndarray:
    """Contrast-limited histogram equalisation of values in [0, 1] on ``bins`` levels, tile mappings blended bilinearly.

    The image is mirrored up to a multiple of the tiles; what a histogram has above its limit is dealt out evenly.
    """
    h, w = image.shape
    level = (np.clip(image, 0, 1) * (bins - 1)).astype(int)
    th, tw = -(-h // tiles), -(-w // tiles)
    wide = mirrored(level, max(th * tiles - h, tw * tiles - w))
    edge = (wide.shape[0] - h) // 2
    wide = wide[edge:edge + th * tiles, edge:edge + tw * tiles]
    limit, area = max(1, int(clip * th * tw / bins)), th * tw
    maps = np.empty((tiles, tiles, bins))
    for i in range(tiles):
        for j in range(tiles):
            hist = np.bincount(wide[i * th:(i + 1) * th, j * tw:(j + 1) * tw].ravel(), minlength=bins)
            over = int(np.maximum(hist - limit, 0).sum())
            hist = np.minimum(hist, limit) + over // bins
            if rest := over % bins:
                step = max(1, bins // rest)
                hist[np.arange(0, bins, step)[:rest]] += 1
            maps[i, j] = np.clip(np.rint(np.cumsum(hist) * (bins - 1) / area), 0, bins - 1)
    fy, fx = np.arange(h) / th - 0.5, np.arange(w) / tw - 0.5
    y0, x0 = np.floor(fy).astype(int), np.floor(fx).astype(int)
    wy, wx = (fy - y0)[:, None], (fx - x0)[None]
    at = lambda a, b: maps[np.clip(a, 0, tiles - 1)[:, None], np.clip(b, 0, tiles - 1)[None], level]
    out = (1 - wy) * ((1 - wx) * at(y0, x0) + wx * at(y0, x0 + 1)) + wy * ((1 - wx) * at(y0 + 1, x0) + wx * at(y0 + 1, x0 + 1))
    return np.rint(out) / (bins - 1)


def enhanced(image: np.ndarray, blend: float = 0.5) -> np.ndarray:
    r = retinex(image)
    return np.clip(blend * equalised(r) + (1 - blend) * r, 0, 1)


def log_gabor(shape: tuple[int, int], scales: int = 4, orients: int = 6, least: float = 3.0, mult: float = 2.1, sigma: float = 0.55, spread: float = 1.2) -> np.ndarray:
    """Filter bank (scale, orientation, h, w) in the frequency domain, nothing at frequency zero."""
    fy, fx = ((np.arange(n) - n // 2) / n for n in shape)
    fy, fx = np.fft.ifftshift(fy)[:, None], np.fft.ifftshift(fx)[None]
    radius, theta = np.hypot(fy, fx), np.arctan2(-fy, fx)
    radius[0, 0] = 1.0
    radial = np.exp(-np.log(radius * (least * mult ** np.arange(scales))[:, None, None]) ** 2 / (2 * np.log(sigma) ** 2))
    radial[:, 0, 0] = 0
    turn = theta - (np.arange(orients) * np.pi / orients)[:, None, None]
    away = np.abs(np.arctan2(np.sin(turn), np.cos(turn)))
    return radial[:, None] * np.exp(-away**2 / (2 * (np.pi / orients / spread) ** 2))[None]


def phase_congruency(image: np.ndarray, scales: int = 4, orients: int = 6):
    """Phase congruency, maximum and minimum moment (each scaled to [0, 1]) and the index of the orientation of most energy.

    An orientation's energy is the length of its responses' sum over the scales.
    """
    image = stretched(image, 2, 98)
    response = np.fft.ifft2(np.fft.fft2(image) * log_gabor(image.shape, scales, orients))
    by_orient = response.sum(0)
    energy = np.abs(by_orient)
    pc = np.clip(np.abs(by_orient.sum(0)) / (np.abs(response).sum((0, 1)) + 1e-5), 0, 1)
    angle = (np.arange(orients) * np.pi / orients)[:, None, None]
    c, s = energy * np.cos(angle), energy * np.sin(angle)
    xx, yy, xy = ((t.sum(0) * 2 / orients) for t in (c * c, s * s, 2 * c * s))
    root = np.hypot(xx - yy, xy)
    scaled = lambda m: (m - m.min()) / (m.max() - m.min() + 1e-6)
    return pc, scaled((xx + yy + root) / 2), scaled((xx + yy - root) / 2), energy.argmax(0)


def mim_descriptor(mim: np.ndarray, y: int, x: int, cells: int = 4, patch: int = 48, orients: int = 6) -> np.ndarray | None:
    """Histograms of orientation indices over cells x cells cells of a patch: unit length, clipped, unit length again.

    None where the patch leaves the image.
    """
    half, size = patch // 2, max(2, patch // cells)
    if y < half or x < half or y + half >= mim.shape[0] or x + half >= mim.shape[1]:
        return None
    own = mim[y - half:y + half, x - half:x + half][:cells * size, :cells * size]
    cell = (np.arange(own.shape[0]) // size)[:, None] * cells + np.arange(own.shape[1]) // size
    out = np.bincount((cell * orients + own).ravel(), minlength=cells * cells * orients).astype(float)
    out = np.minimum(out / (np.linalg.norm(out) + 1e-7), 0.2)
    return out / (np.linalg.norm(out) + 1e-7)


def corners(image: np.ndarray, most: int = 1500, quality: float = 0.02, apart: float = 6.0, block: int = 5) -> list[tuple[int, int]]:
    """Local maxima of the structure tensor's smaller eigenvalue, strongest first, ``apart`` from any stronger one."""
    level = np.rint(stretched(image, 0, 100) * 255)
    wide = mirrored(level, 1)
    smooth = lambda a, axis: sum(w * np.take(a, range(i, i + a.shape[axis] - 2), axis) for i, w in enumerate((1, 2, 1)))
    slope = lambda a, axis: np.take(a, range(2, a.shape[axis]), axis) - np.take(a, range(a.shape[axis] - 2), axis)
    gx, gy = slope(smooth(wide, 0), 1), slope(smooth(wide, 1), 0)
    a, b, c = (convolved(t, np.ones(block)) for t in (gx * gx, gx * gy, gy * gy))
    score = (a + c) / 2 - np.sqrt(((a - c) / 2) ** 2 + b * b)
    top = sliding_window_view(np.pad(score, 1, constant_values=-np.inf), (3, 3)).max((2, 3))
    ok = (score == top) & (score > quality * score.max()) & (score > 0)
    ok[[0, -1]] = False
    ok[:, [0, -1]] = False
    r = int(np.ceil(apart))
    disc = np.hypot(*np.mgrid[-r:r + 1, -r:r + 1]) < apart
    free, out = np.ones((image.shape[0] + 2 * r, image.shape[1] + 2 * r), bool), []
    at = np.flatnonzero(ok)
    for i in at[np.argsort(-score.ravel()[at], kind="stable")].tolist():
        y, x = divmod(i, image.shape[1])
        if free[y + r, x + r]:
            out.append((y, x))
            if len(out) >= most:
                break
            free[y:y + 2 * r + 1, x:x + 2 * r + 1] &= ~disc
    return out


def hann(shape: tuple[int, int]) -> np.ndarray:
    return np.outer(*(np.hanning(n) if n > 1 else np.ones(1) for n in shape))


def _fast_size(n: int) -> int:
    """The next number without a prime factor above 5."""
    while True:
        m = n
        for p in (2, 3, 5):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += 1


def phase_shift(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """(dx, dy, response) by which b is moved against a: the centroid of 5 x 5 places around the peak of their phase correlation."""
    shape = tuple(_fast_size(n) for n in a.shape)
    cross = np.fft.fft2(a, shape) * np.conj(np.fft.fft2(b, shape))
    length = np.abs(cross)
    surface = np.fft.fftshift(np.fft.ifft2(np.divide(cross, length, out=np.zeros_like(cross), where=length > 1e-12)).real)
    py, px = np.unravel_index(surface.argmax(), shape)
    ys, xs = (np.arange(max(0, p - 2), min(n, p + 3)) for p, n in ((py, shape[0]), (px, shape[1])))
    part = surface[np.ix_(ys, xs)]
    total = part.sum()
    if abs(total) < 1e-12:
        return 0.0, 0.0, 0.0
    return float(shape[1] // 2 - (part.sum(0) * xs).sum() / total), float(shape[0] // 2 - (part.sum(1) * ys).sum() / total), float(total)


def translation(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """phase_shift() of the part that both shapes have, under a Hann window."""
    h, w = min(a.shape[0], b.shape[0]), min(a.shape[1], b.shape[1])
    return phase_shift(a[:h, :w] * hann((h, w)), b[:h, :w] * hann((h, w)))


def sampled(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear values at the places (x, y); nothing lies outside the image."""
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    out = np.zeros(x.shape)
    for j, wy in ((0, y0 + 1 - y), (1, y - y0)):
        for i, wx in ((0, x0 + 1 - x), (1, x - x0)):
            inside = (x0 + i >= 0) & (x0 + i < image.shape[1]) & (y0 + j >= 0) & (y0 + j < image.shape[0])
            out += np.where(inside, wx * wy * image[np.clip(y0 + j, 0, image.shape[0] - 1), np.clip(x0 + i, 0, image.shape[1] - 1)], 0)
    return out


def resized(image: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Bilinear, pixel centres on pixel centres."""
    at = lambda n, m: np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
    y, x = np.meshgrid(at(shape[0], image.shape[0]), at(shape[1], image.shape[1]), indexing="ij")
    return sampled(image, x, y)


def turned(image: np.ndarray, degrees: float, scale: float) -> np.ndarray:
    """The image turned about its middle (positive: counter-clockwise) and scaled."""
    h, w = image.shape
    c, s = scale * np.cos(np.radians(degrees)), scale * np.sin(np.radians(degrees))
    y, x = np.mgrid[:h, :w]
    u, v = x - w / 2, y - h / 2
    d = c * c + s * s
    return sampled(image, (c * u - s * v) / d + w / 2, (s * u + c * v) / d + h / 2)


def log_polar(image: np.ndarray) -> np.ndarray:
    """Log-polar samples (angle down, log radius across) of the windowed, centred, scaled log spectrum."""
    h, w = image.shape
    mag = np.log1p(np.abs(np.fft.fftshift(np.fft.fft2(image * hann(image.shape)))))
    mag = (mag - mag.min()) / max(mag.max() - mag.min(), 1e-12)
    r = np.exp(np.arange(w) * np.log(max(min(h, w) / 2, 1 + 1e-6)) / w)[None]
    t = (np.arange(h) * 2 * np.pi / h)[:, None]
    return sampled(mag, r * np.cos(t) + w / 2, r * np.sin(t) + h / 2)


def similarity(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float, float, float]:
    """(rotation in degrees, scale, dx, dy, response) of b against a.

    Rotation and scale are the shift of the log-polar spectra; which of two opposite rotations holds, and the
    translation, come from phase correlation of a with b turned back.
    """
    h, w = a.shape
    b = b if b.shape == a.shape else resized(b, a.shape)
    d_radius, d_angle, response = phase_shift(log_polar(a), log_polar(b))
    wrap = lambda t: (t + 180.0) % 360.0 - 180.0
    # a spectrum turns with its image, against the direction in which rows count angles, and shrinks as it grows
    angle = wrap(-d_angle / h * 360.0)
    scale = float(np.exp(-d_radius * np.log(min(w, h) / 2 + 1e-6) / w))
    best = None
    for t in (angle, wrap(angle + 180.0)):
        dx, dy, sure = phase_shift(a, turned(b, -t, 1 / (scale + 1e-6)))
        if best is None or sure > best[3]:
            best = (t, dx, dy, sure)
    return best[0], scale, best[1], best[2], response * best[3]


def ncc_surface(ref: np.ndarray, target: np.ndarray, y: int, x: int, ty: int | None = None, tx: int | None = None, half: int = 8, reach: int = 2) -> np.ndarray | None:
    """Normalised cross-correlation of the patch at (y, x) of ref with those of target around (ty, tx), for moves up to reach.

    None where a patch leaves its image or the first one is flat; a flat patch of target gives 0.
    """
    ty, tx = y if ty is None else ty, x if tx is None else tx
    for (p, q), n, r in (((y, x), ref.shape, half), ((ty, tx), target.shape, half + reach)):
        if p < r or q < r or p + r >= n[0] or q + r >= n[1]:
            return None
    a = ref[y - half:y + half + 1, x - half:x + half + 1]
    if a.std() < 1e-4:
        return None
    a = (a - a.mean()) / a.std()
    r = half + reach
    b = sliding_window_view(target[ty - r:ty + r + 1, tx - r:tx + r + 1], a.shape)
    mean, std = b.mean((2, 3)), b.std((2, 3))
    flat = std < 1e-4
    return np.where(flat, 0.0, ((b * a).mean((2, 3)) - mean * a.mean()) / np.where(flat, 1.0, std))


def paraboloid(s: np.ndarray) -> tuple[float, float, float] | None:
    """(dx, dy, peak) of the second-order surface through 3 x 3 values by finite differences; None without a maximum within a pixel."""
    gx, gy = (s[1, 2] - s[1, 0]) / 2, (s[2, 1] - s[0, 1]) / 2
    xx, yy = s[1, 2] - 2 * s[1, 1] + s[1, 0], s[2, 1] - 2 * s[1, 1] + s[0, 1]
    xy = (s[2, 2] - s[2, 0] - s[0, 2] + s[0, 0]) / 4
    det = xx * yy - xy * xy
    if det <= 1e-9 or xx >= 0 or yy >= 0:
        return None
    dx, dy = -(yy * gx - xy * gy) / det, -(xx * gy - xy * gx) / det
    return (dx, dy, s[1, 1] + (gx * dx + gy * dy) / 2) if max(abs(dx), abs(dy)) <= 1 else None
