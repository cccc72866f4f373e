"""Raster measurement and filters.

A raster row is one image, or one band of it: ``(image_id, height, width, channels,
px)`` with ``px`` the samples in scan order, channels interleaved. ``positions`` turns a
row into one row per sample while keeping the array at hand, so a neighbour is an array
read inside the same generated code: small filters need no join, no shuffle and no Python.
Wide means and medians run over whole bands in Arrow batches, map side, where shifted
copies of the array do the work. A very large image is cut into bands with a halo
(``to_bands``) and spread over tasks.

Statistics come from 256-bin histograms, which are combined per partition before the
shuffle: at most 256 rows per image, channel and task cross the network.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vellumine.functions.bands import half_even, percent
from vellumine.functions.once import compute_once

BINS = 256

# Border handling. The default mirrors without repeating the edge;
# medians and local thresholds repeat the edge sample.
MIRROR, REPLICATE = "mirror", "replicate"

# Kernels as (dy, dx, weight).
SHARPEN = [(-1, 0, -1), (0, -1, -1), (0, 0, 5), (0, 1, -1), (1, 0, -1)]
LAPLACE = [(-1, 0, 1), (0, -1, 1), (0, 0, -4), (0, 1, 1), (1, 0, 1)]
SOBEL_X = [(-1, -1, -1), (-1, 1, 1), (0, -1, -2), (0, 1, 2), (1, -1, -1), (1, 1, 1)]
SOBEL_Y = [(-1, -1, -1), (-1, 0, -2), (-1, 1, -1), (1, -1, 1), (1, 0, 2), (1, 1, 1)]
# Small Gaussian kernels.
SMALL_GAUSSIAN = {
    1: [1.0],
    3: [0.25, 0.5, 0.25],
    5: [0.0625, 0.25, 0.375, 0.25, 0.0625],
    7: [0.03125, 0.109375, 0.21875, 0.28125, 0.21875, 0.109375, 0.03125],
}
# Weights of red, green and blue in gray.
GRAY_WEIGHTS = (0.299, 0.587, 0.114)


# --- pixel relation ----------------------------------------------------------
def with_band(raster: DataFrame) -> DataFrame:
    """Make the band columns explicit: an uncut image is one band of all its lines."""
    if "y_first" in raster.columns:
        return raster
    return raster.withColumns({"y_first": F.lit(0), "own_from": F.lit(0), "own_to": F.col("height") - 1})


def to_bands(raster: DataFrame, lines: int = 512, halo: int = 8) -> DataFrame:
    """Cut images into bands of ``lines`` with ``halo`` extra lines on both sides.

    The cut is an array slice inside the image's row; the bands are then spread
    evenly, so one huge image no longer occupies one task.
    """
    n = F.expr(f"CAST(ceil(height / {lines}D) AS INT)")
    cut = raster.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("_b"))
    return cut.selectExpr(
        *[c for c in raster.columns if c != "px"],
        f"greatest(0, _b * {lines} - {halo}) AS y_first", f"_b * {lines} AS own_from",
        f"least(height - 1, (_b + 1) * {lines} - 1) AS own_to",
        f"slice(px, greatest(0, _b * {lines} - {halo}) * width * size(channels) + 1, "
        f"(least(height, (_b + 1) * {lines} + {halo}) - greatest(0, _b * {lines} - {halo})) * width * size(channels)) AS px",
    ).repartition("image_id", "own_from")


def reaching(raster: DataFrame, lines: int) -> DataFrame:
    """``raster`` with its bands made explicit; a band whose halo is under ``lines`` raises.

    A filter that reads ``lines`` beyond its sample would otherwise meet the end of a band.
    """
    if not lines or "y_first" not in raster.columns:
        return with_band(raster)
    held = "(y_first + size(px) DIV (width * size(channels)))"
    enough = f"(y_first = 0 OR own_from - y_first >= {lines}) AND ({held} >= height OR {held} - 1 - own_to >= {lines})"
    return raster.withColumn("px", F.expr(f"CASE WHEN {enough} THEN px ELSE CAST(raise_error('the filter reaches {lines} lines; cut the bands with that halo') AS ARRAY<SMALLINT>) END"))


def positions(raster: DataFrame, reach: int = 0) -> DataFrame:
    """One row per sample a band owns: image_id, y, x, k (channel index), ch, v.

    ``px`` and the geometry stay available for neighbour reads; select them away. The
    outer generator keeps the optimizer from deriving a not-empty filter on ``px`` and
    pushing its whole computation below the scan; the line filter drops the null row of
    an empty image. ``reach`` is the number of lines that neighbour reads go beyond.
    """
    r = reaching(raster, reach)
    flat = r.select("image_id", "height", "width", "channels", "y_first", "own_from", "own_to", "px",
                    F.size("channels").alias("nc"), F.posexplode_outer("px").alias("i", "v"))
    out = flat.selectExpr(
        "image_id", "height", "width", "channels", "nc", "y_first", "own_from", "own_to", "px", "CAST(v AS INT) AS v",
        "CAST(i % nc AS INT) AS k", "CAST((i DIV nc) % width AS INT) AS x",
        "CAST(y_first + i DIV (nc * width) AS INT) AS y")
    return out.where("y BETWEEN own_from AND own_to").withColumn("ch", F.get("channels", F.col("k")))


def pixels(raster: DataFrame) -> DataFrame:
    """The pixel relation (image_id, y, x, ch, v)."""
    return positions(raster).select("image_id", "y", "x", "ch", "v")


def from_pixels(px: DataFrame, lines: int = 64) -> DataFrame:
    """Pixel relation back to raster rows, in bands of a bounded number of lines."""
    dims = px.groupBy("image_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"),
                                      F.array_sort(F.collect_set("ch")).alias("channels"))
    bands = px.groupBy("image_id", F.expr(f"y DIV {lines}").cast("int").alias("_b")).agg(
        F.array_sort(F.collect_list(F.struct("y", "x", "ch", "v"))).alias("_s"))
    return bands.join(dims, "image_id").selectExpr(
        "image_id", "height", "width", "channels", f"_b * {lines} AS y_first", f"_b * {lines} AS own_from",
        f"least(height - 1, (_b + 1) * {lines} - 1) AS own_to", "transform(_s, s -> CAST(s.v AS SMALLINT)) AS px")


def _index(i: str, n: str, border: str) -> str:
    if border == REPLICATE:
        return f"least({n} - 1, greatest(0, {i}))"
    return f"({n} - 1 - abs({n} - 1 - pmod({i}, greatest(1, 2 * ({n} - 1)))))"


def sample(dy: int, dx: int, border: str = MIRROR, source: str = "px", per_channel: bool = True) -> str:
    """SQL: the sample at an offset from the current position."""
    y = "y" if dy == 0 else _index(f"(y + ({dy}))", "height", border)
    x = "x" if dx == 0 else _index(f"(x + ({dx}))", "width", border)
    flat = f"({y} - y_first) * width + {x}"
    return f"get({source}, ({flat}) * nc + k)" if per_channel else f"get({source}, {flat})"


def weighted(kernel: Sequence[tuple[int, int, float]], border: str = MIRROR, source: str = "px") -> str:
    """SQL: kernel-weighted sum around the current position (integer for integer weights)."""
    return " + ".join(f"CAST({sample(dy, dx, border, source)} AS INT) * ({w})" for dy, dx, w in kernel)


def saturate(expr: str) -> str:
    return f"CAST(least(255, greatest(0, {expr})) AS INT)"


def _filtered(raster: DataFrame, expr: str, out: str = "v", reach: int = 1) -> DataFrame:
    return positions(raster, reach).selectExpr("image_id", "y", "x", "ch", f"{expr} AS {out}")


def gray(raster: DataFrame, rounded: bool = True) -> DataFrame:
    """Single-channel raster from R, G and B, whatever their order in ``channels``.

    ``rounded`` is the rule of the filters; histograms truncate instead. A gray raster
    passes unchanged; alpha is left out.
    """
    def channel(c: str) -> str:
        return f"CAST(get(px, i * size(channels) + array_position(channels, '{c}') - 1) AS DOUBLE)"

    r, g, b = GRAY_WEIGHTS
    mix = f"{r}D * {channel('R')} + {g}D * {channel('G')} + {b}D * {channel('B')}"
    mix = f"floor({mix} + 0.5D)" if rounded else f"floor({mix})"
    first = "transform(sequence(0, size(px) DIV size(channels) - 1), i -> get(px, i * size(channels)))"
    mixed = f"transform(sequence(0, size(px) DIV size(channels) - 1), i -> CAST({mix} AS SMALLINT))"
    return compute_once(raster, {
        "px": f"CASE WHEN size(channels) = 1 THEN px WHEN array_contains(channels, 'R') THEN {mixed} ELSE {first} END",
        "channels": "array('GRAY')"})


def gray_samples(raster: DataFrame, rounded: bool = False) -> DataFrame:
    """Gray values as a pixel relation, computed in generated code (histogram path)."""
    both = gray_pairs(raster).withColumnRenamed("rounded" if rounded else "truncated", "v")
    return both.select("image_id", "y", "x", F.lit("GRAY").alias("ch"), "v")


def gray_pairs(raster: DataFrame) -> DataFrame:
    """Both gray values of each pixel, rounded and truncated, in one projection: (image_id, y, x,
    rounded, truncated). A gray raster passes unchanged; alpha is left out."""
    r, g, b = GRAY_WEIGHTS
    at = lambda c: f"CAST(get(px, i * nc + array_position(channels, '{c}') - 1) AS DOUBLE)"
    mix = f"{r}D * {at('R')} + {g}D * {at('G')} + {b}D * {at('B')}"
    base = with_band(raster).withColumn("nc", F.size("channels"))
    spots = base.select("image_id", "width", "channels", "nc", "px", "y_first", "own_from", "own_to",
                        F.explode(F.expr("sequence(0, size(px) DIV nc - 1)")).alias("i"))
    value = lambda v: f"CAST(CASE WHEN array_contains(channels, 'R') THEN {v} ELSE get(px, i * nc) END AS INT)"
    return spots.selectExpr(
        "image_id", "CAST(y_first + i DIV width AS INT) AS y", "CAST(i % width AS INT) AS x",
        f"{value(f'floor({mix} + 0.5D)')} AS rounded", f"{value(f'floor({mix})')} AS truncated",
        "own_from", "own_to").where("y BETWEEN own_from AND own_to").drop("own_from", "own_to")


# --- histograms and statistics -----------------------------------------------
TASK_BINS = 1 << 20  # bins that a task counts


def spread_bins(raster: DataFrame, task_bins: int = TASK_BINS) -> DataFrame:
    """Deal out images so that a task meets about ``task_bins`` bins, whatever the scan's splits.

    Small images have nearly a bin for each sample, so what a task combines grows with its
    images. Only the geometry is read to count them.
    """
    bins = F.least(F.col("height").cast("bigint") * F.col("width"), F.lit(BINS)) * F.size("channels")
    tasks = math.ceil((raster.agg(F.sum(bins)).first()[0] or 0) / task_bins)
    return raster.repartition(tasks) if tasks > raster.rdd.getNumPartitions() else raster


def bin_counts(px: DataFrame) -> DataFrame:
    """Counts per image, channel and value: (image_id, ch, bin, n)."""
    return px.groupBy("image_id", "ch", F.col("v").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram(px: DataFrame) -> DataFrame:
    """256-bin histogram with empty bins and cumulative share: (image_id, ch, bin, n, cdf_pct).

    The second grouping gathers at most 256 counted bins per image and channel.
    """
    return histogram_from(bin_counts(px))


def histogram_from(counts: DataFrame) -> DataFrame:
    per = counts.groupBy("image_id", "ch").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_m"), F.sum("n").alias("_total"))
    bins = per.select("image_id", "ch", "_m", "_total", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("bin"))
    out = bins.select("image_id", "ch", "_total", "bin", F.coalesce(F.try_element_at("_m", F.col("bin")), F.lit(0)).alias("n"))
    upto = W.partitionBy("image_id", "ch").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    share = F.sum("n").over(upto).cast("double") / F.col("_total").cast("double") * 100
    return out.select("image_id", "ch", "bin", "n", share.alias("cdf_pct"))


def select_channel(px: DataFrame, mode: str = "GRAY") -> DataFrame:
    """The channel statistics are taken from (gray by default)."""
    return px.where(F.col("ch") == mode)


def colour_only(px: DataFrame) -> DataFrame:
    """Alpha is held apart from colour statistics."""
    return px.where(F.col("ch") != "A")


def alpha_only(px: DataFrame) -> DataFrame:
    return px.where(F.col("ch") == "A")


def statistics(counts: DataFrame, digits: int = 2) -> DataFrame:
    """Per image and channel, from bin counts: pixels, mean, std, min, max, range, median
    and percentiles (linear interpolation).

    Sums of integers keep the result exact and independent of row order.
    """
    n, v = F.col("n"), F.col("bin").cast("bigint")
    agg = counts.groupBy("image_id", "ch").agg(
        F.sum(n).alias("pixel_count"), F.sum(v * n).alias("_s1"), F.sum(v * v * n).alias("_s2"),
        F.min(v).alias("min"), F.max(v).alias("max"),
        F.percentile(F.col("bin").cast("double"), F.array(*[F.lit(p) for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)]), n).alias("_p"))
    mean = F.col("_s1").cast("double") / F.col("pixel_count")
    var = F.col("_s2").cast("double") / F.col("pixel_count") - mean * mean
    return agg.select(
        "image_id", "ch", "pixel_count", half_even(mean, digits).alias("mean"),
        half_even(F.sqrt(F.greatest(var, F.lit(0.0))), digits).alias("std_dev"), "min", "max",
        (F.col("max") - F.col("min")).alias("dynamic_range"), half_even(F.get("_p", F.lit(3)), digits).alias("median"),
        *[F.get("_p", F.lit(i)).alias(name) for i, name in enumerate(["p1", "p5", "p25", "p50", "p75", "p95", "p99"])])


def clipping(counts: DataFrame) -> DataFrame:
    """Pixels at 0 and 255 per image and channel, with percentages."""
    at = lambda b: F.sum(F.when(F.col("bin") == b, F.col("n")).otherwise(0))
    c = counts.groupBy("image_id", "ch").agg(at(0).alias("black_count"), at(255).alias("white_count"), F.sum("n").alias("_t"))
    return c.select("image_id", "ch", "black_count", percent(F.col("black_count"), F.col("_t")).alias("black_pct"),
                    "white_count", percent(F.col("white_count"), F.col("_t")).alias("white_pct"))


# Tonal ranges, inclusive.
TONES = {"shadows": (0, 84), "midtones": (85, 170), "highlights": (171, 255)}


def tonal_split(counts: DataFrame) -> DataFrame:
    sums = [F.sum(F.when(F.col("bin").between(a, b), F.col("n")).otherwise(0)).alias(f"{t}_count") for t, (a, b) in TONES.items()]
    c = counts.groupBy("image_id", "ch").agg(*sums, F.sum("n").alias("_t"))
    return c.select("image_id", "ch", *[x for t in TONES for x in (
        F.col(f"{t}_count"), percent(F.col(f"{t}_count"), F.col("_t")).alias(f"{t}_pct"))])


def histogram_invariant(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every channel's bins must sum to width x height; the note says what failed."""
    sums = counts.groupBy("image_id", "ch").agg(F.sum("n").alias("bin_sum"))
    per = sizes.select("image_id", (F.col("width").cast("bigint") * F.col("height")).alias("total_pixels"))
    ok = F.col("bin_sum") == F.col("total_pixels")
    return sums.join(per, "image_id").groupBy("image_id", "total_pixels").agg(
        F.bool_and(ok).alias("invariant_passed"),
        F.coalesce(F.concat(F.lit("Bin sums do not match total pixels: "), F.nullif(F.array_join(
            F.array_sort(F.collect_list(F.when(~ok, F.concat_ws("=", "ch", "bin_sum")))), ", "), F.lit(""))), F.lit("")).alias("invariant_notes"))


def plot_series(hist: DataFrame, log_scale: bool = False) -> DataFrame:
    """Heights 0-1 of a histogram plot against the image's peak, and the share of a bin."""
    peaks = hist.groupBy("image_id").agg(F.greatest(F.max("n"), F.lit(1)).alias("_peak"))
    totals = hist.groupBy("image_id", "ch").agg(F.sum("n").alias("_total"))
    height = (F.log10(F.col("n") + 1.0) / F.log10(F.col("_peak") + 1.0) if log_scale
              else F.col("n").cast("double") / F.col("_peak").cast("double"))
    return hist.join(peaks, "image_id").join(totals, ["image_id", "ch"]).select(
        "image_id", "ch", "bin", height.alias("height"), percent(F.col("n"), F.col("_total")).alias("share_pct"))


# --- point operations (over the pixel relation) -------------------------------
def to_8bit(v: Column) -> Column:
    """16-bit sample to 8 bits by truncation."""
    return F.floor(v / 256).cast("int")


def brightness(px: DataFrame, beta: float) -> DataFrame:
    """Add, take the absolute value, saturate."""
    return px.withColumn("v", F.least(F.lit(255), F.rint(F.abs(F.col("v") + F.lit(float(beta))))).cast("int"))


def contrast(px: DataFrame, alpha: float) -> DataFrame:
    """Scale by at least 0.1, round half-even, saturate."""
    a = float(max(0.1, alpha))
    return px.withColumn("v", F.least(F.lit(255.0), F.rint(F.abs(F.col("v") * F.lit(a)))).cast("int"))


def threshold(px: DataFrame, level: int = 128) -> DataFrame:
    return px.withColumn("v", F.when(F.col("v") > level, 255).otherwise(0))


def isolate_channel(px: DataFrame, channel: str, single_plane: bool = False) -> DataFrame:
    """One colour channel: the others zeroed, or only its plane."""
    if single_plane:
        return px.where(F.col("ch") == channel)
    return px.withColumn("v", F.when(F.col("ch") == channel, F.col("v")).otherwise(0))


def to_hsv(raster: DataFrame) -> DataFrame:
    """Hue 0-179, saturation and value 0-255 per pixel, in 12-bit fixed point."""
    p = positions(raster).where("k = 0")
    at = lambda c: f"CAST(get(px, ((y - y_first) * width + x) * nc + array_position(channels, '{c}') - 1) AS INT)"
    p = p.selectExpr("image_id", "y", "x", f"{at('R')} AS r", f"{at('G')} AS g", f"{at('B')} AS b")
    p = p.withColumns({"val": F.greatest("r", "g", "b"), "diff": F.greatest("r", "g", "b") - F.least("r", "g", "b")})
    raw = F.expr("CASE WHEN val = r THEN g - b WHEN val = g THEN b - r + 2 * diff ELSE r - g + 4 * diff END")
    scaled = F.expr("CAST(floor((h0 * CAST(CASE WHEN diff = 0 THEN 0D ELSE rint(737280D / (6D * diff)) END AS BIGINT) + 2048) / 4096D) AS INT)")
    p = p.withColumn("h0", raw).withColumn("h1", scaled)
    return p.selectExpr(
        "image_id", "y", "x", "CASE WHEN h1 < 0 THEN h1 + 180 ELSE h1 END AS h",
        "CAST((diff * CAST(CASE WHEN val = 0 THEN 0D ELSE rint(1044480D / val) END AS BIGINT) + 2048) DIV 4096 AS INT) AS s", "val AS v")


def add_noise(px: DataFrame, amount: int = 25, seed: int = 0) -> DataFrame:
    """Simulated Gaussian noise, sigma at least 1, clipped and truncated.

    Two uniform numbers come from a hash of (image, y, x, channel, seed), so a sample gets
    the same noise on every cluster, whatever the partitions.
    """
    digest = F.md5(F.concat_ws(":", F.col("image_id").cast("string"), F.col("y").cast("string"), F.col("x").cast("string"), "ch", F.lit(str(seed))).cast("binary"))
    uniform = lambda at: (F.conv(F.substring(digest, at, 8), 16, 10).cast("double") + 1) / F.lit(2.0**32)
    normal = F.sqrt(-2 * F.ln(uniform(1))) * F.cos(F.lit(2 * math.pi) * uniform(9))
    noisy = F.col("v") + normal * float(max(1, amount))
    return px.withColumn("v", F.least(F.lit(255.0), F.greatest(F.lit(0.0), noisy)).cast("int"))


# --- neighbourhood filters ---------------------------------------------------
def odd(k: int, least: int = 1) -> int:
    k = max(least, int(k))
    return k if k % 2 else k + 1


def gaussian_taps(k: int) -> list[float]:
    """Weights of a k-tap Gaussian whose sigma follows from k."""
    if k in SMALL_GAUSSIAN:
        return SMALL_GAUSSIAN[k]
    sigma = 0.3 * ((k - 1) * 0.5 - 1) + 0.8
    raw = [math.exp(-((i - (k - 1) / 2) ** 2) / (2 * sigma * sigma)) for i in range(k)]
    return [w / sum(raw) for w in raw]


def _border(at: np.ndarray, n: int, border: str) -> np.ndarray:
    """Indices inside 0..n-1 for indices that may lie beyond."""
    if border == REPLICATE:
        return np.clip(at, 0, n - 1)
    return (n - 1) - np.abs((n - 1) - at % max(1, 2 * (n - 1)))


def _planes(px, width: int, nc: int) -> np.ndarray:
    return np.asarray(px).reshape(-1, width, nc)


def _rows_of(lines: int, height: int, y_first: int, shift: int, border: str) -> np.ndarray:
    """Line of the band that stands ``shift`` below each of its lines; owned lines find theirs
    inside the band, halo lines may be held back at its ends and are not used."""
    return np.clip(_border(np.arange(y_first, y_first + lines) + shift, height, border) - y_first, 0, lines - 1)


def _smoothed(taps: Sequence[float], border: str, anchor: int):
    """Separable weighted mean of whole bands, taps added in order."""
    @F.pandas_udf("array<double>")
    def run(px: pd.Series, height: pd.Series, width: pd.Series, nc: pd.Series, y_first: pd.Series) -> pd.Series:
        out = []
        for p, h, w, c, y in zip(px, height, width, nc, y_first):
            if p is None or not len(p):
                out.append(p)
                continue
            a = _planes(p, w, c).astype(np.float64)
            across = sum((a[:, _border(np.arange(w) + i - anchor, w, border)] * t for i, t in enumerate(taps[1:], 1)), a[:, _border(np.arange(w) - anchor, w, border)] * taps[0])
            down = sum((across[_rows_of(len(a), h, y, i - anchor, border)] * t for i, t in enumerate(taps[1:], 1)), across[_rows_of(len(a), h, y, -anchor, border)] * taps[0])
            out.append(down.ravel())
        return pd.Series(out)
    return run


def _medians(k: int):
    """Median over k x k of whole bands, 64 lines at once."""
    @F.pandas_udf("array<smallint>")
    def run(px: pd.Series, height: pd.Series, width: pd.Series, nc: pd.Series, y_first: pd.Series) -> pd.Series:
        out, reach = [], k // 2
        for p, h, w, c, y in zip(px, height, width, nc, y_first):
            if p is None or not len(p):
                out.append(p)
                continue
            a, done = _planes(p, w, c), []
            for top in range(0, len(a), 64):
                lines = [_rows_of(len(a), h, y, dy, REPLICATE)[top : top + 64] for dy in range(-reach, reach + 1)]
                sides = [_border(np.arange(w) + dx, w, REPLICATE) for dx in range(-reach, reach + 1)]
                window = np.stack([a[rows][:, cols] for rows in lines for cols in sides])
                done.append(np.partition(window, k * k // 2, axis=0)[k * k // 2])
            out.append(np.concatenate(done).ravel())
        return pd.Series(out)
    return run


def _beside(raster: DataFrame, reach: int, **made) -> DataFrame:
    """As ``positions``, with the values of whole-band functions at each sample.

    The functions run over Arrow batches of bands, map side; nothing is shuffled.
    """
    r = reaching(raster, reach).withColumn("nc", F.size("channels"))
    r = r.withColumns({f"_{n}": f("px", "height", "width", "nc", "y_first") for n, f in made.items()})
    samples = F.arrays_zip(F.col("px").alias("v"), *[F.col(f"_{n}").alias(n) for n in made])
    flat = r.select("image_id", "height", "width", "channels", "nc", "y_first", "own_from", "own_to", "px", F.posexplode_outer(samples).alias("i", "_s"))
    return flat.selectExpr(
        "image_id", "height", "width", "channels", "nc", "y_first", "own_from", "own_to", "px", "CAST(_s.v AS INT) AS v", *[f"_s.{n} AS {n}" for n in made],
        "CAST(i % nc AS INT) AS k", "CAST((i DIV nc) % width AS INT) AS x", "CAST(y_first + i DIV (nc * width) AS INT) AS y",
    ).where("y BETWEEN own_from AND own_to").withColumn("ch", F.get("channels", F.col("k")))


def separable(raster: DataFrame, taps: Sequence[float], border: str, anchor: int | None = None) -> DataFrame:
    """Positions with ``acc``, the separable weighted mean around each sample."""
    anchor = len(taps) // 2 if anchor is None else anchor
    p = _beside(raster, max(anchor, len(taps) - 1 - anchor), acc=_smoothed(list(taps), border, anchor))
    return p.select("image_id", "y", "x", "ch", "v", "acc")


def box_blur(raster: DataFrame, k: int = 5) -> DataFrame:
    """Mean over k x k, mirrored edges; an even k reaches one further back."""
    k = max(1, int(k))
    sums = separable(raster, [1.0] * k, MIRROR, anchor=k // 2)
    return sums.selectExpr("image_id", "y", "x", "ch", f"CAST(rint(acc * {1.0 / (k * k)!r}D) AS INT) AS v")


def gaussian_blur(raster: DataFrame, k: int = 5) -> DataFrame:
    """Gaussian over an odd k, mirrored edges, rounded half up."""
    return separable(raster, gaussian_taps(odd(k)), MIRROR).selectExpr(
        "image_id", "y", "x", "ch", "CAST(floor(acc + 0.5D) AS INT) AS v")


def median_blur(raster: DataFrame, k: int = 5) -> DataFrame:
    """Median over an odd k x k, edge samples repeated."""
    k = odd(k)
    return _beside(raster, k // 2, m=_medians(k)).selectExpr("image_id", "y", "x", "ch", "CAST(m AS INT) AS v")


def sharpen(raster: DataFrame) -> DataFrame:
    return _filtered(raster, saturate(weighted(SHARPEN)))


def laplacian(raster: DataFrame) -> DataFrame:
    """Magnitude of the second derivative, saturated."""
    return _filtered(raster, f"CAST(least(255, abs({weighted(LAPLACE)})) AS INT)")


def sobel(raster: DataFrame) -> DataFrame:
    """Gradient magnitude, rounded half-even and saturated."""
    gx, gy = f"CAST({weighted(SOBEL_X)} AS DOUBLE)", f"CAST({weighted(SOBEL_Y)} AS DOUBLE)"
    return _filtered(raster, f"CAST(least(255D, rint(sqrt(({gx}) * ({gx}) + ({gy}) * ({gy})))) AS INT)")


def laplacian_variance(raster: DataFrame) -> DataFrame:
    """Variance of the unsaturated Laplacian per image: focus, and a noise estimate."""
    lap = _filtered(raster, weighted(LAPLACE), "l")
    sums = lap.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("l").cast("bigint")).alias("_s"),
                                       F.sum(F.col("l").cast("bigint") * F.col("l")).alias("_q"))
    mean = F.col("_s").cast("double") / F.col("_n")
    return sums.select("image_id", (F.col("_q").cast("double") / F.col("_n") - mean * mean).alias("laplacian_variance"))


def noise_band(variance: Column) -> Column:
    return (F.when(variance < 50, "Low Noise (Smooth/Compressed)").when(variance < 200, "Moderate Noise")
            .otherwise("High Noise / Detailed Texture"))


def noise_residual(raster: DataFrame, scale: int = 8) -> DataFrame:
    """Difference from the 3x3 median: ``residual`` and its scaled, clipped map ``v``."""
    p = _beside(raster, 1, m=_medians(3)).selectExpr("image_id", "y", "x", "ch", "abs(v - CAST(m AS INT)) AS residual")
    return p.withColumn("v", F.least(F.lit(255), F.col("residual") * scale))


def noise_level(raster: DataFrame) -> DataFrame:
    r = noise_residual(raster).groupBy("image_id").agg(
        F.sum("residual").alias("_s"), F.count(F.lit(1)).alias("_n"))
    level = F.col("_s").cast("double") / F.col("_n")
    return r.select("image_id", level.alias("noise_level"), noise_rating(level).alias("noise_rating"))


def noise_rating(level: Column) -> Column:
    return F.when(level < 3, "Low").when(level < 8, "Moderate").otherwise("High")


def adaptive_threshold(raster: DataFrame, block: int = 11, c: float = 2, inverted: bool = False) -> DataFrame:
    """Compare each sample with its Gaussian-weighted surroundings less ``c``."""
    local = separable(raster, gaussian_taps(odd(block, 3)), REPLICATE)
    above = f"v > CAST(rint(acc) AS INT) - ({c})"
    on, off = (0, 255) if inverted else (255, 0)
    return local.selectExpr("image_id", "y", "x", "ch", f"CASE WHEN {above} THEN {on} ELSE {off} END AS v")


def text_visibility(raster: DataFrame) -> DataFrame:
    """Share of dark-on-light samples and its rating."""
    marks = adaptive_threshold(raster, 15, 10, inverted=True).groupBy("image_id").agg(
        F.count_if(F.col("v") > 0).alias("_t"), F.count(F.lit(1)).alias("_n"))
    ratio = F.col("_t").cast("double") / F.col("_n")
    return marks.select("image_id", ratio.alias("text_pixel_ratio"), visibility_rating(ratio).alias("text_visibility"))


def visibility_rating(ratio: Column) -> Column:
    return (F.when(ratio.between(0.05, 0.4), "Good").when(ratio.between(0.02, 0.5), "Moderate").otherwise("Poor"))


def area_scale(px: DataFrame, factor: int) -> DataFrame:
    """Shrink by an integer factor, averaging blocks. Blocks are combined map-side."""
    cell = px.groupBy("image_id", "ch", F.expr(f"y DIV {factor}").cast("int").alias("y"), F.expr(f"x DIV {factor}").cast("int").alias("x"))
    sums = cell.agg(F.sum("v").alias("_s"), F.count(F.lit(1)).alias("_n"))
    if factor == 2:
        v = F.expr("CAST(floor((_s + _n / 2) / _n) AS INT)")
    else:
        v = F.rint(F.col("_s").cast("double") / F.col("_n")).cast("int")
    return sums.select("image_id", "ch", "y", "x", v.alias("v"))


def error_level(original: DataFrame, resaved: DataFrame, scale: float = 10.0) -> DataFrame:
    """Scaled absolute difference of two versions of the same images.

    Rows are joined once each, by image, or by image and band where both sides are cut the
    same way; where one side is cut, its owned lines are looked up in the whole other image.
    The samples are compared inside the joined row.
    """
    cut = ["y_first" in r.columns for r in (original, resaved)]
    walked, other = (original, resaved) if cut[0] or not cut[1] else (resaved, original)
    keys = ["image_id", "own_from"] if all(cut) else ["image_id"]
    other = with_band(other).select(*keys, F.col("px").alias("_px2"), F.col("y_first").alias("_y2"))
    both = with_band(walked).join(other, keys)
    flat = both.select("image_id", "height", "width", "channels", F.size("channels").alias("nc"), "_px2", "_y2", "y_first", "own_from", "own_to",
                       F.posexplode_outer("px").alias("i", "v"))
    diff = f"least(255D, abs(CAST(v AS DOUBLE) - CAST(get(_px2, i + (y_first - _y2) * width * nc) AS DOUBLE)) * {float(scale)!r}D)"
    placed = flat.where("i IS NOT NULL").withColumn("y", F.expr("CAST(y_first + i DIV (nc * width) AS INT)")).where("y BETWEEN own_from AND own_to")
    return placed.selectExpr("image_id", "y", "CAST((i DIV nc) % width AS INT) AS x", "get(channels, CAST(i % nc AS INT)) AS ch", f"CAST({diff} AS INT) AS v")


def block_summary(px: DataFrame, block: int = 8) -> DataFrame:
    """Mean and maximum per square block."""
    return px.groupBy("image_id", F.expr(f"y DIV {block}").cast("int").alias("by"), F.expr(f"x DIV {block}").cast("int").alias("bx")).agg(
        (F.sum("v").cast("double") / F.count(F.lit(1))).alias("mean_level"), F.max("v").alias("max_level"))


# --- quality of a page image -------------------------------------------------
def resolution_rating(pixels_: Column) -> Column:
    return F.when(pixels_ >= 2_000_000, "Good").when(pixels_ >= 500_000, "Low").otherwise("Very Low")


def dpi_estimate(pixels_: Column) -> Column:
    return F.when(pixels_ >= 2_000_000, 300).when(pixels_ >= 500_000, 150).otherwise(72)


def sharpness_rating(variance: Column) -> Column:
    return F.when(variance > 500, "Good").when(variance > 100, "Moderate").otherwise("Poor")


def brightness_rating(mean: Column) -> Column:
    return F.when(mean.between(80, 200), "Good").when(mean < 80, "Dark").otherwise("Bright")


def contrast_rating(std: Column) -> Column:
    return F.when(std > 60, "Good").when(std > 35, "Moderate").otherwise("Poor")


def background_rating(std: Column) -> Column:
    return F.when(std < 15, "Clean").when(std < 35, "Noisy").otherwise("Uneven")


def background(raster: DataFrame) -> DataFrame:
    """Standard deviation of four border strips (corners count twice) and its rating."""
    b = "greatest(10, least(height, width) DIV 20)"
    hits = (f"CAST(y < {b} AS INT) + CAST(y >= height - {b} AS INT) + CAST(x < {b} AS INT) + CAST(x >= width - {b} AS INT)")
    p = positions(raster).selectExpr("image_id", "v", f"{hits} AS w").where("w > 0")
    sums = p.groupBy("image_id").agg(F.sum("w").alias("_n"), F.sum(F.col("w") * F.col("v")).alias("_s"),
                                     F.sum(F.col("w") * F.col("v") * F.col("v")).alias("_q"))
    mean = F.col("_s").cast("double") / F.col("_n")
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("_q").cast("double") / F.col("_n") - mean * mean))
    return sums.select("image_id", std.alias("background_std"), background_rating(std).alias("background_quality"))


def readiness_issues(df: DataFrame) -> DataFrame:
    """Weighted issues of a quality row and the readiness they add up to."""
    def worth(col: str, **weights: int) -> Column:
        out = F.lit(0)
        for label, w in weights.items():
            out = F.when(F.col(col) == label.replace("_", " "), w).otherwise(out)
        return out

    issues = (worth("resolution_rating", Very_Low=2, Low=1) + worth("sharpness_rating", Poor=2, Moderate=1)
              + worth("contrast_rating", Poor=1) + worth("noise_rating", High=1) + worth("text_visibility", Poor=2))
    return df.withColumn("issues", issues).withColumn(
        "readiness", F.when(F.col("issues") == 0, "Good").when(F.col("issues") <= 2, "Needs Enhancement").otherwise("Poor"))


def quality_report(raster: DataFrame) -> DataFrame:
    """One quality row per image from a gray raster: measures, ratings, readiness.

    All measures share one pass over the samples and reduce to a few sums per image inside
    the task.
    """
    b = "greatest(10, least(height, width) DIV 20)"
    hits = (f"CAST(y < {b} AS INT) + CAST(y >= height - {b} AS INT) + CAST(x < {b} AS INT) + CAST(x >= width - {b} AS INT)")
    p = _beside(raster, 7, m=_medians(3), acc=_smoothed(gaussian_taps(15), REPLICATE, 7)).selectExpr(
        "image_id", "height", "width", "CAST(v AS BIGINT) AS v", f"CAST({weighted(LAPLACE)} AS BIGINT) AS l",
        "abs(v - CAST(m AS INT)) AS r", "v <= CAST(rint(acc) AS INT) - 10 AS mark", f"CAST({hits} AS BIGINT) AS w")
    s = p.groupBy("image_id", "height", "width").agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"),
        F.sum("l").alias("ls"), F.sum(F.col("l") * F.col("l")).alias("lq"), F.sum("r").alias("rs"), F.count_if("mark").alias("t"),
        F.sum("w").alias("wn"), F.sum(F.col("w") * F.col("v")).alias("ws"), F.sum(F.col("w") * F.col("v") * F.col("v")).alias("wq"))

    def spread(total: str, square: str, n: str) -> Column:
        mean = F.col(total).cast("double") / F.col(n)
        return F.greatest(F.lit(0.0), F.col(square).cast("double") / F.col(n) - mean * mean)

    m = s.select("image_id", "height", "width", spread("ls", "lq", "n").alias("sharpness_score"),
                 (F.col("s").cast("double") / F.col("n")).alias("brightness_mean"),
                 F.sqrt(spread("s", "q", "n")).alias("contrast_std"),
                 (F.col("rs").cast("double") / F.col("n")).alias("noise_level"),
                 F.sqrt(spread("ws", "wq", "wn")).alias("background_std"),
                 (F.col("t").cast("double") / F.col("n")).alias("text_pixel_ratio"))
    size = F.col("height").cast("bigint") * F.col("width")
    return readiness_issues(m.withColumns({
        "resolution_rating": resolution_rating(size), "dpi_estimate": dpi_estimate(size),
        "sharpness_rating": sharpness_rating(F.col("sharpness_score")),
        "blur_detected": F.col("sharpness_score") <= 100,
        "brightness_rating": brightness_rating(F.col("brightness_mean")),
        "contrast_rating": contrast_rating(F.col("contrast_std")),
        "noise_rating": noise_rating(F.col("noise_level")),
        "background_quality": background_rating(F.col("background_std")), "text_visibility": visibility_rating(F.col("text_pixel_ratio")),
    }))


def preprocessing_plan(quality: DataFrame, skew: str = "skew_angle") -> DataFrame:
    """Six decisions per image: (step_no, name, applied, reason, details).

    ``skew`` is an input column in degrees; without it the page counts as straight.
    """
    if skew not in quality.columns:
        quality = quality.withColumn(skew, F.lit(0.0))
    angle, size = F.col(skew), F.concat(F.col("width").cast("string"), F.lit("×"), F.col("height").cast("string"))
    text = lambda shape, c: F.format_string(shape, c)
    one = lambda c: half_even(c, 1)

    def step(name: str, column: Column, cases: Sequence[tuple[Column, Column | str, str | Column]], calm: Column) -> Column:
        applied, reason, details = F.lit(False), F.lit("Not Required"), calm
        for when, why, what in reversed(cases):
            as_col = lambda v: F.lit(v) if isinstance(v, str) else v
            applied = F.when(when, True).otherwise(applied)
            reason = F.when(when, as_col(why)).otherwise(reason)
            details = F.when(when, as_col(what)).otherwise(details)
        return F.struct(F.lit(name).alias("name"), applied.alias("applied"), reason.alias("reason"), details.alias("details"))

    is_ = lambda c, v: F.col(c) == v
    noise, std, mean = one(F.col("noise_level")), one(F.col("contrast_std")), F.rint("brightness_mean")
    steps = F.array(
        step("Deskew", angle, [(F.abs(angle) >= 1.0, text("Skew angle: %.1f°", one(angle)), text("Corrected %.1f° rotation", one(angle)))],
             text("Skew angle %.1f° within tolerance", one(angle))),
        step("Resolution Enhancement", size, [
            (is_("resolution_rating", "Very Low"), F.concat(F.lit("Very low resolution ("), size, F.lit(")")), "Upscaled 2× with cubic interpolation"),
            (is_("resolution_rating", "Low"), F.concat(F.lit("Low resolution ("), size, F.lit(")")), "Upscaled 1.5× with cubic interpolation")],
            F.concat(F.lit("Resolution adequate ("), size, F.lit(")"))),
        step("Noise Reduction", noise, [
            (is_("noise_rating", "High"), text("High noise level (%.1f)", noise), "Applied fast non-local means denoising (strength=10)"),
            (is_("noise_rating", "Moderate"), text("Moderate noise level (%.1f)", noise), "Applied mild non-local means denoising (strength=5)")],
            text("Noise level acceptable (%.1f)", noise)),
        step("Contrast Enhancement", std, [
            (is_("contrast_rating", "Poor"), text("Poor contrast (σ=%.1f)", std), "Applied CLAHE with clip_limit=3.0"),
            (is_("contrast_rating", "Moderate"), text("Moderate contrast (σ=%.1f)", std), "Applied CLAHE with clip_limit=2.0")],
            text("Contrast adequate (σ=%.1f)", std)),
        step("Brightness Normalization", mean, [
            (is_("brightness_rating", "Dark"), text("Image too dark (mean=%.0f)", mean), "Increased brightness by +40"),
            (is_("brightness_rating", "Bright"), text("Image too bright (mean=%.0f)", mean), "Decreased brightness by -30")],
            text("Brightness adequate (mean=%.0f)", mean)),
        step("Background Normalization", F.col("background_quality"), [
            (is_("background_quality", "Uneven"), "Uneven background detected", "Applied morphological background subtraction")],
            F.concat(F.lit("Background quality: "), F.col("background_quality"))),
    )
    return quality.select("image_id", F.posexplode(steps).alias("step_no", "_s")).select("image_id", "step_no", "_s.*")


def variant_plan(quality: DataFrame) -> DataFrame:
    """Preprocessing variants to try per image: (variant_no, variant)."""
    names = lambda *v: F.array(*[F.lit(x) for x in v])
    chosen = (F.when(F.col("readiness") == "Good", names("Original"))
              .when(F.col("readiness") == "Poor", names("Mild Enhancement", "Grayscale + Contrast", "Denoised"))
              .otherwise(names("Mild Enhancement", "Grayscale + Contrast")))
    return quality.select("image_id", F.posexplode(chosen).alias("variant_no", "variant"))


def colour_space(channels: Column, bits: Column | None = None) -> Column:
    """struct(color_space, has_alpha, bit_depth) from the channel names and sample size."""
    n, alpha = F.size(channels), F.array_contains(channels, "A")
    depth = F.lit(8) if bits is None else bits
    label = (F.when((n == 1) & (depth == 16), "16-bit Grayscale").when(n == 1, "Grayscale")
             .when((n == 2) & alpha, "LA (Grayscale + Alpha)").when(alpha, "RGBA").otherwise("RGB"))
    return F.struct(label.alias("color_space"), alpha.alias("has_alpha"), depth.cast("int").alias("bit_depth"))
