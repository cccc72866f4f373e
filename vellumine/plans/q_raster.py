"""Raster operators over the embeddings: each vector of 64 is an 8 x 8 gray tile.

The colour tile takes the vector as red, its mirror image as green and its negative as
blue; alpha is constant per label.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumine.functions import text as tx  # noqa: F401
from vellumine.operators import raster as ra
from vellumine.plans.registry import query, table
from vellumine.sources.files import spread

LEVEL = "CAST(least(255D, greatest(0D, floor((CAST(e AS DOUBLE) + 0.6D) * 212D))) AS SMALLINT)"


def tiles(spark, d):
    e = table(spark, d, "embeddings")
    return spread(e.selectExpr("vec_id AS image_id", "label", "8 AS height", "8 AS width", "array('GRAY') AS channels",
                               f"transform(embedding, e -> {LEVEL}) AS px"))


def colour_tiles(spark, d, alpha=False):
    names = "array('B', 'G', 'R', 'A')" if alpha else "array('B', 'G', 'R')"
    extra = ", CAST(label * 20 % 256 AS SMALLINT)" if alpha else ""
    return tiles(spark, d).selectExpr(
        "image_id", "label", "height", "width", f"{names} AS channels",
        "flatten(transform(sequence(0, 63), i -> array(CAST(255 - get(px, i) AS SMALLINT), get(px, 63 - i), get(px, i)"
        f"{extra}))) AS px")


LEVEL_SQL = "CAST(least(255.0::DOUBLE, greatest(0.0::DOUBLE, floor((e::DOUBLE + 0.6::DOUBLE) * 212))) AS INT)"
TILES_SQL = f"""tile AS (SELECT vec_id AS image_id, label, list_transform(embedding, lambda e: {LEVEL_SQL}) AS a FROM embeddings),
px AS (SELECT image_id, label, (i // 8)::INT AS y, (i % 8)::INT AS x, 'GRAY' AS ch, a[i + 1] AS v FROM tile, range(64) r(i))"""
COLOUR_SQL = TILES_SQL + """,
cpx AS (SELECT image_id, (i // 8)::INT AS y, (i % 8)::INT AS x, c.ch, CASE c.ch WHEN 'R' THEN a[i + 1] WHEN 'G' THEN a[64 - i] WHEN 'B' THEN 255 - a[i + 1]
  ELSE label * 20 % 256 END AS v FROM tile, range(64) r(i), (VALUES ('R'), ('G'), ('B'), ('A')) c(ch)),
rgb AS (SELECT image_id, y, x, max(v) FILTER (ch = 'R') AS r, max(v) FILTER (ch = 'G') AS g, max(v) FILTER (ch = 'B') AS b FROM cpx GROUP BY 1, 2, 3),
gpx AS (SELECT image_id, y, x, 'GRAY' AS ch, floor(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b)::INT AS v FROM rgb)"""
ALL_COLOUR = COLOUR_SQL + ", allpx AS (SELECT * FROM cpx WHERE ch <> 'A' UNION ALL BY NAME SELECT * FROM gpx)"


def colour_samples(spark, d):
    """Samples of R, G, B and truncated gray."""
    r = ra.spread_bins(colour_tiles(spark, d))
    return ra.pixels(r).unionByName(ra.gray_samples(r))


def colour_counts(spark, d):
    """Counts of R, G, B and truncated gray."""
    return ra.bin_counts(colour_samples(spark, d))


@query("p01_pixel_relation", f"WITH {COLOUR_SQL} SELECT image_id, y, x, ch, v FROM cpx WHERE ch <> 'A'")
def p01(spark, d):
    return ra.pixels(colour_tiles(spark, d))


@query("p02_gray", f"""WITH {COLOUR_SQL} SELECT image_id, y, x, floor(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b + 0.5::DOUBLE)::INT AS rounded,
  floor(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b)::INT AS truncated FROM rgb""")
def p02(spark, d):
    return ra.gray_pairs(colour_tiles(spark, d))


@query("p03_histogram", f"""WITH {ALL_COLOUR}, c AS (SELECT image_id, ch, v AS bin, count(*) AS n FROM allpx GROUP BY 1, 2, 3)
SELECT k.image_id, k.ch, b.bin::INT AS bin, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT image_id, ch FROM c) k CROSS JOIN range(256) b(bin)
LEFT JOIN c ON c.image_id = k.image_id AND c.ch = k.ch AND c.bin = b.bin""")
def p03(spark, d):
    r = colour_tiles(spark, d)
    return ra.histogram(ra.pixels(r).unionByName(ra.gray_samples(r))).drop("cdf_pct")


@query("p04_cdf", f"""WITH {TILES_SQL}, c AS (SELECT image_id, v AS bin, count(*) AS n FROM px GROUP BY 1, 2)
SELECT k.image_id, b.bin::INT AS bin, sum(coalesce(c.n, 0)) OVER (PARTITION BY k.image_id ORDER BY b.bin)::DOUBLE / 64.0::DOUBLE * 100 AS cdf_pct
FROM (SELECT DISTINCT image_id FROM c) k CROSS JOIN range(256) b(bin) LEFT JOIN c ON c.image_id = k.image_id AND c.bin = b.bin""")
def p04(spark, d):
    return ra.histogram(ra.pixels(tiles(spark, d))).select("image_id", "bin", "cdf_pct")


STAT_SQL = """count(*) AS pixel_count, round_even(sum(v)::DOUBLE / count(*) * 100, 0) / 100 AS mean,
  round_even(sqrt(greatest(sum(v * v)::DOUBLE / count(*) - sum(v)::DOUBLE / count(*) * (sum(v)::DOUBLE / count(*)), 0)) * 100, 0) / 100 AS std_dev,
  min(v)::BIGINT AS min, max(v)::BIGINT AS max"""


@query("p05_statistics", f"WITH {COLOUR_SQL} SELECT image_id, {STAT_SQL}, (max(v) - min(v))::BIGINT AS dynamic_range FROM gpx GROUP BY 1")
def p05(spark, d):
    s = ra.statistics(ra.bin_counts(ra.gray_samples(colour_tiles(spark, d))))
    return s.select("image_id", "pixel_count", "mean", "std_dev", "min", "max", "dynamic_range")


@query("p06_percentiles", f"""WITH {TILES_SQL} SELECT image_id, round_even(quantile_cont(v::DOUBLE, 0.5) * 100, 0) / 100 AS median,
  round(quantile_cont(v::DOUBLE, 0.01), 6) AS p1, round(quantile_cont(v::DOUBLE, 0.05), 6) AS p5, round(quantile_cont(v::DOUBLE, 0.25), 6) AS p25,
  round(quantile_cont(v::DOUBLE, 0.75), 6) AS p75, round(quantile_cont(v::DOUBLE, 0.95), 6) AS p95, round(quantile_cont(v::DOUBLE, 0.99), 6) AS p99 FROM px GROUP BY 1""")
def p06(spark, d):
    s = ra.statistics(ra.bin_counts(ra.pixels(tiles(spark, d))))
    return s.select("image_id", "median", *[F.round(c, 6).alias(c) for c in ("p1", "p5", "p25", "p75", "p95", "p99")])


@query("p07_channel_statistics", f"WITH {COLOUR_SQL} SELECT image_id, ch, {STAT_SQL} FROM cpx WHERE ch <> 'A' GROUP BY 1, 2")
def p07(spark, d):
    s = ra.statistics(ra.bin_counts(ra.pixels(colour_tiles(spark, d))))
    return s.select("image_id", "ch", "pixel_count", "mean", "std_dev", "min", "max")


@query("p08_clipping", f"""WITH {ALL_COLOUR} SELECT image_id, ch, count(*) FILTER (v = 0) AS black_count, round_even(count(*) FILTER (v = 0)::DOUBLE / 64 * 100 * 100, 0) / 100 AS black_pct,
  count(*) FILTER (v = 255) AS white_count, round_even(count(*) FILTER (v = 255)::DOUBLE / 64 * 100 * 100, 0) / 100 AS white_pct FROM allpx GROUP BY 1, 2""")
def p08(spark, d):
    return ra.clipping(colour_counts(spark, d))


@query("p09_tonal_split", f"""WITH {TILES_SQL} SELECT image_id, count(*) FILTER (v <= 84) AS shadows_count, round_even(count(*) FILTER (v <= 84)::DOUBLE / 64 * 100 * 100, 0) / 100 AS shadows_pct,
  count(*) FILTER (v BETWEEN 85 AND 170) AS midtones_count, round_even(count(*) FILTER (v BETWEEN 85 AND 170)::DOUBLE / 64 * 100 * 100, 0) / 100 AS midtones_pct,
  count(*) FILTER (v >= 171) AS highlights_count, round_even(count(*) FILTER (v >= 171)::DOUBLE / 64 * 100 * 100, 0) / 100 AS highlights_pct FROM px GROUP BY 1""")
def p09(spark, d):
    return ra.tonal_split(ra.bin_counts(ra.pixels(tiles(spark, d)))).drop("ch")


@query("p10_histogram_invariant", f"""WITH {ALL_COLOUR}, s AS (SELECT image_id, ch, count(*) AS n FROM allpx GROUP BY 1, 2)
SELECT image_id, 64::BIGINT AS total_pixels, bool_and(n = 64) AS invariant_passed, '' AS invariant_notes FROM s GROUP BY 1""")
def p10(spark, d):
    return ra.histogram_invariant(colour_counts(spark, d), colour_tiles(spark, d))


@query("p11_alpha_apart", f"""WITH {COLOUR_SQL} SELECT image_id, ch, v AS bin, count(*) AS n, ch = 'A' AS is_alpha FROM cpx GROUP BY 1, 2, 3""")
def p11(spark, d):
    px = ra.pixels(colour_tiles(spark, d, alpha=True))
    colour = ra.bin_counts(ra.colour_only(px)).withColumn("is_alpha", F.lit(False))
    return colour.unionByName(ra.bin_counts(ra.alpha_only(px)).withColumn("is_alpha", F.lit(True)))


@query("p12_sixteen_bit", """SELECT l_orderkey, l_linenumber, l_partkey, floor((l_partkey * 31 % 65536) / 256.0::DOUBLE)::INT AS v FROM lineitem""")
def p12(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", ra.to_8bit(F.col("l_partkey") * 31 % 65536).alias("v"))


@query("p13_channel_mode", f"WITH {ALL_COLOUR} SELECT image_id, 'R' AS mode, {STAT_SQL} FROM cpx WHERE ch = 'R' GROUP BY 1 UNION ALL SELECT image_id, 'GRAY', {STAT_SQL} FROM gpx GROUP BY 1")
def p13(spark, d):
    r = colour_tiles(spark, d)
    px = ra.pixels(r).unionByName(ra.gray_samples(r))
    picked = ra.select_channel(px, "R").unionByName(ra.select_channel(px))
    return ra.statistics(ra.bin_counts(picked)).select("image_id", F.col("ch").alias("mode"), "pixel_count", "mean", "std_dev", "min", "max")


@query("p14_plot_series", f"""WITH {TILES_SQL}, c AS (SELECT image_id, v AS bin, count(*) AS n FROM px GROUP BY 1, 2),
h AS (SELECT k.image_id, b.bin::INT AS bin, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT image_id FROM c) k CROSS JOIN range(256) b(bin)
  LEFT JOIN c ON c.image_id = k.image_id AND c.bin = b.bin)
SELECT image_id, bin, n::DOUBLE / max(n) OVER (PARTITION BY image_id) AS height, round(log10(n + 1.0::DOUBLE) / log10(max(n) OVER (PARTITION BY image_id) + 1.0::DOUBLE), 9) AS log_height,
  round_even(n::DOUBLE / 64 * 100 * 100, 0) / 100 AS share_pct FROM h""")
def p14(spark, d):
    h = ra.histogram(ra.pixels(tiles(spark, d)))
    logs = ra.plot_series(h, log_scale=True).select("image_id", "bin", F.round("height", 9).alias("log_height"))
    return ra.plot_series(h).select("image_id", "bin", "height", "share_pct").join(logs, ["image_id", "bin"])


def _point(name, expr, fn):
    @query(name, f"WITH {TILES_SQL} SELECT image_id, y, x, ({expr})::INT AS v FROM px")
    def run(spark, d, fn=fn):
        return fn(ra.pixels(tiles(spark, d))).select("image_id", "y", "x", "v")
    return run


p15 = _point("p15_brightness", "least(255, abs(v - 100))", lambda px: ra.brightness(px, -100))
p16 = _point("p16_contrast", "least(255.0::DOUBLE, round_even(v * 1.7::DOUBLE, 0))", lambda px: ra.contrast(px, 1.7))
p19 = _point("p19_threshold", "CASE WHEN v > 128 THEN 255 ELSE 0 END", lambda px: ra.threshold(px, 128))


@query("p17_channel_isolation", f"""WITH {COLOUR_SQL} SELECT image_id, y, x, ch, CASE WHEN ch = 'G' THEN v ELSE 0 END AS v, false AS plane FROM cpx WHERE ch <> 'A'
UNION ALL SELECT image_id, y, x, ch, v, true FROM cpx WHERE ch = 'R'""")
def p17(spark, d):
    px = ra.pixels(colour_tiles(spark, d))
    return ra.isolate_channel(px, "G").withColumn("plane", F.lit(False)).unionByName(
        ra.isolate_channel(px, "R", single_plane=True).withColumn("plane", F.lit(True)))


@query("p18_hsv", f"""WITH {COLOUR_SQL}, m AS (SELECT *, greatest(r, g, b) AS val, greatest(r, g, b) - least(r, g, b) AS diff FROM rgb),
h AS (SELECT *, CASE WHEN val = r THEN g - b WHEN val = g THEN b - r + 2 * diff ELSE r - g + 4 * diff END AS h0 FROM m),
s AS (SELECT *, floor((h0 * CASE WHEN diff = 0 THEN 0.0::DOUBLE ELSE round_even(737280.0::DOUBLE / (6 * diff), 0) END + 2048) / 4096.0::DOUBLE)::INT AS h1 FROM h)
SELECT image_id, y, x, CASE WHEN h1 < 0 THEN h1 + 180 ELSE h1 END AS h,
  floor((diff * CASE WHEN val = 0 THEN 0.0::DOUBLE ELSE round_even(1044480.0::DOUBLE / val, 0) END + 2048) / 4096.0::DOUBLE)::INT AS s, val AS v FROM s""")
def p18(spark, d):
    return ra.to_hsv(colour_tiles(spark, d))


def mirror(i, n="7"):
    return f"({n} - abs({n} - abs({i})))"


def clamp(i, n="7"):
    return f"least({n}, greatest(0, {i}))"


def conv_sql(kernel, edge=mirror):
    """Neighbour lookup on the tile array, one term per kernel entry."""
    return " + ".join(f"({w}) * a[{edge(f'(y + ({dy}))')} * 8 + {edge(f'(x + ({dx}))')} + 1]" for dy, dx, w in kernel)


GRID_SQL = f"{TILES_SQL}, grid AS (SELECT p.image_id, p.label, p.y, p.x, p.v, t.a FROM px p JOIN tile t USING (image_id))"


def _filter(name, expr, fn):
    @query(name, f"WITH {GRID_SQL} SELECT image_id, y, x, ({expr})::INT AS v FROM grid")
    def run(spark, d, fn=fn):
        return fn(tiles(spark, d)).select("image_id", "y", "x", "v")
    return run


BOX4 = [(dy, dx, 1) for dy in range(-2, 2) for dx in range(-2, 2)]
BOX3 = [(dy, dx, 1) for dy in range(-1, 2) for dx in range(-1, 2)]
G5 = ra.SMALL_GAUSSIAN[5]
GAUSS5 = [(i - 2, j - 2, f"{G5[i] * G5[j]!r}::DOUBLE") for i in range(5) for j in range(5)]


def median_sql(k):
    r = k // 2
    cells = ", ".join(f"a[{clamp(f'(y + ({dy}))')} * 8 + {clamp(f'(x + ({dx}))')} + 1]" for dy in range(-r, r + 1) for dx in range(-r, r + 1))
    return f"list_sort([{cells}])[{k * k // 2 + 1}]"


p20 = _filter("p20_box_blur", f"round_even(({conv_sql(BOX4)})::DOUBLE / 16, 0)", lambda r: ra.box_blur(r, 4))
p21 = _filter("p21_gaussian_blur", f"floor(({conv_sql(GAUSS5)}) + 0.5::DOUBLE)", lambda r: ra.gaussian_blur(r, 4))
p22 = _filter("p22_median_blur", median_sql(5), lambda r: ra.median_blur(r, 5))
p23 = _filter("p23_sharpen", f"least(255, greatest(0, {conv_sql(ra.SHARPEN)}))", ra.sharpen)
p24 = _filter("p24_laplacian", f"least(255, abs({conv_sql(ra.LAPLACE)}))", ra.laplacian)
p28 = _filter("p28_sobel", f"least(255.0::DOUBLE, round_even(sqrt((({conv_sql(ra.SOBEL_X)})::DOUBLE) ** 2 + (({conv_sql(ra.SOBEL_Y)})::DOUBLE) ** 2), 0))", ra.sobel)

LAP_SQL = f"""lap AS (SELECT image_id, sum(l)::DOUBLE / 64 AS m, sum(l * l)::DOUBLE / 64 AS q FROM (SELECT image_id, {conv_sql(ra.LAPLACE)} AS l FROM grid) GROUP BY 1)"""
RES_SQL = f"res AS (SELECT image_id, y, x, abs(v - {median_sql(3)}) AS residual FROM grid)"


@query("p25_laplacian_variance", f"""WITH {GRID_SQL}, {LAP_SQL} SELECT image_id, q - m * m AS laplacian_variance,
  CASE WHEN q - m * m < 50 THEN 'Low Noise (Smooth/Compressed)' WHEN q - m * m < 200 THEN 'Moderate Noise' ELSE 'High Noise / Detailed Texture' END AS level FROM lap""")
def p25(spark, d):
    return ra.laplacian_variance(tiles(spark, d)).withColumn("level", ra.noise_band(F.col("laplacian_variance")))


@query("p26_noise_residual", f"WITH {GRID_SQL}, {RES_SQL} SELECT image_id, y, x, residual, least(255, residual * 8) AS v FROM res")
def p26(spark, d):
    return ra.noise_residual(tiles(spark, d)).drop("ch")


@query("p27_noise_level", f"""WITH {GRID_SQL}, {RES_SQL}, m AS (SELECT image_id, sum(residual)::DOUBLE / count(*) AS noise_level FROM res GROUP BY 1)
SELECT image_id, noise_level, CASE WHEN noise_level < 3 THEN 'Low' WHEN noise_level < 8 THEN 'Moderate' ELSE 'High' END AS noise_rating FROM m""")
def p27(spark, d):
    return ra.noise_level(tiles(spark, d))


def separable_sql(taps):
    """Two-pass weighted mean with repeated edges, in the operator's order of addition."""
    r = len(taps) // 2
    across = " + ".join(f"a[y * 8 + {clamp(f'(x + ({i - r}))')} + 1]::DOUBLE * {w!r}::DOUBLE" for i, w in enumerate(taps))
    down = " + ".join(f"h[{clamp(f'(y + ({i - r}))')} * 8 + x + 1] * {w!r}::DOUBLE" for i, w in enumerate(taps))
    return (f"hp AS (SELECT image_id, list({across} ORDER BY y, x) AS h FROM grid GROUP BY 1), "
            f"acc AS (SELECT g.image_id, g.y, g.x, g.v, {down} AS acc FROM grid g JOIN hp USING (image_id))")


T11, T15 = ra.gaussian_taps(11), ra.gaussian_taps(15)
VIS_SQL = f"""vis AS (SELECT image_id, count(*) FILTER (NOT v > round_even(acc, 0) - 10)::DOUBLE / 64 AS ratio FROM acc GROUP BY 1)"""
VIS_CASE = "CASE WHEN ratio BETWEEN 0.05::DOUBLE AND 0.4::DOUBLE THEN 'Good' WHEN ratio BETWEEN 0.02::DOUBLE AND 0.5::DOUBLE THEN 'Moderate' ELSE 'Poor' END"


@query("p29_adaptive_threshold", f"WITH {GRID_SQL}, {separable_sql(T11)} SELECT image_id, y, x, CASE WHEN v > round_even(acc, 0) - 2 THEN 255 ELSE 0 END AS v FROM acc")
def p29(spark, d):
    return ra.adaptive_threshold(tiles(spark, d), 10, 2).select("image_id", "y", "x", "v")


@query("p29_text_visibility", f"WITH {GRID_SQL}, {separable_sql(T15)}, {VIS_SQL} SELECT image_id, ratio AS text_pixel_ratio, {VIS_CASE} AS text_visibility FROM vis")
def p29_text(spark, d):
    return ra.text_visibility(tiles(spark, d))


@query("p30_area_scale", f"""WITH {TILES_SQL} SELECT image_id, y // 4 AS y, x // 4 AS x, round_even(sum(v)::DOUBLE / count(*), 0)::INT AS v, 4 AS factor FROM px GROUP BY 1, 2, 3
UNION ALL SELECT image_id, y // 2, x // 2, floor((sum(v) + 2) / 4.0::DOUBLE)::INT, 2 FROM px GROUP BY 1, 2, 3""")
def p30(spark, d):
    px = ra.pixels(tiles(spark, d))
    out = ra.area_scale(px, 4).withColumn("factor", F.lit(4)).unionByName(ra.area_scale(px, 2).withColumn("factor", F.lit(2)))
    return out.drop("ch")


@query("p31_error_level", f"WITH {TILES_SQL} SELECT image_id, y, x, least(255, abs(v - (v // 12) * 12) * 10)::INT AS v FROM px")
def p31(spark, d):
    t = tiles(spark, d)
    resaved = t.withColumn("px", F.expr("transform(px, v -> CAST((v DIV 12) * 12 AS SMALLINT))"))
    return ra.error_level(t, resaved).select("image_id", "y", "x", "v")


@query("p31_error_blocks", f"""WITH {TILES_SQL}, e AS (SELECT image_id, y, x, least(255, abs(v - (v // 12) * 12) * 10) AS v FROM px)
SELECT image_id, (y // 4)::INT AS by, (x // 4)::INT AS bx, sum(v)::DOUBLE / count(*) AS mean_level, max(v)::INT AS max_level FROM e GROUP BY 1, 2, 3""")
def p31_blocks(spark, d):
    return ra.block_summary(p31(spark, d), 4)


@query("p32_add_noise", f"""WITH {TILES_SQL}, h AS (SELECT *, md5(concat_ws(':', image_id::VARCHAR, y::VARCHAR, x::VARCHAR, ch, '7')) AS m FROM px),
u AS (SELECT *, (('0x' || substr(m, 1, 8))::BIGINT + 1) / 4294967296::DOUBLE AS a, (('0x' || substr(m, 9, 8))::BIGINT + 1) / 4294967296::DOUBLE AS b FROM h)
SELECT image_id, y, x, ch, trunc(least(255, greatest(0, v + sqrt(-2 * ln(a)) * cos(2 * pi() * b) * 25)))::INT AS v FROM u""")
def p32(spark, d):
    return ra.add_noise(ra.pixels(tiles(spark, d)), 25, seed=7)


@query("p33_resolution_band", """WITH x AS (SELECT p_partkey, p_size * 60000::BIGINT AS n FROM part)
SELECT p_partkey, CASE WHEN n >= 2000000 THEN 'Good' WHEN n >= 500000 THEN 'Low' ELSE 'Very Low' END AS rating,
  CASE WHEN n >= 2000000 THEN 300 WHEN n >= 500000 THEN 150 ELSE 72 END AS dpi FROM x""")
def p33(spark, d):
    n = F.col("p_size").cast("bigint") * 60000
    return table(spark, d, "part").select("p_partkey", ra.resolution_rating(n).alias("rating"), ra.dpi_estimate(n).alias("dpi"))


QUALITY_SQL = f"""{GRID_SQL}, {LAP_SQL}, {RES_SQL}, {separable_sql(T15)}, {VIS_SQL},
sums AS (SELECT image_id, sum(v)::DOUBLE / 64 AS m, sum(v * v)::DOUBLE / 64 AS q FROM grid GROUP BY 1),
nl AS (SELECT image_id, sum(residual)::DOUBLE / 64 AS noise_level FROM res GROUP BY 1),
meas AS (SELECT s.image_id, greatest(0, l.q - l.m * l.m) AS sharpness_score, s.m AS brightness_mean, sqrt(greatest(0, s.q - s.m * s.m)) AS contrast_std,
  noise_level, ratio, sqrt(greatest(0, s.q - s.m * s.m)) AS background_std FROM sums s JOIN lap l USING (image_id) JOIN nl USING (image_id) JOIN vis USING (image_id)),
rated AS (SELECT *, CASE WHEN sharpness_score > 500 THEN 'Good' WHEN sharpness_score > 100 THEN 'Moderate' ELSE 'Poor' END AS sharpness_rating,
  CASE WHEN brightness_mean BETWEEN 80 AND 200 THEN 'Good' WHEN brightness_mean < 80 THEN 'Dark' ELSE 'Bright' END AS brightness_rating,
  CASE WHEN contrast_std > 60 THEN 'Good' WHEN contrast_std > 35 THEN 'Moderate' ELSE 'Poor' END AS contrast_rating,
  CASE WHEN noise_level < 3 THEN 'Low' WHEN noise_level < 8 THEN 'Moderate' ELSE 'High' END AS noise_rating, {VIS_CASE} AS text_visibility,
  CASE WHEN background_std < 15 THEN 'Clean' WHEN background_std < 35 THEN 'Noisy' ELSE 'Uneven' END AS background_quality FROM meas),
issued AS (SELECT *, 2 + CASE sharpness_rating WHEN 'Poor' THEN 2 WHEN 'Moderate' THEN 1 ELSE 0 END + CASE contrast_rating WHEN 'Poor' THEN 1 ELSE 0 END
  + CASE noise_rating WHEN 'High' THEN 1 ELSE 0 END + CASE text_visibility WHEN 'Poor' THEN 2 ELSE 0 END AS issues FROM rated),
ready AS (SELECT *, CASE WHEN issues = 0 THEN 'Good' WHEN issues <= 2 THEN 'Needs Enhancement' ELSE 'Poor' END AS readiness FROM issued)"""


@query("p34_quality_bands", f"WITH {QUALITY_SQL} SELECT image_id, sharpness_rating, brightness_rating, contrast_rating FROM ready")
def p34(spark, d):
    return ra.quality_report(tiles(spark, d)).select("image_id", "sharpness_rating", "brightness_rating", "contrast_rating")


@query("p35_background", f"""WITH {TILES_SQL}, s AS (SELECT image_id, sum(4 * v)::DOUBLE / 256 AS m, sum(4 * v * v)::DOUBLE / 256 AS q FROM px GROUP BY 1)
SELECT image_id, sqrt(greatest(0, q - m * m)) AS background_std,
  CASE WHEN sqrt(greatest(0, q - m * m)) < 15 THEN 'Clean' WHEN sqrt(greatest(0, q - m * m)) < 35 THEN 'Noisy' ELSE 'Uneven' END AS background_quality FROM s""")
def p35(spark, d):
    return ra.background(tiles(spark, d))


@query("p36_readiness", f"WITH {QUALITY_SQL} SELECT image_id, issues, readiness FROM ready")
def p36(spark, d):
    return ra.quality_report(tiles(spark, d)).select("image_id", "issues", "readiness")


@query("p37_preprocessing_plan", f"""WITH {QUALITY_SQL}
SELECT image_id, 'Resolution Enhancement' AS name, true AS applied, 'Very low resolution (8×8)' AS reason FROM ready
UNION ALL SELECT image_id, 'Deskew', false, 'Not Required' FROM ready
UNION ALL SELECT image_id, 'Noise Reduction', noise_rating <> 'Low', CASE WHEN noise_rating = 'Low' THEN 'Not Required'
  ELSE noise_rating || ' noise level (' || printf('%.1f', round_even(noise_level * 10, 0) / 10) || ')' END FROM ready
UNION ALL SELECT image_id, 'Contrast Enhancement', contrast_rating <> 'Good', CASE WHEN contrast_rating = 'Good' THEN 'Not Required'
  ELSE contrast_rating || ' contrast (σ=' || printf('%.1f', round_even(contrast_std * 10, 0) / 10) || ')' END FROM ready
UNION ALL SELECT image_id, 'Brightness Normalization', brightness_rating <> 'Good', CASE brightness_rating WHEN 'Good' THEN 'Not Required'
  WHEN 'Dark' THEN 'Image too dark (mean=' || printf('%.0f', round_even(brightness_mean, 0)) || ')' ELSE 'Image too bright (mean=' || printf('%.0f', round_even(brightness_mean, 0)) || ')' END FROM ready
UNION ALL SELECT image_id, 'Background Normalization', background_quality = 'Uneven', CASE WHEN background_quality = 'Uneven' THEN 'Uneven background detected' ELSE 'Not Required' END FROM ready""")
def p37(spark, d):
    return ra.preprocessing_plan(ra.quality_report(tiles(spark, d))).select("image_id", "name", "applied", "reason")


@query("p38_variant_plan", f"""WITH {QUALITY_SQL} SELECT image_id, unnest(CASE readiness WHEN 'Good' THEN ['Original']
  WHEN 'Poor' THEN ['Mild Enhancement', 'Grayscale + Contrast', 'Denoised'] ELSE ['Mild Enhancement', 'Grayscale + Contrast'] END) AS variant FROM ready""")
def p38(spark, d):
    return ra.variant_plan(ra.quality_report(tiles(spark, d))).select("image_id", "variant")


@query("p39_colour_space", """SELECT vec_id AS image_id, CASE WHEN label % 3 = 0 THEN 'Grayscale' WHEN label % 3 = 1 THEN 'RGB' ELSE 'RGBA' END AS color_space,
  label % 3 = 2 AS has_alpha, 8 AS bit_depth FROM embeddings""")
def p39(spark, d):
    mixed = tiles(spark, d).withColumn("channels", F.expr(
        "CASE label % 3 WHEN 0 THEN array('GRAY') WHEN 1 THEN array('B', 'G', 'R') ELSE array('B', 'G', 'R', 'A') END"))
    return mixed.select("image_id", ra.colour_space(F.col("channels")).alias("c")).select("image_id", "c.*")
