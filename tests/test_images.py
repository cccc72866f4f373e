"""Scan, decode, histogram and filter files and pixel fixtures."""

import pytest
from pyspark.sql import functions as F

from tests.make_files import png
from vellumine.operators import raster as ra
from vellumine.plans import flows
from vellumine.sources import files as sf, sinks


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("evidence")
    (root / "sub").mkdir()
    (root / "rgb.png").write_bytes(png(100, 100, lambda y, x: (100, 0, 0) if y < 50 else (0, 200, 0)))
    (root / "rgba.png").write_bytes(png(100, 100, lambda y, x: (50, 150, 250, 128), 4))
    (root / "sub" / "gray.PNG").write_bytes(png(100, 100, lambda y, x: (0,) if y < 50 else (255,), 1))
    (root / "notes.txt").write_text("not evidence")
    (root / "noext").write_text("not evidence")
    return str(root)


def test_scan_keeps_supported_files(spark, folder):
    found = sf.evidence_scan(spark, folder)
    assert "content" not in found.columns
    facts = {r.file_name: r for r in sf.file_facts(found).collect()}
    assert set(facts) == {"rgb.png", "rgba.png", "gray.PNG"}
    assert facts["gray.PNG"].file_type == "PNG" and facts["gray.PNG"].mime_type == "image/png"


def test_listing_does_not_read_content(spark, folder):
    plan = sf.file_facts(sf.evidence_scan(spark, folder, listing="driver"))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_files_are_listed_and_read_in_tasks(spark, tmp_path, monkeypatch):
    deep = tmp_path / "flat" / "a" / "b" / "c" / "d"
    deep.mkdir(parents=True)
    (tmp_path / "empty").mkdir()
    for i in range(3000):
        (tmp_path / "flat" / f"{i}.png").write_bytes(bytes([i % 256]) * (i % 5))
    (deep / ".hidden é.png").write_bytes(b"xyz")
    (deep / "no.txt").write_text("no")
    files = sf.list_files(spark, str(tmp_path))
    assert files.count() == 3002 and files.where("length = 0").count() == 600
    monkeypatch.setattr(sf, "TASK_BYTES", 100)
    for root in (str(tmp_path), f"file://{tmp_path}/", f"file:{tmp_path}"):
        read = sf.evidence_scan(spark, root, content=True)
        assert read.rdd.getNumPartitions() > 8
    rows = read.withColumn("part", F.spark_partition_id()).collect()
    assert len(rows) == 3001 and all(r.length == len(r.content) for r in rows) and len({r.part for r in rows}) > 8
    assert {r.path for r in rows} >= {f"file:{tmp_path}/flat/7.png", f"file:{deep}/.hidden é.png"}
    # the same paths and times as Spark's own source
    spark_rows = {(r.path, r.modificationTime, r.length) for r in sf.evidence_scan(spark, str(tmp_path), listing="driver").collect()}
    assert spark_rows == {(r.path, r.modificationTime, r.length) for r in rows if r.length and "hidden" not in r.path}
    assert sf.evidence_scan(spark, str(tmp_path / "empty"), content=True).count() == 0
    with pytest.raises(FileNotFoundError):
        sf.list_files(spark, str(tmp_path / "absent"))


def test_files_gone_after_the_listing_are_left_out(spark, tmp_path):
    for name in ("a.png", "b.png"):
        (tmp_path / name).write_bytes(b"1")
    files = sf.list_files(spark, str(tmp_path))
    (tmp_path / "a.png").unlink()
    (tmp_path / "b.png").write_bytes(b"22")
    assert [(r.path.rsplit("/", 1)[1], r.length, bytes(r.content)) for r in sf.read_files(files).collect()] == [("b.png", 2, b"22")]


@pytest.fixture(scope="module")
def images(spark, folder):
    return sf.decoded_images(spark, folder).withColumn("image_id", F.regexp_extract("image_id", r"([^/]+)$", 1)).cache()


def test_every_channel_sums_to_the_pixel_count(spark, images):
    parts = flows.histogram_examination(images)
    rows = parts["invariant"].collect()
    assert len(rows) == 3 and all(r.invariant_passed and r.total_pixels == 10_000 for r in rows)
    ends = parts["histogram"].where("bin = 255").collect()
    assert all(abs(r.cdf_pct - 100) < 1e-9 for r in ends)
    falling = parts["histogram"].alias("a").join(
        parts["histogram"].alias("b"), (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.ch") == F.col("b.ch")) & (F.col("a.bin") + 1 == F.col("b.bin")))
    assert falling.where("b.cdf_pct < a.cdf_pct").count() == 0


def test_colour_counts(images):
    counts = {(r.ch, r.bin): r.n for r in ra.bin_counts(ra.pixels(images.where("image_id = 'rgb.png'"))).collect()}
    assert counts == {("R", 100): 5000, ("R", 0): 5000, ("G", 200): 5000, ("G", 0): 5000, ("B", 0): 10000}


def test_alpha_is_apart(images):
    px = ra.pixels(images.where("image_id = 'rgba.png'"))
    assert [(r.bin, r.n) for r in ra.bin_counts(ra.alpha_only(px)).collect()] == [(128, 10000)]
    assert {r.ch: r.bin for r in ra.bin_counts(ra.colour_only(px)).collect()} == {"R": 50, "G": 150, "B": 250}


def test_clipping_and_tones(images):
    counts = ra.bin_counts(ra.gray_samples(images.where("image_id = 'gray.PNG'")))
    clip = ra.clipping(counts).first()
    assert (clip.black_count, clip.white_count, clip.black_pct, clip.white_pct) == (5000, 5000, 50.0, 50.0)
    tone = ra.tonal_split(counts).first()
    assert (tone.shadows_count, tone.midtones_count, tone.highlights_count) == (5000, 0, 5000)


def test_invariant_failure_is_explained(spark):
    counts = spark.createDataFrame([("a", "R", 3, 5)], "image_id string, ch string, bin int, n long")
    sizes = spark.createDataFrame([("a", 3, 2)], "image_id string, width int, height int")
    row = ra.histogram_invariant(counts, sizes).first()
    assert not row.invariant_passed and "R=5" in row.invariant_notes


def test_histogram_sinks(spark, images, tmp_path):
    parts = flows.histogram_examination(images)
    sinks.write_histogram_csv(parts["histogram"], str(tmp_path / "csv"), images.select("image_id", "width", "height"))
    back = spark.read.option("header", "true").csv(str(tmp_path / "csv" / "counts"))
    assert back.columns == ["image_id", "Intensity", "Red_Count", "Green_Count", "Blue_Count", "Grayscale_Count"]
    assert back.where("image_id = 'rgb.png'").count() == 256
    lines = sinks.histogram_report(parts["statistics"], parts["clipping"], parts["tonal"])
    sinks.write_text_report(lines, str(tmp_path / "txt"), "image_id")
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "txt")).collect())
    assert "gray.PNG\tBlack Clipping      : 5,000 pixels (50.0%)" in text


def random_raster(spark, height, width, channels=("GRAY",)):
    import random

    rnd = random.Random(5)
    px = [rnd.randrange(256) for _ in range(height * width * len(channels))]
    return px, spark.createDataFrame([("a", height, width, list(channels), px)],
                                     "image_id string, height int, width int, channels array<string>, px array<smallint>")


FILTERS = {
    "sharpen": ra.sharpen, "median": lambda r: ra.median_blur(r, 3), "gauss": lambda r: ra.gaussian_blur(r, 7),
    "box": lambda r: ra.box_blur(r, 4), "sobel": ra.sobel, "adaptive": lambda r: ra.adaptive_threshold(r, 11, 2),
}


@pytest.mark.parametrize("name", list(FILTERS))
def test_bands_give_the_same_result_as_the_whole_image(spark, name):
    _, raster = random_raster(spark, 37, 11, ("B", "G", "R"))
    whole = FILTERS[name](raster)
    cut = FILTERS[name](ra.to_bands(raster, lines=9, halo=8))
    cols = ["image_id", "y", "x", "ch", "v"]
    assert sorted(map(tuple, whole.select(cols).collect())) == sorted(map(tuple, cut.select(cols).collect()))


def test_quality_report_of_bands_matches(spark):
    _, raster = random_raster(spark, 40, 30)
    whole, cut = ra.quality_report(raster).first(), ra.quality_report(ra.to_bands(raster, 16, 8)).first()
    assert whole.asDict() == cut.asDict()


def brute(px, h, w, fn, border):
    def at(y, x):
        if border == "mirror":
            y, x = (h - 1) - abs((h - 1) - abs(y)), (w - 1) - abs((w - 1) - abs(x))
        else:
            y, x = min(h - 1, max(0, y)), min(w - 1, max(0, x))
        return px[y * w + x]
    return {(y, x): fn(lambda dy, dx: at(y + dy, x + dx)) for y in range(h) for x in range(w)}


def test_filters_against_brute_force(spark):
    px, raster = random_raster(spark, 12, 9)
    got = lambda df: {(r.y, r.x): r.v for r in df.collect()}
    near = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    assert got(ra.median_blur(raster, 3)) == brute(px, 12, 9, lambda a: sorted(a(*o) for o in near)[4], "replicate")
    assert got(ra.box_blur(raster, 3)) == brute(px, 12, 9, lambda a: round(sum(a(*o) for o in near) / 9), "mirror")
    assert got(ra.sharpen(raster)) == brute(
        px, 12, 9, lambda a: max(0, min(255, 5 * a(0, 0) - a(-1, 0) - a(1, 0) - a(0, -1) - a(0, 1))), "mirror")
    taps = ra.SMALL_GAUSSIAN[3]
    smooth = brute(px, 12, 9, lambda a: int(sum(taps[i + 1] * taps[j + 1] * a(i, j) for i, j in near) + 0.5), "mirror")
    assert got(ra.gaussian_blur(raster, 3)) == smooth


def test_pixels_round_trip(spark):
    px, raster = random_raster(spark, 70, 5, ("B", "G", "R"))
    back = ra.from_pixels(ra.pixels(raster), lines=64)
    assert back.count() == 2
    assert sorted(map(tuple, ra.pixels(back).collect())) == sorted(map(tuple, ra.pixels(raster).collect()))


def test_one_pixel_image(spark):
    raster = spark.createDataFrame([("a", 1, 1, ["GRAY"], [7])], "image_id string, height int, width int, channels array<string>, px array<smallint>")
    assert ra.sharpen(raster).first().v == 7 and ra.gaussian_blur(raster, 5).first().v == 7


def test_noise_is_clipped(spark):
    _, raster = random_raster(spark, 20, 20)
    row = ra.add_noise(ra.pixels(raster), 200, 1).agg(F.min("v"), F.max("v")).first()
    assert row[0] == 0 and row[1] == 255


def test_hsv_of_known_colours(spark):
    raster = spark.createDataFrame([("a", 1, 4, ["B", "G", "R"], [0, 0, 255, 0, 255, 0, 255, 0, 0, 128, 128, 128])],
                                   "image_id string, height int, width int, channels array<string>, px array<smallint>")
    rows = {r.x: (r.h, r.s, r.v) for r in ra.to_hsv(raster).collect()}
    assert rows == {0: (0, 255, 255), 1: (60, 255, 255), 2: (120, 255, 255), 3: (0, 0, 128)}


def test_colour_space_labels(spark):
    df = spark.createDataFrame([(["GRAY"], 8), (["GRAY"], 16), (["GRAY", "A"], 8), (["B", "G", "R"], 8), (["B", "G", "R", "A"], 8)], "c array<string>, b int")
    got = [tuple(r[0]) for r in df.select(ra.colour_space(F.col("c"), F.col("b"))).collect()]
    assert got == [("Grayscale", False, 8), ("16-bit Grayscale", False, 16), ("LA (Grayscale + Alpha)", True, 8), ("RGB", False, 8), ("RGBA", True, 8)]


def test_error_level_on_bands(spark):
    _, raster = random_raster(spark, 20, 3)
    other = raster.withColumn("px", F.expr("transform(px, v -> CAST((v DIV 7) * 7 AS SMALLINT))"))
    key = lambda df: sorted(map(tuple, df.select("image_id", "y", "x", "ch", "v").collect()))
    whole, bands = key(ra.error_level(raster, other)), lambda r: ra.to_bands(r, lines=6, halo=2)
    assert whole == key(ra.error_level(bands(raster), other)) == key(ra.error_level(raster, bands(other))) == key(ra.error_level(bands(raster), bands(other)))


def test_filter_beyond_the_halo_raises(spark):
    _, raster = random_raster(spark, 30, 4)
    assert ra.gaussian_blur(ra.to_bands(raster, lines=10, halo=3), 7).count() == ra.gaussian_blur(raster, 7).count()
    with pytest.raises(Exception, match="reaches 4 lines"):
        ra.gaussian_blur(ra.to_bands(raster, lines=10, halo=3), 9).count()


def test_noise_does_not_depend_on_partitions(spark):
    _, raster = random_raster(spark, 9, 9)
    px = ra.pixels(raster)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(ra.add_noise(px, 25, 3)) == key(ra.add_noise(px.repartition(5, "x"), 25, 3)) != key(ra.add_noise(px, 25, 4))


def test_histogram_lines_take_one_grouping_of_bounded_tasks(spark, sf_dir):
    from vellumine.plans.catalogue import QUERIES

    lines = QUERIES["s07_histogram_csv"](spark, sf_dir)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("HashAggregate") == 2
    counted = spark.createDataFrame([(1, "R", 5, 2), (1, "R", 5, 3), (1, "GRAY", 5, 7), (1, "A", 6, 1), (2, "B", 0, 4)], "image_id long, ch string, bin int, n long")
    assert sorted(tuple(r) for r in sinks.histogram_table(counted).collect()) == [(1, 5, 5, 0, 0, 7), (1, 6, 0, 0, 0, 0), (2, 0, 0, 0, 4, 0)]
    small = spark.range(0, 4000, 1, 2).selectExpr("id AS image_id", "8 AS height", "8 AS width", "array('R', 'G') AS channels")
    large = spark.range(0, 40, 1, 2).selectExpr("id AS image_id", "4000 AS height", "6000 AS width", "array('R', 'G') AS channels")
    assert ra.spread_bins(small, 1 << 15).rdd.getNumPartitions() == 16  # 128 bins each
    assert ra.spread_bins(large, 1 << 15).rdd.getNumPartitions() == 2 and ra.spread_bins(small.limit(0)).count() == 0
