import numpy as np
import pytest

from rasterloom.kernel import color, palette

#: Published pairs of the CIEDE2000 paper's test data.
PAIRS = (
    ((50.0, 2.6772, -79.7751), (50.0, 0.0, -82.7485), 2.0425),
    ((50.0, 3.1571, -77.2803), (50.0, 0.0, -82.7485), 2.8615),
    ((50.0, -1.3802, -84.2814), (50.0, 0.0, -82.7485), 1.0),
    ((50.0, 0.0, 0.0), (50.0, -1.0, 2.0), 2.3669),
    ((50.0, 2.49, -0.001), (50.0, -2.49, 0.0009), 7.1792),
    ((50.0, 2.5, 0.0), (73.0, 25.0, -18.0), 27.1492),
    ((60.2574, -34.0099, 36.2677), (60.4626, -34.1751, 39.4387), 1.2644),
    ((22.7233, 20.0904, -46.694), (23.0331, 14.973, -42.5619), 2.0373),
    ((2.0776, 0.0795, -1.135), (0.9033, -0.0636, -0.5514), 0.9082),
)


def test_published_differences_in_numpy_and_in_columns(spark):
    from pyspark.sql import functions as F

    from rasterloom.functions.color import delta_e2000

    for p, q, want in PAIRS:
        assert abs(float(color.ciede2000(np.array([p]), np.array([q]))[0]) - want) < 1e-4
    df = spark.createDataFrame([(p, q, w) for p, q, w in PAIRS], "p struct<L:double,a:double,b:double>, q struct<L:double,a:double,b:double>, w double")
    assert df.where(F.abs(delta_e2000(F.col("p"), F.col("q")) - F.col("w")) > 1e-4).count() == 0


def test_lab_and_back(spark):
    from pyspark.sql import functions as F

    from rasterloom.functions.color import color_name, lab_to_rgb, rgb_to_lab

    df = spark.range(0, 4096).selectExpr("cast(id * 61 % 256 as int) r", "cast(id * 37 % 256 as int) g", "cast(id * 11 % 256 as int) b")
    got = df.withColumn("lab", rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))).withColumn("back", lab_to_rgb(F.col("lab"))).withColumn("name", color_name(F.col("r"), F.col("g"), F.col("b"))).toPandas()
    assert all((x.r, x.g, x.b) == tuple(x.back) for x in got.itertuples())
    want = color.lab(got[["r", "g", "b"]].to_numpy())
    assert np.allclose(want, np.array([tuple(v) for v in got.lab]), atol=1e-9)
    assert all(color.name_of((x.r, x.g, x.b)) == x.name for x in got.itertuples())


def test_names_and_hex():
    assert color.name_of((255, 255, 255)) == "White" and color.name_of((0, 0, 0)) == "Black" and color.name_of((255, 0, 0)) == "Vivid Red"
    assert color.rgb_of("#0af") == (0, 170, 255) and color.hex_of((0, 170, 255)) == "#00aaff"
    assert color.distinct_names(["Red", "Blue", "Red"]) == ["Red 1", "Blue", "Red 2"]


def test_assignment_is_decided_by_the_first_pixel_of_a_key():
    pal = np.array([[0, 0, 0], [16, 16, 16]])
    codes = lambda *c: np.array([v << 16 | v << 8 | v for v in c])
    assert palette.assign(codes(0, 16), pal).tolist() == [0, 1]
    # 9 and 14 share a key of five bits a channel; whoever comes first decides for both.
    dark_first, light_first = palette.assign(codes(9, 14), pal), palette.assign(codes(14, 9), pal)
    assert len(set(dark_first)) == len(set(light_first)) == 1


def test_kmeans_is_deterministic_and_merging_keeps_the_heavier_colour():
    rng = np.random.default_rng(1)
    px = rng.integers(0, 256, (20_000, 3))
    codes = px[:, 0] << 16 | px[:, 1] << 8 | px[:, 2]
    assert (palette.kmeans(codes, 6, 1, 6) == palette.kmeans(codes, 6, 1, 6)).all()
    out = palette.merge_similar(np.array([[100, 100, 100], [101, 100, 100], [200, 0, 0]]), np.array([1.0, 5.0, 3.0]), 3)
    assert [101, 100, 100] in out.tolist() and len(out) == 2


def test_generator():
    draw = palette.Mulberry(24301)
    values = [draw() for _ in range(1000)]
    assert all(0 <= v < 1 for v in values) and abs(sum(values) / 1000 - 0.5) < 0.05


def test_palettes_beyond_their_limit_are_refused(spark):
    from rasterloom.operators import pixels

    palette = lambda n: spark.range(n).selectExpr("cast(id as int) idx", "cast(id % 256 as int) r", "cast(id div 256 as int) g", "0 b")
    colors = spark.createDataFrame([(7, 0, 0), (255, 0, 0)], "r int, g int, b int")
    assert {r["r"]: r["label"] for r in pixels.nearest_entry(colors, palette(256), "r").collect()} == {7: 7, 255: 255}
    with pytest.raises(Exception, match="at most 256"):
        pixels.nearest_entry(colors, palette(300), "r").collect()
