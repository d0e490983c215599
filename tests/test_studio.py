"""Folders of image files through the user-facing calls."""

import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rasterloom.plans import studio
from rasterloom.plans.options import NAMES
from rasterloom.plans.report import settings_guide
from rasterloom.sinks.png import encode
from rasterloom.sources.images import decode_base64, discover, from_pixels, pixels, read_images
from tests.drawing import blank, disc, photo, rect


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    art = rect(rect(blank(300, 300), 40, 40, 120, 120, (230, 57, 70)), 60, 180, 140, 80, (0, 0, 200))
    for name in ("a.png", "b.PNG", "nested/a.png", ".hidden/z.png"):
        path = root / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(encode(art))
    (root / "photo.png").write_bytes(encode(photo()))
    (root / "broken.png").write_bytes(b"not an image")
    (root / "notes.txt").write_text("x")
    return str(root)


def test_discovery(spark, folder):
    names = lambda df: [os.path.relpath(r["path"].removeprefix("file:"), folder) for r in df.orderBy("id").collect()]
    assert names(discover(spark, folder)) == ["a.png", "b.PNG", "broken.png", "photo.png"]
    assert names(discover(spark, folder, recursive=True)) == ["a.png", "b.PNG", "broken.png", "nested/a.png", "photo.png"]
    assert len(names(discover(spark, folder, limit=2))) == 2
    with pytest.raises(ValueError):
        discover(spark, folder, [folder])


def test_pixels_survive_the_round_trip(spark, folder):
    px = pixels(read_images(spark, f"{folder}/a.png"))
    assert px.count() == 90_000
    assert px.where("a = 255").groupBy("r", "g", "b").count().orderBy("r").collect()[1][:4] == (230, 57, 70, 14400)


def test_analysis_and_failures_are_rows(spark, folder):
    got = {os.path.basename(r["image_id"]): r for r in studio.analyze(read_images(spark, folder)).collect()}
    assert got["photo.png"]["suitability"] == "poor" and got["a.png"]["suitability"] == "excellent"
    assert got["broken.png"]["status"] == "failed" and got["broken.png"]["reason"]


def test_batch(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    run = lambda **k: {(r["status"], os.path.basename(r["image_id"]), r["reason"]) for r in studio.vectorize_batch(spark, folder, out, recursive=True, **k).collect()}
    dry = run(dry_run=True)
    assert not os.path.exists(out) and sum(s == "ok" for s, *_ in dry) == 2 or len(dry) >= 4
    first = run()
    assert {s for s, n, _ in first if n == "photo.png"} == {"skipped"} and {s for s, n, _ in first if n == "broken.png"} == {"failed"}
    assert sorted(os.path.relpath(os.path.join(d, f), out) for d, _, fs in os.walk(out) for f in fs) == ["a.svg", "b.svg", "nested/a.svg"]
    again = run()
    assert ("skipped", "a.png", "the output exists") in again and not [r for r in again if r[0] == "ok"]
    assert sum(s == "ok" for s, *_ in run(overwrite=True, min_score=0)) >= 3


def test_results_do_not_depend_on_partitions(spark, folder):
    images = read_images(spark, folder).where("data IS NOT NULL")
    cols = ("image_id", "colors", "pieces", "nodes", F.md5("output").alias("digest"))
    results = [sorted(map(tuple, studio.vectorize(images.repartition(n)).select(*cols).collect())) for n in (1, 5)]
    assert results[0] == results[1]


def test_layers_are_nested_rows(spark, folder):
    row = studio.vectorize(read_images(spark, f"{folder}/a.png"), "logo").first()
    assert row["colors"] == 2 and [layer["hex"] for layer in row["layers"]] == ["#e63946", "#0000c8"]
    contour = row["layers"][0]["shapes"][0]["contours"][0]
    assert not contour["is_hole"] and contour["signed_area"] == 14400 and [s["kind"] for s in contour["segments"]] == ["line"] * 4


def test_compare_suggest_refine(spark, folder):
    one = read_images(spark, f"{folder}/a.png")
    assert studio.compare_presets(one, ("logo", "poster")).count() == 2
    (s,) = studio.suggest_merges(one, threshold=100).collect()
    assert (s["keep"], s["absorb"], s["projected_colors"]) == ("#e63946", "#0000c8", 1)
    merged = studio.refine(one, merge=[("#e63946", ["#0000c8"])]).first()
    assert (merged["colors"], merged["pieces"]) == (1, 2)
    gone = studio.refine(one, remove=["#0000c8"]).first()
    assert (gone["colors"], gone["pieces"]) == (1, 1)
    assert "not in the palette" in studio.refine(one, remove=["#123456"]).first()["reason"]


def test_merging_again_brings_no_backdrop_back(spark):
    a = disc(disc(blank(240, 240, (255, 255, 255, 255)), 70, 70, 40, (200, 0, 0)), 170, 170, 40, (180, 0, 40))
    images = from_pixels(spark.createDataFrame([("i", 240, 240, bytearray(a.tobytes()))], "image_id string, width int, height int, data binary"))
    for background, colours in (("auto", 1), ("keep", 2)):
        row = studio.refine(images, merge=[("#c80000", ["#b40028"])], preset="logo", overrides={"background": background, "color_merge_threshold": 0.0}).first()
        assert row["colors"] == colours


def test_base64(spark):
    df = spark.createDataFrame([("data:image/png;base64,aGVsbG8=",), ("aGVsbG8=",), ("",), ("%%%",)], "payload string")
    assert [r["content"] and bytes(r["content"]) for r in decode_base64(df, "payload").collect()] == [b"hello", b"hello", None, None]


def test_sql_functions(spark):
    from rasterloom.functions.registry import register

    names = register(spark)
    assert "rl_hex" in names
    row = spark.sql("SELECT rl_hex(230, 57, 70) h, rl_luma(255, 255, 255) l, rl_epsilon(100) e, round(rl_luminance(255, 255, 255), 6) m").first()
    assert (row["h"], row["l"], row["e"], row["m"]) == ("#e63946", 255.0, 0.0, 1.0)


def test_orientation_of_jpeg_heads():
    from rasterloom.sources.images import exif_orientation, turned
    import numpy as np
    import struct

    def head(order, value):
        tiff = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "IHHHIHHI", 8, 1, 0x0112, 3, 1, value, 0, 0)
        body = b"Exif\0\0" + tiff
        return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda"

    assert [exif_orientation(head(o, v)) for o in "<>" for v in (1, 6, 8)] == [1, 6, 8] * 2
    assert exif_orientation(b"") == exif_orientation(b"\x89PNG") == exif_orientation(head("<", 6)[:20]) == exif_orientation(head("<", 99)) == 1
    a = np.arange(24).reshape(2, 3, 4)
    assert turned(a, 6).shape == (3, 2, 4) and (turned(a, 6)[0, -1] == a[0, 0]).all() and (turned(turned(a, 6), 8) == a).all() and (turned(a, 3) == a[::-1, ::-1]).all()


def test_saved_presets(spark):
    import json

    from rasterloom.operators import presets

    good = {"id": "custom:a", "label": "  Mine ", "options": {"maxColors": 999, "detail": "x", "background": "auto", "strokeMode": "nope", "smoothing": 12.5}, "createdAt": 5}
    bad = [{"id": "a", "label": "x", "options": {"detail": 1}}, {"id": "custom:b", "label": " ", "options": {"detail": 1}}, {"id": "custom:c", "label": "x", "options": {}}, 7, None]
    rows = [("u", json.dumps([good, *bad])), ("v", "{nope"), ("w", '{"a": 1}'), ("x", None), ("y", json.dumps([good | {"id": f"custom:{i}"} for i in range(30)]))]
    got = presets.load(spark.createDataFrame(rows, "user string, json string"), "json", "user").orderBy("user", "position").collect()
    assert [r["user"] for r in got].count("y") == 24 and {r["user"] for r in got} == {"u", "y"}
    o = got[0]["options"]
    assert (got[0]["label"], o["maxColors"], o["detail"], o["background"], o["strokeMode"], o["smoothing"], got[0]["created_at"]) == ("Mine", 256.0, None, "auto", None, 12.5, 5)
    df = presets.load(spark.createDataFrame(rows[:1], "user string, json string")).drop("position")
    assert df.select(presets.describe(F.col("options")).alias("d")).first()["d"] == "256 colors · smoothing 12.5 · background auto"
    new = df.withColumn("id", F.lit("custom:z")).withColumn("label", F.lit("mine")).withColumn("created_at", F.lit(9).cast("bigint"))
    saved = presets.save(df, new).collect()
    assert [(r["id"], r["label"]) for r in saved] == [("custom:z", "mine 2"), ("custom:a", "Mine")]
    assert presets.delete(presets.save(df, new), df.select("id")).count() == 1


def test_reports(spark, folder, tmp_path):
    from rasterloom.plans import report

    assert report.presets(spark).count() == 8
    results = studio.vectorize_batch(spark, folder, str(tmp_path / "o"), dry_run=True)
    text = report.batch_summary(results, folder, 1000.0)
    assert "converted: 2   skipped: 1   failed: 1" in text and "a.png" in text and "Failed (1):" in text
    traced = studio.vectorize(read_images(spark, f"{folder}/a.png"))
    assert [r["hex"] for r in report.layers_report(traced).collect()] == ["#e63946", "#0000c8"]
    assert '"content":"<svg' in report.answers(traced, "svg").first()["answer"] and '"content"' not in report.answers(traced, "svg", 10).first()["answer"]


def test_session():
    from rasterloom.plans.session import Studio

    s = Studio()
    assert s.trace()["type"] == "error" and s.export()["type"] == "error"
    a = rect(rect(blank(200, 200), 20, 20, 80, 80, (230, 57, 70)), 120, 120, 60, 60, (200, 57, 70))
    assert s.load(a)["type"] == "loaded"
    first = s.trace("logo", color_merge_threshold=0.0)
    assert (first["colors"], first["pieces"]) == (2, 2)
    merged = s.edit([("#e63946", ["#c83946"])])
    assert (merged["colors"], merged["pieces"], merged["nodes"]) == (1, 2, first["nodes"])
    assert s.edit([("#e63946", ["#c83946"])], exact=True)["colors"] == 1 and s.export("svg")["body"].startswith(b"<svg")
    assert s.edit(remove=["#c83946"])["pieces"] == 1 and s.load(a[:0])["type"] == "error" and s.reset() == {"type": "reset"}


def test_samples_have_the_expected_verdicts(spark):
    from rasterloom.plans import report
    from rasterloom.sources.samples import sample_images, sample_list

    assert sample_list(spark).count() == 6
    images = sample_images(spark)
    kinds = {r["image_id"]: r for r in studio.analyze(images).collect()}
    assert kinds["photo"]["suitability"] == "poor" and kinds["logo"]["suitability"] == "excellent" and kinds["noisy-logo"]["noise_estimate"] > 0.1 > kinds["logo"]["noise_estimate"]
    assert {r["image_id"]: r["worst"] for r in report.notices(studio.analyze(images)).collect()}["photo"] == "error"
    traced = {r["image_id"]: r for r in studio.vectorize(images, min_score=35).collect()}
    assert traced["photo"]["status"] == "skipped"
    assert (traced["logo"]["colors"], traced["logo"]["dropped_regions"]) == (4, 0) and traced["logo"]["nodes"] < 120 and {"#1d3557", "#f1faee", "#e63946", "#457b9d"} == {x["hex"] for x in traced["logo"]["layers"]}
    assert traced["sticker"]["colors"] == 3 and traced["sticker"]["nodes"] < 200 and "#ffffff" not in {x["hex"] for x in traced["sticker"]["layers"]}
    assert traced["line-art"]["strokes"] >= 4 and abs(traced["line-art"]["median_stroke_width"] - 9) <= 0.5
    assert traced["noisy-logo"]["pieces"] <= 10 and 3 <= traced["noisy-logo"]["colors"] <= 5
    pixel = traced["pixel-art"]
    points = [(s["to"]["x"], s["to"]["y"]) for x in pixel["layers"] for shape in x["shapes"] for c in shape["contours"] for s in c["segments"]]
    assert pixel["colors"] == 3 and all(x == int(x) and y == int(y) for x, y in points)


def test_limits_blanks_and_small_helpers(spark, folder):
    from rasterloom.functions.text import output_bytes
    from rasterloom.operators import editing, presets
    from rasterloom.sources.images import blank as blank_pixels, within_bytes

    got = {os.path.basename(r["image_id"]): r for r in within_bytes(spark, read_images(spark, folder), folder, most=5000).collect()}
    assert got["photo.png"]["data"] is None and "5000" in got["photo.png"]["reason"] and got["a.png"]["data"] is not None
    assert blank_pixels(spark, 7, 3).agg(F.count("p"), F.max("x"), F.max("y"), F.sum("a")).first()[:] == (21, 6, 2, 0)
    one = spark.range(1).select(output_bytes(F.lit("é"), "pdf").alias("p"), output_bytes(F.lit("é"), "svg").alias("s")).first()
    assert bytes(one["p"]) == b"\xe9" and bytes(one["s"]) == "é".encode()
    s = spark.createDataFrame([("#111111", "#222222"), ("#333333", "#444444")], "keep string, absorb string")
    assert editing.pending(s, spark.createDataFrame([("#222222",)], "hex string")).count() == 1
    row = spark.createDataFrame([('[{"id":"custom:a","label":"x","options":{"detail":3},"createdAt":4}]',)], "json string")
    assert presets.load(presets.store(presets.load(row))).select("id", "label", "options.detail", "created_at").first()[:] == ("custom:a", "x", 3.0, 4)


def test_sql_colour_functions_agree_with_columns(spark):
    from rasterloom.functions import color
    from rasterloom.functions.registry import register

    register(spark)
    df = spark.range(0, 2000).selectExpr("cast(id * 61 % 256 as int) r", "cast(id * 37 % 256 as int) g", "cast(id * 11 % 256 as int) b")
    lab = color.rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    both = df.withColumn("lab", lab).withColumn("name", color.color_name(F.col("r"), F.col("g"), F.col("b"))).withColumn("d", color.delta_e2000(F.col("lab"), F.lead("lab").over(Window.orderBy("r", "g", "b"))))
    both = both.withColumn("next", F.lead("lab").over(Window.orderBy("r", "g", "b")))
    bad = both.where("rl_color_name(r, g, b) <> name OR abs(rl_rgb_to_lab(r, g, b).a - lab.a) > 1e-9 OR abs(rl_delta_e2000(lab, next) - d) > 1e-9")
    assert bad.count() == 0


def test_guide_names_every_setting(spark):
    rows = {r["setting"]: r for r in settings_guide(spark).collect()}
    assert set(rows) == set(NAMES) and all(r["advice"] for r in rows.values())
    assert (rows["max_colors"]["least"], rows["max_colors"]["most"], rows["max_colors"]["standard"]) == (1, 256, "8")
    assert rows["stroke_mode"]["choices"] == ["off", "auto", "force"]
