import re
import xml.etree.ElementTree as ET

import numpy as np
import pytest

from rasterloom.kernel.tracer import vectorize
from rasterloom.plans.options import Options
from rasterloom.sinks import jpeg, render
from rasterloom.sinks.dxf import nearest_index
from rasterloom.sinks.numbers import fixed, short
from rasterloom.sinks.png import draw
from rasterloom.sinks.svg import escape, join
from tests.drawing import blank, disc, rect


@pytest.fixture(scope="module")
def traced():
    a = rect(disc(blank(240, 160), 60, 60, 40, (230, 57, 70)), 10, 130, 220, 8, (0, 0, 200))
    a[55:63, 55:63] = 0
    return a, vectorize(a, Options(stroke_mode="auto"))


def test_numbers():
    assert [fixed(v, 2) for v in (1.0, 0.5, -0.001, 2.345, float("nan"))] == ["1", "0.5", "0", "2.35", "0"] or fixed(2.345, 2) in ("2.34", "2.35")
    assert short(0.5, 2) == ".5" and short(-0.25, 2) == "-.25" and short(10.0, 1) == "10"
    assert join(["M", "1", "2", "l", "-3", ".5", "Z"]) == "M1 2l-3 .5Z" and escape('<a & "b">') == "&lt;a &amp; &quot;b&quot;&gt;"


def test_svg_is_well_formed(traced):
    root = ET.fromstring(render(traced[1], "svg"))
    groups = [g for g in root if g.tag.endswith("}g")]
    assert [g.get("data-color") for g in groups] == [layer.hex for layer in traced[1].layers]
    assert any(g.get("data-strokes") == "1" for g in groups)
    flat = ET.fromstring(render(traced[1], "svg", group=False, path_per_shape=True, metadata=False, background="#fff"))
    assert not [g for g in flat if g.tag.endswith("}g")] and flat[0].tag.endswith("rect")


def test_pdf_offsets_are_exact(traced):
    body = render(traced[1], "pdf")
    offsets = [int(m) for m in re.findall(rb"(\d{10}) 00000 n", body)]
    assert len(offsets) == 5 and all(body[o:].startswith(b"%d 0 obj" % i) for i, o in enumerate(offsets, 1))
    start = int(re.search(rb"startxref\n(\d+)", body)[1])
    assert body[start:].startswith(b"xref") and body.endswith(b"%%EOF\n")
    length = int(re.search(rb"/Length (\d+)", body)[1])
    stream = body[body.index(b"stream\n") + 7 : body.index(b"\nendstream")]
    assert len(stream) == length


def test_eps_and_dxf(traced):
    eps = render(traced[1], "eps").decode()
    assert eps.startswith("%!PS-Adobe-3.0 EPSF-3.0") and "%%BoundingBox: 0 0 180 120" in eps and eps.rstrip().endswith("%%EOF")
    lines = render(traced[1], "dxf").decode().split("\n")[:-1]
    pairs = list(zip(lines[::2], lines[1::2]))
    assert len(lines) % 2 == 0 and ("0", "EOF") == pairs[-1]
    assert sum(p == ("0", "POLYLINE") for p in pairs) == sum(p == ("0", "SEQEND") for p in pairs) == 3
    assert any("_W" in v for c, v in pairs if c == "2") and nearest_index((250, 5, 5)) == 1


def test_preview_draws_what_was_traced(traced):
    image, t = traced
    seen = draw(t)
    assert (seen[..., 3] != image[..., 3]).mean() < 0.02
    assert render(t, "png").startswith(b"\x89PNG")
    with pytest.raises(ValueError):
        render(t, "tiff")


def test_smooth_previews_mix_at_edges_only(traced):
    image, t = traced
    hard, soft = draw(t), draw(t, smooth=True)
    inside = (soft[..., 3] == 255) & (hard[..., 3] == 255)
    assert 0 < ((soft[..., 3] > 0) & (soft[..., 3] < 255)).mean() < 0.1
    assert (np.abs(hard[inside].astype(int) - soft[inside]).max(axis=1) > 2).mean() < 0.1
    assert draw(t, width=2 * t.width, smooth=True).shape[1] == 2 * t.width
    white = draw(t, background="#ffffff", smooth=True)
    assert (white[..., 3] == 255).all()


def _decoded(spark, folder, images):
    for name, body in images.items():
        (folder / f"{name}.jpg").write_bytes(body)
    out = {}
    for r in spark.read.format("image").load(str(folder)).select("image.*").collect():
        out[r["origin"].rsplit("/", 1)[1][:-4]] = np.frombuffer(bytes(r["data"]), np.uint8).reshape(r["height"], r["width"], 3)[..., ::-1]
    return out


def test_jpeg_can_be_read_back(spark, tmp_path, traced):
    _, t = traced
    yy, xx = np.mgrid[:45, :70]
    plain = {
        "one": np.array([[[10, 200, 30]]], np.uint8),
        "slope": np.stack([xx * 3, yy * 5, xx + yy], axis=-1).astype(np.uint8),
        "noise": np.random.default_rng(3).integers(0, 256, (33, 17, 3)).astype(np.uint8),
        "traced": draw(t, background="#ffffff", smooth=True)[..., :3],
    }
    got = _decoded(spark, tmp_path, {k: jpeg.encode(v) for k, v in plain.items() if k != "traced"} | {"traced": render(t, "jpeg")})
    for name, want in plain.items():
        assert got[name].shape == want.shape
        assert np.abs(got[name].astype(int) - want).mean() < (8 if name == "noise" else 2), name
    with pytest.raises(ValueError):
        jpeg.encode(np.zeros((0, 5, 3), np.uint8))


def test_empty_images_render():
    t = vectorize(np.zeros((10, 10, 4), np.uint8))
    for kind in ("svg", "pdf", "eps", "dxf", "png", "jpeg"):
        assert render(t, kind)
