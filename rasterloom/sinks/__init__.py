"""Serialisers of traced images: SVG, PDF, EPS, DXF, PNG and JPEG previews."""

from __future__ import annotations

from rasterloom.sinks import dxf, eps, jpeg, pdf, png, svg


def render(traced, kind: str = "svg", **options) -> bytes:
    """The traced image in one of the formats."""
    writers = {"svg": svg.write, "pdf": pdf.write, "eps": eps.write, "dxf": dxf.write, "png": png.preview, "jpeg": jpeg.preview}
    if kind not in writers:
        raise ValueError(f"no writer for {kind!r}")
    out = writers[kind](traced, **options)
    return out if isinstance(out, bytes) else out.encode("utf-8")


def extension(kind: str) -> str:
    return "jpg" if kind == "jpeg" else kind
