"""An interactive session over one image: load, trace, edit, export, reset.

The decoded pixels and the traced geometry stay between calls, so an edit or an export doesn't trace
again; mistakes are answers, not crashes.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from rasterloom.kernel import editing
from rasterloom.kernel.analysis import analyze
from rasterloom.kernel.tracer import Traced, vectorize
from rasterloom.plans.options import resolve
from rasterloom.sinks import render


class Studio:
    def __init__(self) -> None:
        self.reset()

    def reset(self) -> dict:
        self.pixels: np.ndarray | None = None
        self.base: Traced | None = None
        self.current: Traced | None = None
        return {"type": "reset"}

    def load(self, rgba: np.ndarray) -> dict:
        """Take over an (h, w, 4) array and tell what it is."""
        return self._answer("loaded", lambda: self._load(rgba))

    def _load(self, rgba: np.ndarray) -> dict:
        report = analyze(rgba)
        self.reset()
        self.pixels = rgba
        return report

    def trace(self, preset: str = "logo", **overrides) -> dict:
        return self._answer("traced", lambda: self._trace(preset, overrides))

    def _trace(self, preset: str, overrides: dict) -> dict:
        if self.pixels is None:
            raise ValueError("no image is loaded")
        self.base = self.current = vectorize(self.pixels, resolve(preset, overrides))
        return self.summary()

    def edit(self, groups: Sequence[tuple[str, Sequence[str]]] = (), remove: Sequence[str] = (), exact: bool = False) -> dict:
        """Merge and remove colours of the traced image: recoloured as it is, or traced again where ``exact`` and there are merges."""
        return self._answer("edited", lambda: self._edit([(k, list(v)) for k, v in groups], list(remove), exact))

    def _edit(self, groups: list, remove: list, exact: bool) -> dict:
        if self.base is None:
            raise ValueError("nothing is traced")
        if exact and groups:
            self.current = editing.merge_exact(self.pixels, self.base, groups, remove)
        else:
            self.current = editing.merge_fast(self.base, groups, remove)
        return self.summary()

    def export(self, format: str = "svg", **options) -> dict:
        return self._answer("exported", lambda: {"format": format, "body": self._export(format, options)})

    def _export(self, format: str, options: dict) -> bytes:
        if self.current is None:
            raise ValueError("nothing is traced")
        return render(self.current, format, **options)

    def summary(self) -> dict:
        t = self.current
        total = sum(layer.pixels for layer in t.layers) or 1
        return {
            "width": t.width, "height": t.height, **t.stats, "suggestions": editing.suggest_merges(t),
            "layers": [{"hex": layer.hex, "name": layer.name, "pieces": len(layer.shapes), "strokes": len(layer.strokes), "nodes": layer.nodes, "area_share": layer.pixels / total} for layer in t.layers],
        }

    @staticmethod
    def _answer(kind: str, work) -> dict:
        try:
            return {"type": kind, **work()}
        except Exception as e:
            return {"type": "error", "message": str(e) or type(e).__name__}
