"""Raster cubes as long pixel tables, built lazily: search, load, mask and scale, composite, indices, postprocess, storage.

A cube is a DataFrame of pixels (item id, y, x, one column per band) and one of items.  Nothing runs before execute();
and execute() returns a DataFrame, so Catalyst prunes bands and pushes the item filter down to the chip table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import raster
from tidemark.operators import scan

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class RasterCube:
    """Every method returns a new cube; steps run in the fixed order of execute()."""

    items: DataFrame
    pixels: DataFrame
    bands: tuple[str, ...]
    item_key: str = "id"
    keys: tuple[str, ...] = ("y", "x")
    nodata: Mapping[str, float] = field(default_factory=dict)
    _mask: dict = field(default_factory=dict)
    _composite: dict = field(default_factory=dict)
    _indices: tuple[str, ...] = ()
    _post: tuple[Step, ...] = ()
    _storage: dict = field(default_factory=dict)

    def search(self, box: scan.Box, start=None, end=None, max_cloud: float | None = None, filter_function: Step | None = None) -> RasterCube:
        found = scan.search_items(self.items, box, start, end, max_cloud)
        return replace(self, items=found.transform(filter_function) if filter_function else found)

    def load(self, bands: Sequence[str] | None = None) -> RasterCube:
        if unknown := [b for b in bands or () if b not in self.pixels.columns]:
            raise ValueError(f"unknown bands: {unknown}")
        return replace(self, bands=tuple(bands or self.bands))

    def mask_and_scale(self, inside: Column | None = None, mask_nodata: bool = True, mask_values: Sequence[float] = (), mask_scene: Sequence[str | int] = (), scale_factor: float | None = None, add_offset: float = 0.0, skip: Sequence[str] = ()) -> RasterCube:
        """Where set: outside of `inside`, nodata, values, scene classes become missing; then bands (but for skip) are unscaled."""
        return replace(self, _mask={"inside": inside, "nodata": mask_nodata, "values": tuple(mask_values), "scene": tuple(mask_scene), "factor": scale_factor, "offset": add_offset, "skip": tuple(skip)})

    def composite(self, method: str = "median", percentile: float = 50.0, custom: Step | None = None) -> RasterCube:
        if method not in ("median", "percentile", "custom") or (method == "custom") != (custom is not None):
            raise ValueError("method must be median, percentile, or custom with a function")
        if not 0 <= percentile <= 100:
            raise ValueError("percentile must be from 0 to 100")
        return replace(self, _composite={"method": method, "q": percentile, "custom": custom})

    def add_spectral_indices(self, names: Sequence[str]) -> RasterCube:
        return replace(self, _indices=(*self._indices, *names))

    def postprocess(self, step: Step) -> RasterCube:
        return replace(self, _post=(*self._post, step))

    def optimize_for_storage(self, scale_factor: float, nodata: int, add_offset: float = 0.0, skip: Sequence[str] = ()) -> RasterCube:
        return replace(self, _storage={"factor": scale_factor, "nodata": nodata, "offset": add_offset, "skip": tuple(skip)})

    def execute(self) -> DataFrame:
        scl = ["SCL"] if self._mask.get("scene") and "SCL" not in self.bands else []
        df = self.pixels.select(self.item_key, *self.keys, *self.bands, *scl).join(self.items.select(self.item_key), self.item_key, "left_semi")
        if self._mask:
            df = self._masked(df).drop(*scl)
        if c := self._composite:
            if c["method"] == "custom":
                df = c["custom"](df)
            elif c["method"] == "median":
                df = raster.composite_median(df, self.bands, self.keys)
            else:
                df = raster.composite_percentile(df, self.bands, c["q"], self.keys)
        if self._indices:
            df = raster.with_indices(df, self._indices, normalize=False)
        for step in self._post:
            df = df.transform(step)
        if s := self._storage:
            left = [b for b in (*self.bands, *self._indices) if b not in s["skip"] and b in df.columns]
            df = df.withColumns({b: raster.scaled(b, s["factor"], s["offset"], s["nodata"]) for b in left})
        return df

    def _masked(self, df: DataFrame) -> DataFrame:
        m = self._mask
        out = {}
        for b in self.bands:
            bad = F.lit(False)
            if m["inside"] is not None:
                bad = bad | ~F.coalesce(m["inside"], F.lit(False))
            if m["nodata"]:
                bad = bad | raster.nodata_mask(b, self.nodata.get(b))
            if m["values"]:
                bad = bad | raster.numeric_mask(b, m["values"])
            if m["scene"]:
                bad = bad | raster.scene_mask(m["scene"])
            value = F.when(~bad, F.col(b))
            out[b] = value if m["factor"] is None or b in m["skip"] else value.cast("double") * m["factor"] + m["offset"]
        return df.withColumns(out)


def dtm(pixels: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Elevation without data is sea: 0."""
    return pixels.withColumns({b: F.coalesce(F.nanvl(F.col(b).cast("double"), F.lit(None).cast("double")), F.lit(0.0)) for b in bands})


def on_chips(df: DataFrame, band: str, kernel: Callable, schema: str, keys: Sequence[str] = ("cube_id",)) -> DataFrame:
    """kernel(key tuple, 2-d array) -> pandas frame, for each chip: chips are small and bounded, so one chip is one group."""
    import numpy as np

    def run(key, pdf):
        chip = np.full((int(pdf.y.max()) + 1, int(pdf.x.max()) + 1), np.nan)
        chip[pdf.y, pdf.x] = pdf[band].astype(float)
        return kernel(key, chip)

    return df.select(*keys, "y", "x", band).groupBy(*keys).applyInPandas(run, schema)
