"""File names as a second schema: expressions that make and read them.

Each kind of name has one regular expression with a group for each field; a name is read
by extracting the groups, and a name that doesn't match reads as null fields.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.rle import _let

_MARK = "\x01"  # between fields that are read; no field can hold it
_PRODUCT = r"((?:[a-zA-Z0-9]+_)*[a-zA-Z0-9]+)"
_SCALE = r"((?:sf|gr)[0-9]+p[0-9]+)"
_CLOUD_SCALE = r"((?:(?:sf|gr)[0-9]+p[0-9]+)?(?:_?vs[0-9]+p[0-9]+)?)"


@dataclass(frozen=True)
class NameKind:
    """Name of a file kind: ``pattern`` has a group for each of ``fields``, in order."""

    pattern: str
    fields: tuple[str, ...]

    def matches(self, name: Column) -> Column:
        return name.rlike(self.pattern)

    def field(self, name: Column, field: str) -> Column:
        found = F.regexp_extract(name, self.pattern, self.fields.index(field) + 1)
        return F.when(self.matches(name) & (found != ""), found)

    def split(self, name: Column) -> Column:
        """All fields by one pass of the pattern, null if the name doesn't match; empty fields are ''."""
        groups = "".join(f"${k + 1}{_MARK}" for k in range(len(self.fields)))
        read = F.regexp_replace(name, self.pattern, groups)
        # a name that matches can't be what it is replaced by: its marks aren't in it
        return _let(read, lambda x: F.when(x != name, F.split(x, _MARK)))

    def checked(self, name: Column) -> Column:
        """The name, or an error if it doesn't match."""
        return _let(name, lambda x: F.when(self.matches(x), x).otherwise(F.raise_error(F.concat(F.lit("not a valid name: "), F.coalesce(x, F.lit("null"))))))


# The forms of the names. The newest form of a tile's name comes first.
TILE = NameKind(rf"^{_PRODUCT}_tile_([a-zA-Z0-9]+)_{_SCALE}_(-?[0-9]+)_(-?[0-9]+)_([0-9]+)_([0-9]+)_([0-9]+)\.tif$", ("product", "aoi", "specifier", "col", "row", "width", "height", "tile_id"))
TILE_SIZED = NameKind(rf"^{_PRODUCT}_tile_([a-zA-Z0-9]+)_([0-9]+)_{_SCALE}_([0-9]+)_([0-9]+)\.tif$", ("product", "aoi", "width", "specifier", "col", "row"))
TILE_AOI = NameKind(rf"^{_PRODUCT}_tile_([a-zA-Z0-9]+)_{_SCALE}_([0-9]+)_([0-9]+)\.tif$", ("product", "aoi", "specifier", "col", "row"))
TILE_PLAIN = NameKind(rf"^{_PRODUCT}_tile_{_SCALE}_([0-9]+)_([0-9]+)\.tif$", ("product", "specifier", "col", "row"))
TILES = (TILE, TILE_SIZED, TILE_AOI, TILE_PLAIN)
COCO = NameKind(rf"^{_PRODUCT}_coco_{_SCALE}_([a-zA-Z0-9]+)\.json$", ("product", "specifier", "fold"))
CLOUD_COCO = NameKind(rf"^(.*?)_?pccoco_{_CLOUD_SCALE}_([a-zA-Z0-9]+)\.json$", ("product", "specifier", "fold"))
GEOJSON = NameKind(rf"^{_PRODUCT}_{_SCALE}_([a-zA-Z0-9]+)\.geojson$", ("product", "specifier", "fold"))
GPKG = NameKind(rf"^{_PRODUCT}_{_SCALE}_([a-zA-Z0-9]+)\.gpkg$", ("product", "specifier", "fold"))
AOI_IMAGE = NameKind(rf"^{_PRODUCT}_aoistiles_{_SCALE}\.png$", ("product", "specifier"))
AOI_GPKG = NameKind(rf"^{_PRODUCT}_aoi_{_SCALE}_([a-zA-Z0-9]+)\.gpkg$", ("product", "specifier", "aoi"))
CLOUD_TILE = NameKind(rf"^(.*?)_?pctile_([a-zA-Z0-9]+)_{_CLOUD_SCALE}_([0-9]+)_([0-9]+)\.(ply|las|pcd)$", ("product", "aoi", "specifier", "col", "row", "extension"))


def product_name(stem: Column) -> Column:
    """Lower case with single underscores for blanks and dashes; an error if other marks remain."""
    name = F.regexp_replace(F.lower(F.translate(stem, " -", "__")), "_+", "_")
    name = F.regexp_replace(name, "^_|_$", "")
    return _let(name, lambda x: F.when(x.rlike("^[a-z0-9]+(?:_[a-z0-9]+)*$"), x).otherwise(F.raise_error(F.concat(F.lit("not a product name: "), F.coalesce(stem, F.lit("null"))))))


def strip_extensions(path: Column) -> Column:
    """Base name without any suffix."""
    return F.regexp_extract(F.regexp_extract(path, r"([^/\\]*)$", 1), r"^(\.?[^.]*)", 1)


def _number(x) -> Column:
    """A number as a name spells it: 0.5 as 0p5, 1 as 1p0."""
    text = F.lit(str(float(x))) if isinstance(x, int | float) else x.cast("double").cast("string")
    return F.replace(text, F.lit("."), F.lit("p"))


def specifier(scale_factor=None, ground_resolution=None, voxel_size=None) -> Column:
    """``sf0p5`` or ``gr0p05``, with ``_vs0p1`` for a voxel size; a scale factor of 1 if neither is given."""
    if scale_factor is not None:
        out = F.concat(F.lit("sf"), _number(scale_factor))
    elif ground_resolution is not None:
        out = F.concat(F.lit("gr"), _number(ground_resolution))
    else:
        out = F.lit("sf1p0")
    return out if voxel_size is None else F.concat(out, F.lit("_vs"), _number(voxel_size))


def parse_specifier(spec: Column) -> dict[str, Column]:
    """``scale_factor, ground_resolution, voxel_size`` as nullable doubles."""
    read = lambda key: F.replace(F.regexp_extract(spec, rf"{key}([0-9]+p[0-9]+)", 1), F.lit("p"), F.lit(".")).try_cast("double")
    return {"scale_factor": read("sf"), "ground_resolution": read("gr"), "voxel_size": read("vs")}


def _or_no_aoi(aoi) -> Column:
    return F.coalesce(aoi, F.lit("noaoi")) if isinstance(aoi, Column) else F.lit(aoi or "noaoi")


def tile_name(product: Column, spec: Column, col: Column, row: Column, width: Column, height: Column, tile_id: Column, aoi=None) -> Column:
    return TILE.checked(F.concat(F.concat_ws("_", product, F.lit("tile"), _or_no_aoi(aoi), spec, col, row, width, height, tile_id), F.lit(".tif")))


def parse_tile_name(name: Column) -> dict[str, Column]:
    """Fields of a tile's name in any of its forms; ``noaoi`` reads as null."""
    fields = ("product", "aoi", "specifier", "col", "row", "width", "height", "tile_id")

    def read(kind: NameKind) -> Callable[[Column], Column]:
        """The fields of one kind in one order; sized names are squares."""
        places = {f: i for i, f in enumerate(kind.fields)}
        if kind is TILE_SIZED:
            places["height"] = places["width"]
        return lambda parts: F.when(parts.isNotNull(), F.array(*[F.nullif(parts[places[f]], F.lit("")) if f in places else F.lit(None).cast("string") for f in fields]))

    # the first kind that matches; equal expressions of a select are computed once, so a name is read once for all its fields
    found = F.coalesce(*[_let(k.split(name), read(k)) for k in TILES])
    at = {f: found[i] for i, f in enumerate(fields)}
    out = {"product": at["product"], "aoi": F.when(at["aoi"] != "noaoi", at["aoi"])}
    out |= {f: at[f].cast("int") for f in ("col", "row", "width", "height")}
    out["tile_id"] = at["tile_id"].cast("long")
    spec = parse_specifier(at["specifier"])
    return out | {k: spec[k] for k in ("scale_factor", "ground_resolution")}


def coco_name(product: Column, spec: Column, fold: Column) -> Column:
    return COCO.checked(F.concat(F.concat_ws("_", product, F.lit("coco"), spec, fold), F.lit(".json")))


def cloud_coco_name(product: Column, spec: Column, fold: Column) -> Column:
    return CLOUD_COCO.checked(F.concat(F.concat_ws("_", product, F.lit("pccoco"), spec, fold), F.lit(".json")))


def vector_name(product: Column, spec: Column, fold: Column, extension: str = "geojson") -> Column:
    kind = {"geojson": GEOJSON, "gpkg": GPKG}[extension]
    return kind.checked(F.concat(F.concat_ws("_", product, spec, fold), F.lit(f".{extension}")))


def aoi_image_name(product: Column, spec: Column) -> Column:
    return AOI_IMAGE.checked(F.concat(F.concat_ws("_", product, F.lit("aoistiles"), spec), F.lit(".png")))


def aoi_gpkg_name(product: Column, spec: Column, aoi: Column) -> Column:
    return AOI_GPKG.checked(F.concat(F.concat_ws("_", product, F.lit("aoi"), spec, aoi), F.lit(".gpkg")))


def cloud_tile_name(product: Column, spec: Column, col: Column, row: Column, aoi=None, extension: str = "pcd") -> Column:
    return CLOUD_TILE.checked(F.concat(F.concat_ws("_", product, F.lit("pctile"), _or_no_aoi(aoi), spec, col, row), F.lit(f".{extension}")))


def parse_name(kind: NameKind, name: Column) -> dict[str, Column]:
    """Fields of any other kind of name, its specifier read into numbers."""
    out = {f: kind.field(name, f) for f in kind.fields if f != "specifier"}
    return out | parse_specifier(kind.field(name, "specifier"))
