"""Ingest: crawler lines into paths and metadata, last one wins; projections of documents; file-name rules."""

from __future__ import annotations

import json
import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths, times
from ..model import clean_name

LINE = T.StructType([T.StructField(c, T.StringType()) for c in ("in_path", "in_type", "in_json")])
AXIS = "struct<name:string,params:array<double>,strides:array<int>,shape:array<int>,grid:string>"
DATASET = (
    "struct<ds_name:string,namespace:string,array_type:string,srs:string,geo_transform:array<double>,timestamps:array<string>,"
    f"polygon:string,means:array<double>,sample_counts:array<int>,nodata:double,axes:array<{AXIS}>>"
)
DOCUMENT = f"struct<filename:string,file_type:string,geo_metadata:array<{DATASET}>>"

#: Patterns of file names, the first that matches wins. Fields are named groups.
PATTERNS = (
    ("landsat", r"LC(?P<mission>\d)(?P<path>\d\d\d)(?P<row>\d\d\d)(?P<year>\d\d\d\d)(?P<julian_day>\d\d\d)(?P<processing_level>[a-zA-Z0-9]+)_(?P<band>[a-zA-Z0-9]+)"),
    ("modis43A4", r"^LHTC_(?P<year>\d\d\d\d)(?P<julian_day>\d\d\d).(?P<horizontal>h\d\d)(?P<vertical>v\d\d).(?P<resolution>\d\d\d).[0-9]+"),
    ("lhtc", r"^COMPOSITE_(?P<namespace>LOW|HIGH).+_PER_20.nc$"),
    ("modis1", r"^(?P<product>MCD\d\d[A-Z]\d).A(?P<year>\d\d\d\d)(?P<julian_day>\d\d\d).(?P<horizontal>h\d\d)(?P<vertical>v\d\d).(?P<resolution>\d\d\d).[0-9]+"),
    ("modis-fc", r"^(?P<product>FC).v302.(?P<collection>MCD43A4).h(?P<horizontal>\d\d)v(?P<vertical>\d\d).(?P<year>\d\d\d\d).(?P<resolution>\d\d\d).(?P<namespace>[A-Z0-9]+).jp2$"),
    ("modis2", r"M(?P<satellite>[OD|YD])(?P<product>[0-9]+_[A-Z0-9]+).A[0-9]+.[0-9]+.(?P<collection_version>\d\d\d).(?P<year>\d\d\d\d)(?P<julian_day>\d\d\d)(?P<hour>\d\d)(?P<minute>\d\d)(?P<second>\d\d)"),
    ("modisJP", r"^(?P<product>FC).v302.(?P<root_product>MCD\d\d[A-Z]\d).h(?P<horizontal>\d\d)v(?P<vertical>\d\d).(?P<year>\d\d\d\d).(?P<resolution>\d\d\d)."),
    ("sentinel2", r"^T(?P<zone>\d\d)(?P<sensor>[A-Z]+)_(?P<year>\d\d\d\d)(?P<month>\d\d)(?P<day>\d\d)T(?P<hour>\d\d)(?P<minute>\d\d)(?P<second>\d\d)_(?P<namespace>B\d\d).jp2$"),
    ("modisJP_LR", r"^(?P<product>FC_LR).v302.(?P<root_product>MCD\d\d[A-Z]\d).h(?P<horizontal>\d\d)v(?P<vertical>\d\d).(?P<year>\d\d\d\d).(?P<resolution>\d\d\d)."),
    ("himawari8", r"^(?P<year>\d\d\d\d)(?P<month>\d\d)(?P<day>\d\d)(?P<hour>\d\d)(?P<minute>\d\d)(?P<second>\d\d)-P1S-(?P<product>ABOM[0-9A-Z_]+)-PRJ_GEOS141_(?P<resolution>\d+)-HIMAWARI8-AHI"),
    ("agdc_landsat1", r"LS(?P<mission>\d)_(?P<sensor>[A-Z]+)_(?P<correction>[A-Z]+)_(?P<epsg>\d+)_(?P<x_coord>-?\d+)_(?P<y_coord>-?\d+)_(?P<year>\d\d\d\d)."),
    ("elevation_ga", r"^Elevation_1secSRTM_DEMs_v1.0_DEM-S_Tiles_e(?P<longitude>\d+)s(?P<latitude>\d+)dems.nc$"),
    ("chirps2.0", r"^(?P<namespace>chirps)-v2.0.(?P<year>\d\d\d\d).dekads.nc$"),
    ("era-interim", r"^(?P<namespace>[a-z0-9]+)_(?P<accum>\dhrs)_ERAI_historical_(?P<levels>[a-z\-]+)_(?P<start_year>\d\d\d\d)(?P<start_month>\d\d)(?P<start_day>\d\d)_(?P<end_year>\d\d\d\d)(?P<end_month>\d\d)(?P<end_day>\d\d).nc$"),
    ("agdc_landsat2", r"LS(?P<mission>\d)_OLI_(?P<sensor>[A-Z]+)_(?P<product>[A-Z]+)_(?P<epsg>\d+)_(?P<x_coord>-?\d+)_(?P<y_coord>-?\d+)_(?P<year>\d\d\d\d)."),
    ("agdc_dem", r"SRTM_(?P<product>[A-Z]+)_(?P<x_coord>-?\d+)_(?P<y_coord>-?\d+)_(?P<year>\d\d\d\d)(?P<month>\d\d)(?P<day>\d\d)(?P<hour>\d\d)(?P<minute>\d\d)(?P<second>\d\d)"),
    ("sentinel2_ard_nbar_nbart", r"_(?P<year>\d\d\d\d)(?P<month>\d\d)(?P<day>\d\d)T(?P<hour>\d\d)(?P<minute>\d\d)(?P<second>\d\d).*_(?P<namespace>NBART?[\w\d_]+)\.TIF"),
    ("sentinel2_ard_qa_supp", r"_(?P<year>\d\d\d\d)(?P<month>\d\d)(?P<day>\d\d)T(?P<hour>\d\d)(?P<minute>\d\d)(?P<second>\d\d)_.+0\d_(?P<namespace>[\w\d_]+)\.TIF"),
    ("barra", r"(?P<year>\d\d\d\d)(?P<month>\d\d)(?P<day>\d\d)T(?P<hour>\d\d)(?P<minute>\d\d)Z\.nc"),
    ("ereef", r"roms"),
    ("default", r".+"),
)



class Rule(NamedTuple):
    """How a collection's files are named, and what goes for them besides what they say themselves.

    ``namespace`` says where variable names come from: the file name (``path``), the raster (``dataset``) or both
    (``combine``). ``box`` is (left, top, right, bottom). ``x_places`` and ``y_places`` are (pattern, template) of the
    rasters that hold each pixel's place; ``{field}`` in a template is a named group of the pattern.
    """

    name: str
    pattern: str
    namespace: str = "dataset"
    full_path: bool = False
    srs: str | None = None
    box: tuple[float, float, float, float] | None = None
    x_places: tuple[str, str] | None = None
    y_places: tuple[str, str] | None = None


#: What some rules say besides their patterns.
_NAMED_BY_PATH = ("modis-fc", "sentinel2", "chirps2.0", "era-interim", "sentinel2_ard_nbar_nbart", "sentinel2_ard_qa_supp")
_EXTRA = {
    "lhtc": {"namespace": "combine"},
    "ereef": {"box": (-180.0, 90.0, 180.0, -90.0), "x_places": ("(?P<filename>.*)", 'NETCDF:"{filename}":lon_v'), "y_places": ("(?P<filename>.*)", 'NETCDF:"{filename}":lat_v')},
    **{n: {"namespace": "path"} for n in _NAMED_BY_PATH},
}
RULES = tuple(Rule(n, p, **_EXTRA.get(n, {})) for n, p in PATTERNS)

#: Pixel types of bands that aren't Byte.
BAND_TYPES = {
    "Int16": (
        "nbar_blue",
        "nbar_coastal_aerosol",
        "nbar_green",
        "nbar_nir_1",
        "nbar_nir_2",
        "nbar_red",
        "nbar_red_edge_1",
        "nbar_red_edge_2",
        "nbar_red_edge_3",
        "nbar_swir_2",
        "nbar_swir_3",
        "nbart_blue",
        "nbart_coastal_aerosol",
        "nbart_green",
        "nbart_nir_1",
        "nbart_nir_2",
        "nbart_red",
        "nbart_red_edge_1",
        "nbart_red_edge_2",
        "nbart_red_edge_3",
        "nbart_swir_2",
        "nbart_swir_3",
    ),
    "Float32": (
        "azimuthal_exiting",
        "azimuthal_incident",
        "exiting",
        "incident",
        "relative_azimuth",
        "relative_slope",
        "satellite_azimuth",
        "satellite_view",
        "solar_azimuth",
        "solar_zenith",
        "timedelta",
    ),
}


def lines(text: DataFrame, column: str = "value") -> DataFrame:
    """Crawler lines (path, type, document between tabs) as columns."""
    parts = F.split(F.col(column), "\t", 3)
    return text.select(*(F.get(parts, F.lit(i)).alias(f.name) for i, f in enumerate(LINE.fields)))


def latest(rows: DataFrame, key: list[str], stamp: str) -> DataFrame:
    """One row per key, the newest: an upsert as one aggregation that combines before the shuffle."""
    others = [c for c in rows.columns if c not in key]
    ordered = F.struct(F.col(stamp).alias("__at"), *(F.col(c) for c in others if c != stamp))
    best = rows.groupBy(*key).agg(F.max(ordered).alias("r"))
    return best.select(*key, F.col("r.__at").alias(stamp), *(F.col(f"r.{c}").alias(c) for c in others if c != stamp)).select(*rows.columns)


def merge(stored: DataFrame, staged: DataFrame, key: list[str], stamp: str) -> DataFrame:
    """``stored`` with ``staged`` rows put over it by ``key``."""
    return latest(stored.unionByName(staged), key, stamp)


def staged_paths(ingested: DataFrame, stamp: str = "ingested") -> DataFrame:
    """Paths of ingested lines with hash and ancestors, one row each."""
    own = ingested.select(
        paths.path_hash(F.col("in_path")).alias("pa_hash"), F.col(stamp).alias("pa_ingested"), F.col("in_type").alias("pa_type"), F.col("in_path").alias("pa_path"), paths.ancestor_hashes(F.col("in_path")).alias("pa_parents")
    )
    return latest(own, ["pa_hash"], "pa_ingested")


def datasets(documents: DataFrame, json: str, names: list[str] | None = None) -> DataFrame:
    """One row per dataset of a file's document, with safe names, filtered by them."""
    parsed = documents.select("path", F.explode(F.from_json(F.col(json), DOCUMENT)["geo_metadata"]).alias("d"))
    out = parsed.select("path", "d.*").withColumn("namespace", clean_name(F.col("namespace")))
    return out.where(F.col("namespace").isin(names)) if names else out


def attribute(json: Column, name: str, kind: str = "string") -> Column:
    """A header attribute, null where it is missing or doesn't read as ``kind``."""
    text = F.get_json_object(json, f"$.{name}")
    if kind == "timestamp":
        return F.try_to_timestamp(text).cast("timestamp_ntz")
    return text if kind == "string" else text.try_cast(kind)


def _java(pattern: str) -> str:
    return re.sub(r"\(\?P<\w+>", "(", pattern)


def read_rules(text: str) -> tuple[Rule, ...]:
    """A user's own rules from JSON: ``{"rule_sets": [{"collection", "pattern", "namespace", "match_full_path", "srs_text", "bbox", "geo_loc"}]}``."""
    out = []
    for i, r in enumerate(json.loads(text)["rule_sets"]):
        style, box, at = r.get("namespace", "ns_dataset").removeprefix("ns_"), r.get("bbox"), r.get("geo_loc") or {}
        if style not in ("path", "dataset", "combine"):
            raise ValueError(f"no namespace {style}")
        if box is not None and len(box) != 4:
            raise ValueError("a box is left, top, right and bottom")
        x, y = ((at[f"{a}_dataset_pattern"], re.sub(r"\{\{\s*\.(\w+)\s*\}\}", r"{\1}", at[f"{a}_dataset_template"])) if at else None for a in "xy")
        out.append(Rule(r.get("collection") or f"rule{i}", r["pattern"], style, bool(r.get("match_full_path")), r.get("srs_text") or None, tuple(box) if box else None, x, y))
    names = [r.name for r in out]
    if len(set(names)) < len(names):
        raise ValueError("two rules have one name")
    return tuple(out)


def _seen(rule: Rule, name: Column, path: Column | None) -> Column:
    if rule.full_path and path is None:
        raise ValueError(f"rule {rule.name} is about whole paths")
    return path if rule.full_path else name


def matched_rule(name: Column, path: Column | None = None, rules: tuple[Rule, ...] = RULES) -> Column:
    """The first rule whose pattern the file name (or, if it says so, the whole path) matches; null if there is none."""
    return F.coalesce(*(F.when(_seen(r, name, path).rlike(_java(r.pattern)), F.lit(r.name)) for r in rules))


def rule_field(name: Column, rule: Column, field: str, path: Column | None = None, rules: tuple[Rule, ...] = RULES) -> Column:
    """A named field of the matched rule, null where the rule has none."""
    cases = []
    for known in rules:
        groups = re.findall(r"\(\?P<(\w+)>", known.pattern)
        if field in groups:
            cases.append(F.when(rule == known.name, F.regexp_extract(_seen(known, name, path), _java(known.pattern), groups.index(field) + 1)))
    return F.coalesce(*cases) if cases else F.lit(None).cast("string")


def name_time(name: Column, rule: Column, path: Column | None = None, rules: tuple[Rule, ...] = RULES) -> Column:
    """The time in a file name by its rule's fields."""
    fields = [rule_field(name, rule, f, path, rules).try_cast("int") for f in ("year", "julian_day", "month", "day", "hour", "minute", "second")]
    return times.from_name(*fields)


def variable_name(by_path: Column, by_dataset: Column, rule: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """A variable's name from the file name, the raster, or both with a colon, as the rule says."""
    styles = {s: [r.name for r in rules if r.namespace == s] for s in ("path", "combine")}
    both = F.concat(F.coalesce(by_path, F.lit("")), F.lit(":"), F.coalesce(by_dataset, F.lit("")))
    return F.when(rule.isin(styles["path"]), by_path).when(rule.isin(styles["combine"]), both).otherwise(by_dataset)


def rule_polygon(rule: Column, own: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The footprint: the box that the rule fixes, else the file's own."""
    out = own
    for r in rules:
        if r.box:
            left, top, right, bottom = r.box
            ring = ((left, top), (left, bottom), (right, bottom), (right, top), (left, top))
            out = F.when(rule == r.name, F.lit("POLYGON ((" + ",".join(f"{x:f} {y:f}" for x, y in ring) + "))")).otherwise(out)
    return out


def place_raster(path: Column, rule: Column, axis: str, rules: tuple[Rule, ...] = RULES) -> Column:
    """The raster with the ``x`` or ``y`` places of a file's pixels, null for rules without any or names that don't match."""
    cases = []
    for r in rules:
        found = r.x_places if axis == "x" else r.y_places
        if found:
            pattern, template = found
            groups = re.findall(r"\(\?P<(\w+)>", pattern)
            pieces = [
                F.regexp_extract(path, _java(pattern), groups.index(t) + 1) if i % 2 else F.lit(t)
                for i, t in enumerate(re.split(r"\{(\w+)\}", template))
            ]
            cases.append(F.when((rule == r.name) & path.rlike(_java(pattern)), F.concat(*pieces)))
    return F.coalesce(*cases) if cases else F.lit(None).cast("string")


def band_type(name: Column) -> Column:
    """Pixel type of a band by its name, Byte unless it is known."""
    cases = [F.when(name.isin(list(names)), F.lit(kind)) for kind, names in BAND_TYPES.items()]
    return F.coalesce(*cases, F.lit("Byte"))


def first_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: F.coalesce(a, b), columns)
