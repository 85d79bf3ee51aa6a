"""Reading what crawlers leave: lines, directory listings, YAML documents, raster tiles, logs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import LINE, band_type

DATASETS = (
    "filename string, ds_name string, namespace string, timestamp string, x_size int, y_size int, geo_transform array<double>, polygon string, srs string"
)
#: Words of a file filter besides comparisons and quoted texts.
_FILTER = re.compile(r"\s*(?:(path|type)\b|(&&|\|\||==|!=|=~|!~|!|\(|\))|'([^']*)'|\"([^\"]*)\")")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Crawler files: path, type and document between tabs, gzipped or not; documents stay text."""
    return spark.read.csv(path, schema=LINE, sep="\t", quote="\b", escape="\b", multiLine=False)


def file_filter(text: str) -> Column:
    """A filter on ``path`` and ``type``: comparisons, ``=~`` (pattern), ``&&``, ``||``, ``!``, brackets.

    Read word by word into SQL in which texts are quoted anew, so nothing else gets through.
    """
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _FILTER.match(text, at)
        if not m:
            raise ValueError(f"cannot read filter at {text[at:]!r}")
        at = m.end()
        if m[1]:
            out.append(f"`{m[1]}`")
        elif m[2]:
            out.append({"&&": "AND", "||": "OR", "==": "=", "!": "NOT", "=~": "RLIKE", "!~": "NOT RLIKE"}.get(m[2], m[2]))
        else:
            quoted = (m[3] if m[3] is not None else m[4]).replace("\\", "\\\\").replace("'", "\\'")
            out.append(f"'{quoted}'")
    return F.expr(" ".join(out))


def list_files(spark: SparkSession, root: str, pattern: str | None = None, whole: str | None = None) -> DataFrame:
    """Files below ``root`` with size and time; contents aren't read. ``pattern`` is a ``file_filter``.

    A folder whose name ends in ``whole`` (as ``.parquet``), as Spark writes a table, counts as one file: its parts'
    sizes summed, the last of their times. ``id`` is a hash of path, size and time, so a changed file is a new one.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = found.select(F.col("path"), F.lit("file").alias("type"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    if whole:
        # Parts lie in the folder itself or in its partitions' folders (`key=value`).
        folder = F.regexp_extract("path", rf"^(.*{re.escape(whole)})(?:/[^/=]+=[^/]*)*/[^/]+$", 1)
        path = F.when(folder == "", F.col("path")).otherwise(folder)
        files = files.groupBy(path.alias("path"), "type").agg(F.sum("size").alias("size"), F.max("mtime").alias("mtime"))
    return with_ids(files.where(file_filter(pattern)) if pattern else files)


def with_ids(files: DataFrame) -> DataFrame:
    """Listed files with their ids."""
    return files.withColumn("id", F.md5(F.concat_ws("|", "path", "size", F.unix_micros("mtime"))))


def posix_lines(files: DataFrame) -> DataFrame:
    """Listed files as crawler lines."""
    doc = F.to_json(F.struct("id", "size", F.unix_seconds("mtime").alias("mtime"), "type"))
    return files.select(F.concat_ws("\t", "path", F.lit("posix"), doc).alias("value"))


class _Yaml:
    """A YAML document of which only the fields asked for are made into values, since that takes most of the time."""

    TAG = "tag:yaml.org,2002:"

    def __init__(self, text: str):
        import yaml

        self.loader, self.scalar = getattr(yaml, "CSafeLoader", yaml.SafeLoader)(text), yaml.ScalarNode
        self.root = self.loader.get_single_node()
        self.loader.dispose()

    def value(self, node, default=None):
        """What a node says; an absent one says ``default``."""
        if node is None:
            return default
        plain = node.tag == self.TAG + "str" and isinstance(node, self.scalar)
        return node.value if plain else self.loader.construct_object(node, deep=True)

    def fields(self, node) -> dict:
        """The nodes of a mapping by name, merged ones (``<<``) too; none of an absent or empty one."""
        if node is None or not node.value or node.tag == self.TAG + "null":
            return {}
        if node.tag != self.TAG + "map":
            raise ValueError(f"a mapping is expected, not {node.tag}{node.start_mark}")
        self.loader.flatten_mapping(node)
        return {self.value(k): v for k, v in node.value}


def _datasets(filename: str, text: str, family: str) -> Iterator[tuple]:
    doc = _Yaml(text)
    value, fields = doc.value, doc.fields
    top = fields(doc.root)
    folder = filename.rsplit("/", 1)[0]
    ring = lambda points: "POLYGON ((" + ",".join(f"{x} {y}" for x, y in points) + "))"
    if family == "sentinel2":
        space = fields(fields(top.get("grid_spatial")).get("projection"))
        points = value(fields(space.get("valid_data")).get("coordinates")) or [[]]
        stamp, srs = str(value(fields(top.get("extent")).get("center_dt"), "")), value(space.get("spatial_reference"))
        for name, node in fields(fields(top.get("image")).get("bands")).items():
            band = fields(node)
            info = fields(band.get("info"))
            path, transform = value(band["path"]), value(info.get("geotransform")) or []
            yield filename, f"{folder}/{path}", name, stamp, value(info.get("width")), value(info.get("height")), [float(v) for v in transform], ring(points[0]), srs
    elif family == "landsat":
        points = value(fields(top.get("geometry")).get("coordinates")) or [[]]
        stamp = re.sub(r"^(\S+) (\d\d:\d\d:\d\d).*$", r"\1T\2Z", str(value(fields(top.get("properties")).get("datetime"), "")))
        outline, srs = ring((f"{float(x):f}", f"{float(y):f}") for x, y in points[0]), value(top.get("crs"))
        for name, band in fields(top.get("measurements")).items():
            yield filename, f"{folder}/{value(fields(band)['path'])}", name, stamp, None, None, [0.0] * 6, outline, srs
    else:
        raise ValueError(f"no YAML family {family}")


def yaml_bands(texts: DataFrame, family: str) -> DataFrame:
    """YAML documents (``filename``, ``value``) of Sentinel-2 or Landsat scenes, one row per band, with its pixel type."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in DATASETS.split(", ")]
        for batch in batches:
            rows = [r for name, text in zip(batch["filename"], batch["value"]) for r in _datasets(name, text, family)]
            yield pd.DataFrame(rows, columns=names)

    made = texts.select("filename", "value").mapInPandas(run, DATASETS)
    kind = band_type(F.col("namespace")) if family == "sentinel2" else F.lit("Int16")
    return made.withColumn("array_type", kind)


def read_yaml(spark: SparkSession, path: str, family: str) -> DataFrame:
    """The bands of all YAML documents at ``path``, whole files at a time."""
    return yaml_bands(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("filename"), "value"), family)


def read_window(spark: SparkSession, path: str, bands: list[str], x: tuple[int, int], y: tuple[int, int], tile: int) -> DataFrame:
    """Pixels of some bands in a window of a stored tile table: only its tiles' folders are read."""
    t = spark.read.parquet(path).where(F.col("band").isin(bands))
    t = t.where(F.col("tile_x").between(x[0] // tile, x[1] // tile) & F.col("tile_y").between(y[0] // tile, y[1] // tile))
    return t.where(F.col("px").between(*x) & F.col("py").between(*y))


def virtual_bands(pixels: DataFrame, on: list[str], names: list[str], bands: dict[str, str]) -> DataFrame:
    """A virtual raster: bands derived by checked expressions from the aligned bands of another."""
    from ..operators import expressions, raster

    wide = raster.aligned(pixels, on, "band", names)
    made = {out: expressions.parse(text, names) for out, text in bands.items()}
    return wide.select(*on, *(raster.band_math(wide, list(e.variables), e.column()).alias(n) for n, e in made.items()))


def pixel_function(rasters: DataFrame, value: str, function) -> DataFrame:
    """A user's function over numpy arrays of pixel values, batch by batch through Arrow."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{value: function(batch[value].to_numpy(float))})

    return rasters.mapInPandas(run, rasters.schema)
