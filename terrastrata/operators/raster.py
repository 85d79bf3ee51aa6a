"""Rasters in long form: one row per band, time and pixel; null is nodata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Groups up to which their ranges (some 50 bytes each) are broadcast.
MOST_RANGES = 100_000


def mosaic(pixels: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The latest valid value of each pixel: the value with the greatest ``order``, whatever the rows' order.

    A maximum over a struct: it combines on the map side, so a shuffle carries one row per pixel and task.
    """
    return pixels.where(F.col("value").isNotNull()).groupBy(*by).agg(F.max_by("value", F.struct(*order)).alias("value"))


def canvas(grid: DataFrame, pixels: DataFrame, on: list[str], nodata: float) -> DataFrame:
    """Every pixel of ``grid``, nodata where ``pixels`` has none."""
    return grid.join(pixels, on, "left").withColumn("value", F.coalesce("value", F.lit(nodata)))


def masked_by_value(mask: Column, bits: str) -> Column:
    """Whether any bit of the binary text ``bits`` is set."""
    return mask.bitwiseAND(F.lit(int(bits, 2))) > 0


def masked_by_tests(mask: Column, tests: list[str]) -> Column:
    """Whether for any pair (filter, value) of binary texts ``mask & filter = value``."""
    if len(tests) % 2:
        raise ValueError("bit tests come in pairs of filter and value")
    pairs = [(int(a, 2), int(b, 2)) for a, b in zip(tests[::2], tests[1::2])]
    return reduce(lambda x, y: x | y, (mask.bitwiseAND(F.lit(a)) == b for a, b in pairs), F.lit(False))


def apply_mask(data: DataFrame, mask: DataFrame, on: list[str], bad: Column, inclusive: bool = False) -> DataFrame:
    """Pixels of ``data`` whose mask pixel (joined on ``on``, column ``mask``) is ``bad`` become nodata.

    ``inclusive`` keeps the bad ones and drops the others. Pixels without a mask stay.
    """
    joined = data.join(mask, on, "left")
    hit = F.coalesce(bad if not inclusive else ~bad, F.lit(False))
    return joined.withColumn("value", F.when(~hit, F.col("value"))).drop("mask")


def scale(value: Column, offset: float, factor: float, clip: float) -> Column:
    """To 0..254: add offset, clamp to 0..clip, multiply (254 / clip if no factor is given); nodata is 255."""
    clip = clip if clip > 0 else 1.0
    factor = factor if factor > 0 else 254.0 / clip
    held = F.least(F.greatest(value + offset, F.lit(0.0)), F.lit(float(clip)))
    return F.when(value.isNull(), 255).otherwise(F.floor(held * F.lit(float(factor)))).cast("int")


def auto_scale(pixels: DataFrame, by: list[str]) -> DataFrame:
    """Scaled by each group's own range; a single value gets a range of 0.1.

    Groups (bands, in most cases) are few and large: where a count shows that, their ranges are broadcast and
    the pixels stay where they are.
    """
    low = pixels.groupBy(*by).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    high = F.when(F.col("high") == F.col("low"), F.col("high") + 0.1).otherwise(F.col("high"))
    ranges = low.withColumn("high", high)
    few = ranges.limit(MOST_RANGES + 1).count() <= MOST_RANGES
    joined = pixels.join(F.broadcast(ranges) if few else ranges, by)
    scaled = F.floor((F.col("value") - F.col("low")) * (254 / (F.col("high") - F.col("low"))))
    return joined.withColumn("byte", F.when(F.col("value").isNull(), 255).otherwise(scaled).cast("int")).drop("low", "high")


def log_scale(value: Column) -> Column:
    """Decimal logarithm; nodata where there is none."""
    return F.when(value > 0, F.log10(value))


def palette(colours: list[tuple[int, int, int, int]], interpolate: bool) -> list[tuple[int, int, int, int]]:
    """256 colours: between neighbours by equal steps, or each repeated; what 256 leaves over goes to the first sections."""
    sections = len(colours) - 1 if interpolate else len(colours)
    size, rest = divmod(256, sections)
    out: list[tuple[int, int, int, int]] = []
    for k in range(sections):
        n = size + (k < rest)
        a = colours[k]
        b = colours[k + 1] if interpolate else a
        out += [tuple(x + int(i * (y - x) / n) for x, y in zip(a, b)) for i in range(n)]  # type: ignore[misc]
    return out


def coloured(pixels: DataFrame, byte: str, colours: list[tuple[int, int, int, int]], interpolate: bool = True) -> DataFrame:
    """Red, green, blue and alpha of each scaled pixel; 255 is transparent. The table joined has 256 rows."""
    ramp = palette(colours, interpolate)
    rows = [(i, *c) for i, c in enumerate(ramp)]
    lookup = pixels.sparkSession.createDataFrame(rows, f"{byte} int, r int, g int, b int, a int")
    joined = pixels.join(F.broadcast(lookup), byte)
    return joined.withColumn("a", F.when(F.col(byte) == 255, 0).otherwise(F.col("a")))


def aligned(pixels: DataFrame, on: list[str], name: str, names: list[str]) -> DataFrame:
    """One row per pixel with a column per band."""
    return pixels.groupBy(*on).pivot(name, names).agg(F.first("value"))


def band_math(wide: DataFrame, names: list[str], expression: Column) -> Column:
    """``expression`` where every input is valid and the result finite; else nodata."""
    valid = reduce(lambda x, y: x & y, (F.col(n).isNotNull() for n in names))
    finite = ~F.isnan(expression) & (F.abs(expression) != float("inf"))
    return F.when(valid & finite, expression)


def rgb(wide: DataFrame, red: str, green: str, blue: str) -> DataFrame:
    """Three scaled bands as a pixel, transparent only where all three are 255."""
    clear = (F.col(red) == 255) & (F.col(green) == 255) & (F.col(blue) == 255)
    return wide.withColumns({"r": F.col(red), "g": F.col(green), "b": F.col(blue), "a": F.when(clear, 0).otherwise(255)})


def point(pixels: DataFrame, x: int, y: int, by: list[str], order: list[str]) -> DataFrame:
    """The latest value at one pixel per band as text, ``n/a`` where it has none."""
    at = pixels.where((F.col("px") == x) & (F.col("py") == y))
    best = at.groupBy(*by).agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.struct(*order))).alias("v"))
    return best.select(*by, F.coalesce(F.format_string("%.4f", "v"), F.lit("n/a")).alias("value"))


def warp(source: DataFrame, grid: DataFrame, x: Column, y: Column, width: int, height: int) -> DataFrame:
    """Nearest neighbour: each target pixel takes the source pixel its centre falls in, none outside.

    ``x`` and ``y`` are a target row's place in source pixels; the join is an equality on the pixel.
    """
    sx, sy = F.floor(x + 1e-10), F.floor(y + 1e-10)
    inside = (sx >= 0) & (sx < width) & (sy >= 0) & (sy < height)
    placed = grid.withColumns({"sx": F.when(inside, sx).cast("int"), "sy": F.when(inside, sy).cast("int")})
    return placed.join(source.withColumnsRenamed({"px": "sx", "py": "sy"}), ["sx", "sy"])


def overview(levels: list[float], target: float) -> int:
    """Which pyramid level to read for a wanted reduction: the last one that isn't coarser; -1 for the file itself."""
    fitting = [i for i, ratio in enumerate(levels) if ratio <= target]
    return max(fitting, key=lambda i: levels[i], default=-1)


def reduced(pixels: DataFrame, by: list[str], k: int) -> DataFrame:
    """An overview: means of blocks of ``k`` by ``k`` pixels."""
    block = {"px": F.expr(f"px div {k}"), "py": F.expr(f"py div {k}")}
    return pixels.withColumns(block).groupBy(*by, "px", "py").agg(F.avg("value").alias("value"))


def tiles(pixels: DataFrame, tile_x: int, tile_y: int) -> DataFrame:
    """Tile numbers, and the place within the tile, of each pixel."""
    return pixels.withColumns(
        {"tile_x": F.expr(f"px div {tile_x}").cast("int"), "tile_y": F.expr(f"py div {tile_y}").cast("int"), "in_x": F.col("px") % tile_x, "in_y": F.col("py") % tile_y}
    )


def windows(width: int, height: int, tile: int, workers: int, least: int = 5) -> list[tuple[int, int, int, int, int]]:
    """(x, y, width, height, worker) of the windows of a request, dealt out in runs of ``least`` or more."""
    cells = [(x, y, min(tile, width - x), min(tile, height - y)) for y in range(0, height, tile) for x in range(0, width, tile)]
    run = max(least, -(-len(cells) // max(workers, 1)))
    return [(*c, i // run) for i, c in enumerate(cells)]


def require_bands(pixels: DataFrame, wanted: list[str], name: str = "band") -> DataFrame:
    """The wanted bands that ``pixels`` lacks."""
    asked = pixels.sparkSession.createDataFrame([(n,) for n in wanted], f"{name} string")
    return asked.join(pixels.select(name).distinct(), name, "left_anti")


def fuse(layers: list[DataFrame], on: list[str]) -> DataFrame:
    """Layers blended: the first layer with a valid value wins each pixel. One shuffle, not one join per layer."""
    tagged = [d.select(*on, "value", F.lit(i).alias("layer")) for i, d in enumerate(layers)]
    both = reduce(DataFrame.unionByName, tagged).where(F.col("value").isNotNull())
    return both.groupBy(*on).agg(F.min_by("value", "layer").alias("value"), F.min("layer").alias("layer"))


def time_weighted(pixels: DataFrame, on: list[str], weights: dict[int, float], when: str = "t") -> DataFrame:
    """Passes for several times combined by weights, over those that have a value."""
    table = F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(v))))
    w = F.try_element_at(table, F.col(when))
    valid = pixels.where(F.col("value").isNotNull() & w.isNotNull())
    return valid.groupBy(*on).agg((F.sum(F.col("value") * w) / F.sum(w)).alias("value"))


def same_shape(rasters: DataFrame) -> DataFrame:
    """``ok`` or what is mixed among the rasters' type, width and height."""
    kinds = rasters.agg(F.count_distinct("kind").alias("k"), F.count_distinct("width").alias("w"), F.count_distinct("height").alias("h"))
    return kinds.select(F.when(F.col("k") > 1, "mixed types").when(F.col("w") > 1, "mixed width").when(F.col("h") > 1, "mixed height").otherwise("ok").alias("status"))


def output_size(width: Column, height: Column, limit_x: float, limit_y: float) -> tuple[Column, Column]:
    """Size of a drill's raster: limits of at most 1 are shares, others pixel caps that keep the aspect."""
    wx = F.ceil(width * limit_x) if limit_x <= 1 else F.least(width, F.lit(limit_x))
    hy = F.ceil(height * limit_y) if limit_y <= 1 else F.least(height, F.lit(limit_y))
    share = F.least(wx / width, hy / height)
    w, h = (wx, hy) if limit_x <= 1 and limit_y <= 1 else (width * share, height * share)
    return F.greatest(F.floor(w + 0.5), F.lit(1)).cast("int"), F.greatest(F.floor(h + 0.5), F.lit(1)).cast("int")
