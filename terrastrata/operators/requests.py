"""The small languages of requests: subsets of axes, constraint expressions, query strings."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

LOWEST, HIGHEST = float("-inf"), float("inf")


@dataclass
class AxisChoice:
    """What a request picks along one axis."""

    name: str
    low: float | None = None
    high: float | None = None
    values: list[float] = field(default_factory=list)
    indices: list[tuple[int, int, int]] = field(default_factory=list)
    low_open: bool = False
    high_open: bool = False
    order: str = "asc"
    aggregate: bool = True

    def keep(self, value: Column) -> Column:
        """Whether a value of the axis is chosen."""
        if self.values:
            return value.isin(self.values)
        out = F.lit(True)
        if self.low is not None and self.low != LOWEST:
            out = out & (value > self.low if self.low_open else value >= self.low)
        if self.high is not None and self.high != HIGHEST:
            out = out & (value < self.high if self.high_open else value <= self.high)
        return out


def _number(text: str, unbounded: float) -> float:
    text = text.strip()
    return unbounded if text == "*" else float(text)


def parse_subset(text: str) -> dict[str, AxisChoice]:
    """``axis(lo,hi)order=asc,agg=union`` , ``axis((v1,v2))``, ``axis(v)``, ``*`` for no bound; joined by ``;``."""
    out = {}
    for clause in filter(None, (c.strip() for c in text.split(";"))):
        m = re.fullmatch(r"([A-Za-z_]\w*)\s*\((.*)\)\s*([^()]*)", clause)
        if not m:
            raise ValueError(f"cannot read subset {clause!r}")
        choice, inner = AxisChoice(m[1]), m[2].strip()
        if inner.startswith("("):
            choice.values = [float(v) for v in inner.strip("()").split(",")]
        else:
            ends = inner.split(",")
            if len(ends) > 2:
                raise ValueError(f"a subset has one or two ends: {clause!r}")
            choice.low = _number(ends[0], LOWEST)
            choice.high = _number(ends[1], HIGHEST) if len(ends) == 2 else (None if choice.low == LOWEST else choice.low)
        for option in filter(None, (o.strip() for o in m[3].split(","))):
            key, _, value = option.partition("=")
            if key == "order" and value in ("asc", "desc"):
                choice.order = value
            elif key == "agg" and value in ("union", ""):
                choice.aggregate = True
            elif key == "agg" and value == "none":
                choice.aggregate = False
            else:
                raise ValueError(f"no option {option!r}")
        out[choice.name] = choice
    return out


@dataclass
class Constraint:
    """A data set, its variables with index selections, and filters on axes."""

    dataset: str
    variables: dict[str, list[tuple[int, int, int] | None]]
    axes: dict[str, AxisChoice]


def parse_constraint(text: str) -> Constraint:
    """``dataset{var;var2[0:2:9][3]|axis>=1,axis<5}``; bounds keep whether they include their end."""
    m = re.fullmatch(r"\s*/?([\w./-]+)\s*\{([^{}|]*)(?:\|([^{}]*))?\}(?:\|(.*))?\s*", text)
    if not m:
        raise ValueError(f"cannot read constraint {text!r}")
    variables: dict[str, list[tuple[int, int, int] | None]] = {}
    for v in filter(None, (x.strip() for x in m[2].split(";"))):
        name = re.match(r"[A-Za-z_]\w*", v)
        if not name or not re.fullmatch(r"(\[[\d:]*\])*", v[name.end() :]):
            raise ValueError(f"cannot read variable {v!r}")
        variables[name[0]] = [parse_index(i) for i in re.findall(r"\[([\d:]*)\]", v)]
    axes: dict[str, AxisChoice] = {}
    for f in filter(None, (x.strip() for x in (m[3] or m[4] or "").split(","))):
        two = re.fullmatch(r"(-?[\d.]+)\s*(<=?)\s*([A-Za-z_]\w*)\s*(<=?)\s*(-?[\d.]+)", f)
        one = re.fullmatch(r"([A-Za-z_]\w*)\s*(<=?|>=?|==?)\s*(-?[\d.]+)", f)
        if not two and not one:
            raise ValueError(f"cannot read filter {f!r}")
        axis = axes.setdefault(two[3] if two else one[1], AxisChoice(two[3] if two else one[1]))
        if two:
            axis.low, axis.low_open, axis.high, axis.high_open = float(two[1]), two[2] == "<", float(two[5]), two[4] == "<"
        elif one[2].startswith(">"):
            axis.low, axis.low_open = float(one[3]), one[2] == ">"
        elif one[2].startswith("<"):
            axis.high, axis.high_open = float(one[3]), one[2] == "<"
        else:
            axis.low = axis.high = float(one[3])
    return Constraint(m[1], variables, axes)


def parse_index(text: str) -> tuple[int, int, int] | None:
    """``i``, ``a:b`` or ``a:step:b``, ends included; empty for all."""
    if not text:
        return None
    parts = [int(p) for p in text.split(":")]
    a, s, b = (parts[0], 1, parts[0]) if len(parts) == 1 else (parts[0], 1, parts[1]) if len(parts) == 2 else parts
    if a > b or s < 1:
        raise ValueError(f"cannot select {text!r}")
    return a, b, s


def query_map(query: Column) -> Column:
    """A query string as a map with lower-case keys, the last of repeated ones; ``\\&`` is a plain ``&``."""
    plain = F.replace(query, F.lit("\\&"), F.lit("\x01"))
    pairs = F.filter(F.split(plain, "&"), lambda p: p.contains("="))
    entries = F.transform(
        pairs,
        lambda p: F.struct(
            F.lower(F.substring_index(p, "=", 1)).alias("k"),
            F.replace(F.substr(p, F.length(F.substring_index(p, "=", 1)) + 2), F.lit("\x01"), F.lit("&")).alias("v"),
        ),
    )
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    last = F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"])
    return F.map_from_arrays(keys, last)


def remote_address(forwarded: Column, address: Column) -> Column:
    """The first hop of a forwarding header, else the address; without the port."""
    first = F.trim(F.get(F.split(forwarded, ","), F.lit(0)))
    return F.regexp_replace(F.coalesce(F.nullif(first, F.lit("")), address), r":\d+$", "")


def scale_range(text: Column) -> tuple[Column, Column]:
    """``min,max`` as offset (minus the minimum) and clip (the width)."""
    parts = F.split(text, ",")
    low, high = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    return -low, high - low


def crs_code(text: Column) -> Column:
    """The number in ``EPSG:n``, null in other texts."""
    return F.nullif(F.regexp_extract(text, r"^EPSG:(\d+)$", 1), F.lit("")).try_cast("int")


def blank_null(text: Column) -> Column:
    """An empty parameter is a missing one."""
    return F.nullif(text, F.lit(""))


def name_list(text: Column) -> Column:
    """A comma list, null if missing or empty."""
    return F.split(blank_null(text), ",")
