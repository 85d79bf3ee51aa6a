"""Path functions: hashes, ancestors, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal(path: Column) -> Column:
    """One leading slash, none behind."""
    return F.concat(F.lit("/"), F.trim(path, F.lit("/")))


def path_hash(path: Column) -> Column:
    return F.md5(path)


def depth(path: Column) -> Column:
    """Number of slashes of a normal path."""
    return F.length(path) - F.length(F.replace(path, F.lit("/")))


def ancestors(path: Column) -> Column:
    """All strict ancestors, root first, without a join."""
    parts = F.split(F.trim(path, F.lit("/")), "/")
    n = F.size(parts) - 1
    own = F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, k), "/")))
    return F.when(n > 0, own).otherwise(F.array().cast("array<string>"))


def ancestor_hashes(path: Column) -> Column:
    return F.transform(ancestors(path), path_hash)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def absolute(path: Column, base: Column) -> Column:
    """``./x`` below ``base``; other paths as they are."""
    return F.when(path.startswith("./"), F.concat(base, F.lit("/"), F.substr(path, F.lit(3)))).otherwise(path)


def under(parents: Column, path: str) -> Column:
    """Whether ``path`` is among the ancestors (given by hash)."""
    return F.array_contains(parents, F.md5(F.lit(path)))


def child_of(parents: Column, path: str) -> Column:
    """Whether ``path`` is the last ancestor."""
    return F.try_element_at(parents, F.lit(-1)) == F.md5(F.lit(path))


def nth_ancestor(parents: Column, n: int, path: str) -> Column:
    """Whether ``path`` is the ``n``-th ancestor, the root's first."""
    return F.try_element_at(parents, F.lit(n)) == F.md5(F.lit(path))
