"""Paths, URLs and route segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The lower-cased text after the last dot."""
    return F.lower(F.element_at(F.split(path, r"\."), -1))


def ancestors(path: Column) -> Column:
    """All directories above a path, outermost first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def normalize_url(url: Column) -> Column:
    """One leading slash, none at the end, no doubled ones."""
    return F.regexp_replace(F.concat(F.lit("/"), F.regexp_replace(url, "^/+|/+$", "")), "/+", "/")


def feature_of(path: Column) -> Column:
    """The first directory below app/ that is no group, parameter or slot."""
    inner = F.regexp_extract(path, r"^(?:.*/)?app/(.+)$", 1)
    parts = F.split(inner, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.try_element_at(F.filter(folders, lambda x: ~x.rlike(r"^[(\[@]")), F.lit(1))


def route_segment(segment: Column) -> Column:
    """What one folder adds to a URL; null for groups and slots."""
    return (
        F.when(segment.rlike(r"^\(.+\)$") | segment.startswith("@"), F.lit(None).cast("string"))
        .when(segment.rlike(r"^\[\[\.\.\..+\]\]$"), F.concat(F.lit("*"), F.regexp_extract(segment, r"^\[\[\.\.\.(.+)\]\]$", 1), F.lit("?")))
        .when(segment.rlike(r"^\[\.\.\..+\]$"), F.concat(F.lit("*"), F.regexp_extract(segment, r"^\[\.\.\.(.+)\]$", 1)))
        .when(segment.rlike(r"^\[.+\]$"), F.concat(F.lit(":"), F.regexp_extract(segment, r"^\[(.+)\]$", 1)))
        .otherwise(segment)
    )


def url_of(folder: Column) -> Column:
    """The URL of a folder below the app directory."""
    parts = F.filter(F.transform(F.filter(F.split(folder, "/"), lambda x: x != ""), route_segment), lambda x: x.isNotNull())
    return F.concat(F.lit("/"), F.array_join(parts, "/"))
