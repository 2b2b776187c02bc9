"""Longest-prefix joins: paths to projects and layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import prefixes
from ..plans.graph import Graph


def longest_prefix(paths: DataFrame, path: str, roots: DataFrame, root: str, value: str, out: str) -> DataFrame:
    """paths with `out`: the value of the longest root that is the path or one of its folders; null if none.

    The folders of the distinct paths are exploded and met by an equi-join, never by a nested loop.
    Of equal roots the smallest value counts. A root of '.' matches no path.
    """
    keys = paths.select(F.col(path).alias("__p")).distinct()
    steps = keys.select("__p", F.posexplode(prefixes(F.col("__p"))).alias("__n", "__r"))
    known = roots.select(F.rtrim(F.col(root), F.lit("/")).alias("__r"), F.col(value).alias("__v"))
    best = steps.join(known, "__r").groupBy("__p").agg(F.min_by("__v", F.struct("__n", "__v")).alias(out))
    return paths.join(best, F.col(path) == F.col("__p"), "left").drop("__p")


def package_of(g: Graph, paths: DataFrame, path: str = "path", out: str = "package") -> DataFrame:
    return longest_prefix(paths, path, g.projects, "root", "project_id", out)


def layer_rows(config: DataFrame) -> DataFrame:
    """layers map<string, struct<path, canImport>> of a boundary file as (layer, prefix, can_import)."""
    return config.select(F.explode("layers").alias("layer", "x")).select("layer", F.col("x.path").alias("prefix"), F.coalesce("x.canImport", F.array().cast("array<string>")).alias("can_import"))


def violations(g: Graph, layers: DataFrame) -> DataFrame:
    """Import edges between two layers that the source's layer doesn't allow."""
    rows = g.edges.where("kind = 'imports'").select("source", "target")
    rows = longest_prefix(longest_prefix(rows, "source", layers, "prefix", "layer", "from_layer"), "target", layers, "prefix", "layer", "to_layer")
    allowed = layers.select(F.col("layer").alias("from_layer"), "can_import")
    return rows.where("from_layer <> to_layer").join(allowed, "from_layer").where(~F.array_contains("can_import", F.col("to_layer"))).select("source", "target", "from_layer", "to_layer")


def or_unknown(c: Column) -> Column:
    return F.coalesce(c, F.lit("unknown"))
