"""Imports in source text, and the files that they mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed
from .paths import dirname, join_path


def _all(code: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(code, F.lit(pattern), F.lit(group))


def _entries(specifiers: Column, kind: str = "import") -> Column:
    return F.transform(specifiers, lambda s: F.struct(s.alias("specifier"), F.lit(kind).alias("kind")))


def _static(code: Column) -> Column:
    """Static imports and re-exports; the first word of a match tells which."""
    kinds = F.transform(_all(code, fixed.TS_IMPORT, 0), lambda m: F.when(m.startswith("export"), "export").otherwise("import"))
    both = F.arrays_zip(_all(code, fixed.TS_IMPORT).alias("s"), kinds.alias("k"))
    return F.transform(both, lambda x: F.struct(x["s"].alias("specifier"), x["k"].alias("kind")))


def import_entries(code: Column, language: Column) -> Column:
    """array<struct<specifier, kind>> in order of pattern, then place; repeats stay."""
    required = _all(code, fixed.TS_REQUIRE)
    seen = F.array_union(_all(code, fixed.TS_IMPORT), required)
    fresh = lambda p: _entries(F.filter(_all(code, p), lambda s: ~F.array_contains(seen, s)))
    script = F.concat(_static(code), _entries(required), fresh(fixed.TS_SIDE_EFFECT), fresh(fixed.TS_DYNAMIC_IMPORT))
    inner = F.flatten(F.transform(_all(code, fixed.GO_IMPORT_BLOCK), lambda b: _all(b, fixed.GO_IMPORT_LINE)))
    go = F.concat(_entries(_all(code, fixed.GO_IMPORT_SINGLE)), _entries(inner))
    out = F.when(language.isin("typescript", "javascript"), script).when(language == "go", go)
    for name, patterns in fixed.IMPORTS.items():
        out = out.when(language == name, F.concat(*[_entries(_all(code, p)) for p in patterns]))
    return out.otherwise(F.array().cast("array<struct<specifier:string,kind:string>>"))


def extract_imports(files: DataFrame) -> DataFrame:
    """files(path, language, content) to (path, language, no, specifier, kind)."""
    return files.select("path", "language", F.posexplode(import_entries(F.coalesce("content", F.lit("")), F.col("language"))).alias("no", "e")).select("path", "language", "no", "e.specifier", "e.kind")


def candidates(specifier: Column, path: Column, language: Column) -> Column:
    """array of paths that a specifier may mean, best first; the last is what it means if none exists."""
    here = dirname(path)
    local = specifier.startswith(".")
    joined = join_path(here, specifier)
    script = F.array(joined, *[F.concat(joined, F.lit(e)) for e in fixed.RESOLVE_EXTENSIONS + fixed.RESOLVE_INDEX_FILES], joined)
    dots, rest = F.regexp_extract(specifier, r"^(\.+)", 1), F.regexp_replace(specifier, r"^\.+", "")
    up = F.aggregate(F.sequence(F.lit(1), F.length(dots)), here, lambda d, i: F.when(i == 1, d).otherwise(dirname(d)))
    python = F.when(rest == "", up).otherwise(join_path(up, F.replace(rest, F.lit("."), F.lit("/"))))
    crate = join_path(F.lit("src"), F.array_join(F.filter(F.split(F.regexp_replace(specifier, "^crate::", ""), "::"), lambda p: ~p.contains("{") & ~p.contains("*")), "/"))
    module = join_path(here, F.concat(specifier, F.lit(".rs")))
    return (
        F.when(language.isin("typescript", "javascript") & local, script)
        .when((language == "python") & local, F.array(python))
        .when((language == "rust") & specifier.startswith("crate::"), F.array(crate))
        .when((language == "rust") & ~specifier.contains("::"), F.array(module, join_path(here, F.concat(specifier, F.lit("/mod.rs"))), module))
        .when((language == "ruby") & local, F.array(F.concat(joined, F.lit(".rb")), joined))
        .otherwise(F.array(specifier))
    )


def resolve(imports: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """imports(path, language, no, specifier, kind) with target: the first candidate among known(path), else the last one.

    Candidates are exploded and met by an equi-join; the files are no driver-side set.
    """
    rows = imports.withColumn("__c", candidates(F.col("specifier"), F.col("path"), F.col("language")))
    last = F.element_at("__c", -1)
    if known is None:
        return rows.withColumn("target", last).drop("__c")
    keys = ["path", "language", "no", "specifier", "kind"]
    probe = rows.where(F.size("__c") > 1).select(*keys, last.alias("target"), F.posexplode("__c").alias("__p", "__k"))
    met = probe.join(known.select(F.col("path").alias("__k")).distinct().withColumn("__hit", F.lit(True)), "__k", "left")
    best = met.groupBy(*keys, "target").agg(F.min_by("__k", F.when(F.col("__hit"), F.col("__p"))).alias("__b")).select(*keys, F.coalesce("__b", "target").alias("target"))
    return rows.where(F.size("__c") == 1).select(*keys, last.alias("target")).unionByName(best)
