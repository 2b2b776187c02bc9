"""Point lookups, filters, search, counts and the ledger."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import symbols as S
from ..functions.paths import extension, snippet
from ..plans.graph import Graph


def by_key(table: DataFrame, key: str, value) -> DataFrame:
    return table.where(F.col(key) == F.lit(value))


def batch(table: DataFrame, key: str, wanted: list | DataFrame) -> DataFrame:
    """Rows whose key is wanted: an IN list, or a semi-join with a table of keys."""
    if isinstance(wanted, DataFrame):
        return table.join(wanted.select(F.col(wanted.columns[0]).alias(key)), key, "left_semi")
    return table.where(F.col(key).isin(wanted)) if wanted else table.where(F.lit(False))


def edges_of(g: Graph, kind: str | None = None, source: str | None = None, target: str | None = None) -> DataFrame:
    out = g.edges
    for col, value in (("kind", kind), ("source", source), ("target", target)):
        out = out if value is None else out.where(F.col(col) == value)
    return out


def edges_by_targets(g: Graph, targets: list[str]) -> DataFrame:
    """Edges of any kind to the targets, with the place of the target in the list; repeats stay."""
    keys = g.edges.sparkSession.createDataFrame(list(enumerate(targets)), "pos int, target string")
    return g.edges.join(F.broadcast(keys), "target").select("pos", "source", "target", "kind", "confidence")  # an argument list


def _like(c: Column, q: str) -> Column:
    """LIKE as in an engine that folds ASCII case only and has no escape character."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    return F.translate(c, upper, lower).like(q.translate(str.maketrans(upper, lower)).replace("\\", "\\\\"))


def search_symbols(g: Graph, q: str, k: int = 50) -> DataFrame:
    """Symbols whose name starts with q if there are k of them, else symbols whose name contains q; at most k by (name, id).

    One plan: both sets are limited first and the branch is a count of the limited prefix set.
    """
    order = ["name", "id"]
    starts = g.symbols.where(_like(F.col("name"), q + "%")).orderBy(*order).limit(k)
    contains = g.symbols.where(_like(F.col("name"), "%" + q + "%")).orderBy(*order).limit(k)
    full = starts.agg((F.count("*") >= k).alias("__full"))
    both = starts.withColumn("__p", F.lit(True)).unionByName(contains.withColumn("__p", F.lit(False)))
    return both.join(F.broadcast(full), F.col("__p") == F.col("__full")).drop("__p", "__full").orderBy(*order)  # one row


def definition(g: Graph, symbol_id: str) -> DataFrame:
    """The symbol with its range unpacked and up to three lines; null range, no lines."""
    rows = by_key(g.symbols, "id", symbol_id)
    return with_snippets(rows, g.contents)


def with_snippets(rows: DataFrame, contents: DataFrame, path: str = "file_path", start: str = "range_start", end: str = "range_end") -> DataFrame:
    text = contents.select(F.col("path").alias(path), F.col("content").alias("__c"))
    out = rows.join(text, path, "left").withColumn("snippet", snippet(F.col("__c"), S.line_of(F.col(start)))).drop("__c")
    return out.withColumns({"start_line": S.line_of(F.col(start)), "start_col": S.column_of(F.col(start)), "end_line": S.line_of(F.col(end)), "end_col": S.column_of(F.col(end))})


def references(g: Graph, symbol_id: str, exclude_definitions: bool = False, scope: str | None = None) -> DataFrame:
    out = by_key(g.occurrences, "symbol_id", symbol_id)
    if exclude_definitions:
        out = out.where(~S.has_role(F.col("roles")))
    if scope:
        out = out.where(F.col("file_path").startswith(scope))
    return with_snippets(out, g.contents)


def named_kinds(symbols: DataFrame) -> DataFrame:
    return symbols.where(F.col("kind").isNotNull() & (F.col("kind") != ""))


def is_source(p: Column) -> Column:
    """Files that freshness looks at; fewer than those that are indexed."""
    return extension(p).isin(*fixed.FRESH_EXTENSIONS)


def status(g: Graph) -> DataFrame:
    """One row of counts; last_indexed is 0 for an empty table."""
    parts = [getattr(g, t).agg(F.count("*").alias(n)) for t, n in (("symbols", "n_symbols"), ("edges", "n_edges"), ("dirty", "n_dirty"))]
    out = g.files.agg(F.count("*").alias("n_files"), F.coalesce(F.max("indexed_at"), F.lit(0)).cast("bigint").alias("last_indexed"))
    for p in parts:  # rows of one
        out = out.join(F.broadcast(p))
    return out


def latest_events(ledger: DataFrame) -> DataFrame:
    """The row with the largest id of each event."""
    return ledger.groupBy("event").agg(F.max_by(F.struct("id", "timestamp", "data"), "id").alias("r")).select("event", "r.*")


def events_after(ledger: DataFrame, timestamp: int) -> DataFrame:
    return ledger.where(F.col("timestamp") > timestamp)


def tested_after_edit(ledger: DataFrame, *keys: str) -> DataFrame:
    """Whether the last test_run has a larger id than the last edit: true without edits, false without tests."""
    at = lambda e: F.max(F.when(F.col("event") == e, F.col("id")))
    out = ledger.groupBy(*keys).agg(at("edit").alias("e"), at("test_run").alias("t"))
    return out.select(*keys, F.when(F.col("e").isNull(), True).otherwise(F.coalesce(F.col("t") > F.col("e"), F.lit(False))).alias("tested"))


def stale_files(g: Graph, walked: DataFrame) -> DataFrame:
    """walked(path, hash) that are not stored with that hash; is_new tells those that are not stored at all."""
    stored = g.files.select("path", F.col("hash").alias("__h"))
    return walked.join(stored, "path", "left").where("__h IS NULL OR __h <> hash").select("path", "hash", F.col("__h").isNull().alias("is_new"))


def first_per(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__n") <= n).drop("__n")
