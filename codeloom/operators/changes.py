"""Upserts, deletes, the dirty set and ingest of symbol indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import symbols as S
from ..functions.imports import extract_imports, resolve
from ..functions.paths import in_project, language_of
from ..plans.graph import Graph
from ..runtime import cut, written

#: Powers of four that hold the lines of any packed position.
LEVELS = 8


def upsert(table: DataFrame, incoming: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """table with incoming rows: the last of a key wins, by `order` (dropped) or else by its other columns, and replaces all columns."""
    by = [order] if order else [c for c in incoming.columns if c not in keys]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in by or keys]))
    last = incoming.withColumn("__n", rank).where("__n = 1").drop("__n", *([order] if order else []))
    return table.join(last.select(*keys), keys, "left_anti").unionByName(last.select(table.columns))


def append_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    if "confidence" not in new.columns:
        new = new.withColumn("confidence", F.lit("high"))
    return edges.unionByName(new.select(edges.columns))


def clear_edges(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Without all edges whose source is one of paths(path)."""
    return edges.join(paths.select(F.col("path").alias("source")), "source", "left_anti").select(edges.columns)


def clear_semantic(g: Graph, paths: DataFrame) -> DataFrame:
    """Edges without the definitions and references of files, and the calls of their symbols."""
    own = g.symbols.join(paths.select(F.col("path").alias("file_path")), "file_path", "left_semi").select(F.col("id").alias("source"), F.lit("calls").alias("kind"))
    marks = paths.select(F.col("path").alias("source")).join(F.broadcast(paths.sparkSession.createDataFrame([("defines",), ("references",)], "kind string"))).unionByName(own)  # two rows
    return g.edges.join(marks.distinct(), ["source", "kind"], "left_anti").select(g.edges.columns)


def delete_files(g: Graph, paths: DataFrame) -> Graph:
    by = lambda df, col: df.join(paths.select(F.col("path").alias(col)), col, "left_anti").select(df.columns)
    return g.having(files=by(g.files, "path"), occurrences=by(g.occurrences, "file_path"), edges=by(clear_semantic(g, paths), "source"))


def clear_dirty(dirty: DataFrame, root: str) -> DataFrame:
    """Without the files below a project's root; '.' and '' clear all."""
    return dirty.where(~in_project(F.col("path"), F.lit(root)) | (F.col("path") == root) & F.lit(root not in ("", ".")))


def set_project_time(projects: DataFrame, project_id: str, ts: int) -> DataFrame:
    return projects.withColumn("last_index_ts", F.when(F.col("project_id") == project_id, F.lit(ts).cast("bigint")).otherwise(F.col("last_index_ts")))


def log_events(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """Appends new(timestamp, event, data) with ids after the largest one, in order of time and text."""
    top = ledger.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    return ledger.unionByName(numbered(new, ["timestamp", "event", "data"], "id", top + 1).select("id", "timestamp", "event", "data"))


def numbered(rows: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """rows with consecutive numbers in an order, without bringing them into one task.

    Ranges of the order are sorted apart; their sizes (a row for each partition) tell where each begins.
    """
    parts = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__part": F.spark_partition_id(), "__n": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = {r["__part"]: r["n"] for r in parts.groupBy("__part").agg(F.count("*").alias("n")).collect()}  # one row a partition
    if not sizes:
        return parts.select(*rows.columns, F.lit(start).cast("bigint").alias(name))
    begin, at = {}, start
    for part in sorted(sizes):
        begin[part], at = at, at + sizes[part]
    where = F.create_map(*[F.lit(x) for kv in begin.items() for x in kv])[F.col("__part")]
    return parts.select(*rows.columns, (where + F.col("__n")).cast("bigint").alias(name))


def call_edges(occurrences: DataFrame) -> DataFrame:
    """(source, target): symbol whose definition encloses a reference most closely, and the referred symbol.

    Definitions and references meet by file and block of lines: a definition has the blocks (two at
    most) of the smallest power of four that holds its lines, a reference one block of each size that
    some definition has (at most LEVELS + 1, often one or two). So a reference meets definitions
    around its place only, not all of its file. A definition may have
    enclosing_start and enclosing_end; its own range counts otherwise. No call of itself; a pair
    counts once in a file.
    """
    lo = F.col("enclosing_start") if "enclosing_start" in occurrences.columns else F.col("range_start")
    hi = F.col("enclosing_end") if "enclosing_end" in occurrences.columns else F.col("range_end")
    defs = occurrences.where(S.has_role(F.col("roles"))).select("file_path", F.coalesce(lo, "range_start").alias("d0"), F.coalesce(hi, "range_end").alias("d1"), F.col("symbol_id").alias("source")).where("d0 <= d1")
    first, last = S.line_of(F.col("d0")), S.line_of(F.col("d1"))
    bits = F.length(F.bin(last - first))
    defs = defs.withColumn("level", F.when(last == first, 0).otherwise(F.ceil(bits / 2)).cast("int"))
    defs = defs.withColumn("block", F.explode(F.array_distinct(F.array(F.expr("(d0 >> 16) >> (2 * level)"), F.expr("(d1 >> 16) >> (2 * level)")))))
    defs = written(defs)
    levels = sorted(r["level"] for r in defs.select("level").distinct().collect() if r["level"] <= LEVELS)  # LEVELS + 1 rows at most
    refs = occurrences.where(~S.has_role(F.col("roles"))).select("file_path", "range_start", "range_end", F.col("symbol_id").alias("target"))
    refs = refs.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("block", F.expr("(range_start >> 16) >> (2 * level)"))
    inside = refs.join(defs, ["file_path", "level", "block"]).where("d0 <= range_start AND range_end <= d1")
    best = inside.groupBy("file_path", "range_start", "range_end", "target").agg(F.max_by("source", F.struct("d0", "source")).alias("source"))
    return best.where("source <> target").select("file_path", "source", "target").distinct().select("source", "target", F.lit("calls").alias("kind"), F.lit("approximate").alias("confidence"))


def structural(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Import edges of files(path, language, content); an extracted export gives an exports edge as well."""
    found = resolve(extract_imports(files), known if known is not None else files.select("path"))
    imports = found.select(F.col("path").alias("source"), "target", F.lit("imports").alias("kind"), F.lit("structural").alias("confidence"))
    return imports.unionByName(found.where("kind = 'export'").select(F.col("path").alias("source"), "target", F.lit("exports").alias("kind"), F.lit("structural").alias("confidence")))


def ingest(g: Graph, docs: DataFrame, now: int, hashes: DataFrame | None = None, root: str = "") -> Graph:
    """Graph with decoded index documents (schemas.SCIP_DOCS) merged in.

    hashes(path, hash): documents whose stored hash is the same are skipped. Local and empty
    symbols are left out. A definition gives its symbol the file and range.
    """
    prefix = F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace("relative_path", r"^\./", "")) if root not in ("", ".") else F.regexp_replace("relative_path", r"^\./", "")
    docs = docs.withColumn("path", prefix)
    if hashes is not None:
        same = hashes.join(g.files.select("path", "hash"), ["path", "hash"], "left_semi").select("path")
        docs = docs.join(same, "path", "left_anti").join(hashes, "path", "left")
    else:
        docs = docs.withColumn("hash", F.sha2(F.to_json(F.struct("symbols", "occurrences")), 256))
    paths = docs.select("path").distinct()
    occ = docs.select(F.col("path").alias("file_path"), F.posexplode("occurrences").alias("no", "o")).where("o.symbol IS NOT NULL AND o.symbol <> '' AND NOT startswith(o.symbol, 'local ')")
    r = S.range_of(F.col("o.range"))
    occ = occ.select("file_path", r["start"].alias("range_start"), r["end"].alias("range_end"), F.col("o.symbol").alias("symbol_id"), F.coalesce("o.symbol_roles", F.lit(0)).alias("roles"), "no")
    sym = docs.select("path", F.explode("symbols").alias("s")).where("NOT startswith(s.symbol, 'local ') AND s.symbol <> ''")
    sym = sym.select(F.col("s.symbol").alias("id"), F.coalesce(S.kind_name(F.col("s.kind")), S.inferred_kind(F.col("s.symbol"))).alias("kind"), S.display_name(F.col("s.display_name"), F.col("s.symbol")).alias("name"), F.nullif(F.array_join("s.documentation", "\n"), F.lit("")).alias("doc")).dropDuplicates(["id"])
    home = occ.where(S.has_role(F.col("roles"))).groupBy(F.col("symbol_id").alias("id")).agg(F.max_by(F.struct("file_path", "range_start", "range_end"), F.struct("file_path", "no")).alias("d"))
    sym = sym.join(home, "id", "left").select("id", "kind", "name", F.col("d.file_path").alias("file_path"), F.col("d.range_start").alias("range_start"), F.col("d.range_end").alias("range_end"), "doc")
    old = g.occurrences.join(paths.withColumnRenamed("path", "file_path"), "file_path", "left_anti").select(g.occurrences.columns)
    is_def = S.has_role(F.col("roles"))
    linked = occ.select(F.col("file_path").alias("source"), F.col("symbol_id").alias("target"), F.when(is_def, "defines").otherwise("references").alias("kind"), F.lit("high").alias("confidence"))
    files = docs.select("path", F.coalesce(F.nullif(F.lower("language"), F.lit("")), language_of(F.col("path"))).alias("language"), "hash", F.lit(now).cast("bigint").alias("indexed_at"))
    return g.having(
        files=upsert(g.files, files, schemas.KEYS["files"]),
        symbols=upsert(g.symbols, sym, schemas.KEYS["symbols"]),
        occurrences=upsert(old, occ, schemas.KEYS["occurrences"], "no"),
        edges=append_edges(append_edges(clear_semantic(g, paths), linked), call_edges(occ)),
    )


def update(g: Graph, walked: DataFrame, now: int) -> Graph:
    """walked(path, language, hash, content) against the stored hashes: stale and new files are extracted again and marked dirty."""
    stored = g.files.select("path", F.col("hash").alias("__h"))
    stale = walked.join(stored, "path", "left").where("__h IS NULL OR __h <> hash").drop("__h")
    marks = stale.select("path", F.lit(now).cast("bigint").alias("changed_at"))
    known = g.files.select("path").unionByName(walked.select("path")).distinct()
    structural_kinds = g.edges.where("kind IN ('imports', 'exports')").join(stale.select(F.col("path").alias("source")), "source", "left_anti").select(g.edges.columns)
    kept = g.edges.where("kind NOT IN ('imports', 'exports')").unionByName(structural_kinds)
    return g.having(
        files=upsert(g.files, stale.select("path", "language", "hash", F.lit(now).cast("bigint").alias("indexed_at")), ["path"]),
        edges=append_edges(kept, structural(stale.select("path", "language", "content"), known)),
        dirty=upsert(g.dirty, marks, ["path"]),
    )
