"""Module and symbol graphs, and their text forms."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.symbols import has_role
from ..plans.graph import Graph


def nodes(g: Graph, scope: str | None = None) -> DataFrame:
    out = g.files.select("path", "language")
    return out.where(F.col("path").startswith(scope)) if scope else out


def import_edges(g: Graph, scope: str | None = None) -> DataFrame:
    """(from, to, kind, weight): imports and exports, a bag; scope holds for sources only."""
    out = g.edges.where("kind IN ('imports', 'exports')")
    out = out.where(F.col("source").startswith(scope)) if scope else out
    return out.select(F.col("source").alias("from"), F.col("target").alias("to"), "kind", F.lit(None).cast("bigint").alias("weight"))


def semantic_edges(g: Graph, scope: str | None = None) -> DataFrame:
    """Reference occurrences of symbols in other files, counted for each pair of files in scope."""
    refs = g.occurrences.where(~has_role(F.col("roles"))).select(F.col("file_path").alias("from"), "symbol_id")
    home = g.symbols.where("file_path IS NOT NULL").select(F.col("id").alias("symbol_id"), F.col("file_path").alias("to"))
    out = refs.join(home, "symbol_id").where("`from` <> `to`").groupBy("from", "to").agg(F.count("*").alias("weight"))
    known = nodes(g, scope).select("path")
    for end in ("from", "to"):
        out = out.join(known.withColumnRenamed("path", end), end, "left_semi")
    return out.select("from", "to", F.lit("semantic").alias("kind"), "weight")


def hybrid_edges(g: Graph, scope: str | None = None) -> DataFrame:
    imports = import_edges(g, scope).groupBy("from", "to").agg(F.min("kind").alias("i"))
    semantic = semantic_edges(g, scope).select("from", "to", "weight")
    both = imports.join(semantic, ["from", "to"], "full_outer")
    kind = F.when(F.col("i").isNull(), "semantic").when(F.col("weight").isNull(), "import").otherwise("import+semantic")
    return both.select("from", "to", kind.alias("kind"), "weight")


def graph(g: Graph, scope: str | None = None, mode: str = "imports") -> tuple[DataFrame, DataFrame]:
    return nodes(g, scope), {"imports": import_edges, "semantic": semantic_edges, "hybrid": hybrid_edges}[mode](g, scope)


def symbol_graph(g: Graph, symbol_id: str, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """Files with an occurrence of a symbol, its own file first, and their edges to it."""
    home = g.symbols.where(F.col("id") == symbol_id).select(F.col("file_path").alias("path"), F.lit(True).alias("is_def")).where("path IS NOT NULL")
    uses = g.occurrences.where(F.col("symbol_id") == symbol_id).select(F.col("file_path").alias("path"), F.lit(False).alias("is_def"))
    found = home.unionByName(uses).groupBy("path").agg(F.max("is_def").alias("is_def")).orderBy(F.desc("is_def"), "path").limit(most)
    rows = found.join(g.files.select("path", "language"), "path", "left").select("path", F.coalesce("language", F.lit("unknown")).alias("language"), "is_def")
    edges = found.where("NOT is_def").select(F.col("path").alias("from")).join(F.broadcast(home.select(F.col("path").alias("to")))).select("from", "to", F.lit("references").alias("kind"))  # one row
    return rows.select("path", "language"), edges


def mermaid_ids(paths: DataFrame) -> DataFrame:
    return paths.select("path", F.regexp_replace("path", r"[/.\-]", "_").alias("id"))


def dot_lines(edges: DataFrame) -> DataFrame:
    """One attribute line of a DOT graph for each edge."""
    q = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    weight = F.when(F.col("weight").isNull(), F.lit("")).otherwise(F.concat(F.lit(", weight="), F.col("weight").cast("string")))
    return edges.select(F.concat(F.lit("  "), q("from"), F.lit(" -> "), q("to"), F.lit(' [label="'), F.col("kind"), F.lit('"'), weight, F.lit("];")).alias("line"))


def to_dot(node_rows: list, edge_rows: list) -> str:
    """DOT text of a drawn (small, collected) graph."""
    q = lambda s: json.dumps(s, ensure_ascii=False)
    lines = ["digraph module_graph {", "  rankdir=LR;", "  node [shape=box, style=rounded];", *(f"  {q(n['path'])};" for n in node_rows)]
    for e in edge_rows:
        w = f", weight={e['weight']}" if e["weight"] is not None else ""
        lines.append(f"  {q(e['from'])} -> {q(e['to'])} [label={q(e['kind'])}{w}];")
    return "\n".join([*lines, "}"])


def to_mermaid(node_rows: list, edge_rows: list) -> str:
    name = lambda p: re.sub(r"[/.\-]", "_", p)
    lines = ["graph LR", *(f'  {name(n["path"])}["{n["path"]}"]' for n in node_rows)]
    return "\n".join(lines + [f"  {name(e['from'])} -->|{e['kind']}| {name(e['to'])}" for e in edge_rows])
