"""Breadth-first search, call graphs and strongly connected components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import stem
from ..functions.symbols import has_role
from ..plans.graph import Graph
from ..runtime import cut, near, written

#: Edges that a task adds before it shrinks what it holds.
BLOCK = 1_500_000


def reach(seeds: DataFrame, step, depth: int) -> DataFrame:
    """(node, depth, rank, via) from seeds(node): level by level, each node at its first level.

    step(frontier) gives (node, rank, via); the smallest (rank, via) is the reason. One join a
    level, checkpointed; ends when a level is empty. Seeds have depth 0. A level (and what is seen)
    of at most NEAR nodes goes to all executors, so that the edges stay where they are.
    """
    seen = cut(seeds.select("node", F.lit(0).alias("depth"), F.lit(0).alias("rank"), F.lit(None).cast("string").alias("via")).distinct())
    frontier = seen
    for d in range(1, depth + 1):
        found = step(near(frontier.select("node"))).where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("rank", "via")).alias("r"))
        found = found.join(near(seen.select("node")), "node", "left_anti")
        frontier = cut(found.select("node", F.lit(d).alias("depth"), "r.rank", "r.via"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def importers(g: Graph, frontier: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(node, via): sources of edges to a file or to its path without extension; any kind unless told."""
    keys = frontier.select(F.col("node").alias("via"), F.explode(F.array_distinct(F.array("node", stem(F.col("node"))))).alias("target"))
    edges = g.edges if kinds is None else g.edges.where(F.col("kind").isin(kinds))
    return edges.join(keys, "target").select(F.col("source").alias("node"), "via")


def referrers(g: Graph, frontier: DataFrame, references_only: bool = False) -> DataFrame:
    """(node, via, symbol_id): files with an occurrence of a symbol that a frontier file defines."""
    defs = definitions(g).join(frontier.select(F.col("node").alias("via")), "via").select("symbol_id", "via")
    uses = g.occurrences.where(~has_role(F.col("roles"))) if references_only else g.occurrences
    return uses.join(defs, "symbol_id").select(F.col("file_path").alias("node"), "via", "symbol_id")


def definitions(g: Graph) -> DataFrame:
    """(symbol_id, via): symbols and the files that define them."""
    return g.occurrences.where(has_role(F.col("roles"))).select("symbol_id", F.col("file_path").alias("via")).distinct()


def calls_by_file(g: Graph) -> DataFrame:
    """(symbol_id, node): called symbols and the files of the symbols that call them."""
    homes = g.symbols.where("file_path IS NOT NULL").select(F.col("id").alias("source"), F.col("file_path").alias("node"))
    return g.edges.where("kind = 'calls'").select("source", F.col("target").alias("symbol_id")).join(homes, "source").select("symbol_id", "node")


class Uses:
    """Uses(symbol_id, node) as steps from files that define a symbol to its nodes.

    Uses of a symbol with one file are stored as pairs of files, once for all levels of a search;
    those of a symbol with several stay with the symbol, so that a level tells each of its uses
    once and no product of definitions and uses is made.
    """

    def __init__(self, defs: DataFrame, uses: dict[int, DataFrame]):
        homes = written(defs.groupBy("symbol_id").agg(F.count("*").alias("n"), F.min("via").alias("via")))
        many = homes.where("n > 1").select("symbol_id")
        ranked = [df.where("node IS NOT NULL").withColumn("rank", F.lit(rank)) for rank, df in uses.items()]
        self.pairs = [written(df.join(homes.where("n = 1").select("symbol_id", "via"), "symbol_id").select("via", "node", "rank")) for df in ranked]
        self.shared = []
        if not many.isEmpty():
            self.defs = written(defs.join(many, "symbol_id", "left_semi"))
            self.shared = [written(df.join(many, "symbol_id", "left_semi")) for df in ranked]

    def step(self, frontier: DataFrame) -> DataFrame:
        """(node, rank, via), via being the smallest file of the frontier that defines a shared symbol."""
        f = frontier.select(F.col("node").alias("via"))
        out = [df.join(f, "via").select("node", "rank", "via") for df in self.pairs]
        if self.shared:
            now = near(cut(self.defs.join(f, "via").groupBy("symbol_id").agg(F.min("via").alias("via"))))
            out += [df.join(now, "symbol_id").select("node", "rank", "via") for df in self.shared]
        return reduce(DataFrame.unionByName, out)


def call_graph(g: Graph, symbol_id: str, depth: int = 1) -> DataFrame:
    """(direction, id, name, kind, file_path, depth): callers and callees within `depth` calls; unknown ids count as steps but aren't shown.

    Levels, not a depth-first walk, so that a symbol is found whenever a path of that length
    exists. The symbol itself is listed if a cycle leads back to it.
    """
    calls = g.edges.where("kind = 'calls'").select("source", "target").distinct()
    out = None
    for direction, a, b in (("caller", "target", "source"), ("callee", "source", "target")):
        found = frontier = None
        for d in range(1, depth + 1):
            now = calls.where(F.col(a) == symbol_id) if frontier is None else calls.join(frontier.select(F.col("id").alias(a)), a)
            now = now.select(F.col(b).alias("id")).distinct()
            now = now if found is None else now.join(found.select("id"), "id", "left_anti")
            frontier = cut(now.withColumn("depth", F.lit(d)))
            found = frontier if found is None else found.unionByName(frontier)
        rows = found.join(g.symbols, "id").select(F.lit(direction).alias("direction"), "id", "name", "kind", "file_path", "depth")
        out = rows if out is None else out.unionByName(rows)
    return out


def _strong(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Label (a member) of the strongly connected component of each of n nodes, by Tarjan's algorithm without recursion."""
    order = np.argsort(a, kind="stable")
    start, heads = np.searchsorted(a[order], np.arange(n + 1)).tolist(), b[order].tolist()
    at, number, low, label = start[:n], [0] * n, [0] * n, [-1] * n
    stack, count = [], 0
    for root in range(n):
        if number[root]:
            continue
        count += 1
        number[root] = low[root] = count
        stack.append(root)
        work = [root]
        while work:
            node = work[-1]
            k = at[node]
            if k < start[node + 1]:
                at[node] = k + 1
                x = heads[k]
                if not number[x]:
                    count += 1
                    number[x] = low[x] = count
                    stack.append(x)
                    work.append(x)
                elif label[x] < 0 and number[x] < low[node]:
                    low[node] = number[x]
            else:
                work.pop()
                if work and low[node] < low[work[-1]]:
                    low[work[-1]] = low[node]
                if low[node] == number[node]:
                    while label[node] < 0:
                        label[stack.pop()] = node
    return np.array(label, dtype=np.int64)


def _joined(batches: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Names, and the distinct edges as numbers of names."""
    names = pa.concat_arrays([x[c].cast(pa.large_string()) for c in ("a", "b") for x in batches]).dictionary_encode()
    ids, n = names.indices.to_numpy().astype(np.int64), len(names.dictionary)
    pairs = np.unique(ids[: len(ids) // 2] * n + ids[len(ids) // 2:])
    return names.dictionary, pairs // max(n, 1), pairs % max(n, 1)


def _out(names: pa.Array, a: np.ndarray, b: np.ndarray, columns: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(a), 10_000):
        yield pa.record_batch([names.take(pa.array(x[k:k + 10_000])).cast(pa.string()) for x in (a, b)], names=list(columns))


def _shrunk(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    """Edges with the same components: a ring through each component, and one edge for all between two of them."""
    names, a, b = _joined(batches)
    n = len(names)
    label = _strong(n, a, b)
    x, y = label[a], label[b]
    links = np.unique(x[x != y] * n + y[x != y])
    ring = np.argsort(label, kind="stable")
    first = np.flatnonzero(np.diff(label[ring], prepend=-1))
    after = np.roll(ring, -1)
    after[np.append(first[1:], n) - 1] = ring[first]
    ring, after = ring[ring != after], after[ring != after]
    return list(_out(names, np.append(links // n, ring), np.append(links % n, after), ("a", "b")))


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shrinks edges as they come; holds at most twice BLOCK of them."""
    held, n, kept = [], 0, 0
    for x in batches:
        held.append(x)
        n += x.num_rows
        if n >= kept + BLOCK:
            held = _shrunk(held)
            n = kept = sum(h.num_rows for h in held)
            if kept > BLOCK:
                yield from held
                held, n, kept = [], 0, 0
    if n > kept:
        held = _shrunk(held)
    yield from held


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges, held by this task."""
    held = [x for x in batches if x.num_rows]
    if held:
        names, a, b = _joined(held)
        label = _strong(len(names), a, b)
        order = pc.sort_indices(names).to_numpy().astype(np.int64)
        groups, smallest, size = np.unique(label[order], return_index=True, return_counts=True)
        at = np.searchsorted(groups, label)
        some = np.flatnonzero(size[at] > 1)
        yield from _out(names, some, order[smallest[at[some]]], ("node", "component"))


def _propagate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, low): smallest node that reaches each node, by passing minima along edges until none changes."""
    labels = cut(nodes.select("node", F.col("node").alias("low")))
    while True:
        told = edges.join(labels.withColumnRenamed("node", "a"), "a").groupBy("b").agg(F.min("low").alias("told")).withColumnRenamed("b", "node")
        new = cut(labels.join(told, "node", "left").select("node", F.least("low", "told").alias("low"), (F.col("told") < F.col("low")).alias("changed")))
        labels = new.select("node", "low")
        if new.where("changed").isEmpty():
            return labels


def components(edges: DataFrame, local_edges: int = 3_000_000) -> DataFrame:
    """(node, component) of strongly connected components of two or more nodes; component is the smallest member.

    Tasks replace the components among the edges that they read by rings, and edges between these
    by one each, which changes no component and leaves little of a dense graph. Few tasks then do
    so with what is left, as long as it shrinks. At most local_edges edges (counted first) are
    settled by one task. Beyond that, rounds of colouring: the smallest node that reaches a node is
    its colour; nodes of a colour that reach back to it are a component and leave; edges between
    colours leave too. All ways give the same rows.
    """
    e = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).where("a <> b")
    tasks, before = 2 * e.sparkSession.sparkContext.defaultParallelism, None
    while True:
        e = written(e.coalesce(tasks).mapInArrow(_shrink, "a string, b string"))
        n = e.count()
        if n <= local_edges:
            return e.coalesce(1).mapInArrow(_settle, "node string, component string")
        if tasks == 1 or before is not None and n > 0.7 * before:
            break
        tasks, before = max(1, tasks // 8), n
    e = e.distinct()
    done = None
    while not e.isEmpty():
        live = e.select(F.col("a").alias("node")).intersect(e.select(F.col("b").alias("node")))
        nodes = live
        e = cut(e.join(live.withColumnRenamed("node", "a"), "a", "left_semi").join(live.withColumnRenamed("node", "b"), "b", "left_semi"))
        colour = _propagate(nodes, e)
        same = e.join(colour.select(F.col("node").alias("a"), F.col("low").alias("ca")), "a").join(colour.select(F.col("node").alias("b"), F.col("low").alias("cb")), "b").where("ca = cb")
        back = same.select(F.col("b").alias("a"), F.col("a").alias("b"), "ca")
        reached = reach(colour.where("node = low").select("node"), lambda f: back.join(f.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), F.lit(0).alias("rank"), F.lit("").alias("via")), 1_000_000)
        part = cut(reached.select("node").join(colour, "node").select("node", F.col("low").alias("component")))
        big = part.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
        new = part.join(big, "component").select("node", "component")
        done = new if done is None else done.unionByName(new)
        left = same.select("a", "b").join(part.select(F.col("node").alias("a")), "a", "left_anti").join(part.select(F.col("node").alias("b")), "b", "left_anti")
        e = cut(left)
    return done if done is not None else e.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)


def cycles(g: Graph, scope: str | None = None, local_edges: int = 3_000_000) -> DataFrame:
    """(first, members, size) of the import cycles; a file that imports only itself is none."""
    e = g.edges.where("kind = 'imports'")
    e = e.where(F.col("source").startswith(scope)) if scope else e
    out = components(e, local_edges).groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("members"))
    return out.select(F.col("component").alias("first"), "members", F.size("members").alias("size"))
