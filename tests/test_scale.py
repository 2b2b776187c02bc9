"""What searches, cycles and derived tables read, store and move."""

import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeloom.operators import changes, impact, traverse
from codeloom.plans import catalog, graph
from codeloom.runtime import near

FOLDER = "/root/testdata/sf0.001"
D, R = 1, 8
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def batches(pairs, n=5):
    return iter([pa.record_batch([pa.array([p[i] for p in pairs[k:k + n]], pa.string()) for i in (0, 1)], names=["a", "b"]) for k in range(0, len(pairs), n)])


def told(found):
    return sorted(tuple(r.values()) for x in found for r in x.to_pylist())


def test_dense_edges_shrink_to_a_ring(monkeypatch):
    monkeypatch.setattr(traverse, "BLOCK", 100)
    names = [f"é{k}" for k in range(30)]
    pairs = [(a, b) for a in names for b in names if a != b] + [(a, "sink") for a in names] + [("spring", a) for a in names]
    left = told(traverse._shrink(batches(pairs)))
    assert len(left) <= len(names) + 2 * len(names)
    assert told(traverse._settle(batches(left))) == sorted((a, min(names)) for a in names)
    assert told(traverse._settle(iter([]))) == [] == told(traverse._shrink(iter([])))


@pytest.mark.parametrize("seed", range(30))
def test_shrunk_edges_have_the_same_components(monkeypatch, seed):
    monkeypatch.setattr(traverse, "BLOCK", 6)
    rnd = random.Random(seed)
    pairs = [(f"n{rnd.randrange(14)}", f"n{rnd.randrange(14)}") for _ in range(rnd.choice([3, 15, 30]))]
    pairs = [p for p in pairs if p[0] != p[1]]
    reach = {x: {b for a, b in pairs if a == x} for p in pairs for x in p}
    for _ in reach:
        for s in reach.values():
            s |= {y for x in list(s) for y in reach[x]}
    want = sorted((a, min([a, *(b for b in s if a in reach[b])])) for a, s in reach.items() if any(b != a and a in reach[b] for b in s))
    assert told(traverse._settle(batches(pairs))) == want
    assert told(traverse._settle(traverse._shrink(batches(pairs)))) == want


def _edges_of_cycles(spark, monkeypatch, name):
    seen, run = [], traverse.components
    monkeypatch.setattr(traverse, "components", lambda e, *n: seen.append(plan(e)) or run(e, *n))
    catalog.QUERIES[name](spark, FOLDER)
    return seen


@tables
@pytest.mark.parametrize("name", ["policy_violations", "metrics_diff_cycles"])
def test_both_states_read_stored_edges(spark, monkeypatch, name):
    seen = _edges_of_cycles(spark, monkeypatch, name)
    assert len(seen) == 2 and not any("l_orderkey" in p for p in seen)


@tables
def test_checks_store_edges_of_modules_only(spark, monkeypatch):
    kinds, run = [], catalog.verify.verify
    monkeypatch.setattr(catalog.verify, "verify", lambda g, *a: kinds.extend(r.kind for r in g.edges.select("kind").distinct().collect()) or run(g, *a))
    catalog._all_issues(spark, FOLDER)
    assert sorted(kinds) == ["exports", "imports"]


def test_references_meet_only_sizes_that_definitions_have(spark):
    at = lambda line: line << 16
    occ = spark.createDataFrame([("f", at(3), at(13), "outer", D), ("f", at(5), at(5) + 3, "inner", R)], "file_path string, range_start int, range_end int, symbol_id string, roles int")
    calls = changes.call_edges(occ)
    assert [tuple(r)[:2] for r in calls.collect()] == [("outer", "inner")]
    assert "explode([2])" in plan(calls)
    assert changes.call_edges(occ.where("roles = 8")).count() == 0


def _search(spark, seed, calls):
    rnd = random.Random(seed)
    f, s = [f"d/f{k}.ts" for k in range(12)], [f"s{k}" for k in range(8)]
    occ = [(rnd.choice(f), k, k + 1, rnd.choice(s), rnd.choice([D, D, R])) for k in range(16)]
    symbols = [(x, "function", x, rnd.choice([*f, None]), 0, 1, None) for x in s]
    edges = [(rnd.choice(f), rnd.choice(f)[:rnd.choice([4, 20])], "imports", "high") for _ in range(4)] + [(rnd.choice(s), rnd.choice(s), "calls", "high") for _ in range(4)]
    home, stem = {x[0]: x[3] for x in symbols}, lambda p: p.rsplit(".", 1)[0]
    seen, level, want = {f[0]}, {f[0]}, {}
    for depth in range(1, 4):
        now = {}
        for via in level:
            mine = {o[3] for o in occ if o[0] == via and o[4] == D}
            steps = [(o[0], 0, "references symbol from ") for o in occ if o[3] in mine] + [(e[0], 1, "imports ") for e in edges if e[1] in (via, stem(via))]
            steps += [(home[e[0]], 2, "calls into ") for e in edges if calls and e[2] == "calls" and e[1] in mine and home[e[0]]]
            for node, rank, word in steps:
                if node not in seen:
                    now[node] = min(now.get(node, (9,)), (rank, via, word + via))
        want |= {x: (x, depth, r[2]) for x, r in now.items()}
        seen, level = seen | set(now), set(now)
    return graph.graph_of(spark, occurrences=occ, symbols=symbols, edges=edges), f[0], sorted(want.values())


@pytest.mark.parametrize("seed", range(4))
def test_affected_equals_search_file_by_file(spark, seed):
    g, start, want = _search(spark, seed, calls=seed % 2 == 1)
    got = impact.affected(g, impact.path_rows(spark, [start]), 3, seed % 2 == 1)
    assert sorted(map(tuple, got.collect())) == want


def test_levels_move_no_uses_and_make_no_product(spark):
    defs = spark.createDataFrame([("one", "a")] + [("many", f"d{k}") for k in range(20)], "symbol_id string, via string")
    uses = spark.createDataFrame([("one", "x")] + [("many", f"u{k}") for k in range(20)], "symbol_id string, node string")
    u = traverse.Uses(defs, {0: uses})
    assert u.pairs[0].count() == 1 and u.shared[0].count() == 20
    frontier = spark.createDataFrame([("a",), ("d3",), ("d2",)], "node string")
    assert sorted(map(tuple, u.step(frontier).collect())) == sorted([("x", 0, "a")] + [(f"u{k}", 0, "d2") for k in range(20)])
    assert "SortMergeJoin" not in (p := u.step(near(frontier))._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning" not in p


ORDERS = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string"


@pytest.mark.parametrize("name", sorted(graph.KEYED))
def test_tables_by_keys_equal_their_sql(spark, name):
    rnd = random.Random(5)
    pick = lambda n: rnd.choice([None, *range(n)])
    lines = spark.createDataFrame([(pick(6), pick(20), pick(16), pick(4), rnd.choice("RAN")) for _ in range(150)] * 2, ORDERS)
    part = spark.createDataFrame([(k, "t", f"p{k}", k % 5, "b") for k in range(20)], "p_partkey long, p_type string, p_name string, p_size int, p_brand string")
    supplier = spark.createDataFrame([(k, 4000.0 + 300 * k) for k in range(7)], "s_suppkey long, s_acctbal double")
    out = []
    for form in (graph.DERIVED, graph.KEYED):
        text = graph._with_frames(form[name].replace("% N)", "% 7)").replace("% N ", "% 7 "))
        frames = {"lineitem": lines, "part": part} | ({"supplier": supplier} if name == "edges" else {})
        df = spark.sql(text, **frames)
        out.append((df.dtypes, sorted(map(repr, df.collect()))))
    assert out[0] == out[1] and len(out[0][1]) > 100


def test_stored_tables_are_read_by_columns(spark):
    g = graph.graph_of(spark, occurrences=[("f", 1, 2, "s", D)]).stored("occurrences", "edges")
    p = g.occurrences.select("file_path")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<file_path:string>" in p
    assert [tuple(r) for r in g.occurrences.collect()] == [("f", 1, 2, "s", D)] and g.edges.count() == 0
