"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Characters that separate words: space and U+0009 to U+000D. bytes.split() uses the same six.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RE = "[\\x20\\x09-\\x0D]+"
WORD_SQL = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new
    local one where that is unset (local mode and tests)."""
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or sc._conf.get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if current is None:
        if not there and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(there or f"file://{tempfile.mkdtemp(prefix='codeloom-')}")
        current = sc.getCheckpointDir()
    return there or current


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/codeloom-{name}-{uuid.uuid4().hex}"


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


SMALL = 1 << 16  #: edges that one task settles; counted first


def _settled(edges: DataFrame) -> DataFrame:
    """connected_components() of few edges, by one task."""

    def run(batches):
        root: dict = {}

        def find(x):
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up]
                x = up
            return x

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, y = find(x), find(y)
                root[max(x, y)] = min(x, y)
        nodes = list(root)
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], ["node", "root"])

    spark_kind = edges.schema["a"].dataType
    kind = to_arrow_type(spark_kind)
    return cut(edges.select("a", "b").coalesce(1).mapInArrow(run, f"node {spark_kind.simpleString()}, root {spark_kind.simpleString()}"))


def connected_components(edges: DataFrame, most_rounds: int = 60, small: int = SMALL) -> DataFrame:
    """(node, root) for every node of edges(a, b); root is the smallest node reachable.

    Up to `small` edges are settled by one task, with the same rows: rounds over few edges
    cost only files, several for each partition of each shuffle. Beyond that it alternates large-star and small-star steps (Kiveris et al. 2014): each is a
    grouped minimum and an equi-join, and needs O(log^2 n) rounds whatever the
    diameter. Every round is checkpointed in the shared folder, so that a lost
    executor costs one round. Null ends and self-links are ignored.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            new = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            low = down.groupBy("a").agg(F.min("b").alias("m"))
            near = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            new = near.unionAll(low.select("a", F.col("m").alias("b")))
        return new.where("a <> b").distinct()

    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if edges.count() <= small:
        return _settled(edges)
    mark = None
    for _ in range(most_rounds):
        edges = cut(star(star(edges, True), False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


# --- whole texts as arrays -------------------------------------------------

U64 = np.uint64
MULT = U64(0x9E3779B97F4A7C15)
P_BYTE, P_WORD = 0x100000001B3 | 1, 0xD6E8FEB86659FD93
_POWERS: dict[tuple[int, int], np.ndarray] = {}
PIECE = 1 << 19  #: bytes or words that are hashed at once, so that memory hardly grows with one text


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls in blocks."""
    size = max(1 << 16, 1 << max(0, n - 1).bit_length())
    if (base, size) not in _POWERS:
        out = np.full(size, base, U64)
        out[0] = 1
        _POWERS[base, size] = np.multiply.accumulate(out)
    return _POWERS[base, size][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64 bits."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(29))) * MULT
    return x ^ (x >> U64(32))


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of every word in an array of bytes that starts and ends with white space.

    The hash is a polynomial in the bytes, taken for all words of a piece at once from running sums.
    Pieces are cut at white space, so the hashes don't depend on them.
    """
    found, low = [], 0
    while True:
        high = low + PIECE
        while high < len(raw) and not (space := IS_SPACE[raw[high : high + PIECE]]).any():
            high += PIECE
        high = high + int(space.argmax()) + 1 if high < len(raw) else len(raw)
        start, end, words = _word_hashes(raw[low:high])
        found.append((start + low, end + low, words))
        if high >= len(raw):
            return tuple(np.concatenate(x) if len(x) > 1 else x[0] for x in zip(*found))
        low = high - 1  # the white space that ends a piece starts the next one


def _word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(IS_SPACE[raw].view(np.int8)))
    start, end = edge[0::2] + 1, edge[1::2] + 1
    if not len(start):
        return start, end, np.zeros(0, U64)
    up = powers(P_BYTE, len(raw))
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * up, out=total[1:])
    # dividing by base**start makes the sum free of the word's place
    inverse = powers(pow(P_BYTE, -1, 1 << 64), len(raw))
    return start, end, mix((total[end] - total[start]) * inverse[start] + (end - start).astype(U64) * MULT)


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes."""
    if len(words) < n:
        return np.zeros(0, U64)
    if len(words) - n >= PIECE:
        return np.concatenate([run_hashes(words[k : k + PIECE + n - 1], n) for k in range(0, len(words) - n + 1, PIECE)])
    up, down = powers(P_WORD, len(words)), powers(pow(P_WORD, -1, 1 << 64), len(words))
    total = np.zeros(len(words) + 1, U64)
    np.cumsum(words * up, out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(words) - n + 1])


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array of bytes, a newline before, between and after; and where each starts."""
    raw = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return raw, 1 + np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(texts) else np.zeros(0, np.int64)


def chunks(ids: list, texts: list, most: int = 1 << 21):
    """(ids, encoded texts) in pieces of about `most` bytes; a longer text stands alone."""
    some_ids, some, size = [], [], 0
    for i, t in zip(ids, texts):
        b = t.encode("utf-8", "surrogatepass") if t else b""
        if some and size + len(b) > most:
            yield some_ids, some
            some_ids, some, size = [], [], 0
        some_ids.append(i)
        some.append(b)
        size += len(b)
    if some:
        yield some_ids, some
