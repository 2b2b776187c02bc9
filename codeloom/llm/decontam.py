"""Benchmark decontamination with SimHash over item-sized windows.

Texts become words: runs of bytes that are neither white space nor ASCII
punctuation, A-Z lower-cased. A document is contaminated by an item if some
window of as many words as the item (all of a shorter document) has

1. a 64-bit SimHash, over its shingles of five words with their counts as
   weights, within `radius` bits of the item's, and
2. a weighted Jaccard similarity of shingle counts (sum of minima over sum of
   maxima) of at least `least`.

A window that reaches a positive similarity has a shingle in common with an item
of its size, so windows are hashed only around shingles of the benchmark: nothing
that passes test 2 is lost. Their fingerprints are looked up in a multi-index of
the items of that size: 64 bits in BLOCKS blocks of 16, and for each block a table
from its value to the items that have it. By the pigeonhole principle an item
within the radius differs in at most radius // BLOCKS bits on some block, so the
tables are read at all values that near, and every item within the radius is a
candidate. At 15 bits and blocks of 16 a random fingerprint is one for 4 % of the
items. Similarities of candidates come from one bag that slides with the window.

A radius of 15 bits is where a similarity of 0.8 lies with two standard deviations
to spare (9.7 bits in the mean, 2.9 of deviation).

Items of fewer than five words have one shingle, all their words. Items with the
same words are one. The benchmark's size is checked: it is read in blocks of at
most `most_bytes` of distinct text (a longer item is a block of its own), one pass
over the documents for each.

Defined results: null or wordless texts and items match nothing; null item ids
are reported as null; a row of docs gives one row for each item that it holds,
so repeated rows repeat; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, chunks, joined, run_hashes, table, word_hashes

SHINGLE, BLOCKS, SPAN, HELD = 5, 4, 1 << 15, 64
RADIUS, LEAST, MOST_BYTES = 15, 0.8, 16 << 20
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
for _c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    FOLD[_c] = 32


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _halves(prints: np.ndarray) -> np.ndarray:
    """(n, BLOCKS) values of the blocks of fingerprints."""
    return np.ascontiguousarray(prints.astype("<u8")).view("<u2").reshape(-1, BLOCKS)


def _flips(most: int) -> np.ndarray:
    """All 16-bit values of at most `most` set bits."""
    x = np.arange(1 << 16, dtype=np.uint16)
    return x[np.bitwise_count(x) <= most]


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """first[0] .. last[0]-1, first[1] .. last[1]-1 and so on."""
    n = last - first
    return np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def _pieces(low: np.ndarray, high: np.ndarray, gap: int):
    """Arrays of the places in the union of the sorted ranges low .. high-1, split at gaps over `gap` and at SPAN words."""
    end = np.maximum.accumulate(high)
    low = np.maximum(low, np.concatenate([low[:1], end[:-1]]))
    some = end > low
    low, high = low[some], end[some]
    new = np.flatnonzero(low[1:] - high[:-1] >= gap) + 1
    for a, z in zip(np.split(low, new), np.split(high, new)):
        at = int(a[0])
        while at < int(z[-1]):
            stop = min(at + SPAN, int(z[-1]))
            lo, hi = np.clip(a, at, stop), np.clip(z, at, stop)
            if len(run := _ranges(lo, hi)):
                yield run
            at = stop


class Table:
    """The multi-index over the fingerprints of the items of one size."""

    def __init__(self, prints: np.ndarray):
        self.prints, halves = prints, _halves(prints)
        self.order = np.argsort(halves, axis=0, kind="stable").T
        self.first = [np.concatenate([[0], np.cumsum(np.bincount(halves[:, b], minlength=1 << 16))]).astype(np.int32) for b in range(BLOCKS)]

    def near(self, probes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(place in probes, place in prints) of all pairs within the radius, and how many pairs were candidates."""
        flips, n, keys = _flips(radius // BLOCKS), len(self.prints), []
        halves = _halves(probes)
        for b in range(BLOCKS):
            values, back = np.unique(halves[:, b], return_inverse=True)
            at, item = [], []
            for k in range(0, len(values), 1024):
                seen = (values[k : k + 1024, None] ^ flips).astype(np.int64)
                low, high = self.first[b][seen], self.first[b][seen + 1]
                row, col = np.nonzero(high > low)
                low, high = low[row, col], high[row, col]
                at.append(np.repeat(row + k, high - low))
                item.append(self.order[b][_ranges(low, high)])
            at, item = np.concatenate(at), np.concatenate(item)
            # values back to the probes that have them
            by_value, many = np.argsort(back, kind="stable"), np.bincount(back, minlength=len(values))
            start = np.concatenate([[0], np.cumsum(many)[:-1]])
            keys.append(by_value[_ranges(start[at], start[at] + many[at])] * n + np.repeat(item, many[at]))
        key = np.unique(np.concatenate(keys))
        probe, item = key // n, key % n
        close = np.bitwise_count(probes[probe] ^ self.prints[item]) <= radius
        return probe[close], item[close], len(key)


class Index:
    """The items of one block of the benchmark, in arrays: about 40 bytes for each word."""

    def __init__(self, items: list[tuple], radius: int = RADIUS, least: float = LEAST):
        self.ids, self.radius, self.least, self.candidates, self.compared = [], radius, least, 0, 0
        sizes, prints, found = [], [], []
        for item, text in items:
            raw, _ = joined([(text or "").encode("utf-8", "surrogatepass")])
            words = word_hashes(FOLD[raw])[2]
            if not len(words):
                continue
            grams = run_hashes(words, min(SHINGLE, len(words)))
            self.ids.append(item)
            sizes.append(len(words))
            found.append(grams)
            prints.append(np.packbits(2 * _bits(grams).sum(0, dtype=np.int64) > len(grams), bitorder="little").view("<u8")[0])
        self.sizes, self.prints = np.array(sizes, np.int64), np.array(prints, U64)
        self.first = np.concatenate([[0], np.cumsum([len(g) for g in found])]).astype(np.int64)
        self.grams = np.concatenate(found) if found else np.zeros(0, U64)
        of_gram = np.repeat(self.sizes, np.diff(self.first))
        self.probes = {}
        for width in sorted(set(np.minimum(self.sizes, SHINGLE).tolist())):  # shingle -> sizes of its items
            own = np.minimum(of_gram, SHINGLE) == width
            order = np.lexsort((of_gram[own], self.grams[own]))
            g, s = self.grams[own][order], of_gram[own][order]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1])
            g, s = g[new], s[new]
            known, start = np.unique(g, return_index=True)
            bitmap = np.zeros(1 << max(16, (16 * len(known)).bit_length()), bool)
            bitmap[known & U64(len(bitmap) - 1)] = True
            self.probes[width] = known, np.append(start, len(g)), s, bitmap
        self.tables: OrderedDict[int, tuple] = OrderedDict()

    def table(self, size: int) -> tuple[Table, np.ndarray]:
        """The table of the items of a size and their places; the HELD used last are kept."""
        if size not in self.tables:
            own = np.flatnonzero(self.sizes == size)
            self.tables[size] = Table(self.prints[own]), own
            if len(self.tables) > HELD:
                self.tables.popitem(last=False)
        self.tables.move_to_end(size)
        return self.tables[size]

    def items_near(self, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in prints, item) for all items of that size within the radius, by item."""
        index, own = self.table(size)
        at, item, seen = index.near(prints, self.radius)
        self.candidates += seen
        self.compared += len(prints) * len(own)
        order = np.lexsort((at, item))
        return at[order], own[item[order]]

    def matches(self, texts: list[bytes]):
        """(text, item, best similarity, first word of the best window, windows) for each pair found."""
        raw, begin = joined(texts)
        start, _, words = word_hashes(FOLD[raw])
        first = np.searchsorted(start, begin)
        last = np.append(first[1:], len(words))
        owner = np.repeat(np.arange(len(texts)), last - first)
        for width, (known, offset, sizes, bitmap) in self.probes.items():
            grams = run_hashes(words, width)
            hit = np.flatnonzero(bitmap[grams & U64(len(bitmap) - 1)])
            at = np.minimum(np.searchsorted(known, grams[hit]), len(known) - 1)
            real = (known[at] == grams[hit]) & (owner[hit] == owner[hit + width - 1])
            hit, at = hit[real], at[real]
            many = offset[at + 1] - offset[at]
            place, size = np.repeat(hit, many), sizes[_ranges(offset[at], offset[at + 1])]
            order = np.lexsort((place, size, owner[place]))
            place, size = place[order], size[order]
            new = np.flatnonzero((np.diff(size) != 0) | (np.diff(owner[place]) != 0)) + 1
            for places, s in zip(np.split(place, new), size[np.concatenate([[0], new])] if len(place) else ()):
                doc = int(owner[places[0]])
                yield from self._windows(doc, int(s), width, places, grams, int(first[doc]), int(last[doc]))

    def _windows(self, doc, size, width, places, grams, low, high):
        n = min(size, high - low)
        seen: dict[int, list] = {}
        count = n - width + 1  # shingles in a window
        for run in _pieces(np.maximum(low, places + width - n), np.minimum(places, high - n) + 1, n):  # neighbouring starts share one running sum
            a, z = int(run[0]), int(run[-1])
            total = np.zeros((z - a + count + 1, 64), np.int32)
            np.cumsum(_bits(grams[a : z + count]), axis=0, out=total[1:])
            ones = total[run - a + count] - total[run - a]
            prints = np.packbits(2 * ones > count, axis=1, bitorder="little").view("<u8")[:, 0]
            at, items = self.items_near(size, prints)
            new = np.flatnonzero(np.diff(items)) + 1
            for some, k in zip(np.split(run[at], new), items[np.concatenate([[0], new])].tolist() if len(items) else ()):
                for s, similar in zip(some.tolist(), self.similarities(k, some, grams, count)):
                    if similar >= self.least:
                        best = seen.setdefault(k, [0.0, 0, 0])
                        best[2] += 1
                        if similar > best[0]:
                            best[:2] = similar, s - low
        for k, (similar, at, windows) in sorted(seen.items()):
            yield doc, self.ids[k], similar, at, windows

    def similarities(self, k: int, starts: np.ndarray, grams: np.ndarray, count: int):
        """Weighted Jaccard similarity of item k and the windows of `count` shingles at sorted starts."""
        item = self.grams[self.first[k] : self.first[k + 1]]
        names, want = np.unique(item, return_counts=True)
        a, z = int(starts[0]), int(starts[-1]) + count
        own = np.minimum(np.searchsorted(names, grams[a:z]), len(names) - 1)
        own = np.where(names[own] == grams[a:z], own, -1).tolist()
        want, have, both, low, high = want.tolist(), Counter(), 0, a, a
        for s in starts.tolist():
            if s >= high:  # nothing of the last window is left
                have, both, low, high = Counter(), 0, s, s
            while high < s + count:
                g = own[high - a]
                if g >= 0:
                    both += have[g] < want[g]
                    have[g] += 1
                high += 1
            while low < s:
                g = own[low - a]
                if g >= 0:
                    have[g] -= 1
                    both -= have[g] < want[g]
                low += 1
            yield both / (count + len(item) - both)


def _indexes(benchmark: DataFrame, item_text_col: str, radius: int, least: float, most_bytes: int):
    """An index for each block of the benchmark's distinct texts, by the SHA-256 of the text."""
    items = benchmark.select(F.col(item_text_col).cast("string").alias("text")).where("text IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 64 * -(-size // most_bytes) if size > most_bytes else 1
    items = items.withColumn("key", F.sha2("text", 256)).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(n)))
    parts = {0: size} if n == 1 else {r.part: r.size for r in items.groupBy("part").agg(F.sum(F.octet_length("text")).alias("size")).collect()}
    blocks, room = [[]], most_bytes
    for part, own in sorted(parts.items()):
        if own > room and blocks[-1]:
            blocks.append([])
            room = most_bytes
        blocks[-1].append(part)
        room -= own
    for block in blocks:
        rows = items.where(F.col("part").isin(block)).select("key", "text").collect()  # most_bytes, or one part of long items
        yield Index(sorted((r.key, r.text) for r in rows), radius, least)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", radius: int = RADIUS, least: float = LEAST, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_windows). No shuffle of documents, only of what is found."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {kind}, key string, similarity double, start_word bigint, n_windows bigint"
    out = None
    for index in _indexes(benchmark, item_text_col, radius, least, most_bytes):

        def run(batches, index=index):
            for b in batches:
                cols: list[list] = [[], [], [], [], []]
                for ids, texts in chunks(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for doc, *rest in index.matches(texts):
                        for col, v in zip(cols, (ids[doc], *rest)):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], ["doc_id", "key", "similarity", "start_word", "n_windows"])

        new = text.mapInArrow(run, schema)
        out = new if out is None else out.unionAll(new)
    names = benchmark.select(F.col(item_col).alias("item_id"), F.sha2(F.col(item_text_col).cast("string"), 256).alias("key"))
    return out.join(names, "key").select("doc_id", "item_id", "similarity", "start_word", "n_windows")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text", radius: int = RADIUS, least: float = LEAST, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows of docs whose own text holds no item, whatever their ids. No shuffle."""
    at = docs.columns.index(text_col)
    for index in _indexes(benchmark, item_text_col, radius, least, most_bytes):

        def run(batches, index=index):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                texts = b.column(at).cast(pa.string()).to_pylist()
                for rows, some in chunks(list(range(len(texts))), texts):
                    keep[[rows[doc] for doc, *_ in index.matches(some)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.withColumn("similarity", F.round("similarity", 6))
