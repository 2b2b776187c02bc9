"""SimHash near-duplicates through covering locality-sensitive hashing.

Two documents are linked if their 64-bit fingerprints differ in at most `radius`
bits; a class is a connected component of links. Fingerprints come from all
shingles of the whole text. Distinct fingerprints (not documents) are linked, so
a group of copies of any size is one row from the first aggregate on.

Candidates: each bit is given a non-zero vector of radius + 1 bits, and table v
keeps the bits whose vector has an odd inner product with v (Pagh 2016, covering
LSH). Some v is orthogonal to the vectors of any `radius` differing bits, so
every pair within the radius falls into one bucket of at least one of the
2**(radius+1) - 1 tables: recall is exactly 1, with no random failures.

Buckets over `most` fingerprints are dealt anew by blocks of the bits that
their mask leaves free (of radius + 1 blocks, one is equal in any pair within
the radius), until they are small or so few bits are free that a bucket can't
hold more than 2**FREE distinct values. No bucket is capped or sampled. A bucket
yields the spanning stars of its components, never its pairs.

near_dedup() removes near-duplicates of a five-word similarity. Such texts lie many
bits apart in fingerprints of shingles, as one changed word changes five of them,
and few in fingerprints of their distinct words: 4 bits in the mean at 0.8. So it
links texts whose word fingerprints are within NEAR bits and whose sets of shingles
have a Jaccard similarity of `percent` or more. Candidates come from covering
masks as above, over the halves of the fingerprint: of any two texts within 8 bits
one half differs in at most 4 bits or the other in at most 3, so 31 and 15 tables
of about 16 bits find all of them. It works on distinct sets of shingles.

1. In some of the tables each set names the nearest sets of its bucket, which takes
   groups of copies together at the cost of two pairs a set.
2. In the same tables sets that have more than PARTNERS candidates of other classes in
   their bucket are tied to them (below). What is tied makes crowds, whose pairs are
   all decided at the end, so the next step leaves the pairs within a crowd out.
3. In all tables all pairs within the radius are compared but those already in one
   class or one crowd. Buckets over `most` are dealt anew by blocks of their free bits, DEPTH
   times at most (each makes a bucket of unlike texts a 32nd, and none of like ones);
   those that remain, or hardly hold more than one crowd, are cut into pieces of
   `most` sets, each with all sets outside of the largest crowd. No pair is left out.

A pair is a candidate only if its sizes, and the parities of its shingles in 128
classes, allow the similarity: sets of s shingles together that differ in d of them
have one of (s - d) / (s + d), and parities that differ in at most d bits. So of many
texts that are near in words but not similar, few pairs leave the task.

A set with more than PARTNERS candidates in a bucket does not list them: it is tied to
them, one row for each set, and the tied sets of both steps make groups. A group is
dealt into blocks of about BLOCK sets (fewer if they are large) and each two blocks meet
once, with the shingles themselves: exact counts of common shingles for all pairs come
from products of 0/1 matrices, and only spanning stars of similar pairs leave the task.
So rows grow with the sets, not with their pairs, however many texts lie near 0.8, and
every pair is still decided; the work on one such group grows with its square.

Defined results: a null or wordless text has fingerprint zero and is linked like
any other; repeated rows share a class; documents whose ids are all null get a
null class; an empty table gives none; other columns are ignored. near_dedup():
shorter texts are one shingle, wordless and null texts are one class; a class keeps
its smallest id (null ids last), and one text of an id with several; rows that
repeat id and text are one document; other columns are carried along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, chunks, connected_components, cut, joined, run_hashes, table, word_hashes

BITS, FREE = 64, 12
SHINGLE, PERCENT, NEAR, MOST, DEPTH, FIRST, FEW, SAMPLE = 5, 80, 8, 1024, 2, 5, 1 << 17, 16
PARTNERS, BLOCK, BLOCK_GRAMS = 4, 1024, 1 << 19
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Majority of each bit over the XXH64 of all shingles; signed."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[k:] for k in range(shingle)))))
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, [seed] * len(grams)), np.uint64, len(grams))
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 1 << 14):
        part = h[k : k + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): a signed 64-bit fingerprint per row."""

    def run(batches):
        for b in batches:
            fp = [fingerprint(t.as_py(), shingle, seed) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def covering_masks(radius: int, first: int = 0, bits: int = BITS) -> list[int]:
    """2**(radius+1) - 1 masks of some bits, signed, of which each pair within the radius on them agrees on one."""
    n = (1 << (radius + 1)) - 1
    vectors = [1 + i % n for i in range(bits)]
    return [_signed(sum(1 << first + i for i in range(bits) if bin(vectors[i] & v).count("1") % 2)) for v in range(1, n + 1)]


def half_masks(radius: int) -> list[int]:
    """Masks of which each pair within the radius agrees on one: it differs in radius // 2 bits at most on the
    lower half, or in (radius - 1) // 2 at most on the upper one."""
    return covering_masks(radius // 2, 0, 32) + (covering_masks((radius - 1) // 2, 32, 32) if radius else [])


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _finer(mask: int, blocks: int) -> list[int]:
    """The mask with one more block of its free bits, for each block."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    return [_signed((mask & ((1 << BITS) - 1)) | sum(1 << i for i in free[k::blocks])) for k in range(blocks)]


def _stars(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(fp, root) of the components within one bucket, from distances in blocks of rows."""
    n = len(fps)
    u = fps.view(np.uint64)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for k in range(0, n, 256):
        near = np.bitwise_count(u[k : k + 256, None] ^ u[None, k:]) <= radius
        for i, j in zip(*np.nonzero(np.triu(near, 1))):
            a, b = find(k + i), find(k + j)
            if a != b:
                root[max(a, b)] = min(a, b)
    return [(int(fps[i]), int(fps[r])) for i in range(n) if (r := find(i)) != i]


def links(fps: DataFrame, radius: int = 3, most: int = 1024) -> DataFrame:
    """(a, b): links that connect what pairs of distinct fps within the radius connect.

    fps: one column fp of distinct values. Shuffles (mask, key) rows of 16 bytes,
    2**(radius+1) - 1 for each fingerprint; groups are counted by a partial aggregate first.
    """
    masks = covering_masks(radius)
    rows = fps.select("fp", F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask"))
    found = None

    def run(batches):
        for b in batches:
            out = [e for x in b.column(0) for e in _stars(np.array(x.values, np.int64), radius)]
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in out], pa.int64()), pa.array([e[1] for e in out], pa.int64())], ["a", "b"])

    while True:
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        small = F.expr(f"n <= {most} OR bit_count(mask) >= {BITS - FREE}")
        shared = cut(rows.join(sizes, ["mask", "key"]))
        groups = shared.where(small).groupBy("mask", "key").agg(F.collect_list("fp").alias("fps"))  # at most `most` or 2**FREE each
        new = groups.select("fps").mapInArrow(run, "a bigint, b bigint")
        found = new if found is None else found.unionAll(new)
        large = shared.where(~small)
        masks = [r.mask for r in large.select("mask").distinct().collect()]  # (2**(radius+1) - 1) * (radius + 1)**depth at most
        if not masks:
            return found.distinct()
        finer = F.create_map(*[x for m in masks for x in (F.lit(m), F.array(*[F.lit(y) for y in _finer(m, radius + 1)]))])
        rows = large.select("fp", F.explode(finer[F.col("mask")]).alias("mask"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, shingle: int = 3, most: int = 1024) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id in the class."""
    marked = cut(fingerprints(docs, id_col, text_col, shingle))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = connected_components(links(distinct.select("fp"), radius, most)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return marked.join(rooted.join(lows, "root").select("fp", "component_id"), "fp", "left").select("doc_id", "fp", "component_id")


def _ints(*columns, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE):
    """(sorted distinct shingle hashes, word fingerprint) of each text."""
    raw, begin = joined(texts)
    start, _, words = word_hashes(LOWER[raw])
    first = np.searchsorted(start, begin)
    grams = run_hashes(words, shingle)
    for a, z in zip(first.tolist(), np.append(first[1:], len(words)).tolist()):
        if a == z:
            yield grams[:0], 0
            continue
        own = grams[a : z - shingle + 1] if z - a >= shingle else run_hashes(words[a:z], z - a)
        once, ones = np.unique(words[a:z]), np.zeros(BITS, np.int64)
        for k in range(0, len(once), 1 << 14):
            ones += np.unpackbits(once[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        yield np.unique(own), int(np.packbits(2 * ones > len(once), bitorder="little").view("<i8")[0])


def parities(grams: np.ndarray) -> np.ndarray:
    """The parity of the shingles in each of 128 classes, as two numbers: sets that differ in d shingles differ in at most d bits."""
    return np.packbits(np.bincount((grams >> U64(57)).astype(np.int64), minlength=128) & 1, bitorder="little").view("<i8")


def _sets(batches, shingle: int):
    """Lists of (row key, name of the set, set, fingerprint) in pieces of text."""
    for b in batches:
        for keys, texts in chunks(b.column(0).to_pylist(), b.column(1).to_pylist(), 1 << 18):
            yield [(k, int(np.uint64(xxhash.xxh3_64_intdigest(g.tobytes())).astype(np.int64)), g, fp) for k, (g, fp) in zip(keys, shingle_sets(texts, shingle))]


class _Labels:
    """Classes of 0 .. n - 1, named by their smallest element."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, at: np.ndarray):
        old = np.unique(self.root[at])
        if len(old) > 1:
            self.root[np.isin(self.root, old[1:])] = old[0]

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        moved = np.flatnonzero(self.root != np.arange(len(self.root)))
        return moved, self.root[moved]


class _Bucket:
    """The sets of one bucket, and which pairs of them can be similar."""

    def __init__(self, members, radius: int, percent: int):
        columns = [members.field(k).to_numpy(zero_copy_only=False) for k in range(7)]
        order = np.lexsort(columns[:2])
        self.ids, self.fps, self.root, self.crowd, self.n, *self.parity = (c[order] for c in columns)
        self.fps, self.parity = self.fps.view(U64), [x.view(U64) for x in self.parity]
        self.radius, self.percent = radius, percent

    def able(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether sizes and parities allow the similarity. Only pairs that can't have it are left out."""
        n, m, p = self.n[i], self.n[j], self.percent
        apart = sum(np.bitwise_count(x[i] ^ x[j]).astype(np.int64) for x in self.parity)
        return (100 * np.minimum(n, m) >= p * np.maximum(n, m)) & (apart * (100 + p) <= (100 - p) * (n + m))

    def nearest(self):
        """Pairs of each set and its nearest one, and its nearest one before it, in pieces of MOST sets."""
        for low in range(0, len(self.ids), MOST):
            at = np.arange(low, min(low + MOST, len(self.ids)))
            for k in range(0, len(at), 256):
                own = at[k : k + 256]
                apart = np.bitwise_count(self.fps[own, None] ^ self.fps[None, at]).astype(np.int16)
                apart[np.arange(len(own)), own - low] = 99
                for far in (apart, np.where(at[None, :] < own[:, None], apart, 99)):
                    near = far.argmin(1)
                    some = far[np.arange(len(own)), near] <= self.radius
                    yield own[some], at[near[some]]

    def apart(self, rows: np.ndarray, others: np.ndarray):
        """All pairs of rows and others within the radius that are in two classes and two crowds."""
        for k in range(0, len(rows), 256):
            own = rows[k : k + 256]
            i, j = np.nonzero(np.bitwise_count(self.fps[own, None] ^ self.fps[None, others]) <= self.radius)
            i, j = own[i], others[j]
            some = (self.root[i] != self.root[j]) & (self.crowd[i] != self.crowd[j])
            yield i[some], j[some]

    def crowded(self):
        """The pairs of two classes in pieces of MOST sets."""
        for low in range(0, len(self.ids), MOST):
            at = np.arange(low, min(low + MOST, len(self.ids)))
            yield from self.apart(at, at)

    def across(self, top: int | None, mask: int, masks: np.ndarray):
        """All pairs of two crowds of which one set is outside of crowd `top`, and for which
        `mask` is the first of `masks` on which they agree: so one table names each pair."""
        before = masks[: int(np.flatnonzero(masks == mask)[0])]
        every = np.arange(len(self.ids))
        for i, j in self.apart(every if top is None else np.flatnonzero(self.crowd != top), every):
            for m in before:
                some = (self.fps[i] ^ self.fps[j]) & U64(int(m) & (1 << BITS) - 1) != 0
                i, j = i[some], j[some]
            yield i, j


def _pairs(rows: DataFrame, radius: int, percent: int, step: str, partners: int = PARTNERS) -> DataFrame:
    """(a, b, tied) within each bucket and piece of rows: the `nearest` ones of each set, or all `across` crowds.

    In a step other than `nearest`, a set with more than `partners` of them gives no pairs; it and they are tied to
    one of them. The step `crowded` gives these ties alone.
    """
    seen = _Bucket.crowded if step == "crowded" else _Bucket.nearest

    def run(batches):
        for b in batches:
            for x, top, mask in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                bucket = _Bucket(x.values, radius, percent)
                ties = _Labels(len(bucket.ids))
                for i, j in bucket.across(top, mask, masks) if step == "across" else seen(bucket):
                    able = bucket.able(i, j)
                    i, j = i[able], j[able]
                    if step != "nearest" and len(i):  # by i, in order
                        many = np.bincount(i)[i] > partners
                        own, at = np.unique(i[many], return_index=True)
                        for k, js in zip(own, np.split(j[many], at[1:])):
                            ties.join(np.append(js, k))
                        i, j = i[~many], j[~many]
                    if step != "crowded" and len(i):
                        yield rows_of(bucket.ids[i], bucket.ids[j], False)
                i, j = ties.stars()
                if len(i):
                    yield rows_of(bucket.ids[i], bucket.ids[j], True)

    def rows_of(a, b, tied: bool):
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.full(len(a), tied))], ["a", "b", "tied"])

    members = F.collect_list(F.struct("id", "fp", "root", "crowd", "n", "s0", "s1")).alias("members")
    masks = np.array(half_masks(radius), np.int64)
    groups = rows.groupBy("bucket", "piece", "mask0").agg(members, F.max("top").alias("top")).where("size(members) > 1")
    return groups.select("members", "top", "mask0").mapInArrow(run, "a bigint, b bigint, tied boolean").distinct()


def common_shingles(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of `left` has in common with each of `right`: products of 0/1 matrices for
    the frequent shingles, in pieces of 1024, and one by one for the others."""
    n, m = len(left), len(right)
    _, col = np.unique(np.concatenate(left + right), return_inverse=True)
    size = [len(x) for x in left], [len(x) for x in right]
    row_l, row_r = (np.repeat(np.arange(len(x)), x) for x in size)
    col_l, col_r = col[: len(row_l)], col[len(row_l) :]
    width = int(col.max()) + 1 if len(col) else 0
    n_l, n_r = np.bincount(col_l, minlength=width), np.bincount(col_r, minlength=width)
    out = np.zeros(n * m, np.int64)
    often = n_l * n_r * 32 > n * m
    place = np.cumsum(often) - 1
    for low in range(0, int(often.sum()), 1024):
        both = []
        for rows, cols, k in ((row_l, col_l, n), (row_r, col_r, m)):
            some = often[cols] & (place[cols] >= low) & (place[cols] < low + 1024)
            x = np.zeros((k, 1024), np.float32)
            x[rows[some], place[cols[some]] - low] = 1
            both.append(x)
        out += (both[0] @ both[1].T).ravel().astype(np.int64)
    some = ~often[col_l] & (n_r[col_l] > 0)
    row_l, col_l = row_l[some], col_l[some]
    order = np.argsort(col_r, kind="stable")
    row_r, first = row_r[order], np.cumsum(n_r) - n_r
    times = n_r[col_l]
    before = np.concatenate([[0], np.cumsum(times)])
    k = 0
    while k < len(times):
        z = max(k + 1, int(np.searchsorted(before, before[k] + (1 << 21), "right")) - 1)
        at = np.arange(before[z] - before[k]) + np.repeat(first[col_l[k:z]] - before[k:z] + before[k], times[k:z])
        out += np.bincount(np.repeat(row_l[k:z], times[k:z]) * m + row_r[at], minlength=n * m)
        k = z
    return out.reshape(n, m)


def _block_links(held: list[tuple], same: bool, radius: int, percent: int) -> tuple[list[int], list[int]]:
    """Stars of the similar pairs of two blocks; held: (whether of the lower block, id, fp, grams)."""
    left = [k for k, x in enumerate(held) if x[0]]
    right = left if same else [k for k, x in enumerate(held) if not x[0]]
    labels = _Labels(len(held))
    if left and right:
        sets, fps = [x[3] for x in held], np.array([x[2] for x in held], np.int64).view(U64)
        n = np.array([len(x) for x in sets], np.int64)
        both = common_shingles([sets[k] for k in left], [sets[k] for k in right])
        near = (100 + percent) * both >= percent * (n[left][:, None] + n[right][None, :])
        near &= np.bitwise_count(fps[left][:, None] ^ fps[right][None, :]) <= radius
        for k, hit in zip(left, near):
            if hit.any():
                labels.join(np.append(np.array(right)[hit], k))
    i, j = labels.stars()
    return [held[k][1] for k in i], [held[k][1] for k in j]


def _group_links(ties: DataFrame, sets: DataFrame, grams_of, radius: int, percent: int, block: int) -> DataFrame:
    """(a, b): links between tied sets that connect what pairs of them within the radius and of the similarity connect."""
    groups = connected_components(ties).withColumnRenamed("node", "id").withColumnRenamed("root", "own")
    members = cut(groups.join(sets.select("id", "fp", "n"), "id"))
    parts = F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(block)), F.ceil(F.sum("n") / F.lit(BLOCK_GRAMS))).cast("int")
    sizes = members.groupBy("own").agg(parts.alias("parts"))
    dealt = members.join(sizes, "own").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).cast("int"))
    dealt = dealt.join(grams_of(members.select("id")), "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("own", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), (F.col("part") <= F.col("other")).alias("lower"), "id", "fp", "grams")

    def run(batches):
        key, held = None, []
        for b in batches:
            head = [b.column(k).to_pylist() for k in range(6)]
            for row, (own, low, high, *rest) in enumerate(zip(*head)):
                if held and (own, low, high) != key:
                    yield _ints(*_block_links(held, key[1] == key[2], radius, percent), names=["a", "b"])
                    held = []
                key = own, low, high
                held.append((*rest, b.column(6)[row].values.to_numpy(zero_copy_only=False).copy()))
        if held:
            yield _ints(*_block_links(held, key[1] == key[2], radius, percent), names=["a", "b"])

    return cut(dealt.repartition("own", "low", "high").sortWithinPartitions("own", "low", "high").mapInArrow(run, "a bigint, b bigint"))


def _dealt(rows: DataFrame, masks) -> DataFrame:
    """rows once for each mask, with the bucket: a hash of mask and masked fingerprint (of the first dealing, mask0 tells those apart that collide)."""
    rows = rows.withColumn("mask", F.explode(masks))
    rows = rows if "mask0" in rows.columns else rows.withColumn("mask0", F.col("mask"))  # that of the first dealing
    return rows.withColumns({"bucket": F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))), "piece": F.lit(0), "top": F.lit(None).cast("long")})


def _large(rows: DataFrame, most: int) -> DataFrame:
    """Buckets of more than about `most` sets, from a sixteenth of the sets. Only the way that a bucket is treated depends on it."""
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0) if most >= 64 * SAMPLE else rows
    share = SAMPLE if most >= 64 * SAMPLE else 1
    return cut(some.groupBy("bucket").agg((F.count("*") * share).alias("size")).where(F.col("size") > most))


def _candidates(sets: DataFrame, radius: int, percent: int, most: int, partners: int) -> DataFrame:
    """(a, b, tied), as _pairs: all pairs of sets(id, fp, root, crowd) within the radius whose roots and crowds differ and that can be similar."""
    rows, found = _dealt(sets, F.array(*[F.lit(m) for m in half_masks(radius)])), None
    for depth in range(DEPTH + 1):
        large = _large(rows, most)
        many = large.count()
        if many and many <= FEW:  # 16 bytes each
            large = F.broadcast(large)
        fit = _pairs(rows.join(large, "bucket", "left_anti") if many else rows, radius, percent, "across", partners)
        found = fit if found is None else found.unionAll(fit)
        if not many:
            break
        rest = cut(rows.drop("top").join(large, "bucket"))
        by_crowd = rest.groupBy("bucket", "crowd").agg(F.count("*").alias("own"))
        top = by_crowd.groupBy("bucket").agg(F.sum("own").alias("all"), F.max(F.struct("own", "crowd")).alias("top"))
        top = cut(top.select("bucket", "all", F.col("top.crowd").alias("top"), (F.col("all") - F.col("top.own")).alias("others")).where("others > 0"))
        rest = rest.join(top, "bucket")
        done = F.expr(f"others * all <= {most * most}") | F.lit(depth == DEPTH)
        # pieces of `most` sets, each with all sets outside of the largest crowd
        pieces = F.ceil(F.col("all") / F.lit(most)).cast("int")
        own = F.pmod(F.xxhash64("id"), pieces.cast("long")).cast("int")
        salted = rest.where(done).withColumn("piece", F.explode(F.when(F.col("crowd") != F.col("top"), F.sequence(F.lit(0), pieces - 1)).otherwise(F.array(own))))
        found = found.unionAll(_pairs(salted, radius, percent, "across", partners))
        rest = rest.where(~done)
        masks = [r.mask for r in rest.select("mask").distinct().collect()]  # 46 * (radius + 1)**(DEPTH - 1) at most
        if not masks:
            break
        finer = F.create_map(*[x for m in masks for x in (F.lit(m), F.array(*[F.lit(y) for y in _finer(m, radius + 1)]))])
        rows = cut(_dealt(rest.drop("bucket", "piece", "top", "size", "all", "others").withColumn("finer", finer[F.col("mask")]).drop("mask"), F.col("finer")).drop("finer"))
    return found.distinct()


def similar_links(rows: DataFrame, sets: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, radius: int = NEAR, most: int = MOST, partners: int = PARTNERS, block: int = BLOCK) -> DataFrame:
    """(a, b): links between the ids of sets that connect what pairs within the radius and of the similarity connect.

    rows(key, text); sets(id, key, fp, n, s0, s1): a row of each set, its fingerprint, size and parities.
    """

    def grams_of(ids: DataFrame) -> DataFrame:
        wanted = cut(ids.distinct().join(sets.select("id", "key"), "id"))
        keys = wanted.select("key").distinct()
        if wanted.count() <= FEW:  # 8 bytes each
            keys = F.broadcast(keys)

        def grams(batches):
            for piece in _sets(batches, shingle):
                for _, name, own, _ in piece:
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([own.view(np.int64)], pa.list_(pa.int64()))], ["id", "grams"])

        return cut(rows.join(keys, "key", "left_semi").mapInArrow(grams, "id bigint, grams array<bigint>").dropDuplicates(["id"]))

    def similar(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs)
        known = grams_of(pairs.select(F.explode(F.array("a", "b")).alias("id")))
        a, b = (known.select(F.col("id").alias(c), F.col("grams").alias(f"{c}s")) for c in "ab")
        both, all_ = F.size(F.array_intersect("as", "bs")), F.size("as") + F.size("bs")
        return cut(pairs.join(a, "a").join(b, "b").where((100 + percent) * both >= percent * all_).select("a", "b"))

    masks = half_masks(radius)
    some, large = F.array(*[F.lit(m) for m in masks[:: len(masks) // FIRST]]), None

    def few(sets: DataFrame) -> DataFrame:
        """Some tables. They need not find all, so a large bucket is cut into pieces of like fingerprints."""
        nonlocal large
        rows = _dealt(sets, some)
        large = _large(rows, most) if large is None else large
        return rows.join(large, "bucket", "left").withColumn("piece", F.pmod(F.xxhash64("fp"), F.coalesce(F.ceil(F.col("size") / F.lit(most)), F.lit(1))).cast("int")) if large.count() else rows

    alone = sets.drop("key").withColumns({"root": F.col("id"), "crowd": F.col("id")})
    found = similar(_pairs(few(alone), radius, percent, "nearest").select("a", "b"))
    roots = connected_components(found).withColumnRenamed("node", "id")
    rooted = cut(alone.drop("root").join(roots, "id", "left").withColumns({"root": F.coalesce("root", "id"), "crowd": F.coalesce("root", "id")}))
    ties = cut(_pairs(few(rooted), radius, percent, "crowded", partners).select("a", "b"))
    if ties.limit(1).count():
        crowds = connected_components(ties).select(F.col("node").alias("id"), F.col("root").alias("tied"))
        rooted = cut(rooted.join(crowds, "id", "left").withColumn("crowd", F.when(F.col("tied").isNull(), F.col("crowd")).otherwise(F.xxhash64("tied"))).drop("tied"))
    near = cut(_candidates(rooted, radius, percent, most, partners))
    found = found.unionAll(similar(near.where(~F.col("tied")).select("a", "b")))
    ties = ties.unionAll(near.where("tied").select("a", "b"))
    return found.unionAll(_group_links(ties, sets, grams_of, radius, percent, block)) if ties.limit(1).count() else found


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, radius: int = NEAR, most: int = MOST, partners: int = PARTNERS, block: int = BLOCK) -> DataFrame:
    """The rows of docs that are the first of their class, one for each id and text."""
    key = F.xxhash64(F.col(id_col).isNull(), F.col(id_col), F.col(text_col).isNull(), F.col(text_col))
    rows = docs.select(key.alias("key"), F.col(text_col).cast("string").alias("text"))

    def name(batches):
        for piece in _sets(batches, shingle):
            parity = np.array([parities(g) for _, _, g, _ in piece])
            yield _ints([x[0] for x in piece], [x[1] for x in piece], [x[3] for x in piece], [len(x[2]) for x in piece], parity[:, 0], parity[:, 1], names=["key", "id", "fp", "n", "s0", "s1"])

    named = cut(rows.mapInArrow(name, "key bigint, id bigint, fp bigint, n bigint, s0 bigint, s1 bigint"))
    sets = cut(named.where("n > 0").groupBy("id").agg(*[F.min(c).alias(c) for c in ("key", "fp", "n", "s0", "s1")]))
    low = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("low")
    marked = docs.select(key.alias("key"), F.col(id_col).alias("doc_id")).distinct()
    first = cut(named.select("key", "id").distinct().join(marked, "key").groupBy("id").agg(low))
    roots = connected_components(similar_links(rows, sets, shingle, percent, radius, most, partners, block)).withColumnRenamed("node", "id")
    keep = first.join(roots, "id", "left").groupBy(F.coalesce("root", "id")).agg(F.min("low").alias("low")).select(F.col("low.key").alias("__cl_key"))
    return docs.withColumn("__cl_key", key).join(keep, "__cl_key", "left_semi").dropDuplicates(["__cl_key"]).drop("__cl_key")


def op1_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
