"""Repeated passages through compressed FM-indexes.

A window is WINDOW consecutive words of one document. A window is a repeat if
its words also start at an earlier place (smaller doc_id, or the same document
and an earlier start). Words that some repeat covers are removed.

Routing. Each window names an anchor: among its runs of ANCHOR words, the one
with the smallest hash (leftmost on a tie). Equal windows have equal anchors at
equal offsets, so no repeat is lost if windows meet by anchor. Consecutive
windows with the same anchor form a segment, about one for every eight words; a
segment is one row of 40 bytes: anchor, hash of its words, document and place.

1. Segments with the same anchor and the same words: the first stays, all others
   are repeats. Tasks drop those that repeat within one of their own blocks of
   text before the shuffle, so that a passage in a third of all documents is a
   few rows from each task. An anchor with only one sequence of words is done.
2. Anchors in several contexts (near copies, edges of passages): the words of
   the first segment of each context go to the shard of their anchor. A shard
   holds a compressed FM-index over its segments in corpus order: suffix array,
   Burrows-Wheeler transform in a wavelet matrix of packed bits with block
   counts. Every window is searched backwards, all windows of a shard in step; a
   window whose interval shrinks to itself has no match and leaves the search.
   Statistics that reach WINDOW words are reported, and a window is a repeat if
   the smallest text position in its interval is not its own.
3. Anchors with more than `most` contexts: their windows become segments of one
   window, with the hash of the whole window for an anchor, and go through step 1,
   which is exact for them. So no index holds an unbounded group, and nothing is
   capped.

An index is built over whole anchors until it has `tokens` words, so its memory
does not depend on the input. Documents are shuffled once by id (the exchange is
shared by steps 2 and 4); step 4 unites the intervals of each document.

Defined results: a null text has no words; a null doc_id has no place in the
order, so its document keeps all words and repeats nothing; rows that repeat an
id and a text are one document; rows that share an id but not a text are ordered
by start within it and otherwise not before one another; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import P_WORD, U64, chunks, cut, joined, mix, powers, run_hashes, table, word_hashes

WINDOW, ANCHOR = 20, 6
COVERED, CONTEXT = 0, 1


# --- FM-index ----------------------------------------------------------------


class Bits:
    """Packed bits with a count before each 64: rank in constant time, 1.5 bits a bit."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))[:-1]]).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block = i >> 6
        mask = (U64(1) << (i & 63).astype(U64)) - U64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = []
        for b in reversed(range(max(1, int(sigma - 1).bit_length()))):
            bit = (symbols >> b & 1).astype(bool)
            self.levels.append((b, Bits(bit), int(len(bit) - bit.sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, c: np.ndarray, i: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Occurrences of symbols c before positions i; start: the result for i = 0 at the lowest level."""
        for b, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where(c >> b & 1, zeros + ones, i - ones)
        return i - start


class FMIndex:
    """Over a text of symbols 1 .. sigma - 1, with 0 between and after its pieces; suffixes are sorted to `depth` symbols."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int):
        n = len(text)
        rank = text.astype(np.int64)
        step = 1
        order = np.argsort(rank, kind="stable")
        while True:  # prefix doubling
            key = rank * (n + sigma + 1)
            key[: n - step] += rank[step:] + 1
            order = np.argsort(key, kind="stable")
            new = np.zeros(n, np.int64)
            new[1:] = key[order][1:] != key[order][:-1]
            rank[order] = np.cumsum(new)
            step *= 2
            if step >= depth or rank[order[-1]] == n - 1:
                break
        self.suffixes = order.astype(np.int32)
        self.bwt = WaveletMatrix(text[order - 1], sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.size = n
        symbols = np.arange(sigma)
        self.zero = self.bwt.rank(symbols, np.zeros(sigma, np.int64), np.zeros(sigma, np.int64))

    def extend(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of c + pattern from those of pattern."""
        return self.first[c] + self.bwt.rank(c, low, self.zero[c]), self.first[c] + self.bwt.rank(c, high, self.zero[c])


def repeats(pieces: list[np.ndarray], window: int = WINDOW) -> list[np.ndarray]:
    """For each piece (word hashes, in corpus order): which of its windows start earlier in the pieces."""
    sizes = np.array([len(p) for p in pieces])
    counts = sizes - window + 1
    _, ids = np.unique(np.concatenate(pieces), return_inverse=True)
    text = np.zeros(len(ids) + len(pieces), np.int64)
    start = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    text[np.arange(len(ids)) + np.repeat(np.arange(len(pieces)), sizes)] = ids + 1
    index = FMIndex(text, int(text.max()) + 1, window)
    at = np.concatenate([np.arange(s, s + c) for s, c in zip(start, counts)])
    live, low, high = np.arange(len(at)), np.zeros(len(at), np.int64), np.full(len(at), index.size, np.int64)
    for k in range(window - 1, -1, -1):
        low, high = index.extend(text[at[live] + k], low, high)
        more = high - low > 1  # one occurrence left: the window itself
        live, low, high = live[more], low[more], high[more]
    hit = np.zeros(len(at), bool)
    if len(live):
        lows, back = np.unique(low, return_inverse=True)
        highs = np.zeros(len(lows), np.int64)
        highs[back] = high
        bounds = np.stack([lows, np.minimum(highs, index.size - 1)], 1).ravel()
        least = np.minimum.reduceat(index.suffixes, bounds)[::2]
        last = highs == index.size
        least[last] = np.minimum(least[last], index.suffixes[-1])
        hit[live] = least[back] < at[live]
    return np.split(hit, np.cumsum(counts)[:-1])


# --- segments ------------------------------------------------------------------


def anchors(words: np.ndarray, window: int = WINDOW, run: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the anchor of each window; leftmost smallest run of words."""
    grams = run_hashes(words, run)
    span = window - run + 1
    views = np.lib.stride_tricks.sliding_window_view(grams, span)
    place = np.concatenate([views[k : k + 65536].argmin(1) for k in range(0, len(views), 65536)])
    place += np.arange(len(place))
    return grams[place], place


def segments(texts: list[bytes], window: int = WINDOW):
    """Arrays (text, start in the text, windows, anchor, hash of words) of all segments."""
    raw, begin = joined(texts)
    begin_word, _, words = word_hashes(raw)
    none = np.zeros(0, np.int64)
    if len(words) < window:
        return none, none, none, none.view(U64), none.view(U64)
    first = np.searchsorted(begin_word, begin)
    owner = np.repeat(np.arange(len(texts)), np.diff(np.append(first, len(words))))
    anchor, place = anchors(words, window)
    inside = owner[: len(anchor)] == owner[window - 1 :]
    new = np.ones(len(anchor), bool)
    new[1:] = (place[1:] != place[:-1]) | (owner[1 : len(anchor)] != owner[: len(anchor) - 1]) | ~inside[:-1]
    new &= inside
    starts = np.flatnonzero(new)
    if not len(starts):
        return none, none, none, none.view(U64), none.view(U64)
    total = np.concatenate([[0], np.cumsum(inside)])
    counts = total[np.append(starts[1:], len(anchor))] - total[starts]
    size = counts + window - 1
    sums = np.zeros(len(words) + 1, U64)
    np.cumsum(mix(words) * powers(P_WORD, len(words)), out=sums[1:])
    content = mix((sums[starts + size] - sums[starts]) * powers(pow(P_WORD, -1, 1 << 64), len(words))[starts] + size.astype(U64))
    return owner[starts], starts - first[owner[starts]], counts, anchor[starts], content


def _pack(start, part, count):
    return start << 24 | part << 8 | count


def _first_of(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order by the keys, whether a sorted row has other first two keys than the row before)."""
    order = np.lexsort(keys[::-1])
    a, b = keys[0][order], keys[1][order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, new


SEGMENT = "anchor bigint, content bigint, doc_id {0}, place bigint, known boolean"


def _emit(ids, part, owner, start, counts, anchor, content, id_type):
    """A batch of segments; those that repeat one of the same block are known and spread by document."""
    doc = np.array(ids, np.int64 if pa.types.is_integer(id_type) else str)[owner]
    place = _pack(start, part[owner], counts)
    order, new = _first_of([anchor, content, doc, place])
    doc, place, anchor, content = doc[order], place[order], anchor[order], content[order]
    rank = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    same = (doc == doc[rank]) & (place >> 24 == place[rank] >> 24)  # the first itself, or its like in a row with the same id
    known = ~same
    key = np.where(known, mix(doc.astype(U64) if doc.dtype == np.int64 else np.array([zlib.crc32(x.encode()) for x in doc], U64)), anchor)
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), pa.array(doc).cast(id_type), pa.array(place), pa.array(known)], ["anchor", "content", "doc_id", "place", "known"])


def _verdicts(rows: DataFrame, kind: str) -> DataFrame:
    """(doc_id, place, anchor, state) of segments that repeat (COVERED) or are the first of one of several contexts (CONTEXT).

    Rows of an anchor are read in order from a sorted partition, a batch at a time.
    """

    def run(batches):
        for b in _whole_groups(batches):
            anchor, content = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            doc, place, known = b.column(2), b.column(3).to_numpy(zero_copy_only=False), b.column(4).to_numpy(zero_copy_only=False)
            ids = doc.to_numpy(zero_copy_only=False)
            n = len(anchor)
            new_anchor, new = np.ones(n, bool), np.ones(n, bool)
            new_anchor[1:] = anchor[1:] != anchor[:-1]
            new[1:] = new_anchor[1:] | (content[1:] != content[:-1]) | known[1:] | known[:-1]
            head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            is_first = (head == np.arange(n)) | (ids == ids[head]) & (place >> 24 == place[head] >> 24)
            group = np.cumsum(new_anchor) - 1
            contexts = np.bincount(group, weights=new & ~known)[group]
            state = np.where(known | ~is_first, COVERED, np.where(contexts > 1, CONTEXT, -1)).astype(np.int32)
            keep = state >= 0
            if keep.any():
                mask = pa.array(keep)
                yield pa.RecordBatch.from_arrays([doc.filter(mask), pa.array(place[keep]), pa.array(anchor[keep]), pa.array(state[keep]), pa.array(contexts[keep].astype(np.int64))], ["doc_id", "place", "anchor", "state", "contexts"])

    dealt = rows.repartition("anchor").sortWithinPartitions("anchor", "known", "content", "doc_id", "place")
    return dealt.mapInArrow(run, f"doc_id {kind}, place bigint, anchor bigint, state int, contexts bigint")


def _whole_groups(batches):
    """Sorted batches, cut between anchors only."""
    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        key = t.column(0)
        last = key[t.num_rows - 1].as_py()
        cut_at = int(np.searchsorted(key.to_numpy(), last, "left"))
        if cut_at:
            yield from t.slice(0, cut_at).combine_chunks().to_batches()
        rest = t.slice(cut_at)
    if rest is not None and rest.num_rows:
        yield from rest.combine_chunks().to_batches()


def covered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, most: int = 20_000, tokens: int = 1 << 19) -> tuple[DataFrame, DataFrame]:
    """(texts, intervals): texts(doc_id, part, text) of docs, and intervals(doc_id, place) of windows that repeat.

    place packs the first window, 16 bits that tell texts of one id apart, and the number of windows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    part = F.pmod(F.xxhash64(F.col(text_col)), F.lit(65536)).cast("int")
    texts = docs.select(F.col(id_col).alias("doc_id"), part.alias("part"), F.col(text_col).cast("string").alias("text"))
    real = texts.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())

    def cut_up(batches):
        for b in batches:
            ids, parts = b.column(0).to_pylist(), dict(zip(range(b.num_rows), b.column(1).to_pylist()))
            for own, some in chunks(list(range(b.num_rows)), b.column(2).to_pylist(), 1 << 22):
                found = segments(some, window)
                yield _emit([ids[k] for k in own], np.array([parts[k] for k in own], np.int64), *found, b.schema.field(0).type)

    seen = cut(_verdicts(real.mapInArrow(cut_up, SEGMENT.format(kind)), kind))
    of_doc = lambda rows: rows.groupBy("doc_id").agg(F.collect_list(F.struct("place", "anchor")).alias("own"))  # noqa: E731  the segments of one document
    context = seen.where(F.col("state") == CONTEXT)

    def words_of(batches, hot: bool):
        for b in batches:
            id_type = b.schema.field(0).type
            out: list[list] = [[], [], [], []]
            ids, parts, some, own = (b.column(k).to_pylist() for k in range(4))
            for i, p, t, segs in zip(ids, parts, some, own):
                raw, _ = joined([t.encode("utf-8", "surrogatepass")])
                words = word_hashes(raw)[2]
                for s in segs:
                    place = s["place"]
                    if place >> 8 & 65535 != p:
                        continue
                    start, count = place >> 24, place & 255
                    if hot:
                        whole = run_hashes(words[start : start + count + window - 1], window)
                        other = run_hashes(mix(words[start : start + count + window - 1]), window)
                        for k in range(count):
                            for col, v in zip(out, (int(whole[k].view(np.int64)), int(other[k].view(np.int64)), i, _pack(start + k, p, 1))):
                                col.append(v)
                    else:
                        for col, v in zip(out, (s["anchor"], i, place, words[start : start + count + window - 1].tobytes())):
                            col.append(v)
            if hot:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], id_type), pa.array(out[3], pa.int64()), pa.array([False] * len(out[0]))], ["anchor", "content", "doc_id", "place", "known"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], id_type), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], ["anchor", "doc_id", "place", "words"])

    def shard(batches):
        held: list[tuple] = []
        size = 0

        def flush():
            once = {row[1:3]: k for k, row in enumerate(held)}  # rows that repeat a document
            order = sorted(once.values(), key=lambda k: (held[k][1], held[k][2] >> 24))
            hits = repeats([held[k][3] for k in order], window)
            ids, places = [], []
            for k, hit in zip(order, hits):
                edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).view(np.int8)))
                for a, z in zip(edge[0::2].tolist(), edge[1::2].tolist()):
                    ids.append(held[k][1])
                    places.append(_pack((held[k][2] >> 24) + a, held[k][2] >> 8 & 65535, z - a))
            return ids, places

        kept_type = None
        for b in batches:
            kept_type = b.schema.field(1).type
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if size >= tokens and row[0] != held[-1][0]:
                    ids, places = flush()
                    yield pa.RecordBatch.from_arrays([pa.array(ids, kept_type), pa.array(places, pa.int64())], ["doc_id", "place"])
                    held.clear()
                    size = 0
                held.append((*row[:3], np.frombuffer(row[3], U64)))
                size += len(held[-1][3])
        if held:
            ids, places = flush()
            yield pa.RecordBatch.from_arrays([pa.array(ids, kept_type), pa.array(places, pa.int64())], ["doc_id", "place"])

    cool = texts.join(of_doc(context.where(F.col("contexts") <= most)), "doc_id").mapInArrow(lambda x: words_of(x, False), f"anchor bigint, doc_id {kind}, place bigint, words binary")
    found = cool.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(shard, f"doc_id {kind}, place bigint")
    hot = texts.join(of_doc(context.where(F.col("contexts") > most)), "doc_id").mapInArrow(lambda x: words_of(x, True), SEGMENT.format(kind))
    intervals = seen.where(F.col("state") == COVERED).select("doc_id", "place").unionAll(cut(found))
    if context.where(F.col("contexts") > most).limit(1).count():
        intervals = intervals.unionAll(cut(_verdicts(hot, kind)).where(F.col("state") == COVERED).select("doc_id", "place"))
    return texts, intervals


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **how) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept is the words that stay, joined by one space."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts, intervals = covered(docs, id_col, text_col, window, **how)
    own = intervals.groupBy("doc_id").agg(F.collect_list("place").alias("own"))

    def run(batches):
        for b in batches:
            _, parts, some, places = (b.column(k).to_pylist() for k in range(4))
            out: list[list] = [[], [], []]
            for p, t, mine in zip(parts, some, places):
                words = t.encode("utf-8", "surrogatepass").split() if t else []
                gone = np.zeros(len(words) + 1, np.int32)
                for x in mine or ():
                    if x >> 8 & 65535 == p:
                        gone[x >> 24] += 1
                        gone[(x >> 24) + (x & 255) + window - 1] -= 1
                left = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                out[0].append(len(words))
                out[1].append(len(words) - len(left))
                out[2].append(b" ".join(words if len(left) == len(words) else [words[k] for k in left]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return texts.join(own, "doc_id", "left").select("doc_id", "part", "text", "own").mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - {WINDOW - 2})) AS p, unnest(list_transform(range(1, len(w) - {WINDOW - 2}), lambda p: md5(array_to_string(w[p:p + {WINDOW - 1}], ' ')))) AS h FROM d WHERE len(w) >= {WINDOW}),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) > 1 AS again FROM g),
c AS (SELECT DISTINCT doc_id, p + k AS p FROM f, (SELECT unnest(range({WINDOW})) AS k) WHERE again),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT x.doc_id, count(c.p) AS n_removed, string_agg(word, ' ' ORDER BY x.p) FILTER (c.p IS NULL) AS kept FROM x LEFT JOIN c USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
