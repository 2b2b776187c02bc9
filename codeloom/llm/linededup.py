"""Repeated runs of lines, found by content-defined chunks.

A text is split at newlines. A rolling hash over the hashes of the last WINDOW
lines ends a chunk wherever its low bits are zero, so boundaries depend on the
lines nearby only and come back after any insertion (the idea of content-defined
chunking, with lines for bytes). One line alone joins the next, and longer chunks
are cut into twos (a last three stays whole), so that short repetitions hold a
chunk; a repetition that is out of step with its first occurrence is still lost.
Chunks of two or more lines that occur more than once anywhere are removed but for
the first occurrence (smallest doc_id, then place). Equality is settled on bytes: a
hash counts as repeated only if all its
chunks have one and the same text.

Defined results: a null text stays null and has no lines; an empty text has one
empty line; documents with null ids keep all their chunks and are no one's
first occurrence; rows that repeat a doc_id are numbered by text and count as
later parts of it; an empty table gives none; other columns are carried along.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

WINDOW, DIVISOR, LEAST = 2, 2, 2


def chunks_of(text: str, window: int = WINDOW, divisor: int = DIVISOR) -> list[tuple[int, int]]:
    """(first line, end line) of every chunk of a text; they cover it."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    hashes = [xxhash.xxh3_64_intdigest(x) for x in lines]
    out, start = [], 0
    for i in range(len(lines)):
        roll = 0
        for h in hashes[max(0, i - window + 1) : i + 1]:
            roll = (roll * 0x9E3779B97F4A7C15 + h) & 0xFFFFFFFFFFFFFFFF
        # a boundary needs a full window, so that two documents agree on it wherever the lines are the same
        if i - start and i + 1 >= window and (roll >> 32) % divisor == 0 or i + 1 == len(lines):
            if out and i == start:  # a last line alone joins the chunk before
                start = out.pop()[0]
            while i + 1 - start > 3:
                out.append((start, start + 2))
                start += 2
            out.append((start, i + 1))
            start = i + 1
    return out


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, divisor: int = DIVISOR, least: int = LEAST) -> DataFrame:
    """(doc_id, part, drop array<struct<start, end>>): the lines to remove, for rows that have any.

    part is the XXH64 of the row's text, which tells rows of the same id apart. One
    shuffle of 40 bytes a chunk, and one for the comparison of bytes, to which every
    task sends each text that it has once.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("part"), F.col(text_col).alias("text"))

    def emit(with_text: bool):
        def run(batches):
            for b in batches:
                ids, parts, texts = (b.column(k).to_pylist() for k in range(3))
                out: list[list] = [[], [], [], [], [], []]
                for i, p, t in zip(ids, parts, texts):
                    lines = t.encode("utf-8", "surrogatepass").split(b"\n")
                    for s, e in chunks_of(t, window, divisor):
                        if e - s < least:
                            continue
                        raw = b"\n".join(lines[s:e])
                        for col, v in zip(out, (i, p, s, e, xxhash.xxh3_128_digest(raw), raw)):
                            col.append(v)
                arrays = [pa.array(out[0], b.schema.field(0).type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.binary())]
                names = ["doc_id", "part", "start", "end", "hash"]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(out[5], pa.binary())] if with_text else arrays, [*names, "raw"] if with_text else names)

        return rows.mapInArrow(run, f"doc_id {kind}, part bigint, start int, end int, hash binary" + ", raw binary" * with_text)

    found = cut(emit(False))
    place = F.struct("doc_id", "part", "start")
    again = cut(found.groupBy("hash").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").drop("n"))
    # comparison of bytes: tasks send one copy of each text, and a hash with two texts is not a repetition
    texts = emit(True).groupBy("hash", "raw").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("texts"))
    sure = cut(again.join(texts.where("texts > 1"), "hash", "left_anti"))
    gone = found.join(sure, "hash").where(place != F.col("first"))
    return gone.groupBy("doc_id", "part").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("drop"))  # at most the chunks of one row


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with repeated chunks cut out of the text, and __cl_lines, __cl_gone: lines before and removed."""
    gone = repeated(docs, id_col, text_col, **how).withColumnsRenamed({"doc_id": "__cl_id", "part": "__cl_part", "drop": "__cl_drop"})
    on = (F.col(id_col) == F.col("__cl_id")) & (F.xxhash64(F.col(text_col)) == F.col("__cl_part"))
    all_rows = docs.join(gone, on, "left")
    lines = F.split(F.col(text_col), "\n")

    def cut_out(x):
        # (next line, kept lines) over the sorted ranges
        return F.aggregate(
            F.col("__cl_drop"),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("kept")),
            lambda acc, r: F.struct(r["end"].alias("at"), F.concat(acc["kept"], F.slice(x, acc["at"] + 1, r["start"] - acc["at"])).alias("kept")),
            lambda acc: F.concat(acc["kept"], F.slice(x, acc["at"] + 1, F.greatest(F.size(x) - acc["at"], F.lit(0)))),
        )

    kept = F.transform(F.array(lines), cut_out)[0]
    n_gone = F.coalesce(F.aggregate("__cl_drop", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"]), F.lit(0).cast("long"))
    return all_rows.withColumns({
        "__cl_lines": F.coalesce(F.size(lines), F.lit(0)).cast("long"),
        "__cl_gone": n_gone,
        text_col: F.when(F.col("__cl_drop").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")),
    }).drop("__cl_id", "__cl_part", "__cl_drop")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, lines removed and the SHA-256 of the text that stays."""
    out = remove(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("__cl_lines").alias("n_lines"), F.col("__cl_gone").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
