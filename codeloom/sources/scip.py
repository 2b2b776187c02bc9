"""Symbol indexes in SCIP's protobuf encoding, without a protobuf library.

Only the fields that ingest uses are decoded: documents (2) with relative_path (1),
occurrences (2), symbols (3) and language (4); occurrence range (1, packed or
not), symbol (2) and roles (3); symbol (1), documentation (3), kind (5) and
display_name (6). Other fields are skipped.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def _varint(b: bytes, i: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        x |= (b[i] & 127) << shift
        shift += 7
        i += 1
        if b[i - 1] < 128:
            return x, i


def fields(b: bytes):
    """(number, value) of a message; a value is an int or bytes."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, i = b[i : i + n], i + n
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


def _ints(value) -> list[int]:
    if isinstance(value, int):
        return [value]
    out, i = [], 0
    while i < len(value):
        x, i = _varint(value, i)
        out.append(x)
    return out


def document(b: bytes) -> dict:
    doc: dict = {"relative_path": "", "language": "", "symbols": [], "occurrences": []}
    for n, v in fields(b):
        if n == 1:
            doc["relative_path"] = v.decode()
        elif n == 4:
            doc["language"] = v.decode()
        elif n == 2:
            o: dict = {"symbol": "", "range": [], "symbol_roles": 0}
            for m, x in fields(v):
                if m == 1:
                    o["range"] += _ints(x)
                elif m == 2:
                    o["symbol"] = x.decode()
                elif m == 3:
                    o["symbol_roles"] = x
            doc["occurrences"].append(o)
        elif n == 3:
            s: dict = {"symbol": "", "kind": 0, "display_name": "", "documentation": []}
            for m, x in fields(v):
                if m == 1:
                    s["symbol"] = x.decode()
                elif m == 3:
                    s["documentation"].append(x.decode())
                elif m == 5:
                    s["kind"] = x
                elif m == 6:
                    s["display_name"] = x.decode()
            doc["symbols"].append(s)
    return doc


def decode(indexes: DataFrame) -> DataFrame:
    """indexes(content) to schemas.SCIP_DOCS, one row a document."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_schema(_parse_datatype_string(schemas.SCIP_DOCS))

    def run(batches):
        for b in batches:
            for raw in b.column(0).to_pylist():
                docs = [document(v) for n, v in fields(raw) if n == 2]
                for k in range(0, len(docs), 200):
                    yield pa.RecordBatch.from_pylist(docs[k : k + 200], kind)

    return indexes.select("content").mapInArrow(run, schemas.SCIP_DOCS)


def read(spark: SparkSession, path: str) -> DataFrame:
    return decode(spark.read.format("binaryFile").load(path).select(F.col("content")))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Decoded documents, one JSON object a line."""
    return spark.read.schema(schemas.SCIP_DOCS).json(path)
