"""Language identification with a byte convolutional network, in numpy.

Bytes (A-Z lower-cased) of fixed windows go through filters of several widths,
max pooling over the window, and a softmax layer. A filter of width k is k
tables of 256 rows, one for each place, so that a convolution is a sum of table
rows; for prediction, tables of neighbouring places are folded into tables over
byte pairs. A text is cut into consecutive windows of WINDOW bytes (the last
padded with spaces) that cover it all; its distribution is the mean of its
windows' distributions, weighted by their bytes.

Training reads a bounded sample: at most `per_lang` labelled rows of each language,
and fewer where there are so many languages that this exceeds `most_rows` (but at
least LEAST of each; every language is learnt), those with the smallest hash, and
PIECES windows spread over each. Prediction uses the text alone.

Defined results: a null text or one without a letter is 'und' with score 0, and
so is everything if no labelled row is left to learn from; null ids pass
through (rows with null id, text or lang teach nothing); repeated rows give
repeated rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, table

WINDOW, PIECES, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 16
LEAST, SPARE = 16, 4
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Model:
    langs: list[str]
    tables: list[np.ndarray]  # per width: (width, 256, FILTERS)
    bias: np.ndarray  # (len(WIDTHS) * FILTERS,)
    dense: np.ndarray  # (features, langs)
    out: np.ndarray  # (langs,)


def _maxima(windows: np.ndarray, tables: list[np.ndarray], best: bool = False):
    """Largest response of each filter in each window, (n, features); with `best` also where."""
    top, where = [], []
    for t in tables:
        k = len(t)
        r = t[0][windows[:, : WINDOW - k + 1]]
        for j in range(1, k):
            r = r + t[j][windows[:, j : WINDOW - k + 1 + j]]
        if best:
            where.append(r.argmax(1))
        top.append(r.max(1))
    return (np.concatenate(top, 1), where) if best else np.concatenate(top, 1)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(windows: np.ndarray, labels: np.ndarray, langs: list[str], steps: int = 1500, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Model:
    """Adam on cross-entropy; gradients of the pooled maxima go to the winning place only."""
    rnd = np.random.default_rng(seed)
    feats = len(WIDTHS) * FILTERS
    params = [rnd.normal(0, 0.1, (k, 256, FILTERS)).astype(np.float32) for k in WIDTHS]
    params += [np.zeros(feats, np.float32), rnd.normal(0, 0.3, (feats, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    of = [np.flatnonzero(labels == c) for c in range(len(langs))]
    for step in range(1, steps + 1):
        pick = np.array([rnd.choice(of[c]) for c in rnd.integers(0, len(langs), batch)])  # languages in equal parts
        x, y = windows[pick].copy(), labels[pick]
        for i in np.flatnonzero(rnd.random(batch) < 0.3):  # short texts must be told apart as well
            x[i, rnd.integers(8, WINDOW) :] = 32
        top, where = _maxima(x, params[:-3], best=True)
        pre = top + params[-3]
        hid = np.maximum(pre, 0)
        p = _softmax(hid @ params[-2] + params[-1])
        p[np.arange(batch), y] -= 1
        p /= batch
        back = (p @ params[-2].T) * (pre > 0)
        grads = []
        for w, (k, at) in enumerate(zip(WIDTHS, where)):
            g = np.zeros_like(params[w])
            own = back[:, w * FILTERS : (w + 1) * FILTERS]
            for j in range(k):
                np.add.at(g[j], (x[np.arange(batch)[:, None], at + j], np.arange(FILTERS)[None, :]), own)
            grads.append(g)
        grads += [back.sum(0), hid.T @ p, p.sum(0)]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            params[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Model(langs, params[:-3], params[-3], params[-2], params[-1])


def as_windows(raw: bytes) -> np.ndarray:
    n = max(1, -(-len(raw) // WINDOW))
    return LOWER[np.frombuffer(raw.ljust(n * WINDOW), np.uint8).reshape(n, WINDOW)]


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % 3 == 1


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 1500, most_rows: int = 12_000, steps: int = 1500, seed: int = 7) -> Model | None:
    """A model from at most per_lang rows of each language; None if there are none.

    The driver gets max(most_rows, LEAST * languages) rows of PIECES * WINDOW characters at most.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    # Only rows whose hash is below a bound that leaves about SPARE * per_lang of a language are dealt out and ordered.
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not sizes:
        return None
    per_lang = min(per_lang, max(LEAST, most_rows // len(sizes)))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, min(1.0, SPARE * per_lang / r.n))])[F.col("lang")]
    few = labelled.withColumn("h", F.xxhash64("doc_id", "text")).where(F.col("h").cast("double") / 2.0**64 + 0.5 <= share)
    size = F.length("text")
    piece = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substr("text", (F.floor(i * size / PIECES) + 1).cast("int"), F.lit(WINDOW)))
    few = few.select("lang", "h", piece.alias("p")).dropDuplicates(["lang", "h"])
    rows = few.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= per_lang).drop("n").collect()
    rows = sorted(rows, key=lambda r: (r.lang, r.h))
    langs = sorted({r.lang for r in rows})
    xs, ys = [], []
    for r in rows:
        for p in dict.fromkeys(r.p):
            if any(c.isalpha() for c in p):
                xs.append(as_windows(p.encode("utf-8", "replace")[:WINDOW])[0])
                ys.append(langs.index(r.lang))
    langs_seen = sorted(set(ys))
    if not xs:
        return None
    ys = [langs_seen.index(y) for y in ys]
    return fit(np.array(xs), np.array(ys), [langs[c] for c in langs_seen], steps, seed=seed)


def classify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from its whole text. No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        label = _labeller(model)
        for b in batches:
            langs, scores = [], []
            for _, texts in chunks(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = label(texts)
                langs += found[0]
                scores += found[1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def _labeller(model: Model | None):
    """A function from encoded texts to (languages, scores)."""
    if model is None:
        return lambda texts: (["und"] * len(texts), [0.0] * len(texts))
    pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
    two = pair(model.tables[0][0], model.tables[0][1])
    three = pair(model.tables[1][0], model.tables[1][1]), model.tables[1][2]
    four = pair(model.tables[2][0], model.tables[2][1]), pair(model.tables[2][2], model.tables[2][3])

    def probabilities(w: np.ndarray) -> np.ndarray:
        p = w[:, :-1].astype(np.uint16) << 8 | w[:, 1:]
        top = [two[p].max(1), (three[0][p[:, :-1]] + three[1][w[:, 2:]]).max(1), (four[0][p[:, :-2]] + four[1][p[:, 2:]]).max(1)]
        hid = np.maximum(np.concatenate(top, 1) + model.bias, 0)
        return _softmax((hid @ model.dense + model.out).astype(np.float64))

    def label(texts: list[bytes]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        own = [k for k, t in enumerate(texts) if any(c.isalpha() for c in t.decode("utf-8", "replace"))]
        if not own:
            return langs, scores
        counts = [max(1, -(-len(texts[k]) // WINDOW)) for k in own]
        w = np.concatenate([as_windows(texts[k]) for k in own])
        p = np.concatenate([probabilities(w[i : i + 256]) for i in range(0, len(w), 256)])
        weight = np.full(len(w), float(WINDOW))
        ends = np.cumsum(counts)
        for e, k, n in zip(ends, own, counts):
            weight[e - 1] = max(1, len(texts[k]) - (n - 1) * WINDOW)
        starts = ends - counts
        mean = np.add.reduceat(p * weight[:, None], starts) / np.add.reduceat(weight, starts)[:, None]
        for k, c, row in zip(own, mean.argmax(1), mean):
            langs[k], scores[k] = model.langs[c], float(min(1.0, row[c]))
        return langs, scores

    return label


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.35) -> DataFrame:
    """Rows of docs whose language is identified: not 'und', and with a score of `least` or more.

    `least` is low, as the scores of short and of mixed texts are: it is meant for texts that
    no learned language explains. The text decides in the same pass, so that rows keep all
    their columns without a join.
    """
    model = train(docs.where(~held_out(F.col(id_col))), id_col, text_col, lang_col)
    place, names = docs.columns.index(text_col), docs.columns

    def run(batches):
        label = _labeller(model)
        for b in batches:
            langs, scores = [], []
            for _, texts in chunks([None] * b.num_rows, b.column(place).to_pylist()):
                found = label(texts)
                langs += found[0]
                scores += found[1]
            keep = pa.array([x != "und" and s >= least for x, s in zip(langs, scores)])
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in b.columns], names)

    return docs.mapInArrow(run, docs.schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = classify(docs, train(docs.where(~held_out(F.col("doc_id")))))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
