"""Quality by compression: how much better a text compresses with a dictionary of good texts than with one of bad texts.

Two zstandard dictionaries are built from a bounded sample of labelled rows. A text is cut into blocks and every block is
compressed with each dictionary, so that no block profits from the text before it and a long text is judged all along.
The normalised difference of the compressed sizes, (bad - good) / (bad + good), its value for the text's worst blocks and
the same difference of the plain size and the size by the good dictionary (what both dictionaries save in common, without
which three times as many held-out bad texts pass) enter a logistic regression fitted on a second part of the sample, which
gives a calibrated score. The fit weights each class by its labelled rows, all of them and not those in the sample, so the
bounds do not move the scores.

Defined results: null and empty texts score the smoothed share of good labels; rows without a label or whose label is
null are not learned from; a sample with one class, or none, gives every text that share and drops no row; a labelled text
that does not fit into what is left of SAMPLE_BYTES is passed over and the next is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import free_name, text_slices

#: Rows of each class that the sample has at most, in the order of a hash; half build the dictionaries.
SAMPLE_ROWS = 1500
#: Bytes of text that the sample of a class holds at most (whole texts).
SAMPLE_BYTES = 8 << 20
DICTIONARY_BYTES = 64 << 10
BLOCK_BYTES = 1024
LEVEL = 1
THRESHOLD = 0.7
FEATURES = 4


class Compressors:
    """The two dictionaries, ready to compress."""

    def __init__(self, good: bytes, bad: bytes):
        make = lambda d: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
        self.good, self.bad = make(good), make(bad)

    def features(self, text: bytes) -> tuple[float, ...]:
        """1, the normalised difference over all blocks, its lower tenth over the blocks, and the one
        of the plain size and the size by the good dictionary."""
        if not text:
            return (1.0,) + (0.0,) * (FEATURES - 1)
        good, bad = [], []
        for at in range(0, len(text), BLOCK_BYTES):
            block = text[at : at + BLOCK_BYTES]
            good.append(len(self.good.compress(block)))
            bad.append(len(self.bad.compress(block)))
        g, b = np.array(good, float), np.array(bad, float)
        each = (b - g) / (b + g)
        return 1.0, float((b.sum() - g.sum()) / (b.sum() + g.sum())), float(np.partition(each, len(each) // 10)[len(each) // 10]), float((len(text) - g.sum()) / (len(text) + g.sum()))


def build_dictionary(texts: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary; raw content where there is too little to train on."""
    blocks = [t[at : at + BLOCK_BYTES] for t in texts for at in range(0, len(t), BLOCK_BYTES)]
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-size:] or b" " * 16


def fit_logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, mean, scale) of a ridge logistic regression by Newton's method on standardised features; a row counts by its share."""
    share = share * (len(y) / share.sum())
    mean = np.average(x, 0, share)
    scale = np.sqrt(np.average((x - mean) ** 2, 0, share))
    mean[0], scale[scale < 1e-12] = 0.0, 1.0
    scale[0] = 1.0
    z, w = (x - mean) / scale, np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (share * p * (1 - p))[:, None]).T @ z + ridge * len(y) * np.eye(len(w)) + 1e-9 * np.eye(len(w)), z.T @ (share * (p - y)) + ridge * len(y) * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale


class QualityModel:
    """Fitted on a sample of each class; n_good and n_bad are the labelled rows that the samples stand for."""

    def __init__(self, good: list[str], bad: list[str], n_good: int, n_bad: int):
        g, b = ([t.encode() for t in texts if t] for texts in (good, bad))
        self.prior = (n_good + 1) / (n_good + n_bad + 2)
        self.usable = len(g) >= 4 and len(b) >= 4
        if self.usable:
            self.dictionaries = build_dictionary(g[::2]), build_dictionary(b[::2])
            tool = Compressors(*self.dictionaries)
            x = np.array([tool.features(t) for t in [*g[1::2], *b[1::2]]])
            sizes = [len(g[1::2]), len(b[1::2])]
            y, share = np.repeat([1.0, 0.0], sizes), np.repeat([n_good / sizes[0], n_bad / sizes[1]], sizes)
            self.weights, self.mean, self.scale = fit_logistic(x, y, share)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.usable:
            return np.full(len(texts), self.prior)
        tool = Compressors(*self.dictionaries)
        x = np.array([tool.features((t or "").encode()) for t in texts]).reshape(-1, FEATURES)
        p = 1 / (1 + np.exp(-np.clip(((x - self.mean) / self.scale) @ self.weights, -30, 30)))
        return np.where([bool(t) for t in texts], p, self.prior)


def chosen(sizes: list[tuple[int, int]], limit: int) -> list[int]:
    """The lots of rows (lot, bytes), in order, that fit into the limit together; one that does not fit is passed over."""
    taken, left = [], limit
    for lot, size in sorted(sizes):
        if size <= left:
            taken.append(lot)
            left -= size
    return taken


def _class_sample(rows: DataFrame, label: int, n: int) -> list[str]:
    """Whole texts of one class of n rows, at most SAMPLE_ROWS and SAMPLE_BYTES of them, chosen by a hash of the identifier.

    Sizes come to the driver first, 16 bytes a row; texts are fetched only for rows that fit.
    """
    own = rows.where((F.col("label") == label) & (F.col("lot") < F.lit(min(1 << 62, int((1 << 62) * 1.2 * SAMPLE_ROWS / max(1, n))))))
    sizes = own.select("lot", "size").orderBy("lot", "size").limit(SAMPLE_ROWS).collect()
    lots = chosen([(r["lot"], r["size"]) for r in sizes], SAMPLE_BYTES)
    if not lots:
        return []
    wanted = F.broadcast(own.sparkSession.createDataFrame([(x,) for x in lots], "lot long"))
    texts = own.where(F.col("size") <= SAMPLE_BYTES).join(wanted, "lot", "left_semi").dropDuplicates(["lot"]).select("lot", "text").toLocalIterator()
    return [r["text"] for r in sorted(texts, key=lambda r: r["lot"])]


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fit on the labelled rows of docs for which `learn` holds."""
    marked = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    # A row's lot: a hash of its identifier and text, so that rows that repeat an identifier are told apart.
    lot = F.shiftrightunsigned(F.xxhash64(id_col, text_col, F.lit(29)), 2)
    texts = docs.where(learn).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.octet_length(text_col).alias("size"), lot.alias("lot")).where("size > 0")
    rows = texts.join(marked, "id")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    n_good, n_bad = counts.get(1, 0), counts.get(0, 0)
    return QualityModel(_class_sample(rows, 1, n_good), _class_sample(rows, 0, n_bad), n_good, n_bad)


def with_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", score: str = "score") -> DataFrame:
    """docs with a score from 0 to 1; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size and four weights

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text_col):
            scores = shared.value.scores(batch.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, score])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))


def learnable(id_col: str = "doc_id") -> Column:
    """Rows that may be learned from: those whose identifier's checksum modulo 4 is not 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 != 2, F.lit(True))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    model = train(docs, labels, learnable(id_col), id_col, text_col)
    scored = with_quality(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    return scored.select("doc_id", (~learnable("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the classifier does not reject; all of them where there is too little to learn from."""
    model = train(docs, labels, learnable(id_col), id_col, text_col)
    if not model.usable:
        return docs
    name = free_name(docs, "score")
    return with_quality(docs, model, text_col, name).where(F.col(name) >= THRESHOLD).drop(name)
