"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths run over fixed-length windows, each
filter's largest response in a window is a feature, and a softmax over the features
gives the language.  The network is trained in numpy on windows of a bounded sample of
labelled documents and applied to every window of every text; a document's scores are
the mean over its windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm import words as W
from textmill.llm.runtime import hashed_sample, map_batches

WINDOW_BYTES = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
DIMENSIONS = 8
#: Labelled documents that the network is trained on at most, taken by a hash of doc_id; one passage of each.
SAMPLE_ROWS = 6_000
SAMPLE_CHARS = 400
PAD = 256
_BATCH = 96


@dataclass
class Network:
    """Weights; filters of all widths stand in one matrix over the widest, with zeros beyond their own width."""

    languages: list[str]
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def responses(self, windows: np.ndarray) -> np.ndarray:
        """Responses (windows, positions, filters); windows holds byte numbers, PAD beyond the text."""
        n, length = windows.shape
        x = self.embedding[windows]
        widest = max(WIDTHS)
        columns = np.concatenate([x[:, k : length - widest + 1 + k] for k in range(widest)], axis=2)
        return (columns.reshape(-1, columns.shape[2]) @ self.filters).reshape(n, length - widest + 1, -1)

    def logits(self, windows: np.ndarray) -> np.ndarray:
        parts = [np.maximum(self.responses(windows[i : i + _BATCH]).max(axis=1) + self.bias, 0) @ self.out + self.out_bias for i in range(0, len(windows), _BATCH)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)), np.float32)


def cut(data: np.ndarray, offsets: np.ndarray, length: int = WINDOW_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Windows of rows laid end to end, and each window's row; every byte is in one window, an empty row has one of padding."""
    count = np.maximum(1, -(-(offsets[1:] - offsets[:-1]) // length))
    row = np.repeat(np.arange(len(count)), count)
    begin = offsets[:-1][row] + length * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
    at = begin[:, None] + np.arange(length)
    inside = at < offsets[1:][row][:, None]
    padded = np.append(data, 0).astype(np.int16)
    return np.where(inside, padded[np.minimum(at, len(data))], PAD), row


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[bytes], labels: list[str], *, epochs: int = 6, seed: int = 11, rate: float = 0.01, batch: int = 64) -> Network:
    """Fit a network by Adam on one window of each text; languages are weighted alike."""
    random = np.random.default_rng(seed)
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels], dtype=np.int64)
    windows = np.full((len(texts), WINDOW_BYTES), PAD, dtype=np.int16)
    for row, t in zip(windows, texts, strict=True):
        part = np.frombuffer(t[:WINDOW_BYTES], dtype=np.uint8)
        row[: len(part)] = part
    widest, total = max(WIDTHS), FILTERS * len(WIDTHS)
    mask = np.zeros((widest * DIMENSIONS, total), dtype=np.float32)
    for i, w in enumerate(WIDTHS):
        mask[: w * DIMENSIONS, i * FILTERS : (i + 1) * FILTERS] = 1
    net = Network(
        languages,
        random.normal(0, 0.5, (PAD + 1, DIMENSIONS)).astype(np.float32),
        random.normal(0, 0.3, mask.shape).astype(np.float32) * mask,
        np.zeros(total, np.float32),
        random.normal(0, 0.3, (total, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    net.embedding[PAD] = 0
    weight = (len(y) / np.maximum(np.bincount(y, minlength=len(languages)), 1) / len(languages)).astype(np.float32)
    names = ("embedding", "filters", "bias", "out", "out_bias")
    moments = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in names}
    step = 0
    for _ in range(epochs):
        order = random.permutation(len(y))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            grad = _gradients(net, windows[pick], y[pick], weight, mask)
            step += 1
            for k in names:
                m, v = moments[k]
                m += 0.1 * (grad[k] - m)
                v += 0.001 * (grad[k] ** 2 - v)
                getattr(net, k)[...] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            net.embedding[PAD] = 0
    return net


def _gradients(net: Network, windows: np.ndarray, y: np.ndarray, weight: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
    n, widest = len(windows), max(WIDTHS)
    responses = net.responses(windows)
    place = responses.argmax(axis=1)
    pooled = np.take_along_axis(responses, place[:, None], axis=1)[:, 0] + net.bias
    feature = np.maximum(pooled, 0)
    error = _softmax(feature @ net.out + net.out_bias)
    error[np.arange(n), y] -= 1
    error *= (weight[y] / n)[:, None]
    back = (error @ net.out.T) * (pooled > 0)
    # only the bytes at each filter's largest response take part
    at = place[:, :, None] + np.arange(widest)
    seen = windows[np.arange(n)[:, None, None], at]
    x = net.embedding[seen].reshape(n, len(net.bias), -1)
    filters = np.einsum("nf,nfd->df", back, x) * mask
    to_bytes = (back[:, :, None] * net.filters.T[None]).reshape(n, len(net.bias), widest, DIMENSIONS)
    embedding = np.zeros_like(net.embedding)
    np.add.at(embedding, seen.ravel(), to_bytes.reshape(-1, DIMENSIONS))
    return {"embedding": embedding, "filters": filters, "bias": back.sum(axis=0), "out": feature.T @ error, "out_bias": error.sum(axis=0)}


def sample_of(docs: DataFrame, learns: Column, *, sample_rows: int = SAMPLE_ROWS) -> tuple[list[bytes], list[str]]:
    """A passage and the label of sample_rows labelled documents at most; the passage starts anywhere in the text."""
    chars = F.length("text")
    start = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.greatest(chars - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    rows = (
        hashed_sample(docs.where(learns & F.col("lang").isNotNull()), "doc_id", sample_rows, 5)
        .where(F.col("text").rlike(r"\p{L}"))
        .select("h", "doc_id", F.col("text").substr(start, F.lit(SAMPLE_CHARS)).alias("passage"), "lang")
        .orderBy("h", "doc_id", "passage", "lang")
        .limit(sample_rows)
        .toPandas()
    )
    return [p.encode() for p in rows["passage"]], rows["lang"].tolist()


def held_out(divisor: int, remainder: int) -> Column:
    """Whether crc32 of doc_id as text leaves the remainder; a null doc_id is hashed as empty."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(divisor)) == remainder


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every row's whole text.

    ``und`` with score 0 stands for null texts, texts without a letter, and for all texts
    if there is no network.  Rows are judged one by one: repeats give equal rows, and a
    very long text is more windows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in W.slices(batch.column("text")):
                name, score = _predict(net, data, offsets, np.asarray(batch.column("letters").slice(a, b - a).to_pylist(), dtype=bool))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a).cast(pa.int64()), pa.array(name, pa.string()), pa.array(score)], schema=schema)

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    return docs.select("doc_id", "text", letters).transform(map_batches, rows, "doc_id long, lang_pred string, score double")


def _predict(net: Network | None, data: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> tuple[list[str], np.ndarray]:
    if net is None:
        return ["und"] * len(letters), np.zeros(len(letters))
    logits = np.zeros((len(letters), len(net.languages)))
    windows, row = cut(data, offsets)
    np.add.at(logits, row, net.logits(windows))
    p = _softmax(logits / np.bincount(row, minlength=len(letters))[:, None])
    best = p.argmax(axis=1)
    return [net.languages[k] if ok else "und" for k, ok in zip(best, letters, strict=True)], np.where(letters, p[np.arange(len(p)), best], 0.0)


def predict_languages(docs: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Train on labelled documents that are not held out (remainder 1 of 3), predict all; adds held_out."""
    texts, labels = sample_of(docs, ~held_out(3, 1), sample_rows=sample_rows)
    found = identify(docs, train(texts, labels) if texts else None)
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")
