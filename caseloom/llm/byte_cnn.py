"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover the whole document. Each
byte has a learned embedding; learned filters slide over a chunk and are max-pooled
within it; mean, largest and least pooled value over all chunks of a document enter one
logistic output. The network is fitted on a bounded sample of labelled documents (ids of
least hash; bounds are arguments of ``fit``), on the driver, and applied to whole texts
where they lie.

Defined results: a null text counts as empty and is scored as one chunk of padding; a
null ``doc_id`` is scored and counts as not held out; repeated rows give one result each;
labels that are null or whose document is missing are not used, several labels of one
document are averaged; without labels of both kinds every score is the share of label 1
(0.5 without any label); an empty table gives no rows; texts of any length count
whole; other columns of the input, whatever their names, stay outside.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import id_crc_mod, small_batches, texts

CHUNK, OVERLAP = 512, 64
WIDTH, STRIDE, DIMS, FILTERS = 8, 2, 8, 24


@dataclass
class Network:
    embed: np.ndarray  # 256 x DIMS
    filters: np.ndarray  # WIDTH * DIMS x FILTERS
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # 3 * FILTERS: for the mean, the largest and the least pooled value
    shift: float

    def pooled(self, chunks: np.ndarray, keep_argmax: bool = False):
        """Largest filter response within each chunk; with ``keep_argmax`` also the windows and where it was."""
        flat = self.embed[chunks].reshape(len(chunks), CHUNK * DIMS)
        windows = np.lib.stride_tricks.sliding_window_view(flat, WIDTH * DIMS, axis=1)[:, :: STRIDE * DIMS]
        response = (windows.reshape(-1, WIDTH * DIMS) @ self.filters).reshape(len(chunks), -1, FILTERS)
        if not keep_argmax:
            return response.max(axis=1) + self.bias
        at = response.argmax(axis=1)
        return np.take_along_axis(response, at[:, None], 1)[:, 0] + self.bias, at, windows

    def scores(self, documents: list[bytes], at_once: int = 64) -> np.ndarray:
        """The probability of label 1 for each document; memory is bounded by ``at_once`` chunks."""
        chunks, owner = cut(documents)
        active = np.empty((len(chunks), FILTERS), np.float32)
        for i in range(0, len(chunks), at_once):
            active[i : i + at_once] = np.maximum(self.pooled(chunks[i : i + at_once]), 0)
        return 1 / (1 + np.exp(-(combine(active, owner) @ self.out + self.shift).astype(np.float64)))


def cut(documents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping chunks of all documents (zeros behind the end) and the first chunk of each document."""
    step = CHUNK - OVERLAP
    sizes = np.array([len(d) for d in documents], np.int64)
    counts = np.maximum(1, -(-(sizes - OVERLAP) // step))
    owner = np.concatenate([[0], np.cumsum(counts)[:-1]])
    padded = (counts - 1) * step + CHUNK
    buffer = b"".join(d.ljust(n, b"\0") for d, n in zip(documents, padded))
    base = np.concatenate([[0], np.cumsum(padded)[:-1]])
    starts = np.repeat(base, counts) + step * (np.arange(counts.sum()) - np.repeat(owner, counts))
    return np.lib.stride_tricks.sliding_window_view(np.frombuffer(buffer, np.uint8), CHUNK)[starts], owner


def combine(active: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Mean, largest and least pooled value over each document's chunks."""
    counts = np.diff(np.append(owner, len(active)))[:, None]
    parts = (np.add.reduceat(active, owner) / counts, np.maximum.reduceat(active, owner), np.minimum.reduceat(active, owner))
    return np.concatenate(parts, axis=1)


def train(documents: list[bytes], labels: np.ndarray, seed: int = 7, epochs: int = 8, least_steps: int = 400, batch: int = 32, rate: float = 4e-3) -> Network:
    """Fit by stochastic gradient descent with momentum and per-weight scaling; the same input gives the same network."""
    rng = np.random.default_rng(seed)
    share = float(labels.mean()) if len(labels) else 0.5
    net = Network(
        rng.normal(0, 0.5, (256, DIMS)).astype("f4"),
        rng.normal(0, (WIDTH * DIMS) ** -0.5, (WIDTH * DIMS, FILTERS)).astype("f4"),
        np.zeros(FILTERS, "f4"),
        np.zeros(3 * FILTERS, "f4"),
        0.0,
    )
    if share in (0.0, 1.0) or not len(labels):
        net.shift = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return net
    net.shift = float(np.log(share / (1 - share)))
    weights = [net.embed, net.filters, net.bias, net.out, np.array([net.shift], "f4")]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    steps_each = -(-len(documents) // batch)
    epochs, done = max(epochs, -(-least_steps // steps_each)), 0
    for epoch in range(epochs):
        order = rng.permutation(len(documents))
        for i in range(0, len(order), batch):
            chosen = order[i : i + batch]
            grads = gradients(net, [documents[j] for j in chosen], labels[chosen])
            done += 1
            pace = rate * min(1.0, 1.5 - 1.5 * epoch / epochs)
            for w, g, m, v in zip(weights, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= pace * (m / (1 - 0.9**done)) / (np.sqrt(v / (1 - 0.99**done)) + 1e-6)
            net.shift = float(weights[4][0])
    return net


def gradients(net: Network, documents: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean logistic loss for the five groups of weights."""
    chunks, owner = cut(documents)
    z, at, windows = net.pooled(chunks, keep_argmax=True)
    active = np.maximum(z, 0)
    joined = combine(active, owner)
    probability = 1 / (1 + np.exp(-(joined @ net.out + net.shift)))
    error = ((probability - labels) / len(labels)).astype("f4")
    counts = np.diff(np.append(owner, len(chunks)))
    doc = np.repeat(np.arange(len(documents)), counts)
    mean, most, least = net.out.reshape(3, FILTERS)
    back = (error / counts)[doc][:, None] * mean
    for column, weight in ((1, most), (2, least)):
        hit = active == joined[doc][:, column * FILTERS : (column + 1) * FILTERS]
        ties = np.add.reduceat(hit, owner, dtype="f4")[doc]
        back += error[doc][:, None] * weight * hit / ties
    back *= z > 0
    best = windows[np.arange(len(chunks))[:, None], at]  # chunk x filter x window
    by_filter = np.einsum("mf,mfk->kf", back, best)
    into = (back[:, :, None] * net.filters.T[None]).reshape(-1, DIMS)
    places = at[:, :, None] * STRIDE + np.arange(WIDTH)
    which = chunks[np.arange(len(chunks))[:, None, None], places].reshape(-1)
    by_byte = np.stack([np.bincount(which, into[:, k], 256) for k in range(DIMS)], 1).astype("f4")
    return [by_byte, by_filter.astype("f4"), back.sum(0), joined.T @ error, error.sum(keepdims=True)]


def sample(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, max_rows: int, max_bytes: int) -> list:
    """At most ``max_rows`` labelled documents outside the held-out fold, none over ``max_bytes``: those of least hash."""
    marked = (
        labels.where("quality is not null and doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
        .where(id_crc_mod(F.col("doc_id"), folds) != held_out)
        .withColumn("_place", F.xxhash64("doc_id", F.lit(11)))
    )
    short = texts(docs).where(F.octet_length("text") <= max_bytes)
    present = marked.join(short.select("doc_id"), "doc_id", "left_semi")
    last = present.orderBy("_place").limit(max_rows).agg(F.max("_place")).first()[0]
    if last is None:
        return []
    chosen = F.broadcast(marked.where(F.col("_place") <= last))  # At most max_rows rows of three numbers.
    rows = short.join(chosen, "doc_id").groupBy("_place", "quality").agg(F.min("text").alias("text")).collect()
    return sorted(rows, key=lambda r: r[0])


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, max_rows: int = 2000, max_bytes: int = 16_384) -> Network:
    """A network fitted on a sample of at most ``max_rows`` documents of at most ``max_bytes`` bytes each."""
    rows = sample(docs, labels, folds, held_out, max_rows, max_bytes)
    return train([r.text.encode() for r in rows], np.array([r.quality for r in rows], "f4"))


def score_column(network: Network, text: Column) -> Column:
    """The score of a text column (null: empty)."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            parts = [network.scores([t.encode() for t in batch.iloc[i : i + 256]]) for i in range(0, len(batch), 256)]
            yield pd.Series(np.concatenate([*parts, []]))

    return score(F.coalesce(text, F.lit("")))


def classify(docs: DataFrame, network: Network, folds: int = 3, held_out: int = 1) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in small_batches(whole, "text", 2_000_000):
                scores = network.scores([t.encode() for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double").select(
        "doc_id",
        F.coalesce(id_crc_mod(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
