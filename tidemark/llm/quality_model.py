"""Document quality from passages: gated attention pooling of passage encodings."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, small_batches
from tidemark.llm.words import mix, words_of

#: Words in a passage.
PASSAGE = 64
#: Labelled documents that the model is fitted on, at most; chosen by a hash of the id.
TRAIN_DOCS = 8000
#: Passages of a document that the model is fitted on, at most, evenly spaced; scores use all.
TRAIN_PASSAGES = 256
#: Classes of bytes whose shares are features.
CLASSES = ("upper", "lower", "digit", "stop", "quote", "mark", "bracket", "symbol", "high", "newline")
_CLASS = np.zeros((len(CLASSES), 256), bool)
for _i, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), b".,;:", b"'\"`", b"!?", b"()[]{}", b"#*$%&|<>@^~_=+/\\-", range(128, 256), b"\n")):
    _CLASS[_i, list(_bytes)] = True
N_FEATURES = len(CLASSES) + 7


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a batch, a row each, and where each text's passages begin (and the end).

    A text without words has one passage of zeros.  Features are shares of byte
    classes, the word lengths' mean and spread, the share of distinct words, of words
    that repeat in the text and of 3-word runs that do, and how full the passage is.
    """
    w = words_of(column)
    n_words = np.diff(w.firsts)
    n_passages = np.maximum(1, -(-n_words // PASSAGE))
    bounds = np.concatenate([[0], np.cumsum(n_passages)])
    out = np.zeros((bounds[-1], N_FEATURES), np.float32)
    word_repeats = np.zeros(len(w.starts), np.float32)
    run_repeats = np.zeros(len(w.starts), np.float32)
    salt = np.array([3, 5, 7], np.uint64)
    runs = mix(w.hashes[:-2] * salt[0] + w.hashes[1:-1] * salt[1] + w.hashes[2:] * salt[2]) if len(w.hashes) > 2 else w.hashes[:0]
    filled = np.flatnonzero(n_words)
    for d in filled:
        a, b = w.firsts[d], w.firsts[d + 1]
        _, at, counts = np.unique(w.hashes[a:b], return_inverse=True, return_counts=True)
        word_repeats[a:b] = counts[at] > 1
        if b - a > 2:
            _, at, counts = np.unique(runs[a : b - 2], return_inverse=True, return_counts=True)
            run_repeats[a : b - 2] = counts[at] > 1
    if not len(filled):
        return out, bounds
    where = np.concatenate([np.arange(bounds[d], bounds[d + 1]) for d in filled])
    first = np.concatenate([np.arange(w.firsts[d], w.firsts[d + 1], PASSAGE) for d in filled])
    last = np.minimum(first + PASSAGE, np.repeat(w.firsts[1:][filled], n_passages[filled]))
    size = (last - first).astype(np.float64)
    begin = w.starts[first]
    stop = np.concatenate([begin[1:], [len(w.data)]])
    stop[np.searchsorted(where, bounds[filled + 1]) - 1] = w.offsets[filled + 1]  # to the end of the text
    n_bytes = np.maximum(stop - begin, 1)
    spans = np.empty(2 * len(begin), np.int64)
    spans[0::2], spans[1::2] = begin, stop
    for i in range(len(CLASSES)):
        sums = np.concatenate([[0], np.cumsum(_CLASS[i][w.data])])
        out[where, i] = (sums[stop] - sums[begin]) / n_bytes
    lengths = (w.ends - w.starts).astype(np.float64)
    total = lambda x: np.add.reduceat(x, first)
    mean = total(lengths) / size
    k = len(CLASSES)
    out[where, k] = mean / 10
    out[where, k + 1] = np.sqrt(np.maximum(total(lengths**2) / size - mean**2, 0)) / 10
    order = np.lexsort((w.hashes, np.repeat(np.arange(len(first)), last - first)))
    sorted_hashes, sorted_of = w.hashes[order], np.repeat(np.arange(len(first)), last - first)
    new = np.ones(len(order), bool)
    new[1:] = (sorted_hashes[1:] != sorted_hashes[:-1]) | (sorted_of[1:] != sorted_of[:-1])
    out[where, k + 2] = np.add.reduceat(new.astype(np.float64), first) / size
    out[where, k + 3] = total(word_repeats.astype(np.float64)) / size
    out[where, k + 4] = total(run_repeats.astype(np.float64)) / size
    out[where, k + 5] = size / PASSAGE
    out[where, k + 6] = 1
    return out, bounds


class Model(NamedTuple):
    """Encoder, gated attention (tanh branch, sigmoid branch, weights) and classifier."""

    mean: np.ndarray
    scale: np.ndarray
    encode: np.ndarray
    encode0: np.ndarray
    gate_v: np.ndarray
    gate_u: np.ndarray
    attend: np.ndarray
    weigh: np.ndarray
    bias: np.ndarray


def _segment_softmax(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    starts = bounds[:-1]
    of = np.repeat(np.arange(len(starts)), np.diff(bounds))
    e = np.exp(x - np.maximum.reduceat(x, starts)[of])
    return e / np.add.reduceat(e, starts)[of]


def _forward(model: Model, x: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    z = (x - model.mean) / model.scale
    h = np.tanh(z @ model.encode + model.encode0)
    v, u = np.tanh(h @ model.gate_v), 1 / (1 + np.exp(-(h @ model.gate_u)))
    a = _segment_softmax((v * u) @ model.attend, bounds)
    pooled = np.add.reduceat(h * a[:, None], bounds[:-1], axis=0)
    return {"z": z, "h": h, "v": v, "u": u, "a": a, "pooled": pooled, "score": 1 / (1 + np.exp(-np.clip(pooled @ model.weigh + model.bias[0], -30, 30)))}


def score_passages(model: Model, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Scores of texts: the classifier on the attention-weighted mean of their passages' encodings."""
    return _forward(model, x, bounds)["score"]


def _gradients(model: Model, x: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    f = _forward(model, x, bounds)
    of = np.repeat(np.arange(len(y)), np.diff(bounds))
    d_logit = (f["score"] - y) / len(y)
    d_pooled = np.outer(d_logit, model.weigh)[of]
    d_a = (d_pooled * f["h"]).sum(1)
    d_e = f["a"] * (d_a - np.add.reduceat(f["a"] * d_a, bounds[:-1])[of])
    d_vu = np.outer(d_e, model.attend)
    d_v, d_u = d_vu * f["u"] * (1 - f["v"] ** 2), d_vu * f["v"] * f["u"] * (1 - f["u"])
    d_h = d_pooled * f["a"][:, None] + d_v @ model.gate_v.T + d_u @ model.gate_u.T
    d_z = d_h * (1 - f["h"] ** 2)
    return [f["z"].T @ d_z, d_z.sum(0), f["h"].T @ d_v, f["h"].T @ d_u, (f["v"] * f["u"]).T @ d_e, f["pooled"].T @ d_logit, d_logit.sum(keepdims=True)]


def fit(x: np.ndarray, bounds: np.ndarray, y: np.ndarray, hidden: int = 32, gate: int = 16, epochs: int = 40, batch: int = 256, seed: int = 7) -> Model:
    """Fit by Adam on the cross-entropy of document labels; passages have none."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    base = np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3)) if len(y) else 0.0
    model = Model(x.mean(0), x.std(0) + 1e-3, draw(N_FEATURES, hidden), np.zeros(hidden), draw(hidden, gate), draw(hidden, gate), draw(gate), draw(hidden), np.array([base]))
    if not len(y):
        return model
    weights = [p.astype(np.float64) for p in model[2:]]
    first, second = ([np.zeros_like(p) for p in weights] for _ in range(2))
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            rows = np.concatenate([np.arange(bounds[d], bounds[d + 1]) for d in pick])
            own = np.concatenate([[0], np.cumsum(bounds[pick + 1] - bounds[pick])])
            step += 1
            for i, g in enumerate(_gradients(model._replace(**dict(zip(Model._fields[2:], weights, strict=True))), x[rows], own, y[pick])):
                g = g + 1e-4 * weights[i]
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                weights[i] = weights[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return model._replace(**dict(zip(Model._fields[2:], weights, strict=True)))


def _held_out(id_: str):
    return F.crc32(F.col(id_).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on at most ``train_docs`` labelled documents that aren't held out, with ``TRAIN_PASSAGES`` passages each.

    Of several texts of one id one is taken.  Passages are encoded to features on the executors; the driver gets those of the
    chosen documents alone.  Null labels are left out; of several labels of an id the least counts.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
        .where(F.col("y").isNotNull() & F.col("doc_id").isNotNull())
        .where(~_held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(train_docs)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            x, bounds = passages(batch.column("text"))
            own = [x[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            rows = [p[np.linspace(0, len(p) - 1, min(len(p), TRAIN_PASSAGES)).round().astype(int)].astype("<f4").tobytes() for p in own]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(rows, pa.binary())], names=["doc_id", "y", "x"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    got = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, x binary").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x")).collect()
    got.sort(key=lambda r: r["doc_id"])
    xs = [np.frombuffer(r["x"], "<f4").reshape(-1, N_FEATURES) for r in got]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in xs])]).astype(np.int64)
    return fit(np.concatenate(xs) if xs else np.zeros((1, N_FEATURES), np.float32), bounds, np.array([r["y"] for r in got], np.float64))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1, higher for good texts) and ``predicted`` for every row.

    The score is a function of the text alone.  Every passage of the whole text is
    encoded, and a gated attention learned from labels of documents weighs the
    passages.  Scoring is one narrow pass; the model, a few thousand numbers, goes to
    the workers with the task.

    Null and empty texts have one passage of zeros and so a score like others.
    Repeated rows get equal scores.  Without any label all texts score about a half.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = train(docs, labels, id_col, text_col)
    held = F.coalesce(_held_out("doc_id"), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            scores = score_passages(model, *passages(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array(scores >= threshold, pa.bool_()).cast(pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", held.alias("held_out"), "text")
    return own.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
