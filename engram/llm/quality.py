"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network whose
probabilities are calibrated with a temperature.

Random indexing: every word has a sparse random index vector (a few +1 and -1, from its hash); a word's
context vector is the sum of its neighbours' index vectors over the whole corpus. Words share a fixed number
of hashed rows, so the table that is summed over partitions and broadcast has a size set by parameters.

Only labels of rows that aren't held out are learned from; the network is fitted on at most
``MAX_LABELLED`` labelled rows (those with the smallest id hash), a documented bound. Word vectors are
counted over all documents.

Words share ``ROWS`` hashed rows on purpose: two words of one row share a vector, which a larger table makes rarer and never
changes what counts. The table's size is a parameter of the model, not a cap on the vocabulary: every word is counted.

Defined results: null and empty texts are scored from their (zero) pooled vector; with no labels, or labels of one
class, the score is that class's smoothed rate; an id that is labelled more than once teaches once per
label; of rows that share a labelled id the one with the smallest text hash teaches; repeated rows count in the word vectors each
time and are scored each on its own; equal hashes are broken by id and label; an empty table gives an empty result; very long texts
are read whole; columns that are named like a result are replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, mix64, runs, shielded, summed, table, tidy, utf8

MAX_LABELLED = 20_000
ROWS, DIMS, CHUNKS, REACH = 8192, 32, 8, 2
THRESHOLD = 0.3
_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\s]+")
#: Rows kept for a word in capitals, a word equal to the one before, and the gap between documents.
CAPITALS, AGAIN, GAP = 0, 1, 2


class RowOf(dict):
    """Token to its row of the vector table; the first tokens are remembered, up to a bound."""

    def __init__(self, most: int = 200_000):
        import xxhash

        super().__init__()
        self._hash, self._most = xxhash.xxh3_64_intdigest, most

    def __missing__(self, token: bytes) -> int:
        row = CAPITALS if token.isupper() and len(token) > 1 else 3 + self._hash(token.lower()) % (ROWS - 3)
        if len(self) < self._most:
            self[token] = row
        return row


def rows_of(texts: list[bytes], known: RowOf) -> tuple[np.ndarray, np.ndarray]:
    """Vector rows of all tokens, a gap after each text, and where each text starts."""
    tokens = [_TOKEN.findall(t) for t in texts]
    starts = np.cumsum([0] + [len(t) + 1 for t in tokens])
    rows = np.full(starts[-1], GAP, np.int32)
    for s, t in zip(starts[:-1].tolist(), tokens, strict=True):
        rows[s : s + len(t)] = np.fromiter(map(known.__getitem__, t), np.int32, len(t))
    same = np.zeros(len(rows), bool)
    same[1:] = (rows[1:] == rows[:-1]) & (rows[1:] > GAP)
    rows[same] = AGAIN
    return rows, starts


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Per row two dimensions, the first counted +1 and the second -1."""
    h = mix64(np.arange(ROWS, dtype=np.uint64) + np.uint64(12345))
    plus = (h % np.uint64(DIMS)).astype(np.int64)
    minus = (plus + 1 + (h >> np.uint64(32)).astype(np.int64) % (DIMS - 1)) % DIMS
    return plus, minus


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Context vectors from all ``docs``: ROWS x DIMS, each of unit length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known, (plus, minus) = np.zeros(ROWS * DIMS, np.int64), RowOf(), index_vectors()
        for b in batches:
            texts = utf8(b, "text")
            for x, y in runs(map(len, texts), 2_000_000):
                rows, _ = rows_of(texts[x:y], known)
                for d in range(1, REACH + 1):
                    left, right = rows[:-d], rows[d:]
                    fine = (left != GAP) & (right != GAP)
                    left, right = left[fine].astype(np.int64), right[fine].astype(np.int64)
                    for a, c in ((left, right), (right, left)):
                        total += np.bincount(a * DIMS + plus[c], minlength=ROWS * DIMS)
                        total -= np.bincount(a * DIMS + minus[c], minlength=ROWS * DIMS)
        part, step = TaskContext.get().partitionId(), ROWS * DIMS // CHUNKS
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(CHUNKS), pa.int32()), pa.array([part] * CHUNKS, pa.int32()), pa.array([total[i * step : (i + 1) * step].tobytes() for i in range(CHUNKS)], pa.binary())],
            names=["chunk", "part", "payload"],
        )

    got = summed(docs.select(F.col(text_col).alias("text")).mapInArrow(tidy(run), "chunk int, part int, payload binary"), "<i8")
    step = ROWS * DIMS // CHUNKS
    v = np.concatenate([got.get(i, np.zeros(step)) for i in range(CHUNKS)]).reshape(ROWS, DIMS).astype(np.float32)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-6)


def pooled(texts: list[bytes], vectors: np.ndarray, known: RowOf) -> np.ndarray:
    """Mean of each text's word vectors and its length, the mean over its distinct-neighbour rows, and the shares of the kept rows."""
    out = np.zeros((len(texts), DIMS + 3), np.float32)
    for x, y in runs(map(len, texts), 50_000):  # so that the gathered vectors stay in the processor's cache
        rows, starts = rows_of(texts[x:y], known)
        n = np.diff(starts) - 1
        v = vectors[rows]
        v[rows == GAP] = 0
        mean = np.add.reduceat(v, starts[:-1], axis=0) / np.maximum(n, 1)[:, None]
        caps, again = (np.add.reduceat((rows == k).astype(np.float32), starts[:-1]) / np.maximum(n, 1) for k in (CAPITALS, AGAIN))
        out[x:y] = np.column_stack([mean, np.linalg.norm(mean, axis=1), caps, again])
    return out


class Network:
    """Two layers, fitted by Adam on standardised inputs; ``temperature`` is fitted on a validation part."""

    def __init__(self, x: np.ndarray, y: np.ndarray, *, hidden: int = 32, epochs: int = 60, seed: int = 7):
        self.rate = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        self.fitted = len(y) >= 10 and 0 < y.sum() < len(y)
        if not self.fitted:
            return
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-4
        x, check = (x - self.mean) / self.scale, np.arange(len(y)) % 5 == 0
        w = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        xt, yt, best = x[~check], y[~check].astype(float), (np.inf, w)
        for _ in range(epochs):
            order = rng.permutation(len(yt))
            for i in range(0, len(order), 128):
                xb, yb = xt[order[i : i + 128]], yt[order[i : i + 128]]
                h = np.maximum(0, xb @ w[0] + w[1])
                d = (_sigmoid(h @ w[2] + w[3]) - yb) / len(yb)
                back = np.outer(d, w[2]) * (h > 0)
                t += 1
                for k, g in enumerate((xb.T @ back + 1e-4 * w[0], back.sum(0), h.T @ d + 1e-4 * w[2], d.sum(keepdims=True))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    w[k] = w[k] - 3e-3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
            self.w = w
            loss = _loss(self._logit(x[check]), y[check])
            if loss < best[0]:
                best = (loss, [a.copy() for a in w])
        self.w = best[1]
        z = self._logit(x[check])
        self.temperature = min(np.exp(np.linspace(-1.5, 1.5, 121)), key=lambda k: _loss(z / k, y[check]))

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(0, x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.rate)
        return _sigmoid(self._logit((x - self.mean) / self.scale) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, np.where(y == 1, -z, z))))


def features(docs: DataFrame, vectors, others: list[str], text_col: str = "text") -> DataFrame:
    """``others`` of ``docs`` and the pooled vector as ``x`` (binary float32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = RowOf()
        for b in batches:
            x = pooled(utf8(b, text_col), vectors.value, known)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), pa.array([r.tobytes() for r in x], pa.binary())], names=[*others, "x"])

    rows = docs.select(*others, text_col)
    return rows.mapInArrow(tidy(run), docs.select(*others).schema.add("x", "binary"))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED):
    """(broadcast word vectors, network). ``docs``: all documents; labels of held-out ids are left out."""
    vectors = docs.sparkSession.sparkContext.broadcast(word_vectors(docs, text_col))
    usable = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)").filter(~held_out(F.col("_id")))
    picked = usable.join(docs.select(F.col(id_col).alias("_id")), "_id", "left_semi").orderBy(F.xxhash64("_id"), "_id", "_y").limit(max_labelled)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "_id")  # max_labelled rows at most
    # One row of a repeated id teaches, so what is collected is max_labelled rows at most too.
    rows = rows.groupBy("_id", "_y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = rows.join(F.broadcast(picked.groupBy("_id", "_y").agg(F.count(F.lit(1)).cast("int").alias("_times"))), ["_id", "_y"])
    got = [r for r in features(rows, vectors, ["_id", "_y", "_times"]).collect() for _ in range(r["_times"])]
    got.sort(key=lambda r: (r["_id"], r["_y"], bytes(r.x)))
    got = [got[i] for i in np.random.default_rng(1).permutation(len(got))]
    x = np.frombuffer(b"".join(bytes(r.x) for r in got), "<f4").reshape(len(got), DIMS + 3)
    return vectors, Network(x, np.array([r["_y"] for r in got], int))


def score(docs: DataFrame, model, *, text_col: str = "text", threshold: float = THRESHOLD, keep_text: bool = False) -> DataFrame:
    """``docs`` with score and predicted, without the text unless asked for."""
    vectors, network = model
    shared = docs.sparkSession.sparkContext.broadcast(network)
    names = [c for c in docs.columns if (keep_text or c != text_col) and c not in ("_score", "_predicted")]
    docs = docs.select(*names, *([] if keep_text else [text_col]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = RowOf()
        for b in batches:
            p = shared.value.score(pooled(utf8(b, text_col), vectors.value, known)).astype(float)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*names, "_score", "_predicted"])

    schema = docs.select(*names).schema.add("_score", "double").add("_predicted", "integer")
    return docs.mapInArrow(tidy(run), schema)


def keep_good(docs: DataFrame, model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` that the classifier accepts, all columns as they came."""
    docs, new, back = shielded(docs)
    return back(score(docs, model, text_col=new[text_col], threshold=threshold, keep_text=True).filter("_predicted = 1"))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: the quality of every document, learned from labels of rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = score(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
    return out.withColumnsRenamed({"_score": "score", "_predicted": "predicted"})
