"""Quality of documents: random-indexing word vectors, pooled, then a two-layer network with calibrated probabilities.

Every hashed word has a fixed random sign vector; its word vector is the sum of the sign vectors around it in the whole
corpus. A document is the mean and the spread of its words' vectors. The network is fitted on a bounded sample of
labelled rows, and a temperature set on rows kept out of the fit makes its probabilities honest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm._words import _ODD, _BYTE, _powers, groups, mix64, numbers
from marlstone.llm.langid import remainder
from marlstone.runtime import store, spread, table, text_batches

#: Word vectors, by default; a power of two. Words are hashed to them, so the model's size does not grow with the corpus.
BUCKETS = 1 << 15
DIMENSIONS = 32
WINDOW = 2
#: Labelled rows that the fit reads, by expectation; they are chosen by a hash of the id, and read whole.
SAMPLE_ROWS = 20_000
HIDDEN = 32
EPOCHS = 40
THRESHOLD = 0.3
#: Buckets of words whose sums travel together, and partial sums made before the last.
CHUNK, FANS = 512, 32
#: Words whose vectors are added up at once.
PIECE = 1 << 10

_CLASS = np.full(256, 3, np.uint8)
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1


def tokens(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the tokens of some documents, and where each document's begin. A token is a run of letters (all that is
    not ASCII counts), of digits, or of other signs; case is kept."""
    kind = _CLASS[data]
    change = np.ones(len(data), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    real = kind[starts] != 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[real], ends[real]
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    h = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD)
    return (h & np.uint64(buckets - 1)).astype(np.int64), np.searchsorted(starts, offsets)


def signs(buckets: int = BUCKETS, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The random index vectors of all buckets, of ones and minus ones."""
    return (((numbers(71, buckets)[:, None] >> np.arange(1, dimensions + 1).astype(np.uint64)) & np.uint64(1)).astype(np.int8) * 2 - 1).astype(np.int8)


def around(at: np.ndarray, begin: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The sum of the index vectors up to WINDOW tokens from each token, within its document."""
    doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    out = np.zeros((len(at), index.shape[1]), np.int32)
    for step in range(1, min(WINDOW, len(at) - 1) + 1):
        same = (doc[step:] == doc[:-step])[:, None]
        out[step:] += index[at[:-step]] * same
        out[:-step] += index[at[step:]] * same
    return out


def contexts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The sum of index vectors around every bucket's tokens, over all texts: buckets x DIMENSIONS. Each task adds up its
    own and sends the buckets that it met; the sums are added in two steps, so the last adds a bounded number a chunk."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        index, total, met = signs(buckets), None, np.zeros(buckets, bool)
        for batch in batches:
            for _, _, data, offsets in groups(batch.column(0), 1 << 19):
                at, begin = tokens(data, offsets, buckets)
                if not len(at):
                    continue
                total = np.zeros((buckets, DIMENSIONS), np.int64) if total is None else total
                sums = around(at, begin, index)
                order = np.argsort(at, kind="stable")
                found, first = np.unique(at[order], return_index=True)
                total[found] += np.add.reduceat(sums[order], first, axis=0)
                met[found] = True
        if total is not None:
            at = np.flatnonzero(met)
            yield _sums(at, total[at], TaskContext.get().partitionId() % FANS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        met: dict[int, np.ndarray] = {}
        fan = 0
        for batch in batches:
            for chunk, fan, at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                at = np.frombuffer(at.as_py(), "<u2")
                if chunk not in total:
                    total[chunk], met[chunk] = np.zeros((CHUNK, DIMENSIONS), np.int64), np.zeros(CHUNK, bool)
                total[chunk][at] += np.frombuffer(pa.decompress(data.as_py(), 8 * DIMENSIONS * len(at), codec="zstd", asbytes=True), np.int64).reshape(-1, DIMENSIONS)
                met[chunk][at] = True
        for chunk, sums in total.items():
            at = np.flatnonzero(met[chunk])
            yield _sums(at + chunk * CHUNK, sums[at], fan)

    def _sums(at: np.ndarray, total: np.ndarray, fan: int) -> pa.RecordBatch:
        chunks, first = np.unique(at // CHUNK, return_index=True)
        cut = lambda x: np.split(x, first[1:])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(chunks, pa.int32()), pa.array([fan] * len(chunks), pa.int32()), pa.array([x.tobytes() for x in cut((at % CHUNK).astype("<u2"))], pa.binary()),
                pa.array([pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in cut(total)], pa.binary()),
            ],
            names=["chunk", "fan", "at", "data"],
        )

    schema = "chunk int, fan int, at binary, data binary"
    parts = docs.select("text").mapInArrow(count, schema)
    some = parts.repartition("chunk", "fan").mapInArrow(add, schema).withColumn("fan", F.lit(0))
    out = np.zeros((buckets, DIMENSIONS), np.int64)
    for row in some.repartition("chunk").mapInArrow(add, schema).collect():
        at = np.frombuffer(row.at, "<u2").astype(np.int64) + row.chunk * CHUNK
        out[at] = np.frombuffer(pa.decompress(row.data, 8 * DIMENSIONS * len(at), codec="zstd", asbytes=True), np.int64).reshape(-1, DIMENSIONS)
    return out


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Unit vectors of the buckets; what all have in common is taken off first."""
    size = np.linalg.norm(sums, axis=1, keepdims=True)
    unit = sums / np.maximum(size, 1)
    used = size[:, 0] > 0
    if used.any():
        unit[used] -= unit[used].mean(axis=0)
    return (unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9) * used[:, None]).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """A row a text: mean of its words' vectors, mean of their squares, how alike neighbours are, and its length. Sums are
    in double precision, of PIECE words at a time, so that they stay in the cache."""
    vectors = vectors.astype(np.float64)
    out = []
    for row, to, data, offsets in groups(texts, 1 << 19):
        at, begin = tokens(data, offsets, len(vectors))
        sums = np.zeros((to - row, 2 * DIMENSIONS + 1))
        for i, (lo, hi) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist())):
            for a in range(lo, hi, PIECE):
                # one word more at the front, for its neighbour
                front = int(a > lo)
                v = vectors[at[a - front : min(hi, a + PIECE)]]
                sums[i, -1] += np.dot(v[1:].ravel(), v[:-1].ravel())
                v = v[front:]
                sums[i, :DIMENSIONS] += v.sum(axis=0)
                sums[i, DIMENSIONS:-1] += np.einsum("ij,ij->j", v, v)
        n = np.diff(begin)[:, None]
        out.append(np.concatenate([sums[:, :-1] / np.maximum(n, 1), sums[:, -1:] / np.maximum(n - 1, 1), np.log1p(n) / 5], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2 * DIMENSIONS + 2))


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS) -> Network:
    """Adam on log loss; every fifth row is left for the temperature. Without rows of both labels the result says how
    often label 1 is, or one half."""
    rng = np.random.default_rng(0)
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    w1, w2 = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden)
    p = (y.sum() + 1) / (len(y) + 2)
    net = Network(mean, scale, w1, np.zeros(hidden), w2, float(np.log(p / (1 - p))), 1.0)
    if not len(y) or y.min() == y.max():
        return net
    held = np.arange(len(y)) % 5 == 4
    z, t = ((x - mean) / scale)[~held], y[~held].astype(float)
    params = [w1, net.b1, w2 + rng.normal(0, 0.1, hidden), np.array([net.b2])]
    m, v = [np.zeros_like(q) for q in params], [np.zeros_like(q) for q in params]
    step = 0
    for epoch in range(epochs):
        for rows in np.array_split(rng.permutation(len(t)), max(1, len(t) // 256)):
            step += 1
            h = np.tanh(z[rows] @ params[0] + params[1])
            d = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40))) - t[rows]) / len(rows)
            dh = np.outer(d, params[2]) * (1 - h * h)
            grads = [z[rows].T @ dh + 1e-4 * params[0], dh.sum(axis=0), h.T @ d + 1e-4 * params[2], np.array([d.sum()])]
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] = params[k] - 0.005 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, params[0], params[1], params[2], float(params[3][0]), 1.0)
    if held.any():
        logits, truth = net.logits(x[held]), y[held]
        loss = lambda t: np.logaddexp(0, -np.where(truth == 1, 1, -1) * logits / t).mean()
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def train(docs: DataFrame, labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, buckets: int = BUCKETS) -> tuple[np.ndarray, Network]:
    """Word vectors over all of `docs` (doc_id, text), and a network fitted on `labelled` (doc_id, quality), of which
    about `sample_rows` are read. Labels that are null, or whose document is missing, are passed over."""
    text_batches(docs.sparkSession)
    vectors = word_vectors(contexts(docs, buckets))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    rows = labelled.where("quality is not null and doc_id is not null").select(F.col("doc_id").alias("l_id"), F.col("quality").cast("int").alias("quality"))
    draw = F.xxhash64(F.lit("quality"), "l_id") / F.lit(2.0**64) + F.lit(0.5)
    chosen = store(rows.where(draw < min(1.0, sample_rows / max(1, rows.count()))), "quality-sample").df

    def pool(batches):
        for batch in batches:
            x = pooled(batch.column(2), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    # the sample's size is bounded by its parameter, so its ids may go to every task
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).select("doc_id", "quality", "text")
    got = both.mapInArrow(pool, "doc_id long, quality int, x array<double>").toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    x = np.array(got.column("x").to_pylist(), float).reshape(got.num_rows, 2 * DIMENSIONS + 2)
    return vectors, fit(x, got.column("quality").to_numpy())


def score(docs: DataFrame, model: tuple[np.ndarray, Network]) -> DataFrame:
    """doc_id and score, the probability of quality 1, for every row of `docs` (doc_id, text). Null text counts as empty,
    and empty texts get the score of a document without words; repeated rows keep one row each; an empty table gives
    none. Only text decides."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        vectors, net = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.probability(pooled(batch.column(1), vectors)), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`, scored by a model of the labels that are not held out; empty and null texts have the score of no
    words, a null id counts as the empty text in the split, an empty table gives no rows."""
    docs = spread(table(spark, sf_dir, "documents"))
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
