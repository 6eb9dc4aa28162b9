"""Operator 2: a quality classifier that learns from document labels which passages matter.

A document is a bag of passages (windows of its UTF-8 bytes; the whole text is covered). A passage is described by how often
each kind of character follows another and by how its words repeat; a small network encodes it, a gate gives it a weight among
the document's passages, and the weighted mean of the encodings is scored (gated attention-based multiple-instance learning).
The model is fitted on the driver on a bounded sample of labelled documents (SAMPLE rows, chosen by a hash of doc_id; all passages of
each, 600 bytes for every KiB of its text); scoring is a map over all passages of all rows, without a shuffle.

Labels, language, source and id are never inputs. An empty or null text is one passage without characters and gets a score too; a very
long one has as many passages as it needs. Null labels are left out; where a document has several labels, their mean rounded decides;
where several rows have a document's id, one of them, by a hash of its text, is fitted on. Repeated rows get the same score each.
Without any label every score is 1. Other columns pass through scored(), whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, prepared, raw, unused, words

SAMPLE, WINDOW = 3000, 1024
KINDS = 12
FEATURES = KINDS * KINDS + 5
HIDDEN, GATE = 24, 12
THRESHOLD = 0.3


def _kinds() -> np.ndarray:
    out = np.full(256, 9, np.int64)  # other printable
    out[:32] = 10
    out[128:] = 11
    for k, letters in enumerate((range(97, 123), range(65, 91), range(48, 58), b" ", b"\n", b".", b",", b"!?", b"|/\\")):
        out[list(letters)] = k
    return out


_KIND = _kinds()


def passages(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The features of all passages, and where each document's passages begin."""
    base = int(offsets[0])
    length = np.diff(offsets)
    count = np.maximum(1, -(-length // window))
    first = np.cumsum(count) - count
    n = int(count.sum())
    size = np.full(n, window, np.int64)
    size[first + count - 1] = length - (count - 1) * window
    of = np.repeat(np.arange(n), size)
    kind = _KIND[data[base : int(offsets[-1])]]
    after = np.append(kind[1:], 4) if len(kind) else kind
    after[(offsets[1:] - base)[length > 0] - 1] = 4  # a text ends as a line does, whatever stands beside it
    out = np.zeros((n, FEATURES), np.float32)
    out[:, : KINDS * KINDS] = np.bincount((of * KINDS + kind) * KINDS + after, minlength=n * KINDS * KINDS).reshape(n, -1)
    out[:, : KINDS * KINDS] = np.sqrt(out[:, : KINDS * KINDS] / np.maximum(1, size)[:, None])
    starts, ends, code, _ = words(data, offsets)
    if len(starts):
        home = of[starts]
        n_words = np.maximum(1, np.bincount(home, minlength=n))
        same = np.zeros(len(code))
        same[1:] = code[1:] == code[:-1]
        near = np.zeros(len(code))
        near[2:] = code[2:] == code[:-2]
        out[:, -5] = np.bincount(home, same, n) / n_words
        out[:, -4] = np.bincount(home, near, n) / n_words
        out[:, -3] = np.bincount(home, ends - starts, n) / n_words / 16
        out[:, -2] = np.bincount(home, np.minimum(32, ends - starts) ** 2, n) / n_words / 256
    out[:, -1] = np.log1p(size) / 7
    return out, first


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, first, axis=0)


class Model:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        draw = lambda a, b: (r.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.p = {"W": draw(FEATURES, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "g": draw(GATE, 1), "c": draw(HIDDEN, 1), "d": np.zeros(1, np.float32)}
        self.mean, self.scale = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, tuple]:
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["g"]
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        a = np.exp(e - np.maximum.reduceat(e, first, axis=0)[of])
        a /= _sums(a, first)[of]
        z = _sums(a * h, first)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return y[:, 0], (x, first, h, t, s, of, a, z)

    def gradients(self, y: np.ndarray, want: np.ndarray, kept: tuple) -> dict[str, np.ndarray]:
        p, (x, first, h, t, s, of, a, z) = self.p, kept
        dy = ((y - want) / len(want)).astype(np.float32)[:, None]
        dz = (dy @ p["c"].T)[of]
        da = (dz * h).sum(1, keepdims=True)
        de = a * (da - _sums(a * da, first)[of])
        dts = de @ p["g"].T
        dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
        dh = (a * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "g": (t * s).T @ de, "c": z.T @ dy, "d": dy.sum(0)}

    def fit(self, bags: list[np.ndarray], want: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 0.004, decay: float = 1e-4, seed: int = 7) -> Model:
        r = np.random.default_rng(seed)
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 0.02
        bags = [(b - self.mean) / self.scale for b in bags]
        m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            pace = rate * (1 - epoch / epochs) + 1e-5
            order = r.permutation(len(bags))
            for k in range(0, len(order), batch):
                some = order[k : k + batch]
                x = np.concatenate([bags[i] for i in some])
                sizes = np.array([len(bags[i]) for i in some])
                y, kept = self.forward(x, np.cumsum(sizes) - sizes)
                step += 1
                for name, g in self.gradients(y, want[some], kept).items():
                    g = g + decay * self.p[name]
                    a, b = m[name]
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    self.p[name] -= (pace * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x, first = passages(data, offsets)
        return self.forward((x - self.mean) / self.scale, first)[0].astype(np.float64)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        x, first = passages(*raw(batch["text"]))
        bags = [x[a:b].astype("<f4").tobytes() for a, b in zip(first, np.append(first[1:], len(x)))]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["quality"], pa.array(bags, pa.binary())], ["doc_id", "quality", "bag"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model by at most sample of the labelled rows whose crc32(doc_id) mod 5 isn't 0; None if there are none."""
    spark = prepared(docs.sparkSession)
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.round(F.avg("quality")).cast("int").alias("quality"))
    known = known.filter(~held_out(F.col("doc_id"))).join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = chosen.collect()  # at most sample pairs of numbers
    if not rows:
        return None
    few = F.broadcast(spark.createDataFrame(rows, chosen.schema))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(few, "doc_id")
    one = texts.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"))  # of rows with one id, one
    bags = one.select("doc_id", F.col("x.text").alias("text"), "quality").mapInArrow(_bags, "doc_id long, quality int, bag binary")
    got = sorted((r.doc_id, bytes(r.bag), r.quality) for r in bags.collect())
    return Model().fit([np.frombuffer(b, "<f4").reshape(-1, FEATURES) for _, b, _ in got], np.array([q for *_, q in got], np.float32))


def held_out(doc_id):
    """Rows whose labels the model never sees. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def scored(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """docs with one more column, the score."""
    prepared(docs.sparkSession)
    if model is None:
        return docs.withColumn(name, F.lit(1.0))
    text = unused([*docs.columns, name], "__text")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            y = model.score(*raw(batch[text]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(y)], [*batch.schema.names[:-1], name])

    return docs.withColumn(text, F.coalesce("text", F.lit(""))).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = train(docs, labels)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scored(slim, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
