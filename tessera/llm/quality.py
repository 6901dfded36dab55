"""Quality classifier by attention over passages.

A document is a bag of passages of `PASSAGE` words. Each is encoded as shares of
kinds of bytes, word lengths and repetition, and a seeded projection of its
words. A hidden layer, gated attention over the bag and a logistic output are
learned together from labels that only documents have, so the model finds by
itself which passages tell. Scoring encodes every passage of every document.

The model is fitted on at most `bound` labelled documents, taken evenly over the
two labels by the hash of doc_id.

Defined results. One row for each input row, repeated ones included; equal
texts get equal scores. Null texts and those without words have no passages,
score null and aren't kept. Without labels of both kinds every document scores
the share of good labels, or 0.5 without any. Labels that are null are left
out. Ties in attention go to the first passage. Other columns are passed over.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.cluster import small_batches, with_small_side
from tessera.llm.learn import one_each, sample_by_class
from tessera.llm.textcore import _WORD, SHAPES, Words, chunks, shapes, string_buffer

PASSAGE = 48
#: Labelled documents that the model is fitted on, at most.
BOUND = 2000
#: Least score of a document that is kept.
CUT = 0.5
PROJECTED, HIDDEN, GATE = 16, 16, 8
WIDTH = SHAPES + 4 + PROJECTED
ROUNDS = 300

_signs = np.random.Generator(np.random.PCG64(7)).choice([-1.0, 1.0], (4096, PROJECTED)).astype(np.float32)


def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all passages, and the number of passages of each text."""
    raw, off = string_buffer(texts)
    n = len(raw)
    inside = np.zeros(n + 1, bool)
    inside[1:] = _WORD[raw]
    first = inside[1:] & ~inside[:-1]
    cuts = off[:-1][off[:-1] < n]
    first[cuts] = inside[1:][cuts]
    start = np.flatnonzero(first)
    doc = np.searchsorted(start, off)
    count = np.diff(doc)
    bags = -(-count // PASSAGE)
    total = int(bags.sum())
    if not total:
        return np.zeros((0, WIDTH), np.float32), bags
    base = np.concatenate([[0], np.cumsum(bags)])
    owner = np.repeat(np.arange(len(count)), count)
    of_word = base[owner] + (np.arange(len(start)) - doc[owner]) // PASSAGE
    words = np.bincount(of_word, minlength=total).astype(np.float32)
    # bytes from a passage's first word to the next passage or the text's end
    opens = np.flatnonzero(np.diff(of_word, prepend=-1))
    begin, text = start[opens], owner[opens]
    end = np.minimum(np.append(begin[1:], n), off[text + 1])
    size = end - begin
    which = np.repeat(np.arange(total), size)
    at = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(len(which))
    form = shapes(raw[at], which, total).astype(np.float32) / size[:, None]
    low = Words(texts)
    out = np.zeros((total, WIDTH), np.float32)
    out[:, :SHAPES] = 2 * np.sqrt(form)
    out[:, SHAPES] = size / words / 10
    out[:, SHAPES + 1] = words / PASSAGE
    if len(low) == len(start):
        code = (low.hash >> np.uint64(52)).astype(np.int64)
        kinds = np.unique(of_word * 4096 + code)
        out[:, SHAPES + 2] = np.bincount(kinds // 4096, minlength=total) / words
        most = np.bincount(of_word[1:][(low.hash[1:] == low.hash[:-1]) & (of_word[1:] == of_word[:-1])], minlength=total)
        out[:, SHAPES + 3] = most / words
        for k in range(PROJECTED):
            out[:, SHAPES + 4 + k] = np.bincount(of_word, _signs[code, k], total) / np.sqrt(words) / 4
    return out, bags


class Model:
    """Hidden layer, gated attention and output; constant if it can't be learned."""

    NAMES = ("w", "b", "v", "u", "a", "c", "d")

    def __init__(self, seed: int = 11):
        r = np.random.Generator(np.random.PCG64(seed))
        draw = lambda m, n: (r.standard_normal((m, n)) / np.sqrt(m)).astype(np.float64)
        self.w, self.b, self.v, self.u = draw(WIDTH, HIDDEN), np.zeros(HIDDEN), draw(HIDDEN, GATE), draw(HIDDEN, GATE)
        self.a, self.c, self.d = draw(GATE, 1)[:, 0], draw(HIDDEN, 1)[:, 0], np.zeros(1)
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)
        self.constant: float | None = None

    def forward(self, x: np.ndarray, bags: np.ndarray) -> dict:
        """All values on the way to the scores of bags with at least one passage."""
        start = np.concatenate([[0], np.cumsum(bags)[:-1]])
        bag = np.repeat(np.arange(len(bags)), bags)
        h = np.tanh(x @ self.w + self.b)
        t, s = np.tanh(h @ self.v), 1 / (1 + np.exp(-np.clip(h @ self.u, -30, 30)))
        e = (t * s) @ self.a
        e = np.exp(e - np.maximum.reduceat(e, start)[bag])
        a = e / np.add.reduceat(e, start)[bag]
        z = np.add.reduceat(a[:, None] * h, start, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ self.c + self.d, -30, 30)))
        return {"bag": bag, "start": start, "h": h, "t": t, "s": s, "a": a, "z": z, "y": y}

    def gradients(self, x: np.ndarray, bags: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        f = self.forward(x, bags)
        miss = weight * (f["y"] - label)
        dz = miss[:, None] * self.c
        dh = f["a"][:, None] * dz[f["bag"]]
        da = (f["h"] * dz[f["bag"]]).sum(1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, f["start"])[f["bag"]])
        gate = f["t"] * f["s"]
        dt, ds = de[:, None] * self.a * f["s"] * (1 - f["t"] ** 2), de[:, None] * self.a * gate * (1 - f["s"])
        dh += dt @ self.v.T + ds @ self.u.T
        dp = dh * (1 - f["h"] ** 2)
        return {"w": x.T @ dp, "b": dp.sum(0), "v": f["h"].T @ dt, "u": f["h"].T @ ds, "a": gate.T @ de, "c": f["z"].T @ miss, "d": miss.sum(keepdims=True)}

    def learn(self, x: np.ndarray, bags: np.ndarray, label: np.ndarray, rounds: int = ROUNDS, rate: float = 0.02, decay: float = 1e-4) -> None:
        """Adam on all bags; the two labels weigh the same."""
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.scale
        weight = np.where(label > 0, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum()))
        m = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        v = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        for i in range(1, rounds + 1):
            for k, g in self.gradients(x, bags, label, weight).items():
                g = g + decay * getattr(self, k)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                setattr(self, k, getattr(self, k) - rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.999**i)) + 1e-8))

    def scores(self, x: np.ndarray, bags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of each bag (nan if empty) and its passage with most attention (-1 if empty)."""
        score, top = np.full(len(bags), np.nan), np.full(len(bags), -1)
        some = np.flatnonzero(bags)
        if len(some):
            f = self.forward((x - self.mean) / self.scale, bags[some])
            score[some] = f["y"] if self.constant is None else self.constant
            order = np.lexsort((-f["a"], f["bag"]))
            top[some] = order[f["start"]] - f["start"]
        return score, top


def fit(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> Model:
    """The model from documents that labels name."""
    small_batches(docs.sparkSession)
    named = labels.select(F.col("doc_id").cast("long").alias("named_id"), F.col("quality").cast("int").alias("quality")).where("named_id IS NOT NULL AND quality IN (0, 1)").distinct()
    chosen = sample_by_class(named, "quality", bound, "named_id")
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(with_small_side(chosen, 10 * bound), F.col("doc_id") == F.col("named_id")).select("named_id", "quality", "text")
    rows = one_each(rows, "named_id", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            x, bags = encode(b.column("text"))
            end = np.cumsum(bags)
            yield pa.RecordBatch.from_arrays([b.column("named_id"), b.column("quality"), pa.array([x[e - n : e].tobytes() for e, n in zip(end, bags, strict=True)], pa.binary())], ["named_id", "quality", "x"])

    got = rows.mapInArrow(run, "named_id long, quality int, x binary").where("octet_length(x) > 0").toArrow().sort_by([("named_id", "ascending"), ("quality", "ascending")])
    model = Model()
    label = got.column("quality").to_numpy().astype(np.float64)
    if not len(label) or label.min() == label.max():
        model.constant = float(label.mean()) if len(label) else 0.5
        return model
    blobs = got.column("x").to_pylist()
    x = np.frombuffer(b"".join(blobs), np.float32).reshape(-1, WIDTH).astype(np.float64)
    model.learn(x, np.array([len(t) // (4 * WIDTH) for t in blobs]), label)
    return model


def quality_scores(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """(doc_id, score, keep, n_passages, top_passage) for every row of docs."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            x, bags = encode(b.column("text"))
            score, top = shared.value.scores(x, bags)
            none = bags == 0
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score, mask=none), pa.array(np.nan_to_num(score) >= cut), pa.array(bags), pa.array(top, mask=none)], ["doc_id", "score", "keep", "n_passages", "top_passage"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("keep", T.BooleanType()), T.StructField("n_passages", T.LongType()), T.StructField("top_passage", T.LongType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_scores(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
