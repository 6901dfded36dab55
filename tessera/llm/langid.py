"""Language identification with error-correcting output codes.

Every language has a codeword. One binary classifier per bit, a logistic
regression on hashed letter bigrams and trigrams of the whole text, says how
surely the bit is set. Decoding weighs each bit's logistic loss by how reliable
its classifier is on rows held out of the fit, and picks the codeword with the least loss; a
small lead over the next one, or a text without letters, flags the answer as
ambiguous.

The classifiers are fitted on at most `bound` labelled rows, taken evenly over
the languages by the hash of doc_id. With up to five languages codewords are
exhaustive; with more they are seeded random words far apart.

Defined results. One row for each row of the input, repeated ones included. A
text that is null, empty or without letters has language null, margin 0 and is
ambiguous. Without any labelled row the same holds for all texts; with one
language only every text with letters is of that language. Whole texts are
read, however long. Ties between codewords go to the first language in
alphabetical order and are ambiguous. Other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.llm.cluster import small_batches
from tessera.llm.learn import fit_logistic, sample_by_class
from tessera.llm.textcore import chunks, string_buffer

#: Labelled rows that the classifiers are fitted on, at most.
BOUND = 2000
#: Lead of the nearest codeword below which an answer is ambiguous, as a share of the total weight of the bits.
MARGIN = 0.1
BITS = 12
WIDTH = 1 << BITS

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the square roots of gram counts, and the letters of each text."""
    raw, off = string_buffer(pc.utf8_lower(pc.fill_null(texts, "") if texts.null_count else texts))
    n = len(texts)
    raw = _LETTER[raw].astype(np.uint32)
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(off))
    letters = np.bincount(owner[raw != 32], minlength=n)
    two = raw[:-1] | (raw[1:] << np.uint32(8))
    same = (owner[:-1] == owner[1:]) & (two != 0x2020)
    at = owner[:-1][same] * np.int32(WIDTH) + ((two[same] * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32)
    count = np.bincount(at, minlength=n * WIDTH)
    if len(raw) > 2:
        three = two[:-1] | (raw[2:] << np.uint32(16))
        same = (owner[:-2] == owner[2:]) & (raw[1:-1] != 32)
        at = owner[:-2][same] * np.int32(WIDTH) + (((three[same] ^ np.uint32(0x5BD1E995)) * np.uint32(2246822519)) >> np.uint32(32 - BITS)).astype(np.int32)
        count += np.bincount(at, minlength=n * WIDTH)
    x = np.sqrt(count, dtype=np.float32).reshape(n, WIDTH)
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)
    return x, letters


def packed(x: np.ndarray) -> bytes:
    """Which cells of a row aren't zero, as bits, and these."""
    some = x != 0
    return np.packbits(some).tobytes() + x[some].tobytes()


def unpack(data: pa.Buffer, to: np.ndarray) -> None:
    """The reverse of packed(), into a row of zeros."""
    some = np.unpackbits(np.frombuffer(data, np.uint8, WIDTH // 8)).view(bool)
    to[some] = np.frombuffer(data, np.float32, offset=WIDTH // 8)


def codewords(k: int) -> np.ndarray:
    """A row of -1/+1 for each of k languages."""
    if k <= 1:
        return np.zeros((k, 0), np.float32)
    if k <= 5:
        bits = 2 ** (k - 1) - 1
        words = [[1] * bits] + [[1 if c >> i & 1 else -1 for c in range(bits)] for i in range(k - 1)]
        return np.array(words, np.float32)
    rng = np.random.Generator(np.random.PCG64(k))
    best, apart = None, -1
    for _ in range(50):
        words = rng.choice([-1.0, 1.0], (k, int(np.ceil(10 * np.log2(k))))).astype(np.float32)
        words = words[:, np.abs(words.sum(0)) < k]
        least = ((words.shape[1] - words @ words.T) / 2 + np.eye(k) * 1e9).min()
        if least > apart:
            best, apart = words, least
    return best


class Model:
    def __init__(self, languages: list[str], w: np.ndarray, b: np.ndarray, alpha: np.ndarray, margin: float):
        self.languages, self.w, self.b, self.alpha, self.margin = languages, w, b, alpha, margin
        self.codes = codewords(len(languages))

    def decode(self, x: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language (-1: none) and its lead over the next."""
        n, k = len(x), len(self.languages)
        if k == 0:
            return np.full(n, -1), np.zeros(n)
        if k == 1:
            return np.where(letters > 0, 0, -1), np.where(letters > 0, 1.0, 0.0)
        f = (x @ self.w + self.b).astype(np.float64)
        loss = np.stack([(self.alpha * np.logaddexp(0, -c * f)).sum(1) for c in self.codes], 1) / self.alpha.sum()
        order = np.argsort(loss, 1, kind="stable")
        rows = np.arange(n)
        lead = loss[rows, order[:, 1]] - loss[rows, order[:, 0]]
        return np.where(letters > 0, order[:, 0], -1), np.where(letters > 0, lead, 0.0)


def fit(docs: DataFrame, bound: int = BOUND, margin: float = MARGIN) -> Model:
    """The model from rows of docs that have text, lang and doc_id."""
    small_batches(docs.sparkSession)
    rows = sample_by_class(docs.select("doc_id", "lang", "text").where("text IS NOT NULL"), "lang", bound, "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            x, letters = grams(b.column("text"))
            ids, langs = b.column("doc_id"), b.column("lang")
            yield pa.RecordBatch.from_arrays([ids, langs, pa.array([packed(r) for r in x], pa.binary()), pa.array(letters)], ["doc_id", "lang", "x", "letters"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(features, f"doc_id {kind}, lang string, x binary, letters long").where("letters > 0").toArrow().sort_by([("doc_id", "ascending")]).slice(0, 2 * bound)
    langs = got.column("lang").to_pylist()
    names = sorted(set(langs))
    if len(names) < 2:
        return Model(names, np.zeros((WIDTH, 0), np.float32), np.zeros(0, np.float32), np.zeros(0), margin)
    x = np.zeros((len(langs), WIDTH), np.float32)
    for to, value in zip(x, got.column("x"), strict=True):
        unpack(value.as_buffer(), to)
    del got
    which = np.array([names.index(v) for v in langs])
    y = (codewords(len(names))[which] > 0).astype(np.float32)
    each = 1.0 / np.bincount(which)[which]
    w, b = fit_logistic(x, y, each)
    return Model(names, w, b, reliability(x, y, each), margin)


def reliability(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Half the log-odds, at least a little, that each bit's classifier is right about rows that it wasn't fitted on, every fifth one."""
    held = np.arange(len(x)) % 5 == 0
    if held.all():
        return np.ones(y.shape[1])
    w, b = fit_logistic(x, y, np.where(held, 0.0, weight))  # no copy of the others
    right = ((x @ w.astype(x.dtype) + b > 0) == (y > 0))[held].sum(0)
    share = (right + 0.5) / (held.sum() + 1)
    return np.maximum(1e-3, np.log(share / (1 - share)) / 2)


def _judge(shared, keep: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        names = pa.array([*model.languages, None], pa.string())
        for b in chunks(batches):
            which, lead = model.decode(*grams(b.column("text")))
            doubt = (which < 0) | (lead < model.margin)
            if keep:
                yield b.filter(pa.array(~doubt))
            else:
                lang = names.take(pa.array(np.where(which < 0, len(model.languages), which)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), lang, pa.array(lead), pa.array(doubt)], ["doc_id", "language", "margin", "ambiguous"])

    return run


def identify(docs: DataFrame, model: Model | None = None, bound: int = BOUND, margin: float = MARGIN) -> DataFrame:
    """(doc_id, language, margin, ambiguous) for every row of docs."""
    small_batches(docs.sparkSession)
    model = model or fit(docs, bound, margin)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("language", T.StringType()), T.StructField("margin", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    return docs.select("doc_id", "text").mapInArrow(_judge(shared, False), schema)


def keep_identified(docs: DataFrame, model: Model | None = None, bound: int = BOUND, margin: float = MARGIN) -> DataFrame:
    """The rows of docs, with all their columns, whose language is clear."""
    small_batches(docs.sparkSession)
    model = model or fit(docs, bound, margin)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_judge(shared, True), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
