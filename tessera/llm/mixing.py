"""Mixing a corpus to target weights with soft memberships.

A softmax classifier, fitted on documents that the labels table names, on the
words that tell their domains apart, gives every document a posterior over
domains, p. Rates r >= 0, one for each
document, then make the expected domain tokens sum(r_i * n_i * p_id) meet their
targets in weighted least squares, found by projected gradient descent with
momentum, from equal rates, in the metric where a token counts the same in a
long document as in a short one. Where ROUNDS of these haven't met the targets,
as in skewed corpora, Newton's method finds the rates nearest to equal ones that
meet them (`_finish`); it ends when every target is met within TOLERANCE, or
when a lower bound on what any rates leave shows that they can't be met and no
rates come closer than SLACK, and then gives the shortfall as a warning; if
neither can be shown, it fails. Posteriors and lengths are written once as a
narrow table; an iteration reads it, and only one number for each domain comes
back to the driver. A document's rate follows from its own row and the
gradients so far, so rates are never shuffled or stored between iterations.

Domains are what `labels` can tell: "toxic" where toxic = 1, else "good" where
quality = 1, else "poor". At most `bound` labelled documents are used to fit,
taken evenly over the domains by the hash of doc_id, and of these at most FEATURES
words that tell the domains apart.

Defined results. One row for each input row, repeated ones included; equal
texts get equal rates. Null and empty texts have no tokens, the classifier's
prior as posterior, and change no total. Labels with nulls, without a document
or given twice in contradiction are left out or used as they are. Without any
usable label the posterior is uniform. A domain that no text can supply stays
short of its target, with a warning. An empty table gives no rows. Other columns are kept or
ignored as the function says.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import beside, blocks
from tessera.llm.cluster import ease, free_name, lean, small_batches, with_small_side, written
from tessera.llm.learn import fit_softmax, one_each, sample_by_class, softmax
from tessera.llm.textcore import SHAPES, Lookup, Words, chunks, shapes, string_buffer

DOMAINS = ("good", "poor", "toxic")
#: Shares of the tokens that the mix is to have.
TARGETS = {"good": 0.93, "poor": 0.06, "toxic": 0.01}
#: Tokens of the mix for each token of the corpus.
SCALE = 1.1
#: Labelled documents that the classifier is fitted on, at most.
BOUND = 3000
#: Rounds of gradient descent, after which Newton's method goes on.
ROUNDS = 60
#: Distance from a target within which it is met, as a share of all tokens of the mix.
TOLERANCE = 1e-4
#: If the targets can't be met: how much of the weighted squares that are left may be due to stopping.
SLACK = 0.01

#: Words that the classifier may look for, at most, and the least z-score of their difference in document frequency.
FEATURES, Z = 3000, 4.0


def pieces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words with the text of each, the words of each text, and shares of kinds of bytes."""
    words = Words(texts)
    n = len(texts)
    raw, off = string_buffer(texts)
    form = shapes(raw, np.repeat(np.arange(n), np.diff(off)), n)
    return words.hash, words.owner(), words.counts(), 4 * np.sqrt(form / np.maximum(1, form.sum(1, keepdims=True)))


class Classifier:
    """Softmax regression on which of some words a text has, each scaled by how much it tells, and on its kinds of bytes."""

    def __init__(self, words: np.ndarray, scale: np.ndarray, w: np.ndarray, b: np.ndarray):
        self.words, self.scale, self.w, self.b = words, scale, w, b
        self.table = Lookup(words)

    def posteriors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        hashes, owner, count, form = pieces(texts)
        at, which = self.table.find(hashes)
        has = np.unique(owner[at] * np.int64(len(self.words) + 1) + which)
        row, which = has // (len(self.words) + 1), has % (len(self.words) + 1)
        z = form @ self.w[len(self.words) :]
        for k in range(len(self.b)):
            z[:, k] += np.bincount(row, self.scale[which] * self.w[which, k], len(texts))
        z[count == 0] = 0
        return softmax(z + self.b), count


def telling(rows: np.ndarray, hashes: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Words whose document frequency differs most between a class and the rest, and by how much its logarithm does; (rows, hashes) are the distinct words of documents."""
    words, back = np.unique(hashes, return_inverse=True)
    have = np.bincount(back * k + y[rows], minlength=len(words) * k).reshape(-1, k).astype(np.float64)
    n = np.bincount(y, minlength=k).astype(np.float64)
    best, gap = np.zeros(len(words)), np.zeros(len(words))
    for c in range(k):
        rest = n.sum() - n[c]
        if not n[c] or not rest:
            continue
        p, q = (have[:, c] + 0.5) / (n[c] + 1), (have.sum(1) - have[:, c] + 0.5) / (rest + 1)
        z = np.abs(p - q) / np.sqrt(p * (1 - p) / n[c] + q * (1 - q) / rest)
        log = np.abs(np.log(p / (1 - p)) - np.log(q / (1 - q)))
        gap = np.where(z > best, log, gap)
        best = np.maximum(best, z)
    some = np.sort(np.argsort(-best, kind="stable")[:FEATURES])
    some = some[best[some] >= Z]
    return words[some], gap[some]


def fit(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> Classifier:
    """The classifier from documents that labels name."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).when(F.col("quality") == 0, 1)
    named = labels.select(F.col("doc_id").cast("long").alias("named_id"), domain.alias("domain")).where("named_id IS NOT NULL AND domain IS NOT NULL").distinct()
    chosen = sample_by_class(named, "domain", bound, "named_id")
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(with_small_side(chosen, 10 * bound), F.col("doc_id") == F.col("named_id")).select("named_id", "domain", "text")
    rows = one_each(rows, "named_id", "domain")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            hashes, owner, _, form = pieces(b.column("text"))
            ends = np.searchsorted(owner, np.arange(b.num_rows + 1))
            kinds = [np.unique(hashes[i:j]).tobytes() for i, j in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([b.column("named_id"), b.column("domain"), pa.array(kinds, pa.binary()), pa.array([f.tobytes() for f in form], pa.binary())], ["named_id", "domain", "words", "form"])

    got = rows.mapInArrow(lean(run), "named_id long, domain int, words binary, form binary").toArrow().sort_by([("named_id", "ascending"), ("domain", "ascending")])
    n, k = got.num_rows, len(DOMAINS)
    if not n:
        return Classifier(np.zeros(0, np.uint64), np.zeros(0), np.zeros((SHAPES, k)), np.zeros(k))
    y = got.column("domain").to_numpy()
    parts = [np.frombuffer(x, np.uint64) for x in got.column("words").to_pylist()]
    hashes, owner = np.concatenate(parts), np.repeat(np.arange(n), [len(x) for x in parts])
    words, scale = telling(owner, hashes, y, k)
    at, which = Lookup(words).find(hashes)
    form = np.frombuffer(b"".join(got.column("form").to_pylist())).reshape(n, SHAPES)
    cell = np.arange(SHAPES)
    w, b = fit_softmax(
        np.concatenate([owner[at], np.repeat(np.arange(n), SHAPES)]), np.concatenate([which, np.tile(len(words) + cell, n)]), np.concatenate([scale[which], form.ravel()]),
        n, len(words) + SHAPES, y, k, rounds=300,
    )
    b = np.where(np.bincount(y, minlength=k) > 0, b, -30.0)  # a domain without labels can't be predicted
    return Classifier(words, scale, w, b)


def priors(labels: DataFrame) -> np.ndarray:
    """Shares of the domains among all labels, to undo the even sampling."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).when(F.col("quality") == 0, 1)
    found = {r[0]: r[1] for r in labels.select(domain.alias("d")).where("d IS NOT NULL").groupBy("d").count().collect()}
    n = np.array([found.get(k, 0) for k in range(len(DOMAINS))], np.float64)
    return n / n.sum() if n.sum() else np.full(len(n), 1 / len(n))


def rates_after(p: np.ndarray, start: float, step: float, gradients: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rates, and the point at which the next gradient is taken, of documents with posteriors p, after projected gradient steps with momentum."""
    r = y = np.full(len(p), start)
    was = 1.0
    for g in gradients:
        new = np.maximum(0.0, y - step * (p @ g))
        now = (1 + np.sqrt(1 + 4 * was * was)) / 2
        r, y, was = new, new + (was - 1) / now * (new - r), now
    return r, y


def _sums(narrow: DataFrame, of: Callable, size: int) -> np.ndarray:
    """Sum over all rows of the vectors that `of` gives for a batch (p, n). A vector for each task goes to the driver, without an exchange: there are many passes, and what the driver does for each adds up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            p = np.stack([b.column(f"p_{d}").to_numpy() for d in DOMAINS], 1)
            total += of(p, b.column("n_tokens").to_numpy().astype(np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    out = np.zeros(size)
    for (total,) in narrow.mapInArrow(lean(run), "total binary").collect():
        out += np.frombuffer(total)
    return out


class Plan:
    """What rates depend on besides the posteriors of a document: gradients, or the slope of Newton's method. missed: the targets less what is reached, where they can't be met; else None."""

    def __init__(self, start: float, step: float, gradients: list[np.ndarray], totals: np.ndarray, targets: np.ndarray, reached: np.ndarray, slope: np.ndarray | None = None, missed: np.ndarray | None = None):
        self.start, self.step, self.gradients, self.slope = start, step, gradients, slope
        self.totals, self.targets, self.reached, self.missed = totals, targets, reached, missed

    def rates(self, p: np.ndarray) -> np.ndarray:
        if self.slope is not None:
            return np.maximum(0.0, self.start + p @ self.slope)
        return rates_after(p, self.start, self.step, self.gradients)[0]


def least_left(gradient: np.ndarray, lowest: float, want: np.ndarray, weight: np.ndarray) -> float:
    """A bound below half the weighted squares that any rates leave, by duality; lowest: the least product of the gradient and a document's posterior."""
    u = gradient + max(0.0, -lowest)  # posteriors add up to 1, so now no document has a negative product
    short = -(u @ want)
    return short * short / (2 * (u * u / weight).sum()) if short > 0 else 0.0


def _finish(narrow: DataFrame, start: float, want: np.ndarray, weight: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """The slope v of rates max(0, start + p @ v), what they reach, and whether that meets the targets.

    Such rates are the best of the weighted squares with a pull to equal rates;
    v is found by Newton's method on the dual, a convex function of as many
    numbers as there are domains, for an ever weaker pull. One pass tries all
    lengths of a Newton step.
    """
    k = len(want)
    lengths = 0.5 ** np.arange(24)
    v, along = np.zeros(k), np.zeros(k)
    pull, reached = 1e-2, np.zeros(k)

    def tried(v: np.ndarray, along: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each length: half the squares of the rates, what they reach, and the matrix of the documents in use."""

        def of(p: np.ndarray, n: np.ndarray) -> np.ndarray:
            base, more, out = start + p @ v, p @ along, []
            for x in lengths:
                r = np.maximum(0.0, base + x * more)
                out += [[(n * r * r).sum() / 2], n * r @ p, ((p * (n * (r > 0))[:, None]).T @ p).ravel()]
            return np.concatenate(out)

        return _sums(narrow, of, len(lengths) * (1 + k + k * k)).reshape(len(lengths), -1)

    while pull >= 1e-14:
        ease(narrow.sparkSession)
        at = tried(v, along, lengths[:1])[0]
        while True:
            reached = at[1 : 1 + k]
            if np.abs(reached - want).max() <= tolerance * want.sum():
                return v, reached, True
            gradient = reached - want + pull * v / weight
            matrix = at[1 + k :].reshape(k, k) + np.diag(pull / weight)
            along = -np.linalg.solve(matrix, gradient)
            slope = gradient @ along
            value = at[0] - v @ want + pull * (v * v / weight).sum() / 2
            if np.abs(gradient).max() <= 1e-3 * np.abs(reached - want).max() or -slope <= 1e-13 * abs(value):
                break
            found = tried(v, along, lengths)
            to = v + lengths[:, None] * along
            values = found[:, 0] - to @ want + pull * (to * to / weight).sum(1) / 2
            best = int(np.argmin(values))
            if not values[best] < value:
                break  # no better in floating point
            v, at = to[best], found[best]
        along = np.zeros(k)
        left = weight * (reached - want)
        if least_left(left, _lowest(narrow, left), want, weight) >= (1 - SLACK) * (left * (reached - want)).sum() / 2:
            return v, reached, False
        pull /= 10
    raise RuntimeError(f"mixing: no fit; reached {reached.tolist()} of {want.tolist()} tokens")


def _lowest(narrow: DataFrame, u: np.ndarray) -> float:
    """The least product of u and the posterior of a document with tokens."""
    product = sum((F.col(f"p_{d}") * float(x) for d, x in zip(DOMAINS, u, strict=True)), F.lit(0.0))
    return narrow.where("n_tokens > 0").agg(F.min(product)).first()[0]


def solve(narrow: DataFrame, targets: dict[str, float] = TARGETS, scale: float = SCALE, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> Plan:
    """Fit the rates over a table with p_<domain> and n_tokens."""
    k = len(DOMAINS)
    share = np.array([targets.get(d, 0.0) for d in DOMAINS], np.float64)
    share = share / share.sum()
    first = _sums(narrow, lambda p, n: np.concatenate([n @ p, ((p * n[:, None]).T @ p).ravel()]), k + k * k)
    totals, gram = first[:k], first[k:].reshape(k, k)
    want = share * totals.sum() * scale
    if totals.sum() <= 0:
        return Plan(scale, 0.0, [], totals, want, totals)
    weight = 1 / np.maximum(want, 1e-3 * totals.sum())
    root = np.sqrt(weight)
    step = 1 / max(np.linalg.eigvalsh(gram * root[:, None] * root[None, :]).max(), 1e-12)
    gradients: list[np.ndarray] = []
    for done in range(rounds):
        if done % 10 == 0:
            ease(narrow.sparkSession)
        # the gradient at the point ahead
        start, held = scale, list(gradients)
        at = _sums(narrow, lambda p, n: np.concatenate([(r := rates_after(p, start, step, held))[1] * n @ p, r[0] * n @ p]), 2 * k)
        reached = at[k:]
        if np.abs(reached - want).max() <= tolerance * want.sum():
            return Plan(scale, step, gradients, totals, want, reached)
        gradients.append(weight * (at[:k] - want))
    slope, reached, met = _finish(narrow, scale, want, weight, tolerance)
    if met:
        return Plan(scale, step, [], totals, want, reached, slope)
    missed = want - reached
    warnings.warn("mixing: no rates meet the targets; short of them, in shares of all tokens: " + ", ".join(f"{d} {m / want.sum():.4f}" for d, m in zip(DOMAINS, missed, strict=True)), stacklevel=2)
    return Plan(scale, step, [], totals, want, reached, slope, missed)


def calibrated(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> Classifier:
    """The classifier with the domains' shares among all labels as its prior."""
    model = fit(docs, labels, bound)
    model.b = model.b + np.log(np.maximum(priors(labels) * len(DOMAINS), 1e-6))
    return model


def posterior_table(docs: DataFrame, model: Classifier, *keep: str) -> DataFrame:
    """The columns `keep` of docs with n_tokens and p_<domain>."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*keep, "n_tokens", *(f"p_{d}" for d in DOMAINS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            p, count = shared.value.posteriors(b.column("text"))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(count), *(pa.array(np.ascontiguousarray(x)) for x in p.T)], names)

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("n_tokens", T.LongType()), *(T.StructField(f"p_{d}", T.DoubleType()) for d in DOMAINS)])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(lean(run), schema)


def rated(narrow: DataFrame, plan: Plan) -> DataFrame:
    """narrow with domain, its likeliest, and rate."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.stack([b.column(f"p_{d}").to_numpy() for d in DOMAINS], 1)
            rate = plan.rates(p)
            domain = pa.array(DOMAINS).take(pa.array(p.argmax(1)))
            yield pa.RecordBatch.from_arrays([*b.columns, domain, pa.array(rate)], [*b.schema.names, "domain", "rate"])

    return narrow.mapInArrow(run, T.StructType([*narrow.schema.fields, T.StructField("domain", T.StringType()), T.StructField("rate", T.DoubleType())]))


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, scale: float = SCALE, bound: int = BOUND) -> DataFrame:
    """(doc_id, n_tokens, p_<domain>, domain, rate) for every row of docs."""
    narrow = written(posterior_table(docs, calibrated(docs, labels, bound), "doc_id"), "mixing")
    return rated(narrow, solve(narrow, targets, scale))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, scale: float = SCALE, bound: int = BOUND) -> DataFrame:
    """The mix itself: each row of docs as often as its rate says, the fraction decided by the hash of doc_id, text and the row's number in its file, so that copies aren't all kept or all dropped. Columns as in docs."""
    spark = docs.sparkSession
    small_batches(spark)
    file, row, coin = (free_name(docs, n) for n in ("in_file", "in_row", "coin"))
    found = beside.placed(docs, file, row)
    narrow = posterior_table(found.select(F.col(file).alias("file"), F.col(row).alias("row"), "text"), calibrated(docs, labels, bound), "file", "row")
    side = beside.lay(narrow, "mixing", blocks.Layout(blocks.text_bytes(docs)).blocks)
    plan = solve(spark.read.schema(narrow.schema).parquet(side.path), targets, scale)
    tossed = found.withColumn(coin, F.pmod(F.xxhash64("doc_id", "text", row), F.lit(1 << 30)) / F.lit(float(1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for f, window, b in beside.windows(batches, file=file, row=row):
            if at != (f, window):
                at, got = (f, window), side.read(f, window)
                rows, rate = got.column("row").to_numpy(), plan.rates(np.stack([got.column(f"p_{d}").to_numpy() for d in DOMAINS], 1))
            mine = rate[np.searchsorted(rows, b.column(row).to_numpy())]
            whole = np.floor(mine)
            times = (whole + (b.column(coin).to_numpy() < mine - whole)).astype(np.int64)
            yield b.take(pa.array(np.repeat(np.arange(b.num_rows), times))).drop_columns([file, row, coin])

    return tossed.mapInArrow(lean(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
