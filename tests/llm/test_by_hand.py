"""Queries without SQL against plain recomputations, a text at a time."""

import re
from collections import Counter

import numpy as np
import pytest
from conftest_llm import SF
from pyspark.sql import functions as F
from test_dedup import links_of

import corpus_pipeline
from tessera.llm import beside, decontaminate, langid, mixing, quality
from tessera.llm.cluster import shared_dir, written
from tessera.llm.textcore import SHAPES, Words


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def word_hashes(text):
    import pyarrow as pa

    return Words(pa.array([text or ""])).hash


def language_by_hand(model, text):
    """Language, margin: counts of letter pairs and triples, a product for each bit, a loss for each codeword."""
    raw = [b if b >= 128 or 97 <= b <= 122 else 32 for b in (text or "").lower().encode()]
    if not [b for b in raw if b != 32]:
        return None, 0.0
    count = Counter()
    for i in range(len(raw) - 1):
        two = raw[i] | raw[i + 1] << 8
        if two != 0x2020:
            count[(two * 2654435761 & 0xFFFFFFFF) >> 32 - langid.BITS] += 1
        if i + 2 < len(raw) and raw[i + 1] != 32:
            count[((two | raw[i + 2] << 16) ^ 0x5BD1E995) * 2246822519 % 2**32 >> 32 - langid.BITS] += 1
    norm = max(sum(count.values()) ** 0.5, 1e-9)
    f = [sum(n**0.5 / norm * float(model.w[at, k]) for at, n in count.items()) + float(model.b[k]) for k in range(model.w.shape[1])]
    losses = sorted((sum(a * np.log1p(np.exp(-c * v)) for a, c, v in zip(model.alpha, code, f, strict=True)) / model.alpha.sum(), i) for i, code in enumerate(model.codes))
    return model.languages[losses[0][1]], losses[1][0] - losses[0][0]


def test_languages_by_hand(spark, documents):
    model = langid.fit(documents)
    found = {r.doc_id: r for r in langid.identify(documents, model).collect()}
    for r in documents.collect():
        language, margin = language_by_hand(model, r.text)
        got = found[r.doc_id]
        assert got.language == language and abs(got.margin - margin) < 1e-4 and (abs(margin - model.margin) < 1e-4 or got.ambiguous == (margin < model.margin))


def quality_by_hand(model, text):
    """Score, number of passages, passage with most attention."""
    spans = [m.span() for m in re.finditer(rb"[A-Za-z0-9\x80-\xff]+", (text or "").encode())]
    raw = (text or "").encode()
    if not spans:
        return None, 0, None
    hashes = word_hashes(text)
    assert len(hashes) == len(spans)
    passages = []
    for a in range(0, len(spans), quality.PASSAGE):
        words = spans[a : a + quality.PASSAGE]
        end = spans[a + quality.PASSAGE][0] if a + quality.PASSAGE < len(spans) else len(raw)
        body = raw[words[0][0] : end]
        kinds = [0] * SHAPES
        for b in body:
            kinds[0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b in (9, 10, 13, 32) else 4 if chr(b) in ".,;:'\"-()?" else 6 if b >= 128 else 5] += 1
        codes = [int(h) >> 52 for h in hashes[a : a + len(words)]]
        same = sum(x == y for x, y in zip(hashes[a + 1 : a + len(words)], hashes[a : a + len(words)], strict=False))
        n = len(words)
        x = [2 * (k / len(body)) ** 0.5 for k in kinds] + [len(body) / n / 10, n / quality.PASSAGE, len(set(codes)) / n, same / n]
        x += [sum(float(quality._signs[c, k]) for c in codes) / n**0.5 / 4 for k in range(quality.PROJECTED)]
        passages.append((np.array(x) - model.mean) / model.scale)
    hidden = [np.tanh(x @ model.w + model.b) for x in passages]
    attention = np.array([(np.tanh(h @ model.v) / (1 + np.exp(-(h @ model.u)))) @ model.a for h in hidden])
    attention = np.exp(attention - attention.max())
    attention /= attention.sum()
    z = sum(a * h for a, h in zip(attention, hidden, strict=True))
    return 1 / (1 + np.exp(-(z @ model.c + model.d[0]))), len(passages), int(attention.argmax())


def test_quality_by_hand(documents, given):
    model = quality.fit(documents, given)
    found = {r.doc_id: r for r in quality.quality_scores(documents, model).collect()}
    for r in documents.collect():
        score, n, top = quality_by_hand(model, r.text)
        got = found[r.doc_id]
        assert got.n_passages == n
        if n:
            assert abs(got.score - score) < 1e-4 and got.keep == (got.score >= quality.CUT) and (n > 1 or got.top_passage == top == 0)


def posterior_by_hand(model, text):
    raw = np.frombuffer((text or "").encode(), np.uint8)
    form = np.zeros(SHAPES)
    for b in raw:
        form[0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b in (9, 10, 13, 32) else 4 if chr(b) in ".,;:'\"-()?" else 6 if b >= 128 else 5] += 1
    hashes = word_hashes(text)
    z = model.b.copy()
    if len(hashes):
        z = z + 4 * np.sqrt(form / max(1, form.sum())) @ model.w[len(model.words) :]
        has = set(hashes.tolist())
        for k, (word, scale) in enumerate(zip(model.words.tolist(), model.scale, strict=True)):
            if word in has:
                z = z + scale * model.w[k]
    z = np.exp(z - z.max())
    return z / z.sum(), len(hashes)


def rates_by_hand(p, n, targets, scale):
    """Projected gradient descent with momentum over all rows at once."""
    share = np.array([targets[d] for d in mixing.DOMAINS])
    want = share / share.sum() * n.sum() * scale
    weight = 1 / np.maximum(want, 1e-3 * n.sum())
    gram = (p * n[:, None]).T @ p * np.sqrt(weight)[:, None] * np.sqrt(weight)
    step = 1 / np.linalg.eigvalsh(gram).max()
    r = ahead = np.full(len(p), scale)
    was = 1.0
    for _ in range(mixing.ROUNDS):
        if np.abs((r * n) @ p - want).max() <= mixing.TOLERANCE * want.sum():
            return r
        new = np.maximum(0, ahead - step * (p @ (weight * ((ahead * n) @ p - want))))
        now = (1 + np.sqrt(1 + 4 * was * was)) / 2
        r, ahead, was = new, new + (was - 1) / now * (new - r), now
    return None


def test_mixing_by_hand(documents, given):
    targets = {"good": 0.85, "poor": 0.12, "toxic": 0.03}
    model = mixing.calibrated(documents, given)
    rows = sorted(documents.collect(), key=lambda r: r.doc_id)
    by_hand = [posterior_by_hand(model, r.text) for r in rows]
    p, n = np.array([x for x, _ in by_hand]), np.array([k for _, k in by_hand], float)
    want = rates_by_hand(p, n, targets, 1.1)
    assert want is not None
    got = sorted(mixing.mixing_rates(documents, given, targets, 1.1).collect(), key=lambda r: r.doc_id)
    assert np.allclose([[r[f"p_{d}"] for d in mixing.DOMAINS] for r in got], p, atol=1e-6) and [r.n_tokens for r in got] == n.tolist()
    assert np.allclose([r.rate for r in got], want, atol=1e-5)
    mix = Counter(r.doc_id for r in mixing.mixed(documents, given, targets, 1.1).collect())
    assert all(int(r) <= mix[d.doc_id] <= int(r) + 1 for d, r in zip(rows, want, strict=True) if abs(r - round(r)) > 1e-4)
    assert abs(sum(mix[d.doc_id] * k for d, k in zip(rows, n, strict=True)) / n.sum() - 1.1) < 0.15


def test_pipeline_by_hand(spark, documents):
    """Each stage on what the one before it kept: decisions from plain loops over all documents, pairs and items."""
    docs = documents
    bench = [r for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = docs.collect()
        out = written(stage(spark, docs, SF), f"by-hand{k}")
        kept = Counter(r.doc_id for r in out.collect())
        if k == 0:
            model = langid.fit(docs)
            want = Counter(r.doc_id for r in rows if (m := language_by_hand(model, r.text)[1]) >= model.margin or abs(m - model.margin) < 1e-4 and kept[r.doc_id])
        elif k == 1:
            linked = {r[0]: r[1] for r in links_of([(r.doc_id, r.text) for r in rows])}
            want = Counter(r.doc_id for r in rows if linked.get(r.doc_id, r.doc_id) == r.doc_id)
        elif k == 2:
            want = Counter()
            items = [(h := word_hashes(b.text), len(h)) for b in bench]
            for r in rows:
                text = word_hashes(r.text)
                scores = [decontaminate.align(h[None], text[None])[0] / (2 * n) if len(text) else 0 for h, n in items if n >= decontaminate.N]
                want[r.doc_id] += max(scores) < decontaminate.LEAST
            want += Counter()
        elif k == 3:
            found = {r.doc_id: r.rate for r in mixing.mixing_rates(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
            assert all(int(found[d]) <= kept[d] <= int(found[d]) + 1 for d in found)
            want = kept
        else:
            want = Counter(r.doc_id for r in rows)
            by = {}
            for r in out.collect():
                by.setdefault(r.shard, []).append(r.position)
            assert all(sorted(p) == list(range(len(p))) for p in by.values())
        assert kept == want, name
        assert out.columns == (documents.columns if k < 4 else [*documents.columns, "shard", "position"])
        docs = out
    assert sum(kept.values()) > 100
    key = lambda r: (r.doc_id, r.shard, r.position)
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, docs.collect()))


def test_pipeline_executes_on_odd_rows(spark, odd, empty):
    """Nulls, empty, blank and very long texts, repeated rows and clashing columns go through all stages, one after the other."""
    docs, many = odd, [odd.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, SF), f"odd{k}")
        many.append(docs.count())
        assert docs.columns[: len(odd.columns)] == odd.columns
    assert many[1] < many[0] and many[2] < many[1] and many[5] == many[4] and docs.columns[-2:] == ["shard_", "position_"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == []


def test_sides_are_read_by_window(spark):
    rows = spark.range(70_000).selectExpr("id % 3 AS file", "id AS row", "id * 2 AS v")
    side = beside.lay(rows, "t", 4)
    assert side.path.startswith(shared_dir(spark))
    for file, window in ((0, 0), (1, 2), (2, 4)):
        got = side.read(file, window)
        low = window << beside.WINDOW
        assert got.column("row").to_pylist() == [r for r in range(low, min(70_000, low + (1 << beside.WINDOW))) if r % 3 == file]
        assert got.column("v").to_pylist() == [2 * r for r in got.column("row").to_pylist()]
    assert side.read(7, 0) is None and side.read(0, 99) is None
    assert spark.read.parquet(side.path).agg(F.sum("v")).first()[0] == 70_000 * 69_999
