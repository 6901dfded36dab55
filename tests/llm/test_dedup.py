import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import rows_of, sentence

from tessera.llm import blocks, exactdedup, jaccard, linededup, substrings


def words(text):
    import re

    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())


def grams(text, n):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


@pytest.fixture(scope="module")
def near(make):
    rng = random.Random(1)
    rows, k = [], 0
    for group in range(40):
        base = sentence(rng, rng.choice([2, 5, 30, 80, 200])).split()
        for _ in range(rng.choice([1, 2, 6])):
            copy = [w if rng.random() > 0.04 else f"x{rng.randrange(50)}" for w in base]
            rows.append((k, " ".join(copy)))
            k += 1
    rows += [(k, rows[0][1]), (k + 1, "shared words here " * 3 + rows[1][1])]
    return make(rows), rows


def links_of(rows):
    """The rows of near_copies, by comparing all pairs."""
    p, q = jaccard.THRESHOLD
    sets = [grams(t, jaccard.N) for _, t in rows]
    links = {k: {} for k in range(len(rows))}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            o = len(a & b)
            if i != j and o and o * (p + q) >= p * (len(a) + len(b)):
                links[i][j] = (o, o / len(a | b))
    out = []
    for i, some in links.items():
        seen, todo = {i}, [i]
        for x in todo:
            todo += [y for y in links[x] if y not in seen]
            seen |= set(links[x])
        if some:
            ids = [rows[x][0] for x in seen if rows[x][0] is not None]
            out.append((rows[i][0], min(ids, default=None), len(some), sum(o for o, _ in some.values()), max(j for _, j in some.values())))
    return sorted(out, key=repr)


def test_jaccard_against_brute_force(near):
    docs, rows = near
    want = links_of(rows)
    assert rows_of(jaccard.near_copies(docs)) == want and sum(r[2] for r in want) > 100


@pytest.mark.parametrize("tile, cross", [(2, 0), (16, 1)])
def test_jaccard_tiles_of_a_large_row_block(near, monkeypatch, tile, cross):
    docs, rows = near
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "CROSS", cross)
    assert rows_of(jaccard.near_copies(docs)) == links_of(rows)


def test_jaccard_links_of_many_tiles_come_once(spark, make, monkeypatch):
    rng = random.Random(8)
    rows = []
    for _ in range(6):  # row blocks of two and a half tiles
        base = sentence(rng, 60, 10**6)
        rows += [(len(rows) + i, f"{base} {sentence(rng, 1 + i, 10**6)}") for i in range(10)]
    monkeypatch.setattr(jaccard, "TILE", 8)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = rows_of(jaccard.near_copies(make(rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert got == links_of(rows) and sum(r[2] for r in got) == 6 * 90


def test_jaccard_with_more_bits_than_blocks(near, monkeypatch):
    docs, rows = near
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 64)
    monkeypatch.setattr(blocks, "MOST_BITS", 3)
    monkeypatch.setattr(blocks, "BATCH_ITEMS", 500)
    assert blocks.Layout(20_000, 64).more > 3
    assert rows_of(jaccard.near_copies(docs)) == links_of(rows)


def test_jaccard_of_a_hot_group(make):
    rng = random.Random(12)
    base, passage = sentence(rng, 40), sentence(rng, 12)
    rows = [(i, base) for i in range(300)] + [(300 + i, f"{passage} {sentence(rng, 30)}") for i in range(150)] + [(450 + i, sentence(rng, 40)) for i in range(150)] + [(600, base + " and more")]
    got = rows_of(jaccard.near_copies(make(rows)))
    assert got == links_of(rows) and len(got) == 301
    assert sorted(r.doc_id for r in jaccard.keep_one(make(rows)).collect()) == [0, *range(300, 600)]


def test_parities_never_overestimate_a_difference():
    rng = np.random.default_rng(4)
    for n, m, both in ((40, 40, 0), (40, 60, 30), (5, 200, 5), (300, 310, 250), (1, 1, 1)):
        a = rng.integers(0, 2**63, n + m - both).astype(np.uint64)
        x, y = a[:n], a[n - both :]
        found = jaccard.apart(jaccard.parities(x), n, jaccard.parities(y), m)
        assert found == jaccard.apart(jaccard.parities(y), m, jaccard.parities(x), n) <= n + m - 2 * both
        if not both:
            assert found > 25


def test_overlaps_dense_and_sparse():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 40)) for _ in range(25)]
    ids = np.concatenate(sets).astype(np.uint64)
    doc = np.repeat(np.arange(25), [len(s) for s in sets])
    got = jaccard.overlaps(ids, doc, 25)
    for i in range(25):
        for j in range(i + 1, 25):
            assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_keep_one_of_each_group(near):
    docs, rows = near
    linked = {r[0]: r[1] for r in links_of(rows)}
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in rows if linked.get(i, i) == i)


def test_jaccard_of_odd_rows(odd, empty):
    got = [r[:3] for r in rows_of(jaccard.near_copies(odd))]
    assert sorted(got, key=repr) == sorted([(1, 1, 2), (1, 1, 2), (2, 1, 2), (6, 6, 1), (None, 6, 1), (8, 8, 1), (9, 8, 1)], key=repr)
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({1: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, 10: 2, 11: 1, None: 1})
    assert rows_of(jaccard.near_copies(empty)) == [] and jaccard.keep_one(empty).count() == 0


def test_exact_against_brute_force(make, odd, empty):
    rng = random.Random(3)
    texts = [sentence(rng, n) for n in (0, 1, 5, 50)] + ["same start " + sentence(rng, k) for k in range(4)]
    rows = [(i, rng.choice(texts)) for i in range(60)]
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    want = sorted(((i, first[t], len(t)) for i, t in rows if first[t] != i), key=repr)
    assert rows_of(exactdedup.exact_copies(make(rows))) == want
    assert rows_of(exactdedup.exact_copies(make(rows), trie_bytes=200)) == want  # with spills
    assert [r[:2] for r in rows_of(exactdedup.exact_copies(odd))] == [(1, 1), (2, 1), (5, 4), (None, 6)]
    assert rows_of(exactdedup.exact_copies(empty)) == []


@pytest.mark.parametrize("start", [b"one prefix of all ", b""])
def test_texts_far_beyond_the_bound_of_a_trie(start, tmp_path):
    rng = random.Random(9)
    texts = [start + sentence(rng, 4).encode() for _ in range(800)] + [start + b"a" * n for n in range(60)] + [start + b"b" * 150]
    entries = [(t, exactdedup.Found((False, i, 7, i), 1, (7, 0, i, i))) for i, t in enumerate(texts + texts[::2])]
    want = defaultdict(list)
    for t, found in entries:
        want[t].append(found.least[1])
    rng.shuffle(entries)
    got = list(exactdedup.owners(iter(entries), f"file://{tmp_path}", 600))
    assert len(got) == len(want)
    for t, found in got:
        assert found.least[1] == min(want[t]) and found.n == len(want[t]) and sorted(found.addresses[2::4]) == sorted(want[t])
    assert not list(tmp_path.iterdir())


def test_trie_holds_prefixes_and_empty_keys():
    trie = exactdedup.PatriciaTrie()
    for k, i in ((b"", 1), (b"ab", 2), (b"abc", 3), (b"ab", 4), (b"a", 5), (b"x", 6), (b"", 7)):
        trie.insert(k, exactdedup.Found((False, i, 0, 0), 1, (0, 0, i, i)))
    assert {k: f.addresses[2::4].tolist() for k, f in trie.entries()} == {b"": [1, 7], b"a": [5], b"ab": [2, 4], b"abc": [3], b"x": [6]}
    assert {k: f.least[1] for k, f in trie.entries()} == {b"": 1, b"a": 5, b"ab": 2, b"abc": 3, b"x": 6}


def test_lines_against_brute_force(make, odd, empty):
    rng = random.Random(4)
    pool = [sentence(rng, 6) for _ in range(30)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.4 else sentence(rng, 9) for _ in range(rng.randrange(8)))) for i in range(50)]
    seen, want = {}, []
    for i, t in rows:
        for n, line in enumerate(t.split("\n")):
            if line.strip():
                if line in seen:
                    want.append((i, n, *seen[line]))
                seen.setdefault(line, (i, n))
    assert rows_of(linededup.repeated_lines(make(rows))) == sorted(want, key=repr)
    got = rows_of(linededup.repeated_lines(odd))
    assert Counter(got) == Counter([(2, 0, 1, 0), (None, 0, 6, 0), (10, 1, 10, 0), (10, 3, 10, 0)])
    assert rows_of(linededup.repeated_lines(empty)) == []


def test_bloom_filters_miss_nothing():
    rng = np.random.default_rng(2)
    items = rng.integers(0, 5000, 20_000).astype(np.uint32)
    marks = linededup.seen_twice(items, step=777)
    kinds, n = np.unique(items, return_counts=True)
    assert marks[np.isin(items, kinds[n > 1])].all()
    alone = rng.permutation(200_000).astype(np.uint32)
    assert linededup.seen_twice(alone).mean() < 0.05


def spans(rows, size):
    place = defaultdict(list)
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - size + 1):
            place[tuple(w[s : s + size])].append((i, s))
    marks = {}
    for where in place.values():
        if len(where) > 1:
            head = min(where)
            for x in where:
                marks[x] = (head[0], x == head)
    out = []
    for (i, s), m in sorted(marks.items()):
        if out and out[-1][0] == i and out[-1][1] + out[-1][2] - size + 1 == s and tuple(out[-1][3:]) == m:
            out[-1][2] += 1
        else:
            out.append([i, s, size, *m])
    return sorted(map(tuple, out), key=repr)


def test_substrings_against_brute_force(make, odd, empty):
    rng = random.Random(6)
    shared = [sentence(rng, n) for n in (50, 51, 70, 49)]
    rows = []
    for i in range(60):
        parts = [sentence(rng, rng.randrange(80))] + [rng.choice(shared) for _ in range(rng.choice([0, 0, 1, 2]))] + [sentence(rng, rng.randrange(60))]
        rows.append((i, " ".join(parts)))
    rows += [(60, "der " * 200), (61, "der die " * 90)]
    want = spans(rows, substrings.SIZE)
    assert rows_of(substrings.repeated_spans(make(rows))) == want and len(want) > 20
    got = rows_of(substrings.repeated_spans(odd))
    assert (2, 0, 120, 1, False) in got and (1, 0, 120, 1, True) in got and (None, 0, 90, 6, False) in got
    assert (9, 0, 60_000, 8, False) in got and len(got) == 7 and got.count((1, 0, 120, 1, True)) == 2
    assert rows_of(substrings.repeated_spans(empty)) == []


def test_sketch_never_underestimates():
    rng = np.random.default_rng(2)
    items = rng.integers(0, 9000, 20_000).astype(np.uint32)
    kinds, n = np.unique(items, return_counts=True)
    assert substrings.estimated_repeats(items, step=999)[np.isin(items, kinds[n > 1])].all()
