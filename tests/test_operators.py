import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, hierarchy, paths, search, tables
from tessera.operators.ranking import global_rank


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_global_rank(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0.0, 0.1, 5.0, rng.random()])) for i in range(500)]
    got = {r.id: r.rank for r in global_rank(spark.createDataFrame(rows, "id long, s double").repartition(4), "s", "id", "rank").collect()}
    assert got == {i: n + 1 for n, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert global_rank(spark.createDataFrame([], "id long, s double"), "s", "id", "rank").count() == 0


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        (1, "readFile opens a file and reads the file", "function", "public", "r1", "readFile"),
        (2, "socket listens on a port", "class", "private", "r1", "Listener"),
        (3, "parse the file header", "function", "public", "r2", "parseHeader"),
        (4, "nothing in common", "variable", "public", "r2", "gamma"),
    ]
    vectors = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0]), (4, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, kind string, visibility string, source string, name string"), spark.createDataFrame(vectors, "vec_id long, embedding array<double>")


def test_text_vector_and_fused_search(corpus):
    docs, vectors = corpus
    ids = lambda **k: [r.doc_id for r in search.search(docs, search.SearchRequest(**k), vectors=vectors).orderBy(F.col("rrf").desc(), "doc_id").collect()]
    assert ids(text="file") == [1, 3]
    assert ids(vector=[0.0, 1.0, 0.0]) == [2]
    assert ids(text="file", vector=[0.0, 0.0, 1.0]) == [3, 1]
    assert ids(text="file", kind="function", visibility="public", sources=("r2",)) == [3]
    assert ids(text="file", boost_source="r2", boost_factor=2.0) == [3, 1]
    both = search.search(docs, search.SearchRequest(text="file", vector=[0.0, 0.0, 1.0]), vectors=vectors).where("doc_id = 3").first()
    assert math.isclose(both.rrf, 0.5 / 61 + 0.5 / 62, abs_tol=1e-9)


def test_unranked_search_and_bad_requests(corpus):
    docs, _ = corpus
    page = search.search(docs, search.SearchRequest(limit=1, offset=1))
    assert [r.name for r in page.collect()] == ["gamma", "parseHeader"]
    assert [r.doc_id for r in search.search(docs, search.SearchRequest(name="READFILE")).collect()] == [1]
    for bad in ({"kind": "thing"}, {"visibility": "odd"}, {"limit": -1}):
        with pytest.raises(ValueError):
            search.SearchRequest(**bad).checked()


def test_filename_complete(spark):
    rows = [("r1", p) for p in ("a/b/c/deep.py", "abc_tools.py", "zzz.txt", "A/Bc.md", "b/x_a_b_c.py")] + [("r2", "abc.py")]
    files = spark.createDataFrame(rows, "repo_id string, path string")
    got = [r.path for r in paths.filename_complete(files, "abc").collect()]
    assert got[0] == "abc.py" and "zzz.txt" not in got and len(got) == 5
    assert [r.path for r in paths.filename_complete(files, "abc", repo_ids=["r2"]).collect()] == ["abc.py"]
    assert paths.filename_complete(files, "").count() == 0 and paths.filename_complete(files, "abc", repo_ids=[]).count() == 0
    assert paths.filename_complete(files, ".*").count() == 0


def test_virtual_paths(spark):
    files = spark.createDataFrame([("main", "a/b.py"), ("lib", "c.py"), ("gone", "d.py")], "repo string, file string")
    known = spark.createDataFrame([("main",), ("lib",)], "name string")
    for by_project, want in ((False, ["a/b.py", ".virtual-path/lib/c.py", ".virtual-path/gone/d.py"]), (True, ["main/a/b.py", "lib/c.py", "gone/d.py"])):
        there = files.select(paths.virtual_path(F.col("repo"), F.col("file"), "main", by_project).alias("virtual_path"))
        assert sorted(r.virtual_path for r in there.collect()) == sorted(want)
        back = rows_of(paths.physical_path(there, known, "main", by_project=by_project).select("repo", "path"))
        assert back == sorted([("main", "a/b.py"), ("lib", "c.py"), (None, None)], key=repr)


@pytest.fixture(scope="module")
def code(spark):
    files = spark.createDataFrame([(p,) for p in "abcd"], "path string")
    defs = spark.createDataFrame([("a", "func", "public"), ("c", "beta", "public")], "path string, name string, visibility string")
    refs = spark.createDataFrame([("b", "func"), ("d", "beta"), ("d", "func")], "path string, name string")
    return files, defs, refs


def test_name_weights(code):
    w = {r.name: r for r in graph.name_weights(*code[1:]).collect()}
    assert math.isclose(w["func"].weight, 0.15 * 4 * math.log(3)) and math.isclose(w["beta"].weight, 0.15 * 4 * math.log(2))


def test_walks_prefer_definitions_and_seeds(code):
    edges = graph.code_graph(*code)
    ranks = {r.node: r.score for r in graph.pagerank(edges, rounds=60).collect()}
    assert math.isclose(sum(ranks.values()), 1, rel_tol=1e-9)
    assert ranks["a"] > ranks["b"] and ranks["c"] > ranks["d"]
    at_b = [r.path for r in graph.top_files(graph.pagerank(edges, ["b"], rounds=30)).collect()]
    assert at_b.index("a") < at_b.index("c")
    at_beta = {r.node: r.score for r in graph.pagerank(edges, ["sym::beta"], rounds=30).collect()}
    assert at_beta["c"] > at_beta["a"]
    with pytest.raises(ValueError):
        graph.pagerank(edges, ["nowhere"])


def test_prompts_and_budget(spark, code):
    names = spark.createDataFrame([("Func",), ("beta",), ("ab",)], "name string")
    assert rows_of(graph.mentioned_names(names, "call x.func. and ab, please")) == [("Func",)]
    files = spark.createDataFrame([("src/a.py",), ("b.py",)], "path string")
    assert rows_of(graph.mentioned_files(files, "see A.py")) == [("src/a.py",)]
    ranked = spark.createDataFrame([(1, 3), (2, 4), (3, 1)], "r int, cost int")
    assert [r.r for r in graph.within_budget(ranked, "cost", 7, F.col("r").asc()).collect()] == [1, 2]


def test_hierarchy(spark):
    nodes = spark.createDataFrame([("a", None, "class"), ("b", "a", "method"), ("c", "b", "literal"), ("d", "c", "variable")], "id string, parent_id string, kind string")
    assert rows_of(hierarchy.with_children(nodes.where("id = 'a'"), nodes)) == [("a", "b")]
    assert hierarchy.with_children(nodes.where("id = 'c'"), nodes, kind_col="kind").count() == 0
    assert rows_of(hierarchy.ancestors(nodes.where("id = 'd'"), nodes)) == [("d", "a", 3), ("d", "b", 2), ("d", "c", 1)]
    assert rows_of(hierarchy.ancestors(nodes.where("id IN ('b', 'd')"), nodes, kind_col="kind")) == [("b", "a", 1)]
    page = hierarchy.page_without_parents(nodes, 5, F.col("id").asc())
    assert [r.id for r in page.collect()] == ["d"]
    rows = spark.createDataFrame([("p.A.B.m",), ("p.A.n",), ("q.x",), ("solo",)], "fqn string")
    owners = spark.createDataFrame([("p.A",), ("p.A.B",), ("p.AA",)], "owner string")
    assert rows_of(hierarchy.longest_prefix(rows, owners, "fqn", "owner")) == sorted([("p.A.B.m", "p.A.B"), ("p.A.n", "p.A"), ("q.x", None), ("solo", None)], key=repr)


def test_tables(spark, tmp_path):
    base = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, None, "y")], "id int, s string, t string")
    assert tables.by_ids(base, []).count() == 0 and tables.by_ids(base, [1, 3, 9]).count() == 2
    assert tables.by_ids(base, list(range(2000)), most=10).count() == 3
    assert rows_of(tables.patched(base, spark.createDataFrame([(1, "z"), (9, "q")], "id int, t string"))) == [(1, "a", "z"), (2, "b", "x"), (3, None, "y")]
    assert rows_of(tables.insert_ignore(base, spark.createDataFrame([(3, "n"), (4, "m"), (4, "m")], "id int, s string"), ["id"]))[-1] == (4, "m", None)
    new = spark.createDataFrame([(1, "a", None), (2, "B", "x"), (None, "c", None)], "id int, s string, t string")
    assert rows_of(tables.difference(base, new, ["id"], ["s", "t"])) == sorted([(1, "same"), (2, "updated"), (3, "deleted"), (None, "created")], key=repr)
    assert tables.tri_state(base, "t", None).count() == 3 and tables.tri_state(base, "t", False).count() == 1
    times = spark.createDataFrame([(m, i, None if i == 0 else i) for m in "ab" for i in range(20 if m == "a" else 8)], "model string, id int, at int")
    kept = tables.newest(times, 10, "at", ["model"], "id", batch=5)
    assert {r["model"]: r["count"] for r in kept.groupBy("model").count().collect()} == {"a": 10, "b": 8}
    catalog = tables.Catalog(spark, f"file://{tmp_path}/cat")
    with pytest.raises(KeyError):
        catalog.read("t")
    catalog.write("t", base)
    catalog.write("t", tables.upserted(catalog.read("t"), new.where("id = 2"), ["id"]))
    assert catalog.versions("t") == [1, 2] and rows_of(catalog.read("t"))[1] == (2, "B", "x") and catalog.read("t", 1).count() == 3


def test_token_budget_over_all_documents(spark, tmp_path):
    spark.range(1500).selectExpr("id AS doc_id", "'word' AS text", "4L AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    from tessera.plans.queries import token_budget_prefix

    got = token_budget_prefix(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.running) for r in got) == [(i, i + 1) for i in range(1500)]


def test_chunk_tiling_of_odd_rows(spark, tmp_path):
    import hashlib

    from tessera.plans.queries import chunk_tiling

    big = 2**53 + 1
    rows = [(1, "one two. three"), (1, "one two. three"), (1, "another"), (None, "no name"), (None, "none"), (2, ""), (3, None), (4, " \n"), (big, "word " * 200)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    want = [(i, len(t), hashlib.md5(t.encode()).hexdigest(), True) for i, t in rows if t]
    assert rows_of(chunk_tiling(spark, str(tmp_path))) == sorted(want, key=repr)


def test_text_index_adds_segments(spark, tmp_path, monkeypatch):
    import os

    monkeypatch.setattr(search, "STRETCH", 50)  # lists of several stretches, and several of a merge
    monkeypatch.setattr(search, "SEGMENTS", 2)
    odd = ["readFile reads HTTPServer2Go", "", "naïve file_1 x", "File FILE file", "\u0001 tab\tfile\nfile"]
    docs = spark.createDataFrame([(i, odd[i % len(odd)] + f" w{i % 7} plain" * (i % 3)) for i in range(60)] + [(99, None)], "doc_id long, text string")
    query = "readFile http file w3 plain nowhere"
    index = search.TextIndex(spark, f"file://{tmp_path}/index")
    segments = lambda: len(list((tmp_path / "index").glob("v*")))
    index.build(docs.where("doc_id < 40"))
    before = {p: os.stat(p).st_mtime_ns for p in (tmp_path / "index").rglob("postings/*.parquet")}
    index.refresh(docs.where("doc_id >= 40"))
    assert segments() == 2 and len(index._current()) == 2  # the first segment is still read, not written anew
    assert all(os.stat(p).st_mtime_ns == at for p, at in before.items())
    assert rows_of(index.scores(query)) == rows_of(search.bm25_scores(docs, query))
    changed = docs.where("doc_id % 10 = 0").withColumn("text", F.lit("another file"))
    index.refresh(changed, docs.where("doc_id % 10 = 1").select("doc_id"))
    assert len(index._current()) == 1  # merged
    left = docs.where("doc_id % 10 > 1").unionByName(changed)
    assert rows_of(index.scores(query)) == rows_of(search.bm25_scores(left, query))
    spaced = lambda text: F.split(text, r"\s+")
    other = search.TextIndex(spark, f"file://{tmp_path}/other", tokenizer=spaced).build(docs)
    assert rows_of(other.scores("file plain")) == rows_of(search.bm25_scores(docs, "file plain", tokenizer=spaced))


def test_walks_with_large_nodes(spark, monkeypatch):
    from tessera.plans.queries import _defs_refs

    monkeypatch.setattr(graph, "LIST", 3)
    edges = [(f"f{i}", "hub", 1.0 + i) for i in range(40)] + [("hub", f"f{i}", 2.0) for i in range(30)] + [("f1", "f2", 0.5), ("f1", "f2", 0.25)] + [("end", "end", 0.3)]
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    lists = graph._lists(df).where("src = 'hub'").collect()
    assert len(lists) > 3 and sum(len(r.to) for r in lists) == 30  # no row holds all ways out of the hub
    nodes = sorted({x for e in edges for x in e[:2]})
    for seeds in (None, ["f3", "end", "nowhere"]):
        home = {n: float(seeds is None or n in seeds) for n in nodes}
        rank, all_mass = dict.fromkeys(nodes, 1 / len(nodes)), sum(home.values())
        for _ in range(12):
            total = {n: sum(w for s, _, w in edges if s == n) for n in nodes}
            rank = {n: 0.15 * home[n] / all_mass + 0.85 * sum(rank[s] * w / total[s] for s, t, w in edges if t == n) for n in nodes}
        got = {r.node: r.score for r in graph.pagerank(df, seeds, rounds=12).collect()}
        assert got.keys() == rank.keys() and all(math.isclose(got[n], rank[n], abs_tol=1e-12) for n in nodes)
    _, defs, refs = _defs_refs(spark, "/root/testdata/sf0.001")
    plan = defs.join(refs, "name")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_quantity" not in plan  # lines are read and summed up once, not by everything that looks at names


def test_token_budget_of_rows_without_length(spark, tmp_path):
    spark.createDataFrame([(1, "a b c", None), (None, "d", 1), (2, "e f", 1), (3, "", 0), (4, None, 0), (5, "g\x0bh", 2)], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    from tessera.plans.queries import token_budget_prefix

    got = token_budget_prefix(spark, str(tmp_path)).collect()
    assert sorted((r.running, r.doc_id, r.cost) for r in got) == [(0, 3, 0), (2, 2, 2), (3, None, 1), (4, 5, 1), (7, 1, 3)]
