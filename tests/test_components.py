import json

from pyspark.sql import functions as F

from tessera.components import CodeGraph, Component, NodeVectors, SymbolIndex, Workspace
from tessera.functions import text as X
from tessera.operators import embed, graph, search
from tessera.operators.tables import Catalog
from tessera.tools import Project


def written(folder, files):
    for name, text in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def rows(df, *digits):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


def whole_graph(catalog):
    return graph.code_graph(catalog.read("files").select("path"), catalog.read("nodes").where("name IS NOT NULL").select("path", "name", "visibility"), catalog.read("refs").select("path", "name"))


class Counter(Component):
    name = "counter"

    def __init__(self):
        self.seen, self.gone = [], False

    def initialize(self, catalog):
        self.seen.append("all")

    def refresh(self, catalog, changes):
        self.seen.append(sorted((r.path, r.change) for r in changes.collect()))

    def destroy(self, catalog):
        self.gone = True


def test_components_follow_the_changes(spark, tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    written(one, {"a.py": "def reader(): pass\n\n\ndef helper():\n    reader()\n", "b.py": "import a\n\n\ndef main():\n    a.helper()\n"})
    written(two, {"c.py": "def other(): pass\n"})
    clock, counter = [0.0], Counter()
    catalog = Catalog(spark, f"file://{tmp_path}/cat")
    space = Workspace(spark, catalog, {"one": f"file://{one}", "two": f"file://{two}"}, [CodeGraph(), SymbolIndex(), counter], clock=lambda: clock[0])
    assert space.refresh() == {"one": {"new": 2}, "two": {"new": 1}}
    assert counter.seen == [[("a.py", "new"), ("b.py", "new")], [("c.py", "new")]]
    assert rows(CodeGraph.read(catalog)) == rows(whole_graph(catalog))
    written(one, {"b.py": "def main():\n    fresh_name()\n", "d.py": "def fresh_name(): pass\n"})
    (one / "a.py").unlink()
    assert space.refresh() == {}  # too soon
    clock[0] = 301
    assert space.refresh() == {"one": {"changed": 1, "gone": 1, "new": 1}, "two": {"same": 1}}
    assert len(counter.seen) == 3  # nothing changed in the second one
    assert rows(CodeGraph.read(catalog)) == rows(whole_graph(catalog))
    for query in ("fresh name", "reader", "other main"):
        assert rows(SymbolIndex.of(catalog).scores(query)) == rows(search.bm25_scores(catalog.read("nodes"), query, "id", "fts_needle"))
    assert '"name": "fresh_name"' in Project(spark, catalog, f"file://{one}", "one").run("search_symbols", {"query": "fresh_name"}, as_json=True)
    assert space.refresh("two", force=True) == {"two": {"same": 1}}
    again = Counter()
    space.add(again)
    assert counter.gone and again.seen == ["all"] and space.get("counter") is again and space.get("none") is None
    space.close()
    assert again.gone


def test_steps_run_once_in_order(spark, tmp_path):
    catalog, ran = Catalog(spark, f"file://{tmp_path}/cat"), []
    steps = [("002 more", lambda c: ran.append(2)), ("001 first", lambda c: ran.append(1))]
    assert catalog.migrate(steps) == ["001 first", "002 more"] and ran == [1, 2]
    assert catalog.migrate([*steps, ("003 last", lambda c: ran.append(3))]) == ["003 last"] and ran == [1, 2, 3]


def test_tables_are_published_together(spark, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/cat")
    table = lambda x: spark.createDataFrame([(x,)], "x int")
    catalog.publish({"a": table(1), "b": table(1)})
    catalog._write("a", table(2))  # what a scan leaves that broke off
    assert catalog.read("a").first().x == 1 and catalog.versions("a") == [1]
    catalog.publish({"a": table(3), "b": table(3)})
    assert catalog.read("a").first().x == catalog.read("b").first().x == 3 and catalog.read("a", 1).first().x == 1
    catalog.write("b", table(4))
    assert catalog.read("b").first().x == 4 and catalog.read("a").first().x == 3


def test_words_of_a_language_are_left_out(spark):
    df = spark.createDataFrame([("def fooBar return x", "python"), ("def fooBar return x", "go"), ("def fooBar", "text"), ("func X", None)], "t string, lang string")
    got = [r[0] for r in df.select(X.auto_tokens(F.col("t"), F.col("lang"))).collect()]
    assert got == [["fooBar", "foo", "Bar", "x"], ["def", "fooBar", "foo", "Bar", "x"], ["def", "fooBar", "foo", "Bar"], ["func", "X"]]
    assert len(X.STOP_WORDS["python"]) == 29 and len(X.STOP_WORDS["go"]) == 22


def test_go_packages_lie_in_the_nearest_module(spark, tmp_path):
    root = tmp_path / "tree"
    written(root, {
        "go.mod": "module example.com/m\n\ngo 1.22\n", "util/u.go": "package util\n\nfunc Do() {}\n", "main.go": "package main\n\nimport \"example.com/m/util\"\n\nfunc main() {\n\tutil.Do()\n}\n",
        "sub/go.mod": "// the inner one\nmodule example.com/inner\n", "sub/x/x.go": "package x\n\nimport \"example.com/m/util\"\n",
    })
    catalog = Catalog(spark, f"file://{tmp_path}/cat")
    Workspace(spark, catalog, {"main": f"file://{root}"}, []).refresh()
    assert {(r.path, r.virtual_path) for r in catalog.read("packages_resolved").collect()} == {("main.go", "example.com/m"), ("util/u.go", "example.com/m/util"), ("sub/x/x.go", "example.com/inner/x")}
    assert {(r.path, r.to_package, r.external) for r in catalog.read("imports_resolved").collect()} == {("main.go", "util", False), ("sub/x/x.go", "util", False)}
    assert {(r.name, r.package_path) for r in catalog.read("refs_resolved").where("path = 'main.go'").collect()} >= {("Do", "util")}


def test_symbols_are_found_by_their_vectors(spark, tmp_path):
    provider = embed.HashedNgrams()
    root = tmp_path / "tree"
    written(root, {"a.py": "class Loader:\n    def load_matrix(self, path):\n        return path\n\n\ndef unrelated():\n    return 12345\n", "b.py": "def load_matrices(paths):\n    return paths\n"})
    catalog = Catalog(spark, f"file://{tmp_path}/cat")
    Workspace(spark, catalog, {"main": f"file://{root}"}, [SymbolIndex(), NodeVectors(provider)]).refresh()
    project = Project(spark, catalog, f"file://{root}", provider=provider)
    found = json.loads(project.run("search_symbols", {"query": "def load_matrices(paths):\n    return paths"}, as_json=True))
    assert found[0]["name"] == "load_matrices"
    shown = json.loads(project.run("search_symbols", {"symbol_name": "load_matrix", "summary_mode": "definition"}, as_json=True))
    assert shown[0]["body"] == "class Loader:\n    def load_matrix(self, path):\n        ..."
    assert json.loads(project.run("search_symbols", {"symbol_name": "unrelated", "summary_mode": "skip"}, as_json=True))[0].get("body") is None
    other = Project(spark, catalog, f"file://{root}", "elsewhere")
    assert other.run("search_symbols", {"symbol_name": "unrelated"}, as_json=True) == "[]"
    assert '"unrelated"' in other.run("search_symbols", {"symbol_name": "unrelated", "global_search": True}, as_json=True)
    mapped = json.loads(project.run("repo_map", {"file_paths": ["b.py"], "summary_mode": "definition", "skip_mentioned_summary": True}, as_json=True))
    assert {r["file_path"]: r.get("summary") is None for r in mapped} == {"a.py": False, "b.py": True}
