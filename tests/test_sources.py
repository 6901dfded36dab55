import pytest
from pyspark.sql import functions as F

from tessera.lang import language_of, parse
from tessera.operators.tables import Catalog
from tessera.sources import repo
from tessera.sources.ignore import IgnoreRules
from tessera.streaming import incremental

PYTHON = '''"""Module text."""
import os
from . import helper as h
from pkg.mod import thing

LIMIT = 3
count = 0


# says hello
@decorated(1)
def greet(name: str, *rest, loud=False) -> str:
    """Greets."""
    return h.shout(name) if loud else thing(name)


class Base(Parent):
    """A base."""

    FLAG = True

    def __init__(self):
        self.x = os.getcwd()

    async def _hidden(self): ...
'''
GO = 'package geo\n\nimport (\n\t"fmt"\n\tu "example.com/m/util"\n)\n\n// Point is a place.\ntype Point struct {\n\tX, Y int\n\tBase\n}\n\ntype Shape interface {\n\tArea() float64\n}\n\nconst Pi = 3\n\nvar (\n\ta = 1\n\tB = 2\n)\n\nfunc (p *Point) Move(dx int) {\n\tfmt.Println("func x() {", dx)\n\tu.Do(p)\n}\n\ntype Name = string\n'
JAVA = "package com.x;\n\nimport java.util.List;\n\n/** A thing. */\npublic class A<T> extends Base implements I {\n    private static final int MAX = 3;\n    protected List<String> items;\n\n    public A(int n) {\n        this.n = n;\n    }\n\n    @Override\n    public int size() {\n        return helper(items.size());\n    }\n\n    enum Color { RED, GREEN(1); }\n}\n\ninterface I {\n    void run();\n}\n"
TS = "import { a } from './util';\nimport React from \"react\";\nexport interface P {\n  name: string;\n  go(): void;\n}\nexport abstract class K<T> extends B {\n  private n: number = 1;\n  constructor(x: T) {\n    super();\n  }\n  static make() {\n    return new K(a());\n  }\n}\nexport type U = string | number;\nexport enum E { A, B = 2 }\nnamespace N {\n  export function inner() { return 1; }\n}\nexport const f = (x: number): number => x + 1;\nconst LIMIT = 10;\n"
JS = "const fs = require('fs');\nexport { x } from './x.js';\nexport function run(a, b) {\n  return fs.read(a, `{${b}`);\n}\nclass Q {\n  #secret = 1;\n  go() {\n    run(1, 2);\n  }\n}\nlet v = 2;\n"


def kinds(path, source):
    result = parse(path, source.encode())
    return result, {(n.kind, n.name) for n in result.nodes}


def test_python():
    result, found = kinds("pkg/sub/one.py", PYTHON)
    assert result.package == "pkg.sub.one" and result.docstring == "Module text."
    assert {("constant", "LIMIT"), ("variable", "count"), ("function", "greet"), ("class", "Base"), ("constant", "FLAG"), ("method", "__init__"), ("method", "_hidden")} <= found
    greet = next(n for n in result.nodes if n.name == "greet")
    assert greet.docstring == "Greets." and greet.decorators == ["decorated(1)"] and greet.return_type == "str" and greet.comment == "says hello"
    assert [p["name"] for p in greet.parameters] == ["name", "*rest", "loud"] and greet.signature.startswith("def greet(")
    assert greet.fqn == "pkg.sub.one.greet" and next(n for n in result.nodes if n.name == "_hidden").visibility == "protected"
    assert [(i.virtual_path, i.external) for i in result.imports] == [("os", True), ("pkg.sub", False), ("pkg.mod", True)]
    assert {(r.raw, r.to_package) for r in result.refs} >= {("h.shout", "pkg.sub"), ("thing", "pkg.mod"), ("os.getcwd", "os")}
    broken = parse("x.py", b"def (:\n")
    assert [n.kind for n in broken.nodes] == ["literal"]


def test_go():
    result, found = kinds("geo/p.go", GO)
    assert found >= {("class", "Point"), ("property", "X"), ("property", "Y"), ("property", "Base"), ("interface", "Shape"), ("method_def", "Area"), ("constant", "Pi"), ("variable", "a"), ("method", "Move"), ("type_alias", "Name")}
    move = next(n for n in result.nodes if n.name == "Move")
    assert result.nodes[move.parent].name == "Point" and next(n for n in result.nodes if n.name == "a").visibility == "private"
    assert next(n for n in result.nodes if n.name == "Point").docstring == "Point is a place."
    assert {(r.raw, r.to_package) for r in result.refs} >= {("fmt.Println", "fmt"), ("u.Do", "example.com/m/util")}


def test_java():
    result, found = kinds("src/com/x/A.java", JAVA)
    assert result.package == "com.x"
    assert found >= {("class", "A"), ("constant", "MAX"), ("property", "items"), ("method", "A"), ("method", "size"), ("enum", "Color"), ("constant", "RED"), ("constant", "GREEN"), ("interface", "I"), ("method_def", "run")}
    size = next(n for n in result.nodes if n.name == "size")
    assert size.fqn == "com.x.A.size" and size.visibility == "public"
    assert {r.raw for r in result.refs} == {"helper", "items.size", "Base", "I"}


def test_typescript_and_javascript():
    result, found = kinds("web/x.ts", TS)
    assert found >= {("interface", "P"), ("method_def", "go"), ("class", "K"), ("property", "n"), ("method", "constructor"), ("method", "make"), ("type_alias", "U"), ("enum", "E"), ("constant", "A"), ("namespace", "N"), ("function", "inner"), ("function", "f"), ("constant", "LIMIT")}
    assert [(i.virtual_path, i.external) for i in result.imports] == [("web.util", False), ("react", True)]
    inner = next(n for n in result.nodes if n.name == "inner")
    assert result.nodes[inner.parent].name == "N"
    result, found = kinds("web/y.js", JS)
    assert found >= {("function", "run"), ("class", "Q"), ("method", "go"), ("variable", "v")}
    assert {(i.virtual_path, i.alias) for i in result.imports} == {("fs", "fs"), ("web.x.js", None)}
    assert ("run", "call") in {(r.raw, r.type) for r in result.refs}


def test_markup():
    result = parse("r.md", b"intro\n# A\ntext\n## B\n```\n# no\n```\n# C\n")
    assert [(n.docstring, n.parent) for n in result.nodes] == [(None, None), ("A", None), ("B", 1), ("C", None)]
    long = parse("t.txt", ("word " * 1200).encode())
    assert "".join(n.body for n in long.nodes) == "word " * 1200 and len(long.nodes) > 1
    assert language_of("a/B.PY") == "python" and language_of("Makefile") is None and parse("x.rs", b"") is None


def test_ignore_rules():
    rules = IgnoreRules([("", "# note\n*.log\n/build\ndocs/**/tmp\ncache/\n!keep.log\n"), ("sub", "local\n/top.txt\n")])
    for path in ("a.log", "x/y.log", "build", "build/a", "docs/a/b/tmp", "cache/z", "x/cache/z", "sub/deep/local", "sub/top.txt"):
        assert rules.ignored(path), path
    for path in ("keep.log", "x/build", "cache", "local", "sub/deep/top.txt", "a.txt"):
        assert not rules.ignored(path), path


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for name, text in {".gitignore": "*.log\n", "a/one.py": "import a.two\nX = 1\ndef foo(): pass\n", "a/two.py": "def bar(): pass\n", "b/g.go": GO, "a/__init__.py": "from a.two import bar\n", "a/_private.py": "Z = 2\n", "b/h.go": "package geo\n\nfunc (s *Square) Area() float64 {\n\treturn 1\n}\n", "b/i.go": "package geo\n\ntype Square struct {\n\tside int\n}\n", ".hidden.md": "# Title\n", "noise.log": "x", "node_modules/z.py": "x = 1\n", "b/.gitignore": "gen.py\n", "b/gen.py": "y = 1\n"}.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return root


def test_ingest_follows_the_tree(spark, tree, tmp_path):
    root, catalog = f"file://{tree}", Catalog(spark, f"file://{tmp_path}/cat")
    tree_files = [".gitignore", ".hidden.md", "a/__init__.py", "a/_private.py", "a/one.py", "a/two.py", "b/.gitignore", "b/g.go", "b/h.go", "b/i.go"]
    assert repo.ingest(spark, root, catalog) == {"new": len(tree_files)}
    assert sorted(r.path for r in catalog.read("files").collect()) == tree_files
    parents = lambda: {r.name: r.above for r in catalog.read("nodes").alias("n").join(catalog.read("nodes").selectExpr("id AS up", "name AS above"), F.col("parent_id") == F.col("up"), "left").where("kind = 'method'").collect()}
    assert parents()["Area"] == "Square"  # its struct is in another file
    imports = {(r.path, r.virtual_path): (r.to_package, r.external) for r in catalog.read("imports_resolved").collect()}
    assert imports[("a/__init__.py", "a.two")] == ("a/two", False) and imports[("b/g.go", "fmt")] == (None, True)
    assert {r.to_package: r.package_path for r in catalog.read("refs_resolved").where("to_package IS NOT NULL").collect()}["fmt"] is None
    names = lambda: {r.name for r in catalog.read("nodes").where("path = 'a/one.py' AND name IS NOT NULL").collect()}
    assert names() == {"X", "foo"}
    foo = catalog.read("nodes").where("name = 'foo'").first()
    assert foo.search_boost == 2.0 and "foo" in foo.fts_needle.split()
    assert repo.ingest(spark, root, catalog) == {"same": len(tree_files)}
    (tree / "a/one.py").write_text("def foo(): return 1\n")
    (tree / "a/two.py").unlink()
    assert repo.ingest(spark, root, catalog, paths=["a/one.py"]) == {"changed": 1}
    assert names() == {"foo"} and catalog.read("files").count() == len(tree_files) and parents()["Area"] == "Square"
    assert repo.ingest(spark, root, catalog)["gone"] == 1
    left = catalog.read("imports_resolved").where("path LIKE 'a/%'").collect()
    assert [(r.path, r.to_package, r.external) for r in left] == [("a/__init__.py", None, True)] and catalog.read("nodes").where("path = 'a/two.py'").count() == 0


def test_methods_find_their_class(spark):
    rows = [("1", "main", "g/a.go", "Point", "g.Point", "class", None), ("2", "main", "g/b.go", "Move", "g.Point.Move", "method", None), ("3", "main", "g/b.go", "Free", "g.Free", "method", None)]
    nodes = spark.createDataFrame(rows, "id string, repo string, path string, name string, fqn string, kind string, parent_id string")
    assert {r.id: r.parent_id for r in repo.adopted(nodes).collect()} == {"1": None, "2": "1", "3": None}


def test_imports_find_their_package(spark):
    edges = spark.createDataFrame([("m", "a.two", None, False), ("m", None, "b/x", False), ("m", "os", None, True), ("m", None, "b/x", True)], "repo string, virtual_path string, physical_path string, external boolean")
    packages = spark.createDataFrame([("m", "a.two", "a/two"), ("m", "b.x", "b/x")], "repo string, virtual_path string, package_path string")
    got = sorted(((r.virtual_path, r.external, r.to_package) for r in repo.resolved_imports(edges, packages).collect()), key=repr)
    assert got == sorted([("a.two", False, "a/two"), (None, False, "b/x"), ("os", True, None), (None, True, None)], key=repr)


def test_incremental_stream_is_idempotent(spark, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/cat")
    sink = incremental.upsert_into(catalog, "t", ["id"], "at")
    schema = "id int, v string, at int"
    spark.createDataFrame([(1, "a", 1), (2, "b", 1), (1, "c", 2)], schema).write.parquet(f"{tmp_path}/in/1")
    go = lambda: incremental.refresh(spark, f"{tmp_path}/in/*", spark.createDataFrame([], schema).schema, f"{tmp_path}/check", sink)
    go()
    go()
    spark.createDataFrame([(2, "d", 5)], schema).write.parquet(f"{tmp_path}/in/2")
    go()
    assert sorted((r.id, r.v) for r in catalog.read("t").collect()) == [(1, "c"), (2, "d")]
