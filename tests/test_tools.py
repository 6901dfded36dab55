import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import embed, summary
from tessera.operators.tables import Catalog
from tessera.sources import repo
from tessera.tools import TOOLS, Project

ONE = 'import b.two\n\n\nclass Reader(Base):\n    """Reads."""\n\n    def open(self, path):\n        return helper(path)\n\n\ndef helper(path):\n    """Helps."""\n    return 1\n'
TWO = "from a.one import Reader, helper\n\n\ndef main():\n    helper(Reader().open('x'))\n"


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in {"a/one.py": ONE, "b/two.py": TWO, "notes.txt": "plain words", "data.bin2": "raw"}.items():
        path = root / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
    catalog = Catalog(spark, f"file://{tmp_path_factory.mktemp('cat')}")
    repo.ingest(spark, f"file://{root}", catalog)
    return Project(spark, catalog, f"file://{root}")


def test_files(project):
    assert project.run("list_files", {"patterns": ["*.py"]}) == "idx: 0\nvalue: a/one.py\n---\nidx: 1\nvalue: b/two.py"
    assert project.run("list_files", '{"patterns": []}', as_json=True) == "[]"
    assert project.run("complete_path", {"needle": "two"}, as_json=True) == '["b/two.py"]'
    assert project.run("read_file", {"path": "notes.txt"}).endswith("\n\nplain words")
    assert project.run("read_file", {"path": "gone"}).startswith("404")


def test_summaries(project):
    text = project.run("summarize_files", {"paths": ["a/one.py", "unknown.py"]})
    assert "class Reader(Base):" in text and "def open(self, path)" in text and "return helper" not in text and "Helps." not in text
    assert "Helps." in project.run("summarize_files", {"paths": ["a/one.py"], "summary_mode": "documentation"})
    assert project.run("summarize_files", {"paths": ["a/one.py"], "summary_mode": "skip"}, as_json=True) == "[]"
    with pytest.raises(ValueError):
        project.run("summarize_files", {"paths": [], "summary_mode": "source"})
    assert project.summaries(["data.bin2"], "source") == {"data.bin2": "raw"}


def test_a_hit_is_shown_within_its_class(project):
    rows = [r.asDict(recursive=True) for r in project.catalog.read("nodes").where("path = 'a/one.py'").collect()]
    hit = next(r["id"] for r in rows if r["name"] == "open")
    assert summary.hit_text(hit, rows, "python") == "class Reader(Base):\n    def open(self, path):\n        ..."


def test_search_and_map(project):
    assert '"name": "helper"' in project.run("search_symbols", {"query": "helper", "kind": "function", "limit": 1}, as_json=True)
    assert project.run("search_symbols", {"symbol_name": "READER"}, as_json=True).count('"name"') == 1
    ranked = project.run("repo_map", {"prompt": "what does Reader do?", "limit": 2}, as_json=True)
    assert ranked.startswith('[{"file_path": "a/one.py"')
    assert project.run("repo_map", {"symbol_names": ["main"], "token_limit": 1}, as_json=True) == "[]"
    for bad in (("nothing", {}), ("list_files", {"x": 1})):
        with pytest.raises(ValueError):
            project.run(*bad)
    assert all(t.schema()["parameters"]["properties"] == t.arguments for t in TOOLS.values())


def test_vectors_are_cached_and_trimmed(spark):
    provider = embed.HashedNgrams(64, max_tokens=8)
    rows = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta"), (3, " ".join(f"w{k}" for k in range(30))), (4, None)], "id int, body string")
    empty = spark.createDataFrame([], embed.CACHE)
    out, cache = embed.with_vectors(rows, "body", provider, empty)
    got = {r.id: r.vector for r in out.collect()}
    assert got[1] == got[2] and got[4] is None and len(got[3]) == embed.WIDTH
    assert abs(np.linalg.norm(got[1]) - 1) < 1e-5 and np.linalg.norm(got[3]) < 1
    kept = spark.createDataFrame(cache.collect(), embed.CACHE)
    assert kept.count() == 2
    later = F.lit("2100-01-01 00:00:00").cast("timestamp")
    again, touched = embed.with_vectors(rows.where("id = 1"), "body", provider, kept, now=lambda: later)
    assert again.first().vector == got[1] and touched.count() == 2
    assert embed.trimmed(spark.createDataFrame(touched.collect(), embed.CACHE), 1).count() == 1
    assert embed.windows("a b c d e", 3, 1) == ["a b c", "c d e"]
