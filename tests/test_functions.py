import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import render
from tessera.functions import text as X
from tessera.functions.vector import cosine, fitted
from tessera.operators.chunking import chunk_spans, count_words

# input, words, code tokens
TOKENS = [
    ("alpha beta", "alpha beta", "alpha beta"),
    ("AlphaBeta", "AlphaBeta", "AlphaBeta Alpha Beta"),
    ("alphaBeta", "alphaBeta", "alphaBeta alpha Beta"),
    ("alpha_beta", "alpha beta", "alpha beta"),
    ("alpha-beta", "alpha beta", "alpha beta"),
    ("ab12cd", "ab12cd", "ab12cd ab 12 cd"),
    ("12ab", "12ab", "12ab 12 ab"),
    ("ab12", "ab12", "ab12 ab 12"),
    ("XMLReader", "XMLReader", "XMLReader XML Reader"),
    ("p-q_r.s", "p q r s", "p q r s"),
    ("toXML", "toXML", "toXML to XML"),
    ("V8_fastPath", "V8 fastPath", "V8 V 8 fastPath fast Path"),
    ("fn find(a: TreeNode) -> [Leaf]", "fn find a TreeNode Leaf", "fn find a TreeNode Tree Node Leaf"),
    ("", "", ""),
]


def test_tokenizers(spark):
    df = spark.createDataFrame([(t[0],) for t in TOKENS], "t string")
    got = {r.t: (r.w, r.c) for r in df.select("t", F.array_join(X.words(F.col("t")), " ").alias("w"), F.array_join(X.code_tokens(F.col("t")), " ").alias("c")).collect()}
    assert got == {t: (w, c) for t, w, c in TOKENS}
    stop = df.select(F.array_join(X.code_tokens(F.col("t"), ["alpha", "tree"]), " ").alias("c")).collect()
    assert all("alpha" not in r.c.split() and "Alpha" not in r.c.split() for r in stop)


def test_needle_repeats_by_weight(spark):
    df = spark.createDataFrame([("aB", None, "c")], "a string, b string, c string")
    assert df.select(X.weighted_needle([(F.col("a"), 2), (F.col("b"), 3), (F.col("c"), 1)]).alias("n")).first().n == "aB a B aB a B c"


def test_globs_and_subsequences():
    import re

    for glob, yes, no in (("*.py", "a/b.py", "a.pyc"), ("src/?.go", "src/a.go", "src/ab.go"), ("[!a]*", "b", "a"), ("[ab]x", "ax", "cx"), ("a[", "a[", "a"), ("a+b", "a+b", "aab")):
        assert re.match(X.glob_pattern(glob), yes) and not re.match(X.glob_pattern(glob), no)
    assert re.match(X.subsequence("a.c"), "xA/.b/C") and not re.match(X.subsequence("a.c"), "abc")


def test_names(spark):
    rows = [("getUserName", "public"), ("_x", "protected"), ("__x", "private"), ("__init__", "protected"), ("", "public")]
    df = spark.createDataFrame(rows, "n string, v string")
    for r in df.select("n", "v", X.python_visibility(F.col("n")).alias("p"), X.descriptiveness(F.col("n")).alias("d")).collect():
        assert r.p == r.v
        if r.n == "getUserName":
            assert r.d == round((3 / 6 + 11 / 30) / 2, 4)
        if not r.n:
            assert r.d == 0
    paths = spark.createDataFrame([("a/b.py", "a.b"), ("a/__init__.py", "a"), ("c.py", "c")], "p string, m string")
    assert all(r.m == r.x for r in paths.select("m", X.dotted_module(F.col("p")).alias("x")).collect())


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0, 2.0])], "a array<double>, b array<double>")
    got = [r.c for r in df.select(cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got[0] == 0 and abs(got[1] - 1) < 1e-12 and got[2:] == [None, None, None]
    assert len(df.select(fitted(F.col("b").cast("array<float>"), 5).alias("f")).first().f) == 5


PARAGRAPHS = "One. Two words here.\n\nA much longer sentence, with several phrases; it has to be parted (more than once) because it is long. Then a short one.\n\nEnd"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab ,.;\n!()", max_size=200), st.integers(1, 12), st.one_of(st.none(), st.integers(1, 12)))
def test_chunks_tile_the_text(text, most, least):
    if least is not None and least > most:
        with pytest.raises(ValueError):
            chunk_spans(text, most, least)
        return
    spans = chunk_spans(text, most, least)
    assert "".join(text[a:z] for a, z in spans) == text
    assert all(count_words(text[a:z]) <= most for a, z in spans)


def test_chunks_by_level():
    got = [PARAGRAPHS[a:z] for a, z in chunk_spans(PARAGRAPHS, 6)]
    assert got[0] == "One. Two words here.\n\n"
    assert "A much longer sentence, " in got
    alone = [PARAGRAPHS[a:z] for a, z in chunk_spans(PARAGRAPHS, 6, 3)]
    assert len(alone) >= len(got)
    assert chunk_spans("a b c", 5) == [(0, 5)]


def test_structured_text():
    assert render.as_text({"b": 1, "a": [1, {"z": 1, "y": {3, 2}}]}) == 'a: [1, {"y": [2, 3], "z": 1}]\nb: 1'
    assert render.as_text([1, "x"]) == "idx: 0\nvalue: 1\n---\nidx: 1\nvalue: x"
    assert render.as_text({"k": "one\r\ntwo"}) == "k:\n```text\none\ntwo\n```"
    assert render.as_text({"k": "````\ncode"}).startswith("k:\n`````text")
    assert render.as_text({"k": "abcdef"}, most=3) == "k: abc…"
    assert render.as_text(7) == "value: 7"
    assert render.as_json({"a": None, "b": "ü", "c": [{"d": None}]}) == '{"b": "ü", "c": [{}]}'


def test_file_responses():
    files = {"a.txt": "hé".encode(), "b.bin": b"\xff\x00"}
    assert render.file_response("", files.get)["status"] == 400
    assert render.file_response("x", files.get)["status"] == 404
    assert render.file_response("a.txt", files.get) == {"status": 200, "content_type": "text/plain", "encoding": "utf-8", "body": "hé"}
    assert render.file_response("b.bin", files.get)["encoding"] == "base64"
    assert render.response_text(render.file_response("a.txt", files.get)).startswith("200 OK\nContent-Type: text/plain\n")
    assert render.response_text({"status": 404, "error": "gone"}).endswith("\n\ngone")
