"""The engine's operators on the given tables, each over all of its table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as X
from tessera.functions.vector import cosine, fitted
from tessera.operators import chunking, graph, hierarchy, paths, search, tables
from tessera.operators.ranking import global_rank
from tessera.session import load, shared_folder, stored
from tessera.sources import repo

SEARCH_TEXT = "that thest inou andThe"
NEEDLE = "exa12"
PROMPT = "Compare Brand#13 with brand.Brand and see the blue part."
BUDGET = 2000


def scan_filter_project(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 30))
    return rows.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount")), 4).alias("net"))


def full_scan(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")


def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return tables.by_id(load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), 7, "o_orderkey")


def multi_lookup(spark: SparkSession, d: str) -> DataFrame:
    return tables.by_ids(load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), [1, 2, 3, 5, 8, 13, 21, 34, -1], "o_orderkey")


def equality_filters(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.equal_to(load(spark, d, "documents"), lang="en", source=["src0", "src1"], n_chars=None)
    return rows.select("doc_id", "lang", "source")


def name_ignoring_case(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").withColumn("name", F.col("p_brand")).where(search.conditions(search.SearchRequest(name="BRAND#13"), ["name"])).select("p_partkey", "p_brand")


def in_subquery_semi(spark: SparkSession, d: str) -> DataFrame:
    urgent = load(spark, d, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, d, "customer").select("c_custkey", "c_name").join(urgent, "c_custkey", "left_semi")


def not_in_anti(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem").where("l_quantity >= 40").select("l_partkey")
    return tables.orphans(load(spark, d, "part").select("p_partkey", "p_brand"), lines, "p_partkey", "l_partkey")


def left_join_null_fill(spark: SparkSession, d: str) -> DataFrame:
    counts = load(spark, d, "lineitem").where("l_quantity > 49").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return load(spark, d, "supplier").select("s_suppkey").join(counts, "s_suppkey", "left").select("s_suppkey", F.coalesce("n", F.lit(0)).alias("n_lines"))


def tri_state_null(spark: SparkSession, d: str) -> DataFrame:
    joined = load(spark, d, "documents").select("doc_id").join(load(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    parts = [tables.tri_state(joined, "quality", s).agg(F.count("*").alias("n")).select(F.lit(name).alias("state"), "n") for name, s in (("present", True), ("absent", False), ("either", None))]
    return parts[0].union(parts[1]).union(parts[2])


def fullouter_diff(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus", F.year("o_orderdate").alias("y"))
    side = lambda y: o.where(F.col("y") == y).groupBy("o_custkey", "o_orderpriority").agg(F.max("o_orderstatus").alias("status"))
    return tables.difference(side(1995), side(1996), ["o_custkey", "o_orderpriority"], ["status"])


def code_tokens(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part")
    return p.select("p_partkey", F.array_join(X.code_tokens(F.concat_ws(" ", "p_name", "p_brand", F.regexp_replace("p_type", " ", ""))), " ").alias("tokens"))


def word_tokens_stopwords(spark: SparkSession, d: str) -> DataFrame:
    tokens = X.words(F.col("text"), ["the", "and", "der", "la", "de", "en"])
    return load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(tokens).cast("bigint").alias("n_tokens"), F.md5(F.array_join(tokens, " ")).alias("digest"))


def trigram_index(spark: SparkSession, d: str) -> DataFrame:
    return paths.trigram_index(load(spark, d, "pages"), "page_id", "url")


def filename_complete(spark: SparkSession, d: str) -> DataFrame:
    return paths.filename_complete(load(spark, d, "pages").select("page_id", "url"), NEEDLE, "url").select("page_id", "url", F.round("score", 6).alias("score"))


def glob_list(spark: SparkSession, d: str) -> DataFrame:
    return paths.matching(load(spark, d, "pages").select("page_id", "url"), ["*1?", "http*/*[579]"], "url")


def virtual_paths(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", "source", F.concat(F.lit("lib/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string")).alias("file"))
    there = docs.select("doc_id", paths.virtual_path(F.col("source"), F.col("file"), "src0").alias("virtual_path"))
    known = docs.where("source <> 'src3'").select(F.col("source").alias("name"))
    return paths.physical_path(there, known, "src0").select("doc_id", "virtual_path", "repo", "path")


def _defs_refs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    files = load(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("src/"), F.col("s_name")).alias("path"))
    use = load(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity").join(load(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    use = use.select(F.col("l_suppkey").alias("s_suppkey"), F.col("p_brand").alias("name"), "l_quantity").groupBy("s_suppkey", "name").agg(F.max("l_quantity").alias("q"), F.count("*").alias("n"))
    named = stored(use.join(files, "s_suppkey"), "uses")  # definitions and references are read several times, lines once
    defs = named.where("q >= 50").select("path", "name", F.when(F.col("name").endswith("1"), "private").otherwise("public").alias("visibility"))
    return files.select("path"), defs, named.where("n >= 2").select("path", "name")


def collect_defs_refs(spark: SparkSession, d: str) -> DataFrame:
    _, defs, refs = _defs_refs(spark, d)
    a = defs.groupBy("name").agg(F.count_distinct("path").alias("n_defs"), F.array_join(F.array_sort(F.collect_set("path")), ",").alias("def_paths"))
    b = refs.groupBy("name").agg(F.count_distinct("path").alias("n_refs"))
    return a.join(b, "name", "full").select("name", F.coalesce("n_defs", F.lit(0)).alias("n_defs"), "def_paths", F.coalesce("n_refs", F.lit(0)).alias("n_refs"))


def edge_weights(spark: SparkSession, d: str) -> DataFrame:
    return graph.code_graph(*_defs_refs(spark, d)).select("src", "dst", F.round("weight", 6).alias("weight"))


def pagerank_uniform(spark: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(graph.code_graph(*_defs_refs(spark, d))).select("node", F.round("score", 8).alias("score"))


def pagerank_seeded(spark: SparkSession, d: str) -> DataFrame:
    ranks = graph.pagerank(graph.code_graph(*_defs_refs(spark, d)), [graph.SYMBOL + "Brand#13", graph.SYMBOL + "Brand#22", "nowhere"])
    return graph.top_files(ranks).select("path", F.round("score", 8).alias("score"))


def prompt_mining(spark: SparkSession, d: str) -> DataFrame:
    return graph.mentioned_names(load(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("name")).distinct(), PROMPT)


def token_budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "n_chars", F.size(X.plain_tokens(F.col("text"))).cast("bigint").alias("cost"))
    # only documents of lengths that begin within the budget, all of them, are ranked one by one
    before = F.coalesce(F.sum("total").over(Window.orderBy(F.col("n_chars").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lengths = docs.groupBy("n_chars").agg(F.sum("cost").alias("total")).withColumn("before", before).where(F.col("before") <= BUDGET).select(F.col("n_chars").alias("length"))
    page = docs.join(lengths, F.col("n_chars").eqNullSafe(F.col("length")), "left_semi")
    return graph.within_budget(page, "cost", BUDGET, F.col("n_chars").asc_nulls_last(), F.col("doc_id").asc_nulls_last()).select("doc_id", "cost", "running")


def fts_needle_weights(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part")
    return p.select("p_partkey", X.weighted_needle([(F.col("p_name"), 3), (F.col("p_brand"), 2), (F.col("p_type"), 1)]).alias("needle"))


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25_scores(load(spark, d, "documents"), SEARCH_TEXT)


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d).orderBy(F.col("bm25").desc(), F.col("doc_id").asc()).limit(20)


def bm25_rank(spark: SparkSession, d: str) -> DataFrame:
    return global_rank(_bm25(spark, d), "bm25", "doc_id", "rank").select("doc_id", "rank")


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    found = load(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()
    return [float(x) for x in found[0]] if found else [0.0]


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    near = search.cosine_scores(load(spark, d, "embeddings"), _query_vector(spark, d), cut=0.1)
    return near.orderBy(F.col("similarity").desc(), F.col("vec_id").asc()).limit(20)


def _hybrid(spark: SparkSession, d: str, **more) -> DataFrame:
    request = search.SearchRequest(text=SEARCH_TEXT, vector=_query_vector(spark, d), similarity_cut=0.1, limit=10, **more)
    docs = load(spark, d, "documents").withColumn("kind", F.col("lang"))
    return search.search(docs, request, vectors=load(spark, d, "embeddings")).select("doc_id", "lang", "source", "rrf")


def hybrid_search_rrf(spark: SparkSession, d: str) -> DataFrame:
    """Text and vector ranks over the whole table, fused, boosted by kind, filtered after."""
    return _hybrid(spark, d, kind_boosts={"en": 1.1}, sources=tuple(f"src{i}" for i in range(10)))


def rrf_repo_boost(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, boost_source="src0", boost_factor=1.1)


def search_unranked(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").withColumn("name", F.col("source"))
    return search.search(docs, search.SearchRequest(sources=("src1", "src2"), limit=10, offset=5)).select("doc_id", "source")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "conv_id", "turn", "role")
    before = F.lag("id").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.withColumn("parent_id", before)


def hierarchy_children(spark: SparkSession, d: str) -> DataFrame:
    turns = _turns(spark, d)
    return hierarchy.with_children(turns.where("role = 'user'"), turns)


def ancestor_chain(spark: SparkSession, d: str) -> DataFrame:
    turns = _turns(spark, d)
    last = turns.join(turns.select(F.col("parent_id").alias("id")), "id", "left_anti")
    return hierarchy.ancestors(last, turns)


def topk_offset_overfetch(spark: SparkSession, d: str) -> DataFrame:
    turns = _turns(spark, d)
    page = turns.orderBy(F.col("conv_id").asc(), F.col("turn").asc()).offset(10).limit(20)
    return hierarchy.page_without_parents(page, 10, F.col("conv_id").asc(), F.col("turn").asc()).select("id", "conv_id", "turn")


def longest_prefix_parent(spark: SparkSession, d: str) -> DataFrame:
    urls = load(spark, d, "pages").select("page_id", "url")
    owners = urls.select(F.regexp_replace("url", "/[^/]*$", "").alias("owner")).union(urls.select(F.regexp_extract("url", "^([a-z]+://[^/]+)", 1))).distinct()
    return hierarchy.longest_prefix(urls, owners, "url", "owner", separator="/").select("page_id", "owner")


def lru_trim(spark: SparkSession, d: str) -> DataFrame:
    last = load(spark, d, "events").groupBy("event_type", "user_id").agg(F.max("ts").alias("last"))
    return tables.newest(last, 50, "last", ["event_type"], "user_id", batch=5).select("event_type", "user_id")


def cache_hit_miss(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "lang", F.sha2("text", 256).alias("hash"))
    stored = docs.where("lang <> 'en'").select("hash", F.col("doc_id").alias("vector"))
    probed = tables.reused(docs, stored, ["hash"], "vector")
    return probed.select("doc_id", F.col("vector").isNotNull().alias("hit"), F.coalesce("vector", F.lit(-1)).alias("vector"))


def change_detection(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files of two listings: one language is new, another is gone, one was rewritten, one only touched."""
    docs = load(spark, d, "documents").select("lang", F.col("doc_id").cast("string").alias("path"), F.col("n_chars").cast("double").alias("mtime"), F.md5(F.coalesce("text", F.lit(""))).alias("hash"))
    moved = F.when(F.col("lang").isin("fr", "de"), F.col("mtime") - 1).otherwise(F.col("mtime"))
    stored = docs.where("lang <> 'es'").select("path", moved.alias("mtime"), F.when(F.col("lang") == "fr", "old").otherwise(F.col("hash")).alias("hash"))
    return tables.changed_files(stored, docs.where("lang <> 'en' OR mtime > 300"))


def upsert_snapshot(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    fresh = o.where("o_orderstatus = 'P'").select((F.col("o_orderkey") + F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(100000000)).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), "o_totalprice")
    return tables.upserted(o.drop("o_orderpriority"), fresh, ["o_orderkey"])


def patch_rows(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer")
    patch = c.where("c_mktsegment = 'BUILDING'").select("c_custkey", F.when(F.col("c_acctbal") < 0, "PATCHED").alias("c_mktsegment"))
    return tables.patched(c.select("c_custkey", "c_name", "c_mktsegment"), patch, "c_custkey")


def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part")
    return tables.insert_ignore(p.where("p_size <= 25").select("p_partkey", "p_brand"), p.where("p_brand LIKE 'Brand#1%'").select("p_partkey"), ["p_partkey"])


def stale_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", "source", "lang")
    return tables.without(docs, docs.where("lang = 'en'"), ["doc_id"])


def import_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Customers as imports, by virtual or physical path, and nations as packages."""
    nation = F.col("c_nationkey").cast("string")
    virtual = F.when(F.col("c_mktsegment") != "BUILDING", F.concat(F.lit("v."), nation)).alias("virtual_path")
    physical = F.when(F.col("c_acctbal") > 0, F.concat(F.lit("p/"), nation)).alias("physical_path")
    imports = load(spark, d, "customer").select("c_custkey", F.lit("main").alias("repo"), virtual, physical, (F.col("c_mktsegment") == "MACHINERY").alias("external"))
    packages = load(spark, d, "nation").select(F.lit("main").alias("repo"), F.when(F.col("n_regionkey") < 3, F.concat(F.lit("v."), F.col("n_nationkey").cast("string"))).alias("virtual_path"), F.concat(F.lit("p/"), F.col("n_nationkey").cast("string")).alias("package_path"))
    return repo.resolved_imports(imports, packages).select("c_custkey", "to_package")


def method_adoption(spark: SparkSession, d: str) -> DataFrame:
    """Nations as classes of their region's folder, customers as methods that may belong to one there."""
    n = load(spark, d, "nation")
    classes = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/types.go")).alias("path"), F.lit("class").alias("kind"), F.lit(None).cast("string").alias("parent_id"), F.col("n_name").alias("fqn"))
    c = load(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    folder = F.when(F.col("c_mktsegment") == "FURNITURE", F.lit("elsewhere")).otherwise(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")))
    methods = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.concat(folder, F.lit("/use.go")).alias("path"), F.lit("method").alias("kind"), F.when(F.col("c_acctbal") < 0, F.lit("known")).alias("parent_id"), F.concat_ws(".", "n_name", "c_mktsegment", "c_name").alias("fqn"))
    nodes = classes.unionByName(methods).withColumn("repo", F.lit("main"))
    return repo.adopted(nodes).select("id", "parent_id")


def reference_resolution(spark: SparkSession, d: str) -> DataFrame:
    refs = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit("main").alias("repo"), F.concat(F.lit("v."), F.col("l_suppkey").cast("string")).alias("to_package"))
    packages = load(spark, d, "supplier").where("s_acctbal > 0").select(F.lit("main").alias("repo"), F.concat(F.lit("v."), F.col("s_suppkey").cast("string")).alias("virtual_path"), F.concat(F.lit("n/"), F.col("s_nationkey").cast("string")).alias("package_path"))
    return repo.resolved_refs(refs, packages).select("l_orderkey", "l_linenumber", "package_path")


def bm25_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """The same as bm25_topk from an inverted index that was built without one language and then refreshed with it."""
    docs = load(spark, d, "documents").select("doc_id", "lang", "text")
    index = search.TextIndex(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    index.build(docs.where("lang <> 'en' OR lang IS NULL")).refresh(docs.where("lang = 'en'"))
    return index.scores(SEARCH_TEXT).orderBy(F.col("bm25").desc(), F.col("doc_id").asc()).limit(20)


def search_boosted(spark: SparkSession, d: str) -> DataFrame:
    """Hits by the boost that is stored with them, and of one kind only."""
    docs = load(spark, d, "documents").withColumn("kind", F.when(F.col("lang") == "en", "method").otherwise("class")).withColumn("search_boost", F.when(F.col("source") == "src1", 1.8))
    return search.search(docs, search.SearchRequest(text=SEARCH_TEXT, kind="METHOD", limit=10)).select("doc_id", "source", "rrf")


def children_without_literals(spark: SparkSession, d: str) -> DataFrame:
    turns = _turns(spark, d).withColumn("kind", F.when(F.col("role") == "assistant", "literal").otherwise("method"))
    return hierarchy.with_children(turns, turns, kind_col="kind")


def ancestors_below_literals(spark: SparkSession, d: str) -> DataFrame:
    """Ancestors up to the first one that is a literal."""
    turns = _turns(spark, d).withColumn("kind", F.when(F.col("turn") == 2, "literal").otherwise("method"))
    return hierarchy.ancestors(turns, turns, kind_col="kind")


def chunk_tiling(spark: SparkSession, d: str) -> DataFrame:
    """What chunks of every text make up together: its characters, without gap or overlap, and the text itself. Rows are told apart by their place, as identifiers may recur."""
    docs = load(spark, d, "documents").withColumn("row", F.monotonically_increasing_id())
    chunks = chunking.chunked(docs, most=64, least=8, beside=("row",))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk"))), lambda x: x["chunk"]), "")
    return chunks.groupBy("row", "doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("n_chars"), F.md5(joined).alias("digest"), (F.max("chunk_no") + 1 == F.count("*")).alias("numbered")).drop("row")


def vectors_of_a_width(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings").select("vec_id", fitted(F.col("embedding"), 100).alias("long"), fitted(F.col("embedding"), 5).alias("short"))
    return e.select("vec_id", F.size("long").alias("n_long"), F.size("short").alias("n_short"), F.round(F.col("short")[4].cast("double"), 6).alias("fifth"), F.round(F.col("long")[99].cast("double"), 6).alias("last"))


def module_paths(spark: SparkSession, d: str) -> DataFrame:
    """Import name, language and visibility of paths made of pages."""
    path = F.concat(F.lit("pkg/"), F.regexp_replace("url", "[^a-z0-9]+", "_"), F.when(F.length("url") > 30, "/__init__.py").otherwise(".py"))
    p = load(spark, d, "pages").select("page_id", path.alias("path"))
    return p.select("page_id", X.dotted_module(F.col("path")).alias("module"), X.language_of(F.col("path"), {".py": "python", ".go": "go"}).alias("language"), X.go_visibility(X.basename(F.col("path"))).alias("visibility"))


def suffix_stats(spark: SparkSession, d: str) -> DataFrame:
    found = tables.suffix_stats(load(spark, d, "events"), "event_type", "value")
    return found.select("event_type", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"))


def sliding_token_windows(spark: SparkSession, d: str) -> DataFrame:
    found = chunking.token_windows(load(spark, d, "documents"))
    return found.select("doc_id", "window_no", "start", "n", F.md5("body").alias("digest"))


def mean_pool_vectors(spark: SparkSession, d: str) -> DataFrame:
    return chunking.mean_pooled(load(spark, d, "embeddings"), "label", "embedding").select("label", "at", F.round("mean", 6).alias("mean"))


def name_properties(spark: SparkSession, d: str) -> DataFrame:
    names = load(spark, d, "part").select("p_partkey", F.concat(F.when(F.col("p_partkey") % 3 == 0, "__").when(F.col("p_partkey") % 3 == 1, "_").otherwise(""), F.regexp_replace(F.initcap("p_name"), " ", ""), F.when(F.col("p_partkey") % 6 == 0, "__").otherwise("")).alias("name"))
    return names.select("p_partkey", X.descriptiveness(F.col("name")).alias("descriptiveness"), X.python_visibility(F.col("name")).alias("visibility"), X.is_constant_name(F.col("name")).alias("is_constant"))


def vector_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of each vector to its label's first one."""
    e = load(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("head"))
    return e.join(first, "label").select("vec_id", F.round(cosine(F.col("embedding"), F.col("head")), 6).alias("similarity"))


def chunk_recursive(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunked(load(spark, d, "documents"))


def html_section_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Sections of pages by their headings: number, level, title, parent."""
    pages = load(spark, d, "pages").where("html IS NOT NULL")
    heads = F.regexp_extract_all("html", F.lit(r"(?is)(<h[1-6][^>]*>.*?</h[1-6]>)"), F.lit(1))
    rows = pages.select("page_id", F.posexplode(heads).alias("at", "head")).withColumn("level", F.regexp_extract("head", r"(?i)^<h([1-6])", 1).cast("int"))
    title = F.trim(F.regexp_replace(F.regexp_replace("head", r"(?is)<[^>]*>", ""), r"\s+", " "))
    before = Window.partitionBy("page_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    above = F.lit(None).cast("int")
    for level in range(2, 7):
        above = F.when(F.col("level") == level, F.max(F.when(F.col("level") < level, F.col("at"))).over(before)).otherwise(above)
    return rows.select("page_id", "at", "level", title.alias("title"), above.alias("parent_at"))


QUERIES = {
    f.__name__: f
    for f in (
        full_scan, scan_filter_project, point_lookup, multi_lookup, equality_filters, name_ignoring_case, in_subquery_semi, not_in_anti, left_join_null_fill, tri_state_null, fullouter_diff,
        code_tokens, word_tokens_stopwords, trigram_index, filename_complete, glob_list, virtual_paths, collect_defs_refs, edge_weights, pagerank_uniform, pagerank_seeded, prompt_mining, token_budget_prefix,
        fts_needle_weights, bm25_topk, bm25_rank, cosine_topk, hybrid_search_rrf, rrf_repo_boost, search_unranked, hierarchy_children, ancestor_chain, topk_offset_overfetch, longest_prefix_parent,
        lru_trim, cache_hit_miss, change_detection, upsert_snapshot, patch_rows, insert_ignore, stale_rows, import_resolution, method_adoption, reference_resolution, bm25_index_topk, search_boosted, children_without_literals, ancestors_below_literals, chunk_tiling, vectors_of_a_width, module_paths, suffix_stats, sliding_token_windows, mean_pool_vectors, name_properties, vector_pairs,
        chunk_recursive, html_section_nodes,
    )
}
