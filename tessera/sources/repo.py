"""Repositories as tables: listing, change detection, parsing, and resolution."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.functions.text import auto_tokens, language_of, weighted_needle
from tessera.lang import SUFFIXES, parse
from tessera.operators import hierarchy, tables
from tessera.session import stored
from tessera.sources.ignore import IgnoreRules

#: What tools leave behind, version control first.
IGNORED_FOLDERS = ["CVS", ".bzr", ".git", ".hg", ".svn", ".cache", ".eggs", ".gradle", ".idea", ".mypy_cache", ".nox", ".pytest_cache", ".ruff_cache", ".tox", ".venv", ".vscode", "__pycache__", "bower_components", "build", "dist", "node_modules", "target", "venv"]
#: Bytes of files that one task reads.
TASK_BYTES = 32 << 20
KIND_BOOSTS = {"function": 2.0, "method": 1.8, "class": 1.5, "literal": 0.6}
FIELD_WEIGHTS = {"name": 3, "file_path": 2, "body": 1, "docstring": 1, "fqn": 1}


NODES = (
    "id string, repo string, path string, ordinal int, parent_id string, name string, fqn string, kind string, subtype string, visibility string, exported boolean, modifiers array<string>, "
    "signature string, parameters array<struct<name:string,type:string,default:string>>, return_type string, decorators array<string>, docstring string, comment string, body string, "
    "start_line int, end_line int, start_byte int, end_byte int"
)
IMPORTS = "repo string, path string, ordinal int, from_package string, raw string, virtual_path string, physical_path string, alias string, dot boolean, external boolean"
REFS = "repo string, path string, ordinal int, name string, raw string, type string, to_package string"


PACKAGES = "repo string, path string, virtual_path string, package_path string"


def parsed_schema() -> T.StructType:
    """A file with all that is found in it; needs a session."""
    lists = [T.StructField(name, T.ArrayType(T.StructType.fromDDL(ddl))) for name, ddl in (("nodes", NODES), ("imports", IMPORTS), ("refs", REFS))]
    return T.StructType([T.StructField("path", T.StringType()), T.StructField("package", T.StringType()), *lists])


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's view of a folder, and its path there."""
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if uri.startswith("s3a://") else uri)


def walked(root: str, ignored_folders: list[str] = IGNORED_FOLDERS) -> tuple[list[tuple[str, float, int]], list[tuple[str, str]]]:
    """(path, mtime, size) of every file below the root, whatever its name, and (folder, content) of the ignore files; ignored folders aren't entered."""
    fs, top = filesystem(root)
    files, rules, todo = [], [], [""]
    for folder in todo:
        for info in sorted(fs.get_file_info(pafs.FileSelector(f"{top}/{folder}" if folder else top)), key=lambda x: x.base_name):
            path = f"{folder}/{info.base_name}" if folder else info.base_name
            if info.type == pafs.FileType.Directory:
                if info.base_name not in ignored_folders:
                    todo.append(path)
            elif info.type == pafs.FileType.File:
                files.append((path, info.mtime_ns / 1e9, info.size))
                if info.base_name == ".gitignore":
                    with fs.open_input_stream(info.path) as source:
                        rules.append((folder, source.readall().decode("utf-8", "replace")))
    return files, rules


def listed(spark: SparkSession, root: str, paths: list[str] | None = None, ignored_folders: list[str] = IGNORED_FOLDERS) -> DataFrame:
    """(path, mtime, size) of the files that aren't ignored, those whose names begin with a dot or an underscore as well.

    The tree is listed on the driver, where the rules of its ignore files are
    applied; contents are read by tasks, see `with_content`. `paths` restricts
    the listing to those files.
    """
    files, found = walked(root, ignored_folders)
    rules = IgnoreRules(found)
    wanted = None if paths is None else set(paths)
    kept = [f for f in files if (wanted is None or f[0] in wanted) and not rules.ignored(f[0])]
    return spark.createDataFrame(kept, "path string, mtime double, size long")


def with_content(files: DataFrame, root: str) -> DataFrame:
    """files (path, ...) with content, read by as many tasks as their bytes ask for. Files that have gone since have null."""
    total = files.agg(F.sum("size")).first()[0] or 0
    schema = T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = filesystem(root)
        for b in batches:
            for k in range(b.num_rows):  # a file each, they may be long
                try:
                    with fs.open_input_stream(f"{top}/{b.column('path')[k].as_py()}") as source:
                        content = source.readall()
                except FileNotFoundError:
                    content = None
                yield pa.RecordBatch.from_arrays([*b.slice(k, 1).columns, pa.array([content], pa.binary())], [*b.schema.names, "content"])

    return files.repartition(max(1, -(-total // TASK_BYTES)), "path").mapInArrow(run, schema)


def snapshot(files: DataFrame, suffixes: dict[str, str] = SUFFIXES) -> DataFrame:
    """(path, mtime, hash, language) of listed files."""
    return files.select("path", "mtime", F.sha2("content", 256).alias("hash"), language_of(F.col("path"), suffixes).alias("language"))


def parsed(files: DataFrame, repo: str = "main") -> dict[str, DataFrame]:
    """Nodes, imports, refs and packages of files (path, content). Each file is parsed once; the tables are views of one stored result.

    Identifiers follow from repository, path and place, so a second run gives the same ones.
    """
    some = files.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(sorted(SUFFIXES))).where("content IS NOT NULL").select("path", "content")
    schema = parsed_schema()
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist([_rows_of(repo, path, content)], schema=arrow)

    once = stored(some.mapInArrow(run, schema), "parsed")
    out = {kind: once.select(F.explode(kind).alias("r")).select("r.*") for kind in ("nodes", "imports", "refs")}
    # a package is found by the name that imports give it, and by its folder, or its file without suffix
    package = once.where("package IS NOT NULL").select(F.lit(repo).alias("repo"), "path", F.col("package").alias("virtual_path"), F.regexp_replace("path", r"(/__init__)?\.[^./]+$", "").alias("own"), F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"))
    named_by_file = F.col("path").rlike(r"\.py$")
    out["packages"] = package.select("repo", "path", "virtual_path", F.when(named_by_file, F.col("own")).otherwise(F.col("folder")).alias("package_path"))
    return out


def _rows_of(repo: str, path: str, content: bytes) -> dict:
    import hashlib

    result = parse(path, content)
    ids = [hashlib.sha256(f"{repo}\0{path}\0{k}\0{n.start_byte}\0{n.kind}\0{n.name}".encode()).hexdigest()[:32] for k, n in enumerate(result.nodes)]
    nodes = []
    for k, n in enumerate(result.nodes):
        row = asdict(n)
        parent = row.pop("parent")
        row["parameters"] = [{"name": p.get("name"), "type": p.get("type"), "default": p.get("default")} for p in n.parameters]
        nodes.append({**row, "id": ids[k], "repo": repo, "path": path, "ordinal": k, "parent_id": None if parent is None else ids[parent]})
    imports = [{**asdict(i), "repo": repo, "path": path, "ordinal": k, "from_package": result.package} for k, i in enumerate(result.imports)]
    refs = [{**asdict(r), "repo": repo, "path": path, "ordinal": k} for k, r in enumerate(result.refs)]
    return {"path": path, "package": result.package, "nodes": nodes, "imports": imports, "refs": refs}


def with_search_columns(nodes: DataFrame, boosts: dict[str, float] = KIND_BOOSTS, weights: dict[str, int] = FIELD_WEIGHTS) -> DataFrame:
    """nodes with fts_needle, without the words of their language's syntax, and search_boost. A signature takes the place of the name."""
    source = {"name": F.coalesce("signature", "name"), "file_path": F.col("path"), "body": F.col("body"), "docstring": F.col("docstring"), "fqn": F.col("fqn")}
    boost = F.lit(1.0)
    for kind, by in boosts.items():
        boost = F.when(F.col("kind") == kind, F.lit(by)).otherwise(boost)
    language = language_of(F.col("path"), SUFFIXES)
    return nodes.withColumn("fts_needle", weighted_needle([(source[k], n) for k, n in weights.items()], lambda c, _: auto_tokens(c, language))).withColumn("search_boost", boost)


def go_modules(files: DataFrame, repo: str = "main") -> DataFrame:
    """(repo, path, module) of the go.mod files among files (path, content)."""
    text = F.decode("content", "UTF-8")
    found = files.where(F.col("path").rlike("(^|/)go\\.mod$")).select(F.lit(repo).alias("repo"), "path", F.regexp_extract(text, r"(?m)^\s*module\s+(\S+)", 1).alias("module"))
    return found.where("module <> ''")


def within_modules(packages: DataFrame, modules: DataFrame) -> DataFrame:
    """packages in which a Go package's virtual path is that of the nearest module above it and the folders between."""
    folder = lambda path: F.concat(F.lit("./"), F.regexp_replace(path, "[^/]*$", ""))
    above = modules.groupBy("repo", folder(F.col("path")).alias("_root")).agg(F.min("module").alias("_module")).withColumn("_owner", F.regexp_replace("_root", "/$", ""))
    go = F.col("path").rlike("\\.go$")
    placed = packages.withColumn("_folder", folder(F.col("path")))
    names = placed.where(go).select("repo", "_folder").distinct()
    found = hierarchy.longest_prefix(names, above, "_folder", "_owner", "/", ["repo"]).join(above, ["repo", "_owner"]).select("repo", "_folder", "_root", "_module")
    inner = F.regexp_replace(F.expr("substring(_folder, length(_root) + 1)"), "/$", "")
    name = F.when(inner == "", F.col("_module")).otherwise(F.concat("_module", F.lit("/"), inner))
    joined = placed.join(found, ["repo", "_folder"], "left")
    return joined.withColumn("virtual_path", F.when(go & F.col("_module").isNotNull(), name).otherwise(F.col("virtual_path"))).select(*packages.columns)


def resolved_imports(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """imports with to_package: by virtual path, else by physical path if not external. packages: (repo, virtual_path, package_path)."""
    by_virtual = packages.groupBy("repo", "virtual_path").agg(F.min("package_path").alias("_v"))
    by_path = packages.groupBy("repo", F.col("package_path").alias("physical_path")).agg(F.min("package_path").alias("_p"))
    joined = imports.join(by_virtual, ["repo", "virtual_path"], "left").join(by_path, ["repo", "physical_path"], "left")
    return joined.withColumn("to_package", F.coalesce("_v", F.when(~F.col("external"), F.col("_p")))).drop("_v", "_p")


def resolved_refs(refs: DataFrame, packages: DataFrame) -> DataFrame:
    """refs with package_path: the package that the name they are bound to leads to, if it is in the repository."""
    by_name = packages.groupBy("repo", F.col("virtual_path").alias("to_package")).agg(F.min("package_path").alias("package_path"))
    return refs.join(by_name, ["repo", "to_package"], "left")


def adopted(nodes: DataFrame) -> DataFrame:
    """nodes in which methods without a parent have the class or interface of their package whose qualified name is the longest prefix of theirs."""
    package = F.regexp_extract("path", "^(.*/)?[^/]*$", 1)
    placed = nodes.withColumn("_package", package)
    owners = placed.where(F.col("kind").isin("class", "interface") & F.col("fqn").isNotNull()).groupBy("repo", "_package", F.col("fqn").alias("_owner")).agg(F.min("id").alias("_owner_id"))
    orphans = placed.where((F.col("kind") == "method") & F.col("parent_id").isNull() & F.col("fqn").isNotNull())
    found = hierarchy.longest_prefix(orphans.select("repo", "_package", "fqn").distinct(), owners, "fqn", "_owner", ".", ["repo", "_package"])
    found = found.join(owners, ["repo", "_package", "_owner"]).select("repo", "_package", "fqn", "_owner_id")
    lost = (F.col("kind") == "method") & F.col("parent_id").isNull()
    joined = placed.join(found, ["repo", "_package", "fqn"], "left")
    return joined.withColumn("parent_id", F.when(lost, F.col("_owner_id")).otherwise(F.col("parent_id"))).select(*nodes.columns)


def ingest(spark: SparkSession, root: str, catalog: tables.Catalog, repo: str = "main", paths: list[str] | None = None) -> dict[str, int]:
    """Bring the catalog's files, nodes, imports, refs, packages and modules up to date with the tree; only new and changed files are parsed. `changes` names them.

    Methods find their class, and imports and references their package, over the
    whole repository, as either may be in a file that didn't change. All tables
    are published together. Files that are gone are removed on a full scan, not
    if `paths` is given.
    """
    found = with_content(listed(spark, root, paths), root)
    now = stored(snapshot(found).withColumn("repo", F.lit(repo)), "snapshot")
    have = catalog.versions("files")
    before = catalog.read("files") if have else now.limit(0)
    change = tables.changed_files(before.where(F.col("repo") == repo), now)
    if paths is not None:
        change = change.where("change <> 'gone'")
    change = stored(change, "change")
    counts = {r["change"]: r["count"] for r in change.groupBy("change").count().collect()}
    redo = change.where(F.col("change").isin("new", "changed")).select("path")
    gone = change.where(F.col("change").isin("new", "changed", "gone")).select("path", F.lit(repo).alias("repo"))
    again = with_content(listed(spark, root, paths).join(redo, "path", "left_semi"), root)
    fresh = parsed(again, repo)
    fresh["modules"] = go_modules(again, repo)
    fresh["nodes"] = with_search_columns(fresh["nodes"])
    fresh["files"] = now.join(redo, "path", "left_semi")
    whole = {}
    for name, table in fresh.items():
        old = tables.without(catalog.read(name).select(*table.columns), gone, ["path", "repo"]) if have else None
        whole[name] = table if old is None else old.unionByName(table)
    whole["nodes"] = adopted(whole["nodes"])
    packages = stored(within_modules(whole["packages"], whole["modules"]), "packages")
    imports = resolved_imports(whole["imports"], packages)
    whole["imports_resolved"] = imports.withColumn("external", F.col("external") & F.col("to_package").isNull())
    whole["refs_resolved"] = resolved_refs(whole["refs"], packages)
    whole["packages_resolved"] = packages
    whole["changes"] = change.where("change <> 'same'").withColumn("repo", F.lit(repo))
    catalog.publish(whole)
    return counts
