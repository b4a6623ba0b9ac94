"""Documents from folders, archives and lock files."""

from __future__ import annotations

import fnmatch
import io
import os
import re
import tarfile
import tomllib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import extension, strip_front_matter, title
from ..runtime import materialize

TEXT_KINDS = ("md", "txt")
KINDS = (*TEXT_KINDS, "pdf")


def _ignored(root: str) -> list[tuple[bool, str]]:
    """Patterns of the root's ignore file, only where the root is under version control."""
    path = os.path.join(root, ".gitignore")
    if not os.path.isdir(os.path.join(root, ".git")) or not os.path.exists(path):
        return []
    with open(path) as f:
        rules = [line.strip() for line in f if line.strip() and not line.startswith("#")]
    return [(r.startswith("!"), r.removeprefix("!").rstrip("/").removeprefix("/")) for r in rules]


def _regex(rule: str) -> str:
    body = fnmatch.translate(rule).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z").replace(".*", "[^/]*")
    return f"(^|/){body}(/|$)" if "/" not in rule else f"^{body}(/|$)"


def discover_files(spark: SparkSession, collection: str, root: str) -> DataFrame:
    """collection, path, absolute_path, mtime (s), n_bytes of the documents under a folder.

    Markdown, text and PDF files by extension in any case; hidden files and
    folders and, under version control, ignored ones are left out. Only names
    are listed; contents are read when asked for.
    """
    root = root.rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).drop("content")
    local = F.regexp_replace("path", r"^file:(//)?", "")
    base = re.sub(r"^file:(//)?", "", root)
    rel = F.substr(local, F.lit(len(base) + 2))
    found = rows.select(
        F.lit(collection).alias("collection"), rel.alias("path"), local.alias("absolute_path"),
        F.unix_timestamp("modificationTime").alias("mtime"), F.col("length").alias("n_bytes"),
    )
    found = found.where(extension("path").isin(*KINDS)).where(~F.col("path").rlike(r"(^|/)\."))
    gone = F.lit(False)
    for negated, rule in _ignored(base):
        hit = F.col("path").rlike(_regex(rule))
        gone = F.when(hit, F.lit(not negated)).otherwise(gone)
    return found.where(~gone)


def load_documents(spark: SparkSession, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, failures): contents as text; files that aren't valid UTF-8 or are PDF fail by themselves.

    PDF extraction needs a library this package doesn't bring; see `pdf_to_markdown`.
    """
    paths = [r[0] for r in files.select("absolute_path").toLocalIterator()]
    if not paths:
        empty = files.withColumn("text", F.lit(None).cast("string"))
        return empty, files.withColumn("error", F.lit(""))
    raw = spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", r"^file:(//)?", "").alias("absolute_path"), "content")
    both = files.join(raw, "absolute_path").withColumn("decoded", F.try_validate_utf8(F.col("content").cast("string")))
    pdf = extension("path") == "pdf"
    ok = both.where(F.col("decoded").isNotNull() & ~pdf).drop("content").withColumnRenamed("decoded", "text")
    error = F.when(pdf, "no PDF reader").otherwise("not valid UTF-8")
    return ok, both.where(F.col("decoded").isNull() | pdf).select(*files.columns, error.alias("error"))


def prepare(documents: DataFrame) -> DataFrame:
    """Add title and body (the text without front matter)."""
    return documents.withColumn("title", title("text", "path")).withColumn("body", strip_front_matter("text"))


def pdf_to_markdown(pages: list[str]) -> str:
    """Markdown of a PDF's page texts: pages apart by a blank line, a first line made the title if there is none."""
    text = "\n\n".join(p.strip() for p in pages if p.strip())
    if re.search(r"(?m)^# \S", text):
        return text
    m = re.search(r"(?m)^\s*(\S.*)$", text)
    return text if not m else f"{text[: m.start(1)]}# {m[1].lstrip('#').strip()}{text[m.end(1):]}"


def read_archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """archive, path, content of the files in gzipped tar archives, their top folder stripped.

    Links and members whose path is absolute or leads upwards are refused: the
    archive fails. So does one without files.
    """

    def run(batches):
        for b in batches:
            rows = []
            for name, raw in zip(b["path"], b["content"]):
                own = []
                with tarfile.open(fileobj=io.BytesIO(raw), mode="r:*") as tar:
                    for m in tar:
                        if m.isdir():
                            continue
                        parts = m.name.split("/")
                        if m.name.startswith("/") or ".." in parts or not m.isreg():
                            raise ValueError(f"{name}: unsafe member {m.name!r}")
                        if len(parts) > 1:
                            own.append((name, "/".join(parts[1:]), tar.extractfile(m).read()))
                if not own:
                    raise ValueError(f"{name}: no files")
                rows += own
            yield pd.DataFrame(rows, columns=["archive", "path", "content"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, "archive string, path string, content binary")


def module_files(sources: DataFrame, entry: str) -> DataFrame:
    """archive, path, module: files reached from an entry file over `mod name;` declarations, each once.

    Edges (file declares module) are found once; a frontier is then followed
    level by level until nothing new is reached.
    """
    decl = F.regexp_extract_all(F.col("content").cast("string"), F.lit(r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+([A-Za-z_]\w*)\s*;"), F.lit(1))
    folder = F.when(F.col("path").rlike(r"(^|/)(lib|main|mod)\.rs$"), F.regexp_replace("path", r"[^/]*$", "")).otherwise(
        F.concat(F.regexp_replace("path", r"\.rs$", ""), F.lit("/"))
    )
    edges = sources.select("archive", F.col("path").alias("from_path"), folder.alias("folder"), F.explode(decl).alias("name"))
    to = F.explode(F.array(F.concat("folder", "name", F.lit(".rs")), F.concat("folder", "name", F.lit("/mod.rs"))))
    edges = edges.select("archive", "from_path", "name", to.alias("path")).join(sources.select("archive", "path"), ["archive", "path"])
    reached = sources.where(F.col("path") == entry).select("archive", "path", F.array().cast("array<string>").alias("module"))
    frontier = reached
    while not frontier.isEmpty():
        step = frontier.select("archive", F.col("path").alias("from_path"), "module").join(edges, ["archive", "from_path"])
        frontier = step.select("archive", "path", F.concat("module", F.array("name")).alias("module")).join(reached, ["archive", "path"], "left_anti")
        frontier = materialize(frontier.dropDuplicates(["archive", "path"]), "modules")
        reached = reached.unionByName(frontier)
    return reached


def lock_packages(spark: SparkSession, text: str, registry: str = "registry+") -> DataFrame:
    """name, version of a lock file's packages that come from the default registry."""
    rows = [(p["name"], p["version"]) for p in tomllib.loads(text).get("package", []) if str(p.get("source", "")).startswith(registry)]
    return spark.createDataFrame(rows, "name string, version string").distinct()
