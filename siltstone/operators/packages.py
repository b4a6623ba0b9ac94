"""Versions, items and implementors of source packages."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import glob_pattern

#: Into so many pieces the impls of one trait name are split.
PIECES = 8

_SEMVER = r"^(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"


def version_key(v: Column | str) -> Column:
    """Sortable struct of a version; a pre-release precedes its release. Null if it is none."""
    c = F.col(v) if isinstance(v, str) else v
    pre = F.regexp_extract(c, _SEMVER, 4)
    ids = F.transform(
        F.split(pre, r"\."),
        lambda x: F.struct((~x.rlike(r"^\d+$")).cast("int").alias("alpha"), F.coalesce(x.try_cast("bigint"), F.lit(0)).alias("num"), x.alias("txt")),
    )
    num = [F.regexp_extract(c, _SEMVER, i).try_cast("bigint").alias(n) for i, n in ((1, "major"), (2, "minor"), (3, "patch"))]
    return F.when(c.rlike(_SEMVER), F.struct(*num, (pre == "").cast("int").alias("stable"), ids.alias("pre")))


def latest(versions: DataFrame) -> DataFrame:
    """name, num: the highest version of each name that is neither yanked nor a pre-release."""
    k = version_key("num")
    ok = versions.where(~F.coalesce("yanked", F.lit(False))).withColumn("k", k).where("k IS NOT NULL AND k.stable = 1")
    return ok.groupBy("name").agg(F.max_by("num", "k").alias("num"))


def exact(versions: DataFrame, num: str) -> DataFrame:
    """name, num of that very version, yanked or not."""
    return versions.where(F.col("num") == num).select("name", "num").distinct()


def _bounds(req: str) -> Column:
    """Condition on the struct `k` for one comparator of a version requirement."""
    m = re.fullmatch(r"\s*(\^|~|>=|<=|>|<|=)?\s*v?(\d+|\*|x)(?:\.(\d+|\*|x))?(?:\.(\d+|\*|x))?(?:-([0-9A-Za-z.-]+))?\s*", req)
    if not m:
        raise ValueError(f"not a version requirement: {req!r}")
    op = m[1] or "^"
    given = [int(x) for x in m.groups()[1:4] if x is not None and x.isdigit()]
    parts = F.array(F.col("k.major"), F.col("k.minor"), F.col("k.patch"))

    def vec(p: list[int]) -> Column:
        return F.array(*[F.lit(x).cast("bigint") for x in (p + [0, 0, 0])[:3]])

    if not given:
        return F.lit(True)
    low = vec(given)
    after = {1: [given[0] + 1], 2: [given[0], (given + [0])[1] + 1], 3: [given[0], (given + [0])[1], (given + [0, 0])[2] + 1]}[len(given)]
    if op == "=" or (op == "^" and "*" in req):
        return (parts >= low) & (parts < vec(after))
    if op == "^":
        i = next((n for n, x in enumerate(given) if x), len(given) - 1)
        return (parts >= low) & (parts < vec(given[:i] + [given[i] + 1]))
    if op == "~":
        return (parts >= low) & (parts < vec([given[0], given[1] + 1] if len(given) > 1 else [given[0] + 1]))
    return {">=": parts >= low, "<": parts < low, ">": parts >= vec(after) if len(given) < 3 else parts > low, "<=": parts < vec(after) if len(given) < 3 else parts <= low}[op]


def satisfying(versions: DataFrame, requirement: str) -> DataFrame:
    """name, num: the highest version, not yanked, that meets a requirement such as `^1.2, <1.5`."""
    cond = F.lit(True)
    for part in requirement.split(","):
        cond = cond & _bounds(part)
    ok = versions.where(~F.coalesce("yanked", F.lit(False))).withColumn("k", version_key("num")).where("k IS NOT NULL AND k.stable = 1").where(cond)
    return ok.groupBy("name").agg(F.max_by("num", "k").alias("num"))


@dataclass(frozen=True)
class PackageRef:
    """A package with its version: `latest`, a full version or a requirement."""

    name: str
    spec: str

    @staticmethod
    def parse(text: str) -> "PackageRef":
        name, at, version = text.partition("@")
        if not name or "@" in version or any(c.isspace() for c in name) or (at and not version):
            raise ValueError(f"not a package reference: {text!r}")
        return PackageRef(name, "latest" if version in ("", "latest", "*") else version)


def resolve(versions: DataFrame, ref: PackageRef) -> DataFrame:
    own = versions.where(F.col("name") == ref.name)
    if ref.spec == "latest":
        return latest(own)
    return exact(own, ref.spec) if re.match(_SEMVER, ref.spec) else satisfying(own, ref.spec)


def sync_plan(packages: DataFrame, cached: DataFrame, exclude: list[str], force: bool = False) -> DataFrame:
    """name, version, action: `queued`, `excluded` (by globs on name or name@version) or `cached`."""
    full = F.concat_ws("@", "name", "version")
    out = F.lit(False)
    for g in exclude:
        out = out | F.col("name").rlike(glob_pattern(g)) | full.rlike(glob_pattern(g))
    have = cached.select("name", "version", F.lit(True).alias("have")).distinct()
    action = F.when(out, "excluded").when(F.col("have").isNotNull() & F.lit(not force), "cached").otherwise("queued")
    return packages.join(have, ["name", "version"], "left").select("name", "version", action.alias("action"))


def items(table: DataFrame, kind: str | None = None, prefix: str | None = None, visible: bool = False) -> DataFrame:
    """Items by kind and by module prefix, in the order of their paths; repeats once."""
    rows = table
    if kind:
        rows = rows.where(F.col("item_kind") == kind)
    if prefix:
        p = prefix.replace("-", "_").strip(":")
        rows = rows.where((F.col("qualified_path") == p) | F.col("qualified_path").startswith(p + "::"))
    if visible:
        rows = rows.where(F.col("visibility") == "pub")
    return rows.dropDuplicates(["item_id"]).orderBy("qualified_path", "item_id")


def lower_items(table: DataFrame) -> DataFrame:
    """Items as search documents: collection, path, title, body, metadata (JSON)."""
    nl = F.lit("\n")
    module = F.array_join(F.coalesce("module_path", F.array().cast("array<string>")), "::")
    where = F.concat_ws("", F.lit("source: "), "source_file", F.lit(":"), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"), nl)
    body = F.concat(
        F.concat_ws(" ", "item_kind", "qualified_path"), nl,
        F.concat_ws("", F.lit("crate: "), "crate_name", F.lit("@"), "crate_version", nl),
        F.when(module != "", F.concat(F.lit("module: "), module, nl)).otherwise(""),
        where, nl, F.coalesce("signature", F.lit("")),
        F.when(F.coalesce("doc_markdown", F.lit("")) != "", F.concat(F.lit("\n\n"), F.col("doc_markdown"))).otherwise(""),
        F.when((F.coalesce("body", F.lit("")) != "") & ~F.col("body").eqNullSafe(F.col("signature")), F.concat(F.lit("\n\n"), F.col("body"))).otherwise(""),
    )
    return table.select(
        "item_id",
        F.concat_ws("@", "crate_name", "crate_version").alias("collection"),
        F.concat_ws("", "source_file", F.lit("#L"), F.col("line_start").cast("string"), F.lit("-L"), F.col("line_end").cast("string")).alias("path"),
        F.col("qualified_path").alias("title"),
        body.alias("body"),
        F.to_json(F.struct(F.col("item_kind").alias("kind"), F.col("crate_name").alias("crate"), F.col("crate_version").alias("version"), "module_path")).alias("metadata"),
    )


def implementors(traits: DataFrame, impls: DataFrame) -> DataFrame:
    """trait_path, impl_signature: impls of a trait by its full path, else by its last segment.

    Impls of a common name are split into pieces, each of which meets all
    traits of the name, so no task holds a whole name.
    """
    last = F.element_at(F.split("trait_path", "::"), -1)
    full = traits.join(impls, "trait_path").select("trait_path", "impl_signature")
    t = traits.select("trait_path", last.alias("seg"), F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))).alias("piece"))
    i = impls.select(F.col("trait_path").alias("other"), last.alias("seg"), "impl_signature", F.pmod(F.xxhash64("impl_signature"), F.lit(PIECES)).cast("int").alias("piece"))
    return full.unionByName(t.join(i, ["seg", "piece"]).where("trait_path <> other").select("trait_path", "impl_signature"))


def merge_docs(items_: DataFrame, docs: DataFrame) -> DataFrame:
    """Items whose doc_markdown is replaced where `docs` (qualified_path, doc) has other, non-empty text."""
    new = docs.where("doc IS NOT NULL AND doc <> ''").dropDuplicates(["qualified_path"])
    out = [F.coalesce("doc", "doc_markdown").alias("doc_markdown") if c == "doc_markdown" else F.col(c) for c in items_.columns]
    return items_.join(new.select("qualified_path", "doc"), "qualified_path", "left").select(*out)


def evict(cached: DataFrame, name: str, requirement: str | None = None) -> DataFrame:
    """The cache without a package, or without its versions that meet a requirement."""
    mine = F.col("name") == name
    if requirement is None:
        return cached.where(~mine)
    cond = F.lit(True)
    for part in requirement.split(","):
        cond = cond & _bounds(part)
    return cached.withColumn("k", version_key("version")).where(~(mine & F.coalesce(F.col("k").isNotNull() & cond, F.lit(False)))).drop("k")


def stale(resolved: DataFrame, now: int, max_age: int) -> DataFrame:
    """Packages whose `latest` was resolved longer than max_age seconds ago."""
    return resolved.where((F.col("spec") == "latest") & (F.lit(now) - F.col("resolved_at") > max_age))


def implementors_block(found: DataFrame) -> DataFrame:
    """trait_path, block: the Markdown list of a trait's implementors."""
    line = F.concat(F.lit("- `"), "impl_signature", F.lit("`"))
    rows = found.select("trait_path", line.alias("line")).groupBy("trait_path").agg(F.array_join(F.array_sort(F.collect_set("line")), "\n").alias("lines"))
    return rows.select("trait_path", F.concat(F.lit("# Implementors\n\n"), "lines", F.lit("\n")).alias("block"))
