"""Lexical index and BM25 search over any number of fields."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.stemmer import stem, stemmed
from ..functions.text import tokens
from ..runtime import materialize

K1 = 1.2
B = 0.75
TITLE_BOOST = 2.0
TOP_LIMIT = 1000
FUZZY_LEAST = 3


@dataclass
class LexicalIndex:
    """rows: doc, field, len, term of every token, unstemmed (len: of the doc's field). lengths: field, doc, len. fields: field, n_docs, avg_len. vocabulary: term, stem."""

    rows: DataFrame
    lengths: DataFrame
    fields: DataFrame
    vocabulary: DataFrame | None

    @property
    def stemmed(self) -> bool:
        return self.vocabulary is not None

    @property
    def postings(self) -> DataFrame:
        """field, term, doc, tf with terms stemmed where the index is."""
        return self.matching(None).drop("len")

    @property
    def terms(self) -> DataFrame:
        """field, term, df."""
        return self.postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))

    def matching(self, wanted: list[str] | None) -> DataFrame:
        """Postings of the wanted terms; the choice is made before anything is shuffled."""
        rows, key = self.rows, F.col("term")
        if self.vocabulary is not None:
            # the few terms with a wanted stem are written first, so that their true size decides on the join
            vocab = self.vocabulary if wanted is None else materialize(self.vocabulary.where(F.col("stem").isin(wanted)), "stems")
            rows, key = rows.join(vocab, "term"), F.col("stem")
        elif wanted is not None:
            rows = rows.where(key.isin(wanted))
        return rows.groupBy("field", key.alias("term"), "doc", "len").agg(F.count(F.lit(1)).alias("tf"))


def _raw(docs: DataFrame, doc: str, fields: list[str]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("toks")) for f in fields]))
    rows = docs.select(F.col(doc).alias("doc"), each.alias("x"))
    return rows.select("doc", "x.field", F.size("x.toks").cast("bigint").alias("len"), F.explode("x.toks").alias("term"))


def postings(docs: DataFrame, doc: str, fields: list[str]) -> DataFrame:
    """field, term, doc, tf. Null texts hold no terms."""
    return _raw(docs, doc, fields).groupBy("field", "term", "doc").agg(F.count(F.lit(1)).alias("tf"))


def build(docs: DataFrame, doc: str, fields: list[str], stemming: bool = False) -> LexicalIndex:
    # lengths come from the texts themselves: no posting is shuffled for them
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.size(tokens(F.col(f))).cast("bigint").alias("len")) for f in fields]))
    lengths = docs.select(F.col(doc).alias("doc"), each.alias("x")).select("x.field", "doc", "x.len").where("len > 0")
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    stats = lengths.groupBy("field").agg(F.sum("len").alias("total")).join(F.broadcast(n), how="inner")  # a single row
    stats = stats.select("field", "n_docs", (F.col("total") / F.col("n_docs")).alias("avg_len"))
    vocabulary = _raw(docs, doc, fields).select("term").distinct().withColumn("stem", stemmed(F.col("term"))) if stemming else None
    return LexicalIndex(_raw(docs, doc, fields), lengths, stats, vocabulary)


BUCKETS = 64
POSTINGS = "bucket int, field string, term string, doc string, tf bigint, len bigint"
TERMS = "field string, term string, df bigint"
FIELDS = "field string, n_docs bigint, avg_len double"


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass
class StoredIndex:
    """An index kept as tables: postings by bucket of the term (POSTINGS), dictionary (TERMS) and field lengths (FIELDS).

    A search reads the buckets of its terms, in them the row groups that hold
    the terms, and no text.
    """

    stored: DataFrame
    terms: DataFrame
    fields: DataFrame
    stemmed: bool

    @property
    def postings(self) -> DataFrame:
        return self.stored.select("field", "term", "doc", "tf")

    @property
    def lengths(self) -> DataFrame:
        return self.stored.select("field", "doc", "len").distinct()

    def matching(self, wanted: list[str] | None) -> DataFrame:
        rows = self.stored
        if wanted is not None:
            rows = rows.where(F.col("bucket").isin([_bucket(F.lit(t)) for t in wanted]) & F.col("term").isin(wanted))
        return rows.select("field", "term", "doc", "len", "tf")


def stored_rows(docs: DataFrame, doc: str, fields: list[str], stemming: bool = False) -> DataFrame:
    """The postings of documents as a stored index keeps them."""
    idx = build(docs, doc, fields, stemming)
    return idx.matching(None).select(_bucket(F.col("term")).alias("bucket"), "field", "term", F.col("doc").cast("string").alias("doc"), "tf", "len")


def laid_out(stored: DataFrame) -> DataFrame:
    """Postings in the order they are written in: a few files per bucket, terms together."""
    part = F.pmod(F.xxhash64("term", F.lit(1)), F.lit(4))
    return stored.withColumn("_part", part).repartition("bucket", "_part").sortWithinPartitions("bucket", "field", "term").drop("_part")


def dictionary(stored: DataFrame) -> DataFrame:
    return stored.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


def field_stats(stored: DataFrame, docs: DataFrame) -> DataFrame:
    """docs: a row per document, those without terms included."""
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    total = stored.groupBy("field").agg(F.sum("tf").alias("total")).join(F.broadcast(n), how="inner")  # a single row
    return total.select("field", "n_docs", (F.col("total") / F.col("n_docs")).alias("avg_len"))


def save(docs: DataFrame, doc: str, fields: list[str], path: str, stemming: bool = False) -> None:
    """Write the index of documents under a folder; its description comes last, an index without it is none."""
    _save(stored_rows(docs, doc, fields, stemming), docs.select(F.col(doc).cast("string").alias("doc")), fields, path, stemming)


def _save(stored: DataFrame, docs: DataFrame, fields: list[str], path: str, stemming: bool) -> None:
    spark = docs.sparkSession
    laid_out(stored).write.partitionBy("bucket").parquet(f"{path}/postings")
    kept = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    docs.write.parquet(f"{path}/docs")
    dictionary(kept).write.parquet(f"{path}/terms")
    field_stats(kept, docs).write.parquet(f"{path}/fields")
    spark.createDataFrame([(stemming, fields)], "stemmed boolean, names array<string>").coalesce(1).write.parquet(f"{path}/about")


def load(spark: SparkSession, path: str) -> StoredIndex:
    about = spark.read.parquet(f"{path}/about").first()
    read = lambda name, kind: spark.read.schema(kind).parquet(f"{path}/{name}")
    return StoredIndex(read("postings", POSTINGS), read("terms", TERMS), read("fields", FIELDS), about["stemmed"])


def update(spark: SparkSession, old: str, new: str, docs: DataFrame, doc: str, gone: DataFrame) -> None:
    """The index at `old` without the documents of `gone` (doc) and with `docs` put in place of theirs, written to `new`.

    Only the texts of `docs` are read. A document that is both gone and given is kept as given.
    """
    about = spark.read.parquet(f"{old}/about").first()
    ids = docs.select(F.col(doc).cast("string").alias("doc")).distinct()
    out = gone.select(F.col("doc").cast("string").alias("doc")).unionByName(ids).distinct()
    was = load(spark, old).stored
    stored = was.join(out, "doc", "left_anti").select(*was.columns).unionByName(stored_rows(docs, doc, about["names"], about["stemmed"]))
    kept = spark.read.schema("doc string").parquet(f"{old}/docs").join(out, "doc", "left_anti").unionByName(ids)
    _save(stored, kept, about["names"], new, about["stemmed"])


def query_terms(query: str, stemming: bool = False) -> list[str]:
    """Analysed terms of a query in order; query syntax has no meaning."""
    import regex

    words = [w for w in regex.findall(r"[\p{L}\p{N}]+", query.lower()) if len(w.encode()) < 40]
    return [stem(w) for w in words] if stemming else words


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two strings differ by at most one edit, a swap of neighbours counting as one."""
    swap = F.exists(
        F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))),
        lambda i: F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2)) == b,
    )
    return (F.levenshtein(a, b, 1) >= 0) | ((F.length(a) >= 2) & (F.length(a) == F.length(b)) & swap)


def fuzzy_terms(index: LexicalIndex | StoredIndex, wanted: list[str], field: str = "body") -> DataFrame:
    """asked, term: dictionary terms within one edit of a query term of three bytes or more.

    The query is a handful of literals, so the dictionary is scanned once with
    a length band before the edit distance, without a join.
    """
    long = sorted({t for t in wanted if len(t.encode()) >= FUZZY_LEAST})
    if not long:
        return index.terms.where("false").select(F.col("term").alias("asked"), "term")
    asked = F.explode(F.array(*[F.lit(t) for t in long]))
    rows = index.terms.where(F.col("field") == field).select(asked.alias("asked"), "term")
    near = F.abs(F.length("asked") - F.length("term")) <= 1
    return rows.where(near).where(within_one_edit(F.col("asked"), F.col("term")))


def bm25(index: LexicalIndex | StoredIndex, query: str, boosts: dict[str, float] | None = None, fuzzy: bool = False, only: DataFrame | None = None) -> DataFrame:
    """doc, score: the sum over query terms and fields of BM25 times the field's boost.

    A repeated query term counts as often as it is given. With fuzzy each
    further dictionary term within one edit adds the constant 1. only: the
    documents (doc) to be scored; frequencies are those of all documents.
    """
    wanted = query_terms(query, index.stemmed)
    boosts = boosts or {}
    if not wanted:
        return index.lengths.where("false").select("doc", F.lit(0.0).alias("score"))
    counts = {t: wanted.count(t) for t in wanted}
    weight = F.create_map(*[x for t, n in counts.items() for x in (F.lit(t), F.lit(float(n)))])
    boost = F.coalesce(*[F.when(F.col("field") == f, F.lit(float(b))) for f, b in boosts.items()], F.lit(1.0))
    hit = materialize(index.matching(list(counts)), "hits")  # read for document frequencies and for scores
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    own = (lambda rows: rows) if only is None else (lambda rows: rows.join(only.select("doc"), "doc", "left_semi"))
    part = (
        own(hit).join(hit.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df")), ["field", "term"])
        .join(index.fields, "field")
        .select("doc", (weight[F.col("term")] * boost * idf * norm).alias("s"))
    )
    if fuzzy:
        # dictionary terms one edit from a handful of query terms: a bounded list, with which postings are pruned
        near = [tuple(r) for r in fuzzy_terms(index, wanted).select("asked", "term").distinct().collect()]
        if near:
            found = own(index.matching(sorted({t for _, t in near})).where(F.col("field") == "body"))
            pairs = found.sparkSession.createDataFrame(near, "asked string, term string")
            part = part.unionByName(found.join(F.broadcast(pairs), "term").select("doc", "asked").distinct().select("doc", F.lit(1.0).alias("s")))
    return part.groupBy("doc").agg(F.sum("s").alias("score"))


def top(scored: DataFrame, k: int, tie: str = "doc") -> DataFrame:
    """The k best rows, ties to the smaller id; the limit stays a top-k, not a sort."""
    return scored.orderBy(F.desc("score"), tie).limit(k)
