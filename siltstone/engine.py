"""The retrieval engine: collections of documents, their indexes, search and reading."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import text as T
from .operators import fusion, late_interaction as L, lexical, lookup, upsert as U, vectors as V
from .runtime import ManifestLog, delete_path, folders, materialize
from .sources import files as S

Encoder = Callable[[list[str]], list[np.ndarray]]
OVERSAMPLE, OVERSAMPLE_LEAST = 8, 64


def hashing_encoder(dim: int = 32) -> Encoder:
    """Deterministic token vectors from hashed words, where no model is at hand."""

    def encode(texts: list[str]) -> list[np.ndarray]:
        import regex
        import xxhash

        out = []
        for t in texts:
            rows = []
            for w in regex.findall(r"[\p{L}\p{N}]+", t.lower()):
                v = np.random.default_rng(xxhash.xxh3_64_intdigest(w)).standard_normal(dim)
                rows.append(v / np.linalg.norm(v))
            out.append(np.array(rows) if rows else np.zeros((0, dim)))
        return out

    return encode


@dataclass(frozen=True)
class SearchOptions:
    """What a search returns: mode bm25, semantic or hybrid; `all` lifts the count."""

    mode: str = "hybrid"
    count: int = 10
    collection: str | None = None
    min_score: float = 0.0
    fuzzy: bool = True
    all: bool = False


class Engine:
    """Tables under one folder: collections, contexts, documents, manifest, codes and the codec."""

    TABLES = {
        "collections": "collection string, root string",
        "contexts": "uri string, description string",
        "documents": "collection string, path string, title string, text string, body string, mtime bigint, full_hex string, content_hash string",
        "manifest": "doc string, pos int, chunk string, start_byte bigint, byte_len bigint",
        "tokens": "chunk string, tok int, vec array<double>",
        "postings": lexical.POSTINGS,
        "terms": lexical.TERMS,
        "fields": lexical.FIELDS,
        "codes": "doc string, cid int, code binary",
        "codec": "nbits int, centroids array<array<double>>, cutoffs array<double>, weights array<double>",
        "user_metadata": "full_hex string, metadata string",
        "settings": "key string, value string",
    }

    def __init__(self, spark: SparkSession, root: str, encoder: Encoder | None = None, model: str = "hashing"):
        self.spark, self.root, self.model = spark, root.rstrip("/"), model
        self.encoder, self.stand_in = encoder or hashing_encoder(), encoder is None

    # --- tables -------------------------------------------------------------------------------

    @property
    def log(self) -> ManifestLog:
        return ManifestLog(self.spark, f"{self.root}/log")

    def table(self, name: str) -> DataFrame:
        _, last = self.log.last()
        at = (last or {"tables": {}})["tables"].get(name)
        return self.spark.read.schema(self.TABLES[name]).parquet(f"{self.root}/data/{at}") if at else self.spark.createDataFrame([], self.TABLES[name])

    def _swap(self, tables: dict[str, DataFrame]) -> None:
        """Write new versions beside the old ones and commit them together.

        One manifest names the current version of every table. Its number is
        given once: a write that fails, or meets another one, changes nothing.
        Old versions stay for readers under way until `vacuum`.
        """
        number, last = self.log.last()
        now = dict((last or {"tables": {}})["tables"])
        written = []
        try:
            for name, df in tables.items():
                at = f"{name}-{uuid.uuid4().hex}"
                written.append(at)
                rows = df.select(*[c.split()[0] for c in self.TABLES[name].split(", ")])
                (lexical.laid_out(rows).write.partitionBy("bucket") if name == "postings" else rows.write).parquet(f"{self.root}/data/{at}")
                now[name] = at
            self.log.publish(number + 1, {"tables": now})
        except BaseException:
            for at in written:
                delete_path(self.spark, f"{self.root}/data/{at}")
            raise

    def rollback(self) -> None:
        """Go back to the state before the last commit."""
        number, _ = self.log.last()
        if number < 0:
            raise ValueError("nothing was committed")
        before = self.log.read(number - 1) if number else {"tables": {}}
        self.log.publish(number + 1, before)

    def vacuum(self, keep: int = 2) -> int:
        """Delete table versions that none of the last `keep` commits names; returns how many."""
        numbers = self.log.numbers()
        held = {at for n in numbers[-keep:] for at in self.log.read(n)["tables"].values()}
        gone = [f for f in folders(self.spark, f"{self.root}/data") if f not in held]
        for f in gone:
            delete_path(self.spark, f"{self.root}/data/{f}")
        for n in numbers[:-keep]:
            self.log.drop(n)
        return len(gone)

    # --- collections, contexts, metadata ----------------------------------------------------------

    def add_collection(self, name: str, root: str) -> None:
        if not name or "/" in name or ":" in name:
            raise ValueError(f"not a collection name: {name!r}")
        have = self.table("collections")
        if not have.where(F.col("collection") == name).isEmpty():
            raise ValueError(f"collection {name} exists")
        self._swap({"collections": have.unionByName(self.spark.createDataFrame([(name, root)], self.TABLES["collections"]))})

    def remove_collection(self, name: str) -> None:
        """Documents, manifest and metadata go with a collection; embeddings stay as a cache."""
        gone = self.table("documents").where(F.col("collection") == name)
        ids = gone.select("full_hex")
        self._swap(
            {
                **self._lexical(self.table("documents").where("false"), ids, self.table("documents").where(F.col("collection") != name)),
                "collections": self.table("collections").where(F.col("collection") != name),
                "manifest": U.delete(self.table("manifest"), ids.withColumnRenamed("full_hex", "doc"), ["doc"]),
                "user_metadata": U.delete(self.table("user_metadata"), ids, ["full_hex"]),
                "documents": self.table("documents").where(F.col("collection") != name),
            }
        )

    def collections(self) -> DataFrame:
        return self.table("collections").orderBy("collection")

    def set_context(self, uri: str, description: str) -> None:
        new = self.spark.createDataFrame([(uri, description)], self.TABLES["contexts"])
        self._swap({"contexts": U.upsert(self.table("contexts"), new, ["uri"])})

    def remove_context(self, uri: str) -> None:
        self._swap({"contexts": self.table("contexts").where(F.col("uri") != uri)})

    def set_metadata(self, rows: DataFrame) -> None:
        """rows: full_hex, metadata (JSON); invalid JSON is refused."""
        good = rows.where(F.try_parse_json("metadata").isNotNull())
        self._swap({"user_metadata": U.upsert(self.table("user_metadata"), good, ["full_hex"])})

    def status(self) -> DataFrame:
        return lookup.status(self.table("collections"), self.table("documents"))

    # --- indexing ------------------------------------------------------------------------------

    def _check_model(self) -> None:
        said = self.table("settings").where("key = 'model'").first()
        if said and said["value"] != self.model:
            raise ValueError(f"the index was built with {said['value']}, not {self.model}; rebuild it")

    def sync(self, only: str | None = None) -> DataFrame:
        """Bring the index up to date with the folders; returns path changes (collection, path, change).

        Files whose content changed are chunked and indexed anew; chunks already
        embedded are not embedded again. All tables change in one commit.
        """
        self._check_model()
        now = None
        for r in self.table("collections").toLocalIterator():
            if only is None or r["collection"] == only:
                found, _ = S.load_documents(self.spark, S.discover_files(self.spark, r["collection"], r["root"]))
                now = found if now is None else now.unionByName(found)
        old = self.table("documents")
        if now is None:
            return old.where("false").select("collection", "path", F.lit("").alias("change"))
        now = lookup.with_ids(S.prepare(now)).withColumn("content_hash", F.sha2("text", 256)).select(*old.columns).cache()
        mine = old if only is None else old.where(F.col("collection") == only)
        diff = (
            mine.select("collection", "path", F.col("content_hash").alias("was"))
            .join(now.select("collection", "path", F.col("content_hash").alias("now")), ["collection", "path"], "full_outer")
            .withColumn("change", F.expr("CASE WHEN was IS NULL THEN 'new' WHEN now IS NULL THEN 'deleted' WHEN was <> now THEN 'changed' END"))
            .where("change IS NOT NULL")
            .select("collection", "path", "change")
        )
        diff = materialize(diff, "sync")  # outlives the tables it was derived from
        fresh = now.join(diff.where("change <> 'deleted'"), ["collection", "path"], "left_semi")
        gone = lookup.with_ids(diff).select("full_hex")
        docs = U.delete(old, gone, ["full_hex"]).unionByName(fresh)
        model = self.spark.createDataFrame([("model", self.model)], self.TABLES["settings"])
        self._swap(
            {
                **self._chunked(fresh, gone),
                **self._lexical(fresh, gone, docs),
                "settings": U.upsert(self.table("settings"), model, ["key"]),
                "documents": docs,
            }
        )
        now.unpersist()
        return diff

    def _chunked(self, fresh: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
        """New manifest, tokens and codes after the documents `fresh` came and those of `gone` (full_hex) went.

        Chunks cover the whole text. Known chunks are not embedded again, and
        the codec stays as it was fitted at first.
        """
        rows = fresh.select(F.col("full_hex").alias("doc"), F.explode(T.chunks("body", contiguous=True)).alias("c"))
        chunked = rows.select("doc", F.col("c.idx").alias("pos"), T.chunk_hex("c.text", self.model).alias("chunk"), "c.start_byte", F.octet_length("c.text").cast("bigint").alias("byte_len"), "c.text")
        chunked = materialize(chunked, "chunks")
        manifest = U.delete(self.table("manifest"), gone.withColumnRenamed("full_hex", "doc"), ["doc"]).unionByName(chunked.drop("text"))
        missing = U.cache_misses(chunked, self.table("tokens"))
        todo = chunked.select("chunk", "text").dropDuplicates(["chunk"]).join(missing, "chunk", "left_semi")
        new = materialize(self._embed(todo), "tokens")
        tokens = self.table("tokens").unionByName(new)
        out = {"manifest": manifest, "tokens": tokens}
        codec = self._codec()
        if codec is None:
            n = tokens.count()
            if not n:
                return out
            codec, new = V.fit_codec(tokens.withColumn("key", F.xxhash64("chunk", "tok", "vec")), V.centroid_count(n), vec="vec", key="key"), tokens
            row = (codec.nbits, codec.centroids.tolist(), codec.cutoffs.tolist(), codec.weights.tolist())
            out["codec"] = self.spark.createDataFrame([row], self.TABLES["codec"])
        codes = V.encode(new.select(F.col("chunk").alias("doc"), "vec"), codec, "vec")
        return out | {"codes": self.table("codes").unionByName(codes)}

    def _codec(self) -> V.Codec | None:
        r = self.table("codec").first()
        return V.Codec(r["nbits"], np.array(r["centroids"]), np.array(r["cutoffs"]), np.array(r["weights"])) if r else None

    def _lexical(self, fresh: DataFrame, gone: DataFrame, docs: DataFrame) -> dict[str, DataFrame]:
        """New postings, dictionary and field lengths; of texts only those of `fresh` are read."""
        old = self.table("postings")
        rows = lexical.stored_rows(fresh, "full_hex", ["title", "body"], stemming=True)
        kept = materialize(U.delete(old, gone.select(F.col("full_hex").alias("doc")), ["doc"]).select(*old.columns).unionByName(rows), "postings")
        return {"postings": kept, "terms": lexical.dictionary(kept), "fields": lexical.field_stats(kept, docs)}

    def rebuild(self, what: str = "all") -> DataFrame | None:
        """Index anew: `all` from the folders, embeddings and model included; `index` or `embeddings` only, from the documents at hand."""
        docs = self.table("documents")
        none = docs.where("false").select("full_hex")
        empty = {n: self.spark.createDataFrame([], k) for n, k in self.TABLES.items()}
        if what == "index":
            self._swap(self._lexical(docs, docs.select("full_hex"), docs))
        elif what == "embeddings":
            self._swap({n: empty[n] for n in ("manifest", "tokens", "codes", "codec")})
            self._swap(self._chunked(docs, none))
        elif what == "all":
            self._swap({n: empty[n] for n in ("documents", "manifest", "tokens", "codes", "codec", "postings", "terms", "fields", "settings")})
            return self.sync()
        else:
            raise ValueError(f"no such part of the index: {what}")
        return None

    def _embed(self, chunks: DataFrame, factor: int = 2) -> DataFrame:
        encoder = self.encoder

        def run(batches):
            for b in batches:
                out = []
                for chunk, x in zip(b["chunk"], encoder(b["text"].tolist())):
                    out += [(chunk, i, v) for i, v in enumerate(L.pool(np.asarray(x, dtype=float), factor))]
                yield pd.DataFrame(out, columns=["chunk", "tok", "vec"])

        return chunks.select("chunk", "text").mapInPandas(run, self.TABLES["tokens"])

    # --- search ------------------------------------------------------------------------------

    def _bm25(self, query: str, o: SearchOptions) -> DataFrame:
        idx = lexical.StoredIndex(self.table("postings"), self.table("terms"), self.table("fields"), stemmed=True)
        only = self.table("documents").where(F.col("collection") == o.collection).select(F.col("full_hex").alias("doc")) if o.collection else None
        return lexical.bm25(idx, query, {"title": lexical.TITLE_BOOST}, fuzzy=o.fuzzy, only=only)

    def _semantic(self, query: str, k: int, o: SearchOptions) -> DataFrame:
        """doc, score, best_chunk; chunks outside the collection are left out before the search."""
        docs = self.table("documents")
        if o.collection:
            docs = docs.where(F.col("collection") == o.collection)
        owners = self.table("manifest").join(docs.select(F.col("full_hex").alias("doc")), "doc", "left_semi").select("chunk", "doc").distinct()
        q, codec = self.encoder([query])[0], self._codec()
        if not len(q) or codec is None:
            return owners.where("false").select("doc", F.lit(0.0).alias("score"), F.lit("").alias("best_chunk"))
        codes = self.table("codes").join(owners.select(F.col("chunk").alias("doc")).distinct(), "doc", "left_semi")
        params = L.SearchParams.for_k(max(OVERSAMPLE * k, OVERSAMPLE_LEAST))
        if self.stand_in:  # hashed words are alike or unrelated, so no centroid is near enough to be told by a threshold
            params = replace(params, n_probe=8, threshold=None)
        hits = L.search(codes, codec, q, params)
        return fusion.collapse(hits.withColumnRenamed("doc", "chunk"), owners)

    def search(self, query: str, options: SearchOptions | None = None) -> DataFrame:
        """rank, score, short_id, collection, path, title, excerpts, match, context, metadata of the best documents."""
        o = options or SearchOptions()
        if o.mode not in ("bm25", "semantic", "hybrid"):
            raise ValueError(f"no such mode: {o.mode}")
        limit = lexical.TOP_LIMIT if o.all else o.count
        no_chunk = F.lit(None).cast("string").alias("best_chunk")
        if o.mode == "bm25":
            found = self._bm25(query, o).where(F.col("score") >= o.min_score).select("doc", "score", no_chunk)
        elif o.mode == "semantic":
            found = self._semantic(query, o.count, o).where(F.col("score") >= o.min_score)
        else:
            sem = materialize(self._semantic(query, fusion.LEG_LIMIT, o), "semantic")
            fused = fusion.reciprocal_rank_fusion(fusion.ranked(self._bm25(query, o)), fusion.ranked(sem))
            found = fused.join(sem.select("doc", "best_chunk"), "doc", "left")
        return self._enrich(found.orderBy(F.desc("score"), "doc").limit(limit), query)

    def _enrich(self, found: DataFrame, query: str) -> DataFrame:
        docs = lookup.short_ids(self.table("documents").select("collection", "path", "title", "text", "body", "full_hex"))
        rows = found.withColumnRenamed("doc", "full_hex").join(docs, "full_hex")
        first = self.table("manifest").groupBy("doc", "chunk").agg(F.min_by(F.struct("start_byte", "byte_len"), "pos").alias("at"))
        rows = rows.join(first.select(F.col("doc").alias("full_hex"), F.col("chunk").alias("best_chunk"), "at"), ["full_hex", "best_chunk"], "left")
        ctx = self.table("contexts")
        own = ctx.select(F.col("uri").alias("doc_uri"), F.col("description").alias("doc_context"))
        coll = ctx.select(F.col("uri").alias("coll_uri"), F.col("description").alias("coll_context"))
        rows = rows.withColumn("doc_uri", T.document_uri("collection", "path")).withColumn("coll_uri", F.concat(F.lit("doc://"), "collection"))
        rows = rows.join(own, "doc_uri", "left").join(coll, "coll_uri", "left").join(self.table("user_metadata"), "full_hex", "left")
        from pyspark.sql import Window as W

        return rows.select(
            F.row_number().over(W.orderBy(F.desc("score"), "full_hex")).alias("rank"),  # a limited list
            F.round("score", 6).alias("score"),
            F.concat(F.lit("#"), "short_id").alias("short_id"),
            "collection", "path", "title",
            T.excerpts("body", query, 3).alias("excerpts"),
            F.when(F.col("at").isNotNull(), F.struct(F.col("at.start_byte").alias("start_byte"), F.least(F.col("at.start_byte") + F.col("at.byte_len") - 1, F.octet_length("body") - 1).alias("end_byte"))).alias("match"),
            F.coalesce("doc_context", "coll_context").alias("context"),
            "metadata",
        )

    # --- reading ---------------------------------------------------------------------------------

    def get(self, reference: str, first_line: int | None = None, last_line: int | None = None, first_byte: int | None = None, last_byte: int | None = None, numbers: bool = False) -> DataFrame:
        """collection, path, text of a referenced document; line and byte ranges exclude each other."""
        if (first_line or last_line) and (first_byte is not None or last_byte is not None):
            raise ValueError("give lines or bytes")
        docs = self.table("documents")
        hit = docs.join(lookup.resolve(docs, reference), ["collection", "path"], "left_semi")
        text = F.col("text")
        if first_line or last_line:
            text = T.line_range(text, first_line, last_line)
        elif first_byte is not None or last_byte is not None:
            text = T.byte_range(text, first_byte, last_byte)
        return hit.select("collection", "path", (T.number_lines(text, first_line or 1) if numbers else text).alias("text"))

    def multi_get(self, glob: str, collection: str | None = None) -> DataFrame:
        return lookup.matching(self.table("documents"), glob, collection).select("collection", "path", "text")

    def ingest(self, collection: str, path: str, text: str, metadata: dict | None = None) -> None:
        """Add or replace one document by content, without a folder."""
        clean = lookup.clean_path(path)
        if clean is None:
            raise ValueError(f"not a document path: {path!r}")
        row = self.spark.createDataFrame([(collection, clean, text, int(time.time()))], "collection string, path string, text string, mtime bigint")
        new = lookup.with_ids(S.prepare(row)).withColumn("content_hash", F.sha2("text", 256))
        old = self.table("documents")
        new = new.select(*old.columns)
        docs, ids = U.upsert(old, new, ["full_hex"]), new.select("full_hex")
        tables = {**self._chunked(new, ids), **self._lexical(new, ids, docs), "documents": docs}
        if metadata is not None:
            said = new.select("full_hex", F.lit(json.dumps(metadata)).alias("metadata"))
            tables["user_metadata"] = U.upsert(self.table("user_metadata"), said, ["full_hex"])
        self._swap(tables)

    def delete(self, reference: str) -> None:
        docs = self.table("documents")
        gone = docs.join(lookup.resolve(docs, reference), ["collection", "path"], "left_semi").select("full_hex")
        kept = U.delete(docs, gone, ["full_hex"])
        self._swap(
            {
                **self._lexical(docs.where("false"), gone, kept),
                "manifest": U.delete(self.table("manifest"), gone.withColumnRenamed("full_hex", "doc"), ["doc"]),
                "user_metadata": U.delete(self.table("user_metadata"), gone, ["full_hex"]),
                "documents": kept,
            }
        )
