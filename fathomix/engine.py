"""The engine: an index in a folder, and search over it.

A run reads the changed files once, writes all tables under new names, and names them
in one manifest; see fathomix.store. Postings of the lexical index are added run by run;
those of documents that changed since are passed over by their run's number, and all are
written anew once these are many.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fathomix import models
from fathomix.assistant import PARSE, RERANK, Ask, or_nothing
from fathomix.config import Config
from fathomix.functions.paths import basename, glob_matcher
from fathomix.functions.text import json_in, lexical_tokens, shortened
from fathomix.monitor import Gate
from fathomix.operators import archives, hybrid, indexing, knn, lexical, tables
from fathomix.sources.extract import Limits, Readers, extracted
from fathomix.sources.files import scan_folders
from fathomix.store import Store

SCHEMAS = {
    "files": "file_id long, path string, real_path string, type string, size_bytes long, mtime_ns long, status string, error_message string, created_at long, updated_at long",
    "chunks": "file_id long, chunk_no long, chunk_type string, start_offset long, end_offset long, start_time_ms long, end_time_ms long, snippet string, vector_id long",
    "frames": "file_id long, frame_no long, timestamp_ms long, width int, height int, vector_id long",
    "vectors": "vector_id long, space string, embedding array<float>",
    "lexical": "file_id long, path string, basename string, snippet string, inner_paths string, n_tokens long, run long",
    "entries": "file_id long, inner_path string, size_bytes long, mtime_ns long",
}
#: The columns that lexical search looks into.
SEARCHED = ["path", "basename", "snippet", "inner_paths"]
#: Postings are written anew once this part of their documents is superseded, or there are so many runs of them.
STALE_SHARE, MOST_RUNS = 0.3, 50
KINDS = {"text", "pdf", "image", "audio", "video", "archive"}


def _names(table: str) -> list[str]:
    return [c.split()[0] for c in SCHEMAS[table].split(", ")]


class Engine:
    """index() and search() over one folder, which must be one that all executors share.

    embedder: a factory, made once a worker, for texts and images; text_embedder: one for
    texts alone, in a space of its own. Without them, those that the settings name.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        config: Config | None = None,
        embedder: Callable[[], indexing.Embedder] | None = None,
        text_embedder: Callable[[], indexing.Embedder] | None = None,
        readers: Readers | None = None,
    ) -> None:
        self.spark, self.store, self.config = spark, Store(folder), config or Config()
        chosen, dim = self.config.models, self.config.indexing.hash_dim
        chain, text_chain, speech = list(chosen.embedders), list(chosen.text_embedders), chosen.transcriber
        self.embedder = embedder or (lambda: models.first_that_works(chain, dim))
        self.text_embedder = text_embedder or ((lambda: models.first_that_works(text_chain, dim)) if text_chain else self.embedder)
        self.readers = readers or Readers(transcriber=(lambda: models.transcriber(speech)) if speech else None)

    # Tables ----------------------------------------------------------------------------------------------------------

    def table(self, name: str) -> DataFrame:
        return self._read(name, self.store.manifest()["tables"].get(name, []))

    def _read(self, name: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*map(self.store.uri, folders))

    def _write(self, name: str, df: DataFrame) -> str:
        folder = self.store.new_name(name)
        df.select(*_names(name)).write.parquet(self.store.uri(folder))
        return folder

    def wipe(self) -> None:
        self.store.wipe()

    def cleanup(self, everything: bool = False) -> list[str]:
        """Deletes what no manifest names; with everything, the whole index."""
        gone = self.store.leftovers()
        for name in gone:
            self.store.delete(name)
        if everything:
            self.store.wipe()
        return gone

    # Indexing --------------------------------------------------------------------------------------------------------

    def scan(self, roots: list[str]) -> DataFrame:
        """Files that an index run would look at, before change detection."""
        c = self.config
        return scan_folders(self.spark, roots, c.allow_roots, c.ignore)

    def index(self, roots: list[str], gate: Gate | None = None) -> dict[str, int]:
        """Indexes what is new or changed below roots; counts by status.

        Files go in batches; each is committed, so a run that is stopped loses its last batch
        at most. A closed gate holds the run before each of a batch's steps.
        """
        state = self.store.manifest()["state"] | {"last_scan_ms": int(time.time() * 1000), "enqueued": 0, "processed": 0, "skipped": 0, "errors": 0}
        try:
            while self._batch(roots, gate, state) == self.config.indexing.batch_files:
                pass
        finally:
            self._drop_kept()
        return self._counts(self.table("files"))

    def _batch(self, roots: list[str], gate: Gate | None, state: dict) -> int:
        """Indexes up to batch_files changed files; how many they were."""

        def hold() -> None:
            if gate is not None:
                gate.wait(lambda g: self._tell(state, paused=True, pause_reason=g.reason, paused_for_s=g.paused_for_s))
            state.update(paused=False, pause_reason=None, paused_for_s=None)

        hold()
        old = {name: self.table(name) for name in SCHEMAS}
        fresh = self._kept("fresh", tables.changed(self.scan(roots), old["files"]).limit(self.config.indexing.batch_files))
        n = fresh.count()
        self._tell(state, enqueued=state["enqueued"] + n)
        if not n:
            # Nothing to do writes no tables: readers and later runs see them as they are.
            return 0
        hold()
        c = self.config
        limits = Limits(c.indexing.max_text_bytes, c.archives.size_threshold, c.archives.extract_small, c.video.frame_every_seconds, c.video.max_frames, glob_matcher(c.ignore))
        parts = self._kept("parts", extracted(fresh, self.readers, limits, c.indexing.task_bytes))
        hold()
        written = self._tables(fresh, parts, old, state)
        told = parts.where("part = 'file'").agg(F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if(F.col("skipped").isNotNull()).alias("skipped"), F.count("*").alias("n")).first()
        for key, more in (("errors", told["errors"]), ("skipped", told["skipped"]), ("processed", told["n"] - told["errors"] - told["skipped"])):
            state[key] += more
        self.store.commit(written, state | {"updated_at_ms": int(time.time() * 1000)})
        self._drop_kept()
        return n

    def _tell(self, state: dict, **more) -> None:
        state |= {**more, "updated_at_ms": int(time.time() * 1000)}
        self.store.save_state(state)

    def _kept(self, label: str, df: DataFrame) -> DataFrame:
        """A table of this run alone, in the index folder, so that it is computed once."""
        folder = self.store.new_name(f"run-{label}")
        self._run_folders = [*getattr(self, "_run_folders", []), folder]
        df.write.parquet(self.store.uri(folder))
        return self.spark.read.schema(df.schema).parquet(self.store.uri(folder))

    def _drop_kept(self) -> None:
        for folder in getattr(self, "_run_folders", []):
            self.store.delete(folder)
        self._run_folders = []

    def _tables(self, fresh: DataFrame, parts: DataFrame, old: dict[str, DataFrame], state: dict) -> dict[str, list[str]]:
        """Writes all tables of a run; their folders by name."""
        c, now = self.config, F.unix_millis(F.current_timestamp())
        known, manifest, out = old["files"], self.store.manifest()["tables"], {}
        # All that hangs on a file that is read again goes, and the virtual files of an archive do too.
        stale = self._kept("stale", known.join(fresh.select(F.col("path").alias("real_path")).distinct(), "real_path", "left_semi").select("file_id", "path", "real_path"))
        files = tables.without(known, stale.where("path <> real_path"), "path")
        status = F.when(F.col("error").isNotNull(), "error").when(F.col("skipped").isNotNull(), "skipped").otherwise("indexed")
        rows = parts.where("part = 'file'").dropDuplicates(["path"]).select(
            "path", "real_path", "type", "size_bytes", "mtime_ns", status.alias("status"), F.coalesce("error", "skipped").alias("error_message"), now.alias("created_at"), now.alias("updated_at")
        )
        new_ids = tables.dense_ids(tables.without(rows.select("path"), files, "path"), "file_id", self._next(known, "file_id"), "path")
        merged = tables.upsert(files, rows.join(new_ids, "path", "left"), "path", ["real_path", "type", "size_bytes", "mtime_ns", "status", "error_message", "updated_at"], ["file_id", "created_at"])
        out["files"] = [self._write("files", merged)]
        files = self._read("files", out["files"])
        ids = files.join(parts.where("part = 'file'").select("path").distinct(), "path", "left_semi").select("path", "file_id")

        items = self._kept("items", self._items(parts.join(ids, "path")))
        first_free = max(self._next(old["chunks"], "vector_id"), self._next(old["frames"], "vector_id"))
        items = self._kept("numbered", tables.dense_ids(items, "vector_id", first_free, "file_id", "space", "item_no"))
        gone = stale.select("file_id")
        chunks = items.where("space = 'text'").withColumn("chunk_no", F.col("item_no"))
        out["chunks"] = [self._write("chunks", tables.without(old["chunks"], gone, "file_id").select(*_names("chunks")).unionByName(chunks.select(*_names("chunks"))))]
        frames = items.where("space = 'image'").select("file_id", F.col("item_no").alias("frame_no"), F.col("start_time_ms").alias("timestamp_ms"), "width", "height", "vector_id")
        out["frames"] = [self._write("frames", tables.without(old["frames"], gone, "file_id").select(*_names("frames")).unionByName(frames))]
        # Vectors whose chunk or frame is gone are dropped, so that they take no places in a search; new ones are added in a folder of their own.
        lost = old["chunks"].select("file_id", "vector_id").unionByName(old["frames"].select("file_id", "vector_id")).join(gone, "file_id", "left_semi")
        texts = indexing.embedded(items.where("space = 'text'").select("vector_id", "space", "piece"), self.text_embedder, "piece")
        images = indexing.embedded(items.where("space = 'image'").select("vector_id", "space", "image"), self.embedder, "image", images=True)
        fresh_vectors = self._write("vectors", texts.drop("piece").unionByName(images.drop("image")))
        kept = manifest.get("vectors", []) if lost.isEmpty() else [self._write("vectors", tables.without(old["vectors"], lost, "vector_id"))]
        out["vectors"] = [*kept, fresh_vectors]
        entries = parts.where("part = 'entry'").join(ids, "path").select("file_id", F.col("text").alias("inner_path"), "size_bytes", "mtime_ns")
        out["entries"] = [self._write("entries", tables.without(old["entries"], gone, "file_id").select(*_names("entries")).unionByName(entries))]
        return out | self._lexical(files, ids, items, out, old, gone, manifest, state)

    def _items(self, parts: DataFrame) -> DataFrame:
        """What gets a vector: (file_id, space, item_no, chunk_type, offsets, times, snippet, piece, image, width, height)."""
        c = self.config.indexing
        nothing, no_text = F.lit(None).cast("long"), F.lit(None).cast("string")
        image_less = [F.lit(None).cast("binary").alias("image"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height")]
        snippet = F.substring("piece", 1, c.snippet_chars).alias("snippet")
        texts = indexing.with_chunks(parts.where("part = 'text'"), "text", c.chunk_chars, c.chunk_overlap_chars).withColumn("piece", F.col("chunk_text"))
        texts = texts.select("file_id", F.lit(0).cast("long").alias("part_no"), "chunk_no", F.lit("text").alias("chunk_type"), "start_offset", "end_offset", nothing.alias("start_time_ms"), nothing.alias("end_time_ms"), snippet, "piece", *image_less)
        pages = indexing.with_chunks(parts.where("part = 'page'").select("file_id", "no", "text"), "text", c.chunk_chars, c.chunk_overlap_chars).withColumn("piece", F.col("chunk_text"))
        pages = pages.select("file_id", F.col("no").alias("part_no"), "chunk_no", F.lit("pdf_page").alias("chunk_type"), F.col("no").alias("start_offset"), F.col("no").alias("end_offset"), nothing.alias("start_time_ms"), nothing.alias("end_time_ms"), snippet, "piece", *image_less)
        spoken = parts.where("part = 'segment'").withColumn("piece", F.col("text"))
        spoken = spoken.select(
            "file_id", F.col("no").alias("part_no"), F.lit(0).cast("long").alias("chunk_no"), F.when(F.col("type") == "video", "video_transcript").otherwise("audio_segment").alias("chunk_type"),
            nothing.alias("start_offset"), nothing.alias("end_offset"), F.col("start_ms").alias("start_time_ms"), F.col("end_ms").alias("end_time_ms"), snippet, "piece", *image_less,
        )
        frames = parts.where("part = 'frame'").select(
            "file_id", F.col("no").alias("part_no"), F.lit(0).cast("long").alias("chunk_no"), F.lit("frame").alias("chunk_type"), nothing.alias("start_offset"), nothing.alias("end_offset"),
            F.col("start_ms").alias("start_time_ms"), nothing.alias("end_time_ms"), no_text.alias("snippet"), no_text.alias("piece"), "image", "width", "height",
        )
        every = texts.unionByName(pages).unionByName(spoken).withColumn("space", F.lit("text")).unionByName(frames.withColumn("space", F.lit("image")))
        in_file = F.row_number().over(item_order()) - 1
        return every.withColumn("item_no", in_file.cast("long")).drop("part_no", "chunk_no")

    def _lexical(self, files: DataFrame, ids: DataFrame, items: DataFrame, out: dict, old: dict, gone: DataFrame, manifest: dict, state: dict) -> dict[str, list[str]]:
        """The table of what is searched by words, and its postings: those of this run are added, or all are written anew."""
        run = (old["lexical"].agg(F.max("run")).first()[0] or 0) + 1
        first = items.where("space = 'text' and item_no = 0").select("file_id", "snippet")
        inner = archives.listed_paths(self._read("entries", out["entries"]).join(ids, "file_id", "left_semi"), most=self.config.indexing.inner_paths).select("file_id", "inner_paths")
        fresh = files.join(ids.select("file_id"), "file_id", "left_semi").join(first, "file_id", "left").join(inner, "file_id", "left").withColumn("basename", basename(F.col("path")))
        count = sum((F.size(lexical_tokens(F.coalesce(F.col(x), F.lit("")))) for x in SEARCHED), F.lit(0)).cast("long")
        fresh = fresh.select(*_names("lexical")[:-2], count.alias("n_tokens"), F.lit(run).cast("long").alias("run"))
        kept = tables.without(old["lexical"], gone, "file_id").select(*_names("lexical"))
        done = {"lexical": [self._write("lexical", kept.unionByName(fresh))]}
        now = self._read("lexical", done["lexical"])
        told = now.agg(F.count("*").alias("n"), F.count_if(F.col("run") == run).alias("fresh"), F.avg(F.col("n_tokens").cast("double")).alias("mean")).first()
        runs, ever = manifest.get("postings", []), told["fresh"] + (state.get("posted") or 0)
        anew = len(runs) >= MOST_RUNS or told["n"] < (1 - STALE_SHARE) * ever
        folder = self.store.new_name("postings")
        lexical.write_index(now if anew else now.where(F.col("run") == run), "file_id", SEARCHED, self.store.uri(folder), carried="run")
        state |= {"n_docs": told["n"], "mean_tokens": told["mean"], "posted": told["n"] if anew else ever}
        return done | {"postings": [folder] if anew else [*runs, folder]}

    @staticmethod
    def _next(df: DataFrame, column: str) -> int:
        return (df.agg(F.max(column)).first()[0] or 0) + 1

    @staticmethod
    def _counts(files: DataFrame) -> dict[str, int]:
        return {r["status"]: r["count"] for r in files.groupBy("status").count().collect()}

    # Search ----------------------------------------------------------------------------------------------------------

    def lexical_index(self) -> lexical.LexicalIndex | None:
        """The postings of all runs, without those of documents that a later run replaced."""
        manifest = self.store.manifest()
        folders, state = manifest["tables"].get("postings"), manifest["state"]
        if not folders:
            return None
        every = lexical.read_postings(self.spark, [self.store.uri(x) for x in folders], "bigint", "run long")
        figures = self.spark.createDataFrame([(float(state["n_docs"]), state["mean_tokens"])], "n double, avgdl double")
        live = None if state["posted"] == state["n_docs"] else self._read("lexical", manifest["tables"]["lexical"]).select(F.col("file_id").alias("id"), "run")
        return lexical.LexicalIndex(every, figures, tuple(SEARCHED), live)

    def search(
        self, query: str, top: int | None = None, type_filter: str | None = None, path_glob: str | None = None, since: str | None = None, ask: Ask | None = None, rerank: bool = True
    ) -> DataFrame:
        """(file_id, path, type, score, snippet, timestamp_ms, sources, explanation), best first.

        ask, a model's text completion, may propose filters for what the caller left
        open, and an order of the best results; what it says is used if it is JSON and valid.
        """
        s = self.config.search
        asked = query
        if ask is not None and self.config.language_model.parse_queries:
            query, type_filter, path_glob, since = self._rewritten(ask, query, type_filter, path_glob, since)
        vectors, chunks, frames = self.table("vectors"), self.table("chunks"), self.table("frames")
        hits = []
        for space, factory in (("text", self.text_embedder), ("image", self.embedder)):
            q = [float(x) for x in factory().embed_texts([query])[0]]
            nearest = knn.knn_lsh if s.nearest == "lsh" and not vectors.where(F.col("space") == space).isEmpty() else knn.knn
            hits.append(nearest(vectors, q, s.vector_k, space).select("vector_id", "sim"))
        vec = hybrid.file_scores(*hits, chunks, frames)
        docs, index = self.table("lexical"), self.lexical_index()
        found = lexical.search(docs if index is None else index, query, "file_id", SEARCHED, s.fts_k)
        fts = F.broadcast(found).join(docs.select("file_id", F.col("snippet").alias("fts_snippet")), "file_id").select("file_id", "fts_score", "fts_snippet")
        fused = hybrid.fuse(vec, fts, self.table("files").select("file_id", "path", "type", "mtime_ns"), s.w_vec, s.w_fts)
        best = hybrid.best(hybrid.filtered(fused, type_filter, path_glob, since), s.top if top is None else top)
        if ask is None or not rerank or not self.config.language_model.rerank:
            return best.withColumn("explanation", F.lit(None).cast("string"))
        return self._reranked(ask, asked, best)

    def _reranked(self, ask: Ask, query: str, best: DataFrame) -> DataFrame:
        most = self.config.search.rerank_items
        # At most top rows; fixed once, so that the model's numbers mean the same rows.
        rows = best.withColumn("shown", shortened(F.col("snippet"), 200)).collect()
        lines = "\n".join(f"{i}: {r['path']} ({r['type']}) {r['shown']}" for i, r in enumerate(rows[:most]))
        told = self._json(or_nothing(ask, RERANK.format(query=query, files=lines))) if rows else {}
        order = [x for x in told.get("order") or [] if isinstance(x, int) and not isinstance(x, bool)] if isinstance(told.get("order"), list) else []
        why = told.get("explanations") if isinstance(told.get("explanations"), dict) else {}
        ranked = self.spark.createDataFrame([(*r[:-1], i) for i, r in enumerate(rows)], best.schema.add("pos", "long"))
        said = self.spark.createDataFrame([(order, {str(k): v for k, v in why.items() if isinstance(v, str)})], "order array<int>, explanations map<string,string>")
        return hybrid.rerank(ranked, said, most).orderBy("new_pos").drop("pos", "new_pos")

    def _json(self, text: str) -> dict:
        row = self.spark.createDataFrame([(text,)], "t string")
        found = row.select(F.to_json(json_in(F.col("t")))).first()[0]
        told = json.loads(found) if found else {}
        return told if isinstance(told, dict) else {}

    def _rewritten(self, ask: Ask, query: str, type_filter: str | None, path_glob: str | None, since: str | None):
        told = self._json(or_nothing(ask, PARSE.format(query=query)))
        text = lambda key: told.get(key) if isinstance(told.get(key), str) else None
        kind = text("type") if text("type") in KINDS else None
        try:
            hybrid.parse_since(text("since"))
            date = text("since")
        except ValueError:
            date = None
        return text("query") or query, type_filter or kind, path_glob or text("path_glob"), since or date

    # Status ----------------------------------------------------------------------------------------------------------

    def status(self) -> DataFrame:
        return self.table("files").groupBy("status", "type").agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("size_bytes"))

    def state(self) -> dict:
        """Counters and pause of the last run, and the bytes of the index and of its vectors."""
        manifest = self.store.manifest()
        sizes = {name: self.store.size_of(folders) for name, folders in manifest["tables"].items()}
        return manifest["state"] | {"index_bytes": sum(sizes.values()), "vector_bytes": sizes.get("vectors", 0)}


def item_order():
    """A file's items in the order of their parts."""
    from pyspark.sql import Window as W

    return W.partitionBy("file_id", "space").orderBy("part_no", "chunk_no")
