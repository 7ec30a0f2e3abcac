"""Queries of the engine's operators, each with the same result in DuckDB's SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from fathomix.config import IGNORED
from fathomix.functions import paths, text as textf, vectors as vec
from fathomix.operators import archives, hybrid, indexing, knn, lexical, load, tables
from fathomix.plans import views as V
from fathomix.sources.files import candidates, decoded
from fathomix.work import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- Scan and filter -------------------------------------------------------------------------------------------------

_IGNORED_SQL = " OR ".join(f"path GLOB '{g}'" for pattern in IGNORED for g in ([pattern, pattern[:-3]] if pattern.endswith("/**") else [pattern]))
#: Folders below the root, by depth: a pruned one hides what it holds.
_PRUNED_SQL = "(path LIKE '%/.ssh/%' OR path LIKE '%/foo.key/%')"


@query(f"WITH {V.TYPED_SQL} SELECT file_id, path, type, size_bytes, mtime_ns FROM typed_v WHERE type IS NOT NULL AND NOT ({_IGNORED_SQL}) AND NOT {_PRUNED_SQL}")
def scan_files(spark, sf):
    return candidates(V.files(spark, sf), [V.ROOT], [V.ROOT], list(IGNORED)).select("file_id", "path", "type", "size_bytes", "mtime_ns")


@query(f"WITH {V.TYPED_SQL} SELECT file_id, path, type FROM typed_v WHERE type IS NOT NULL")
def detect_type(spark, sf):
    return V.files(spark, sf).select("file_id", "path", paths.file_type(F.col("path")).alias("type")).where(F.col("type").isNotNull())


@query(f"WITH {V.FILES_SQL} SELECT file_id, path FROM files_v WHERE starts_with(path, '/corpus/src1/') OR starts_with(path, '/corpus/src2/en/')")
def filter_allow_roots(spark, sf):
    return V.files(spark, sf).where(paths.below_any(F.col("path"), ["/corpus/src1", "/corpus/src2/en/"])).select("file_id", "path")


@query(f"WITH {V.FILES_SQL} SELECT file_id, ({_IGNORED_SQL} OR path GLOB '*/doc_?[!0-4]5*' OR path GLOB '/corpus/src[3-5]/*.md') AS ignored FROM files_v")
def filter_ignore_globs(spark, sf):
    globs = [*IGNORED, "*/doc_?[!0-4]5*", "/corpus/src[3-5]/*.md"]
    return V.files(spark, sf).select("file_id", paths.matches_any(F.col("path"), globs).alias("ignored"))


@query(f"WITH {V.FILES_SQL} SELECT file_id, (starts_with(path, '/corpus/src1/') AND NOT ({_IGNORED_SQL})) AS allowed FROM files_v")
def filter_path(spark, sf):
    return V.files(spark, sf).select("file_id", paths.allowed(F.col("path"), ["/corpus/src1"], IGNORED).alias("allowed"))


@query(f"WITH {V.FILES_SQL} SELECT file_id, path FROM files_v WHERE {_PRUNED_SQL}")
def filter_dir_prune(spark, sf):
    return V.files(spark, sf).where(paths.pruned(F.col("path"), V.ROOT, IGNORED)).select("file_id", "path")


@query(f"WITH {V.FILES_SQL} SELECT file_id, substr(sha256(concat(path, CAST(mtime_ns AS VARCHAR))), 1, 16) AS key FROM files_v")
def content_key(spark, sf):
    return V.files(spark, sf).select("file_id", F.substring(F.sha2(F.concat("path", F.col("mtime_ns").cast("string")), 256), 1, 16).alias("key"))


@query("SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes, CAST(length(html) AS BIGINT) AS n_chars, md5(html) AS digest FROM pages")
def text_scan(spark, sf):
    read = V.table(spark, sf, "pages").select("page_id", F.col("html").cast("binary").alias("content")).withColumn("text", decoded(F.col("content")))
    return read.select("page_id", F.octet_length("content").cast("long").alias("n_bytes"), F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query(
    f"""WITH {V.TYPED_SQL} SELECT file_id, type, CASE WHEN size_bytes > 6000 AND type = 'pdf' THEN 'error' WHEN type = 'audio' THEN 'skipped' ELSE 'indexed' END AS status,
    CASE WHEN size_bytes > 6000 AND type = 'pdf' THEN 'unreadable' WHEN type = 'audio' THEN 'no transcriber' END AS error_message FROM typed_v WHERE type IS NOT NULL"""
)
def file_status(spark, sf):
    typed = V.files(spark, sf).withColumn("type", paths.file_type(F.col("path"))).where(F.col("type").isNotNull())
    error = F.when((F.col("size_bytes") > 6000) & (F.col("type") == "pdf"), "unreadable")
    out = typed.withColumn("o", indexing.outcome(F.col("type"), F.col("size_bytes"), False, 1 << 30, error))
    return out.select("file_id", "type", "o.status", "o.error_message")


# --- Chunks and media ------------------------------------------------------------------------------------------------

_CHUNKS_SQL = """SELECT doc_id AS file_id, i AS chunk_no, i * 1800 AS start_offset, least(i * 1800 + 2000, length(text)) AS end_offset,
  substr(text, i * 1800 + 1, 512) AS snippet
  FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(ceil((length(text) - 2000) / 1800::DOUBLE), 0) AS BIGINT) + 1)) AS i FROM documents WHERE length(text) > 0) q"""


@query(_CHUNKS_SQL)
def chunk_documents(spark, sf):
    return indexing.text_chunks(V.texts(spark, sf))


@query(
    """WITH p AS (SELECT doc_id AS file_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS page_no FROM documents)
    SELECT file_id, page_no, i AS chunk_no, substr(substr(text, i * 450 + 1, 500), 1, 512) AS snippet
    FROM (SELECT *, unnest(range(0, CAST(greatest(ceil((length(text) - 500) / 450::DOUBLE), 0) AS BIGINT) + 1)) AS i FROM p WHERE length(text) > 0) q"""
)
def pdf_page_chunks(spark, sf):
    return indexing.page_chunks(V.texts(spark, sf).select("file_id", F.split("text", "\n").alias("pages")), 500, 50)


_WHITE_SQL = " || ".join(f"chr({ord(c)})" for c in textf.WHITE)


@query(
    f"""WITH s AS (SELECT conv_id, turn, trim(CASE turn % 3 WHEN 0 THEN concat(chr(9), text, chr(10), chr(12288)) WHEN 1 THEN text ELSE concat(chr(160), chr(13)) END, {_WHITE_SQL}) AS text FROM conversations)
    SELECT conv_id AS file_id, turn * 5000 AS start_time_ms, turn * 5000 + 4000 AS end_time_ms, text FROM s WHERE text <> ''"""
)
def transcript_segments(spark, sf):
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("\t"), "text", F.lit("\n\u3000"))).when(F.col("turn") % 3 == 1, F.col("text")).otherwise(F.lit("\xa0\r"))
    segments = V.table(spark, sf, "conversations").select(F.col("conv_id").alias("file_id"), (F.col("turn") * F.lit(5.0)).alias("start_s"), (F.col("turn") * F.lit(5.0) + 4).alias("end_s"), text.alias("text"))
    return indexing.segment_chunks(segments)


@query(
    """WITH s AS (SELECT user_id AS file_id, epoch(ts) AS at_s, event_id FROM events),
    f AS (SELECT file_id, CAST(floor(at_s / 86400) AS BIGINT) AS slot, arg_min(event_id, (at_s, event_id)) AS sample_id FROM s GROUP BY 1, 2),
    n AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY slot) - 1 AS frame_no FROM f)
    SELECT file_id, frame_no, sample_id, frame_no * 86400000 AS timestamp_ms FROM n WHERE frame_no < 5"""
)
def frame_sampling(spark, sf):
    samples = V.table(spark, sf, "events").select(F.col("user_id").alias("file_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at_s"), F.col("event_id").alias("sample_id"))
    return indexing.sampled_frames(samples, every_s=86400.0, most=5)


@query(f"WITH c AS ({_CHUNKS_SQL}) SELECT file_id, count(*) AS n_chunks, CAST(sum(end_offset - start_offset) AS BIGINT) AS n_chars FROM c GROUP BY 1")
def append_chunks(spark, sf):
    chunks = indexing.text_chunks(V.texts(spark, sf))
    old, new = chunks.where("file_id % 2 = 0"), chunks.where("file_id % 2 = 1")
    return old.unionByName(new).groupBy("file_id").agg(F.count("*").alias("n_chunks"), F.sum(F.col("end_offset") - F.col("start_offset")).alias("n_chars"))


# --- Vectors ---------------------------------------------------------------------------------------------------------

_COS_SQL = "(list_sum(list_transform(list_zip(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), lambda p: p[1] * p[2])) / ((sqrt(list_sum(list_transform(CAST({a} AS DOUBLE[]), lambda x: x * x))) + 1e-12) * (sqrt(list_sum(list_transform(CAST({b} AS DOUBLE[]), lambda x: x * x))) + 1e-12)))"


def _hits_sql(name: str, vec_id: int, k: int, space: str | None) -> str:
    cos = _COS_SQL.format(a="v.embedding", b="q.embedding")
    where = f"WHERE v.space = '{space}'" if space else ""
    return f"{name} AS (SELECT v.vector_id, v.space, v.file_id, {cos} AS sim FROM vec_v v CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = {vec_id}) q {where} ORDER BY sim DESC, vector_id LIMIT {k})"


@query(
    """WITH d AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) + 1e-12 AS l FROM d)
    SELECT vec_id AS vector_id, p AS pos, round(e[p + 1] / l, 6) AS value FROM n, unnest(range(0, 64)) AS t(p)"""
)
def vector_normalize(spark, sf):
    unit = V.vectors(spark, sf).select("vector_id", vec.normalized(vec.doubles(F.col("embedding"))).alias("v"))
    return unit.select("vector_id", F.posexplode("v").alias("pos", "x")).select("vector_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("value"))


@query("SELECT vec_id AS vector_id, CAST(len(embedding) AS BIGINT) AS dim FROM embeddings")
def vector_dim_check(spark, sf):
    return knn.checked(V.vectors(spark, sf), 64).select("vector_id", F.size("embedding").cast("long").alias("dim"))


@query(f"WITH {V.VEC_SQL}, {_hits_sql('h', 3, 50, None)} SELECT vector_id, file_id, round(sim, 6) AS sim FROM h")
def knn_exact(spark, sf):
    return knn.knn(V.vectors(spark, sf), V.query_vector(spark, sf, 3), 50).select("vector_id", "file_id", F.round("sim", 6).alias("sim"))


@query(f"WITH {V.VEC_SQL}, {_hits_sql('h', 3, 20, 'image')} SELECT vector_id, space, round(sim, 6) AS sim FROM h")
def knn_space_router(spark, sf):
    return knn.knn(V.vectors(spark, sf), V.query_vector(spark, sf, 3), 20, "image").select("vector_id", "space", F.round("sim", 6).alias("sim"))


@query(
    f"""WITH {V.VEC_SQL}, s AS (SELECT q.vec_id AS query_id, v.vector_id, {_COS_SQL.format(a='v.embedding', b='q.embedding')} AS sim
    FROM vec_v v CROSS JOIN (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0) q)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vector_id) AS INTEGER) AS rank, vector_id, round(sim, 6) AS sim FROM s
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vector_id) <= 5"""
)
def knn_batch(spark, sf):
    vectors = V.vectors(spark, sf)
    queries = vectors.where("vector_id % 20 = 0").select(F.col("vector_id").alias("query_id"), "embedding")
    return knn.knn_batch(vectors, queries, 5).withColumn("sim", F.round("sim", 6))


_LOOKUP_SQL = f"{V.VEC_SQL}, {V.CHUNK_ROWS_SQL}, {_hits_sql('th', 3, 50, 'text')}, {_hits_sql('ih', 3, 50, 'image')}"
_HITS_SQL = """hits AS (SELECT c.file_id, h.sim, 0 AS kind, h.vector_id, coalesce(c.snippet, '') AS snippet, c.start_time_ms AS at_ms FROM th h JOIN chunk_rows c USING (vector_id)
  UNION ALL SELECT f.file_id, h.sim, 1, h.vector_id, '', f.timestamp_ms FROM ih h JOIN frame_rows f USING (vector_id))"""
_SCORES_SQL = """scores AS (SELECT file_id, greatest(0.0, max(sim)) AS vec_score, min_by(struct_pack(s := snippet, t := at_ms), (kind, -sim, vector_id)) AS first,
  list_sort(list(DISTINCT CASE WHEN kind = 0 THEN 'vector:text' ELSE 'vector:image' END)) AS vec_sources FROM hits GROUP BY file_id)"""


def _recall(spark, sf, vec_id=3, k=50):
    q, vectors = V.query_vector(spark, sf, vec_id), V.vectors(spark, sf)
    hits = [knn.knn(vectors, q, k, space).select("vector_id", "sim") for space in ("text", "image")]
    return hybrid.file_scores(*hits, V.chunk_rows(spark, sf), V.frame_rows(spark, sf))


@query(f"WITH {_LOOKUP_SQL} SELECT h.vector_id, c.file_id, round(h.sim, 6) AS sim, c.snippet FROM th h JOIN chunk_rows c USING (vector_id)")
def knn_join_chunks(spark, sf):
    hits = knn.knn(V.vectors(spark, sf), V.query_vector(spark, sf, 3), 50, "text").select("vector_id", "sim")
    return F.broadcast(hits).join(V.chunk_rows(spark, sf), "vector_id").select("vector_id", "file_id", F.round("sim", 6).alias("sim"), "snippet")


@query(f"WITH {_LOOKUP_SQL} SELECT h.vector_id, f.file_id, round(h.sim, 6) AS sim, f.timestamp_ms FROM ih h JOIN frame_rows f USING (vector_id)")
def knn_join_frames(spark, sf):
    hits = knn.knn(V.vectors(spark, sf), V.query_vector(spark, sf, 3), 50, "image").select("vector_id", "sim")
    return F.broadcast(hits).join(V.frame_rows(spark, sf), "vector_id").select("vector_id", "file_id", F.round("sim", 6).alias("sim"), "timestamp_ms")


@query(f"WITH {_LOOKUP_SQL}, {_HITS_SQL}, {_SCORES_SQL} SELECT file_id, round(vec_score, 6) AS vec_score FROM scores")
def score_max_per_file(spark, sf):
    return _recall(spark, sf).select("file_id", F.round("vec_score", 6).alias("vec_score"))


@query(f"WITH {_LOOKUP_SQL}, {_HITS_SQL}, {_SCORES_SQL} SELECT file_id, first.s AS snippet, first.t AS timestamp_ms FROM scores")
def snippet_first_hit(spark, sf):
    return _recall(spark, sf).select("file_id", F.col("vec_snippet").alias("snippet"), "timestamp_ms")


@query(
    """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[A-Za-z0-9_]+') AS ts, text FROM documents),
    x AS (SELECT doc_id, unnest(CASE WHEN len(ts) > 0 THEN ts ELSE [text] END) AS tok, len(ts) > 0 AS is_real FROM t),
    c AS (SELECT doc_id, CAST('0x' || substr(md5(tok), 1, 8) AS BIGINT) % 384 AS bucket, count(*) AS n, bool_or(is_real) AS is_real FROM x GROUP BY 1, 2),
    w AS (SELECT doc_id, bucket, CASE WHEN is_real THEN ln(1 + n) ELSE 1.0 END AS w FROM c)
    SELECT doc_id AS file_id, bucket, round(w / (sqrt(sum(w * w) OVER (PARTITION BY doc_id)) + 1e-12), 6) AS weight FROM w"""
)
def hash_embed_text(spark, sf):
    return indexing.sparse_hash_embedding(V.texts(spark, sf)).withColumn("weight", F.round("weight", 6))


@query()
def hash_embed_blake(spark, sf):
    """The hash embedding as the engine stores it, by BLAKE2b; SQL has no such hash, tests compare it."""
    return indexing.embedded(V.texts(spark, sf), indexing.HashEmbedder, "text").select("file_id", "embedding")


@query(
    """WITH h AS (SELECT page_id, md5(html) AS h FROM pages WHERE html IS NOT NULL),
    b AS (SELECT page_id, CAST('0x' || unnest([substr(h, 7, 2), substr(h, 5, 2), substr(h, 3, 2), substr(h, 1, 2), '00', '00', '00', '00']) AS BIGINT) AS bucket FROM h),
    c AS (SELECT page_id, bucket, count(*) AS n FROM b GROUP BY 1, 2)
    SELECT page_id AS file_id, bucket, round(n / (sqrt(sum(n * n) OVER (PARTITION BY page_id)) + 1e-12), 6) AS weight FROM c"""
)
def hash_embed_image(spark, sf):
    """The hash embedding of bytes, by MD5's first four as a number of eight; the engine's uses BLAKE2b."""
    bytes_of = V.table(spark, sf, "pages").where("html is not null").select(F.col("page_id").alias("file_id"), F.col("html").cast("binary").alias("image"))
    dense = indexing.embedded(bytes_of, lambda: indexing.HashEmbedder(384, indexing.md5_32), "image", images=True)
    told = dense.select("file_id", F.posexplode("embedding").alias("bucket", "weight")).where("weight > 0")
    return told.select("file_id", F.col("bucket").cast("long").alias("bucket"), F.round(F.col("weight").cast("double"), 6).alias("weight"))


@query(
    """WITH p AS (SELECT label, CASE WHEN vec_id % 3 = 0 THEN 0.0 ELSE 1.0 END AS mask, embedding, i FROM embeddings, unnest(range(0, 64)) AS t(i)),
    m AS (SELECT label, i, sum(CAST(embedding[i + 1] AS DOUBLE) * mask) / greatest(sum(mask), 1e-9) AS m FROM p GROUP BY 1, 2)
    SELECT label, i AS pos, round(m / (sqrt(sum(m * m) OVER (PARTITION BY label)) + 1e-12), 6) AS value FROM m"""
)
def mean_pool(spark, sf):
    tokens = V.table(spark, sf, "embeddings").select("label", (F.col("vec_id") % 3 != 0).cast("int").alias("mask"), "embedding")
    return indexing.mean_pooled(tokens, "label").withColumn("value", F.round("value", 6))


@query()
def knn_lsh(spark, sf):
    return knn.knn_lsh(V.vectors(spark, sf), V.query_vector(spark, sf, 3), 10)


# --- Lexical ---------------------------------------------------------------------------------------------------------

_TOKENS_SQL = f"regexp_extract_all(translate(lower({{}}), '{textf.MARKED}', '{textf.PLAIN}'), '[\\p{{{{L}}}}\\p{{{{N}}}}\\p{{{{Co}}}}]+')"


def _tokens_sql(column: str) -> str:
    return _TOKENS_SQL.format(column).replace("{{", "{").replace("}}", "}")


def _bm25_sql(source: str, key: str, columns: list[str], phrases: list[str], wanted: str, prefix: bool = False) -> str:
    """CTEs up to ranked(key, rank): the published formula, phrases as blank-joined tokens."""
    parts = " || ".join(f"' ' || array_to_string({_tokens_sql(f'coalesce({c}, {chr(39)}{chr(39)})')}, ' ') || ' ' || chr(1)" for c in columns)
    dl = " + ".join(f"len({_tokens_sql(f'coalesce({c}, {chr(39)}{chr(39)})')})" for c in columns)
    # A token's blanks are doubled, so that matches of a phrase cannot overlap in one.
    tf = [f"CAST(len(regexp_extract_all(replace(toks, ' ', '  '), ' {p.replace(' ', '  ')}{'[^ ]*' if prefix else ''} ')) AS DOUBLE) AS tf{i}" for i, p in enumerate(phrases)]
    df = [f"sum(CASE WHEN tf{i} > 0 THEN 1.0 ELSE 0.0 END) AS df{i}" for i in range(len(phrases))]
    score = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(phrases)))
    return f"""toks AS (SELECT {key}, {parts} AS toks, CAST({dl} AS DOUBLE) AS dl FROM {source}),
    counted AS (SELECT {key}, dl, {', '.join(tf)} FROM toks),
    stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl, {', '.join(df)} FROM counted),
    ranked AS (SELECT {key}, -({score}) AS rank FROM counted CROSS JOIN stats WHERE {wanted})"""


def _docs(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", "text")


_INDEXES: dict[tuple, lexical.LexicalIndex] = {}


def _index(spark, sf, name, docs, key, columns):
    """The lexical index of a table, written at the first search of a session and read by all; written anew if the table's files change."""
    files = V.table(spark, sf, "documents").inputFiles()
    stamp = spark.read.format("binaryFile").load(files).agg(F.count("*"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()
    at = (spark.sparkContext.applicationId, sf, name, *stamp)
    if at not in _INDEXES:
        folder = new_folder(spark, "lexical")
        lexical.write_index(docs(spark, sf), key, columns, folder)
        _INDEXES[at] = lexical.open_index(spark, folder, "bigint", columns)
    return _INDEXES[at]


def _text_index(spark, sf):
    return _index(spark, sf, "documents", _docs, "doc_id", ["text"])


def _ranked(spark, sf, text):
    return lexical.bm25(_text_index(spark, sf), lexical.parse_query(text), "doc_id", ["text"]).withColumn("rank", F.round("rank", 6))


@query(f"WITH {_bm25_sql('documents', 'doc_id', ['text'], ['the', 'whst'], 'tf0 > 0 AND tf1 > 0')} SELECT doc_id, round(rank, 6) AS rank FROM ranked")
def fts_bm25(spark, sf):
    return _ranked(spark, sf, "the whst")


@query(f"WITH {_bm25_sql('documents', 'doc_id', ['text'], ['the', 'whst'], 'tf0 > 0 AND tf1 > 0')} SELECT doc_id, round(rank, 6) AS rank FROM ranked")
def fts_scan(spark, sf):
    """The same without an index."""
    return lexical.bm25(_docs(spark, sf), lexical.parse_query("the whst"), "doc_id", ["text"]).withColumn("rank", F.round("rank", 6))


@query(
    f"""WITH {_bm25_sql('documents', 'doc_id', ['text'], ['ened', 'thing'], 'tf0 > 0 AND tf1 > 0')}
    SELECT doc_id, round(rank, 6) AS rank, round(1.0 / (1.0 + abs(rank)), 6) AS fts_score FROM (SELECT * FROM ranked ORDER BY rank, doc_id LIMIT 50) t"""
)
def fts_search(spark, sf):
    return lexical.search(_text_index(spark, sf), "ened thing", "doc_id", ["text"], 50).select("doc_id", F.round("rank", 6).alias("rank"), F.round("fts_score", 6).alias("fts_score"))


@query(
    f"""WITH {_bm25_sql('documents', 'doc_id', ['text'], ['of the'], 'tf0 > 0')}
    SELECT doc_id, round(rank, 6) AS rank FROM (SELECT * FROM ranked ORDER BY rank, doc_id LIMIT 50) t"""
)
def fts_phrase(spark, sf):
    return lexical.search(_text_index(spark, sf), "of-the", "doc_id", ["text"], 50).select("doc_id", F.round("rank", 6).alias("rank"))


@query(
    f"""WITH {_bm25_sql('documents', 'doc_id', ['text'], ['idiot', 'moron', 'de'], '(tf0 > 0 OR (tf1 > 0 AND tf2 = 0))').replace("+ greatest(ln((n - df2 + 0.5) / (df2 + 0.5)), 1e-6) * tf2 * 2.2 / (tf2 + 1.2 * (0.25 + 0.75 * dl / avgdl))", "")}
    SELECT doc_id, round(rank, 6) AS rank FROM ranked"""
)
def fts_boolean(spark, sf):
    return _ranked(spark, sf, "idiot OR moron NOT de")


@query(f"WITH {_bm25_sql('documents', 'doc_id', ['text'], ['pathet'], 'tf0 > 0', prefix=True)} SELECT doc_id, round(rank, 6) AS rank FROM ranked")
def fts_prefix(spark, sf):
    return _ranked(spark, sf, "pathet*")


@query(
    f"""WITH t AS (SELECT doc_id, ' ' || array_to_string({_tokens_sql('coalesce(text, chr(32))')}, ' ') || ' ' AS toks FROM documents)
    SELECT doc_id FROM t WHERE regexp_matches(toks, ' the( [^ ]+){{0,2}} of ') OR regexp_matches(toks, ' of( [^ ]+){{0,2}} the ')"""
)
def fts_near(spark, sf):
    return _ranked(spark, sf, "NEAR(the of, 2)").select("doc_id")


@query(
    f"""WITH versions AS (SELECT conv_id AS file_id, turn AS version, text FROM conversations), last AS (SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY version DESC, text DESC) = 1),
    t AS (SELECT DISTINCT file_id, unnest({_tokens_sql('text')}) AS token FROM last) SELECT token, count(*) AS n_docs FROM t GROUP BY token"""
)
def fts_upsert(spark, sf):
    versions = V.table(spark, sf, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("version"), "text")
    last = tables.latest(versions, "file_id", F.col("version"), F.col("text"))
    tokens = last.select(F.explode(F.array_distinct(textf.lexical_tokens(F.col("text")))).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("n_docs"))


# --- Hybrid search ---------------------------------------------------------------------------------------------------

_FTS_DOCS_SQL = f"{V.TYPED_SQL}, fts_docs AS (SELECT f.file_id, f.path, regexp_extract(f.path, '[^/]*$') AS basename, substr(d.text, 1, 512) AS snippet FROM files_v f JOIN documents d ON d.doc_id = f.file_id)"
_FUSED_SQL = f"""{_FTS_DOCS_SQL}, {_LOOKUP_SQL}, {_HITS_SQL}, {_SCORES_SQL},
  {_bm25_sql('fts_docs', 'file_id', ['path', 'basename', 'snippet'], ['thing', 'en'], 'tf0 > 0 AND tf1 > 0')},
  fts AS (SELECT r.file_id, 1.0 / (1.0 + abs(r.rank)) AS fts_score, d.snippet AS fts_snippet FROM (SELECT * FROM ranked ORDER BY rank, file_id LIMIT 50) r JOIN fts_docs d USING (file_id)),
  fused AS (SELECT file_id, 0.7 * coalesce(vec_score, 0.0) + 0.3 * coalesce(fts_score, 0.0) AS score, coalesce(nullif(first.s, ''), fts_snippet, '') AS snippet, first.t AS timestamp_ms,
    list_sort(list_concat(coalesce(vec_sources, []), CASE WHEN fts_score IS NOT NULL THEN ['fts'] ELSE [] END)) AS sources FROM scores FULL JOIN fts USING (file_id)),
  results AS (SELECT u.*, t.path, t.type, t.mtime_ns FROM fused u JOIN typed_v t USING (file_id))"""
_RESULT_COLUMNS_SQL = "file_id, path, type, round(score, 6) AS score, snippet, timestamp_ms, array_to_string(sources, ',') AS sources"


def _fts_docs(spark, sf):
    return V.files(spark, sf).select("file_id", "path", paths.basename(F.col("path")).alias("basename")).join(V.texts(spark, sf).select("file_id", F.substring("text", 1, 512).alias("snippet")), "file_id")


_FTS_COLUMNS = ["path", "basename", "snippet"]


def _file_index(spark, sf):
    return _index(spark, sf, "files", _fts_docs, "file_id", _FTS_COLUMNS)


def _fts(spark, sf):
    docs = _fts_docs(spark, sf)
    hits = lexical.search(_file_index(spark, sf), "thing en", "file_id", _FTS_COLUMNS, 50)
    return F.broadcast(hits).join(docs, "file_id").select("file_id", "fts_score", F.col("snippet").alias("fts_snippet"))


def _results(spark, sf):
    typed = V.files(spark, sf).withColumn("type", paths.file_type(F.col("path"))).select("file_id", "path", "type", "mtime_ns")
    return hybrid.fuse(_recall(spark, sf), _fts(spark, sf), typed)


def _shown(df):
    return df.select("file_id", "path", "type", F.round("score", 6).alias("score"), "snippet", "timestamp_ms", F.array_join("sources", ",").alias("sources"))


@query(f"WITH {_FTS_DOCS_SQL} SELECT file_id FROM fts_docs WHERE contains(' ' || array_to_string({_tokens_sql('path')}, ' ') || ' ', ' es ') AND contains(' ' || array_to_string({_tokens_sql('snippet')}, ' ') || ' ', ' de ')")
def fts_column(spark, sf):
    query = lexical.parse_query("path : es {snippet} : de")
    return lexical.bm25(_file_index(spark, sf), query, "file_id", _FTS_COLUMNS).select("file_id")


@query(f"WITH {_FUSED_SQL} SELECT file_id FROM fused")
def candidate_union(spark, sf):
    return _recall(spark, sf).select("file_id").union(_fts(spark, sf).select("file_id")).distinct()


@query(f"WITH {_FUSED_SQL} SELECT file_id, array_to_string(sources, ',') AS sources FROM results")
def sources_collect(spark, sf):
    return _results(spark, sf).select("file_id", F.array_join("sources", ",").alias("sources"))


@query(f"WITH {_FUSED_SQL} SELECT {_RESULT_COLUMNS_SQL} FROM (SELECT * FROM results ORDER BY score DESC, file_id LIMIT 20) t")
def hybrid_search(spark, sf):
    return _shown(hybrid.best(_results(spark, sf), 20))


@query(f"WITH {_FUSED_SQL} SELECT {_RESULT_COLUMNS_SQL} FROM (SELECT * FROM results WHERE type = 'image' ORDER BY score DESC, file_id LIMIT 20) t")
def search_type_filter(spark, sf):
    return _shown(hybrid.best(hybrid.filtered(_results(spark, sf), type_filter="image"), 20))


@query(f"WITH {_FUSED_SQL} SELECT {_RESULT_COLUMNS_SQL} FROM (SELECT * FROM results WHERE path GLOB '/corpus/src1*/en/*' ORDER BY score DESC, file_id LIMIT 20) t")
def search_path_filter(spark, sf):
    return _shown(hybrid.best(hybrid.filtered(_results(spark, sf), path_glob="/corpus/src1*/en/*"), 20))


@query(f"WITH {_FUSED_SQL} SELECT {_RESULT_COLUMNS_SQL} FROM (SELECT * FROM results WHERE mtime_ns >= 1704240000000000000 ORDER BY score DESC, file_id LIMIT 20) t")
def search_since_filter(spark, sf):
    return _shown(hybrid.best(hybrid.filtered(_results(spark, sf), since="2024-01-03"), 20))


_TOP_SQL = f"{_FUSED_SQL}, top AS (SELECT *, row_number() OVER (ORDER BY score DESC, file_id) - 1 AS pos FROM results QUALIFY pos < 20)"


def _top(spark, sf):
    return hybrid.best(_results(spark, sf), 20).withColumn("pos", F.row_number().over(W.orderBy(F.desc("score"), "file_id")).cast("long") - 1)


@query(
    f"""WITH {_TOP_SQL}, o AS (SELECT p, min(i) AS at FROM (SELECT unnest([4, 2, 99, 2, -1, 0, 17]) AS p, unnest(range(7)) AS i) x WHERE p >= 0 AND p < 10 GROUP BY p)
    SELECT t.file_id, t.pos, CAST(row_number() OVER (ORDER BY CASE WHEN o.at IS NOT NULL THEN 0 WHEN t.pos < 10 THEN 1 ELSE 2 END, coalesce(o.at, t.pos)) - 1 AS BIGINT) AS new_pos,
    CASE WHEN o.at IS NOT NULL AND t.pos = 2 THEN 'why' END AS explanation FROM top t LEFT JOIN o ON o.p = t.pos"""
)
def rerank_apply(spark, sf):
    order = spark.createDataFrame([([4, 2, 99, 2, -1, 0, 17], {"2": " why ", "0": "  "})], "order array<int>, explanations map<string,string>")
    return hybrid.rerank(_top(spark, sf), order, max_items=10).select("file_id", "pos", "new_pos", "explanation")


@query(
    """SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'pdf' WHEN item_id % 2 = 0 THEN 'text' END AS type,
    coalesce(CASE WHEN item_id % 5 = 0 THEN 'user' END, CASE WHEN item_id % 2 = 0 THEN 'parsed' END) AS path_glob FROM benchmark"""
)
def query_rewrite_apply(spark, sf):
    """What a parsed query proposes counts only where the user left a filter open."""
    asked = V.table(spark, sf, "benchmark").select("item_id", F.when(F.col("item_id") % 3 == 0, "pdf").alias("user_type"), F.when(F.col("item_id") % 5 == 0, "user").alias("user_glob"))
    parsed = textf.json_in(F.when(F.col("item_id") % 2 == 0, F.lit('Sure! {"type": "text", "path_glob": "parsed"} Done.')).otherwise(F.lit("no json")))
    told = asked.withColumn("parsed", parsed)
    got = lambda name: F.try_variant_get("parsed", F.lit(f"$.{name}"), "string")
    return told.select("item_id", F.coalesce("user_type", got("type")).alias("type"), F.coalesce("user_glob", got("path_glob")).alias("path_glob"))


@query(
    f"""WITH {_FUSED_SQL}, top AS (SELECT * FROM results ORDER BY score DESC, file_id LIMIT 20), s AS (SELECT *, trim(replace(coalesce(snippet, ''), chr(10), ' ')) AS one FROM top)
    SELECT file_id, concat(format('{{:6.3f}}', score), ' [', type, '] ', path, CASE WHEN timestamp_ms IS NOT NULL THEN concat(' @', timestamp_ms, 'ms') ELSE '' END, ' (', array_to_string(sources, ','), ')') AS line,
    CASE WHEN length(one) > 140 THEN concat(substr(one, 1, 140), '…') ELSE one END AS shown FROM s WHERE type IS NOT NULL"""
)
def result_format(spark, sf):
    return hybrid.as_lines(hybrid.best(_results(spark, sf), 20).where(F.col("type").isNotNull())).select("file_id", "line", "shown")


# --- Tables and state ------------------------------------------------------------------------------------------------

_OLD_SQL = "old_f AS (SELECT path, size_bytes, mtime_ns, 'indexed' AS status, 'm' AS mime, file_id, 1000 AS created_at FROM files_v WHERE file_id % 3 <> 0)"
_NEW_SQL = "new_f AS (SELECT path, size_bytes + CASE WHEN file_id % 5 = 0 THEN 1 ELSE 0 END AS size_bytes, mtime_ns, 'indexing' AS status, CAST(NULL AS VARCHAR) AS mime, file_id + 1000000 AS file_id, 2000 AS created_at FROM files_v WHERE file_id % 2 = 0)"


def _old_new(spark, sf):
    f = V.files(spark, sf)
    old = f.where("file_id % 3 <> 0").select("path", "size_bytes", "mtime_ns", F.lit("indexed").alias("status"), F.lit("m").alias("mime"), "file_id", F.lit(1000).alias("created_at"))
    new = f.where("file_id % 2 = 0").select(
        "path", (F.col("size_bytes") + F.when(F.col("file_id") % 5 == 0, 1).otherwise(0)).alias("size_bytes"), "mtime_ns", F.lit("indexing").alias("status"), F.lit(None).cast("string").alias("mime"), (F.col("file_id") + 1000000).alias("file_id"), F.lit(2000).alias("created_at")
    )
    return old, new


@query(
    f"""WITH {V.FILES_SQL}, {_OLD_SQL}, {_NEW_SQL} SELECT coalesce(n.path, o.path) AS path, CASE WHEN n.path IS NOT NULL THEN n.size_bytes ELSE o.size_bytes END AS size_bytes,
    CASE WHEN n.path IS NOT NULL THEN n.status ELSE o.status END AS status, CASE WHEN n.path IS NOT NULL THEN n.mime ELSE o.mime END AS mime,
    coalesce(o.file_id, n.file_id) AS file_id, coalesce(o.created_at, n.created_at) AS created_at FROM old_f o FULL JOIN new_f n ON o.path = n.path"""
)
def upsert_files(spark, sf):
    old, new = _old_new(spark, sf)
    return tables.upsert(old, new, "path", ["size_bytes", "status", "mime"], ["file_id", "created_at"])


@query(
    f"""WITH {V.FILES_SQL}, {_OLD_SQL}, {_NEW_SQL} SELECT n.path, n.size_bytes FROM new_f n LEFT JOIN old_f o ON o.path = n.path
    WHERE o.path IS NULL OR o.size_bytes IS DISTINCT FROM n.size_bytes OR o.mtime_ns IS DISTINCT FROM n.mtime_ns"""
)
def incremental_changed(spark, sf):
    old, new = _old_new(spark, sf)
    return tables.changed(new, old).select("path", "size_bytes")


@query(f"WITH {V.VEC_SQL} SELECT vector_id, file_id FROM vec_v WHERE vector_id IN (SELECT event_id % 400 FROM events WHERE user_id % 10 = 0)")
def lookup_semi_join(spark, sf):
    wanted = V.table(spark, sf, "events").where("user_id % 10 = 0").select((F.col("event_id") % 400).alias("vector_id")).distinct()
    return V.vectors(spark, sf).select("vector_id", "file_id").join(wanted, "vector_id", "left_semi")


@query(f"WITH c AS ({_CHUNKS_SQL}) SELECT file_id, chunk_no FROM c WHERE file_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr')")
def clear_children(spark, sf):
    gone = V.table(spark, sf, "documents").where("lang = 'fr'").select(F.col("doc_id").alias("file_id"))
    return tables.without(indexing.text_chunks(V.texts(spark, sf)), gone, "file_id").select("file_id", "chunk_no")


@query(
    f"""WITH {V.ARCH_SQL}, f AS (SELECT file_id, concat('/a/', file_id, '.zip') AS real_path, concat('/a/', file_id, '.zip::', inner_path) AS path FROM arch_v
      UNION SELECT DISTINCT file_id, concat('/a/', file_id, '.zip'), concat('/a/', file_id, '.zip') FROM arch_v)
    SELECT path FROM f WHERE NOT (file_id % 4 = 0 AND path <> real_path)"""
)
def delete_virtual_files(spark, sf):
    entries = V.archive_entries(spark, sf)
    archive = F.concat(F.lit("/a/"), "file_id", F.lit(".zip"))
    inner = entries.select("file_id", archive.alias("real_path"), archives.virtual_path(archive, F.col("inner_path")).alias("path"))
    every = inner.unionByName(entries.select("file_id", archive.alias("real_path"), archive.alias("path"))).distinct()
    gone = tables.virtual_files(every, F.when(F.col("file_id") % 4 == 0, F.col("real_path")))
    return tables.without(every, gone, "path").select("path")


@query(f"WITH c AS ({_CHUNKS_SQL}) SELECT file_id, chunk_no, 41 + row_number() OVER (ORDER BY file_id, chunk_no) AS vector_id FROM c")
def allocate_vector_ids(spark, sf):
    chunks = indexing.text_chunks(V.texts(spark, sf)).select("file_id", "chunk_no")
    return tables.dense_ids(chunks, "vector_id", 42, "file_id", "chunk_no")


_STATE_SQL = "SELECT event_type AS key, props AS value, ts, event_id FROM events"


@query(f"WITH s AS ({_STATE_SQL}) SELECT key, arg_max(value, event_id) AS value FROM s GROUP BY key")
def state_kv_upsert(spark, sf):
    states = V.table(spark, sf, "events").select(F.col("event_type").alias("key"), F.col("props").alias("value"), "event_id")
    return states.groupBy("key").agg(F.max_by("value", "event_id").alias("value"))


@query(
    f"""WITH s AS ({_STATE_SQL}), l AS (SELECT key, arg_max(value, event_id) AS value FROM s GROUP BY key)
    SELECT k AS key, coalesce((SELECT replace(value, ' ', '') FROM l WHERE l.key = k), d) AS value FROM (VALUES ('click', NULL), ('missing', 'none')) AS t(k, d)"""
)
def state_kv_get(spark, sf):
    state = state_kv_upsert(spark, sf)
    return tables.state_value(state, "click").unionByName(tables.state_value(state, "missing", "none"))


@query(
    f"""WITH {V.TYPED_SQL} SELECT coalesce(type, 'none') AS type, count(*) AS enqueued, count(*) FILTER (WHERE type IS NOT NULL AND type <> 'audio') AS processed,
    count(*) FILTER (WHERE type = 'audio') AS skipped, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM typed_v GROUP BY 1"""
)
def index_status(spark, sf):
    typed = V.files(spark, sf).withColumn("type", paths.file_type(F.col("path")))
    return typed.groupBy(F.coalesce("type", F.lit("none")).alias("type")).agg(
        F.count("*").alias("enqueued"), F.count_if(F.col("type").isNotNull() & (F.col("type") != "audio")).alias("processed"), F.count_if(F.col("type") == "audio").alias("skipped"), F.sum("size_bytes").alias("size_bytes")
    )


@query(f"WITH {V.FILES_SQL} SELECT DISTINCT regexp_replace(path, '/doc_.*', '') AS path FROM files_v")
def dedup_paths(spark, sf):
    return V.files(spark, sf).select(F.regexp_replace("path", "/doc_.*", "").alias("path")).dropDuplicates(["path"])


# --- Archives --------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS file_id, CASE WHEN o_totalprice > 200000 THEN 'peek' ELSE 'extract' END AS route FROM orders")
def archive_route(spark, sf):
    return V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("file_id"), F.when(archives.is_large(F.col("o_totalprice"), 200000), "peek").otherwise("extract").alias("route"))


@query(f"WITH {V.ARCH_SQL} SELECT file_id, count(*) AS n_entries, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM arch_v JOIN orders ON o_orderkey = file_id WHERE o_totalprice > 200000 GROUP BY 1")
def archive_peek(spark, sf):
    large = V.table(spark, sf, "orders").where(archives.is_large(F.col("o_totalprice"), 200000)).select(F.col("o_orderkey").alias("file_id"))
    return V.archive_entries(spark, sf).join(large, "file_id").groupBy("file_id").agg(F.count("*").alias("n_entries"), F.sum("size_bytes").alias("size_bytes"))


@query(
    f"""WITH {V.ARCH_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY string_split(inner_path, '/'), size_bytes) AS rn FROM arch_v)
    SELECT file_id, count(*) AS n_entries, string_agg(inner_path, chr(10) ORDER BY rn) FILTER (WHERE rn <= 4) AS inner_paths FROM r GROUP BY file_id"""
)
def archive_inner_paths(spark, sf):
    return archives.listed_paths(V.archive_entries(spark, sf), most=4)


@query(
    f"""WITH {V.ARCH_SQL} SELECT concat('/a/', file_id, '.zip::', inner_path) AS path, concat('/a/', file_id, '.zip') AS real_path, 'text' AS type, size_bytes FROM arch_v
    WHERE NOT (concat('/', inner_path) GLOB '*/dir1*/**')"""
)
def archive_virtual_files(spark, sf):
    archive = F.concat(F.lit("/a/"), "file_id", F.lit(".zip"))
    ignore = ["*/dir1*/**"]
    members = archives.guarded(V.archive_entries(spark, sf)).where(~paths.matches_any(F.concat(F.lit("/"), "inner_path"), ignore))
    path = archives.virtual_path(archive, F.col("inner_path"))
    return members.select(path.alias("path"), archive.alias("real_path"), paths.file_type(F.col("inner_path")).alias("type"), "size_bytes").where(~paths.matches_any(F.col("path"), ignore))


_MEMBERS = ("{}", "/{}", "../{}", "a/../{}", "a/../../{}", "\\\\{}", "./{}", "a\\..\\..\\{}")
_SAFE = (True, True, False, True, False, False, True, False)


@query(f"WITH {V.ARCH_SQL} SELECT file_id, l_linenumber, inner_path, CASE (file_id + l_linenumber) % 8 {' '.join(f'WHEN {i} THEN {str(s).lower()}' for i, s in enumerate(_SAFE))} END AS safe FROM arch_v")
def zip_slip_guard(spark, sf):
    entries = V.archive_entries(spark, sf)
    crafted = F.lit(None).cast("string")
    for i, form in enumerate(_MEMBERS):
        head = form.replace("{}", "")
        crafted = F.when((F.col("file_id") + F.col("l_linenumber")) % 8 == i, F.concat(F.lit(head), "inner_path")).otherwise(crafted)
    return entries.select("file_id", "l_linenumber", "inner_path", paths.safe_member(crafted).alias("safe"))


# --- Load, status, JSON ----------------------------------------------------------------------------------------------


@query(
    """SELECT event_id, CASE WHEN event_id % 50 < 2 THEN 'mem_available_gb<2.00' WHEN value > 70 THEN 'cpu>70%' WHEN event_id % 7 > 6.4 * 0.8 THEN 'load1>5.12' END AS reason FROM events"""
)
def load_is_high(spark, sf):
    e = V.table(spark, sf, "events")
    load1 = F.when(F.col("event_id") % 7 != 0, (F.col("event_id") % 7).cast("double"))
    return e.select("event_id", load.high_reason((F.col("event_id") % 50).cast("double"), F.col("value"), load1, F.lit(6.4)).alias("reason"))


_DEBOUNCE_SQL = (
    f"""WITH {V.LOAD_SQL}, s AS (SELECT *, epoch(ts) AS at_s FROM load_v),
    a AS (SELECT *, coalesce(lag(high) OVER w <> high, true) AS is_first FROM s WINDOW w AS (PARTITION BY user_id ORDER BY at_s, event_id)),
    b AS (SELECT *, sum(is_first::INT) OVER (PARTITION BY user_id ORDER BY at_s, event_id) AS island FROM a),
    c AS (SELECT *, at_s - min(at_s) OVER (PARTITION BY user_id, island) AS held FROM b),
    d AS (SELECT *, CASE WHEN high AND held >= 3600 THEN true WHEN NOT high AND held >= 7200 THEN false END AS told FROM c)
    SELECT event_id, user_id, coalesce(last_value(told IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY at_s, event_id), false) AS paused FROM d"""
)


@query(_DEBOUNCE_SQL)
def load_debounce(spark, sf):
    samples = V.load(spark, sf).withColumn("at_s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return load.debounced(samples, "user_id", "at_s", "high", 3600, 7200).select("event_id", "user_id", "paused")


@query(
    """WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, epoch_us(ts) // 1000 AS at_ms FROM events),
    w AS (SELECT user_id, min((at_ms, event_id)) AS beat FROM e GROUP BY 1
      UNION ALL SELECT e.user_id, min((e.at_ms, e.event_id)) FROM w JOIN e ON e.user_id = w.user_id AND e.at_ms >= w.beat[1] + 86400000 GROUP BY 1)
    SELECT user_id, beat[1] AS at_ms, beat[2] AS event_id FROM w"""
)
def status_throttle(spark, sf):
    e = V.table(spark, sf, "events").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return load.throttled(e, "user_id", "at_ms", 86_400_000)


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(props->>'$.k' AS BIGINT) END AS k FROM events""")
def json_extract(spark, sf):
    e = V.table(spark, sf, "events").select("event_id", "props")
    told = F.element_at(F.array("props", F.concat(F.lit("Here: "), "props", F.lit("\nok?")), F.concat(F.lit("  "), "props", F.lit("\n")), F.lit("no {json} here")), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select("event_id", F.try_variant_get(textf.json_in(told), F.lit("$.k"), "long").alias("k"))


@query(f"WITH {V.TYPED_SQL}, c AS ({_CHUNKS_SQL}) SELECT file_id, type, count(chunk_no) AS n_chunks FROM typed_v JOIN c USING (file_id) WHERE type = 'text' GROUP BY 1, 2")
def stream_index_once(spark, sf):
    from fathomix.streaming.index import index_available

    return index_available(spark, f"{sf.rstrip('/')}/documents.parquet")


@query(_DEBOUNCE_SQL)
def stream_debounce(spark, sf):
    from fathomix.streaming.index import debounced_stream, drained, state_in_rocksdb, table_stream

    events = table_stream(spark, f"{sf.rstrip('/')}/events.parquet")
    samples = events.select(F.col("user_id").cast("long").alias("key"), F.col("event_id").cast("long").alias("event_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at_s"), (F.col("value") > 70).alias("high"))
    with state_in_rocksdb(spark):
        return drained(debounced_stream(samples, 3600, 7200)).select("event_id", F.col("key").alias("user_id"), "paused")


@query(f"WITH {V.FILES_SQL} SELECT DISTINCT regexp_replace(path, '/doc_.*', '') AS path FROM files_v")
def stream_dedup_paths(spark, sf):
    from fathomix.streaming.index import distinct_paths, drained, table_stream

    docs = table_stream(spark, f"{sf.rstrip('/')}/documents.parquet")
    seen = docs.select(F.regexp_replace(F.expr(V._PATH), "/doc_.*", "").alias("path"), F.timestamp_seconds(F.lit(1704067200)).alias("at"))
    return drained(distinct_paths(seen)).select("path")
