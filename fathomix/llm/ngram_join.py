"""Operator 4: n-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles; two are linked if their sets have a
Jaccard similarity of 0.8 or more.

1. A pass over all texts takes each set's MinHash signature and a hash of the whole
   set. Documents with equal sets form a class, from here on one representative.
2. Signatures are cut into bands; representatives that share a band are candidates.
   Their MinHash values are compared a few at a time, and a pair is dropped when the
   posterior probability that its similarity reaches the threshold (uniform prior)
   falls below TOLERANCE. What survives joins representatives to candidate groups; a
   bucket yields a spanning forest of its surviving pairs, never the pairs.
3. Within a candidate group every pair is verified exactly on the whole sets. A
   document's number of links is counted there, and the verified links give the
   classes of near duplicates by connected components.

Buckets and groups that are large are cut into blocks, and each pair of blocks is a
task's work of its own, so no group has to fit in one task and none is capped.
Buckets with the same members in several bands are compared once.

Shingles are compared by 64-bit hashes. The chance to miss a pair at the threshold is
that of sharing no band, (1 - 0.8**5)**24, or 7e-5, and less above it.

Defined results: words are runs of letters and digits, in lower case; a text of one
to four words has one shingle of all of them; a text without words, or a null one,
has no links; rows with a null id join classes like others, and come last where one
stands for a class, whose id is null if it has no other row; repeated rows are
copies of each other; equal ids with unlike texts are unlike sets, each with the
links of its own text; an empty table gives no rows. Columns other than doc_id and
text are not carried by the join; keep_one keeps all.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from fathomix.llm.chunk_cache import GenerationCache
from fathomix.llm.common import heavy_from, join_counted, materialize, nested
from fathomix.llm.components import connected

N, THRESHOLD = 5, 0.8
BANDS, BAND_ROWS = 24, 5
HASHES = BANDS * BAND_ROWS
#: MinHash values compared at a time, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 12, 1e-5
#: Members of a bucket's block; members and shingles of a candidate group's block.
BUCKET_BLOCK, GROUP_BLOCK, GROUP_SHINGLES = 512, 512, 1_000_000

WORDS = re.compile(r"\w+")
_MASK = (1 << 64) - 1
_PRIME = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _word_hashes() -> GenerationCache:
    return GenerationCache(lambda w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")), 60_000)


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_229)
    return rng.integers(0, 1 << 63, (HASHES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, (HASHES, 1), dtype=np.uint64)


def shingles(text: str) -> np.ndarray:
    """The set of hashed shingles of a text, ascending, without repeats."""
    words = WORDS.findall(text.lower())
    if not words:
        return np.empty(0, np.uint64)
    cache = _word_hashes()
    ids = np.array([cache[w] for w in words], np.uint64)
    n = min(N, len(ids))
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(_PRIME) + ids[k : len(ids) - n + 1 + k]
    # Finalisation, so that equal sums of unlike words do not show in single bits.
    out ^= out >> np.uint64(30)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return np.unique(out)


def set_hash(members: np.ndarray) -> tuple[int, int]:
    whole = xxhash.xxh3_128_digest(members.astype("<u8").tobytes())
    return int.from_bytes(whole[:8], "little", signed=True), int.from_bytes(whole[8:], "little", signed=True)


def minhash(members: np.ndarray) -> np.ndarray:
    """HASHES values of 16 bits."""
    a, b = _permutations()
    low = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(members), 2048):
        low = np.minimum(low, ((members[None, at : at + 2048] * a + b) >> np.uint64(32)).min(axis=1))
    return low.astype("<u2")


@lru_cache(maxsize=4)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """After each STEP values: the fewest matches that keep a pair.

    With a uniform prior the similarity after m matches of n is Beta(m + 1, n - m + 1);
    that it reaches the threshold is as likely as at most m successes of n + 1 at it.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def survivors(one: np.ndarray, n_one: int, others: np.ndarray, n_others: np.ndarray) -> np.ndarray:
    """Positions in others that are not pruned against one signature: lengths first, then MinHash by steps."""
    short, long = np.minimum(n_others, n_one), np.maximum(n_others, n_one)
    live = np.flatnonzero(short >= THRESHOLD * long - 1e-9)
    counts = np.zeros(len(live), np.int64)
    for k, least in enumerate(least_matches()):
        if not len(live):
            break
        s = slice(k * STEP, (k + 1) * STEP)
        counts += (others[live, s] == one[s]).sum(axis=1)
        keep = counts >= least
        live, counts = live[keep], counts[keep]
    return live


def bucket_forest(signatures: np.ndarray, lengths: np.ndarray, side: np.ndarray | None) -> list[tuple[int, int]]:
    """Edges between positions that span what survives; with sides, only pairs across them are compared.

    Each member is compared with those that its component has not reached yet, so a
    bucket of near copies costs about one comparison a member.
    """
    edges = []
    pools = [np.arange(len(lengths))] * 2 if side is None else [np.flatnonzero(side == 1), np.flatnonzero(side == 0)]
    unseen = np.ones(len(lengths), bool)
    for seed in range(len(lengths)):
        if not unseen[seed]:
            continue
        unseen[seed] = False
        front = [seed]
        while front:
            u = front.pop()
            pool = pools[0 if side is None else int(side[u])]
            left = pool[unseen[pool]]
            hits = left[survivors(signatures[u], lengths[u], signatures[left], lengths[left])]
            unseen[hits] = False
            edges += [(u, int(v)) for v in hits]
            front += hits.tolist()
    return edges


def intersections(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of all pairwise intersections: within a, or of a with b."""
    own = b is None
    sets = a if own else a + b
    if len(sets) == 2:
        n = np.intersect1d(sets[0], sets[1], assume_unique=True).size
        return np.array([[len(sets[0]), n], [n, len(sets[1])]]) if own else np.array([[n]])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    everywhere, shared = counts == len(sets), counts > 1
    number = np.cumsum(shared & ~everywhere) - 1
    use = (shared & ~everywhere)[column]
    owner, column = owner[use], number[column[use]]
    width = int(number[-1]) + 1 if len(number) else 0
    out = np.full((len(a), len(a) if own else len(b)), int(everywhere.sum()), np.int64)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    chunk = max(1, 4_000_000 // len(sets))
    for lo in range(0, width, chunk):
        s = slice(*np.searchsorted(column, [lo, lo + chunk]))
        block = np.zeros((len(sets), min(chunk, width - lo)), np.float32)
        block[owner[s], column[s] - lo] = 1
        out += np.rint(block @ block.T if own else block[: len(a)] @ block[len(a) :].T).astype(np.int64)
    if own:
        np.fill_diagonal(out, [len(x) for x in a])
    return out


def links(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """Which pairs reach the threshold; the diagonal within a is left out."""
    both = intersections(a, b)
    na = np.array([len(x) for x in a])[:, None]
    nb = np.array([len(x) for x in (a if b is None else b)])[None, :]
    out = both >= THRESHOLD * (na + nb - both) - 1e-9
    if b is None:
        np.fill_diagonal(out, False)
    return out


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric matrix."""
    unseen, edges = np.ones(len(linked), bool), []
    for seed in range(len(linked)):
        if not unseen[seed]:
            continue
        unseen[seed] = False
        front = [seed]
        while front:
            u = front.pop()
            hits = np.flatnonzero(linked[u] & unseen)
            unseen[hits] = False
            edges += [(u, int(v)) for v in hits]
            front += hits.tolist()
    return edges


def runs(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of a stream that is sorted by keys."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        values = [frame[k].to_numpy() for k in keys]
        change = np.flatnonzero(np.logical_or.reduce([v[1:] != v[:-1] for v in values])) + 1
        starts = [0, *change.tolist(), len(frame)]
        for lo, hi in zip(starts, starts[1:]):
            part = frame.iloc[lo:hi]
            if held and any(held[-1][k].iat[0] != part[k].iat[0] for k in keys):
                yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)


def tiled(df: DataFrame, blocks: Column, by: str) -> DataFrame:
    """Deals members into blocks by hash and each member to all tiles of its block.

    Adds lo, hi, the two blocks of a tile, and side: whether the member is of hi.
    """
    spread = df.withColumn("blocks", blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64(by), F.col("blocks")).cast("int"))
    single = spread.where("blocks = 1").select("*", F.lit(0).alias("other"))
    several = spread.where("blocks > 1").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return (
        single.unionByName(several)
        .withColumn("lo", F.least("own", "other"))
        .withColumn("hi", F.greatest("own", "other"))
        .withColumn("side", (F.col("own") > F.col("other")).cast("int"))
        .drop("blocks", "own", "other")
    )


def signature_table(docs: DataFrame) -> DataFrame:
    """(doc_id, t, n, h1, h2, signature): text hash, shingles, 128-bit hash of the set, MinHash; nulls without words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            n, h1, h2, signature = [], [], [], []
            for text in frame["text"]:
                members = shingles(text or "")
                n.append(len(members))
                if len(members):
                    a, b = set_hash(members)
                    h1.append(a), h2.append(b), signature.append(minhash(members).tobytes())
                else:
                    h1.append(None), h2.append(None), signature.append(None)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "t": frame["t"], "n": n, "h1": pd.array(h1, dtype="Int64"), "h2": pd.array(h2, dtype="Int64"), "signature": signature})

    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.xxhash64("text").alias("t"), F.col("text").cast("string").alias("text"))
    made = rows.mapInPandas(run, "doc_id string, t long, n long, h1 long, h2 long, signature binary")
    return materialize(made.withColumn("doc_id", F.col("doc_id").cast("long")), "signatures")


def candidate_groups(classes: DataFrame) -> DataFrame:
    """(node, root): components of a spanning forest, bucket by bucket, of pairs of classes that the Bayesian test keeps."""
    bands = F.array(*(F.xxhash64(F.lit(k), F.substring(F.col("signature"), 2 * BAND_ROWS * k + 1, 2 * BAND_ROWS)) for k in range(BANDS)))
    listed = classes.select("h1", F.explode(bands).alias("bucket"))
    buckets = listed.groupBy("bucket").agg(F.count("*").alias("m"), F.bit_xor("h1").alias("x"), F.bit_xor(F.xxhash64("h1")).alias("s"))
    once = buckets.where("m > 1").groupBy("m", "x", "s").agg(F.min("bucket").alias("bucket")).select("bucket", "m")
    total = BANDS * classes.count()
    members = join_counted(listed, once, ["bucket"], "m", total, heavy=buckets.where(F.col("m") > heavy_from(total)))
    members = members.join(classes.select("h1", "n", "signature"), "h1")
    tiles = tiled(members, F.ceil(F.col("m") / BUCKET_BLOCK), "h1").drop("m")
    keys = ["bucket", "lo", "hi"]

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        u: list[int] = []
        v: list[int] = []
        for group in runs(frames, keys):
            key = group["h1"].to_numpy()
            if len(key) < 2:
                continue
            signatures = np.frombuffer(b"".join(group["signature"]), "<u2").reshape(len(key), HASHES)
            side = None if group["lo"].iat[0] == group["hi"].iat[0] else group["side"].to_numpy()
            for a, b in bucket_forest(signatures, group["n"].to_numpy(), side):
                u.append(key[a])
                v.append(key[b])
            if len(u) > 100_000:
                yield pd.DataFrame({"u": u, "v": v})
                u, v = [], []
        yield pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})

    return connected(tiles.repartition(*keys).sortWithinPartitions(*keys), compare)


def verified(docs: DataFrame, classes: DataFrame, groups: DataFrame) -> DataFrame:
    """Exact verification within candidate groups.

    Rows (u, v, links): with v a link of a spanning forest, with v null a number of
    linked documents of u's class (several rows a class add up).
    """
    members = groups.select(F.col("node").alias("h1"), F.col("root").alias("group")).join(classes.select("rep", "rep_t", "n", "h1", "copies"), "h1")
    sizes = members.groupBy("group").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    blocks = sizes.select("group", "m", F.greatest(F.ceil(F.col("m") / GROUP_BLOCK), F.ceil(F.col("total") / GROUP_SHINGLES)).alias("blocks"))
    dealt = join_counted(members, blocks, ["group"], "m", groups.count()).drop("m", "n")
    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), F.xxhash64("text").alias("rep_t"), F.col("text").cast("string").alias("text"))
    texts = rows.join(dealt.where("rep is not null"), ["rep", "rep_t"])
    # Rows without an id are found by their text, each text once.
    nameless = rows.where("rep is null").drop("rep").dropDuplicates(["rep_t"]).join(dealt.where("rep is null"), "rep_t")
    texts = texts.unionByName(nameless.select(*texts.columns))

    def whole_sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 256):
                part = frame.iloc[at : at + 256]
                sets = [shingles(t or "") for t in part["text"]]
                # Of rows that share an id, those with the text that the class is of.
                same = np.array([len(s) > 0 and set_hash(s)[0] == h for s, h in zip(sets, part["h1"])], bool)
                kept = part[same]
                yield pd.DataFrame({"h1": kept["h1"], "group": kept["group"], "copies": kept["copies"], "blocks": kept["blocks"], "members": [s.astype("<u8").tobytes() for s, ok in zip(sets, same) if ok]})

    sets = texts.mapInPandas(whole_sets, "h1 long, group long, copies long, blocks long, members binary")
    tiles = tiled(sets, F.col("blocks"), "h1")
    keys = ["group", "lo", "hi"]

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple[int, int | None, int]] = []
        for group in runs(frames, keys):
            group = group.drop_duplicates("h1")
            key, copies = group["h1"].to_numpy(), group["copies"].to_numpy()
            members = [np.frombuffer(x, "<u8") for x in group["members"]]
            if group["lo"].iat[0] == group["hi"].iat[0]:
                linked = links(members, None)
                forest = [(key[a], key[b]) for a, b in spanning(linked)]
                counts = [(r, int(c)) for r, c in zip(key, linked @ copies)]
            else:
                side = group["side"].to_numpy() == 1
                a, b = np.flatnonzero(~side), np.flatnonzero(side)
                if not len(a) or not len(b):
                    continue
                linked = links([members[i] for i in a], [members[i] for i in b])
                square = np.zeros((len(key), len(key)), bool)
                square[np.ix_(a, b)] = linked
                forest = [(key[i], key[j]) for i, j in spanning(square | square.T)]
                counts = [(key[i], int(c)) for i, c in zip(a, linked @ copies[b])] + [(key[i], int(c)) for i, c in zip(b, linked.T @ copies[a])]
            out += [(int(u), int(v), 0) for u, v in forest] + [(int(u), None, c) for u, c in counts if c]
            if len(out) > 50_000:
                yield as_frame(out)
                out = []
        yield as_frame(out)

    def as_frame(rows: list[tuple]) -> pd.DataFrame:
        u, v, n = zip(*rows) if rows else ((), (), ())
        return pd.DataFrame({"u": np.array(u, np.int64), "v": pd.array(v, dtype="Int64"), "links": np.array(n, np.int64)})

    return materialize(tiles.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(verify, "u long, v long, links long"), "verified")


def classified(docs: DataFrame) -> DataFrame:
    """(doc_id, t, class_id, copy_of, n_links, kept, words) of every row; kept: whether the row stands for its class."""
    table = signature_table(docs)
    own = F.col("n") > 0
    one = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "t", "n", "signature")
    classes = materialize(
        table.where(own)
        .groupBy("h1", "h2")
        .agg(F.min(one).alias("r"), F.count("*").alias("copies"))
        .select(F.col("r.doc_id").alias("rep"), F.col("r.t").alias("rep_t"), F.col("r.n").alias("n"), "h1", "h2", F.col("r.signature").alias("signature"), "copies"),
        "classes",
    )
    found = verified(docs, classes, candidate_groups(classes))
    roots = connected(found.where("v is not null").select("u", "v")).withColumnRenamed("node", "h1")
    counts = found.where("v is null").groupBy(F.col("u").alias("h1")).agg(F.sum("links").alias("links"))
    narrow = classes.select("h1", "h2", "rep", "rep_t", "copies").join(roots, "h1", "left").join(counts, "h1", "left")
    narrow = materialize(narrow.withColumn("root", F.coalesce("root", "h1")), "class-roots")
    heads = narrow.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("nameless"), "rep", "rep_t")).alias("head"), F.count("*").alias("m"))
    about = join_counted(narrow, heads, ["root"], "m", narrow.count())
    about = materialize(about.select("h1", "h2", "copies", "rep", "head", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "about")
    joined = join_counted(table.where(own).select("doc_id", "t", "h1", "h2"), about, ["h1", "h2"], "copies", table.count())
    kept = F.col("doc_id").eqNullSafe(F.col("head.rep")) & (F.col("t") == F.col("head.rep_t"))
    alone = table.where(~own).select("doc_id", "t", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"), F.lit(False).alias("words"))
    return joined.select("doc_id", "t", F.col("head.rep").alias("class_id"), F.col("rep").alias("copy_of"), "n_links", kept.alias("kept"), F.lit(True).alias("words")).unionByName(alone)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, copy_of, n_links) of every row.

    copy_of: the smallest id with the same set of shingles. class_id: the smallest id
    that links lead to. n_links: other rows that reach the threshold with this one.
    """
    return classified(docs).select("doc_id", "class_id", "copy_of", "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each class, and all documents without links; all columns stay.

    Of the class its smallest id stays. Rows equal in id and text count once, unless
    the id is null and the text has no words: such rows all stay.
    """
    # Read four times below; unwritten, each plan would hold all of its joins as often.
    told = materialize(classified(docs).select("doc_id", "t", "kept", "words"), "told")
    dropped = told.where(~F.col("kept")).select(F.col("doc_id").alias("gone_i"), F.col("t").alias("gone_t")).distinct()
    wordless = told.where(F.col("doc_id").isNull() & ~F.col("words")).select(F.col("t").alias("gone_t")).distinct()
    rows = nested(docs, i=F.col("doc_id").cast("long"), t=F.xxhash64("text"))
    stays = rows.join(dropped, F.col("i").eqNullSafe(F.col("gone_i")) & (F.col("t") == F.col("gone_t")), "left_anti")
    empty = F.col("i").isNull() & (F.col("t") == F.col("gone_t"))
    once = stays.join(wordless, empty, "left_anti").dropDuplicates(["i", "t"])
    return once.unionByName(stays.join(wordless, empty, "left_semi")).select("row.*")
