"""Operator 5: document fingerprints by SpotSigs.

A signature is a chain of the CHAIN content words that follow an anchor, a common
word of English, French, German or Spanish; anchors between them are passed over.
A text's beginning is an anchor too, so that every text with a content word has a
signature. A fingerprint is the set of a text's 64-bit signature hashes, as one string
of sixteen hex digits each, ordered as signed integers.

Fingerprints are compared by Jaccard similarity, pruned by length: sets of m <= n
members cannot reach t if m / n < t. near_pairs() partitions sets by length so that
only neighbouring partitions can hold partners, and meets them through the rarest
members of each set.

Everything is DataFrame operations: text functions mark the anchors, one pattern
reads the chains off, and array functions compare.

Defined results: a null text counts as empty; a text without content words has the
empty fingerprint, which is wholly like another empty one and unlike all others; a
null id comes last in descending order; equal ids are ordered by a hash of their
text, descending; a table of one row is its own next document; an empty table gives no rows.
Columns other than doc_id and text are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fathomix.llm.common import NULL_ID, join_counted, materialize, range_bounds, range_bucket

# The anchors.
ANCHORS = {
    "en": "the of and to a in is that it was for on be with as by at this are from an or he she they we you not but have has had which were their been will would there if when can",
    "fr": "le la les de des du un une et à en est que qui dans pour sur par avec ne pas au aux ce il elle son sa ses plus ou on nous vous",
    "de": "der die das und in zu den von mit ist des auf für im dem nicht ein eine als auch es an er sie so dass aus bei nach wird sich einer",
    "es": "el la los las de que y en un una por con para del se no al es lo como más su sus o pero le ya este esta",
}
#: Content words in a chain.
CHAIN = 2
#: Rows of a member's block in near_pairs, about.
SALT_ROWS = 1_000
#: Documents that are ordered together to find each one's next, about.
RANGE_ROWS = 2_048


def trie_pattern(words: list[str]) -> str:
    """A pattern for exactly these words that branches letter by letter, so that it fails early."""
    branches: dict[str, list[str]] = {}
    for w in words:
        if w:
            branches.setdefault(w[0], []).append(w[1:])
    tails = [head + trie_pattern(rest) for head, rest in sorted(branches.items())]
    body = tails[0] if len(tails) == 1 else f"(?:{'|'.join(tails)})"
    return "" if not tails else f"(?:{body})?+" if "" in words else body


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """The set of signature hashes of a text, ascending: array<bigint>."""
    words = sorted({w for ws in ANCHORS.values() for w in ws.split()})
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    # Each anchor becomes '#'; lookarounds leave the blanks to both neighbours.
    marked = F.regexp_replace(plain, rf"(?<= ){trie_pattern(words)}(?= )", "#")
    marked = F.concat(F.lit(" #"), marked)
    chains = F.regexp_extract_all(marked, F.lit(rf" #(?=(?: #)*( [^ #]+(?:(?: #)* [^ #]+){{0,{chain - 1}}}))"), F.lit(1))
    hashed = F.transform(chains, lambda c: F.xxhash64(F.regexp_replace(c, r"(?: #)+", "")))
    return F.array_sort(F.array_distinct(hashed))


def fingerprint_text(members: Column) -> Column:
    return F.array_join(F.transform(members, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two sets; of two empty ones 1."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def pruned_jaccard(a: Column, b: Column, threshold: float) -> Column:
    """jaccard where lengths allow the threshold, else null without comparing members."""
    short, long = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    return F.when(short >= threshold * long, jaccard(a, b))


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(id_a, id_b, similarity) of texts with different fingerprints that reach threshold.

    Equal fingerprints are one class, named by their smallest doc_id (null without one)
    and told from others by a hash of their members, so ids may repeat. Classes are
    partitioned by set length in steps of 1 / threshold: a partner lies in the same
    partition or the next. Within partitions classes meet on the members of their
    prefix: the rarest of their members, of which any pair that reaches the
    threshold shares at least one. They are compared within the join, so only pairs
    that reach it leave it. A member of many prefixes is salted: its classes are dealt
    into blocks, and each block meets all of them in a task of its own.
    """
    sets = docs.select(F.col("doc_id").cast("long").alias("doc_id"), signatures(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("members"))
    key = F.struct(F.xxhash64("members").alias("x"), F.xxhash64(F.lit(1), "members").alias("y"))
    classes = sets.where(F.size("members") > 0).groupBy("members").agg(F.min("doc_id").alias("id"))
    step = F.floor(F.log(F.size("members").cast("double")) / -F.log(F.lit(threshold)) + 1e-9).cast("int")
    classes = materialize(classes.select(key.alias("c"), "id", "members", step.alias("step")), "spot-classes")
    listed = classes.select("c", F.size("members").alias("size"), "step", F.explode("members").alias("member"))
    counts = materialize(listed.groupBy("member").agg(F.count("*").alias("n")), "spot-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    by_rarity = join_counted(listed, counts, ["member"], "n", total).groupBy("c", "size", "step").agg(F.array_sort(F.collect_list(F.struct("n", "member"))).alias("all"))
    prefix = F.col("size") - F.ceil(threshold * F.col("size") - 1e-9).cast("int") + 1
    heads = by_rarity.select("c", "step", F.explode(F.slice("all", F.lit(1), prefix)).alias("m")).select("c", "step", F.col("m.member").alias("member"))
    near = F.array(F.col("step"), F.col("step") + 1, F.col("step") - 1)
    heads = materialize(heads, "spot-heads")
    uses = heads.groupBy("member").agg(F.count("*").alias("uses"))
    salted = join_counted(heads, uses, ["member"], "uses", heads.count()).withColumn("blocks", F.ceil(F.col("uses") / SALT_ROWS).cast("int")).join(classes.select("c", "id", "members"), "c")
    own = F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")
    left = salted.select(F.col("c").alias("ca"), F.col("id").alias("id_a"), F.col("members").alias("a"), "step", "member", own.alias("salt"))
    right = salted.select(F.col("c").alias("cb"), F.col("id").alias("id_b"), F.col("members").alias("b"), F.explode(near).alias("step"), "member", "blocks")
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in ("step", "member", "salt")]
    close = pruned_jaccard(F.col("a"), F.col("b"), threshold)
    found = left.alias("l").join(right.alias("r"), [*same, F.col("ca") < F.col("cb"), close >= threshold]).select("ca", "cb", "id_a", "id_b", close.alias("similarity"))
    once = found.dropDuplicates(["ca", "cb"])
    turned = F.col("id_b") < F.col("id_a")
    return once.select(F.when(turned, F.col("id_b")).otherwise(F.col("id_a")).alias("id_a"), F.when(turned, F.col("id_a")).otherwise(F.col("id_b")).alias("id_b"), "similarity")


def with_next(docs: DataFrame) -> DataFrame:
    """Adds members, next_text and next_members to (doc_id, text): those of the next document by descending id.

    Rows are cut into ranges of near-equal size by id, and the rows of one id that holds
    many by a hash of their texts. A range is ordered in one task; the first document of
    the range below joins it as a guest, so that its last document finds its next one
    too. The table of guests has one row a range, and ranges are limited in number, so
    it can be broadcast. Signatures are taken after the shuffle, once a row.
    """
    keyed = docs.withColumn("ord", F.coalesce("doc_id", F.lit(NULL_ID))).withColumn("tie", F.xxhash64("text"))
    ids = keyed.select("ord", "tie")
    bounds = range_bounds(ids, "ord", RANGE_ROWS)
    bucket = range_bucket(F.col("ord"), bounds, F.col("tie"))
    tops = sorted((r["bucket"], r["top"]["ord"], r["top"]["tie"]) for r in ids.groupBy(bucket.alias("bucket")).agg(F.max(F.struct("ord", "tie")).alias("top")).collect())
    own = keyed.withColumn("bucket", bucket).withColumn("guest", F.lit(False))
    hosts = [b for b, _, _ in tops[1:]] + [b for b, _, _ in tops[:1]]
    guests = docs.sparkSession.createDataFrame([(o, t, host) for (_, o, t), host in zip(tops, hosts)], "ord long, tie long, host int")
    # Rows equal in id and text are the same guest: one of them is enough.
    visiting = keyed.join(F.broadcast(guests), ["ord", "tie"]).dropDuplicates(["host"]).withColumn("bucket", F.col("host")).withColumn("guest", F.lit(True)).drop("host")
    dealt = own.unionByName(visiting).repartition("bucket").withColumn("members", signatures(F.col("text")))
    order = W.partitionBy("bucket").orderBy("guest", F.desc("ord"), F.desc("tie"))
    return (
        dealt.select("doc_id", "text", "members", "guest", F.lead("text").over(order).alias("next_text"), F.lead("members").over(order).alias("next_members"))
        .where(~F.col("guest"))
        .drop("guest")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    return (
        with_next(rows)
        .withColumn("edited", edited)
        .withColumn("edited_members", signatures(F.col("edited")))
        .select(
            "doc_id",
            n.cast("long").alias("n_chars"),
            F.sha2(F.col("edited"), 256).alias("edited_sha256"),
            fingerprint_text(F.col("members")).alias("fingerprint"),
            fingerprint_text(F.col("edited_members")).alias("edited_fingerprint"),
            jaccard(F.col("members"), F.col("edited_members")).alias("near_edited"),
            jaccard(F.col("members"), F.col("next_members")).alias("near_next"),
        )
    )
