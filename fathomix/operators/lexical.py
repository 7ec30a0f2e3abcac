"""Lexical search: BM25 over whole-text tokens, a small query grammar, ranked top-k.

An index is written once: a row a token and document with the token's positions and the
document's length, in folders by the token's first letters, sorted by token. A query
reads the folders and row groups of its own tokens only, and one row of figures of the
whole table. Without an index a scan gives the same rows, a document's positions of
the query's tokens, without exploding tokens or shuffling texts.

A position is a token's place in its column plus COLUMN times the column's number, so
no phrase crosses columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fathomix.functions.text import MARKED, PLAIN, lexical_tokens

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
COLUMN = 1 << 32
#: Folders of an index, how many letters of a token choose its folder, and the gap of NEAR without a number.
FOLDERS, LETTERS, NEAR_GAP = 64, 2, 10


@dataclass(frozen=True)
class Phrase:
    """Tokens that must follow each other; the last may be a prefix. columns: names it is looked for in; first: only at a column's start."""

    tokens: tuple[str, ...]
    prefix: bool = False
    columns: tuple[str, ...] | None = None
    first: bool = False

    @property
    def terms(self) -> tuple[tuple[str, bool], ...]:
        """(token, whether it is a prefix) of each token."""
        last = len(self.tokens) - 1
        return tuple((t, self.prefix and i == last) for i, t in enumerate(self.tokens))


@dataclass(frozen=True)
class Near:
    """Phrases with at most gap tokens between any two."""

    phrases: tuple[Phrase, ...]
    gap: int = NEAR_GAP


@dataclass(frozen=True)
class Both:
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Either:
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Without:
    """keep, but none of drop."""

    keep: Node
    drop: Node


Node = Phrase | Near | Both | Either | Without


def phrases_of(node: Node, scored_only: bool = False) -> list[Phrase]:
    """The phrases of a query in order; scored_only leaves out those that must be missing."""
    if isinstance(node, Phrase):
        return [node]
    if isinstance(node, Near):
        return list(node.phrases)
    parts = (node.keep,) if isinstance(node, Without) and scored_only else (node.keep, node.drop) if isinstance(node, Without) else node.parts
    return [p for part in parts for p in phrases_of(part, scored_only)]


def tokens_of(text: str) -> tuple[str, ...]:
    return tuple(re.findall(r"[^\W_]+", text.lower().translate(str.maketrans(MARKED, PLAIN))))


class _Malformed(Exception):
    pass


class _Parser:
    """Recursive descent. Blank-separated items bind tightest, then NOT, AND, OR."""

    LEXEME = re.compile(r'\s*(?:("(?:[^"]|"")*")|(\w+)|([(){}:,*^+-]))', re.UNICODE)

    def __init__(self, text: str) -> None:
        self.at, self.lexemes = 0, []
        end = 0
        while text[end:].strip():
            m = self.LEXEME.match(text, end)
            if m is None:
                raise _Malformed
            self.lexemes.append(m.group().strip())
            end = m.end()

    def peek(self, ahead: int = 0) -> str:
        return self.lexemes[self.at + ahead] if self.at + ahead < len(self.lexemes) else ""

    def take(self, wanted: str = "") -> str:
        found = self.peek()
        if not found or wanted and found != wanted:
            raise _Malformed
        self.at += 1
        return found

    def query(self) -> Node:
        node = self.either()
        if self.peek():
            raise _Malformed
        return node

    def either(self) -> Node:
        parts = [self.both()]
        while self.peek() == "OR":
            self.take()
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Either(tuple(parts))

    def both(self) -> Node:
        parts = [self.without()]
        while self.peek() == "AND":
            self.take()
            parts.append(self.without())
        return parts[0] if len(parts) == 1 else Both(tuple(parts))

    def without(self) -> Node:
        node = self.group()
        while self.peek() == "NOT":
            self.take()
            node = Without(node, self.group())
        return node

    def group(self) -> Node:
        parts = [self.item(None)]
        while self.peek() and self.peek() not in ("AND", "OR", "NOT", ")"):
            parts.append(self.item(None))
        return parts[0] if len(parts) == 1 else Both(tuple(parts))

    def item(self, columns: tuple[str, ...] | None) -> Node:
        if self.peek() == "{":
            self.take()
            names = []
            while self.peek() != "}":
                names.append(self.word())
            self.take("}")
            self.take(":")
            return self.item(tuple(names))
        if self.peek(1) == ":" and re.fullmatch(r"\w+", self.peek()):
            name = self.word()
            self.take(":")
            return self.item((name,))
        if self.peek() == "(":
            self.take()
            node = self.either()
            self.take(")")
            return limited(node, columns)
        if self.peek() == "NEAR" and self.peek(1) == "(":
            self.take(), self.take()
            phrases, gap = [], NEAR_GAP
            while self.peek() not in (",", ")"):
                phrases.append(self.phrase(columns))
            if self.take() == ",":
                gap = self.take()
                if not gap.isdecimal():
                    raise _Malformed
                gap = int(gap)
                self.take(")")
            if not phrases:
                raise _Malformed
            return Near(tuple(phrases), gap) if len(phrases) > 1 else phrases[0]
        return self.phrase(columns)

    def word(self) -> str:
        found = self.take()
        if not re.fullmatch(r"\w+", found):
            raise _Malformed
        return found

    def string(self) -> tuple[str, ...]:
        if self.peek().startswith('"'):
            return tokens_of(self.take()[1:-1].replace('""', " "))
        if self.peek() in ("AND", "OR", "NOT"):
            raise _Malformed
        return tokens_of(self.word())

    def phrase(self, columns: tuple[str, ...] | None) -> Phrase:
        first = self.peek() == "^"
        if first:
            self.take()
        tokens = self.string()
        while self.peek() == "+":
            self.take()
            tokens += self.string()
        prefix = self.peek() == "*"
        if prefix:
            self.take()
        if not tokens:
            raise _Malformed
        return Phrase(tokens, prefix, columns, first)


def limited(node: Node, columns: tuple[str, ...] | None) -> Node:
    """The node with its phrases limited to columns, and to those that they name themselves."""
    if columns is None:
        return node
    if isinstance(node, Phrase):
        own = columns if node.columns is None else tuple(c for c in node.columns if c in columns)
        return Phrase(node.tokens, node.prefix, own, node.first)
    if isinstance(node, Near):
        return Near(tuple(limited(p, columns) for p in node.phrases), node.gap)
    if isinstance(node, Without):
        return Without(limited(node.keep, columns), limited(node.drop, columns))
    return type(node)(tuple(limited(p, columns) for p in node.parts))


def parse_query(text: str) -> Node | None:
    """Blank-separated words are all required; OR, AND, NOT, parentheses, "phrases", a + b, prefix*, ^first, column : word
    and NEAR(a b, 3) are understood.

    What is not well formed (other punctuation, dangling operators, an open quote)
    counts as one phrase of the whole text without its quotes. None: nothing to find.
    """
    if not text.strip():
        return None
    try:
        return _Parser(text).query()
    except _Malformed:
        tokens = tokens_of(text.replace('"', " "))
        return Phrase(tokens) if tokens else None


def terms_of(query: Node) -> list[tuple[str, bool]]:
    return list(dict.fromkeys(t for p in phrases_of(query) for t in p.terms))


def is_term(token: Column, term: tuple[str, bool]) -> Column:
    return token.startswith(term[0]) if term[1] else token == term[0]


# Positions of a query's terms --------------------------------------------------------------------------------------


def scanned(docs: DataFrame, terms: list[tuple[str, bool]], id_column: str, text_columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(id, dl, p0, p1, ...) of all documents, pk the positions of the kth term, and one row (n, avgdl)."""
    tokens = [lexical_tokens(F.coalesce(F.col(c), F.lit(""))).alias(f"c{k}") for k, c in enumerate(text_columns)]
    # The tokens pass a generator of one row: filters do not move below it, so they are made once a document.
    once = docs.select(F.col(id_column).alias("id"), F.explode(F.array(F.struct(*tokens))).alias("t"))

    def in_column(k: int, term: tuple[str, bool]) -> Column:
        return F.transform(F.col(f"t.c{k}"), lambda t, i: F.when(is_term(t, term), i + F.lit(k * COLUMN)))

    def positions(term: tuple[str, bool]) -> Column:
        return F.filter(F.concat(*(in_column(k, term) for k in range(len(text_columns)))), lambda x: x.isNotNull())

    length = sum((F.size(f"t.c{k}") for k in range(len(text_columns))), F.lit(0)).cast("double")
    wide = once.select("id", length.alias("dl"), *(positions(t).alias(f"p{j}") for j, t in enumerate(terms)))
    return wide, wide.agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"))


def folder_of(token: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(token, 1, LETTERS)), F.lit(FOLDERS)).cast("int")


@dataclass(frozen=True)
class LexicalIndex:
    """postings: (token, id, dl, positions, folder); figures: one row (n, avgdl); text_columns in the order of their numbers.

    live: (id, run) of the documents that count, if postings have a run and not all do.
    """

    postings: DataFrame
    figures: DataFrame
    text_columns: tuple[str, ...]
    live: DataFrame | None = None

    def wide(self, terms: list[tuple[str, bool]]) -> tuple[DataFrame, DataFrame]:
        """As scanned(), of the documents that hold one of the terms."""
        token = F.col("token")
        wanted, folders = F.lit(False), set()
        for t in terms:
            wanted = wanted | is_term(token, t)
            # A prefix shorter than what chooses a folder may lie in any.
            folders.add(t[0][:LETTERS] if not t[1] or len(t[0]) >= LETTERS else None)
        read = self.postings.where(wanted)
        if None not in folders:
            spark = self.postings.sparkSession
            rows = spark.createDataFrame([(x,) for x in sorted(folders)], "x string").select(folder_of(F.col("x")).alias("folder")).collect()
            read = read.where(F.col("folder").isin([r["folder"] for r in rows]))
        if self.live is not None:
            read = read.join(self.live, ["id", "run"], "left_semi")
        found = [F.flatten(F.collect_list(F.when(is_term(token, t), F.col("positions")))).alias(f"p{j}") for j, t in enumerate(terms)]
        return read.groupBy("id").agg(F.first("dl").alias("dl"), *found), self.figures


POSTINGS = "token string, id {id}, dl double, positions array<bigint>, folder int"


def write_index(docs: DataFrame, id_column: str, text_columns: list[str], folder: str, carried: str | None = None) -> None:
    """Writes the index of a table below folder: postings/folder=k, and figures. carried: a long column that postings keep."""
    id_type = docs.schema[id_column].dataType.simpleString()
    tokens = docs.select(F.col(id_column).alias("id"), *([carried] if carried else []), *(lexical_tokens(F.coalesce(F.col(c), F.lit(""))).alias(f"c{k}") for k, c in enumerate(text_columns)))
    as_text = tokens.withColumn("id", F.col("id").cast("string"))
    own = 2 if carried else 1

    def post(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                places: dict[str, list[int]] = {}
                for k, column in enumerate(row[own:]):
                    for i, t in enumerate(column):
                        places.setdefault(t, []).append(k * COLUMN + i)
                if places:
                    more = {carried: row[1]} if carried else {}
                    yield pd.DataFrame({"token": list(places), "id": row[0], "dl": float(sum(map(len, row[own:]))), "positions": list(places.values()), **more})

    schema = "token string, id string, dl double, positions array<bigint>" + (f", {carried} long" if carried else "")
    rows = as_text.mapInPandas(post, schema).withColumn("id", F.col("id").cast(id_type)).withColumn("folder", folder_of(F.col("token")))
    # By ranges, so that a token of very many documents spans several tasks and files.
    rows.repartitionByRange("folder", "token", "id").sortWithinPartitions("folder", "token", "id").write.partitionBy("folder").parquet(f"{folder}/postings")
    length = sum((F.size(f"c{k}") for k in range(len(text_columns))), F.lit(0)).cast("double")
    tokens.agg(F.count("*").cast("double").alias("n"), F.avg(length).alias("avgdl")).coalesce(1).write.parquet(f"{folder}/figures")


def read_postings(spark: SparkSession, folders: list[str], id_type: str, carried: str | None = None) -> DataFrame:
    """The postings of some folders, carried given as a name and type."""
    schema = POSTINGS.format(id=id_type) + (f", {carried}" if carried else "")
    out = None
    for folder in folders:
        one = spark.read.schema(schema).parquet(f"{folder}/postings")
        out = one if out is None else out.unionByName(one)
    return out


def open_index(spark: SparkSession, folder: str, id_type: str, text_columns: list[str]) -> LexicalIndex:
    return LexicalIndex(read_postings(spark, [folder], id_type), spark.read.schema("n double, avgdl double").parquet(f"{folder}/figures"), tuple(text_columns))


# Scores --------------------------------------------------------------------------------------------------------------


def shifted(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda x: x - by)


def starts_of(phrase: Phrase, terms: list[tuple[str, bool]], text_columns: list[str]) -> Column:
    """The positions at which a phrase begins."""
    at = [F.col(f"p{terms.index(t)}") for t in phrase.terms]
    found = at[0]
    for k, positions in enumerate(at[1:], 1):
        found = F.array_intersect(found, shifted(positions, k))
    if phrase.columns is not None:
        numbers = [text_columns.index(c) for c in phrase.columns if c in text_columns]
        found = F.filter(found, lambda x: F.floor(x / COLUMN).isin(numbers))
    return F.filter(found, lambda x: x % COLUMN == 0) if phrase.first else found


def near_starts(near: Near, k: int, starts: list[Column]) -> Column:
    """The beginnings of the kth phrase that have all other phrases within the gap."""
    own = len(near.phrases[k].tokens)

    def having(found: Column, others: Column, size: int) -> Column:
        return F.filter(found, lambda x: F.exists(others, lambda y: (y != x) & (F.floor(y / COLUMN) == F.floor(x / COLUMN)) & (y - x <= near.gap + own) & (x - y <= near.gap + size)))

    found = starts[k]
    for j, other in enumerate(near.phrases):
        found = found if j == k else having(found, starts[j], len(other.tokens))
    return found


def ranked(wide: DataFrame, figures: DataFrame, query: Node, terms: list[tuple[str, bool]], text_columns: list[str]) -> DataFrame:
    """(id, rank) of matching documents; ranks are negative, lower is better."""
    counts: list[Column] = []
    numbers: dict[int, int] = {}

    def count(node: Node) -> None:
        if isinstance(node, Near):
            starts = [starts_of(p, terms, text_columns) for p in node.phrases]
            for k, p in enumerate(node.phrases):
                numbers[id(p)] = len(counts)
                counts.append(F.size(near_starts(node, k, starts)))
        elif isinstance(node, Phrase):
            numbers[id(node)] = len(counts)
            counts.append(F.size(starts_of(node, terms, text_columns)))
        else:
            for part in (node.keep, node.drop) if isinstance(node, Without) else node.parts:
                count(part)

    def matches(node: Node) -> Column:
        if isinstance(node, Phrase):
            return F.col(f"tf{numbers[id(node)]}") > 0
        if isinstance(node, Without):
            return matches(node.keep) & ~matches(node.drop)
        every = [matches(p) for p in (node.phrases if isinstance(node, Near) else node.parts)]
        out = every[0]
        for one in every[1:]:
            out = out | one if isinstance(node, Either) else out & one
        return out

    count(query)
    counted = wide.select("id", "dl", *(c.cast("double").alias(f"tf{i}") for i, c in enumerate(counts)))
    frequencies = counted.agg(*(F.coalesce(F.sum((F.col(f"tf{i}") > 0).cast("double")), F.lit(0.0)).alias(f"df{i}") for i in range(len(counts))))
    score = F.lit(0.0)
    for phrase in phrases_of(query, scored_only=True):
        i = numbers[id(phrase)]
        df, tf = F.col(f"df{i}"), F.col(f"tf{i}")
        idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    # figures and frequencies: one row each
    return counted.where(matches(query)).crossJoin(F.broadcast(frequencies)).crossJoin(F.broadcast(figures)).select("id", (-score).alias("rank"))


def bm25(source: DataFrame | LexicalIndex, query: Node, id_column: str, text_columns: list[str]) -> DataFrame:
    """(id, rank) of matching documents of a table or of its index."""
    terms = terms_of(query)
    wide, figures = source.wide(terms) if isinstance(source, LexicalIndex) else scanned(source, terms, id_column, text_columns)
    return ranked(wide, figures, query, terms, text_columns).withColumnRenamed("id", id_column)


def fts_score(rank: Column, norm: str = "inverse") -> Column:
    """inverse: 1 / (1 + |rank|), which falls as relevance grows; monotone: |rank| / (1 + |rank|)."""
    size = F.abs(rank)
    return size / (size + 1.0) if norm == "monotone" else F.lit(1.0) / (size + 1.0)


def search(source: DataFrame | LexicalIndex, text: str, id_column: str, text_columns: list[str], k: int = 50, norm: str = "inverse") -> DataFrame:
    """The k best documents: (id, rank, fts_score); none for a blank query."""
    query = parse_query(text)
    if query is None:
        rows = source.postings.withColumnRenamed("id", id_column) if isinstance(source, LexicalIndex) else source
        return rows.select(id_column, F.lit(0.0).alias("rank"), F.lit(0.0).alias("fts_score")).limit(0)
    found = bm25(source, query, id_column, text_columns).withColumn("fts_score", fts_score(F.col("rank"), norm))
    return found.orderBy("rank", id_column).limit(k)
