"""Column functions on text: chunks, lexical tokens, JSON in prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Letters whose marks the lexical tokenizer removes, and what they become.
MARKED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿāăąćčďđēęěğīłńňōőřśšťūůűźżž"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyyaaaccddeeegilnnoorsstuuuzzz"
# Fixed value: what counts as white space.
WHITE = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def check_chunking(chars: int, overlap: int) -> None:
    if chars <= 0 or overlap < 0 or overlap >= chars:
        raise ValueError(f"chunks of {chars} with overlap {overlap}: want 0 <= overlap < chars")


def chunk_numbers(length: Column, chars: int, overlap: int) -> Column:
    """0, 1, ... for each chunk of a text of so many characters; empty for none."""
    check_chunking(chars, overlap)
    last = F.greatest(F.ceil((length - chars) / F.lit(float(chars - overlap))), F.lit(0)).cast("int")
    return F.when(length > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def with_chunks(df: DataFrame, text: str, chars: int = 2000, overlap: int = 200) -> DataFrame:
    """A row for each chunk: adds chunk_no, start_offset, end_offset and chunk_text."""
    step = chars - overlap
    numbered = df.withColumn("chunk_no", F.explode(chunk_numbers(F.length(text), chars, overlap).cast("array<bigint>")))
    start = F.col("chunk_no") * step
    return (
        numbered.withColumn("start_offset", start)
        .withColumn("end_offset", F.least(start + chars, F.length(text).cast("long")))
        .withColumn("chunk_text", F.substring(F.col(text), (start + 1).cast("int"), F.lit(chars)))
    )


def stripped(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.btrim(text, F.lit(WHITE))


def lexical_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits without marks; marks are looked up, not decomposed."""
    return F.regexp_extract_all(F.translate(F.lower(text), MARKED, PLAIN), F.lit(TOKEN), F.lit(0))


def strict_json(text: Column) -> Column:
    """The JSON value that a text is as a whole; null otherwise.

    The parser lets text after a value pass, so the text goes in as the only element
    of an array.
    """
    listed = F.try_parse_json(F.when(text != "", F.concat(F.lit("["), text, F.lit("]"))))
    return F.when(F.try_variant_get(listed, F.lit("$[1]"), "variant").isNull(), F.try_variant_get(listed, F.lit("$[0]"), "variant"))


def json_in(text: Column) -> Column:
    """The JSON value that a text is or, else, holds from its first to its last brace; null without one."""
    whole = F.trim(text)
    return F.coalesce(strict_json(whole), strict_json(F.regexp_extract(whole, r"(?s)\{.*\}", 0)))


def shortened(text: Column, chars: int) -> Column:
    """One line, trimmed, cut with an ellipsis."""
    line = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\n", " "))
    return F.when(F.length(line) > chars, F.concat(F.substring(line, 1, chars), F.lit("…"))).otherwise(line)
