"""Native text expressions shared by the operators. All are JVM-side columns; nulls give null unless stated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Python's str.strip and str.isspace take for white space.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
_SPACE_CLASS = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

#: The whitespace budget tokenizer `\w+|[^\w\s]` with Unicode classes spelled out, one form for Java and RE2.
BUDGET_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_" + _SPACE_CLASS + "]"
SPACE_RUN = "[" + _SPACE_CLASS + "]+"


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body of x, with x evaluated once however often body names it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def strip(x: str | Column) -> Column:
    """Without white space at both ends, Unicode white space included."""
    return F.btrim(col(x), F.lit(SPACES))


def byte_length(x: str | Column) -> Column:
    return F.octet_length(col(x))


def budget_tokens(x: str | Column) -> Column:
    """Number of tokens under the whitespace budget tokenizer; null for null."""
    return F.regexp_count(col(x), F.lit(BUDGET_TOKEN)).cast("bigint")


def clean_lang(x: str | Column) -> Column:
    """Trimmed, lower-cased and cut before the first hyphen."""
    return F.substring_index(F.lower(strip(x)), "-", 1)


def sql_strip(x: str) -> str:
    """strip() as a DuckDB expression."""
    return f"trim({x}, {' || '.join(f'chr({ord(c)})' for c in SPACES)})"


def sql_budget_tokens(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{BUDGET_TOKEN}'))"


def sql_clean_lang(x: str) -> str:
    return f"split_part(lower({sql_strip(x)}), '-', 1)"


def hashed_ids(x: str | Column) -> Column:
    """Ids of the budget tokens: the first 16 bits of a token's MD5, a vocabulary of 65,536 without fitting; null for null."""
    return F.transform(F.regexp_extract_all(col(x), F.lit(BUDGET_TOKEN), F.lit(0)), lambda t: F.conv(F.substring(F.md5(t), 1, 4), 16, 10).cast("int"))


def sql_hashed_ids(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '{BUDGET_TOKEN}'), lambda t: CAST('0x' || substr(md5(t), 1, 4) AS INTEGER))"
