"""What several operators share: words, lines and table reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of code points other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words, 0 for null, as long."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The words, unchanged; an empty array for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def has_word(text: Column) -> Column:
    return F.translate(text, SPACES, "") != ""


def hex32(digest: Column) -> Column:
    """The first 32 bits of a hex digest as a long."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def bucket(doc_id: Column, n: int) -> Column:
    """CRC-32 of the id as text, modulo n; of the empty text where the id is null."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def utf8(text: Column) -> Column:
    """The bytes of a text, none for null."""
    return F.coalesce(text, F.lit("")).cast("binary")


def kind(df: DataFrame, name: str) -> str:
    """A column's type in DDL."""
    return df.select(df[name]).schema[0].dataType.simpleString()


def sampled(rows: DataFrame, total: int, n: int, *key: Column) -> DataFrame:
    """About `n` of `total` rows, those of the lowest hashes of the key; 2 n at most. Nothing is sorted or shuffled for it, and reruns agree."""
    share = min(1 << 30, -(-(n << 30) // max(total, 1)))
    return rows.where(F.pmod(F.xxhash64(*key, F.lit(29)), F.lit(1 << 30)) < share).limit(2 * n)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or that with underscores before it, so that no column of `df` has it (in upper or lower case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
