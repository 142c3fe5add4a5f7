"""Key and value of a record, and how records are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SortConfig

DEFAULT = SortConfig()


def key_of(record: Column, config: SortConfig = DEFAULT, checked: bool = False) -> Column:
    """The leading key bytes; with `checked`, a record shorter than its key is an error."""
    key = F.substring(record, 1, config.key_length)
    if not checked:
        return key
    short = F.raise_error(F.lit(f"a record is shorter than its key of {config.key_length} bytes"))
    return F.when(F.length(record) >= config.key_length, key).otherwise(short.cast("binary"))


def value_of(record: Column, config: SortConfig = DEFAULT) -> Column:
    return F.substring(record, config.key_length + 1, config.record_length - config.key_length)


def to_hex(data: Column) -> Column:
    """Two lower-case digits for each byte."""
    return F.lower(F.hex(data))


def to_ascii(data: Column) -> Column:
    """Printable ASCII as it is, a dot for every other byte."""
    return F.regexp_replace(F.decode(data, "ISO-8859-1"), r"[^\x20-\x7E]", ".")


def line_view(number: Column, record: Column, config: SortConfig = DEFAULT) -> Column:
    """One line: number, key in hex, value in ASCII."""
    return F.format_string("%d: %s %s", number, to_hex(key_of(record, config)), to_ascii(value_of(record, config)))


def detailed_view(df: DataFrame, record: str = "record", config: SortConfig = DEFAULT) -> DataFrame:
    """Key and value of each record, both in hex and in ASCII."""
    key, value = key_of(F.col(record), config), value_of(F.col(record), config)
    return df.withColumns({"key_hex": to_hex(key), "key_ascii": to_ascii(key), "value_hex": to_hex(value), "value_ascii": to_ascii(value)})


def padded(key: Column, config: SortConfig = DEFAULT) -> Column:
    """A key as a whole record: zero bytes behind it."""
    return F.rpad(key, config.record_length, F.lit(b"\0"))


def numeric_key(*parts: tuple[Column, int]) -> Column:
    """Big-endian key bytes from unsigned numbers of so many bytes each."""
    return F.unhex(F.concat(*[F.lpad(F.hex(c), 2 * n, "0") for c, n in parts]))


def record_from(key: Column, value: Column, config: SortConfig = DEFAULT) -> Column:
    """Key bytes followed by the value, padded with spaces or cut to the record's length."""
    return F.rpad(F.concat(key, value.cast("binary")), config.record_length, F.lit(b" "))


def generated(spark, count: int, offset: int = 0, config: SortConfig = DEFAULT) -> DataFrame:
    """Deterministic records `offset` to `offset + count - 1`: key bytes from a digest of the number, which is the value."""
    ids = spark.range(offset, offset + count)
    key = F.substring(F.unhex(F.md5(F.col("id").cast("string").cast("binary"))), 1, config.key_length)
    return ids.select("id", record_from(key, F.col("id").cast("string"), config).alias("record"))


def demo(spark, count: int = 10, config: SortConfig = DEFAULT) -> DataFrame:
    """Records to look at: the number as a big-endian key, a readable message as the value."""
    ids = spark.range(count)
    key = numeric_key((F.col("id"), config.key_length))
    return ids.select("id", record_from(key, F.concat(F.lit("Record number "), F.col("id").cast("string")), config).alias("record"))
