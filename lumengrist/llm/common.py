"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import write_shared

__all__ = ["BLANKS", "NO_ID", "ascii_lower", "boxed", "field", "flagged", "load", "maybe_member", "shuffle_partitions", "unboxed", "write_shared"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The bytes that the contracts count as white space.
BLANKS = " \t\n\x0b\x0c\r"
NO_ID = 9223372036854775807


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. All-ASCII texts, the cheap case, use the built-in that scans bytes."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def boxed(docs: DataFrame, **more: Column) -> DataFrame:
    """docs as one column `row`, a struct, so that no name of its columns can meet one of the operator's; `more` stand beside it."""
    return docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in more.items()])


def field(name: str) -> Column:
    return F.col(f"row.{quoted(name)}")


def unboxed(df: DataFrame, columns: list[str], new: dict[str, Column] | None = None) -> DataFrame:
    """The columns out of `row`; those in `new` from these expressions."""
    return df.select(*[(new or {}).get(c, field(c)).alias(c) for c in columns])


#: Bits of the largest filter that is broadcast: 32 MB.
MOST_BITS = 28


def bit_cells(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """A one-hash bit filter over a BIGINT column as rows (cell, masks), 64 words of 64 bits each: 2**bits / 8 bytes at most."""
    words = (
        keys.select(F.expr(f"pmod({key}, {1 << bits})").alias("slot"))
        .select(F.expr("shiftright(slot, 6)").alias("word"), F.expr("shiftleft(1L, int(slot & 63))").alias("mask"))
        .groupBy("word")
        .agg(F.bit_or("mask").alias("mask"))
    )
    cells = words.groupBy(F.expr("shiftright(word, 6)").alias("cell")).agg(F.map_from_entries(F.collect_list(F.struct(F.expr("word & 63"), "mask"))).alias("m"))
    return cells.select("cell", F.expr("transform(sequence(0L, 63L), i -> coalesce(try_element_at(m, i), 0L))").alias("masks"))


def flagged(df: DataFrame, key: str, keys: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """df with `maybe`: false where its key is for certain not among keys.key. The filter has about 16 bits for each of the keys, which
    should be a written table, and 2**most_bits at most; when fuller, more is flagged, never less."""
    bits = max(16, min(most_bits, (16 * keys.count()).bit_length()))
    cells = F.broadcast(bit_cells(keys, key, bits).select(F.col("cell").alias("_cell"), F.col("masks").alias("_masks")))  # 2**most_bits / 8 bytes
    slot = f"pmod({key}, {1 << bits})"
    hit = F.expr("coalesce(getbit(get(_masks, int(shiftright(_slot, 6) & 63)), int(_slot & 63)) = 1, false)")
    return df.withColumn("_slot", F.expr(slot)).join(cells, F.expr("shiftright(_slot, 12) = _cell"), "left").withColumn("maybe", hit).drop("_slot", "_cell", "_masks")


def maybe_member(df: DataFrame, key: str, keys: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """Rows of df whose key may be among keys.key."""
    return flagged(df, key, keys, most_bits).where("maybe").drop("maybe")
