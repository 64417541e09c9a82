"""Placement of rows on shards through a permutation-filled lookup table.

Each shard orders the slots of a table of prime size by its own permutation (an offset and a skip
taken from hashes of its name); the shards take turns, each claiming the first slot of its order
that is still free. A row's slot is the hash of its key modulo the table's size, so placing it is
one look-up in a broadcast table whose size is a parameter and does not grow with the data. When a
shard is added or lost, few slots beyond its own change hands.

Cases: a null key counts as the empty string; equal keys share a shard; an empty table stays empty;
the columns slot and shard replace any of these names in the input.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 8191
SHARDS = 64
#: The lookup table is broadcast; larger ones are refused.
MAX_TABLE = 1 << 20


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """For each slot the index of the shard that claimed it."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need distinct names")
    if not is_prime(size) or not len(shards) <= size <= MAX_TABLE:
        raise ValueError(f"the table's size has to be a prime from {len(shards)} to {MAX_TABLE}")
    place = [_number(f"{s}|offset") % size for s in shards]
    skip = [1 + _number(f"{s}|skip") % (size - 1) if size > 1 else 1 for s in shards]
    table, free = [-1] * size, size
    while True:
        for i in range(len(shards)):
            while table[place[i]] >= 0:
                place[i] = (place[i] + skip[i]) % size
            table[place[i]] = i
            free -= 1
            if not free:
                return table


def key_hash(key: Column) -> Column:
    """The first 15 hex digits of the key's MD5, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def place(df: DataFrame, key: str = "doc_id", shards: list[str] | None = None, size: int = TABLE_SIZE) -> DataFrame:
    """df with slot int and shard int (an index into shards)."""
    names = shards if shards is not None else [f"shard-{i}" for i in range(SHARDS)]
    table = F.broadcast(df.sparkSession.createDataFrame(list(enumerate(fill(names, size))), "slot int, shard int"))
    return df.drop("slot", "shard").withColumn("slot", F.pmod(key_hash(F.col(f"`{key}`")), F.lit(size)).cast("int")).join(table, "slot", "inner")
