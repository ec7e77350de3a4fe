"""Members folded by what they belong to.

What holds for a member depends only on the nodes that hold it. So members are shuffled once, by instance, into a sorted
array of their nodes; everything else is worked out for each distinct array and fanned out to its members, or only
counted with their number. Distinct arrays are as many as there are combinations of classes that some member has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import kept

#: Bytes of a table that is broadcast, at most; it is counted first.
BROADCAST_BYTES = 64 << 20


def fold(by: tuple[str, ...] | list[str], required: tuple[str, ...] = (), **sides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, sets): members has (by, instance, set_id), sets has (by, set_id, n, and a sorted array for each side).

    sides: tables (by, instance, item) by the name of their array. One shuffle, with partial aggregation, brings an
    instance's items together; instances without an item of a required side are left out. Equal arrays have equal ids.
    """
    by = list(by)
    names, rows = list(sides), None
    for name, df in sides.items():
        own = df.select(*by, "instance", *(F.col("item").alias(n) if n == name else F.lit(None).cast("string").alias(n) for n in names))
        rows = own if rows is None else rows.unionByName(own)
    folded = rows.groupBy(*by, "instance").agg(*(F.array_sort(F.collect_set(n)).alias(n) for n in names))
    for name in required:
        folded = folded.where(F.size(name) > 0)
    folded = kept(folded.withColumn("set_id", set_id(*names)), "members")
    return folded.select(*by, "instance", "set_id"), kept(counted(folded, names, by), "sets")


def set_id(*arrays: str) -> Column:
    return F.md5(F.concat_ws("\x01", *(F.concat(F.size(n).cast("string"), F.lit("\x02"), F.array_join(n, "\x02")) for n in arrays)))


def counted(folded: DataFrame, arrays: list[str] | tuple[str, ...], by: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """(by, set_id, n, arrays). Equal ids have equal arrays; with these in the key only a count is aggregated, by hash: no
    member is sorted, and none but partial counts are shuffled."""
    return folded.groupBy(*by, "set_id", *arrays).agg(F.count("*").alias("n")).select(*by, "set_id", "n", *arrays)


def small(df: DataFrame, size: Column) -> DataFrame:
    """df, marked for broadcast if the sum of `size` (bytes of a row) is within the bound; else joins shuffle it."""
    df = kept(df, "small")
    total = df.agg(F.sum(size + 64)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def fanned_out(members: DataFrame, found: DataFrame, by: tuple[str, ...] | list[str], array: str, bytes_of: Column) -> DataFrame:
    """(by, instance, and the fields of the array's structs) for every member and entry of its set's array."""
    by = list(by)
    return members.join(small(found.select(*by, "set_id", array), bytes_of), [*by, "set_id"]).select(*by, "instance", F.inline(array))
