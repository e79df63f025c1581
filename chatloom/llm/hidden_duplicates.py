"""Duplicates hidden by formatting differences.

Each message is split into its fields; every (position.field, normalised value)
pair is hashed to 128 bits and the hashes are added modulo 2^64 per lane, so the
fingerprint does not depend on the order of fields and nothing is sorted. Only
fingerprints (24 bytes a record) are shuffled to find groups; texts of records in
groups of two or more are read again and compared field by field with the group's
least record.

Defined cases: records without key can't be named and are no cases; records without messages (null, empty or blank only) are no cases;
null and blank elements are not counted; a field that a shape lacks differs from
one that is present; records that share a fingerprint but not their fields (a hash
collision) are grouped by their fields instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.lines import alnum_key, over_records, parse_line
from chatloom.session import HOT, hot_joined, keep, scratch, small, stored

MASK = (1 << 64) - 1


def fields_of(messages: list[str]) -> Iterator[str]:
    """``position|field|value`` of every field of every message."""
    for i, raw in enumerate(messages):
        time, user, text = parse_line(raw)
        if time is not None:
            yield f"{i}|time|{alnum_key(time)}"
        if user is not None:
            yield f"{i}|user|{alnum_key(user)}"
        yield f"{i}|text|{alnum_key(text)}"


def fingerprint(fields: Iterator[str]) -> tuple[int, int]:
    """Commutative multiset hash: two sums modulo 2^64, as signed longs."""
    a = b = 0
    for f in fields:
        h = xxhash.xxh3_128_intdigest(f)
        a += h & MASK
        b += h >> 64
    a, b = a & MASK, b & MASK
    return a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b


def _prints(key: int, messages: list[str]) -> Iterator[tuple]:
    a, b = fingerprint(fields_of(messages))
    yield key, len(messages), a, b


def _content(key: int, messages: list[str]) -> Iterator[tuple]:
    yield key, "\n".join(fields_of(messages))


def duplicate_members(tables: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(tbl, rec_id, rep): every record with at least one equal one, and the least record of its group."""
    spark = tables[0][1].sparkSession
    with scratch(spark):
        return keep(_verified(tables))


def _verified(tables: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    tables = [(name, df.where(F.col(key).isNotNull()), key, body) for name, df, key, body in tables]
    prints = stored(over_records(tables, _prints, "rec_id long, n int, a long, b long", [("rec_id", pa.int64()), ("n", pa.int32()), ("a", pa.int64()), ("b", pa.int64())]), "p3-prints")
    groups = stored(prints.groupBy("tbl", "n", "a", "b").agg(F.count("*").alias("copies"), F.min("rec_id").alias("rep")).where("copies > 1"), "p3-groups")
    members = stored(hot_joined(prints, groups, ["tbl", "n", "a", "b"], "copies", 48).select("tbl", "rec_id", "rep", (1 + F.expr(f"copies div {HOT}")).alias("parts")), "p3-members")
    rows = members.count()
    again = []
    for name, df, key, body in tables:
        ids = small(members.where(F.col("tbl") == name).select(F.col("rec_id").alias(key)), 16, rows)
        again.append((name, df.select(key, body).join(ids, key, "left_semi"), key, body))
    content = stored(members.join(over_records(again, _content, "rec_id long, content string", [("rec_id", pa.int64()), ("content", pa.string())]), ["tbl", "rec_id"]), "p3-content")
    # Members of a hot group are spread over parts, each of which meets a copy of the group's first record.
    reps = content.where("rec_id = rep").select("tbl", "rep", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("content").alias("first"))
    parted = content.withColumn("part", F.pmod(F.xxhash64("rec_id"), F.col("parts")))
    checked = parted.join(reps, ["tbl", "rep", "part"]).select("tbl", "rec_id", "rep", "content", (F.col("content") == F.col("first")).alias("same"))
    collided = checked.where("NOT same").select("tbl", "rec_id", "content")
    regrouped = collided.groupBy("tbl", "content").agg(F.min("rec_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    return stored(checked.where("same").select("tbl", "rec_id", "rep").union(collided.join(regrouped, ["tbl", "content"]).select("tbl", "rec_id", "rep")), "p3-verified")


def duplicate_pairs(tables: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(tbl, key_a, key_b): all pairs of each group, smaller key first."""
    m = duplicate_members(tables)
    a, b = m.select("tbl", "rep", F.col("rec_id").alias("key_a")), m.select("tbl", "rep", F.col("rec_id").alias("key_b"))
    return a.join(b, ["tbl", "rep"]).where("key_a < key_b").select("tbl", "key_a", "key_b")


def collapse(tables: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(tbl, rec_id, copies): one row per distinct record, the least of its group, with the number of its copies.

    Records without messages are kept, each with one copy.
    """
    m = duplicate_members(tables)
    copies = m.groupBy("tbl", F.col("rep").alias("rec_id")).agg(F.count("*").alias("n"))
    keys = None
    for name, df, key, _ in tables:
        one = df.where(F.col(key).isNotNull()).select(F.lit(name).alias("tbl"), F.col(key).alias("rec_id"))
        keys = one if keys is None else keys.union(one)
    dropped = m.where("rec_id <> rep").select("tbl", "rec_id")
    return keys.join(dropped, ["tbl", "rec_id"], "left_anti").join(copies, ["tbl", "rec_id"], "left").select("tbl", "rec_id", F.coalesce("n", F.lit(1)).alias("copies"))
