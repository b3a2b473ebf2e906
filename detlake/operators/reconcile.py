"""Invariants, set comparison, digests and the reconciliation of persisted results.

A check is a DataFrame that must be empty. Nothing is collected but the count and a few examples of what breaks it.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from detlake.functions.keys import ordered_digest

#: Legal transitions of a job.
TRANSITIONS = (("queued", "running"), ("queued", "failed"), ("running", "completed"), ("running", "interrupted"), ("running", "failed"))


class InvariantError(ValueError):
    """Rows exist that must not."""


def enforce(name: str, broken: DataFrame) -> None:
    """Raise unless a check is empty, naming up to three examples."""
    examples = broken.limit(3).collect()
    if examples:
        raise InvariantError(f"{name}: {examples}")


def set_difference(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side): keys that only one side has; each side's repetitions don't matter."""
    e, a = expected.select(*keys).distinct(), actual.select(*keys).distinct()
    return e.join(a, keys, "left_anti").withColumn("side", F.lit("missing")).unionByName(a.join(e, keys, "left_anti").withColumn("side", F.lit("unexpected")))


def bag_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that the sides hold in different numbers."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def value_differences(expected: DataFrame, actual: DataFrame, keys: list[str], tolerances: dict[str, float]) -> DataFrame:
    """(keys, field, expected, actual) of numeric fields further apart than their tolerance, or on one side only."""
    side = lambda df, s: df.select(*keys, *(F.col(f).cast("double").alias(f"{s}_{f}") for f in tolerances))
    j = side(expected, "e").join(side(actual, "a"), keys, "full_outer")
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"e_{f}").alias("expected"), F.col(f"a_{f}").alias("actual"), F.lit(t).cast("double").alias("t")) for f, t in tolerances.items()))
    rows = j.select(*keys, F.explode(fields).alias("x")).select(*keys, "x.*")
    apart = (F.col("expected").isNull() != F.col("actual").isNull()) | (F.abs(F.col("expected") - F.col("actual")) > F.col("t"))
    return rows.where(apart).drop("t")


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("count")).where("count > 1")


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows with the names of the rules that they break; a rule that is null counts as broken."""
    names = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), n) for n, ok in rules.items()))
    return rows.withColumn("broken", F.filter(names, lambda n: n.isNotNull())).where(F.size("broken") > 0)


def unreferenced(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Children without a parent."""
    return children.join(parents.select(*keys).distinct(), keys, "left_anti")


def event_reconciliation(observations: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """Events whose stored counts, extent or maximum differ from their observations; events or observations alone as well.

    observations: keys, frame_index, confidence; events: keys, observation_count, first_frame, last_frame, max_confidence.
    """
    again = observations.groupBy(*keys).agg(F.count("*").alias("n"), F.min("frame_index").alias("lo"), F.max("frame_index").alias("hi"), F.max("confidence").alias("top"))
    j = events.select(*keys, "observation_count", "first_frame", "last_frame", "max_confidence").join(again, keys, "full_outer")
    same = F.col("n").eqNullSafe(F.col("observation_count")) & F.col("lo").eqNullSafe(F.col("first_frame")) & F.col("hi").eqNullSafe(F.col("last_frame")) & F.col("top").eqNullSafe(F.col("max_confidence"))
    return j.where(~same)


def bad_transitions(history: DataFrame, job: str, at: str, status: str) -> DataFrame:
    """Steps of a job's history that aren't legal: (job, at, from, to); a first step must be queued."""
    before = F.lag(F.lower(status)).over(W.partitionBy(job).orderBy(at))
    rows = history.select(job, at, before.alias("from_status"), F.lower(status).alias("to_status"))
    legal = reduce(lambda x, y: x | y, ((F.col("from_status") == a) & (F.col("to_status") == b) for a, b in TRANSITIONS), F.col("from_status").isNull() & (F.col("to_status") == "queued"))
    return rows.where(~F.coalesce(legal, F.lit(False)))


def job_status(history: DataFrame, job: str, at: str, status: str) -> DataFrame:
    """Each job's latest status and when it began, started and ended."""
    s = F.lower(status)
    return history.groupBy(job).agg(F.max_by(s, F.col(at)).alias("status"), F.min(at).alias("created_at"), F.min(F.when(s == "running", F.col(at))).alias("started_at"), F.max(F.when(s.isin("completed", "failed", "interrupted"), F.col(at))).alias("ended_at"))


def table_digest(rows: DataFrame, columns: list[str], order: list[str], buckets: int = 256) -> DataFrame:
    """One row (rows, digest): order-independent of partitioning, by digests of hash buckets that are digested again.

    A bucket's lines are ordered and hashed in one task, so the number of buckets bounds what a task holds; raise it
    with the table.
    """
    line = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    key = F.to_json(F.struct(*order))
    d = rows.select(line.alias("l"), key.alias("k"), F.pmod(F.xxhash64(*order), F.lit(buckets)).alias("b"))
    parts = d.groupBy("b").agg(F.count("*").alias("n"), ordered_digest(F.col("l"), F.col("k")).alias("d"))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(ordered_digest(F.col("d"), F.col("b")), F.sha2(F.lit(""), 256)).alias("digest"))


def group_digests(rows: DataFrame, by: list[str], columns: list[str], order: list[str], digits: int = 2) -> DataFrame:
    """(by, rows, digest) of each group: a digest over the digests of its buckets, each over its lines ``a|b|...`` in order.

    The bucket of a row is the beginning of the SHA-256 of its order columns, ``digits`` hexadecimal digits, so no task orders a whole group;
    more digits make smaller buckets. Buckets that are empty don't count.
    """
    joined = lambda cs: F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cs))
    bucket = F.substring(F.sha2(joined(order), 256), 1, digits)
    parts = rows.withColumn("_bucket", bucket).groupBy(*by, "_bucket").agg(F.count("*").alias("_n"), ordered_digest(joined(columns), F.struct(*order)).alias("_d"))
    return parts.groupBy(*by).agg(F.sum("_n").alias("rows"), ordered_digest(F.col("_d"), F.col("_bucket")).alias("digest"))


def stream_digests(rows: DataFrame, by: list[str], order: list[str], line: Column, head: str = "", between: str = "", tail: str = "") -> DataFrame:
    """(by, rows, digest): SHA-256 of each group's lines put end to end in order, for byte formats that are given from outside.

    Such a digest is one sequence of bytes, so a group is one sorted stream, but it is hashed line by line in constant memory
    and the sort may spill. Null lines count as empty. Use ``group_digests`` where the format is free.
    """
    schema = StructType([*(rows.schema[c] for c in by), StructField("rows", LongType()), StructField("digest", StringType())])

    def run(batches):
        key, count, digest = None, 0, None
        done = lambda: pa.RecordBatch.from_pylist([dict(zip(by, key)) | {"rows": count, "digest": (digest.update(tail.encode()) or digest).hexdigest()}], to_arrow_schema(schema))
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(len(by))] or [[None] * batch.num_rows]
            for *now, text in zip(*columns, batch.column(batch.num_columns - 1).to_pylist()):
                if now != key:
                    if digest is not None:
                        yield done()
                    key, count, digest = now, 0, hashlib.sha256(head.encode())
                digest.update(((between if count else "") + (text or "")).encode())
                count += 1
        if digest is not None:
            yield done()

    laid = rows.select(*by, *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), line.alias("_line"))
    laid = laid.repartition(*by) if by else laid.repartition(1)
    return laid.sortWithinPartitions(*by, *(f"_o{i}" for i in range(len(order))), "_line").select(*by, "_line").mapInArrow(run, schema)
