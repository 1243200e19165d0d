"""Exact quantiles of many rows in a few passes, by histograms that refine.

The order of doubles is that of 64-bit numbers made from their bits. A pass counts the
next 16 bits of the numbers that agree with what is known of a quantile so far, and
finds the next 16 bits from those counts. Four passes give the value itself; no rows
are sorted or moved. Groups that overlap add up the counts of the parts they share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from volscribe.session import written

DIGIT_BITS = 16
# Counts a task holds before it sends them.
HELD = 1 << 20


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the values; both zeros are one."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def from_bits(number: int) -> float:
    bits = number ^ (1 << 63) if number >> 63 else ~number & (2**64 - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def exact_quantiles(rows: DataFrame, by: Sequence[str], column: str, probabilities: Sequence[float]) -> DataFrame:
    """``by``, probability and value: the smallest value with at least that share of its group's values up to it.

    Nulls and NaN are left out; a group without values has no row. The number of groups
    times probabilities should be small, as that many histograms are counted at once;
    it is not for a quantile per security.
    """
    out = pooled_quantiles(rows, by, (column,), probabilities, lambda group: [group], rows.select(*by).schema)
    return out.drop("metric")


def pooled_quantiles(
    rows: DataFrame, by: Sequence[str], columns: Sequence[str], probabilities: Sequence[float],
    pools: Callable[[tuple], Sequence[tuple]], named: T.StructType,
) -> DataFrame:
    """The columns ``named``, metric, probability and value, for each of ``columns`` over the rows of each pool.

    ``pools`` gives the pools that the rows of a group, the values of ``by``, belong to.
    Rows are counted once for their group, however many pools it is in, and pools add up
    their groups' counts. Nulls and NaN are left out; a pool without values of a column
    has no row for it.
    """
    spark = rows.sparkSession
    stored = written(rows.select(*by, *[F.col(c).cast("double").alias(f"value_{k}") for k, c in enumerate(columns)]), "values")
    groups = [tuple(r) for r in stored.select(*by).distinct().toLocalIterator()]
    schema = T.StructType([*named.fields, T.StructField("metric", T.StringType()), T.StructField("probability", T.DoubleType()), T.StructField("value", T.DoubleType())])
    if not groups:
        return spark.createDataFrame([], schema)
    names = spark.createDataFrame([(k, *g) for k, g in enumerate(groups)], T.StructType([T.StructField("group", T.IntegerType()), *stored.select(*by).schema.fields]))
    numbered = stored.join(F.broadcast(names), [stored[c].eqNullSafe(names[c]) for c in by])
    numbered = numbered.select("group", *[f"value_{k}" for k in range(len(columns))])
    members: dict[tuple, list[int]] = {}
    for k, group in enumerate(groups):
        for pool in pools(group):
            members.setdefault(tuple(pool), []).append(k)
    # [pool, column, probability, rank among the values that agree with what is known (none before the first pass), what is known]
    targets = [[pool, c, p, None, 0] for pool in sorted(members, key=repr) for c in range(len(columns)) for p in probabilities]
    for done in range(0, 64, DIGIT_BITS):
        # Each column's values that agree with one of these count, in the groups whose pools ask for it.
        known = [sorted({t[4] for t in targets if t[1] == c}) for c in range(len(columns))]
        links = {(g, t[1], known[t[1]].index(t[4]), (t[0], t[1], t[4])) for t in targets for g in members[t[0]]}
        spots = {spot: k for k, spot in enumerate(sorted({spot for *_, spot in links}, key=repr))}
        digits = _digits(numbered, known, {link[:3] for link in links}, len(groups), done)
        linked = spark.createDataFrame([(*link, spots[spot]) for *link, spot in links], "group int, column int, known int, spot int")
        summed = digits.join(F.broadcast(linked), ["group", "column", "known"]).groupBy("spot", "digit").agg(F.sum("n").alias("n"))
        whole = Window.partitionBy("spot")
        summed = summed.withColumns({"upto": F.sum("n").over(whole.orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(whole)})
        asked = [(i, spots[t[0], t[1], t[4]], t[2], t[3]) for i, t in enumerate(targets)]
        ranks = spark.createDataFrame(asked, "target int, spot int, probability double, rank bigint")
        of_all = F.greatest(F.lit(1), F.col("all") - F.floor(F.col("all") - F.col("all") * F.col("probability")))
        found = summed.join(F.broadcast(ranks), "spot").withColumn("rank", F.coalesce("rank", of_all)).where("upto >= rank AND upto - n < rank")
        # A row for each target that has values.
        left = []
        for r in found.select("target", "digit", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")).toLocalIterator():
            pool, c, p, _, prefix = targets[r.target]
            left.append([pool, c, p, r["rank"], (prefix << DIGIT_BITS) | r.digit])
        targets = left
        if not targets:
            break
    return spark.createDataFrame([(*pool, columns[c], float(p), from_bits(known)) for pool, c, p, _, known in targets], schema)


def _digits(numbered: DataFrame, known: list[list[int]], asked: set[tuple[int, int, int]], groups: int, done: int) -> DataFrame:
    """group, column, known, digit and n: how often each next digit follows the first ``done`` bits ``known``, where ``asked``."""
    prefixes = [np.array(k, np.uint64) for k in known]
    wanted = [np.zeros((groups, max(1, len(k))), bool) for k in known]
    for g, c, k in asked:
        wanted[c][g, k] = True
    most = max(w.shape[1] for w in wanted)

    def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        # Sums of whole numbers, exact below 2**53.
        return keys, np.bincount(back, np.concatenate([n for _, n in held])).astype(np.int64)

    def batch_of(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        place, digit = keys >> DIGIT_BITS, keys & ((1 << DIGIT_BITS) - 1)
        group, column, prefix = place // most // len(known), place // most % len(known), place % most
        columns = [*(pa.array(x.astype(np.int32)) for x in (group, column, prefix, digit)), pa.array(n)]
        return pa.RecordBatch.from_arrays(columns, ["group", "column", "known", "digit", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            group = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for c, (values, own) in enumerate(zip(batch.columns[1:], prefixes, strict=True)):
                # Nulls become NaN.
                values = values.to_numpy(zero_copy_only=False).astype(np.float64)
                used = ~np.isnan(values)
                bits, of = ordered_bits(values[used]), group[used]
                place = np.zeros(len(bits), np.int64)
                if done:
                    first = bits >> np.uint64(64 - done)
                    place = np.minimum(np.searchsorted(own, first), len(own) - 1) if len(own) else place
                    fits = own[place] == first if len(own) else np.zeros(len(bits), bool)
                    bits, of, place = bits[fits], of[fits], place[fits]
                fits = wanted[c][of, place]
                digit = (bits[fits] >> np.uint64(64 - done - DIGIT_BITS)) & np.uint64((1 << DIGIT_BITS) - 1)
                place = (of[fits] * len(known) + c) * most + place[fits]
                keys, n = np.unique((place << DIGIT_BITS) | digit.astype(np.int64), return_counts=True)
                held.append((keys, n))
                size += len(keys)
            if size > HELD:
                held = [summed(held)]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield batch_of(*held[0])
                    held, size = [], 0
        if held:
            yield batch_of(*summed(held))

    parts = numbered.mapInArrow(counted, "group int, column int, known int, digit int, n bigint")
    return parts.groupBy("group", "column", "known", "digit").agg(F.sum("n").alias("n"))
