"""Items of varying length in containers of a fixed capacity, with little room left.

Dynamic programming over the global histogram of lengths chooses the bounds of length buckets that minimise padding
(the sum over items of bucket bound minus length). Containers are token-budget batches: their plan, which says how
many items of which buckets share a container, is made from the buckets' sizes alone, so that any item of a bucket
fits in any place of that bucket. A plan of batches within single buckets can't fill containers when most items are
longer than half a container; a batch here may also take items of smaller buckets into its remaining budget. Histogram, bounds and
plan have a size bounded by the capacity, not by the data; items find their place by their rank within the bucket,
which is counted in salted parts, so a bucket that holds most rows is no single task's.

Defined results: an item of more than ``capacity`` tokens gives full containers of its own and one remainder, which
is packed like an item; no other item is split. Items of length 0 or null, and null identifiers, take no place.
Repeated identifiers are separate items. An empty input gives no containers. Ties in length are broken by the identifier's hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.runtime import cut

SALTS = 64


def bucket_bounds(histogram: np.ndarray, buckets: int) -> np.ndarray:
    """Upper bounds (ascending) of at most ``buckets`` length buckets with the least padding; histogram[l] counts length l."""
    sizes = np.flatnonzero(histogram)
    if not len(sizes):
        return np.zeros(0, int)
    n, total = np.cumsum(histogram[sizes]), np.cumsum(histogram[sizes] * sizes)
    n0, t0 = np.concatenate([[0], n]).astype(float), np.concatenate([[0], total]).astype(float)
    m = len(sizes)
    k = min(buckets, m)
    # cost[i, j]: padding when sizes i..j share a bucket bounded by sizes[j]
    cost = sizes[None, :] * (n0[None, 1:] - n0[:-1, None]) - (t0[None, 1:] - t0[:-1, None])
    cost[np.tril_indices(m, -1)] = np.inf
    best, back = cost[0].copy(), [np.zeros(m, int)]
    for _ in range(k - 1):
        options = np.concatenate([[np.inf], best[:-1]])[:, None] + cost
        back.append(options.argmin(0))
        best = options.min(0)
    bounds, j = [], m - 1
    for step in reversed(back):
        bounds.append(sizes[j])
        j = step[j] - 1
        if j < 0:
            break
    return np.array(bounds[::-1])


def batch_plan(bounds: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {bucket: items}) for all items: containers start from the largest bucket left and take the set of
    other buckets that fills their budget best (a subset sum), larger ones first."""
    left, plan = counts.astype(np.int64).copy(), []
    while left.any():
        top = int(np.flatnonzero(left)[-1])
        room = capacity - int(bounds[top])
        batch = {top: 1}
        have = left.copy()
        have[top] -= 1
        # reach[r]: the bucket used last to fill r exactly, larger buckets preferred, none used twice as often as it is there
        reach = np.full(room + 1, -2)
        reach[0] = -1
        for b in np.flatnonzero(have)[::-1]:
            size, times = int(bounds[b]), np.zeros(room + 1, np.int64)
            if size > room:
                continue
            for r in range(size, room + 1):
                if reach[r] == -2 and reach[r - size] != -2 and times[r - size] < have[b]:
                    reach[r], times[r] = b, times[r - size] + 1
            if reach[room] != -2:
                break
        r = int(np.flatnonzero(reach != -2)[-1])
        while r:
            b = int(reach[r])
            batch[b] = batch.get(b, 0) + 1
            r -= int(bounds[b])
        times = min(int(left[b]) // k for b, k in batch.items())
        plan.append((times, batch))
        for b, k in batch.items():
            left[b] -= times * k
    return plan


def pack(items: DataFrame, identifier: str, length: str, capacity: int = 1024, buckets: int = 256) -> DataFrame:
    """(container, identifier, part, parts, first_token, n_tokens): the items, or parts of them, of every container."""
    c = F.col(f"`{length}`").cast("long")
    items = items.select(F.col(f"`{identifier}`").alias("i"), c.alias("n")).filter("i is not null and n > 0")
    # full containers first, then remainders
    items = items.withColumn("full", (F.col("n") / capacity).cast("long")).withColumn("rest", F.col("n") % capacity)
    items = cut(items.withColumn("parts", (F.col("full") + (F.col("rest") > 0).cast("long")).cast("int")).withColumn("salt", F.pmod(F.xxhash64("i"), F.lit(SALTS)).cast("int")))
    histogram = np.zeros(capacity + 1, np.int64)
    for row in items.filter("rest > 0").groupBy("rest").count().collect():
        histogram[row[0]] = row[1]
    bounds = bucket_bounds(histogram, buckets)
    of = np.searchsorted(bounds, np.arange(capacity + 1)) if len(bounds) else np.zeros(capacity + 1, int)
    counts = np.bincount(of[histogram > 0], histogram[histogram > 0], minlength=len(bounds)).astype(np.int64) if len(bounds) else np.zeros(0, np.int64)
    plan = batch_plan(bounds, counts, capacity)
    # places of each bucket in the order of the plan: from rank, first container, items a container
    places: dict[int, list] = {b: [] for b in range(len(bounds))}
    used, first = np.zeros(len(bounds), np.int64), 0
    for times, batch in plan:
        for b, k in batch.items():
            places[b].append((int(used[b]), first, k))
            used[b] += times * k
        first += times
    arrays = {b: tuple(np.array(x) for x in zip(*p)) for b, p in places.items() if p}
    base = first

    # rank within bucket: rank within (bucket, salt) plus the rows of smaller salts
    to_bucket = of.tolist()
    rests = items.filter("rest > 0").withColumn("bucket", F.get(F.array(*[F.lit(x) for x in to_bucket]), F.col("rest").cast("int")))
    sums = rests.groupBy("bucket", "salt").agg(F.count("*").alias("m"))
    before = sums.withColumn("before", F.sum("m").over(Window.partitionBy("bucket").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("bucket", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("bucket", "salt").orderBy(F.xxhash64("i"), "i")) - 1
    ranked = rests.withColumn("k", place).join(before, ["bucket", "salt"]).select("i", "n", "full", "rest", "parts", "bucket", (F.col("k") + F.col("before")).alias("rank"))

    def assign(batches):
        for pdf in batches:
            container = np.zeros(len(pdf), np.int64)
            bucket, rank = pdf["bucket"].to_numpy(), pdf["rank"].to_numpy()
            for b in np.unique(bucket):
                start, at, each = arrays[b]
                mine = bucket == b
                k = np.searchsorted(start, rank[mine], "right") - 1
                container[mine] = at[k] + (rank[mine] - start[k]) // each[k]
            yield pd.DataFrame({"container": container, "i": pdf["i"], "part": pdf["parts"], "parts": pdf["parts"], "first_token": pdf["full"] * capacity, "n_tokens": pdf["rest"]})

    kind = items.schema["i"].dataType.simpleString()
    mixed = ranked.mapInPandas(assign, f"container long, i {kind}, part int, parts int, first_token long, n_tokens long")
    # containers of parts of long items: numbered on, by salt
    long = items.filter("full > 0")
    fulls = long.groupBy("salt").agg(F.sum("full").alias("m"))
    upto = fulls.withColumn("before", F.sum("m").over(Window.orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("salt", F.coalesce("before", F.lit(0)).alias("before"))
    run = F.sum("full").over(Window.partitionBy("salt").orderBy(F.xxhash64("i"), "i").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("full")
    whole = long.withColumn("run", run).join(upto, "salt").withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)))
    whole = whole.select((F.lit(base) + F.col("before") + F.col("run") + F.col("p")).alias("container"), "i", (F.col("p") + 1).cast("int").alias("part"), "parts", (F.col("p") * capacity).alias("first_token"), F.lit(capacity).cast("long").alias("n_tokens"))
    return mixed.unionByName(whole).withColumnRenamed("i", identifier)


def packing_report(packed: DataFrame, capacity: int) -> DataFrame:
    """(containers, tokens, overfull, unused_share, least_containers) of a packing."""
    each = packed.groupBy("container").agg(F.sum("n_tokens").alias("n"))
    return each.agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.count_if(F.col("n") > capacity).alias("overfull")).select("containers", "tokens", "overfull", (1 - F.try_divide("tokens", F.col("containers") * capacity)).alias("unused_share"), F.ceil(F.col("tokens") / capacity).alias("least_containers"))
