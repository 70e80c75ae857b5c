"""Filling containers of fixed capacity: a linear grouping scheme over the histogram of sizes.

What the scheme works on is the number of items of each size, at most one entry for each
size up to the capacity, whatever the number of items. Its answer is a list of kinds of
containers, each with a number of containers and the sizes in one; which item lies in which
container follows from the item's rank among those of its size.
"""

from __future__ import annotations

import bisect
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import partitions, shared_folder

#: For a larger capacity, configurations of large items are searched in units of more than one token, rounded up: the
#: search is over a table of that many rooms. All else, small items above all, goes by exact sizes.
MOST_ROOMS = 1 << 15
#: Items above this share of the capacity are large.
SMALL = 1 / 4
GROUPS = 128
#: Parts, at least, that the items of one size are numbered in.
PARTS = 64


def _groups(large: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
    """(size, count), largest first, cut into k groups of equal numbers of items; a group for each size if that are no more."""
    if len(large) <= k:
        return [[x] for x in large]
    total = sum(n for _, n in large)
    k = max(1, min(k, total))
    out: list[list[tuple[int, int]]] = [[]]
    filled, done = 0, 0
    for size, n in large:
        while n:
            room = (done + 1) * total // k - filled
            if room <= 0:
                done += 1
                out.append([])
                continue
            take = min(n, room)
            out[-1].append((size, take))
            filled += take
            n -= take
    return [g for g in out if g]


def _best_pattern(widths: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of widths within the capacity."""
    k = len(widths)
    most = max(1, capacity // int(widths.min()))
    best = np.zeros(capacity + 1)
    choice: list[np.ndarray] = []
    for _ in range(most):
        step = best.copy()
        picked = np.full(capacity + 1, -1, np.int32)
        for g in range(k):
            w = int(widths[g])
            gain = best[: capacity + 1 - w] + worth[g]
            better = gain > step[w:] + 1e-12
            step[w:][better] = gain[better]
            picked[w:][better] = g
        if (picked < 0).all():
            break
        best = step
        choice.append(picked)
    counts = np.zeros(k)
    room = capacity
    for picked in reversed(choice):
        g = picked[room]
        if g >= 0:
            counts[g] += 1
            room -= int(widths[g])
    return float(counts @ worth), counts


def _patterns(widths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[list[tuple[int, np.ndarray]], bool]:
    """Patterns of rounded sizes and how often each is used: the configuration programme's
    optimum by column generation, rounded down; the demand that is left is packed singly.
    And whether the optimum was reached: 40 columns a width are made at most, should the
    programme be degenerate; without it the patterns are as good as the last columns."""
    unit = -(-capacity // MOST_ROOMS)
    capacity //= unit
    widths = np.minimum(-(-widths // unit), capacity)
    k = len(widths)
    basis = np.diag((capacity // widths).astype(float))
    use = demand / np.diag(basis)
    optimal = False
    for _ in range(40 * k):
        price = np.linalg.solve(basis.T, np.ones(k))
        value, column = _best_pattern(widths, np.maximum(price, 0), capacity)
        if value <= 1 + 1e-7:
            optimal = True
            break
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        use = use - ratio[out] * step
        use[out] = ratio[out]
        use = np.maximum(use, 0)
        basis[:, out] = column
    left = demand.astype(np.int64).copy()
    found: list[tuple[int, np.ndarray]] = []
    for j in np.argsort(-use):
        column = basis[:, j].astype(np.int64)
        needs = column > 0
        n = min(int(use[j] + 1e-6), *(left[needs] // column[needs]).tolist()) if needs.any() else 0
        if n > 0:
            found.append((int(n), column))
            left -= n * column
    while left.any():
        pattern = np.zeros(k, np.int64)
        room = capacity
        for g in range(k):
            take = int(min(left[g], room // widths[g]))
            pattern[g] = take
            room -= take * int(widths[g])
        n = int((left[pattern > 0] // pattern[pattern > 0]).min())
        found.append((n, pattern))
        left -= n * pattern
    return found, optimal


def plan(histogram: dict[int, int], capacity: int, groups: int = GROUPS, small: float = SMALL) -> list[tuple[int, dict[int, int]]]:
    """The first of what `solved` gives."""
    return solved(histogram, capacity, groups, small)[0]


def solved(histogram: dict[int, int], capacity: int, groups: int = GROUPS, small: float = SMALL) -> tuple[list[tuple[int, dict[int, int]]], bool]:
    """(number of containers, {size: copies in each}) that hold all items of the histogram, and whether the
    configurations of large items are optimal.

    Sizes are from 1 to the capacity. Large ones are rounded up to the largest of their
    group; the few rounded sizes are packed by optimal configurations; the items themselves
    take the slots in order of size, so that what a container has left is exact; small ones,
    and those of containers that are not half full, go where they leave least: one
    container at most ends up less than half full.
    """
    sizes = sorted(((s, n) for s, n in histogram.items() if n > 0), reverse=True)
    full = [(n, {s: 1}) for s, n in sizes if s == capacity]
    large = [(s, n) for s, n in sizes if small * capacity < s < capacity]
    tiny = [(s, n) for s, n in sizes if s <= small * capacity and s < capacity]
    kinds: list[list] = []
    optimal = True
    if large:
        grouped = _groups(large, groups)
        # equal roundings are one width
        merged: list[tuple[int, list[tuple[int, int]]]] = []
        for g in grouped:
            if merged and merged[-1][0] == g[0][0]:
                merged[-1][1].extend(g)
            else:
                merged.append((g[0][0], list(g)))
        widths = np.array([w for w, _ in merged])
        demand = np.array([sum(n for _, n in g) for _, g in merged])
        queues = [[list(x) for x in g] for _, g in merged]
        heads = [0] * len(queues)
        found, optimal = _patterns(widths, demand, capacity)
        for times, pattern in found:
            slots = [g for g in range(len(widths)) for _ in range(int(pattern[g]))]
            runs: list[list[tuple[int, int]]] = []
            for g in slots:
                need, run = times, []
                while need:
                    entry = queues[g][heads[g]]
                    take = min(need, entry[1])
                    run.append((entry[0], take))
                    entry[1] -= take
                    need -= take
                    if not entry[1]:
                        heads[g] += 1
                runs.append(run)
            ends = sorted({e for run in runs for e in np.cumsum([n for _, n in run]).tolist()})
            at, where = 0, [0] * len(runs)
            passed = [run[0][1] for run in runs]
            for end in ends:
                held: dict[int, int] = {}
                for r, run in enumerate(runs):
                    while passed[r] <= at:
                        where[r] += 1
                        passed[r] += run[where[r]][1]
                    held[run[where[r]][0]] = held.get(run[where[r]][0], 0) + 1
                kinds.append([end - at, held, capacity - sum(s * c for s, c in held.items())])
                at = end
    # where rounding up left a container less than half full, its items go with the small ones
    loose = dict(tiny)
    for n, held, room in kinds:
        for s, c in held.items() if 2 * room > capacity else ():
            loose[s] = loose.get(s, 0) + n * c
    tiny = sorted(loose.items(), reverse=True)
    kinds = [kind for kind in kinds if 2 * kind[2] <= capacity]
    by_room: dict[int, list[int]] = {}
    for i, kind in enumerate(kinds):
        by_room.setdefault(kind[2], []).append(i)
    rooms = sorted(by_room)

    def put(i: int) -> None:
        room = kinds[i][2]
        if room not in by_room:
            by_room[room] = []
            bisect.insort(rooms, room)
        by_room[room].append(i)

    for size, n in tiny:
        while n:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                a_container = capacity // size
                times = max(1, n // a_container)
                kinds.append([times, {}, capacity])
                put(len(kinds) - 1)
                continue
            room = rooms[at]
            i = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
            kind = kinds[i]
            take = min(room // size, n)
            times = min(kind[0], n // take)
            if times < kind[0]:
                kinds.append([kind[0] - times, dict(kind[1]), room])
                put(len(kinds) - 1)
                kind[0] = times
            kind[1][size] = kind[1].get(size, 0) + take
            kind[2] = room - take * size
            n -= times * take
            if kind[2]:
                put(i)
    return full + [(n, held) for n, held, _ in kinds], optimal


_PLAN = "spec_id long, size long, rank long, copies long, first long, optimal boolean"


def _planned(groups: int, small: float):
    """A function of a spec's histogram: the plan as rows of _PLAN. From `rank` on, the items of a size lie `copies`
    together, in containers from `first` on."""

    def run(table: pa.Table) -> pa.Table:
        spec, capacity = table.column("spec_id")[0].as_py(), table.column("capacity")[0].as_py()
        kinds, optimal = solved(dict(zip(table.column("size").to_pylist(), table.column("n").to_pylist())), capacity, groups, small)
        used: dict[int, int] = {}
        rows, first = [], 0
        for n, held in kinds:
            for size, copies in held.items():
                rows.append((spec, size, used.get(size, 0), copies, first, optimal))
                used[size] = used.get(size, 0) + n * copies
            first += n
        names = ["spec_id", "size", "rank", "copies", "first"]
        return pa.table([*(pa.array(c, pa.int64()) for c in list(zip(*rows))[:5]), pa.array([r[5] for r in rows], pa.bool_())], [*names, "optimal"])

    return run


class _Slots:
    """The plan of one spec, to be asked for the containers of many items."""

    #: Items of one size are fewer.
    RANKS = 1 << 40

    def __init__(self, rows: list[tuple[int, int, int, int]]):
        size, self.rank, self.copies, self.first = (np.array(c, np.int64) for c in zip(*sorted(rows)))
        self.sizes, at = np.unique(size, return_inverse=True)
        self.at = at * self.RANKS + self.rank

    def containers(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.at, np.searchsorted(self.sizes, size) * self.RANKS + rank, side="right") - 1
        return self.first[k] + (rank - self.rank[k]) // self.copies[k]


def pack(sizes: DataFrame, specs: list[tuple[int, int]], groups: int = GROUPS, small: float = SMALL) -> DataFrame:
    """(spec_id, container_id, doc_id, piece, first_token, n_tokens): where each document lies.

    `sizes` has (doc_id, n_tokens); `specs` the (spec_id, capacity_tokens) to pack for, each
    by itself. A text above the capacity is cut into full pieces and a rest, no other is
    cut. A text of no tokens, or null size, takes no container: one row, its container null.
    Specs with a null or not positive capacity are left out; without any there are no rows.
    Equal rows of `sizes` are items of their own.

    Small exchanges over (spec, size) counts and item numbers; texts don't move. Each spec
    is planned by a task of its own from its histogram, at most one entry for each size that
    occurs; the plans (at most a few entries a size) go by the driver to the executors.
    Items of one size are numbered in PARTS parts or the shuffle's width, so a size that a
    third of all texts have is no single task. A warning tells of specs whose
    configurations are not optimal.
    """
    spark = sizes.sparkSession
    specs = sorted({(int(s), int(c)) for s, c in specs if s is not None and c is not None and c > 0})
    schema = "spec_id long, container_id long, doc_id long, piece long, first_token long, n_tokens long"
    if not specs:
        return spark.createDataFrame([], schema)
    shared_folder(spark)
    # written once, as the histogram and the placing both read it
    sizes = sizes.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n")).checkpoint()
    spec = F.explode(F.array(*[F.struct(F.lit(s).cast("long").alias("spec_id"), F.lit(c).cast("long").alias("capacity")) for s, c in specs]))
    each = sizes.select("doc_id", "n", spec.alias("s")).select("s.*", "doc_id", "n")
    last = F.greatest(F.ceil(F.col("n") / F.col("capacity")) - 1, F.lit(0))
    pieces = each.select("spec_id", "capacity", "doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    first = F.col("piece") * F.col("capacity")
    items = pieces.select("spec_id", "capacity", "doc_id", "piece", first.alias("first_token"), F.least(F.col("capacity"), F.col("n") - first).alias("n_tokens"))
    items = items.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(max(PARTS, partitions(spark)))).cast("int"))
    counts = items.where("n_tokens > 0").groupBy("spec_id", "capacity", F.col("n_tokens").alias("size"), "part").agg(F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("spec_id", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    histogram = counts.groupBy("spec_id", "capacity", "size").agg(F.sum("n").alias("n"))
    plans: dict[int, list[tuple]] = {}
    for r in histogram.groupBy("spec_id").applyInArrow(_planned(groups, small), _PLAN).collect():
        plans.setdefault(r["spec_id"], []).append((r["size"], r["rank"], r["copies"], r["first"]))
        if not r["optimal"] and len(plans[r["spec_id"]]) == 1:
            warnings.warn(f"spec {r['spec_id']}: its configurations are not optimal", stacklevel=2)
    shared = spark.sparkContext.broadcast({s: _Slots(rows) for s, rows in plans.items()})
    order = Window.partitionBy("spec_id", "n_tokens", "part").orderBy("doc_id", "piece")
    begins = counts.select("spec_id", F.col("size").alias("n_tokens"), "part", earlier.alias("earlier"))
    ranked = items.withColumn("rank", F.row_number().over(order) - 1).join(begins, ["spec_id", "n_tokens", "part"], "left")
    ranked = ranked.select("spec_id", "doc_id", "piece", "first_token", "n_tokens", (F.col("rank") + F.coalesce("earlier", F.lit(0))).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spec_of, size, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 4, 5))
            out = np.full(batch.num_rows, -1, np.int64)
            for s, slots in shared.value.items():
                own = np.flatnonzero((spec_of == s) & (size > 0))
                out[own] = slots.containers(size[own], rank[own])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, mask=out < 0), *(batch.column(i) for i in range(1, 5))], ["spec_id", "container_id", "doc_id", "piece", "first_token", "n_tokens"])

    return ranked.mapInArrow(place, schema)


def faults(packed: DataFrame, sizes: DataFrame, specs: list[tuple[int, int]]) -> DataFrame:
    """(spec_id, documents, over_full, split_short, broken): documents that a packing names, containers with more than
    their capacity, documents cut though they are not above it, and documents whose pieces don't add up to them, end to end.

    `sizes` has (doc_id, n_tokens), one row a document.
    """
    capacity = F.element_at(F.create_map(*[F.lit(x).cast("long") for s in specs for x in s]), F.col("spec_id"))
    held = packed.where("container_id is not null").groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("n"))
    full = held.groupBy("spec_id").agg(F.count_if(F.col("n") > capacity).alias("over_full"))
    whole = packed.groupBy("spec_id", "doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("n"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"), F.countDistinct("first_token").alias("starts"))
    own = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("own"))
    each = whole.join(own, "doc_id").groupBy("spec_id").agg(
        F.count("*").alias("documents"),
        F.count_if((F.col("pieces") > 1) & (F.col("own") <= capacity)).alias("split_short"),
        F.count_if((F.col("n") != F.col("own")) | (F.col("end") != F.col("own")) | (F.col("starts") != F.col("pieces"))).alias("broken"),
    )
    return each.join(full, "spec_id", "left").select("spec_id", "documents", F.coalesce("over_full", F.lit(0)).alias("over_full"), "split_short", "broken")


def fill(packed: DataFrame, specs: list[tuple[int, int]]) -> DataFrame:
    """(spec_id, containers, tokens, least, fill): containers used, the fewest that any packing needs by volume, and the share of room used."""
    capacity = F.element_at(F.create_map(*[F.lit(x).cast("long") for s in specs for x in s]), F.col("spec_id"))
    each = packed.where("container_id is not null").groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("n"))
    total = each.groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"))
    return total.withColumns({"least": F.ceil(F.col("tokens") / capacity), "fill": F.round(F.col("tokens") / (F.col("containers") * capacity), 6)})
