"""Filling containers of fixed capacity with items, by linear grouping.

An item is a text, its size the number of its tokens. Sizes are whole numbers up to the capacity, so all that a plan
needs to know of the corpus, whatever its length, is how many items have each size: at most `capacity` numbers, which
are counted by all tasks and planned on the driver.

1. Large sizes are cut, in order, into groups with equally many items, and rounded up to their group's largest.
2. For these few sizes the best mix of configurations (contents of one container) is found by linear programming with
   column generation; the whole parts of the solution are used.
3. The items themselves take the places of their groups, largest first, which leaves room where they were rounded up;
   items that no whole configuration took, and then the small ones, go best-fit, in falling size.

A plan is a list of runs: the items of a size with ranks r0.. go to containers c0.., `per` to each. Every item gets a
rank among those of its size from its place in the written table of sizes, and looks up its container.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.bpe import TOKENIZERS, VOCABULARY, count_tokens
from brindle.storage import free_name, materialize

CAPACITY, GROUPS, SMALL = 2048, 32, 8


def best_configuration(sizes: list[int], worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The contents of one container with the highest total worth (a knapsack with repeats), by dynamic programming."""
    value = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    s, k = np.array(sizes), np.arange(len(sizes))
    for c in range(int(s.min()), capacity + 1):
        ok = s <= c
        got = value[c - s[ok]] + worth[ok]
        i = int(got.argmax())
        if got[i] > value[c - 1] + 1e-12:
            value[c], pick[c] = got[i], k[ok][i]
        else:
            value[c] = value[c - 1]
    counts, c = np.zeros(len(sizes), int), capacity
    while c > 0:
        if pick[c] < 0 or value[c] == value[c - 1]:
            c -= 1
        else:
            counts[pick[c]] += 1
            c -= sizes[pick[c]]
    return float(value[capacity]), counts


def configurations(sizes: list[int], demand: list[int], capacity: int) -> tuple[list[tuple[np.ndarray, int]], float, float]:
    """(contents, how often): whole numbers of containers that take at most the demand, by a revised simplex; the containers
    of the linear programme's solution, and a number that none of its solutions can be below.

    Columns are generated until none is worth more than a container, which is the optimum; then both numbers are equal. Only if
    rounding made the simplex come back to a basis would it stop before, and the two would show by how much."""
    n = len(sizes)
    columns = [np.eye(n, dtype=int)[i] * (capacity // sizes[i]) for i in range(n)]
    d = np.array(demand, float)
    basis = np.array(columns, float).T
    met, bound = set(), 0.0
    while (now := tuple(sorted(c.tobytes() for c in columns))) not in met:
        met.add(now)
        worth = np.linalg.solve(basis.T, np.ones(n))
        gain, new = best_configuration(sizes, np.maximum(worth, 0), capacity)
        bound = max(bound, float(d @ worth) / max(gain, 1.0))  # no configuration is worth more than `gain`
        if gain <= 1 + 1e-9:
            break
        x, move = np.linalg.solve(basis, d), np.linalg.solve(basis, new.astype(float))
        ratio = np.where(move > 1e-9, np.maximum(x, 0) / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        columns[out] = new
        basis[:, out] = new
    x = np.maximum(np.linalg.solve(basis, d), 0)
    left, taken = np.array(demand), []
    for i in np.argsort(-x):
        used = columns[i] > 0
        often = min(int(x[i] + 1e-6), *(int(v) for v in left[used] // columns[i][used]))
        if often > 0:
            taken.append((columns[i], often))
            left = left - often * columns[i]
    return taken, float(x.sum()), bound


def least_containers(counts: dict[int, int], capacity: int) -> int:
    """A number of containers that no packing of items given as {size: how many} can be below: for every size k, items larger
    than capacity - k have containers of their own, and what is of size k or more must fit beside and beyond them."""
    size = np.array(sorted(counts), np.int64)
    n = np.array([counts[s] for s in size.tolist()], np.int64)
    best = 0
    for k in [0, *size[size * 2 <= capacity].tolist()]:
        big, mid, low = size > capacity - k, (size <= capacity - k) & (size * 2 > capacity), (size * 2 <= capacity) & (size >= k)
        room = int(n[mid].sum()) * capacity - int(n[mid] @ size[mid])
        best = max(best, int(n[big | mid].sum()) + max(0, -(-(int(n[low] @ size[low]) - room) // capacity)))
    return best


class Plan:
    """Containers for items given as {size: how many}."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL):
        self.capacity, self.containers = capacity, 0
        self.solution = self.bound = 0.0  # containers of the linear programme, and what none can be below
        self.runs: list[tuple[int, int, int, int, int]] = []  # size, first rank, items, first container, items in each
        self.room: dict[int, list[tuple[int, int]]] = {}  # free space: (first container, how many)
        self.rooms: list[int] = []
        counts = {s: n for s, n in counts.items() if n > 0}
        rank = dict.fromkeys(counts, 0)
        large = sorted((s for s in counts if s * small > capacity and s < capacity), reverse=True)
        if large:
            self.grouped(counts, rank, large, groups)
        for s in sorted(counts, reverse=True):
            self.best_fit(s, rank[s], counts[s] - rank[s])

    def free(self, space: int, first: int, n: int) -> None:
        if n and space:
            if space not in self.room:
                self.room[space] = []
                insort(self.rooms, space)
            self.room[space].append((first, n))

    def best_fit(self, size: int, rank: int, n: int) -> None:
        """n items of one size to the tightest containers that have room, then to new ones."""
        while n > 0:
            i = bisect_left(self.rooms, size)
            if i == len(self.rooms):
                per = self.capacity // size
                space, first, have = self.capacity, self.containers, -(-n // per)
                self.containers += have
            else:
                space = self.rooms[i]
                first, have = self.room[space].pop()
                if not self.room[space]:
                    del self.room[space], self.rooms[i]
                per = space // size
            full = min(have, n // per)
            if full:
                self.runs.append((size, rank, full * per, first, per))
                self.free(space - per * size, first, full)
                rank, n = rank + full * per, n - full * per
            if full < have:
                rest = n if n < per else 0
                if rest:
                    self.runs.append((size, rank, rest, first + full, rest))
                    self.free(space - rest * size, first + full, 1)
                    rank, n = rank + rest, 0
                self.free(space, first + full + (rest > 0), have - full - (rest > 0))

    def grouped(self, counts: dict[int, int], rank: dict[int, int], large: list[int], groups: int) -> None:
        total = sum(counts[s] for s in large)
        if len(large) <= groups:  # few sizes as they are: nothing need be rounded
            cuts = np.cumsum([counts[s] for s in large]).tolist()
        else:
            cuts = sorted({round(total * g / groups) for g in range(1, groups + 1)} - {0})
        members: list[list[list[int]]] = [[]]  # per group: [size, first rank, items], sizes falling
        at, g = 0, 0
        for s in large:
            lo, n = 0, counts[s]
            while n:
                part = min(n, cuts[g] - at)
                members[g].append([s, lo, part])
                lo, n, at = lo + part, n - part, at + part
                if at == cuts[g] and at < total:
                    members.append([])
                    g += 1
        merged: dict[int, list[list[int]]] = {}  # groups with the same largest size are one
        for m in members:
            merged.setdefault(m[0][0], []).extend(m)
        sizes = sorted(merged, reverse=True)
        demand = [sum(x[2] for x in merged[s]) for s in sizes]
        queues = [merged[s] for s in sizes]
        taken: dict[int, list[tuple[int, int, int]]] = {}
        found, self.solution, self.bound = configurations(sizes, demand, self.capacity)
        for contents, often in found:
            first = self.containers
            self.containers += often
            cuts_at, steps = {0}, []  # where the size in a slot changes along the containers
            for k in np.nonzero(contents)[0]:
                for _ in range(int(contents[k])):
                    done = 0
                    while done < often:
                        run = queues[k][0]
                        part = min(run[2], often - done)
                        taken.setdefault(run[0], []).append((run[1], part, first + done))
                        steps.append((done, run[0]))
                        steps.append((done + part, -run[0]))
                        cuts_at.add(done)
                        done += part
                        run[1], run[2] = run[1] + part, run[2] - part
                        if not run[2]:
                            queues[k].pop(0)
            change: dict[int, int] = {}
            for where, size in steps:
                change[where] = change.get(where, 0) + size
            used, marks = 0, sorted(change)
            for a, b in zip(marks, [*marks[1:], often]):
                used += change[a]
                if b > a:
                    self.free(self.capacity - used, first + a, b - a)
        # What is left of a size is moved behind its taken ranks, so that the rest is one range of ranks.
        for s, parts in taken.items():
            lo = 0
            for _, n, container in sorted(parts):
                self.runs.append((s, lo, n, container, 1))
                lo += n
            rank[s] = lo


def _local_ranks(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    """Adds the task's number and the rank of each row among the task's rows of its size."""
    part = TaskContext.get().partitionId()
    seen: dict[int, int] = {}
    for b in batches:
        if not b.num_rows:
            continue
        size = b.column(b.num_columns - 1).to_numpy()
        order = np.argsort(size, kind="stable")
        values, start, n = np.unique(size[order], return_index=True, return_counts=True)
        base = np.array([seen.get(v, 0) for v in values.tolist()])
        rank = np.empty(len(size), np.int64)
        rank[order] = np.arange(len(size)) - np.repeat(start, n) + np.repeat(base, n)
        seen.update(zip(values.tolist(), (base + n).tolist()))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(size), part, np.int32)), pa.array(rank)], names=[*(f"k{i}" for i in range(keep)), "piece", "size", "part", "local"])


def pack(sized: DataFrame, size: str, keep: list[str], capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """The kept columns of every item, `piece` (int, 0 unless the item was split), `size` (bigint, of the piece) and its
    `container` (bigint, from 0). Items larger than the capacity are split into pieces of the capacity and a rest; other
    items are whole. Items without a size, or of size 0 or less, go nowhere and have no row. Repeated rows are items of
    their own. An empty table gives no rows. The new columns get an underscore where a kept one has their name."""
    names = [f"k{i}" for i in range(len(keep))]
    n = F.col("n").cast("bigint")
    items = sized.select(*(F.col(c).alias(k) for c, k in zip(keep, names)), F.col(size).alias("n")).where("n > 0")
    pieces = items.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / capacity).cast("int"))))
    pieces = pieces.select(*names, "piece", F.least(F.lit(capacity).cast("bigint"), n - F.col("piece").cast("bigint") * capacity).alias("size"))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    width = len(names)
    ranked = materialize(pieces.mapInArrow(lambda it: _local_ranks(it, width), f"{types}, part int, local bigint"), "sizes")

    counts = {r["size"]: r["n"] for r in ranked.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    plan = Plan(counts, capacity, groups)
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 5)
    shared = sized.sparkSession.sparkContext.broadcast(runs)  # bounded by the capacity, not by the corpus

    before = ranked.groupBy("size", "part").agg(F.count(F.lit(1)).alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    placed = ranked.join(before.select("size", "part", offset.alias("offset")), ["size", "part"])
    placed = placed.select(*names, "piece", "size", (F.col("local") + F.col("offset")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        span = int((table[:, 1] + table[:, 2]).max(initial=0)) + 1
        starts = table[:, 0].astype(object) * span + table[:, 1] if span * (capacity + 1) >= 2**63 else table[:, 0] * span + table[:, 1]
        for b in batches:
            s, rank = b.column(width + 1).to_numpy(), b.column(width + 2).to_numpy()
            at = np.searchsorted(starts, s * span + rank, side="right") - 1
            container = table[at, 3] + (rank - table[at, 1]) // table[at, 4]
            yield pa.RecordBatch.from_arrays([*b.columns[: width + 2], pa.array(container)], names=[*names, "piece", "size", "container"])

    done = placed.mapInArrow(run, f"{types}, container bigint")
    piece, new = free_name("piece", keep), free_name("size", keep)
    return done.select(*(F.col(k).alias(c) for k, c in zip(names, keep)), F.col("piece").alias(piece), F.col("size").alias(new), F.col("container").alias(free_name("container", keep)))


def pack_texts(df: DataFrame, text: str, keep: list[str], capacity: int = CAPACITY, groups: int = GROUPS, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """`pack` with the texts' tokens as sizes; null and empty texts go nowhere."""
    taken = free_name("n_tokens", keep)
    return pack(count_tokens(df, text, keep, taken, tokenizers, vocabulary), taken, keep, capacity, groups)


def summary(packed: DataFrame, size: str = "size", container: str = "container", capacity: int = CAPACITY) -> DataFrame:
    """One row about a packing: `items`, `tokens`, `containers`, the number `least` that no packing can be below, their `gap`,
    and the share of all room that is `unused` (null without items). Counted by size and by container, with partial counts."""
    counts = {r["s"]: r["n"] for r in packed.groupBy(F.col(size).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    least = least_containers(counts, capacity)
    used = packed.select(container).distinct().agg(F.count(F.lit(1)).alias("containers"))
    items, tokens = sum(counts.values()), sum(s * n for s, n in counts.items())
    c = F.col("containers")
    lit = lambda x: F.lit(x).cast("bigint")
    unused = F.lit(1.0) - F.try_divide(F.lit(float(tokens)), c * capacity)
    return used.select(lit(items).alias("items"), lit(tokens).alias("tokens"), "containers", lit(least).alias("least"), (c - lit(least)).alias("gap"), unused.alias("unused"))
