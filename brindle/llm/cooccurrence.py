"""Items that appear together: counts of item pairs per basket, and how far they exceed chance.

Each task turns its baskets into a binary sparse matrix X (basket x item), a few thousand records at a time, and adds up
the Gram matrix X'X in blocks of items. Items have numbers, frequent ones low numbers. Where both items are among the
first HEAD, the sums lie in dense blocks: short baskets are added as sparse outer products, one per basket length, long
ones as dense products of the blocks they touch. All other blocks are nearly empty and are kept as sorted lists of
their cells. Cells of a task are added up until there are more than HELD; then the smaller half of the counts is passed
on, so that pairs that come often stay and combine, and memory stays bounded for any number of items. Only non-zero sums
are shuffled, never single pairs, and they are set against the product of the items' own counts.

`pair_counts` asks for a support. A pair in at least a `1/share`-th of the N baskets has two items that are each in as
many, and baskets of L distinct items on average leave at most `share` x L such items. These frequent items get numbers
by falling frequency; that table is the only thing sent to all tasks, and its size is checked. Where it is too large, and
in `every_pair`, which has no support, each task numbers its items itself, and the items' counts come by joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.storage import materialize, spread

#: Items of a dense block, items in dense blocks, records of a slice, the longest basket taken as sparse outer products.
SIDE, HEAD, RECORDS, SHORT = 256, 2048, 4096, 24
#: Cells of nearly empty blocks that a task holds (16 bytes each); rows of a batch that it passes on.
HELD, OUT = 1 << 21, 1 << 17
#: Frequent items that may be sent to all tasks.
MOST_ITEMS = 1 << 18

Cells = tuple[np.ndarray, np.ndarray]


class Gram:
    """X'X above its diagonal: codes (a << 32 | b, with a < b) of item pairs, and their counts."""

    def __init__(self, side: int = SIDE, head: int = HEAD, held: int = HELD):
        self.side, self.head, self.held = side, head, held
        self.blocks: dict[tuple[int, int], np.ndarray] = {}
        self.codes, self.times, self.fresh, self.n_fresh = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, ids: np.ndarray, n: np.ndarray) -> Iterator[Cells]:
        """Add records: their item numbers, ascending within a record, one record after the other; their lengths.

        Gives the cells that had to make room."""
        ids = ids.astype(np.int64)
        start = np.cumsum(n) - n
        for length in np.unique(n[(n > 1) & (n <= SHORT)]):
            a, b = np.triu_indices(length, 1)
            at = start[n == length]
            for lo in range(0, len(at), max(1, self.held // len(a))):
                x = ids[at[lo : lo + max(1, self.held // len(a)), None] + np.arange(length)]  # record x place
                yield from self.put((x[:, a] << 32 | x[:, b]).ravel())
        if (long := np.nonzero(n > SHORT)[0]).size:
            records = [ids[start[r] : start[r] + n[r]] for r in long]
            self.dense([x[x < self.head] for x in records])
            for x in records:
                for i in range(int(np.searchsorted(x, self.head)), len(x)):
                    yield from self.put(x[:i] << 32 | x[i])

    def put(self, codes: np.ndarray) -> Iterator[Cells]:
        """Sparse outer products: to the dense blocks, or to the cells of the others."""
        inner = codes & 0xFFFFFFFF < self.head
        if inner.any():
            code, times = np.unique(codes[inner], return_counts=True)
            a, b = code >> 32, code & 0xFFFFFFFF
            where = a // self.side << 32 | b // self.side
            order = np.argsort(where, kind="stable")
            for part in np.split(order, np.nonzero(np.diff(where[order]))[0] + 1):
                i, j = int(a[part[0]] // self.side), int(b[part[0]] // self.side)
                self.block(i, j)[a[part] % self.side, b[part] % self.side] += times[part]  # codes are distinct
            codes = codes[~inner]
        if codes.size:
            self.fresh.append(codes)
            self.n_fresh += len(codes)
            if self.n_fresh >= self.held:
                self.merge()
                if len(self.codes) > self.held:
                    yield self.make_room()

    def block(self, i: int, j: int) -> np.ndarray:
        b = self.blocks.get((i, j))
        if b is None:
            b = self.blocks[i, j] = np.zeros((self.side, self.side), np.int64)
        return b

    def dense(self, records: list[np.ndarray]) -> None:
        """Products of dense sub-matrices: for two item blocks, of the records that touch both."""
        touched: dict[int, dict[int, np.ndarray]] = {}
        for r, x in enumerate(records):
            which = x // self.side
            for k in np.unique(which):
                touched.setdefault(int(k), {})[r] = x[which == k] % self.side
        for i in sorted(touched):
            for j in sorted(k for k in touched if k >= i):
                both = sorted(touched[i].keys() & touched[j].keys())
                for lo in range(0, len(both), 1024):
                    part = both[lo : lo + 1024]
                    x, y = (np.zeros((len(part), self.side), np.float32) for _ in range(2))
                    for p, r in enumerate(part):
                        x[p, touched[i][r]] = 1
                        y[p, touched[j][r]] = 1
                    g = (x.T @ y).astype(np.int64)  # counts up to 1024 are exact
                    self.block(i, j)[:] += np.triu(g, 1) if i == j else g

    def merge(self) -> None:
        if self.fresh:
            new, times = np.unique(np.concatenate(self.fresh), return_counts=True)
            codes, where = np.unique(np.concatenate([self.codes, new]), return_inverse=True)
            self.times = np.bincount(where, weights=np.concatenate([self.times, times]), minlength=len(codes)).astype(np.int64)  # exact up to 2**53
            self.codes, self.fresh, self.n_fresh = codes, [], 0

    def make_room(self) -> Cells:
        """Takes out half of the cells, those with the smallest counts."""
        out = np.zeros(len(self.codes), bool)
        out[np.argpartition(self.times, len(self.codes) // 2)[: len(self.codes) // 2]] = True
        gone = self.codes[out], self.times[out]
        self.codes, self.times = self.codes[~out], self.times[~out]
        return gone

    def flush(self) -> Iterator[Cells]:
        self.merge()
        for (i, j), b in self.blocks.items():
            r, c = np.nonzero(b)
            yield (r + i * self.side) << 32 | (c + j * self.side), b[r, c]
        yield self.codes, self.times
        self.blocks.clear()
        self.codes, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)


def item_counts(baskets: DataFrame, items: str) -> DataFrame:
    """(item, n_a): baskets that hold the item. Partial counts are combined before the shuffle."""
    return baskets.select(F.explode(F.array_distinct(items)).alias("item")).where("item is not null").groupBy("item").agg(F.count(F.lit(1)).alias("n"))


def _baskets(baskets: DataFrame, items: str) -> DataFrame:
    """The distinct items of every basket that has some, in a column `items`."""
    return materialize(baskets.select(F.array_distinct(F.filter(items, lambda x: x.isNotNull())).alias("items")).where("size(items) > 0"), "baskets")


def _lift(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("lift", F.col("n_ab").cast("double") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b")))


def pair_counts(baskets: DataFrame, items: str, least: int, share: int, most_items: int = MOST_ITEMS) -> DataFrame:
    """(item_a, item_b, n_a, n_b, n_ab, n, lift) of the pairs in at least `least` baskets and a `share`-th of all N.

    `items` is an array of strings, in which an item counts once a basket; item_a comes before item_b by code point.
    N counts the baskets with an item, null items are none, and empty or null baskets are not counted. `lift` is
    n_ab * N / (n_a * n_b), 1 being chance. Baskets of any length are used whole; every repeated basket counts.
    An empty table gives no rows. Other columns are not read. Where more than `most_items` items have the support, the
    result is the same, but the items' names travel with their counts."""
    spark = baskets.sparkSession
    baskets = _baskets(baskets, items)
    n_all = baskets.count()
    enough = max(least, -(-n_all // share))
    counts = item_counts(baskets, "items")
    frequent = counts.where(F.col("n") >= enough).orderBy(F.desc("n"), "item").limit(most_items + 1).collect()
    if len(frequent) > most_items:
        return _named(baskets, counts, n_all).where(F.col("n_ab") >= enough)
    names, n = [r["item"] for r in frequent], [r["n"] for r in frequent]
    shared = spark.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(shared.value, pa.string())
        gram = Gram()

        def out(cells: Iterator[Cells]) -> Iterator[pa.RecordBatch]:
            for codes, times in cells:
                for lo in range(0, len(codes), OUT):
                    c = codes[lo : lo + OUT]
                    yield pa.RecordBatch.from_pydict({"a": pa.array((c >> 32).astype(np.int32)), "b": pa.array((c & 0xFFFFFFFF).astype(np.int32)), "n": pa.array(times[lo : lo + OUT])})

        for batch in batches:
            for lo in range(0, batch.num_rows, RECORDS):
                lists = batch.column(0).slice(lo, RECORDS)
                # numbers of the items, and the records they are in; rarer items have none
                numbers = lists.flatten().dictionary_encode()
                at = pa.compute.index_in(numbers.dictionary, names).to_numpy(zero_copy_only=False).astype(np.float64)
                ids = at[numbers.indices.to_numpy()]
                record = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                ok = ~np.isnan(ids)
                ids, record = ids[ok].astype(np.int32), record[ok]
                order = np.lexsort((ids, record))
                yield from out(gram.add(ids[order], np.bincount(record, minlength=len(lists))))
        yield from out(gram.flush())

    cells = baskets.mapInArrow(run, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n_ab")).where(F.col("n_ab") >= enough)
    numbered = spark.createDataFrame([(i, x, c) for i, (x, c) in enumerate(zip(names, n))], "i int, item string, c bigint")
    left, right = numbered.toDF("a", "item_l", "n_l"), numbered.toDF("b", "item_r", "n_r")
    pairs = cells.join(left, "a").join(right, "b")
    # Spark compares strings by their UTF-8 bytes, which is the order of code points.
    first = F.col("item_l") < F.col("item_r")
    pick = lambda x, y, name: F.when(first, F.col(x)).otherwise(F.col(y)).alias(name)
    out = pairs.select(pick("item_l", "item_r", "item_a"), pick("item_r", "item_l", "item_b"), pick("n_l", "n_r", "n_a"), pick("n_r", "n_l", "n_b"), "n_ab", F.lit(n_all).cast("long").alias("n"))
    return _lift(out)


class Named:
    """A task's Gram matrix under numbers of its own, in the order in which items come, and the names behind them."""

    def __init__(self, held: int = HELD):
        self.number: dict[str, int] = {}
        self.gram, self.held = Gram(held=held), held

    def add(self, lists: pa.ListArray) -> Iterator[pa.RecordBatch]:
        coded = lists.flatten().dictionary_encode()
        own = np.array([self.number.setdefault(x, len(self.number)) for x in coded.dictionary.to_pylist()], np.int64)
        ids = own[coded.indices.to_numpy()]
        n = np.diff(lists.offsets.to_numpy())
        ids = ids[np.lexsort((ids, np.repeat(np.arange(len(lists)), n)))]
        yield from self.out(self.gram.add(ids, n))
        if len(self.number) >= self.held:  # the names must fit too
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        yield from self.out(self.gram.flush())
        self.number = {}

    def out(self, cells: Iterator[Cells]) -> Iterator[pa.RecordBatch]:
        """Cells by name, item_a before item_b by code point."""
        names = None
        for codes, times in cells:
            if names is None:
                names = list(self.number)
                place = np.empty(len(names), np.int64)
                place[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
                names = pa.array(names, pa.string())
            for lo in range(0, len(codes), OUT):
                a, b = codes[lo : lo + OUT] >> 32, codes[lo : lo + OUT] & 0xFFFFFFFF
                a, b = np.where(place[a] < place[b], a, b), np.where(place[a] < place[b], b, a)
                yield pa.RecordBatch.from_pydict({"item_a": names.take(pa.array(a)), "item_b": names.take(pa.array(b)), "n": pa.array(times[lo : lo + OUT])})


def _named(baskets: DataFrame, counts: DataFrame, n_all: int) -> DataFrame:
    counts = materialize(counts, "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = Named()
        for batch in batches:
            for lo in range(0, batch.num_rows, RECORDS):
                yield from named.add(batch.column(0).slice(lo, RECORDS))
        yield from named.flush()

    cells = spread(baskets).mapInArrow(run, "item_a string, item_b string, n bigint").groupBy("item_a", "item_b").agg(F.sum("n").alias("n_ab"))
    known = cells.join(counts.toDF("item_a", "n_a"), "item_a").join(counts.toDF("item_b", "n_b"), "item_b")
    return _lift(known.select("item_a", "item_b", "n_a", "n_b", "n_ab", F.lit(n_all).cast("long").alias("n")))


def every_pair(baskets: DataFrame, items: str) -> DataFrame:
    """The columns of `pair_counts`, of all pairs of items that share a basket, however few: no support and no bound on
    the number of items. Rules for items and baskets are the same. The result can be as large as the baskets' pairs."""
    baskets = _baskets(baskets, items)
    return _named(baskets, item_counts(baskets, "items"), baskets.count())
