"""Items that appear together: a blocked Gram matrix over binary baskets.

Baskets become binary sparse rows with the items numbered by falling frequency. The columns of the common
items are cut into blocks, and for each block of records the products of the transposed item blocks are
added up: G[I, J] += X[I]' X[J]. The columns of rarer items hold few entries, so their part of the product
is taken entry by entry. Each task keeps its sums and emits one partial count a pair, so the shuffle carries
pairs of items, not pairs of a basket.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setlore.session import materialise

BLOCK = 256
#: Items, the most frequent ones, whose columns are multiplied as dense blocks.
HEAD = 13 * BLOCK
#: Non-null items gathered before one round of products.
ENTRIES = 1 << 20
#: Pairs of single entries that are counted at once.
AT_ONCE = 1 << 22
#: Items of the broadcast dictionary, at most, by falling frequency; the others travel by name.
DICTIONARY = 50_000
#: Bits of the broadcast filter that keeps items too rare for the limits out of the products.
FILTER_BITS = 1 << 24
ROWS = 4096


def gram(row: np.ndarray, col: np.ndarray, items: int, block: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray]]:
    """(I, J, counts) of every pair of item blocks I <= J that meets in a row; (row, col) are distinct, sorted by row."""
    order = np.argsort(col // block, kind="stable")
    blocks, starts = np.unique((col // block)[order], return_index=True)
    parts = {i: (row[m], col[m] - i * block) for i, m in zip(blocks, np.split(order, starts[1:]))}
    for i, (ri, ci) in parts.items():
        for j, (rj, cj) in parts.items():
            if j < i:
                continue
            both = np.intersect1d(ri, rj)
            if not len(both):
                continue
            total = np.zeros((block, block), np.int64)
            for at in range(0, len(both), ROWS):
                some = both[at : at + ROWS]
                a, b = _dense(ri, ci, some, block), _dense(rj, cj, some, block)
                total += (a.T @ b).astype(np.int64)  # float32 holds whole numbers up to 2^24 > ROWS exactly
            yield int(i), int(j), total


def _dense(row: np.ndarray, col: np.ndarray, some: np.ndarray, block: int) -> np.ndarray:
    at = np.searchsorted(some, row)
    at[at == len(some)] = 0
    ok = some[at] == row
    out = np.zeros((len(some), block), np.float32)
    out[at[ok], col[ok]] = 1
    return out


def entry_pairs(row: np.ndarray, col: np.ndarray, head: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, counts), a < b: the pairs of columns that meet in a row and one of which is `head` or beyond; (row, col) are distinct, sorted by both."""
    start = np.searchsorted(row, row)
    late = np.nonzero(col >= head)[0]
    late = late[late > start[late]]
    many = late - start[late]
    size = int(col.max()) + 1 if len(col) else 1
    ends = np.cumsum(many)
    at = 0
    while at < len(late):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        some, n = late[at:stop], many[at:stop]
        second = np.repeat(some, n)
        first = np.arange(len(second)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[some], n)
        keys, counts = np.unique(col[first] * size + col[second], return_counts=True)
        yield keys // size, keys % size, counts
        at = stop


def _bit(item: DataFrame) -> DataFrame:
    """The set bits of the filter over a column `item`, by words of 64: (at, bits), at most FILTER_BITS / 64 rows."""
    bit = F.pmod(F.xxhash64("item"), F.lit(FILTER_BITS))
    return item.select(F.floor(bit / 64).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))


def cooccurrence(df: DataFrame, items: str, min_count: int = 1, min_share: int = 0) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n, lift) of every pair of different items that meet in a basket, item_a < item_b.

    items: an array<string> column; within a basket an item counts once and nulls do not count. n is the
    number of baskets with an item, lift = n_ab * n / (n_a * n_b). min_count: least n_ab. min_share: with
    k > 0 only pairs with k * n_ab >= n.

    Both limits hold for the single items of such a pair too, so rarer items are dropped before the
    products, without loss: by the dictionary of the DICTIONARY most frequent items, and beyond it by a
    filter of fixed size whose false hits fall out in the join with the exact counts. Any number of items
    takes the same path.

    Null or empty baskets count nowhere; repeated baskets count each time; an empty table gives an empty
    table. Only the named column is read.
    """
    baskets = df.select(F.array_distinct(F.filter(F.col(items), lambda x: x.isNotNull())).alias("items")).where(F.size("items") > 0)
    n = baskets.count()
    least = max(min_count, -(-n // min_share) if min_share else 1)
    counts = materialise(baskets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("c")).where(F.col("c") >= least))
    known = [r[0] for r in counts.orderBy(F.desc("c"), "item").limit(DICTIONARY + 1).select("item").collect()]
    words = pa.array(known[:DICTIONARY], pa.string())
    bits = np.zeros(0, np.int64)
    if len(known) > DICTIONARY:
        bits = np.zeros(FILTER_BITS // 64, np.int64)
        for r in _bit(counts).toLocalIterator():
            bits[r["at"]] = r["bits"]
    shared = df.sparkSession.sparkContext.broadcast((words, bits))
    schema = pa.schema([("item_a", pa.string()), ("item_b", pa.string()), ("n_ab", pa.int64())])
    head = min(HEAD, len(words))

    def named(a: np.ndarray, b: np.ndarray, n_ab: np.ndarray, names: pa.Array) -> pa.RecordBatch:
        left, right = names.take(pa.array(a)), names.take(pa.array(b))
        swap = pc.greater(left, right)
        return pa.RecordBatch.from_arrays([pc.if_else(swap, right, left), pc.if_else(swap, left, right), pa.array(n_ab, pa.int64())], schema=schema)

    def emit(sums: dict[tuple[int, int], np.ndarray], names: pa.Array) -> Iterator[pa.RecordBatch]:
        for (i, j), g in sums.items():
            x, y = np.nonzero(g)
            keep = (x + i * BLOCK) != (y + j * BLOCK) if i != j else x < y
            yield named(x[keep] + i * BLOCK, y[keep] + j * BLOCK, g[x[keep], y[keep]], names)

    def passes(found: pa.Array, bits: np.ndarray) -> np.ndarray:
        at = np.array([xxhash.xxh64_intdigest(x, seed=42) for x in found.to_pylist()], np.uint64) % np.uint64(FILTER_BITS)
        return (bits[(at // np.uint64(64)).astype(np.int64)] >> (at % np.uint64(64)).astype(np.int64)) & 1 == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        words, bits = shared.value
        sums: dict[tuple[int, int], np.ndarray] = {}
        held, entries = [], 0

        def products() -> Iterator[pa.RecordBatch]:
            lists = pa.chunked_array(held).combine_chunks()
            flat, row = lists.flatten(), pc.list_parent_indices(lists).to_numpy().astype(np.int64)
            col = pc.index_in(flat, value_set=words)
            names = words
            ok = pc.is_valid(col).to_numpy(zero_copy_only=False)
            number = pc.fill_null(col, 0).to_numpy().astype(np.int64)
            if len(bits) and not ok.all():
                rest = flat.filter(pa.array(~ok))
                others = pc.unique(rest)
                others = others.filter(pa.array(passes(others, bits)))
                spot = pc.index_in(rest, value_set=others)
                number[~ok] = pc.fill_null(spot, 0).to_numpy().astype(np.int64) + len(words)
                ok[~ok] = pc.is_valid(spot).to_numpy(zero_copy_only=False)
                names = pa.concat_arrays([words, others])
            row, number = row[ok], number[ok]
            order = np.lexsort((number, row))
            row, number = row[order], number[order]
            common = number < head
            for i, j, g in gram(row[common], number[common], head):
                if (i, j) in sums:
                    sums[i, j] += g
                else:
                    sums[i, j] = g
            for a, b, c in entry_pairs(row, number, head):
                yield named(a, b, c, names)

        for batch in batches:
            if batch.num_rows:
                held.append(batch["items"])
                entries += len(batch["items"].flatten())
            if entries >= ENTRIES:
                yield from products()
                held, entries = [], 0
        if held:
            yield from products()
        yield from emit(sums, words)

    partial = baskets.mapInArrow(run, "item_a string, item_b string, n_ab long")
    pairs = partial.groupBy("item_a", "item_b").agg(F.sum("n_ab").alias("n_ab")).where(F.col("n_ab") >= least)
    one = counts.select(F.col("item").alias("item_a"), F.col("c").alias("n_a"))
    two = counts.select(F.col("item").alias("item_b"), F.col("c").alias("n_b"))
    return pairs.join(one, "item_a").join(two, "item_b").select(
        "item_a", "item_b", "n_ab", "n_a", "n_b", F.lit(n).cast("long").alias("n"), (F.col("n_ab") * F.lit(float(n)) / (F.col("n_a").cast("double") * F.col("n_b"))).alias("lift")
    )
