"""Documents packed into containers of fixed capacity with little unused space, by swap-based local search.

Documents are spread over blocks of about ``BLOCK`` items, so no task sees more than a bounded number of them. Each
block starts from a best-fit filling. Then, from the emptiest bin on, documents move, change places one for one, or two
for one with documents of fuller bins, always by the exchange that fills the fuller bin most. Each step raises the sum
of squared fills, so the search ends by itself where no step is left; bins that run empty go. What stands in poorly
filled bins of all blocks is packed and searched once more in blocks of the same size.

Defined results: a document longer than the capacity fills containers of its own with whole capacities, and its rest is
an item like any other; documents of no token are in no container; every other document is in exactly one per capacity.
Null or non-positive capacities pack nothing. Ties fall to the lower doc_id.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import stored

BLOCK, POOR = 4096, 0.97  # items packed together, and the fill under which a bin is packed again
_OUT = "pack_name string, capacity bigint, doc_id bigint, piece_no bigint, n_tokens bigint, block bigint, start_bin bigint, bin bigint, bin_tokens bigint"


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Bins of items given in falling order of size."""
    free: list[tuple[int, int]] = []
    out, bins = [], 0
    for s in sizes:
        k = bisect_left(free, (s, -1))
        if k < len(free):
            room, b = free.pop(k)
        else:
            room, b = capacity, bins
            bins += 1
        out.append(b)
        if room > s:
            insort(free, (room - s, b))
    return out


def improve(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Local search over underfull bins until no step is left; every step raises the sum of squared fills."""
    bins = bins.copy()
    fill = np.bincount(bins, weights=sizes).astype(np.int64)
    inside: list[list[int]] = [[] for _ in fill]
    for i, b in enumerate(bins.tolist()):
        inside[b].append(i)
    while any([_empty(a, sizes, bins, fill, inside, capacity) for a in np.argsort(fill, kind="stable").tolist() if 0 < fill[a] < capacity]):
        pass
    return bins


def _empty(a: int, sizes: np.ndarray, bins: np.ndarray, fill: np.ndarray, inside: list[list[int]], capacity: int) -> bool:
    """Takes what it can out of one bin; whether anything changed."""

    def put(i: int, b: int) -> None:
        inside[bins[i]].remove(i)
        inside[b].append(i)
        fill[bins[i]] -= sizes[i]
        fill[b] += sizes[i]
        bins[i] = b

    changed = False
    while fill[a]:
        own = np.array(sorted(inside[a], key=lambda i: (-sizes[i], i)))
        # move a document: to the fullest bin that has room and will be fuller than this one is now
        moved = False
        for i in own.tolist():
            fits = np.flatnonzero((fill <= capacity - sizes[i]) & (fill > fill[a] - sizes[i]) & (fill > 0))
            fits = fits[fits != a]
            if len(fits):
                put(i, int(fits[np.argmax(fill[fits])]))
                moved = changed = True
                break
        if moved:
            continue
        # give one or two documents for a smaller one of a bin at least as full, so that it gets as full as may be
        theirs = np.flatnonzero((fill[bins] >= fill[a]) & (fill[bins] < capacity) & (bins != a))
        if not len(theirs):
            break
        small, most = sizes[theirs], sizes[theirs] + capacity - fill[bins[theirs]]
        step = _exchange(sizes[own], small, most) or _exchange_two(sizes[own], small, most)
        if step is None:
            break
        given, j = step
        back = int(theirs[j])
        b = int(bins[back])
        for k in given:
            put(int(own[k]), b)
        put(back, a)
        changed = True
    return changed


def _exchange(own: np.ndarray, small: np.ndarray, most: np.ndarray) -> tuple[tuple[int], int] | None:
    """The document to give, and which to take back, that move most; ``own`` falls."""
    k = np.searchsorted(-own, -most)  # the largest of ours that fits in place of each of theirs
    gain = np.where(k < len(own), own[np.minimum(k, len(own) - 1)] - small, 0)
    j = int(np.argmax(gain))
    return ((int(k[j]),), j) if gain[j] > 0 else None


def _exchange_two(own: np.ndarray, small: np.ndarray, most: np.ndarray) -> tuple[tuple[int, int], int] | None:
    """As ``_exchange`` over all pairs; documents of one size are as good as each other, so two of each size do."""
    kept = np.flatnonzero(np.concatenate([np.ones(min(2, len(own)), bool), own[2:] != own[:-2]])) if len(own) else own
    x, y = np.triu_indices(len(kept), 1)
    if not len(x):
        return None
    sums = own[kept[x]] + own[kept[y]]
    order = np.argsort(-sums, kind="stable")
    found = _exchange(sums[order], small, most)
    if found is None:
        return None
    (k,), j = found
    return (int(kept[x[order[k]]]), int(kept[y[order[k]]])), j


def pack_items(sizes: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins before and after the search, the latter numbered from 0 without gaps, of items in falling order of size."""
    start = np.array(best_fit(sizes, capacity), np.int64)
    return start, np.unique(improve(np.array(sizes, np.int64), start, capacity), return_inverse=True)[1]


def _pack_block(block: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values(["n_tokens", "doc_id", "piece_no"], ascending=[False, True, True]).reset_index(drop=True)
    start, bins = pack_items(block["n_tokens"].tolist(), int(block["capacity"].iloc[0]))
    fills = np.bincount(bins, weights=block["n_tokens"])
    return block.assign(start_bin=start, bin=bins, bin_tokens=fills[bins].astype(np.int64))


def packed(sizes: DataFrame, packs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(pack_name, capacity, bin_id, start_bin, doc_id, piece_no, n_tokens, bin_tokens) for ``sizes`` with doc_id and n_tokens.

    ``start_bin`` is the container before the search.
    """
    sizes = stored(sizes.where("n_tokens > 0").select("doc_id", "n_tokens"))
    kinds = packs.where("capacity_tokens > 0").select("pack_name", "capacity_tokens").distinct().collect()  # a table of fixed size
    each = F.array(*[F.struct(F.lit(k[0]).alias("pack_name"), F.lit(k[1]).cast("bigint").alias("capacity")) for k in sorted(kinds, key=str)])
    kind = "array<struct<pack_name: string, capacity: bigint>>"
    items = sizes.select("*", F.explode(each.cast(kind)).alias("_k")).select("doc_id", "n_tokens", "_k.pack_name", "_k.capacity")
    items = items.withColumn("whole", F.floor(F.col("n_tokens") / F.col("capacity")))
    pieces = items.where("whole > 0").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1)).alias("piece_no"))
    full = pieces.select(
        "pack_name", "capacity", F.concat_ws("-", F.lit("w"), "doc_id", "piece_no").alias("bin_id"),
        F.concat_ws("-", F.lit("w"), "doc_id", "piece_no").alias("start_bin"), "doc_id", "piece_no",
        F.col("capacity").alias("n_tokens"), F.col("capacity").alias("bin_tokens"),
    )
    rests = items.withColumn("rest", F.col("n_tokens") % F.col("capacity")).where("rest > 0").select("pack_name", "capacity", "doc_id", F.col("whole").alias("piece_no"), F.col("rest").alias("n_tokens"))
    blocks = max(1, math.ceil(sizes.count() / block))

    def fill(rows: DataFrame, n: int, seed: int) -> DataFrame:
        part = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(n)).alias("block")
        return rows.select("pack_name", "capacity", "doc_id", "piece_no", "n_tokens", part).groupBy("pack_name", "block").applyInPandas(_pack_block, _OUT)

    first = stored(fill(rests, blocks, 1))
    poor = F.col("bin_tokens") < POOR * F.col("capacity")
    again = first.where(poor)
    most = again.groupBy("pack_name").count().agg(F.max("count")).first()[0] or 0
    second = fill(again, max(1, math.ceil(most / block)), 2)
    columns = ["pack_name", "capacity", "bin_id", "start_bin", "doc_id", "piece_no", "n_tokens", "bin_tokens"]

    def named(rows: DataFrame, letter: str) -> DataFrame:
        name = lambda c: F.concat_ws("-", F.lit(letter), "block", c)
        return rows.withColumn("bin_id", name("bin")).withColumn("start_bin", name("start_bin")).select(*columns)

    return full.select(*columns).unionByName(named(first.where(~poor), "a")).unionByName(named(second, "b"))


def packing_report(bins: DataFrame) -> DataFrame:
    """Per capacity: containers before and after the search, the least number of containers, the share of space used."""
    kind = ["pack_name", "capacity"]
    now = bins.groupBy(*kind, "bin_id").agg(F.sum("n_tokens").alias("n"))
    before = bins.groupBy(*kind, "start_bin").agg(F.sum("n_tokens").alias("n")).groupBy(*kind).agg(F.count("*").alias("start_bins"))
    per = now.groupBy(*kind).agg(F.count("*").alias("n_bins"), F.sum("n").alias("tokens"), F.sum(F.col("n") * F.col("n")).alias("squared_fill"))
    docs = bins.groupBy(*kind).agg(F.countDistinct("doc_id").alias("n_docs"))
    least = F.ceil(F.col("tokens") / F.col("capacity")).alias("least_bins")
    return per.join(before, kind).join(docs, kind).select(*kind, "n_docs", "tokens", "start_bins", "n_bins", least, "squared_fill", F.round(F.col("tokens") / (F.col("n_bins") * F.col("capacity")), 6).alias("used"))
