"""Filling containers of a fixed capacity with items of varying length.

*Exact-complement hashing*: items are counted by length, and single, pair and
triple sums of the available lengths are indexed. From the longest length down,
combinations that fill a container's gap exactly are used up under the
availability counts; what is left is placed best-fit.

Planning works on the counts by length, of which there are at most as many as
the capacity, never on items; a step uses up at least one length, so the plan
is as short. Items then find their container by their rank among the items of
their length, which comes from range-partitioned sorting with offsets, so a
length that a third of all items share stays distributed.

Only an item longer than the capacity is cut: into full containers and a rest
that is placed like any other item. Defined results: an item without length
takes no space and goes to container 0; a NULL id is -1; repeated rows are items of their own;
an empty table gives no container.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.runtime import running_total, stage

#: Most (length, interval) pairs of a plan that are sent to the workers, some 500 MB. A plan has at most four
#: entries per distinct length and exact combination, so this admits capacities in the millions.
MAX_PLAN = 20_000_000


class Pattern(NamedTuple):
    lengths: tuple[int, ...]  # longest first
    times: int
    exact: bool


class _Stock:
    """Availability counts by length, and as bit sets: which lengths from 1 to ``top`` are there, forwards and backwards."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for x, n in counts.items():
            if not 0 < x <= capacity:
                raise ValueError(f"length {x} does not fit {capacity}")
            self.left[x] += n
        self.there = self._bits(self.left > 0)
        self.back = self._bits(self.left[::-1] > 0)
        self.sums, self.sums_back, self.old = 0, 0, True

    @staticmethod
    def _bits(flags: np.ndarray) -> int:
        return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")

    def forget(self, x: int) -> None:
        """Takes a length out of the index, as it is used up or is left to best fit."""
        if self.there >> x & 1:
            self.there ^= 1 << x
            self.back ^= 1 << (self.capacity - x)
            self.old = True

    def use(self, lengths: tuple[int, ...]) -> int:
        """How often the combination can be taken, and takes it."""
        need: dict[int, int] = {}
        for x in lengths:
            need[x] = need.get(x, 0) + 1
        m = min(int(self.left[x]) // k for x, k in need.items())
        if m:
            for x, k in need.items():
                self.left[x] -= m * k
                if not self.left[x]:
                    self.forget(x)
        return m

    def pairs(self, gap: int) -> int:
        """The lengths whose complement to ``gap`` is there too, as a bit set."""
        both = self.there & (self.back >> (self.capacity - gap)) if gap > 1 else 0
        if gap % 2 == 0 and both >> (gap // 2) & 1 and self.left[gap // 2] < 2:
            both ^= 1 << (gap // 2)
        return both

    def pair(self, gap: int) -> tuple[int, int] | None:
        """Two lengths that are there and fill the gap, the most unequal ones first."""
        both = self.pairs(gap)
        b = both.bit_length() - 1
        return (b, gap - b) if both else None

    def index_sums(self) -> None:
        """Indexes the sums of pairs, by convolution. Lengths only get fewer, so an old index has too many sums, never too few."""
        n = 1 << (2 * self.capacity + 1).bit_length()
        has = np.unpackbits(np.frombuffer(self.there.to_bytes(self.capacity // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: self.capacity + 1]
        f = np.fft.rfft(has, n)
        sums = np.fft.irfft(f * f, n)[: self.capacity + 1] > 0.5
        self.sums_back, self.old = self._bits(sums[::-1]), False

    def firsts(self, gap: int, below: int) -> int:
        """The lengths under ``below`` that a pair may complete to ``gap``, as a bit set."""
        return self.there & (self.sums_back >> (self.capacity - gap)) & ((1 << below) - 1)

    def triple(self, a: int, gap: int, below: int) -> tuple[int, tuple[int, int, int] | None]:
        """The longest length under ``below`` that a pair completes to ``gap``, and the three; a length's own count is heeded."""
        missed = 0
        found = self.firsts(gap, min(below, gap - 1))
        while found:
            x = found.bit_length() - 1
            found ^= 1 << x
            self.left[x] -= 1
            lone = not self.left[x]
            if lone:
                self.there ^= 1 << x
                self.back ^= 1 << (self.capacity - x)
            p = self.pair(gap - x)
            self.left[x] += 1
            if lone:
                self.there ^= 1 << x
                self.back ^= 1 << (self.capacity - x)
            if p:
                return x, (x, *p)
            missed += 1
            if missed % 2048 == 0 and self.old:  # by now a new index costs no more than the misses
                self.index_sums()
                found &= self.firsts(gap, x)
        return 0, None


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns of lengths with their multiplicities; every counted item is in one.

    All pairs and triples that fill a gap are found, whatever the number of lengths: they are looked up in bit
    sets of the available lengths and of their pair sums, so a look-up costs capacity / 64 steps.
    """
    if capacity < 1:
        raise ValueError(f"capacity {capacity} is below 1")
    stock = _Stock(counts, capacity)
    left = stock.left
    out: list[Pattern] = []

    def take(lengths: tuple[int, ...], exact: bool = True) -> bool:
        m = stock.use(lengths)
        if m:
            out.append(Pattern(lengths, m, exact))
        return m > 0

    if left[capacity]:
        take((capacity,))
    stock.index_sums()
    for a in np.flatnonzero(left)[::-1]:
        a = int(a)
        gap = capacity - a
        while left[a]:
            # the item itself is one of its length; the others must be there beside it
            left[a] -= 1
            if not left[a]:
                stock.there ^= 1 << a
                stock.back ^= 1 << (capacity - a)
            rest: tuple[int, ...] | None = (gap,) if gap <= capacity and stock.there >> gap & 1 else stock.pair(gap)
            if rest is None:
                _, rest = stock.triple(a, gap, capacity + 1)
            if not left[a]:
                stock.there ^= 1 << a
                stock.back ^= 1 << (capacity - a)
            left[a] += 1
            if rest is None or not take(tuple(sorted((a, *rest), reverse=True))):
                break
        # what is longer than the next length is no part of its combinations
        stock.forget(a)
    # best fit: the longest that is left, then again and again the longest that still fits
    have = [int(x) for x in np.flatnonzero(left)]
    n = {x: int(left[x]) for x in have}
    while have:
        gap, used = capacity, {}
        hi = len(have)
        while gap > 0 and (hi := bisect.bisect_right(have, gap, 0, hi)):
            x = have[hi - 1]
            # as many as fit, but not more than there are
            used[x] = min(gap // x, n[x])
            gap -= used[x] * x
            hi -= 1
        m = min(n[x] // k for x, k in used.items())
        out.append(Pattern(tuple(x for x, k in used.items() for _ in range(k)), m, gap == 0))
        for x, k in used.items():
            n[x] -= m * k
            if not n[x]:
                del have[bisect.bisect_left(have, x)]
    return out


def pieces(items: DataFrame, capacity: Column | int) -> DataFrame:
    """Items as pieces that fit: doc_id, piece_no, n_pieces, length. Whole items have one piece. Columns of ``capacity`` stay."""
    cap = F.lit(capacity) if isinstance(capacity, int) else capacity
    keep = [c for c in items.columns if c not in ("doc_id", "n_tokens")]
    n = F.when(F.col("n_tokens") > cap, F.ceil(F.col("n_tokens") / cap)).otherwise(1)
    items = items.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), *keep)
    return (
        items.select("doc_id", "n_tokens", n.cast("int").alias("n_pieces"), *keep)
        .withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
        .select(
            *keep,
            "doc_id",
            "piece_no",
            "n_pieces",
            F.when(F.col("n_pieces") == 1, F.col("n_tokens"))
            .when(F.col("piece_no") < F.col("n_pieces") - 1, cap)
            .otherwise(F.col("n_tokens") - cap * (F.col("n_pieces") - 1))
            .cast("bigint")
            .alias("length"),
        )
    )


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """doc_id, piece_no, n_pieces, length, bin_id, exact (its container has no space left).

    ``items``: doc_id, n_tokens.
    """
    return pack_all(items, [("", capacity)]).drop("budget_name")


def pack_all(items: DataFrame, budgets: list[tuple[str, int]]) -> DataFrame:
    """The same for several (name, capacity) at once, with budget_name: one pass over the items and one ranking."""
    spark = items.sparkSession
    if any(c < 1 for _, c in budgets):
        raise ValueError("a capacity below 1")
    every = F.array(*[F.struct(F.lit(b).alias("budget_name"), F.lit(c).cast("bigint").alias("capacity")) for b, c in budgets])
    cut = stage(pieces(items.select("doc_id", "n_tokens", F.explode(every).alias("b")).select("doc_id", "n_tokens", "b.*"), F.col("capacity")).drop("capacity"))
    counts: dict[str, dict[int, int]] = {b: {} for b, _ in budgets}
    for r in cut.where("length > 0").groupBy("budget_name", "length").agg(F.count(F.lit(1)).alias("n")).collect():  # as many as the capacities, at most
        counts[r["budget_name"]][r["length"]] = r["n"]
    table: dict[tuple[str, int], tuple] = {}
    entries = 0
    for name, capacity in budgets:
        slots: dict[int, list[tuple[int, int, bool]]] = {}  # length -> (first rank, its container, exact)
        seen: dict[int, int] = {}
        base = 0
        for p in plan(counts[name], capacity):
            for x in p.lengths:
                slots.setdefault(x, []).append((seen.get(x, 0), base, p.exact))
                seen[x] = seen.get(x, 0) + p.times
                entries += 1
            base += p.times
        if entries > MAX_PLAN:
            raise ValueError(f"a plan of {entries} entries")
        table |= {(name, x): tuple(np.array(c) for c in zip(*v)) for x, v in slots.items()}
    shared = spark.sparkContext.broadcast(table)
    ranked = running_total(
        cut.withColumn("one", F.lit(1).cast("bigint")), ["budget_name", "length"], ["doc_id", "piece_no"], "one", "rank"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bins, exact = np.zeros(len(b), dtype=np.int64), np.zeros(len(b), dtype=bool)
            for key, rows in b.groupby(["budget_name", "length"], sort=False).indices.items():
                if key[1] > 0:
                    first, at, full = shared.value[key]
                    r = b["rank"].to_numpy()[rows]
                    k = np.searchsorted(first, r, side="right") - 1
                    bins[rows], exact[rows] = at[k] + r - first[k], full[k]
            yield b[["budget_name", "doc_id", "piece_no", "n_pieces", "length"]].assign(bin_id=bins, exact=exact)

    return ranked.select("budget_name", "doc_id", "piece_no", "n_pieces", "length", "rank").mapInPandas(
        run, "budget_name string, doc_id bigint, piece_no int, n_pieces int, length bigint, bin_id bigint, exact boolean"
    )
