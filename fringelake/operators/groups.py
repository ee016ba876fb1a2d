"""Groups of positions, versioned, and their order from iteration to iteration.

Orders and members come from a keyed bijection of whole numbers (a Feistel network
over the bits of a rank), so that every task works its own rows out and nothing is
sorted. Members change only where re-grouping is asked for; otherwise they are those of
the last version, and only the order may change.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Rounds of the network; a factor of its round function.
ROUNDS, FACTOR = 4, 69069


def round_keys(seed: str, iteration: int) -> list[int]:
    """Keys below 2**20 of each round, from the digest of seed and iteration."""
    raw = hashlib.sha256(f"{seed}:{iteration}".encode()).digest()
    return [int.from_bytes(raw[4 * k : 4 * k + 4], "little") % (1 << 20) for k in range(ROUNDS)]


def half_bits(n: int) -> int:
    """Bits of half a number, so that both halves hold 0 .. n - 1."""
    if n > 1 << 40:
        raise ValueError("2**40 numbers at most")
    return max(1, -(-max(1, (n - 1).bit_length()) // 2))


def bijection(i: Column, n: int, keys: list[int]) -> Column:
    """`i` of 0 .. n - 1 mapped to another, one to one.

    The network permutes 4**half_bits(n) numbers, fewer than 4 n + 4; one that falls beyond n goes through
    it again until it doesn't, which it must, as its own circle leads back to where it began.
    """
    bits = half_bits(n)
    mask = (1 << bits) - 1

    def once(x: Column) -> Column:
        left, right = F.shiftright(x, bits), x.bitwiseAND(F.lit(mask))
        for k in keys:
            mixed = (right * FACTOR + k) * FACTOR % (1 << 40)
            left, right = right, left.bitwiseXOR(F.shiftright(mixed, 13).bitwiseAND(F.lit(mask)))
        return F.shiftleft(left, bits).bitwiseOR(right)

    again = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), once(i.cast("long")), lambda at, _: F.when(at >= n, once(at)).otherwise(at))
    return F.when(again < n, again).otherwise(F.raise_error(F.lit("a number did not come back")).cast("long"))


#: Times that a number is sent through again at most; one needs more with a chance of 0.75**256.
WALKS = 256


def bijection_sql(n: int, keys: list[int]) -> str:
    """SQL of recursive tables, the last of them image (i, x), of a table ids (i)."""
    bits = half_bits(n)
    mask = (1 << bits) - 1
    left, right = f"(x >> {bits})", f"(x & {mask})"
    step = f"SELECT i, {left} AS l, {right} AS r FROM ({{source}})"
    for k in keys:
        step = f"SELECT i, r AS l, xor(l, ((((r * {FACTOR} + {k}) * {FACTOR}) % {1 << 40}) >> 13) & {mask}) AS r FROM ({step})"
    once = f"SELECT i, (l << {bits}) | r AS x FROM ({step})"
    first, more = once.format(source="SELECT i, i AS x FROM ids"), once.format(source=f"SELECT i, x FROM walk WHERE x >= {n}")
    return f"walk(i, x) AS ({first} UNION ALL {more}), image AS (SELECT i, x FROM walk WHERE x < {n})"


@dataclass(frozen=True)
class Groups:
    """count: groups; seed: of both members and order; regroup: iterations at which members change; shuffle: whether the order does."""

    count: int
    seed: str = "seed"
    regroup: tuple[int, ...] = ()
    shuffle: bool = True

    def version(self, iteration: int) -> int:
        """The iteration at which the members of `iteration` were drawn."""
        return max([0, *(k for k in self.regroup if k <= iteration)])

    def members(self, ranked: DataFrame, n: int, iteration: int) -> DataFrame:
        """(pos_id, grp, version) of `ranked` (pos_id, rank of 0 .. n - 1); sizes differ by one at most."""
        version = self.version(iteration)
        at = bijection(F.col("rank"), n, round_keys(f"{self.seed}/members", version))
        return ranked.select("pos_id", F.floor(at * self.count / n).cast("long").alias("grp"), F.lit(version).alias("version"))

    def order(self, groups: DataFrame, iteration: int) -> DataFrame:
        """`groups` (grp, ...) with `place`, that of each group in the iteration."""
        at = bijection(F.col("grp"), self.count, round_keys(f"{self.seed}/order", iteration)) if self.shuffle else F.col("grp")
        return groups.withColumn("place", at)
