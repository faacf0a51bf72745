"""Counter-based random numbers: a draw depends on seed, stream and row alone.

So results do not depend on partitioning, retries cannot change them, and DuckDB computes the same
numbers. ``stream`` names purpose and column, so that no two draws share a counter. A published
seed makes noise removable: releases need a secret one, and no claim is made about floating-point
attacks on the Laplace mechanism.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _digest(seed: object, stream: str, *row: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(stream), *[r.cast("string") for r in row]))


def uniform(seed: object, stream: str, *row: Column) -> Column:
    """A double strictly between 0 and 1."""
    return (F.conv(F.substring(_digest(seed, stream, *row), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def uniform_sql(seed: object, stream: str, *row: str) -> str:
    """The same number in DuckDB."""
    text = ", ".join([f"'{seed}'", f"'{stream}'", *row])
    return f"((cast('0x' || substr(md5(concat_ws(':', {text})), 1, 13) as bigint) + 0.5::double) / 4503599627370496.0::double)"


#: Rounds of the keyed permutation, and steps after which a number must be back below n: numbers at or above n are under
#: 64 or a share of 1 / sqrt(n), so 64 steps do for all n.
ROUNDS, STEPS = 6, 64


def _sides(n: int) -> tuple[int, int]:
    """Two sides, about equal, whose product is n or little more."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def shuffled(row: Column, n: int, seed: object, stream: str) -> Column:
    """The place of a row number below n in a permutation of 0 to n - 1 that the seed picks.

    A Feistel network over two digits: each round adds a hash of one digit to the other, which can be
    undone, so no two numbers meet. Its range may be a little larger than n; what falls outside goes
    through again until it is inside, which keeps it a permutation. No row needs another, at any n.
    """
    a, b = _sides(n)

    def hashed(x: Column, k: Column) -> Column:
        return F.conv(F.substring(_digest(seed, stream, k, x), 1, 8), 16, 10).cast("bigint")

    def turn(x: Column, k: Column) -> Column:
        left = F.struct(((x["l"] + hashed(x["r"], k)) % a).alias("l"), x["r"].alias("r"))
        right = F.struct(x["l"].alias("l"), ((x["r"] + hashed(x["l"], k)) % b).alias("r"))
        return F.when(k % 2 == 1, left).otherwise(right)

    def through(x: Column) -> Column:
        start = F.struct((x % a).cast("bigint").alias("l"), F.floor(x / a).cast("bigint").alias("r"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda x: x["r"] * a + x["l"])

    out = through(row)
    if a * b > n:
        out = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), out, lambda x, _: F.when(x < n, x).otherwise(through(x)))
    return F.when(out < n, out).otherwise(F.raise_error(F.lit("a number did not come back below n")).cast("bigint"))


def shuffled_sql(row: str, n: int | str, rows: str, seed: object, stream: str) -> str:
    """A query for (id, place) of the same permutation in DuckDB; ``row`` is a column of ``rows``, n a number or a query."""

    def through(inner: str) -> str:
        """(id, l, r) after all rounds, from (id, x)."""
        sql = f"SELECT id, x % a AS l, x // a AS r FROM ({inner}), n"
        for k in range(1, ROUNDS + 1):
            text = lambda x: f"cast('0x' || substr(md5(concat_ws(':', '{seed}', '{stream}', {k}, {x})), 1, 8) AS BIGINT)"  # noqa: B023, E731
            sql = f"SELECT id, (l + {text('r')}) % a AS l, r FROM ({sql}), n" if k % 2 else f"SELECT id, l, (r + {text('l')}) % b AS r FROM ({sql}), n"
        return f"SELECT id, r * a + l AS x FROM ({sql}), n"

    sides = "(SELECT n, a, greatest(1, (n + a - 1) // a) AS b FROM (SELECT n, greatest(1, ceil(sqrt(n::DOUBLE))::BIGINT) AS a FROM (SELECT ({n})::BIGINT AS n)))".format(n=n)
    return f"""WITH RECURSIVE n AS MATERIALIZED {sides}, walk AS ({through(f"SELECT {row} AS id, {row} AS x FROM {rows}")} UNION ALL {through("SELECT walk.id, walk.x FROM walk, n WHERE walk.x >= n.n")})
SELECT id, x AS place FROM walk, n WHERE x < n.n"""


def laplace(u: Column, scale: Column | float) -> Column:
    """Laplace noise by the inverse distribution function."""
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    return -scale * F.signum(u - 0.5) * F.ln(1 - 2 * F.abs(u - 0.5))


def laplace_sql(u: str, scale: str | float) -> str:
    return f"(-({scale})::double * sign({u} - 0.5::double) * ln(1 - 2 * abs({u} - 0.5::double)))"


def letters(seed: object, stream: str, row: Column, length: Column) -> Column:
    """A lower-case string of the given length; empty for 0."""

    def letter(i: Column) -> Column:
        number = F.conv(F.substring(_digest(seed, stream, row, i), 1, 8), 16, 10).cast("long")
        return F.substring(F.lit(LETTERS), (number % 26 + 1).cast("int"), F.lit(1))

    return F.when(length >= 1, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(length, F.lit(1)).cast("int")), letter), "")).when(length <= 0, "")


def letters_sql(seed: object, stream: str, row: str, length: str) -> str:
    digest = f"md5(concat_ws(':', '{seed}', '{stream}', {row}, i))"
    return f"array_to_string(list_transform(range(1, ({length})::bigint + 1), lambda i: substr('{LETTERS}', (cast('0x' || substr({digest}, 1, 8) as bigint) % 26 + 1)::int, 1)), '')"


def uniform_here(seed: object, stream: str, *row: object) -> float:
    """The same number on the driver, for the few draws that are made there."""
    import hashlib

    text = ":".join(map(str, (seed, stream, *row)))
    return (int(hashlib.md5(text.encode()).hexdigest()[:13], 16) + 0.5) / 2**52
