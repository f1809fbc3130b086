"""Small dense matrices as arrays of rows, worked on inside the engine: one matrix in a row, as many rows as there are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def identity(p: int) -> Column:
    return F.array(*(F.array(*(F.lit(float(i == j)) for j in range(p))) for i in range(p)))


def solved(matrix: Column, right: Column, p: int) -> Column:
    """matrix⁻¹ right, both arrays of rows (right with any number of columns), by elimination with row exchanges; null if singular.

    A pivot counts as zero below 1e-300; whether a result is sound where the matrix is nearly singular is for the caller to say.
    """

    def step(m: Column, k: Column) -> Column:
        # The row with the largest entry of column k among those not used yet.
        size = F.transform(m, lambda r, i: F.when(i >= k, F.abs(F.get(r, k))).otherwise(-1.0))
        at = let(size, lambda s: (F.array_position(s, F.array_max(s)) - 1).cast("int"))

        def eliminate(best: Column) -> Column:
            pivot = F.get(best, k)
            lead = F.transform(best, lambda v: v / pivot)

            def with_lead(line: Column, at_: Column) -> Column:
                def row(r: Column, i: Column) -> Column:
                    # The row that makes place for the pivot's goes where that was.
                    old = F.when(i == at_, F.get(m, k)).otherwise(r)
                    return F.when(i == k, line).otherwise(let(old, lambda o: F.zip_with(o, line, lambda a, b: a - F.get(o, k) * b)))

                return F.transform(m, row)

            return F.when(F.abs(pivot) > 1e-300, let(lead, lambda line: let(at, lambda a: with_lead(line, a))))

        return F.when(m.isNotNull(), let(at, lambda a: eliminate(F.get(m, a))))

    both = F.zip_with(matrix, right, lambda a, b: F.concat(a, b))
    done = F.aggregate(F.sequence(F.lit(0), F.lit(p - 1)), both, step)
    return F.transform(done, lambda r: F.slice(r, p + 1, F.greatest(F.size(r) - p, F.lit(0))))
