"""Array helpers made of built-in functions, linear in the array."""

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = chr(1)


def bind(value, body):
    """Evaluate ``value`` once and hand it to ``body`` as a variable.

    An expression used inside a lambda is otherwise evaluated again for every
    element of the array the lambda runs over.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def indexes(size: Column) -> Column:
    """``[0 .. size-1]``, empty for 0 (a bare ``sequence(0, -1)`` counts down)."""
    return F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(
        F.array().cast("array<int>")
    )


def run_starts(ordered: Column, key=lambda x: x) -> Column:
    """Positions of a sorted array at which a new key begins."""
    return F.filter(
        indexes(F.size(ordered)),
        lambda i: (i == 0) | (key(F.get(ordered, i)) != key(F.get(ordered, i - 1))),
    )


def by_run(ordered: Column, emit, key=lambda x: x) -> Column:
    """``emit(element, number in its run)`` for each element of a sorted array."""

    def one_run(starts):
        def elements(start, k):
            end = F.coalesce(F.get(starts, k + 1), F.size(ordered))
            return F.transform(
                indexes(end - start), lambda j: emit(F.get(ordered, start + j), j)
            )

        return F.flatten(F.transform(starts, elements))

    return bind(run_starts(ordered, key), one_run)


def numbered(items: Column) -> Column:
    """Turn a bag of strings into a set by adding each copy's number to it.

    Set operations on the result are bag operations on the input, so a clipped
    match count is the size of an ``array_intersect``.
    """
    return bind(
        F.sort_array(items),
        lambda s: by_run(s, lambda x, j: F.concat(x, F.lit(SEP), j.cast("string"))),
    )


def bag_overlap(a: Column, b: Column) -> Column:
    """Size of the bag intersection of two string arrays.

    Each value both sides have counts once, and the further copies are compared
    in the same way; those are few, so only they are numbered.
    """

    def further(ordered):
        return F.filter(ordered, lambda x, i: F.get(ordered, i - 1) == x)

    def rest(x, y):
        return F.when(
            (F.size(x) > 0) & (F.size(y) > 0),
            F.size(F.array_intersect(numbered(x), numbered(y))),
        ).otherwise(0)

    def both(x, y):
        return F.size(F.array_intersect(x, y)) + bind(
            further(x), lambda u: bind(further(y), lambda v: rest(u, v))
        )

    return bind(F.sort_array(a), lambda x: bind(F.sort_array(b), lambda y: both(x, y)))


def find_slice(items: Column, pattern: Column, start=0) -> Column:
    """0-based place of the first ``pattern`` in ``items`` at or after ``start``,
    NULL when there is none or either is empty."""
    start = F.lit(start) if isinstance(start, int) else start
    n = F.size(pattern)
    last = F.size(items) - n
    # The first element rules out most places before a slice is made.
    hits = F.filter(
        F.sequence(start, last),
        lambda i: (F.get(items, i) == F.get(pattern, F.lit(0)))
        & (F.slice(items, i + 1, n) == pattern),
    )
    fits = (n > 0) & (F.size(items) > 0) & (last >= start)
    return F.when(fits, F.get(hits, F.lit(0))).cast("int")
