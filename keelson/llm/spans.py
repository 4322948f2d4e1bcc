"""Places of regular-expression matches in a text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keelson.llm.common import let

BLOCK = 256


def before(values: Column, start, join) -> Column:
    """For each element the fold of those before it, in blocks, since a plain fold would copy its array at each step."""
    fold = lambda a: F.aggregate(a, F.lit(start).cast("long"), join)
    block = lambda i: F.floor(i / BLOCK).cast("int")

    def places(v: Column) -> Column:
        folded = F.transform(F.sequence(F.lit(0), block(F.size(v) - 1)), lambda b: fold(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))
        before = let(folded, lambda f: F.transform(f, lambda _, b: fold(F.slice(f, F.lit(1), b))))
        return let(before, lambda f: F.transform(v, lambda _, i: join(fold(F.slice(v, block(i) * BLOCK + 1, i % BLOCK)), F.get(f, block(i)))))

    return let(values, places)


def placed_matches(v: Column, between: Column, make) -> Column:
    """make(match, start) for each of v, a pattern's matches in a text, one at least; ``between`` is what the pattern
    splits the text into: the lengths of both give the places."""
    lengths = F.zip_with(v, F.slice(between, F.lit(1), F.size(v)), lambda x, y: (F.length(x) + F.length(y)).cast("long"))
    return let(before(lengths, 0, lambda a, b: a + b), lambda done: F.transform(v, lambda x, i: make(x, F.get(done, i) + F.length(F.get(between, i)))))
