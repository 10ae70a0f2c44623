"""Column helpers for the exact value semantics that the platform's numbers rely on.

All are Column -> Column and stay inside Spark's code generation.
"""

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """Half toward plus infinity, as floor(x * 10^d + 0.5) / 10^d; -2.5 gives -2."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def or_else(x: Column, *others: Column) -> Column:
    """The first that is neither null, zero nor empty, else the last."""
    tried = [F.when((c.cast("string") != "0") & (c.cast("string") != "0.0") & (c.cast("string") != ""), c) for c in (x, *others[:-1])]
    return F.coalesce(*tried, others[-1])


def ascending(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).asc_nulls_last()


def descending(c: Column | str, nulls_last: bool = False) -> Column:
    """Nulls first, unless the query says otherwise."""
    c = F.col(c) if isinstance(c, str) else c
    return c.desc_nulls_last() if nulls_last else c.desc_nulls_first()


def upper_median(x: Column) -> Column:
    """The element at floor(n / 2) of the sorted values: 3 for 1..4. An aggregate."""
    values = F.sort_array(F.collect_list(x))
    return F.get(values, F.floor(F.size(values) / 2).cast("int"))


def mid_rank(x: str, over: list[str] | None = None) -> Column:
    """(below + equal / 2) / n within the partition ``over``; over non-null values. Null where the value is."""
    everything = Window.partitionBy(*(over or [])) if over else Window.partitionBy()
    n = F.count(x).over(everything)
    equal = F.count(x).over(Window.partitionBy(*(over or []), x))
    below = F.sum(F.lit(1)).over(everything.orderBy(F.col(x).asc_nulls_last()).rangeBetween(Window.unboundedPreceding, 0)) - equal
    return F.when(F.col(x).isNotNull(), (below + equal / 2) / n)


def share_of_total(x: Column, spec: WindowSpec) -> Column:
    """Percent of the window's total, one decimal; 0 where the total is 0."""
    total = F.sum(x).over(spec)
    return F.when(total != 0, half_up(x * 100 / total, 1)).otherwise(F.lit(0.0))


def gini(ranked: str = "rank", value: str = "value") -> Column:
    """Aggregate over rows with ``value`` and its rank 1..n in ascending order; 0 for a single value or no sum.

    Equals the mean absolute difference of all pairs over twice the mean, without the pairs.
    """
    n, total = F.count("*"), F.sum(value)
    weighted = F.sum(F.col(ranked) * F.col(value))
    return F.when((n <= 1) | (total == 0), F.lit(0.0)).otherwise(half_up((2 * weighted - (n + 1) * total) / (n * total), 2))


def ascii_word(pattern: str) -> str:
    """``pattern`` between ASCII word boundaries, where non-ASCII letters are no word characters."""
    return f"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def page_limit(raw: str | None, most: int, default: int = 50) -> int:
    """A request's limit: leading digits (with sign) count, nothing or zero is the default, clamped to 1..most."""
    import re

    m = re.match(r"\s*[+-]?\d+", raw or "")
    return min(max(int(m[0]) if m and int(m[0]) else default, 1), most)


def contains_ci(column: Column, term: str, escape: bool = False) -> Column:
    """Case-insensitive substring; unless escaped, % and _ in the term are wildcards."""
    if escape:
        term = term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return column.ilike(f"%{term}%")
