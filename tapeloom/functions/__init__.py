"""Column helpers: guarded arithmetic, rolling windows with null guards, correlation."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def series(key: str | list[str] = "ticker", time: str | list[str] = "date") -> WindowSpec:
    """Rows of a key in time order."""
    keys = [key] if isinstance(key, str) else key
    times = [time] if isinstance(time, str) else time
    return Window.partitionBy(*keys).orderBy(*times)


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(1 - n, 0)


def rolling(f, x: Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    """Aggregate of the last n rows, null unless `least` (n by default) of them are not null."""
    over = last_rows(w, n)
    return F.when(F.count(x).over(over) >= (n if least is None else least), f(x).over(over))


def change(x: Column, w: WindowSpec, n: int = 1) -> Column:
    """Relative change over n rows; null where the base is null or zero."""
    return F.try_divide(x, F.lag(x, n).over(w)) - 1


def filled(x: Column, w: WindowSpec) -> Column:
    """The last value that isn't null so far."""
    return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def flag(c: Column) -> Column:
    """1 or 0; null counts as 0."""
    return F.coalesce(c, F.lit(False)).cast("int")


def moments_corr(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson correlation from sums; null for fewer than two pairs or a constant side."""
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return F.when((n > 1) & (vx > 0) & (vy > 0), F.try_divide(n * sxy - sx * sy, F.sqrt(vx) * F.sqrt(vy)))


def corr(x: Column, y: Column) -> Column:
    """Pearson correlation of pairs where both are given; null for a constant side (which `corr` refuses)."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    # a constant side is told by its range, before any division
    fine = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(fine, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def corr_over(x: Column, y: Column, w: WindowSpec, n: int) -> Column:
    """Rolling correlation of the last n rows, all of them given."""
    over = last_rows(w, n)
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    fine = (F.count(a).over(over) >= n) & (F.min(a).over(over) < F.max(a).over(over)) & (F.min(b).over(over) < F.max(b).over(over))
    return F.when(fine, F.try_divide(F.covar_pop(a, b).over(over), F.stddev_pop(a).over(over) * F.stddev_pop(b).over(over)))


def rounded(df, digits: dict[str, int] | int, columns: list[str] | None = None):
    """Round double columns for output."""
    names = columns or [f.name for f in df.schema if f.dataType.simpleString() == "double"]
    at = lambda c: digits if isinstance(digits, int) else digits.get(c, 6)
    return df.withColumns({c: F.round(c, at(c)) for c in names})
