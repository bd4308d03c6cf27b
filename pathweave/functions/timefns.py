"""Time arithmetic, rounding and clipping as Spark expressions."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def minutes_between(start, end) -> Column:
    """(end - start) in minutes, keeping microseconds.

    Computed as micros / 1e6 / 60 so the double equals the one obtained from
    a seconds count divided by 60 (the usual pandas route).
    """
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end)) / F.lit(1e6) / F.lit(60.0)


def round2(x) -> Column:
    """Round to 2 decimals the way numpy does: rint(x * 100) / 100 (half-even on the scaled double)."""
    return F.rint(_c(x) * F.lit(100.0)) / F.lit(100.0)


def clip_lower(x, lo: float = 0.0) -> Column:
    """Null-safe lower clip (``greatest`` would turn a null into ``lo``)."""
    c = _c(x)
    return F.when(c < F.lit(lo), F.lit(lo)).otherwise(c)


def clip_upper(x, hi) -> Column:
    """Null-safe upper clip; ``hi`` may be a literal or a column."""
    c = _c(x)
    h = hi if isinstance(hi, Column) else F.lit(hi)
    return F.when(c > h, h).otherwise(c)


def parse_ts_lenient(x, ntz: bool = False) -> Column:
    """Text -> timestamp; unparseable text becomes NULL (works with ANSI on)."""
    return _c(x).try_cast("timestamp_ntz" if ntz else "timestamp")


def parse_ts_strict(x, ntz: bool = False, what: str = "timestamp") -> Column:
    """Text -> timestamp; unparseable, non-null text raises, whatever the ANSI setting."""
    c = _c(x)
    t = "timestamp_ntz" if ntz else "timestamp"
    parsed = c.try_cast(t)
    return F.when(c.isNotNull() & parsed.isNull(),
                  F.raise_error(F.concat(F.lit(f"unparseable {what}: "), c.cast("string")))
                  ).otherwise(parsed).cast(t)


_SPLIT = 134217729.0  # 2**27 + 1, Veltkamp splitting constant


def _two_prod(a: Column, b: float):
    """(p, e) with a * b == p + e exactly (Dekker), in plain IEEE double arithmetic."""
    bl = F.lit(float(b))
    p = a * bl
    c = F.lit(_SPLIT) * a
    ah = c - (c - a)
    al = a - ah
    cb = _SPLIT * b
    bh = cb - (cb - b)
    bo = b - bh
    e = ((ah * F.lit(bh) - p) + ah * F.lit(bo) + al * F.lit(bh)) + al * F.lit(bo)
    return p, e


def let(x: Column, body) -> Column:
    """Evaluate ``x`` once and pass it to ``body`` (a lambda variable), so an
    expensive input used many times in ``body`` is not recomputed per use."""
    return F.element_at(F.transform(F.array(x), body), 1)


def round_exact(x, digits: int = 2) -> Column:
    """Round like Python's built-in ``round(x, digits)``: half-even on the exact binary value.

    ``x * 10**digits`` is split into a double and its exact error; only a
    scaled value sitting on .5 needs the error's sign to decide the side.
    """
    return let(_c(x).cast("double"), lambda c: _round_exact_body(c, digits))


def round_exact_array(name: str, digits: int = 2) -> Column:
    """``round_exact`` applied to every element of the array column ``name`` (built once per name)."""
    return _round_exact_array_named(name, digits)


@lru_cache(maxsize=32)
def _round_exact_array_named(name: str, digits: int) -> Column:
    return F.transform(F.col(name), lambda c: _round_exact_body(c.cast("double"), digits))


def _round_exact_body(c: Column, digits: int) -> Column:
    scale = float(10 ** digits)
    p, e = _two_prod(c, scale)
    fl = F.floor(p).cast("double")
    tie = (p - fl) == F.lit(0.5)
    k = (F.when(tie & (e > 0), fl + F.lit(1.0))
         .when(tie & (e < 0), fl)
         .otherwise(F.rint(p)))
    return F.when(c.isNull() | F.isnan(c), c).otherwise(k / F.lit(scale))
