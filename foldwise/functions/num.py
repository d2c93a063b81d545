"""Column helpers with the missing-value and rounding rules every operator shares.

Missing is always NULL. A comparison with a missing value is false, a clipped
missing value stays missing, and a division by zero is missing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 6


def r6(c: Column, digits: int = DIGITS) -> Column:
    """Round to the report precision, with -0.0 folded into 0.0."""
    return F.round(c, digits) + F.lit(0.0)


def flag(cond: Column) -> Column:
    """1 when the condition holds, 0 when it fails or is unknown."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def clip_low(c: Column, low) -> Column:
    return F.when(c.isNotNull(), F.greatest(c, F.lit(low)))


def clip_high(c: Column, high) -> Column:
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(c.isNotNull(), F.least(c, high))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def missing(c: Column, dtype: str) -> Column:
    """True for NULL, and for NaN in floating point columns."""
    if dtype in ("double", "float"):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def nln(c: Column) -> Column:
    """n * ln(n) with 0 * ln(0) = 0; the building block of plug-in entropies."""
    x = c.cast("double")
    return F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0))


def total(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def argmax_array(p: Column) -> Column:
    """Index of the first maximum of an array, zero-based."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def argmax_columns(cols: Sequence[Column]) -> Column:
    """Index of the first maximum among columns, zero-based.

    Each column is named only twice, so the expression stays small when it is
    inlined into filters.
    """
    return argmax_array(F.array(*cols))


def present(v: Column) -> Column:
    """The value as a double; NaN counts as missing."""
    d = v.cast("double")
    return F.when(~F.isnan(d), d)


def skew_corrected(g1: Column, n: Column) -> Column:
    """Sample-corrected skewness from the population one; missing below three values."""
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def kurt_corrected(g2: Column, n: Column) -> Column:
    """Sample-corrected excess kurtosis from the population one; missing below four values."""
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def order_key(cols: Sequence[str | Column], seed: int | str = 42) -> Column:
    """Pseudo-random but reproducible ordering key: md5 of the key columns and a seed."""
    return F.md5(F.concat_ws("|", *[c if isinstance(c, Column) else F.col(c) for c in cols], F.lit(str(seed))))


# Unicode white space, the separators and the control characters Python splits on.
SPACE = r"[\p{Z}\s\x0b\x1c-\x1f\x{85}]+"


def words(text: Column) -> Column:
    """Whitespace tokens; a missing or blank text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def let(value: Column, body) -> Column:
    """Bind a value once and use it many times in `body`, so that the expression tree stays small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def exact_scaled(x: Column, digits: int | Column) -> Column:
    """x * 10^digits rounded half-even on the exact binary value, as a long.

    Splitting x in two halves makes both products exact, so the side of a tie is
    decided without error. Valid while |x| * 10^digits stays below 2^52.
    """
    p = F.pow(F.lit(10.0), digits) if isinstance(digits, Column) else F.lit(float(10 ** digits))

    def halves(v):
        c = v * F.lit(134217729.0)
        hi = c - (c - v)
        return F.struct(hi.alias("hi"), (v - hi).alias("lo"), F.rint(v * p).alias("q"))

    def settle(s):
        over = (s["hi"] * p - s["q"] - 0.5) + s["lo"] * p
        under = (s["hi"] * p - s["q"] + 0.5) + s["lo"] * p
        odd = F.pmod(s["q"], F.lit(2.0)) == 1.0
        step = (F.when((over > 0) | ((over == 0) & odd), F.lit(1.0))
                .when((under < 0) | ((under == 0) & odd), F.lit(-1.0)).otherwise(F.lit(0.0)))
        return (s["q"] + step).try_cast("bigint")

    return let(x, lambda v: let(halves(v), settle))


def fixed_text(x: Column, digits: int) -> Column:
    """Fixed-decimal text of the exact binary value."""
    p = 10 ** digits

    def text(q):
        a = F.abs(q)
        return F.concat(F.when(q < 0, F.lit("-")).otherwise(F.lit("")), F.floor((a - a % p) / F.lit(p)).cast("string"), F.lit("."),
                        F.lpad((a % p).cast("string"), digits, "0"))

    return let(exact_scaled(x, digits), text)


def half_up_text(x: Column, digits: int = 2) -> Column:
    """Round the shortest decimal form half-up and keep trailing zeros."""
    return F.round(x.cast("string").try_cast("decimal(38,18)"), digits).try_cast(f"decimal(38,{digits})").cast("string")


def short_text(x: Column) -> Column:
    """Six significant digits with trailing zeros dropped, scientific outside 1e-4 to 1e6."""
    def text(v):
        mant = F.regexp_replace(F.format_string("%.5e", v), r"\.?0+e", "e")
        plain = let(F.floor(F.log10(F.abs(v))).cast("int"), lambda e: F.when((e >= -4) & (e < 6), let(exact_scaled(v, 5 - e), lambda q: render(v, q, 5 - e))))
        return F.when(v == 0, "0").otherwise(F.coalesce(plain, mant))

    def render(v, q, d):
        p = F.pow(F.lit(10.0), d).cast("bigint")
        a = F.abs(q)
        part = F.when(d > 0, F.rtrim(F.lpad((a % p).cast("string"), d, F.lit("0")), F.lit("0"))).otherwise("")
        whole = F.floor((a - a % p) / p).cast("string")
        # A carry to seven digits leaves the plain range.
        return F.when((d > 0) | (a < 1000000), F.concat(F.when(v < 0, "-").otherwise(""), whole, F.when(part != "", F.concat(F.lit("."), part)).otherwise("")))

    return let(x, text)
