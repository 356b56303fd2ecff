"""Scalar Column helpers shared by every operator.

All of them are built-in Catalyst expressions, so they stay inside
whole-stage codegen and never leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word character in the Unicode sense (letters, digits, underscore).  The
# same spelling works in Java regex and RE2, so SQL oracles can repeat it.
WORD = r"[\p{L}\p{N}_]"
WORDS = WORD + "+"
# Whitespace as Python's ``str.split``/``re`` ASCII set sees it.
SPACE = r"[\t\n\x0B\f\r ]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Every character Python's ``str.isspace`` accepts (derived by rule, not listed).
PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def py_strip(c: str | Column) -> Column:
    """Python ``str.strip()``: drop leading and trailing whitespace of any kind.

    ``trim`` with the exact character set Python strips (plain ``trim``
    removes only spaces); no regex involved.
    """
    return F.trim(col(c), F.lit(PY_WHITESPACE))


def md5_int(*parts: str | Column) -> Column:
    """60-bit non-negative integer from md5 of the ``|``-joined string parts.

    Partition-independent and reproducible across engines: the same value is
    ``('0x' || substr(md5(concat_ws('|', ...)), 1, 15))::BIGINT`` in DuckDB.
    """
    args = [col(p).cast("string") if not isinstance(p, (int, float)) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *args)), 1, 15), 16, 10).cast("bigint")


def md5_mod(n: str | Column | int, *parts: str | Column) -> Column:
    """``md5_int(parts) % n`` — a uniform draw in ``[0, n)``."""
    n_col = F.lit(n) if isinstance(n, int) else col(n)
    return F.pmod(md5_int(*parts), n_col.cast("bigint"))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Higher-order functions run interpreted, without common-subexpression
    elimination: an intermediate array used twice inside a lambda is
    recomputed each time (per element). Binding it through a one-element
    ``transform`` evaluates it once.
    """
    return F.get(F.transform(F.array(value), body), 0)


def with_computed(df, name: str, expr: Column):
    """Add ``name = expr`` evaluated exactly once per row.

    A later filter on ``name`` would otherwise be pushed below the projection
    with ``expr`` inlined, running an expensive rewrite twice. A one-element
    generator is a fence the optimizer does not push predicates through.
    """
    return df.select("*", F.explode(F.array(expr)).alias(name))


def safe_div(num: Column, den: Column) -> Column:
    """``num / den`` as DOUBLE, 0.0 when the divisor is 0 (reference convention)."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def fixed3(c: str | Column, places: int = 3) -> Column:
    """Double as text with ``places`` decimals, rounding half away from zero.

    Built from integer arithmetic so every engine renders the same digits
    (``format_string`` rounds a decimal string, printf rounds the binary value).
    """
    scale = 10 ** places
    x = col(c)
    scaled = F.floor(F.abs(x) * F.lit(float(scale)) + F.lit(0.5)).cast("bigint")
    whole = F.floor(scaled / F.lit(scale)).cast("bigint")
    frac = F.pmod(scaled, F.lit(scale)).cast("string")
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, whole.cast("string"), F.lit("."), F.lpad(frac, places, "0"))


def fixed_sql(x: str, places: int = 3) -> str:
    """DuckDB spelling of :func:`fixed3`."""
    scale = 10 ** places
    scaled = f"CAST(floor(abs({x}) * {float(scale)} + 0.5) AS BIGINT)"
    return (f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || CAST(CAST(floor({scaled} / {scale}) AS BIGINT) AS VARCHAR)"
            f" || '.' || lpad(CAST({scaled} % {scale} AS VARCHAR), {places}, '0'))")
