"""Column-level helpers. Every helper returns a JVM-side ``Column``
expression, so it stays inside whole-stage codegen (no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_even(c, digits: int) -> Column:
    """Half-even rounding of the scaled binary value: ``rint(x * 10^k) / 10^k``.

    This is the rounding of ``Series.round`` / ``numpy.round``: 1.005 -> 1.0,
    0.125 -> 0.12, 2.675 -> 2.68. Spark's ``round`` is half-up on the decimal
    expansion and differs on such values.
    """
    scale = float(10 ** digits)
    return F.rint(_col(c) * F.lit(scale)) / F.lit(scale)


def clip(c, lower: float | None = None, upper: float | None = None) -> Column:
    """Bound a column to ``[lower, upper]``; either side may be open."""
    out = _col(c)
    if lower is not None:
        out = F.greatest(out, F.lit(float(lower)))
    if upper is not None:
        out = F.least(out, F.lit(float(upper)))
    return out


def guarded_ratio(num, den, scale: float = 1.0, otherwise: float | None = 0.0) -> Column:
    """``num / den * scale`` when ``den > 0``, else ``otherwise``.

    The division sits inside the ``when`` branch, so it is never evaluated on a
    zero denominator (ANSI mode raises on ``x / 0.0``).
    """
    num, den = _col(num), _col(den)
    ratio = num / den
    if scale != 1.0:
        ratio = ratio * F.lit(float(scale))
    fallback = F.lit(otherwise).cast("double") if otherwise is not None else F.lit(None).cast("double")
    return F.when(den > 0, ratio).otherwise(fallback)


# Characters that Python's ``str.strip()`` removes: every code point for which
# ``str.isspace()`` holds. Derived from that rule instead of listed by hand.
PY_SPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

# C ``isspace`` set, which the numeric parser trims around a number.
_ASCII_SPACE = " \t\n\x0b\f\r"
# A decimal number, optional sign and exponent, or inf / infinity in any case.
NUMBER_PATTERN = (
    "^[+-]?(?:(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
    "|(?i:inf|infinity))\\z"
)
# A month as ``YYYY-M`` or ``YYYY-MM`` (month 1-12), nothing around it.
MONTH_PATTERN = "^[0-9]{4}-(0?[1-9]|1[0-2])\\z"


def strip_text(c, missing_label: str = "nan") -> Column:
    """Text as string, Unicode white space removed at both ends, missing ->
    ``missing_label``."""
    s = _col(c).cast("string")
    return F.coalesce(F.btrim(s, F.lit(PY_SPACE)), F.lit(missing_label))


def number_from_text(c) -> Column:
    """Parse text as a double the way a lenient numeric parser does: white
    space around, sign, decimal point, exponent and inf accepted; thousands
    separators, hex, words and the ``d``/``f`` suffixes rejected (-> NULL)."""
    s = _col(c).cast("string")
    trimmed = F.btrim(s, F.lit(_ASCII_SPACE))
    return F.when(trimmed.rlike(NUMBER_PATTERN), trimmed.try_cast("double"))


def zero_filled(c) -> Column:
    """NULL and NaN -> 0.0; infinities are kept."""
    d = _col(c).cast("double")
    return F.coalesce(F.nanvl(d, F.lit(0.0)), F.lit(0.0))


def month_from_text(c) -> Column:
    """``YYYY-MM`` (or ``YYYY-M``) -> first day of that month; anything else
    -> NULL.

    The pattern admits exactly the texts a ``yyyy-M`` date parser accepts
    (year 0001-9999, month 1-12, optional leading zero); the date is then
    built from the two integers, which is several times cheaper per row than
    a formatter parse.
    """
    s = _col(c).cast("string")
    year = F.substring(s, 1, 4)
    valid = s.rlike(MONTH_PATTERN) & (year != F.lit("0000"))
    return F.when(valid, F.make_date(year.cast("int"), F.substring_index(s, "-", -1).cast("int"), F.lit(1)))


# --- fixed values: forecast-confidence bins and labels --------------------
# Bins [0, 0.5], (0.5, 0.7], (0.7, 0.85], (0.85, 1.0001]; 0 itself included.
CONFIDENCE_EDGES: tuple[float, ...] = (0.0, 0.5, 0.7, 0.85, 1.0001)
CONFIDENCE_LABELS: tuple[str, ...] = (
    "Low (<0.5)",
    "Moderate (0.5-0.7)",
    "High (0.7-0.85)",
    "Very High (0.85+)",
)


def confidence_bucket_id(c) -> Column:
    """0-based bin number of a confidence score; NULL outside [0, 1.0001]."""
    x = _col(c)
    e = CONFIDENCE_EDGES
    ladder = F.when((x >= e[0]) & (x <= e[1]), F.lit(0))
    for i in range(1, len(e) - 1):
        ladder = ladder.when((x > e[i]) & (x <= e[i + 1]), F.lit(i))
    return ladder


def confidence_bucket_label(bucket_id) -> Column:
    b = _col(bucket_id)
    out = None
    for i, label in enumerate(CONFIDENCE_LABELS):
        out = (F.when if out is None else out.when)(b == i, F.lit(label))
    return out


# --- fixed values: KPI band thresholds for average quota attainment -------
KPI_GOOD_AT = 80.0
KPI_WARN_AT = 50.0


def kpi_band(avg_quota) -> Column:
    """``good`` at >= 80, ``warn`` at >= 50, else ``danger``."""
    q = _col(avg_quota)
    return (
        F.when(q >= KPI_GOOD_AT, F.lit("good"))
        .when(q >= KPI_WARN_AT, F.lit("warn"))
        .otherwise(F.lit("danger"))
    )
