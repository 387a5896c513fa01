"""Number parsing and printing as column expressions (JVM-side, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, as text stripping removes it.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

# Plain decimal number, optional sign and exponent.  Guards the cast so that
# Spark-only forms ("1d", "5f") and DuckDB/Python-only forms ("1_000") are
# rejected alike, and "nan"/"inf" text gives null.
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Drop white space of any kind at both ends (``trim`` drops blanks only)."""
    return F.btrim(_col(c), F.lit(SPACES))


def guarded_double(text) -> Column:
    """Cast stripped text to double when it is a plain number, else null."""
    t = strip(text)
    return F.when(t.rlike(NUMBER_PATTERN), t.try_cast("double"))


def accounting_number(text, replace_all: bool = True) -> Column:
    """Accounting text -> double: ``(x)`` -> ``-x``, drop ``$`` and ``,``, trim; bad -> 0.0.

    ``replace_all`` chooses between the replace-first (captive) and replace-all
    (commission, referral) forms.  ``.*`` is greedy, so the two differ only when
    the text holds a line break; Java's ``.`` stops at line breaks like the
    reference's engine, so replace-first is the first match of a non-multiline
    pattern.
    """
    c = _col(text)
    if replace_all:
        neg = F.regexp_replace(c, r"\((.*)\)", "-$1")
    else:
        # Anchored lazy prefix: only the leftmost "(...)" on a line is rewritten.
        neg = F.regexp_replace(c, r"(?s)^(.*?)\(((?-s:.*))\)", "$1-$2")
    return F.coalesce(guarded_double(F.regexp_replace(neg, r"[$,]", "")), F.lit(0.0))


def lenient_float(c) -> Column:
    """Python ``float()``-like parse of text; failure -> null ("1,000" is null)."""
    return guarded_double(_col(c).cast("string"))


def nan_to_null(c) -> Column:
    col = _col(c)
    return F.when(F.isnan(col), F.lit(None).cast("double")).otherwise(col)


def js_text(c) -> Column:
    """Text of a number as a browser prints it: ``100`` not ``100.0``, plain
    digits from 1e-6 up to 1e21, beyond that ``1e+30`` and ``1e-7``."""
    col = _col(c)
    s = col.cast("string")
    plain = F.regexp_replace(s, r"\.0$", "")
    digits = F.regexp_replace(F.regexp_replace(col.try_cast("decimal(38,16)").cast("string"), r"0+$", ""), r"\.$", "")
    short = F.regexp_replace(s, r"\.0E", "E")
    power = F.when(short.contains("E-"), F.lower(short)).otherwise(F.regexp_replace(short, "E", "e+"))
    size = F.abs(col)
    return F.when(col.isNull(), F.lit(None)).when(~s.contains("E"), plain).when((size >= 1e21) | (size < 1e-6), power).otherwise(digits)
