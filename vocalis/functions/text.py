"""Scalar text functions as Spark Column expressions (FN-1, 2, 5-12).

All of them are built-in expressions, so they stay inside whole-stage codegen;
keyword lists become array literals and the tests run as higher-order
functions (``exists`` / ``filter``) on the row, never as joins.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# (?U) gives \s and \b their Unicode meaning, as in Python's ``re``.
URL_RE = r"(?U)http\S+|www\.\S+"
SPACE_RE = r"(?U)\s+"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words_lit(words: Iterable[str]) -> Column:
    """A (possibly empty) array<string> literal."""
    words = list(words)
    if not words:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(w) for w in words])


# FN-1 -----------------------------------------------------------------------
def clean_text(c) -> Column:
    """Drop URLs, collapse whitespace, trim; null becomes ''."""
    t = F.regexp_replace(F.coalesce(col_(c), F.lit("")), URL_RE, "")
    return F.trim(F.regexp_replace(t, SPACE_RE, " "))


# FN-2 -----------------------------------------------------------------------
def anonymize_author(c) -> Column:
    """First 12 hex digits of SHA-256; null or '' becomes 'anonymous'."""
    a = col_(c).cast("string")
    return F.when(a.isNull() | (a == ""), F.lit("anonymous")).otherwise(
        F.substring(F.sha2(a, 256), 1, 12))


# FN-5 -----------------------------------------------------------------------
def truncate_excerpt(c, n: int = 200) -> Column:
    """Text longer than n characters becomes its first n plus '...'."""
    t = F.coalesce(col_(c), F.lit(""))
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def context_snippet(text, pos0, length, radius: int = 50) -> Column:
    """``text[max(0,p-r) : min(len, p+len+r)].strip()`` for a 0-based position."""
    t = col_(text)
    start = F.greatest(col_(pos0) - radius, F.lit(0))
    end = F.least(F.length(t), col_(pos0) + col_(length) + radius)
    return F.trim(F.substring(t, start + 1, end - start))


# FN-6 -----------------------------------------------------------------------
def contains_any(c, words: Iterable[str]) -> Column:
    """True when any of the (lower-case) words is a substring of c."""
    return F.exists(words_lit(words), lambda w: F.instr(col_(c), w) > 0)


def count_contained(c, words: Iterable[str]) -> Column:
    """Number of distinct words of the list that occur as substrings of c."""
    return F.size(F.filter(words_lit(dict.fromkeys(words)), lambda w: F.instr(col_(c), w) > 0))


def majority_match(c, phrase) -> Column:
    """At least floor(n/2)+1 of the phrase's n space-separated terms occur in c."""
    terms = F.split(col_(phrase), " ")
    hits = F.size(F.filter(terms, lambda w: F.instr(col_(c), w) > 0))
    return hits >= F.floor(F.size(terms) / 2) + 1


# FN-7 -----------------------------------------------------------------------
def parse_like_count(c) -> Column:
    """'12 Likes' -> 12; anything unparsable -> 0."""
    raw = F.trim(F.regexp_replace(F.regexp_replace(col_(c), "Likes", ""), "Like", ""))
    return F.coalesce(raw.try_cast("bigint"), F.lit(0).cast("bigint"))


# FN-8 -----------------------------------------------------------------------
def score_indicator(c, threshold: float = 0.1) -> Column:
    s = col_(c)
    return (F.when(s > threshold, "Positive")
            .when(s < -threshold, "Negative").otherwise("Neutral"))


# FN-9 -----------------------------------------------------------------------
def signed3(c) -> Column:
    return F.format_string("%+.3f", col_(c))


def pct1(c) -> Column:
    return F.format_string("%.1f%%", col_(c))


def capitalize(c) -> Column:
    """Python ``str.capitalize``: first character upper, the rest lower."""
    t = col_(c)
    return F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 1 << 30)))


def thousands(c) -> Column:
    return F.format_number(col_(c), 0)


def slug(c) -> Column:
    return F.replace(F.lower(col_(c)), F.lit(" "), F.lit("-"))


# FN-10 ----------------------------------------------------------------------
def absolute_url(href, base) -> Column:
    """An href made absolute against ``base`` (a string or a column)."""
    h = col_(href)
    b = F.lit(base) if isinstance(base, str) else base
    return F.when(h.startswith("http"), h).otherwise(F.concat(b, h))


# FN-11 ----------------------------------------------------------------------
def array_to_json(c) -> Column:
    return F.to_json(col_(c))


# FN-12 ----------------------------------------------------------------------
def round_half_even(c, digits: int) -> Column:
    """Python's ``round(x, n)`` on doubles: half-to-even on the *exact* binary
    value, sign of zero kept (``round(-0.00001, 4) == -0.0``).

    ``bround`` rounds the shortest decimal form ("6.35" -> 6.4) while the
    binary value is 6.3499...; near such ties the value is formatted with
    ``format_number`` (``DecimalFormat``, HALF_EVEN on the exact value)."""
    x = col_(c).cast("double")
    scaled = x * float(10 ** digits)
    near_tie = F.abs(scaled - F.floor(scaled) - F.lit(0.5)) < F.lit(1e-6)
    exact = F.regexp_replace(F.format_number(x, digits), ",", "").cast("double")
    r = F.when(near_tie, exact).otherwise(F.bround(x, digits))
    return F.when(r == 0, x * F.lit(0.0)).otherwise(r)


def exact_mean(c, digits: int) -> Column:
    """Aggregate: mean of values that carry at most ``digits`` decimals,
    rounded half-to-even at ``digits`` *exactly* (integer arithmetic on the
    scaled sum), so the result does not depend on the summation order.
    A negative mean that rounds to zero keeps its sign, like Python."""
    scale = 10 ** digits
    x = col_(c).cast("double")
    s = F.sum(F.bround(x * float(scale), 0).cast("long"))
    n = F.count(x)
    r = ((s % n) + n) % n
    q = ((s - r) / n).cast("long")
    up = (r * 2 > n) | ((r * 2 == n) & (((q % 2) + 2) % 2 == 1))
    k = q + up.cast("long")
    mean = k.cast("double") / float(scale)
    return F.when(n == 0, F.lit(None).cast("double")).when(
        (k == 0) & (s < 0), F.lit(-0.0)).otherwise(mean)
