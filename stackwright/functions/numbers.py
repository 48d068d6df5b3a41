"""Number words and scores, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English number words.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
ROMAN = "i ii iii iv v vi vii viii ix x xi xii xiii xiv xv".split()


def fixed(words) -> Column:
    """A constant array of strings, as one literal that is split when the plan is made."""
    return F.split(F.lit("|".join(words)), r"\|")


def _low(n: int) -> str:
    return UNITS[n] if n < 20 else TENS[n // 10 - 2] + ("" if n % 10 == 0 else " " + UNITS[n % 10])


def below_hundred(n: Column) -> Column:
    """Words for 0 to 99; null beyond."""
    return F.get(fixed(map(_low, range(100))), n.cast("int"))


def in_words(n: Column) -> Column:
    """A number as titles spell it: 1984 is nineteen eighty four, 1805 eighteen five, 1900 nineteen.

    0 and below are empty; from 10,000 on digits stand.
    """
    under = lambda x: F.when(x == 0, "").otherwise(below_hundred(x))
    joined = lambda *parts: F.array_join(F.filter(F.array(*parts), lambda w: w != ""), " ")
    floor = lambda x, k: F.floor(x / k).cast("int")
    hundreds = lambda x: joined(under(floor(x, 100)), F.when(x >= 100, "hundred").otherwise(""), under(x % 100))
    pair = joined(under(floor(n, 100)), under(n % 100))
    thousands = joined(under(floor(n, 1000)), F.lit("thousand"), F.when(n % 1000 == 0, "").otherwise(hundreds(n % 1000)))
    return F.when(n <= 0, "").when(n < 100, under(n)).when((n >= 1100) & (n <= 1999), pair).when(n < 1000, hundreds(n)).when(n < 10000, thousands).otherwise(n.cast("string"))


def volume_numbers(words: Column) -> Column:
    """The numbers among some words: digits 1 to 99, number words, roman i to xv; distinct and sorted."""
    table = {w: i for i, w in enumerate(UNITS) if i} | {w: 10 * (i + 2) for i, w in enumerate(TENS)} | {w: i + 1 for i, w in enumerate(ROMAN)}
    known = F.expr("map(" + ", ".join(f"'{w}', {i}" for w, i in table.items()) + ")")
    one = lambda w: F.when(w.rlike(r"^0*[1-9]\d?$"), w.try_cast("int")).otherwise(F.try_element_at(known, w))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(words, one))))


def rank_score(rank: Column, total: Column) -> Column:
    """100 (1 - ln r / ln N), kept within 0 and 100; a missing rank scores 0."""
    raw = 100 * (1 - F.ln(rank.cast("double")) / F.nullif(F.ln(total.cast("double")), F.lit(0.0)))
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), F.lit(0.0))


def trapezoid(x: Column, a: float, b: float, c: float, d: float) -> Column:
    """0 outside a..d, 1 within b..c, straight between."""
    return F.when((x <= a) | (x >= d), 0.0).when(x < b, (x - a) / (b - a)).when(x <= c, 1.0).otherwise((d - x) / (d - c))


def rounded(x: Column, digits: int) -> Column:
    """``x`` to some decimals: the double x * 10^digits, half away from zero, as DuckDB rounds.

    ``F.round`` goes by a double's shortest decimal form, which lies on the other side of some halves.
    """
    y = F.abs(x) * F.lit(10.0**digits)
    whole = F.floor(y).cast("double")
    return F.signum(x) * (whole + F.when(y - whole >= 0.5, 1.0).otherwise(0.0)) / F.lit(10.0**digits)
