"""What a line on a spine is: title, author or other, by its height, place and wording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stackwright.functions.numbers import trapezoid

# The weights and bands of each role by relative height, then by place along the crop.
TITLE = ((0.65, (0.020, 0.060, 0.160, 0.260)), (0.30, (0.0, 0.08, 0.70, 0.92)))
AUTHOR = ((0.60, (0.012, 0.032, 0.105, 0.170)), (0.30, (0.28, 0.48, 0.88, 0.98)))
OTHER_HEIGHT, OTHER_PLACES = (0.55, (0.004, 0.010, 0.045, 0.085)), (0.30, ((0.0, 0.02, 0.20, 0.38), (0.72, 0.90, 0.98, 1.0)))
BASE, EXCLUDED, NAMED = 0.05, 1.50, 1.25
PREFIXES = ("by", "written by", "author")


def edge(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def line_height(quad: Column) -> Column:
    """Area over the longer mean edge of four points in order."""
    from stackwright.functions.geometry import polygon_area

    p = [quad[i] for i in range(4)]
    wide = F.greatest((edge(p[1], p[0]) + edge(p[2], p[3])) / 2, (edge(p[3], p[0]) + edge(p[2], p[1])) / 2)
    return polygon_area(quad) / F.greatest(wide, F.lit(1.0))


def within_one(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def relative_height(quad: Column, crop: Column) -> Column:
    return within_one(line_height(quad) / F.greatest(crop, F.lit(1.0)))


def place(quad: Column, crop: Column) -> Column:
    """Mean height of the corners as a share of the crop."""
    mean = (quad[0]["y"] + quad[1]["y"] + quad[2]["y"] + quad[3]["y"]) / 4
    return within_one(mean / F.greatest(crop, F.lit(1.0)))


def excluded(text: Column) -> Column:
    """Whether a line holds a book number's name, an address, a copyright mark or four digits in a row."""
    low = F.lower(text)
    return F.contains(low, F.lit("isbn")) | F.contains(low, F.lit("http")) | F.contains(low, F.lit("www")) | F.contains(text, F.lit("©")) | text.rlike(r"\p{N}{4}")


def person_like(text: Column) -> Column:
    """Two to four words of letters: after ``by`` or the like, or two capitalised ones in a line not all in capitals."""
    low = F.lower(text)
    cut = F.lit(0)
    for prefix in reversed(PREFIXES):  # the first that fits counts
        cut = F.when(low.startswith(prefix), len(prefix)).otherwise(cut)
    rest = F.trim(F.substring(text, cut + 1, F.length(text)))
    words = F.filter(F.split(F.when(cut > 0, rest).otherwise(text), " "), lambda w: w != "")
    fit = (F.size(words) >= 2) & (F.size(words) <= 4) & F.forall(words, lambda w: w.rlike(r"^\p{L}{2,24}$"))
    capitals = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    shouted = (text == F.upper(text)) & (text != F.lower(text))
    return fit & ((cut > 0) | ((capitals >= 2) & ~shouted))


def role_scores(height: Column, at: Column, text: Column) -> Column:
    """struct(title, author, other), adding up to 1."""
    band = lambda x, b: trapezoid(x, *b)
    title, author = (BASE + r[0][0] * band(height, r[0][1]) + r[1][0] * band(at, r[1][1]) for r in (TITLE, AUTHOR))
    other = BASE + OTHER_HEIGHT[0] * band(height, OTHER_HEIGHT[1]) + OTHER_PLACES[0] * F.greatest(*(band(at, b) for b in OTHER_PLACES[1]))
    raw = F.struct(title.alias("t"), F.when(person_like(text), author * NAMED).otherwise(author).alias("a"), F.when(excluded(text), other * EXCLUDED).otherwise(other).alias("o"))
    share = lambda r, c: r[c] / (r["t"] + r["a"] + r["o"])
    return F.element_at(F.transform(F.array(raw), lambda r: F.struct(share(r, "t").alias("title"), share(r, "a").alias("author"), share(r, "o").alias("other"))), 1)


def priority(token: Column, share: Column) -> Column:
    return share * (0.70 + 0.03 * F.least(F.length(token), F.lit(10)))
