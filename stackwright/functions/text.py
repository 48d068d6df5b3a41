"""String functions for catalog keys, as Column expressions; Arrow UDFs only where a loop needs them."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackwright.functions import numbers as nu

STOPWORDS = ("a", "an", "and", "the", "of", "in", "on", "to", "for", "by", "with", "or")
# Punctuation that says nothing, and is dropped without a blank.
DECORATIVE = "\"“”()[]{}!?;:,*#@–—/\\_~`^|<>=+."


def _folded() -> tuple[str, str]:
    """Characters below U+2100 and in full width whose compatibility decomposition, without marks, is one other character."""
    pairs = []
    for c in map(chr, [*range(0x80, 0x2100), *range(0xFF01, 0xFFEF)]):
        d = "".join(x for x in unicodedata.normalize("NFKD", c) if unicodedata.category(x) != "Mn")
        if len(d) == 1 and d != c:
            pairs.append((c, d))
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


MARKED, PLAIN = _folded()


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: an expression used n times is otherwise planned n times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_case(x: Column | str) -> Column:
    """Without marks, in lower case."""
    return F.lower(F.regexp_replace(F.translate(col(x), MARKED, PLAIN), r"\p{Mn}", ""))


def normalize(x: Column | str) -> Column:
    """Lower case, no marks, ``&`` as ``and``, single blanks; decorative punctuation and format marks dropped.

    A blank is kept on either side of a dropped mark.  ``normalize_nfkd`` also decomposes ligatures.
    """
    y = F.regexp_replace(fold_case(x), r"[\s\p{Z}\x1c-\x1f\x85]+", " ")
    y = F.regexp_replace(F.translate(y, "‘’" + DECORATIVE, "''"), r"\p{Cf}", "")
    return F.regexp_replace(F.ltrim(F.replace(y, F.lit("&"), F.lit("and"))), " $", "")


@F.pandas_udf(T.StringType())
def normalize_nfkd(x: pd.Series) -> pd.Series:
    """``normalize`` with full compatibility decomposition, for text outside ``MARKED``."""
    drop = {ord(c): None for c in DECORATIVE} | {0x2018: "'", 0x2019: "'", ord("&"): "and"}

    def one(s: str | None) -> str | None:
        if s is None:
            return None
        t = "".join(c for c in unicodedata.normalize("NFKD", s) if unicodedata.category(c) != "Mn").lower()
        t = re.sub(r"\s+", " ", t).translate(drop)
        return "".join(c for c in t if unicodedata.category(c) != "Cf").lstrip(" ").removesuffix(" ")

    return x.map(one)


def tokens(x: Column | str) -> Column:
    """The words of a normalised string; an empty array for an empty one."""
    return F.filter(F.split(col(x), " "), lambda t: t != "")


def content_tokens(x: Column | str) -> Column:
    """Words that are no stopwords; all words if none is left."""
    all_words = tokens(x)
    kept = F.filter(all_words, lambda t: ~F.array_contains(nu.fixed(STOPWORDS), t))
    return F.when(F.size(kept) > 0, kept).otherwise(all_words)


def join_names(names: Column | str) -> Column:
    """'A', 'A and B', 'A, B, and C'."""
    n = col(names)
    k = F.size(n)
    head = F.array_join(F.slice(n, 1, F.greatest(k - 1, F.lit(1))), ", ")
    last = F.element_at(n, -1)
    return F.when(k == 0, F.lit("")).when(k == 1, n[0]).when(k == 2, F.concat(n[0], F.lit(" and "), n[1])).otherwise(F.concat(head, F.lit(", and "), last))


def match_key(title: Column | str, author: Column | str) -> Column:
    return F.concat_ws("|", normalize(title), normalize(author))


# --- similarity: 2 * LCS / total length, in percent ------------------------------------------------


def lcs_length(a: Column | str, b: Column | str) -> Column:
    """Length of the longest common subsequence of characters, by nested folds inside the JVM."""
    a, b = col(a), col(b)
    x, y = F.filter(F.split(a, ""), lambda c: c != ""), F.filter(F.split(b, ""), lambda c: c != "")
    first = F.transform(F.concat(F.array(F.lit("")), y), lambda _: F.lit(0))

    def row(prev: Column, c: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            up, diagonal, left = F.element_at(prev, j + 1), F.element_at(prev, j), F.element_at(acc, -1)
            best = F.when(F.element_at(y, j) == c, diagonal + 1).otherwise(F.greatest(up, left))
            return F.concat(acc, F.array(best))

        cells = F.when(F.size(y) > 0, F.sequence(F.lit(1), F.size(y))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(cells, F.array(F.lit(0)), cell)

    return F.element_at(F.aggregate(x, first, row), -1)


def ratio(a: Column | str, b: Column | str) -> Column:
    """0 to 100; two empty strings 100, one empty 0."""
    a, b = col(a), col(b)
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(200.0 * lcs_length(a, b) / total)


def token_sort_ratio(a: Column | str, b: Column | str) -> Column:
    s = lambda x: F.array_join(F.array_sort(tokens(x)), " ")
    return ratio(s(a), s(b))


def _indel(a: str, b: str) -> float:
    if not a and not b:
        return 100.0
    if not a or not b:
        return 0.0
    where: dict[str, int] = {}
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    v = full
    for c in a:
        u = v & where.get(c, 0)
        v = (v + u | v - u) & full
    return 200.0 * (len(b) - v.bit_count()) / (len(a) + len(b))


def _token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    one = " ".join(filter(None, [both, " ".join(sorted(x - y))]))
    two = " ".join(filter(None, [both, " ".join(sorted(y - x))]))
    return max(_indel(both, one), _indel(both, two), _indel(one, two))


@F.pandas_udf(T.DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """``ratio`` by bits of whole numbers, for strings of any length."""
    return pd.Series([None if x is None or y is None else _indel(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The best ratio among the common words and either side's words."""
    return pd.Series([None if x is None or y is None else _token_set(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def weighted_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The best of ratio, 0.95 token sort and 0.95 token set."""

    def one(x: str, y: str) -> float:
        return max(_indel(x, y), 0.95 * _indel(" ".join(sorted(x.split())), " ".join(sorted(y.split()))), 0.95 * _token_set(x, y))

    return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity, 0 to 100; above 70 a common start of up to four characters adds a tenth each."""

    def one(s: str, t: str) -> float:
        if s == t:
            return 100.0
        if not s or not t:
            return 0.0
        reach = max(0, max(len(s), len(t)) // 2 - 1)
        used, hits = [False] * len(t), []
        for i, c in enumerate(s):
            for j in range(max(0, i - reach), min(len(t), i + reach + 1)):
                if not used[j] and t[j] == c:
                    used[j] = True
                    hits.append(c)
                    break
        if not hits:
            return 0.0
        moved = sum(x != y for x, y in zip(hits, (c for c, u in zip(t, used) if u))) // 2
        m = len(hits)
        jaro = (m / len(s) + m / len(t) + (m - moved) / m) / 3
        if jaro <= 0.7:
            return 100 * jaro
        prefix = 0
        for x, y in zip(s[:4], t[:4]):
            if x != y:
                break
            prefix += 1
        return 100 * (jaro + prefix * 0.1 * (1 - jaro))

    return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(a, b)], dtype="float64")


# --- book numbers ----------------------------------------------------------------------------------


def isbn_clean(x: Column | str) -> Column:
    return F.upper(F.regexp_replace(col(x), r"[\s-]", ""))


def isbn10_ok(x: Column | str) -> Column:
    """Weights 10 to 1, sum divisible by 11, X (10) only at the end."""
    v = col(x)
    digit = lambda i: F.when(F.substring(v, i, 1) == "X", 10).otherwise(F.substring(v, i, 1).try_cast("int"))
    total = sum((digit(i) * (11 - i) for i in range(2, 11)), digit(1) * 10)
    return F.coalesce(v.rlike(r"^\d{9}[\dX]$") & (total % 11 == 0), F.lit(False))


def isbn13_check(first12: Column | str) -> Column:
    """The check digit of twelve digits, weights 1 and 3."""
    v = col(first12)
    total = sum((F.substring(v, i, 1).try_cast("int") * (3 if i % 2 == 0 else 1) for i in range(2, 13)), F.substring(v, 1, 1).try_cast("int"))
    return ((10 - total % 10) % 10).cast("string")


def isbn13_ok(x: Column | str) -> Column:
    v = col(x)
    return F.coalesce(v.rlike(r"^97[89]\d{10}$") & (isbn13_check(F.substring(v, 1, 12)) == F.substring(v, 13, 1)), F.lit(False))


def isbn10_to_13(x: Column | str) -> Column:
    """With prefix 978 and a new check digit; null unless valid."""
    core = F.concat(F.lit("978"), F.substring(col(x), 1, 9))
    return F.when(isbn10_ok(x), F.concat(core, isbn13_check(core)))


def isbn13(x: Column | str) -> Column:
    """Any written form to a valid 13-digit number, else null."""
    v = isbn_clean(x)
    return F.when(isbn13_ok(v), v).when(isbn10_ok(v), isbn10_to_13(v))


# --- parsers and keys ------------------------------------------------------------------------------


def path_id(url: Column | str, marker: str = "/book/show/") -> Column:
    return F.regexp_extract(col(url), f"{marker}(\\d+)", 1).try_cast("bigint")


def number_in(x: Column | str, pattern: str) -> Column:
    """A number with thousands separators, as ``score: 42,463`` has; null if absent."""
    return F.replace(F.regexp_extract(col(x), pattern, 1), F.lit(",")).try_cast("bigint")


# What names a volume, and how its number may be written.
VOLUME_WORDS = ("volume", "vol", "part", "book", "chapter", "bk")
NUMBER_WORDS = (*nu.UNITS[1:], *nu.TENS, *nu.ROMAN)
SERIES_MARK = r"\s*\([^()]*#[^())]*\)?\s*$"
SERIES_WORDS = r"(?i)\s*\([^()]*?\b(?:book|volume|vol\.?|part|bk\.?)\s+(?:\d+|" + "|".join(sorted(NUMBER_WORDS, key=len, reverse=True)) + r")\b[^()]*\)\s*$"
BLOCK_STOP = ("the", "a", "an", "of", "and", "or", "in", "on", "to", "for", "with", "from", "by", "at")


def series_stripped(title: Column | str) -> Column:
    """Without a ``(..., #n)`` tail, cut off or not, or else a ``(... Book N)`` one; N is a number."""
    t = col(title)
    return F.trim(let(F.regexp_replace(t, SERIES_MARK, ""), lambda marked: F.when(marked == t, F.regexp_replace(t, SERIES_WORDS, "")).otherwise(marked)))


def unhyphened(x: Column | str) -> Column:
    """Hyphens as blanks, single blanks."""
    return F.trim(F.regexp_replace(F.replace(col(x), F.lit("-"), F.lit(" ")), r"\s+", " "))


def has_volume(x: Column | str) -> Column:
    """Whether a text names a volume, by a word for one or a small number of its own."""
    return let(tokens(unhyphened(normalize(x))), lambda words: F.arrays_overlap(words, nu.fixed(VOLUME_WORDS)) | (F.size(nu.volume_numbers(words)) > 0))


def title_core(title: Column | str) -> Column:
    """The head of a title, normalised: no series, no subtitle, no second title after ``or``, no article.

    A subtitle goes after a head of two words or more, unless it names a volume.
    """

    def head(raw: Column) -> Column:
        cut = F.instr(raw, ":")
        first, tail = F.trim(F.substring(raw, F.lit(1), cut - 1)), F.substring(raw, cut + 1, F.length(raw))
        long = F.size(F.filter(F.split(first, r"\s+"), lambda w: w != "")) >= 2
        return F.when((cut > 0) & long & ~has_volume(tail), first).otherwise(raw)

    def one(t: Column) -> Column:
        first = F.trim(F.split(t, " or ", 2)[0])
        return F.when(F.contains(t, F.lit(" or ")) & (first != ""), first).otherwise(t)

    def bare(words: Column) -> Column:
        return F.regexp_replace(F.array_join(words, " "), "^(?:(?:a|an|the)(?: |$))+", "")

    return let(tokens(let(unhyphened(normalize(let(series_stripped(title), head))), one)), bare)


def _number_of(core: Column, most: int = 2100) -> Column:
    """The number that a title core is, from 1 to ``most``; null else."""
    n = F.when(core.rlike(r"^\d{1,9}$"), core.try_cast("int"))
    return F.when((n >= 1) & (n <= most), n)


def spelled(core: Column) -> Column:
    """The words of the number that a title core is; null else."""
    return nu.in_words(_number_of(core))


def block_tokens(core: Column | str) -> Column:
    """The first two content words of a title core."""
    return F.slice(F.filter(tokens(core), lambda t: ~F.array_contains(nu.fixed(BLOCK_STOP), t) & (F.length(t) > 1)), 1, 2)


def title_prefix(title: Column | str) -> Column:
    """The first two content words, or the only one, if eight characters long; null else."""
    return let(F.array_join(block_tokens(title_core(title)), " "), lambda p: F.when(F.length(p) >= 8, p))


def lookup_keys(title: Column | str) -> Column:
    """The normalised titles under which a title may be stored, in the order to try them."""

    def joined(year: Column) -> Column:
        """Nineteen eighty four is also written nineteen eighty-four."""
        parts = F.split(year, " ")
        rest = F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(1))), " ")
        return F.when(F.size(parts) > 2, F.concat_ws(" ", parts[0], F.concat(parts[1], F.lit("-"), rest)))

    def tried(core: Column) -> Column:
        plain = F.array(core, F.concat(F.lit("the "), core), F.concat(F.lit("a "), core), F.replace(core, F.lit(" "), F.lit("-")))
        return F.concat(plain, let(nu.in_words(_number_of(core)), lambda year: F.array(year, F.replace(year, F.lit(" "), F.lit("-")), joined(year))))

    keys = F.concat(F.array(normalize(series_stripped(title))), let(title_core(title), tried))
    return F.array_distinct(F.filter(F.transform(keys, lambda k: F.trim(k)), lambda k: k.isNotNull() & (k != "")))


def same_title(a: Column | str, b: Column | str) -> Column:
    """Whether two title cores are equal but for hyphens, or one is the other's number in words."""
    no = F.lit(False)
    spelled = lambda x, y: F.coalesce(nu.in_words(_number_of(x)) == y, no)
    return let(unhyphened(a), lambda x: let(unhyphened(b), lambda y: (x == y) | spelled(x, y) | spelled(y, x)))


def title_score(a: Column | str, b: Column | str) -> Column:
    """100 for the same title, 0 if both hold volume numbers and share none, else the ratio of sorted words."""
    x, y = nu.volume_numbers(tokens(a)), nu.volume_numbers(tokens(b))
    apart = (F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)
    words = lambda t: F.array_join(F.array_sort(tokens(t)), " ")
    return F.when(same_title(a, b), 100.0).when(apart, 0.0).otherwise(ratio_udf(words(a), words(b)))


def hold_out_unit(key: Column | str, salt: str) -> Column:
    """A number from 0 to 1, by the first eight hex digits of sha256('salt:key')."""
    h = F.substring(F.sha2(F.concat(F.lit(salt + ":"), col(key).cast("string")), 256), 1, 8)
    return F.conv(h, 16, 10).cast("double") / F.lit(4294967295.0)


# Characters that scanning confuses, either way, in the order to try them.
CONFUSED = (("o", "0"), ("i", "l"), ("l", "1"), ("s", "5"), ("z", "2"), ("b", "8"), ("g", "6"), ("rn", "m"), ("cl", "d"), ("vv", "w"))


def ocr_variants(word: Column | str, confidence: Column | None = None) -> Column:
    """Up to two spellings with one confused character each, in rule order.

    None for words under 4 or over 18 characters, or read with a confidence of 0.94 or more.
    """
    w = col(word)
    sure = F.lit(0.0) if confidence is None else confidence
    once = lambda a, b: F.when(F.contains(w, F.lit(a)), F.regexp_replace(w, f"^(.*?){a}", f"$1{b}"))
    tried = F.array(*(once(*r) for a, b in CONFUSED for r in ((a, b), (b, a))))
    fits = (F.length(w) >= 4) & (F.length(w) <= 18) & (sure < 0.94)
    return F.when(fits, F.slice(F.array_distinct(F.array_compact(tried)), 1, 2)).otherwise(F.array().cast("array<string>"))


def author_key(author: Column | str) -> Column:
    """The letters a-z and digits of a normalised author."""
    return F.regexp_replace(normalize(author), "[^a-z0-9]", "")


def plain_words(x: Column | str) -> Column:
    """Another normaliser: lower case, letters and digits, everything else a blank, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold_case(x), r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


def hit(truth: Column | str, picked: Column | str) -> Column:
    """(exact, loose): whether a picked title is the true one, or one of at least four characters holds the other."""
    a, b = plain_words(truth), plain_words(F.coalesce(col(picked), F.lit("")))
    exact = (a == b) & (b != "")
    loose = exact | ((F.length(b) >= 4) & F.contains(a, b)) | ((F.length(a) >= 4) & F.contains(b, a))
    return F.struct(exact.alias("exact"), loose.alias("loose"))
