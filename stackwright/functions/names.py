"""People's names in author strings, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stackwright.functions import text as tx
from stackwright.functions.text import let

# What stands behind a name, and words of a name that tell nobody apart.
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "phd", "md", "esq")
PARTICLES = ("the", "a", "an", "and", "or", "von", "van", "de", "del", "da", "di", "la", "le")


def significant(normalized: Column) -> Column:
    """The words of a normalised name that are no suffix, particle or single letter."""
    return F.filter(tx.tokens(normalized), lambda t: ~F.array_contains(tx.nu.fixed(SUFFIXES + PARTICLES), t) & (F.length(t) > 1))


def _person(display: Column, words: Column, family: Column, turned: bool) -> Column:
    return F.struct(F.trim(display).alias("display"), words.alias("tokens"), family.alias("family"), F.lit(turned).alias("inverted"))


def western(chunk: Column) -> Column:
    """A person named first name first; null without a word."""

    def words(plain: Column) -> Column:
        some = significant(plain)
        return F.when(F.size(some) > 0, some).otherwise(F.filter(tx.tokens(plain), lambda t: ~F.array_contains(tx.nu.fixed(SUFFIXES), t)))

    return let(let(tx.normalize(chunk), words), lambda w: F.when(F.size(w) > 0, _person(chunk, w, F.try_element_at(w, F.lit(-1)), False)))


def inverted(chunk: Column) -> Column:
    """A person named ``Last, First``; null unless the last name is one significant word."""
    last = significant(tx.normalize(F.substring_index(chunk, ",", 1)))
    first = significant(tx.normalize(F.substring(chunk, F.instr(chunk, ",") + 1, F.length(chunk))))
    return let(last, lambda w: F.when(F.contains(chunk, F.lit(",")) & (F.size(w) == 1), _person(chunk, F.concat(w, first), w[0], True)))


def people(author: Column | str) -> Column:
    """The people of an author string, as structs (display, tokens, family, inverted).

    ``and``, ``&`` or two commas part a list; one comma turns a name round where its last part is one word.
    """

    def listed(a: Column) -> Column:
        commas = F.length(a) - F.length(F.replace(a, F.lit(",")))
        many = a.rlike(r"(?i)\s+and\s+|&") | (commas >= 2)
        parts = F.filter(F.when(many, F.split(a, r"(?i)\s+and\s+|[&,]")).otherwise(F.array(a)), lambda p: F.trim(p) != "")
        one = F.when(~many & (commas == 1), inverted(a))
        return let(one, lambda p: F.when(p.isNotNull(), F.array(p)).otherwise(F.array_compact(F.transform(parts, western))))

    return let(F.coalesce(F.trim(tx.col(author)), F.lit("")), listed)


def family_keys(person: Column) -> Column:
    """Blocking keys of a person: the family name, the other word of two, or other long words of more."""
    words, family = person["tokens"], person["family"]
    other = F.when(words[1] == family, words[0]).otherwise(words[1])
    longer = F.filter(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1))), lambda t: F.length(t) >= 4)
    more = F.when(F.size(words) == 2, F.array(other)).when(F.size(words) >= 3, longer).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(family), more))


def all_family_keys(who: Column, author: Column) -> Column:
    """The blocking keys of ``people``; the author's letters and digits where there are none."""
    compact = tx.author_key(F.coalesce(author, F.lit("")))
    none = let(compact, lambda c: F.when(c != "", F.array(c)).otherwise(F.array().cast("array<string>")))
    return let(F.array_distinct(F.flatten(F.transform(who, family_keys))), lambda k: F.when(F.size(k) > 0, k).otherwise(none))


def keys_of(core: Column, spelled: Column, who: Column, author: Column) -> Column:
    """``family|word`` for the first content words of a title core; a number in digits is also its first word."""
    some = F.array_distinct(F.concat(tx.block_tokens(core), F.filter(F.array(F.split(spelled, " ")[0]), lambda w: w.isNotNull())))
    plain = F.slice(tx.tokens(core), 1, 1)
    words = let(some, lambda ws: F.when(F.size(ws) > 0, F.slice(ws, 1, 2)).when(F.size(plain) > 0, plain).otherwise(F.array(F.lit("_"))))
    return let(words, lambda ws: F.flatten(F.transform(all_family_keys(who, author), lambda f: F.transform(ws, lambda w: F.concat_ws("|", f, w)))))


def block_keys(title: Column | str, author: Column | str) -> Column:
    """``keys_of`` a title and an author."""
    a = tx.col(author)
    return let(tx.title_core(title), lambda core: keys_of(core, tx.spelled(core), people(a), a))


def same_people(x: Column, y: Column) -> Column:
    """Whether two arrays of ``people`` may be the same ones; see ``compatible``."""
    family = lambda p: F.transform(p, lambda q: q["family"])
    words = lambda p: F.flatten(F.transform(p, lambda q: q["tokens"]))
    pairs = lambda p: F.transform(F.filter(p, lambda q: F.size(q["tokens"]) == 2), lambda q: F.array_join(F.array_sort(F.array_distinct(q["tokens"])), " "))
    meet = lambda p, q: F.coalesce(F.arrays_overlap(p, q), F.lit(False))
    some = (F.size(x) > 0) & (F.size(y) > 0)
    return some & (meet(family(x), family(y)) | meet(pairs(x), pairs(y)) | meet(family(x), words(y)) | meet(words(x), family(y)))


def compatible(a: Column | str, b: Column | str) -> Column:
    """Whether two author strings may name the same people.

    They do if a family name is shared, if two names of two words are each other's turn, or if a family name
    is among the other side's words; not if either side names nobody.
    """
    return let(people(a), lambda x: let(people(b), lambda y: same_people(x, y)))


def author_score(a: Column | str, b: Column | str) -> Column:
    """100 for compatible names, else the ratio of the sorted words."""
    words = lambda t: F.array_join(F.array_sort(tx.tokens(tx.normalize(t))), " ")
    return F.when(compatible(a, b), 100.0).otherwise(tx.ratio_udf(words(a), words(b)))
