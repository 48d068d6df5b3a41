"""What the query modules share: a register, tables, a scratch folder, and SQL for the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stackwright.functions import numbers as nu
from stackwright.functions import text as tx


def register() -> tuple[dict, dict[str, str], object]:
    """Queries by name, their SQL, and the decorator that fills both."""
    queries: dict = {}
    sqls: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                sqls[f.__name__] = sql
            return f

        return add

    return queries, sqls, query


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- the text functions in DuckDB's SQL ------------------------------------------------------------


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_norm(x: str) -> str:
    gone = f"translate(regexp_replace(lower(strip_accents({x})), '\\s+', ' ', 'g'), {sql_text('‘’' + tx.DECORATIVE)}, '''''')"
    return f"regexp_replace(ltrim(replace({gone}, '&', 'and'), ' '), ' $', '')"


def sql_unhyphened(x: str) -> str:
    return f"trim(regexp_replace(replace({x}, '-', ' '), '\\s+', ' ', 'g'))"


def sql_words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


NUMBERS = {w: i for i, w in enumerate(nu.UNITS) if i} | {w: 10 * (i + 2) for i, w in enumerate(nu.TENS)} | {w: i + 1 for i, w in enumerate(nu.ROMAN)}


def sql_numbers(words: str) -> str:
    """The sorted distinct volume numbers among some words."""
    table = "MAP {" + ", ".join(f"'{w}': {i}" for w, i in NUMBERS.items()) + "}"
    one = f"CASE WHEN regexp_full_match(w, '0*[1-9][0-9]?') THEN try_cast(w AS INT) ELSE ({table})[w] END"
    return f"list_sort(list_distinct(list_filter(list_transform({words}, lambda w: {one}), lambda n: n IS NOT NULL)))"


def sql_core(source: str, key: str, title: str) -> str:
    """CTEs c1 to c4; c4 has key and core for every row of ``source``."""
    words = ", ".join(sql_text(w) for w in tx.VOLUME_WORDS)
    tail = sql_words(sql_unhyphened(sql_norm("substr(s, strpos(s, ':') + 1)")))
    return f"""c1 AS (SELECT *, regexp_replace({title}, {sql_text(tx.SERIES_MARK)}, '') AS m FROM {source}),
c2 AS (SELECT *, trim(CASE WHEN m = {title} THEN regexp_replace({title}, {sql_text(tx.SERIES_WORDS)}, '') ELSE m END) AS s FROM c1),
c3 AS (SELECT *, {sql_unhyphened(sql_norm(f"CASE WHEN strpos(s, ':') > 0 AND len({sql_words(chr(115) + 'plit_part(s, chr(58), 1)')}) >= 2 AND NOT (list_has_any({tail}, [{words}]) OR len({sql_numbers(tail)}) > 0) THEN trim(split_part(s, ':', 1)) ELSE s END"))} AS n FROM c2),
c4 AS (SELECT *, array_to_string({sql_words("regexp_replace(CASE WHEN contains(n, ' or ') AND trim(split_part(n, ' or ', 1)) <> '' THEN trim(split_part(n, ' or ', 1)) ELSE n END, '^((the|a|an)( |$))+', '')")}, ' ') AS core FROM c3)"""


def sql_in_words(n: str) -> str:
    """A number from 1 to 9,999 in words."""
    units, tens = "['', " + ", ".join(f"'{w}'" for w in nu.UNITS[1:]) + "]", "[" + ", ".join(f"'{w}'" for w in nu.TENS) + "]"
    low = lambda x: f"(CASE WHEN ({x}) < 20 THEN {units}[({x}) + 1] ELSE trim({tens}[({x}) // 10 - 1] || ' ' || {units}[({x}) % 10 + 1]) END)"
    hundreds = lambda x: f"(CASE WHEN ({x}) < 100 THEN {low(x)} ELSE trim({low(f'({x}) // 100')} || ' hundred ' || {low(f'({x}) % 100')}) END)"
    return f"(CASE WHEN {n} BETWEEN 1100 AND 1999 THEN trim({low(f'({n}) // 100')} || ' ' || {low(f'({n}) % 100')}) WHEN {n} < 1000 THEN {hundreds(n)} ELSE trim({low(f'({n}) // 1000')} || ' thousand ' || {hundreds(f'({n}) % 1000')}) END)"


def sql_lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence: a fold over a's characters, each a fold over b's."""
    row = f"list_reduce(list_transform(range(1, length({b}) + 1), lambda j: [j]), lambda r, j: list_append(r, CASE WHEN substr({b}, j[1], 1) = substr({a}, i[1], 1) THEN acc[j[1]] + 1 ELSE greatest(acc[j[1] + 1], r[len(r)]) END), [0])"
    return f"list_last(list_reduce(list_transform(range(1, length({a}) + 1), lambda i: [i]), lambda acc, i: {row}, list_transform(range(0, length({b}) + 1), lambda x: 0)))"


def sql_ratio(a: str, b: str) -> str:
    return f"(CASE WHEN length({a}) + length({b}) = 0 THEN 100.0 WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 ELSE 200.0 * {sql_lcs(a, b)} / (length({a}) + length({b})) END)"


def sql_sorted(a: str) -> str:
    return f"array_to_string(list_sort({sql_words(a)}), ' ')"


def sql_token_set(a: str, b: str) -> str:
    x, y = f"list_distinct({sql_words(a)})", f"list_distinct({sql_words(b)})"
    both = f"array_to_string(list_sort(list_intersect({x}, {y})), ' ')"
    only = lambda p, q: f"trim({both} || ' ' || array_to_string(list_sort(list_filter({p}, lambda v: NOT list_contains({q}, v))), ' '))"
    return f"(SELECT greatest({sql_ratio('m', 'p')}, {sql_ratio('m', 'q')}, {sql_ratio('p', 'q')}) FROM (SELECT {both} AS m, {only(x, y)} AS p, {only(y, x)} AS q))"


def sql_confused(w: str) -> str:
    """Spellings of a word with one confused character, in rule order, null where a rule does not fit."""
    once = lambda a, b: f"CASE WHEN contains({w}, '{a}') THEN regexp_replace({w}, '^(.*?){a}', '\\1{b}') END"
    return "[" + ", ".join(once(*r) for a, b in tx.CONFUSED for r in ((a, b), (b, a))) + "]"
