"""Titles, authors and links: book-like rows made from parts, in every form that the functions tell apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwright.functions import names as na
from stackwright.functions import numbers as nu
from stackwright.functions import text as tx
from stackwright.operators import linkage

from .tables import register, sql_confused, sql_core, sql_in_words, sql_lcs, sql_norm, sql_numbers, sql_words, t

QUERIES, SQL, query = register()

GIVEN = ["Ann", "Jean-Luc", "Zoë", "J. R.", "Otto", "María"]
FAMILY = ["Miller", "O’Brien", "Márquez", "Roe Jr.", "Ito", "Le Guin", "Grün"]
FORMS = 10

_LIST = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
_TITLE = """CASE p_partkey % 10 WHEN 0 THEN 'The ' || p_name || ': A Tale of ' || p_type WHEN 1 THEN p_name || ' (' || p_brand || ', #' || p_size || ')'
 WHEN 2 THEN 'Red & ' || p_name || ': Volume ' || p_size WHEN 3 THEN 'A ' || p_name || ', Part ' || (p_size % 20) WHEN 4 THEN p_name || ' (' || p_type || ' Book ' || (p_size % 9 + 1) || ')'
 WHEN 5 THEN (1100 + p_size * 17)::VARCHAR WHEN 6 THEN p_name || ' Or, The ' || p_type WHEN 7 THEN 'Das  “' || p_name || '” – Café' WHEN 8 THEN 'An  The ' || replace(p_name, ' ', '-') ELSE p_name || ' (Book of the Year)' END"""
_AUTHOR = f"""CASE p_size % 5 WHEN 0 THEN {_LIST(FAMILY)}[p_partkey % 7 + 1] || ', ' || {_LIST(GIVEN)}[p_size % 6 + 1] WHEN 1 THEN {_LIST(GIVEN)}[p_size % 6 + 1] || ' ' || {_LIST(FAMILY)}[p_partkey % 7 + 1]
 WHEN 2 THEN {_LIST(GIVEN)}[p_partkey % 6 + 1] || ' van ' || {_LIST(FAMILY)}[p_partkey % 7 + 1] || ' and ' || {_LIST(GIVEN)}[p_size % 6 + 1] || ' ' || {_LIST(FAMILY)}[p_size % 7 + 1]
 WHEN 3 THEN {_LIST(FAMILY)}[p_size % 7 + 1] || ' & ' || {_LIST(FAMILY)}[p_partkey % 7 + 1] || ', ' || {_LIST(GIVEN)}[p_size % 6 + 1] ELSE {_LIST(FAMILY)}[p_partkey % 7 + 1] || ' ' || {_LIST(GIVEN)}[p_size % 6 + 1] END"""
_B = f"b AS (SELECT p_partkey AS id, p_size, {_TITLE} AS title, {_AUTHOR} AS author FROM part)"


def _books(spark: SparkSession, d: str) -> DataFrame:
    """id, title and author for each part."""
    key, size, name, kind = F.col("p_partkey"), F.col("p_size"), F.col("p_name"), F.col("p_type")
    s, num = F.lit, lambda x: x.cast("string")
    form = key % 10
    title = (
        F.when(form == 0, F.concat(s("The "), name, s(": A Tale of "), kind))
        .when(form == 1, F.concat(name, s(" ("), F.col("p_brand"), s(", #"), num(size), s(")")))
        .when(form == 2, F.concat(s("Red & "), name, s(": Volume "), num(size)))
        .when(form == 3, F.concat(s("A "), name, s(", Part "), num(size % 20)))
        .when(form == 4, F.concat(name, s(" ("), kind, s(" Book "), num(size % 9 + 1), s(")")))
        .when(form == 5, num(1100 + size * 17))
        .when(form == 6, F.concat(name, s(" Or, The "), kind))
        .when(form == 7, F.concat(s("Das  “"), name, s("” – Café")))
        .when(form == 8, F.concat(s("An  The "), F.replace(name, s(" "), s("-"))))
        .otherwise(F.concat(name, s(" (Book of the Year)")))
    )
    pick = lambda xs, at: F.element_at(F.array(*map(F.lit, xs)), (at % len(xs)).cast("int") + 1)
    g, gk, f, fs = pick(GIVEN, size), pick(GIVEN, key), pick(FAMILY, key), pick(FAMILY, size)
    who = size % 5
    author = F.when(who == 0, F.concat(f, s(", "), g)).when(who == 1, F.concat(g, s(" "), f)).when(who == 2, F.concat(gk, s(" van "), f, s(" and "), g, s(" "), fs)).when(who == 3, F.concat(fs, s(" & "), f, s(", "), g)).otherwise(F.concat(f, s(" "), g))
    return t(spark, d, "part").select(key.alias("id"), "p_size", title.alias("title"), author.alias("author"))


@query(f"WITH {_B} SELECT id, {sql_norm('title')} AS title, {sql_norm('author')} AS author, {sql_norm('title')} || '|' || {sql_norm('author')} AS match_key, regexp_replace({sql_norm('author')}, '[^a-z0-9]', '', 'g') AS author_key FROM b")
def normalized_books(spark: SparkSession, d: str) -> DataFrame:
    b = _books(spark, d)
    return b.select("id", tx.normalize("title").alias("title"), tx.normalize("author").alias("author"), tx.match_key("title", "author").alias("match_key"), tx.author_key("author").alias("author_key"))


@query(f"SELECT conv_id, turn, {sql_norm('text')} AS text, len({sql_words(sql_norm('text'))})::BIGINT AS words FROM conversations")
def normalized_turns(spark: SparkSession, d: str) -> DataFrame:
    """Whole turns in four languages, with marks, punctuation and line breaks."""
    plain = t(spark, d, "conversations").select("conv_id", "turn", tx.normalize("text").alias("text"))
    return plain.withColumn("words", F.size(tx.tokens("text")).cast("long"))


@query(f"WITH {_B}, {sql_core('b', 'id', 'title')} SELECT id, s AS stripped, core, {sql_numbers(sql_words('core'))}::VARCHAR AS numbers FROM c4")
def title_cores(spark: SparkSession, d: str) -> DataFrame:
    b = _books(spark, d).select("id", tx.series_stripped("title").alias("stripped"), tx.title_core("title").alias("core"))
    return b.withColumn("numbers", F.concat(F.lit("["), F.array_join(nu.volume_numbers(tx.tokens("core")), ", "), F.lit("]")))


_STOP = ", ".join(f"'{w}'" for w in tx.BLOCK_STOP)
_YEAR = f"CASE WHEN regexp_full_match(core, '[0-9]{{1,9}}') AND core::INT BETWEEN 1 AND 2100 THEN {sql_in_words('core::INT')} END"


@query(f"""WITH {_B}, {sql_core('b', 'id', 'title')}, y AS (SELECT id, s, core, {_YEAR} AS year FROM c4), z AS (SELECT *, string_split(year, ' ') AS p FROM y),
k AS (SELECT id, unnest([{sql_norm('s')}, core, 'the ' || core, 'a ' || core, replace(core, ' ', '-'), year, replace(year, ' ', '-'), CASE WHEN len(p) > 2 THEN p[1] || ' ' || p[2] || '-' || array_to_string(p[3:], ' ') END]) AS key, unnest(range(1, 9)) AS place FROM z),
f AS (SELECT id, key, min(place) AS place FROM k WHERE key IS NOT NULL AND key <> '' GROUP BY ALL) SELECT id, key, row_number() OVER (PARTITION BY id ORDER BY place)::BIGINT AS place FROM f""")
def lookup_keys(spark: SparkSession, d: str) -> DataFrame:
    keys = _books(spark, d).select("id", F.posexplode(tx.lookup_keys("title")).alias("place", "key"))
    return keys.select("id", "key", (F.col("place") + 1).cast("long").alias("place"))


_SIG = lambda x: f"list_filter(string_split({x}, ' '), lambda w: w <> '' AND len(w) > 1 AND NOT list_contains({_LIST(na.SUFFIXES)}, w) AND NOT list_contains({_LIST(na.PARTICLES)}, w))"
_ROUGH = lambda x: f"list_filter(string_split({x}, ' '), lambda w: w <> '' AND NOT list_contains({_LIST(na.SUFFIXES)}, w))"
# One row a person: pos, tokens, family, inverted; the commas of this table's authors are one at most.
_PEOPLE = f"""pa AS (SELECT id, author, regexp_matches(author, '(?i)\\s+and\\s+|&') AS many, len(author) - len(replace(author, ',', '')) AS commas FROM b),
pb AS (SELECT id, many OR commas >= 2 AS many, CASE WHEN NOT many AND commas = 1 THEN {_SIG(sql_norm("split_part(author, ',', 1)"))} END AS last, CASE WHEN NOT many AND commas = 1 THEN {_SIG(sql_norm("substr(author, strpos(author, ',') + 1)"))} END AS given,
 list_filter(CASE WHEN many OR commas >= 2 THEN regexp_split_to_array(author, '(?i)\\s+and\\s+|[&,]') ELSE [author] END, lambda x: trim(x) <> '') AS parts FROM pa),
pc AS (SELECT id, last, given, unnest(CASE WHEN len(last) = 1 THEN ['-'] ELSE parts END) AS part, unnest(range(0, CASE WHEN len(last) = 1 THEN 1 ELSE len(parts)::BIGINT END)) AS pos FROM pb),
pd AS (SELECT id, pos, len(last) = 1 AS turned, last, given, {sql_norm('part')} AS n FROM pc),
pe AS (SELECT id, pos, coalesce(turned, false) AS inverted, CASE WHEN turned THEN last || given WHEN len({_SIG('n')}) > 0 THEN {_SIG('n')} ELSE {_ROUGH('n')} END AS tokens, last FROM pd),
pp AS (SELECT id, pos, inverted, tokens, CASE WHEN inverted THEN last[1] ELSE tokens[len(tokens)] END AS family FROM pe WHERE len(tokens) > 0)"""
_FAMILY_KEYS = "list_distinct([family] || CASE WHEN len(tokens) = 2 THEN [CASE WHEN tokens[2] = family THEN tokens[1] ELSE tokens[2] END] WHEN len(tokens) >= 3 THEN list_filter(tokens[1:len(tokens) - 1], lambda w: len(w) >= 4) ELSE [] END)"


@query(f"WITH {_B}, {_PEOPLE} SELECT id, pos::BIGINT AS pos, array_to_string(tokens, ' ') AS tokens, family, inverted FROM pp")
def people_of(spark: SparkSession, d: str) -> DataFrame:
    p = _books(spark, d).select("id", F.posexplode(na.people("author")).alias("pos", "p"))
    # Places count the parts of the author string; a part without a name leaves none here.
    return p.select("id", F.col("pos").cast("long").alias("pos"), F.array_join("p.tokens", " ").alias("tokens"), "p.family", "p.inverted")


_BLOCKS = f"""{sql_core('b', 'id', 'title')}, y AS (SELECT id, core, {_YEAR} AS year, list_filter(string_split(core, ' '), lambda w: len(w) > 1 AND NOT list_contains([{_STOP}], w))[1:2] AS ws FROM c4),
yw AS (SELECT id, core, CASE WHEN year IS NOT NULL THEN (list_filter(ws, lambda w: w <> split_part(year, ' ', 1)) || [split_part(year, ' ', 1)])[1:2] WHEN len(ws) > 0 THEN ws WHEN core <> '' THEN [split_part(core, ' ', 1)] ELSE ['_'] END AS ws FROM y),
fk AS (SELECT DISTINCT id, unnest({_FAMILY_KEYS}) AS f FROM pp), bk AS (SELECT DISTINCT id, f || '|' || unnest(ws) AS block FROM fk JOIN yw USING (id))"""


@query(f"WITH {_B}, {_PEOPLE}, {_BLOCKS} SELECT id, block FROM bk")
def block_keys(spark: SparkSession, d: str) -> DataFrame:
    return _books(spark, d).select("id", F.explode(F.array_distinct(na.block_keys("title", "author"))).alias("block"))


# Two sides: rows of even and of odd ids.  A row's editions are its size.
_LINK = f"""{_B}, {_PEOPLE}, {_BLOCKS},
pr AS (SELECT DISTINCT x.id AS a, y.id AS w FROM bk x JOIN bk y USING (block) WHERE x.id % 2 = 0 AND y.id % 2 = 1),
fam AS (SELECT id, list(DISTINCT family) AS fs, list_distinct(flatten(list(tokens))) AS ws, list(CASE WHEN len(tokens) = 2 THEN array_to_string(list_sort(list_distinct(tokens)), ' ') END) AS ps FROM pp GROUP BY id),
ok AS (SELECT a, w FROM pr JOIN fam x ON x.id = a JOIN fam y ON y.id = w WHERE list_has_any(x.fs, y.fs) OR list_has_any(list_filter(x.ps, lambda v: v IS NOT NULL), list_filter(y.ps, lambda v: v IS NOT NULL)) OR list_has_any(x.fs, y.ws) OR list_has_any(x.ws, y.fs)),
cd AS (SELECT a, w, x.core AS ca, y.core AS cb, x.year AS ya, y.year AS yb, b.p_size AS editions FROM ok JOIN y x ON x.id = a JOIN y ON y.id = w JOIN b ON b.id = w),
pairs AS (SELECT DISTINCT ca, cb, ya, yb FROM cd),
same AS (SELECT ca, cb, ca = cb OR coalesce(ya = cb, false) OR coalesce(yb = ca, false) AS same, {sql_numbers(sql_words('ca'))} AS na, {sql_numbers(sql_words('cb'))} AS nb, array_to_string(list_sort(string_split(ca, ' ')), ' ') AS sa, array_to_string(list_sort(string_split(cb, ' ')), ' ') AS sb FROM pairs),
sc AS (SELECT ca, cb, same, CASE WHEN same THEN 100.0 WHEN len(na) > 0 AND len(nb) > 0 AND NOT list_has_any(na, nb) THEN 0.0 ELSE 200.0 * {sql_lcs('sa', 'sb')} / (length(sa) + length(sb)) END AS raw FROM same),
m AS (SELECT cd.a, cd.w, cd.cb, cd.editions, sc.same, sc.raw FROM cd JOIN sc USING (ca, cb)),
ident AS (SELECT a, arg_max(w, (editions, w)) AS w FROM m WHERE same GROUP BY a),
best AS (SELECT a, cb, arg_min(w, (-editions, -raw, w)) AS w, arg_min(raw, (-editions, -raw, w)) AS raw, max(editions) AS editions FROM m WHERE a NOT IN (SELECT a FROM ident) GROUP BY a, cb),
rk AS (SELECT *, row_number() OVER o AS p, lead(raw) OVER o AS nx FROM best WINDOW o AS (PARTITION BY a ORDER BY raw DESC, editions DESC, w)),
found AS (SELECT a, w AS work, 'title_author' AS method, 100.0 AS score, NULL AS margin FROM ident UNION ALL
 SELECT a, CASE WHEN raw >= 90 AND (nx IS NULL OR raw - nx >= 5) THEN w END, CASE WHEN raw >= 90 AND (nx IS NULL OR raw - nx >= 5) THEN 'title_author' ELSE 'ambiguous' END, CASE WHEN raw >= 90 AND (nx IS NULL OR raw - nx >= 5) THEN 0.7 * raw + 30 ELSE raw END, raw - nx FROM rk WHERE p = 1),
links AS (SELECT b.id, coalesce(work, -1) AS work, coalesce(method, 'unmatched') AS method, round(score, 4) AS score, round(margin, 4) AS margin FROM b LEFT JOIN found ON found.a = b.id WHERE b.id % 2 = 0)"""


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    b = _books(spark, d)
    left = linkage.described(b.filter("id % 2 = 0"), "id", "title", "author")
    right = linkage.described(b.filter("id % 2 = 1").select(F.col("id").alias("work"), "title", "author", F.col("p_size").alias("editions")), "work", "title", "author", "editions")
    return left, right


def _linked(spark: SparkSession, d: str) -> DataFrame:
    return linkage.match_title_author(*_sides(spark, d), "id", "work")


@query(f"WITH {_LINK} SELECT * FROM links")
def title_author_links(spark: SparkSession, d: str) -> DataFrame:
    """Blocks, the author gate, identity, scores per title and the margin, over all parts of both sides."""
    return _linked(spark, d).select("id", F.coalesce("work", F.lit(-1)).alias("work"), "method", F.round("score", 4).alias("score"), F.round("margin", 4).alias("margin"))


# Every seventh row has a book number, and so have the rows of the other side with the same remainder.
_ISBN = "iw AS (SELECT id AS work, (id // 3) % 400 AS isbn FROM b WHERE id % 2 = 1), hit AS (SELECT x.id, min(iw.work) AS h FROM b x JOIN iw ON iw.isbn = x.id % 900 WHERE x.id % 2 = 0 AND x.id % 7 = 0 GROUP BY x.id)"


def _cascade(spark: SparkSession, d: str) -> DataFrame:
    b = _books(spark, d)
    isbns = b.filter("id % 2 = 1").select(F.col("id").alias("work"), (F.floor(F.col("id") / 3) % 400).alias("isbn"))
    left = b.filter("id % 2 = 0 and id % 7 = 0").select("id", (F.col("id") % 900).alias("isbn"))
    return linkage.match_cascade(left, isbns, _linked(spark, d), "id", "isbn", "work")


@query(f"WITH {_LINK}, {_ISBN} SELECT l.id, coalesce(h, work) AS work, CASE WHEN h IS NOT NULL THEN 'isbn' ELSE method END AS method, CASE WHEN h IS NOT NULL THEN 100.0 ELSE score END AS score, CASE WHEN h IS NULL THEN margin END AS margin FROM links l LEFT JOIN hit ON hit.id = l.id")
def cascade_links(spark: SparkSession, d: str) -> DataFrame:
    return _cascade(spark, d).select("id", F.coalesce("work", F.lit(-1)).alias("work"), "method", F.round("score", 4).alias("score"), F.round("margin", 4).alias("margin"))


@query(f"WITH {_LINK}, {_ISBN} SELECT count(*)::BIGINT AS gold_pairs, count(*) FILTER (work = h)::BIGINT AS exact, count(*) FILTER (work <> h AND work >= 0)::BIGINT AS conflict, count(*) FILTER (work < 0)::BIGINT AS missing, round(coalesce(count(*) FILTER (work = h) / nullif(count(*), 0), 0), 6) AS recall FROM hit LEFT JOIN links USING (id)")
def gold_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Links by title and author against links by number."""
    b = _books(spark, d)
    isbns = b.filter("id % 2 = 1").select(F.col("id").alias("work"), (F.floor(F.col("id") / 3) % 400).alias("isbn"))
    gold = b.filter("id % 2 = 0 and id % 7 = 0").select("id", (F.col("id") % 900).alias("isbn")).join(isbns, "isbn")
    return linkage.gold_evaluation(_linked(spark, d), gold, "id", "work")


@query(f"WITH {_LINK} SELECT method, count(*)::BIGINT AS n, round(avg(score), 3) AS score FROM links GROUP BY method")
def link_methods(spark: SparkSession, d: str) -> DataFrame:
    return _linked(spark, d).withColumn("score", F.round("score", 4)).groupBy("method").agg(F.count("*").alias("n"), F.round(F.avg("score"), 3).alias("score"))


@query(f"""WITH {_LINK}, r AS (SELECT work, x.core, f.ws FROM links JOIN y x USING (id) LEFT JOIN fam f USING (id) WHERE method = 'title_author'),
g AS (SELECT work, count(*) AS n, count(DISTINCT core) AS cores FROM r GROUP BY work HAVING count(*) >= 2), k AS (SELECT work, max(c) AS most FROM (SELECT work, w, count(*) AS c FROM (SELECT work, unnest(ws) AS w FROM r) GROUP BY ALL) GROUP BY work)
SELECT work, n::BIGINT AS n, cores::BIGINT AS cores, cores > 1 OR coalesce(most, 0) < n AS suspicious FROM g LEFT JOIN k USING (work)""")
def suspicious_works(spark: SparkSession, d: str) -> DataFrame:
    left, right = _sides(spark, d)
    return linkage.suspicious_works(linkage.match_title_author(left, right, "id", "work"), left, "id", "work")


@query(f"""WITH {_LINK}, lb AS (SELECT id, CASE WHEN id % 8 = 0 THEN id + 1 WHEN id % 8 = 4 THEN NULL ELSE id - 1 END AS truth FROM b WHERE id % 4 = 0)
SELECT count(*)::BIGINT AS reviewed, count(truth)::BIGINT AS checkable, count(*) FILTER (truth IS NOT NULL AND work = truth)::BIGINT AS agree, count(*) FILTER (truth IS NULL AND work < 0)::BIGINT AS rightly_none FROM lb LEFT JOIN links USING (id)""")
def label_evaluation(spark: SparkSession, d: str) -> DataFrame:
    b = _books(spark, d).filter("id % 4 = 0")
    labels = b.select("id", F.when(F.col("id") % 8 == 0, F.col("id") + 1).otherwise(F.lit(None)).alias("truth"))
    return linkage.label_evaluation(labels, _linked(spark, d), "id", "work")


@query(f"WITH {_LINK}, ds AS (SELECT x.id AS one, y.id AS two FROM b x JOIN b y ON y.id = x.id + 10 WHERE x.id % 2 = 0) SELECT one, two, x.work FROM ds JOIN links x ON x.id = one JOIN links y ON y.id = two WHERE x.work = y.work AND x.work >= 0")
def false_merges(spark: SparkSession, d: str) -> DataFrame:
    b = _books(spark, d).filter("id % 2 = 0").select(F.col("id").alias("one"))
    pairs = b.join(b.select((F.col("one") - 10).alias("one"), F.col("one").alias("two")), "one")
    return linkage.false_merges(pairs, _linked(spark, d), "one", "two", "id", "work")


@query(f"SELECT p_partkey, p_size, {sql_in_words('(1 + p_partkey % 9999)')} AS words, {sql_in_words('(p_size + 1850)')} AS year FROM part")
def spelled_numbers(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select("p_partkey", "p_size", nu.in_words((1 + F.col("p_partkey") % 9999).cast("int")).alias("words"), nu.in_words(F.col("p_size") + 1850).alias("year"))


@query(f"""WITH w AS (SELECT DISTINCT unnest(string_split({sql_norm('p_name')} || ' c0rn1 ' || p_size || 'modern clvv58z', ' ')) AS w FROM part),
v AS (SELECT w, unnest({sql_confused('w')}) AS v, unnest(range(1, {2 * len(tx.CONFUSED) + 1})) AS i FROM w WHERE length(w) BETWEEN 4 AND 18), f AS (SELECT w, v, min(i) AS i FROM v WHERE v IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY i) AS place FROM f) SELECT w AS word, v AS variant, place::BIGINT AS place FROM r WHERE place <= 2""")
def scan_variants(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(tx.normalize("p_name"), F.lit(" c0rn1 "), F.col("p_size").cast("string"), F.lit("modern clvv58z"))
    w = t(spark, d, "part").select(F.explode(F.split(line, " ")).alias("word")).distinct()
    return w.select("word", F.posexplode(tx.ocr_variants("word")).alias("place", "variant")).withColumn("place", (F.col("place") + 1).cast("long"))


@query("""WITH n AS (SELECT DISTINCT lower(p_name) AS n FROM part), w AS (SELECT n, unnest(string_split(n, ' ')) AS w FROM n), p AS (SELECT DISTINCT x.n AS a, y.n AS b FROM w x JOIN w y USING (w)),
s AS (SELECT a, b, 'jaccard' AS scorer, round(len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / len(list_distinct(string_split(a, ' ') || string_split(b, ' '))), 6) AS score FROM p WHERE a <> b
 UNION ALL SELECT a, b, 'length', (0 - abs(length(a) - length(b)))::DOUBLE FROM p WHERE a <> b), r AS (SELECT *, row_number() OVER (PARTITION BY a, scorer ORDER BY score DESC, b) AS n FROM s) SELECT a, b, scorer, score FROM r WHERE n = 1""")
def scorer_table(spark: SparkSession, d: str) -> DataFrame:
    """Each name's best partner by each named scorer."""
    n = t(spark, d, "part").select(F.lower("p_name").alias("n")).distinct()
    w = n.select("n", F.explode(F.split("n", " ")).alias("w"))
    pairs = w.select(F.col("n").alias("a"), "w").join(w.select(F.col("n").alias("b"), "w"), "w").filter("a <> b").select("a", "b").distinct()
    x, y = F.split("a", " "), F.split("b", " ")
    scorers = {"jaccard": F.round(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)), 6), "length": -F.abs(F.length("a") - F.length("b"))}
    return linkage.scored_by_all(pairs, "a", "b", scorers).select("a", "b", "scorer", "score")
