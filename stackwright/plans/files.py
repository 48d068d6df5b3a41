"""Files: every query writes what it reads, with lines that readers must skip, and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwright.functions import text as tx
from stackwright.operators import dml, etl, lists
from stackwright.sources import books, records, sinks
from stackwright.sources.shared import scratch

from .tables import register, t

QUERIES, SQL, query = register()

JUNK = ["", "not json", "{\"a\": ", "[1, 2]", "\"text\"", "7"]


def _text(lines: DataFrame, what: str, junk: bool = True, codec: str = "gzip") -> str:
    """Lines and junk as text files; their folder."""
    path = scratch(lines.sparkSession, what)
    if junk:
        lines = lines.unionByName(lines.sparkSession.createDataFrame([(x,) for x in JUNK], "value string"))
    lines.write.option("compression", codec).text(path)
    return path


@query("SELECT event_id, user_id, event_type, value, (props->>'k')::BIGINT AS k FROM events")
def json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Events as gzip JSON lines with malformed ones between them."""
    e = t(spark, d, "events").select(F.to_json(F.struct("event_id", "user_id", "event_type", "value", "props")).alias("value"))
    back = records.json_records(records.lines(spark, _text(e, "events")), "event_id long, user_id long, event_type string, value double, props string")
    return back.select("event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT conv_id, turn, role, text FROM conversations")
def written_json(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "json")
    sinks.json_gz(t(spark, d, "conversations").select("conv_id", "turn", "role", "text"), path)
    return books.strict(spark, path, "conv_id long, turn long, role string, text string")


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN '/authors/' || s_suppkey ELSE '/authors/L' || s_suppkey END AS key, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE '/type/author' END AS type, s_name AS name FROM supplier WHERE s_suppkey % 4 IN (0, 1)""")
def dump_lines(spark: SparkSession, d: str) -> DataFrame:
    """Bare JSON objects, five tab-parted columns, too few columns, and broken JSON."""
    s, id_ = t(spark, d, "supplier"), F.col("s_suppkey")
    num = id_.cast("string")
    bare = F.to_json(F.struct(F.concat(F.lit("/authors/"), num).alias("key"), F.col("s_name").alias("name"), id_.alias("id")))
    body = F.to_json(F.struct(F.col("s_name").alias("name"), id_.alias("id")))
    line = F.when(id_ % 4 == 0, bare).when(id_ % 4 == 1, F.concat_ws("\t", F.lit("/type/author"), F.concat(F.lit("/authors/L"), num), F.lit("3"), F.lit("2024-01-01"), body)).when(id_ % 4 == 2, F.concat_ws("\t", F.lit("/type/author"), num)).otherwise(F.concat_ws("\t", F.lit("a"), num, F.lit("3"), F.lit("x"), F.lit("{broken")))
    back = records.dump_records(records.lines(spark, _text(s.select(line.alias("value")), "dump", junk=False)), "key string, name string, id long")
    return back.select("id", "key", "type", "name")


_PAGE = """p AS (SELECT l_orderkey % 5 AS list_id, l_orderkey AS page, l_linenumber AS pos, l_partkey AS book, l_quantity::BIGINT AS q, floor(l_extendedprice)::BIGINT AS price, l_discount, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
z AS (SELECT *, CASE WHEN book % 9 = 0 THEN NULL ELSE book END AS book_id, CASE WHEN q % 7 = 0 THEN NULL ELSE round(l_discount * 50, 2) END AS average, CASE WHEN q % 7 = 0 THEN NULL ELSE price END AS ratings, CASE WHEN q % 5 = 0 THEN NULL ELSE price * 3 END AS score, q AS votes FROM p)"""


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Page records of five lists written as JSON lines below a folder a list; titles lack the last entry of every third page."""
    x = t(spark, d, "lineitem")
    q, price = F.col("l_quantity").cast("long"), F.floor("l_extendedprice").cast("long")
    url = F.when(F.col("l_partkey") % 9 == 0, F.concat(F.lit("/author/show/"), F.col("l_partkey").cast("string"))).otherwise(F.concat(F.lit("/book/show/"), F.col("l_partkey").cast("string"), F.lit("-a-title")))
    mean = F.round(F.col("l_discount") * 50, 2)
    rating = F.when(q % 7 == 0, "not yet rated").otherwise(F.concat(mean.cast("string"), F.lit(" avg rating — "), F.format_number(price, 0), F.lit(" ratings")))
    score = F.when(q % 5 == 0, "no score").otherwise(F.concat(F.lit("score: "), F.format_number(price * 3, 0)))
    votes = F.concat(F.format_number(q, 0), F.when(q == 1, " person voted").otherwise(" people voted"))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    each = x.select("l_orderkey", F.struct(*order, url.alias("u"), F.concat(F.lit("T"), F.col("l_partkey").cast("string")).alias("t"), rating.alias("r"), score.alias("s"), votes.alias("v")).alias("e"))
    page = each.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("e")).alias("es"))
    col = lambda c: F.transform("es", lambda e: e[c])
    n = F.size("es")
    titles = F.when((F.col("l_orderkey") % 3 == 0) & (n > 1), F.slice(col("t"), F.lit(1), n - 1)).otherwise(col("t"))
    body = F.to_json(F.struct(col("u").alias("book_urls"), titles.alias("titles"), col("t").alias("authors"), col("r").alias("rating_texts"), col("s").alias("score_texts"), col("v").alias("vote_texts")))
    path = scratch(spark, "pages")
    page.select((F.col("l_orderkey") % 5).alias("list"), body.alias("value")).write.partitionBy("list").text(path)
    return records.lines(spark, f"{path}/*")


@query(f"WITH {_PAGE} SELECT list_id, book_id, count(*)::BIGINT AS n, round(sum(average), 2) AS average, sum(ratings)::BIGINT AS ratings, sum(score)::BIGINT AS score, sum(votes)::BIGINT AS votes FROM z WHERE book_id IS NOT NULL AND NOT (page % 3 = 0 AND n > 1 AND i = n) GROUP BY ALL")
def list_entries(spark: SparkSession, d: str) -> DataFrame:
    """All six arrays, cut to the shortest; texts to numbers."""
    rows = lists.entries(books.list_pages(_pages(spark, d), lists.ARRAYS, r"list=(\d+)"), "list_id")
    return rows.groupBy("list_id", "book_id").agg(F.count("*").alias("n"), F.round(F.sum("average"), 2).alias("average"), F.sum("ratings").alias("ratings"), F.sum("score").alias("score"), F.sum("votes").alias("votes"))


@query(f"WITH {_PAGE} SELECT book_id, max(coalesce(ratings, 0))::BIGINT AS ratings, count(*)::BIGINT AS appearances, sum(coalesce(score, 0))::BIGINT AS score, sum(coalesce(votes, 0))::BIGINT AS votes FROM z WHERE book_id IS NOT NULL GROUP BY 1")
def list_popularity(spark: SparkSession, d: str) -> DataFrame:
    """Four arrays only, so that short titles cut nothing; absent numbers are 0."""
    return lists.popularity(lists.entries(books.list_pages(_pages(spark, d), lists.SHORT_ARRAYS, r"list=(\d+)"), "list_id"), "book_id")


@query(f"WITH {_PAGE}, g AS (SELECT book_id, list_id, count(*) AS n, sum(coalesce(score, 0)) AS score, sum(coalesce(votes, 0)) AS votes, max(ratings) AS ratings FROM z WHERE book_id IS NOT NULL GROUP BY ALL) SELECT book_id, sum(n)::BIGINT AS appearances, sum(score)::BIGINT AS score, sum(votes)::BIGINT AS votes, string_agg(CASE list_id % 2 WHEN 0 THEN 'even' ELSE 'odd' END, ',' ORDER BY list_id) AS genres_raw, arg_min(ratings, list_id) FILTER (ratings IS NOT NULL)::BIGINT AS ratings FROM g GROUP BY book_id".replace("string_agg(CASE list_id % 2 WHEN 0 THEN 'even' ELSE 'odd' END, ',' ORDER BY list_id) AS genres_raw", "array_to_string(list_sort(list_distinct(list(CASE list_id % 2 WHEN 0 THEN 'even' ELSE 'odd' END))), ',') AS genres"))
def merged_lists(spark: SparkSession, d: str) -> DataFrame:
    """Books over all lists: sums, genres, and the first rating by list; a list gives its largest."""
    rows = lists.entries(books.list_pages(_pages(spark, d), lists.SHORT_ARRAYS, r"list=(\d+)"), "list_id")
    one = rows.groupBy("book_id", "list_id").agg(F.count("*").alias("n"), F.sum(F.coalesce("score", F.lit(0))).alias("score"), F.sum(F.coalesce("votes", F.lit(0))).alias("votes"), F.max("ratings").alias("ratings"), F.max("average").alias("average"))
    one = one.withColumn("genre", F.when(F.col("list_id") % 2 == 0, "even").otherwise("odd"))
    out = lists.merged_books(one, "book_id", "list_id").join(one.groupBy("book_id").agg(F.sum("n").alias("n")), "book_id")
    return out.select("book_id", F.col("n").alias("appearances"), "score", "votes", F.array_join("genres", ",").alias("genres"), "ratings")


@query(f"WITH {_PAGE} SELECT DISTINCT book_id FROM z WHERE book_id IS NOT NULL")
def raw_ids(spark: SparkSession, d: str) -> DataFrame:
    urls = records.json_records(_pages(spark, d), books.PAGE).select(F.explode("book_urls").alias("u"))
    return urls.select(tx.path_id("u").alias("book_id")).filter("book_id is not null").distinct()


@query("SELECT 'bad' AS kind, 'authors,titles' AS missing, 1::BIGINT AS files")
def page_contract(spark: SparkSession, d: str) -> DataFrame:
    """Of two folders of pages, the one whose first line lacks fields."""
    path = scratch(spark, "contract")
    for kind, text in (("good", '{"book_urls": [], "titles": [], "authors": []}'), ("bad", '{"book_urls": []}')):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/{kind}")
    gone = books.missing_fields(books.ordered_lines(spark, f"{path}/*"), ["book_urls", "titles", "authors"])
    return gone.groupBy(F.regexp_extract("file", r"/(good|bad)/", 1).alias("kind"), F.array_join("missing", ",").alias("missing")).agg(F.count("*").alias("files"))


_REC = "r AS (SELECT event_id, user_id, event_type, value, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN 'x' || user_id ELSE user_id::VARCHAR END AS legacy, lpad((user_id * 7919 % 1000000000)::VARCHAR, 9, '0') AS core FROM events)"


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Events as API records: errors are warnings, views have ids that are no numbers."""
    e, u = t(spark, d, "events"), F.col("user_id").cast("string")
    err = F.col("event_type") == "error"
    legacy = F.when(err, None).when(F.col("event_type") == "view", F.concat(F.lit("x"), u)).otherwise(u)
    rec = F.struct(legacy.alias("legacy_id"), F.when(F.col("event_type") == "click", F.lit("978-0-306-40615-7")).alias("isbn13"), F.when(~err, F.concat(F.lit(" T"), u)).alias("title"), F.when(F.col("event_id") % 2 == 0, F.lit("A")).otherwise("").alias("author"), (F.col("event_id") % 1000).cast("string").alias("ratings_count"), F.when(err, F.lit("null required field")).alias("_scrape_warning"), F.when(err, F.concat(F.lit("https://x.org/book/show/"), u, F.lit(".json"))).alias("_url"), F.when(err & (F.col("event_id") % 10 == 0), F.lit("3")).alias("_attempt_count"), F.col("event_id").alias("at"))
    path = _text(e.select(F.to_json(rec).alias("value")), "records")
    return records.json_records(records.lines(spark, path), books.RECORD + ", at long")


@query("SELECT DISTINCT user_id AS id FROM events WHERE event_type NOT IN ('error', 'view')")
def succeeded_ids(spark: SparkSession, d: str) -> DataFrame:
    return books.succeeded(_records(spark, d))


@query("SELECT user_id AS id, sum(CASE WHEN event_id % 10 = 0 THEN 3 ELSE 1 END)::BIGINT AS attempts FROM events WHERE event_type = 'error' GROUP BY 1")
def warned_ids(spark: SparkSession, d: str) -> DataFrame:
    return books.warned(_records(spark, d))


@query("""SELECT user_id AS id, '9780306406157' AS isbn13, 'T' || user_id AS title, 'A' AS author, (max(event_id) % 1000)::BIGINT AS ratings, 0 AS appearances FROM events WHERE event_type = 'click' AND event_id % 2 = 0 GROUP BY user_id""")
def full_records(spark: SparkSession, d: str) -> DataFrame:
    return books.full_records(_records(spark, d))


@query("""WITH ok AS (SELECT DISTINCT user_id AS id FROM events WHERE event_type NOT IN ('error', 'view')), w AS (SELECT user_id AS id, sum(CASE WHEN event_id % 10 = 0 THEN 3 ELSE 1 END) AS a FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT id, 'success' AS kind, 1::BIGINT AS attempts FROM ok UNION ALL SELECT id, 'warning', a::BIGINT FROM w WHERE id NOT IN (SELECT id FROM ok)""")
def merged_records(spark: SparkSession, d: str) -> DataFrame:
    return books.last_or_accumulated(_records(spark, d))


@query("SELECT s_suppkey AS id, round(s_acctbal, 2) AS score, s_nationkey::BIGINT AS votes FROM supplier")
def state_file(spark: SparkSession, d: str) -> DataFrame:
    """One JSON object keyed by id, written and read, beside a file that is none."""
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.round("s_acctbal", 2).alias("score"), F.col("s_nationkey").cast("long").alias("votes"))
    path = _text(books.as_state_file(s, "id", "books"), "state", codec="none")
    return books.state_file(records.lines(spark, path), "books", "score: double, votes: bigint")


@query("SELECT DISTINCT l_suppkey AS id FROM lineitem")
def id_lines(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "ids")
    sinks.sorted_ids(t(spark, d, "lineitem"), "l_suppkey", path)
    spark.createDataFrame([(x,) for x in (" ", "x7", "1.5")], "value string").write.mode("append").text(path)
    return records.ids(records.lines(spark, path))


@query("""SELECT text AS title, role AS author, CASE WHEN turn % 2 = 0 THEN conv_id::VARCHAR END AS isbn, conv_id || '-' || turn AS workkey FROM conversations WHERE trim(text) <> '' """.replace("SELECT text", "SELECT trim(text)"))
def csv_books(spark: SparkSession, d: str) -> DataFrame:
    """Texts with line breaks, quotes and commas through CSV, under a header in mixed case."""
    c = t(spark, d, "conversations")
    rows = c.select(F.col("text").alias("Title"), F.col("role").alias("AUTHOR"), F.when(F.col("turn") % 2 == 0, F.col("conv_id").cast("string")).alias("Isbn"), F.concat_ws("-", "conv_id", "turn").alias("workKey"))
    path = scratch(spark, "csv")
    sinks.csv_catalog(rows, path)
    return records.catalog_csv(spark, path)


_SPINES = "r AS (SELECT user_id AS run_id, 's' || (user_id % 4) AS scene, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events)"


@query(f"WITH {_SPINES} SELECT run_id, scene, place::BIGINT AS place, CASE WHEN event_type = 'error' THEN 'none' ELSE event_type END AS decision, round(CASE WHEN event_id % 5 = 0 THEN 0 ELSE value END, 2) AS score, (event_id % 4)::BIGINT AS candidates FROM r")
def telemetry_spines(spark: SparkSession, d: str) -> DataFrame:
    """Runs with nested spines as JSON lines; absent fields take their defaults."""
    e = t(spark, d, "events")
    none = F.lit(None)
    spine = F.struct("event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("decision"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("score"), F.when(F.col("event_id") % 4 > 0, F.transform(F.sequence(F.lit(1), (F.col("event_id") % 4).cast("int")), lambda i: i.cast("string"))).otherwise(none).alias("candidates"))
    runs = e.groupBy(F.col("user_id").alias("run_id")).agg(F.array_sort(F.collect_list(spine)).alias("spines")).withColumn("scene", F.concat(F.lit("s"), (F.col("run_id") % 4).cast("string")))
    path = _text(runs.select(F.to_json(F.struct("run_id", "scene", "spines")).alias("value")), "runs")
    back = books.telemetry(records.lines(spark, path), "run_id long, scene string, spines array<struct<event_id: bigint, decision: string, score: double, candidates: array<string>>>")
    return books.spine_rows(back).withColumn("score", F.round("score", 2))


@query("SELECT p_partkey AS id, p_name AS title, p_size::BIGINT AS ratings, 'W' || p_partkey AS work FROM part")
def nested_documents(spark: SparkSession, d: str) -> DataFrame:
    """A keyed cache inside a script inside a page."""
    p = t(spark, d, "part")
    key = F.col("p_partkey").cast("string")
    book = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.struct(F.col("p_size").alias("ratings")).alias("stats")))
    work = F.to_json(F.struct(F.concat(F.lit("W"), key).alias("work")))
    cache = F.to_json(F.map_from_arrays(F.array(F.concat(F.lit("Work:"), key), F.concat(F.lit("Book:"), key), F.lit("ROOT")), F.array(work, book, F.lit("{}"))))
    html = F.concat(F.lit("<html><script>var a = 1;</script><script id=\"__NEXT_DATA__\" type=\"application/json\">"), cache, F.lit("</script></html>"))
    doc = p.select(books.embedded_json(html).alias("doc"))
    b, w = books.nested_json(F.col("doc"), "Book:"), books.nested_json(F.col("doc"), "Work:")
    return doc.select(F.get_json_object(b, "$.id").cast("long").alias("id"), F.get_json_object(b, "$.title").alias("title"), F.get_json_object(b, "$.stats.ratings").cast("long").alias("ratings"), F.get_json_object(w, "$.work").alias("work"))


@query("SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))) AS link FROM pages")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)))).alias("link"))


@query("SELECT c_custkey AS query, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey)::BIGINT - 1 AS place, 'T' || o_orderkey AS title, 1::BIGINT AS authors FROM customer JOIN orders ON o_custkey = c_custkey QUALIFY o_orderkey % 3 <> 0")
def volume_fixture(spark: SparkSession, d: str) -> DataFrame:
    """A map of queries to nested volumes; blank titles drop out, places count all."""
    o = t(spark, d, "orders").join(t(spark, d, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    one = F.struct("o_orderkey", F.struct(F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.concat(F.lit("T"), F.col("o_orderkey").cast("string"))).alias("title"), F.array(F.lit("A")).alias("authors")).alias("volumeInfo"))
    per = o.groupBy("c_custkey").agg(F.array_sort(F.collect_list(one)).alias("vs"))
    line = per.select(F.to_json(F.map_from_arrays(F.array(F.col("c_custkey").cast("string")), F.array("vs"))).alias("value"))
    v = books.volumes(records.lines(spark, _text(line, "volumes", junk=False)))
    return v.select(F.col("query").cast("long").alias("query"), "place", "title", F.size("authors").cast("long").alias("authors"))


@query("""WITH l AS (SELECT l_orderkey AS id, l_linenumber AS n, (l_quantity / 100.0) AS x, (l_discount) AS y FROM lineitem) SELECT id % 10 AS class, count(*)::BIGINT AS n, round(sum(0.1 * 640 * 0.05 * 480), 3) AS area, round(min(x) * 640, 3) AS left_most FROM l GROUP BY ALL""")
def label_quads(spark: SparkSession, d: str) -> DataFrame:
    """Label lines in shares of the picture, with lines that are none, to pixels."""
    from stackwright.functions import geometry as g

    x, y = F.col("l_quantity") / 100.0, F.col("l_discount")
    line = F.concat_ws(" ", (F.col("l_orderkey") % 10).cast("string"), x, y, x + 0.1, y, x + 0.1, y + 0.05, x, y + 0.05)
    q = records.quads(records.lines(spark, _text(t(spark, d, "lineitem").select(line.alias("value")), "labels")), 640.0, 480.0)
    return q.groupBy(F.col("class").cast("long").alias("class")).agg(F.count("*").alias("n"), F.round(F.sum(g.polygon_area(F.col("points"))), 3).alias("area"), F.round(F.min(F.col("points")[0]["x"]), 3).alias("left_most"))


@query("""WITH e AS (SELECT l_orderkey AS work, l_returnflag AS lang, CASE WHEN l_linestatus = 'F' THEN 'X' || l_partkey END AS isbn FROM lineitem) SELECT work, count(*)::BIGINT AS edition_count, array_to_string(list_sort(list_distinct(list(lang))), ',') AS languages, coalesce(array_to_string(list_sort(list_distinct(list(isbn) FILTER (isbn IS NOT NULL))), ','), '') AS isbns, min(isbn) AS isbn13 FROM e GROUP BY work""")
def edition_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Editions of a work: count, languages, numbers, the least number."""
    e = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("work"), F.col("l_returnflag").alias("lang"), F.when(F.col("l_linestatus") == "F", F.concat(F.lit("X"), F.col("l_partkey").cast("string"))).alias("isbn"))
    s = etl.edition_stats(e, "work", "isbn", "lang")
    return s.select("work", "edition_count", F.array_join("languages", ",").alias("languages"), F.array_join("isbns", ",").alias("isbns"), "isbn13")


# --- table changes ---------------------------------------------------------------------------------

_WORKS = "w AS (SELECT p_partkey AS work, p_name AS title, p_brand AS author, p_size AS editions, p_partkey AS popularity_rank FROM part), n AS (SELECT l_partkey AS work, l_returnflag AS lang FROM lineitem GROUP BY ALL), lg AS (SELECT work, string_agg(lower(lang), ',' ORDER BY lang) AS languages FROM n GROUP BY work)"


def _works(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select(F.col("p_partkey").alias("work"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"), F.col("p_size").alias("editions"), F.col("p_partkey").alias("popularity_rank"))


def _with_languages(spark: SparkSession, d: str) -> DataFrame:
    codes = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("work")).agg(F.collect_list(F.concat(F.lit(" /languages/"), "l_returnflag")).alias("codes"))
    known = codes.select("work", F.array_join(dml.language_set(F.col("codes")), ",").alias("languages"))
    return dml.set_from(dml.with_column_if_absent(_works(spark, d), "languages", "string"), known, "work", "languages")


@query(f"WITH {_WORKS} SELECT work, title, author, editions, popularity_rank, languages FROM w LEFT JOIN lg USING (work)")
def language_update(spark: SparkSession, d: str) -> DataFrame:
    return _with_languages(spark, d)


@query(f"WITH {_WORKS}, k AS (SELECT work FROM n WHERE lang IN ('A', 'N') GROUP BY 1), i AS (SELECT DISTINCT l_suppkey AS isbn, l_partkey AS work FROM lineitem) SELECT 'book' AS kind, count(*)::BIGINT AS n, sum(work)::BIGINT AS total FROM k UNION ALL SELECT 'isbn', count(*)::BIGINT, sum(isbn + work)::BIGINT FROM i WHERE work IN (SELECT work FROM k)")
def language_prune(spark: SparkSession, d: str) -> DataFrame:
    isbns = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("isbn"), F.col("l_partkey").alias("work")).distinct()
    kept, left = dml.pruned(_with_languages(spark, d), isbns, "languages", ["a", "n"], "work")
    return kept.agg(F.lit("book").alias("kind"), F.count("*").alias("n"), F.sum("work").alias("total")).unionByName(left.agg(F.lit("isbn").alias("kind"), F.count("*").alias("n"), F.sum(F.col("isbn") + F.col("work")).alias("total")))


@query(f"WITH {_WORKS} SELECT work::VARCHAR AS work, title, author, popularity_rank::BIGINT AS popularity_rank, editions FROM w UNION ALL SELECT 'gap:' || c_custkey, c_name, c_mktsegment, 999999, 0 FROM customer WHERE c_acctbal >= 5000")
def gap_fill(spark: SparkSession, d: str) -> DataFrame:
    w = _works(spark, d).withColumn("work", F.col("work").cast("string"))
    un = t(spark, d, "customer").select(F.col("c_custkey").alias("book_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("author"), F.col("c_acctbal").alias("ratings"))
    return dml.gap_filled(w, un, 5000, 999999, "work").withColumn("popularity_rank", F.col("popularity_rank").cast("long"))


@query(f"WITH {_WORKS}, f AS (SELECT l_partkey AS work, min(l_linenumber) AS r, max(l_quantity) AS e FROM lineitem GROUP BY 1) SELECT CASE WHEN work % 6 = 0 THEN 'gap:' || work ELSE 'w' || work END AS work, CASE WHEN work % 6 = 0 THEN popularity_rank ELSE r END::BIGINT AS popularity_rank, CASE WHEN work % 6 = 0 THEN editions ELSE coalesce(e, editions) END::DOUBLE AS editions FROM w LEFT JOIN f USING (work)")
def enrich_update(spark: SparkSession, d: str) -> DataFrame:
    """A correlated update from another table's least and most; guarded keys keep theirs."""
    key = F.when(F.col("work") % 6 == 0, F.concat(F.lit("gap:"), F.col("work").cast("string"))).otherwise(F.concat(F.lit("w"), F.col("work").cast("string")))
    w = _works(spark, d).select(key.alias("work"), F.col("popularity_rank").cast("long").alias("popularity_rank"), F.col("editions").cast("double").alias("editions"))
    x = t(spark, d, "lineitem")
    full = x.select(F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("work"), F.col("l_linenumber").cast("long").alias("popularity_rank"), F.col("l_quantity").alias("editions"))
    full = full.unionByName(full.withColumn("work", F.replace("work", F.lit("w"), F.lit("gap:"))))
    return dml.enriched(w, full, "work", "gap:")


@query(f"WITH {_WORKS}, k AS (SELECT work FROM n WHERE lang = 'R' GROUP BY 1) SELECT (SELECT count(*) FROM w)::BIGINT AS before, (SELECT count(*) FROM k)::BIGINT AS after, (SELECT count(*) FROM w WHERE work NOT IN (SELECT work FROM k))::BIGINT AS deleted, 0::BIGINT AS inserted")
def delete_counts(spark: SparkSession, d: str) -> DataFrame:
    before = _with_languages(spark, d)
    return dml.touched(before, before.filter("array_contains(split(languages, ','), 'r')"), "work")


@query("SELECT s_suppkey AS id, '/a/' || s_suppkey AS first_key, (1 + s_suppkey % 3)::BIGINT AS n, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'eng' END AS lang FROM supplier")
def nested_keys(spark: SparkSession, d: str) -> DataFrame:
    """Author references in two shapes, path segments and language codes."""
    k = F.col("s_suppkey")
    refs = F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), lambda i: F.when(i % 2 == 0, F.struct(F.concat(F.lit("/a/"), (k + i).cast("string")).alias("key"), F.lit(None).cast("struct<key:string>").alias("author"))).otherwise(F.struct(F.lit(None).cast("string").alias("key"), F.struct(F.concat(F.lit("/a/"), (k + i).cast("string")).alias("key")).alias("author"))))
    s = t(spark, d, "supplier").select(k.alias("id"), F.to_json(refs).alias("authors"), F.when(k % 5 == 0, "  ").when(k % 2 == 0, "/languages/ENG").otherwise(" eng ").alias("lang"))
    keys = books.author_refs(F.col("authors"))
    return s.select("id", F.concat(F.lit("/a/"), books.last_segment(keys[0])).alias("first_key"), F.size(keys).cast("long").alias("n"), books.language_code(F.col("lang")).alias("lang"))
