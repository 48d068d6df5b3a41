"""URL filters: rules by host and path, then host word segmentation and naive Bayes.

A URL that no rule fits is judged by its words.  Names run together in hosts and paths are split by a
unigram Viterbi: the words' counts over the text of all pages (and the words of the labelled table) give
their costs, other characters a cost each.  A multinomial naive Bayes model over the words, fitted to the
small labelled table below, gives the log odds; a URL of words it does not know is allowed.

Word counts are summed over all pages.  Those of words that are substrings of a name in a host or path are kept,
as no other word can be in a split, with the total of all; no word is cut off by rank.  Each task gets this table,
which grows with the distinct names.  Judging is one narrow pass over page_id and url.

Defined results
---------------
* null url, or one without ``://``: empty host and path, no rule, verdict allow.
* null page_id and repeated rows: a row each.  Empty table: no rows.  Null html counts no words.
* ties between rules of one length: the later one in the list.  Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

# The rules of the query, host and path with the verdict.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
LONGEST = 64  # letters of a word; a longer run of letters is none
PRIOR = 0.2  # share of URLs to block
SMOOTH = 0.3
# Parts of URLs that say nothing of their content.
SILENT = frozenset("www m com net org edu gov info biz html php index".split())
SCHEMA = "page_id long, host string, path string, rule string, verdict string, words string, log_odds double"
NAME = re.compile(r"[^\W\d_]+")  # letters of any script
LOWER = {c: c + 32 for c in range(65, 91)}

# The labelled table: URLs to block, then URLs to allow.
BLOCK = """
cheap-pills.shop/buy spam-farm.biz/page casino-bonus.win/play freeviagra.top/order onlinecasino.bet/slots
cheapmeds.info/pills buyfollowers.site/cheap adultvideos.xxx/watch pornhub-clone.tube/free getrichquick.biz/cash
paydayloans.click/apply replicawatches.store/sale weightloss-miracle.com/diet fakeid.shop/order crackedsoftware.ru/download
warez-torrent.to/crack spamlinks.farm/links hotsingles.date/meet xxxcams.live/girls forexsignals.win/profit
bitcoin-doubler.biz/invest freeiphone.win/prize clickbait-farm.net/viral slotmachine.bet/jackpot poker-bonus.club/win
discount-pills.pharmacy/viagra cheap-cialis.top/buy escort-girls.date/city gambling-wins.bet/bonus seo-spam.farm/backlinks
"""
ALLOW = """
www.university.edu/research blog.company.com/posts docs.project.org/guide news.city.net/article wiki.community.org/page
m.weather.com/today support.software.com/help forum.cars.net/thread library.school.edu/books museum.art.org/history
www.health.gov/advice recipes.kitchen.com/soup travel.world.net/paris shop.garden.com/tools science.journal.org/paper
blog.family.net/photos www.music.org/concert code.developer.com/reference maps.town.gov/streets sports.daily.com/football
www.bank.com/contact jobs.career.net/engineer archive.paper.org/index static.media.com/image mail.office.net/login
www.theatre.org/tickets learn.language.com/german data.open.gov/tables blog.science.net/physics www.bakery.com/bread
"""


def parts_of(url: str | None) -> tuple[str, str]:
    """Host (A-Z in lower case) and path."""
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = re.split(r"[?#]", url[at + 3 :], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(LOWER), slash + path


def rule_of(host: str, path: str, rules: dict[str, list[tuple[str, str, str]]]) -> tuple[str | None, str | None]:
    """The longest rule that fits, and its verdict; ``rules``: by host."""
    best: tuple[str | None, str | None] = (None, None)
    if not host:
        return best
    name = host
    while True:
        for rule_path, rule, verdict in rules.get(name, ()):
            if path.startswith(rule_path) and (best[0] is None or len(rule) >= len(best[0])):
                best = (rule, verdict)
        dot = name.find(".")
        if dot < 0:
            return best
        name = name[dot + 1 :]


def by_host(rules: tuple[tuple[str, str], ...]) -> dict[str, list[tuple[str, str, str]]]:
    out: dict[str, list[tuple[str, str, str]]] = {}
    for rule, verdict in rules:
        host, slash, path = rule.partition("/")
        out.setdefault(host, []).append((slash + path, rule, verdict))
    return out


class Counts(dict):
    """Counts of some words, and the total of all words of the text."""

    total = 0


class Model:
    """Word costs for segmentation and the naive Bayes weights."""

    def __init__(self, counts: dict[str, int]) -> None:
        labelled = [(y, u) for y, text in ((1, BLOCK), (0, ALLOW)) for u in text.split()]
        seeds = Counter(w for _, u in labelled for w in self._seed_words(u))
        total = (counts.total if isinstance(counts, Counts) else sum(c for w, c in counts.items() if 2 <= len(w) <= LONGEST)) + 1
        floor = max(10, total // 20_000)
        words = {w: c for w, c in counts.items() if 2 <= len(w) <= LONGEST}
        for w, c in seeds.items():
            total += max(0, floor * c - words.get(w, 0))
            words[w] = max(words.get(w, 0), floor * c)
        self.cost = {w: math.log(total / c) for w, c in words.items()}
        self.other = math.log(total) + 2.0  # of a character outside all words
        self.split = lru_cache(200_000)(self._split)
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for y, u in labelled:
            seen[y].update(self.words(u))
        vocabulary = (set(seen[0]) | set(seen[1])) - SILENT
        n = [sum(c.values()) for c in seen]
        self.weight = {w: math.log((seen[1][w] + SMOOTH) / (n[1] + SMOOTH * len(vocabulary))) - math.log((seen[0][w] + SMOOTH) / (n[0] + SMOOTH * len(vocabulary))) for w in vocabulary}
        self.prior = math.log(PRIOR / (1 - PRIOR))

    @staticmethod
    def _seed_words(url: str) -> list[str]:
        return NAME.findall(url)

    def _split(self, name: str) -> tuple[str, ...]:
        """The cheapest words of a name; characters outside words stay single and are left out."""
        best, back = [0.0] + [math.inf] * len(name), [0] * (len(name) + 1)
        for j in range(1, len(name) + 1):
            best[j], back[j] = best[j - 1] + self.other, j - 1
            for i in range(max(0, j - LONGEST), j):
                c = self.cost.get(name[i:j])
                if c is not None and best[i] + c < best[j]:
                    best[j], back[j] = best[i] + c, i
        out, j = [], len(name)
        while j:
            if name[back[j] : j] in self.cost:
                out.append(name[back[j] : j])
            j = back[j]
        return tuple(reversed(out))

    def words(self, text: str) -> list[str]:
        return [w for name in NAME.findall(text.lower()) for w in self.split(name)]

    def log_odds(self, words: list[str]) -> float:
        return self.prior + sum(self.weight.get(w, 0.0) for w in words)


def _substrings(pages: DataFrame) -> DataFrame:
    """The distinct substrings, of 2 to ``LONGEST`` letters, of names in hosts and paths, and the labelled table's words."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {n for u in batch.column(0).to_pylist() for n in NAME.findall("".join(parts_of(u)).lower())}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], ["name"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: set[str] = set()
            for n in batch.column(0).to_pylist():
                out.update(n[i:j] for i in range(len(n)) for j in range(i + 2, min(len(n), i + LONGEST) + 1))
                if len(out) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string())], ["word"])
                    out = set()
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string())], ["word"])

    distinct = pages.select(F.col("url").cast("string")).mapInArrow(names, "name string").distinct()
    seeds = pages.sparkSession.createDataFrame([(w,) for w in sorted(set(NAME.findall(BLOCK + ALLOW)))], "word string")
    return distinct.mapInArrow(cut, "word string").unionByName(seeds).distinct()


def word_counts(pages: DataFrame) -> Counts:
    """The counts, in the text of all pages with tags left out, of the words that names in their URLs can hold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag, held = re.compile(r"<(?:script|style)\b.*?</(?:script|style)>|<[^>]*>", re.S), Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for html in batch.column(0).to_pylist():
                held.update(NAME.findall(tag.sub(" ", html or "").lower()))
                if len(held) > 200_000:
                    yield out()
                    held.clear()
        yield out()

    counted = pages.select(F.col("html").cast("string")).mapInArrow(count, "word string, n long").filter(f"length(word) between 2 and {LONGEST}")
    sums = stored(counted.groupBy("word").agg(F.sum("n").alias("n")), "url-words")
    out = Counts((r.word, r.n) for r in sums.join(_substrings(pages), "word", "left_semi").collect())
    out.total = sums.agg(F.sum("n")).first()[0] or 0
    return out


def judge(pages: DataFrame, model: Model, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict for each row, with the words and their log odds."""
    spark = pages.sparkSession
    held = spark.sparkContext.broadcast((model.cost, model.other, model.weight, model.prior, by_host(rules)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.__new__(Model)
        m.cost, m.other, m.weight, m.prior, listed = held.value
        m.split = lru_cache(200_000)(m._split)
        for batch in batches:
            rows = []
            for page_id, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                host, path = parts_of(url)
                rule, verdict = rule_of(host, path, listed)
                words = m.words(host + path)
                odds = round(m.log_odds(words), 4)
                rows.append((page_id, host, path, rule, verdict or ("block" if odds > 0 else "allow"), " ".join(words), odds))
            kinds = [pa.int64(), *[pa.string()] * 5, pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 7, kinds)], [c.split()[0] for c in SCHEMA.split(", ")])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).mapInArrow(run, SCHEMA)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, Model(word_counts(pages)))
