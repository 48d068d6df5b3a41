"""Operators without SQL against plain Python: segmentation, naive Bayes, leaks, held-out personal data, masks."""

import itertools
import math
import random

import numpy as np
import pytest

from stackwright.llm import decontaminate, pii, toxicity, url_filter


def every_split(name):
    for cuts in itertools.product([0, 1], repeat=len(name) - 1):
        parts, at = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(name[at:i])
                at = i
        yield [*parts, name[at:]]


def test_segmentation_is_the_cheapest_of_all_splits():
    rng = random.Random(3)
    words = ["ab", "abc", "bca", "ca", "cab", "bb", "aab", "ccc", "über", "née"]
    model = url_filter.Model({w: rng.randint(1, 500) for w in words})
    cost = lambda parts: sum(model.cost.get(p, model.other if len(p) == 1 else math.inf) for p in parts)
    for _ in range(300):
        name = "".join(rng.choice("abcx") for _ in range(rng.randint(1, 10)))
        got = model._split(name)
        left = name
        for w in got:  # words in order; what stands between them is single characters
            left = left[left.index(w) + len(w) :]
        assert cost(got) + model.other * (len(name) - sum(map(len, got))) == pytest.approx(min(map(cost, every_split(name))))
    assert model.words("http-über-née") == ["http", "über", "née"] or "über" in model.words("http-über-née")


def test_naive_bayes_weights_by_the_formula():
    model = url_filter.Model({})
    seen = {y: [w for u in text.split() for w in model.words(u)] for y, text in ((1, url_filter.BLOCK), (0, url_filter.ALLOW))}
    vocabulary = (set(seen[0]) | set(seen[1])) - url_filter.SILENT
    for w in ("casino", "university", "bonus"):
        p = [(seen[y].count(w) + url_filter.SMOOTH) / (len(seen[y]) + url_filter.SMOOTH * len(vocabulary)) for y in (0, 1)]
        assert model.weight[w] == pytest.approx(math.log(p[1]) - math.log(p[0]))
    assert model.log_odds(["casino", "bonus"]) > 0 > model.log_odds(["university", "library"]) and model.log_odds([]) < 0


def test_unseen_urls_of_known_words():
    model = url_filter.Model({})
    judge = lambda u: model.log_odds(model.words("".join(url_filter.parts_of(u)))) > 0
    bad = ["http://cheapviagra.net/pills", "http://pokerbonus.org/win", "https://spambacklinks.com/cheap", "http://freecams.net/girls"]
    good = ["http://cityuniversity.com/library", "http://scienceblog.net/physics", "https://openlibrary.com/books", "http://www.weather.net/today"]
    assert all(map(judge, bad)) and not any(map(judge, good))


def test_very_long_url():
    model = url_filter.Model({"red": 5, "ring": 5})
    host, path = url_filter.parts_of("http://EX.com/" + "redring" * 3000 + "?q")
    assert host == "ex.com" and len(path) == 21001
    assert model.words(path) == ["red", "ring"] * 3000


@pytest.mark.parametrize("damage", [0.0, 0.2, 0.4])
def test_leaks_against_all_regions(damage):
    """What the word checks accept at any place, and what the candidate search finds of it."""
    rng = random.Random(int(100 * damage) + 1)
    vocabulary = [f"w{i}" for i in range(4000)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    block = decontaminate.Benchmark([(i, " ".join(draw(rng.randint(12, 50)))) for i in range(60)])
    finder = decontaminate.Finder(block, np.random.default_rng(5).standard_normal((decontaminate.TERMS, decontaminate.RANK), dtype=np.float32))
    texts = []
    for own in block.words:
        near = [w.decode() if rng.random() >= damage else rng.choice(vocabulary) for w in own]
        if damage and rng.random() < 0.5:  # clauses in another order
            k = len(near) // 5
            near = near[:k][::-1] + near[k:]
        texts.append(" ".join(draw(rng.randint(0, 60)) + near + draw(rng.randint(0, 60))))
    texts += [" ".join(draw(150)) for _ in range(20)] + ["", None]
    want = set()
    for k, text in enumerate(texts):
        words = decontaminate.words_of(text)
        for i, own in enumerate(block.words):
            if len(set(words) & set(own)) < decontaminate.COMMON * len(set(own)):
                continue
            margin = max(8, len(own) // 4)
            for at in range(-margin, len(words)):
                region = words[max(0, at - margin) : max(0, at + len(own) + margin)]
                if decontaminate.lcs(own, region) >= decontaminate.COMMON * len(own) and decontaminate.lcs(block.answers[i], region) >= decontaminate.ANSWER * len(block.answers[i]):
                    want.add((k, i))
                    break
    got = {(k, x[0]) for k, found in enumerate(finder.leaks_of(texts)) for x in found}
    assert got <= want and len(got) >= 0.9 * len(want), (len(got), len(want))
    assert [x[0] for x in finder.leaks(texts[0])] == [i for k, i in sorted(got) if k == 0]


def test_candidate_terms_do_not_depend_on_the_portion():
    texts = ["Red ring, red RING.", None, "", "été über 12", "x" * 500]
    whole, n = decontaminate.terms_of_texts(texts)
    one = [decontaminate.terms_of_texts([t])[0] for t in texts]
    assert n.tolist() == [len(x) for x in one] == [4, 0, 0, 3, 1] and whole.tolist() == np.concatenate(one).tolist()
    assert whole[0] == whole[2] and whole[1] == whole[3] and whole[:4].tolist() == decontaminate.terms_of([b"red", b"ring", b"red", b"ring"]).tolist()


def test_held_out_personal_data():
    """Names, local phones and identity numbers that the labelled table does not hold."""
    d = pii.Decoder(pii.train())
    given, family = ["Emma", "Noah", "Olga", "Luis", "Greta", "Ivan"], ["Fischer", "Moreau", "Gomez", "Novak", "Baker", "Lind"]
    texts, truth = [], []
    for i, (a, b) in enumerate(itertools.product(given, family)):
        cue = ["Mr.", "Mrs.", "Dr.", "Frau", "Monsieur", "Señora"][i % 6]
        texts.append(f"erin thanth {cue} {a} {b} said onther")
        truth.append(f"{a} {b}")
        number = f"555-{1000 + 37 * i % 9000}"
        texts.append(f"onther {['call', 'phone:', 'tel.'][i % 3]} {number} the anded")
        truth.append(number)
        ssn = f"{100 + 7 * i}-{10 + i}-{1000 + 91 * i}"
        texts.append(f"the ssn {ssn} and onther")
        truth.append(ssn)
    hits = [any(t[a:b] == want for k, a, b in spans) for t, want, spans in zip(texts, truth, pii.spans_of(texts, d))]
    assert sum(hits) >= 0.9 * len(hits), sum(hits) / len(hits)
    clean = ["The anded onther erin of the thanth.", "Les uns et les autres, aux bords du lac.", "Version 3.1 of 2019, pages 12 and 14.", "THE END OF IT", "In May the Rhine rose."] * 5
    assert sum(bool(x) for x in pii.spans_of(clean, d)) <= 1


def test_masks_of_spans_that_overlap():
    assert pii.masked("abcdefgh", [(0, 1, 5), (1, 3, 7)]) == "a<email>h"
    assert pii.masked("abcdefgh", [(0, 1, 7), (1, 3, 5)]) == "a<email>h"
    assert pii.masked("abcdefgh", [(0, 0, 2), (1, 2, 4)]) == "<email><ip>efgh" and pii.masked("ab", []) == "ab"


def test_window_scores_are_the_highest_of_all_windows():
    """The score of a text is that of its best window, each run by itself."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(80)]
    docs = [[rng.choice(words) for _ in range(n)] for n in (1, 31, 32, 33, 39, 40, 41, 100)]
    scorer = toxicity.Scorer(toxicity.Network())
    got = scorer.raw(docs)
    for d, x in zip(docs, got):
        n = len(d)
        starts = sorted({*range(0, n - toxicity.WINDOW + 1, toxicity.STEP), n - toxicity.WINDOW}) if n >= toxicity.WINDOW else [0]
        each = [scorer.raw([d[s : s + toxicity.WINDOW]])[0] for s in starts]
        assert x == pytest.approx(max(each), abs=1e-4)
