"""What grows with the input: memory of a cluster's blocks, disk of n-gram rows, labels that a fit counts."""

import random
import tracemalloc
import zlib

import numpy as np

from stackwright.llm import components, jaccard_join, lm_score, toxicity


def test_pairs_of_full_blocks_take_little_beside_their_matrix():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**63, 60, dtype=np.uint64))
    n = 2 * jaccard_join.SETS
    sets = [np.unique(np.concatenate([rng.choice(base, 50, replace=False), rng.integers(0, 2**63, int(rng.integers(0, 30)), dtype=np.uint64)])) for _ in range(n)]
    tracemalloc.start()
    root = jaccard_join.linked_groups(sets, 80, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * n * n * 3  # the matrix holds four bytes a pair; all its pairs at once took over seven times that
    some = sorted(rng.choice(n, 300, replace=False).tolist())
    few = [sets[i] for i in some]
    want = list(range(300))
    for i in range(300):
        for j in range(i):
            both = len(np.intersect1d(few[i], few[j], True))
            if 100 * both >= 80 * (len(few[i]) + len(few[j]) - both):
                old, new = max(want[i], want[j]), min(want[i], want[j])
                want = [new if x == old else x for x in want]
    assert jaccard_join.linked_groups(few, 80, 100).tolist() == want
    part = root[some]  # what links among a few links among all
    assert all(part[i] == part[j] for i, j in enumerate(want))


def test_n_gram_rows_are_dealt_slice_by_slice(spark, monkeypatch):
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choice("abcdefghijkl") for _ in range(60))) for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    dealt, whole = [], lm_score.shared_counts

    def counted(asked, parts):
        dealt.append(asked.count())
        return whole(asked, parts)

    monkeypatch.setattr(lm_score, "shared_counts", counted)
    assert lm_score.score_documents(docs, 3).count() == 200
    grams = {tuple(t.split()[i : i + n]) for _, t in texts for n in (1, 2, 3) for i in range(60 - n + 1)}
    assert sum(dealt) >= len(grams) and max(dealt) <= 0.3 * sum(dealt)


def test_all_labelled_documents_are_counted_and_stepped_over(spark, monkeypatch):
    rng = random.Random(8)
    plain = [f"w{a}{b}" for a in "abcdefgh" for b in "klmnopqr"]
    rows, rare = [], set()
    for i in range(6000):
        words = [rng.choice(plain) for _ in range(12)]
        if i % 2 and (i // 2) % 150 == 0:  # too few for any sample of a thousand documents a class
            words[5] = "grumble"
            rare.add(i)
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    seen = []
    monkeypatch.setattr(toxicity, "_rounds", lambda net, windows, *_: seen.append(windows.collect()), raising=False)
    net = toxicity.train(docs, labels)
    taught = [i for i in range(6000) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert seen and len(seen[0]) == len(taught)
    assert sorted("grumble" in r.words for r in seen[0] if r.sure == 1 and r.toxic).count(True) == len(rare & set(taught))
    assert net.rate == sum(i % 2 for i in taught) / len(taught)


def test_each_round_of_components_leaves_nothing_in_the_driver(spark, monkeypatch):
    rounds, freed, stored = [], [], components.stored
    monkeypatch.setattr(components, "stored", lambda *a: rounds.append(1) or stored(*a))
    monkeypatch.setattr(components, "released", lambda _: freed.append(len(rounds)), raising=False)
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    assert sorted(components.components(edges, "a", "b").collect()) == [(i, 0) for i in range(1, 21)]
    assert freed == list(range(2, len(rounds) + 1))


def test_a_short_word_takes_its_own_steps_only(monkeypatch):
    words = ["x" * 20] + [a + b for a in "abcdefgh" for b in "klmnopqr"]
    done, tanh = [], np.tanh
    monkeypatch.setattr(np, "tanh", lambda x, *a, **k: done.append(np.size(x)) or tanh(x, *a, **k))
    net = toxicity.Network()
    together, _ = net.word_inputs(words)
    assert sum(done) == 2 * 3 * toxicity.H * sum(map(len, words))  # padded to the longest word it was nine times that
    each = np.concatenate([net.word_inputs([w])[0] for w in words])
    assert np.allclose(together, each, atol=1e-5)


def test_gradients_are_the_slopes_of_the_loss():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdef"), rng.integers(1, 9))) for _ in range(30)]
    windows = [[words[i] for i in rng.integers(0, 30, n)] for n in (5, 32, 1, 17, 32, 9)]
    y, weight = np.array([1, 0, 0, 1, 1, 0], np.float32), np.array([1, 0.5, 2, 1, 0.2, 1], np.float32)
    net = toxicity.Network()
    g, _ = net.step(windows, y, weight)
    for name, slope in g.items():
        if name != "embed":
            way = slope / np.sqrt((slope * slope).sum())
            at, loss = net.p[name], []
            for eps in (-1e-2, 1e-2):
                net.p[name] = (at + eps * way).astype(np.float32)
                loss.append(net.step(windows, y, weight)[1])
            net.p[name] = at
            assert np.isclose((loss[1] - loss[0]) / 2e-2, np.sqrt((slope * slope).sum()), rtol=0.02, atol=1e-4), name


def test_word_pairs_with_a_word_of_one_batch_are_not_dealt(spark, monkeypatch):
    texts = [(i, " ".join(w for k in range(30) for w in ("same", f"own{i}x{k}"))) for i in range(4)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4, "doc_id")
    dealt, whole = [], lm_score.shared_counts

    def counted(asked, parts):
        dealt.append(asked.count())
        return whole(asked, parts)

    monkeypatch.setattr(lm_score, "shared_counts", counted)
    got = {r.doc_id: r.log_score for r in lm_score.score_documents(docs, 2).collect()}
    # 120 own words and "same" a batch; their pairs stand nowhere else and were dealt, 236 of them, before.
    assert 121 <= sum(dealt) <= 124
    same, rest = np.log10(90 / 180), np.log10(0.4 / 181)
    pair = np.log10(0.4) + same
    assert all(np.isclose(x, same + 29 * pair + 30 * (np.log10(0.4) + rest), atol=1e-3) for x in got.values()) and len(got) == 4
