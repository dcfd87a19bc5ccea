"""Similarity joins against brute force, models on held-out rows, the pipeline, and edge cases."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from spanmill.llm import classifier, embeddings, jaccard, lattice, quality
from spanmill.llm.common import Scratch
from spanmill.llm.components import connected_components
from spanmill.llm.queries import queries
from tests.llm.test_documents import empty, odd_documents

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def components(nodes, edges):
    label = {n: n for n in nodes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    r = random.Random(1)
    edges = {"path": [(i, i + 1) for i in range(300)], "star": [(7, i) for i in range(400)], "random": [(r.randrange(500), r.randrange(500)) for _ in range(350)], "none": []}[shape]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    assert got == components({n for e in edges for n in e}, edges)


@pytest.mark.parametrize("cell", [50, 1, 1000])
def test_embeddings_against_brute_force(spark, cell):
    r = np.random.default_rng(0)
    x = r.standard_normal((240, 24))
    x[40:80] = x[0] + 0.25 * r.standard_normal((40, 24))  # around the threshold
    x[80:90] = x[5]
    x[90] = 3 * x[6]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(300, None, 0), (301, [], 0), (302, [0.0] * 24, 0), (303, [float("nan")] * 24, 0), (304, [1.0, None, *[0.0] * 22], 0), (305, [float("inf")] * 24, 0), (306, x[5, :23].tolist(), 0), (5, x[5].tolist(), 1), (None, x[5].tolist(), 1)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, k1 int")
    got = embeddings.near_duplicates(frame, cell=cell).collect()
    assert len(got) == len(rows + odd)
    usable = [(k, v) for k, v, _ in [*rows, *odd[-2:]]]
    m = np.array([v for _, v in usable])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.9
    np.fill_diagonal(near, False)
    label = components(range(len(m)), zip(*np.nonzero(near), strict=True))
    least = defaultdict(list)
    for i, (k, _) in enumerate(usable):
        least[label[i]].append(math.inf if k is None else k)
    want = Counter((k, int(near[i].sum()), min(least[label[i]])) for i, (k, _) in enumerate(usable))
    assert want == Counter((g.vec_id, g.n_links, g.component_id) for g in got if g.vec_id is None or g.vec_id < 300)
    assert all(g.n_links == 0 and g.component_id == g.vec_id and g.kept for g in got if g.vec_id is not None and g.vec_id >= 300)
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0
    assert embeddings.near_duplicates(frame.where("vec_id = 300")).collect()[0].component_id == 300


def test_embedding_query(spark, sf_dir):
    """Links and classes of the whole table by the matrix of all cosines."""
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    ids = sorted(k for k, v in rows.items() if v and all(x is not None and math.isfinite(x) for x in v) and any(v))
    m = np.array([rows[k] for k in ids], dtype=float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.9
    np.fill_diagonal(near, False)
    label = components(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(near), strict=True)])
    want = {k: (0, k, True) for k in rows} | {k: (int(near[i].sum()), label[k], label[k] == k) for i, k in enumerate(ids)}
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries()["op6_embedding_near_dedup"](spark, sf_dir).collect()} == want


def test_cells_reach_every_neighbour():
    """What a range reaches is all cells with a point in it."""
    r = np.random.default_rng(4)
    x, cuts = r.standard_normal((300, 3)), [np.array([0.1]), np.array([-0.5, 0.0, 0.6]), np.array([0.0])]
    home, costs = np.zeros(300, dtype=int), []
    for k, c in enumerate(cuts):
        low, high = np.r_[-np.inf, c], np.r_[c, np.inf]
        costs.append(np.maximum(0, np.maximum(low - x[:, k, None], x[:, k, None] - high)) ** 2)
        home = home * len(low) + np.searchsorted(c, x[:, k], side="right")
    got = set(zip(*(a.tolist() for a in embeddings.reachable(costs, 0.3)), strict=True))
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= 0.3
    assert {(i, int(home[j])) for i, j in zip(*np.nonzero(near), strict=True)} <= got and len(got) < 300 * 16


def brute_links(sets, threshold=0.8):
    keys = list(sets)
    return [(a, b) for i, a in enumerate(keys) for b in keys[:i] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9]


def near_copies(seed=0):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 8)))
    texts = []
    for n in (60, 150, 400):
        base = [word() for _ in range(n)]
        for k in range(25):
            own = list(base)
            for _ in range(r.randrange(0, max(1, n // 25))):
                own[r.randrange(n)] = word()
            texts.append(" ".join(own))
    shared = [word() for _ in range(30)]  # a passage that unlike texts share
    texts += [" ".join([*shared, *(word() for _ in range(60))]) for _ in range(60)]
    texts += ["a b c", "a b c", "a b", "x", texts[3], texts[3], texts[40]]
    return texts


def test_jaccard_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 8)
    monkeypatch.setattr(jaccard, "BLOCK", 10)  # several tiles a group
    texts = near_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {k: set(jaccard.shingles(t.encode()).tolist()) for k, t in enumerate(texts)}
    links = brute_links(sets)
    count = Counter(k for e in links for k in e)
    label = components(sets, links)
    got = {r.doc_id: r for r in jaccard.near_duplicates(docs).collect()}
    assert {k: (g.n_links, g.class_id, g.kept) for k, g in got.items()} == {k: (count[k], label[k], label[k] == k) for k in sets}
    assert {r.doc_id for r in jaccard.keep_first(docs).collect()} == set(label.values())


def test_jaccard_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    links = brute_links({k: set(jaccard.shingles(t.encode()).tolist()) for k, t in texts.items()})
    count = Counter(k for e in links for k in e)
    assert {r.doc_id: r.n_links for r in queries()["op7_ngram_jaccard"](spark, sf_dir).collect()} == {k: count[k] for k in texts}


def test_jaccard_oddities(spark):
    rows = jaccard.near_duplicates(odd_documents(spark)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert len(rows) == 13 and all(by[k][0].n_links == 0 and by[k][0].class_id == k and by[k][0].kept for k in (1, 2, 3, 4))
    assert by[8][0].n_links == 4 and {r.class_id for r in by[9]} == {8} and by[None][0].class_id == 8 and not by[None][0].kept
    assert jaccard.near_duplicates(empty(spark)).count() == 0
    assert jaccard.keep_first(empty(spark)).columns == empty(spark).columns


def test_runs_reach_the_recall():
    for depth in (1, 2, 3):
        miss = (1 - jaccard.found_with(depth)) ** jaccard.runs_for(0.999, depth)
        assert miss <= 0.001


def segmentations(word, p):
    """The sum over all segmentations, by plain recursion on suffixes."""
    sums = {len(word): 1.0}
    for at in range(len(word) - 1, -1, -1):
        sums[at] = sum(p[word[at:to]] * sums[to] for to in range(at + 1, min(len(word), at + 60) + 1) if word[at:to] in p)
    return sums[0]


def test_lattice_sums_all_segmentations(monkeypatch):
    own = lattice.Lattice([b" ", b" a", b" ab", b"a", b"b", b"c", b"ab", b"bc", b"abc"], np.log([0.2, 0.15, 0.1, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05]), math.log(0.05))
    p = {k: math.exp(v) for k, v in zip(own.pieces, own.log_p, strict=True)}

    def total(word):
        return 1.0 if not word else sum(p[word[:k]] * total(word[k:]) for k in range(1, len(word) + 1) if word[:k] in p)

    words = [b"abc", b"a", b"cab", b"abcabc", b"b", b""]
    assert np.allclose(own.word_log_p(words), [math.log(total(b" " + w)) for w in words])
    assert total(b" abcabc") == pytest.approx(segmentations(b" abcabc", p))
    counts = own.expected([b"abc"], np.array([2.0]))
    assert counts[[0, 1, 2]].sum() == pytest.approx(2)  # each word begins once
    long = [b"abcab" * 20, b"cab", b"bca" * 9]
    short, times = (own.word_log_p(long), own.expected(long, np.array([1.0, 3.0, 2.0]))), np.array([1.0, 3.0, 2.0])
    monkeypatch.setattr(lattice, "LONG_WORD", 5)  # a long word goes through the same sums
    assert np.allclose(own.word_log_p(long), short[0]) and np.allclose(own.expected(long, times), short[1])


def test_lattice_query(spark, sf_dir):
    """Counts, the base and the score of all rows, the weights learned too, by plain recursion over dictionaries."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    counts, ends = Counter(), 0
    for k, t in docs.items():
        if zlib.crc32(str(k).encode()) % 10:
            counts.update((t or "").encode().lower().split())
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    pieces = lattice.vocabulary(PIECES)
    p = {x: 1 / (i + 100) for i, x in enumerate(pieces)}
    end = 1 / 100
    for _ in range(lattice.PASSES):
        whole = sum(p.values()) + end
        p, found = {x: c / whole for x, c in p.items()}, dict.fromkeys(pieces, lattice.SMOOTHING)
        for word, times in counts.items():
            word = b" " + word
            to = {0: 1.0}
            for at in range(1, len(word) + 1):
                to[at] = sum(to[a] * p[word[a:at]] for a in range(max(0, at - 60), at) if word[a:at] in p)
            after = {len(word): 1.0}
            for at in range(len(word) - 1, -1, -1):
                after[at] = sum(p[word[at:b]] * after[b] for b in range(at + 1, min(len(word), at + 60) + 1) if word[at:b] in p)
            for a in range(len(word)):
                for b in range(a + 1, min(len(word), a + 60) + 1):
                    if word[a:b] in p:
                        found[word[a:b]] += times * to[a] * p[word[a:b]] * after[b] / to[len(word)]
        p, end = found, ends + lattice.SMOOTHING
    whole = sum(p.values()) + end
    p = {x: c / whole for x, c in p.items()}
    own = {w: math.log10(segmentations(b" " + w, p)) for w in {w for t in docs.values() for w in (t or "").encode().lower().split()}}
    for r in queries()["op4_lattice_score"](spark, sf_dir).collect():
        words = (docs[r.doc_id] or "").encode().lower().split()
        base = sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in [*(counts[w] for w in words), ends])
        assert r.n_tokens == len(words) + 1 and r.n_known == 1 + sum(w in counts for w in words) and r.train_tokens == n
        assert r.base_score == pytest.approx(base) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert r.score == pytest.approx(sum(own[w] for w in words) + math.log10(end / whole), rel=1e-6)


def test_lattice_joins_rare_words(spark):
    """What is broadcast and what meets in a join give the same scores."""
    docs = odd_documents(spark)
    train = F.coalesce(F.col("doc_id"), F.lit(0)) != 8
    every, none = (sorted(((r.doc_id, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lattice.score(docs, train, PIECES, hot_words=h).collect()), key=repr) for h in (1000, 0))
    assert every == none and len(every) == 13
    assert lattice.score(empty(spark), train, PIECES).count() == 0
    one = lattice.score(docs.where("doc_id = 8"), F.lit(False), PIECES).first()
    assert one.n_known == 0 and one.train_tokens == 0 and math.isfinite(one.score)


def test_keep_first_judges_rows_that_share_an_id(spark):
    r = random.Random(8)
    text = lambda: " ".join(f"w{r.randrange(10_000)}" for _ in range(60))
    copied, alone, other = text(), text(), text()
    docs = spark.createDataFrame([(1, copied, "a"), (5, copied + " more", "b"), (5, alone, "c"), (6, copied, "d"), (None, copied, "e"), (7, other, "f"), (7, other, "g"), (7, "", "h")], "doc_id long, text string, kind string")
    assert "".join(sorted(x.kind for x in jaccard.keep_first(docs).collect())) == "acefgh"


def test_classifier_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = {r.doc_id: r for r in queries()["op8_quality_classifier"](spark, d).collect()}
    held = [(rows[k].predicted, q) for k, q in labels.items() if k in rows and rows[k].held_out]
    assert len(held) > 60 and sum(a == b for a, b in held) / len(held) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows.values())


def test_classifier_oddities(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(4, 0, 0), (8, 1, 0), (8, 1, 0), (9, None, 0), (None, 1, 1), (77, 1, 0)], "doc_id long, quality int, toxic int")
    model = classifier.fit(docs, labels, F.lit(True), Scratch(spark, "test"))
    assert classifier.score(docs, model).where("score between 0 and 1").count() == 13
    flat = classifier.fit(docs, labels.limit(0), F.lit(True), Scratch(spark, "test"))
    assert {r.score for r in classifier.score(docs, flat).collect()} == {0.5}
    assert classifier.score(empty(spark), model).count() == 0


def test_classifier_counts_each_indicator_alone(spark):
    """Log ratios are those of exact counts, and words that training hasn't seen weigh nothing, however many it has."""
    r = random.Random(4)
    word = lambda letters: "".join(r.choice(letters) for _ in range(12))
    rows = [(k, " ".join([f"class{'ab'[k % 2]}", *(word("abcdefghijklm") for _ in range(1000))])) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, quality int")
    model = classifier.fit(docs, labels, F.lit(True), Scratch(spark, "test"))
    texts = spark.createDataFrame([(k, " ".join(["classa", *(word("nopqrstuvwxyz") for _ in range(1000))])) for k in range(8)], "doc_id long, text string")
    assert len({x.score for x in classifier.score(texts, model).collect()}) == 1
    held = {}
    for k, text in rows:
        for key in classifier.features(text.encode()).tolist():
            held.setdefault(key, [0, 0])[k % 2] += 1
    ratios = {key: math.log((b + 1) / 202) - math.log((a + 1) / 202) for key, (a, b) in held.items() if a + b >= 3}
    assert dict(zip(model.keys.tolist(), model.scales.tolist(), strict=True)) == pytest.approx({k: v * v for k, v in ratios.items() if v})


def test_dual_coordinate_descent_meets_its_conditions():
    r = np.random.default_rng(1)
    y = np.where(r.random(80) < 0.5, 1.0, -1.0)
    rows = [np.unique(np.r_[r.integers(0, 30, 4), [40 if v > 0 else 41]]) for v in y]
    values = [np.full(len(f), 1 / math.sqrt(len(f))) for f in rows]
    w = classifier.descend(rows, values, y, np.full(80, 10.0), 400)
    margins = np.array([w[f] @ x + w[-1] for f, x in zip(rows, values, strict=True)])
    assert (y * margins).min() > 0.95  # separable, and the cost is high


def test_dual_coordinate_descent_against_a_dense_solver():
    """The same weights as projected gradient steps on the whole dual problem give."""
    r = np.random.default_rng(3)
    y = np.where(r.random(60) < 0.5, 1.0, -1.0)
    x = r.random((60, 12)) * (r.random((60, 12)) < 0.5) + 0.2 * (y > 0)[:, None] * (np.arange(12) < 3)
    x[x.sum(1) == 0, 0] = 1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cost = np.where(y > 0, 0.7, 1.3)
    rows, values = [np.flatnonzero(v) for v in x], [v[v != 0] for v in x]
    w = classifier.descend(rows, values, y, cost, 20_000, n=12, least=1e-10)
    q = (y[:, None] * np.c_[x, np.ones(60)]) @ (y[:, None] * np.c_[x, np.ones(60)]).T
    alpha, step = np.zeros(60), 1 / np.linalg.eigvalsh(q).max()
    for _ in range(200_000):
        alpha = np.clip(alpha - step * (q @ alpha - 1), 0, cost)
    assert np.allclose(w, (alpha * y) @ np.c_[x, np.ones(60)], atol=1e-4)


def test_stages_on_odd_documents(spark):
    """Nulls, empty and very long texts, repeated rows, clashing names and empty tables at every stage."""
    import corpus_pipeline as pipe

    docs, none = odd_documents(spark), empty(spark)
    source = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)
    got = {}
    for name, stage in pipe.STAGES:
        out = stage(spark, docs, "")
        got[name] = out.collect()
        assert stage(spark, none, "").count() == 0
        if name != "packing":
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got[name] if name != "near_dedup")
    kept = [(k, quality.judge((t or "").encode(), quality.LineRules())) for k, t in source]
    assert sorted(((r.doc_id, r.text) for r in got["quality_rules"]), key=repr) == sorted(((k, v[-1].decode()) for k, v in kept if v[6]), key=repr)
    for name in ("line_dedup", "substring_dedup"):
        assert sorted((r.doc_id for r in got[name]), key=repr) == sorted((k for k, _ in source), key=repr)
        by = {r.doc_id: r.text for r in got[name]}
        assert by[1] is None and by[2] == "" and by[3] == " \n\t \n" and by[7] == "one"
    assert sorted((r.doc_id for r in got["near_dedup"]), key=repr) == sorted([1, 2, 3, 4, 5, 6, 7, 8, 11, None], key=repr)
    whole = Counter(r.doc_id for r in got["packing"] if r.start == 0)
    assert whole == Counter(k for k, _ in source) and all(r.doc_tokens == r.length == 1 for r in got["packing"] if r.doc_id in (1, 2, 3))


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as pipe

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base, seen = Scratch(spark, "test"), docs
    for k, (name, stage) in enumerate(pipe.STAGES):
        before = {r.doc_id: r.text for r in seen.collect()}
        seen = base.write(stage(spark, seen, sf_dir), name)
        if k < 4:
            assert seen.columns == docs.columns
            after = {r.doc_id: r.text for r in seen.collect()}
            assert set(after) <= set(before)
            if name in ("line_dedup", "substring_dedup"):
                assert set(after) == set(before) and after != before
            elif name == "near_dedup":
                sets = {i: set(jaccard.shingles(t.encode()).tolist()) for i, t in before.items()}
                label = components(sets, brute_links(sets))
                assert set(after) == set(label.values())
    pieces = seen.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("of")).collect()
    assert {r.doc_id for r in pieces} == set(after) and all(r.n == r.of for r in pieces)
    assert pipe.run(spark, sf_dir).count() == seen.count()
