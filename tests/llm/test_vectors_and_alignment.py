"""Permutation index, vector codes and token alignment: held against brute force, and edge cases."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from spanmill.llm import alignment, codes, permutations
from spanmill.llm.queries import queries
from tests.llm.test_documents import empty, odd_documents

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def embeddings_of(spark, sf_dir):
    return [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_neighbours(rows, every, top):
    """(query's place, ids, scores) of each query, by all inner products, added up in order."""
    out = []
    for i, (qid, q) in enumerate(rows):
        if qid is None or qid % every:
            continue
        scores = []
        for j, (vid, v) in enumerate(rows):
            if i != j:
                s = 0.0
                for a, b in zip(q, v):  # of unlike lengths: what is missing counts as zeros
                    s += a * b
                scores.append((-s, math.inf if vid is None else vid))
        scores.sort()
        out.append((qid, scores[:top]))
    return out


def test_neighbours_exact_when_all_are_reranked(spark):
    """Copies, ties, repeated ids, odd vectors and clashing columns; with every candidate reranked the result is brute force's."""
    r = np.random.default_rng(0)
    x = r.standard_normal((260, 12)) * r.uniform(0.5, 3, (260, 1))
    x[30:90] = x[7]  # one vector many times
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(20, x[7].tolist()), (None, x[7].tolist()), (None, (2 * x[40]).tolist()), (500, x[5, :9].tolist()), (-20, x[11].tolist())]
    odd = [(600, None), (620, []), (640, [0.0] * 12), (660, [math.nan] * 12), (680, [1.0, None, *[0.0] * 10]), (700, [math.inf] * 12)]
    frame = spark.createDataFrame([(k, v, 1, "x") for k, v in rows + odd], "vec_id long, embedding array<double>, row int, block string")
    got = permutations.neighbours(frame, 20, top=5, pivots=16, prefix=8, least=1000, block_bytes=12 * 8 * 50).collect()
    by = defaultdict(list)
    for g in sorted(got, key=lambda g: g["rank"]):
        by[g.query_id].append((g["rank"], -g.score, math.inf if g.vec_id is None else g.vec_id))
    want = defaultdict(list)
    for qid, found in brute_neighbours(rows, 20, 5):
        want[qid] += [(k + 1, *f) for k, f in enumerate(found)]
    assert {k: sorted(v) for k, v in by.items()} == {k: sorted(v) for k, v in want.items()}
    assert not any(k >= 600 for k in by)
    assert permutations.neighbours(frame.limit(0), 20).count() == 0
    assert permutations.neighbours(frame.where("vec_id >= 600"), 20).count() == 0
    few = permutations.neighbours(frame.where("vec_id in (0, 1, 2)"), 20).collect()
    assert [(g.query_id, g["rank"]) for g in sorted(few, key=lambda g: g["rank"])] == [(0, 1), (0, 2)]


def test_footrule():
    """What is summed over the query's pivots orders vectors as the footrule distance of the prefixes does."""
    r, n, k = random.Random(2), 12, 6
    query = r.sample(range(n), k)
    place = lambda order, p: order.index(p) if p in order else k
    footrules, sums = [], []
    for _ in range(50):
        own = r.sample(range(n), k)
        footrules.append(sum(abs(place(own, p) - place(query, p)) for p in range(n)))
        sums.append(sum(max(place(own, p), s) for s, p in enumerate(query)))
    assert len({f - 2 * s for f, s in zip(footrules, sums)}) == 1


def recall(spark, folder):
    rows = [(k, v) for k, v, _ in embeddings_of(spark, folder) if good(v) and any(v)]
    ids, x = np.array([k for k, _ in rows]), np.array([v for _, v in rows], dtype=float)
    got = defaultdict(list)
    for g in queries()["op11_permutation_index"](spark, folder).collect():
        got[g.query_id].append((g["rank"], g.vec_id, g.score))
    hit = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        own = sorted(got[ids[i]])
        assert [k for k, _, _ in own] == list(range(1, min(20, len(ids) - 1) + 1)) and len({v for _, v, _ in own}) == len(own)
        assert all(abs(score - x[np.flatnonzero(ids == v)[0]] @ x[i]) < 1e-12 for _, v, score in own)
        assert [(-score, v) for _, v, score in own] == sorted((-score, v) for _, v, score in own)
        hit += len({v for _, v, _ in own} & set(best.tolist()))
        total += len(best)
    return hit / total


def test_recall(spark):
    """Over whole tables, of which the larger has vectors that aren't reranked."""
    assert recall(spark, "/root/testdata/sf0.01") >= 0.95
    assert recall(spark, "/root/testdata/sf0.1") >= 0.95


def brute_codes(rows, entries, rounds, parts=4):
    """Lloyd's rounds from scratch, in whole numbers."""
    width = -(-max(len(v) for _, v, _ in rows) // parts) * parts
    size = width // parts
    x = [[math.floor(1024 * c) for c in v] + [0] * (width - len(v)) for _, v, _ in rows]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, x[i]))[:entries]
    books = [[x[i][p * size : (p + 1) * size] for i in first] for p in range(parts)]

    def nearest(v, book):
        far = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in book]
        return far.index(min(far)), min(far)

    for k in range(rounds + 1):
        found = [[nearest(v[p * size : (p + 1) * size], books[p]) for p in range(parts)] for v in x]
        if k == rounds:
            break
        for p in range(parts):
            own = defaultdict(list)
            for v, f in zip(x, found):
                own[f[p][0]].append(v[p * size : (p + 1) * size])
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e])] if e in own else book for e, book in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(rows[i][0], "".join(f"{e:02x}" for e, _ in f), sum(d for _, d in f)) for i, f in enumerate(found)], sha


def test_codes_against_brute_force(spark):
    """Copies, ties, repeated and null ids, unlike lengths, odd vectors; sums from changes are those from all."""
    r = np.random.default_rng(1)
    x = np.round(r.standard_normal((150, 10)), 1)
    x[20:60] = x[3]
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(3, x[9].tolist(), None), (None, x[10].tolist(), None), (900, x[5, :7].tolist(), 1), (-4, [-0.1] * 10, 2), (901, [], 2)]
    odd = [(902, None, 1), (903, [math.nan] * 10, 1), (904, [None, *[1.0] * 9], 1), (905, [-math.inf] * 10, 1)]
    frame = spark.createDataFrame([(*row, "a", 1) for row in rows + odd], "vec_id long, embedding array<double>, label int, code string, error int")
    for entries in (9, 256):
        got = codes.compress(frame, entries=entries)
        want, sha = brute_codes(rows, entries, codes.ROUNDS)
        assert Counter((g.vec_id, g.code.hex(), g.error) for g in got.rows.collect()) == Counter(want)
        assert got.sha256() == sha
    near = {g.vec_id: g.embedding for g in got.decoded().collect()}
    assert max(abs(a - b) for a, b in zip(near[30], x[30])) < 0.2
    assert codes.compress(frame.limit(0)) is None and codes.compress(frame.where("vec_id in (902, 903)")) is None
    with pytest.raises(ValueError, match="components must be less"):
        codes.compress(spark.createDataFrame([(1, [1e9] * 4, 0)], "vec_id long, embedding array<double>, label int"))


def test_codes_shuffle_changes_only(spark):
    """Once no part changes its entry, a round has nothing to shuffle."""
    frame = spark.createDataFrame([(i, [float(i % 4)] * 8, 0) for i in range(64)], "vec_id long, embedding array<double>, label int")
    books = np.arange(4, dtype=np.int64)[None, :, None] * np.full((4, 1, 2), 1024)
    rows, width = codes.integers(frame, codes.Scratch(spark, "test"), 4, 1024, "vec_id", "embedding", "label")
    once = codes.assigned(rows, books).cache()
    assert codes.changes(once, 4, 4, width).where("at = -1").agg(F.sum("value")).first()[0] == 64 * 4
    assert codes.changes(codes.assigned(once, books), 4, 4, width).count() == 0


def brute_alignment(texts):
    """n_a, n_b, n_groups, n_links, n_best, count_sum, digest of each text by the libraries and loops over all pairs of a group."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    letters = alignment.byte_letters()
    special = "<|endoftext|>"

    def spans(pieces):
        at, out = 0, []
        for p in pieces:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    docs, counts = [], Counter()
    for text in texts:
        if not text:
            docs.append(None)
            continue
        want = (" " + text).encode()
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        ap = [special.encode() if a.id_to_token(i) == special else bytes(letters[c] for c in a.id_to_token(i)) for i in x]
        bp = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if b"".join(ap) != want or b"".join(bp) != want:
            docs.append(None)
            continue
        a_spans, b_spans = spans(ap), spans(bp)
        cuts = sorted({e for _, e in a_spans} & {e for _, e in b_spans})
        groups, links, i, j = [], [], 0, 0
        for cut in cuts:
            k, m = i, j
            while i < len(x) and a_spans[i][1] <= cut:
                i += 1
            while j < len(y) and b_spans[j][1] <= cut:
                j += 1
            groups.append((x[k:i], y[m:j]))
            links += [(x[p], y[q]) for p in range(k, i) for q in range(m, j) if a_spans[p][0] < b_spans[q][1] and b_spans[q][0] < a_spans[p][1]]
        docs.append((x, y, groups, links))
        counts.update(links)
    most = defaultdict(int)
    for (_, q), n in counts.items():
        most[q] = max(most[q], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        x, y, groups, links = d
        said = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        out.append((len(x), len(y), len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(said.encode()).hexdigest()))
    return out


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_query(spark, sf_dir):
    """The whole table by the libraries and by loops."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = Counter((r.doc_id, *w) for r, w in zip(rows, brute_alignment([r.text for r in rows]), strict=True))
    got = queries()["op13_alignment"](spark, sf_dir)
    assert got.columns == ["doc_id", *FIELDS]
    assert Counter(tuple(g) for g in got.collect()) == want


@pytest.mark.parametrize("batch_units", [3, 1 << 20])
def test_alignment_oddities(spark, batch_units):
    """White space of all kinds, special tokens' strings, marks for spaces, many scripts; in parts or whole."""
    r = random.Random(5)
    bits = [" ", "\n", "  ", "\n\n", "\t", "\r", "a", "the", " don't", "12", "é", "▁", "漢字", "　", " ", "​", "<|endoftext|>", "<s>", "💩", "ह", "\x00", "\x1c", "\u0085", "﻿", ".", "!!", "aaaa" * 9]
    texts = ["".join(r.choice(bits[: 27 if k % 2 else 5] + bits[6:9]) for _ in range(r.randrange(1, 40))) for k in range(400)]
    frame = spark.createDataFrame([(k % 50 or None, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, row int, links string")
    got = alignment.align(frame, BYTE, PIECE, batch_units=batch_units).collect()
    assert Counter(tuple(g) for g in got) == Counter((k % 50 or None, *w) for k, w in enumerate(brute_alignment(texts)))


def test_alignment_of_odd_documents(spark):
    rows = odd_documents(spark).select("doc_id", "text").collect()
    got = alignment.align(odd_documents(spark), BYTE, PIECE).collect()
    assert Counter(tuple(g) for g in got) == Counter((r.doc_id, *w) for r, w in zip(rows, brute_alignment([r.text for r in rows]), strict=True))
    assert alignment.align(empty(spark), BYTE, PIECE).count() == 0


def test_alignment_splits_into_rows_of_a_text_or_a_unit(spark):
    """What a task hands to Spark has no row the size of a batch: a row is one text's places or one unit."""
    texts = [f"{w} und {w} oder {k}" for k, w in enumerate(["eins", "zwei", "drei"] * 100)]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    split = alignment.in_units(frame, BYTE, PIECE).cache()
    assert [len(r.places) for r in split.where("row is not null").collect()] == [5] * 300
    units = {r.unit: r.n for r in split.where("unit is not null").collect()}
    assert units == Counter(f" {w}" for t in texts for w in t.split())
    split.unpersist()


def test_alignment_shuffles_little(spark):
    """A unit's text is shuffled once, what goes back to a batch is packed: 1.4 times the texts' bytes here, with a row for each unit and batch 2.3 times."""
    r = random.Random(1)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(4000)]
    texts = [" ".join(words[int(4000 * r.random() ** 3)] for _ in range(300)) for _ in range(600)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)

    def shuffled():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {s.stageId(): s.shuffleWriteBytes() for s in map(stages.apply, range(stages.size()))}

    before = shuffled()
    assert len(alignment.align(frame, BYTE, PIECE, batch_bytes=1 << 16).collect()) == 600
    sent = sum(n for stage, n in shuffled().items() if stage not in before)
    assert 0 < sent < 1.8 * sum(map(len, texts))


@pytest.mark.parametrize("block_bytes", [1, 500, 1 << 20])
def test_alignment_blocks(monkeypatch, block_bytes):
    """However units are cut into blocks, each batch gets its own back: long texts, many homes, large counts."""
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block_bytes)
    r, want, units, place = random.Random(3), defaultdict(list), [], Counter()
    for k in range(200):
        text, counts = "7|8;" * r.choice([1, 3, 400]) + f"{k}|1", [r.choice([1, 127, 128, 1 << 40, (1 << 63) - 1]) for _ in alignment._COUNTS]
        homes = r.sample(range(40), r.choice([1, 2, 40]))
        units.append(([(b << 42 | 5 << alignment.PLACE_BITS) + place[b] for b in homes], text, *counts))
        for b in homes:
            place[b] += 1
            want[b].append((text, *counts))
    schema = pa.schema({"homes": pa.list_(pa.int64()), "text": pa.string()} | dict.fromkeys(alignment._COUNTS, pa.int64()))
    rows = pa.RecordBatch.from_pylist([dict(zip(schema.names, u, strict=True)) for u in r.sample(units, len(units))], schema)
    blocks = pa.Table.from_batches(list(alignment._blocks([rows.slice(0, 70), rows.slice(70, 0), rows.slice(70)])))
    assert set(blocks["home"].to_pylist()) == {b << 42 | 5 << alignment.PLACE_BITS for b in want}
    for b, own in want.items():
        counts, texts = alignment._from_blocks(blocks.filter(pc.equal(blocks["home"], b << 42 | 5 << alignment.PLACE_BITS)))
        assert list(zip(texts.to_pylist(), *(counts[c].tolist() for c in alignment._COUNTS), strict=True)) == own


def test_numbers_of_varying_length():
    values = np.array([0, 1, 127, 128, 16383, 16384, 1 << 35, (1 << 63) - 1, 5], dtype=np.int64)
    data, ends = alignment.varints(values)
    assert alignment.from_varints(data).tolist() == values.tolist()
    assert ends.tolist() == [1, 2, 3, 5, 7, 10, 16, 25, 26]
    assert alignment.from_varints(alignment.varints(values[:0])[0]).tolist() == []
