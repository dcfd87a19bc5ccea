"""Operators on single documents and on chunks: held against libraries and brute force, and edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from spanmill.llm import common, lines, packing, quality, sentencepieces, substrings, warc
from spanmill.llm.common import Scratch, keyed
from spanmill.llm.queries import oracle_sql, queries
from tests.conftest import same_rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 long, doc string, list string, c0 int, n_lines string, N_CHUNKS string, bucket int"
LONG = "word " * 200_000 + "end."
SENTENCES = "The quick brown fox jumps over the lazy dog near the river bank. " * 4


def odd_documents(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names could clash."""
    texts = {1: None, 2: "", 3: " \n\t \n", 4: LONG, 5: "é" * 5000 + "\n\U0001f600 x\n\ny", 6: "same line\nsame line\nsame line\nsame line\n" * 9, 7: "one", 8: SENTENCES, 9: SENTENCES, 11: "x" * 30_000 + "漢字" * 5000, None: SENTENCES}
    rows = [(k, t, None, None, None, 7, "d", "l", 0, "x", "y", 3) for k, t in texts.items()]
    return spark.createDataFrame([*rows, rows[-3], rows[-3]], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, duck, sf_dir, name):
    same_rows(queries()[name](spark, sf_dir), duck.sql(oracle_sql()[name]))


def test_quality_oddities(spark):
    rows = quality.clean(odd_documents(spark)).collect()
    assert len(rows) == 13
    by = {r.doc_id: r for r in rows}
    assert by[1].n_words == by[2].n_words == by[3].n_words == 0 and by[1].base_failed and not by[1].kept
    assert by[4].n_words == 200_001 and by[4].base_failed
    assert by[6].n_dup_lines == 35
    assert quality.clean(empty(spark)).count() == 0
    kept = quality.filter_documents(odd_documents(spark))
    assert kept.columns == odd_documents(spark).columns and {r.doc_id for r in kept.collect()} <= set(by)


def test_quality_stage_removes_failing_lines(spark, sf_dir):
    import corpus_pipeline

    good = "The dog went to the river, and the fox stayed where it was before, near the old stone bridge of the town."
    more = "Later that day a heavy rain fell on all the fields, so both of them went home and slept until noon."
    rows = [(1, f"{good}\nHome | About | Contact | Help\n\n{more}", 999), (2, "Home | About | Contact | Help", 29), (3, None, None), (4, good, len(good))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    text = f"{good}\n\n{more}"
    out = corpus_pipeline.quality_rules(spark, docs, sf_dir)
    assert out.schema == docs.schema and sorted(map(tuple, out.collect())) == [(1, text, len(text)), (4, good, len(good))]


def test_quality_bounds_all_lost_words(spark, sf_dir):
    import corpus_pipeline

    licence = "Licensed under the Apache License, Version 2.0 of that year, too."
    menu = "Home | About | Contact | Help | Shop | News | Jobs | Terms"
    own = "The dog went to a river, and the fox stayed where it was before, near an old stone bridge of that town."
    docs = spark.createDataFrame([(1, f"{licence}\n{menu}"), (2, f"{licence}\n{own}")], "doc_id long, text string")
    assert not quality.judge(f"{licence}\n{menu}".encode(), quality.LineRules())[6]
    assert [(r.doc_id, r.text) for r in corpus_pipeline.quality_rules(spark, docs, sf_dir).collect()] == [(2, own)]


def test_quality_sql_on_many_scripts(spark, duck):
    """The operator and its SQL agree on texts of several scripts, whose words end in all kinds of characters."""
    r = random.Random(8)
    bits = ["the", "end\u01a6", "\u00e6", "\u0926\u0947\u0936\u0964", "\u6f22\u5b57\u3002", "\u043c\u0438\u0440", "\u0633\u0644\u0627\u0645\u061f", "wait\u2026", "a,", "stop.", "x|", "|", ">", "\u00bb", "no!!", "Privacy Policy", "all rights reserved", "Back to top", "Copyright 2020", "#a#", "b**", "\u00e9t\u00e9", "word"]
    texts = ["\n".join(" ".join(r.choice(bits) for _ in range(r.choice([0, 2, 5, 14, 25]))) for _ in range(r.randrange(1, 6))) for _ in range(300)]
    texts += [" ".join(["word"] * 3 + [f"w{k}" for k in range(20)] + [end]) for end in ("end\u01a6", "\u00e6", "\u0926", "\u0964", "\u2026", "plain")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    same_rows(quality.clean(docs, with_text=False).drop("cleaned"), con.sql(oracle_sql()["op5_quality_rules"]))


@pytest.mark.parametrize("seed", range(20))
def test_repeated_words(seed):
    r = random.Random(seed)
    ids = [r.randrange(3) for _ in range(r.randrange(60))]
    seen = defaultdict(list)
    for i in range(len(ids) - 7):
        seen[tuple(ids[i : i + 8])].append(i)
    marked = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    assert quality.repeated_words(ids) == len(marked)


def test_line_rules():
    rules = quality.LineRules()
    verdict = lambda s: quality.line_verdict(s.encode(), s.encode().split(), rules)
    assert verdict("Home | About | Contact | Help") == "navigation"
    assert verdict("Licensed under the Apache License, Version 2.0.") == "boilerplate"
    assert {verdict(s) for s in ("(c) 2004. Alle Rechte vorbehalten.", "© Tous droits réservés.", "Aviso legal y Política de privacidad.")} == {"boilerplate"}
    assert verdict("a*** b%%% c&&& d### e$$$ f") == "punctuation"
    assert verdict("The dog went to the river, and the fox stayed where it was before.") == ""
    assert verdict("A heading") == ""
    assert verdict("The privacy policy debate of the year made headlines, and the minister said so") == ""
    assert {verdict(s) for s in ("Accept all cookies to continue.", "Copyright 2020 by the authors.", "Back to top")} == {"boilerplate"}
    assert verdict(" ".join(f"w{k}" for k in range(22)) + " end\u01a6") == "punctuation"  # ends in a byte of the ellipsis
    assert verdict(" ".join(f"\u092f\u0939{k}" for k in range(14)) + " \u0939\u0948\u0964") == "" and verdict(" ".join(f"\u5b57{k}" for k in range(14)) + "\u5b57\u3002") == ""


def test_packing(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = defaultdict(list)
    rows = queries()["op10_packing"](spark, sf_dir).collect()
    for r in rows:
        found[r.doc_id].append(r)
        assert r.length & (r.length - 1) == 0 and r.length <= 4096 and r.offset == 0
    assert len({r.sequence_id for r in rows}) == len(rows)
    for k, text in texts.items():
        ids, at = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4"), 0
        for r in sorted(found[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_packing_words():
    table = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    r, parts = random.Random(3), ["'s", "don't", "é", "İ", "Σ", "ΑΣ", "<|endoftext|>", "A", "b", "12", " ", "\x1c", "\x85", "!?", ".", ",", "ª", "ẞ", "漢", "\U0001f600", "́", "\xa0", "\n", "\t", " ", " ", "ing"]
    for _ in range(2000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(15)))
        assert np.frombuffer(table.text(text.encode()), "<u4").tolist() == table.encode(text)


def test_packing_oddities(spark, tmp_path):
    pieces = packing.pack(odd_documents(spark), public_tokenizers.path("word_bpe_49k.json"))
    by = defaultdict(list)
    for r in pieces.collect():
        by[r.doc_id].append(r)
    assert [bytes(r.ids) for r in by[1]] == [bytes(r.ids) for r in by[2]] == [(2).to_bytes(4, "little")]
    assert sum(r.length for r in by[4]) == by[4][0].doc_tokens and max(r.length for r in by[4]) == 4096
    assert len(by[9]) == 3 * len(by[8])
    packing.write_buckets(pieces, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == pieces.count()
    assert packing.pack(empty(spark), public_tokenizers.path("word_bpe_49k.json")).count() == 0
    with pytest.raises(ValueError):
        packing.pack(empty(spark), "", max_length=1000)


def test_sentencepieces(spark, sf_dir, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in queries()["op9_sentencepieces"](spark, sf_dir).collect():
        ids = [library.bos_id(), *library.encode(texts[r.doc_id] or ""), library.eos_id()]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_sentencepieces_oddities(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepieces.MergePrefixEncoder(path)
    r, letters = random.Random(1), "  ▁\n\tabething.,é%漢\U0001f600\x00<s>0xA"
    for k in range(4000):
        text = "".join(r.choice(letters) for _ in range(r.randrange(40))) if k % 2 else " " * r.randrange(20) + r.choice(["the", "x", "", "é"]) + " " * r.randrange(40) + r.choice(["ing", "\n", " a"])
        ids = np.frombuffer(own.encode(text.encode()), "<u4").tolist()
        assert ids == library.encode(text), repr(text)
        assert own.decode([1, *ids, 2]).decode() == library.decode([1, *ids, 2])
    rows = sentencepieces.encode_decode(odd_documents(spark), path).collect()
    assert len(rows) == 13 and {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {2}
    assert next(bytes(r.decoded).decode() for r in rows if r.doc_id == 4) == LONG
    assert sentencepieces.encode_decode(empty(spark), path).count() == 0


def test_archive(spark, tmp_path):
    rows = [(1, "u1", "abc"), (2, "u\r\n2", "abc"), (3, None, None), (4, "", ""), (5, "u5", "x" * 300_000), (7, "u7", "dup"), (6, "u6", "dup"), (6, "u6", "dup"), (None, "n", "abc"), (None, "n", "solo")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, sha256 string")
    archive = warc.Archive.write(pages, str(tmp_path / "a"))
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in archive.summary().collect()), key=repr)
    assert got == sorted([(1, 3, "response", None), (2, 3, "revisit", 1), (3, 0, "response", None), (4, 0, "revisit", 3), (5, 300_000, "response", None), (7, 3, "revisit", 6), (6, 3, "response", None), (6, 3, "response", None), (None, 3, "revisit", 1), (None, 4, "response", None)], key=repr)
    assert sorted(((r.page_id, bytes(r.payload).decode()) for r in archive.read().select("page_id", "payload").collect()), key=repr) == sorted(((k, h or "") for k, _, h in rows), key=repr)
    assert archive.payloads().count() == 5
    whole = archive.original().collect()
    assert len({r.header.split("WARC-Record-ID: ")[1].split("\r")[0] for r in whole}) == len(rows)
    original = {r.page_id: bytes(r.record) for r in whole if r.page_id}
    assert original[5].startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and b"\r\nWARC-Date: 20" in original[5] and b"\r\nWARC-Target-URI: u%0D%0A2\r\n" in original[2] and b"Content-Length: 300000\r\n\r\nxxx" in original[5] and original[5].endswith(b"x\r\n\r\n")
    assert b"WARC-Refers-To: " + original[1].split(b"WARC-Record-ID: ")[1].split(b"\r\n")[0] + b"\r\n" in original[2] and original[2].endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")
    assert warc.Archive.write(pages.limit(0), str(tmp_path / "e")).summary().count() == 0
    spark.createDataFrame([(bytes(32), b"forged")], "sha256 binary, payload binary").write.mode("append").parquet(str(tmp_path / "a" / "payloads"))
    with pytest.raises(Exception, match="digest"):
        archive.payloads().collect()


def expected_texts(module, texts):
    held = defaultdict(set)
    for k, t in texts.items():
        for g in module.chunk_digests(t):
            held[g].add(k)
    shared = defaultdict(dict)
    for g, ks in held.items():
        if len(ks) > 1:
            for k in ks:
                shared[k][g] = k != min(ks)
    return {k: module.cleaned(t, shared[k])[0].decode() for k, t in texts.items()}


@pytest.mark.parametrize(("module", "name"), [(lines, "op3_line_dedup"), (substrings, "op2_substring_dedup")])
def test_chunks_against_brute_force(spark, sf_dir, texts, module, name):
    got = {r.doc_id: r.text for r in queries()[name](spark, sf_dir).collect()}
    assert got == expected_texts(module, {k: t.encode() for k, t in texts.items()})


@pytest.mark.parametrize("module", [lines, substrings])
def test_chunk_oddities(spark, module):
    docs = odd_documents(spark)
    out = module.deduplicate(docs)
    rows = out.collect()
    assert out.columns[: len(docs.columns)] == docs.columns and len({c.lower() for c in out.columns}) == len(out.columns) and len(rows) == 13
    by = {r.doc_id: r.text for r in rows}
    assert by[1] is None and by[2] == "" and by[8] == SENTENCES if module is lines else by[1] is None and by[2] == ""
    again = [r.text for r in rows if r.doc_id == 9]
    assert len(again) == 3 and len(set(again)) == 1  # rows that share an id are documents of their own, and 8 has their text first
    assert module.deduplicate(empty(spark)).count() == 0


@pytest.mark.parametrize(("window", "least"), [(64, 0.7), (256, 0.9)])
def test_substrings_recall(spark, sf_dir, texts, window, least):
    """Held against an oracle without chunks: bytes within a window that an earlier text has, or the text itself before.
    Most of them go, and a text without a repeated window of the shortest run that goes stays as it is."""
    own = substrings.MIN_RUN
    got = {r.doc_id: r for r in queries()["op2_substring_dedup"](spark, sf_dir).collect()}
    due = left = 0
    seen: dict[int, set[int]] = {window: set(), own: set()}
    for k, text in sorted((k, t.encode()) for k, t in texts.items()):
        covered = {}
        for n in {window, own}:
            marks = np.zeros(len(text) + 1, dtype=np.int64)
            first: dict[int, int] = {}
            for i in range(len(text) - n + 1):
                h = hash(text[i : i + n])
                if h in seen[n] or first.setdefault(h, i) + n <= i:
                    marks[i] += 1
                    marks[i + n] -= 1
            seen[n] |= first.keys()
            covered[n] = int((np.cumsum(marks)[:-1] > 0).sum())
        gone = len(text) - len(got[k].text.encode())
        assert gone == got[k].n_removed_bytes <= covered[own]
        due += covered[window]
        left += max(0, covered[window] - gone)
    assert due > 50_000 and left <= (1 - least) * due


def test_substrings_find_shifted_passages(spark):
    r = random.Random(5)
    words = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(n))
    passage = words(80)
    docs = spark.createDataFrame([(k, f"{words(40 + k)} {passage} {words(30)}") for k in range(6)] + [(10 + k, words(150)) for k in range(20)], "doc_id long, text string")
    rows = {x.doc_id: x for x in substrings.deduplicate(docs).collect()}
    source = {x.doc_id: x.text for x in docs.collect()}
    assert all(rows[k].text == source[k] for k in [0, *range(10, 30)])
    for k in range(1, 6):
        assert len(source[k]) - len(rows[k].text) > 0.6 * len(passage) and rows[k].n_repeated_chunks > 0


def test_boundaries_resist_insertions():
    r = random.Random(2)
    text = bytes(r.randrange(97, 123) for _ in range(4000))
    moved = text[:100] + b"inserted" + text[100:]
    a, b = {x for x in substrings.boundaries(text) if x > 200}, {x - 8 for x in substrings.boundaries(moved) if x > 208}
    assert a == b and len(a) > 30
    own = [f"line {r.random()}".encode() for _ in range(200)]
    chunks = lambda rows, held=lines.HELD: {b"\n".join(rows[i:j]) for i, j in lines.line_chunks(rows, held)}
    for held in (lines.HELD, 2):
        assert len(chunks(own, held) - chunks([*own[:20], b"new", *own[20:]], held)) <= 2
    assert [x for i, j in lines.line_chunks([b"a", b"", b"b", b""]) for x in range(i, j)] == [0, 1, 2, 3]


def run_lines_gone(texts):
    """The texts without each line in a run of two or more, one with a word, that an earlier text has or the text itself, before the run, by comparing all runs of lines."""
    out, earlier = {}, set()
    for k, text in sorted(texts.items()):
        rows = text.split("\n")
        runs = [(i, j, "\n".join(rows[i:j])) for i in range(len(rows)) for j in range(i + 2, min(i + 10, len(rows)) + 1)]
        first = {}
        for i, _, run in runs:
            first.setdefault(run, i)
        gone = {x for i, j, run in runs if run in earlier or run.strip() and first[run] + j - i <= i for x in range(i, j)}
        earlier |= {run for *_, run in runs if run.strip()}
        out[k] = "\n".join(row for x, row in enumerate(rows) if x not in gone)
    return out


def found_of(source, cleaned, expected):
    """(lines that went, of them in repeated runs, lines in repeated runs) by comparing texts only."""
    went = hit = due = 0
    for k, text in source.items():
        gone = Counter(text.split("\n")) - Counter(cleaned[k].split("\n"))
        want = Counter(text.split("\n")) - Counter(expected[k].split("\n"))
        went, hit, due = went + gone.total(), hit + (gone & want).total(), due + want.total()
    return went, hit, due


def test_lines_recall(spark):
    """Of the lines in repeated runs of two or more, found without chunks, at least nine in ten go; no others do."""
    folder = "/root/testdata/sf0.01"
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r.doc_id: r.text for r in queries()["op3_line_dedup"](spark, folder).collect()}
    expected = run_lines_gone(source)
    went, hit, due = found_of(source, got, expected)
    assert due > 300 and hit >= 0.9 * due and went - hit <= 0.01 * due
    # What goes rests on the boundaries: fewer of them find fewer short runs.
    docs = spark.createDataFrame(sorted(source.items()), "doc_id long, text string")
    sparse = {r.doc_id: r.text for r in lines.deduplicate(docs, held=1).collect()}
    assert sparse != got and found_of(source, sparse, expected)[1] < hit


def test_lines_find_copied_runs(spark):
    """Copied blocks of 2 to 8 lines inside otherwise different documents go but for lines at an end without a boundary; lines that repeat alone stay."""
    r = random.Random(11)
    own = lambda n: [f"line {r.random()}" for _ in range(n)]
    blocks = {n: own(n) for n in range(2, 9)}
    texts = {k: "\n".join([*own(r.randrange(1, 4)), *blocks[2 + k % 7], "", *own(r.randrange(1, 3)), "alone", *own(2)]) for k in range(70)}
    texts |= {100: "\n".join([blocks[8][0], "x", blocks[8][1], blocks[7][0], blocks[8][2]])}
    got = {x.doc_id: x for x in lines.deduplicate(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")).collect()}
    went, hit, due = found_of(texts, {k: x.text for k, x in got.items()}, run_lines_gone(texts))
    assert went == hit >= 0.9 * due
    assert all(got[k].n_removed_lines == 0 for k in [*range(7), 100])
    assert lines.cleaned(b"a\na\na\na\na", {}, held=10**9)[:3] == (b"a\na", 5, 3) and lines.cleaned(b"a\nb\nc\na\nb", {}, held=10**9)[0] == b"a\nb\nc"


def test_lines_compare_bytes(spark):
    """Chunks whose digests are equal but whose bytes are not stay."""
    a, b = "\n".join(f"first {i}" for i in range(40)), "\n".join(f"other {i}" for i in range(40))
    docs = spark.createDataFrame([(1, a), (2, a), (3, b)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed_lines for r in lines.deduplicate(docs).collect()}
    assert got == {1: 0, 2: 40, 3: 0}
    weak = {r.doc_id: (r.text, r.n_removed_lines) for r in lines.deduplicate(docs, digest=lambda chunk: bytes([len(chunk) % 251]) * 16).collect()}
    assert weak == {1: (a, 0), 2: (a, 0), 3: (b, 0)}
    alike = spark.createDataFrame([(1, a), (2, a)], "doc_id long, text string")  # of chunks alone in their length it takes the word
    assert lines.deduplicate(alike, held=1, digest=lambda chunk: bytes([len(chunk) % 251]) * 16).where("doc_id = 2").first().n_removed_lines == 40


@pytest.mark.parametrize("ids", ["none", "one", "mixed"])
@pytest.mark.parametrize("module", [lines, substrings])
def test_rows_without_ids_of_their_own(spark, module, ids):
    """Of rows that lack an id or share one each is a document: what several hold stays in one of them only, and no list outgrows its row."""
    r = random.Random(7)
    passage = "\n".join("".join(r.choice("abcdefgh") for _ in range(40)) for _ in range(5))
    rows = [({"none": None, "one": 3, "mixed": [None, 3, k][k % 3]}[ids], f"own {k} {r.random()}\n{passage if k % 2 else r.random()}\nend {r.random()}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    out = module.deduplicate(docs).collect()
    middle = passage.split("\n")[2]
    assert len(out) == 3000 and sum(middle in x.text for x in out) == 1
    assert Counter(x.doc_id for x in out) == Counter(k for k, _ in rows)
    assert sorted(x.text for x in out if x.n_removed_lines == 0) == sorted(t for _, t in rows if passage not in t or t in {x.text for x in out}) if module is lines else True


def test_keys_of_rows(spark):
    """Unique whole ids are the keys; else rows are numbered in the order of ids, those without one last."""
    with Scratch(spark, "test") as scratch:
        docs = spark.createDataFrame([(5, "a"), (9, "b"), (2, None)], "doc_id long, text string")
        assert sorted((x.c0, x.row) for x in keyed(docs, "doc_id", "text", scratch).collect()) == [(2, 2), (5, 5), (9, 9)]
        r = random.Random(3)
        ids = [r.choice([None, 7, r.randrange(50), -r.randrange(50)]) for _ in range(400)]
        docs = spark.createDataFrame([(k, str(i)) for i, k in enumerate(ids)], "doc_id long, text string").repartition(5)
        rows = sorted(keyed(docs, "doc_id", "text", scratch).collect(), key=lambda x: x.row)
        alike = spark.range(0, 20_000, 1, 8).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text").alias("text"))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few bytes would be merged
        try:
            dealt = [r[1] for r in keyed(alike, "doc_id", "text", Scratch(spark, "test")).groupBy(F.shiftright("row", 33)).count().collect()]
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert len(dealt) == 8 and max(dealt) < 5_000
        assert len({x.row for x in rows}) == 400 and [x.c0 for x in rows] == sorted(ids, key=lambda k: math.inf if k is None else k)


def test_hot_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    r = random.Random(1)
    many = spark.createDataFrame([(r.choice([0, 1, r.randrange(90)]), i) for i in range(600)], "k long, i long")
    few = many.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("least")).where("k % 7 <> 3")
    got = common.hot_join(many, few, ["k"])
    assert got.columns == ["k", "i", "least"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, many.join(few.drop("n"), "k").collect()))


def test_scratch(spark):
    with Scratch(spark, "test") as scratch:
        table = scratch.write(spark.range(5), "t")
        assert table.count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(scratch.path("t"))
