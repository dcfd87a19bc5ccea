"""Alignment of two tokenizers' tokens over the bytes of a text.

Python tokenises, once. Units are aligned by Spark's higher-order functions on arrays of token ends:
``array_intersect`` gives the offsets where both tokenizers end a token, ``sequence`` the tokens of one
that a token of the other overlaps, and ``transform`` makes groups and links.

Neither tokenizer has a token from what is no white space into the white space after it, so a text's
tokens are those of its units: white space and what follows it. Texts are cut into units first; each
unit of the corpus is tokenised and aligned once, counted times its occurrences, and comes back to the
batches of texts that have it, where each text's sums and digest are taken from its units'. A unit meets
its text once, with the list of its places in batches (homes); from there on a number stands for it, and
what goes back to a batch goes in blocks of many units.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, hot_join, own_cache, sliced
from .sentencepieces import MergePrefixEncoder

#: Bytes of the texts of a batch, and units of a batch: a longer text is cut into parts of so many.
BATCH_BYTES, BATCH_UNITS = 8 << 20, 1 << 22
#: A home's lowest bits are a unit's place in its batch, the next ones the batch's number in its task, the others the task's.
PLACE_BITS, NUMBER_BITS = 22, 20
#: Units that are tokenised at once.
LEARN = 2048
#: Bytes of units and of what is said of them that are dealt into blocks at once.
BLOCK_BYTES = 32 << 20
#: Pairs of ids with at least this share of all links are sent to all workers, so there are no more of them than its inverse.
HOT_PAIRS = 1 << 18

#: White space but for space and newline, and the mark for a space: beside these a run of spaces may be split otherwise.
_OTHER_SPACE = "[\t\r\x0b\x0c\x1c-\x1f\u0085\u00a0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u2581\u3000\ufeff]"

#: What a byte-level piece writes for each byte: itself if it is visible, else the next letter from 256 on.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    hidden = [b for b in range(256) if b not in set(_VISIBLE)]
    return {chr(b): b for b in _VISIBLE} | {chr(256 + k): b for k, b in enumerate(hidden)}


#: Stands for the ids of a text whose bytes a tokenizer doesn't give back.
UNLIKE = (b"", b"")


class TwoTokenizers:
    """Ids of a text by a byte-level BPE (A, of a space and the text) and by a sentencepiece BPE (B, which adds that space)."""

    def __init__(self, a_path: str, b_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        rules = MergePrefixEncoder(b_path)  # refuses models whose pieces span words or lines
        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        letters, special = byte_letters(), {i: t.content for i, t in self.a.get_added_tokens_decoder().items()}
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            self.a_bytes[i] = special[i].encode() if i in special else bytes(letters[c] for c in piece)
        self.b_bytes = rules.surface
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in table], dtype=np.int32) for table in (self.a_bytes, self.b_bytes))

    def both(self, spaced: list[bytes]) -> list[tuple[bytes, bytes]]:
        """A's and B's ids (little-endian uint32) of texts that are already preceded by their white space; UNLIKE if either's bytes aren't the text's."""
        texts, out = [x.decode() for x in spaced], []
        # Behind a line's end, which is a token of its own, no space is added.
        for own, a, b in zip(spaced, self.a.encode_batch(texts, add_special_tokens=False), self.b.encode(["\n" + t for t in texts], num_threads=1), strict=True):
            a, b = a.ids, b[2:]
            alike = b"".join([self.a_bytes[i] for i in a]) == own == b"".join([self.b_bytes[i] for i in b])
            out.append((array("I", a).tobytes(), array("I", b).tobytes()) if alike else UNLIKE)
        return out


def unit_starts(data: np.ndarray, starts: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """Where units begin in texts that follow each other, each preceded by a space: at white space after what is none.
    Texts that are ``odd`` only have them where a single space parts visible ASCII characters."""
    space = (data == 32) | (data == 10)
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    if odd.any():
        plain = (data > 32) & (data < 127)
        alone = np.zeros(len(data), dtype=bool)
        alone[1:-1] = (data[1:-1] == 32) & plain[:-2] & plain[2:]
        sizes = np.diff(np.append(starts, len(data)))
        begins &= alone | ~np.repeat(odd, sizes)
    begins[starts] = True
    return np.flatnonzero(begins)


_LOADED: dict[tuple[str, str], TwoTokenizers] = {}


def tokenizers(a_path: str, b_path: str) -> TwoTokenizers:
    own_cache("alignment", _LOADED.clear)
    if (a_path, b_path) not in _LOADED:
        _LOADED[a_path, b_path] = TwoTokenizers(a_path, b_path)
    return _LOADED[a_path, b_path]


#: A text's places of its units, or a unit of the batch at its place: rows of either kind, the other's columns null. Home: the batch, of a unit with its place.
_SPLIT = "home long, doc_id long, row long, part int, parts int, places {}, unit string, n long"


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def _split(home: np.ndarray, of_places: pa.DataType, **columns: pa.Array) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "row": pa.int64(), "part": pa.int32(), "parts": pa.int32(), "places": of_places, "unit": pa.string(), "n": pa.int64()}
    return pa.RecordBatch.from_pydict({"home": pa.array(home)} | {c: columns[c] if c in columns else pa.nulls(len(home), kind) for c, kind in kinds.items()})


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers from 0 on by seven bits a byte, lowest first, all but the last byte of each with the eighth set; and where each ends."""
    sizes = np.ones(len(values), dtype=np.int64)
    for k in range(7, 63, 7):
        if not (longer := values >= 1 << k).any():
            break
        sizes += longer
    ends = np.cumsum(sizes)
    out, starts = np.empty(int(sizes.sum()), dtype=np.uint8), ends - sizes
    for k in range(int(sizes.max(initial=0))):
        has = np.flatnonzero(sizes > k)
        out[starts[has] + k] = (values[has] >> 7 * k & 127) | np.where(sizes[has] > k + 1, 128, 0)
    return out, ends


def from_varints(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128) + 1
    starts = np.concatenate([[0], ends])[: len(ends)].astype(np.int64)
    sizes, out = ends - starts, np.zeros(len(ends), dtype=np.int64)
    for k in range(int(sizes.max(initial=0))):
        has = np.flatnonzero(sizes > k)
        out[has] |= (data[starts[has] + k].astype(np.int64) & 127) << 7 * k
    return out


def _batches(tokenizers: Callable[[], TwoTokenizers], home: Callable[[], int], doc_ids: pa.Array, rows: np.ndarray, texts: pa.Array, most: int, packed: bool) -> Iterator[pa.RecordBatch]:
    """For up to ``most`` units of the texts at a time, record batches of the texts' parts and of the distinct units, the most frequent first."""
    n = len(texts)
    has = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False)
    texts, wide = texts.filter(pa.array(has)).cast(pa.large_string()), lambda x: pa.scalar(x, pa.large_string())
    spaced = pc.binary_join_element_wise(wide(" "), texts, wide(""))
    odd = pc.match_substring_regex(spaced, _OTHER_SPACE).to_numpy(zero_copy_only=False)
    # White space that a tokenizer may not give back is rare; whole texts tell whether it does.
    whole = np.ones(len(spaced), dtype=bool)
    for i in np.flatnonzero(odd):
        whole[i] = tokenizers().both([spaced[int(i)].as_py().encode()])[0] != UNLIKE
    spaced, odd = spaced.filter(pa.array(whole)), odd[whole]
    has[np.flatnonzero(has)[~whole]] = False
    joined = np.frombuffer(b"".join(spaced.cast(pa.large_binary()).to_pylist()), dtype=np.uint8)
    sizes = pc.binary_length(spaced).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)])[: len(sizes)].astype(np.int64)
    at = unit_starts(joined, starts, odd) if len(starts) else np.zeros(0, dtype=np.int64)
    units = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.append(at, len(joined)).astype(np.int64)), pa.py_buffer(joined)]).dictionary_encode()
    place, counts = units.indices.to_numpy(), np.zeros(n, dtype=np.int64)
    counts[np.flatnonzero(has)] = np.diff(np.append(np.searchsorted(at, starts), len(place)))
    ends = np.cumsum(counts)
    parts = np.maximum(1, -(-ends // most) - (ends - counts) // most)
    for chunk in range(max(1, -(-len(place) // most))):
        low, high = chunk * most, min((chunk + 1) * most, len(place))
        # Texts without units go with the chunk where they would be.
        here = np.flatnonzero((ends - counts < high) & (ends > low) | (counts == 0) & (ends >= low) & ((ends < high) | (high == len(place))))
        times = np.bincount(place[low:high], minlength=len(units.dictionary))
        used = np.flatnonzero(times)
        used = used[np.argsort(-times[used], kind="stable")]
        rank = np.empty(len(times), dtype=np.int32)
        rank[used] = np.arange(len(used), dtype=np.int32)
        own, here_home = rank[place[low:high]], home()
        offsets = np.concatenate([[0], np.cumsum(np.clip(ends[here], low, high) - np.clip(ends[here] - counts[here], low, high))])
        part = np.maximum(0, chunk - (ends[here] - counts[here]) // most)
        if packed:
            data, at_byte = varints(own)
            ends_at = np.concatenate([[0], at_byte])[offsets].astype(np.int32)
            places = pa.Array.from_buffers(pa.binary(), len(here), [None, pa.py_buffer(ends_at), pa.py_buffer(data)])
        else:
            places = _lists(offsets, pa.array(own))
        yield _split(np.full(len(here), here_home), places.type, doc_id=doc_ids.take(pa.array(here)), row=pa.array(rows[here]), part=pa.array(part.astype(np.int32)), parts=pa.array(parts[here].astype(np.int32)), places=places)
        for at_once in range(0, len(used), 1 << 14):
            some = used[at_once : at_once + (1 << 14)]
            yield _split(here_home + np.arange(at_once, at_once + len(some)), places.type, unit=units.dictionary.take(pa.array(some)).cast(pa.string()), n=pa.array(times[some].astype(np.int64)))


def in_units(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES, batch_units: int = BATCH_UNITS, packed: bool = False) -> DataFrame:
    """Rows of batches: texts as places of their units (home, doc_id, row, part, parts, places), and the batch's distinct units with their occurrences (home, unit, n).

    A text of more than ``batch_units`` units is cut into parts. ``row`` names a document's row. What has no tokens has no units.
    ``packed`` gives the places as bytes (``varints``), of which frequent units have one or two.
    """
    if batch_units > 1 << PLACE_BITS:
        raise ValueError(f"a batch has {1 << PLACE_BITS} units at most")

    def run(batches):
        task, number = TaskContext.get().partitionId(), -1

        def home() -> int:
            nonlocal number
            number += 1
            if task >> (63 - PLACE_BITS - NUMBER_BITS) or number >> NUMBER_BITS:
                raise ValueError("more tasks, or batches of a task, than a home has bits for")
            return (task << NUMBER_BITS | number) << PLACE_BITS

        for batch in sliced(batches, 2, 1 << 16, batch_bytes):
            yield from _batches(lambda: tokenizers(a_path, b_path), home, batch.column(0), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2), batch_units, packed)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, _SPLIT.format("binary" if packed else "array<int>"))


def tokenised(units: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """unit, n, homes, a_ids, a_ends, b_ids, b_ends: ids and byte offsets of the ends of both tokenizers' tokens. A unit that a tokenizer doesn't give back is an error here: ``in_units`` leaves out the texts that have such."""

    def tokens(chunks: list[bytes], sizes: np.ndarray) -> tuple[pa.Array, pa.Array]:
        counts = np.array([len(c) // 4 for c in chunks], dtype=np.int64)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        ids = np.frombuffer(b"".join(chunks), dtype="<i4")
        ends = np.cumsum(sizes[ids], dtype=np.int64)
        ends -= np.repeat(np.concatenate([[0], ends])[offsets[:-1]], counts)
        return _lists(offsets, pa.array(ids)), _lists(offsets, pa.array(ends.astype(np.int32)))

    def run(batches):
        both = tokenizers(a_path, b_path)
        for batch in sliced(batches, 0, LEARN):
            found = both.both([u.encode() for u in batch.column(0).to_pylist()])
            if UNLIKE in found:
                raise ValueError("a tokenizer doesn't give back a text without odd white space")
            yield pa.RecordBatch.from_arrays([*batch.columns, *tokens([a for a, _ in found], both.a_sizes), *tokens([b for _, b in found], both.b_sizes)], names=["unit", "n", "homes", "a_ids", "a_ends", "b_ids", "b_ends"])

    return units.select("unit", "n", "homes").mapInArrow(run, "unit string, n long, homes array<long>, a_ids array<int>, a_ends array<int>, b_ids array<int>, b_ends array<int>")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it within its own functions."""
    return F.get(F.transform(F.array(value), use), 0)


def owners(ends: Column) -> Column:
    """For each byte the place of the token that holds it."""
    return F.flatten(F.transform(ends, lambda e, k: F.array_repeat(k, e - F.coalesce(F.get(ends, k - 1), F.lit(0)))))


def aligned(unit: Column) -> Column:
    """groups (a, b: ids between two offsets where both end a token) and links (A's id times 2^32 plus B's, for each two tokens that share a byte) of a unit."""
    a_ids, a_ends, b_ids, b_ends = (unit[c] for c in ("a_ids", "a_ends", "b_ids", "b_ends"))

    def between(ids: Column, own: Column, start: Column, end: Column) -> Column:
        return F.transform(F.sequence(F.get(own, start), F.get(own, end - 1)), lambda k: F.get(ids, k))  # ``slice`` reads all its array each time

    def groups(cuts: Column, own_a: Column, own_b: Column) -> Column:
        def group(cut: Column, k: Column) -> Column:
            start = F.coalesce(F.get(cuts, k - 1), F.lit(0))
            return F.struct(between(a_ids, own_a, start, cut).alias("a"), between(b_ids, own_b, start, cut).alias("b"))

        return F.transform(cuts, group)

    def links(own_b: Column) -> Column:
        def of(a: Column, k: Column) -> Column:
            overlapped = F.sequence(F.get(own_b, F.coalesce(F.get(a_ends, k - 1), F.lit(0))), F.get(own_b, F.get(a_ends, k) - 1))
            return F.transform(overlapped, lambda j: pair(a, F.get(b_ids, j)))

        return F.flatten(F.transform(a_ids, of))

    pair = lambda a, b: F.shiftleft(a.cast("long"), 32) + b
    kind = F.struct(F.array(F.struct(a_ids.alias("a"), b_ids.alias("b"))).alias("groups"), F.flatten(F.transform(a_ids, lambda a: F.transform(b_ids, lambda b: pair(a, b)))).alias("links"))
    many = let(
        F.struct(F.array_intersect(a_ends, b_ends).alias("cuts"), owners(a_ends).alias("own_a"), owners(b_ends).alias("own_b")),
        lambda x: F.struct(groups(x["cuts"], x["own_a"], x["own_b"]).alias("groups"), links(x["own_b"]).alias("links")),
    )
    # A unit that is one token of either tokenizer is one group, in which all overlap.
    return F.when((F.size(a_ids) == 1) | (F.size(b_ids) == 1), kind).otherwise(many)


def group_text(groups: Column) -> Column:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group."""
    return F.array_join(F.transform(groups, lambda g: F.concat(F.array_join(g["a"].cast("array<string>"), ","), F.lit("|"), F.array_join(g["b"].cast("array<string>"), ","))), ";")


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, n (its links), best (no pair of its B id has more), rows, of rows (pair, n). The counts of B's ids are as many as B has ids."""
    counts = links.groupBy("pair").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    b = F.col("pair").bitwiseAND((1 << 32) - 1)
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return counts.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"), "rows")


_COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


#: Units of one batch, in the order of their places: how many, and as compressed bytes their numbers (steps between places, sizes of texts, _COUNTS) and texts.
_BLOCK = "home long, rows int, numbers_size int, numbers binary, said_size int, said binary"


def _lengths(length: Callable[[pa.Array], pa.Array], column: pa.Array) -> np.ndarray:
    return length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def _squeezed(data: np.ndarray | pa.Buffer) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units (homes, text, _COUNTS) dealt to the batches that have them, as blocks."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += int((_lengths(pc.list_value_length, batch["homes"]) * (64 + _lengths(pc.binary_length, batch["text"]))).sum())
        if size >= BLOCK_BYTES:
            yield from _pieces(held)
            held, size = [], 0
    if held:
        yield from _pieces(held)


def _pieces(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for units in pa.Table.from_batches(held).combine_chunks().to_batches():
        homes = pc.list_flatten(units["homes"]).to_numpy()
        unit = np.repeat(np.arange(units.num_rows), _lengths(pc.list_value_length, units["homes"]))
        ends, at = np.cumsum(64 + _lengths(pc.binary_length, units["text"])[unit]), 0
        while at < len(homes):  # a unit of a long text and many homes is cut, too
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 2 * BLOCK_BYTES, side="right")))
            yield _dealt(homes[at:to], unit[at:to], units)
            at = to


def _dealt(homes: np.ndarray, unit: np.ndarray, units: pa.RecordBatch) -> pa.RecordBatch:
    order = np.argsort(homes)
    homes, unit = homes[order], unit[order]
    batch, said = homes >> PLACE_BITS, units["text"].cast(pa.large_string()).take(pa.array(unit))
    sizes = _lengths(pc.binary_length, said)
    said_ends, data = np.concatenate([[0], np.cumsum(sizes)]), said.buffers()[2]
    starts = np.flatnonzero(np.concatenate([[True], batch[1:] != batch[:-1]]))
    steps = np.diff(homes, prepend=0)
    steps[starts] = homes[starts] & (1 << PLACE_BITS) - 1
    columns = [steps, sizes, *(units[c].to_numpy()[unit] for c in _COUNTS)]
    made = []
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(homes)], strict=True):
        numbers = varints(np.concatenate([c[start:end] for c in columns]))[0]
        low, high = int(said_ends[start]), int(said_ends[end])
        made.append((int(batch[start]) << PLACE_BITS, end - start, len(numbers), _squeezed(numbers), high - low, _squeezed(data.slice(low, high - low))))
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]
    names = ["home", "rows", "numbers_size", "numbers", "said_size", "said"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=names)


def _from_blocks(blocks: pa.Table) -> tuple[dict[str, np.ndarray], pa.Array]:
    """A batch's units in the order of their places: _COUNTS and texts."""
    columns, said = [np.zeros((2 + len(_COUNTS), 0), dtype=np.int64)], []
    for block in blocks.select(["rows", "numbers_size", "numbers", "said_size", "said"]).to_pylist():
        numbers = from_varints(np.frombuffer(pa.decompress(block["numbers"], block["numbers_size"], codec="zstd"), dtype=np.uint8)).reshape(-1, block["rows"])
        numbers[0] = np.cumsum(numbers[0])
        columns.append(numbers)
        said.append(pa.decompress(block["said"], block["said_size"], codec="zstd", asbytes=True))
    places, sizes, *counts = np.concatenate(columns, axis=1)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    texts = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(b"".join(said))])
    order = np.argsort(places)
    return {c: x[order] for c, x in zip(_COUNTS, counts, strict=True)}, texts.take(pa.array(order))


def _gathered(texts: pa.Table, blocks: pa.Table) -> pa.Table:
    """A batch's texts with the sums over their units, and the digest of their units' groups (of a part: the groups themselves)."""
    places = texts["places"].to_pylist()
    data = np.frombuffer(b"".join(places), dtype=np.uint8)
    bounds = np.concatenate([[0], np.cumsum(data < 128)])[np.concatenate([[0], np.cumsum([len(p) for p in places])]).astype(np.int64)].astype(np.int64)
    own, (counts, groups) = from_varints(data), _from_blocks(blocks)
    sums = {}
    for c in _COUNTS:
        run = np.concatenate([[0], np.cumsum(counts[c][own])])
        sums[c] = pa.array((run[bounds[1:]] - run[bounds[:-1]]).astype(np.int64))
    groups = pc.binary_join_element_wise(groups, pa.scalar(";", pa.large_string()), pa.scalar("", pa.large_string()))
    said = groups.take(pa.array(own)) if len(own) else pa.array([], pa.large_string())
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(said).to_numpy(zero_copy_only=False))]).astype(np.int64)[bounds]
    data = memoryview(said.buffers()[2] or b"")
    digests, kept = [], []
    for start, end, parts in zip(ends[:-1].tolist(), ends[1:].tolist(), texts["parts"].to_pylist(), strict=True):
        one = data[start : end - 1] if end > start else None
        digests.append(("" if one is None else hashlib.sha256(one).hexdigest()) if parts == 1 else None)
        kept.append(bytes(one).decode() if parts > 1 and one is not None else None)
    return pa.table({c: texts[c] for c in ("doc_id", "row", "part", "parts")} | sums | {"digest": pa.array(digests, pa.string()), "text": pa.array(kept, pa.string())})


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None, batch_bytes: int = BATCH_BYTES, batch_units: int = BATCH_UNITS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of ``docs``.

    Texts that are null or empty, or whose joined token bytes differ from a space and the text, have no
    tokens: zeros and an empty digest. Rows that repeat or lack an id are documents each by themselves.
    Ids are integers; other columns are not read. An empty table gives an empty one.

    A unit is counted before the shuffle, in its batch, so a word of a third of all texts is a row a
    batch. Id pairs are counted from distinct units times their occurrences. A unit's list of homes is as
    long as there are batches that have it. What comes back to a batch is its distinct units, in blocks,
    and no row or group is larger than what a batch has.
    """
    scratch = scratch or Scratch(docs.sparkSession, "alignment")
    split = scratch.write(in_units(docs, a_path, b_path, id_col, text_col, batch_bytes, batch_units, packed=True), "split")
    units = split.where("unit is not null").groupBy("unit").agg(F.sum("n").alias("n"), F.collect_list("home").alias("homes"))
    found = tokenised(units, a_path, b_path).withColumn("x", aligned(F.struct("a_ids", "a_ends", "b_ids", "b_ends")))
    size = lambda c, name: F.size(c).cast("long").alias(name)
    counted = (size("a_ids", "n_a"), size("b_ids", "n_b"), size("x.groups", "n_groups"), size("x.links", "n_links"))
    found = found.select(F.monotonically_increasing_id().alias("own"), "n", "homes", *counted, group_text(F.col("x.groups")).alias("text"), F.col("x.links").alias("links"))
    found = scratch.write(found, "units")  # from here on its own number stands for a unit
    links = found.select("own", "n", F.explode("links").alias("pair"))
    pairs = scratch.write(pair_counts(links), "pairs")
    weighed = hot_join(links.select("own", "pair"), pairs, ["pair"], "rows", HOT_PAIRS)
    sums = weighed.groupBy("own").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("n").alias("count_sum"))
    back = found.drop("n", "links").join(sums, "own").select("homes", "text", *_COUNTS).mapInArrow(_blocks, _BLOCK)
    texts = split.where("row is not null").select("home", "doc_id", "row", "part", "parts", "places")
    kinds = f"doc_id long, row long, part int, parts int, {', '.join(f'{c} long' for c in _COUNTS)}, digest string, text string"
    out = scratch.write(texts.groupBy("home").cogroup(back.groupBy("home")).applyInArrow(_gathered, kinds), "gathered")
    whole = out.where("parts = 1").select("doc_id", *_COUNTS, "digest")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"])
    cut = out.where("parts > 1").groupBy("row").agg(F.first("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in _COUNTS), F.sha2(F.array_join(in_order, ";"), 256).alias("digest"))
    return whole.unionByName(cut.drop("row")).withColumnRenamed("digest", "groups_sha256")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
