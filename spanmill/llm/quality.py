"""Line-first cleaning: rules judge each line, failing lines go, and a text that loses too much goes whole."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, documents, own_cache, sliced, table_batches

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30


@dataclass(frozen=True)
class LineRules:
    """What a line must satisfy, and how much of a text may go."""

    #: A line of this many words or more has to have a word that ends in one of ``_TERMINALS`` among its last so many.
    punctuated_from: int = 12
    #: A line is navigation if this share of its words, at least this many, are separators.
    min_separators: int = 3
    separator_share: float = 0.2
    #: A line is noise if words that end in a run of symbols, shouted words or words that repeat the one before make up this share of it.
    noisy_share: float = 0.5
    #: A line is boilerplate if it holds one of these phrases, with A-Z in lower case. How often a line recurs in the corpus doesn't tell: prose has lines more frequent than notices.
    boilerplate: tuple[str, ...] = (
        *("licensed under", "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "click here", "sign up for", "subscribe to our", "powered by", "skip to content", "accept all cookies", "back to top", "copyright 19", "copyright 20", "copyright ©", "copyright (c)"),
        *("alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung"),
        *("tous droits réservés", "politique de confidentialité", "mentions légales"),
        *("todos los derechos reservados", "política de privacidad", "aviso legal"),
    )
    #: A phrase is boilerplate in a line whose words it makes up this share of at least: a longer sentence may speak of a privacy policy.
    phrase_share: float = 1 / 6
    #: A text is rejected if more than this share of its words went.
    max_removed: float = 0.5


#: What closes a sentence or a clause, in several scripts.
_TERMINALS = tuple(c.encode() for c in ".!?:;,\"')]}…。！？।؟۔”’»")
_SEPARATORS = frozenset([b"|", b">", b"<", b"/", b"-", b"*", b"\xc2\xbb", b"\xe2\x80\xba", b"\xe2\x80\xa2", b"\xc2\xb7"])
_SYMBOLS = b"#*$%&|<>"
_TRIMMED = b".,;:!?\"'()"


def line_verdict(line: bytes, words: list[bytes], rules: LineRules) -> str:
    """"" for a line that stays, else the rule that it fails. Lines without a word stay."""
    n = len(words)
    if not n:
        return ""
    low = line.lower()
    if any(p in low and k >= rules.phrase_share * n for p, k in _phrases(rules)):
        return "boilerplate"
    bars = 0
    if b"|" in line or b">" in line or b" - " in line or b" / " in line or b" * " in line or b"\xc2" in line or b"\xe2" in line:
        bars = sum(map(_SEPARATORS.__contains__, words))
    if bars >= rules.min_separators and bars >= rules.separator_share * n or bars and n <= 8 and bars >= 0.25 * n:
        return "navigation"
    if line.translate(None, _SYMBOLS) != line:
        noisy = sum(1 for w in words if w.rstrip(_TRIMMED)[-2:].strip(_SYMBOLS) == b"" and len(w) > 1)
        if n >= 4 and noisy >= rules.noisy_share * n:
            return "punctuation"
    if n >= 4 and b"!!" in line and sum(1 for w in words if w.endswith(b"!!")) >= rules.noisy_share * n:
        return "punctuation"
    if n >= 8 and sum(map(bytes.__eq__, words[1:], words)) >= rules.noisy_share * n:
        return "punctuation"
    if n >= rules.punctuated_from and not any(w.endswith(_TERMINALS) for w in words[-rules.punctuated_from :]):
        return "punctuation"
    return ""


_PHRASES: dict[LineRules, tuple[tuple[bytes, int], ...]] = {}


def _phrases(rules: LineRules) -> tuple[tuple[bytes, int], ...]:
    """The phrases and how many words they have."""
    if rules not in _PHRASES:
        _PHRASES[rules] = tuple((p.encode(), len(p.split())) for p in rules.boilerplate)
    return _PHRASES[rules]


def repeated_words(ids: "list[int]", window: int = WINDOW) -> int:
    """How many of the words lie in a window of so many words that occurs at least twice, the first included."""
    import numpy as np

    n = len(ids) - window + 1
    if n < 2:
        return 0
    x = np.asarray(ids, dtype=np.int64)
    # Ranks of windows of 1, 2, 4 and 8 words from ranks of their halves: exact, without hashing.
    rank, width = x, 1
    while width < window:
        step = min(width, window - width)
        pair = rank[: len(rank) - step] * (len(x) + 1) + rank[step:]
        width += step
        _, rank = np.unique(pair, return_inverse=True)
        if len(_) == len(pair):
            return 0
    again = np.bincount(rank)[rank] > 1
    marks = np.zeros(len(x) + 1, dtype=np.int64)
    at = np.flatnonzero(again)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + window, -1)
    return int((np.cumsum(marks)[:-1] > 0).sum())


def judge(text: bytes, rules: LineRules) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines_removed, n_words_removed, cleaned text."""
    words = text.split()
    n = len(words)
    number: dict[bytes, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    repeats = repeated_words(ids) if len(number) < n else 0
    joined = b"".join(words)
    word_chars = len(joined) - sum(map(joined.count, _CONTINUED)) if not joined.isascii() else len(joined)
    symbols = len(joined) - len(joined.translate(None, _SYMBOLS))
    seen: set[bytes] = set()
    dup = bad_lines = bad_words = 0
    kept_lines = []
    for line in text.split(b"\n"):
        own = line.split()
        if own:
            if line in seen:
                dup += 1
            seen.add(line)
        verdict = line_verdict(line, own, rules)
        if verdict:
            bad_lines += 1
            bad_words += len(own)
        else:
            kept_lines.append(line)
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEATED_PERCENT * n
    kept = not failed and bad_words <= rules.max_removed * n
    return n, word_chars, symbols, dup, repeats, failed, kept, bad_lines, bad_words, b"\n".join(kept_lines)


_CONTINUED = [bytes([b]) for b in range(0x80, 0xC0)]
_FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines_removed long, n_words_removed long"
_KINDS = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2


def clean(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, the counts, base_failed, kept, what was removed, and the cleaned text (``cleaned``; null without ``with_text``, which spares its way back).

    One pass without a shuffle. A null text counts as one without words, which is base_failed; ids are
    integers, null ones stay null; repeated rows are judged each. Columns besides id and text are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), *((f.split()[0], k) for f, k in zip(_FIELDS.split(", "), _KINDS, strict=True)), ("cleaned", pa.string())])

    def run(batches):
        own_cache("quality", _PHRASES.clear)

        def rows():
            for batch in batches:
                for key, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                    *found, cleaned = judge(text, rules)
                    yield key, *found, cleaned.decode("utf-8", "replace") if with_text else None

        yield from table_batches(rows(), schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id long, {_FIELDS}, cleaned string")


def filter_documents(docs: DataFrame, rules: LineRules = LineRules(), text_col: str = "text") -> DataFrame:
    """The rows that are kept, with all their columns, without the lines that fail; the text crosses to Python once."""
    from pyspark.sql.types import StructType

    fields = docs.schema
    at = fields.fieldNames().index(text_col)

    def run(batches):
        own_cache("quality", _PHRASES.clear)
        for batch in sliced(batches, at):
            kept, texts = [], []
            for text in as_bytes(batch.column(at)):
                *found, cleaned = judge(text, rules)
                kept.append(found[6])
                texts.append(cleaned.decode("utf-8", "replace") if found[6] else None)
            columns = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, StructType(fields))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(documents(spark, sf_dir), with_text=False).drop("cleaned")


#: The contract's counts and the line rules over whole texts, for DuckDB.
OP5_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text, row_number() over () as rid from documents),
w as (select rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from d),
f as (select rid, unnest(ws) as w, generate_subscripts(ws, 1) as i from w),
g as (select rid, i, string_agg(w, ' ') over (partition by rid order by i rows between current row and 7 following) as g,
      count(*) over (partition by rid order by i rows between current row and 7 following) as k from f),
h as (select rid, i, count(*) over (partition by rid, g) as c from g where k = 8),
p as (select rid, i from h where c > 1),
q as (select rid, count(distinct i + j) as n_repeat_words from p, range(8) t(j) group by rid),
s as (select rid, len(ws) as n_words, coalesce(length(array_to_string(ws, '')), 0) as word_chars,
      len(regexp_extract_all(array_to_string(ws, ''), '[#*$%&|<>]')) as n_symbols from w),
l as (select rid, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as li from d),
lw as (select rid, li, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as ws from l),
dl as (select rid, sum(c - 1)::bigint as n_dup_lines from (select rid, line, count(*) as c from lw where len(ws) > 0 group by rid, line) group by rid),
v as (select rid, len(ws) as n,
      len(list_filter(ws, lambda x: x in ('|', '>', '<', '/', '-', '*', '»', '›', '•', '·'))) as bars,
      len(list_filter(ws, lambda x: strlen(x) > 1 and regexp_matches(x, '(^|[#*$%&|<>])[#*$%&|<>][.,;:!?"''()]*$') or strlen(x) > 1 and regexp_matches(x, '^[.,;:!?"''()]*$'))) as noisy,
      len(list_filter(ws, lambda x: x like '%!!')) as loud,
      len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) as stutter,
      regexp_matches(line, '[#*$%&|<>]') as has_symbol,
      len(list_filter(ws[-12:], lambda x: regexp_matches(x, '[.!?:;,"'')\]}…。！？।؟۔”’»]$'))) as stops,
      len(list_filter([{phrases}], lambda p: contains(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), p) and len(string_split(p, ' ')) >= len(ws) / 6.0::double)) > 0 as boiler
      from lw where len(ws) > 0),
x as (select rid, n, case when boiler then 'b' when bars >= 3 and bars >= 0.2 * n or bars > 0 and n <= 8 and bars >= 0.25 * n then 'n'
      when has_symbol and n >= 4 and noisy >= 0.5 * n then 'p' when n >= 4 and loud >= 0.5 * n then 'p' when n >= 8 and stutter >= 0.5 * n then 'p'
      when n >= 12 and stops = 0 then 'p' else '' end as verdict from v),
y as (select rid, count(*) filter (verdict <> '') as n_lines_removed, coalesce(sum(n) filter (verdict <> ''), 0)::bigint as n_words_removed from x group by rid),
z as (select d.doc_id, s.n_words::bigint as n_words, s.word_chars::bigint as word_chars, s.n_symbols::bigint as n_symbols,
      coalesce(dl.n_dup_lines, 0)::bigint as n_dup_lines, coalesce(q.n_repeat_words, 0)::bigint as n_repeat_words,
      coalesce(y.n_lines_removed, 0)::bigint as n_lines_removed, coalesce(y.n_words_removed, 0)::bigint as n_words_removed
      from d join s using (rid) left join q using (rid) left join dl using (rid) left join y using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and n_words_removed <= 0.5 * n_words as kept,
  n_lines_removed, n_words_removed
from (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from z)
""".replace("{phrases}", ", ".join(f"'{p}'" for p in LineRules().boilerplate))
