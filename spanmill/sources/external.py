"""Where models come in: hooks that run a callable over Arrow-backed batches. No model is part of this library."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import PROMPT, judge
from ..schemas import EOS, RUN_KEYS
from . import results

Batches = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
#: Answers a prompt with a reply and why it ended ("stop", "length"); an exception is a failed request.
Ask = Callable[[str], tuple[str, str]]
#: From the ids before a generation and a few generations' ids: each one's log probabilities, a row per generated token over the whole vocabulary.
EosScorer = Callable[[list[int], list[list[int]]], list[np.ndarray]]


def generated(prompts: DataFrame, generator: Batches, schema: str) -> DataFrame:
    """Rollouts from prompts by a generator of batches; it is set up once a task."""
    return prompts.mapInPandas(generator, schema)


#: Tokens of a batch, padding included, unless a hook is told otherwise.
TOKENS = 1 << 16


def by_length(rows: DataFrame, hook: Batches, schema: str, length: Column, tokens: int = TOKENS) -> DataFrame:
    """A hook over batches of rows of like length: as many rows as fit into ``tokens`` when all are padded to the longest, one at least.

    Rows are dealt by ranges of length over all tasks, those of one length by their places in the scan, and
    sorted within a task; a batch ends where the next row would not fit. What the hook returns has to
    carry its rows' keys, as rows come back in another order.
    """
    dealt = rows.withColumns({"__length": F.coalesce(length.cast("long"), F.lit(0)), "__place": F.monotonically_increasing_id()})
    dealt = dealt.repartitionByRange("__length", "__place").sortWithinPartitions("__length").drop("__place")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def filled() -> Iterator[pd.DataFrame]:
            held: list[pd.DataFrame] = []
            n = 0
            for batch in batches:
                lengths, start = batch["__length"].to_numpy(), 0
                for i, own in enumerate(lengths.tolist()):
                    if n and (n + 1) * own > tokens:
                        if i > start:
                            held.append(batch.iloc[start:i])
                        yield pd.concat(held, ignore_index=True).drop(columns="__length")
                        held, n, start = [], 0, i
                    n += 1
                if start < len(batch):
                    held.append(batch.iloc[start:])
            if held:
                yield pd.concat(held, ignore_index=True).drop(columns="__length")

        return hook(filled())

    return dealt.mapInPandas(run, schema)


def embedded(rollouts: DataFrame, encoder: Batches, schema: str, length: Column | None = None, tokens: int = TOKENS) -> DataFrame:
    """With ``length`` the encoder gets batches of like length (``by_length``)."""
    return rollouts.mapInPandas(encoder, schema) if length is None else by_length(rollouts, encoder, schema, length, tokens)


def rewarded(rollouts: DataFrame, scorer: Batches, schema: str, length: Column | None = None, tokens: int = TOKENS) -> DataFrame:
    """With ``length`` the scorer gets batches of like length (``by_length``)."""
    return rollouts.mapInPandas(scorer, schema) if length is None else by_length(rollouts, scorer, schema, length, tokens)


def _asked(ask: Ask, prompt: str, retries: int, wait: float) -> tuple[str, str | None, bool]:
    """Reply, finish reason, failed. A request is repeated after ever longer waits; the last error is the reply."""
    for k in range(retries + 1):
        try:
            text, reason = ask(prompt)
            return (text or "").strip(), reason, False
        except Exception as error:  # whatever a client raises is a failed request
            last = error
            if k < retries and wait:
                time.sleep(wait * 2**k)
    return repr(last), None, True


def require_ready(judge: Callable[[], Ask], probe: str = "Reply with one word.") -> None:
    """Asks once, on the driver, before many requests are spent; an error goes to the caller."""
    judge()(probe)


def judged(pairs: DataFrame, judge: Callable[[], Ask], prompt: str = "prompt", concurrency: int = 64, retries: int = 5, wait: float = 1.0) -> DataFrame:
    """The rows with text, finish_reason and failed. ``judge`` makes a client, once a task; so many requests of a task are in flight at most, and so many rows held."""
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in pairs.schema.fields)}, text string, finish_reason string, failed boolean"
    at = pairs.columns.index(prompt)

    def run(batches):
        ask = judge()
        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                for k in range(0, batch.num_rows, 16 * concurrency):
                    part = batch.slice(k, 16 * concurrency)
                    replies = list(pool.map(lambda p: _asked(ask, p, retries, wait), part.column(at).to_pylist()))
                    texts, reasons, failed = zip(*replies, strict=True)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string()), pa.array(reasons, pa.string()), pa.array(failed, pa.bool_())], names=[*part.schema.names, "text", "finish_reason", "failed"])

    return pairs.mapInArrow(run, schema)


def judgment_matrix(nodes: DataFrame, template: str, judge_client: Callable[[], Ask], keys: list[str] = PROMPT, text: str = "text", concurrency: int = 64, retries: int = 5, wait: float = 1.0) -> DataFrame:
    """keys, r, c, text, is_similar, status: every pair r < c of the judged rollouts (keys, pos, text), and the other way round those that were found similar.

    What is asked is written before it is used again, so no request is made twice. ``template`` has to
    have {task_prompt}, {response_a} and {response_b}, and the nodes a column task_prompt.
    """
    missing = [p for p in ("{task_prompt}", "{response_a}", "{response_b}") if p not in template]
    if missing:
        raise ValueError(f"the template lacks {missing}")
    if "task_prompt" not in nodes.columns:
        raise ValueError("the nodes lack task_prompt, which the template asks for")
    own = nodes.select(*keys, "pos", F.col(text).alias("response"), "task_prompt")
    both = judge.forward_pairs(own, keys)
    response = {"response_a": F.col("response_r"), "response_b": F.col("response_c"), "task_prompt": F.col("task_prompt_r")}

    def asked(pairs: DataFrame) -> DataFrame:
        replies = judged(pairs.select(*keys, "r", "c", E.filled(template, response).alias("prompt")), judge_client, "prompt", concurrency, retries, wait)
        return results.cut(judge.judgments(replies).select(*keys, "r", "c", "text", "is_similar", "status"))

    forward = asked(both)
    turned = both.select(*keys, F.col("c").alias("r"), F.col("r").alias("c"), F.col("response_c").alias("response_r"), F.col("response_r").alias("response_c"), "task_prompt_r")
    reverse = asked(turned.join(judge.reverse_pairs(forward, keys), [*keys, "r", "c"], "left_semi"))
    return forward.unionByName(reverse)


def eos_scored(rollouts: DataFrame, scorer: EosScorer, eos: list[int], top_k: int | None = None, batch_size: int = 4, prefix: str = "prefix_ids") -> DataFrame:
    """Rows of the EOS artifact: for each generated token the log of the end tokens' joint probability and, with ``top_k``, whether one is among the likeliest.

    ``rollouts`` has the run's keys, prompt_id, rollout_idx, token_ids and the ids before the generation
    (``prefix``). Generations of one prefix and similar length are scored together.
    """

    def run(batches):
        for batch in batches:
            ids, before = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            logs, tops = [None] * len(ids), [None] * len(ids)
            groups: dict[tuple, list[int]] = {}
            for i in sorted(range(len(ids)), key=lambda i: len(ids[i])):
                groups.setdefault(tuple(before[i]), []).append(i)
            for prefix_ids, members in groups.items():
                for k in range(0, len(members), batch_size):
                    part = members[k : k + batch_size]
                    for i, scores in zip(part, scorer(list(prefix_ids), [ids[j] for j in part]), strict=True):
                        most = scores.max(1, keepdims=True)
                        scores = scores - most - np.log(np.exp(scores - most).sum(1, keepdims=True))
                        logs[i] = np.logaddexp.reduce(scores[:, eos], axis=1).astype(np.float32)
                        if top_k:
                            tops[i] = np.isin(np.argsort(-scores, axis=1, kind="stable")[:, :top_k], eos).any(1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(logs, pa.list_(pa.float32())), pa.array(tops, pa.list_(pa.bool_()))], names=[*batch.schema.names[:-2], "eos_logprob", "eos_in_top_k"])

    return rollouts.select(*RUN_KEYS, "prompt_id", "rollout_idx", "token_ids", F.col(prefix).alias("prefix")).mapInArrow(run, EOS)
