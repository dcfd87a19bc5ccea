"""Schemas of the tables, as DDL. Where a source stores parallel lists, these have a row for each rollout."""

from __future__ import annotations

#: Columns that name a run; they are strings, also as partitions.
RUN_KEYS = ["model_name", "task", "model_variant", "run_name"]
_RUN = "model_name string, task string, model_variant string, run_name string"

PROMPTS = "task string, prompt_id int, prompt string"
RUNS = f"{_RUN}, prompt_file string, num_prompts int, n_samples int, max_new_tokens int, temperature double, top_k int, top_p double, seed int, logprobs int, enable_thinking boolean"
ROLLOUTS = f"{_RUN}, prompt_id int, rollout_idx int, text string, token_ids array<bigint>, seq_len bigint, step_entropy array<float>, step_logprobs array<array<float>>"
EMBEDDINGS = f"{_RUN}, embedding_key string, prompt_id int, rollout_idx int, embedding array<float>"
REWARDS = f"{_RUN}, reward_name string, prompt_id int, rollout_idx int, reward float"
JUDGE_RUNS = f"{_RUN}, judge_name string, model string, prompt_sha string, num_rollouts int, seed int, temperature double, top_p double, max_tokens int"
JUDGE_NODES = f"{_RUN}, judge_name string, prompt_id int, pos int, rollout_idx int"
JUDGMENTS = f"{_RUN}, judge_name string, prompt_id int, r int, c int, is_similar boolean, status string, text string"
EOS = f"{_RUN}, prompt_id int, rollout_idx int, eos_logprob array<float>, eos_in_top_k array<boolean>"

#: The column, if any, that sets apart the artifacts of one kind in a run.
ARTIFACTS = {"rollouts": (ROLLOUTS, None), "embeddings": (EMBEDDINGS, "embedding_key"), "rewards": (REWARDS, "reward_name"), "judge_nodes": (JUDGE_NODES, "judge_name"), "judgments": (JUDGMENTS, "judge_name"), "eos": (EOS, None)}


def names(schema: str) -> list[str]:
    """The columns of a schema, in order."""
    return [part.split()[0] for part in schema.split(", ")]
