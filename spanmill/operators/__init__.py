"""Operators over rollouts. Tables are keyed by run columns, ``prompt_id`` and ``rollout_idx``; every function takes the keys to group by."""

RUN = ["task", "model_name", "model_variant"]
PROMPT = [*RUN, "prompt_id"]
