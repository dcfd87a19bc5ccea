"""Settings with their defaults, as plain dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Sampling:
    n_samples: int = 100
    max_new_tokens: int = 4000
    temperature: float = 1.0
    top_k: int = 100
    top_p: float = 1.0
    seed: int = 42
    logprobs: int = 100
    save_logprobs: bool = False

    def __post_init__(self) -> None:
        if self.logprobs < self.top_k:
            raise ValueError("logprobs must be at least top_k: entropies are of the truncated distribution")


@dataclass(frozen=True)
class Compute:
    keep_fraction: float = 0.7
    use_reward_filter: bool = False
    run_name: str = "default"


@dataclass(frozen=True)
class Bootstrap:
    n_boot: int = 2000
    seed: int = 42
    ci_level: float = 0.95


@dataclass(frozen=True)
class Judge:
    num_rollouts: int = 24
    seed: int = 42
    max_prompts: int | None = None
    temperature: float = 0.1
    top_p: float = 0.95
    max_tokens: int = 1536
    max_concurrency: int = 64
    timeout: int = 120
    max_retries: int = 5
    max_failure_rate: float = 0.05


@dataclass(frozen=True)
class Matrix:
    models: list[str]
    tasks: list[str]
    variants: list[str] = field(default_factory=lambda: ["base", "instruct"])
    run_name: str = "default"


@dataclass(frozen=True)
class Figures:
    bin_step: int = 5
    min_active_rollouts: int = 1
    bins: int = 50
    length_points: int = 1000
    variance_points: int = 400
