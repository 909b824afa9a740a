"""Defaults of every tunable, as one frozen value passed around explicitly."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    seed: int = 42
    time_zone: str = "Asia/Shanghai"

    # modelling tables
    static_per_class: int = 250_000
    history_per_class: int = 30_000
    history_share: float = 0.6
    smoothing: float = 20.0
    tail_rows: int = 5_000

    # gift tiers: at most low_max is Low, at most mid_max is Mid, the rest High
    low_max: float = 5.0
    mid_max: float = 99.0

    # refinement loop
    learn_rows: int = 1_000
    valid_rows: int = 500
    test_rows: int = 2_000
    iterations: int = 3
    prompt_batch: int = 50
    shown_rows: int = 300
    shown_errors: int = 60
    spend_cap_usd: float = 8.0

    # training tables
    plain_train_rows: int = 8_000
    plain_test_rows: int = 1_000
    plain_batch: int = 128
    rationale_train_rows: int = 3_000
    rationale_batch: int = 64
    epochs: int = 2
    learning_rate: float = 1e-4
    rationale_weight: float = 0.05
    placebo_seed: int = 0

    # evaluation
    eval_train_rows: int = 30_000
    eval_test_rows: int = 2_000
    audit_rows: int = 2_500
    bootstrap_draws: int = 2_000
    natural_rate: float = 0.279
    natural_rows: int = 2_000
    min_numeric_levels: int = 30
    deletion_ks: tuple[int, ...] = (1, 3, 5)
    stability_k: int = 10


DEFAULTS = Settings()
