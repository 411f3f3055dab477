"""Settings of the operators."""

from __future__ import annotations

from dataclasses import dataclass

EVENT_TYPES = ("view", "cart", "remove_from_cart", "purchase")
REQUIRED_COLUMNS = (
    "event_time", "event_type", "product_id", "category_id", "category_code", "brand", "price", "user_id", "user_session",
)
SPLITS = ("train", "validation", "test")
MISSING = "<missing>"


@dataclass(frozen=True)
class LabelingPolicy:
    """What counts as a positive prefix: a purchase in (cutoff, cutoff + window] of the same session."""

    prediction_window_minutes: int = 30
    exclude_at_or_after_first_purchase: bool = True
    include_current_event_in_prefix: bool = True

    def __post_init__(self) -> None:
        if self.prediction_window_minutes <= 0:
            raise ValueError("the prediction window must be positive")


@dataclass(frozen=True)
class FeaturePolicy:
    """Look-ahead window, time split and sequence length of the features."""

    prediction_window_minutes: int = 30
    train_ratio: float = 0.70
    validation_ratio: float = 0.15
    max_sequence_length: int = 50

    def __post_init__(self) -> None:
        if self.prediction_window_minutes <= 0 or self.max_sequence_length <= 0:
            raise ValueError("window and sequence length must be positive")
        if not (0 < self.train_ratio < 1 and 0 <= self.validation_ratio < 1 and self.train_ratio + self.validation_ratio < 1):
            raise ValueError("split ratios must leave a part for every split")


@dataclass(frozen=True)
class QualityPolicy:
    """From how many events a session is long, and how many of them are listed."""

    extreme_session_threshold: int = 100
    top_n: int = 20


@dataclass(frozen=True)
class SequencePolicy:
    """Length and vocabulary sizes of encoded sequences."""

    max_sequence_length: int = 50
    vocabulary_top_k: int = 10_000
    pad_id: int = 0
    unknown_id: int = 1


@dataclass(frozen=True)
class BaselinePolicy:
    """Evaluation and training settings of the baseline models."""

    strategies: tuple[str, ...] = ("none", "balanced")
    threshold: float = 0.5
    top_k_fraction: float = 0.1
    max_iter: int = 300
    inverse_regularization: float = 1.0
    trees: int = 200
    learning_rate: float = 0.05
    tree_depth: int = 5
    subsample: float = 0.8
    column_share: float = 0.8
    seed: int = 42
