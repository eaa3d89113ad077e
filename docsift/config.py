"""Settings shared by the jobs."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values.
USEFUL, NOT_USEFUL, MANUAL_CHECK = "useful", "not_useful", "manual_check"
VALID_LABELS = (NOT_USEFUL, USEFUL)
FILE_TYPES = ("txt", "pdf")
MODEL_TYPES = ("random_forest", "logistic_regression", "svm")
FEATURE_MODES = ("tfidf", "semantic", "combined")
MIN_EXTRACTED_CHARS = 50
IMBALANCE_LIMIT = 5.0
CONFIDENCE_THRESHOLD = 75.0
POOR_CV_F1 = 0.5
OVERFIT_GAP = 0.15


@dataclass(frozen=True)
class TrainConfig:
    model_type: str = "logistic_regression"
    feature_mode: str = "combined"
    file_type: str = "txt"
    max_features: int = 2000
    ngram: tuple[int, int] = (1, 2)
    min_df: int = 5
    stop_words: tuple[str, ...] | None = None
    test_size: float = 0.25
    seed: int = 42
    smote_threshold: float = IMBALANCE_LIMIT
    chi2_k: int = 1000
    top_n: int = 50
    cv_folds: int = 5
    embedding_dim: int = 64
    # The class ratio that triggers rebalancing is counted after blank
    # documents are dropped; True counts it before, on the raw label rows.
    ratio_pre_filter: bool = False
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.model_type not in MODEL_TYPES:
            raise ValueError(
                f"unknown model type {self.model_type!r}; choose one of {', '.join(MODEL_TYPES)}"
            )
        if self.feature_mode not in FEATURE_MODES:
            raise ValueError(
                f"unknown feature mode {self.feature_mode!r}; choose one of {', '.join(FEATURE_MODES)}"
            )
