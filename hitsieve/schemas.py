"""Explicit schemas and parameter objects."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

MEASUREMENT = T.StructType([
    T.StructField("entity_id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("relation", T.StringType()),
    T.StructField("unit", T.StringType()),
    T.StructField("value", T.StringType()),
])

PREDICTION = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("y_true", T.IntegerType()),
    T.StructField("y_pred", T.IntegerType()),
    T.StructField("y_prob", T.DoubleType()),
    T.StructField("model", T.StringType()),
    T.StructField("seed", T.IntegerType()),
    T.StructField("fold", T.IntegerType()),
])

SCORE_OUTPUT = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("prob", T.FloatType()),
    T.StructField("pred_label", T.ByteType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("seed", T.LongType()),
    T.StructField("threshold_used", T.FloatType()),
])

# Model families, metric names, threshold columns.
MODELS = ["LR", "RFC", "SVC", "XGBC", "ETC", "MLP"]
SCALED_MODELS = {"LR", "SVC", "MLP"}
TREE_MODELS = {"RFC", "ETC", "XGBC"}
METRICS = ["accuracy", "precision", "recall", "f1", "mcc", "roc_auc", "pr_auc", "ef1", "ef5", "ef10", "nef10"]
RANKING_METRICS = ["roc_auc", "pr_auc", "ef1", "ef5", "ef10", "nef10"]
SELECTION_RULES = ["max_f1", "max_mcc", "max_precision", "max_recall", "youden_j"]
FP_BITS = 2048


@dataclass(frozen=True)
class Rule:
    """Closed range on one column; an open end is None."""

    column: str
    lo: float | None = None
    hi: float | None = None


# The two published rule sets, as upper bounds and as closed ranges.
BASIC_RULES = (
    Rule("mw", None, 500.0), Rule("logp", None, 5.0), Rule("hbd", None, 5.0),
    Rule("hba", None, 10.0), Rule("tpsa", None, 140.0),
)
STRICT_RULES = (
    Rule("n_atoms", 10.0, None), Rule("mw", 250.0, 500.0), Rule("logp", -1.0, 5.0),
    Rule("tpsa", 20.0, 140.0), Rule("hbd", None, 5.0), Rule("hba", None, 10.0), Rule("rotb", None, 10.0),
)
ALLOWED_SYMBOLS = ("C", "H", "N", "O", "S", "P", "F", "Cl", "Br", "I")
MAX_TEXT_LENGTH = 120
MIN_DESIRABILITY = 0.4


@dataclass(frozen=True)
class MissingPolicy:
    strategy: str = "nan_indicator"
    impute_value: float = 0.0
    suffix: str = "__isna"


@dataclass(frozen=True)
class TrainConfig:
    seeds: tuple[int, ...] = (42, 43, 44)
    models: tuple[str, ...] = tuple(MODELS)
    test_size: float = 0.2
    cv_folds: int = 5
    split_method: str = "group"
    variance_threshold: float = 0.05
    correlation_threshold: float = 0.9
    max_correlation_bits: int | None = None
    thresholding: bool = False
    classification_threshold: float = 0.5
    selection_rule: str = "max_f1"
    sweep_points: int = 501
    curve_points: int = 501
    n_augments: int = 0
    descriptor_mode: str = "reuse_original"
    missing: MissingPolicy = field(default_factory=MissingPolicy)
    search: str = "none"
    search_iterations: int = 60
    search_folds: int = 3
    search_scoring: str = "roc_auc"


@dataclass(frozen=True)
class DomainConfig:
    base_method: str = "knn_density"
    knn_k: int = 5
    quantile: float = 0.99
    pca_variance: float = 0.95
    residual_z: float = 3.0
    tanimoto_threshold: float = 0.6
    cosine_threshold: float = 0.7
    strict_similarity: bool = True
    skip_som: bool = True
    som_rows: int = 12
    som_cols: int = 12
    som_epochs: int = 20


@dataclass(frozen=True)
class ExplainConfig:
    background: int = 256
    explain: int = 50
    permutations: int = 4
    seed: int = 42
    top_features: int = 15
    heat_rows: int = 64
