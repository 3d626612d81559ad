"""Column-level (scalar) building blocks; all are native Spark expressions."""

from cohortlens.functions.columns import (  # noqa: F401
    tolerant_double, as_category, pass_label, order_key, sigmoid, logit,
    dnorm, linear_predictor, safe_ratio, snake_case,
)
