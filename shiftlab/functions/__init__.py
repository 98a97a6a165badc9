"""Column functions (JVM-side higher-order array expressions)."""

from shiftlab.functions.vectors import (  # noqa: F401
    argmax_class, as_double_array, cross_entropy, dot, l2_normalize, log_sum_exp, softmax,
    standardize, CLIP_MEAN, CLIP_STD, IMAGENET_MEAN, IMAGENET_STD,
)
