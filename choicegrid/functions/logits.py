"""Arithmetic on arrays of logits: log-probabilities, greedy and top tokens, mass of the options."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import bound


def log_softmax(logits: Column) -> Column:
    """Log-probabilities; the largest logit and the logarithm of the sum are computed once per array."""

    def log_sum(top: Column) -> Column:
        return top + F.ln(F.aggregate(logits, F.lit(0.0).cast("double"), lambda s, x: s + F.exp(x - top)))

    return bound(bound(F.array_max(logits), log_sum), lambda z: F.transform(logits, lambda x: x - z))


def argmax(values: Column) -> Column:
    """Zero-based place of the largest value; the least place on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def top_k(logprobs: Column, k: int) -> Column:
    """The k largest as structs (neg, token_id): largest first, least token on ties."""
    pairs = F.transform(logprobs, lambda x, i: F.struct((-x).alias("neg"), i.alias("token_id")))
    return F.slice(F.array_sort(pairs), 1, k)


def entropy(logprobs: Column) -> Column:
    return -F.aggregate(logprobs, F.lit(0.0).cast("double"), lambda s, x: s + F.exp(x) * x)


def option_mass(logprobs: Column, options: Column) -> Column:
    """Probability of all the options' tokens; null where there are none."""
    total = F.aggregate(options, F.lit(0.0).cast("double"), lambda s, i: s + F.exp(F.get(logprobs, i)))
    return F.when(F.size(options) > 0, total)


def option_status(token_counts: Column, most: int) -> Column:
    """Why the options of a choice can be scored or not; token_counts holds each option's number of tokens (null: unknown)."""
    if most <= 0:
        return F.lit("off")
    return (
        F.when(F.size(token_counts) > most, "too_many_options")
        .when(F.exists(token_counts, lambda n: n.isNull() | (n < 1)), "tokenization_mismatch")
        .when(F.exists(token_counts, lambda n: n > 1), "multi_token_option")
        .otherwise("scored")
    )
