"""Similarities of texts and of vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import is_blank, tokens


def token_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of the token sets; 0 if either is empty."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is null, empty or zero."""
    size = norm(a) * norm(b)
    return F.coalesce(F.when(size > 0, dot(a, b) / size), F.lit(0.0))


def l2_normalized(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / (norm(a) + 1e-8))


def answer_similarity(metric: str, answer: Column, gold: Column, answer_vector: Column | None = None, gold_vector: Column | None = None) -> Column:
    """By metric; a blank answer is 0, a blank gold answer 1. Cosine without vectors falls back to the tokens."""
    if metric == "embedding_cosine" and answer_vector is not None and gold_vector is not None:
        value = F.when(answer_vector.isNull() | gold_vector.isNull(), token_overlap(answer, gold)).otherwise(cosine(answer_vector, gold_vector))
    elif metric in ("embedding_cosine", "token_overlap"):
        value = token_overlap(answer, gold)
    else:  # bleu and rouge have a constant in their place
        value = F.lit(0.5)
    return F.when(is_blank(answer), 0.0).when(is_blank(gold), 1.0).otherwise(value)


def exploratory_similarity(answer: Column, external: Column, answer_vector: Column, external_vector: Column) -> Column:
    """0 if either text is blank."""
    return F.when(is_blank(answer) | is_blank(external), 0.0).otherwise(cosine(answer_vector, external_vector))


def mmr_score(marginal: Column, vector: Column, selected: Column, weight: float) -> Column:
    """Marginal gain, less the closeness to what is selected; with nothing selected the gain itself."""
    nearest = F.array_max(F.transform(selected, lambda s: dot(s, vector)))
    return F.when(F.coalesce(F.size(selected), F.lit(0)) <= 0, marginal.cast("double")).otherwise(weight * marginal - (1 - weight) * nearest)


def overlap_share(docs: Column, seen: Column) -> Column:
    """Share of the list that is seen; the list's own length counts, repeats included."""
    return F.size(F.array_intersect(docs, seen)) / F.greatest(F.size(docs), F.lit(1))
