"""SQL forms of the most used functions, as temporary SQL functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .text import CANNOT_ANSWER

_TOKENS = r"array_remove(split(lower({}), r'(?U)\s+'), '')"
_QUOTED = ", ".join("'" + p.replace("'", "\\'") + "'" for p in CANNOT_ANSWER)
DEFINITIONS = (
    f"token_overlap(a STRING, b STRING) RETURNS DOUBLE RETURN IF(size({_TOKENS.format('a')}) <= 0 OR size({_TOKENS.format('b')}) <= 0, 0D, size(array_intersect({_TOKENS.format('a')}, {_TOKENS.format('b')})) / size(array_union({_TOKENS.format('a')}, {_TOKENS.format('b')})))",
    f"cannot_answer(answer STRING) RETURNS BOOLEAN RETURN coalesce(exists(array({_QUOTED}), p -> contains(lower(answer), p)), false)",
    "trace_cost(tokens BIGINT) RETURNS DOUBLE RETURN tokens / 1000D * 0.01D",
    r"subgoals(response STRING, most INT) RETURNS TABLE (place INT, goal STRING) RETURN SELECT pos, col FROM (SELECT posexplode(slice(filter(transform(filter(transform(split(response, '\n'), s -> trim(s)), s -> s RLIKE '^[0-9•-]'), s -> trim(regexp_replace(s, '^[0-9.•)-]+', ''))), s -> length(s) > 5), 1, most)))",
)


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session and returns their names; ``subgoals`` is a table function."""
    for text in DEFINITIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")
    return [text.partition("(")[0] for text in DEFINITIONS]
