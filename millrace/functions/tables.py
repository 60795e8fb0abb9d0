"""Table functions in Python: goals of planned responses, by row and by key."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import IntegerType, StringType, StructType

#: As ``answers.planned_goals`` has them.
_MARK, _LISTED, _BULLET = "SUB-GOALS:", re.compile(r"^[0-9•-]"), re.compile(r"^[0-9.•)-]+")
_EDGE = re.compile(r"^\s+|\s+$")
SHORTEST = 6


def goals(response: str | None, most: int) -> list[str]:
    """The listed goals of a response: lines that begin with a number or a bullet, without it, if long enough."""
    if response is None:
        return []
    body = response.split(_MARK)[1] if _MARK in response else response
    lines = (_EDGE.sub("", line) for line in body.split("\n"))
    found = (_EDGE.sub("", _BULLET.sub("", line)) for line in lines if _LISTED.match(line))
    return [goal for goal in found if len(goal) >= SHORTEST][:most]


def _most(argument: AnalyzeArgument) -> int:
    if not argument.isConstantExpression or argument.value is None or argument.value < 1:
        raise ValueError("the number of goals must be a positive constant")
    return int(argument.value)


class _Goals:
    """planned_goals(response, most): place and goal of each listed goal, for a lateral join."""

    @staticmethod
    def analyze(response: AnalyzeArgument, most: AnalyzeArgument) -> AnalyzeResult:
        if response.dataType != StringType():
            raise ValueError("the response must be a string")
        _most(most)
        return AnalyzeResult(StructType().add("place", IntegerType()).add("goal", StringType()))

    def eval(self, response: str | None, most: int) -> Iterator[tuple[int, str]]:
        yield from enumerate(goals(response, most), 1)


class _GoalsByKey:
    """goals_by_key(TABLE(rows), most): the first distinct goals of each key, from all its responses in order of place.

    rows: key, place, response. The function asks Spark for rows partitioned by key and ordered by place; of a key it holds the goals that it has given alone.
    """

    def __init__(self) -> None:
        self.key, self.given = None, {}

    @staticmethod
    def analyze(rows: AnalyzeArgument, most: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or [f.name for f in rows.dataType.fields][:3] != ["key", "place", "response"]:
            raise ValueError("the table must have the columns key, place and response")
        _most(most)
        schema = StructType().add("key", rows.dataType.fields[0].dataType).add("number", IntegerType()).add("goal", StringType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("key")], orderBy=[OrderingColumn("place")])

    def eval(self, row, most: int) -> Iterator[tuple]:
        self.key = row["key"]
        if len(self.given) < most:
            for goal in goals(row["response"], most):
                if goal not in self.given and len(self.given) < most:
                    self.given[goal] = len(self.given) + 1
                    yield self.key, self.given[goal], goal


def register(spark: SparkSession) -> list[str]:
    """Makes the table functions known to the session's SQL and returns their names."""
    spark.udtf.register("planned_goals", udtf(_Goals, useArrow=True))
    spark.udtf.register("goals_by_key", udtf(_GoalsByKey, useArrow=False))
    return ["planned_goals", "goals_by_key"]
