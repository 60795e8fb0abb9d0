"""Prompt templates: text files with {name} placeholders, read once."""

from __future__ import annotations

from functools import cache
from pathlib import Path

from pyspark.sql import Column, functions as F

from ..functions import text as T

FOLDER = Path(__file__).parent / "prompts"


@cache
def template(name: str) -> str:
    return (FOLDER / f"{name}.txt").read_text(encoding="utf-8")


def names() -> list[str]:
    return sorted(p.stem for p in FOLDER.glob("*.txt"))


def variables(name: str) -> list[str]:
    import re

    return sorted(set(re.findall(r"\{(\w+)\}", template(name).replace("{{", "").replace("}}", ""))))


def info(name: str) -> dict:
    text = template(name)
    return {"name": name, "variables": variables(name), "bytes": len(text.encode()), "lines": text.count("\n") + 1, "characters": len(text)}


def render(name: str, **values: Column) -> Column:
    """A prompt for each row; a missing variable raises."""
    if missing := set(variables(name)) - set(values):
        raise ValueError(f"prompt {name} needs {', '.join(sorted(missing))}")
    return T.rendered(F.lit(template(name)), values)
