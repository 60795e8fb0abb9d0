"""Scalar functions over prompts, responses and names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Phrases by which an answer says that it has none (fixed values).
CANNOT_ANSWER = (
    "cannot answer",
    "cannot provide",
    "insufficient evidence",
    "not enough information",
    "no information",
    "unable to answer",
    "don't have enough",
    "cannot determine",
    "not provided in the evidence",
    "evidence does not contain",
    "evidence doesn't contain",
)
#: Substrings of model names, in the order in which they are tried (fixed values).
PROVIDERS = (
    ("openai", ("gpt", "openai", "o1", "davinci", "turbo")),
    ("anthropic", ("claude", "anthropic")),
    ("google", ("gemini", "palm", "bison")),
    ("mistral", ("mistral",)),
    ("cohere", ("cohere", "command")),
    ("together", ("together",)),
)
_BLANK = r"(?U)^\s+|\s+$"


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, _BLANK, "")


def tokens(text: Column) -> Column:
    """Lower-case tokens between white space, repeats included."""
    return F.array_remove(F.split(F.lower(text), r"(?U)\s+"), "")


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.length(stripped(text)) == 0)


def cannot_answer(text: Column) -> Column:
    """Whether the text holds one of the phrases, in any case; false for null."""
    lower = F.lower(text)
    found = F.lit(False)
    for phrase in CANNOT_ANSWER:
        found = found | lower.contains(phrase)
    return F.coalesce(found, F.lit(False))


def provider_of(model: Column) -> Column:
    """The provider that a model name points to; unknown names go to openai."""
    out = F.when(model.startswith("custom/"), "custom").when(model.startswith("ollama/"), "ollama")
    for name, parts in PROVIDERS:
        out = out.when(F.lower(model).rlike("|".join(parts)), name)
    return out.otherwise("openai")


def title_label(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def sample_id(number: Column) -> Column:
    """sample_001 for 1."""
    return F.format_string("sample_%03d", number)


def execution_mode(mode: Column) -> Column:
    """standard or adaptive; anything else is standard."""
    plain = F.lower(stripped(mode))
    return F.when(plain.isin("standard", "adaptive"), plain).otherwise("standard")


def after_marker(response: Column, first: str, second: str) -> Column:
    """The part after the first ``second`` (up to another one) where both markers are there; else the whole."""
    both = response.contains(first) & response.contains(second)
    return stripped(F.when(both, F.split_part(response, F.lit(second), F.lit(2))).otherwise(response))


def reasoning_of(response: Column, first: str, second: str) -> Column:
    """The part before ``second`` without ``first`` where both markers are there; else null."""
    both = response.contains(first) & response.contains(second)
    return F.when(both, stripped(F.replace(F.split_part(response, F.lit(second), F.lit(1)), F.lit(first), F.lit(""))))


def bracket_slice(text: Column, left: str = "[", right: str = "]") -> Column:
    """From the first ``left`` to the last ``right``; null without both in this order."""
    return F.nullif(F.regexp_extract(text, rf"(?s)\{left}.*\{right}", 0), F.lit(""))


def code_fence_stripped(text: Column) -> Column:
    """What a leading code fence encloses, without the word json; other text as it is."""
    plain = stripped(text)
    inner = F.split_part(plain, F.lit("```"), F.lit(2))
    return stripped(F.when(plain.startswith("```"), F.regexp_replace(inner, r"^json", "")).otherwise(plain))


def fenced_anywhere(text: Column) -> Column:
    """What the first ```json fence encloses, or else the first fence; other text as it is."""
    plain = stripped(text)
    tagged = F.split_part(F.split_part(plain, F.lit("```json"), F.lit(2)), F.lit("```"), F.lit(1))
    fenced = F.split_part(plain, F.lit("```"), F.lit(2))
    return stripped(F.when(plain.contains("```json"), tagged).when(plain.contains("```"), fenced).otherwise(plain))


def json_strings(text: Column) -> Column:
    """The non-blank strings of a JSON array; null if it is none."""
    parsed = F.from_json(text, "array<string>")
    return F.filter(parsed, lambda q: ~is_blank(q))


def subgoals(response: Column, most: int = 3) -> Column:
    """Lines that begin with a digit, '-' or a bullet, without these, if longer than five characters; the first ``most``."""
    lines = F.transform(F.split(response, "\n"), stripped)
    lines = F.filter(lines, lambda s: s.rlike(r"^[0-9\-•]"))
    lines = F.transform(lines, lambda s: stripped(F.regexp_replace(s, r"^[0-9.\-•)]+", "")))
    return F.slice(F.filter(lines, lambda s: F.length(s) > 5), 1, most)


def merged_goals(own: Column, others: Column, most: int = 3) -> Column:
    """``own`` as it is, then unseen ones of ``others`` while fewer than twice ``most`` different ones are there."""
    fresh = F.array_distinct(F.array_except(others, own))
    return F.concat(own, F.slice(fresh, 1, F.greatest(F.lit(2 * most) - F.size(F.array_distinct(own)), F.lit(0))))


def placeholders(template: Column) -> Column:
    """Names in single braces, sorted, each once."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{(\w+)\}"), F.lit(1))))


def rendered(template: Column, values: dict[str, Column]) -> Column:
    """The template with its placeholders filled; doubled braces stand for single ones."""
    out = F.replace(F.replace(template, F.lit("{{"), F.lit("\u0001")), F.lit("}}"), F.lit("\u0002"))
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return F.replace(F.replace(out, F.lit("\u0001"), F.lit("{")), F.lit("\u0002"), F.lit("}"))


def reformulation(source: Column, target: Column) -> Column:
    """How a query was reformulated: a plan of steps is procedural, a part of the words syntactic, the rest conceptual."""
    part = F.size(F.array_except(tokens(target), tokens(source))) == 0
    return F.when(F.lower(stripped(target)).rlike(r"^(i will|first)\b"), "procedural").when(part, "syntactic").otherwise("conceptual")


def usage(raw: Column) -> dict[str, Column]:
    """prompt, completion and total tokens from the usage JSON of any provider."""
    def first(*paths: str) -> Column:
        return F.coalesce(*(F.get_json_object(raw, f"$.{p}").cast("long") for p in paths))

    prompt = first("prompt_tokens", "input_tokens", "promptTokenCount", "prompt_eval_count")
    completion = first("completion_tokens", "output_tokens", "candidatesTokenCount", "eval_count")
    total = F.coalesce(first("total_tokens", "totalTokenCount"), F.coalesce(prompt, F.lit(0)) + F.coalesce(completion, F.lit(0)))
    return {"prompt_tokens": prompt, "completion_tokens": completion, "total_tokens": total}
