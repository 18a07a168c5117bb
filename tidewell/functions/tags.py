"""Tag output of models to columns: strict JSON, all or nothing per row; whitelists; prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strict_json import strict_object

#: Accepted tag values.
DIFFICULTY = ["very easy", "easy", "medium", "hard", "very hard"]
QUALITY = ["very poor", "poor", "average", "good", "excellent"]
CATEGORY = ["Information seeking", "Reasoning", "Planning", "Editing", "Coding & Debugging", "Math", "Role playing", "Data analysis", "Creative writing", "Advice seeking", "Brainstorming", "Other"]
#: The JSON keys of each mission, and the columns they fill.
MISSIONS = {
    "difficulty": {"intent": "intent", "knowledge": "knowledge", "difficulty": "difficulty"},
    "quality": {"input_quality": "input_quality", "explanation": "quality_explanation"},
    "classification": {"primary_tag": "task_category", "other_tags": "other_task_category"},
}
_ASK = {
    "difficulty": "Name the user's intent, the knowledge it takes, and how difficult it is ({values}).",
    "quality": "Rate how clear and complete the query is ({values}), and explain why.",
    "classification": "Choose the task category that fits best ({values}), and any others that apply.",
}
_VALUES = {"difficulty": DIFFICULTY, "quality": QUALITY, "classification": [*CATEGORY[:-1], "Others"]}


def around(mission: str) -> tuple[str, str]:
    """What stands before and after the text in a mission's prompt."""
    if mission not in _ASK:
        raise ValueError(f"unknown mission {mission!r}")
    keys = ", ".join(f'"{k}"' for k in MISSIONS[mission])
    return f"{_ASK[mission].format(values=' / '.join(_VALUES[mission]))} Answer with one JSON object with the keys {keys}.\n\n## User query\n```\n", "\n```\n"


def prompt(mission: str, text: Column) -> Column:
    """The tagging prompt of a mission around the text."""
    head, tail = around(mission)
    return F.concat(F.lit(head), text, F.lit(tail))


def whitelist(col: Column, allowed: list[str], others: bool = False) -> Column:
    """The value if allowed, else null. others: read 'Others' as 'Other' instead of dropping it."""
    if others:
        col = F.when(col == "Others", "Other").otherwise(col)
    return F.when(col.isin(allowed), col)


def parse_tags(text: Column, mission: str) -> Column:
    """struct(ok, one string per column): null fields and ok = false unless the whole text is one JSON object that has every key (see strict_object)."""
    found, columns = strict_object(text, list(MISSIONS[mission])), MISSIONS[mission].values()
    named = lambda o: F.struct(o["ok"].alias("ok"), *[o[f"v{i}"].alias(c) for i, c in enumerate(columns)])
    return F.get(F.transform(F.array(found), named), F.lit(0))
