"""Grades from a language model: what it is asked for, and how its reply is read."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

GRADE = 'Answer with JSON only: {"score": a number from 0 (different) to 1 (equivalent), "reason": one sentence}'


@dataclass(frozen=True)
class Example:
    """A graded pair that shows the model what a score means."""

    answer: str
    reference: str
    score: float
    reason: str

    def __str__(self) -> str:
        return f"Answer:\n{self.answer}\nReference:\n{self.reference}\nScore: {self.score}\nReason: {self.reason}"


def graded(llm, prompt: str) -> tuple[float, str]:
    """Score and reason of the model's reply; ValueError if it holds none."""
    reply = llm.complete(prompt)
    found = re.search(r"\{.*\}", reply or "", re.DOTALL)
    try:
        raw = json.loads(found[0]) if found else None
        return float(raw["score"]), str(raw.get("reason") or "")
    except (ValueError, TypeError, KeyError):
        raise ValueError(f"no score in the reply: {reply!r}") from None
