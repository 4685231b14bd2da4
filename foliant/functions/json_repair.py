"""Tolerant reading of JSON that a model wrote: what was tried, and what came out."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from .lazy import vectorised

#: Escapes that stay when a text has to be repaired; \b and \f begin words of formulas far more often.
_KEEP = frozenset('"\\/nrt')
_FENCE = re.compile(r"```\w*[ \t]*\n(.*?)\n\s*```", re.S)
_PLAIN, _SPACES = re.compile(r"[^\\,]+"), re.compile(r"\s*")
_LIST_NAMES = ("cards", "flashcards", "anki_cards")


def repair(text: str, keep: frozenset = _KEEP) -> str:
    """Backslashes that begin no kept escape are doubled, commas before a closing bracket go. One pass."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c not in "\\,":
            j = _PLAIN.match(text, i).end()
            out.append(text[i:j])
            i = j
        elif c == "\\":
            nxt = text[i + 1 : i + 2]
            valid = nxt in keep and nxt != "" or (nxt == "u" and re.fullmatch("[0-9a-fA-F]{4}", text[i + 2 : i + 6]))
            out.append(text[i : i + 2] if valid else "\\\\")
            i += 2 if valid else 1
        elif text[(j := _SPACES.match(text, i + 1).end()) : j + 1] in ("]", "}"):
            i += 1
        else:
            out.append(c)
            i += 1
    return "".join(out)


def _load(text: str):
    for t in (text, None):
        try:
            return json.loads(repair(text) if t is None else t)
        except (ValueError, RecursionError):
            pass
    return None


def _balanced(text: str) -> str | None:
    depth = 0
    for m in re.finditer(r"[{}]", text):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return text[: m.end()]
    return None


def recover(text: str):
    """The longest beginning that ends with a closing brace and can be closed to a JSON object."""
    text = repair(text)
    cuts, open_, quoted, skip = [], [], False, False
    for i, c in enumerate(text):  # what is open after each brace, strings aside
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]":
            if not open_ or open_.pop() != c:
                break
            if c == "}":
                cuts.append((i + 1, "".join(reversed(open_))))
    for end, tail in reversed(cuts):
        try:
            found = json.loads(text[:end] + tail)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return None


def shape(found):
    """Every accepted shape as {"new_cards": [...]}."""
    if isinstance(found, list):
        return {"new_cards": found}
    if isinstance(found, dict) and "new_cards" not in found:
        for name in _LIST_NAMES:
            if isinstance(found.get(name), list):
                return {"new_cards": found[name]}
        if "front" in found and "back" in found:
            return {"new_cards": [found]}
    return found


def read_reply(reply: str | None) -> tuple[str, object]:
    text = (reply or "").strip()
    if not text:
        return "empty", {"new_cards": []}
    at = text.find("{")
    tries = [("direct", [text]), ("markdown_fence", (m[1].strip() for m in _FENCE.finditer(text)))]
    if at >= 0:
        tries += [("brace_match", [_balanced(text[at:])]), ("greedy", [text[at : text.rfind("}") + 1]])]
    for name, parts in tries:
        for part in parts:
            if part and (found := _load(part)) is not None:
                return name, shape(found)
    if at >= 0 and (found := recover(text[at:])) is not None:
        return "truncated_recovery", shape(found)
    return "all_failed", {"new_cards": []}


@vectorised("strategy string, payload string, n_cards int")
def parse_reply(replies: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """strategy, payload (JSON with sorted keys) and the number of cards of each reply."""
    for batch in replies:
        rows = []
        for reply in batch:
            name, found = read_reply(reply)
            cards = found.get("new_cards") if isinstance(found, dict) else None
            rows.append((name, json.dumps(found, ensure_ascii=False, sort_keys=True), len(cards) if isinstance(cards, list) else 0))
        yield pd.DataFrame(rows, columns=["strategy", "payload", "n_cards"])


@vectorised("string")
def canonical_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Keys sorted, no spaces; null for what is no JSON."""

    def one(t):
        try:
            return json.dumps(json.loads(t), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except (TypeError, ValueError):
            return None

    for batch in texts:
        yield batch.map(one)
