"""JSON from answers of models: finding the object in chatter, repairing strings and ends; retry classes."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# Keys by which an object is a result.
RESULT_KEYS = {"smelly", "tier", "reason", "evidence", "role", "verdict", "reviews", "cases", "decisions", "proofs"}
# Transient errors that are tried again with the same prompt.
SAME_PROMPT = ["No JSON object found", "Empty assistant content", "Empty response content", "error decoding response body", "Invalid JSON response", "Timed out reading response body", "timed out waiting for"]


def clean_strings(text: str) -> str:
    """Escapes raw control characters and wrong backslashes inside strings only."""
    out, inside, k = [], False, 0
    while k < len(text):
        c = text[k]
        if not inside:
            inside = c == '"'
            out.append(c)
        elif c == "\\":
            nxt = text[k + 1 : k + 2]
            good = nxt != "" and (nxt in '"\\/bfnrt' or re.match(r"u[0-9a-fA-F]{4}", text[k + 1 : k + 6]))
            out.append("\\" + nxt if good else "\\\\")
            k += bool(good)
        elif c == '"':
            inside = False
            out.append(c)
        else:
            out.append(json.dumps(c)[1:-1] if c < " " else c)
        k += 1
    return "".join(out)


def _ended(text: str) -> str | None:
    """The text from its first brace with open strings and brackets closed."""
    start = text.find("{")
    if start < 0:
        return None
    stack, inside, escaped = [], False, False
    for c in text[start:]:
        if inside:
            inside, escaped = escaped or c != '"', c == "\\" and not escaped
        elif c == '"':
            inside, escaped = True, False
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack and stack[-1] == c:
            stack.pop()
    body = text[start:] + ('"' if inside else "")
    return re.sub(r",\s*$", "", body) + "".join(reversed(stack))


def _result(value):
    """The first object with a result key in a value, else the value where it is an object."""
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError:
            return None
    if isinstance(value, list):
        return next((r for v in value if (r := _result(v)) is not None), None)
    if not isinstance(value, dict):
        return None
    if RESULT_KEYS & value.keys():
        return value
    return next((r for v in value.values() if isinstance(v, (dict, list, str)) and (r := _result(v)) is not None), value)


def salvage(text: str | None) -> str | None:
    """A result object as JSON from an answer, or null."""
    body = re.sub(r"^```(?:json)?\s*|\s*```$", "", (text or "").strip())
    decoder = json.JSONDecoder()
    for form in (body, clean_strings(body)):
        tries = [lambda f=form: json.loads(f)]
        tries += [lambda f=form, k=m.start(): decoder.raw_decode(f, k)[0] for m in re.finditer(r"\{", form)]
        tries += [lambda f=form: json.loads(re.sub(r",(\s*[}\]])", r"\1", _ended(f) or ""))]
        for attempt in tries:
            try:
                found = _result(attempt())
            except (ValueError, RecursionError):  # too deep an answer has no result
                continue
            if found is not None:
                return json.dumps(found, ensure_ascii=False, separators=(",", ":"))
    return None


@F.pandas_udf(StringType())
def salvaged(answers: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in answers:
        yield part.map(salvage)


def http_status(error: Column) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(error, r"HTTP\s+(\d+)", 1), F.lit("")), F.lit("999999")).cast("int")


def retry_class(error: Column) -> Column:
    """``fatal``, ``retry_same_prompt`` or ``wait_and_retry``."""
    status = http_status(error)
    transient = status.isin(408, 409, 425, 429) | status.between(500, 599)
    same = error.rlike("|".join(re.escape(x) for x in SAME_PROMPT))
    return F.when(status.isNotNull() & ~transient, "fatal").when(same, "retry_same_prompt").otherwise("wait_and_retry")
