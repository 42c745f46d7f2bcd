"""Repair of JSON that was cut off: what stands whole before the cut, at any depth, with its brackets closed."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CLOSERS = {"{": "}", "[": "]"}
_NEXT = re.compile(r'"|[{}\[\],:]|[^\s"{}\[\],:]+')


def repaired(text: str | None) -> str | None:
    """The first object in ``text``; if it is cut off or broken, its whole entries up to there. Null without an object.

    One pass with a stack of open brackets. After each whole value, and after each opened bracket, closing the stack would give valid
    JSON; the last such place counts. A number or word at the very end may go on, so it is not whole; a key without its value goes.
    """
    start = (text or "").find("{")
    if start < 0:
        return None
    stack: list[str] = []
    at, safe, after_colon = start, (start, ""), False
    while at < len(text):
        m = _NEXT.search(text, at)
        if not m:
            break
        said, at = m.group(), m.end()
        if said == '"':
            while at < len(text) and text[at] != '"':
                at += 2 if text[at] == "\\" else 1
            if at >= len(text):
                break
            at += 1
            whole = not (stack and stack[-1] == "}" and not after_colon)
        elif said in _CLOSERS:
            if stack and stack[-1] == "}" and not after_colon:
                break
            stack.append(_CLOSERS[said])
            after_colon = False
            safe = (at, "".join(reversed(stack)))
            continue
        elif said in "}]":
            if not stack or stack.pop() != said:
                break
            whole = True
        elif said == ":":
            after_colon = True
            continue
        elif said == ",":
            after_colon = False
            continue
        else:
            whole = at < len(text) and re.fullmatch(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null", said) is not None
            if not whole:
                break
        if whole:
            after_colon = False
            safe = (at, "".join(reversed(stack)))
            if not stack:
                break
    return text[start : safe[0]] + safe[1]


@F.pandas_udf(T.StringType())
def repair_json(text: pd.Series) -> pd.Series:
    """``repaired`` as a column."""
    return text.map(repaired)
