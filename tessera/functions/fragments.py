"""Stitching of a JSON text that arrived in fragments.

A model that runs out of room stops anywhere; asked to go on, it repeats something, puts
its part into a fence, or begins again after the last object that was whole. Fragments
are joined where they overlap, what is still open at the end is closed, and a value that
was cut off is dropped.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X

#: Characters that two fragments share at least to count as overlapping: shorter runs, such
#: as the quote and comma between entries, are often alike by chance.
OVERLAP = 12

#: An entry of a table of contents.
ENTRY = "structure string, title string, page string"


def overlap(head: str, tail: str) -> int:
    """Characters of the longest suffix of head that tail begins with, in linear time: the
    prefix function of tail, carried on over the end of head."""
    end = head[-len(tail) :] if tail else ""
    joined = tail + "\0" + end
    border = [0] * len(joined)
    for i in range(1, len(joined)):
        k = border[i - 1]
        while k and joined[i] != joined[k]:
            k = border[k - 1]
        border[i] = k + (joined[i] == joined[k])
    return border[-1] if end else 0


def closed(text: str) -> str:
    """text up to its last whole value, with what is open closed; text as it is if nothing
    is open. One pass of an automaton with a stack of brackets."""
    stack: list[str] = []
    safe, at_safe = 0, ""  # where the text may end, and what closes it there
    inside = escaped = False
    key = False  # whether the string just read is a key
    expects = "value"
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if inside:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                inside = False
                if not key:
                    safe, at_safe = i + 1, "".join(reversed(stack))
                    expects = "after"
        elif c == '"':
            inside = True
            key = bool(stack) and stack[-1] == "}" and expects == "key"
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
            expects = "key" if c == "{" else "value"
            safe, at_safe = i + 1, "".join(reversed(stack))
        elif c in "}]":
            if stack and stack[-1] == c:
                stack.pop()
            safe, at_safe = i + 1, "".join(reversed(stack))
            expects = "after"
            if not stack:
                return text[: i + 1]
        elif c == ",":
            expects = "key" if stack and stack[-1] == "}" else "value"
        elif c == ":":
            expects = "value"
        elif c not in " \t\r\n":
            end = i
            while end < n and text[end] not in ",]} \t\r\n":
                end += 1
            if end < n:  # a number or word at the very end may go on
                safe, at_safe = end, "".join(reversed(stack))
                expects = "after"
            i = end - 1
        i += 1
    return text[:safe] + at_safe if stack or inside else text


def _read(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def stitch(parts: list[str], least: int = OVERLAP) -> str | None:
    """One JSON text of the fragments, null if there is none in them."""
    whole = ""
    for part in parts:
        if not whole:
            whole = part
            continue
        n = overlap(whole, part)
        if n >= least:
            whole += part[n:]
            continue
        # Else the part follows at once, or after the last whole object, or begins again.
        direct = whole + part
        end = whole.rfind("}")
        anew = whole[: end + 1] + ("" if part.lstrip().startswith((",", "]", "}")) else ",") + part if end >= 0 else direct
        again = whole + part[n:] if n in (len(whole), len(part)) else direct
        whole = max((direct, anew, again), key=lambda t: (_read(t) is not None, _read(closed(t)) is not None, len(closed(t)), t is direct))
    begins = [i for i in (whole.find("{"), whole.find("[")) if i >= 0]
    if not begins:
        return None
    whole = whole[min(begins) :]
    fixed = whole if _read(whole) is not None else closed(whole)
    return fixed if _read(fixed) is not None else None


@F.pandas_udf(T.StringType())
def _stitched(parts: pd.Series) -> pd.Series:
    return parts.map(lambda p: None if p is None else stitch([x for x in p if x is not None]))


def stitched(fragments: Column) -> Column:
    """JSON text of an array of fragments in order; fences are taken off. A text of one
    fragment that reads as it is needs no help."""
    bare = F.transform(fragments, _unfenced)
    whole = (F.size(bare) == 1) & F.try_parse_json(bare[0]).isNotNull()
    return F.when(whole, bare[0]).otherwise(_stitched(F.when(whole, F.lit(None).cast("array<string>")).otherwise(bare)))


def _unfenced(c: Column) -> Column:
    """A fragment without its fence; white space at a cut belongs to the text."""
    return F.when(X.stripped(c).startswith("```"), F.regexp_replace(F.regexp_replace(c, r"^\s*```(?:json)?\s?", ""), r"\n?```\s*$", "")).otherwise(c)


def contents(payload: Column) -> Column:
    """The entries of a table of contents: an object's table_of_contents or a list; null
    for anything else."""
    value = F.try_parse_json(payload)
    kind = F.schema_of_variant(value)
    listed = F.when(kind.startswith("ARRAY"), payload).when(kind.startswith("OBJECT") & F.schema_of_variant(F.try_variant_get(value, "$.table_of_contents", "variant")).startswith("ARRAY"), F.get_json_object(payload, "$.table_of_contents"))
    return F.from_json(listed, f"array<struct<{', '.join(x.replace(' ', ': ') for x in ENTRY.split(', '))}>>")
