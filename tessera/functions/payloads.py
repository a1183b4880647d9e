"""Answer payloads and their schemas, on the driver: closed schemas, checks, fallbacks."""

from __future__ import annotations

import hashlib
import json
import re

#: What a field of a fallback answer holds, by its name.
BY_NAME = {"found": False, "sources": [], "confidence": "low", "title": "Not found"}
#: Fields that hold the fallback's text.
TEXT_FIELDS = ("interpretation", "answer", "message", "summary")
#: What a field holds by its type, if its name says nothing.
BY_TYPE = {"array": [], "boolean": False, "integer": 0, "number": 0.0, "string": ""}
#: Fields that make an answer a documentation payload.
REQUIRED = ("title", "interpretation", "confidence")
#: Python types of JSON types.
_TYPES = {"array": list, "object": dict, "boolean": bool, "integer": int, "number": (int, float), "string": str, "null": type(None)}


def closed_schema(schema: dict) -> dict:
    """A self-contained schema: local references are replaced by what they name, and
    objects allow no other fields unless they say so. A recursive reference raises."""
    named = {f"#/$defs/{name}": part for name, part in schema.get("$defs", {}).items()}

    def flat(node, within: tuple[str, ...] = ()):
        if isinstance(node, list):
            return [flat(x, within) for x in node]
        if not isinstance(node, dict):
            return node
        to = node.get("$ref")
        if to in named:
            if to in within:
                raise ValueError(f"recursive schema: {to}")
            own = {k: v for k, v in node.items() if k != "$ref"}
            return flat({**named[to], **own}, (*within, to))
        out = {k: flat(v, within) for k, v in node.items() if k != "$defs"}
        return {**out, "additionalProperties": out.get("additionalProperties", False)} if out.get("type") == "object" else out

    return flat(schema)


def _kind(field: dict) -> dict:
    """A field's schema without the alternative of null."""
    real = [x for x in field.get("anyOf", ()) if x.get("type") != "null"]
    return real[0] if len(real) == 1 else field


def fallback_payload(schema: dict, text: str) -> dict:
    """A payload of a closed schema for when there is no answer: by the field's name, its
    type, its default, else null."""

    def value(name: str, field: dict):
        kind = _kind(field)
        if name in BY_NAME:
            return BY_NAME[name]
        if name in TEXT_FIELDS:
            return text
        if kind.get("type") == "object":
            return {n: value(n, f) for n, f in kind.get("properties", {}).items()}
        return BY_TYPE.get(kind.get("type"), field.get("default"))

    return {name: value(name, field) for name, field in schema.get("properties", {}).items()}


def problems(schema: dict, value, at: str = "answer") -> list[str]:
    """What is wrong with a value by a closed schema: types, missing and unknown fields."""
    kinds = [x.get("type") for x in schema.get("anyOf", [schema])]
    known = [_TYPES[k] for k in kinds if k in _TYPES]
    fits = any(isinstance(value, t) and not (isinstance(value, bool) and t is not bool) for t in known)
    if known and not fits:
        return [f"{at} is not of type {' or '.join(k for k in kinds if k)}"]
    kind = _kind(schema)
    if isinstance(value, dict) and kind.get("type") == "object":
        fields = kind.get("properties", {})
        out = [f"{at}.{n} is missing" for n in kind.get("required", ()) if n not in value]
        if kind.get("additionalProperties") is False:
            out += [f"{at}.{n} is unknown" for n in value if n not in fields]
        return out + [p for n, f in fields.items() if n in value for p in problems(f, value[n], f"{at}.{n}")]
    if isinstance(value, list) and "items" in kind:
        return [p for i, x in enumerate(value) for p in problems(kind["items"], x, f"{at}[{i}]")]
    return []


def repaired_json(text: str):
    """The value of a model's JSON, or None: a fence, line comments and trailing commas
    go, missing closing brackets are added."""
    fenced = re.search(r"```(?:json)?(.*?)(?:```|$)", text, re.S)
    clean = (fenced.group(1) if fenced else text).strip()
    clean = re.sub(r"(?m)^\s*//[^\n]*", "", clean)
    clean = re.sub(r",(\s*[}\]])", r"\1", clean).translate(str.maketrans("„”“‘’", "'''''"))
    lacking = [max(0, clean.count(a) - clean.count(b)) for a, b in ("{}", "[]")]
    for attempt in (clean, clean + "}" * lacking[0] + "]" * lacking[1]):
        try:
            return json.loads(attempt)
        except ValueError:
            continue
    return None


def coerced(raw: str, parsed, text: str = "No answer was found.") -> dict | None:
    """A documentation payload of a reply: the parsed one if it has the required fields;
    one that says that nothing was found for a message, ``found: false`` or plain text;
    None for any other object."""
    missing = {"title": BY_NAME["title"], "interpretation": text, "confidence": BY_NAME["confidence"], "found": False, "sources": []}
    if isinstance(parsed, dict):
        if all(k in parsed for k in REQUIRED):
            return parsed
        told = isinstance(parsed.get("message"), str) and parsed["message"].strip()
        return missing if told or parsed.get("found") is False else None
    return missing if isinstance(raw, str) and raw.strip() else None


def cache_key(model: str, system: str, tools: list, messages: list[dict]) -> str:
    """A key that calls of one question share: of the model, the system prompt, the tools
    and the first text of the user."""
    texts = (block["text"] for m in messages if m.get("role") == "user" for block in m.get("content", ()) if block.get("text"))
    material = {"model": model, "system_prompt": system, "tools": tools, "first_user_text": next(texts, "")}
    return "agentic-rag:" + hashlib.sha256(json.dumps(material, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
