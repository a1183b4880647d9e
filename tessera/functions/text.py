"""Scalar text functions as Columns."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LATIN = [c for c in map(chr, range(0xC0, 0x250)) if len(d := unicodedata.normalize("NFKD", c)) > 1 and d[0].isascii() and all(map(unicodedata.combining, d[1:]))]
#: Accented Latin letters and what they fold to.
FOLD_FROM, FOLD_TO = "".join(_LATIN), "".join(unicodedata.normalize("NFKD", c)[0] for c in _LATIN)

#: Fixed values of the scorer.
PREFIXES = ("the answer is", "answer:", "answer is")
UNANSWERABLE = ("not answerable", "unanswerable", "cannot be determined", "cannot be answered", "not enough information", "context_overflow")
YES, NO = ("yes", "true", "correct"), ("no", "false", "incorrect")
FORMATS = {"Str": "entity", "Int": "numeric", "Float": "numeric", "None": "unanswerable", "Bool": "boolean", "Boolean": "boolean", "Percentage": "percentage"}
TOLERANCE, SIMILAR, ANLS_LEAST = 0.05, 0.8, 0.5
#: Digits from which on a whole number is no long; a shorter one that is kept as a
#: decimal was written with a point.
WIDE = 19


def once(value: Column, body) -> Column:
    """body(value) with value computed once; code that is generated for an expression
    with many uses of a costly part would grow beyond what the compiler takes."""
    return F.transform(F.array(value), body)[0]


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return stripped(F.coalesce(c, F.lit(""))) == ""


def folded(c: Column) -> Column:
    """Lower case without accents; a text of ASCII alone needs no table."""
    other = F.rlike(c, F.lit(r"[^\x00-\x7F]"))
    return F.when(other, F.translate(F.lower(F.translate(c, FOLD_FROM, FOLD_TO)), FOLD_FROM, FOLD_TO)).otherwise(F.lower(c))


@F.pandas_udf(T.StringType())
def _casefolded(c: pd.Series) -> pd.Series:
    return c.map(lambda t: None if t is None else t.casefold())


def casefolded(c: Column) -> Column:
    """Full case folding (ligatures and sharp s included); ASCII texts by the engine."""
    other = F.rlike(c, F.lit(r"[^\x00-\x7F]"))
    return F.when(other, _casefolded(F.when(other, c))).otherwise(F.lower(c))


@F.pandas_udf(T.StringType())
def _decomposed_key(c: pd.Series) -> pd.Series:
    """Keys of texts beyond ASCII; the engine has no compatibility decomposition."""

    def key(text: str | None) -> str | None:
        if text is None:
            return None
        plain = "".join(x for x in unicodedata.normalize("NFKD", text) if not unicodedata.combining(x))
        return re.sub(r"[\s_.\-]+", " ", plain).strip().lower()

    return c.map(key)


def match_key(c: Column) -> Column:
    """Key of fuzzy comparison: without marks (compatibility decomposition), separators
    as one space, stripped, lower case. ASCII texts are folded by the engine."""
    other = F.rlike(c, F.lit(r"[^\x00-\x7F]"))
    plain = F.trim(F.lower(F.regexp_replace(c, r"[\x09-\x0D\x1C-\x20_.\-]+", " ")))
    return F.when(other, _decomposed_key(F.when(other, c))).otherwise(plain)


def terms(c: Column) -> Column:
    """Document-side search terms: folded runs of letters and digits."""
    return F.regexp_extract_all(folded(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def query_terms(c: Column) -> Column:
    """Query-side terms: ASCII runs with underscores, lower case, duplicates kept."""
    return F.transform(F.regexp_extract_all(c, F.lit("([0-9A-Za-z_]+)"), F.lit(1)), F.lower)


def normalised_answer(c: Column) -> Column:
    # Each prefix goes if the text starts with it when its turn comes.
    lead = "".join(rf"(?:{p}\s*)?" for p in PREFIXES)
    out = F.regexp_replace(F.lower(stripped(c)), f"(?U)^{lead}", "")
    out = F.regexp_replace(out, r"(?U)[^\w\s.\-%]", "")
    out = F.regexp_replace(out, r"(?U)\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def number(c: Column) -> Column:
    """The first number of a text, null if there is none."""
    return F.nullif(F.regexp_extract(F.regexp_replace(c, "[, ]", ""), r"[-+]?\d*\.?\d+", 0), F.lit("")).try_cast("double")


def similarity(a: Column, b: Column) -> Column:
    def of(s: Column) -> Column:
        x, y = s["x"], s["y"]
        longest = F.greatest(F.length(x), F.length(y))
        return F.when((x == "") & (y == ""), 1.0).when((x == "") | (y == ""), 0.0).otherwise(1 - F.levenshtein(x, y) / longest)

    return once(F.struct(F.lower(stripped(a)).alias("x"), F.lower(stripped(b)).alias("y")), of)


def anls(a: Column, b: Column) -> Column:
    return once(similarity(a, b), lambda s: F.when(s >= ANLS_LEAST, s).otherwise(0.0))


def float_text(d: Column) -> Column:
    """A double as the shortest text that reads back: 1.0, 1e-05, 1e+16."""
    raw = d.cast("string")
    mantissa, exponent = F.substring_index(raw, "E", 1), F.substring_index(raw, "E", -1).try_cast("int")
    sign = F.when(raw.startswith("-"), "-").otherwise("")
    digits = F.regexp_replace(F.translate(mantissa, "-.", ""), "(?<=.)0+$", "")
    n = F.length(digits)
    large = F.when(n <= exponent + 1, F.concat(F.rpad(digits, exponent + 1, "0"), F.lit(".0"))).otherwise(F.concat(F.substr(digits, F.lit(1), exponent + 1), F.lit("."), F.substr(digits, exponent + 2)))
    power = F.concat(F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), "0"))
    short = F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""), power)
    small = F.concat(F.lit("0.000"), digits)
    # The engine turns to an exponent outside 1e-3 to 1e7, the format outside 1e-4 to 1e16.
    return F.when(~F.contains(raw, F.lit("E")), raw).otherwise(F.concat(sign, F.when(exponent == -4, small).when((exponent > 0) & (exponent < 16), large).otherwise(short)))


def spaced_json(c: Column) -> Column:
    """JSON without spaces as one with a space after each comma and colon."""
    parts = F.regexp_extract_all(c, F.lit(r'("(?:[^"\\]|\\.)*"|[,:]|[^",:]+)'), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.when(x.isin(",", ":"), F.concat(x, F.lit(" "))).otherwise(x)), "")


def string_value(value: Column) -> Column:
    """A JSON value as text: null is '', booleans are True and False, whole numbers and
    texts as they read, other numbers in float notation, objects (keys sorted) and arrays
    as JSON with a space after commas and colons."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    number = float_text(F.try_variant_get(value, "$", "double"))
    return (
        F.when(value.isNull() | (kind == "VOID"), "")
        .when(kind == "BOOLEAN", F.initcap(text))
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), spaced_json(F.to_json(value)))
        .when(kind.isin("DOUBLE", "FLOAT") | (kind.startswith("DECIMAL") & (~kind.endswith(",0)") | (F.length(text) < WIDE))), number)
        .otherwise(text)
    )


def _any(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def token_f1(prediction: Column, gold: Column) -> Column:
    words = lambda c: F.array_remove(F.array_distinct(F.split(normalised_answer(c), " ")), "")
    sizes = lambda s: F.struct(F.size(s["p"]).alias("p"), F.size(s["g"]).alias("g"), F.size(F.array_intersect(s["p"], s["g"])).alias("same"))

    def of(n: Column) -> Column:
        precision, recall = n["same"] / n["p"], n["same"] / n["g"]
        return F.when(n["g"] == 0, F.when(n["p"] == 0, 1.0).otherwise(0.0)).when((n["p"] == 0) | (n["same"] == 0), 0.0).otherwise(2 * precision * recall / (precision + recall))

    return once(once(F.struct(words(prediction).alias("p"), words(gold).alias("g")), sizes), of)


def answer_type(raw: Column, rule: Column) -> Column:
    raw = F.coalesce(F.nullif(raw, F.lit("")), F.lit("Str"))
    known = reduce(lambda rest, x: F.when(raw == x[0], x[1]).otherwise(rest), FORMATS.items(), F.lit(None))
    return F.coalesce(known, F.when(F.contains(rule, F.lit("numeric")) | F.contains(rule, F.lit("tolerance")), "numeric").otherwise(F.lower(raw)))


def relaxed_accuracy(prediction: Column, gold: Column, kind: Column) -> Column:
    """1 or 0 by answer type; types that find nothing to compare fall through."""
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    option = lambda c: F.regexp_extract(F.upper(stripped(c)), r"(?U)\b([A-D])\b", 1)
    texts = F.struct(normalised_answer(prediction).alias("p"), normalised_answer(gold).alias("g"), option(prediction).alias("op"), option(gold).alias("og"), kind.alias("kind"))

    def known(s: Column) -> Column:
        said = F.when(_any(s["p"], YES), True).when(_any(s["p"], NO), False)
        return F.struct(s["p"].alias("p"), s["g"].alias("g"), s["op"].alias("op"), s["og"].alias("og"), s["kind"].alias("kind"), number(s["p"]).alias("np"), number(s["g"]).alias("ng"), said.alias("said"))

    def of(s: Column) -> Column:
        p, g, np, ng, kind = (s[c] for c in ("p", "g", "np", "ng", "kind"))
        boolean = F.when(s["said"].isNull(), 0.0).otherwise(one(s["said"] == _any(g, YES)))
        numeric = F.when(ng == 0, one(F.abs(np) < 1e-6)).otherwise(one(F.abs(np - ng) / F.abs(ng) <= TOLERANCE))
        return (
            F.when(kind == "unanswerable", one(_any(p, UNANSWERABLE)))
            .when(kind == "boolean", boolean)
            .when(kind.isin("numeric", "percentage") & np.isNotNull() & ng.isNotNull(), numeric)
            .when((kind == "single_choice") & (s["op"] != "") & (s["og"] != ""), one(s["op"] == s["og"]))
            .otherwise(one(((g != "") & F.contains(p, g)) | (similarity(p, g) >= SIMILAR)))
        )

    return once(once(texts, known), of)


def chunk_identity(kind: Column, path: Column, index: Column, section_id: Column, title: Column, own_id: Column | None = None, content: Column | None = None) -> Column:
    """SHA-1 of the chunk's coordinates; a null reads ``None``.

    Without a path or an index it is the chunk's own id if it has one, else the SHA-1
    of its content.
    """
    parts = [F.coalesce(c.cast("string"), F.lit("None")) for c in (kind, path, index, section_id, title)]
    whole = F.sha1(F.concat_ws("::", *parts))
    if own_id is None and content is None:
        return whole
    rest = [F.nullif(own_id, F.lit(""))] if own_id is not None else []
    rest += [F.sha1(F.coalesce(content, F.lit("")))] if content is not None else []
    return F.when(path.isNotNull() & index.isNotNull(), whole).otherwise(F.coalesce(*rest))


def canonical_json(c: Column) -> Column:
    """JSON with sorted keys and without spaces; malformed text raises."""
    value = F.try_parse_json(c)
    return F.when(value.isNull(), F.raise_error(F.concat(F.lit("invalid JSON: "), F.coalesce(c, F.lit("null"))))).otherwise(F.to_json(value))


def portable_key(path: Column) -> Column:
    """A path below ``datasets`` from an absolute path of any system."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    absolute = slashed.rlike(r"^(/|[A-Za-z]:/)")
    below = F.regexp_extract(slashed, r"/(datasets/.+)$", 1)
    return F.when(~absolute | (below == ""), slashed).otherwise(below)


def relative_key(path: Column, root: str) -> Column:
    """A path relative to root; one outside raises."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 30)).when(~path.startswith("/"), path).otherwise(F.raise_error(F.concat(F.lit("outside the root: "), path)))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[^\w\-.]", "_")


def preview(c: Column, most: int) -> Column:
    """One line of at most ``most`` characters, with the whole length if cut."""
    line = F.replace(c, F.lit("\n"), F.lit("\\n"))
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.substring(line, 1, most), F.lit("... ("), F.length(c), F.lit(" chars)")))


def clean_json(c: Column) -> Column:
    """A model's JSON without fence, line comments, trailing commas and curly quotes."""
    fenced = lambda mark: F.trim(F.split(F.split(c, mark, 3)[1], "```", 2)[0])
    out = F.when(F.contains(c, F.lit("```json")), fenced("```json")).when(F.contains(c, F.lit("```")), fenced("```")).otherwise(stripped(c))
    out = F.regexp_replace(out, r"(?m)^\s*//[^\n]*", "")
    out = F.regexp_replace(out, r",(\s*[}\]])", "$1")
    return F.translate(out, "„”“‘’", "'''''")


def closed_json(c: Column) -> Column:
    """Missing braces, then brackets, added by count."""
    count = lambda s: F.length(c) - F.length(F.replace(c, F.lit(s), F.lit("")))
    missing = lambda a, b: F.greatest(count(a) - count(b), F.lit(0))
    braces = missing("{", "}")
    return F.concat(c, F.when(braces > 0, "\n").otherwise(""), F.repeat(F.lit("}"), braces), F.repeat(F.lit("]"), missing("[", "]")))


def parsed_json(c: Column) -> Column:
    """The value of cleaned JSON, closed if that makes it valid, else null."""
    clean = clean_json(c)
    return F.coalesce(F.try_parse_json(clean), F.try_parse_json(closed_json(clean)))


def verdict(c: Column) -> Column:
    """struct<correct, reasoning> of a judge's reply: JSON, or the word true or false."""
    value = parsed_json(c)
    flag = F.try_variant_get(value, "$.correct", "boolean")
    low = F.lower(c)
    plain = F.when(F.contains(low, F.lit("true")), True).when(F.contains(low, F.lit("false")), False)
    return F.struct(F.coalesce(flag, plain).alias("correct"), F.try_variant_get(value, "$.reasoning", "string").alias("reasoning"))


def status_label(score: Column, passing: float = 0.7) -> Column:
    return F.when(score >= passing, "PASS").otherwise("FAIL")


def name_uuid(namespace: str, name: Column) -> Column:
    """UUID version 5 of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F)).bitwiseOR(0x80)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12))


def sentences(c: Column, least: int = 10) -> Column:
    """Stripped pieces between . ! ? and line feeds, longer than ``least``."""
    return F.filter(F.transform(F.split(c, r"[.!?\n]+"), stripped), lambda s: F.length(s) > least)
