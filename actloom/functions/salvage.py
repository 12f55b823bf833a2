"""JSON out of replies that hold other things as well: fenced, bare, or among noise.

Each form gives the text of what it found; :func:`variant` makes it a VARIANT. JSON here is what Spark's parser takes:
no repeated keys, no NaN, and some 1,000 levels at most.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(c: Column, f) -> Column:
    """``f`` of a value that is made once a row, however often ``f`` names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def trimmed(c: Column) -> Column:
    """A text without white space at its ends, which alone are looked at."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def is_json(c: Column) -> Column:
    """Whether a text is one JSON value and nothing else.

    The parser stops after the first value, so it is asked twice: what passes as an array's only element and as
    an object's only value has nothing behind it.
    """
    return F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}"))).isNotNull()


def variant(c: Column) -> Column:
    """The VARIANT of a salvaged text; null if there is none."""
    return F.try_parse_json(c)


def between(c: Column, opens: str, closes: str) -> Column:
    """From the first ``opens`` to the last ``closes``, both included; null if they do not stand in that order."""
    begin, back = F.instr(c, opens), F.instr(F.reverse(c), closes)
    stop = F.length(c) - back + 1
    return F.when((begin > 0) & (back > 0) & (stop > begin), F.substring(c, begin, stop - begin + 1))


def _first(*candidates: Column) -> Column:
    return F.coalesce(*[bound(c, lambda x: F.when(is_json(x), x)) for c in candidates])


def reply_json(c: Column) -> Column:
    """What a fence holds, else the whole text if it starts like JSON, else the widest array, else the widest object."""

    def found(t):
        fence = F.when(F.contains(t, F.lit("```")), trimmed(F.regexp_extract(t, r"(?is)```(?:json)?\s*(.*?)```", 1)))
        whole = F.when(F.substring(t, 1, 1).isin("{", "["), t)
        return _first(F.nullif(fence, F.lit("")), whole, between(t, "[", "]"), between(t, "{", "}"))

    return bound(trimmed(c), found)


def object_json(c: Column) -> Column:
    """The widest object, after back-quotes at both ends of a fenced text are taken away."""
    bare = bound(trimmed(c), lambda t: F.when(t.startswith("```"), trimmed(F.btrim(t, F.lit("`")))).otherwise(t))
    return bound(bare, lambda t: _first(between(t, "{", "}")))


def any_json(c: Column) -> Column:
    """The whole text, or of a fenced text what the fence holds, as any JSON value; else the widest object there."""

    def held(t):
        inner = F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
        return F.when(t.startswith("```") & F.rlike(t, F.lit(r"(?s)```.*```")), trimmed(inner)).otherwise(t)

    return bound(bound(trimmed(c), held), lambda t: _first(t, between(t, "{", "}")))


_MARKS = re.compile(r'["\\\[\]{}]')
_OPENERS = re.compile(r"[\[{]")


def _reject(name):
    raise ValueError(name)


def _flat(text: str) -> bool:
    """Whether a value is JSON; what it nests stands in it as 0."""
    try:
        json.loads(text, parse_constant=_reject)
    except ValueError:
        return False
    return True


def first_span(text: str) -> tuple[int, int] | None:
    """(begin, end) of the first array or object of a text, at whatever place, that is valid JSON.

    Brackets are matched by a stack, strings left out, from each opener that no earlier match has met. An inner value is checked
    once, then stands as a number in what holds it, so a value costs its own characters whatever its depth.
    """
    met: set[int] = set()
    best: tuple[int, int] | None = None
    for opener in _OPENERS.finditer(text):
        if best and opener.start() > best[0]:
            break
        if opener.start() in met:
            continue
        stack: list[list] = []  # [begin, parts so far, where the next part begins, whether all inside is valid]
        quoted, escaped = False, -1
        for mark in _MARKS.finditer(text, opener.start()):
            at, c = mark.start(), mark.group()
            if quoted:
                if at == escaped:
                    continue
                if c == "\\":
                    escaped = at + 1
                elif c == '"':
                    quoted = False
            elif c == '"':
                quoted = True
            elif c in "[{":
                met.add(at)
                stack.append([at, [], at, True])
            elif c in "]}":
                begin, parts, since, fine = stack.pop()
                if text[begin] + c not in ("[]", "{}"):
                    break
                parts.append(text[since : at + 1])
                fine = fine and _flat("".join(parts))
                if fine and (best is None or begin < best[0]):
                    best = begin, at + 1
                if not stack:
                    break
                up = stack[-1]
                up[1] += [text[up[2] : begin], " 0 "]
                up[2], up[3] = at + 1, up[3] and fine
        if best and best[0] == opener.start():
            break
    return best


def first_json(c: Column) -> Column:
    """The first valid array or object of a text, wherever it stands; null if there is none."""

    @F.pandas_udf("string")
    def found(replies):
        import pandas as pd

        spans = (first_span(t) if t else None for t in replies)
        return pd.Series([t[slice(*span)] if span else None for t, span in zip(replies, spans, strict=True)], dtype=object)

    return found(c)


def label_payload(v: Column) -> Column:
    """The object that carries a label: the VARIANT itself, or of an array its first object with a label or an action.

    An earlier object can only outrank it by reusing a label, for which it must have an action itself, so there is none.
    Null for anything else.
    """
    is_object = lambda x: F.schema_of_variant(x).startswith("OBJECT")
    has = lambda x, key: F.try_variant_get(x, f"$.{key}", "variant").isNotNull()
    told = lambda x: F.filter(F.try_variant_get(x, "$", "array<variant>"), lambda y: is_object(y) & (has(y, "label") | has(y, "action")))
    return bound(v, lambda x: F.when(is_object(x), x).otherwise(F.get(told(x), F.lit(0))))
