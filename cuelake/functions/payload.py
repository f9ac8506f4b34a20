"""JSON values inside free text, and values made safe for JSON."""

from __future__ import annotations

import hashlib
import json
import math
import re
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WALKS = 16
INLINE = 32  # elements up to which an array stays as it is
_FENCE, _FENCE_END = re.compile(r"^```(?:json)?\s*", re.I), re.compile(r"\s*```$")
_OPEN = re.compile(r"[{\[]")


def _ends(text: str, at: int) -> tuple[int, list[tuple[int, int]], int | None]:
    """Walk from a bracket at ``at`` to its partner: where the walk ended, complete bracketed parts, the first bracket in a string.

    Strings and escapes are followed, so brackets inside strings count for nothing.
    """
    stack: list[tuple[str, int]] = []
    parts = []
    quoted = escaped = False
    hidden = None
    for k in range(at, len(text)):
        c = text[k]
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
            elif c in "{[" and hidden is None:
                hidden = k
            continue
        if c == '"':
            quoted = True
        elif c in "{[":
            stack.append((c, k))
        elif c in "}]":
            if stack[-1][0] != ("{" if c == "}" else "["):
                return k, parts, hidden
            parts.append((stack.pop()[1], k + 1))
            if not stack:
                return k + 1, parts, hidden
    return len(text), parts, hidden


def find_value(text: str | None, need_object: bool = False) -> Any:
    """The JSON value of a text: the whole of it, fences aside; else the first object in it, else the first array.

    ``ValueError`` if there is none, or if an object is needed and the whole text is
    another value.  The text is walked from every bracket that no walk before has
    passed, and from those that a fruitless walk took for parts of a string, the latter
    up to ``WALKS`` times the text's length, so brackets in prose cost linear time.
    """
    clean = (text or "").strip()
    if clean.startswith("```"):
        clean = _FENCE_END.sub("", _FENCE.sub("", clean))
    try:
        value = json.loads(clean)
    except (json.JSONDecodeError, RecursionError):
        value = _inside(clean, need_object)
    if need_object and not isinstance(value, dict):
        raise ValueError("the value is no object")
    return value


def _inside(text: str, need_object: bool) -> Any:
    """The first object of a text that reads as JSON, else the first array."""
    array = None
    at = spent = 0
    while m := _OPEN.search(text, at):
        at, parts, hidden = _ends(text, m.start())
        spent += at - m.start()
        tried = -1
        # Outermost parts first; what lies inside one that reads is no candidate of its own.
        for a, b in sorted(parts, key=lambda p: (p[0], -p[1])):
            if a < tried:
                continue
            try:
                value = json.loads(text[a:b])
            except (json.JSONDecodeError, RecursionError):
                tried = max(tried, a + 1 if b - a < 1 << 16 else b)  # a long broken part is not read again piece by piece
                continue
            tried = b
            if isinstance(value, dict):
                return value
            array = value if array is None and not need_object else array
        at = hidden if hidden is not None and spent < WALKS * len(text) else max(at, m.start() + 1)
    if array is None:
        raise ValueError("no JSON value in the text")
    return array


def json_value(text: Column, need_object: bool = False) -> Column:
    """``find_value`` as JSON text with sorted keys; null when there is none."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            try:
                out.append(json.dumps(find_value(t, need_object), ensure_ascii=False, sort_keys=True, separators=(",", ":")))
            except ValueError:
                out.append(None)
        return pa.array(out, pa.string())

    return run(text)


def safe(value: Any, inline: int = INLINE) -> Any:
    """A value that JSON can hold: keys as sorted strings, no infinite numbers, large arrays as their digest."""
    if isinstance(value, dict):
        return {str(k): safe(v, inline) for k, v in sorted(value.items(), key=lambda p: str(p[0]))}
    if isinstance(value, np.ndarray):
        if value.ndim and value.size > inline:
            raw = np.ascontiguousarray(value).tobytes()
            return {"array_type": "ndarray", "dtype": str(value.dtype), "shape": list(value.shape), "sha256": hashlib.sha256(raw).hexdigest()}
        return safe(value.tolist(), inline)
    if isinstance(value, np.generic):
        return safe(value.item(), inline)
    if isinstance(value, (list, tuple, set)):
        return [safe(v, inline) for v in value]
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    return value if value is None or isinstance(value, (str, int, bool)) else str(value)


def array_payload(values: Column, inline: int = INLINE) -> Column:
    """An array of floats as JSON: its values, or its type, shape and digest when it has more than ``inline`` of them."""

    @F.arrow_udf("string")
    def run(rows: pa.Array) -> pa.Array:
        out = []
        for k in range(len(rows)):
            row = rows[k]
            if not row.is_valid:
                out.append(None)
                continue
            flat = np.array([math.nan if x is None else x for x in row.as_py()], row.type.value_type.to_pandas_dtype())
            out.append(json.dumps(safe(flat, inline), separators=(",", ":")))
        return pa.array(out, pa.string())

    return run(values)
