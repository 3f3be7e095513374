"""YAML front matter as properties: one Arrow-batched function, JSON with sorted keys out.

YAML 1.2 core rules decide plain scalars: true/false only are booleans, no base-60
numbers, 0o octals, exponents without a point are floats, and dates with one-digit
months count. Duplicate keys and roots that are not mappings are errors. JSON cannot hold NaN,
infinities and bytes: they become null and an error.
"""

from __future__ import annotations

import json
import math
import re
from datetime import UTC, datetime, timedelta, timezone

import pandas as pd
import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F

_FLOAT = re.compile(r"[-+]?(\.[0-9]+|[0-9]+(\.[0-9]*)?)([eE][-+]?[0-9]+)?")
_INT = re.compile(r"[-+]?(0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|0[0-7_]*|[1-9][0-9_]*)")
_TIME = re.compile(r"(\d{4})-(\d{1,2})-(\d{1,2})(?:(?:[Tt]|[ ]+)(\d{1,2}):(\d{1,2}):(\d{1,2})(?:\.(\d{1,9}))?(?:[ ]*(Z|[-+]\d{2}:\d{2}))?)?")
_CONSTANTS = {**dict.fromkeys(("true", "True", "TRUE"), True), **dict.fromkeys(("false", "False", "FALSE"), False), **dict.fromkeys(("", "~", "null", "Null", "NULL"))}
_INFINITE = {".inf": math.inf, "+.inf": math.inf, "-.inf": -math.inf, ".nan": math.nan}
_TAG = "tag:yaml.org,2002:"


class _Loader(yaml.BaseLoader):
    """Leaves plain scalars untyped and remembers which had a tag written."""

    def compose_scalar_node(self, anchor):
        tag = self.peek_event().tag
        node = super().compose_scalar_node(anchor)
        node.written = tag if tag not in (None, "!") else None
        node.quoted = node.style is not None or tag == "!"
        return node


def _time(text: str) -> str | None:
    m = _TIME.fullmatch(text)
    if not m:
        return None
    year, month, day, hour, minute, second = (int(x or 0) for x in m.groups()[:6])
    zone = UTC
    if m[8] and m[8] != "Z":
        sign = -1 if m[8][0] == "-" else 1
        zone = timezone(sign * timedelta(hours=int(m[8][1:3]), minutes=int(m[8][4:6])))
    try:
        at = datetime(year, month, day, hour, minute, second, tzinfo=zone)
    except ValueError:
        return None
    part = (m[7] or "").rstrip("0")
    offset = "Z" if at.utcoffset() == timedelta(0) else m[8]
    return at.strftime("%Y-%m-%dT%H:%M:%S").rjust(19, "0") + (f".{part}" if part else "") + offset


def _number(text: str):
    if _INT.fullmatch(text):
        plain = text.replace("_", "")
        sign, digits = (-1 if plain[0] == "-" else 1), plain.lstrip("+-")
        base = {"x": 16, "b": 2, "o": 8}.get(digits[1:2].lower(), 8 if len(digits) > 1 and digits[0] == "0" else 10)
        value = sign * int(digits[2:] if digits[1:2].isalpha() else digits, base)
        return value if -(1 << 63) <= value < 1 << 64 else float(value)
    if _FLOAT.fullmatch(text.replace("_", "") if text[:1] != "_" else text):
        return float(text.replace("_", ""))
    return None


class _Reader:
    def __init__(self):
        self.problems: list[str] = []

    def scalar(self, node):
        text, tag = node.value, (node.written or "").removeprefix(_TAG)
        if tag in ("str", "binary") or (node.quoted and not tag):
            if tag == "binary":
                self.problems.append("bytes have no JSON form")
                return None
            return text
        if not tag and text in _CONSTANTS:
            return _CONSTANTS[text]
        if tag in ("bool", "null") and text in _CONSTANTS:
            return _CONSTANTS[text]
        if text.lower() in _INFINITE:
            self.problems.append(f"{text} has no JSON form")
            return None
        if tag in ("", "int", "float") and (number := _number(text)) is not None:
            return float(number) if tag == "float" else number
        if tag in ("", "timestamp") and (at := _time(text)) is not None:
            return at
        if tag in ("int", "float", "bool", "null", "timestamp"):
            raise yaml.YAMLError(f"cannot read {text!r} as {tag}")
        return text

    def mapping(self, node, seen) -> dict:
        out, merged = {}, {}
        for key, value in node.value:
            if isinstance(key, yaml.ScalarNode) and key.value == "<<" and not key.quoted:
                for part in value.value if isinstance(value, yaml.SequenceNode) else [value]:
                    if not isinstance(part, yaml.MappingNode):
                        raise yaml.YAMLError("map merge requires map or sequence of maps as the value")
                    merged = self.mapping(part, seen) | merged
                continue
            if not isinstance(key, yaml.ScalarNode):
                raise yaml.YAMLError("a key is not a scalar")
            if key.value in out:
                raise yaml.YAMLError(f"line {key.start_mark.line + 1}: mapping key {key.value!r} already defined")
            out[key.value] = self.value(value, seen)
        return merged | out

    def value(self, node, seen=()):
        if isinstance(node, yaml.ScalarNode):
            return self.scalar(node)
        if id(node) in seen:
            raise yaml.YAMLError("an anchor contains itself")
        seen = (*seen, id(node))
        return self.mapping(node, seen) if isinstance(node, yaml.MappingNode) else [self.value(v, seen) for v in node.value]


def parse(text: str | None) -> tuple[str | None, str | None]:
    """(properties as JSON, error). Empty front matter has neither."""
    if not text:
        return None, None
    reader = _Reader()
    try:
        root = yaml.compose(text, Loader=_Loader)
        if root is None or (isinstance(root, yaml.ScalarNode) and reader.scalar(root) is None):
            return None, None
        if not isinstance(root, yaml.MappingNode):
            return None, "front matter is not a mapping"
        found = reader.value(root)
    except (yaml.YAMLError, ValueError, RecursionError) as e:
        return None, " ".join(str(e).split())
    return json.dumps(found, sort_keys=True, ensure_ascii=False, separators=(",", ":")), "; ".join(reader.problems) or None


def properties(front_matter: Column) -> Column:
    """struct(properties_json, error). Notes without front matter send only a null to Python."""

    @F.pandas_udf("properties_json string, error string")
    def parsed(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(t) for t in texts], columns=["properties_json", "error"])

    return parsed(F.when(front_matter != "", front_matter))
