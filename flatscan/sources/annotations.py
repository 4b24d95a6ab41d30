"""Logical annotations of a schema element: what they mean, and whether they agree.

A meaning is (kind, scale, precision, unit, adjusted, width, signed). The modern
union and the legacy code are each turned into one; where both are there they
must be equal, and the physical type must be able to hold what they mean.
"""

from __future__ import annotations

import math
from typing import Any, NamedTuple

#: Members of the modern union, legacy codes, units and physical types.
MODERN = {1: "STRING", 2: "MAP", 3: "LIST", 4: "ENUM", 5: "DECIMAL", 6: "DATE", 7: "TIME", 8: "TIMESTAMP", 10: "INTEGER", 11: "UNKNOWN", 12: "JSON", 13: "BSON", 14: "UUID", 15: "FLOAT16", 16: "VARIANT", 17: "GEOMETRY", 18: "GEOGRAPHY", 19: "FILE"}
LEGACY = ("UTF8", "MAP", "MAP_KEY_VALUE", "LIST", "ENUM", "DECIMAL", "DATE", "TIME_MILLIS", "TIME_MICROS", "TIMESTAMP_MILLIS", "TIMESTAMP_MICROS", "UINT_8", "UINT_16", "UINT_32", "UINT_64", "INT_8", "INT_16", "INT_32", "INT_64", "JSON", "BSON", "INTERVAL")
UNITS = {1: "MILLIS", 2: "MICROS", 3: "NANOS"}
PHYSICAL = ("BOOLEAN", "INT32", "INT64", "INT96", "FLOAT", "DOUBLE", "BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY")
#: Kinds that only name what a value is; no meaning is given to the ones left out.
WITHOUT_MEANING = {"VARIANT", "GEOMETRY", "GEOGRAPHY", "FILE"}
#: Physical type, and width where it is fixed, of kinds that have only one.
HOLDS = {"STRING": "BYTE_ARRAY", "ENUM": "BYTE_ARRAY", "JSON": "BYTE_ARRAY", "BSON": "BYTE_ARRAY", "DATE": "INT32", "TIMESTAMP": "INT64"}
FIXED_WIDTH = {"UUID": 16, "FLOAT16": 2, "INTERVAL": 12}


class Meaning(NamedTuple):
    kind: str
    scale: int | None = None
    precision: int | None = None
    unit: str | None = None
    adjusted: bool | None = None
    width: int | None = None
    signed: bool | None = None


def physical_name(code: int | None) -> str | None:
    return PHYSICAL[code] if code is not None and 0 <= code < len(PHYSICAL) else None


def modern_meaning(union: dict[str, Any]) -> Meaning | None:
    kind = MODERN.get(union["member"])
    if kind is None or kind in WITHOUT_MEANING:
        return None
    body = union.get("body") or {}
    unit = UNITS.get((body.get("unit") or {}).get("member"))
    if kind in ("TIME", "TIMESTAMP") and unit is None:
        return None
    return Meaning(kind, body.get("scale"), body.get("precision"), unit, body.get("adjusted"), body.get("width"), body.get("signed"))


def legacy_meaning(code: int, scale: int | None, precision: int | None) -> Meaning | None:
    if not 0 <= code < len(LEGACY):
        return None
    name = LEGACY[code]
    head, _, tail = name.rpartition("_")
    if head in ("TIME", "TIMESTAMP"):
        return Meaning(head, unit=tail, adjusted=True)
    if head in ("INT", "UINT"):
        return Meaning("INTEGER", width=int(tail), signed=head == "INT")
    if name == "DECIMAL":
        return Meaning(name, scale, precision)
    return Meaning("STRING" if name == "UTF8" else name)


def _holds(meaning: Meaning, physical: str | None, width: int | None) -> bool:
    kind = meaning.kind
    if kind in FIXED_WIDTH:
        return physical == "FIXED_LEN_BYTE_ARRAY" and width == FIXED_WIDTH[kind]
    if kind in HOLDS:
        return physical == HOLDS[kind]
    if kind in ("MAP", "MAP_KEY_VALUE", "LIST"):
        return physical is None
    if kind == "UNKNOWN":
        return physical is not None
    if kind == "INTEGER":
        return physical == ("INT64" if meaning.width == 64 else "INT32")
    if kind == "TIME":
        return physical == ("INT32" if meaning.unit == "MILLIS" else "INT64")
    digits = {"INT32": 9, "INT64": 18, "BYTE_ARRAY": math.inf}.get(physical, 0)
    if physical == "FIXED_LEN_BYTE_ARRAY" and width and width > 0:
        digits = math.floor((8 * width - 1) * math.log10(2))
    return 0 < (meaning.precision or 0) <= digits


def _well_formed(element: dict[str, Any]) -> bool:
    union, scale, precision = element.get("logical"), element.get("scale"), element.get("precision")
    body = (union or {}).get("body") or {}
    decimal = lambda s, p: s is not None and p is not None and 0 <= s <= p and p > 0
    kind = MODERN.get(union["member"]) if union else None
    if kind == "DECIMAL" and not (decimal(body.get("scale"), body.get("precision")) and (scale, precision) == (body["scale"], body["precision"])):
        return False
    if element.get("converted") == LEGACY.index("DECIMAL") and not decimal(scale, precision):
        return False
    return kind != "INTEGER" or body.get("width") in (8, 16, 32, 64)


def resolve(element: dict[str, Any]) -> tuple[str, Meaning | None]:
    """Status and meaning of an element's annotations."""
    union, code = element.get("logical"), element.get("converted")
    if not _well_formed(element):
        return "INVALID", None
    if union is None and code is None:
        return "NONE", None
    modern = modern_meaning(union) if union is not None else None
    legacy = legacy_meaning(code, element.get("scale"), element.get("precision")) if code is not None else None
    if union is not None and code is not None:
        if modern is None or modern != legacy:
            return "CONFLICT", None
        status, meaning = "CONSISTENT", modern
    else:
        status, meaning = ("MODERN_ONLY", modern) if code is None else ("LEGACY_ONLY", legacy)
    if meaning is not None and not _holds(meaning, physical_name(element.get("type")), element.get("type_length")):
        return "INVALID", None
    return status, meaning
