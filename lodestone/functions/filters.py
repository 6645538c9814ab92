"""Metadata filters: dictionaries in several notations become boolean Columns.

Logic has two values: a comparison with a missing or null field is false, so its negation is true. Only exists,
is_null and is_empty look at missing fields.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EARTH_KM = 6371.0


def field(path: str, schema: T.StructType | None = None, root: str | None = None) -> Column:
    """A dotted path into structs, arrays (by number, from 0), maps and VARIANT columns."""
    head, *rest = path.split(".")
    if root:
        head, rest = root, [head, *rest]
    out = F.col(f"`{head}`")
    kind: T.DataType | None = schema[head].dataType if schema is not None and head in schema.names else None
    for i, step in enumerate(rest):
        if isinstance(kind, T.VariantType):
            tail = "$" + "".join(f"[{s}]" if s.isdigit() else f".{s}" for s in rest[i:])
            return F.try_variant_get(out, tail, "string")
        if isinstance(kind, T.ArrayType) or step.isdigit():
            out, kind = F.get(out, F.lit(int(step))), getattr(kind, "elementType", None)
        elif isinstance(kind, T.MapType):
            out, kind = F.element_at(out, F.lit(step)), kind.valueType
        else:
            kind = kind[step].dataType if isinstance(kind, T.StructType) and step in kind.names else None
            out = out.getField(step)
    return out


def sure(p: Column) -> Column:
    """Two-valued: null is false."""
    return F.coalesce(p, F.lit(False))


def _values(v) -> list:
    return list(v) if isinstance(v, (list, tuple, set)) else [v]


def haversine_km(lat, lon, lat0: float, lon0: float) -> Column:
    lat, lon = lat.cast("double"), lon.cast("double")
    a = F.pow(F.sin(F.radians(lat - lat0) / 2), 2) + math.cos(math.radians(lat0)) * F.cos(F.radians(lat)) * F.pow(F.sin(F.radians(lon - lon0) / 2), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def geo_radius(point: Column, params: dict) -> Column:
    centre = params["center"]
    return haversine_km(point["lat"], point["lon"], centre["lat"], centre["lon"]) <= params["radius_km"]


def geo_box(point: Column, box: dict) -> Column:
    return point["lat"].between(box["min_lat"], box["max_lat"]) & point["lon"].between(box["min_lon"], box["max_lon"])


def date_range(f: Column, low: str | None, high: str | None) -> Column:
    """Both ends inclusive; text that is no date is outside."""
    at = F.try_to_timestamp(f.cast("string"))
    out = at.isNotNull()
    if low is not None:
        out &= at >= F.lit(low).cast("timestamp")
    if high is not None:
        out &= at <= F.lit(high).cast("timestamp")
    return out


def _regex(f: Column, pattern: str) -> Column:
    try:
        re.compile(pattern)
    except re.error:
        return F.lit(False)
    return f.cast("string").rlike(pattern)


def _between(f: Column, v) -> Column:
    return f.between(v[0], v[1]) if isinstance(v, (list, tuple)) and len(v) == 2 else F.lit(False)


def _any(f: Column, v, is_list: bool) -> Column:
    wanted = F.array(*[F.lit(x) for x in _values(v)])
    return F.arrays_overlap(f, wanted) if is_list else f.isin(_values(v))


def _all(f: Column, v, is_list: bool) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(x) for x in _values(v)]), f)) == 0 if is_list else F.lit(False)


def _empty(f: Column, kind: T.DataType | None) -> Column:
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return f.isNull() | (F.size(f) == 0)
    return f.isNull() | (f.cast("string") == "")


OPERATORS: dict[str, Callable[[Column, object, bool], Column]] = {
    "eq": lambda f, v, _: f == F.lit(v),
    "ne": lambda f, v, _: f != F.lit(v),
    "gt": lambda f, v, _: f > F.lit(v),
    "gte": lambda f, v, _: f >= F.lit(v),
    "lt": lambda f, v, _: f < F.lit(v),
    "lte": lambda f, v, _: f <= F.lit(v),
    "in": lambda f, v, _: f.isin(_values(v)),
    "nin": lambda f, v, _: ~f.isin(_values(v)),
    "any": _any,
    "all": _all,
    "contains": lambda f, v, is_list: F.array_contains(f, v) if is_list else f.cast("string").contains(str(v)),
    "icontains": lambda f, v, is_list: F.exists(f, lambda x: F.lower(x) == str(v).lower()) if is_list else F.lower(f.cast("string")).contains(str(v).lower()),
    "starts_with": lambda f, v, _: f.cast("string").startswith(str(v)),
    "ends_with": lambda f, v, _: f.cast("string").endswith(str(v)),
    "regex": lambda f, v, _: _regex(f, str(v)),
    "between": lambda f, v, _: _between(f, v),
    "range": lambda f, v, _: _between(f, v),
    "date_range": lambda f, v, _: date_range(f, v.get("start") or v.get("gte"), v.get("end") or v.get("lte")) if isinstance(v, dict) else date_range(f, v[0], v[1]),
    "geo_radius": lambda f, v, _: geo_radius(f, v),
    "geo_box": lambda f, v, _: geo_box(f, v),
}


class Compiler:
    """Filters over the columns of one schema."""

    def __init__(self, schema: T.StructType | None = None, root: str | None = None):
        self.schema, self.root = schema, root

    def _kind(self, path: str) -> T.DataType | None:
        kind: T.DataType | None = self.schema
        for step in ([self.root] if self.root else []) + path.split("."):
            if isinstance(kind, T.StructType) and step in kind.names:
                kind = kind[step].dataType
            elif isinstance(kind, T.ArrayType) and step.isdigit():
                kind = kind.elementType
            elif isinstance(kind, T.MapType):
                kind = kind.valueType
            else:
                return None
        return kind

    def condition(self, path: str, op: str, value) -> Column:
        f, kind, op = field(path, self.schema, self.root), self._kind(path), op.lstrip("$")
        if op == "exists":
            return f.isNotNull() if value else f.isNull()
        if op == "is_null":
            return f.isNull() if value else f.isNotNull()
        if op == "is_empty":
            return sure(_empty(f, kind)) if value else ~sure(_empty(f, kind))
        if op not in OPERATORS:
            raise ValueError(f"unknown operator {op!r}")
        return sure(OPERATORS[op](f, value, isinstance(kind, T.ArrayType)))

    def __call__(self, spec) -> Column:
        """A filter of any notation: {field: value}, {field: {$op: value}}, $and/$or/$not, {field, op, value},
        or must/should/must_not."""
        if not spec:
            return F.lit(True)
        if isinstance(spec, list):
            return self._join(spec, True)
        if {"must", "should", "must_not"} & set(spec):
            return self._clauses(spec)
        if {"field", "op"} <= set(spec):
            return self.condition(spec["field"], spec["op"], spec.get("value"))
        for name in ("$and", "and", "$or", "or", "$not", "not"):
            if name in spec:
                inner = spec[name]
                kind = name.lstrip("$")
                return ~self(inner) if kind == "not" else self._join(inner, kind == "and")
        parts = []
        for path, value in spec.items():
            if isinstance(value, dict) and value and all(k.startswith("$") for k in value):
                parts += [self.condition(path, k, v) for k, v in value.items()]
            else:
                parts.append(self.condition(path, "eq", value))
        return self._all(parts)

    @staticmethod
    def _all(parts: list[Column]) -> Column:
        out = F.lit(True)
        for p in parts:
            out &= p
        return out

    def _join(self, specs: list, every: bool) -> Column:
        if not specs:
            return F.lit(True)
        if every:
            return self._all([self(s) for s in specs])
        out = F.lit(False)
        for s in specs:
            out |= self(s)
        return out

    def _clauses(self, spec: dict) -> Column:
        out = self._all([self._clause(c) for c in spec.get("must") or []])
        if spec.get("should"):
            some = F.lit(False)
            for c in spec["should"]:
                some |= self._clause(c)
            out &= some
        for c in spec.get("must_not") or []:
            out &= ~self._clause(c)
        return out

    def _clause(self, c: dict) -> Column:
        if {"must", "should", "must_not"} & set(c):
            return self._clauses(c)
        key = c.get("key") or (c.get("is_null") or c.get("is_empty") or {}).get("key")
        if "match" in c:
            m = c["match"]
            return self.condition(key, *(("eq", m["value"]) if "value" in m else ("icontains", m["text"]) if "text" in m else ("in", m["any"])))
        if "range" in c:
            return self._all([self.condition(key, op, c["range"][op]) for op in ("gt", "gte", "lt", "lte") if c["range"].get(op) is not None])
        if "geo_radius" in c:
            g = c["geo_radius"]
            return self.condition(key, "geo_radius", {"center": g["center"], "radius_km": g["radius"] / 1000 if "radius" in g else g["radius_km"]})
        if "geo_bounding_box" in c:
            a, b = c["geo_bounding_box"]["top_left"], c["geo_bounding_box"]["bottom_right"]
            return self.condition(key, "geo_box", {"min_lat": b["lat"], "max_lat": a["lat"], "min_lon": a["lon"], "max_lon": b["lon"]})
        if "is_null" in c:
            return self.condition(key, "is_null", True)
        if "is_empty" in c:
            return self.condition(key, "is_empty", True)
        return self(c)


def compile_filter(spec, schema: T.StructType | None = None, root: str | None = None) -> Column:
    return Compiler(schema, root)(spec)


# ---------------------------------------------------------------- access lists
def acl_predicate(acl: Column, principals: list[str], default_allow: bool = False, deny_prefix: str = "deny:") -> Column:
    """Whether one of principals may read a row with these access entries.

    Public rows are readable; then any matching deny entry forbids; then any matching entry allows; nothing else
    is readable. Entries are type:value, a bare value is user:value, * as value matches any of the type. Rows
    without entries follow default_allow.
    """

    def full(p: str) -> str:
        return p if ":" in p else f"user:{p}"

    mine = F.array(*[F.lit(full(p)) for p in principals]).cast("array<string>")
    kinds = F.array(*[F.lit(full(p).split(":", 1)[0] + ":*") for p in principals]).cast("array<string>")
    wild = [full(p) for p in principals if full(p).endswith(":*")]

    def matches(entry: Column) -> Column:
        named = F.when(entry.contains(":"), entry).otherwise(F.concat(F.lit("user:"), entry))
        out = F.array_contains(mine, named) | F.array_contains(kinds, named)
        for w in wild:
            out |= named.startswith(w[:-1])
        return sure(out)

    denied = F.exists(acl, lambda e: e.startswith(deny_prefix) & matches(F.substring(e, len(deny_prefix) + 1, F.lit(1_000_000))))
    public = F.exists(acl, lambda e: e.isin("public", "everyone", "*"))
    allowed = F.exists(acl, lambda e: ~e.startswith(deny_prefix) & matches(e))
    none = acl.isNull() | (F.size(acl) == 0)
    return F.when(none, F.lit(default_allow)).otherwise(sure(public) | (~sure(denied) & sure(allowed)))


# ---------------------------------------------------------------- geohash
_GEO32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash(lat: Column, lon: Column, precision: int = 6) -> Column:
    """Geohash of a point: interleaved bits of longitude and latitude, five a character."""
    bits = 5 * precision
    n_lon, n_lat = (bits + 1) // 2, bits // 2

    def cell(x: Column, low: float, high: float, n: int) -> Column:
        return F.least(F.floor((x.cast("double") - low) / (high - low) * (1 << n)), F.lit((1 << n) - 1)).cast("long")

    a, b = cell(lon, -180, 180, n_lon), cell(lat, -90, 90, n_lat)
    out = []
    for c in range(precision):
        value = F.lit(0).cast("long")
        for j in range(5):
            i = 5 * c + j
            source, n = (a, n_lon) if i % 2 == 0 else (b, n_lat)
            value = value * 2 + F.shiftright(source, n - 1 - i // 2).bitwiseAND(1)
        out.append(F.substring(F.lit(_GEO32), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*out)


def field_kinds(schema) -> dict[str, str]:
    """How each field can be looked up: numeric, string, tags (lists of strings), geo (structs of lat and lon), boolean,
    time, nested or other; fields of structs by their paths."""
    out: dict[str, str] = {}
    for f in schema.fields:
        kind, name = f.dataType, f.dataType.typeName()
        if name == "struct":
            inner = {x.name for x in kind.fields}
            if {"lat", "lon"} <= inner:
                out[f.name] = "geo"
            else:
                out[f.name] = "nested"
                out |= {f"{f.name}.{k}": v for k, v in field_kinds(kind).items()}
        elif name == "array":
            out[f.name] = "tags" if kind.elementType.typeName() == "string" else "other"
        elif name in ("byte", "short", "integer", "long", "float", "double") or name.startswith("decimal"):
            out[f.name] = "numeric"
        else:
            out[f.name] = {"string": "string", "boolean": "boolean", "timestamp": "time", "timestamp_ntz": "time", "date": "time"}.get(name, "other")
    return out


def tags_equal(column: Column, tags: list[str]) -> Column:
    """Whether a list holds just these tags, in any order and case."""
    low = F.array_distinct(F.transform(column, F.lower))
    return F.array_sort(low) == F.array(*[F.lit(t) for t in sorted({t.lower() for t in tags})]).cast("array<string>")
