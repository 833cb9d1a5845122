"""Typed metadata values: JSON text to tagged structs and back, keeping 3 and 3.0 apart."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.errors import InvalidArgument

BOOL, INT, FLOAT, STRING, SPARSE, BOOLS, INTS, FLOATS, STRINGS = range(1, 10)
#: Kind to the name its index configuration goes by; arrays go by their elements.
BUCKETS = {BOOL: "bool", INT: "int", FLOAT: "float", STRING: "string", SPARSE: "sparse_vector", BOOLS: "bool", INTS: "int", FLOATS: "float", STRINGS: "string"}
FIELDS = {BOOL: "b", INT: "i", FLOAT: "f", STRING: "s", SPARSE: "sv", BOOLS: "ba", INTS: "ia", FLOATS: "fa", STRINGS: "sa"}
_SPARSE = T.StructType([T.StructField("indices", T.ArrayType(T.LongType())), T.StructField("values", T.ArrayType(T.FloatType())), T.StructField("tokens", T.ArrayType(T.StringType()))])
_SCALARS = {"b": T.BooleanType(), "i": T.LongType(), "f": T.DoubleType(), "s": T.StringType()}
VALUE_TYPE = T.StructType(
    [T.StructField("kind", T.ByteType()), *(T.StructField(n, t) for n, t in _SCALARS.items()), *(T.StructField(n + "a", T.ArrayType(t)) for n, t in _SCALARS.items()), T.StructField("sv", _SPARSE)]
)
METADATA_TYPE = T.MapType(T.StringType(), VALUE_TYPE)
METADATA = METADATA_TYPE.simpleString()
MAX_INDEX = 2**32 - 1


def _tag(kind: int, value) -> dict:
    return {f: None for f in ("b", "i", "f", "s", "ba", "ia", "fa", "sa", "sv")} | {"kind": kind, FIELDS[kind]: value}


def _number(value) -> tuple[int, int | float]:
    """Integers beyond 64 bits are floats, as is everything written with a point or an exponent."""
    if isinstance(value, int) and -(2**63) <= value < 2**63:
        return INT, value
    number = float(value)
    if not math.isfinite(number):
        raise InvalidArgument("metadata numbers must be finite")
    return FLOAT, number


def parse_sparse(raw: Mapping) -> dict:
    if not set(raw) <= {"#type", "indices", "values", "tokens"} or raw.get("#type", "sparse_vector") != "sparse_vector":
        raise InvalidArgument("invalid sparse vector")
    indices, values, tokens = raw.get("indices"), raw.get("values"), raw.get("tokens")
    whole = isinstance(indices, list) and all(isinstance(i, int) and not isinstance(i, bool) and 0 <= i <= MAX_INDEX for i in indices)
    if not whole or not isinstance(values, list) or len(values) != len(indices) or tokens is not None and len(tokens) != len(indices):
        raise InvalidArgument("invalid sparse vector")
    if any(a >= b for a, b in zip(indices, indices[1:], strict=False)):
        raise InvalidArgument("sparse vector indices must be strictly ascending")
    return {"indices": indices, "values": [float(np.float32(v)) for v in values], "tokens": tokens}


def parse_value(value) -> dict:
    """The tagged struct of a decoded JSON value; raises InvalidArgument for null, nesting and mixed lists."""
    if isinstance(value, bool):
        return _tag(BOOL, value)
    if isinstance(value, str):
        return _tag(STRING, value)
    if isinstance(value, (int, float)):
        return _tag(*_number(value))
    if isinstance(value, Mapping):
        return _tag(SPARSE, parse_sparse(value))
    if isinstance(value, list):
        if all(isinstance(v, bool) for v in value):  # the empty list too
            return _tag(BOOLS, value)
        if all(isinstance(v, str) for v in value):
            return _tag(STRINGS, value)
        if all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in value):
            numbers = [_number(v) for v in value]
            if all(kind == INT for kind, _ in numbers):
                return _tag(INTS, [n for _, n in numbers])
            return _tag(FLOATS, [float(n) for _, n in numbers])
    raise InvalidArgument("unsupported metadata value")


def check_key(key: str) -> None:
    if not key:
        raise InvalidArgument("Metadata key cannot be empty")
    if key[0] in "#$":
        raise InvalidArgument(f"Metadata key cannot start with '#' or '$': {key}")


def parse_metadata(text: str | None, update: bool = False) -> dict | None:
    """{key: tagged struct} of JSON text; in an update a null value deletes its key and stays None."""
    if text is None:
        return None
    raw = json.loads(text)
    if raw is None:
        return None
    if not isinstance(raw, dict):
        raise InvalidArgument("metadata must be an object")
    out = {}
    for key, value in raw.items():
        check_key(key)
        if value is None and not update:
            raise InvalidArgument("metadata values must not be null")
        out[key] = None if value is None else parse_value(value)
    return out


@F.pandas_udf(METADATA_TYPE)
def decode_metadata(texts: pd.Series) -> pd.Series:
    """Column form of parse_metadata; text that is no valid metadata gives null."""

    def one(text):
        try:
            return parse_metadata(text)
        except (InvalidArgument, ValueError):
            return None

    return texts.map(one)


def format_double(x: float) -> str:
    """The shortest text that reads back as the double and shows that it is no integer."""
    if x == int(x) and abs(x) < 1e21:
        return f"{int(x)}.0" if not (x == 0 and math.copysign(1, x) < 0) else "-0.0"
    return repr(x)


def format_float(x: float) -> str:
    x = np.float32(x)
    if x == np.rint(x) and abs(x) < 1e21:
        return format_double(float(x))
    return np.format_float_positional(x, unique=True, trim="0") if 1e-6 <= abs(x) < 1e21 else repr(float(str(x)))


def encode_value(value: Mapping) -> str:
    """JSON text of a tagged struct."""
    kind = value["kind"]
    v = value[FIELDS[kind]]
    if kind == FLOAT:
        return format_double(v)
    if kind == FLOATS:
        return "[" + ",".join(map(format_double, v)) + "]"
    if kind == SPARSE:
        tokens = "" if v["tokens"] is None else ',"tokens":' + json.dumps(v["tokens"], ensure_ascii=False)
        return '{"#type":"sparse_vector","indices":' + json.dumps(v["indices"]) + ',"values":[' + ",".join(map(format_float, v["values"])) + "]" + tokens + "}"
    return json.dumps(v, ensure_ascii=False, separators=(",", ":"))


def typed_metadata(keys: Mapping[str, str]):
    """A typed metadata map of SQL expressions, {key: "expression as bool|long|double|string|strings"}.

    Null values are missing keys; without any key the map is null.
    """

    def value(sql: str, kind: int):
        fields = [F.lit(kind).cast("byte").alias("kind") if f.name == "kind" else (F.expr(sql) if f.name == FIELDS[kind] else F.lit(None)).cast(f.dataType).alias(f.name) for f in VALUE_TYPE.fields]
        return F.when(F.expr(sql).isNotNull(), F.struct(*fields))

    kinds = {"bool": BOOL, "long": INT, "double": FLOAT, "string": STRING, "strings": STRINGS}
    entries = []
    for key, spec in keys.items():
        check_key(key)
        sql, _, kind = spec.rpartition(" as ")
        if kind not in kinds:
            raise InvalidArgument(f"unsupported metadata type: {spec}")
        entries.append(F.struct(F.lit(key).alias("key"), value(sql, kinds[kind]).alias("value")))
    kept = F.map_filter(F.map_from_entries(F.array(*entries)), lambda k, v: v.isNotNull())
    return F.when(F.size(kept) > 0, kept)
