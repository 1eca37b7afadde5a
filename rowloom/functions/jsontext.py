"""Canonical JSON: keys sorted, the last of repeated keys, no spaces."""

from __future__ import annotations

import json
import math
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical(text: str) -> str:
    """The canonical form of a JSON text; numbers are taken as doubles. A text that isn't JSON raises ValueError."""

    def bad(name: str):
        raise ValueError(f"{name} is not JSON")

    return _write(json.loads(text, parse_int=float, parse_constant=bad))


def _write(x) -> str:
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_write(x[k])}" for k in sorted(x)) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(_write, x)) + "]"
    if isinstance(x, float):
        if not math.isfinite(x):
            raise ValueError("a number is out of range")
        if x == 0:
            return "0" if math.copysign(1, x) > 0 else "-0"
        if 1e-6 <= abs(x) < 1e21:
            text = format(Decimal(repr(x)), "f")
            return text.rstrip("0").rstrip(".") if "." in text else text
        mantissa, exponent = repr(x).split("e")
        return f"{mantissa}e{exponent[0]}{exponent[1:].zfill(2)}" if exponent[0] in "+-" else f"{mantissa}e+{exponent.zfill(2)}"
    return json.dumps(x, ensure_ascii=False)


def json_canonical(column: Column) -> Column:
    """The canonical form as an expression that stays in the JVM; integers keep all their digits there."""
    return F.to_json(F.parse_json(column))


@F.pandas_udf(T.StringType())
def json_canonical_exact(column):
    """``canonical`` over batches, where numbers must print as doubles do."""
    return column.map(lambda x: None if x is None else canonical(x))
