"""The six logical types: what a field of a table file holds, and what a value may be."""

from __future__ import annotations

import re
from datetime import date, datetime

from pyspark.sql import types as T

from .errors import DataError, NotSupportedError

NULL = r"\N"
#: Dates and times stay the ISO text that they were written as, which also sorts them.
SPARK = {"integer": T.LongType(), "real": T.DoubleType(), "boolean": T.BooleanType(), "text": T.StringType(), "date": T.StringType(), "datetime": T.StringType()}
#: The type names a column definition may have.
DECLARED = {
    **dict.fromkeys(("tinyint", "smallint", "mediumint", "int", "integer", "bigint"), "integer"),
    **dict.fromkeys(("float", "double", "real", "decimal", "numeric"), "real"),
    **dict.fromkeys(("char", "varchar", "text"), "text"),
    "boolean": "boolean", "bool": "boolean", "date": "date", "datetime": "datetime", "timestamp": "datetime",
}
_MARKS = re.compile(r"^\\+N$")


def logical_type(name: str) -> str:
    if name.lower() not in DECLARED:
        raise NotSupportedError(f"unsupported column type: {name.upper()}")
    return DECLARED[name.lower()]


def checked(kind: str, value):
    """The value as a table of this type holds it. Raises DataError where it can't hold it."""
    if value is None:
        return None
    if kind == "integer":
        if isinstance(value, bool) or not isinstance(value, int):
            raise DataError(f"not an integer: {value!r}")
        if not -(1 << 63) <= value < 1 << 63:
            raise DataError(f"integer out of range: {value}")
        return value
    if kind == "real":
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise DataError(f"not a real: {value!r}")
        return float(value)
    if kind == "boolean":
        if isinstance(value, bool) or isinstance(value, int) and value in (0, 1):
            return bool(value)
        raise DataError(f"not a boolean: {value!r}")
    if kind == "date" and isinstance(value, date) and not isinstance(value, datetime):
        return value.isoformat()
    if kind == "datetime" and isinstance(value, datetime):
        return value.isoformat(sep=" ")
    if not isinstance(value, str):
        raise DataError(f"not a {kind}: {value!r}")
    if kind == "text":
        if "\0" in value:
            raise DataError("text holds a NUL character")
        return value
    try:
        (date if kind == "date" else datetime).fromisoformat(value)
    except ValueError:
        raise DataError(f"not a {kind}: {value!r}") from None
    return value


def field(kind: str, value) -> str:
    """The field's text, before quoting."""
    if value is None:
        return NULL
    if kind == "boolean":
        return "true" if value else "false"
    if kind == "real":
        return repr(float(value))
    text = str(value)
    return "\\" + text if _MARKS.match(text) else text


def parsed(kind: str, text: str):
    """The value of a field's text. Raises DataError."""
    if text == NULL:
        return None
    if _MARKS.match(text):
        text = text[1:]
    try:
        if kind == "integer":
            return checked(kind, int(text, 10))
        if kind == "real":
            return float(text)
    except ValueError:
        raise DataError(f"not {'an integer' if kind == 'integer' else 'a real'}: {text!r}") from None
    if kind == "boolean":
        if text not in ("true", "false"):
            raise DataError(f"not a boolean: {text!r}")
        return text == "true"
    return checked(kind, text)
