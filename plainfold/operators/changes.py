"""Changes of a table as DataFrame plans: its next state over the old one, which the engine then writes. No file is touched
and nothing is collected here.

Tables come with the column ``_rowid_``, which tells rows apart and orders them; new rows stand after the old ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DataError
from ..sources.tables import ROWID, Col, Schema
from ..values import SPARK

#: Spark's types that a column of a logical type takes.
FITS = {
    "integer": ("long", "integer", "short", "byte", "void"), "real": ("double", "float", "long", "integer", "short", "byte", "decimal", "void"),
    "boolean": ("boolean", "long", "integer", "void"), "text": ("string", "void"),
    "date": ("string", "date", "void"), "datetime": ("string", "timestamp_ntz", "timestamp", "date", "void"),
}
DATE = r"^(\d{4}-\d{2}-\d{2}|\d{8})$"
DATETIME = r"^(\d{4}-\d{2}-\d{2}|\d{8})([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"
#: Rows stand in this order: old ones, then new ones.
ORDER = ("_new_", ROWID)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fitted(value: Column, given: T.DataType, c: Col, table: str) -> Column:
    """The value as the column holds it. Types that don't fit are refused at once, values when the plan runs."""
    name, kind = f"{table}.{c.name}", SPARK[c.kind]
    if given.typeName() not in FITS[c.kind]:
        raise DataError(f"{name}: not a {c.kind}: {given.simpleString()}")
    wrong = F.raise_error(F.concat(F.lit(f"DataError: {name}: not a {c.kind}: "), value.cast("string"))).cast(kind)
    out = value.cast(kind)
    if c.kind == "boolean" and isinstance(given, T.IntegralType):
        out = F.when(value.isNull() | value.isin(0, 1), out).otherwise(wrong)
    elif c.kind == "text":
        out = F.when(F.contains(out, F.lit("\0")), wrong).otherwise(out)
    elif c.kind in ("date", "datetime") and isinstance(given, T.StringType):
        iso = F.regexp_replace(F.replace(value, F.lit("T"), F.lit(" ")), r"^(\d{4})(\d{2})(\d{2})", "$1-$2-$3")
        holds = value.rlike(DATE if c.kind == "date" else DATETIME) & iso.try_cast("date" if c.kind == "date" else "timestamp").isNotNull()
        out = F.when(value.isNull() | holds, value).otherwise(wrong)
    elif c.kind == "datetime" and not isinstance(given, T.NullType):
        at = value.cast("timestamp_ntz")
        out = F.when(F.date_format(at, "SSSSSS") == "000000", F.date_format(at, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    if not c.nullable:
        out = F.coalesce(out, F.raise_error(F.lit(f"IntegrityError: NOT NULL constraint failed: {name}")).cast(kind))
    return out


def rows_of(given: DataFrame, schema: Schema, names: Sequence[str]) -> DataFrame:
    """Whole rows of the table: ``given`` by position into the columns ``names``, defaults for the others."""
    given = given.toDF(*(f"v{i}" for i in range(len(names))))
    at = {n: i for i, n in enumerate(names)}
    out = []
    for c in schema.columns:
        if c.name in at:
            out.append(fitted(F.col(f"v{at[c.name]}"), given.schema[at[c.name]].dataType, c, schema.table).alias(c.name))
        else:
            value = F.lit(c.default)
            out.append(fitted(value, T.NullType() if c.default is None else SPARK[c.kind], c, schema.table).alias(c.name))
    return given.select(F.monotonically_increasing_id().alias(ROWID), *out)


def inserted(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.withColumn("_new_", F.lit(False)).unionByName(new.withColumn("_new_", F.lit(True)))


def changes_of(found: DataFrame, schema: Schema, names: Sequence[str]) -> DataFrame:
    """``found``: _rowid_ and a value for each of ``names``, as __set_0, ...; the same, fitted, as _set_<name>."""
    return found.select(ROWID, *(fitted(F.col(f"__set_{i}"), found.schema[f"__set_{i}"].dataType, schema.column(n), schema.table).alias(f"_set_{n}") for i, n in enumerate(names)))


def updated(old: DataFrame, changed: DataFrame, names: Sequence[str]) -> DataFrame:
    """The rows that ``changed`` (of ``changes_of``) names have its values; rows keep their places."""
    changed = changed.withColumn("_hit_", F.lit(True))
    columns = [F.when(F.col("_hit_"), F.col(quoted(f"_set_{c}"))).otherwise(F.col(quoted(c))).alias(c) if c in names else quoted(c) for c in old.columns]
    return old.join(changed, ROWID, "left").select(*columns).withColumn("_new_", F.lit(False))


def deleted(old: DataFrame, gone: DataFrame) -> DataFrame:
    return old.join(gone.select(ROWID), ROWID, "left_anti").withColumn("_new_", F.lit(False))


def reshaped(old: DataFrame, add: Mapping[str, Column] | None = None, drop: Sequence[str] = (), rename: Mapping[str, str] | None = None) -> DataFrame:
    """Columns added, dropped or renamed."""
    return old.withColumns(dict(add or {})).drop(*drop).withColumnsRenamed(dict(rename or {})).withColumn("_new_", F.lit(False))


def violations(table: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that stand more than once, and how often; counted in two phases."""
    return table.groupBy(*map(quoted, key)).agg(F.count("*").alias("n")).where("n > 1")
