"""Which values of two differently typed columns are equal.

A pair of numeric columns is compared in the least type that holds both: long for integers, a decimal with
room for the whole digits and the scale of both, double as soon as one is floating (a float goes by its
shortest text, so 0.1 stays 0.1). A decimal wider than 38 digits is compared as double. Zero has no sign.
A number beside a text is compared as text; they differ in FORMAT alone if the text reads as the same
number. All other pairs are compared as text, and differ in FORMAT alone if letters' case, blanks or the zeros at the end of a
decimal are all that differs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import types as T

from tidemark.functions.columns import normal_text_sql

#: Types whose values are equal exactly if their texts are.
AS_IS = (T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
#: Decimal digits that hold every value of an integer type.
DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def common_number(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The least numeric type that holds both; None if one isn't numeric."""
    if not (isinstance(a, T.NumericType) and isinstance(b, T.NumericType)):
        return None
    if any(isinstance(x, (T.FloatType, T.DoubleType)) for x in (a, b)):
        return T.DoubleType()
    if type(a) in DIGITS and type(b) in DIGITS:
        return T.LongType()
    scales = [x.scale if isinstance(x, T.DecimalType) else 0 for x in (a, b)]
    whole = max(x.precision - x.scale if isinstance(x, T.DecimalType) else DIGITS[type(x)] for x in (a, b))
    return T.DecimalType(whole + max(scales), max(scales)) if whole + max(scales) <= 38 else T.DoubleType()


def number_sql(value: str, kind: T.DataType, to: T.DataType) -> str:
    """``value`` of type ``kind`` as ``to``."""
    if isinstance(to, T.DoubleType):
        value = f"CAST({value} AS STRING)" if isinstance(kind, T.FloatType) else value
        return f"(CAST({value} AS DOUBLE) + 0D)"
    return f"CAST({value} AS {to.simpleString()})"


@dataclass(frozen=True)
class ColumnPair:
    """A column of both sides, as SQL: the values by which it is compared (of one type on both sides), and their
    texts, where ``{}`` stands for the column."""

    name: str
    source_value: str
    target_value: str
    source_text: str
    target_text: str
    rule: str  # NUMBER, MIXED or TEXT
    number: T.DataType | None

    def differs(self, s: str, t: str) -> str:
        """SQL: whether two values, given as their plain texts, differ."""
        if self.rule == "NUMBER":
            s, t = (self._read(x) for x in (s, t))
        return f"NOT ({s} <=> {t})"

    def same_but_format(self, s: str, t: str) -> str:
        """SQL: whether values that differ do so in format alone."""
        if self.rule == "NUMBER":
            return "FALSE"
        if self.rule == "MIXED":
            s, t = (self._read(x) for x in (s, t))
        else:
            s, t = normal_text_sql(s), normal_text_sql(t)
        return f"coalesce({s} = {t}, FALSE)"

    def _read(self, value: str) -> str:
        zero = " + 0D" if isinstance(self.number, T.DoubleType) else ""
        return f"(TRY_CAST({value} AS {self.number.simpleString()}){zero})"


def pair(name: str, source: str, a: T.DataType, target: str, b: T.DataType) -> ColumnPair:
    """The pair of column ``source`` (of type ``a``) and column ``target`` (of type ``b``)."""
    number = common_number(a, b)
    if number is not None:
        forms, rule = [number_sql("{}", x, number) for x in (a, b)], "NUMBER"
    else:
        beside = [x for x in (a, b) if isinstance(x, T.NumericType)]
        rule = "MIXED" if len(beside) == 1 and any(isinstance(x, T.StringType) for x in (a, b)) else "TEXT"
        # Some types are equal as they are; others are compared by their text.
        forms = ["{}" if a == b and isinstance(a, AS_IS) else "CAST({} AS STRING)"] * 2
        if rule == "MIXED":  # wide enough that '2.504' isn't read as 2.50
            number = T.DoubleType() if isinstance(beside[0], (T.FloatType, T.DoubleType)) else T.DecimalType(38, 18)
    values = [f.replace("{}", ident(n)) for f, n in zip(forms, (source, target), strict=True)]
    return ColumnPair(name, *values, *[f"CAST({f} AS STRING)" for f in forms], rule, number)


def pairs(source: T.StructType, target: T.StructType, names: Sequence[str]) -> list[ColumnPair]:
    """The pairs of these columns, found in both schemas whatever their case."""
    sides = [{f.name.lower(): f for f in schema.fields} for schema in (source, target)]
    out = []
    for n in names:
        s, t = (side[n.lower()] for side in sides)
        out.append(pair(n, s.name, s.dataType, t.name, t.dataType))
    return out
