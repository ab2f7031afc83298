"""Column expressions with string and date-time namespaces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"ms": ("SECOND", 0.001), "s": ("SECOND", 1), "m": ("MINUTE", 1), "h": ("HOUR", 1), "d": ("DAY", 1), "M": ("MONTH", 1), "y": ("YEAR", 1)}


def raw(x: object) -> object:
    """The Spark column of an expression; other values as they are."""
    return x.column if isinstance(x, Expr) else x


class Expr:
    """A lazy column expression.  Null operands give null, as in SQL."""

    def __init__(self, column: Column) -> None:
        self.column = column

    def alias(self, name: str) -> Expr:
        return Expr(self.column.alias(name))

    def cast(self, to: str) -> Expr:
        return Expr(self.column.cast(to))

    def is_in(self, values: list) -> Expr:
        return Expr(self.column.isin(values))

    def between(self, low: object, high: object) -> Expr:
        return Expr(self.column.between(raw(low), raw(high)))

    def like(self, pattern: str) -> Expr:
        return Expr(self.column.like(pattern))

    def matches(self, regex: str) -> Expr:
        return Expr(self.column.rlike(regex))

    def is_null(self) -> Expr:
        return Expr(self.column.isNull())

    @property
    def str(self) -> StringFunctions:
        return StringFunctions(self.column)

    @property
    def dt(self) -> TimeFunctions:
        return TimeFunctions(self.column)

    def __pow__(self, other: object) -> Expr:
        return Expr(F.pow(self.column, raw(other)))

    def __rpow__(self, other: object) -> Expr:
        return Expr(F.pow(F.lit(other), self.column))

    def __hash__(self) -> int:
        return id(self)


def _binary(name: str):
    def op(self: Expr, other: object) -> Expr:
        return Expr(getattr(self.column, name)(raw(other)))

    return op


for _name in ("eq", "ne", "lt", "le", "gt", "ge", "and", "or", "rand", "ror", "add", "radd", "sub", "rsub", "mul", "rmul", "truediv", "rtruediv", "mod", "rmod"):
    setattr(Expr, f"__{_name}__", _binary(f"__{_name}__"))
for _name in ("neg", "invert"):
    setattr(Expr, f"__{_name}__", lambda self, n=f"__{_name}__": Expr(getattr(self.column, n)()))


class StringFunctions:
    def __init__(self, column: Column) -> None:
        self.c = column

    def to_uppercase(self) -> Expr:
        return Expr(F.upper(self.c))

    def to_lowercase(self) -> Expr:
        return Expr(F.lower(self.c))

    def contains(self, part: str) -> Expr:
        return Expr(self.c.contains(part))

    def starts_with(self, part: str) -> Expr:
        return Expr(self.c.startswith(part))

    def ends_with(self, part: str) -> Expr:
        return Expr(self.c.endswith(part))

    def length(self) -> Expr:
        return Expr(F.length(self.c))

    def substring(self, start: int, length: int) -> Expr:
        """``start`` counts from 1."""
        return Expr(F.substring(self.c, start, length))

    def json_extract(self, field: str) -> Expr:
        """A field of a JSON object as text; null if missing."""
        return Expr(F.get_json_object(self.c, f"$.{field}"))

    def strptime(self, format: str = "datetime") -> Expr:
        """Parsed date or time; null where the text is none.  ``time`` keeps the text of the time of day."""
        if format == "datetime":
            return Expr(self.c.try_cast("timestamp_ntz"))
        if format == "date":
            return Expr(self.c.try_cast("date"))
        if format == "time":
            return Expr(F.date_format(F.concat(F.lit("1970-01-01 "), self.c).try_cast("timestamp_ntz"), "HH:mm:ss.SSSSSS"))
        raise ValueError(f"format must be datetime, date or time, not {format!r}")

    def hash(self) -> Expr:
        """A 64-bit hash; its values are this engine's own."""
        return Expr(F.xxhash64(self.c))


class TimeFunctions:
    def __init__(self, column: Column) -> None:
        self.c = column

    def _seconds(self) -> Column:
        return F.extract(F.lit("SECOND"), self.c)

    def hour(self) -> Expr:
        return Expr(F.hour(self.c))

    def minute(self) -> Expr:
        return Expr(F.minute(self.c))

    def second(self) -> Expr:
        return Expr(F.second(self.c))

    def millisecond(self) -> Expr:
        """Seconds and their fraction in milliseconds."""
        return Expr(F.floor(self._seconds() * 1000))

    def microsecond(self) -> Expr:
        """Seconds and their fraction in microseconds."""
        return Expr((self._seconds() * 1_000_000).cast("bigint"))

    def weekday(self) -> Expr:
        """Sunday is 0."""
        return Expr(F.dayofweek(self.c) - 1)

    def week(self) -> Expr:
        return Expr(F.weekofyear(self.c))

    def month(self) -> Expr:
        return Expr(F.month(self.c))

    def year(self) -> Expr:
        return Expr(F.year(self.c))

    def offset_by(self, num: int, unit: str) -> Expr:
        """``unit``: ms, s, m, h, d, M (months) or y."""
        if unit not in _UNITS:
            raise ValueError(f"unit must be one of {', '.join(_UNITS)}")
        name, factor = _UNITS[unit]
        return Expr(self.c + F.expr(f"INTERVAL '{num * factor:.3f}' SECOND" if unit == "ms" else f"INTERVAL '{num}' {name}"))

    def strftime(self) -> Expr:
        return Expr(F.date_format(self.c, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def col(name: str) -> Expr:
    return Expr(F.col(name))


def lit(value: object) -> Expr:
    return Expr(F.lit(value))


def when(condition: Expr, value: object) -> Case:
    return Case(F.when(raw(condition), raw(value)))


class Case(Expr):
    """``when(...).when(...).otherwise(...)``; without ``otherwise`` null."""

    def when(self, condition: Expr, value: object) -> Case:
        return Case(self.column.when(raw(condition), raw(value)))

    def otherwise(self, value: object) -> Expr:
        return Expr(self.column.otherwise(raw(value)))
