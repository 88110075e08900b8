"""Composite, array and domain types: a registry, schemas from it, and checks of values."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PRIMITIVE: dict[str, T.DataType] = {
    "integer": T.IntegerType(), "int": T.IntegerType(), "bigint": T.LongType(), "float": T.FloatType(), "real": T.FloatType(),
    "double": T.DoubleType(), "text": T.StringType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(),
    "datetime": T.TimestampNTZType(), "blob": T.BinaryType(), "json": T.VariantType(),
}
_ARGS = re.compile(r"^(\w+)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?$")


@dataclass(frozen=True)
class Domain:
    """A base type with a rule over ``value`` in SQL, such as ``value BETWEEN 1 AND 5``."""

    base: str
    rule: str


@dataclass
class TypeRegistry:
    """Named types. A type may use others that exist; one that is used cannot be dropped."""

    composites: dict[str, dict[str, str]] = field(default_factory=dict)
    domains: dict[str, Domain] = field(default_factory=dict)
    tables: dict[str, dict[str, str]] = field(default_factory=dict)

    def names(self) -> list[str]:
        return sorted([*self.composites, *self.domains])

    def create(self, name: str, fields: Mapping[str, str]) -> None:
        if name in self.composites or name in self.domains:
            raise ValueError(f"type {name} exists")
        for f, kind in fields.items():
            if name in self._used_by(kind):
                raise ValueError(f"type {name} would contain itself in {f}")
            self.spark_type(kind)
        self.composites[name] = dict(fields)

    def create_domain(self, name: str, base: str, rule: str) -> None:
        if name in self.composites or name in self.domains:
            raise ValueError(f"type {name} exists")
        self.spark_type(base)
        self.domains[name] = Domain(base, rule)

    def drop(self, name: str) -> None:
        users = [n for n, fields in [*self.composites.items(), *self.tables.items()] if n != name and any(name in self._used_by(k) for k in fields.values())]
        users += [n for n, d in self.domains.items() if n != name and name in self._used_by(d.base)]
        if users:
            raise ValueError(f"type {name} is used by {sorted(users)}")
        if self.composites.pop(name, None) is None and self.domains.pop(name, None) is None:
            raise KeyError(name)

    def _used_by(self, kind: str) -> set[str]:
        """Names that a type expression mentions, through all levels."""
        inner = kind.removesuffix("[]")
        out = {inner}
        for k in self.composites.get(inner, {}).values():
            out |= self._used_by(k)
        if inner in self.domains:
            out |= self._used_by(self.domains[inner].base)
        return out

    def spark_type(self, kind: str) -> T.DataType:
        """The Spark type of a type expression: a primitive, ``varchar(n)``, ``decimal(p,s)``, a named type, or ``type[]``."""
        if kind.endswith("[]"):
            return T.ArrayType(self.spark_type(kind[:-2]))
        if kind in self.composites:
            return T.StructType([T.StructField(n, self.spark_type(k)) for n, k in self.composites[kind].items()])
        if kind in self.domains:
            return self.spark_type(self.domains[kind].base)
        m = _ARGS.match(kind.strip().lower())
        if m and m[1] in ("varchar", "char"):
            return T.StringType()
        if m and m[1] in ("decimal", "numeric"):
            return T.DecimalType(int(m[2] or 10), int(m[3] or 0))
        if m and m[1] in _PRIMITIVE:
            return _PRIMITIVE[m[1]]
        raise ValueError(f"unknown type {kind}")

    def schema(self, fields: Mapping[str, str]) -> T.StructType:
        return T.StructType([T.StructField(n, self.spark_type(k)) for n, k in fields.items()])

    def create_table(self, name: str, fields: Mapping[str, str], inherits: str | None = None) -> T.StructType:
        """Schema of a table; a child has its parent's columns first, its own may replace them."""
        merged = {**(self.tables[inherits] if inherits else {}), **fields}
        self.tables[name] = merged
        return self.schema(merged)

    def valid(self, value: Column, kind: str) -> Column:
        """Whether a value, or a text that stands for it, fits a type. Null fits every type."""
        if kind.endswith("[]"):
            ok = F.forall(value, lambda x: self.valid(x, kind[:-2]))
        elif kind in self.composites:
            ok = F.lit(True)
            for n, k in self.composites[kind].items():
                ok = ok & self.valid(value[n], k)
        elif kind in self.domains:
            d = self.domains[kind]
            name = "value"
            ok = self.valid(value, d.base) & F.exists(F.array(F.struct(value.try_cast(self.spark_type(d.base)).alias(name))), lambda s: _rule(d.rule, s[name]))
        else:
            m = _ARGS.match(kind.strip().lower())
            target = self.spark_type(kind)
            if isinstance(target, T.StringType):
                ok = F.length(value) <= int(m[2]) if m and m[2] else F.lit(True)
            elif isinstance(target, T.VariantType):
                ok = F.try_parse_json(value.cast("string")).isNotNull()
            else:
                ok = value.try_cast(target).isNotNull()
        return F.when(value.isNull(), True).otherwise(F.coalesce(ok, F.lit(False)))


_COMPARE = re.compile(r"^\s*value\s*(<=|>=|<>|!=|=|<|>)\s*(.+?)\s*$", re.I)
_BETWEEN = re.compile(r"^\s*value\s+between\s+(.+?)\s+and\s+(.+?)\s*$", re.I)
_IN = re.compile(r"^\s*value\s+in\s*\((.*)\)\s*$", re.I)


def _literal(text: str) -> Column:
    t = text.strip()
    return F.lit(t[1:-1].replace("''", "'")) if t[:1] == "'" else F.lit(float(t) if "." in t else int(t))


def _rule(rule: str, value: Column) -> Column:
    """``value <op> literal``, ``value BETWEEN a AND b`` or ``value IN (..)`` joined by AND; nothing is evaluated as code."""
    if m := _BETWEEN.match(rule):
        return value.between(_literal(m[1]), _literal(m[2]))
    parts = re.split(r"\s+and\s+", rule, flags=re.I)
    if len(parts) > 1:
        out = _rule(parts[0], value)
        for p in parts[1:]:
            out = out & _rule(p, value)
        return out
    if m := _IN.match(rule):
        return value.isin(*[_literal(x) for x in re.findall(r"'(?:[^']|'')*'|[^,\s]+", m[1])])
    if m := _COMPARE.match(rule):
        x = _literal(m[2])
        return {"<=": value <= x, ">=": value >= x, "<>": value != x, "!=": value != x, "=": value == x, "<": value < x, ">": value > x}[m[1]]
    raise ValueError(f"unknown rule {rule}")


def read_with_children(parent: DataFrame, *children: DataFrame) -> DataFrame:
    """Rows of a table and of the tables that inherit from it, with the parent's columns."""
    out = parent
    for c in children:
        out = out.unionByName(c.select(*(col for col in parent.columns if col in c.columns)), allowMissingColumns=True)
    return out


def nest(df: DataFrame, groups: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Columns gathered into structs: ``{"address": {"street": "addr_street"}}``."""
    used = {c for g in groups.values() for c in g.values()}
    return df.select(*(c for c in df.columns if c not in used), *(F.struct(*(F.col(c).alias(n) for n, c in g.items())).alias(name) for name, g in groups.items()))


def set_attribute(df: DataFrame, path: str, value: Column, where: Column | None = None) -> DataFrame:
    """UPDATE of a dotted attribute, where the condition is true."""
    name, _, rest = path.partition(".")
    new = F.col(name).withField(rest, value) if rest else value
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return df.withColumn(name, F.when(hit, new).otherwise(F.col(name)))
