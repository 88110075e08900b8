"""Document collections: ``_id`` and a JSON text ``doc``; find, change, and aggregation pipelines."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.functions.predicates import Path, document_filter, from_json_text, json_path
from strataweave.functions.text import natural_order


def collection(df: DataFrame, ident: str, fields: Sequence[str] | None = None, name: str = "") -> DataFrame:
    """A collection from the rows of a table: ``_id, doc``; null columns are absent from ``doc``."""
    fields = fields or df.columns
    extra = [F.lit(name).alias("_collection")] if name else []
    return df.select(F.col(ident).cast("string").alias("_id"), F.to_json(F.struct(*fields, *extra)).alias("doc"))


def get_path(doc: Column | str, path: str) -> Column:
    """The value at ``a.b``, ``a[0]`` or ``a.0`` as text; null if there is none."""
    return F.get_json_object(F.col(doc) if isinstance(doc, str) else doc, json_path(path))


def find(docs: DataFrame, spec: Mapping[str, Any] | None = None, fields: Sequence[str] | None = None, sort: Sequence[tuple[str, int]] = (), skip: int = 0, limit: int | None = None) -> DataFrame:
    """Documents that match, as ``_id, doc`` or ``_id`` and the chosen fields (``a.b`` becomes column ``a_b``)."""
    at = _at_doc()
    out = docs.where(document_filter(dict(spec or {}), at))
    if sort:
        out = out.orderBy(*_sort_keys(sort, at))
    if skip:
        out = out.offset(skip)
    if limit is not None:
        out = out.limit(limit)
    return out if fields is None else out.select("_id", *(at(f).alias(_flat_name(f)) for f in fields if f != "_id"))


def _flat_name(path: str) -> str:
    return path.replace(".", "_").replace("[", "_").replace("]", "")


def _at_doc() -> Path:
    inner = from_json_text(F.col("doc"))
    return lambda path: F.col("_id") if path == "_id" else inner(path)


def _sort_keys(sort: Sequence[tuple[str, int]], at: Path) -> list[Column]:
    keys: list[Column] = []
    for path, way in sort:
        order = natural_order(at(path))
        keys += order if way > 0 else [_reverse(at(path), i) for i in range(4)]
    return keys


def _reverse(c: Column, i: int) -> Column:
    number = c.try_cast("double")
    return [c.isNotNull().desc(), number.isNull().desc(), number.desc(), F.lower(c).desc()][i]


def insert(docs: DataFrame, new: DataFrame) -> DataFrame:
    """Documents added; an ``_id`` that is there already keeps its document."""
    return docs.unionByName(new.join(docs.select("_id"), "_id", "left_anti").select("_id", "doc"))


def update(docs: DataFrame, spec: Mapping[str, Any], change: Mapping[str, Any]) -> DataFrame:
    """Matching documents changed: ``$set`` (top-level or dotted fields), ``$unset``, ``$inc``, ``$push``; bare fields are set.

    Documents are parsed and rewritten in Arrow batches, only those that match.
    """
    ops: dict[str, dict[str, Any]] = {k: dict(v) for k, v in change.items() if k.startswith("$")}
    bare = {k: v for k, v in change.items() if not k.startswith("$")}
    if bare:
        ops.setdefault("$set", {}).update(bare)
    unknown = set(ops) - {"$set", "$unset", "$inc", "$push"}
    if unknown:
        raise ValueError(f"unknown operators {sorted(unknown)}")
    marked = docs.withColumn("hit_", document_filter(dict(spec), _at_doc()))

    def apply(doc: dict[str, Any]) -> dict[str, Any]:
        for op, fields in ops.items():
            for path, value in fields.items():
                *way, last = path.split(".")
                node = doc
                for step in way:
                    if not isinstance(node.get(step), dict):
                        node[step] = {}
                    node = node[step]
                if op == "$set":
                    node[last] = value
                elif op == "$unset":
                    node.pop(last, None)
                elif op == "$inc":
                    node[last] = (node.get(last) or 0) + value
                else:
                    old = node.get(last)
                    node[last] = [*(old if isinstance(old, list) else [] if old is None else [old]), value]
        return doc

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [json.dumps(apply(json.loads(d)), separators=(",", ":"), ensure_ascii=False) if h and d else d for d, h in zip(b["doc"].to_pylist(), b["hit_"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["_id"], pa.array(texts, pa.string())], ["_id", "doc"])

    hits = marked.where("hit_").mapInArrow(run, "_id string, doc string")
    return marked.where("not hit_").select("_id", "doc").unionByName(hits)


def delete(docs: DataFrame, spec: Mapping[str, Any]) -> DataFrame:
    return docs.where(~document_filter(dict(spec), _at_doc()))


def flatten(docs: DataFrame) -> DataFrame:
    """``_id, path, value``: every node of every document, inner nodes as JSON, array elements as ``path.0``.

    Texts that are not JSON give no rows.
    """

    def nodes(value: Any, path: str) -> Iterator[tuple[str, Any]]:
        items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
        for k, v in items:
            here = f"{path}.{k}" if path else str(k)
            yield here, v
            yield from nodes(v, here)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, paths, values = [], [], []
            for i, d in zip(b["_id"].to_pylist(), b["doc"].to_pylist(), strict=True):
                try:
                    parsed = json.loads(d) if d else None
                except ValueError:
                    parsed = None
                for p, v in nodes(parsed, ""):
                    ids.append(i)
                    paths.append(p)
                    values.append(v if isinstance(v, str) or v is None else json.dumps(v, separators=(",", ":")))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(paths, pa.string()), pa.array(values, pa.string())], ["_id", "path", "value"])

    return docs.select("_id", "doc").mapInArrow(run, "_id string, path string, value string")


class _Stage:
    """A pipeline's rows so far and how their fields are read."""

    def __init__(self, df: DataFrame, fields: Sequence[str] | None = None, has_doc: bool = False) -> None:
        self.df, self.fields, self.has_doc = df, fields, has_doc

    def at(self, path: str) -> Column:
        if self.fields is None or (self.has_doc and path not in self.fields):
            return _at_doc()(path)
        head, _, rest = path.partition(".")
        if path in self.fields:
            return F.col(f"`{path}`")
        if head in self.fields and rest:
            return get_path(F.col(f"`{head}`"), rest)
        return F.lit(None).cast("string")


def pipeline(docs: DataFrame, stages: Sequence[Mapping[str, Any]]) -> DataFrame:
    """``$match $project $sort $limit $skip $group $unwind $count``, compiled to one plan.

    Values are text until they are computed with. In ``$group``, ``$sum`` takes a
    number or a field (missing counts as 0), ``$avg`` of nothing is 0, ``$min`` and
    ``$max`` are numeric, ``$push`` collects in sorted order; a null key is the
    text ``null``. ``$unwind`` keeps documents whose field is no array as they are,
    and drops those that lack it.
    """
    s = _Stage(docs)
    for stage in stages:
        (op, arg), = stage.items()
        s = _OPS[op](s, arg)
    return s.df


def _match(s: _Stage, spec):
    return _Stage(s.df.where(document_filter(spec, s.at)), s.fields, s.has_doc)


def _project(s: _Stage, spec):
    chosen = {"_id": s.at("_id")} if spec.get("_id", 1) and (s.fields is None or "_id" in s.fields) else {}
    for name, what in spec.items():
        if name == "_id" or not what:
            continue
        chosen[_flat_name(name)] = s.at(what[1:]) if isinstance(what, str) and what.startswith("$") else s.at(name)
    return _Stage(s.df.select(*(c.alias(n) for n, c in chosen.items())), list(chosen))


def _sort(s: _Stage, spec):
    return _Stage(s.df.orderBy(*_sort_keys(list(spec.items()), lambda p: s.at(p).cast("string"))), s.fields, s.has_doc)


def _group(s: _Stage, spec):
    key = spec["_id"]
    aggs = []
    for name, what in spec.items():
        if name == "_id":
            continue
        (fn, arg), = what.items()
        value = F.lit(float(arg)) if isinstance(arg, (int, float)) else s.at(arg[1:]).try_cast("double")
        if fn == "$sum":
            aggs.append(F.coalesce(F.sum(value), F.lit(0.0)).alias(name))
        elif fn == "$avg":
            aggs.append(F.coalesce(F.avg(value), F.lit(0.0)).alias(name))
        elif fn in ("$min", "$max"):
            aggs.append((F.min if fn == "$min" else F.max)(value).alias(name))
        elif fn == "$push":
            aggs.append(F.sort_array(F.collect_list(s.at(arg[1:]))).alias(name))
        else:
            raise ValueError(f"unknown accumulator {fn}")
    if key is None:
        return _Stage(s.df.agg(*aggs), [n for n in spec if n != "_id"])
    by = F.coalesce(s.at(key[1:]).cast("string"), F.lit("null")).alias("_id")
    return _Stage(s.df.groupBy(by).agg(*aggs), list(spec))


def _unwind(s: _Stage, arg):
    path = (arg if isinstance(arg, str) else arg["path"])[1:]
    value = s.at(path)
    items = F.from_json(value, "array<string>")
    whole = F.when(value.startswith("["), items).when(value.isNotNull(), F.array(value))
    rows = s.df.withColumn("item_", F.explode(whole))
    name = _flat_name(path)
    if s.fields is None:
        return _Stage(rows.select("_id", F.col("item_").alias(name), "doc"), ["_id", name, "doc"], has_doc=True)
    keep = [f for f in s.fields if f != name]
    return _Stage(rows.select(*keep, F.col("item_").alias(name)), [*keep, name], s.has_doc)


_OPS = {
    "$match": _match,
    "$project": _project,
    "$sort": _sort,
    "$group": _group,
    "$unwind": _unwind,
    "$limit": lambda s, n: _Stage(s.df.limit(n), s.fields, s.has_doc),
    "$skip": lambda s, n: _Stage(s.df.offset(n), s.fields, s.has_doc),
    "$count": lambda s, name: _Stage(s.df.agg(F.count(F.lit(1)).alias(name)), [name]),
}
