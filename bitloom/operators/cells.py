"""The DataFrame operators: parse, produce, records, nodes, and registration for SQL.

``parse`` chooses the lowering: Catalyst columns where every offset is an expression, else one
Arrow-batched reader. Neither shuffles; a task handles its own rows and nothing is collected.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.reader import Reader, Variant, plain, to_json
from ..functions.typed import typed, untyped
from ..functions.values import CellError, Scope
from ..functions.writer import Writer
from ..plans.columns import ERROR, ColumnPlan, NotLowered
from ..plans.layout import Layout, compile_script, struct_schema
from ..plans.produced import BytesPlan

MODES = ("PERMISSIVE", "DROPMALFORMED", "FAILFAST")

_layouts: dict[tuple, Layout] = {}


def _layout(script: str, modules: Mapping[str, str] | None) -> Layout:
    """Compiled once in each process."""
    key = (script, tuple(sorted((modules or {}).items())))
    if key not in _layouts:
        _layouts[key] = compile_script(script, modules)
    return _layouts[key]


def _pruned(schema: T.StructType, fields: list[str] | None) -> T.StructType:
    return schema if fields is None else T.StructType([f for f in schema.fields if f.name in fields or f.name.removesuffix("_name") in fields])


def decode_column(
    cell: Column, script: str, *, entry: str | None = None, params: dict | None = None, output: str = "struct", fields: list[str] | None = None,
    enum_names: bool = False, strict: bool = False, modules: Mapping[str, str] | None = None, max_elements: int | None = None, lowering: str = "auto",
) -> Column:
    """A struct column: value, error (code, message, offset; null if none), consumed.

    A null cell gives a null value and no error. ``output`` is struct, json or variant; ``fields``
    keeps only those members of the entry. ``lowering`` is auto, columns or reader.
    """
    if output == "variant":
        got = decode_column(cell, script, entry=entry, params=params, output="json", strict=strict, modules=modules, max_elements=max_elements)
        return F.struct(F.try_parse_json(got["value"]).alias("value"), got["error"].alias("error"), got["consumed"].alias("consumed"))
    layout = _layout(script, modules)
    top = layout.entry(entry)
    if output not in ("struct", "json"):
        raise ValueError(f"output is struct, json or variant, not {output!r}")
    if lowering != "reader" and output == "struct" and not strict and max_elements is None:
        try:
            value, fine, error, end = ColumnPlan(layout, cell, params).build(entry, enum_names)
            if fields is not None:
                value = F.struct(*[value.getField(f.name).alias(f.name) for f in _pruned(struct_schema(layout, top, enum_names), fields)])
            there = cell.isNotNull() & fine
            return F.struct(F.when(there, value).alias("value"), F.when(cell.isNotNull(), error).alias("error"), F.when(there, end).alias("consumed"))
        except NotLowered:
            if lowering == "columns":
                raise
    elif lowering == "columns":
        raise NotLowered("this output, strict mode or an element limit")
    kind = T.StringType() if output == "json" else _pruned(struct_schema(layout, top, enum_names), fields)
    result = T.StructType([T.StructField("value", kind), T.StructField("error", ERROR), T.StructField("consumed", T.LongType())])
    wire = to_arrow_type(result)
    wanted = None if fields is None else set(fields)
    limits = {} if max_elements is None else {"max_elements": max_elements}

    @F.arrow_udf(result)
    def decode(cells: pa.Array) -> pa.Array:
        layout = _layout(script, modules)
        top = layout.entry(entry)
        reader = Reader(layout, strict=strict, **limits)
        out = []
        for x in cells:
            if not x.is_valid:
                out.append({"value": None, "error": None, "consumed": None})
                continue
            try:
                scope, consumed = reader.read(x.as_py(), entry, params)
                out.append({"value": to_json(scope) if output == "json" else typed(layout, top, scope, enum_names, wanted), "error": None, "consumed": consumed})
            except CellError as e:
                out.append({"value": None, "error": {"code": e.code, "message": e.message, "offset": max(-1 << 63, min(e.offset, (1 << 63) - 1))}, "consumed": None})
            except RecursionError:
                out.append({"value": None, "error": {"code": "PE100", "message": "nested too deep", "offset": 0}, "consumed": None})
        return pa.array(out, wire)

    return decode(cell)


def parse(df: DataFrame, column: str, script: str, *, into: str = "parsed", mode: str = "PERMISSIVE", metadata: bool = True, **options) -> DataFrame:
    """``df`` with the parsed cell as ``into``, and (with ``metadata``) _error, _bytes_consumed
    and _input_size. PERMISSIVE leaves null where a cell is wrong, DROPMALFORMED drops the row,
    FAILFAST fails the job. A column that has one of these names is replaced."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}, not {mode!r}")
    got = "__bitloom"
    out = df.withColumn(got, decode_column(F.col(column), script, **options))
    if mode == "DROPMALFORMED":
        out = out.where(F.col(got)["error"].isNull())
    value = F.col(got)["value"]
    if mode == "FAILFAST":
        said = F.concat(F.col(got)["error"]["code"], F.lit(": "), F.col(got)["error"]["message"])
        value = F.when(F.col(got)["error"].isNotNull(), F.raise_error(said).cast(out.schema[got].dataType["value"].dataType)).otherwise(value)
    new = {into: value}
    if metadata:
        new |= {"_error": F.col(got)["error"], "_bytes_consumed": F.col(got)["consumed"], "_input_size": F.length(F.col(column)).cast("long")}
    return out.withColumns(new).drop(got)


def records(df: DataFrame, column: str, script: str, field: str, *, keep: list[str] | None = None, **options) -> DataFrame:
    """One row for each element of an array member: the kept columns, pos and the element."""
    got = parse(df, column, script, fields=[field], into="__r", metadata=False, **options)
    keep = [c for c in df.columns if c != column] if keep is None else keep
    return got.select(*keep, F.posexplode_outer(F.col("__r")[field]).alias("pos", "element"))


NODE = T.StructType([T.StructField("node_id", T.IntegerType()), T.StructField("parent_id", T.IntegerType()), T.StructField("depth", T.IntegerType()), T.StructField("field", T.StringType()), T.StructField("value", T.StringType())])


def _flat(scope: Scope) -> list[dict]:
    out: list[dict] = []
    todo = [(scope, None, 0, "")]
    while todo:
        at, parent, depth, name = todo.pop()
        own, inner = {}, []
        for k, v in at.out.items():
            v = v.value if isinstance(v, Variant) else v
            if isinstance(v, Scope):
                inner.append((k, v))
            elif isinstance(v, list) and v and isinstance(v[0], Scope):
                inner += [(k, x) for x in v]
            else:
                own[k] = plain(v)
        me = len(out)
        out.append({"node_id": me, "parent_id": parent, "depth": depth, "field": name, "value": json.dumps(own, ensure_ascii=False, separators=(",", ":"))})
        todo += [(v, me, depth + 1, k) for k, v in reversed(inner)]
    return out


def nodes(df: DataFrame, column: str, script: str, *, entry: str | None = None, params: dict | None = None, modules: Mapping[str, str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Trees and lists as rows: every structure of a cell is a node with its scalar members as
    JSON. A wrong or null cell gives no row."""
    _layout(script, modules).entry(entry)

    @F.arrow_udf(T.ArrayType(NODE))
    def flatten(cells: pa.Array) -> pa.Array:
        reader = Reader(_layout(script, modules))
        out = []
        for x in cells:
            try:
                out.append(_flat(reader.read(x.as_py(), entry, params)[0]) if x.is_valid else [])
            except (CellError, RecursionError):
                out.append([])
        return pa.array(out, pa.list_(to_arrow_type(NODE)))

    keep = [c for c in df.columns if c != column] if keep is None else keep
    return df.select(*keep, F.explode(flatten(F.col(column))).alias("n")).select(*keep, "n.*")


def encode_column(value: Column, script: str, *, entry: str | None = None, params: dict | None = None, modules: Mapping[str, str] | None = None, fail: bool = False) -> Column:
    """Bytes of a struct column or of JSON text; null where the value can't be written, unless
    ``fail`` is set."""
    _layout(script, modules).entry(entry)

    @F.arrow_udf(T.BinaryType())
    def encode(values: pa.Array) -> pa.Array:
        writer = Writer(_layout(script, modules))
        out = []
        for x in values:
            if not x.is_valid:
                out.append(None)
                continue
            v = x.as_py()
            try:
                out.append(writer.write(v if isinstance(v, str) else untyped(v), entry, params))
            except (CellError, ValueError, KeyError, TypeError, AttributeError):
                if fail:
                    raise
                out.append(None)
        return pa.array(out, pa.binary())

    return encode(value)


def produce(df: DataFrame, column: str, script: str, *, into: str = "bytes", lowering: str = "auto", **options) -> DataFrame:
    """``df`` with the bytes that ``column`` (a struct or JSON text) makes under the layout.

    A layout whose places don't depend on the value becomes Catalyst columns; any other, and JSON
    text, goes through the writer. ``lowering`` is auto, columns or writer."""
    kind = df.schema[column].dataType
    if lowering != "writer" and isinstance(kind, T.StructType) and not options.get("fail") and not options.get("params"):
        try:
            layout = _layout(script, options.get("modules"))
            return df.withColumn(into, BytesPlan(layout).build(F.col(column), kind, options.get("entry")))
        except NotLowered:
            if lowering == "columns":
                raise
    elif lowering == "columns":
        raise NotLowered("JSON text, parameters or fail")
    return df.withColumn(into, encode_column(F.col(column), script, **options))


def size_column(value: Column, script: str, **options) -> Column:
    """How many bytes ``encode_column`` makes of a value; null where it can't be written."""
    return F.octet_length(encode_column(value, script, **options)).cast("long")


def explain(script: str, *, entry: str | None = None, modules: Mapping[str, str] | None = None) -> str:
    """Which lowering a layout takes, and why not columns; then its Spark schema."""
    layout = _layout(script, modules)
    top = layout.entry(entry)

    def said(make) -> str:
        try:
            make()
        except NotLowered as e:
            return f"rows in Python ({e})"
        return "Catalyst columns"

    schema = struct_schema(layout, top)
    read = said(lambda: ColumnPlan(layout, F.col("cell")).build(entry))
    write = said(lambda: BytesPlan(layout).build(F.col("value"), schema, entry))
    return f"{top.name}\n  parse: {read}\n  produce: {write}\n{schema.treeString()}"


def register(spark: SparkSession, name: str, script: str, *, entry: str | None = None, params: dict | None = None, modules: Mapping[str, str] | None = None) -> None:
    """A SQL function from a binary cell to the JSON text of what it holds (null if it is wrong)."""
    _layout(script, modules).entry(entry)

    @F.arrow_udf(T.StringType())
    def decode(cells: pa.Array) -> pa.Array:
        reader = Reader(_layout(script, modules))
        out = []
        for x in cells:
            try:
                out.append(to_json(reader.read(x.as_py(), entry, params)[0]) if x.is_valid else None)
            except (CellError, RecursionError):
                out.append(None)
        return pa.array(out, pa.string())

    spark.udf.register(name, decode)


def register_records(spark: SparkSession, name: str, script: str, field: str, *, entry: str | None = None, params: dict | None = None, modules: Mapping[str, str] | None = None) -> None:
    """A SQL table function: ``LATERAL name(cell)`` gives (pos, element as JSON) of an array member.
    A wrong or null cell gives no row."""
    _layout(script, modules).entry(entry)

    class Records:
        def eval(self, cell: bytes):
            if cell is None:
                return
            try:
                scope, _ = Reader(_layout(script, modules)).read(cell, entry, params)
            except (CellError, RecursionError):
                return
            for pos, x in enumerate(scope.out.get(field) or []):
                yield pos, json.dumps(plain(x), ensure_ascii=False, separators=(",", ":"))

    spark.udtf.register(name, F.udtf(Records, returnType="pos int, element string"))
