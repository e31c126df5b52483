"""API descriptions in XML and JSON as chunk rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import text as T

_TEXT = S.StringType()


def _struct(*names: str, **more: S.DataType) -> S.StructType:
    return S.StructType([S.StructField(n, _TEXT) for n in names] + [S.StructField(k, v) for k, v in more.items()])


_PARAM = S.ArrayType(_struct("_name", "_type", "_default"))
CLASS_XML = _struct(
    "_name", "_inherits", "brief_description", "description",
    methods=_struct(method=S.ArrayType(_struct("_name", "_qualifiers", "description", **{"return": _struct("_type"), "param": _PARAM}))),
    members=_struct(member=S.ArrayType(_struct("_name", "_type", "_default", "inner_text"))),
    signals=_struct(signal=S.ArrayType(_struct("_name", "description", param=_PARAM))),
    constants=_struct(constant=S.ArrayType(_struct("_name", "_value", "_enum", "inner_text"))),
)
_ARGUMENTS = S.ArrayType(_struct("value_type", "name", "default_value"))
_METHOD = _struct("name", "return_type", "doc_comments", arguments=_ARGUMENTS, is_static=S.BooleanType(), is_virtual=S.BooleanType(), is_const_this=S.BooleanType(), is_override=S.BooleanType())
_TYPE = _struct("name", "mode", "doc_comments", methods=S.ArrayType(_METHOD), properties=S.ArrayType(_struct("name", "value_type", "default_value", "doc_comments")))
API_JSON = _struct(classes=S.ArrayType(_TYPE), structs=S.ArrayType(_TYPE), enums=S.ArrayType(_struct("name", "doc_comments", variants=S.ArrayType(_TEXT))), functions=S.ArrayType(_METHOD))


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def parameters(params: Column, name: str, kind: str, default: str) -> Column:
    """``type name = default`` joined by commas."""
    one = lambda p: F.concat_ws(" ", p[kind], p[name], F.when(p[default].isNotNull(), F.concat(F.lit("= "), p[default])))
    return F.array_join(F.transform(F.coalesce(params, F.array()), one), ", ")


def finish(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Naming, summary and token estimate of chunk rows with ``parent_name``, ``name``, ``chunk_type``, ``content``; ``keys`` are kept."""
    qualified = F.when(F.col("chunk_type") == "class_overview", F.col("parent_name")).otherwise(F.concat_ws(".", "parent_name", "name"))
    return rows.where(_or_empty(F.col("name")) != "").select(
        *keys, "parent_name", qualified.alias("qualified_name"), "chunk_type", T.first_sentence(_or_empty(F.col("about"))).alias("summary"), "content", T.token_estimate(F.col("content")).alias("token_count")
    )


def xml_chunks(classes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Chunks of class descriptions read with ``CLASS_XML``: overview, methods, members, signals, constants; ``keys`` are kept."""
    c = classes.where(F.col("_name").isNotNull())
    about = T.strip(F.concat_ws("\n\n", T.strip(F.col("brief_description")), T.strip(F.col("description"))))
    overview = c.select(*keys, F.col("_name").alias("parent_name"), F.col("_name").alias("name"), F.lit("class_overview").alias("chunk_type"), about.alias("about"), F.concat_ws("\n", F.concat(F.lit("# "), "_name"), F.concat(F.lit("Inherits: "), "_inherits"), about).alias("content"))

    def part(items: str, kind: Column, signature: Column, said: Column) -> DataFrame:
        flat = c.select(*keys, F.col("_name").alias("parent_name"), F.explode(items).alias("m"))
        return flat.select(*keys, "parent_name", F.col("m._name").alias("name"), kind.alias("chunk_type"), T.strip(_or_empty(said)).alias("about"), F.concat_ws("\n\n", signature, F.nullif(T.strip(_or_empty(said)), F.lit(""))).alias("content"))

    methods = part("methods.method", F.lit("method"), F.concat(F.coalesce(F.col("m.return._type"), F.lit("void")), F.lit(" "), F.col("m._name"), F.lit("("), parameters(F.col("m.param"), "_name", "_type", "_default"), F.lit(")")), F.col("m.description"))
    members = part("members.member", F.lit("property"), F.concat_ws(" ", F.col("m._type"), F.col("m._name"), F.when(F.col("m._default").isNotNull(), F.concat(F.lit("= "), F.col("m._default")))), F.col("m.inner_text"))
    signals = part("signals.signal", F.lit("signal"), F.concat(F.lit("signal "), F.col("m._name"), F.lit("("), parameters(F.col("m.param"), "_name", "_type", "_default"), F.lit(")")), F.col("m.description"))
    constants = part("constants.constant", F.when(F.col("m._enum").isNotNull(), "enum").otherwise("constant"), F.concat_ws(" = ", F.col("m._name"), F.col("m._value")), F.col("m.inner_text"))
    return finish(overview.unionByName(methods).unionByName(members).unionByName(signals).unionByName(constants), keys)


def scan_xml(spark: SparkSession, root: str) -> DataFrame:
    """Chunks of every class description below a folder."""
    return xml_chunks(spark.read.schema(CLASS_XML).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").option("rowTag", "class").option("valueTag", "inner_text").format("xml").load(root))


def signature(m: Column) -> Column:
    """``name(type arg = default, ...) -> type [static, virtual, const, override]``."""
    flags = F.array_compact(F.array(*[F.when(m[field], label) for field, label in (("is_static", "static"), ("is_virtual", "virtual"), ("is_const_this", "const"), ("is_override", "override"))]))
    result = F.when(_or_empty(m["return_type"]) != "", F.concat(F.lit(" -> "), m["return_type"])).otherwise("")
    return F.concat(m["name"], F.lit("("), parameters(m["arguments"], "name", "value_type", "default_value"), F.lit(")"), result, F.when(F.size(flags) > 0, F.concat(F.lit(" ["), F.array_join(flags, ", "), F.lit("]"))).otherwise(""))


def json_chunks(files: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Chunks of API files read with ``API_JSON``: types with members, enums and global functions; ``keys`` are kept."""
    types = files.select(*keys, F.explode(F.concat(F.coalesce("classes", F.array()), F.coalesce("structs", F.array()))).alias("t")).where(F.col("t.name").isNotNull())
    row = lambda df, parent, name, kind, about, content: df.select(*keys, parent.alias("parent_name"), name.alias("name"), F.lit(kind).alias("chunk_type"), about.alias("about"), content.alias("content"))
    doc = lambda c: F.nullif(T.strip(_or_empty(c)), F.lit(""))
    overview = row(types, F.col("t.name"), F.col("t.name"), "class_overview", F.col("t.doc_comments"), F.concat_ws("\n\n", F.concat(F.lit("# "), F.col("t.name")), doc(F.col("t.doc_comments"))))
    methods = types.select(*keys, F.col("t.name").alias("p"), F.explode("t.methods").alias("m"))
    properties = types.select(*keys, F.col("t.name").alias("p"), F.explode("t.properties").alias("m"))
    enums = files.select(*keys, F.explode("enums").alias("m"))
    functions = files.select(*keys, F.explode("functions").alias("m"))
    m = F.col("m")
    parts = [
        overview,
        row(methods, F.col("p"), m["name"], "method", m["doc_comments"], F.concat_ws("\n\n", signature(m), doc(m["doc_comments"]))),
        row(properties, F.col("p"), m["name"], "property", m["doc_comments"], F.concat_ws("\n\n", F.concat_ws(" ", F.concat(m["name"], F.lit(":")), m["value_type"], F.when(m["default_value"].isNotNull(), F.concat(F.lit("= "), m["default_value"]))), doc(m["doc_comments"]))),
        row(enums, m["name"], m["name"], "enum", m["doc_comments"], F.concat_ws("\n", m["name"], F.array_join(F.transform(m["variants"], lambda v: F.concat(F.lit("- "), v)), "\n"))),
        row(functions, F.lit("Global"), m["name"], "method", m["doc_comments"], F.concat_ws("\n\n", signature(m), doc(m["doc_comments"]))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return finish(out, keys)


def scan_json(spark: SparkSession, path: str) -> DataFrame:
    return json_chunks(spark.read.schema(API_JSON).option("multiLine", "true").json(path))
