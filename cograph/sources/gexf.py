"""Graph files that other tools open: GEXF, read and written in partitions.

A graph is one GEXF document in a folder of part files, in order: the parts one after another (``cat part-*``) are the
document. Every element stands on a line of its own, so each task writes its range of nodes or edges and no task
holds a graph. Reading goes through Spark's XML source, a file as a stream of elements: a folder written here is read by as many
tasks as it has parts, a file of another tool by one, which deals its elements out as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .io import _fs_exists

# Fixed values of the format.
NAMESPACE = "http://www.gexf.net/1.2draft"
VERSION = "1.2"
TYPES = {"string": "string", "integer": "int", "long": "bigint", "float": "float", "double": "double", "boolean": "boolean", "anyURI": "string", "liststring": "string"}
ESCAPES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "\t": "&#9;", "\n": "&#10;", "\r": "&#13;"}
NO_XML = r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]"  # characters that no XML document can hold

_NAMES = {v: k for k, v in TYPES.items() if k not in ("anyURI", "liststring")}


def _escaped(value: Column) -> Column:
    out = value.cast("string")
    fit = F.when(out.rlike(NO_XML), F.raise_error(F.lit("a value holds a character that XML cannot hold"))).otherwise(out)
    for raw, reference in ESCAPES.items():
        fit = F.replace(fit, F.lit(raw), F.lit(reference))
    return fit


def _attribute(name: str, value: Column) -> Column:
    return F.concat(F.lit(f' {name}="'), _escaped(value), F.lit('"'))


def _literal(text: str) -> str:
    for raw, reference in ESCAPES.items():
        text = text.replace(raw, reference)
    return text


def write_gexf(edges: DataFrame, nodes: DataFrame, path: str, name: str = "") -> None:
    """Write ``edges (src, dst, weight)`` and ``nodes (id, ...)`` as one undirected GEXF document in the folder ``path``.

    Ids and attributes become strings, further columns of ``nodes`` its attributes (nested ones as JSON text). Null
    attributes and weights are left out; rows with a null id or end are not elements of a graph and raise, as do characters
    that XML cannot hold. Repeated rows are written as often as they come. Empty tables leave a document without elements.
    """
    def given(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.raise_error(F.lit(f"null {c} in a graph")).cast("string"))

    simple = {f.name: _NAMES.get(f.dataType.simpleString(), "string") for f in nodes.schema.fields if f.name != "id"}
    head = ["<?xml version='1.0' encoding='UTF-8'?>", f'<gexf xmlns="{NAMESPACE}" version="{VERSION}">',
            f'<graph defaultedgetype="undirected" mode="static" name="{_literal(name)}">', '<attributes class="node" mode="static">']
    head += [f'<attribute id="{i}" title="{_literal(c)}" type="{kind}"/>' for i, (c, kind) in enumerate(simple.items())]
    head += ["</attributes>", "<nodes>"]
    values = []
    for i, c in enumerate(simple):
        value = F.to_json(F.col(f"`{c}`")) if isinstance(nodes.schema[c].dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f"`{c}`")
        values.append(F.coalesce(F.concat(F.lit(f'<attvalue for="{i}"'), _attribute("value", value), F.lit("/>")), F.lit("")))
    node = F.concat(F.lit("<node"), _attribute("id", given("id")), _attribute("label", given("id")), F.lit("><attvalues>"), *values, F.lit("</attvalues></node>"))
    number = F.monotonically_increasing_id()
    edge = F.concat(F.lit("<edge"), _attribute("source", given("src")), _attribute("target", given("dst")),
                    F.coalesce(_attribute("weight", F.col("weight")), F.lit("")), _attribute("id", number), F.lit("/>"))
    fixed = [(0, i, line) for i, line in enumerate(head)] + [(2, 0, "</nodes>"), (2, 1, "<edges>"), (4, 0, "</edges>"), (4, 1, "</graph>"), (4, 2, "</gexf>")]
    lines = (
        nodes.sparkSession.createDataFrame(fixed, "section int, number long, line string")
        .unionByName(nodes.select(F.lit(1).alias("section"), number.alias("number"), node.alias("line")))
        .unionByName(edges.select(F.lit(3).alias("section"), number.alias("number"), edge.alias("line")))
    )
    lines.orderBy("section", "number").select("line").write.mode("overwrite").text(path)


def read_gexf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """``(edges(src, dst, weight), nodes(id, attributes...))`` of a GEXF file or folder; None where there is none.

    Ids are strings, weights doubles (1.0 where an edge has none); node attributes get their declared types. Only the
    declarations of attributes, a few elements, reach the driver.
    """
    if not _fs_exists(spark, path):
        return None

    def elements(tag: str, schema: str) -> DataFrame:
        options = {"rowTag": tag, "mode": "FAILFAST", "nullValue": "\u0001", "ignoreSurroundingSpaces": "false", "useLegacyXMLParser": "true"}  # a part is no document of its own
        return spark.read.format("xml").options(**options).schema(schema).load(path)

    # one declaration a row: the parts of a folder may be cut between them
    declared = elements("attribute", "_id string, _title string, _type string").where("_title IS NOT NULL").distinct().collect()
    edges = elements("edge", "_source string, _target string, _weight double").select(
        F.col("_source").alias("src"), F.col("_target").alias("dst"), F.coalesce("_weight", F.lit(1.0)).alias("weight"))
    nodes = elements("node", "_id string, attvalues struct<attvalue: array<struct<_for: string, _value: string>>>")

    def value(of: str) -> Column:
        return F.filter("attvalues.attvalue", lambda a: a["_for"] == of)[0]["_value"]

    columns = [value(d["_id"]).cast(TYPES.get(d["_type"], "string")).alias(d["_title"]) for d in sorted(declared, key=lambda d: (len(d["_id"]), d["_id"]))]
    return edges, nodes.select(F.col("_id").alias("id"), *columns)
