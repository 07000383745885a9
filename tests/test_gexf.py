"""GEXF graphs: round trip, files of other tools, missing graphs, values that XML must escape."""

import glob
import xml.etree.ElementTree as ET

import pytest

from cograph.sources import gexf

OTHER_TOOL = """<?xml version='1.0' encoding='utf-8'?>
<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2">
  <graph defaultedgetype="undirected" mode="static" name="">
    <attributes mode="static" class="node">
      <attribute id="0" title="frequency" type="long" />
      <attribute id="1" title="share" type="double" />
    </attributes>
    <nodes>
      <node id="null" label="null">
        <attvalues>
          <attvalue for="0" value="5" />
          <attvalue for="1" value="0.25" />
        </attvalues>
      </node>
      <node id="007" label="x"></node>
      <node id="8" label="x"/>
    </nodes>
    <edges>
      <edge source="null" target="007" id="0" weight="0.5" />
      <edge source="007" target="8" id="1" />
    </edges>
  </graph>
</gexf>
"""


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_round_trip_over_many_parts(spark, tmp_path):
    ids = ["a", " b ", 'q"<&>\'', "new\nline\t.", "007", "null", "", "é😀", "&amp;"] + [f"n{i}" for i in range(300)]
    nodes = spark.createDataFrame([(x, i, i / 3, i % 2 == 0, x) for i, x in enumerate(ids)] + [("no values", None, None, None, None)],
                                  "id string, frequency long, `a share` double, even boolean, label string").repartition(7)
    edges = spark.createDataFrame([(ids[i], ids[i // 2], 1 / (i + 3) ** 9) for i in range(1, len(ids))] + [("a", "a", 1e300), ("a", "a", 1e300)],
                                  "src string, dst string, weight double").repartition(5)
    path = str(tmp_path / "g.gexf")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        gexf.write_gexf(edges, nodes, path, 'na"me')
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = gexf.read_gexf(spark, path)
    assert rows(got[0]) == rows(edges) and rows(got[1]) == rows(nodes)
    assert got[1].schema.simpleString() == nodes.schema.simpleString()
    parts = sorted(glob.glob(path + "/part-*"))
    assert len(parts) > 1
    graph = ET.fromstring("".join(open(p, encoding="utf-8", newline="").read() for p in parts).encode())[0]  # the parts are one document
    tag = lambda x: "{" + gexf.NAMESPACE + "}" + x
    assert [c.tag for c in graph] == [tag("attributes"), tag("nodes"), tag("edges")] and graph.get("name") == 'na"me'
    assert sorted(n.get("id") for n in graph[1]) == sorted([*ids, "no values"])
    assert len({e.get("id") for e in graph[2]}) == len(graph[2]) == edges.count()


def test_files_of_other_tools(spark, tmp_path):
    path = tmp_path / "other.gexf"
    path.write_text(OTHER_TOOL)
    edges, nodes = gexf.read_gexf(spark, str(path))
    assert rows(edges) == [("007", "8", 1.0), ("null", "007", 0.5)]
    assert nodes.dtypes == [("id", "string"), ("frequency", "bigint"), ("share", "double")]
    assert rows(nodes) == rows(spark.createDataFrame([("null", 5, 0.25), ("007", None, None), ("8", None, None)], nodes.schema))


def test_missing_and_empty_graphs(spark, tmp_path):
    assert gexf.read_gexf(spark, str(tmp_path / "never_written.gexf")) is None
    edges, nodes = spark.createDataFrame([], "src string, dst string, weight double"), spark.createDataFrame([], "id long, frequency long")
    gexf.write_gexf(edges, nodes, str(tmp_path / "empty.gexf"))
    e, n = gexf.read_gexf(spark, str(tmp_path / "empty.gexf"))
    assert (e.count(), n.count(), n.columns) == (0, 0, ["id", "frequency"])


@pytest.mark.parametrize("bad", [("a\x00", "b"), (None, "b")])
def test_what_no_document_can_hold_raises(spark, tmp_path, bad):
    edges = spark.createDataFrame([(*bad, 1.0)], "src string, dst string, weight double")
    with pytest.raises(Exception, match="XML cannot hold|null src"):
        gexf.write_gexf(edges, spark.createDataFrame([], "id string"), str(tmp_path / "bad.gexf"))
