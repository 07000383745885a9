"""Registered queries: one per SURVEY §2 operator, each a (spark, sf_dir) -> DataFrame callable
over whole driver tables, with the equivalent DuckDB SQL where the operator is SQL-expressible.

Floating results built from sums in engine-dependent order (degrees, modularity, means,
activations) are rounded to 9 places on both sides; phi weights are computed with the same
operations in the same order and are compared unrounded.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify as K
from ..operators import community as CM
from ..operators import contrast as X
from ..operators import corpus as C
from ..operators import dictionary as D
from ..operators import graph as G
from ..operators import splits as S
from ..operators.topk import top_k_per_group
from ..session import checkpoint_dir
from ..sources import gexf, io
from . import bindings as B
from .bindings import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def q(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


def r9(c):
    return F.round(c, 9)


def _scratch(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{checkpoint_dir(spark).rstrip('/')}/cograph-{name}-{uuid.uuid4().hex}"


# ================================================================== SQL building blocks
W = B.WINDOW
KW_SQL = " OR ".join(f"contains(lower(text), '{k}')" for k in B.KEYWORDS)
WORDS = "regexp_extract_all(lower(text), '\\p{L}+')"
def word_ctx(where: str = "true") -> str:
    return f"""ctx AS (
  SELECT DISTINCT doc_id, p // {W} AS win, w AS feature FROM (
    SELECT doc_id, unnest(ws) AS w, unnest(generate_series(0, len(ws) - 1)) AS p
    FROM (SELECT doc_id, {WORDS} AS ws FROM documents WHERE {where})))"""


WORD_CTX = word_ctx()
BRAND_CTX = """ctx AS (
  SELECT DISTINCT l.l_orderkey AS c, p.p_brand AS feature
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
  WHERE l.l_orderkey IN (SELECT o_orderkey FROM orders))"""


def phi_sql(ctx_cte: str, keys: list[str], n_sql: str, min_c: int = B.MIN_COOC, phi: float = B.PHI) -> str:
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    phi_expr = (
        "(big_n * n_ij - fi.frequency::DOUBLE * fj.frequency::DOUBLE) / "
        "(sqrt(fi.frequency::DOUBLE * (big_n - fi.frequency::DOUBLE)) * sqrt(fj.frequency::DOUBLE * (big_n - fj.frequency::DOUBLE)))"
    )
    return f"""{ctx_cte},
nn AS (SELECT ({n_sql})::DOUBLE AS big_n),
freq AS (SELECT feature, count(*) AS frequency FROM ctx GROUP BY feature),
pairs AS (
  SELECT a.feature AS i, b.feature AS j, count(*) AS n_ij FROM ctx a JOIN ctx b ON {on} AND a.feature < b.feature
  GROUP BY 1, 2 HAVING count(*) >= {min_c}),
cand AS (
  SELECT i AS src, j AS dst, {phi_expr} AS weight
  FROM pairs JOIN freq fi ON fi.feature = i JOIN freq fj ON fj.feature = j, nn
  WHERE fi.frequency < big_n AND fj.frequency < big_n),
edges AS (SELECT src, dst, weight FROM cand WHERE weight > {phi}),
nodes AS (
  SELECT feature AS id, frequency FROM freq
  WHERE feature IN (SELECT src FROM edges UNION SELECT dst FROM edges)),
sym AS (SELECT src AS id, dst AS nbr, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges)"""


WORDS_N = f"SELECT count(*) FROM (SELECT DISTINCT doc_id, win FROM ctx)"
WORDS_GRAPH = "WITH " + phi_sql(WORD_CTX, ["doc_id", "win"], WORDS_N)
BRANDS_GRAPH = "WITH " + phi_sql(BRAND_CTX, ["c"], "SELECT count(*) FROM orders")
ANCHOR_GRAPH = "WITH " + phi_sql(word_ctx(f"lang = '{B.ANCHOR_LANG}'"), ["doc_id", "win"], WORDS_N)
OTHER_GRAPH = "WITH " + phi_sql(word_ctx(f"lang <> '{B.ANCHOR_LANG}' AND ({KW_SQL})"), ["doc_id", "win"], WORDS_N)

# ================================================================== sources and sinks


@q("read_corpus", "SELECT doc_id, text, lang FROM documents")
def read_corpus(spark, d):
    return io.read_corpus(spark, f"{d}/documents.parquet").select("doc_id", "text", "lang")


@q("read_corpus_dir", "SELECT doc_id, source, n_chars FROM documents")
def read_corpus_dir(spark, d):
    path = _scratch(spark, "corpus")
    docs = table(spark, d, "documents")
    docs.repartition(max(4, docs.rdd.getNumPartitions())).write.parquet(path)  # a directory of several files
    return io.read_corpus(spark, path).select("doc_id", "source", "n_chars")


@q("read_table", "SELECT * FROM part")
def read_table(spark, d):
    return io.read_table(spark, f"{d}/part.parquet")


@q(
    "csv_to_parquet",
    "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part",
)
def csv_to_parquet(spark, d):
    src = _scratch(spark, "csv") + ".csv"
    table(spark, d, "part").write.option("header", True).csv(src)
    dst = io.csv_to_parquet(spark, src)
    out = spark.read.parquet(dst)
    return out.select(
        F.col("p_partkey").cast("bigint").alias("p_partkey"),
        F.col("p_name").cast("string"),
        F.col("p_brand").cast("string"),
        F.col("p_type").cast("string"),
        F.col("p_size").cast("int"),
        F.col("p_retailprice").cast("double"),
    )


TOPICS_SQL = """topic_sides AS (
  SELECT conv_id AS topic, role AS side, string_agg(text, ' ' ORDER BY turn) AS text
  FROM conversations GROUP BY conv_id, role)"""


def _conversation_topics(spark, d) -> DataFrame:
    conv = table(spark, d, "conversations")
    per = conv.groupBy("conv_id", "role").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("tt"))
    per = per.select("conv_id", "role", F.array_join(F.transform("tt", lambda s: s["text"]), " ").alias("text"))
    return per.groupBy(F.col("conv_id").alias("topic")).agg(F.map_from_entries(F.collect_list(F.struct("role", "text"))).alias("sides"))


@q("read_contrast_topics", f"WITH {TOPICS_SQL} SELECT topic, side, text FROM topic_sides")
def read_contrast_topics(spark, d):
    return io.read_contrast_topics(_conversation_topics(spark, d))


@q(
    "contexts_roundtrip",
    f"WITH {WORD_CTX} SELECT doc_id, win, list_sort(list(feature)) AS features FROM ctx GROUP BY doc_id, win",
)
def contexts_roundtrip(spark, d):
    path = _scratch(spark, "contexts")
    ctx = B.word_contexts(spark, d).select("doc_id", "win", F.sort_array("features").alias("features"))
    io.write_contexts(ctx, path)
    return io.read_contexts(spark, path)


@q("graph_roundtrip", f"{ANCHOR_GRAPH} SELECT id, frequency FROM nodes")
def graph_roundtrip(spark, d):
    e, n = B.corpus_graph(spark, d, "anchor")
    root = _scratch(spark, "graph")
    io.write_graph(e, n, root, "anchor")
    return io.read_graph(spark, root, "anchor")[1]


def once(sql: str) -> str:
    """The same SQL with every CTE computed once."""
    return re.sub(r"\b(\w+) AS \(\s*SELECT", r"\1 AS MATERIALIZED (SELECT", sql)


@q(
    "graph_gexf",
    f"""{once(WORDS_GRAPH)}
    SELECT id, NULL AS other, frequency::DOUBLE AS value FROM nodes UNION ALL SELECT src, dst, round(weight, 9) FROM edges""",
)
def graph_gexf(spark, d):
    """Nodes and edges of the whole word graph, through a GEXF document."""
    path = f"{_scratch(spark, 'graph')}.gexf"
    gexf.write_gexf(*B.words_graph(spark, d), path, "words")
    e, n = gexf.read_gexf(spark, path)
    nodes = n.select("id", F.lit(None).cast("string").alias("other"), F.col("frequency").cast("double").alias("value"))
    return nodes.unionByName(e.select(F.col("src").alias("id"), F.col("dst").alias("other"), r9(F.col("weight")).alias("value")))


@q("cast_edge_weights", f"{ANCHOR_GRAPH} SELECT src, dst, round(weight::FLOAT::DOUBLE, 5) AS weight FROM edges")
def cast_edge_weights(spark, d):
    e, n = B.corpus_graph(spark, d, "anchor")
    root = _scratch(spark, "graph")
    io.write_graph(e.withColumn("weight", F.col("weight").cast("float")), n, root, "anchor")
    # weights stored as float, re-cast to double after the load; compare at float precision
    out = io.read_graph(spark, root, "anchor")[0]
    return out.select("src", "dst", F.round("weight", 5).alias("weight"))



DICT_SQL = f"""dims AS (
  SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(generate_series(0, len(embedding) - 1)) AS k FROM embeddings),
mu AS (SELECT k, avg(v) AS m FROM dims GROUP BY k),
cen AS (SELECT label, k, avg(v) AS c FROM dims GROUP BY label, k),
dirs AS (SELECT label AS feature, cen.k, c - m AS u FROM cen JOIN mu USING (k)),
nrm AS (SELECT feature, sqrt(sum(u * u)) AS nn FROM dirs GROUP BY feature),
wenc AS (SELECT feature, k, {B.DICT_GAIN} * u / nn AS w FROM dirs JOIN nrm USING (feature)),
acts AS (
  SELECT d.vec_id, w.feature, sum((d.v - mu.m) * w.w) AS act
  FROM dims d JOIN mu USING (k) JOIN wenc w USING (k) GROUP BY 1, 2)"""


@q(
    "read_dictionary",
    f"WITH {DICT_SQL} SELECT feature, round(sqrt(sum(w * w)), 9) AS w_norm, count(*) AS dim FROM wenc GROUP BY feature",
)
def read_dictionary(spark, d):
    path = _scratch(spark, "dict")
    B.dictionary_table(spark, d).write.parquet(path)
    io.read_dictionary(spark, path, expected_dim=B.dictionary(spark, d).dim)  # checks the dimension, whatever the size
    norm = F.sqrt(F.aggregate("w_enc", F.lit(0.0), lambda acc, w: acc + w * w))
    return spark.read.parquet(path).select("feature", F.round(norm, 9).alias("w_norm"), F.size("w_enc").cast("bigint").alias("dim"))


@q("write_result_csv", f"WITH {WORD_CTX} SELECT feature, count(*) AS frequency FROM ctx GROUP BY feature")
def write_result_csv(spark, d):
    path = _scratch(spark, "csv")
    io.write_result_csv(B.words_frequency(spark, d), path)
    return spark.read.option("header", True).schema("feature string, frequency bigint").csv(path)


SPLIT_SQL = """ranked AS (
  SELECT *, row_number() OVER (ORDER BY md5(p_partkey::VARCHAR || '|42'), p_partkey) - 1 AS i, count(*) OVER () AS n FROM part),
sized AS (SELECT *, ceil(0.15 * n) AS n_test, ceil((0.15 / (0.7 + 0.15)) * (n - ceil(0.15 * n))) AS n_valid FROM ranked)"""
SPLIT_EXPR = "CASE WHEN i < n_test THEN 'test' WHEN i < n_test + n_valid THEN 'valid' ELSE 'train' END"


@q("write_splits", f"WITH {SPLIT_SQL} SELECT p_partkey, p_brand, {SPLIT_EXPR} AS split FROM sized")
def write_splits(spark, d):
    src = _scratch(spark, "split")
    table(spark, d, "part").write.parquet(src + "/input.parquet")
    part = io.read_table(spark, src + "/input.parquet")
    out = io.write_splits(S.split_3way(part, "p_partkey"), src + "/input.parquet")
    parts = [spark.read.parquet(p).select("p_partkey", "p_brand", F.lit(n).alias("split")) for n, p in out.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@q("split_3way", f"WITH {SPLIT_SQL} SELECT p_partkey, {SPLIT_EXPR} AS split FROM sized")
def split_3way(spark, d):
    return S.split_3way(table(spark, d, "part"), "p_partkey").select("p_partkey", "split")


# ================================================================== corpus
OTHER_SQL = f"SELECT doc_id, text FROM documents WHERE lang <> '{B.ANCHOR_LANG}' AND ({KW_SQL})"


def _anchor(spark, d):
    return table(spark, d, "documents").filter(F.col("lang") == B.ANCHOR_LANG)


def _other(spark, d):
    return table(spark, d, "documents").filter(F.col("lang") != B.ANCHOR_LANG)


@q("keyword_filter", f"SELECT doc_id FROM documents WHERE {KW_SQL}")
def keyword_filter(spark, d):
    return C.keyword_filter(table(spark, d, "documents"), B.KEYWORDS).select("doc_id")


@q("tokenize", f"SELECT doc_id, {WORDS} AS ids FROM documents")
def tokenize(spark, d):
    return C.tokenize(table(spark, d, "documents"))


@q("token_count", f"SELECT doc_id, len({WORDS})::INT AS n_tokens FROM documents")
def token_count(spark, d):
    return C.token_count(C.tokenize(table(spark, d, "documents"))).select("doc_id", "n_tokens")


@q(
    "corpus_tokens",
    f"""SELECT corpus, sum(len({WORDS}))::BIGINT AS total_tokens, count(*) AS n_rows FROM (
      SELECT 'anchor' AS corpus, text FROM documents WHERE lang = '{B.ANCHOR_LANG}'
      UNION ALL SELECT 'other', text FROM ({OTHER_SQL})) GROUP BY corpus""",
)
def corpus_tokens(spark, d):
    a = C.corpus_tokens(C.tokenize(_anchor(spark, d))).withColumn("corpus", F.lit("anchor"))
    o = C.corpus_tokens(C.tokenize(C.keyword_filter(_other(spark, d), B.KEYWORDS))).withColumn("corpus", F.lit("other"))
    return a.unionByName(o).select("corpus", "total_tokens", "n_rows")


@q(
    "sample_order",
    f"SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '|42'), doc_id) - 1 AS idx FROM ({OTHER_SQL})",
)
def sample_order(spark, d):
    o = C.sample_order(C.tokenize(C.keyword_filter(_other(spark, d), B.KEYWORDS)), "random")
    return C.global_index(o, "order_key", "idx").select("doc_id", "idx")


def _accumulate_sql(batch: int) -> str:
    return f"""WITH target AS (SELECT sum(len({WORDS})) AS t FROM documents WHERE lang = '{B.ANCHOR_LANG}'),
o AS (SELECT doc_id, len({WORDS}) AS n, (row_number() OVER (ORDER BY doc_id) - 1) // {batch} AS b FROM ({OTHER_SQL})),
pb AS (SELECT b, sum(n) AS bt FROM o GROUP BY b),
run AS (SELECT b, coalesce(sum(bt) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pb)
SELECT o.doc_id, o.n::INT AS n_tokens FROM o JOIN run USING (b), target WHERE run.before < target.t"""


@q("accumulate_tokens", _accumulate_sql(B.ACC_BATCH))
def accumulate_tokens(spark, d):
    target = C.corpus_tokens(C.tokenize(_anchor(spark, d))).first()["total_tokens"]
    o = C.sample_order(C.tokenize(C.keyword_filter(_other(spark, d), B.KEYWORDS)), "first")
    return C.accumulate_tokens(o, target, B.ACC_BATCH).select("doc_id", F.size("ids").alias("n_tokens"))


@q("prepare_balanced", _accumulate_sql(C.ACCUMULATE_BATCH))
def prepare_balanced(spark, d):
    a, o, _ = C.prepare_balanced(_anchor(spark, d), _other(spark, d), B.KEYWORDS, "first")
    return o.select("doc_id", F.size("ids").alias("n_tokens"))


@q(
    "concat_batches",
    f"""SELECT 'anchor' AS corpus, doc_id, len({WORDS})::INT AS n_tokens FROM documents WHERE lang = '{B.ANCHOR_LANG}'
    UNION ALL SELECT 'other', doc_id, len({WORDS})::INT FROM ({OTHER_SQL})""",
)
def concat_batches(spark, d):
    a = C.tokenize(_anchor(spark, d)).select(F.lit("anchor").alias("corpus"), "doc_id", F.size("ids").alias("n_tokens"))
    o = C.tokenize(C.keyword_filter(_other(spark, d), B.KEYWORDS)).select(F.lit("other").alias("corpus"), "doc_id", F.size("ids").alias("n_tokens"))
    return a.unionByName(o)


def _corpus_windows_sql(where: str) -> str:
    return f"""SELECT doc_id, unnest(generate_series(0, ceil(len({WORDS}) / {W})::BIGINT - 1)) AS win FROM documents WHERE {where}"""


BAL_SQL = f"""a AS ({_corpus_windows_sql(f"lang = '{B.ANCHOR_LANG}'")}),
b AS ({_corpus_windows_sql(f"lang <> '{B.ANCHOR_LANG}' AND ({KW_SQL})")}),
cnt AS (SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b)"""


@q("balance_length", f"WITH {BAL_SQL} SELECT n_a, n_b, least(n_a, n_b) AS n FROM cnt")
def balance_length(spark, d):
    a = C.text_contexts(C.tokenize(_anchor(spark, d)), W)
    b = C.text_contexts(C.tokenize(C.keyword_filter(_other(spark, d), B.KEYWORDS)), W)
    return C.balance_length(a.agg(F.count(F.lit(1)).alias("n")), b.agg(F.count(F.lit(1)).alias("n")))


@q(
    "truncate_contexts",
    f"""WITH {BAL_SQL}
    SELECT doc_id, win FROM (SELECT doc_id, win, row_number() OVER (ORDER BY doc_id, win) AS rn FROM b), cnt
    WHERE rn <= least(n_a, n_b)""",
)
def truncate_contexts(spark, d):
    a = C.text_contexts(C.tokenize(_anchor(spark, d)), W)
    b = C.text_contexts(C.tokenize(C.keyword_filter(_other(spark, d), B.KEYWORDS)), W)
    n = min(a.count(), b.count())
    return C.truncate_contexts(b, n, ["doc_id", "win"]).select("doc_id", "win")


@q(
    "mask_padding",
    f"""SELECT conv_id, turn, pos, token FROM (
      SELECT conv_id, turn, unnest(ws) AS token, unnest(generate_series(0, len(ws) - 1))::INT AS pos
      FROM (SELECT conv_id, turn, {WORDS} AS ws FROM conversations)) WHERE token <> '{B.PAD_TOKEN}'""",
)
def mask_padding(spark, d):
    return C.mask_padding(B.conversation_tokens(spark, d), B.PAD_TOKEN).select("conv_id", "turn", "pos", "token")


@q(
    "clean_label",
    """SELECT conv_id, turn, replace(text, chr(10), '\\n') AS newline_escaped,
    trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS stripped,
    trim(replace(text, 'Ġ', ''), ' ' || chr(9) || chr(10) || chr(13)) AS ego_clean FROM conversations""",
)
def clean_label(spark, d):
    from ..functions import text as T

    c = table(spark, d, "conversations")
    return c.select(
        "conv_id",
        "turn",
        T.clean_label_newline("text").alias("newline_escaped"),
        T.clean_label_strip("text").alias("stripped"),
        T.clean_label_ego("text").alias("ego_clean"),
    )


# ================================================================== graph
@q("build_graph", f"{WORDS_GRAPH} SELECT src, dst, weight FROM edges")
def build_graph(spark, d):
    return B.words_graph(spark, d)[0]


@q("build_graph_brands", f"{BRANDS_GRAPH} SELECT src, dst, weight FROM edges")
def build_graph_brands(spark, d):
    return B.brands_graph(spark, d)[0]


@q(
    "cooccurrence_pairs",
    f"""WITH {BRAND_CTX}
    SELECT a.feature AS i, b.feature AS j, count(*) AS n_ij FROM ctx a JOIN ctx b ON a.c = b.c AND a.feature < b.feature GROUP BY 1, 2""",
)
def cooccurrence_pairs(spark, d):
    return G.cooccurrence_pairs(B.brand_contexts(spark, d), 1)


@q(
    "phi_edges",
    "WITH " + phi_sql(BRAND_CTX, ["c"], "SELECT count(*) FROM orders", 1, -1.0) + " SELECT src, dst, weight FROM edges",
)
def phi_edges(spark, d):
    ctx = B.brand_contexts(spark, d)
    n = ctx.count()
    freq = G.feature_frequency(ctx)
    return G.phi_edges(G.cooccurrence_pairs(ctx, 1), freq, n, 1, -1.0)


@q(
    "context_count",
    f"""WITH {WORD_CTX} SELECT 'words' AS corpus, count(*) AS n_contexts FROM (SELECT DISTINCT doc_id, win FROM ctx)
    UNION ALL SELECT 'brands', count(*) FROM orders""",
)
def context_count(spark, d):
    a = G.context_count(B.word_contexts(spark, d)).withColumn("corpus", F.lit("words"))
    b = G.context_count(B.brand_contexts(spark, d)).withColumn("corpus", F.lit("brands"))
    return a.unionByName(b).select("corpus", "n_contexts")


@q("feature_frequency", f"WITH {WORD_CTX} SELECT feature, count(*) AS frequency FROM ctx GROUP BY feature")
def feature_frequency(spark, d):
    return G.feature_frequency(B.word_contexts(spark, d))


@q(
    "feature_sets",
    f"""WITH {BRAND_CTX}, s AS (SELECT c, list_sort(list(feature)) AS features FROM ctx GROUP BY c)
    SELECT o_orderkey AS ctx, coalesce(s.features, []::VARCHAR[]) AS features FROM orders LEFT JOIN s ON s.c = o_orderkey""",
)
def feature_sets(spark, d):
    return B.brand_contexts(spark, d)


@q("node_attributes", f"{WORDS_GRAPH} SELECT id, frequency FROM nodes")
def node_attributes(spark, d):
    return B.words_graph(spark, d)[1]


@q(
    "graph_counts",
    f"""{WORDS_GRAPH} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges,
    2::DOUBLE * (SELECT count(*) FROM edges) / ((SELECT count(*) FROM nodes)::DOUBLE * ((SELECT count(*) FROM nodes) - 1)::DOUBLE) AS density""",
)
def graph_counts(spark, d):
    e, n = B.words_graph(spark, d)
    return G.graph_counts(e, n)


@q("weighted_degree", f"{WORDS_GRAPH} SELECT id, round(sum(weight), 9) AS weighted_degree FROM sym GROUP BY id")
def weighted_degree(spark, d):
    e, _ = B.words_graph(spark, d)
    return G.weighted_degree(e).select("id", r9(F.col("weighted_degree")).alias("weighted_degree"))


@q(
    "vocabulary_size",
    f"""WITH {DICT_SQL}, act AS (SELECT vec_id, feature FROM acts WHERE greatest(act, 0) > {B.DICT_THRESHOLD})
    SELECT (coalesce(max(feature), 0) + 1)::BIGINT AS vocabulary_size FROM act""",
)
def vocabulary_size(spark, d):
    return G.vocabulary_size(B.dict_contexts(spark, d))


# ================================================================== subgraphs, neighbours, ego
@q(
    "induced_subgraph",
    f"""{WORDS_GRAPH}, sel AS (SELECT id FROM nodes WHERE frequency > 20)
    SELECT src, dst, weight FROM edges WHERE src IN (SELECT id FROM sel) AND dst IN (SELECT id FROM sel)""",
)
def induced_subgraph(spark, d):
    e, n = B.words_graph(spark, d)
    return G.induced_subgraph(e, n.filter(F.col("frequency") > 20))


NBR_SQL = """nb AS (SELECT id AS feature, nbr, weight, row_number() OVER (PARTITION BY id ORDER BY weight DESC, nbr) AS rank FROM sym)"""


@q("neighbours", f"{WORDS_GRAPH}, {NBR_SQL} SELECT feature, nbr, weight, rank::INT AS rank FROM nb WHERE rank <= 4")
def neighbours(spark, d):
    e, n = B.words_graph(spark, d)
    return D.neighbours(e, n.withColumnRenamed("id", "feature"), 4).select("feature", "nbr", "weight", "rank")


@q(
    "format_neighbours",
    f"""{WORDS_GRAPH}, {NBR_SQL}, s AS (
      SELECT feature, string_agg(printf('%s(%.2f)', nbr, weight), ' | ' ORDER BY rank) AS neighbors FROM nb WHERE rank <= 4 GROUP BY feature)
    SELECT f.feature, coalesce(s.neighbors, 'ISOLATED') AS neighbors FROM freq f LEFT JOIN s USING (feature)""",
)
def format_neighbours(spark, d):
    e, _ = B.words_graph(spark, d)
    ids = B.words_frequency(spark, d).select("feature")
    return D.format_neighbours(D.neighbours(e, ids, 4), None)


EGO_SQL = """target AS (SELECT id FROM nodes ORDER BY frequency DESC, id LIMIT 1),
ego_nodes AS (SELECT id FROM target UNION SELECT nbr FROM sym WHERE id = (SELECT id FROM target))"""


def _ego(spark, d):
    e, n = B.words_graph(spark, d)
    t = n.orderBy(F.col("frequency").desc(), F.col("id")).first()["id"]
    return t, D.ego_graph(e, t, 1)


@q(
    "ego_graph",
    f"""{WORDS_GRAPH}, {EGO_SQL}
    SELECT src, dst, weight FROM edges WHERE src IN (SELECT id FROM ego_nodes) AND dst IN (SELECT id FROM ego_nodes)""",
)
def ego_graph(spark, d):
    _, (nodes, edges) = _ego(spark, d)
    return edges


@q(
    "ego_node_style",
    f"""{WORDS_GRAPH}, {EGO_SQL}, w AS (SELECT nbr AS id, weight FROM sym WHERE id = (SELECT id FROM target))
    SELECT id, false AS is_target, (1000 + trunc(weight * 5000))::INT AS size, '#1f77b4' AS color, id AS display FROM w
    UNION ALL SELECT id, true, 3000, '#ff7f0e', (SELECT id FROM target) || '\\n(' || id || ')' FROM target""",
)
def ego_node_style(spark, d):
    t, (nodes, edges) = _ego(spark, d)
    return D.ego_node_style(nodes, t)


# ================================================================== communities
PART_SQL = "part_c AS (SELECT id, substr(id, 1, 1) AS community FROM nodes)"
MOD_SQL = """deg AS (SELECT id, sum(weight) AS k FROM sym GROUP BY id),
m AS (SELECT sum(weight) AS m FROM edges),
intra AS (SELECT coalesce(sum(e.weight), 0) AS l FROM edges e JOIN part_c a ON a.id = e.src JOIN part_c b ON b.id = e.dst WHERE a.community = b.community),
dc AS (SELECT community, sum(k) AS dsum FROM deg JOIN part_c USING (id) GROUP BY community),
qv AS (SELECT (SELECT l FROM intra) / (SELECT m FROM m) - sum((dsum / (2 * (SELECT m FROM m))) * (dsum / (2 * (SELECT m FROM m)))) AS q FROM dc)"""


@q("modularity", f"{WORDS_GRAPH}, {PART_SQL}, {MOD_SQL} SELECT round(q, 9) AS modularity FROM qv")
def modularity(spark, d):
    e, n = B.words_graph(spark, d)
    return CM.modularity(e, B.first_letter_partition(n)).select(r9(F.col("modularity")).alias("modularity"))


@q("community_sizes", f"{WORDS_GRAPH}, {PART_SQL} SELECT community, count(*) AS size FROM part_c GROUP BY community")
def community_sizes(spark, d):
    _, n = B.words_graph(spark, d)
    return CM.community_sizes(B.first_letter_partition(n))


@q(
    "top_communities",
    f"{WORDS_GRAPH}, {PART_SQL} SELECT community, count(*) AS size FROM part_c GROUP BY community ORDER BY size DESC, community LIMIT 5",
)
def top_communities(spark, d):
    _, n = B.words_graph(spark, d)
    return CM.top_communities(B.first_letter_partition(n), 5)


@q(
    "central_nodes",
    f"""{WORDS_GRAPH}, {PART_SQL},
    top AS (SELECT community FROM part_c GROUP BY community ORDER BY count(*) DESC, community LIMIT 5),
    ie AS (SELECT e.src, e.dst, e.weight, a.community FROM edges e JOIN part_c a ON a.id = e.src JOIN part_c b ON b.id = e.dst
           WHERE a.community = b.community AND a.community IN (SELECT community FROM top)),
    wd AS (SELECT community, id, sum(weight) AS wdeg FROM (
           SELECT community, src AS id, weight FROM ie UNION ALL SELECT community, dst, weight FROM ie) GROUP BY community, id),
    rk AS (SELECT community, id, round(wdeg, 9) AS weighted_degree,
           row_number() OVER (PARTITION BY community ORDER BY round(wdeg, 9) DESC, id) AS rank FROM wd)
    SELECT community, id, weighted_degree, rank::INT AS rank FROM rk WHERE rank <= 5""",
)
def central_nodes(spark, d):
    e, n = B.words_graph(spark, d)
    comm = B.first_letter_partition(n)
    return CM.central_nodes(e, comm, 5, 5, places=9)


@q(
    "intra_community_edges",
    f"""{WORDS_GRAPH}, {PART_SQL}
    SELECT e.src, e.dst, e.weight, a.community FROM edges e JOIN part_c a ON a.id = e.src JOIN part_c b ON b.id = e.dst
    WHERE a.community = b.community""",
)
def intra_community_edges(spark, d):
    e, n = B.words_graph(spark, d)
    return CM.intra_community_edges(e, B.first_letter_partition(n))


@q(
    "louvain_round",
    f"""{WORDS_GRAPH}, deg AS (SELECT id, sum(weight) AS k FROM sym GROUP BY id),
    m AS (SELECT sum(weight) AS m FROM edges),
    mv AS (SELECT s.id, s.nbr AS c, round(s.weight - dv.k * dc.k / (2 * (SELECT m FROM m)), 9) AS gain
             FROM sym s JOIN deg dv ON dv.id = s.id JOIN deg dc ON dc.id = s.nbr),
    best AS (SELECT id, c, gain, row_number() OVER (PARTITION BY id ORDER BY gain DESC, c) AS rn FROM mv)
    SELECT d.id, CASE WHEN b.gain > 1e-12 THEN b.c ELSE d.id END AS community
    FROM deg d LEFT JOIN best b ON b.id = d.id AND b.rn = 1""",
)
def louvain_round(spark, d):
    e, _ = B.words_graph(spark, d)
    return CM.louvain_round(e)


@q("louvain")
def louvain(spark, d):
    return B.words_communities(spark, d).communities


@q(
    "louvain_cliques",
    """SELECT id, min(id) OVER w AS community FROM (SELECT DISTINCT l_orderkey, l_orderkey * 8 + l_linenumber AS id FROM lineitem)
    WINDOW w AS (PARTITION BY l_orderkey) QUALIFY count(*) OVER w > 1""",
)
def louvain_cliques(spark, d):
    """G1 on a graph whose best partition is known: the line numbers of an order (at most 7) form a clique, so orders are
    the communities."""
    line = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id")).distinct()
    other = line.withColumnRenamed("id", "dst")
    edges = line.withColumnRenamed("id", "src").join(other, "l_orderkey").where("src < dst").select("src", "dst", F.lit(1.0).alias("weight"))
    found = CM.louvain(edges, threshold=0.0).communities  # to the last move: every clique counts
    name = found.groupBy("community").agg(F.min("id").alias("name"))
    return found.join(name, "community").select("id", F.col("name").alias("community"))


@q("analyze_graph")
def analyze_graph(spark, d):
    e, n = B.words_graph(spark, d)
    return CM.analyze_graph(e, "words", n, found=B.words_communities(spark, d))


@q("analyze_graph_brands")
def analyze_graph_brands(spark, d):
    # empty at the reference thresholds on larger scales: exercises the all-zero row
    e, n = B.brands_graph(spark, d)
    return CM.analyze_graph(e, "brands", n)


BRAND_PART_SQL = "part_c AS (SELECT id, substr(id, 7, 1) AS community FROM nodes)"


def _stats_sql(graph_sql: str, part_sql: str, label: str) -> str:
    return f"""{graph_sql}, {part_sql}, {MOD_SQL}
    SELECT '{label}' AS graph, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges,
      2::DOUBLE * (SELECT count(*) FROM edges) / ((SELECT count(*) FROM nodes)::DOUBLE * ((SELECT count(*) FROM nodes) - 1)::DOUBLE) AS density,
      (SELECT q FROM qv) AS modularity, (SELECT count(DISTINCT community) FROM part_c) AS num_communities"""


def _stats(spark, d) -> DataFrame:
    rows = []
    for label, (e, n), part in (
        ("anchor", B.corpus_graph(spark, d, "anchor"), B.first_letter_partition),
        ("other", B.corpus_graph(spark, d, "other"), B.first_letter_partition),
    ):
        c = G.graph_counts(e, n).first()
        comm = part(n)
        qv = CM.modularity_value(e, comm)
        rows.append((label, c["nodes"], c["edges"], c["density"], qv, comm.select("community").distinct().count()))
    schema = "graph string, nodes bigint, edges bigint, density double, modularity double, num_communities bigint"
    return spark.createDataFrame(rows, schema)


STATS_SQL = f"""stats AS (
  SELECT * FROM ({_stats_sql(ANCHOR_GRAPH, PART_SQL, 'anchor')})
  UNION ALL SELECT * FROM ({_stats_sql(OTHER_GRAPH, PART_SQL, 'other')}))"""


@q(
    "compare_graphs",
    f"""WITH {STATS_SQL}, long AS (
      SELECT 0 AS ord, 'nodes' AS metric, graph, nodes::VARCHAR AS v FROM stats
      UNION ALL SELECT 1, 'edges', graph, edges::VARCHAR FROM stats
      UNION ALL SELECT 2, 'density', graph, printf('%.5f', density) FROM stats
      UNION ALL SELECT 3, 'modularity', graph, printf('%.5f', modularity) FROM stats
      UNION ALL SELECT 4, 'num_communities', graph, num_communities::VARCHAR FROM stats)
    SELECT metric, max(CASE WHEN graph = 'anchor' THEN v END) AS anchor, max(CASE WHEN graph = 'other' THEN v END) AS other
    FROM long GROUP BY ord, metric""",
)
def compare_graphs(spark, d):
    return CM.compare_graphs(_stats(spark, d), "anchor", "other")


@q(
    "polarization_verdict",
    f"""WITH {STATS_SQL}, dq AS (
      SELECT max(CASE WHEN graph = 'other' THEN modularity END) - max(CASE WHEN graph = 'anchor' THEN modularity END) AS delta_q FROM stats)
    SELECT round(delta_q, 9) AS delta_q, CASE WHEN delta_q > 0.05 THEN '{CM.VERDICT_POLARIZED}'
      WHEN delta_q < -0.05 THEN '{CM.VERDICT_INTEGRATED}' ELSE '{CM.VERDICT_NONE}' END AS verdict FROM dq""",
)
def polarization_verdict(spark, d):
    v = CM.polarization_verdict(_stats(spark, d), "anchor", "other")
    return v.select(r9(F.col("delta_q")).alias("delta_q"), "verdict")


# ================================================================== dictionary features
@q("encode_features", f"WITH {DICT_SQL} SELECT vec_id, feature::INT AS feature, round(act, 9) AS act FROM acts WHERE act > 0")
def encode_features(spark, d):
    return B.dict_acts(spark, d).select("vec_id", "feature", r9(F.col("act")).alias("act"))


@q("encode_features_blocks", ORACLE["encode_features"])
def encode_features_blocks(spark, d):
    """P5 with a dictionary that is broadcast block by block."""
    acts = D.encode_features(B.embeddings(spark, d), B.blocked_dictionary(spark, d), "vec_id", "vector", threshold=0.0)
    return acts.select("vec_id", "feature", r9(F.col("act")).alias("act"))


@q(
    "active_features",
    f"""WITH {DICT_SQL}, s AS (SELECT vec_id, list_sort(list(feature::INT)) AS features FROM acts WHERE act > {B.DICT_THRESHOLD} GROUP BY vec_id)
    SELECT e.vec_id, coalesce(s.features, []::INT[]) AS features FROM embeddings e LEFT JOIN s USING (vec_id)""",
)
def active_features(spark, d):
    return B.dict_contexts(spark, d)


@q(
    "build_graph_dictionary",
    "WITH "
    + phi_sql(
        f"{DICT_SQL}, ctx AS (SELECT vec_id, feature::INT AS feature FROM acts WHERE act > {B.DICT_THRESHOLD})",
        ["vec_id"],
        "SELECT count(*) FROM embeddings",
        1,
        B.PHI,
    )
    + " SELECT src, dst, weight FROM edges",
)
def build_graph_dictionary(spark, d):
    ctx = B.dict_contexts(spark, d).withColumnRenamed("vec_id", "ctx")
    return G.build_graph(ctx, 1, B.PHI)[0]


LABEL_SQL = """logits AS (
  SELECT w.feature::INT AS feature, 'tok' || d.vec_id AS token, sum(w.w * d.v) AS logit
  FROM wenc w JOIN dims d USING (k) GROUP BY 1, 2),
lab AS (SELECT feature, token, logit, row_number() OVER (PARTITION BY feature ORDER BY logit DESC, token) AS rank FROM logits)"""


@q("label_features", f"WITH {DICT_SQL}, {LABEL_SQL} SELECT feature, token, round(logit, 9) AS logit, rank::INT AS rank FROM lab WHERE rank <= 5")
def label_features(spark, d):
    lab = D.label_features(B.dictionary(spark, d), B.unembed(spark, d), 5)
    return lab.select("feature", "token", r9(F.col("logit")).alias("logit"), "rank")


@q("label_features_blocks", ORACLE["label_features"])
def label_features_blocks(spark, d):
    """J7 with a dictionary that is broadcast block by block."""
    lab = D.label_features(B.blocked_dictionary(spark, d), B.unembed(spark, d), 5)
    return lab.select("feature", "token", r9(F.col("logit")).alias("logit"), "rank")


TOKVEC_SQL = f"""toks AS (
  SELECT conv_id, turn, unnest(ws) AS token, unnest(generate_series(0, len(ws) - 1))::INT AS pos
  FROM (SELECT conv_id, turn, {WORDS} AS ws FROM conversations)),
tv AS (
  SELECT t.*, ('0x' || substr(md5(t.token), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings) AS vec_id FROM toks t),
loc AS (
  SELECT conv_id, turn, coalesce(min(CASE WHEN contains(token, '{B.PROBE_TARGET}') THEN pos END), max(pos)) AS target_pos
  FROM toks GROUP BY conv_id, turn)"""


@q("locate_target", f"WITH {TOKVEC_SQL} SELECT conv_id, turn, target_pos FROM loc")
def locate_target(spark, d):
    return D.locate_target(B.conversation_tokens(spark, d), B.PROBE_TARGET, ["conv_id", "turn"])


@q(
    "last_token_vector",
    f"""WITH {TOKVEC_SQL}, last AS (SELECT conv_id, turn, max(pos) AS p FROM toks GROUP BY conv_id, turn)
    SELECT tv.conv_id, tv.turn, e.embedding::DOUBLE[] AS vector FROM tv JOIN last ON tv.conv_id = last.conv_id AND tv.turn = last.turn AND tv.pos = last.p
    JOIN embeddings e USING (vec_id)""",
)
def last_token_vector(spark, d):
    tokens, vectors = B.token_vectors(spark, d)
    return D.last_token_vector(tokens, ["conv_id", "turn"], vectors=vectors)


@q(
    "probe_top_features",
    f"""WITH {TOKVEC_SQL}, {DICT_SQL}, atk AS (
      SELECT tv.conv_id, tv.turn, tv.vec_id FROM tv JOIN loc ON tv.conv_id = loc.conv_id AND tv.turn = loc.turn AND tv.pos = loc.target_pos),
    pa AS (SELECT atk.conv_id, atk.turn, a.feature::INT AS feature, a.act FROM atk JOIN acts a USING (vec_id)),
    rk AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY act DESC, feature) AS rank FROM pa)
    SELECT conv_id, turn, feature, round(act, 9) AS act, rank::INT AS rank FROM rk WHERE rank <= 3""",
)
def probe_top_features(spark, d):
    tokens, vectors = B.token_vectors(spark, d)
    p = D.probe_top_features(tokens, B.dictionary(spark, d), B.PROBE_TARGET, 3, ["conv_id", "turn"], vectors=vectors)
    return p.select("conv_id", "turn", "feature", r9(F.col("act")).alias("act"), "rank")


@q(
    "top_k_per_group",
    """SELECT l_orderkey, l_linenumber, l_extendedprice, rank::INT AS rank FROM (
      SELECT l_orderkey, l_linenumber, l_extendedprice,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem) WHERE rank <= 2""",
)
def top_k_per_group_q(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return top_k_per_group(li, "l_orderkey", "l_extendedprice", 2, tie="l_linenumber")


# ================================================================== contrast
PAIR_SQL = """pl AS (
  SELECT (vec_id // 2)::VARCHAR AS topic, CASE WHEN vec_id % 2 = 0 THEN 'base' ELSE 'contrast' END AS side, embedding::DOUBLE[] AS vector FROM embeddings),
pr AS (
  SELECT topic, max(CASE WHEN side = 'base' THEN vector END) AS base, max(CASE WHEN side = 'contrast' THEN vector END) AS contrast
  FROM pl GROUP BY topic HAVING count(DISTINCT side) = 2)"""


@q("pair_sides", f"WITH {PAIR_SQL} SELECT topic, base, contrast FROM pr")
def pair_sides(spark, d):
    return B.pairs(spark, d)


@q("delta_vectors", f"WITH {PAIR_SQL} SELECT topic, list_transform(list_zip(contrast, base), lambda z: z[1] - z[2]) AS delta FROM pr")
def delta_vectors(spark, d):
    return X.delta_vectors(B.pairs(spark, d)).select("topic", "delta")


@q(
    "signed_diffs",
    f"""WITH {PAIR_SQL}
    SELECT topic, list_transform(list_zip(contrast, base), lambda z: z[1] - z[2]) AS x, 1 AS label FROM pr
    UNION ALL SELECT topic, list_transform(list_zip(base, contrast), lambda z: z[1] - z[2]), 0 FROM pr""",
)
def signed_diffs(spark, d):
    return K.signed_diffs(B.pairs(spark, d))


SHIFT_SQL = f"""side_acts AS (
  SELECT (a.vec_id // 2)::VARCHAR AS topic, CASE WHEN a.vec_id % 2 = 0 THEN 'base' ELSE 'contrast' END AS side, a.feature::INT AS feature, a.act
  FROM acts a WHERE a.act > 0),
sh AS (
  SELECT c.topic, c.feature, c.act - coalesce(b.act, 0) AS activation_increase
  FROM (SELECT * FROM side_acts WHERE side = 'contrast') c
  LEFT JOIN (SELECT * FROM side_acts WHERE side = 'base') b ON b.topic = c.topic AND b.feature = c.feature
  WHERE c.topic IN (SELECT topic FROM pr)),
shr AS (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY activation_increase DESC, feature) AS rank
  FROM sh WHERE activation_increase > {X.SHIFT_MIN})"""


def _shifts(spark, d):
    acts = B.dict_acts(spark, d)
    tagged = acts.select(
        F.floor(F.col("vec_id") / 2).cast("string").alias("topic"),
        F.when(F.col("vec_id") % 2 == 0, F.lit("base")).otherwise(F.lit("contrast")).alias("side"),
        "feature",
        "act",
    )
    topics = B.pairs(spark, d).select("topic")
    base = tagged.filter(F.col("side") == "base").join(topics, "topic", "left_semi")
    contrast = tagged.filter(F.col("side") == "contrast").join(topics, "topic", "left_semi")
    return X.feature_shift(base, contrast, X.SHIFT_TOP_K, X.SHIFT_MIN)


@q(
    "feature_shift",
    f"""WITH {PAIR_SQL}, {DICT_SQL}, {SHIFT_SQL}
    SELECT topic, feature, round(activation_increase, 9) AS activation_increase, rank::INT AS rank FROM shr WHERE rank <= {X.SHIFT_TOP_K}""",
)
def feature_shift(spark, d):
    return _shifts(spark, d).select("topic", "feature", r9(F.col("activation_increase")).alias("activation_increase"), "rank")


@q(
    "format_shift",
    f"""WITH {PAIR_SQL}, {DICT_SQL}, {SHIFT_SQL}, {LABEL_SQL}
    SELECT s.topic, string_agg(printf('%s(%.1f)', l.token, s.activation_increase), ', ' ORDER BY s.rank) AS shifts
    FROM shr s JOIN lab l ON l.feature = s.feature AND l.rank = 1 WHERE s.rank <= {X.SHIFT_TOP_K} GROUP BY s.topic""",
)
def format_shift(spark, d):
    labels = D.label_features(B.dictionary(spark, d), B.unembed(spark, d), 1).select("feature", "token")
    return X.format_shift(_shifts(spark, d), labels)


LABEL_TOPIC_SQL = """lt_dims AS (
  SELECT label::VARCHAR AS topic, CASE WHEN vec_id % 2 = 0 THEN 'base' ELSE 'contrast' END AS side,
    unnest(embedding)::DOUBLE AS v, unnest(generate_series(0, len(embedding) - 1)) AS k FROM embeddings),
lt_mean AS (SELECT topic, side, k, avg(v) AS m FROM lt_dims GROUP BY topic, side, k),
lt_delta AS (
  SELECT c.topic, c.k, c.m - b.m AS dv FROM lt_mean c JOIN lt_mean b ON b.topic = c.topic AND b.k = c.k AND b.side = 'base'
  WHERE c.side = 'contrast'),
lt_norm AS (SELECT topic, sqrt(sum(dv * dv)) AS nrm FROM lt_delta GROUP BY topic),
lt_cos AS (
  SELECT a.topic AS topic1, b.topic AS topic2,
    CASE WHEN na.nrm = 0 OR nb.nrm = 0 THEN NULL ELSE sum(a.dv * b.dv) / (na.nrm * nb.nrm) END AS cosine_similarity
  FROM lt_delta a JOIN lt_delta b ON a.k = b.k AND a.topic::INT < b.topic::INT
  JOIN lt_norm na ON na.topic = a.topic JOIN lt_norm nb ON nb.topic = b.topic
  GROUP BY a.topic, b.topic, na.nrm, nb.nrm)"""

def _label_deltas(spark, d):
    return X.delta_vectors(B.label_topic_pairs(spark, d))


@q("pairwise_cosine", f"WITH {LABEL_TOPIC_SQL} SELECT topic1, topic2, round(cosine_similarity, 9) AS cosine_similarity FROM lt_cos")
def pairwise_cosine(spark, d):
    c = X.pairwise_cosine(_label_deltas(spark, d))
    return c.select("topic1", "topic2", r9(F.col("cosine_similarity")).alias("cosine_similarity"))


def _label_topics(spark, d) -> list[str]:
    return [str(r[0]) for r in table(spark, d, "embeddings").select("label").distinct().orderBy("label").collect()]


SQUARE_COLS = ", ".join(f"max(CASE WHEN c = '{t}' THEN round(v, 9) END) AS \"{t}\"" for t in range(10))


@q(
    "square_similarity",
    f"""WITH {LABEL_TOPIC_SQL}, lng AS (
      SELECT topic1 AS r, topic2 AS c, cosine_similarity AS v FROM lt_cos
      UNION ALL SELECT topic2, topic1, cosine_similarity FROM lt_cos
      UNION ALL SELECT DISTINCT topic, topic, 1.0::DOUBLE FROM lt_delta)
    SELECT r AS topic, {SQUARE_COLS} FROM lng GROUP BY r""",
)
def square_similarity(spark, d):
    topics = _label_topics(spark, d)
    c = X.pairwise_cosine(_label_deltas(spark, d))
    sq = X.square_similarity(c, topics)
    return sq.select("topic", *[r9(F.col(f"`{t}`")).alias(t) for t in topics])


@q(
    "interleave_sides",
    f"""WITH {PAIR_SQL}
    SELECT topic, 0 AS side_ord, 'Base' AS type, topic || ' (Base)' AS label FROM pr
    UNION ALL SELECT topic, 1, 'Contrast', topic || ' (Contrast)' FROM pr""",
)
def interleave_sides(spark, d):
    return X.interleave_sides(B.pairs(spark, d), "Base", "Contrast").select("topic", "side_ord", "type", "label")


@q(
    "resolve_sides",
    f"""WITH {TOPICS_SQL}
    SELECT a.topic, a.text AS base, u.text AS contrast FROM topic_sides a JOIN topic_sides u ON a.topic = u.topic
    WHERE a.side = 'assistant' AND u.side = 'user'""",
)
def resolve_sides(spark, d):
    long = io.read_contrast_topics(_conversation_topics(spark, d))
    sides = X.resolve_sides(X.first_topic_sides(long))
    return X.pair_sides(long, sides["base"], sides["contrast"], value="text")


@q("pca")
def pca_q(spark, d):
    scored, _ = X.pca(B.embeddings(spark, d), 2, "vector")
    return scored.select("vec_id", "pc1", "pc2")


@q("pca_deltas")
def pca_deltas(spark, d):
    return X.pca_deltas(X.delta_vectors(B.pairs(spark, d)))[0]


@q("trajectory_table")
def trajectory_table(spark, d):
    return X.trajectory_table(B.pairs(spark, d), "Base", "Contrast")[0]


@q("pca_stats")
def pca_stats(spark, d):
    _, ratios = X.trajectory_table(B.pairs(spark, d), "Base", "Contrast")
    return X.pca_stats(ratios, spark)


# ================================================================== classifier
SPLIT_TOPICS_SQL = f"""{PAIR_SQL}, tp AS (
  SELECT topic, row_number() OVER (ORDER BY md5(topic || '|42'), topic) - 1 AS i, count(*) OVER () AS n FROM pr),
ts AS (SELECT topic, CASE WHEN i < n // 2 THEN 'train' ELSE 'test' END AS split FROM tp)"""


@q("topic_group_split", f"WITH {SPLIT_TOPICS_SQL} SELECT topic, split FROM ts")
def topic_group_split(spark, d):
    return K.topic_group_split(K.signed_diffs(B.pairs(spark, d)))


@q(
    "split_mask",
    f"""WITH {SPLIT_TOPICS_SQL}, rows AS (SELECT topic, 1 AS label FROM pr UNION ALL SELECT topic, 0 FROM pr)
    SELECT r.topic, r.label, ts.split FROM rows r JOIN ts USING (topic)""",
)
def split_mask(spark, d):
    rows = K.signed_diffs(B.pairs(spark, d))
    tr, te = K.split_mask(rows, K.topic_group_split(rows))
    return tr.select("topic", "label", F.lit("train").alias("split")).unionByName(te.select("topic", "label", F.lit("test").alias("split")))


@q(
    "label_balance",
    f"""WITH {SPLIT_TOPICS_SQL}, rows AS (SELECT topic, 1 AS label FROM pr UNION ALL SELECT topic, 0 FROM pr)
    SELECT 'all' AS split, label, count(*) AS n FROM rows GROUP BY label
    UNION ALL SELECT ts.split, label, count(*) FROM rows JOIN ts USING (topic) GROUP BY ts.split, label""",
)
def label_balance(spark, d):
    rows = K.signed_diffs(B.pairs(spark, d))
    return K.label_balance(rows, K.topic_group_split(rows))


@q(
    "standardize",
    f"""WITH {SPLIT_TOPICS_SQL},
    rows AS (
      SELECT topic, 1 AS label, list_transform(list_zip(contrast, base), lambda z: z[1] - z[2]) AS x FROM pr
      UNION ALL SELECT topic, 0, list_transform(list_zip(base, contrast), lambda z: z[1] - z[2]) FROM pr),
    el AS (SELECT r.topic, r.label, ts.split, unnest(r.x) AS v, unnest(generate_series(0, len(r.x) - 1)) AS k FROM rows r JOIN ts USING (topic)),
    st AS (SELECT k, avg(v) AS mu, stddev_pop(v) AS sd FROM el WHERE split = 'train' GROUP BY k)
    SELECT topic, label, k::INT AS dim, round((v - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 6) AS z FROM el JOIN st USING (k)""",
)
def standardize(spark, d):
    rows = K.signed_diffs(B.pairs(spark, d))
    split = K.topic_group_split(rows)
    tr, te = K.split_mask(rows, split)
    mu, sd = K.fit_standardizer(tr)
    z = K.apply_standardizer(rows, mu, sd)
    return z.select("topic", "label", F.posexplode("z").alias("dim", "z")).select("topic", "label", "dim", F.round("z", 6).alias("z"))


def _models(spark, d):
    rows = K.signed_diffs(B.pairs(spark, d))
    tr, te = K.split_mask(rows, K.topic_group_split(rows))
    tr, te = K.standardize(tr, te)
    return tr, te


@q("svm_linear")
def svm_linear(spark, d):
    tr, te = _models(spark, d)
    return K.predictions_table(K.svm_linear(tr, te)[1])


@q("svm_rbf")
def svm_rbf(spark, d):
    tr, te = _models(spark, d)
    return K.predictions_table(K.svm_rbf(tr, te)[1])


@q("svm_poly")
def svm_poly(spark, d):
    tr, te = _models(spark, d)
    return K.predictions_table(K.svm_poly(tr, te)[1])


@q("compare_models")
def compare_models(spark, d):
    tr, te = _models(spark, d)
    return K.compare_models(tr, te)[0]


@q("best_model")
def best_model(spark, d):
    tr, te = _models(spark, d)
    return K.best_model(K.compare_models(tr, te)[0])


# Evaluation operators on a labelled table: true = labels.quality, predicted = labels.toxic,
# per-topic = documents.source (a given predictions table, as the operators expect).
def _given_predictions(spark, d):
    lab = table(spark, d, "labels")
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    return lab.join(docs, "doc_id").select("doc_id", "source", "lang", F.col("quality").alias("label"), F.col("toxic").alias("pred"))


PRED_SQL = """pred AS (SELECT l.doc_id, d.source, d.lang, l.quality AS label, l.toxic AS pred FROM labels l JOIN documents d USING (doc_id))"""


@q("accuracy", f"WITH {PRED_SQL} SELECT lang, round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM pred GROUP BY lang")
def accuracy(spark, d):
    return K.accuracy(_given_predictions(spark, d), ["lang"]).select("lang", r9(F.col("accuracy")).alias("accuracy"))


@q(
    "confusion_matrix",
    f"""WITH {PRED_SQL} SELECT label AS true_label, sum(CASE WHEN pred = 0 THEN 1 ELSE 0 END)::BIGINT AS pred_0,
    sum(CASE WHEN pred = 1 THEN 1 ELSE 0 END)::BIGINT AS pred_1 FROM pred GROUP BY label""",
)
def confusion_matrix(spark, d):
    return K.confusion_matrix(_given_predictions(spark, d))


@q(
    "classification_report",
    f"""WITH {PRED_SQL}, c AS (
      SELECT cls, name, sum(CASE WHEN label = cls AND pred = cls THEN 1.0 ELSE 0.0 END) AS tp,
        sum(CASE WHEN pred = cls THEN 1.0 ELSE 0.0 END) AS pp, sum(CASE WHEN label = cls THEN 1.0 ELSE 0.0 END) AS support
      FROM pred, (VALUES (0, 'Left'), (1, 'Right')) v(cls, name) GROUP BY cls, name),
    m AS (SELECT name, cls, CASE WHEN pp > 0 THEN tp / pp ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, support, tp FROM c),
    m2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM m),
    allr AS (
      SELECT name AS class, cls AS ord, precision, recall, f1, support FROM m2
      UNION ALL SELECT 'accuracy', 2, sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM m2
      UNION ALL SELECT 'macro avg', 3, avg(precision), avg(recall), avg(f1), sum(support) FROM m2
      UNION ALL SELECT 'weighted avg', 4, sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM m2)
    SELECT class, ord, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM allr""",
)
def classification_report(spark, d):
    r = K.classification_report(_given_predictions(spark, d))
    return r.select("class", "ord", *[r9(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


@q(
    "per_topic_accuracy",
    f"WITH {PRED_SQL} SELECT source, round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM pred GROUP BY source",
)
def per_topic_accuracy(spark, d):
    return K.per_topic_accuracy(_given_predictions(spark, d), "source").select("source", r9(F.col("accuracy")).alias("accuracy"))


@q(
    "prediction_labels",
    f"""WITH {PRED_SQL} SELECT source AS topic, CASE WHEN label = 1 THEN 'Right' ELSE 'Left' END AS true_label,
    CASE WHEN pred = 1 THEN 'Right' ELSE 'Left' END AS predicted_label, label = pred AS correct FROM pred""",
)
def prediction_labels(spark, d):
    return K.predictions_table(_given_predictions(spark, d), "source").withColumnRenamed("source", "topic")


@q(
    "accuracy_bucket",
    f"""WITH {PRED_SQL}, a AS (SELECT source, avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END) AS accuracy FROM pred GROUP BY source)
    SELECT source, round(accuracy, 9) AS accuracy, CASE WHEN accuracy = 1.0 THEN 'green' WHEN accuracy >= 0.5 THEN 'orange' ELSE 'red' END AS color FROM a""",
)
def accuracy_bucket(spark, d):
    a = K.accuracy(_given_predictions(spark, d), ["source"])
    return a.select("source", r9(F.col("accuracy")).alias("accuracy"), K.accuracy_bucket().alias("color"))
