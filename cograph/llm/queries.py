"""Registered queries of the subpackage: each applies one operator, with production parameters, to its whole table.

``ORACLE`` holds DuckDB SQL where SQL can say the same; the others are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontamination, exact, extraction, language, lattice, mixing, packing, pu_quality, quotes, runs, token_groups, url_lists
from .common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
YEAR_START, YEAR = 1_704_067_200, 31_536_000


def op1_pfair_mix(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", F.length("text").alias("size"))
    return mixing.mix(docs, size=F.col("size")).select("doc_id", "source", "mix_block", "mix_slot", "mix_offset")


def quoted_messages(spark: SparkSession, d: str) -> DataFrame:
    """``conversations`` as mail: from its third turn on a message quotes the first line of two turns before, and,
    from the fifth on, at the next level, the first line of four turns before."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    first = c.select("conv_id", "turn", F.regexp_extract("text", r"^([^\n]*)", 1).alias("line"))
    one = first.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("line").alias("line1"))
    two = first.select("conv_id", (F.col("turn") + 4).alias("turn"), F.col("line").alias("line2"))
    m = c.join(one, ["conv_id", "turn"], "left").join(two, ["conv_id", "turn"], "left")
    head = F.concat(
        F.when(F.col("line1").isNotNull(), F.concat(F.lit("On that day they wrote:\n> "), "line1", F.lit("\n"))).otherwise(""),
        F.when(F.col("line2").isNotNull(), F.concat(F.lit("> > "), "line2", F.lit("\n"))).otherwise(""),
    )
    return m.select("conv_id", "turn", "role", F.concat(head, "text").alias("text"))


def op2_quote_links(spark: SparkSession, d: str) -> DataFrame:
    linked = quotes.link_quotes(quoted_messages(spark, d))
    return linked.select("conv_id", "turn", "parent_turn", "thread_turn", "depth", "formatted")


def op3_kneser_ney(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    return language.identify(docs).select("doc_id", "held_out", "lang_pred", "score", "rejected", "cross_entropy")


def op4_minimum_cut(spark: SparkSession, d: str) -> DataFrame:
    return extraction.extract(table(spark, d, "pages")).select("page_id", "url", "text", "n_chars")


def _word(text, at: int):
    """Number from the 32 bits of the text's md5 that start at hex digit ``at``."""
    return F.conv(F.substring(F.md5(text), at, 8), 16, 10).cast("long")


def url_captures(spark: SparkSession, d: str) -> DataFrame:
    """``pages`` with a fetch time (seconds) in one year, set by a hash of the page id."""
    return table(spark, d, "pages").select("page_id", "url", (F.lit(YEAR_START) + _word(F.col("page_id").cast("string"), 1) % YEAR).alias("fetched_at"))


def url_entries(captures: DataFrame) -> DataFrame:
    """Dated entries on the hosts and first paths of the captures: by a hash, half of the hosts are listed, then
    removed, and some listed again; one path in four is listed."""
    h = captures.select(url_lists.host(F.col("url")).alias("key")).where("key <> ''").distinct()
    day = lambda at: F.lit(YEAR_START) + _word(F.col("key"), at) % YEAR
    listed = h.where(_word(F.col("key"), 1) % 2 == 0)
    add = listed.select(F.lit("domain").alias("kind"), "key", F.lit("add").alias("action"), day(5).alias("dated"))
    gone = listed.select(F.lit("domain"), "key", F.lit("remove"), (day(5) + _word(F.col("key"), 9) % (YEAR // 4)))
    again = listed.where(_word(F.col("key"), 13) % 2 == 0).select(F.lit("domain"), "key", F.lit("add"), (day(5) + YEAR // 4 + _word(F.col("key"), 17) % (YEAR // 4)))
    p = captures.select(F.array_join(F.slice(F.split(url_lists.bare(F.col("url")), "/", -1), 1, 2), "/").alias("key")).where("key LIKE '%/%'").distinct()
    path = p.where(_word(F.col("key"), 1) % 4 == 0).select(F.lit("path"), "key", F.lit("add"), day(5))
    return add.union(gone).union(again).union(path)


def op5_temporal_lists(spark: SparkSession, d: str) -> DataFrame:
    captures = url_captures(spark, d)
    return url_lists.judge(captures, url_entries(captures)).select("page_id", "url", "fetched_at", "blocked", "rule_kind", "rule_key", "rule_since")


def op6_lattice_dedup(spark: SparkSession, d: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, d, "embeddings"))


def op7_extendible_hash(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return exact.mark_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_binary_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents").select("doc_id", "text"), TOKENIZER)


def op9_token_groups(spark: SparkSession, d: str) -> DataFrame:
    return token_groups.jaccard_classes(table(spark, d, "documents").select("doc_id", "text"))


def op10_pu_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = pu_quality.train(docs, table(spark, d, "labels").select("doc_id", "quality"))
    return pu_quality.classify(docs, model).select("doc_id", "held_out", "score", "predicted")


def op11_token_alignment(spark: SparkSession, d: str) -> DataFrame:
    aligned = alignment.align(table(spark, d, "documents").select("doc_id", "text"), TOKENIZER, PIECES)
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")


def op12_decontamination(spark: SparkSession, d: str) -> DataFrame:
    scanned = decontamination.scan(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark"))
    return scanned.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def repeated_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of one document in ten, by crc32 of the id, the words from some word on repeat a stretch of them;
    their words are joined by single spaces."""
    h = F.crc32(F.col("doc_id").cast("string"))
    d = docs.select("doc_id", "text", (h % 10 == 0).alias("chosen"), F.floor(h / 10).alias("g"))
    d = d.withColumn("w", F.when(F.col("chosen"), F.array_remove(F.split("text", r"[\x20\x09-\x0D]+", -1), "")))
    d = d.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    d = d.withColumn("p", (F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)) + 1).cast("int"))
    words = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))))
    return d.select("doc_id", F.when(F.col("n") > 0, F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def op13_period_runs(spark: SparkSession, d: str) -> DataFrame:
    found = runs.find_runs(repeated_texts(table(spark, d, "documents").select("doc_id", "text")))
    line = F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n")))
    top = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), top.alias("top")).select(
        "doc_id", "n_runs", (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
        F.floor(F.col("top.length") * 1000 / -F.col("top.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {f.__name__: f for f in (
    op1_pfair_mix, op2_quote_links, op3_kneser_ney, op4_minimum_cut, op5_temporal_lists,
    op6_lattice_dedup, op7_extendible_hash, op8_binary_packing, op9_token_groups, op10_pu_quality,
    op11_token_alignment, op12_decontamination, op13_period_runs,
)}

_BARE = r"rtrim(regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '\.$', '') || regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/')"
_HOST = r"regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '\.$', '')"
_W = "('0x' || substr(md5({0}), {1}, 8))::BIGINT"

ORACLE = {
    "op2_quote_links": r"""
        WITH RECURSIVE first AS (SELECT conv_id, turn, trim(regexp_replace(regexp_extract(text, '^([^\n]*)', 1), '\s+', ' ', 'g')) AS line FROM conversations),
        said AS (
            SELECT conv_id, line, min(turn) AS turn FROM (
                SELECT conv_id, turn, lower(trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g'))) AS line FROM conversations
                UNION ALL SELECT conv_id, turn, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) FROM conversations) GROUP BY 1, 2),
        hit AS (
            SELECT f.conv_id, f.turn + 2 * l.level AS turn, l.level, s.turn AS parent
            FROM first f CROSS JOIN (VALUES (1), (2)) l(level)
            JOIN conversations c ON c.conv_id = f.conv_id AND c.turn = f.turn + 2 * l.level
            JOIN said s ON s.conv_id = f.conv_id AND s.line = lower(f.line) AND s.turn < f.turn + 2 * l.level
            WHERE f.line <> ''),
        link AS (SELECT conv_id, turn, arg_min(parent, level) AS parent FROM hit GROUP BY 1, 2),
        up AS (
            SELECT conv_id, turn, parent AS root, 1 AS depth FROM link
            UNION ALL SELECT u.conv_id, u.turn, l.parent, u.depth + 1 FROM up u JOIN link l ON l.conv_id = u.conv_id AND l.turn = u.root),
        top AS (SELECT conv_id, turn, max(depth) AS depth, min(root) AS root FROM up GROUP BY 1, 2)
        SELECT c.conv_id, c.turn, l.parent AS parent_turn, coalesce(t.root, c.turn) AS thread_turn, coalesce(t.depth, 0) AS depth,
               '<|' || coalesce(c.role, 'user') || '|>' || chr(10) || c.text || chr(10) || '<|end|>' || chr(10) AS formatted
        FROM conversations c LEFT JOIN link l USING (conv_id, turn) LEFT JOIN top t USING (conv_id, turn)""",
    "op5_temporal_lists": f"""
        WITH cap AS (SELECT page_id, url, {YEAR_START} + {_W.format('page_id::VARCHAR', 1)} % {YEAR} AS fetched_at, {_HOST} AS host, {_BARE} AS bare FROM pages),
        hosts AS (SELECT DISTINCT host AS key FROM cap WHERE host <> ''),
        listed AS (SELECT key, {YEAR_START} + {_W.format('key', 5)} % {YEAR} AS d FROM hosts WHERE {_W.format('key', 1)} % 2 = 0),
        paths AS (SELECT DISTINCT array_to_string(list_slice(string_split(bare, '/'), 1, 2), '/') AS key FROM cap WHERE bare LIKE '%/%'),
        entries AS (
            SELECT 'domain' AS kind, key, 'add' AS action, d AS dated FROM listed
            UNION ALL SELECT 'domain', key, 'remove', d + {_W.format('key', 9)} % {YEAR // 4} FROM listed
            UNION ALL SELECT 'domain', key, 'add', d + {YEAR // 4} + {_W.format('key', 17)} % {YEAR // 4} FROM listed WHERE {_W.format('key', 13)} % 2 = 0
            UNION ALL SELECT 'path', key, 'add', {YEAR_START} + {_W.format('key', 5)} % {YEAR} FROM paths WHERE {_W.format('key', 1)} % 4 = 0),
        one AS (SELECT kind, key, dated, max(action) AS action FROM entries GROUP BY 1, 2, 3),
        turns AS (SELECT * FROM (SELECT *, lag(action) OVER (PARTITION BY kind, key ORDER BY dated) AS was FROM one) WHERE was IS NULL OR was <> action),
        rules AS (SELECT kind, key, dated AS since, until, action FROM (SELECT *, lead(dated) OVER (PARTITION BY kind, key ORDER BY dated) AS until FROM turns) WHERE action = 'add'),
        asked AS (
            SELECT page_id, fetched_at, 'domain' AS kind, array_to_string(list_slice(string_split(host, '.'), i, 1000), '.') AS key
            FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM cap)
            UNION ALL SELECT page_id, fetched_at, 'path', array_to_string(list_slice(string_split(bare, '/'), 1, i), '/')
            FROM (SELECT *, unnest(range(1, len(string_split(bare, '/')) + 1)) AS i FROM cap)),
        best AS (
            SELECT page_id, kind, key, since FROM (
                SELECT a.page_id, r.kind, r.key, r.since, row_number() OVER (PARTITION BY a.page_id ORDER BY CASE r.kind WHEN 'path' THEN 2 ELSE 3 END, -length(r.key), r.key) AS n
                FROM asked a JOIN rules r ON a.kind = r.kind AND a.key = r.key AND a.fetched_at >= r.since AND (r.until IS NULL OR a.fetched_at < r.until)) WHERE n = 1)
        SELECT c.page_id, c.url, c.fetched_at, b.key IS NOT NULL AS blocked, b.kind AS rule_kind, b.key AS rule_key, b.since AS rule_since
        FROM cap c LEFT JOIN best b USING (page_id)""",
    "op6_lattice_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
        edge AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
        low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
        n AS (SELECT a, count(*) AS n FROM edge GROUP BY a)
        SELECT vec_id, coalesce(n.n, 0) AS n_links, low.b AS component_id, vec_id = low.b AS kept
        FROM v JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op7_extendible_hash": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op9_token_groups": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        edge AS (
            SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
            JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.c >= 75 * (na.n + nb.n - p.c)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)
        SELECT a AS doc_id, any_value(coalesce(n.n, 0)) AS n_shingles, min(b) AS component_id FROM reach LEFT JOIN n ON n.doc_id = a GROUP BY a""",
    "op12_decontamination": r"""
        WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
            FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(len(w), 10) AS n FROM bw WHERE len(w) > 0))),
        sizes AS (SELECT DISTINCT n FROM win),
        place AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
            FROM (SELECT dw.*, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw JOIN sizes ON len(w) >= n)),
        hit AS (SELECT p.r, p.i, p.n, x.item_id FROM place p JOIN win x ON x.n = p.n AND x.g = p.g),
        covered AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY 1),
        items AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY 1)
        SELECT dw.doc_id, len(dw.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM dw LEFT JOIN covered USING (r) LEFT JOIN items USING (r)""",
}
