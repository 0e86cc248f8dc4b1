"""The operators as registered queries over the driver's tables, each beside its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions import geometry as G
from gristmill.functions import text as X
from gristmill.operators import audit, curate, grouping, images, metrics, split, validate
from gristmill.operators import html as H
from gristmill.sources.materialize import materialize
from gristmill.sources.readers import keyed_last, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
BUCKET = "(('0x' || substr(md5({k}::varchar), 1, 4))::int % 100)"
SPLIT = f"CASE WHEN {BUCKET} < 70 THEN 'train' WHEN {BUCKET} < 85 THEN 'val' ELSE 'test' END"
EMB = "embedding::double[]"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


def split_sql(key: str) -> str:
    return SPLIT.format(k=key)


# joins -------------------------------------------------------------------------------------------------------------

@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def pair_unlabeled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id, quality FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE l.doc_id = d.doc_id AND d.source <> 'src0')")
def pair_orphan_labels(spark, d):
    docs = table(spark, d, "documents").filter("source <> 'src0'").select("doc_id")  # without one source, so that labels are left over
    return table(spark, d, "labels").select("doc_id", "quality").join(docs, "doc_id", "left_anti")


@query("SELECT d.doc_id, lang, source, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def pair_inner(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def orders_without_lines(spark, d):
    o, line = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "lineitem")
    return o.join(line.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("SELECT d.doc_id, coalesce(quality::varchar, '') AS split FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def split_left_default(spark, d):
    lab = table(spark, d, "labels").select("doc_id", "quality")
    return table(spark, d, "documents").select("doc_id").join(lab, "doc_id", "left").select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("")).alias("split"))


PAIRS = f"""SELECT a.label, a.vec_id AS vec_id_a, b.vec_id AS vec_id_b, list_cosine_similarity(a.e, b.e) AS score
FROM (SELECT label, vec_id, {EMB} AS e FROM embeddings) a JOIN (SELECT label, vec_id, {EMB} AS e FROM embeddings) b ON a.label = b.label AND a.vec_id < b.vec_id"""


def _pairs(spark, d):
    return grouping.block_pairs(table(spark, d, "embeddings"), "label", "vec_id", "embedding")


def _edges(spark, d):
    return grouping.block_pairs(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 0.30)


@query(f"SELECT label, vec_id_a, vec_id_b, round(score, 6) AS score FROM ({PAIRS})")
def block_pairs(spark, d):
    return _pairs(spark, d).withColumn("score", G.rounded(F.col("score")))


@query(f"""WITH p AS ({PAIRS}), q AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 0.9, 1.0])::double AS q)
SELECT q, round((SELECT quantile_cont(score, [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]) FROM p)[CASE q WHEN 0 THEN 1 WHEN 0.25 THEN 2 WHEN 0.5 THEN 3 WHEN 0.75 THEN 4 WHEN 0.9 THEN 5 ELSE 6 END], 6) AS value FROM q""")
def score_quantiles(spark, d):
    return audit.pair_quantiles(table(spark, d, "embeddings"), "label", "vec_id", "embedding")


@query(f"SELECT vec_id_a, vec_id_b, round(score, 6) AS score FROM ({PAIRS}) WHERE score >= 0.30")
def edges_threshold(spark, d):
    return _edges(spark, d).select("vec_id_a", "vec_id_b", G.rounded(F.col("score")).alias("score"))


COMP = f"""WITH RECURSIVE p AS MATERIALIZED (SELECT vec_id_a AS a, vec_id_b AS b FROM ({PAIRS}) WHERE score >= 0.30), s AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(a, b) AS (SELECT a, a FROM s UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a)"""


def _components(spark, d, edges=None):
    e = (edges if edges is not None else _edges(spark, d)).select("vec_id_a", "vec_id_b")
    c = grouping.connected_components(e)
    return (table(spark, d, "embeddings").select("vec_id", "label").join(c, F.col("vec_id") == F.col("node"), "left")
            .select("vec_id", "label", F.coalesce("component", "vec_id").alias("component")))


@query(COMP + " SELECT vec_id, coalesce((SELECT min(b) FROM r WHERE r.a = vec_id), vec_id) AS component FROM embeddings")
def components(spark, d):
    return _components(spark, d).select("vec_id", "component")


@query("SELECT md5(text) AS text_md5, min(doc_id) AS keep_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark, d):
    g = table(spark, d, "documents").filter("text IS NOT NULL").groupBy(F.md5(F.col("text").cast("binary")).alias("text_md5"))
    return g.agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("copies")).filter("copies > 1")


@query(f"""WITH g AS (SELECT o_custkey, count(DISTINCT {split_sql('o_orderkey')}) AS k, count(*) AS n FROM orders GROUP BY 1)
SELECT count(*) AS source_group_count, sum(CASE WHEN k > 1 THEN 1 ELSE 0 END)::bigint AS cross_split_source_groups, sum(CASE WHEN k > 1 THEN n ELSE 0 END)::bigint AS cross_split_images, sum(n)::bigint AS image_count,
round(sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) / count(*), 6) AS group_rate, round(sum(CASE WHEN k > 1 THEN n ELSE 0 END) / sum(n), 6) AS image_rate FROM g""")
def leakage_profile(spark, d):
    return audit.leakage_profile(table(spark, d, "orders").select("o_custkey", X.split_of(F.col("o_orderkey")).alias("split")), "o_custkey", "split")


@query("""WITH dims AS (SELECT DISTINCT source, c AS class FROM documents, (VALUES ('quality_0'), ('quality_1'), ('toxic_0'), ('toxic_1')) v(c)),
r AS (SELECT d.doc_id, source, unnest(['quality_' || quality, 'toxic_' || toxic]) AS class FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT dims.source, dims.class, count(r.doc_id) AS instance_count, count(DISTINCT r.doc_id) AS image_count FROM dims LEFT JOIN r ON r.source = dims.source AND r.class = dims.class GROUP BY 1, 2""")
def class_count_grid(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    rows = docs.join(table(spark, d, "labels"), "doc_id").select("doc_id", "source", F.explode(F.array(F.concat(F.lit("quality_"), "quality"), F.concat(F.lit("toxic_"), "toxic"))).alias("class"))
    dims = docs.select("source").distinct().withColumn("class", F.explode(F.array(*[F.lit(x) for x in ("quality_0", "quality_1", "toxic_0", "toxic_1")])))
    return audit.class_grid(dims, rows, ["source", "class"], "doc_id")


@query(f"SELECT {split_sql('l_orderkey')} AS split, l_returnflag AS class, count(DISTINCT l_orderkey) AS groups FROM lineitem GROUP BY 1, 2")
def class_presence(spark, d):
    p = split.class_presence(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag")
    return p.groupBy(X.split_of(F.col("l_orderkey")).alias("split"), F.col("l_returnflag").alias("class")).agg(F.count("*").alias("groups"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def eval_representative(spark, d):
    return split.representatives(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", "l_quantity", "l_linenumber")


@query("""WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS image_id FROM orders)
SELECT image_id, l_linenumber, row_number() OVER (ORDER BY image_id, l_linenumber) AS annotation_id FROM o JOIN lineitem ON o_orderkey = l_orderkey""")
def dense_ids(spark, d):
    o = split.dense_ids(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], "image_id")
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return split.dense_ids(o.join(line, "o_orderkey").select("image_id", "l_linenumber"), ["image_id", "l_linenumber"], "annotation_id")


@query("""SELECT p_partkey, p_brand || '__visual_' || lpad((dense_rank() OVER (PARTITION BY p_brand ORDER BY f) - 1)::varchar, 2, '0') AS group_key
FROM (SELECT p_partkey, p_brand, min(p_partkey) OVER (PARTITION BY p_brand, p_type) AS f FROM part)""")
def component_ordinal(spark, d):
    return grouping.component_keys(table(spark, d, "part").select("p_partkey", "p_brand", "p_type"), "p_brand", "p_type", "p_partkey").select("p_partkey", "group_key")


def _split_search(spark, d):
    o = table(spark, d, "orders")
    cuts = split.split_cuts(o, "o_custkey")
    # two classes of a few groups each: one is too rare to count, one is excluded by name
    rows = o.select("o_custkey", F.when(F.col("o_orderkey") <= 4, "rare").when(F.col("o_orderkey") % 11 == 0, "other").otherwise(F.col("o_orderstatus")).alias("class"))
    return cuts, split.split_scores(cuts, split.class_presence(rows, "o_custkey", "class"), "o_custkey", "class", excluded=("other",))


CUT = "CASE WHEN r <= round_even(n * 0.7::double, 0) THEN 'train' WHEN r <= round_even(n * 0.7::double, 0) + round_even(n * 0.15::double, 0) THEN 'val' ELSE 'test' END"
CAND = f"""g AS (SELECT o_custkey, ('0x' || substr(md5(o_custkey::varchar), 1, 13))::bigint AS h1, ('0x' || substr(md5(o_custkey::varchar), 14, 13))::bigint AS h2 FROM (SELECT DISTINCT o_custkey FROM orders)),
a AS (SELECT unnest(range(512))::int AS attempt), n AS (SELECT count(*) AS n FROM g),
r AS (SELECT attempt, o_custkey, row_number() OVER (PARTITION BY attempt ORDER BY (h1 + attempt * h2) % 4503599627370449, o_custkey) AS r FROM g, a),
c AS MATERIALIZED (SELECT attempt, o_custkey, {CUT} AS split FROM r, n),
p AS (SELECT DISTINCT o_custkey, CASE WHEN o_orderkey <= 4 THEN 'rare' WHEN o_orderkey % 11 = 0 THEN 'other' ELSE o_orderstatus END AS o_orderstatus FROM orders),
t AS (SELECT o_orderstatus, count(*) AS n FROM p WHERE o_orderstatus <> 'other' GROUP BY 1 HAVING count(*) >= 6), k AS (SELECT * FROM (VALUES ('train', .7), ('val', .15), ('test', .15)) v(split, ratio)),
s AS MATERIALIZED (SELECT a.attempt, round(avg(abs(coalesce(x.c, 0) / t.n - ratio::double)), 8) AS score FROM a CROSS JOIN t CROSS JOIN k LEFT JOIN
(SELECT attempt, o_orderstatus, split, count(*) AS c FROM c JOIN p ON c.o_custkey = p.o_custkey GROUP BY 1, 2, 3) x ON x.attempt = a.attempt AND x.o_orderstatus = t.o_orderstatus AND x.split = k.split GROUP BY 1)"""


@query(f"WITH {CAND} SELECT o_custkey, split FROM c WHERE attempt = (SELECT attempt FROM s ORDER BY score, attempt LIMIT 1)")
def split_search(spark, d):
    cuts, scores = _split_search(spark, d)
    return split.best_split(table(spark, d, "orders"), "o_custkey", cuts, scores)


@query(f"WITH {CAND} SELECT attempt, score FROM s")
def share_deviation(spark, d):
    return _split_search(spark, d)[1]


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'excluded_empty_label' WHEN quality = 1 THEN 'selected' ELSE 'omitted_correlated_eval_variant' END AS selection_reason
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def selection_reason(spark, d):
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    n = F.when(F.col("quality").isNull(), 0).otherwise(1)
    return j.select("doc_id", audit.selection_reason(n, F.col("quality") == 1).alias("selection_reason"))


OVERLAPS = [("train", "val"), ("train", "test"), ("val", "test")]


@query(f"""WITH g AS (SELECT DISTINCT o_custkey, {split_sql('o_orderkey')} AS s FROM orders), p AS (SELECT * FROM (VALUES ('train', 'val'), ('train', 'test'), ('val', 'test')) v(a, b))
SELECT a AS split_a, b AS split_b, (SELECT count(*) FROM g x JOIN g y ON x.o_custkey = y.o_custkey WHERE x.s = a AND y.s = b) AS shared_groups FROM p""")
def group_overlap(spark, d):
    return audit.overlap(table(spark, d, "orders").select("o_custkey", X.split_of(F.col("o_orderkey")).alias("split")), "o_custkey", "split", OVERLAPS)


# arrays and geometry -----------------------------------------------------------------------------------------------

PTS = f"e AS (SELECT vec_id, label, {EMB} AS e FROM embeddings), b AS (SELECT vec_id, label, e, [e[2 * i + 1] FOR i IN range(len(e) // 2)] AS x, [e[2 * i + 2] FOR i IN range(len(e) // 2)] AS y FROM e)"


def _points(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


@query(f"""WITH {PTS} SELECT vec_id, round(abs(list_sum([x[i + 1] * y[(i + 1) % len(x) + 1] - x[(i + 1) % len(x) + 1] * y[i + 1] FOR i IN range(len(x))])) / 2, 6) AS area FROM b""")
def polygon_area(spark, d):
    return _points(spark, d).select("vec_id", F.round(G.polygon_area(F.col("e")), 6).alias("area"))


@query(f"WITH {PTS} SELECT vec_id, round(list_min(x), 6) AS x, round(list_min(y), 6) AS y, round(list_max(x) - list_min(x), 6) AS w, round(list_max(y) - list_min(y), 6) AS h FROM b")
def bbox(spark, d):
    b = _points(spark, d).select("vec_id", G.bbox(F.col("e")).alias("b"))
    return b.select("vec_id", *[F.round(f"b.{c}", 6).alias(c) for c in "xywh"])


@query(f"""WITH {PTS}, v AS (SELECT label, list_min(x) AS x1, list_min(y) AS y1, list_max(x) - list_min(x) AS w, list_max(y) - list_min(y) AS h FROM b)
SELECT label, round(min(x1), 6) AS x, round(min(y1), 6) AS y, round(max(x1 + w) - min(x1), 6) AS w, round(max(y1 + h) - min(y1), 6) AS h, round(sum(w * h), 4) AS area, count(*) AS parts FROM v GROUP BY 1""")
def union_box(spark, d):
    b = _points(spark, d).select("label", G.bbox(F.col("e")).alias("b")).select("label", "b.*")
    x, y = F.min("x"), F.min("y")
    return b.groupBy("label").agg(F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(F.max(F.col("x") + F.col("w")) - x, 6).alias("w"),
                                  F.round(F.max(F.col("y") + F.col("h")) - y, 6).alias("h"), F.round(F.sum(F.col("w") * F.col("h")), 4).alias("area"), F.count("*").alias("parts"))


@query(f"WITH {PTS}, v AS (SELECT vec_id, unnest(e) AS v, generate_subscripts(e, 1) AS i FROM e) SELECT vec_id, round(sum(least(greatest(v, 0), 1) * CASE WHEN i % 2 = 1 THEN 640 ELSE 480 END), 4) AS total FROM v GROUP BY 1")
def clamp_scale(spark, d):
    s = G.clamp_scale(F.col("e"), F.lit(640.0), F.lit(480.0))
    return _points(spark, d).select("vec_id", F.round(F.aggregate(s, F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


@query(f"""WITH {PTS} SELECT row_number() OVER (ORDER BY vec_id) AS annotation_id, vec_id, label + 1 AS category_id, round(list_min(x), 4) AS x, round(list_max(x) - list_min(x), 4) AS w, len(e) AS points, 0 AS iscrowd FROM b""")
def annotation_rows(spark, d):
    b = _points(spark, d).select("vec_id", (F.col("label") + 1).alias("category_id"), G.bbox(F.col("e")).alias("b"), F.size("e").alias("points"))
    b = b.select("vec_id", "category_id", F.round("b.x", 4).alias("x"), F.round("b.w", 4).alias("w"), "points", F.lit(0).alias("iscrowd"))
    return split.dense_ids(b, ["vec_id"], "annotation_id")


@query(COMP + """, c AS (SELECT vec_id, label, coalesce((SELECT min(b) FROM r WHERE r.a = vec_id), vec_id) AS component FROM embeddings)
SELECT vec_id, 'l' || label || '__visual_' || lpad((dense_rank() OVER (PARTITION BY label ORDER BY component) - 1)::varchar, greatest(2, length((dense_rank() OVER (PARTITION BY label ORDER BY component) - 1)::varchar))::int, '0') AS group_key FROM c""")
def component_update(spark, d):
    c = _components(spark, d).withColumn("prefix", F.concat(F.lit("l"), "label"))
    return grouping.component_keys(c, "prefix", "component", "vec_id").select("vec_id", "group_key")


@query(COMP + f""", c AS (SELECT label, coalesce((SELECT min(b) FROM r WHERE r.a = vec_id), vec_id) AS component FROM embeddings)
SELECT (SELECT count(*) FROM ({PAIRS})) AS pair_count, (SELECT count(*) FROM p) AS matched_edges, count(DISTINCT label) AS prefix_groups, count(DISTINCT component) AS refined_groups FROM c""")
def grouping_profile(spark, d):
    edges = materialize(_edges(spark, d), "edges")
    return grouping.grouping_profile(table(spark, d, "embeddings").select("label"), edges, _components(spark, d, edges), "label")


# strings, JSON, HTML -----------------------------------------------------------------------------------------------

@query("SELECT page_id, string_split(url, '?')[1] AS url_key, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages")
def url_key(spark, d):
    return table(spark, d, "pages").select("page_id", F.substring_index("url", "?", 1).alias("url_key"), F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("host"))


@query("SELECT page_id, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h1, CASE WHEN regexp_matches(html, '(?i)\\bcopy\\b') THEN 'noted' ELSE 'unverified' END AS status FROM pages")
def html_title_h1(spark, d):
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", X.capture(h, r"(?s)<h1>(.*?)</h1>").alias("h1"), F.when(h.rlike(r"(?i)\bcopy\b"), "noted").otherwise("unverified").alias("status"))


@query()
def page_text(spark, d):
    p = H.page_metadata(H.page_fields(table(spark, d, "pages"), prefix="Photo by"))
    return p.select("page_id", "title", "credit", "page_text", "date", "status")


@query("SELECT conv_id, array_to_string(list(role ORDER BY t), '; ') AS provenance, (SELECT count(*) FROM conversations c WHERE c.conv_id = q.conv_id) AS n_rows, (SELECT arg_min(text, turn) FROM conversations c WHERE c.conv_id = q.conv_id) AS text FROM (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY 1, 2) q GROUP BY 1")
def provenance_merge(spark, d):
    return audit.provenance_merge(table(spark, d, "conversations"), "conv_id", "role", "turn", keep=("text",))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def props_json(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("""WITH a AS (SELECT o_orderpriority AS name, count(*) AS n FROM orders GROUP BY 1), e AS (SELECT * FROM (VALUES ('1-URGENT', 7::bigint), ('9-NEVER', 5)) v(name, n) UNION ALL SELECT name, n FROM a WHERE name = '5-LOW')
SELECT coalesce(a.name, e.name) AS name, a.n AS actual, e.n AS expected FROM a FULL JOIN e ON a.name = e.name WHERE a.n IS DISTINCT FROM e.n""")
def reconcile_counts(spark, d):
    """Counts against expectations of which one is wrong, one names nothing, one is right and the others are missing."""
    a = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.count("*").alias("n"))
    e = spark.createDataFrame([("1-URGENT", 7), ("9-NEVER", 5)], "name string, n long").unionByName(a.filter("name = '5-LOW'"))
    return validate.reconcile(a, e, ["name"], "n")


REJ = "(CASE (doc_id % 7)::int WHEN 0 THEN '0 0 0 1 0 1 .75 0 .75' WHEN 1 THEN '23 0 0 1 0 1 1' WHEN 2 THEN '0 0 0 1 0 1' WHEN 3 THEN '0 0 0 1 0 1 1 0' WHEN 4 THEN '0 0 0 1 0 1 1.1' WHEN 5 THEN '0 0 0 .5 .5 1 1' ELSE 'x 0 0 1 0 1 1' END)"


@query(f"""SELECT doc_id, CASE (doc_id % 7)::int WHEN 0 THEN NULL WHEN 1 THEN 'class' WHEN 2 THEN 'arity' WHEN 3 THEN 'arity' WHEN 4 THEN 'range' WHEN 5 THEN 'degenerate' ELSE 'token' END AS reason,
CASE WHEN doc_id % 7 = 0 THEN 12.0::double END AS area FROM documents""")
def rejects(spark, d):
    sql = REJ.replace("::int", "")
    rows = table(spark, d, "documents").select("doc_id", F.lit(1).alias("line_no"), F.expr(sql).alias("line"), F.lit(4.0).alias("width"), F.lit(4.0).alias("height"))
    return validate.parse_polygons(rows, 23).select("doc_id", "reason", F.when(F.col("reason").isNull(), F.col("area")).alias("area"))


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 8")
def topk(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(8)


@query("SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1) // 24 AS batch FROM part")
def batches(spark, d):
    return split.batches(table(spark, d, "part").select("p_partkey"), ["p_partkey"], 24)


@query("SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def required_join(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return curate.required_join(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), orders, "l_orderkey")


@query("SELECT 5 * doc_id AS doc_id FROM documents WHERE 5 * doc_id NOT IN (SELECT doc_id FROM documents)")
def required_join_gap(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return curate.not_in_manifest(docs.select((5 * F.col("doc_id")).alias("doc_id")), docs, "doc_id")


@query("SELECT lang, source, n_chars, count(*) AS copies FROM documents GROUP BY ALL HAVING count(*) > 1")
def name_collisions(spark, d):
    return validate.collisions(table(spark, d, "documents").select("lang", "source", "n_chars"), ["lang", "source", "n_chars"]).withColumnRenamed("count", "copies")


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def manifest_anti(spark, d):
    return curate.not_in_manifest(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id")


@query("SELECT d.doc_id, coalesce(CASE WHEN l.toxic = 1 THEN '' WHEN l.toxic = 0 THEN 'checked' END, source) AS source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def metadata_fallback(spark, d):
    v = table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "").otherwise("checked").alias("source"))
    return curate.with_fallback(table(spark, d, "documents").select("doc_id", "source"), v, "doc_id", ["source"])


@query("""SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'assistant' THEN 1 ELSE 2 END, turn) AS r
FROM (SELECT DISTINCT conv_id, turn, role FROM conversations) WHERE role IN ('assistant', 'user')) WHERE r = 1""")
def first_choice(spark, d):
    return curate.first_choice(table(spark, d, "conversations").select("conv_id", "turn", "role").distinct(), "conv_id", "role", ["assistant", "user"])


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def dim_lookup(spark, d):
    return table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


@query("SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN 'true' ELSE 'false' END AS selected FROM orders")
def semi_flag(spark, d):
    have = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("h", F.lit(True))
    return table(spark, d, "orders").select("o_orderkey").join(have, "o_orderkey", "left").select("o_orderkey", F.coalesce("h", F.lit(False)).cast("string").alias("selected"))


@query(f"""SELECT {split_sql('o_orderkey')} AS split, count(*) AS images, count(DISTINCT o_custkey) AS groups, round(sum(o_totalprice), 2) AS total,
sum(CASE WHEN n IS NULL THEN 1 ELSE 0 END)::bigint AS empty_count, round(avg(CASE WHEN n IS NULL THEN 1.0 ELSE 0.0 END), 6) AS empty_rate, coalesce(sum(n), 0)::bigint AS instances
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1""")
def split_totals(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    j = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice").join(n, "o_orderkey", "left")
    none = F.col("n").isNull()
    return j.groupBy(X.split_of(F.col("o_orderkey")).alias("split")).agg(
        F.count("*").alias("images"), F.count_distinct("o_custkey").alias("groups"), F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.count_if(none).alias("empty_count"), F.round(F.avg(none.cast("double")), 6).alias("empty_rate"), F.coalesce(F.sum("n"), F.lit(0)).alias("instances"))


@query("""SELECT v.c AS l_returnflag, count(l_orderkey) AS instances FROM (VALUES ('A'), ('N'), ('R'), ('Z')) v(c) LEFT JOIN lineitem ON l_returnflag = v.c GROUP BY 1""")
def sparse_class_count(spark, d):
    dims = spark.createDataFrame([("A",), ("N",), ("R",), ("Z",)], "l_returnflag string")
    got = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("instances"))
    return dims.join(got, "l_returnflag", "left").na.fill(0)


# a class table: one row per brand, three shares of its lines, the last one missing for brands with few of them
REPORT_SQL = """(SELECT p_brand AS class, round(avg(CASE WHEN l_discount > 0.04 THEN 1.0 ELSE 0.0 END), 4) AS s, round(avg(CASE WHEN l_tax > 0.03 THEN 1.0 ELSE 0.0 END), 4) AS p,
CASE WHEN count(*) FILTER (l_quantity > 48) >= 5 AND p_brand <> 'Brand#11' THEN round(avg(CASE WHEN l_quantity > 20 THEN 1.0 ELSE 0.0 END), 4) END AS t FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"""


def _report(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    return rows.groupBy("p_brand").agg(share(F.col("l_discount") > 0.04).alias("scratch_val_ap"), share(F.col("l_tax") > 0.03).alias("pretrained_val_ap"), share(F.col("l_quantity") > 20).alias("t"), F.count_if(F.col("l_quantity") > 48).alias("n")).select(
        F.col("p_brand").alias("class"), "scratch_val_ap", "pretrained_val_ap", F.when((F.col("n") >= 5) & (F.col("p_brand") != "Brand#11"), F.col("t")).alias("test_ap"))


@query(f"""SELECT class, round(p - s, 3) AS val_delta, round(p - s, 3) > 0 AS improved, t AS test_ap FROM {REPORT_SQL}""")
def eval_report(spark, d):
    return metrics.class_report(_report(spark, d)).orderBy(F.desc("pretrained_val_ap")).select("class", "val_delta", "improved", "test_ap")


@query(f"""SELECT count(*) AS classes, count(t) AS measurable_test_classes, sum(CASE WHEN round(p - s, 3) > 0 THEN 1 ELSE 0 END)::bigint AS improved_classes, round(avg(s), 4) AS mean_scratch_ap, round(avg(p), 4) AS mean_pretrained_ap, round(avg(t), 4) AS mean_test_ap FROM {REPORT_SQL}""")
def eval_report_summary(spark, d):
    return metrics.class_report_summary(_report(spark, d))


@query(f"SELECT class, t AS test_ap FROM {REPORT_SQL} WHERE t IS NOT NULL")
def measurable_classes(spark, d):
    return _report(spark, d).filter("test_ap IS NOT NULL").select("class", "test_ap")


@query("""SELECT p_brand, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS r FROM part WHERE p_size >= 2) WHERE r = 1 ORDER BY p_size DESC, p_partkey LIMIT 6""")
def group_first_six(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_partkey", "p_size").filter("p_size >= 2")
    return curate.first_per_group(p, "p_brand", [F.desc("p_size"), F.col("p_partkey")], 6)


@query(f"""WITH g AS (SELECT DISTINCT c_custkey FROM customer), n AS (SELECT count(*) AS n FROM g), r AS (SELECT c_custkey, row_number() OVER (ORDER BY md5('0|' || c_custkey), c_custkey) AS r FROM g)
SELECT c_custkey, {CUT} AS split FROM r, n""")
def split_boundaries(spark, d):
    return split.split_boundaries(table(spark, d, "customer"), "c_custkey")


@query(f"""SELECT l_orderkey, l_linenumber, sp AS split, sp = 'train' OR r = 1 AS selected FROM (SELECT l_orderkey, l_linenumber, {split_sql('l_orderkey')} AS sp, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS r FROM lineitem)""")
def select_records(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", X.split_of(F.col("l_orderkey")).alias("split"))
    return split.select_records(rows, "l_orderkey", "l_quantity", "l_linenumber").drop("l_quantity")


@query("""SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 1)
UNION ALL SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'none' ORDER BY o_totalprice DESC, o_orderkey LIMIT 1)""")
def first_or_empty(spark, d):
    """The first of the matching rows, once with matches and once without any."""
    o = table(spark, d, "orders")
    first = lambda where: o.filter(where).select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1)
    return first("o_totalprice > 1000").unionByName(first("o_orderstatus = 'none'"))


@query("SELECT conv_id, array_to_string(list(role ORDER BY t), ',') AS roles FROM (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY 1, 2) GROUP BY 1")
def array_unique_order(spark, d):
    seq = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"])
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.array_distinct(seq), ",").alias("roles"))


@query("""SELECT p_partkey, printf('%s__visual_%02d', p_brand, p_size) AS key, round(p_retailprice, 1) AS price, least(greatest(p_size, 10), 40) AS clamped, substr(regexp_replace(p_name, '[^\\x00-\\x7F]', '', 'g'), 1, 30) AS short,
starts_with(p_brand, 'Brand') AS has_prefix, list_contains(string_split_regex(p_type, '\\s+'), 'STEEL') AS has_token, printf('%dx%d', p_size, p_size * 2) AS dims, printf('%.2f', 1000.0 * p_size / 80) AS avg_ms, coalesce(p_name, '') AS wanted,
CASE WHEN p_size <> 10 THEN 'size ' || p_size ELSE '' END AS note FROM part""")
def scalar_pack(spark, d):
    c = F.col
    return table(spark, d, "part").select(
        "p_partkey", F.format_string("%s__visual_%02d", "p_brand", "p_size").alias("key"), F.round("p_retailprice", 1).alias("price"), F.least(F.greatest("p_size", F.lit(10)), F.lit(40)).alias("clamped"),
        X.ascii_cut(c("p_name"), 30).alias("short"), c("p_brand").startswith("Brand").alias("has_prefix"), X.has_class(c("p_type"), "STEEL").alias("has_token"), X.size_text(c("p_size"), c("p_size") * 2).alias("dims"),
        X.average_ms(c("p_size"), F.lit(10), F.lit(8)).alias("avg_ms"), F.coalesce("p_name", F.lit("")).alias("wanted"), F.when(c("p_size") != 10, F.concat(F.lit("size "), "p_size")).otherwise("").alias("note"))


@query("""SELECT r_name AS group_name, row_number() OVER (PARTITION BY r_name ORDER BY n_name) - 1 AS position, n_name AS class FROM nation JOIN region ON n_regionkey = r_regionkey""")
def taxonomy_explode(spark, d):
    """A map of lists, made from two dimension tables, back to rows."""
    names = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("c"))
    m = names.agg(F.map_from_entries(F.collect_list(F.struct("r_name", "c"))).alias("t"))
    return m.select(F.explode("t").alias("group_name", "c")).select("group_name", F.posexplode("c").alias("position", "class"))


# images, boxes, documents ------------------------------------------------------------------------------------------

_MASK = "list_filter(range(64), lambda p: (p // 8 - 3.5) ** 2 + (p % 8 - 3.5) ** 2 < (8 * 0.42) ** 2)"
_TURNED = {0: "p", 90: "(p % 8) * 8 + 7 - p // 8", 180: "63 - p", 270: "(7 - p % 8) * 8 + p // 8"}


@query(f"""WITH v AS (SELECT vec_id, label, {EMB} AS e FROM embeddings), t AS (SELECT vec_id, label, angle, [e[q + 1] FOR q IN [CASE angle WHEN 0 THEN {_TURNED[0]} WHEN 90 THEN {_TURNED[90]} WHEN 180 THEN {_TURNED[180]} ELSE {_TURNED[270]} END FOR p IN {_MASK}]] AS x
FROM v, (SELECT unnest([0, 90, 180, 270]) AS angle)), c AS (SELECT vec_id, label, angle, [y - list_avg(x) FOR y IN x] AS x FROM t), n AS (SELECT *, sqrt(list_dot_product(x, x)) AS n FROM c)
SELECT a.vec_id AS vec_id_a, b.vec_id AS vec_id_b, round(max(list_dot_product(a.x, b.x) / (a.n * b.n + 1e-8)), 6) AS score FROM n a JOIN n b ON a.label = b.label AND a.vec_id < b.vec_id AND a.angle = 0 GROUP BY 1, 2""")
def rotated_pairs(spark, d):
    """Each vector as an 8 x 8 image; right angles only, as SQL can express those."""
    p = images.rotated_pairs(table(spark, d, "embeddings"), "label", "vec_id", "embedding", angles=(0, 90, 180, 270))
    return p.select("vec_id_a", "vec_id_b", G.rounded(F.col("score")).alias("score"))


@query()
def rotated_edges(spark, d):
    """Pairs that reach 0.5 at any of the 64 angles."""
    p = images.rotated_pairs(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 0.5)
    return p.select("vec_id_a", "vec_id_b", G.rounded(F.col("score")).alias("score"))


def boxes(spark, d):
    """Ground truth and detections over parts: 25 parts an image, four categories, boxes from sizes and prices, detections shifted copies."""
    c = F.col
    p = table(spark, d, "part").select("p_partkey", "p_size", F.floor("p_retailprice").cast("long").alias("m"))
    box = lambda dx, dy, dw: F.struct(((c("m") * 7) % 400 + dx).cast("double").alias("x"), ((c("m") * 3 + c("p_size") * 11) % 300 + dy).cast("double").alias("y"),
                                      (8 + c("p_size") * 3 + dw).cast("double").alias("w"), (8 + c("p_partkey") % 120 + dw).cast("double").alias("h"))
    image, category = F.floor(c("p_partkey") / 25).alias("image_id"), (c("p_size") % 4).alias("category_id")
    truth = p.select(c("p_partkey").alias("gt_id"), image, category, box(F.lit(0), F.lit(0), F.lit(0)).alias("box"), (c("p_partkey") % 17 == 0).cast("int").alias("iscrowd"))
    shift = lambda k: (c("p_partkey") * k) % 9 - 4
    dets = p.filter("p_partkey % 10 <> 3").select(c("p_partkey").alias("det_id"), image, category, (((c("p_partkey") * 37) % 101) / 101.0).alias("score"), box(shift(2), shift(5), shift(7)).alias("box"))
    return truth, dets


@query()
def coco_eval(spark, d):
    """Average precision and greatest recall per category, size range, detection limit and threshold."""
    e = metrics.evaluate(*boxes(spark, d))
    return e.select("category_id", "area", "max_dets", "threshold", F.round("ap", 9).alias("ap"), F.round("recall", 9).alias("recall"))


@query()
def coco_report(spark, d):
    return metrics.report(metrics.evaluate(*boxes(spark, d))).select("metric", F.round("value", 9).alias("value"))


_XY = "list_transform(e[1:8], lambda x: round((x + 1) / 2, 4))"


@query(f"""WITH v AS (SELECT vec_id, label, {_XY} AS q FROM (SELECT vec_id, label, {EMB} AS e FROM embeddings)),
b AS (SELECT vec_id, label, [least(greatest(q[2 * i + 1], 0), 1) * 640 FOR i IN range(4)] AS x, [least(greatest(q[2 * i + 2], 0), 1) * 480 FOR i IN range(4)] AS y,
len(list_filter(q, lambda z: z < -0.000001 OR z > 1.000001)) AS off FROM v), g AS (SELECT *, abs(list_sum([x[i + 1] * y[(i + 1) % 4 + 1] - x[(i + 1) % 4 + 1] * y[i + 1] FOR i IN range(4)])) / 2 AS area FROM b),
r AS (SELECT *, CASE WHEN label > 7 THEN 'class' WHEN off > 0 THEN 'range' WHEN list_max(x) <= list_min(x) OR list_max(y) <= list_min(y) OR area <= 0 THEN 'degenerate' END AS reason FROM g)
SELECT vec_id, 2 AS line_no, reason, CASE WHEN reason IS NULL THEN round(area, 4) END AS area FROM r""")
def label_text(spark, d):
    """Label files as text, two lines and a blank one each, written from vectors and parsed again."""
    xy = F.concat_ws(" ", F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 8), lambda x: F.round((x + 1) / 2, 4).cast("string")))
    files = table(spark, d, "embeddings").select("vec_id", F.concat(F.lit(" \t\n "), F.col("label").cast("string"), F.lit(" "), xy, F.lit("\r\n\n")).alias("text"), F.lit(640.0).alias("width"), F.lit(480.0).alias("height"))
    p = validate.parse_polygons(validate.label_lines(files), 8)
    return p.select("vec_id", "line_no", "reason", F.when(F.col("reason").isNull(), F.round("area", 4)).alias("area"))


@query("SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) AS instances FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def usable_records(spark, d):
    line = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("line_no"), F.lit(0).alias("class_id"), F.array().cast("array<double>").alias("segmentation"), F.lit(0).alias("bbox"), F.lit(0).alias("area"))
    records = validate.image_records(table(spark, d, "orders").select("o_orderkey"), line, ["o_orderkey"])
    return validate.usable(records).select("o_orderkey", F.size("instances").cast("bigint").alias("instances"))


@query("SELECT p_partkey, to_json({'key': p_partkey, 'name': p_name, 'sizes': [p_size, p_size + 1], 'brand': {'id': p_brand}}) AS j FROM part")
def json_encode(spark, d):
    return table(spark, d, "part").select("p_partkey", F.to_json(F.struct(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.array("p_size", F.col("p_size") + 1).alias("sizes"), F.struct(F.col("p_brand").alias("id")).alias("brand"))).alias("j"))


@query("SELECT doc_id, md5(replace(text, ' ', chr(10))) AS m FROM documents")
def newlines(spark, d):
    t = F.replace(F.replace("text", F.lit(". "), F.lit(".\r")), F.lit(" "), F.lit("\r\n"))
    return table(spark, d, "documents").select("doc_id", F.md5(X.normalize_newlines(t).cast("binary")).alias("m"))


@query("""SELECT doc_id, i AS line_no, length(l) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE trim(l) <> '' AND NOT starts_with(l, '#')""")
def line_filter(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "l"))
    return t.filter((F.trim("l") != "") & ~F.col("l").startswith("#")).select("doc_id", (F.col("p") + 1).cast("bigint").alias("line_no"), F.length("l").cast("bigint").alias("n"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def doc_sha256(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("SELECT conv_id, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY 1")
def keyed_last_row(spark, d):
    return keyed_last(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", "turn").select("conv_id", "role", "text")


@query("SELECT 'benchmark' AS origin, item_id AS id FROM benchmark UNION ALL SELECT 'labels', doc_id FROM labels")
def union_append(spark, d):
    a = table(spark, d, "benchmark").select(F.lit("benchmark").alias("origin"), F.col("item_id").alias("id"))
    return a.unionByName(table(spark, d, "labels").select(F.lit("labels").alias("origin"), F.col("doc_id").alias("id")))


@query("SELECT n_nationkey + 1 AS id, n_name AS name, 'nation' AS supercategory FROM nation")
def category_dimension(spark, d):
    return table(spark, d, "nation").select((F.col("n_nationkey") + 1).alias("id"), F.col("n_name").alias("name"), F.lit("nation").alias("supercategory"))


@query("SELECT page_id, replace(url_encode(url || ' * ~ ' || substr(html, 60, 40)), '%20', '+') AS quoted FROM pages")
def url_quote(spark, d):
    return table(spark, d, "pages").select("page_id", X.quote_plus(F.concat("url", F.lit(" * ~ "), F.substring("html", 60, 40))).alias("quoted"))


@query("""WITH b AS (SELECT p_partkey, p_size AS x, p_size / 2 AS y, 100 + p_size AS w, 50 AS h, 300 + p_partkey % 400 AS width, 200 + p_partkey % 90 AS height FROM part),
s AS (SELECT *, least(320 / width, 320 / height) AS k FROM b), o AS (SELECT *, floor((320 - round_even(width * k, 0)) / 2) AS l, floor((320 - round_even(height * k, 0)) / 2) AS t FROM s)
SELECT p_partkey, round(l + x * k, 6) AS x1, round(t + y * k, 6) AS y1, round(l + (x + w) * k, 6) AS x2, round(t + (y + h) * k, 6) AS y2 FROM o""")
def tile_scaling(spark, d):
    c = F.col
    box = G.tile_box(c("p_size"), c("p_size") / 2, c("p_size") + 100, F.lit(50), 300 + c("p_partkey") % 400, 200 + c("p_partkey") % 90, 320)
    return table(spark, d, "part").select("p_partkey", box.alias("b")).select("p_partkey", *[F.round(F.get("b", F.lit(i)), 6).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])
