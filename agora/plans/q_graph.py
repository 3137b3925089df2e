"""Registered queries: neighbour-graph statistics, spanning forest and the
topic hierarchy (E1–E3, G11–G15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from agora.functions import text as T
from agora.operators import density, hierarchy, knn, topics
from agora.plans import model as M
from agora.plans.catalog import big, r6, register
from agora.session import write_shared
from agora.sources import fixtures as fx

K, MIN_SAMPLES = 5, 3

_KNN_CTE = f"""v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT id, e, sqrt(list_dot_product(e, e)) AS nrm FROM v),
p AS (SELECT a.id AS src, b.id AS dst,
             1.0 - CASE WHEN a.nrm = 0 OR b.nrm = 0 THEN 0.0
                        ELSE list_dot_product(a.e, b.e) / (a.nrm * b.nrm) END AS distance
      FROM n a JOIN n b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(distance, 9), dst) AS rank FROM p),
knn AS (SELECT * FROM r WHERE rank <= {K}),
core AS (SELECT src AS id, distance AS core FROM knn WHERE rank = {MIN_SAMPLES})"""


def _knn(spark, d):
    # read several times over: written once
    return write_shared(knn.knn_exact(fx.vectors(spark, d), K, block_rows=256), "knn")


@register("core_distance", f"""WITH {_KNN_CTE}
SELECT CAST(id AS BIGINT) AS id, round(core, 6) AS core FROM core""")
def q_core(spark, d):
    c = density.core_distance(_knn(spark, d), MIN_SAMPLES)
    return c.select(big("id").alias("id"), r6("core").alias("core"))


@register("mutual_reachability", f"""WITH {_KNN_CTE},
e AS (SELECT least(src, dst) AS s, greatest(src, dst) AS t, min(distance) AS distance FROM knn GROUP BY 1, 2)
SELECT CAST(e.s AS BIGINT) AS src, CAST(e.t AS BIGINT) AS dst,
       round(greatest(e.distance, a.core, b.core), 6) AS weight
FROM e JOIN core a ON a.id = e.s JOIN core b ON b.id = e.t""")
def q_mr(spark, d):
    kn = _knn(spark, d)
    m = density.mutual_reachability(kn, density.core_distance(kn, MIN_SAMPLES))
    return m.select(big("src").alias("src"), big("dst").alias("dst"), r6("weight").alias("weight"))


@register("minimum_spanning_forest")
def q_mst(spark, d):
    kn = _knn(spark, d)
    m = density.mutual_reachability(kn, density.core_distance(kn, MIN_SAMPLES))
    f = density.minimum_spanning_forest(m)
    return f.select(big("src").alias("src"), big("dst").alias("dst"), r6("weight").alias("weight"))


@register("spanning_tree")
def q_spanning_tree(spark, d):
    from agora.operators.span import spanning_tree
    v = fx.vectors(spark, d)
    kn = _knn(spark, d)
    t = spanning_tree(v, kn, density.core_distance(kn, MIN_SAMPLES), metric="cosine")
    return t.select(big("src").alias("src"), big("dst").alias("dst"), r6("weight").alias("weight"))


@register("topic_distance", f"""WITH {M.sql_model()},
nrm AS (SELECT topic, sqrt(sum(score * score)) AS n FROM ctfidf GROUP BY topic),
dots AS (SELECT x.topic AS a, y.topic AS b, sum(x.score * y.score) AS dot
         FROM ctfidf x JOIN ctfidf y ON x.term = y.term GROUP BY x.topic, y.topic),
pairs AS (SELECT x.topic AS a, y.topic AS b, x.n AS na, y.n AS nb FROM nrm x CROSS JOIN nrm y)
SELECT CAST(pairs.a AS BIGINT) AS a, CAST(pairs.b AS BIGINT) AS b,
       round(CASE WHEN pairs.a = pairs.b THEN 0.0
                  ELSE greatest(0.0, 1.0 - CASE WHEN na > 0 AND nb > 0 THEN coalesce(dot, 0.0) / (na * nb)
                                                ELSE 0.0 END) END, 6) AS distance
FROM pairs LEFT JOIN dots ON dots.a = pairs.a AND dots.b = pairs.b""")
def q_topic_distance(spark, d):
    t = hierarchy.topic_distance(M.ctfidf(spark, d))
    return t.select(big("a").alias("a"), big("b").alias("b"), r6("distance").alias("distance"))


@register("topic_hierarchy")
def q_topic_hierarchy(spark, d):
    m = hierarchy.ward_hierarchy(hierarchy.topic_distance(M.ctfidf(spark, d)))
    return m.select(big("step").alias("step"), big("parent").alias("parent"), big("left").alias("left"),
                    big("right").alias("right"), r6("distance").alias("distance"), big("size").alias("size"),
                    F.array_join(F.col("topics").cast("array<string>"), ",").alias("topics"))


@register("shorten_label", f"""WITH {M.sql_model()},
info AS (SELECT t.topic, CAST(t.topic AS VARCHAR) || '_' || coalesce(array_to_string(
             list(w.term ORDER BY w.rank) FILTER (WHERE w.rank <= 4), '_'), '') AS name,
         coalesce(array_to_string(list(w.term ORDER BY w.rank), ', '), '') AS representation
  FROM tsize t LEFT JOIN words w ON t.topic = w.topic GROUP BY t.topic)
SELECT CAST(topic AS BIGINT) AS topic,
       array_to_string(string_split(representation, ', ')[1:3], ', ') AS short_label,
       array_to_string(string_split(representation, ', ')[1:3], ', ') || ' (' || name || ')' AS combined
FROM info""")
def q_shorten(spark, d):
    dt = M.doc_topics(spark, d).where(F.col("topic") != -1)
    info = topics.topic_info(dt, M.words(spark, d))
    short = T.shorten_label("representation")
    return info.select(big("topic").alias("topic"), short.alias("short_label"),
                       hierarchy.combine_labels(short, F.col("name"), F.col("topic")).alias("combined"))


# D7, D9, D10, E4 (rows; pytest checks the numerics) ------------------------

@register("smooth_knn")
def q_smooth_knn(spark, d):
    from agora.operators import reduce as R
    s = R.smooth_knn(_knn(spark, d), K)
    return s.select(big("id").alias("id"), r6("rho").alias("rho"), r6("sigma").alias("sigma"))


@register("fuzzy_graph")
def q_fuzzy_graph(spark, d):
    from agora.operators import reduce as R
    kn = _knn(spark, d)
    g = R.fuzzy_graph(kn, R.smooth_knn(kn, K))
    return g.select(big("src").alias("src"), big("dst").alias("dst"), r6("weight").alias("weight"))


@register("fuzzy_graph_given", f"""WITH {_KNN_CTE},
s AS (SELECT src, min(distance) AS rho, avg(distance) AS sigma FROM knn GROUP BY src),
w AS (SELECT k.src, k.dst, exp(-greatest(k.distance - s.rho, 0.0) / s.sigma) AS w FROM knn k JOIN s ON s.src = k.src),
u AS (SELECT least(src, dst) AS i, greatest(src, dst) AS j, coalesce(max(w) FILTER (WHERE src < dst), 0) AS a,
        coalesce(max(w) FILTER (WHERE src > dst), 0) AS b FROM w GROUP BY 1, 2)
SELECT CAST(i AS BIGINT) AS src, CAST(j AS BIGINT) AS dst, round(a + b - a * b, 6) AS weight FROM u""")
def q_fuzzy_graph_given(spark, d):
    from agora.operators import reduce as R
    kn = _knn(spark, d)
    given = kn.groupBy(F.col("src").alias("id")).agg(F.min("distance").alias("rho"), F.avg("distance").alias("sigma"))
    g = R.fuzzy_graph(kn, given)
    return g.select(big("src").alias("src"), big("dst").alias("dst"), r6("weight").alias("weight"))


@register("reduce_pca")
def q_reduce_pca(spark, d):
    from agora.operators import reduce as R
    r = R.reduce(fx.vectors(spark, d), "pca", n_components=8, dim=64)
    return r.select(big("id").alias("id"), F.posexplode("coords").alias("dim", "value")) \
        .select("id", big("dim").alias("dim"), r6(F.abs("value")).alias("abs_value"))


@register("reduce_umap")
def q_reduce_umap(spark, d):
    from agora.operators import reduce as R
    r = R.reduce(fx.vectors(spark, d), "umap", n_components=3, n_neighbors=10, n_epochs=15)
    return r.select(big("id").alias("id"), F.transform("coords", lambda v: F.round(v, 6)).alias("coords"))


EPS = 0.62  # splits the reachability graph of the test vectors into many parts

_MR_CTE = """mr AS (
SELECT e.s AS src, e.t AS dst, greatest(e.distance, a.core, b.core) AS weight
FROM (SELECT least(src, dst) AS s, greatest(src, dst) AS t, min(distance) AS distance FROM knn GROUP BY 1, 2) e
JOIN core a ON a.id = e.s JOIN core b ON b.id = e.t)"""


# the forest connects at every weight what the whole graph connects
@register("components_at", f"""WITH RECURSIVE {_KNN_CTE}, {_MR_CTE},
link AS (SELECT src AS a, dst AS b FROM mr WHERE round(weight, 9) <= {EPS}
         UNION SELECT dst, src FROM mr WHERE round(weight, 9) <= {EPS}),
reach(node, other) AS (SELECT id, id FROM n UNION SELECT r.node, l.b FROM reach r JOIN link l ON l.a = r.other)
SELECT CAST(node AS BIGINT) AS node, CAST(min(other) AS BIGINT) AS comp FROM reach GROUP BY node""")
def q_components_at(spark, d):
    kn = _knn(spark, d)
    m = density.mutual_reachability(kn, density.core_distance(kn, MIN_SAMPLES)).withColumn(
        "weight", F.round("weight", 9))
    nodes = fx.vectors(spark, d).select(F.col("doc_id").alias("node"))
    c = density.components_at(density.minimum_spanning_forest(m), EPS, nodes)
    return c.select(big("node").alias("node"), big("comp").alias("comp"))


# E5, E6, E8 on the vectors (rows; pytest has the definitions), and E6–E8 on a
# fixed tree: all → regions → nations, with customers as points -------------

@register("density_cluster")
def q_density_cluster(spark, d):
    out = density.density_cluster(fx.vectors(spark, d), min_cluster_size=5, min_samples=MIN_SAMPLES,
                                  metric="cosine", k_graph=10)
    return out["labels"].select(big("id").alias("id"), big("cluster").alias("cluster"))


@register("condensed_tree")
def q_condensed_tree(spark, d):
    kn = _knn(spark, d)
    m = density.mutual_reachability(kn, density.core_distance(kn, MIN_SAMPLES))
    nodes = fx.vectors(spark, d).select(F.col("doc_id").alias("node"))
    clusters, _ = density.condensed_tree(density.minimum_spanning_forest(m), nodes, 5)
    return clusters.select("cluster", "parent", r6("birth").alias("birth"), r6("stability").alias("stability"),
                           big("size").alias("size"))


_TREE_CTE = """counts AS (SELECT n_nationkey, n_regionkey, count(c_custkey) AS n
  FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL),
tree AS (SELECT 'n' || n_nationkey AS cluster, 'r' || n_regionkey AS parent, CAST(n * (n_nationkey % 3) AS DOUBLE) AS stability FROM counts
  UNION ALL SELECT 'r' || r_regionkey, 'all', coalesce((SELECT sum(n) FROM counts WHERE n_regionkey = r_regionkey), 0) * 1.0 FROM region
  UNION ALL SELECT 'all', NULL, 0.0),
best AS (SELECT t.cluster, t.stability >= coalesce(sum(k.stability), 0) AS keep
  FROM tree t LEFT JOIN tree k ON k.parent = t.cluster WHERE t.parent = 'all' GROUP BY t.cluster, t.stability),
selected AS (SELECT cluster FROM best WHERE keep
  UNION ALL SELECT t.cluster FROM tree t JOIN best b ON b.cluster = t.parent WHERE NOT b.keep)"""


def _tree(spark, d):
    nation, region, customer = (fx.table(spark, d, t) for t in ("nation", "region", "customer"))
    n = nation.join(customer, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(
        "n_nationkey", "n_regionkey").agg(F.count("c_custkey").alias("n"))
    rows = n.select(F.concat(F.lit("n"), "n_nationkey").alias("cluster"), F.concat(F.lit("r"), "n_regionkey").alias("parent"),
                    (F.col("n") * (F.col("n_nationkey") % 3)).cast("double").alias("stability"))
    sums = n.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.sum("n").alias("n"))
    regions = region.join(sums, "r_regionkey", "left").select(
        F.concat(F.lit("r"), "r_regionkey").alias("cluster"), F.lit("all").alias("parent"),
        F.coalesce("n", F.lit(0)).cast("double").alias("stability"))
    top = regions.limit(1).select(F.lit("all").alias("cluster"), F.lit(None).cast("string").alias("parent"),
                                  F.lit(0.0).alias("stability"))
    return rows.unionByName(regions).unionByName(top)


@register("select_eom", f"WITH {_TREE_CTE} SELECT cluster FROM selected")
def q_select_eom(spark, d):
    return density.select_eom(_tree(spark, d)).select("cluster")


@register("select_leaf", f"""WITH {_TREE_CTE}
SELECT cluster FROM tree WHERE cluster NOT IN (SELECT parent FROM tree WHERE parent IS NOT NULL)""")
def q_select_leaf(spark, d):
    return density.select_leaf(_tree(spark, d)).select("cluster")


@register("cluster_labels", f"""WITH {_TREE_CTE},
points AS (SELECT c_custkey AS node, CASE WHEN c_custkey % 5 = 0 THEN 'r' || n_regionkey ELSE 'n' || n_nationkey END AS own,
             'r' || n_regionkey AS region FROM customer JOIN nation ON c_nationkey = n_nationkey),
chosen AS (SELECT node, CASE WHEN own IN (SELECT cluster FROM selected) THEN own
                             WHEN region IN (SELECT cluster FROM selected) THEN region END AS cluster FROM points),
numbered AS (SELECT cluster, row_number() OVER (ORDER BY count(*) DESC, min(node)) - 1 AS label
  FROM chosen WHERE cluster IS NOT NULL GROUP BY cluster)
SELECT CAST(node AS BIGINT) AS id, CAST(coalesce(label, -1) AS BIGINT) AS cluster
FROM chosen LEFT JOIN numbered USING (cluster)""")
def q_cluster_labels(spark, d):
    tree = _tree(spark, d)
    points = fx.table(spark, d, "customer").join(
        fx.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    members = points.select(F.col("c_custkey").alias("node"), F.when(
        F.col("c_custkey") % 5 == 0, F.concat(F.lit("r"), "n_regionkey")).otherwise(
        F.concat(F.lit("n"), "n_nationkey")).alias("cluster"))
    out = density.cluster_labels(tree, members, density.select_eom(tree), members.select("node"))
    return out.select(big("id").alias("id"), big("cluster").alias("cluster"))


# E11–E14 -------------------------------------------------------------------

@register("relative_validity", """
WITH v AS (SELECT vec_id AS id, CASE WHEN label = 9 THEN -1 ELSE label END AS c FROM embeddings),
e AS (SELECT a.id AS src, b.id AS dst, (a.id * 7919 % 1000 + 1) / 1000.0 AS weight, a.c AS ca, b.c AS cb
      FROM v a JOIN v b ON b.id = a.id + 1),
x AS (SELECT ca AS c, cb AS o, weight FROM e UNION ALL SELECT cb, ca, weight FROM e),
per AS (SELECT c, coalesce(max(weight) FILTER (WHERE o = c), 0) AS dsc,
          coalesce(min(weight) FILTER (WHERE o <> c AND o <> -1), 2 * (SELECT max(weight) FROM e)) AS dspc
        FROM x WHERE c <> -1 GROUP BY c),
s AS (SELECT c, count(*) AS n FROM v WHERE c <> -1 GROUP BY c)
SELECT round(sum(n / (SELECT count(*) FROM v) * (dspc - dsc) / greatest(dspc, dsc)), 6) AS validity
FROM s JOIN per USING (c)""")
def q_relative_validity(spark, d):
    labels = fx.vector_clusters(spark, d).withColumnRenamed("doc_id", "id")
    a, b = labels.select(F.col("id").alias("src")), labels.select(F.col("id").alias("dst"))
    path = a.join(b, F.col("dst") == F.col("src") + 1).select(
        "src", "dst", ((F.col("src") * 7919 % 1000 + 1) / 1000.0).alias("weight"))
    return density.relative_validity(path, labels).select(r6("validity").alias("validity"))


_SPACE = {"n_neighbors": (10, 60, 5), "n_components": (50, 200, 10), "min_cluster_size": (5, 60, 5),
          "min_samples": (1, 20, 1)}


def _candidate_sql(name: str, lo: int, hi: int, step: int) -> str:
    u = f"CAST('0x' || substr(md5('0:' || trial || ':{name}'), 1, 8) AS BIGINT) / {16 ** 8}.0::DOUBLE"
    return f"CAST({lo} + floor({u} * {(hi - lo) // step + 1}) * {step} AS BIGINT) AS {name}"


# as many trials as there are customers
@register("param_candidates", "SELECT CAST(trial AS BIGINT) AS trial, " + ", ".join(
    _candidate_sql(p, *r) for p, r in _SPACE.items())
    + " FROM (SELECT unnest(range(0, (SELECT count(*) FROM customer))) AS trial)")
def q_param_candidates(spark, d):
    n = fx.table(spark, d, "customer").count()
    return density.candidate_table(spark, _SPACE, n).select(*[big(c).alias(c) for c in ("trial", *_SPACE)])


@register("best_trial", """
WITH t AS (SELECT CAST(regexp_extract(source, '(\\d+)', 1) AS BIGINT) AS trial, avg(n_chars % 100) / 100 AS validity,
             avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END) AS noise FROM documents GROUP BY 1)
SELECT trial, round(-validity + 0.1 * noise, 6) AS score FROM t ORDER BY -validity + 0.1 * noise, trial LIMIT 1""")
def q_best_trial(spark, d):
    t = fx.table(spark, d, "documents").groupBy(
        F.regexp_extract("source", r"(\d+)", 1).cast("long").alias("trial")).agg(
        (F.avg(F.col("n_chars") % 100) / 100).alias("validity"),
        F.avg((F.col("lang") == "en").cast("double")).alias("noise"))
    scored = t.select("trial", density.search_score(F.col("validity"), F.col("noise"), 0.1).alias("score"))
    return density.best_trial(scored).select("trial", r6("score").alias("score"))


# the whole space, clipped to the vectors' 64 dimensions: 100 evaluations in rounds
@register("param_sweep")
def q_param_sweep(spark, d):
    t = density.param_sweep(fx.vectors(spark, d), _SPACE, 100)
    return t.select(big("trial").alias("trial"), *[big(c).alias(c) for c in _SPACE], r6("validity").alias("validity"),
                    r6("noise_ratio").alias("noise_ratio"), r6("score").alias("score"))


@register("fit_best")
def q_fit_best(spark, d):
    _, labels = density.fit_best(fx.vectors(spark, d), _SPACE, 100)
    return labels.select(big("id").alias("id"), big("cluster").alias("cluster"))


# G13, G14 on a chain of merges over the document topics (the source numbers) --

_CHAIN_CTE = """topics AS (SELECT topic, row_number() OVER (ORDER BY topic) AS p, count(*) OVER () AS n
  FROM (SELECT DISTINCT CAST(regexp_extract(source, '(\\d+)', 1) AS BIGINT) AS topic FROM documents)),
docs AS (SELECT doc_id, CAST(regexp_extract(source, '(\\d+)', 1) AS BIGINT) AS topic FROM documents)"""


def _chain(spark, d):
    """Topic p + 1 joins the node of topics 1..p: merge p makes node 1000 + p."""
    from pyspark.sql import Window
    docs = fx.table(spark, d, "documents").select(
        "doc_id", F.regexp_extract("source", r"(\d+)", 1).cast("long").alias("topic"))
    t = docs.select("topic").distinct().withColumn("p", F.row_number().over(Window.orderBy("topic")))
    upto = F.array_sort(F.collect_list("topic").over(Window.orderBy("topic")))
    merges = t.withColumn("topics", upto).filter("p > 1").select(
        (F.col("p") - 1).alias("step"), (F.col("p") - 1 + 1000).cast("long").alias("parent"), "topics",
        F.col("p").cast("double").alias("distance"))
    return docs, merges, t.count()


@register("document_hierarchy", f"""WITH {_CHAIN_CTE},
levels AS (SELECT unnest(range(0, (SELECT max(n) FROM topics))) AS level)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(level AS BIGINT) AS level,
  CAST(CASE WHEN level > 0 AND p <= level + 1 THEN 1000 + level ELSE d.topic END AS BIGINT) AS topic
FROM docs d JOIN topics t ON t.topic = d.topic, levels""")
def q_document_hierarchy(spark, d):
    docs, merges, _ = _chain(spark, d)
    return hierarchy.document_hierarchy(merges, docs).select(
        big("doc_id").alias("doc_id"), big("level").alias("level"), big("topic").alias("topic"))


@register("reduce_topics", f"""WITH {_CHAIN_CTE},
cut AS (SELECT topic, CASE WHEN p <= n - 8 + 1 THEN 0 ELSE p END AS part FROM topics),
sized AS (SELECT c.part, min(CASE WHEN c.part = 0 THEN 1000 + t.n - 8 ELSE c.topic END) AS old, count(*) AS size
  FROM docs d JOIN cut c ON c.topic = d.topic JOIN topics t ON t.topic = d.topic GROUP BY c.part),
renamed AS (SELECT part, row_number() OVER (ORDER BY size DESC, old) - 1 AS new_topic FROM sized)
SELECT CAST(c.topic AS BIGINT) AS old_topic, CAST(new_topic AS BIGINT) AS new_topic
FROM cut c JOIN renamed USING (part)""")
def q_reduce_topics(spark, d):
    docs, merges, n = _chain(spark, d)
    mapping, _ = hierarchy.reduce_topics(merges, docs, n, 8)
    return mapping.select(big("old_topic").alias("old_topic"), big("new_topic").alias("new_topic"))
