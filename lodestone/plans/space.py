"""Queries of the spatial, annotation, splitting, conversion and streaming operators on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.frame import clean_counts, clean_obs, one_hot
from lodestone.operators import aggregate as A
from lodestone.operators import annotate as N
from lodestone.operators import cooccurrence as C
from lodestone.operators import embedding, graph, molecules, orthology, platform, plotdata, qc, split
from lodestone.operators import spatial as S
from lodestone.operators import stats as T
from lodestone.plans.matrix import CTE, labels, rounded, sample_weights
from lodestone.runtime import cut, read
from lodestone.streaming import incremental

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None, cte: bool = True):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = (CTE if cte else "") + sql
        return f

    return register


def points(s: SparkSession, d: str) -> DataFrame:
    """(obs, sample, section, x, y, category) with a sample and finite coordinates."""
    return clean_obs(s, d).filter("sample is not null and section is not null and x is not null and y is not null and not isnan(x) and not isnan(y)")


_PTS = ", p AS (SELECT * FROM o WHERE sample IS NOT NULL AND section IS NOT NULL AND isfinite(x) AND isfinite(y)) "


def _near(radius):
    return _PTS + f""", cell AS (SELECT *, CAST(floor(x / {radius}) AS BIGINT) AS cx, CAST(floor(y / {radius}) AS BIGINT) AS cy FROM p),
wide AS (SELECT c.obs, c.sample, c.section, c.x, c.y, c.cx + a.dx AS cx, c.cy + b.dy AS cy FROM cell c, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)),
near AS (SELECT a.obs AS i, b.obs AS j, sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2) AS distance FROM wide a JOIN cell b USING (sample, section, cx, cy)
  WHERE a.obs <> b.obs AND (a.x - b.x) ^ 2 + (a.y - b.y) ^ 2 <= {radius} * {radius} AND (a.x - b.x) ^ 2 + (a.y - b.y) ^ 2 > 0) """


@query("bin_points", _PTS + "SELECT obs, CAST(floor((x - (SELECT min(x) FROM p)) / 50) AS BIGINT) AS x_bin, CAST(floor((y - (SELECT min(y) FROM p)) / 50) AS BIGINT) AS y_bin FROM p")
def _(s, d):
    return S.bin_points(points(s, d), 50.0).select("obs", "x_bin", "y_bin")


@query("codes", _PTS + "SELECT obs, dense_rank() OVER (ORDER BY sample, section) - 1 AS code FROM p")
def _(s, d):
    return S.codes(points(s, d), ["sample", "section"]).select("obs", "code")


_CENT = _PTS + ", c AS (SELECT sample AS obs, avg(x) AS x, avg(y) AS y FROM p GROUP BY sample) "


def _centroids(s, d):
    return points(s, d).groupBy(F.col("sample").alias("obs")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


@query("dense_distances", _CENT + "SELECT a.obs AS i, b.obs AS j, round(sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2), 6) AS distance FROM c a CROSS JOIN c b")
def _(s, d):
    c = _centroids(s, d)
    return rounded(S.dense_distances(c, c))


@query("radius_distances", _near(25) + "SELECT i, j, round(distance, 6) AS distance FROM near")
def _(s, d):
    return rounded(S.sparse_distances(points(s, d), 25.0, ["sample", "section"]))


@query("annotation_distance", _near(25) + "SELECT i, j, round(sqrt(distance ^ 2 + CASE WHEN a.category = b.category THEN 0 ELSE 400 END), 6) AS distance FROM near JOIN lab a ON a.obs = i JOIN lab b ON b.obs = j")
def _(s, d):
    return rounded(S.with_annotation(S.sparse_distances(points(s, d), 25.0, ["sample", "section"]), labels(s, d), 20.0))


@query("annotation_distance_h2", _near(25) + "SELECT i, j, round(sqrt(distance ^ 2 + CASE WHEN a.category = b.category THEN 0 ELSE 100 END), 6) AS distance FROM near JOIN lab a ON a.obs = i JOIN lab b ON b.obs = j")
def _(s, d):
    return rounded(S.with_annotation(S.sparse_distances(points(s, d), 25.0, ["sample", "section"]), one_hot(labels(s, d)), "h2", 10.0))


@query("affinity", _near(25) + "SELECT i, j, round(exp(-(distance ^ 2) / 200), 6) AS w FROM near")
def _(s, d):
    return rounded(S.affinity(S.sparse_distances(points(s, d), 25.0, ["sample", "section"]), 10.0))


@query("strip_distances", _near(25) + "SELECT i, j, round(distance, 6) AS distance FROM near WHERE distance <= 20")
def _(s, d):
    return rounded(S.strip(S.sparse_distances(points(s, d), 25.0, ["sample", "section"]), 20.0))


_FILL = _PTS + """, n AS (SELECT a.obs, b.obs AS j, b.category, row_number() OVER (PARTITION BY a.obs ORDER BY sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2), b.obs) AS rank, sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2) AS distance
  FROM p a JOIN p b ON a.sample = b.sample AND a.section = b.section WHERE a.category IS NULL AND b.category IS NOT NULL) """


def _regions(s, d):
    return points(s, d).select("obs", "x", "y", F.concat_ws("/", "sample", "section").alias("g"), F.col("category").alias("region"))


@query("nearest_labelled", _FILL + "SELECT obs AS i, j, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM n WHERE rank <= 3")
def _(s, d):
    r = _regions(s, d)
    return rounded(S.nearest_labelled(r.filter("region is null"), r.filter("region is not null"), 3, "g"))


@query("fill_regions", _FILL + """, v AS (SELECT obs, category, count(*) AS c FROM n WHERE rank <= 3 GROUP BY 1, 2),
b AS (SELECT obs, category FROM (SELECT *, row_number() OVER (PARTITION BY obs ORDER BY c DESC, category) AS r FROM v) t WHERE r = 1)
SELECT p.obs, coalesce(p.category, b.category) AS region FROM p LEFT JOIN b ON b.obs = p.obs""")
def _(s, d):
    return S.fill_regions(_regions(s, d), 3, "g")


@query("balanced_cuts", _PTS + """, r AS (SELECT section, x, row_number() OVER (PARTITION BY section ORDER BY x) AS k, count(*) OVER (PARTITION BY section) AS m FROM p),
c AS (SELECT r.section, j.j, avg(r.x) AS c FROM r, (VALUES (1), (2), (3)) j(j) WHERE r.k IN (CAST(round_even(j.j * r.m / 4.0, 0) AS INT), CAST(round_even(j.j * r.m / 4.0, 0) AS INT) + 1) GROUP BY 1, 2)
SELECT p.obs, CASE WHEN bool_or(abs(p.x - c.c) < 3) THEN NULL ELSE CAST(count(*) FILTER (c.c < p.x) AS INTEGER) END AS interval FROM p JOIN c ON c.section = p.section GROUP BY p.obs""")
def _(s, d):
    return S.balanced_cuts(points(s, d), "x", 4, "section", 6.0).select("obs", "interval")


@query("quantile_labels", _PTS + ", q AS (SELECT DISTINCT unnest(quantile_cont(y, [0.2, 0.4, 0.6, 0.8])) AS c FROM p) SELECT obs, CAST((SELECT count(*) FROM q WHERE q.c < p.y) AS INTEGER) AS quantile FROM p")
def _(s, d):
    return S.quantile_labels(points(s, d), "y", 5).select("obs", "quantile")


@query("principal_axis", _PTS + ", c AS (SELECT sample, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy FROM p GROUP BY sample) SELECT sample, round(cos(atan2(2 * xy, xx - yy) / 2), 6) AS ax, round(sin(atan2(2 * xy, xx - yy) / 2), 6) AS ay FROM c")
def _(s, d):
    return rounded(S.principal_axis(points(s, d), "sample"))


@query("split_spatial_samples", _PTS + """, r AS (SELECT sample, x, row_number() OVER (PARTITION BY sample ORDER BY x) AS k, count(*) OVER (PARTITION BY sample) AS m FROM p),
c AS (SELECT sample, avg(x) AS c FROM r WHERE m >= 2 AND k IN (CAST(round_even(m / 2.0, 0) AS INT), CAST(round_even(m / 2.0, 0) AS INT) + 1) GROUP BY sample)
SELECT p.obs, CASE WHEN c.c IS NULL OR abs(p.x - c.c) < 10 THEN NULL ELSE p.sample || '|' || CASE WHEN c.c < p.x THEN '1' ELSE '0' END END AS label FROM p LEFT JOIN c ON c.sample = p.sample""")
def _(s, d):
    return S.split_spatial_samples(points(s, d), [("x", 2)], "sample", 20.0).select("obs", "label")


_COOC = """, l AS (SELECT p.obs, p.sample, p.category FROM p WHERE p.category IS NOT NULL),
cnt AS (SELECT a.sample, a.category AS annotation, b.category AS center, CAST({n} - 1 - floor((60 - distance) / {step}) AS INTEGER) AS k, count(*) AS c FROM near JOIN l a ON a.obs = i JOIN l b ON b.obs = j GROUP BY 1, 2, 3, 4),
cats AS (SELECT DISTINCT category FROM l),
f AS (SELECT s.sample, a.category AS annotation, b.category AS center, t.k, CAST(coalesce(cnt.c, 0) AS DOUBLE) AS c
  FROM (SELECT DISTINCT sample FROM l) s CROSS JOIN cats a CROSS JOIN cats b CROSS JOIN (SELECT CAST(unnest(range({n})) AS INTEGER) AS k) t
  LEFT JOIN cnt ON cnt.sample = s.sample AND cnt.annotation = a.category AND cnt.center = b.category AND cnt.k = t.k),
sc AS (SELECT *, (c + 1) / sum(c + 1) OVER (PARTITION BY sample, k, center) AS composition,
  sum(c + 1) OVER (PARTITION BY sample, k, annotation) / sum(c + 1) OVER (PARTITION BY sample, k) AS overall FROM f)
SELECT sample, annotation, center, k, round(c, 6) AS c, round(composition / overall, 6) AS occ, round(composition, 6) AS composition FROM sc
UNION ALL SELECT NULL, annotation, center, k, sum(c), round(avg(composition / overall), 6), round(avg(composition), 6) FROM sc GROUP BY annotation, center, k"""


@query("co_occurrence", _near(60) + _COOC.format(n=3, step=20))
def _(s, d):
    return rounded(C.co_occurrence(points(s, d), one_hot(labels(s, d)), 60.0, 20.0).drop("lo", "hi"))


@query("co_occurrence_matrix", _near(60) + _COOC.format(n=1, step=60))
def _(s, d):
    return rounded(C.co_occurrence_matrix(points(s, d), one_hot(labels(s, d)), 60.0).drop("lo", "hi"))


@query("co_occurrence_permuted")
def _(s, d):
    return C.permutation_scores(points(s, d), labels(s, d), 60.0, 20.0, 8)


@query("annotation_coordinate", _near(60) + """, pr AS (SELECT i, j, distance FROM near UNION ALL SELECT obs, obs, 0 FROM p),
h AS (SELECT i, l.category, least(5, CAST(floor(distance / 10) AS INT)) AS bin, count(*) AS w FROM pr JOIN lab l ON l.obs = j GROUP BY 1, 2, 3),
r AS (SELECT i, category, bin, sum(w) OVER (PARTITION BY i, category ORDER BY bin) AS run FROM h)
SELECT i AS obs, category, (min(bin) FILTER (run > 1) + 0.5) * 10 AS distance FROM r GROUP BY 1, 2""")
def _(s, d):
    return C.annotation_coordinate(points(s, d), one_hot(labels(s, d)), 1.0, 60.0, 10.0)


@query("connected_components", _near(25) + """, reach AS (SELECT obs AS node, obs AS seen FROM p UNION SELECT r.node, n.j FROM reach r JOIN near n ON n.i = r.seen)
SELECT node, min(seen) AS component FROM reach GROUP BY node""")
def _(s, d):
    p = points(s, d)
    return graph.connected_components(S.sparse_distances(p, 25.0, ["sample", "section"]).select("i", "j"), p.select("obs"))


SQL["connected_components"] = SQL["connected_components"].replace("WITH x AS", "WITH RECURSIVE x AS", 1)


@query("spectral_clustering")
def _(s, d):
    p = points(s, d)
    return graph.spectral_clustering(S.affinity(S.sparse_distances(p, 25.0, ["sample", "section"]), 10.0), p.select("obs"), 50)


@query("segments")
def _(s, d):
    p = points(s, d).withColumn("category", F.coalesce("category", F.lit("")))
    # molecules of all sections in one plane, moved apart
    n = S.codes(p, ["sample", "section"], "c").select("obs", (F.col("x") + F.col("c") * 10000).alias("x"), "y")
    return graph.segment(n, 12.5, 30, 25.0, labels(s, d), 10.0)


@query("find_regions")
def _(s, d):
    p = points(s, d).withColumn("g", F.concat_ws("/", "sample", "section"))
    return graph.find_regions(p, one_hot(labels(s, d)), 6, 3.0, "g")


# annotation: observations whose name ends in 0-4 are the reference for the others
def _halves(s, d):
    x = clean_counts(s, d)
    half = F.right("obs", F.lit(1)).cast("int") < 5
    return x.filter(~half), x.filter(half), labels(s, d).filter(half)


@query("annotate_overlap", """, ref AS (SELECT * FROM lab WHERE CAST(right(obs, 1) AS INT) < 5), n AS (SELECT category, count(*) AS n FROM ref GROUP BY 1),
v AS (SELECT DISTINCT var FROM x WHERE CAST(right(obs, 1) AS INT) < 5 INTERSECT SELECT DISTINCT var FROM x WHERE CAST(right(obs, 1) AS INT) >= 5),
m AS (SELECT r.category, x.var, sum(x.value) / any_value(n.n) AS m FROM x JOIN ref r ON r.obs = x.obs JOIN n ON n.category = r.category WHERE x.var IN (SELECT var FROM v) GROUP BY 1, 2),
q AS (SELECT category, var, m / sum(m) OVER (PARTITION BY category) AS q FROM m),
a AS (SELECT obs, var, value / sum(value) OVER (PARTITION BY obs) AS p FROM x WHERE CAST(right(obs, 1) AS INT) >= 5 AND var IN (SELECT var FROM v)),
b AS (SELECT obs, category, sum(sqrt(p * q)) ^ 2 AS s FROM a JOIN q ON q.var = a.var GROUP BY 1, 2)
SELECT obs, category, round(s / sum(s) OVER (PARTITION BY obs), 5) AS weight FROM b""")
def _(s, d):
    return rounded(N.annotate(*_halves(s, d), "projection", deconvolution=False, platform_iterations=-1), 5)


query("annotate_projection")(lambda s, d: N.annotate(*_halves(s, d), "projection"))
query("annotate_nnls")(lambda s, d: N.annotate(*_halves(s, d), "nnls"))
query("annotate_ot")(lambda s, d: N.annotate(*_halves(s, d), "OT", bisections=0, platform_iterations=-1))
query("annotate_bisected")(lambda s, d: N.annotate(*_halves(s, d), "nnls", bisections=2))


def _mixture(s, d):
    """Samples as mixed observations: their counts, category shares and the categories' profiles."""
    o = clean_obs(s, d).filter("sample is not null and category is not null").select("obs", F.col("sample").alias("m"))
    x = clean_counts(s, d)
    mixed = x.join(o, "obs").groupBy(F.col("m").alias("obs"), "var").agg(F.sum("value").alias("value"))
    return mixed, sample_weights(s, d), A.reference_profiles(x, labels(s, d))


_MIX = ", mx AS (SELECT o.sample AS obs, x.var, sum(x.value) AS value FROM x JOIN o ON o.obs = x.obs WHERE o.sample IS NOT NULL AND o.category IS NOT NULL GROUP BY 1, 2) "


@query("split_exact")
def _(s, d):
    return split.split_observations(*_mixture(s, d))


@query("split_exact_totals", _MIX + "SELECT obs, var, value FROM mx")
def _(s, d):
    return split.split_observations(*_mixture(s, d)).groupBy("obs", "var").agg(F.sum("value").alias("value"))


@query("split_denoised", _MIX + """, n AS (SELECT obs, sum(value) AS n FROM mx GROUP BY obs)
SELECT w.obs, w.category, p.var, round(w.weight * n.n * p.p, 5) AS value FROM w JOIN n ON n.obs = w.obs JOIN prof p ON p.category = w.category""")
def _(s, d):
    return rounded(split.split_observations(*_mixture(s, d), "denoise"), 5)


@query("split_bulk", _MIX + """, n AS (SELECT obs, sum(value) AS n FROM mx GROUP BY obs)
SELECT w.obs, 'bulk' AS category, p.var, round(sum(w.weight * n.n * p.p), 5) AS value FROM w JOIN n ON n.obs = w.obs JOIN prof p ON p.category = w.category GROUP BY 1, 3""")
def _(s, d):
    return rounded(split.split_observations(*_mixture(s, d), "bulk"), 5)


_HOM = """WITH a AS (SELECT DISTINCT symbol AS name, db_class_key AS key FROM gene_reference WHERE ncbi_taxon_id = 10090),
b AS (SELECT DISTINCT symbol AS name, db_class_key AS key FROM gene_reference WHERE ncbi_taxon_id = 9606),
b1 AS (SELECT name, key, 1.0 / count(*) OVER (PARTITION BY key) AS w FROM b),
a1 AS (SELECT name, key, 1.0 / count(*) OVER (PARTITION BY name) AS w FROM a WHERE key IN (SELECT key FROM b)),
t AS (SELECT a1.name AS source, b1.name AS target, sum(a1.w * b1.w) AS weight FROM a1 JOIN b1 USING (key) GROUP BY 1, 2) """


def _homology(s, d):
    return read(s, d, "gene_reference").select(F.col("db_class_key").alias("key"), F.col("ncbi_taxon_id").alias("taxon"), "symbol", "synonyms")


@query("orthology_table", _HOM + "SELECT source, target, round(weight, 6) AS weight FROM t", False)
def _(s, d):
    return rounded(orthology.conversion(_homology(s, d), "mouse", "human"))


@query("orthology_counts", CTE.replace("WITH x AS", _HOM + ", x AS", 1) + "SELECT x.obs, t.target AS var, round(sum(x.value * t.weight), 6) AS value FROM x JOIN t ON t.source = x.var GROUP BY 1, 2", False)
def _(s, d):
    return rounded(orthology.convert(clean_counts(s, d), orthology.conversion(_homology(s, d), "mouse", "human")))


@query("subsample_sizes", """SELECT category, CASE WHEN category = 'Arcuate lining' THEN n // 2 WHEN category = 'Dorsal mural' THEN 2 * n ELSE n END AS n FROM ncat""")
def _(s, d):
    return platform.subsample_annotation(labels(s, d), {"Dorsal m": 2.0, "Arcuate lining": 0.5}).groupBy("category").agg(F.sum("draws").alias("n"))


@query("distributed_totals", _PTS + "SELECT x.var AS gene, CAST(sum(x.value) AS BIGINT) AS n FROM x JOIN p ON p.obs = x.obs WHERE x.value >= 1 GROUP BY 1")
def _(s, d):
    return molecules.distribute_molecules(clean_counts(s, d), points(s, d).select("obs", "x", "y"), 1.0).groupBy("gene").agg(F.count("*").alias("n"))


@query("annotate_molecules")
def _(s, d):
    """Counts of all sections as molecules around their observations, the sections moved apart in the plane."""
    x, p = clean_counts(s, d), points(s, d)
    n = S.codes(p, ["sample", "section"], "c").select("obs", (F.col("x") + F.col("c") * 10000).alias("x"), "y")
    m = molecules.named_molecules(x, n, 2.0)
    return molecules.annotate_molecules(m, x, labels(s, d), 60.0, 2, "projection", deconvolution=False)


@query("stream_totals", "SELECT var, sum(value) AS total, count(*) AS entries FROM counts WHERE value > 0 AND NOT isnan(value) GROUP BY var", False)
def _(s, d):
    import uuid

    stream = incremental.running_totals(incremental.stream_table(s, f"{d}/counts.parquet"))
    return incremental.run_to_table(stream, f"totals_{uuid.uuid4().hex}")


@query("stream_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", False)
def _(s, d):
    import uuid

    e = incremental.stream_table(s, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    t = incremental.run_to_table(incremental.windowed_totals(e, "ts", "event_type"), f"windows_{uuid.uuid4().hex}")
    return t.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))



# tables behind figures
_COLORS = "c AS (SELECT annotation_key AS fine, lineage AS category, length(annotation_key) / 20.0 AS r, length(lineage) / 10.0 AS g, 0.5 AS b, 1.0 AS a FROM categories) "


def _colors(s, d):
    c = read(s, d, "categories")
    return c.select(F.col("annotation_key").alias("fine"), F.col("lineage").alias("category"), (F.length("annotation_key") / 20).alias("r"), (F.length("lineage") / 10).alias("g"), F.lit(0.5).alias("b"), F.lit(1.0).alias("a"))


@query("merge_colors", "WITH " + _COLORS + "SELECT category, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b, round(avg(a), 6) AS a FROM c GROUP BY category", False)
def _(s, d):
    c = _colors(s, d)
    return rounded(plotdata.merge_colors(c.drop("category"), c.select("fine", "category")))


@query("mix_colors", ", " + _COLORS + "SELECT w.obs, round(sum(w.weight * c.r) / sum(w.weight), 6) AS r, round(sum(w.weight * c.g) / sum(w.weight), 6) AS g, round(sum(w.weight * c.b) / sum(w.weight), 6) AS b FROM w JOIN c ON c.fine = w.category GROUP BY w.obs")
def _(s, d):
    return rounded(plotdata.mix_colors(sample_weights(s, d), _colors(s, d).select(F.col("fine").alias("category"), "r", "g", "b")))


@query("mix_colors_xyv")
def _(s, d):
    return plotdata.mix_colors(sample_weights(s, d), _colors(s, d).select(F.col("fine").alias("category"), "r", "g", "b"), "xyv")


@query("comparison", ", u AS (SELECT obs, category, 1.0 AS v FROM (SELECT *, row_number() OVER (PARTITION BY obs ORDER BY weight DESC, category) AS r FROM w) t WHERE r = 1) SELECT coalesce(w.obs, u.obs) AS obs, coalesce(w.category, u.category) AS category, round(coalesce(w.weight, 0), 6) AS a, coalesce(u.v, 0) AS b FROM w FULL JOIN u ON u.obs = w.obs AND u.category = w.category")
def _(s, d):
    from lodestone.operators.elementwise import argmax_label

    w = sample_weights(s, d)
    return rounded(plotdata.comparison(w, one_hot(argmax_label(w))))


@query("scatter_frame", _CENT + ", t AS (SELECT *, min(weight) OVER (PARTITION BY category) AS lo, max(weight) OVER (PARTITION BY category) AS hi FROM w) SELECT c.obs, round(c.x, 6) AS x, round(c.y, 6) AS y, t.category, round(CASE WHEN hi > lo THEN (weight - lo) / (hi - lo) ELSE 1 END, 6) AS share FROM c JOIN t ON t.obs = c.obs")
def _(s, d):
    return rounded(plotdata.scatter_frame(_centroids(s, d), sample_weights(s, d)))


@query("label_positions", _PTS + """, l AS (SELECT p.x, p.y, l.category FROM p JOIN lab l ON l.obs = p.obs),
rx AS (SELECT category, x, sum(count(*)) OVER (PARTITION BY category ORDER BY x) AS run, sum(count(*)) OVER (PARTITION BY category) AS t FROM l GROUP BY category, x),
ry AS (SELECT category, y, sum(count(*)) OVER (PARTITION BY category ORDER BY y) AS run, sum(count(*)) OVER (PARTITION BY category) AS t FROM l GROUP BY category, y)
SELECT category, min(x) AS x, (SELECT min(y) FROM ry WHERE ry.category = rx.category AND run >= t / 2) AS y FROM rx WHERE run >= t / 2 GROUP BY category""")
def _(s, d):
    return plotdata.label_positions(points(s, d), one_hot(labels(s, d)))


@query("annotated_heatmap", """, n AS (SELECT category, n, sum(n) OVER () AS a FROM ncat),
s AS (SELECT l.category, x.var, sum(ln(1 + x.value)) AS s, sum(ln(1 + x.value) ^ 2) AS q FROM x JOIN lab l ON l.obs = x.obs GROUP BY 1, 2),
g AS (SELECT v.var, n.category, n.n, n.a - n.n AS m, coalesce(s.s, 0) AS s, coalesce(s.q, 0) AS q FROM (SELECT DISTINCT var FROM s) v CROSS JOIN n LEFT JOIN s ON s.var = v.var AND s.category = n.category),
h AS (SELECT *, sum(s) OVER (PARTITION BY var) - s AS rs, sum(q) OVER (PARTITION BY var) - q AS rq FROM g),
t AS (SELECT category, var, (s / n - rs / m) / sqrt((q - s * s / n) / (n - 1) / n + (rq - rs * rs / m) / (m - 1) / m) AS t FROM h),
mk AS (SELECT category AS marker_of, var FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY t DESC, var) AS r FROM t WHERE t IS NOT NULL AND NOT isnan(t)) u WHERE r <= 2)
SELECT x.obs, l.category, x.var, mk.marker_of, round(ln(1 + x.value / tot.n * 10000), 5) AS value FROM x JOIN mk ON mk.var = x.var JOIN tot ON tot.obs = x.obs JOIN lab l ON l.obs = x.obs""")
def _(s, d):
    x, lab = clean_counts(s, d), labels(s, d)
    return rounded(plotdata.annotated_heatmap(x, lab, qc.rank_markers(x, lab, 2).select("var", "category")), 5)


@query("principal_components")
def _(s, d):
    return embedding.preprocess_single_cell(clean_counts(s, d), 50, 5)
