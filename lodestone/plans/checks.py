"""Queries that test what other operators give, where SQL cannot compute their results but can state what must hold of them.

Each runs the operator on its whole tables and returns what it must be: optimality conditions of least squares and
transport, sums and bounds of soft labels, sizes and totals of random draws, and closed tails of tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.frame import clean_counts, clean_obs, one_hot
from lodestone.operators import aggregate as A
from lodestone.operators import annotate as N
from lodestone.operators import cooccurrence as C
from lodestone.operators import elementwise as E
from lodestone.operators import graph, molecules, platform, qc, split
from lodestone.operators import similarity as D
from lodestone.operators import spatial as S
from lodestone.operators import stats as T
from lodestone.plans import matrix, space
from lodestone.plans.matrix import CTE, labels, rounded
from lodestone.runtime import cut

QUERIES, SQL = {}, {}


def query(name: str, sql: str, cte: bool = True):
    def register(f):
        QUERIES[name] = f
        SQL[name] = (CTE if cte else "") + sql
        return f

    return register


# annotation: halves as in ``space``
_HALF = """, v AS (SELECT DISTINCT var FROM x WHERE CAST(right(obs, 1) AS INT) < 5 INTERSECT SELECT DISTINCT var FROM x WHERE CAST(right(obs, 1) AS INT) >= 5),
d AS (SELECT DISTINCT obs FROM x WHERE CAST(right(obs, 1) AS INT) >= 5 AND var IN (SELECT var FROM v)) """


def least_squares(x: DataFrame, profiles: DataFrame, w: DataFrame) -> DataFrame:
    """(obs, optimal, total): whether the weights, up to their scale, meet the conditions of non-negative least squares: no
    category would lower the squares by growing, and those with weight neither by growing nor shrinking."""
    fit = w.join(profiles, "category").groupBy("obs", "var").agg(F.sum(F.col("weight") * F.col("p")).alias("r"))
    both = x.join(fit, ["obs", "var"], "full").fillna(0.0, ["value", "r"])
    size = both.groupBy("obs").agg((F.sum(F.col("value") * F.col("r")) / F.sum(F.col("r") ** 2)).alias("s"), F.sqrt(F.sum(F.col("value") ** 2)).alias("norm"))
    rest = both.join(size, "obs").select("obs", "var", "norm", (F.col("s") * F.col("r") - F.col("value")).alias("e"))
    length = profiles.groupBy("category").agg(F.sqrt(F.sum(F.col("p") ** 2)).alias("length"))
    slope = rest.join(profiles, "var").groupBy("obs", "category").agg(F.sum(F.col("e") * F.col("p")).alias("g"), F.first("norm").alias("norm")).join(F.broadcast(length), "category")  # a row a category
    slope = slope.withColumn("g", F.col("g") / (F.col("norm") * F.col("length")))
    held = slope.join(w, ["obs", "category"], "left").groupBy("obs").agg(F.min(F.when(F.col("weight").isNull(), F.col("g") > -1e-6).otherwise(F.abs("g") < 1e-6)).alias("optimal"))
    return held.join(w.groupBy("obs").agg(F.round(F.sum("weight"), 6).alias("total")), "obs").select("obs", "optimal", "total")


@query("annotate_nnls_optimal", _HALF + "SELECT obs, true AS optimal, 1.0 AS total FROM d")
def _(s, d):
    x, ref, lab = space._halves(s, d)
    return least_squares(x, A.reference_profiles(ref, lab), cut(N.annotate(x, ref, lab, "nnls")))


@query("annotate_projection_optimal", _HALF + "SELECT obs, true AS optimal, 1.0 AS total FROM d")
def _(s, d):
    """Overlaps as values, the profiles' own overlaps as profiles."""
    x, ref, lab = space._halves(s, d)
    p = cut(A.reference_profiles(ref, lab).select(F.col("category").alias("obs"), "var", F.col("p").alias("value")))
    values = D.overlap(x, p, "bc2").select(F.col("i").alias("obs"), F.col("j").alias("var"), "value")
    own = D.overlap(p, p, "bc2").select(F.col("j").alias("var"), F.col("i").alias("category"), F.col("value").alias("p"))
    return least_squares(cut(values), cut(own), cut(N.annotate(x, ref, lab, "projection", platform_iterations=-1)))


@query("annotate_ot_optimal", _HALF + "SELECT obs, true AS optimal, 1.0 AS total FROM d")
def _(s, d):
    """ln w + cost / epsilon - lambda / epsilon (ln b - ln m) is one number over the categories of an observation, where m are
    the categories' masses in the plan."""
    x, ref, lab = space._halves(s, d)
    w = cut(N.annotate(x, ref, lab, "OT", bisections=0, platform_iterations=-1))
    p = A.reference_profiles(ref, lab).select(F.col("category").alias("obs"), "var", F.col("p").alias("value"))
    cost = cut(D.cdist(x, p, "h2"))
    top = cost.agg(F.max("distance").alias("top"))
    mass = A.get_sum(x).crossJoin(F.broadcast(x.agg(F.sum("value").alias("t")))).select("obs", (F.col("total") / F.col("t")).alias("a"))
    prior = A.category_priors(ref, lab.withColumn("weight", F.lit(1.0)))
    got = w.join(mass, "obs").groupBy("category").agg(F.sum(F.col("weight") * F.col("a")).alias("m")).join(prior, "category").select("category", (F.lit(0.1 / 5e-3) * (F.log("prior") - F.log("m"))).alias("v"))
    each = w.filter("weight > 1e-10").join(cost.withColumnRenamed("i", "obs").withColumnRenamed("j", "category"), ["obs", "category"]).crossJoin(F.broadcast(top)).join(F.broadcast(got), "category")  # a row a category
    c = F.log("weight") + F.col("distance") / F.col("top") / 5e-3 - F.col("v")
    spread = each.groupBy("obs").agg((F.max(c) - F.min(c) < 1e-4).alias("optimal"))
    return spread.join(w.groupBy("obs").agg(F.round(F.sum("weight"), 6).alias("total")), "obs")


def _sums(name: str, run) -> None:
    @query(name, _HALF + "SELECT obs, 1.0 AS total, true AS fine FROM d")
    def _(s, d):
        x, ref, lab = space._halves(s, d)
        w = run(x, ref, lab)
        known = labels(s, d).select("category").distinct().withColumn("known", F.lit(True))
        w = w.join(F.broadcast(known), "category", "left")  # a row a category
        return w.groupBy("obs").agg(F.round(F.sum("weight"), 6).alias("total"), F.bool_and(F.coalesce("known", F.lit(False)) & (F.col("weight") > 0)).alias("fine"))


_sums("annotate_svm_sums", lambda x, ref, lab: N.annotate(x, ref, lab, "svm"))
_sums("annotate_nmf_sums", lambda x, ref, lab: N.annotate(x, ref, lab, "NMFreg"))
_sums("annotate_wot_sums", lambda x, ref, lab: N.annotate(x, ref, lab, "WOT"))
_sums("annotate_novosparc_sums", lambda x, ref, lab: N.annotate(x, ref, lab, "novosparc"))
_sums("annotate_ot_sums", lambda x, ref, lab: N.annotate(x, ref, lab))
_sums("annotate_platform_sums", lambda x, ref, lab: N.annotate(x, ref, lab, "nnls", platform_iterations=1, normalize_to="reference"))
_sums("annotate_multi_center_sums", lambda x, ref, lab: N.annotate(x, ref, lab, "nnls", multi_centers=3, multi_center_amplitudes=False, prior=A.category_priors(ref, one_hot(lab))))


@query("bisection_rounds", """, ref AS (SELECT * FROM lab WHERE CAST(right(obs, 1) AS INT) < 5)""" + _HALF + """
SELECT obs, 1.0 AS total, CAST(4 AS BIGINT) AS categories FROM d""")
def _(s, d):
    """A method that gives all weight to the r-th category in round r: 2 bisections by 3 are 4 rounds of 1/3 and three times 2/9."""
    x, ref, lab = space._halves(s, d)
    names = [r[0] for r in lab.select("category").distinct().orderBy("category").collect()]  # few categories
    calls: list[str] = []

    def method(a: DataFrame, p: DataFrame, q: DataFrame) -> DataFrame:
        calls.append(names[len(calls)])
        return a.select("obs").distinct().select("obs", F.lit(calls[-1]).alias("category"), F.lit(1.0).alias("weight"))

    w = N.annotate(x, ref, lab, method, bisections=2, bisection_divisor=3)
    shares = dict(zip(names, (1 / 3, 2 / 9, 2 / 9, 2 / 9)))
    fine = F.coalesce(*[F.when(F.col("category") == n, F.abs(F.col("weight") - v) < 1e-6) for n, v in shares.items()], F.lit(False))
    return w.filter(fine).groupBy("obs").agg(F.round(F.sum("weight"), 6).alias("total"), F.count("*").alias("categories"))


@query("annotate_filtered", _HALF + """, ref AS (SELECT x.* FROM x WHERE CAST(right(obs, 1) AS INT) < 5 AND var IN (SELECT var FROM v)),
dat AS (SELECT x.* FROM x JOIN d USING (obs) WHERE var IN (SELECT var FROM v)),
g AS (SELECT var FROM ref GROUP BY var HAVING sum(value) >= 50 INTERSECT SELECT var FROM dat GROUP BY var HAVING sum(value) >= 50)
SELECT dat.obs, 1.0 AS total FROM dat WHERE var IN (SELECT var FROM g) GROUP BY dat.obs""")
def _(s, d):
    return N.annotate(*space._halves(s, d), "nnls", min_counts_per_gene=50).groupBy("obs").agg(F.round(F.sum("weight"), 6).alias("total"))


@query("annotation_reconstruction", _HALF + """, k AS (SELECT x.obs, sum(x.value) AS n FROM x JOIN d USING (obs) WHERE var IN (SELECT var FROM v) GROUP BY 1)
SELECT obs, round(n, 3) AS n FROM k""")
def _(s, d):
    """Counts that the sub-categories' weights and profiles imply add up to the observation's reads."""
    x, ref, lab = space._halves(s, d)
    a = N.annotation(x, ref, lab, "nnls", multi_centers=2)
    return rounded(split.reconstruct(x, a.parts, a.profiles, a.mapping.withColumnRenamed("category", "main").withColumnRenamed("main", "category")).groupBy("obs").agg(F.sum("value").alias("n")), 3)


@query("annotation_gene_values", """, ref AS (SELECT * FROM x WHERE CAST(right(obs, 1) AS INT) < 5), dat AS (SELECT * FROM x WHERE CAST(right(obs, 1) AS INT) >= 5),
a AS (SELECT var, sum(value) AS s FROM ref GROUP BY 1), b AS (SELECT var, sum(value) AS t FROM dat GROUP BY 1), j AS (SELECT * FROM a JOIN b USING (var))
SELECT var, round(t / (SELECT sum(t) FROM j) * (SELECT sum(s) FROM j), 3) AS value FROM j""")
def _(s, d):
    """Reads by variable of the reference, scaled along with the platform: the data's shares of the reference's reads."""
    x, ref, lab = space._halves(s, d)
    values = ref.groupBy("var").agg(F.sum("value").alias("value"))
    return rounded(N.annotation(x, ref, lab, "nnls", platform_iterations=0, gene_values={"reads": values}).gene_values["reads"], 3)


@query("platform_factors", """, ref AS (SELECT * FROM x WHERE CAST(right(obs, 1) AS INT) < 5), dat AS (SELECT * FROM x WHERE CAST(right(obs, 1) AS INT) >= 5),
b AS (SELECT var, sum(value) AS s FROM ref GROUP BY 1), a AS (SELECT var, sum(value) AS t FROM dat GROUP BY 1), j AS (SELECT * FROM a JOIN b USING (var))
SELECT var, round((s / (SELECT sum(s) FROM j)) / (t / (SELECT sum(t) FROM j)), 6) AS factor FROM j""")
def _(s, d):
    a, b, _ = space._halves(s, d)
    return rounded(platform.normalize_platform(a, None, b, return_factors=True))


# draws and simulations
@query("random_platform_effect", "SELECT var, count(*) AS entries, true AS one_factor FROM x GROUP BY var")
def _(s, d):
    x = clean_counts(s, d)
    y, factors = platform.random_platform_effect(x)
    both = y.join(x.withColumnRenamed("value", "before"), ["obs", "var"]).join(factors, "var")
    return both.groupBy("var").agg(F.count("*").alias("entries"), F.bool_and(F.abs(F.col("value") - F.col("before") * F.col("factor")) <= 1e-9 * F.col("value")).alias("one_factor"))


@query("subsample_annotation", """SELECT category, CASE WHEN category = 'Arcuate lining' THEN n // 2 ELSE n END AS observations, CASE WHEN category = 'Dorsal mural' THEN 2 ELSE 1 END AS least,
CASE WHEN category = 'Dorsal mural' THEN 2 ELSE 1 END AS most FROM ncat""")
def _(s, d):
    r = platform.subsample_annotation(labels(s, d), {"Dorsal m": 2.0, "Arcuate lining": 0.5})
    return r.groupBy("category").agg(F.count_distinct("obs").alias("observations"), F.min("draws").cast("int").alias("least"), F.max("draws").cast("int").alias("most"))


@query("distribute_molecules", space._PTS + "SELECT x.obs, x.var AS gene, CAST(floor(x.value) AS BIGINT) AS n, true AS near FROM x JOIN p ON p.obs = x.obs WHERE x.value >= 1")
def _(s, d):
    p = space.points(s, d).select("obs", "x", "y")
    m = molecules.distribute_molecules(clean_counts(s, d), p, 1.0).join(p.select("obs", F.col("x").alias("cx"), F.col("y").alias("cy")), "obs")
    return m.groupBy("obs", "gene").agg(F.count("*").alias("n"), F.bool_and(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) < 9).alias("near"))


@query("mix_in_silico_sums", "SELECT true AS shares, true AS whole, true AS enough")
def _(s, d):
    x, w = molecules.mix_in_silico(clean_counts(s, d), labels(s, d))
    a = w.groupBy("obs").agg(F.abs(F.sum("weight") - 1).alias("off")).agg((F.max("off") < 1e-9).alias("shares"))
    b = x.groupBy("obs").agg(F.sum("value").alias("n"), F.max(F.abs(F.col("value") - F.rint("value"))).alias("part")).agg((F.max("part") == 0).alias("whole"), (F.min("n") >= 100).alias("enough"))
    return a.crossJoin(b)


@query("bead_profiles", "SELECT shape, true AS reads_kept FROM (VALUES ('gauss'), ('disc'), ('0.1')) t(shape)", False)
def _(s, d):
    """With weights over the profile's integral, beads gather on average as many reads as the plane has where they lie."""
    x, lab = clean_counts(s, d), labels(s, d)
    want = x.join(lab, "obs").agg(F.sum("value")).first()[0] / lab.count()
    out = []
    for shape in ("gauss", "disc", "0.1"):
        got, _ = molecules.mix_in_silico(x, lab, 2000, 4.0, shape, capture_rate=None, round=False, min_counts=None)
        mean = got.agg(F.sum("value")).first()[0] / 2000
        out.append((shape, abs(mean / want - 1) < 0.1))
    return s.createDataFrame(out, "shape string, reads_kept boolean")


@query("split_exact_whole", space._MIX + "SELECT obs, var, CAST(value AS BIGINT) AS value, true AS whole FROM mx")
def _(s, d):
    out = split.split_observations(*space._mixture(s, d))
    return out.groupBy("obs", "var").agg(F.sum("value").cast("long").alias("value"), F.bool_and((F.col("value") > 0) & (F.col("value") == F.rint("value"))).alias("whole"))


# graphs
_REACH = space._near(25) + """, reach AS (SELECT obs AS node, obs AS seen FROM p UNION SELECT r.node, n.j FROM reach r JOIN near n ON n.i = r.seen),
comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node) """


@query("spectral_parts", _REACH + "SELECT component, count(*) AS nodes, true AS small, true AS inside FROM comp GROUP BY component")
def _(s, d):
    """Clusters of at most 50 nodes, each within one connected component."""
    p = space.points(s, d)
    near = S.sparse_distances(p, 25.0, ["sample", "section"])
    c = graph.spectral_clustering(S.affinity(near, 10.0), p.select("obs"), 50)
    comp = graph.connected_components(near.select("i", "j"), p.select("obs"))
    each = c.join(comp, "node").groupBy("cluster").agg(F.count("*").alias("n"), F.min("component").alias("component"), F.max("component").alias("other"))
    return each.groupBy("component").agg(F.sum("n").alias("nodes"), F.bool_and(F.col("n") <= 50).alias("small"), F.bool_and(F.col("component") == F.col("other")).alias("inside"))


SQL["spectral_parts"] = SQL["spectral_parts"].replace("WITH x AS", "WITH RECURSIVE x AS", 1)


@query("co_occurrence_soft", space._near(60) + """, l AS (SELECT p.obs, p.sample, p.category FROM p WHERE p.category IS NOT NULL),
la AS (SELECT obs, sample, category, 0.8 AS weight FROM l UNION ALL SELECT obs, sample, 'other', 0.2 FROM l),
cnt AS (SELECT a.sample, a.category AS annotation, b.category AS center, CAST(2 - floor((60 - distance) / 20) AS INTEGER) AS k, sum(a.weight) AS c FROM near JOIN la a ON a.obs = i JOIN l b ON b.obs = j GROUP BY 1, 2, 3, 4),
f AS (SELECT s.sample, a.category AS annotation, b.category AS center, t.k, CAST(coalesce(cnt.c, 0) AS DOUBLE) AS c
  FROM (SELECT DISTINCT sample FROM l) s CROSS JOIN (SELECT DISTINCT category FROM la) a CROSS JOIN (SELECT DISTINCT category FROM l) b CROSS JOIN (SELECT CAST(unnest(range(3)) AS INTEGER) AS k) t
  LEFT JOIN cnt ON cnt.sample = s.sample AND cnt.annotation = a.category AND cnt.center = b.category AND cnt.k = t.k),
sc AS (SELECT *, (c + 1) / sum(c + 1) OVER (PARTITION BY sample, k, center) AS composition, sum(c + 1) OVER (PARTITION BY sample, k, annotation) / sum(c + 1) OVER (PARTITION BY sample, k) AS overall FROM f)
SELECT sample, annotation, center, k, round(c, 7) AS c, round(composition / overall, 7) AS occ, round(composition, 7) AS composition FROM sc
UNION ALL SELECT NULL, annotation, center, k, round(sum(c), 7), round(avg(composition / overall), 7), round(avg(composition), 7) FROM sc GROUP BY annotation, center, k""")
def _(s, d):
    """Annotations with a fifth of a common category, around hard centers."""
    lab = one_hot(labels(s, d))
    soft = lab.select("obs", "category", F.lit(0.8).alias("weight")).unionByName(lab.select("obs", F.lit("other").alias("category"), F.lit(0.2).alias("weight")))
    return rounded(C.co_occurrence(space.points(s, d), soft, 60.0, 20.0, lab).drop("lo", "hi"), 7)


# filters to a fixpoint, unrolled
def _fixpoint(rounds: int = 12) -> str:
    out = ", f0 AS (SELECT * FROM x)"
    for k in range(rounds):
        out += f""", g{k} AS (SELECT var FROM f{k} GROUP BY var HAVING sum(value) >= 20 AND count(*) >= 10 AND (count(*) < (SELECT count(DISTINCT obs) FROM f{k}) OR min(value) < max(value))),
h{k} AS MATERIALIZED (SELECT * FROM f{k} WHERE var IN (SELECT var FROM g{k})), c{k} AS (SELECT obs FROM h{k} GROUP BY obs HAVING sum(value) >= 60 AND count(*) >= 15),
f{k + 1} AS MATERIALIZED (SELECT * FROM h{k} WHERE obs IN (SELECT obs FROM c{k}))"""
    return out + f" SELECT obs, var, value FROM f{rounds}"


@query("qc_fixpoint", _fixpoint())
def _(s, d):
    return qc.filter_fixpoint([clean_counts(s, d)], min_counts_per_gene=20, min_counts_per_cell=60, min_cells_per_gene=10, min_genes_per_cell=15)[0]


# tests: tails in closed form or by Simpson's rule
_LC = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1))".format
_HYPER = f"exp({_LC('col', 'k')} + {_LC('(total - col)', '(r - k)')} - {_LC('total', 'r')})"


def _fisher(tables: str) -> str:
    """(value, group, enrichment, p) of a CTE t(value, grp, a, b, c, d)."""
    return f"""{tables}, m AS (SELECT *, a + b AS r, a + c AS col, a + b + c + d AS total FROM t), u AS (SELECT *, unnest(range(greatest(0, r + col - total), least(r, col) + 1)) AS k FROM m),
q AS (SELECT value, grp, 'enriched' AS enrichment, least(1, sum({_HYPER}) FILTER (k >= a)) AS p FROM u GROUP BY 1, 2 UNION ALL SELECT value, grp, 'purified', least(1, sum({_HYPER}) FILTER (k <= a)) FROM u GROUP BY 1, 2),
z AS (SELECT *, row_number() OVER (ORDER BY p, value, grp, enrichment) AS i, count(*) OVER () AS n FROM q),
adj AS (SELECT value, grp AS "group", enrichment, p, least(1, min(p * n / i) OVER (ORDER BY i DESC)) AS p_adjusted FROM z) """


_TABLES = """, cc AS (SELECT o.category AS value, o.{0} AS grp, count(*) AS a FROM o WHERE o.category IS NOT NULL AND o.{0} IS NOT NULL GROUP BY 1, 2),
gg AS (SELECT v.value, h.grp, coalesce(cc.a, 0) AS a FROM (SELECT DISTINCT value FROM cc) v CROSS JOIN (SELECT DISTINCT grp FROM cc) h LEFT JOIN cc ON cc.value = v.value AND cc.grp = h.grp),
t AS (SELECT value, grp, a, CAST(sum(a) OVER (PARTITION BY value) - a AS BIGINT) AS b, CAST(sum(a) OVER (PARTITION BY grp) - a AS BIGINT) AS c, CAST(sum(a) OVER () - sum(a) OVER (PARTITION BY value) - sum(a) OVER (PARTITION BY grp) + a AS BIGINT) AS d FROM gg)""".format


@query("enrichment_fisher", _fisher(_TABLES("section")) + 'SELECT value, "group", enrichment, round(p, 8) AS p, round(p_adjusted, 8) AS p_adjusted FROM adj')
def _(s, d):
    return rounded(T.fisher_enrichment(matrix.QUERIES["contingency"](s, d)), 8)


@query("significances", _fisher(_TABLES("sample")) + """, b AS (SELECT *, row_number() OVER (PARTITION BY value, "group" ORDER BY p_adjusted, enrichment) AS k FROM adj)
SELECT value, "group", round(p_adjusted, 7) AS p, CASE WHEN p_adjusted > 0.05 THEN 0 ELSE round(CASE WHEN enrichment = 'enriched' THEN -1 ELSE 1 END * ln(greatest(p_adjusted, 1e-300)), 5) END AS signed FROM b WHERE k = 1""")
def _(s, d):
    from lodestone.operators import plotdata

    o = clean_obs(s, d)
    t = T.fisher_enrichment(T.contingency(o.select("obs", F.col("category").alias("value")), o.select("obs", F.col("sample").alias("group"))))
    return plotdata.significance_map(t).select("value", "group", F.round("p", 7).alias("p"), F.round("signed", 5).alias("signed"))


@query("over_representation", """WITH g AS (SELECT DISTINCT symbol AS gene, left(symbol, 1) AS term FROM gene_reference WHERE ncbi_taxon_id = 9606), st AS (SELECT DISTINCT symbol AS gene FROM gene_reference WHERE ncbi_taxon_id = 9606 AND synonyms IS NOT NULL),
tt AS (SELECT count(DISTINCT gene) AS total, (SELECT count(*) FROM st) AS r FROM g), per AS (SELECT term, count(*) AS col, count(st.gene) AS a FROM g LEFT JOIN st USING (gene) GROUP BY term HAVING count(st.gene) > 0),
u AS (SELECT per.*, tt.*, unnest(range(a, least(r, col) + 1)) AS k FROM per CROSS JOIN tt), """ + f"""q AS (SELECT term, any_value(a) AS a, any_value(col) AS n_term, least(1, sum({_HYPER})) AS p FROM u GROUP BY term),
z AS (SELECT *, row_number() OVER (ORDER BY p, term) AS i, count(*) OVER () AS n FROM q)
SELECT term, a, n_term, round(p, 8) AS p, round(least(1, min(p * n / i) OVER (ORDER BY i DESC)), 8) AS p_adjusted FROM z""", False)
def _(s, d):
    g = space._homology(s, d).filter("taxon = 9606")
    members = g.select(F.col("symbol").alias("gene"), F.left("symbol", F.lit(1)).alias("term"))
    return rounded(T.over_representation(members, g.filter("synonyms is not null").select(F.col("symbol").alias("gene")), g.select(F.col("symbol").alias("gene")), alpha=1.1), 8)


_SIDES = """, s AS (SELECT category AS value, CASE WHEN CAST(right(obs, 1) AS INT) % 2 = 0 THEN 'even' ELSE 'odd' END AS grp, weight AS x FROM w),
e AS (SELECT value, grp, CAST(count(*) AS DOUBLE) AS n, avg(x) AS m, var_samp(x) AS v FROM s GROUP BY 1, 2),
pr AS (SELECT a.value, a.grp, a.n AS n1, b.n AS n2, a.m AS m1, b.m AS m2, a.v AS v1, b.v AS v2 FROM e a JOIN e b ON a.value = b.value AND a.grp <> b.grp
  WHERE (SELECT max(x) > min(x) FROM s WHERE s.value = a.value)), """
#: P(T > t) with nu degrees of freedom: a half less the integral of cos(u)^(nu - 1) up to atan(t / sqrt(nu)).
_TAIL = """, st AS (SELECT *, atan(t / sqrt(nu)) AS top FROM tv WHERE t IS NOT NULL AND NOT isnan(t)),
ig AS (SELECT value, grp, any_value(top) / 1200 * sum(CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(cos(top * i / 400.0), nu - 1)) AS s, any_value(nu) AS nu FROM st CROSS JOIN range(0, 401) r(i) GROUP BY 1, 2),
pv AS (SELECT value, grp, 0.5 - exp(lgamma((nu + 1) / 2) - lgamma(nu / 2)) / sqrt(pi()) * s AS p FROM ig),
q AS (SELECT value, grp, 'enriched' AS enrichment, p FROM pv UNION ALL SELECT value, grp, 'purified', 1 - p FROM pv),
z AS (SELECT *, row_number() OVER (ORDER BY p, value, grp, enrichment) AS i, count(*) OVER () AS n FROM q)
SELECT value, grp AS "group", enrichment, round(p, 6) AS p, round(least(1, min(p * n / i) OVER (ORDER BY i DESC)), 6) AS p_adjusted FROM z"""
_T = {
    "t": "tv AS (SELECT value, grp, n1 + n2 - 2 AS nu, (m1 - m2) / sqrt(((n1 - 1) * coalesce(v1, 0) + (n2 - 1) * coalesce(v2, 0)) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)) AS t FROM pr)",
    "welch": "tv AS (SELECT value, grp, pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS nu, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t FROM pr WHERE n1 > 1 AND n2 > 1)",
}
for _m, _sql in _T.items():
    query(f"enrichment_{_m}", _SIDES + _sql + _TAIL)(lambda s, d, m=_m: rounded(T.enrichment(matrix._samples(s, d), m).filter("p is not null"), 6))


@query("enrichments_welch", """, s AS (SELECT c.category AS value, CASE WHEN CAST(right(o.obs, 1) AS INT) % 2 = 0 THEN 'even' ELSE 'odd' END AS grp, coalesce(w.weight, 0) AS x
  FROM (SELECT DISTINCT obs FROM w) o CROSS JOIN (SELECT DISTINCT category FROM w) c LEFT JOIN w ON w.obs = o.obs AND w.category = c.category),
""" + _SIDES.split("),\n", 1)[1] + _T["welch"] + _TAIL)
def _(s, d):
    """Shares of labels in samples, compared between samples of even and odd names."""
    o = clean_obs(s, d).filter("sample is not null and category is not null")
    g = o.select("obs", F.when(F.right("sample", F.lit(1)).cast("int") % 2 == 0, "even").otherwise("odd").alias("group"), "sample")
    return rounded(T.enrichments(one_hot(o.select("obs", "category")), g, "welch", reduction="sum", normalization="sum").filter("p is not null"), 6)


@query("contributions_clr_counts", matrix._GRID + "SELECT \"group\", sample, value_key, round(ln(c + 1) - avg(ln(c + 1)) OVER (PARTITION BY \"group\", sample), 6) AS contribution FROM f")
def _(s, d):
    return rounded(A.contributions(one_hot(labels(s, d)), matrix._groups(s, d), "sum", "clr", zeros="auto"))


@query("contributions_reads", matrix._GRID + """, r AS (SELECT g.grp, g.sample, l.category, sum(t.n) AS c FROM g JOIN lab l ON l.obs = g.obs JOIN tot t ON t.obs = g.obs GROUP BY 1, 2, 3)
SELECT k.grp AS "group", k.sample, k.category AS value_key, coalesce(r.c, 0) AS contribution FROM k LEFT JOIN r ON r.grp = k.grp AND r.sample = k.sample AND r.category = k.category""")
def _(s, d):
    return A.contributions(one_hot(labels(s, d)), matrix._groups(s, d), "sum", reads=A.get_sum(clean_counts(s, d)))


@query("contributions_split", space._PTS + """, g AS (SELECT obs, CAST(section AS VARCHAR) AS grp, sample, x FROM p), r AS (SELECT sample, x, row_number() OVER (PARTITION BY sample ORDER BY x) AS k, count(*) OVER (PARTITION BY sample) AS m FROM g),
cu AS (SELECT sample, avg(x) AS c FROM r WHERE m >= 2 AND k IN (CAST(round_even(m / 2.0, 0) AS INT), CAST(round_even(m / 2.0, 0) AS INT) + 1) GROUP BY sample),
h AS (SELECT g.obs, g.grp, g.sample || '|' || CASE WHEN cu.c < g.x THEN '1' ELSE '0' END AS sample FROM g JOIN cu USING (sample)),
k AS (SELECT a.grp, a.sample, c.category FROM (SELECT DISTINCT grp, sample FROM h) a CROSS JOIN (SELECT DISTINCT category FROM lab) c), n AS (SELECT h.grp, h.sample, l.category, count(*) AS c FROM h JOIN lab l ON l.obs = h.obs GROUP BY 1, 2, 3)
SELECT k.grp AS "group", k.sample, k.category AS value_key, CAST(coalesce(n.c, 0) AS DOUBLE) AS contribution FROM k LEFT JOIN n ON n.grp = k.grp AND n.sample = k.sample AND n.category = k.category""")
def _(s, d):
    p = space.points(s, d)
    return A.contributions(one_hot(labels(s, d)), p.select("obs", F.col("section").alias("group"), "sample"), "sum", positions=p, position_split=(2, 1))


@query("wide_shares", "SELECT obs, category, round(weight, 6) AS weight FROM w")
def _(s, d):
    w = matrix.sample_weights(s, d)
    names = sorted(r[0] for r in w.select("category").distinct().collect())  # few categories
    return rounded(A.lengthen(A.widen(w, "obs", "category", "weight", names), "obs", "category", "weight"))


@query("merge_layers", "SELECT x.obs, x.var, c.lineage AS layer, x.value FROM x JOIN lab l ON l.obs = x.obs JOIN categories c ON c.annotation_key = l.category JOIN tot t ON t.obs = x.obs WHERE t.n >= 150")
def _(s, d):
    layers = E.relabel(labels(s, d), matrix.lineages(s, d)).select("obs", F.col("category").alias("layer"))
    return A.merge_layers(clean_counts(s, d).join(layers, "obs").select("obs", "var", "layer", "value"), min_reads=150)


@query("region_graph", space._PTS + """, k AS (SELECT p.category, count(*) AS n FROM p WHERE p.category IS NOT NULL GROUP BY 1)
SELECT category, CAST(2 * sum(greatest(0, n - d)) AS BIGINT) AS links, true AS alike FROM k CROSS JOIN range(1, 4) r(d) GROUP BY category""")
def _(s, d):
    """Links in label space: of n observations of a label, in order, n - 1, n - 2 and n - 3 pairs, both ways."""
    lab = one_hot(labels(s, d).join(space.points(s, d).select("obs"), "obs", "left_semi"))
    e = graph.label_neighbours(lab, 6)
    at = lab.select(F.col("obs").alias("i"), "category").join(e, "i").join(lab.select(F.col("obs").alias("j"), F.col("category").alias("other")), "j")
    return at.groupBy("category").agg(F.count("*").alias("links"), F.bool_and(F.col("category") == F.col("other")).alias("alike"))


@query("region_cover", space._PTS + "SELECT obs, true AS named FROM p")
def _(s, d):
    """Every point with coordinates lies in one region, which is named by one of its points."""
    r = cut(space.QUERIES["find_regions"](s, d))
    names = r.select(F.col("obs").alias("region"), F.col("region").alias("own"))
    return r.join(names, "region", "left").select("obs", F.coalesce(F.col("own") == F.col("region"), F.lit(False)).alias("named"))
