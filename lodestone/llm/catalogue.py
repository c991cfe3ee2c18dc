"""Queries of the training-data problems for text and vectors, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.clusters import assign, describe, plain
from lodestone.llm.mixing import mix
from lodestone.llm.names import map_records
from lodestone.llm.neighbours import alike, nearest
from lodestone.llm.packing import pack, packing_report
from lodestone.llm.pii import find_items, redact
from lodestone.llm.sampling import canonical, draw
from lodestone.llm.tokens import with_tokens
from lodestone.llm.vectors import dense
from lodestone.operators.multivalue import split_values
from lodestone.operators.nearby import latest
from lodestone.runtime import cut, read

CAPACITY = 1024


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(*dense(read(spark, sf_dir, "counts")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alike(*dense(read(spark, sf_dir, "counts")), 0.97)


def _clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """As many clusters as categories."""
    categories = read(spark, sf_dir, "categories")
    k = categories.select("annotation_key").distinct().count()
    labels = latest(read(spark, sf_dir, "obs").select("obs", "annotation_key", "loaded_at"), "obs", "loaded_at")
    labels = labels.select(F.col("obs").alias("k"), F.col("annotation_key").alias("label"))
    assigned = cut(assign(*dense(read(spark, sf_dir, "counts")), k))
    return describe(assigned, labels, categories)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, clusters = _clusters(spark, sf_dir)
    most = clusters.select("cluster", F.col("prevailing_label").alias("annotation_key"), F.col("p").alias("most"))
    odd = members.filter("listed").join(F.broadcast(most), "cluster")  # one row for each cluster
    return odd.filter(~F.col("p").eqNullSafe(F.col("most"))).select(F.col("k").alias("obs"), "annotation_key")


def p2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir)[1].drop("p")


def p5_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, genes = read(spark, sf_dir, "hom_allorganism"), read(spark, sf_dir, "gene_reference")
    also = genes.select(F.col("db_class_key").alias("key"), F.explode(F.split("synonyms", r"\|")).alias("name"), F.lit(False).alias("symbol"))
    reference = genes.select(F.col("db_class_key").alias("key"), F.col("symbol").alias("name"), F.lit(True).alias("symbol")).unionByName(also)
    synonyms = split_values(records, "rec_id", "synonyms", "name").withColumnRenamed("rec_id", "id")
    return map_records(records.select(F.col("rec_id").alias("id"), F.col("symbol").alias("name"), F.col("db_class_key").alias("key")), reference, synonyms)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_mapped(spark, sf_dir).select(F.col("id").alias("rec_id"), F.col("key").alias("db_class_key"))


def _targets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    categories = read(spark, sf_dir, "categories")
    now = latest(read(spark, sf_dir, "obs").select("obs", "sample", "section", "annotation_key", "loaded_at"), "obs", "loaded_at")
    spelled = categories.select(plain(F.col("annotation_key")).alias("p"), F.col("annotation_key").alias("name")).groupBy("p").agg(F.min("name").alias("name"))
    records = now.withColumn("p", plain(F.col("annotation_key"))).join(spelled, "p", "left").select(F.col("obs").alias("i"), "sample", F.col("name").alias("annotation_key"), F.col("section").cast("string").alias("section"))
    plan = canonical(read(spark, sf_dir, "subsample_plan"), "annotation_key", categories, "annotation_key", plain)
    targets = plan.select(F.col("draw_id").alias("draw"), "sample", F.lit("annotation_key").alias("attribute"), F.col("annotation_key").alias("category"), F.col("target_share").alias("share"), F.col("draw_size").alias("size"), F.col("n_min").alias("minimum"))
    return records, targets


def _draws(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return draw(*_targets(spark, sf_dir), ["annotation_key"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _draws(spark, sf_dir)[1].filter("short").select(F.col("draw").alias("draw_id"), F.col("category").alias("annotation_key"))


def p6_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws with targets for the categories and, in equal parts, for the sections of the sample at once."""
    records, targets = _targets(spark, sf_dir)
    sections = records.filter("section is not null").select("sample", F.col("section").alias("category")).distinct()
    shares = sections.join(sections.groupBy("sample").agg(F.count("*").alias("n")), "sample").select("sample", "category", (1 / F.col("n")).alias("share"))
    also = targets.groupBy("draw", "sample").agg(F.max("size").alias("size")).join(shares, "sample").select("draw", "sample", F.lit("section").alias("attribute"), "category", "share", "size", F.lit(0).cast("long").alias("minimum"))
    return draw(records, targets.unionByName(also), ["annotation_key", "section"])[1].withColumnRenamed("draw", "draw_id")


def p6_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _draws(spark, sf_dir)[0].select(F.col("draw").alias("draw_id"), F.col("i").alias("obs"))


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was drawn, with the fields that an earlier run recorded: all, modification and new."""
    r = _draws(spark, sf_dir)[1]
    return r.select(F.col("draw").alias("draw_id"), F.col("category").alias("annotation_key"), "wanted", F.col("available").alias("n_all"), F.try_divide(F.col("drawn"), F.col("available")).alias("modification"), F.col("drawn").alias("n_new"), F.col("share").alias("target_share"), "actual_share", "short")


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(with_tokens(read(spark, sf_dir, "documents"), "text", ["doc_id"]), "doc_id", "n_tokens", CAPACITY)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_packed(spark, sf_dir).filter("parts > 1 and part = 1").select("doc_id").distinct()


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_report(p7_packed(spark, sf_dir), CAPACITY)


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = with_tokens(read(spark, sf_dir, "documents"), "text", ["doc_id", "source"])
    return mix(docs, read(spark, sf_dir, "source_weights"), "doc_id", "source", "n_tokens", "word_share")


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(_mixture(spark, sf_dir)[1]).filter("short").select("source")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(read(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "kind", "found").distinct()


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(read(spark, sf_dir, "documents").select("doc_id", "text"), "text")


def p6_sample_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each draw, how many were drawn, whether anyone twice or from elsewhere, and whether minimums were kept."""
    records, targets = _targets(spark, sf_dir)
    sample, report = draw(records, targets, ["annotation_key"])
    at = sample.join(targets.groupBy("draw").agg(F.max("sample").alias("wanted")), "draw").join(records.filter("annotation_key is not null").select("i", "sample"), "i", "left")
    each = at.groupBy("draw").agg(F.count("*").alias("drawn"), (F.count("*") == F.count_distinct("i")).alias("once"), F.bool_and(F.coalesce(F.col("sample") == F.col("wanted"), F.lit(False))).alias("inside"))
    floors = report.join(targets.groupBy("draw", "category").agg(F.max("minimum").alias("minimum")), ["draw", "category"]).groupBy("draw").agg(F.bool_and(F.col("drawn") >= F.least("minimum", "available")).alias("minimums"))
    return each.join(floors, "draw").withColumnRenamed("draw", "draw_id")


def p7_packed_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document its tokens and parts in the containers, and whether none of these holds more than it can."""
    packed = p7_packed(spark, sf_dir)
    full = packed.groupBy("container").agg((F.sum("n_tokens") <= CAPACITY).alias("fits"))
    return packed.join(full, "container").groupBy("doc_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("parts"), F.bool_and("fits").alias("fits"))


def p7_report_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the report, what follows from the documents; at most a twentieth of the room is left over."""
    return p7_report(spark, sf_dir).select("tokens", "overfull", "least_containers", (F.col("unused_share") <= 0.05).alias("tight"))


def p8_mixture_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source, whether no document is used too often, budgets are kept, and met up to one document where they can be."""
    docs = with_tokens(read(spark, sf_dir, "documents"), "text", ["doc_id", "source"])
    weights = read(spark, sf_dir, "source_weights")
    used, report = mix(docs, weights, "doc_id", "source", "n_tokens", "word_share")
    uses = used.groupBy("source").agg(F.max("uses").alias("most"))
    longest = docs.groupBy("source").agg(F.max("n_tokens").alias("longest"))
    r = report.join(uses, "source", "left").join(longest, "source", "left")
    return r.select("source", (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("repeats_kept"), (F.col("used") <= F.col("budget") + 1e-6).alias("budget_kept"), (F.col("short") | (F.col("budget") - F.col("used") <= F.coalesce("longest", F.lit(0)))).alias("met"))


def p8_short_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens there are and tokens mixed of the sources that fall short: every document as often as allowed."""
    return p8_shares(spark, sf_dir).filter("short").select("source", "available", "used")


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that were mapped or reported as unmatched, and whether the key is one of the list or 0."""
    keys = read(spark, sf_dir, "gene_reference").select("db_class_key").distinct().withColumn("listed", F.lit(True))
    m = p5_found(spark, sf_dir).join(keys, "db_class_key", "left")
    return m.select("rec_id", (F.coalesce("listed", F.lit(False)) | (F.col("db_class_key") == 0)).alias("listed"))


def p5_as_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapped records whose symbol stands in the list as it is, of one entry."""
    genes, records = read(spark, sf_dir, "gene_reference"), read(spark, sf_dir, "hom_allorganism")
    own = genes.groupBy("symbol").agg(F.count_distinct("db_class_key").alias("n")).filter("n = 1").select("symbol")
    asked = records.select("rec_id", "symbol").distinct().join(own, "symbol", "left_semi").select("rec_id").distinct()
    return p5_found(spark, sf_dir).join(asked, "rec_id", "left_semi")


def p9_redacted_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text keeps every line, and everything but the items."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    clean = redact(docs, "text").withColumnRenamed("text", "clean")
    lines = lambda c: F.length(c) - F.length(F.replace(F.col(c), F.lit("\n"), F.lit("")))
    both = docs.join(clean, "doc_id")
    return both.select("doc_id", (F.lit(True) & (lines("text") == lines("clean"))).alias("same_lines"))


QUERIES = {"p5_as_listed": p5_as_listed, "p5_records": p5_records, "p6_sample_fits": p6_sample_fits, "p7_packed_fits": p7_packed_fits, "p7_report_sums": p7_report_sums, "p8_mixture_fits": p8_mixture_fits, "p8_short_shares": p8_short_shares, "p9_redacted_lengths": p9_redacted_lengths, "p1_found": p1_found, "p1_neighbours": p1_neighbours, "p2_found": p2_found, "p2_clusters": p2_clusters, "p5_found": p5_found, "p5_mapped": p5_mapped, "p6_found": p6_found, "p6_joint": p6_joint, "p6_sample": p6_sample, "p6_shares": p6_shares, "p7_found": p7_found, "p7_packed": p7_packed, "p7_report": p7_report, "p8_found": p8_found, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p9_found": p9_found, "p9_redacted": p9_redacted}

_TOKENS = r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+'))"

_PLAIN = r"nullif(regexp_replace(lower({}), '[\s\p{{Z}}_-]+', '', 'g'), '')".format

#: The plan of draws with the categories as they are spelled, and what there is of them.
_DRAWS = f"""
WITH cur AS (
  SELECT sample, {_PLAIN('annotation_key')} AS p FROM (
    SELECT *, row_number() OVER (PARTITION BY obs ORDER BY loaded_at DESC NULLS LAST) AS rn FROM obs) t
  WHERE rn = 1 AND sample IS NOT NULL),
have AS (SELECT sample, p, count(*) AS n FROM cur GROUP BY sample, p),
names AS (SELECT annotation_key AS name, {_PLAIN('annotation_key')} AS p FROM categories),
plan AS (SELECT draw_id, sample, {_PLAIN('annotation_key')} AS p, target_share, draw_size, n_min FROM subsample_plan),
spelled AS (
  SELECT DISTINCT q.p AS written, coalesce(e.name, c.name) AS name, coalesce(e.p, c.p) AS p
  FROM (SELECT DISTINCT p FROM plan) q LEFT JOIN names e ON e.p = q.p
  LEFT JOIN names c ON starts_with(c.p, q.p)
    AND (SELECT count(*) FROM names o WHERE starts_with(o.p, q.p)) = 1)
"""

_DOCS = f"WITH d AS (SELECT doc_id, source, {_TOKENS} AS n FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL) "

_MIXED = f"""
WITH d AS (SELECT source, {_TOKENS} AS n FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
have AS (SELECT source, sum(n) AS n FROM d GROUP BY source), total AS (SELECT sum(n) AS n FROM d) """

SQL = {
    "p1_found": """
WITH x AS (SELECT obs, var, coalesce(arg_max(value, load_id), 0) AS value FROM counts WHERE obs IS NOT NULL AND var IS NOT NULL AND NOT isnan(value) GROUP BY obs, var),
o AS (SELECT DISTINCT obs FROM x WHERE value <> 0), g AS (SELECT o.obs, v.var FROM o CROSS JOIN (SELECT DISTINCT var FROM x) v),
u AS (SELECT g.obs, list(coalesce(x.value, 0) ORDER BY g.var) AS v FROM g LEFT JOIN x USING (obs, var) GROUP BY g.obs),
s AS (SELECT a.obs AS a, b.obs AS b, list_cosine_similarity(a.v, b.v) AS s FROM u a JOIN u b ON a.obs <> b.obs),
t AS (SELECT a, b, s FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(s, 6) DESC, b) <= 5)
SELECT t.a AS obs_a, t.b AS obs_b FROM t JOIN t r ON r.a = t.b AND r.b = t.a WHERE t.a < t.b AND t.s >= 0.97""",
    "p5_records": "SELECT rec_id, true AS listed FROM hom_allorganism WHERE rec_id IS NOT NULL GROUP BY rec_id HAVING bool_or(db_class_key IS NULL OR db_class_key NOT IN (SELECT db_class_key FROM gene_reference WHERE db_class_key IS NOT NULL))",
    "p5_as_listed": """SELECT DISTINCT r.rec_id, g.db_class_key FROM hom_allorganism r JOIN (SELECT symbol, min(db_class_key) AS db_class_key FROM gene_reference GROUP BY symbol HAVING count(DISTINCT db_class_key) = 1) g ON g.symbol = r.symbol
WHERE r.rec_id IS NOT NULL AND (r.db_class_key IS NULL OR r.db_class_key NOT IN (SELECT db_class_key FROM gene_reference WHERE db_class_key IS NOT NULL))""",
    "p6_found": _DRAWS + """
SELECT DISTINCT l.draw_id, s.name AS annotation_key
FROM plan l JOIN spelled s ON s.written = l.p AND s.name IS NOT NULL LEFT JOIN have h ON h.sample = l.sample AND h.p = s.p
WHERE coalesce(h.n, 0) < greatest(l.n_min, CAST(floor(l.target_share * l.draw_size + 0.5) AS BIGINT))""",
    "p6_sample_fits": _DRAWS + """, goal AS (SELECT l.draw_id, any_value(l.sample) AS sample, s.p, max(l.n_min) AS n_min, max(l.draw_size) AS size FROM plan l JOIN spelled s ON s.written = l.p AND s.name IS NOT NULL GROUP BY 1, 3),
f AS (SELECT draw_id, any_value(g.sample) AS sample, max(size) AS size, sum(least(n_min, coalesce(h.n, 0))) AS floors FROM goal g LEFT JOIN have h ON h.sample = g.sample AND h.p = g.p GROUP BY 1),
pool AS (SELECT h.sample, sum(h.n) AS n FROM have h JOIN names USING (p) GROUP BY 1)
SELECT f.draw_id, CAST(least(pool.n, greatest(f.size, f.floors)) AS BIGINT) AS drawn, true AS once, true AS inside, true AS minimums FROM f JOIN pool USING (sample) WHERE least(pool.n, greatest(f.size, f.floors)) > 0""",
    "p7_packed_fits": _DOCS + "SELECT doc_id, n AS tokens, CAST(ceil(n / 1024.0) AS BIGINT) AS parts, true AS fits FROM d WHERE n > 0",
    "p7_report_sums": _DOCS + "SELECT CAST(sum(n) AS BIGINT) AS tokens, 0 AS overfull, CAST(ceil(sum(n) / 1024.0) AS BIGINT) AS least_containers, true AS tight FROM d",
    "p8_mixture_fits": "SELECT source, true AS repeats_kept, true AS budget_kept, true AS met FROM source_weights WHERE source IS NOT NULL GROUP BY source",
    "p8_short_shares": _MIXED + "SELECT w.source, CAST(coalesce(h.n, 0) AS BIGINT) AS available, CAST(coalesce(h.n, 0) * w.max_repeats AS BIGINT) AS used FROM source_weights w LEFT JOIN have h ON h.source = w.source CROSS JOIN total t WHERE coalesce(h.n, 0) * w.max_repeats < w.target_weight * t.n",
    "p9_redacted_lengths": "SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE true END AS same_lines FROM documents",
    "p7_found": f"SELECT doc_id FROM documents WHERE text IS NOT NULL AND {_TOKENS} > 1024",
    "p8_found": f"""
WITH d AS (SELECT source, {_TOKENS} AS n FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
have AS (SELECT source, sum(n) AS n FROM d GROUP BY source), total AS (SELECT sum(n) AS n FROM d)
SELECT w.source FROM source_weights w LEFT JOIN have h ON h.source = w.source CROSS JOIN total t
WHERE coalesce(h.n, 0) * w.max_repeats < w.target_weight * t.n""",
}
