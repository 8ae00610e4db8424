"""Queries on sources, scalar functions, filters and the assay manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayscope.functions import scalars as S
from assayscope.operators.ranking import at_index
from assayscope.plans.registry import add
from assayscope.sources import fixtures as X
from assayscope.sources import ingest as I

V = f"WITH {X.VARIANTS}"
VL = f"WITH {X.VARIANTS}, {X.LONG}"
R = "round({}, 6) + 0.0"


@add(f"{V} SELECT assay, mutant, dms_score, dms_score_bin, m_disc, m_qty, m_retail, m_tax FROM variants")
def scan_assays(spark, sf):
    """The variants written as CSV, a folder of files for each assay, and read back as text."""
    numbers = ["dms_score", "dms_score_bin", *X.METHODS]
    path = I.shared_path(spark, "assays")
    X.variants(spark, sf).select("assay", "mutant", *numbers).write.partitionBy("assay").option("header", True).csv(path)
    t = I.scan_assays(spark, path, ["mutant", *numbers])
    values = {c: S.parse_finite(F.col(c)) for c in numbers}
    return t.withColumns(values | {"dms_score_bin": values["dms_score_bin"].cast("int")}).select("assay", "mutant", *numbers)


@add(f"{V} SELECT assay, mutant, m_qty FROM variants")
def scan_scores_pruned(spark, sf):
    return X.variants(spark, sf).select("assay", "mutant", "m_qty")


@add(f"{VL} SELECT assay, mutant, method, score FROM long")
def scores_long(spark, sf):
    return X.scores_long(X.variants(spark, sf)).select("assay", "mutant", "method", "score")


METHOD_RULES = [("m_q", "volume"), ("m_d", "price"), ("m_r", "price"), ("m_t", "tax")]
_METHOD = "CASE WHEN starts_with(method, 'm_q') THEN 'volume' WHEN starts_with(method, 'm_d') THEN 'price' WHEN starts_with(method, 'm_r') THEN 'price' WHEN starts_with(method, 'm_t') THEN 'tax' ELSE 'other' END"


@add(f"{V}, m AS (UNPIVOT (SELECT {', '.join(f'count({m}) AS {m}' for m in X.METHODS)} FROM variants) ON {', '.join(X.METHODS)} INTO NAME method VALUE n) SELECT method, {_METHOD} AS category, n FROM m")
def method_inventory(spark, sf):
    n = I.method_counts(X.variants(spark, sf), X.BASE_COLUMNS)
    return n.withColumn("category", S.prefix_category(F.col("method"), METHOD_RULES, "other"))


@add(f"SELECT p_type, {_METHOD.replace('method', 'lower(p_type)').replace('m_', '')} AS category, count(*) AS n FROM part GROUP BY 1, 2")
def method_category(spark, sf):
    rules = [(p[2:], c) for p, c in METHOD_RULES]
    p = X.table(spark, sf, "part").withColumn("category", S.prefix_category(F.lower("p_type"), rules, "other"))
    return p.groupBy("p_type", "category").agg(F.count("*").alias("n"))


@add("SELECT s_suppkey AS key, s_acctbal AS bal, 'supplier' AS kind FROM supplier UNION ALL SELECT c_custkey, c_acctbal, 'customer' FROM customer")
def union_checked(spark, sf):
    a = X.table(spark, sf, "supplier").selectExpr("s_suppkey AS key", "s_acctbal AS bal", "'supplier' AS kind")
    b = X.table(spark, sf, "customer").selectExpr("c_custkey AS key", "c_acctbal AS bal", "'customer' AS kind")
    return I.union_checked(a, b)


@add("SELECT s_acctbal AS bal, CAST(NULL AS VARCHAR) AS segment, s_suppkey AS key FROM supplier UNION ALL SELECT c_acctbal, c_mktsegment, c_custkey FROM customer")
def sink_union_keys(spark, sf):
    a = X.table(spark, sf, "supplier").selectExpr("s_suppkey AS key", "s_acctbal AS bal")
    b = X.table(spark, sf, "customer").selectExpr("c_custkey AS key", "c_acctbal AS bal", "c_mktsegment AS segment")
    return I.union_of_keys(a, b)


@add(f"""{V}, m AS (SELECT assay, mutant, dms_score, min(dms_score) OVER (PARTITION BY assay) AS lo, max(dms_score) OVER (PARTITION BY assay) AS hi FROM variants WHERE m_qty IS NOT NULL),
s AS (SELECT assay, mutant, CASE WHEN hi = lo THEN 0.0 ELSE (dms_score - lo) / (hi - lo) END AS scaled FROM m)
SELECT assay, mutant, {R.format('scaled')} AS scaled, CAST(scaled >= 0.5 AS INT) AS binary FROM s""")
def export_minmax_labels(spark, sf):
    out = I.minmax_labels(X.variants(spark, sf), "assay", "dms_score", ["m_qty"])
    return out.select("assay", "mutant", S.r6(F.col("scaled")).alias("scaled"), "binary")


@add(f"{V} SELECT assay, mutant, {', '.join(X.METHODS)} FROM variants WHERE dms_score IS NOT NULL AND {' AND '.join(f'{m} IS NOT NULL' for m in X.METHODS)}")
def export_minmax_features(spark, sf):
    """The vectors that go with export_minmax_labels, for the rows that have every feature."""
    return X.variants(spark, sf).dropna(subset=["dms_score", *X.METHODS]).select("assay", "mutant", *X.METHODS)


@add("SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def dedupe_last_wins(spark, sf):
    return I.last_wins(X.table(spark, sf, "events").select("user_id", "event_type", "value", "event_id"), ["user_id", "event_type"], "event_id").drop("event_id")


@add("""SELECT event_id, t, CASE WHEN lower(trim(t)) IN ('', 'nan', 'none', 'na') THEN NULL ELSE v END AS number FROM
(SELECT *, CASE WHEN isfinite(TRY_CAST(trim(t) AS DOUBLE)) THEN TRY_CAST(trim(t) AS DOUBLE) END AS v FROM
(SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'NaN' WHEN 1 THEN ' none' WHEN 2 THEN 'inf' WHEN 3 THEN event_type ELSE ' ' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || ' ' END AS t FROM events))""")
def parse_finite(spark, sf):
    i = F.col("event_id") % 7
    number = F.concat(F.lit(" "), F.col("value").cast("decimal(18,2)").cast("string"), F.lit(" "))
    t = F.when(i == 0, "NaN").when(i == 1, " none").when(i == 2, "inf").when(i == 3, F.col("event_type")).otherwise(number)
    return X.table(spark, sf, "events").select("event_id", t.alias("t")).withColumn("number", S.parse_finite(F.col("t")))


@add(f"{V} SELECT assay, CASE WHEN v > 0 THEN 1 WHEN v IS NOT NULL THEN 0 END AS label, count(*) AS n FROM (SELECT assay, coalesce(CASE WHEN m_qty > 25 THEN dms_score_bin END, m_disc - 0.05) AS v FROM variants) GROUP BY 1, 2")
def parse_label(spark, sf):
    v = X.variants(spark, sf).withColumn("label", S.parse_label(F.when(F.col("m_qty") > 25, F.col("dms_score_bin").cast("double")), F.col("m_disc") - 0.05))
    return v.groupBy("assay", "label").agg(F.count("*").alias("n"))


_PARTS = "CASE WHEN mutant IN ('', 'WT', 'wildtype', '_wt') THEN [] ELSE string_split(mutant, ':') END"


def _with_wildtypes(spark, sf):
    v = X.variants(spark, sf).select("assay", "mutant")
    return v.withColumn("mutant", F.when(F.length("mutant") == 3, F.lit("WT")).otherwise(F.col("mutant"))).distinct()


_WT = f"{V}, w AS (SELECT DISTINCT assay, CASE WHEN length(mutant) = 3 THEN 'WT' ELSE mutant END AS mutant FROM variants), p AS (SELECT *, {_PARTS} AS parts FROM w)"


@add(f"{_WT} SELECT assay, mutant, len(parts) AS mutation_order FROM p")
def mutation_order(spark, sf):
    return _with_wildtypes(spark, sf).withColumn("mutation_order", S.mutation_order(F.col("mutant")))


@add(f"{_WT} SELECT assay, mutant, array_to_string(parts, '|') AS parts FROM p")
def mutation_parts(spark, sf):
    return _with_wildtypes(spark, sf).withColumn("parts", F.array_join(S.mutation_parts(F.col("mutant")), "|"))


@add(f"{_WT} SELECT assay, CASE len(parts) WHEN 0 THEN 'wt_or_unknown' WHEN 1 THEN 'single' WHEN 2 THEN 'double' ELSE 'higher' END AS bucket, count(*) AS n FROM p GROUP BY 1, 2")
def order_bucket(spark, sf):
    return _with_wildtypes(spark, sf).groupBy("assay", S.order_bucket(S.mutation_order(F.col("mutant"))).alias("bucket")).agg(F.count("*").alias("n"))


_SITES = "list_distinct(list_transform(list_filter(parts, lambda x: length(x) >= 3), lambda x: x[2:-2]))"


@add(f"{_WT} SELECT assay, mutant, array_to_string(list_sort({_SITES}), ',') AS sites FROM p")
def mutation_sites(spark, sf):
    return _with_wildtypes(spark, sf).withColumn("sites", F.array_join(F.array_sort(S.mutation_sites(S.mutation_parts(F.col("mutant")))), ","))


@add(f"{V} SELECT assay, array_to_string(list_sort({_SITES}), ':') AS site_pair, count(*) AS n FROM variants WHERE ord = 2 GROUP BY 1, 2")
def site_pair_key(spark, sf):
    v = X.variants(spark, sf).where(S.mutation_order(F.col("mutant")) == 2)
    return v.groupBy("assay", S.site_pair_key(S.mutation_parts(F.col("mutant"))).alias("site_pair")).agg(F.count("*").alias("n"))


@add(f"{V} SELECT assay, least(parts[1], parts[2]) || ':' || greatest(parts[1], parts[2]) AS pair, count(*) AS n FROM variants WHERE ord = 2 GROUP BY 1, 2")
def pair_key(spark, sf):
    v = X.variants(spark, sf).where(S.mutation_order(F.col("mutant")) == 2).withColumn("p", S.mutation_parts(F.col("mutant")))
    return v.groupBy("assay", S.pair_key(F.get("p", 0), F.get("p", 1)).alias("pair")).agg(F.count("*").alias("n"))


@add(f"""{V}, t AS (SELECT assay, mutant, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM variants)
SELECT x.assay, x.part || ':' || y.part AS pair, count(*) AS n FROM t x JOIN t y ON x.assay = y.assay AND x.mutant = y.mutant AND x.i < y.i GROUP BY 1, 2""")
def mutation_pairs(spark, sf):
    v = X.variants(spark, sf).select("assay", F.explode(S.mutation_pairs(S.mutation_parts(F.col("mutant")))).alias("p"))
    return v.groupBy("assay", F.concat_ws(":", "p.a", "p.b").alias("pair")).agg(F.count("*").alias("n"))


@add(f"{V} SELECT assay, mutant, array_to_string(regexp_extract_all(mutant, '[A-Z*](\\d+)[A-Z*]', 1), ',') AS positions FROM variants")
def regex_positions(spark, sf):
    return X.variants(spark, sf).select("assay", "mutant", F.array_join(S.regex_positions(F.col("mutant")), ",").alias("positions"))


@add("""SELECT name, CASE WHEN (t[2] = upper(t[2]) AND upper(t[2]) <> lower(t[2])) OR regexp_matches(t[2], '^[0-9]') THEN t[1] || '_' || t[2] ELSE t[1] END AS protein, count(*) AS n FROM
(SELECT name, string_split(name, '_') AS t FROM (SELECT replace(p_name, ' ', '_') || '_' || p_type AS name FROM part UNION ALL SELECT p_type || '_' || p_size || '_x' FROM part UNION ALL SELECT p_brand || '_' || p_type FROM part)) GROUP BY 1, 2""")
def protein_key(spark, sf):
    p = X.table(spark, sf, "part")
    a = p.select(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), "p_type").alias("name"))
    b = p.select(F.concat_ws("_", "p_type", F.col("p_size").cast("string"), F.lit("x")).alias("name"))
    c = p.select(F.concat_ws("_", "p_brand", "p_type").alias("name"))
    return a.unionByName(b).unionByName(c).groupBy("name", S.protein_key(F.col("name")).alias("protein")).agg(F.count("*").alias("n"))


KEYWORDS = [(["ring", "gear"], "machine"), (["widget"], "gadget"), (["red", "blue"], "colour")]


@add("SELECT p_name, CASE WHEN contains(lower(p_name), 'ring') OR contains(lower(p_name), 'gear') THEN 'machine' WHEN contains(lower(p_name), 'widget') THEN 'gadget' WHEN contains(lower(p_name), 'red') OR contains(lower(p_name), 'blue') THEN 'colour' ELSE 'other' END AS kind, count(*) AS n FROM part GROUP BY 1, 2")
def assay_type_keyword(spark, sf):
    return X.table(spark, sf, "part").groupBy("p_name", S.keyword_category(F.col("p_name"), KEYWORDS, "other").alias("kind")).agg(F.count("*").alias("n"))


# keyword rules: class, keyword, priority of the class, order of the keyword
RULES = [("machine", "ring", 2, 1), ("machine", "gear", 2, 2), ("gadget", "widget", 1, 3), ("colour", "red", 3, 4), ("colour", "blue", 3, 5)]
_RULES = "rules(kind, word, priority, ord) AS (VALUES " + ", ".join(map(str, RULES)) + ")"


def _rules(spark):
    return spark.createDataFrame(RULES, "kind string, word string, priority int, ord int")


@add(f"""WITH {_RULES}, n AS (SELECT DISTINCT p_name FROM part), m AS (SELECT p_name, kind, priority, arg_min(word, ord) AS word FROM n JOIN rules ON contains(lower(p_name), word) GROUP BY 1, 2, 3)
SELECT n.p_name, coalesce(arg_min(kind, priority), 'Unknown') AS kind, arg_min(word, priority) AS keyword, string_agg(kind, '|' ORDER BY kind) AS basis FROM n LEFT JOIN m USING (p_name) GROUP BY 1""")
def curate_type(spark, sf):
    n = X.table(spark, sf, "part").select("p_name").distinct()
    m = n.join(F.broadcast(_rules(spark)), F.contains(F.lower("p_name"), F.col("word")))
    m = m.groupBy("p_name", "kind", "priority").agg(F.min_by("word", "ord").alias("word"))
    best = m.groupBy("p_name").agg(F.min_by("kind", "priority").alias("kind"), F.min_by("word", "priority").alias("keyword"), F.array_join(F.array_sort(F.collect_list("kind")), "|").alias("basis"))
    return n.join(best, "p_name", "left").withColumn("kind", F.coalesce("kind", F.lit("Unknown")))


@add(f"""WITH {_RULES}, n AS (SELECT DISTINCT p_name, CASE WHEN starts_with(p_name, 'hot') THEN 'heat' END AS curated FROM part),
m AS (SELECT p_name, arg_min(kind, ord) AS kind, arg_min(word, ord) AS word, count(*) AS hits FROM n JOIN rules ON contains(lower(p_name), word) GROUP BY 1)
SELECT p_name, coalesce(curated, kind, 'Unknown') AS kind, CASE WHEN curated IS NOT NULL THEN 'high' WHEN hits >= 2 THEN 'medium' ELSE 'low' END AS confidence,
CAST(curated IS NULL AND coalesce(hits, 0) < 2 AS INT) AS review FROM n LEFT JOIN m USING (p_name)""")
def refine_type(spark, sf):
    n = X.table(spark, sf, "part").select("p_name", F.when(F.startswith("p_name", F.lit("hot")), "heat").alias("curated")).distinct()
    m = n.join(F.broadcast(_rules(spark)), F.contains(F.lower("p_name"), F.col("word"))).groupBy("p_name").agg(F.min_by("kind", "ord").alias("kind"), F.count("*").alias("hits"))
    known = F.col("curated").isNotNull()
    return n.join(m, "p_name", "left").select(
        "p_name", F.coalesce("curated", "kind", F.lit("Unknown")).alias("kind"), F.when(known, "high").when(F.col("hits") >= 2, "medium").otherwise("low").alias("confidence"),
        (~known & (F.coalesce("hits", F.lit(0)) < 2)).cast("int").alias("review"),
    )


# -- filters --------------------------------------------------------------------------------------


@add(f"{VL} SELECT assay, mutant, method, score FROM long WHERE method IN ('m_qty', 'm_tax') AND assay IN ('BUILDING', 'MACHINERY')")
def filter_allowed(spark, sf):
    long = X.scores_long(X.variants(spark, sf))
    return long.where(F.col("method").isin("m_qty", "m_tax") & F.col("assay").isin("BUILDING", "MACHINERY")).select("assay", "mutant", "method", "score")


@add(f"WITH {X.VARIANTS25}, a AS (SELECT DISTINCT assay FROM variants WHERE assay <> 'NATION_1' ORDER BY assay LIMIT 5) SELECT assay, count(*) AS n FROM variants JOIN a USING (assay) GROUP BY 1")
def include_exclude_groups(spark, sf):
    v = X.variants25(spark, sf).select("assay", "mutant")
    first = v.select("assay").distinct().where(~F.col("assay").isin("NATION_1")).orderBy("assay").limit(5)
    return v.join(F.broadcast(first), "assay").groupBy("assay").agg(F.count("*").alias("n"))


@add(f"{V}, b AS (SELECT assay, ord, count(*) AS n FROM variants GROUP BY 1, 2 HAVING count(*) >= 20) SELECT * FROM b")
def min_group_size(spark, sf):
    v = X.variants(spark, sf).withColumn("ord", S.mutation_order(F.col("mutant")))
    return v.groupBy("assay", "ord").agg(F.count("*").alias("n")).where("n >= 20")


@add(f"""{V}, r AS (SELECT *, row_number() OVER (PARTITION BY assay ORDER BY abs(m_qty - 25)) - 1 AS i, count(*) OVER (PARTITION BY assay) AS n FROM variants),
t AS (SELECT assay, abs(m_qty - 25) AS cut FROM r WHERE i = least(n - 1, floor(n * 0.75::DOUBLE))) SELECT assay, mutant FROM variants JOIN t USING (assay) WHERE abs(m_qty - 25) >= cut""")
def quantile_subset(spark, sf):
    v = X.variants(spark, sf).withColumn("far", F.abs(F.col("m_qty") - 25))
    cut = at_index(v, ["assay"], "far", F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(0.75))), "cut")
    return v.join(F.broadcast(cut), "assay").where("far >= cut").select("assay", "mutant")


@add(f"{V} SELECT assay, mutant, dms_score FROM variants WHERE dms_score_bin = 1")
def flag_subset(spark, sf):
    return X.variants(spark, sf).where("dms_score_bin = 1").select("assay", "mutant", "dms_score")


@add(f"{V} SELECT assay, count(*) AS n FROM (SELECT assay, nullif(m_disc, 0.05) AS a, CASE WHEN m_tax > 0.03 THEN m_tax END AS b FROM variants) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1")
def complete_case(spark, sf):
    v = X.variants(spark, sf).select("assay", F.nullif("m_disc", F.lit(0.05)).alias("a"), F.when(F.col("m_tax") > 0.03, F.col("m_tax")).alias("b"))
    return v.dropna(subset=["a", "b"]).groupBy("assay").agg(F.count("*").alias("n"))


# -- manifest -------------------------------------------------------------------------------------

_STRICT = """t AS (SELECT assay, mutant, ord, unnest(parts) AS part FROM variants WHERE ord >= 2), single AS (SELECT assay, mutant AS part FROM variants WHERE ord = 1),
strict AS (SELECT t.assay, t.mutant, t.ord FROM t LEFT JOIN single USING (assay, part) GROUP BY 1, 2, 3 HAVING bool_and(single.assay IS NOT NULL))"""


def strict(v):
    """Multi-mutants all parts of which are measured as singles: assay, mutant, ord."""
    o = v.select("assay", "mutant", S.mutation_order(F.col("mutant")).alias("ord"))
    one = o.where("ord = 1").select("assay", F.col("mutant").alias("part"), F.lit(True).alias("known"))
    t = o.where("ord >= 2").withColumn("part", F.explode(S.mutation_parts(F.col("mutant"))))
    # some hundred singles per assay at most, but the planner decides by size
    t = t.join(one, ["assay", "part"], "left")
    return t.groupBy("assay", "mutant", "ord").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("all")).where("all").drop("all")


@add(f"{V}, {_STRICT} SELECT * FROM strict")
def strict_division(spark, sf):
    return strict(X.variants(spark, sf))


_ORDERS = ", ".join(f"count_if(ord = {i}) AS n_order_{i}" for i in range(1, 11))
_MANIFEST = f"""m AS (SELECT assay, count(*) AS n_variants, count_if(ord > 2) AS n_higher_order, max(ord) AS max_order, {_ORDERS}, count_if(ord > 10) AS n_order_gt10 FROM variants GROUP BY 1),
s AS (SELECT assay, count_if(ord = 2) AS strict_double_evaluable, count_if(ord > 2) AS strict_higher_evaluable FROM strict GROUP BY 1),
manifest AS (SELECT m.*, coalesce(strict_double_evaluable, 0) AS strict_double_evaluable, coalesce(strict_higher_evaluable, 0) AS strict_higher_evaluable FROM m LEFT JOIN s USING (assay))"""


def manifest(v):
    o = v.select("assay", "mutant", S.mutation_order(F.col("mutant")).alias("ord"))
    n = lambda c: F.count_if(c)
    m = o.groupBy("assay").agg(
        F.count("*").alias("n_variants"), n(F.col("ord") > 2).alias("n_higher_order"), F.max("ord").alias("max_order"),
        *[n(F.col("ord") == i).alias(f"n_order_{i}") for i in range(1, 11)], n(F.col("ord") > 10).alias("n_order_gt10"),
    )
    s = strict(v).groupBy("assay").agg(n(F.col("ord") == 2).alias("strict_double_evaluable"), n(F.col("ord") > 2).alias("strict_higher_evaluable"))
    return m.join(s, "assay", "left").fillna(0, ["strict_double_evaluable", "strict_higher_evaluable"])


@add(f"{V}, {_STRICT}, {_MANIFEST} SELECT * FROM manifest")
def assay_manifest(spark, sf):
    return manifest(X.variants(spark, sf))


@add(f"{V}, {_STRICT}, {_MANIFEST} SELECT count(*) AS n_assays, CAST(sum(n_variants) AS BIGINT) AS n_variants, CAST(sum(n_order_2) AS BIGINT) AS n_doubles, CAST(sum(strict_double_evaluable) AS BIGINT) AS strict_doubles, count_if(strict_double_evaluable >= 100) AS n_strict_100 FROM manifest")
def manifest_summary(spark, sf):
    return manifest(X.variants(spark, sf)).agg(
        F.count("*").alias("n_assays"), F.sum("n_variants").alias("n_variants"), F.sum("n_order_2").alias("n_doubles"),
        F.sum("strict_double_evaluable").alias("strict_doubles"), F.count_if(F.col("strict_double_evaluable") >= 100).alias("n_strict_100"),
    )


@add(f"WITH {X.ALIGNMENTS}, s AS (SELECT protein, length(replace(sequence, '-', '')) AS len FROM alignments), r AS (SELECT *, row_number() OVER (PARTITION BY protein ORDER BY len) - 1 AS i, count(*) OVER (PARTITION BY protein) AS n FROM s) SELECT protein, count(*) AS n_sequences, min(len) AS min_len, max(len) AS max_len, max(CASE WHEN i = n // 2 THEN len END) AS median_len FROM r GROUP BY 1")
def alignment_depth(spark, sf):
    a = X.alignments(spark, sf).select("protein", F.length(F.replace("sequence", F.lit("-"), F.lit(""))).alias("len"))
    mid = at_index(a, ["protein"], "len", F.floor(F.col("n") / 2), "median_len")
    return a.groupBy("protein").agg(F.count("*").alias("n_sequences"), F.min("len").alias("min_len"), F.max("len").alias("max_len")).join(mid, "protein")


# -- files ----------------------------------------------------------------------------------------


@add(f"{V} SELECT assay, mutant, m_qty FROM variants")
def sink_table(spark, sf):
    path = I.shared_path(spark, "sink")
    I.sink_table(X.variants(spark, sf), path, ["assay", "mutant", "m_qty"])
    return spark.read.parquet(path)


@add("SELECT CAST(doc_id AS VARCHAR) AS header, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS len FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL")
def read_alignment_records(spark, sf):
    d = X.table(spark, sf, "documents").where("doc_id is not null and text is not null")
    path = I.shared_path(spark, "alignments")
    d.select(F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit("\n"), F.regexp_replace("text", "[^A-Za-z]", "")).alias("value")).write.text(path)
    return I.read_alignment_records(spark, path).select("header", F.length("sequence").alias("len"))


PART_RESIDUES = 9_999  # as many as four columns can number


@add(f"WITH {X.COORDS} SELECT structure, residue, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y, round(z, 3) + 0.0 AS z FROM coords")
def read_ca_coords(spark, sf):
    c = X.coords(spark, sf)
    # the residue field has four columns: a long structure is written in parts, each numbered from 1
    nth = F.col("residue") - 1
    c = c.withColumns({"part": F.floor(nth / PART_RESIDUES), "in_part": (nth % PART_RESIDUES + 1).cast("int")})
    line = F.format_string("ATOM  %5d  CA  ALA A%4d    %8.3f%8.3f%8.3f", "in_part", "in_part", "x", "y", "z")
    lines = c.select(F.struct("structure", "part").alias("structure"), F.col("in_part").alias("line_no"), line.alias("value"))
    out = I.read_ca_coords(lines)
    residue = (F.col("structure.part") * PART_RESIDUES + F.col("residue")).alias("residue")
    return out.select("structure.structure", residue, *[(F.round(k, 3) + F.lit(0.0)).alias(k) for k in "xyz"])
