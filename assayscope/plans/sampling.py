"""Queries on samples, splits and joins with them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from assayscope.functions.scalars import mutation_order, mutation_parts
from assayscope.operators import sampling as P
from assayscope.operators.additive import EXACT
from assayscope.plans.ranking import r, rounded
from assayscope.plans.registry import add
from assayscope.sources import fixtures as X
from assayscope.sources import ingest as I

V = f"WITH {X.VARIANTS}"
SEEDS, BUDGETS = [0, 1, 2, 3, 4], [20, 50, 100]
_KEY = "assay, seed, budget, regime"
_H = "md5(concat_ws('|', assay, seed, budget, regime, mutant)), mutant"
SPLITS = f"""grid(seed, budget) AS (VALUES {', '.join(f'({s}, {b})' for s in SEEDS for b in BUDGETS)}),
g AS (SELECT assay, mutant, ord, seed, budget FROM (SELECT DISTINCT assay, mutant, ord FROM variants WHERE ord > 0), grid),
s1 AS (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY {_H}) AS rank FROM (SELECT *, 'single_only' AS regime FROM g WHERE ord = 1 UNION ALL SELECT *, 'mixed_random' FROM g)),
p0 AS (SELECT *, 'single_plus_double' AS regime FROM g),
p1 AS (SELECT *, row_number() OVER (PARTITION BY {_KEY}, least(ord, 3) ORDER BY {_H}) AS rn, count_if(ord = 1) OVER (PARTITION BY {_KEY}) AS ns0, count_if(ord = 2) OVER (PARTITION BY {_KEY}) AS nd0 FROM p0),
p2 AS (SELECT *, least(ns0, budget - least(nd0, budget // 2)) AS ns FROM p1),
p3 AS (SELECT *, CASE WHEN ord = 1 AND rn <= ns THEN 0 WHEN ord = 2 AND rn <= budget - ns THEN 1 ELSE 2 END AS tier FROM p2),
p4 AS (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY tier, {_H}) AS rank FROM p3),
splits AS (SELECT {_KEY}, rank, mutant FROM s1 WHERE rank <= budget UNION ALL SELECT {_KEY}, rank, mutant FROM p4 WHERE rank <= budget)"""
VS = f"{V}, {SPLITS}"


def ordered(v):
    return v.withColumn("ord", mutation_order(F.col("mutant")))


def splits(spark, sf, v=None, budgets=BUDGETS, regimes=P.REGIMES):
    v = v or I.written(X.variants(spark, sf).select("assay", "mutant"), "variants")
    return P.low_n_splits(spark, ordered(v), SEEDS, budgets, regimes)


@add(f"{VS} SELECT * FROM splits")
def low_n_splits(spark, sf):
    return splits(spark, sf)


@add(f"{V}, r AS (SELECT assay, mutant, row_number() OVER (PARTITION BY assay ORDER BY md5(concat_ws('|', 'sample', assay, mutant)), mutant) AS rank FROM variants) SELECT * FROM r WHERE rank <= 20")
def sample_k_per_group(spark, sf):
    return P.sample_k(X.variants(spark, sf).select("assay", "mutant"), ["assay"], "mutant", 20)


@add(f"{V}, r AS (SELECT assay, mutant, row_number() OVER (PARTITION BY assay ORDER BY md5(concat_ws('|', 'large', assay, mutant)), mutant) AS rank, count(*) OVER (PARTITION BY assay) AS n FROM variants) SELECT assay, mutant, CAST(n > 20000 AS INT) AS sampled FROM r WHERE rank <= 20000")
def sample_large_groups(spark, sf):
    v = X.variants(spark, sf).select("assay", "mutant").withColumn("n", F.count("*").over(Window.partitionBy("assay")))
    return P.sample_k(v, ["assay"], "mutant", 20_000, "large").select("assay", "mutant", (F.col("n") > 20_000).cast("int").alias("sampled"))


@add(f"""{V}, t AS (SELECT assay, mutant, row_number() OVER (PARTITION BY assay ORDER BY dms_score DESC, mutant) <= 100 AS top FROM variants),
s AS (SELECT *, row_number() OVER (PARTITION BY assay, top ORDER BY md5(concat_ws('|', assay, mutant)), mutant) AS rn FROM t) SELECT assay, mutant FROM s WHERE top OR rn <= 900""")
def candidate_pool_retain_top(spark, sf):
    return P.retain_top(X.variants(spark, sf), ["assay"], "dms_score", "mutant", 1000, least=100).select("assay", "mutant")


@add(f"{V}, g AS (SELECT assay, mutant, seed FROM variants, (VALUES (0), (1), (2)) s(seed)), r AS (SELECT *, row_number() OVER (PARTITION BY assay, seed ORDER BY md5(concat_ws('|', 'init', assay, seed, mutant)), mutant) AS rank FROM g) SELECT * FROM r WHERE rank <= 20")
def initial_observed(spark, sf):
    seeds = spark.createDataFrame([(0,), (1,), (2,)], "seed int")
    g = X.variants(spark, sf).select("assay", "mutant").crossJoin(F.broadcast(seeds))
    return P.sample_k(g, ["assay", "seed"], "mutant", 20, "init")


_PICK = {"many": "n DESC", "few": "n", "high": "best DESC", "doubles": "doubles DESC", "wide": "spread DESC"}
_PICKS = " UNION ALL ".join(f"SELECT assay, '{k}' AS reason FROM (SELECT assay, row_number() OVER (ORDER BY {o}, assay) AS o FROM a) WHERE o <= 8" for k, o in _PICK.items())


@add(f"WITH {X.VARIANTS25}, a AS (SELECT assay, count(*) AS n, max(dms_score) AS best, count_if(ord = 2) AS doubles, max(dms_score) - min(dms_score) AS spread FROM variants GROUP BY 1), p AS ({_PICKS}) SELECT assay, string_agg(reason, '|' ORDER BY reason) AS reasons FROM p GROUP BY 1")
def stratified_assay_pick(spark, sf):
    v = ordered(X.variants25(spark, sf))
    a = v.groupBy("assay").agg(F.count("*").alias("n"), F.max("dms_score").alias("best"), F.count_if(F.col("ord") == 2).alias("doubles"), (F.max("dms_score") - F.min("dms_score")).alias("spread"))
    picks = None
    for reason, order in _PICK.items():
        c = F.col(order.split()[0])
        top = a.orderBy(c.desc() if "DESC" in order else c.asc(), "assay").limit(8).select("assay", F.lit(reason).alias("reason"))
        picks = top if picks is None else picks.unionByName(top)
    return picks.groupBy("assay").agg(F.array_join(F.array_sort(F.collect_set("reason")), "|").alias("reasons"))


# -- joins ----------------------------------------------------------------------------------------


@add(f"{VS} SELECT v.assay, v.mutant, round(v.dms_score, 6) + 0.0 AS dms_score FROM variants v WHERE EXISTS (SELECT 1 FROM splits s WHERE s.assay = v.assay AND s.mutant = v.mutant AND regime = 'single_only')")
def train_semi_join(spark, sf):
    v = I.written(X.variants(spark, sf).select("assay", "mutant", "dms_score"), "variants")
    t = splits(spark, sf, v).where("regime = 'single_only'").select("assay", "mutant").distinct()
    return rounded(v.select("assay", "mutant", "dms_score").join(t, ["assay", "mutant"], "left_semi"))


@add(f"{VS}, k AS (SELECT DISTINCT {_KEY} FROM splits) SELECT k.assay, k.seed, k.budget, k.regime, count(*) AS n_test FROM variants v JOIN k ON v.assay = k.assay WHERE NOT EXISTS (SELECT 1 FROM splits s WHERE s.assay = k.assay AND s.seed = k.seed AND s.budget = k.budget AND s.regime = k.regime AND s.mutant = v.mutant) GROUP BY 1, 2, 3, 4")
def heldout_anti_join(spark, sf):
    v = I.written(X.variants(spark, sf).select("assay", "mutant"), "variants")
    s = I.written(splits(spark, sf, v), "splits")
    key = ["assay", "seed", "budget", "regime"]
    # a row per split, and its budget of rows: variants stay where they are
    every = v.join(F.broadcast(s.select(*key).distinct()), "assay")
    return every.join(F.broadcast(s.select(*key, "mutant")), [*key, "mutant"], "left_anti").groupBy(*key).agg(F.count("*").alias("n_test"))


@add(f"""{V}, b AS (SELECT assay, avg(dms_score) AS b FROM variants WHERE ord = 1 GROUP BY 1), e AS (SELECT assay, mutant AS part, CAST(dms_score - b AS DECIMAL(28,10)) AS e FROM variants JOIN b USING (assay) WHERE ord = 1)
SELECT v.assay, v.mutant, {r('CAST(sum(coalesce(e, 0)) AS DOUBLE)')} AS effect FROM (SELECT assay, mutant, unnest(parts) AS part FROM variants) v LEFT JOIN e USING (assay, part) GROUP BY 1, 2""")
def effect_lookup_join(spark, sf):
    v = ordered(X.variants(spark, sf))
    one = v.where("ord = 1")
    e = one.join(one.groupBy("assay").agg(F.avg("dms_score").alias("b")), "assay").select("assay", F.col("mutant").alias("part"), (F.col("dms_score") - F.col("b")).cast(EXACT).alias("e"))
    parts = v.select("assay", "mutant", F.explode(mutation_parts(F.col("mutant"))).alias("part"))
    return rounded(parts.join(e, ["assay", "part"], "left").groupBy("assay", "mutant").agg(F.coalesce(F.sum("e"), F.lit(0)).cast("double").alias("effect")))


_PREFIX = "n AS (SELECT DISTINCT p_name AS protein FROM part), a AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS key FROM part)"


@add(f"WITH {_PREFIX} SELECT protein, arg_min(key, length(key) || key) AS alignment FROM n JOIN a ON starts_with(key, protein) OR starts_with(protein, key) GROUP BY 1")
def prefix_match_join(spark, sf):
    n = X.table(spark, sf, "part").select(F.col("p_name").alias("protein")).distinct()
    a = X.table(spark, sf, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("key")).distinct()
    # equi-joins on the prefixes of either side
    m = prefixes(n, "protein", "key", a).join(a, "key").select("protein", "key").unionByName(prefixes(a, "key", "protein", n).join(n, "protein").select("protein", "key"))
    return m.groupBy("protein").agg(F.min_by("key", F.struct(F.length("key"), "key")).alias("alignment"))


def prefixes(df, column: str, name: str, others):
    """df with a row for each prefix of a column that is as long as some value of others' column `name`: short
    prefixes, which many rows share, are only there if they are asked for."""
    lengths = others.agg(F.array_sort(F.collect_set(F.length(name)))).first()[0]  # at most the longest name's length
    fitting = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length(column))
    return df.withColumn(name, F.explode(F.transform(fitting, lambda n: F.substr(F.col(column), F.lit(1), n))))


@add("WITH n AS (SELECT DISTINCT p_name AS protein FROM part), a AS (SELECT DISTINCT p_type AS key FROM part UNION SELECT 'red') SELECT protein FROM n WHERE EXISTS (SELECT 1 FROM a WHERE starts_with(protein, key))")
def prefix_exists(spark, sf):
    n = X.table(spark, sf, "part").select(F.col("p_name").alias("protein")).distinct()
    a = X.table(spark, sf, "part").select(F.col("p_type").alias("key")).distinct().unionByName(spark.createDataFrame([("red",)], "key string"))
    return prefixes(n, "protein", "key", a).join(a, "key", "left_semi").select("protein").distinct()


#: The fields kept of the reference table; it has no 'taxon' and no 'year'.
KEEP_FIELDS = ["n_name", "n_nationkey", "n_regionkey", "r_name", "r_regionkey", "taxon", "year"]
_TEXT = ", ".join(f"'' AS {f}" if f in ("taxon", "year") else f"coalesce(CAST({f} AS VARCHAR), '') AS {f}" for f in KEEP_FIELDS)


@add(f"""WITH m AS (SELECT DISTINCT 'NATION_' || c_nationkey AS assay FROM customer), f AS (SELECT 'NATION_' || n_nationkey AS assay, n_name, n_nationkey, n_regionkey, nullif(r_name, 'ASIA') AS r_name, r_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 22),
t AS (SELECT assay, {_TEXT} FROM m JOIN f USING (assay)) SELECT *, coalesce(nullif(r_name, ''), 'Unknown') AS assay_type, coalesce(nullif(r_name, ''), 'Unknown') AS assay_type_official, '0' AS needs_manual_review FROM t""")
def official_metadata(spark, sf):
    """Nations as assays; some have no entry in the reference table, and one region's name is missing there."""
    name = lambda c: F.concat(F.lit("NATION_"), F.col(c).cast("string")).alias("assay")
    manifest = X.table(spark, sf, "customer").select(name("c_nationkey")).distinct()
    n = X.table(spark, sf, "nation").where("n_nationkey < 22").join(X.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    known = n.withColumn("r_name", F.nullif("r_name", F.lit("ASIA"))).select(name("n_nationkey"), *[f for f in KEEP_FIELDS if f in n.columns])
    return I.pick_fields(manifest, known, "assay", KEEP_FIELDS, "r_name")


@add("WITH c AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9000) SELECT (SELECT count(*) FROM nation JOIN c ON n_nationkey = k) AS matched, (SELECT count(*) FROM nation WHERE n_nationkey NOT IN (SELECT k FROM c)) AS missing")
def metadata_left_join(spark, sf):
    c = X.table(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"), F.lit(1).alias("there")).distinct()
    j = X.table(spark, sf, "nation").join(c, "n_nationkey", "left")
    return j.agg(F.count("there").alias("matched"), F.count_if(F.col("there").isNull()).alias("missing"))


@add(f"WITH {X.VARIANTS25}, n AS (SELECT assay, avg(dms_score) AS a FROM variants GROUP BY 1), m AS (SELECT assay, avg(m_qty) AS b FROM variants WHERE assay > 'NATION_2' GROUP BY 1) SELECT assay, {r('coalesce(b, a)')} AS value FROM n LEFT JOIN m USING (assay)")
def coalesce_source(spark, sf):
    v = X.variants25(spark, sf)
    a = v.groupBy("assay").agg(F.avg("dms_score").alias("a"))
    b = v.where("assay > 'NATION_2'").groupBy("assay").agg(F.avg("m_qty").alias("b"))
    return rounded(a.join(b, "assay", "left").select("assay", F.coalesce("b", "a").alias("value")))
