"""Queries on coordinates: contacts, exposure, surface, and their bins."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from assayscope.operators import ranking as K
from assayscope.operators import structure as T
from assayscope.plans.ranking import GAINS, ZS25, gains, long25, r, rounded, zero_shot
from assayscope.plans.registry import add
from assayscope.sources import fixtures as X
from assayscope.sources.ingest import written

C = f"WITH {X.COORDS}"
_D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
NB = f"nb AS (SELECT a.structure, a.residue, count(b.residue) AS neighbours FROM coords a LEFT JOIN coords b ON a.structure = b.structure AND a.residue <> b.residue AND {_D2} <= 100.0 GROUP BY 1, 2)"
#: Variants of structures: the customer's number gives one, two or three residues.
SITES = "sites AS (SELECT c_nationkey % 10 AS structure, c_custkey AS variant, CASE WHEN c_custkey % 4 = 0 THEN [c_custkey % 40 + 1] WHEN c_custkey % 3 = 0 THEN [c_custkey % 40 + 1, c_custkey % 17 + 1, c_custkey % 70 + 1] ELSE [c_custkey % 40 + 1, c_custkey % 23 + 2] END AS positions FROM customer)"


def sites(spark, sf):
    k = F.col("c_custkey")
    three = F.array(k % 40 + 1, k % 17 + 1, k % 70 + 1)
    two = F.array(k % 40 + 1, k % 23 + 2)
    return X.table(spark, sf, "customer").select((F.col("c_nationkey") % 10).alias("structure"), k.alias("variant"), F.when(k % 4 == 0, F.array(k % 40 + 1)).when(k % 3 == 0, three).otherwise(two).alias("positions"))


@add(f"{C}, {NB} SELECT * FROM nb")
def radius_self_join(spark, sf):
    return T.radius_counts(X.coords(spark, sf), 10.0)


_PD = f"""{SITES}, pr AS (SELECT structure, variant, unnest(positions) AS a, unnest(range(len(positions))) AS i FROM sites),
pp AS (SELECT x.structure, x.variant, x.a, y.a AS b FROM pr x JOIN pr y ON x.variant = y.variant AND x.i < y.i),
pj AS (SELECT pp.structure, variant, sqrt({_D2}) AS d FROM pp LEFT JOIN coords a ON a.structure = pp.structure AND a.residue = pp.a LEFT JOIN coords b ON b.structure = pp.structure AND b.residue = pp.b),
pd AS (SELECT structure, variant, CASE WHEN count(d) = count(*) THEN min(d) END AS min_distance FROM pj GROUP BY 1, 2)"""


@add(f"{C}, {_PD} SELECT structure, variant, {r('min_distance')} AS min_distance FROM sites LEFT JOIN pd USING (structure, variant)")
def pair_distance(spark, sf):
    return rounded(T.pair_distances(sites(spark, sf), X.coords(spark, sf)))


_FAR = ", ".join(f"{r(f'avg(CASE WHEN min_distance < {d} THEN 1.0 WHEN min_distance IS NOT NULL THEN 0.0 END)')} AS below_{d}" for d in (8, 12, 20))


@add(f"""{C}, {_PD}, k AS (SELECT pd.structure, min_distance, unnest(CASE WHEN len(positions) = 2 THEN ['multi', 'double'] ELSE ['multi'] END) AS kind FROM pd JOIN sites USING (variant) WHERE len(positions) > 1)
SELECT structure, kind, count(*) AS n_variants, count(min_distance) AS n, {r('count(min_distance)::DOUBLE / count(*)')} AS complete, {r('avg(min_distance)')} AS mean_distance, {r('median(min_distance)')} AS median_distance, {_FAR} FROM k GROUP BY 1, 2""")
def contact_summary(spark, sf):
    """Least distance between the mutated residues of a variant: of all variants with several, and of doubles."""
    kinds = F.when(F.size("positions") == 2, F.array(F.lit("multi"), F.lit("double"))).otherwise(F.array(F.lit("multi")))
    p = sites(spark, sf).where(F.size("positions") > 1)
    d = T.pair_distances(p, X.coords(spark, sf)).join(p.select("structure", "variant", kinds.alias("kinds")), ["structure", "variant"])
    d = d.select("structure", "min_distance", F.explode("kinds").alias("kind"))
    near = [F.avg(F.when(F.col("min_distance").isNotNull(), (F.col("min_distance") < k).cast("double"))).alias(f"below_{k}") for k in (8, 12, 20)]
    n = F.count("min_distance")
    return rounded(d.groupBy("structure", "kind").agg(F.count("*").alias("n_variants"), n.alias("n"), (n / F.count("*")).alias("complete"), F.avg("min_distance").alias("mean_distance"), F.median("min_distance").alias("median_distance"), *near))


_PS = f"{SITES}, ps AS (SELECT DISTINCT structure, variant, len(positions) AS n_sites, unnest(positions) AS residue FROM sites)"
_CUTS = "cuts AS (SELECT structure, list_sort(list(neighbours))[count(*) // 3 + 1] AS lo, list_sort(list(neighbours))[2 * count(*) // 3 + 1] AS hi FROM nb GROUP BY 1)"
_EXP = f"""{_PS}, {_CUTS}, ex AS (SELECT structure, variant, avg(neighbours) AS mean_count, avg(CAST(neighbours <= lo AS INT)) AS exposed, avg(CAST(neighbours > lo AND neighbours >= hi AS INT)) AS buried FROM ps JOIN nb USING (structure, residue) JOIN cuts USING (structure) GROUP BY 1, 2)"""


def mutated(spark, sf):
    """The residues of every variant, each once."""
    return sites(spark, sf).select("structure", "variant", F.size("positions").alias("n_sites"), F.explode(F.array_distinct("positions")).alias("residue"))


def exposure(spark, sf):
    """Which part of a variant's residues lies in the lowest, or the highest, third of its structure's neighbour counts."""
    n = written(T.radius_counts(X.coords(spark, sf), 10.0), "neighbours")
    cuts = K.at_indexes(n, ["structure"], "neighbours", lo=F.floor(F.col("n") / 3), hi=F.floor(F.col("n") * 2 / 3))
    d = mutated(spark, sf).join(n, ["structure", "residue"]).join(cuts, "structure")
    v = F.col("neighbours")
    return d.groupBy("structure", "variant").agg(F.avg(v).alias("mean_count"), F.avg((v <= F.col("lo")).cast("int")).alias("exposed"), F.avg(((v > F.col("lo")) & (v >= F.col("hi"))).cast("int")).alias("buried"))


def _by_tertile(table: str, value: str, exposed_low: bool) -> str:
    """SQL of a residue table's variant means by the structure's own tertiles, for all, single and multi variants."""
    low, high = ("exposed", "buried") if exposed_low else ("buried", "exposed")
    return f"""cuts AS (SELECT structure, list_sort(list({value}))[count(*) // 3 + 1] AS lo, list_sort(list({value}))[2 * count(*) // 3 + 1] AS hi FROM {table} GROUP BY 1),
tv AS (SELECT ps.structure, variant, any_value(n_sites) AS n_sites, avg({value}) AS mean_value, avg(CAST({value} <= lo AS INT)) AS {low}, avg(CAST({value} > lo AND {value} >= hi AS INT)) AS {high} FROM ps JOIN {table} USING (structure, residue) JOIN cuts USING (structure) GROUP BY 1, 2),
tk AS (SELECT *, unnest(['all', CASE WHEN n_sites = 1 THEN 'single' ELSE 'multi' END]) AS kind FROM tv)
SELECT structure, kind, count(*) AS n, {r('avg(mean_value)')} AS mean_value, {r('avg(exposed)')} AS exposed, {r('avg(buried)')} AS buried FROM tk GROUP BY 1, 2"""


def by_tertile(spark, sf, residues, value: str, exposed_low: bool):
    low, high = ("exposed", "buried") if exposed_low else ("buried", "exposed")
    residues = written(residues, "residues")
    cuts = K.at_indexes(residues, ["structure"], value, lo=F.floor(F.col("n") / 3), hi=F.floor(F.col("n") * 2 / 3))
    d = mutated(spark, sf).join(residues, ["structure", "residue"]).join(cuts, "structure")
    v = F.col(value)
    d = d.groupBy("structure", "variant", "n_sites").agg(F.avg(value).alias("mean_value"), F.avg((v <= F.col("lo")).cast("int")).alias(low), F.avg(((v > F.col("lo")) & (v >= F.col("hi"))).cast("int")).alias(high))
    d = d.withColumn("kind", F.explode(F.array(F.lit("all"), F.when(F.col("n_sites") == 1, "single").otherwise("multi"))))
    return rounded(d.groupBy("structure", "kind").agg(F.count("*").alias("n"), F.avg("mean_value").alias("mean_value"), F.avg("exposed").alias("exposed"), F.avg("buried").alias("buried")))


@add(f"{C}, {NB}, {_PS}, {_by_tertile('nb', 'neighbours', True)}")
def exposure_summary(spark, sf):
    """Neighbour counts of the mutated residues; few neighbours mean exposed."""
    return by_tertile(spark, sf, T.radius_counts(X.coords(spark, sf), 10.0), "neighbours", True)


_BALL = "ball(i, ux, uy, uz) AS (VALUES " + ", ".join(f"({i}, {x!r}::DOUBLE, {y!r}::DOUBLE, {z!r}::DOUBLE)" for i, x, y, z in T.sphere_points()) + ")"
_SASA = f"""{_BALL}, sp AS (SELECT structure, residue, i, x + 4.0 * ux AS x, y + 4.0 * uy AS y, z + 4.0 * uz AS z FROM coords, ball),
cov AS (SELECT DISTINCT a.structure, a.residue, a.i FROM sp a JOIN coords b ON a.structure = b.structure AND a.residue <> b.residue AND {_D2} <= 16.0),
cn AS (SELECT structure, residue, count(*) AS c FROM cov GROUP BY 1, 2), sasa AS (SELECT structure, residue, {4 * math.pi * 16!r}::DOUBLE * (32 - coalesce(c, 0)) / 32 AS sasa FROM coords LEFT JOIN cn USING (structure, residue))"""


@add(f"{C}, {_SASA} SELECT structure, residue, {r('sasa')} AS sasa FROM sasa")
def residue_sasa(spark, sf):
    return rounded(T.residue_sasa(X.coords(spark, sf)).drop("covered"))


@add(f"{C}, {_SASA}, {_PS}, {_by_tertile('sasa', 'sasa', False)}")
def sasa_summary(spark, sf):
    """Free surface of the mutated residues; a large one means exposed."""
    return by_tertile(spark, sf, T.residue_sasa(X.coords(spark, sf)).drop("covered"), "sasa", False)


@add(f"""{C}, {SITES}, po AS (SELECT DISTINCT structure, unnest(positions) + 8 AS position FROM sites), o AS (SELECT structure, count_if(position IN (SELECT residue FROM coords c WHERE c.structure = po.structure)) AS plain,
count_if(position - 8 IN (SELECT residue FROM coords c WHERE c.structure = po.structure)) AS moved FROM po GROUP BY 1) SELECT structure, plain, moved, CASE WHEN moved > plain THEN 8 ELSE 0 END AS "offset" FROM o""")
def align_offset(spark, sf):
    p = sites(spark, sf).select("structure", F.explode(F.transform("positions", lambda x: x + 8)).alias("position")).distinct()
    return T.align_offset(p, X.coords(spark, sf), 9)


@add(f"{C}, {_PD}, f AS (SELECT structure, avg(CASE WHEN min_distance < 20 THEN 1.0 ELSE 0.0 END) AS share FROM pd WHERE min_distance IS NOT NULL GROUP BY 1) SELECT structure, CASE WHEN share < 0.05 THEN 'low' WHEN share < 0.2 THEN 'mid' ELSE 'high' END AS bin FROM f")
def contact_bin(spark, sf):
    d = T.pair_distances(sites(spark, sf), X.coords(spark, sf)).where("min_distance is not null")
    f = d.groupBy("structure").agg(F.avg((F.col("min_distance") < 20).cast("double")).alias("share"))
    return f.select("structure", F.when(F.col("share") < 0.05, "low").when(F.col("share") < 0.2, "mid").otherwise("high").alias("bin"))


_EBIN = "CASE WHEN buried - exposed >= 0.15::DOUBLE THEN 'buried_enriched' WHEN exposed - buried >= 0.15::DOUBLE THEN 'exposed_enriched' ELSE 'mixed' END"


@add(f"{C}, {NB}, {_EXP} SELECT structure, variant, {_EBIN} AS bin FROM ex")
def exposure_bin(spark, sf):
    gap = F.col("exposed") - F.col("buried")
    return exposure(spark, sf).select("structure", "variant", F.when(gap <= -0.15, "buried_enriched").when(gap >= 0.15, "exposed_enriched").otherwise("mixed").alias("bin"))


@add(f"{C}, {NB}, {_EXP}, g AS (SELECT c_custkey AS variant, c_acctbal AS gain FROM customer) SELECT coalesce({_EBIN.replace('ELSE', 'WHEN exposed IS NOT NULL THEN')}, 'missing') AS bin, count(*) AS n, {r('avg(gain)')} AS mean_gain FROM g LEFT JOIN ex USING (variant) GROUP BY 1")
def gain_bin_join(spark, sf):
    g = X.table(spark, sf, "customer").selectExpr("c_custkey AS variant", "c_acctbal AS gain")
    b = g.join(exposure_bin(spark, sf), "variant", "left").withColumn("bin", F.coalesce("bin", F.lit("missing")))
    return rounded(b.groupBy("bin").agg(F.count("*").alias("n"), F.avg("gain").alias("mean_gain")))


@add(f"{C}, {NB}, {_EXP} SELECT structure % 3 AS type, {_EBIN} AS bin, count(*) AS n, {r('avg(c_acctbal)')} AS mean_gain FROM ex JOIN customer ON c_custkey = variant GROUP BY 1, 2")
def gain_by_bin(spark, sf):
    b = exposure_bin(spark, sf).join(X.table(spark, sf, "customer"), F.col("c_custkey") == F.col("variant"))
    return rounded(b.groupBy((F.col("structure") % 3).alias("type"), "bin").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("mean_gain")))


@add(f"{C}, n AS (SELECT n_nationkey AS assay, n_nationkey % 13 AS structure FROM nation) SELECT assay, 1 AS named, CAST(structure IN (SELECT structure FROM coords) AS INT) AS present FROM n")
def structure_availability(spark, sf):
    n = X.table(spark, sf, "nation").select(F.col("n_nationkey").alias("assay"), (F.col("n_nationkey") % 13).alias("structure"))
    c = X.coords(spark, sf).select("structure", F.lit(1).alias("there")).distinct()
    return n.join(c, "structure", "left").select("assay", F.lit(1).alias("named"), F.coalesce("there", F.lit(0)).alias("present"))


@add(f"""{ZS25.replace('WITH ', f'WITH {X.TYPES}, {X.COORDS}, ', 1)}, {GAINS}, av AS (SELECT 'NATION_' || n_nationkey AS assay, CAST(n_nationkey % 13 IN (SELECT structure FROM coords) AS INT) AS present FROM nation)
SELECT assay_type, 1 AS named, present, count(*) AS n_assays, {r('avg(gain)')} AS mean_gain FROM gains JOIN types USING (assay) JOIN av USING (assay) WHERE gain IS NOT NULL GROUP BY 1, 2, 3""")
def structure_gain_summary(spark, sf):
    """Gain of the methods that use a structure, by assay type and by whether one is there."""
    a = structure_availability(spark, sf).withColumn("assay", F.concat(F.lit("NATION_"), F.col("assay").cast("string")))
    g = gains(zero_shot(long25(spark, sf))).where("gain is not null").join(X.assay_types(spark, sf), "assay").join(a, "assay")
    return rounded(g.groupBy("assay_type", "named", "present").agg(F.count("*").alias("n_assays"), F.avg("gain").alias("mean_gain")))
