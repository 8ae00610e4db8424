"""Column functions: number parsing, mutation strings, keyword classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spellings of an unmutated variant, texts that stand for no number, and the kinds of
# predictors with the names or prefixes that tell them, the first that fits counts.
WILDTYPE = ("", "WT", "wildtype", "_wt")
NO_NUMBER = ("", "nan", "none", "na")
PREDICTOR_NAMES = {
    "additive_or_site_independent": ("Site_Independent",),
    "other_variant_effect": ("VESPA", "VESPAl", "VespaG", "ESCOTT", "VenusREM", "SiteRM"),
}
PREDICTOR_PREFIXES = [
    ("evolution_or_msa", ("EVmutation", "DeepSequence", "EVE", "MSA_Transformer", "GEMME", "RSALOR")),
    ("sequence_plm", ("ESM1", "ESM2", "ESM3", "ESMC", "Unirep", "CARP")),
    ("generative_plm", ("RITA", "Progen", "ProtGPT2", "Wavenet", "xTrimoPGLM")),
    ("retrieval_or_hybrid", ("Tranception", "TranceptEVE", "PoET", "MULAN")),
    ("structure_aware", ("MIF", "ESM-IF1", "ProteinMPNN", "SaProt", "ProSST", "ProtSSN", "S2F", "S3F")),
]


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def parse_finite(text: Column) -> Column:
    """The finite number that the text spells, else null."""
    t = F.trim(text)
    return F.when(~F.lower(t).isin(*NO_NUMBER), finite(t.try_cast("double")))


def parse_label(*columns: Column) -> Column:
    """1 if the first column that isn't null is above 0, 0 if not, null without any."""
    v = F.coalesce(*columns)
    return F.when(v > 0, 1).when(v.isNotNull(), 0)


def mutation_parts(mutant: Column) -> Column:
    return F.when(mutant.isin(*WILDTYPE), F.array().cast("array<string>")).otherwise(F.split(mutant, ":"))


def mutation_order(mutant: Column) -> Column:
    return F.when(mutant.isin(*WILDTYPE), 0).otherwise(F.size(F.split(mutant, ":")))


def order_bucket(order: Column) -> Column:
    return F.when(order == 1, "single").when(order == 2, "double").when(order > 2, "higher").otherwise("wt_or_unknown")


def mutation_sites(parts: Column) -> Column:
    """Distinct positions: tokens of three characters or more without their first and last one."""
    return F.array_distinct(F.transform(F.filter(parts, lambda p: F.length(p) >= 3), lambda p: F.substr(p, F.lit(2), F.length(p) - 2)))


def site_pair_key(parts: Column) -> Column:
    return F.array_join(F.array_sort(mutation_sites(parts)), ":")


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws(":", F.least(a, b), F.greatest(a, b))


def mutation_pairs(parts: Column) -> Column:
    """All 2-combinations of the parts in their order, as structs of a and b."""
    later = lambda p, i: F.transform(F.slice(parts, i + 2, F.size(parts)), lambda q: F.struct(p.alias("a"), q.alias("b")))
    return F.flatten(F.transform(parts, later))


def regex_positions(mutant: Column) -> Column:
    return F.regexp_extract_all(mutant, F.lit(r"[A-Z*](\d+)[A-Z*]"), F.lit(1))


def protein_key(name: Column) -> Column:
    """The first two `_` tokens if the second is in capitals or starts with a digit, else the first."""
    t = F.split(name, "_")
    second = F.get(t, 1)
    capital = (second == F.upper(second)) & (F.upper(second) != F.lower(second))
    return F.when(capital | second.rlike("^[0-9]"), F.concat_ws("_", F.get(t, 0), second)).otherwise(F.get(t, 0))


def prefix_category(name: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The category of the first rule whose prefix the name has."""
    chain = reduce(lambda acc, r: acc.when(F.startswith(name, F.lit(r[0])), r[1]), rules[1:], F.when(F.startswith(name, F.lit(rules[0][0])), rules[0][1]))
    return chain.otherwise(default)


def keyword_category(name: Column, rules: list[tuple[list[str], str]], default: str) -> Column:
    """The category of the first rule one of whose keywords lies in the lower-cased name."""
    low = F.lower(name)
    hit = [reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]) for words, _ in rules]
    chain = F.when(hit[0], rules[0][1])
    for h, (_, c) in zip(hit[1:], rules[1:]):
        chain = chain.when(h, c)
    return chain.otherwise(default)


def r6(x: Column) -> Column:
    """x to six places, without -0.0."""
    return F.round(x, 6) + F.lit(0.0)


def predictor_category(name: Column) -> Column:
    """Kind of a predictor by its whole name, then by its prefix; 'other' where nothing fits."""
    out = F.lit("other")
    for kind, prefixes in reversed(PREDICTOR_PREFIXES):
        out = F.when(reduce(lambda a, b: a | b, [name.startswith(p) for p in prefixes]), kind).otherwise(out)
    for kind, names in PREDICTOR_NAMES.items():
        out = F.when(name.isin(*names), kind).otherwise(out)
    return out
