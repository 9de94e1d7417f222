"""Formulas, weights and assembly of building units, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triplespan.functions.text import let

# Average atomic weights; other elements weigh 0.
WEIGHTS = {
    "H": 1.00794, "C": 12.0107, "N": 14.0067, "O": 15.9994, "F": 18.9984032, "P": 30.973762,
    "S": 32.065, "Cl": 35.453, "Br": 79.904, "I": 126.90447, "Cu": 63.546, "Mo": 95.95,
    "Co": 58.933, "V": 50.9415, "Pd": 106.42, "B": 10.811, "Si": 28.0855, "Se": 78.96,
    "Sb": 121.760, "Te": 127.60, "Al": 26.9815386, "Ca": 40.078, "Fe": 55.845, "Ni": 58.6934,
    "Zn": 65.38, "Ag": 107.8682, "Cd": 112.411, "Sn": 118.710, "Pb": 207.2, "Mn": 54.938045,
    "Cr": 51.9961, "Ti": 47.867, "Zr": 91.224, "Hf": 178.49, "Nb": 92.90638, "Ta": 180.94788,
    "W": 183.84, "Re": 186.207, "Os": 190.23, "Ir": 192.217, "Pt": 195.084, "Au": 196.966569,
    "Hg": 200.59, "Tl": 204.3833, "Bi": 208.98040, "Po": 208.982, "At": 209.987, "Rn": 222.018,
    "Li": 6.941, "Be": 9.012182, "Na": 22.98976928, "Mg": 24.305, "K": 39.0983, "Rb": 85.4678,
    "Cs": 132.9054519, "Ba": 137.327, "Ra": 226.025,
}
# The order of elements in a formula; others follow by name.
ORDER = (
    "C", "H", "N", "O", "F", "P", "S", "Cl", "Br", "I", "B", "Si", "Se", "Sb", "Te", "Mo", "Co", "V", "Cu", "Pd",
    "Al", "Ca", "Fe", "Ni", "Zn", "Ag", "Cd", "Sn", "Pb", "Mn", "Cr", "Ti", "Zr", "Hf", "Nb", "Ta", "W", "Re", "Os", "Ir",
    "Pt", "Au", "Hg", "Tl", "Bi", "Po", "At", "Rn", "Li", "Be", "Na", "Mg", "K", "Rb", "Cs", "Ba", "Ra",
)
# Assembly models (unit a, unit b, number of a, number of b, symmetry).
MODELS = (
    ("5-pyramidal", "2-linear", 12, 30, "Ih"), ("2-linear", "5-pyramidal", 30, 12, "Ih"),
    ("4-planar", "2-bent", 12, 24, "Oh"), ("2-bent", "4-planar", 24, 12, "Oh"),
    ("4-pyramidal", "3-planar", 6, 8, "Oh"), ("3-planar", "4-pyramidal", 8, 6, "Oh"),
    ("3-pyramidal", "4-planar", 6, 8, "Oh"), ("4-planar", "3-pyramidal", 8, 6, "Oh"),
)
# Point group of a polyhedron's symbol.
POINT_GROUPS = {"tet": "Td", "oct": "Oh", "cub": "Oh", "cuo": "Oh", "twc": "D3h", "ico": "Ih", "dod": "Ih", "ido": "Ih"}

ATOMS = "array<struct<element:string,n:int>>"


def _elements(text: Column, times: Column) -> Column:
    """(element, count times `times`) for each element in turn."""
    found = F.regexp_extract_all(text, F.lit("[A-Z][a-z]?[0-9]*"), F.lit(0))
    number = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, "[0-9]+$", 0), F.lit("")).cast("int"), F.lit(1))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, "^[A-Z][a-z]?", 0).alias("element"), (number(x) * times).cast("int").alias("n")))


def atoms(formula: Column) -> Column:
    """Map from element to count. Outer brackets are dropped, the innermost (group)n scaled; a factor outside of nested
    groups has no effect, and neither has one of a hydrate."""
    f = F.regexp_replace(F.trim(F.coalesce(formula, F.lit(""))), r"^\[(.*)\]$", "$1")
    groups = F.regexp_extract_all(f, F.lit(r"\([^()]+\)[0-9]*"), F.lit(0))
    factor = lambda g: F.coalesce(F.nullif(F.regexp_extract(g, r"[0-9]+$", 0), F.lit("")).cast("int"), F.lit(1))
    inner = F.flatten(F.transform(groups, lambda g: _elements(F.regexp_extract(g, r"^\(([^()]+)\)", 1), factor(g))))
    rest = _elements(F.regexp_replace(f, r"\([^()]+\)[0-9]*", " "), F.lit(1))

    def totals(every: Column) -> Column:
        total = lambda e: F.aggregate(F.filter(every, lambda a: a["element"] == e), F.lit(0), lambda s, a: s + a["n"])
        return let(F.array_distinct(F.transform(every, lambda a: a["element"])), lambda names: F.map_from_arrays(names, F.transform(names, total)))

    return let(F.concat(inner, rest), totals)


def formula(counts: Column) -> Column:
    """Carbon, hydrogen, then the fixed order, then others by name."""
    rank = F.create_map(*(x for i, e in enumerate(ORDER) for x in (F.lit(e), F.lit(i))))
    entries = F.filter(F.map_entries(counts), lambda e: e["value"] > 0)
    placed = F.array_sort(F.transform(entries, lambda e: F.struct(F.coalesce(F.element_at(rank, e["key"]), F.lit(len(ORDER))).alias("r"), e["key"].alias("e"), e["value"].alias("n"))))
    return F.array_join(F.transform(placed, lambda x: F.concat(x["e"], F.when(x["n"] > 1, x["n"].cast("string")).otherwise(""))), "")


def weight(counts: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in WEIGHTS.items() for x in pair))
    return F.round(F.aggregate(F.map_entries(counts), F.lit(0.0), lambda s, e: s + F.coalesce(F.element_at(table, e["key"]), F.lit(0.0)) * e["value"]), 4)


def formula_and_weight(counts: Column) -> Column:
    """(formula, weight) of `counts`, which are computed once."""
    return let(counts, lambda c: F.struct(formula(c).alias("formula"), weight(c).alias("weight")))


def candidate_score(found_formula: Column, found_weight: Column, target_formula: Column, target_weight: Column) -> Column:
    """6 for the same formula, and 4, 3, 2, 1 or 0 by relative error of the weight."""
    off = weight_error(found_weight, target_weight)
    by_weight = F.when(off <= 0.003, 4).when(off <= 0.007, 3).when(off <= 0.015, 2).when(off <= 0.03, 1).otherwise(0)
    return F.when(found_formula == target_formula, 6).otherwise(0) + by_weight


def weight_error(found: Column, target: Column) -> Column:
    return F.when(target == 0, 1.0).otherwise(F.abs(found - target) / target)


def is_formula_label(label: Column) -> Column:
    return label.rlike(r"[\[\]()CHNOSP]") & ~F.lower(label).rlike("unit|per|gram|mole|charge|angstrom")


def is_formula_identifier(identifier: Column) -> Column:
    return identifier.rlike(r"[\[\]()]") & identifier.rlike("C|H|N|O|Cu|Fe|Ni")


def formula_search(candidates: DataFrame, target: str, label: str = "label", strict: bool = False, limit: int = 10) -> DataFrame:
    """The best candidates for a target formula: highest score, then smallest error; ties by label. `strict` keeps equal formulas only."""
    counts = atoms(F.lit(target))
    scored = candidates.withColumn("counts", atoms(F.col(label))).withColumn("formula", formula(F.col("counts"))).withColumn("weight", weight(F.col("counts")))
    scored = scored.withColumn("score", candidate_score(F.col("formula"), F.col("weight"), formula(counts), weight(counts))).withColumn("error", F.round(weight_error(F.col("weight"), weight(counts)), 6)).drop("counts")
    scored = scored.where(F.col("formula") == formula(counts)) if strict else scored
    return scored.orderBy(F.desc("score"), "error", *(c for c in candidates.columns)).limit(limit)


def unit_kind(modularity: Column, planarity: Column) -> Column:
    """The canonical kind of a building unit, such as 4-planar."""
    p = F.lower(F.trim(F.coalesce(planarity, F.lit(""))))
    shape = F.when(modularity == 2, F.when(p == "linear", "linear").otherwise("bent")).when(modularity.isin(3, 4) & (p == "planar"), "planar").otherwise("pyramidal")
    return F.concat(modularity.cast("string"), F.lit("-"), shape)


def toggled_kind(kind: Column) -> Column:
    other = F.create_map(*map(F.lit, ("linear", "bent", "bent", "linear", "planar", "pyramidal", "pyramidal", "planar")))
    size, shape = F.substring_index(kind, "-", 1), F.substring_index(kind, "-", -1)
    return F.concat(size, F.lit("-"), F.coalesce(F.element_at(other, shape), shape))


def charge_text(q: Column) -> Column:
    return F.when(q == 0, "").otherwise(F.concat(F.lit("^{"), F.abs(q).cast("string"), F.when(q > 0, "+}").otherwise("-}")))


def models(spark: SparkSession) -> DataFrame:
    rows = [(i, *m) for i, m in enumerate(MODELS)]
    return spark.createDataFrame(rows, "model int, kind_a string, kind_b string, n_a int, n_b int, symmetry string")


def assembled(pairs: DataFrame) -> DataFrame:
    """Per row of `pairs` (id, formula, charge, modularity, planarity of a and b) every model that fits, whether its
    valences close, total charge and formula, and `best` for the first that closes, or else the first."""
    spark = pairs.sparkSession
    kinds = pairs.withColumn("kind_a", unit_kind(F.col("modularity_a"), F.col("planarity_a"))).withColumn("kind_b", unit_kind(F.col("modularity_b"), F.col("planarity_b")))
    found = kinds.join(F.broadcast(models(spark)), ["kind_a", "kind_b"])
    found = found.withColumn("closes", F.col("n_a") * F.col("modularity_a") == F.col("n_b") * F.col("modularity_b"))
    charge = F.col("n_a") * F.col("charge_a") + F.col("n_b") * F.col("charge_b")
    found = found.withColumn("charge", charge).withColumn("formula", F.concat("formula_a", "n_a", "formula_b", "n_b", charge_text(charge)))
    best = found.groupBy("id").agg(F.min_by("model", F.struct(~F.col("closes"), F.col("model"))).alias("best_model"))
    return found.join(best, "id").withColumn("best", F.col("model") == F.col("best_model")).drop("best_model")


def suggestions(pairs: DataFrame) -> DataFrame:
    """Models that fit once the planarity of one of the two units is toggled."""
    kinds = pairs.select("id", "modularity_a", "modularity_b", unit_kind(F.col("modularity_a"), F.col("planarity_a")).alias("a"), unit_kind(F.col("modularity_b"), F.col("planarity_b")).alias("b"))
    turned = kinds.select("id", "modularity_a", "modularity_b", toggled_kind(F.col("a")).alias("kind_a"), F.col("b").alias("kind_b")).union(
        kinds.select("id", "modularity_a", "modularity_b", F.col("a").alias("kind_a"), toggled_kind(F.col("b")).alias("kind_b"))
    )
    found = turned.join(F.broadcast(models(pairs.sparkSession)), ["kind_a", "kind_b"])
    return found.withColumn("closes", F.col("n_a") * F.col("modularity_a") == F.col("n_b") * F.col("modularity_b"))


def assembly_formula(first: Column, second: Column, label: Column) -> Column:
    """The whole formula from two unit formulas and a label (m-planarity)xN(m-planarity)xN; empty if one is missing."""
    pattern = r"^\(([0-9]+)-(?:planar|bent|linear|pyramidal)\)x([0-9]+)\(([0-9]+)-(?:planar|bent|linear|pyramidal)\)x([0-9]+)$"
    part = lambda i: F.regexp_extract(label, pattern, i)
    higher_first = part(1).try_cast("int") >= part(3).try_cast("int")
    counts = [F.when(higher_first, part(i)).otherwise(part(j)) for i, j in ((2, 4), (4, 2))]
    known = label.rlike(pattern) & (F.coalesce(first, F.lit("")) != "") & (F.coalesce(second, F.lit("")) != "")
    return F.when(known, F.concat(first, counts[0], second, counts[1])).otherwise("")


def point_group(c: Column) -> Column:
    c = F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit("_"), F.lit("")))
    usual = F.create_map(*(F.lit(x) for g in ("Oh", "Td", "Ih", "D3h", "D5h", "D2d") for x in (g.lower(), g)))
    return F.coalesce(F.element_at(usual, F.lower(c)), F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30)))


def bound_symbol(symbol: Column, group: Column) -> Column:
    """(symbol, point group): a known symbol decides the group; without one a group with a single symbol decides it."""
    code = F.lower(F.trim(F.coalesce(symbol, F.lit(""))))
    by_symbol = F.create_map(*(F.lit(x) for pair in POINT_GROUPS.items() for x in pair))
    single = [(g, s) for s, g in POINT_GROUPS.items() if list(POINT_GROUPS.values()).count(g) == 1]
    by_group = F.create_map(*(F.lit(x) for pair in single for x in pair))
    canon = point_group(group)
    return F.struct(
        F.when(code != "", code).otherwise(F.coalesce(F.element_at(by_group, canon), F.lit(""))).alias("symbol"),
        F.when(code != "", F.coalesce(F.element_at(by_symbol, code), canon)).otherwise(canon).alias("point_group"),
    )
