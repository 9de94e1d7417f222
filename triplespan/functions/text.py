"""Normalisers for labels, names, amounts and identifiers, as Spark column expressions.

Each takes and returns a string column; NULL gives what an empty text gives. Only what Spark has no function for (NFKC,
full case folding) is a pandas UDF.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters and their replacements.
SCRIPT_DIGITS = ("₀₁₂₃₄₅₆₇₈₉⁰¹²³⁴⁵⁶⁷⁸⁹", "01234567890123456789")
SIGNS = ("·•⋅×÷", "...x/")
GREEK_NAMES = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "μ": "mu", "ν": "nu", "π": "pi"}
GREEK_LETTERS = ("abgdezhqiklmnxoprstufcyw", "αβγδεζηθικλμνξοπρστυφχψω")
# What counts as not available, by use.
NA_FINGERPRINT = ("", "n/a", "na", "-1", "-1.0", "-1e+00", "-1e+0", "-1.00")
NA_RECORD = ("n/a", "na", "n.a.", "none", "null", "-", "")
NA_NAME = ("n/a", "na", "")
# Spellings of units and common values, and their canonical form.
CANONICAL = {
    "°c": "degree celsius",
    "degree c": "degree celsius",
    "degrees celsius": "degree celsius",
    "degrees c": "degree celsius",
    "deg c": "degree celsius",
    "degc": "degree celsius",
    "celsius": "degree celsius",
    "room temperature": "25 degree celsius",
    "rt": "25 degree celsius",
    "ambient temperature": "25 degree celsius",
    "°c/min": "degree celsius per minute",
    "kelvin per hour": "degree celsius per hour",
    "°c/hour": "degree celsius per hour",
    "°c per hour": "degree celsius per hour",
    "milliliter": "ml",
    "milliliters": "ml",
    "millilitre": "ml",
    "millilitres": "ml",
    "liter": "l",
    "liters": "l",
    "litre": "l",
    "litres": "l",
    "gram": "g",
    "grams": "g",
    "milligram": "mg",
    "milligrams": "mg",
    "microgram": "μg",
    "micrograms": "μg",
    "kilogram": "kg",
    "kilograms": "kg",
    "millimole": "mmol",
    "millimoles": "mmol",
    "mole": "mol",
    "moles": "mol",
    "micromole": "μmol",
    "micromoles": "μmol",
    "hour": "h",
    "hours": "h",
    "hrs": "h",
    "hr": "h",
    "minute": "min",
    "minutes": "min",
    "mins": "min",
    "second": "s",
    "seconds": "s",
    "sec": "s",
    "secs": "s",
    "day": "d",
    "days": "d",
    "week": "wk",
    "weeks": "wk",
    "month": "mo",
    "months": "mo",
    "n2": "nitrogen",
    "ar": "argon",
    "inert atmosphere": "inert",
    "na": "n/a",
    "not applicable": "n/a",
    "not available": "n/a",
    "none": "n/a",
    "no data": "n/a",
    "unknown": "n/a",
    "-": "n/a",
    "": "n/a",
    "slowly": "n/a",
    "; n/a mmol": "",
    ", n/a mmol": "",
    "one drop": "1 drop",
    "two drops": "2 drops",
    "three drops": "3 drops",
    "four drops": "4 drops",
    "five drops": "5 drops",
    "six drops": "6 drops",
    "seven drops": "7 drops",
    "eight drops": "8 drops",
    "nine drops": "9 drops",
    "cu(no3)2.6h2o": "cu(no3)2·6h2o",
    "h2ipr-cdc": "h2(ipr-cdc)",
}
# Other names of substances, and the name that stands for them.
SYNONYMS = {
    "n, n-dimethylformamide": "dmf",
    "dimethylformamide": "dmf",
    "n, n'-dimethylformamide": "dmf",
    "n, n-diethylformamide": "def",
    "diethylformamide": "def",
    "n, n-dimethylacetamide": "dma",
    "dimethylacetamide": "dma",
    "n, n'-dimethylacetamide": "dma",
    "water": "h2o",
    "methanol": "meoh",
    "ch3oh": "meoh",
    "methyl alcohol": "meoh",
    "ethanol": "etoh",
    "ch3ch2oh": "etoh",
    "tetrahydrofuran": "thf",
    "acetonitrile": "mecn",
    "zirconocene dichloride": "cp2zrcl2",
    "bis(cyclopentadienyl)zirconium dichloride": "cp2zrcl2",
    "vanadium(iii) chloride": "vcl3",
    "1, 3, 5-triamino-2, 4, 6-trinitrobenzene": "h3tatb",
    "nickel(ii) acetate tetrahydrate": "ni(acetate)2·4h2o",
    "copper(ii) nitrate trihydrate": "cu(no3)2·3h2o",
    "copper(ii) chloride dihydrate": "cucl2·2h2o",
    "vanadyl sulfate hydrate": "voso4·xh2o",
    "vanadyl acetylacetonate": "vo(acac)2",
    "5-ethoxy isophthalic acid": "5-eia",
    "5-(n-propyloxy) isophthalic acid": "5-pria",
    "d-camphoric acid": "h2d-cam",
    "5-methoxy isophthalic acid": "5-mia",
    "4, 4'-(naphthalene-1, 4-diyl)dibenzoic acid": "h2ndbdc",
    "4, 4'-(anthracene-9, 10-diyl)dibenzoic acid": "h2adbdc",
    "4, 4'-(porphyrin-5, 15-diyl)dibenzoic acid": "h2dcpp",
}
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def let(value: Column, body) -> Column:
    """body(value) with `value` computed once a row, however often `body` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _known(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _looked_up(c: Column, table: dict[str, str]) -> Column:
    """What the table has for the value, else the value, which is computed once; one constant map, built once a query."""
    known = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return let(c, lambda x: F.coalesce(F.element_at(known, x), x))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(_known(c), f"^{SPACE}|{SPACE}$", "")


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(_known(c), SPACE, " "))


def normal_label(c: Column) -> Column:
    return collapsed(F.lower(c))


def match_label(c: Column) -> Column:
    """For matching: folded case, underscores as spaces, middle dots as dots."""
    return collapsed(F.translate(F.lower(_known(c)), "_·", " ."))


def plain_signs(c: Column) -> Column:
    """Raised and lowered digits, dots and Greek letters in plain characters."""
    c = F.translate(c, SCRIPT_DIGITS[0] + SIGNS[0], SCRIPT_DIGITS[1] + SIGNS[1])
    for letter, name in GREEK_NAMES.items():
        c = F.replace(c, F.lit(letter), F.lit(name))
    return c


def plain_quotes(c: Column) -> Column:
    return F.translate(c, "‴″”′’", "\"\"\"''")


def fingerprint(c: Column) -> Column:
    """For robust comparison. What stands for not available is recognised before characters are replaced."""
    c = trimmed(c)
    return F.when(F.lower(c).isin(*NA_FINGERPRINT), "").otherwise(F.lower(collapsed(plain_quotes(plain_signs(c)))))


def mapped(c: Column) -> Column:
    """Units and common values in canonical form."""
    return _looked_up(trimmed(F.lower(_known(c))), CANONICAL)


NUMBER = r"[0-9]+\.?[0-9]*|\.[0-9]+"


def short_number(c: Column) -> Column:
    """24.0 as 24; other numbers, and what is none, stay."""
    value = F.when(c.rlike(rf"^({NUMBER})$"), c.try_cast("double"))
    return F.when((value == F.floor(value)) & (value < 1e15), value.cast("long").cast("string")).otherwise(c)


def _quantity(part: Column, number) -> Column:
    """`number unit` with the unit mapped; NULL if the part is no quantity."""
    unit = F.regexp_extract(part, r"^([0-9.]+)\s*(.+)$", 2)
    return let(F.regexp_extract(part, r"^([0-9.]+)\s*(.+)$", 1), lambda n: F.when(n.rlike(rf"^({NUMBER})$"), F.concat(number(n), F.lit(" "), mapped(unit))))


def normal_value(c: Column) -> Column:
    """A step's value: quotes and spaces unified, mapped, quantities with short numbers; also lists of quantities."""
    c = F.translate(trimmed(c), SCRIPT_DIGITS[0] + "•′‵‘’″“”", SCRIPT_DIGITS[1] + "·''''\"\"\"")
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"\s*,\s*", ", "), r"\s*-\s+|\s+-", "-")

    def normal(c: Column) -> Column:
        listed = let(F.transform(F.split(c, ","), lambda p: _quantity(F.trim(p), short_number)), lambda parts: F.when(~F.exists(parts, lambda p: p.isNull()), F.array_join(parts, ", ")))
        whole = F.when(c.contains(","), listed)
        single = F.when(c.rlike(r"^[0-9.]+\s+[^0-9]"), F.coalesce(_quantity(c, short_number), c))
        return let(mapped(c), lambda m: F.when(m != c, m).otherwise(F.coalesce(whole, single, short_number(c))))

    return let(F.trim(F.lower(c)), normal)


def two_decimals(c: Column) -> Column:
    """Integers stay; others get two decimals, half to even on the decimal digits."""
    value = c.try_cast("double")
    return F.when(F.abs(value - F.round(value)) < 1e-9, F.round(value).cast("long").cast("string")).otherwise(F.bround(value.cast("decimal(38,18)"), 2).cast("decimal(38,2)").cast("string"))


def normal_amount(c: Column) -> Column:
    """An amount of substance: `0.045 g (0.276 mmol)` as `0.28 mmol, 0.04 g`; moles first, then mass, volume, others."""
    c = F.regexp_replace(F.regexp_replace(trimmed(c), r"\s+", " "), r",\s*", ", ")
    c = F.trim(F.lower(c))
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\s*\(\s*", ", "), r"\s*\)\s*", ""), r"\s*;\s*", ", ")

    def rank(item: Column) -> Column:
        unit = F.split(F.regexp_extract(item, r"^\S+ (.*)$", 1), " ")[0]
        return F.when(unit.isin("mol", "mmol", "μmol", "umol"), 0).when(unit.isin("kg", "g", "mg", "μg"), 1).when(unit.isin("l", "ml"), 2).otherwise(3)

    def listed(items: Column) -> Column:
        sorted_ = F.array_sort(F.transform(items, lambda x, i: F.struct(rank(x).alias("rank"), i.alias("i"), x.alias("x"))))
        return F.when((F.size(items) > 0) & ~F.exists(items, lambda x: x.isNull()), F.array_join(F.transform(sorted_, lambda x: x["x"]), ", "))

    def normal(c: Column) -> Column:
        parts = F.filter(F.transform(F.split(c, ","), lambda p: F.trim(p)), lambda p: p != "")
        whole = F.when(c.contains(","), let(F.transform(parts, lambda p: _quantity(p, two_decimals)), listed))
        return F.coalesce(whole, _quantity(c, two_decimals), normal_value(c))

    return let(c, normal)


def substance(c: Column) -> Column:
    """A substance's first name."""
    return _looked_up(normal_value(c), SYNONYMS)


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def nfkc_folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def slug(c: Column, folded: Column | None = None) -> Column:
    """A name for an IRI; `folded` may give the text already in NFKC and folded, which plain ASCII is when lower-cased."""
    c = nfkc_folded(_known(c)) if folded is None else folded
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, SPACE, "-"), r"[^a-z0-9_-]+", "-"), r"-+", "-")
    c = F.regexp_replace(c, r"^-|-$", "")
    return F.when(c == "", "entity").otherwise(c)


def clean_label(c: Column) -> Column:
    """NFKC, without control characters, with Greek letters for single letters after - or _ (VMOP-b as VMOP-β)."""
    c = F.regexp_replace(F.regexp_replace(nfkc(_known(c)), r"\p{C}+", ""), SPACE, " ")
    for latin, greek in zip(*GREEK_LETTERS, strict=True):
        c = F.regexp_replace(c, rf"(?U)(?<=[-_]){latin}\b", greek)
    c = collapsed(c)
    return F.when(c == "", "entity").otherwise(c)


def product_name(c: Column) -> Column:
    c = trimmed(F.lower(_known(c)))
    return F.when(c.isin(*NA_NAME), "").otherwise(collapsed(F.replace(plain_signs(c), F.lit("_"), F.lit(" "))))


def deposit_number(c: Column) -> Column:
    """A structure's deposit number: more than five digits get a space before the last one."""
    c = trimmed(F.lower(_known(c)))
    digits = F.regexp_replace(c, r"\s+", "")
    spaced = F.regexp_replace(digits, r"^([0-9]+)([0-9])$", "$1 $2")
    return F.when(c.isin(*NA_NAME), "").when(digits.rlike("^[0-9]{6,}$") | c.rlike(r"^[0-9]+\s+[0-9]$"), spaced).otherwise(c)


def unit_name(c: Column) -> Column:
    """A building unit's name without brackets, spaces, hyphens and underscores."""
    c = trimmed(F.lower(_known(c)))
    plain = F.regexp_replace(plain_signs(c), r"^\[(.*)\]$", "$1")
    return F.when(c.isin(*NA_NAME), "").otherwise(F.regexp_replace(plain, r"[\s_()-]", ""))


def unit_formula(c: Column) -> Column:
    c = F.replace(trimmed(F.lower(_known(c))), F.lit("(c6h3)2"), F.lit("(c12h6)"))
    c = F.regexp_replace(c, r"(?<![a-z0-9])phpo3(?![a-z0-9])", "c6h5po3")
    return F.replace(c, F.lit("v6o6(och3)9(vo4)"), F.lit("v7o10(och3)9"))


def record_value(c: Column) -> Column:
    """A characterisation value: quotes, spaces, lists and dots unified; empty if not available."""
    c = F.regexp_replace(plain_quotes(trimmed(c)), SPACE, " ")
    for pattern, to in ((r"\s*,\s*", ", "), (r"\s*;\s*", "; "), (r",\s*and\s+", ", ")):
        c = F.regexp_replace(c, pattern, to)
    c = F.trim(F.lower(F.translate(c, "μ⋅∙", "µ··")))
    return let(F.replace(c, F.lit("μ"), F.lit("µ")), lambda c: F.when(c.isin(*NA_RECORD), "").otherwise(c))


def percent_text(c: Column) -> Column:
    """`C: 37.50; H: 4.26` and `C 37.50, H 4.26` alike."""
    c = F.replace(F.replace(record_value(c), F.lit("%"), F.lit("")), F.lit(";"), F.lit(","))
    return F.replace(F.regexp_replace(c, r"([a-z]):\s*", "$1"), F.lit(" "), F.lit(""))


def material(c: Column) -> Column:
    return F.regexp_replace(record_value(c), r"\bkbr\s*pellets?\b", "kbr")


def spaced_brackets(c: Column) -> Column:
    c = record_value(c)
    for pattern, to in ((r"(?<=[0-9a-z])\s*\(", " ("), (r"\s*\)", ")"), (r",\s*", ", "), (r";\s*", "; "), (r"\s{2,}", " ")):
        c = F.regexp_replace(c, pattern, to)
    return F.trim(c)


def first_bands(c: Column) -> Column:
    """The first of several lists of infrared bands, without material, in cm-1."""
    c = F.regexp_replace(spaced_brackets(c), r"^kbr\s*(?:pellets?)?\s*,\s*", "")
    c = F.replace(F.replace(c, F.lit("cm⁻¹"), F.lit("cm-1")), F.lit("cm^-1"), F.lit("cm-1"))
    parts = F.filter(F.transform(F.split(c, ";"), lambda p: F.trim(p)), lambda p: p != "")
    return F.coalesce(F.get(parts, F.lit(0)), c)


def plain_formula(c: Column) -> Column:
    return F.translate(record_value(c), "·⋅∙ ", "")


def band_numbers(c: Column) -> Column:
    """Distinct numbers of three or four digits, rounded half to even."""
    found = F.regexp_extract_all(_known(c), F.lit(r"(?<![0-9.])([0-9]{3,4}(?:\.[0-9]+)?)(?![0-9])"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.bround(x.cast("decimal(20,10)"), 0).cast("int")))


def percents(c: Column) -> Column:
    """Element to share, from `C 37.5; H 4.2`."""
    pairs = F.regexp_extract_all(_known(c), F.lit(r"([A-Z][a-z]?)\s*:?\s*([0-9]+(?:\.[0-9]+)?)"), F.lit(0))
    entries = F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, "^[A-Z][a-z]?", 0).alias("k"), F.regexp_extract(x, r"[0-9.]+$", 0).cast("double").alias("v")))
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"]))


def bracket_formulas(c: Column) -> Column:
    return F.regexp_extract_all(_known(c), F.lit(r"\[[^\]]+\]"), F.lit(0))


def model_label(c: Column) -> Column:
    """An assembly-model label with its (m-planarity)xN parts in order."""
    return F.array_join(F.array_sort(F.regexp_extract_all(_known(c), F.lit(r"\([0-9]+-[a-z]+\)x[0-9]+"), F.lit(0))), "")


def doi(c: Column) -> Column:
    """A DOI from a link, or from a file name with an underscore for the slash."""
    c = F.regexp_replace(trimmed(F.lower(_known(c))), r"^(https?://)?(dx\.)?doi\.org/|^doi:\s*", "")
    return F.when(c.contains("/"), c).otherwise(F.regexp_replace(c, r"^(10\.[0-9]+)[_@]", "$1/"))


def document_key(c: Column) -> Column:
    return F.substring(F.sha2(_known(c), 256), 1, 8)


def camel(c: Column) -> Column:
    return F.concat(F.lower(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def yield_text(value: Column) -> Column:
    """42.0 as 42%, 42.5 as 42.5%."""
    return F.concat(F.when(F.abs(value - F.round(value)) < 1e-6, F.round(value).cast("long").cast("string")).otherwise(value.cast("string")), F.lit("%"))


def is_absolute_iri(c: Column) -> Column:
    return _known(c).rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://\S+$")


def is_empirical_formula(c: Column) -> Column:
    return _known(c).rlike(r"^(?:[A-Z][a-z]?[0-9]*)+$")


def is_deposit_number(c: Column) -> Column:
    return _known(c).rlike(r"^[0-9]+$")


def sentences(c: Column) -> Column:
    """Sentences by their marks; a dot inside a number also ends one."""
    return F.filter(F.transform(F.regexp_extract_all(_known(c), F.lit(r"[^.!?]+[.!?]*"), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")


def unwrapped(c: Column) -> Column:
    """Extracted text with hyphenated line ends joined and spaces collapsed."""
    return collapsed(F.regexp_replace(_known(c), r"-\n\s*", ""))
