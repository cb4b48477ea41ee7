"""Column functions that type, label and bucket identifiers and label texts. All stay in built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and names that results must agree with.
DOSAGE_FORMS = (
    ("oral_solid", r"\b(tablet|capsule|caplet|orally disintegrating|chewable)\b"),
    ("oral_liquid", r"\b(oral solution|oral suspension|syrup|elixir|oral liquid)\b"),
    ("transdermal", r"\b(transdermal|patch)\b"),
    ("inhalation", r"\b(inhalation|inhaler|nebuli[sz]|aerosol)\b"),
    ("injection", r"\b(injection|intravenous|subcutaneous|intramuscular|infusion|parenteral)\b"),
    ("implant", r"\b(implant|depot)\b"),
    ("topical", r"\b(topical|cream|ointment|gel|lotion)\b"),
)
FREQUENCIES = (
    ("four_times_daily", r"\b(four times (a |per )?da(y|ily)|q\.?i\.?d\.?|every 6 hours)\b"),
    ("three_times_daily", r"\b(three times (a |per )?da(y|ily)|t\.?i\.?d\.?|every 8 hours)\b"),
    ("twice_daily", r"\b(twice (a |per )?da(y|ily)|b\.?i\.?d\.?|every 12 hours)\b"),
    ("weekly_or_less", r"\b(once (a |per )?week|weekly|every (2|two|4|four) weeks|monthly)\b"),
    ("once_daily", r"\b(once (a |per )?da(y|ily)|daily|q\.?d\.?|every 24 hours)\b"),
    ("as_needed", r"\b(as needed|p\.?r\.?n\.?)\b"),
)
BIOAVAILABILITY = r"(?i)(?:absolute\s+)?(?:oral\s+)?bioavailability[^.]{0,80}?(\d{1,3}(?:\.\d+)?)\s*%"
ABSORPTION = r"(?i)(?:absorbed|absorption)[^.]{0,60}?(\d{1,3}(?:\.\d+)?)\s*%"
HALF_LIFE = r"(?i)half[-\s]?life[^.]{0,90}?(\d+(?:\.\d+)?)\s*(?:to|-|–)?\s*(\d+(?:\.\d+)?)?\s*(hour|hr|h\b|minute|min\b|day)"
CYP = r"(?i)CYP\s?([1-4][A-Z]\d{1,2})"
NOT_METABOLISED = r"(?i)(not (?:significantly |appreciably |extensively )?metaboli[sz]ed|undergoes (?:minimal|negligible) metabolism|excreted unchanged)"
BIOLOGIC_STEMS = ("mab", "cept", "kinra", "ase", "tide")
BIOLOGIC_WORDS = (
    "immunoglobulin", "insulin", "interferon", "interleukin", "antibody", "vaccine", "toxoid", "antigen", "albumin",
    "globulin", "peptide", "erythropoietin", "somatropin", "factor viii", "factor ix", "heparin", "enzyme", "protein",
    "conjugate", "peginterferon", "asparaginase",
)
SAFETY_WORDS = (
    "toxic", "safety", "death", "cardio", "hepato", "nephro", "carcino",
    "teratogen", "adverse", "arrhythm", "hemato", "neuro", "immune", "misuse",
)
COMMERCIAL_WORDS = ("commercial", "business", "marketing", "supply", "voluntar")
EFFICACY_WORDS = ("efficacy", "lack of effect", "ineffective")
NOVELTY = ((0, "High"), (10, "Moderate"), (50, "Low"))


def first_match(text: Column, choices) -> Column:
    """The name of the first pattern found, ignoring case; null if there is none."""
    return F.coalesce(*[F.when(text.rlike(f"(?i){p}"), F.lit(name)) for name, p in choices])


def _group(text: Column, pattern: str, i: int) -> Column:
    got = F.regexp_extract(text, pattern, i)
    return F.when(got != "", got)


def dosage_form(text: Column) -> Column:
    return first_match(text, DOSAGE_FORMS)


def dosing_frequency(text: Column) -> Column:
    return first_match(text, FREQUENCIES)


def bioavailability(text: Column) -> Column:
    """Percent in (0, 100]; null if the text names none."""
    v = F.coalesce(_group(text, BIOAVAILABILITY, 1), _group(text, ABSORPTION, 1)).try_cast("double")
    return F.when((v > 0) & (v <= 100), v)


def half_life_hours(text: Column) -> Column:
    """The mean of a range, in hours, to three places."""
    low = _group(text, HALF_LIFE, 1).try_cast("double")
    high = F.coalesce(_group(text, HALF_LIFE, 2).try_cast("double"), low)
    unit = F.lower(F.regexp_extract(text, HALF_LIFE, 3))
    hours = (low + high) / 2
    return F.bround(F.when(unit.startswith("min"), hours / 60).when(unit.startswith("day"), hours * 24).otherwise(hours), 3)


def cyp_bucket(text: Column) -> Column:
    kinds = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(CYP), 1), F.upper))
    several = F.when(F.array_contains(kinds, "3A4"), "cyp3a4").when(F.size(kinds) > 1, "multiple").when(F.size(kinds) == 1, "single_non_3a4")
    return F.when(text.rlike(NOT_METABOLISED), F.lit("none")).otherwise(several)


def withdrawal_reason(raw: Column) -> Column:
    """commercial before efficacy before safety; a reason that names none is unknown."""
    low = F.lower(raw)
    names = lambda words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    return F.when(names(COMMERCIAL_WORDS), "commercial").when(names(EFFICACY_WORDS), "efficacy").when(names(SAFETY_WORDS), "safety").otherwise("unknown")


def clinical_phase(stage: Column) -> Column:
    """Clinical stage names as phases."""
    key = F.regexp_replace(F.upper(stage), r"[^A-Z0-9/]+", "_")
    names = {"PRECLINICAL": 0.0, "EARLY_PHASE_1": 0.5, "PHASE_1": 1.0, "PHASE_1/PHASE_2": 1.5, "PHASE_2": 2.0, "PHASE_2/PHASE_3": 2.5, "PHASE_3": 3.0, "APPROVAL": 4.0, "PHASE_4": 4.0}
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key)


def removal_reason(name: Column, smiles: Column, weight: Column) -> Column:
    """Why a candidate is no small molecule; null if it is one."""
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    last = F.element_at(F.split(F.regexp_replace(low, "-", " "), r"\s+"), -1)
    word = reduce(lambda a, b: a | b, [low.contains(w) for w in BIOLOGIC_WORDS])
    stem = reduce(lambda a, b: a | b, [last.endswith(s) for s in BIOLOGIC_STEMS]) & (F.length(last) > 5)
    return (
        F.when(F.trim(F.coalesce(smiles, F.lit(""))) == "", F.lit("no defined chemical structure"))
        .when(word | stem, F.lit("biologic, not a small molecule"))
        .when(weight.try_cast("double") > 1200, F.lit("molecular weight above the small-molecule range"))
    )


def novelty_band(hits: Column) -> Column:
    out = F.when(hits.isNull(), F.lit("Unknown"))
    for most, name in NOVELTY:
        out = out.when(hits <= most, F.lit(name))
    return out.otherwise(F.lit("Well-explored"))


def novelty_hits(a: Column, b: Column) -> Column:
    """The sum of two counts; null only if both are."""
    return F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def squashed(score: Column) -> Column:
    """100 s / (s + 100), and 0 for scores that are not positive."""
    return F.when(score > 0, 100 * score / (score + 100)).otherwise(F.lit(0.0))


def entity_type(id_: Column) -> Column:
    """The type that the shape of an identifier suggests; the first rule that holds decides."""
    up = F.upper(F.trim(id_))
    return (
        F.when(up.rlike("^DB[0-9]"), "drug")
        .when(up.rlike("^(CHEMBL|CHEBI|PUBCHEM|CID)"), "drug")
        .when(up.rlike("^MESH:|^[DC][0-9]{6,9}$"), "disease")
        .when(up.rlike("^(MIM|OMIM)|^[0-9]{6}$"), "genetic_disorder")
        .when(up.rlike("^GO:"), "biological_process")
        .when(up.rlike("^R-[^-]+-[^-]+-[^-]+$"), "complex")
        .when(up.rlike("^(R-|HSA|MAP|SMP|REACT|KEGG|WP)"), "pathway")
        .when(up.rlike("^(COMPLEX|CPX)"), "complex")
        .when(up.rlike("^CVCL_"), "cell")
        .when(up.rlike("^(?=.*[0-9])[A-Z][A-Z0-9]{5,9}$"), "gene/protein")
        .otherwise("other")
    )


def human_label(kind: Column, name: Column) -> Column:
    """A label to show: the type as a prefix where ids are opaque, underscores as spaces, words capitalised."""
    spaced = F.initcap(F.regexp_replace(name, "_+", " "))
    prefix = F.when(kind == "biological_process", "GO: ").when(kind == "genetic_disorder", "OMIM: ").when(kind == "complex", "Complex: ").when(kind == "cell", "Cell: ").otherwise("")
    return F.concat(prefix, spaced)


def unresolved(id_: Column, name: Column) -> Column:
    """Whether a label is only an accession: empty, the id itself, or an accession after a prefix."""
    return F.coalesce(F.trim(name), F.lit("")).isin("") | (name == id_) | name.rlike(r"^[A-Z][A-Za-z ]*: ?[A-Z]+:?[0-9]+$")


def search_aliases(id_: Column, *names: Column) -> Column:
    """Names in order without the accession prefix, blanks, repeats and the accession; the accession if none is left."""
    clean = F.transform(F.array(*names), lambda n: F.trim(F.regexp_replace(F.coalesce(n, F.lit("")), "^UniProt:", "")))
    left = F.array_distinct(F.filter(clean, lambda n: (n != "") & (n != id_)))
    return F.when(F.size(left) == 0, F.array(id_)).otherwise(left)


def sanitised(text: Column) -> Column:
    """Everything but ASCII letters and digits as underscores."""
    return F.regexp_replace(F.trim(text), "[^a-zA-Z0-9]", "_")


def effect_key(text: Column) -> Column:
    return F.lower(F.replace(F.trim(text), F.lit(" "), F.lit("_")))


def repaired_url(url: Column) -> Column:
    """A URL with a scheme, one slash between its parts, and without white space; null if no host is left."""
    u = F.regexp_replace(F.trim(url), r"\s+", "")
    u = F.when(u.rlike("^https?://"), u).when(u.rlike("^//"), F.concat(F.lit("https:"), u)).otherwise(F.concat(F.lit("https://"), u))
    u = F.regexp_replace(u, r"(?<!:)/{2,}", "/")
    return F.when(u.rlike(r"^https?://[^/.]+\.[^/]+"), u)
