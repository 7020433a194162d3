"""What two analyte labels say of their chemistry, and whether that forbids taking them for the same.

A label is read once, from left to right, into tokens of nomenclature: chains (18:1 n-9), places of substituents (3,4-), double bonds
(9z-), rings' atoms ([6]-), lettered vitamins (B12), words and numbers. What a label says of an aspect is the set of values its
tokens give it. Two labels are compared aspect by aspect, and a table says which relations of which aspects tell them apart.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ascii_label_key
from .gates import first_reason

# The words that mark each aspect of a label, and the least scores of a lead.
FORMS = ("alpha", "beta", "gamma", "delta", "cis", "trans", "hydroxy")
EXPRESSIONS = ("available", "total", "by difference", "calculated", "labelling")
SCAFFOLDS = ("benzoic", "benzaldehyde", "phenylacetic", "quinic", "cinnamic", "caffeoylquinic", "feruloylquinic", "hydroxycinnamic")
VITAMERS = ("pyridoxine", "pyridoxal", "pyridoxamine", "nicotinic acid", "nicotinamide")
GLYCOSIDES = ("glucoside", "galactoside", "rhamnoside", "rutinoside", "xyloside", "xylosyl", "glucosyl", "glucuronide", "acetyl", "malonyl", "caffeoyl", "feruloyl", "succinyl", "dioxalyl", "gallate")
ISOMERS = {"cis": "cis", "c": "cis", "trans": "trans", "t": "trans", "cla": "conjugated"}
LEAST_SIMILARITY, LEAST_LEXICAL, LEAST_OVERLAP = 0.72, 0.72, 0.50

#: The tokens of a label; of several that begin at a place, the first.
_TOKEN = re.compile(
    r"""(?x)
    (?P<chain> (?P<carbons>\d\d?) \s?:\s? (?P<bonds>\d\d?) (?!\d) (?: \s? (?:n|omega) \s?-?\s? (?P<end>\d+) )? )
  | (?P<atom> \[ \s? \d+ \s? \] \s?-\s? [a-z]+ )
  | (?P<places> \d+ (?: \s?,\s? \d+ )* (?= \s?-\s? [a-z] ) )
  | (?P<double> \d+ \s? (?P<face>[ez]) (?= \s?[)\]]?\s?-) )
  | (?P<vitamin> (?<![a-z\d]) [bdek] \s?-?\s? \d+ )
  | (?P<word> [a-z]+ )
  | (?P<number> \d+ )"""
)
#: What a reading says: sets, as sorted arrays, but for the last two, which are yes or no.
ASPECTS = ("signature", "expression", "scaffold", "vitamer", "form", "state", "glycoside", "aglycone", "locant", "position", "numbers")
_SCHEMA = T.StructType([*(T.StructField(a, T.ArrayType(T.StringType())) for a in ASPECTS), T.StructField("handed", T.BooleanType()), T.StructField("placed", T.BooleanType())])


def _phrases(words: list[str], known: tuple[str, ...]) -> set[str]:
    text = f" {' '.join(words)} "
    return {k for k in known if f" {k} " in text}


def reading(label: str | None) -> dict:
    """What one label says."""
    text = (label or "").lower().replace("ω", "omega")
    tokens = [m for m in _TOKEN.finditer(text) if not (m["vitamin"] and re.search(r"\d\s?$", text[: m.start()]))]
    says: dict[str, set[str]] = {a: set() for a in ASPECTS}
    words, isomers = [], set()
    for at, t in enumerate(tokens):
        after = tokens[at + 1] if at + 1 < len(tokens) else None
        says["numbers"] |= {str(int(d)) for d in re.findall(r"\d+", t[0])}
        plain = re.sub(r"\s", "", t[0])
        if t["chain"]:
            says["signature"].add(f"chain {t['carbons']}:{t['bonds']}:{t['end'] or ''}")
        elif t["vitamin"]:
            says["signature"].add(f"vitamin {plain.replace('-', '')}")
        elif t["places"] or t["double"]:
            says["locant"].add(plain)
            if t["double"]:
                isomers.add({"z": "cis", "e": "trans"}[t["face"]])
        elif t["atom"]:
            says["position"].add(plain)
        if not t["word"]:
            continue
        words.append(t["word"])
        if t["word"] == "menaquinone" and after and (after["number"] or after["places"]):
            says["signature"].add(f"menaquinone {after[0]}")
        elif t["word"] in "omp" and after and after["word"] == "coumaric":
            says["position"].add(t["word"])
        if t["word"] in ISOMERS and not (len(t["word"]) == 1 and after and after["number"]):
            isomers.add(ISOMERS[t["word"]])
        if "conjugated" in t["word"]:
            isomers.add("conjugated")
    # A state of isomers is one of a chain's; "cis/trans not specified" names both states and means neither.
    numbered = any(t["chain"] for t in tokens) or any(a["number"] and b["number"] for a, b in zip(tokens, tokens[1:], strict=False))
    open_state = re.search(r"\bcis\W+trans\W+(unspecified|not\W+specified)", text)
    says["state"] = isomers if numbered and not open_state else set()
    says["form"] = _phrases(words, FORMS) - ({"cis", "trans"} if open_state else set())
    says["expression"] = _phrases(words, EXPRESSIONS)
    says["vitamer"] = _phrases(["pyridoxine" if w == "pyridoxin" else w for w in words], VITAMERS)
    says["scaffold"] = {k for k in SCAFFOLDS if any(k in w for w in words)}
    says["glycoside"] = {k for k in GLYCOSIDES if any(k in w for w in words)}
    if says["glycoside"]:
        # What stands before the place of the sugar, with or without the oxygen that it hangs on.
        says["aglycone"] = {t["word"] for t, p in zip(tokens, tokens[1:], strict=False) if t["word"] and (p["places"] or p["number"])}
    out = {a: sorted(v) for a, v in says.items()}
    first = tokens[:2]
    out["handed"] = any(t["word"] in ("d", "l") and n["word"] for t, n in zip(tokens, tokens[1:], strict=False) if t["word"])
    out["placed"] = len(first) == 2 and bool(first[0]["number"] or first[0]["places"]) and first[0][0].isdigit() and len(first[0][0]) < 3 and bool(first[1]["word"])
    return out


@F.pandas_udf(_SCHEMA)
def read_label(labels: pd.Series) -> pd.DataFrame:
    """A struct of what each label says. Apply it to distinct labels and join these to pairs."""
    return pd.DataFrame([reading(x) for x in labels], columns=[*ASPECTS, "handed", "placed"])


def relation(a: Column, b: Column) -> Column:
    """How what two labels say of an aspect stands to each other: same, first (the first alone says something), second, differs
    (nothing in common) or overlaps."""
    return F.when(a == b, "same").when(F.size(b) == 0, "first").when(F.size(a) == 0, "second").when(F.arrays_overlap(a, b), "overlaps").otherwise("differs")


_ANY = ("differs", "overlaps", "first", "second")
#: Fixed values, in order: which relation of which aspect is a reason to refuse.
REASONS = [
    ("signature", ("differs",), "different_explicit_structural_or_vitamer_signature"),
    ("signature", ("overlaps",), "aggregate_or_different_explicit_structural_definition"),
    ("expression", _ANY, "different_calculated_or_nutritional_expression"),
    ("scaffold", ("differs",), "different_explicit_chemical_scaffold"),
    ("vitamer", _ANY, "different_explicit_vitamer_chemical_form"),
    ("form", ("differs",), "different_explicit_chemical_form"),
    ("form", ("overlaps", "first", "second"), "under_or_over_specified_chemical_form"),
    ("state", ("differs",), "different_explicit_fatty_acid_isomer_state"),
    ("state", ("first",), "source_is_more_specific_fatty_acid_isomer"),
    ("state", ("second",), "target_is_more_specific_fatty_acid_isomer"),
    ("glycoside", _ANY, "different_glycoside_or_acylated_form"),
    ("aglycone", ("differs",), "different_glycoside_aglycone"),
    ("locant", _ANY, "different_explicit_positional_isomer"),
    ("position", _ANY, "different_explicit_small_molecule_position"),
]


def name_variants(label: Column) -> Column:
    """Keys of a label as it is, without parentheses, before its first comma, and with two parts swapped; of 3 characters at least."""
    raw = F.coalesce(label, F.lit(""))
    parts = F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda p: p != "")
    swapped = F.when(F.size(parts) == 2, F.array_join(F.reverse(parts), " "))
    shown = F.array_compact(F.array(raw, F.regexp_replace(raw, r"\s*\([^)]*\)", ""), F.get(parts, F.lit(0)), swapped))
    return F.array_sort(F.array_distinct(F.filter(F.transform(shown, ascii_label_key), lambda k: F.length(k) >= 3)))


def verdict(a: Column, b: Column, exact: Column, similarity: Column, lexical: Column, overlap: Column) -> Column:
    """Struct of accepted and reason for two readings: whether the first label may be a lead for the second. Two labels whose
    chemistry differs are refused, however similar."""
    how = {aspect: relation(a[aspect], b[aspect]) for aspect in ASPECTS}
    refused = first_reason([(how[aspect].isin(*relations), reason) for aspect, relations, reason in REASONS])
    near, shared = similarity >= LEAST_SIMILARITY, (lexical >= LEAST_LEXICAL) & (overlap >= LEAST_OVERLAP)
    leads = [(exact, "exact_name_or_registered_alias"), (F.arrays_overlap(a["signature"], b["signature"]), "matching_explicit_structural_signature"), (near & shared, "strong_name_similarity_with_shared_identity_tokens")]
    accepted = first_reason(leads)
    weak = F.when(near, "semantic_similarity_without_identity_bearing_name_evidence").otherwise("semantic_score_below_review_threshold")
    return F.struct((refused.isNull() & accepted.isNotNull()).alias("accepted"), F.coalesce(refused, accepted, weak).alias("reason"))


def identity_verdict(a: Column, b: Column, exact: Column, similarity: Column, lexical: Column, overlap: Column) -> Column:
    """verdict() of two labels that haven't been read yet."""
    return verdict(read_label(a), read_label(b), exact, similarity, lexical, overlap)


def name_caution(source: Column, target: Column) -> Column:
    """What in two labels may hide that they aren't the same analyte: other numbers, an unequal sign of handedness, a leading place."""
    source, target = read_label(source), read_label(target)
    numbers = relation(source["numbers"], target["numbers"])
    found = F.concat_ws(
        " | ",
        F.when(numbers.isin("differs", "overlaps"), "numeric_form_or_homologue_differs"),
        F.when(source["handed"] != target["handed"], "stereochemical_form_not_confirmed"),
        F.when(source["placed"] | target["placed"], "positional_or_isomeric_form_not_confirmed"),
    )
    return F.when(found == "", "none_detected_from_name_only").otherwise(found)
