"""Ordered rules over several kinds of keys, as a table: the first rule whose conditions all hold decides. Rules meet items by one
equi-join on (kind, value), so neither grows the other's work."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..functions.text import ascii_label_key
from .annotate import ROLES

_NONE = -1


@dataclass(frozen=True)
class Rule:
    """all_of: groups of keys, `kind:value`, of each of which one must be there; none_of: keys of which none may be. outcome: texts
    by column, in which {field} is replaced by the item's own."""

    name: str
    outcome: dict[str, str]
    all_of: Sequence[Sequence[str]] = ()
    none_of: Sequence[str] = field(default=())


def first_rule(items: DataFrame, id_col: str, keys: DataFrame, rules: Sequence[Rule], fields: Sequence[str] = ()) -> DataFrame:
    """items with rule and the rules' outcome columns. keys (id_col, key) are the items' own; an item that no rule covers is an
    error, so a list that ends in a rule without conditions covers all.

    The rules' few keys are broadcast, so that of the items' keys, repeats included, only those that a rule asks for are shuffled; what
    matches is counted by item and rule in partial aggregates.
    """
    spark = items.sparkSession
    names = sorted({c for r in rules for c in r.outcome})
    conditions = [(i, g, k) for i, r in enumerate(rules) for g, group in enumerate(r.all_of) for k in group] + [(i, _NONE, k) for i, r in enumerate(rules) for k in r.none_of]
    table = spark.createDataFrame(conditions, "rule int, clause int, key string")
    outcomes = spark.createDataFrame([(i, r.name, len(r.all_of), *(r.outcome.get(c) for c in names)) for i, r in enumerate(rules)], ", ".join(["_at int", "rule string", "_need int", *(f"`{c}` string" for c in names)]))
    hits = keys.select(id_col, "key").join(F.broadcast(table), "key").groupBy(id_col, "rule").agg(F.countDistinct(F.when(F.col("clause") != _NONE, F.col("clause"))).alias("met"), F.max(F.col("clause") == _NONE).alias("barred"))
    # A rule without conditions holds unless it is barred: it is tried for every item.
    free = [i for i, r in enumerate(rules) if not r.all_of]
    need = F.element_at(F.array(*(F.lit(len(r.all_of)) for r in rules)), F.col("rule") + 1)
    barred = hits.where("barred").select(id_col, "rule")
    held = hits.where((F.col("met") == need) & ~F.col("barred") & (need > 0)).select(id_col, "rule")
    open_ = items.select(id_col).withColumn("rule", F.explode(F.array(*map(F.lit, free)))).join(barred, [id_col, "rule"], "left_anti") if free else None
    first = (held if open_ is None else held.unionByName(open_)).groupBy(id_col).agg(F.min("rule").alias("_at"))
    out = items.join(first, id_col, "left")
    told = F.raise_error(F.concat(F.lit("no rule covers "), F.col(id_col).cast("string"))).cast("int")
    out = out.withColumn("_at", F.when(F.col("_at").isNull(), told).otherwise(F.col("_at"))).join(F.broadcast(outcomes), "_at").drop("_at", "_need")
    for c in names:
        text = F.col(c)
        for f in fields:
            text = F.replace(text, F.lit(f"{{{f}}}"), F.coalesce(F.col(f).cast("string"), F.lit("")))
        out = out.withColumn(c, text)
    return out


def label_keys(items: DataFrame, id_col: str, tag: str, name: str, rules: Sequence[Rule], others: dict[str, Column] | None = None) -> DataFrame:
    """id_col, key: an item's `tag:T`, `starts:T` for every beginning of its tag, `name:n` for its whole label key, `holds:t` for the
    parts of that key that are as long as some text that the rules look for, and `kind:value` of others. Rules that ask for words
    inside a name thus meet it by equality as well."""
    lengths = sorted({len(k.partition(":")[2]) for r in rules for k in (*(k for g in r.all_of for k in g), *r.none_of) if k.startswith("holds:")})
    t, n = F.upper(F.trim(F.coalesce(tag, F.lit("")))), ascii_label_key(F.col(name))
    put = lambda kind, c: F.concat(F.lit(f"{kind}:"), c)
    upto = lambda c: F.sequence(F.lit(1), F.length(c))

    def windows(k: int) -> Column:
        return F.when(F.length(n) >= k, F.transform(F.sequence(F.lit(1), F.length(n) - k + 1), lambda i: put("holds", F.substring(n, i, F.lit(k)))))

    parts = [
        F.when(t != "", F.array(put("tag", t))), F.when(t != "", F.transform(upto(t), lambda i: put("starts", F.substring(t, F.lit(1), i)))), F.when(n != "", F.array(put("name", n))),
        *(windows(k) for k in lengths),
        *(F.when(c.isNotNull(), F.array(put(kind, c.cast("string")))) for kind, c in (others or {}).items()),
    ]
    none = F.array().cast("array<string>")
    return items.select(id_col, F.explode(F.array_distinct(F.flatten(F.array(*(F.coalesce(p, none) for p in parts))))).alias("key"))


def _keys(kind: str, *values: str) -> tuple[str, ...]:
    return tuple(f"{kind}:{v}" for v in values)


_AMINO = next(r for r in ROLES if r[0] == "nutrient_constituent_amino_acid")
_FAT = (*_keys("starts", "FAT", "FA"), *_keys("holds", "fat"))
# Beginnings of tags and words of a vitamin's names.
_VITAMINS = [
    ("a", ("VITA", "RETOL", "CART"), ("retinol", "carotene", "cryptoxanthin")), ("b1", ("THIA",), ("thiamin",)), ("b2", ("RIBF",), ("riboflavin",)), ("b3", ("NIA",), ("niacin", "nicotin")),
    ("b5", ("PANTAC",), ("pantothen",)), ("b6", ("VITB6",), ("vitamin b6", "pyridox")), ("b7", ("BIOT",), ("biotin",)), ("b9", ("FOL",), ("folate", "folic")), ("b12", ("VITB12",), ("vitamin b12", "cobalamin")),
    ("c", ("VITC",), ("vitamin c", "ascorb")), ("d", ("VITD",), ("vitamin d", "calciferol")), ("e", ("VITE", "TOCP", "TOCT"), ("vitamin e", "tocopherol", "tocotrienol")), ("k", ("VITK",), ("vitamin k", "phylloquinone", "menaquinone")),
]
#: A component's family, in order.
FAMILIES = [
    Rule("choline", {"family": "choline_family"}, [(*_keys("tag", "CHOLN"), *_keys("role", "essential_nutrient_choline"))]),
    Rule("lipid", {"family": "lipid_and_fatty_acid_family"}, [(*_keys("role", "macronutrient"), *_keys("starts", "FAT", "FA"), *_keys("holds", "fatty acid")), _FAT]),
    Rule("protein", {"family": "protein_and_amino_acid_family"}, [(*_keys("tag", *_AMINO[1]), *_keys("name", *_AMINO[3]), *_keys("role", "nutrient_constituent_amino_acid"), *_keys("starts", "PRO", "AA"), *_keys("holds", "protein", "amino acid"))]),
    Rule("carbohydrate", {"family": "carbohydrate_family"}, [(*_keys("starts", "CHO", "SUGAR", "FIB", "STAR"), *_keys("holds", "carbohydrate", "sugar", "starch", "fiber", "fibre"))]),
    *(Rule(f"vitamin {v}", {"family": f"vitamin:{v}"}, [_keys("role", "micronutrient_vitamin"), (*_keys("starts", *tags), *_keys("holds", *words))]) for v, tags, words in _VITAMINS),
    Rule("vitamin", {"family": "vitamin_unresolved:{_tag_or_label}"}, [_keys("role", "micronutrient_vitamin")]),
    Rule("mineral", {"family": "mineral:{_tag_or_word}"}, [_keys("role", "micronutrient_mineral")]),
    Rule("component", {"family": "component:{_tag_or_label}"}),
]


def families(items: DataFrame, id_col: str, tag: str, name: str, role: str) -> DataFrame:
    """items with rule and family: which group of components one belongs to, told from its tag, name and role by FAMILIES."""
    t, key = F.upper(F.trim(F.coalesce(tag, F.lit("")))), ascii_label_key(F.col(name))
    # Told once for each tag, name and role, of which many items have the same.
    items = items.withColumn("_kind", F.to_json(F.struct(F.col(tag).alias("t"), F.col(name).alias("n"), F.col(role).alias("r"))))
    rows = items.select("_kind", tag, name, role).dropDuplicates(["_kind"])
    rows = rows.withColumn("_tag_or_label", F.when(t != "", t).otherwise(stable_id("label", key))).withColumn("_tag_or_word", F.when(t != "", t).otherwise(F.split(key, " ")[0]))
    keys = label_keys(rows, "_kind", tag, name, FAMILIES, {"role": F.col(role)})
    found = first_rule(rows, "_kind", keys, FAMILIES, ("_tag_or_label", "_tag_or_word")).select("_kind", "rule", "family")
    return items.join(found, "_kind").drop("_kind")


def _status(name: str, status: str, note: str, all_of: Sequence[Sequence[str]] = (), none_of: Sequence[str] = (), action: str = "reporting_annotation_only") -> Rule:
    return Rule(name, {"review_status": status, "limitation": note, "action": action}, all_of, none_of)


#: What a classification still needs, in order; keys are its category, the rule that gave it and the authority of its identity.
REVIEW = [
    _status("structure", "source_expression_and_structure_review", "measurement_versus_dictionary_structure", [_keys("authority", "INCHIKEY"), _keys("category", "micro_vitamin", "carbohydrate_fraction")]),
    _status("label", "source_label_family_assignment", "exact_source_expression_needs_review", [_keys("authority", "SOURCE")], _keys("category", "non_mass_or_censored", "unresolved", "proximate")),
    _status("salt", "measurement_expression_review", "salt_mass_or_sodium_equivalent", [_keys("by", "salt")]),
    _status("isomer", "isomer_activity_review", "beta_isomer_evidence_required", [_keys("by", "cryptoxanthin")]),
    _status("thiamin salt", "measurement_expression_review", "salt_or_active_thiamin", [_keys("by", "B1_salt")]),
    _status("modality", "numerical_use_requires_correction", "inclusion_not_approved", [_keys("category", "non_mass_or_censored")], action="hold_numerical_use"),
    _status("identity", "identity_unresolved", "no_pooling_by_name", [_keys("category", "unresolved")], action="resolve_source_identity_first"),
    _status("element", "qualified_nutritional_status", "essentiality_as_stated", [_keys("category", "element_boundary")]),
    _status("supported", "evidence_supported_project_assignment", "family_does_not_certify_measurements"),
]


def reviewed(axes: DataFrame, id_col: str, category: str, by: str, authority: str) -> DataFrame:
    """axes with review_status, limitation and action, told from a classification's category, rule and authority by REVIEW."""
    parts = F.array(*(F.concat(F.lit(f"{k}:"), F.col(c).cast("string")) for k, c in (("category", category), ("by", by), ("authority", authority))))
    keys = axes.select(id_col, F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("key"))
    return first_rule(axes, id_col, keys, REVIEW)
