"""Identities recovered by trying keys in order, with the conflicts of each step; and what would be left without a set of labels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..functions.text import ascii_label_key, blank_to_null


@dataclass(frozen=True)
class Step:
    """One try: items' column `key` against known (key, name); several names of one key are a conflict unless `pick` chooses: 'least'
    takes the shortest, then the first by letters."""

    name: str
    key: str
    known: DataFrame
    pick: str = ""


def recovered(orphans: DataFrame, id_col: str, steps: Sequence[Step], banned: Column | None = None) -> DataFrame:
    """orphans with recovered_name, step and decision. Each goes through the steps in order; the first whose key is known decides:
    `recovered`, or `ambiguous` with the names in conflicts, if the key has several; `unresolved` if no step knows it, or it is
    banned. A step's names are brought down to one row for each key before the join, so an orphan stays one row. One join for each
    step: none of them goes back to an earlier one."""
    out = orphans.withColumn("recovered_name", F.lit(None).cast("string")).withColumn("step", F.lit(None).cast("string")).withColumn("conflicts", F.lit(None).cast("string"))
    for s in steps:
        names = s.known.select(F.col("key").cast("string").alias("_k"), blank_to_null(F.trim("name")).alias("_n")).where("_k IS NOT NULL AND trim(_k) <> '' AND _n IS NOT NULL").distinct()
        best = names.groupBy("_k").agg(F.count(F.lit(1)).alias("_c"), F.min(F.struct(F.length("_n").alias("l"), F.col("_n").alias("n")))["n"].alias("_best"), F.array_join(F.slice(F.array_sort(F.collect_set("_n")), 1, 5), " | ").alias("_all"))
        open_ = F.col("step").isNull()
        out = out.join(best, F.col(s.key).cast("string") == F.col("_k"), "left")
        met = open_ & F.col("_k").isNotNull()
        clear = met & ((F.col("_c") == 1) | F.lit(s.pick == "least"))
        out = out.withColumns({"recovered_name": F.when(clear, F.col("_best")).otherwise(F.col("recovered_name")), "conflicts": F.when(met & ~clear, F.col("_all")).otherwise(F.col("conflicts")), "step": F.when(met, s.name).otherwise(F.col("step"))}).drop("_k", "_c", "_best", "_all")
    barred = F.lit(False) if banned is None else F.coalesce(banned, F.lit(False))
    decision = F.when(barred | F.col("step").isNull(), "unresolved").when(F.col("recovered_name").isNull(), "ambiguous").otherwise("recovered")
    out = out.withColumn("decision", decision)
    return out.withColumn("recovered_name", F.when(F.col("decision") == "recovered", F.col("recovered_name")))


# Words that tell an expression's variant, in order, and tags that are another's.
VARIANTS = [
    (("label", "declaration"), "label_expression"), (("from amino acid",), "calculated_from_constituents"), (("by difference", "difference"), "calculated_by_difference"),
    (("equivalent", "rae", "dfe", "alpha te", "from tryptophan", "vitamin a activities", "vitamin e activities"), "biological_equivalent"),
]
SAME_TAGS = {"PROT": "PROCNT"}
NUMBERED = ("usda_sr_legacy", "usda_foundation", "fndds", "cnf")
_NUMBER = r"(?i)(?:number|code)\s+([0-9]+(?:\.[0-9]+)?)"


def variant(name: Column) -> Column:
    key, out = ascii_label_key(name), F.lit("standard_expression")
    for words, kind in reversed(VARIANTS):
        held = F.lit(False)
        for w in words:
            held |= key.contains(w)
        out = F.when(held, kind).otherwise(out)
    return out


def _clean(c: Column) -> Column:
    text = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(F.lower(text).isin("", "nan", "none"), "").otherwise(text)


def authority_keys(components: DataFrame, tags: DataFrame) -> DataFrame:
    """components with namespace, authority_id and variant: the first identity of those an authority gives that a component has: a
    tag that the registry (tags: tag) holds, a nutrient number of a database that numbers them, a CHEBI id, an InChIKey, a EuroFIR
    id; else its own. Expects source_key, source_component_id, infoods_tag, source_definition, chebi_id, inchikey,
    eurofir_component_id, original_name."""
    tag = F.upper(_clean(F.col("infoods_tag")))
    tag = F.coalesce(F.create_map(*(F.lit(x) for kv in SAME_TAGS.items() for x in kv))[tag], tag)
    known = tags.select(F.upper("tag").alias("_tag")).distinct().withColumn("_known", F.lit(True))
    rows = components.withColumn("_t", tag).join(known, F.col("_t") == F.col("_tag"), "left")
    imported = (F.col("source_key") == "foodb") & F.col("source_definition").startswith("FooDB Content.orig_source_id = USDA nutrient number ")
    number = F.when(F.col("source_key").isin(*NUMBERED) | F.coalesce(imported, F.lit(False)), F.regexp_extract(_clean(F.col("source_definition")), _NUMBER, 1))
    chebi = F.regexp_extract(F.upper(_clean(F.col("chebi_id"))), r"^(?:CHEBI[:_])?([0-9]+)$", 1)
    key = F.upper(_clean(F.col("inchikey")))
    own = variant(F.col("original_name"))
    of = lambda space, ident, kind: F.struct(F.lit(space).alias("namespace"), ident.alias("authority_id"), kind.alias("variant"))
    chemical = F.lit("chemical_identity")
    told = F.coalesce(
        F.when(F.col("_known"), of("INFOODS", F.col("_t"), own)), F.when(number != "", of("USDA_CNF_NUTRIENT_NBR", number, own)), F.when(chebi != "", of("CHEBI", chebi, chemical)),
        F.when(key.rlike("^[A-Z]{14}-[A-Z]{10}-[A-Z]$"), of("INCHIKEY", key, chemical)), F.when(_clean(F.col("eurofir_component_id")) != "", of("EUROFIR_EFSA", _clean(F.col("eurofir_component_id")), own)), of("SOURCE", F.concat_ws(":", "source_key", "source_component_id"), own),
    )
    return rows.withColumn("_a", told).select(*components.columns, "_a.*")


def crosswalked(components: DataFrame, aliases: DataFrame, chemicals: DataFrame, tags: DataFrame, name: str = "original_name", tag: str = "infoods_tag", chemical: str = "chebi_id") -> DataFrame:
    """components with harmonised_tag, identity_rule and clash: the tag that a reviewed alias (alias, tag) of the name gives, where the
    component has none of its own that the registry (tags: tag) knows, or the same; else the one of its chemical (chemical, tag). Both
    only if the registry has it. clash: the alias's tag and the component's own known tag, where they differ. Own fields stay."""
    registry = tags.select(F.upper("tag").alias("_reg")).distinct()
    alias = aliases.select(ascii_label_key(F.col("alias")).alias("_alias"), F.upper("tag").alias("_by_name")).distinct().join(registry, F.col("_by_name") == F.col("_reg"), "left_semi")
    told = F.raise_error(F.concat(F.lit("an alias of two tags: "), F.col("_alias"))).cast("string")
    alias = alias.groupBy("_alias").agg(F.min("_by_name").alias("_by_name"), F.max("_by_name").alias("_last")).select("_alias", F.when(F.col("_by_name") == F.col("_last"), F.col("_by_name")).otherwise(told).alias("_by_name"))
    chem = chemicals.select(F.col("chemical").cast("string").alias("_chem"), F.upper("tag").alias("_by_chem")).join(registry, F.col("_by_chem") == F.col("_reg"), "left_semi").groupBy("_chem").agg(F.min("_by_chem").alias("_by_chem"))
    own = F.upper(_clean(F.col(tag)))
    rows = components.withColumn("_own", own).withColumn("_key", ascii_label_key(F.col(name))).join(alias, F.col("_key") == F.col("_alias"), "left").join(chem, F.col(chemical).cast("string") == F.col("_chem"), "left").join(registry, F.col("_own") == F.col("_reg"), "left")
    free = F.col("_reg").isNull()
    by_name = F.col("_by_name").isNotNull() & (free | (F.col("_own") == F.col("_by_name")))
    by_chem = F.col("_by_chem").isNotNull() & free
    # The chemical's comes after the name's and counts over it.
    out = rows.withColumns({
        "harmonised_tag": F.when(by_chem, F.col("_by_chem")).when(by_name, F.col("_by_name")).otherwise(F.col("_own")),
        "identity_rule": F.when(by_chem, "chemical_identity_to_tag").when(by_name, "reviewed_exact_label_to_tag").otherwise("own_identifier_or_source_specific"),
        "clash": F.when(F.col("_by_name").isNotNull() & ~free & (F.col("_own") != F.col("_by_name")), F.concat_ws(" / ", "_by_name", "_own")),
    })
    return out.drop("_own", "_key", "_alias", "_by_name", "_chem", "_by_chem", "_reg")


def without_labels(cells: DataFrame, labels: DataFrame, item: str, axis: str, rejected: str, target: Column) -> DataFrame:
    """item with what is scorable now and would be without the rejected labels: cells (item, axis) stand on labels (item, axis,
    rejected: a boolean), and a cell goes with its first rejected label. n_cells, n_targets, n_lost, n_lost_targets, records,
    rejected_records, scorable, still_scorable.

    Counts are summed once by item and the withdrawn ones subtracted, so another set to withdraw asks for its own counts alone."""
    counted = labels.groupBy(item, axis).agg(F.count(F.lit(1)).alias("_records"), F.count_if(rejected).alias("_rejected"))
    rows = cells.select(item, axis, target.alias("_target")).join(counted, [item, axis], "left").fillna(0, ["_records", "_rejected"])
    gone = F.col("_rejected") > 0
    by = rows.groupBy(item).agg(F.count(F.lit(1)).alias("n_cells"), F.count_if("_target").alias("n_targets"), F.count_if(gone).alias("n_lost"), F.count_if(gone & F.col("_target")).alias("n_lost_targets"), F.sum("_records").alias("records"), F.sum("_rejected").alias("rejected_records"))
    return by.withColumn("scorable", F.col("n_targets") > 0).withColumn("still_scorable", F.col("n_targets") > F.col("n_lost_targets"))


def conversion_mismatches(labels: DataFrame, value: str, factor: str, converted: str, rtol: float = 1e-10, atol: float = 1e-15) -> DataFrame:
    """The labels whose value times factor isn't their converted value; what is null on one side alone is one of them."""
    product, given = F.col(value) * F.col(factor), F.col(converted)
    close = F.abs(product - given) <= atol + rtol * F.abs(given)
    return labels.where(~F.coalesce(close, product.isNull() & given.isNull()))


def import_components(facts: DataFrame, native: DataFrame, number: str, component: str = "component_id") -> tuple[DataFrame, DataFrame]:
    """facts of imported values under the component that their own number names, and the components made for that: one for each old
    component and number that native (number, name) knows. A number of two native components is an error; facts without a known
    number stay as they are."""
    twice = native.groupBy("number").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"a number of two components: {twice[0]['number']}")
    known = native.select(F.col("number").cast("string").alias("_no"), F.col("name").alias("_native"))
    rows = facts.join(known, F.col(number).cast("string") == F.col("_no"), "left")
    made = F.when(F.col("_no").isNotNull(), stable_id("compobs", F.lit("import"), F.col(component), F.col("_no")))
    rows = rows.withColumn("original_component_id", F.col(component)).withColumn(component, F.coalesce(made, F.col(component).cast("string")))
    parts = rows.where("_no IS NOT NULL").groupBy(F.col(component)).agg(F.min("original_component_id").alias("parent_component_id"), F.min("_no").alias("number"), F.min("_native").alias("name"), F.count(F.lit(1)).alias("facts"))
    return rows.drop("_no", "_native"), parts
