"""What goes into a release and what is checked of it: registries with their artifacts, rebuilt observations, catalogues, audits."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_label_key
from .annotate import modal_label
from .cells import select_records
from .relational import dense_index, join_checked, require_unique


def enriched(registry: DataFrame, key: str, file: str, artifacts: DataFrame, versions: DataFrame) -> DataFrame:
    """registry with sha256, bytes and hash_status of its raw file (artifacts: file, sha256, bytes), and version and version_status
    (versions: key, version): what is there, and that it isn't where it isn't."""
    met = join_checked(registry, artifacts.select(F.col("file").alias(file), "sha256", "bytes"), [file])
    met = join_checked(met, versions.select(key, "version"), [key])
    return met.withColumns({"hash_status": F.when(F.col("sha256").isNotNull(), "hashed").when(F.trim(file) != "", "file_missing").otherwise("no_local_file"), "version_status": F.when(F.col("version").isNotNull(), "stated").otherwise("not_stated")})


def rebuilt_observations(content: DataFrame, parts: Sequence[Column], name: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(observations, content with observation_id): an observation is what parts (citation, food, part) are equal in; ids run over
    the sorted keys from 1, and its name is the modal one of its records."""
    keyed = content.withColumn("_key", F.concat_ws("|", *(F.trim(F.coalesce(p.cast("string"), F.lit(""))) for p in parts)))
    ids = dense_index(keyed, "_key", "observation_id")
    labels = modal_label(keyed, ["_key"], name, order).select("_key", F.col("label").alias("name"))
    observations = ids.join(labels, "_key", "left").select("observation_id", F.col("_key").alias("key"), "name")
    return observations, keyed.join(ids, "_key").drop("_key")


def catalogue(axes: DataFrame, key: str, name: str, definitions: DataFrame, records: DataFrame, source: str) -> DataFrame:
    """key, name, definition, records, sources (joined): every axis once, under a name that no other has; an error otherwise."""
    require_unique(axes, [key], "axes")
    named = axes.select(key, name, ascii_label_key(F.col(name)).alias("_n"))
    require_unique(named, ["_n"], "names of axes")
    counts = records.groupBy(key).agg(F.count(F.lit(1)).alias("records"), F.array_join(F.array_sort(F.collect_set(source)), ";").alias("sources"))
    out = join_checked(named.drop("_n"), definitions.select(key, "definition"), [key]).join(counts, key, "left")
    return out.fillna(0, ["records"]).fillna("", ["sources", "definition"])


def external_audit(external: DataFrame, name: str, local: DataFrame, local_name: str, source: str, sources: Sequence[str]) -> DataFrame:
    """name, a column for each of sources (local records of that name), status: what an outside catalogue lists, by exact key,
    against what is there."""
    seen = local.withColumn("_k", ascii_label_key(F.col(local_name))).groupBy("_k").pivot(source, list(sources)).agg(F.count(F.lit(1)))
    out = external.select(name, ascii_label_key(F.col(name)).alias("_k")).distinct().join(seen, "_k", "left").drop("_k").fillna(0, list(sources))
    total = sum((F.col(f"`{s}`") for s in sources), F.lit(0))
    return out.withColumn("status", F.when(total > 0, "covered").otherwise("absent_locally"))


def matrix_equality(cells: DataFrame, table: DataFrame, keys: Sequence[str], value: str, atol: float = 0.0) -> DataFrame:
    """outcome, n: a matrix's cells (keys, value) against a table's: equal, different, or on one side only."""
    a, b = cells.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_l")), table.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_r"))
    require_unique(a, keys, "the matrix")
    require_unique(b, keys, "the table")
    same = F.col("_a").eqNullSafe(F.col("_b")) | F.coalesce(F.abs(F.col("_a") - F.col("_b")) <= atol, F.lit(False))
    outcome = F.when(F.col("_l").isNull(), "table_only").when(F.col("_r").isNull(), "matrix_only").when(same, "equal").otherwise("different")
    return a.join(b, list(keys), "full_outer").groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def verified_winners(measurements: DataFrame, keys: Sequence[str], sources: Sequence[str], previous: DataFrame, id_col: str = "measurement_id", **columns) -> DataFrame:
    """keys, selected_id, previous_id, verdict of a selection run again against the one that was released (keys, id_col)."""
    now = select_records(measurements, keys, sources, id_col=id_col, check_ids=False, **columns)[1].select(*keys, "selected_id")
    then = previous.select(*keys, F.col(id_col).alias("previous_id"))
    out = now.join(then, list(keys), "full_outer")
    verdict = F.when(F.col("previous_id").isNull(), "new").when(F.col("selected_id").isNull(), "lost").when(F.col("selected_id") == F.col("previous_id"), "same").otherwise("changed")
    return out.withColumn("verdict", verdict)


def extracted(extractors: Mapping[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, tuple[str, str]]]:
    """(rows of all with source_key, status and error of each): one dictionary's fault doesn't stop the others. Each is run once,
    as only a run shows that it can be."""
    from ..tables import materialize

    out, told = None, {}
    for key, extract in extractors.items():
        try:
            rows = materialize(extract().withColumn("source_key", F.lit(key)), "extracted", few_files=True)
        except Exception as e:  # noqa: BLE001 - whatever a source's file may hold
            told[key] = ("failed", f"{type(e).__name__}: {e}".splitlines()[0][:300])
            continue
        told[key] = ("extracted", "")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out, told
