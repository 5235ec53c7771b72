"""Look-ups over buildings, floors, paths, passages, points of interest and scan sessions, and checked changes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.versions import Conflict, VersionedTable
from .keeping import kept


class CatalogError(ValueError):
    """A look-up or change that fails, by its code (such as FLOOR_NOT_FOUND)."""


def of_parent(children: DataFrame, parent: str, value: object, order: str | None = None) -> DataFrame:
    """The rows of one parent, in order if asked."""
    rows = children.filter(F.col(parent) == value)
    return rows.orderBy(order) if order else rows


def matching(rows: DataFrame, **values: object) -> DataFrame:
    """Rows equal in every value given; None leaves a column free."""
    for name, value in values.items():
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    return rows


def with_parts(parents: DataFrame, parts: DataFrame, key: str, order: str, columns: Sequence[str], name: str, how: str = "left") -> DataFrame:
    """Each parent with its parts as an ordered array; with how="inner" parents without parts go."""
    lists = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias(name))
    return parents.join(lists, key, how)


def conflicts(new: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows whose keys exist."""
    return new.join(existing.select(*keys).distinct(), list(keys), "left_semi")


def judged(new: DataFrame, existing: DataFrame, keys: Sequence[str], required: Sequence[str] = (), order: str | None = None, taken: str = "FLOOR_ALREADY_EXISTS", invalid: str = "INVALID_INPUT_VALUE") -> DataFrame:
    """Each new row with `error`: null if it may be created, `invalid` where a required column is null or blank, `taken` where its
    keys exist or an earlier new row (by `order`, else by its values) has them. A key with a null is equal to no other."""
    valid = F.lit(True)
    for c in required:
        valid = valid & F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    whole = F.lit(True)
    for c in keys:
        whole = whole & F.col(c).isNotNull()
    rows = new.join(existing.select(*keys).distinct().withColumn("_there", F.lit(True)), list(keys), "left").withColumn("_valid", F.coalesce(valid, F.lit(False)))
    first = Window.partitionBy(*keys, "_valid").orderBy(*([order] if order else []), *(c for c in new.columns if c != order))
    rows = rows.withColumn("_nth", F.row_number().over(first))
    error = F.when(~F.col("_valid"), invalid).when(whole & (F.col("_there").isNotNull() | (F.col("_nth") > 1)), taken)
    return rows.withColumn("error", error).select(*new.columns, "error")


def accepted(new: DataFrame, existing: DataFrame, keys: Sequence[str], required: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """New rows that may be created: required columns neither null nor blank, keys neither taken nor those of an earlier new row."""
    return judged(new, existing, keys, required, order).filter("error IS NULL").drop("error")


def create(table: VersionedTable, new: DataFrame, keys: Sequence[str], required: Sequence[str] = (), order: str | None = None, tries: int = 10) -> DataFrame:
    """Stores the new rows that may be created as the table's next version; each new row with its `error`.

    Another writer's version in between is a conflict: its rows count as existing, and what is still free is tried again.
    """
    new = kept(new)
    for _ in range(tries):
        version = table.latest()
        answers = kept(judged(new, table.read(version), keys, required, order))
        if not answers.filter("error IS NULL").limit(1).count():
            return answers
        folder = table.store(answers.filter("error IS NULL"))
        try:
            table.commit(version + 1, [*table.manifest(version), folder])
            return answers
        except Conflict:
            continue
    raise CatalogError("INTERNAL_SERVER_ERROR")


def replace(table: VersionedTable, change: Callable[[DataFrame], DataFrame], tries: int = 10) -> int:
    """The table's rows as `change` makes them (`changed`, `deleted`) as its next version, computed again if another writer comes first; the version."""
    for _ in range(tries):
        version = table.latest()
        folder = table.store(change(table.read(version)))
        try:
            table.commit(version + 1, [folder])
            return version + 1
        except Conflict:
            continue
    raise CatalogError("INTERNAL_SERVER_ERROR")


def changed(rows: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows with the values of their change, where these are not null."""
    new = changes.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    return rows.join(new, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).select(*rows.columns)


def deleted(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def named_like(rows: DataFrame, name: str, text: str | None) -> DataFrame:
    """Rows with a name that contains the text, whatever the case; all named rows for a blank text."""
    named = rows.filter(F.col(name).isNotNull())
    return named.filter(F.contains(F.lower(name), F.lit(text.strip().lower()))) if text and text.strip() else named


def with_levels(passages: DataFrame, floors: DataFrame) -> DataFrame:
    """Passages with the levels of the floors they join."""
    for side in ("from", "to"):
        passages = passages.join(floors.select(F.col("floor_id").alias(f"{side}_floor_id"), F.col("level").alias(f"{side}_level")), f"{side}_floor_id", "left")
    return passages


def answered(asked: DataFrame, rows: DataFrame, keys: Sequence[str], code: str) -> DataFrame:
    """Each request with the row of its keys and `error`: null, or the code where there is no such row (R1 to R12's look-ups, R17's changes)."""
    found = rows.withColumn("_found", F.lit(True))
    return asked.join(found, list(keys), "left").withColumn("error", F.when(F.col("_found").isNull(), F.lit(code))).drop("_found")


def building_detail(buildings: DataFrame, floors: DataFrame, passages: DataFrame, key: str, level: str, passage: str) -> DataFrame:
    """Each building with its floors' levels and its passages' ids, both in order; empty lists where it has none."""
    for rows, column, name in ((floors, level, "floors"), (passages, passage, "passages")):
        lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(column)).alias(name))
        buildings = buildings.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
    return buildings


def only(rows: DataFrame, code: str) -> DataFrame:
    """rows, or CatalogError(code) if there are none."""
    if not rows.limit(1).count():
        raise CatalogError(code)
    return rows
