"""Class encodings and colours of coastal typology."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.planar import ColumnOrName, col

#: Codes of the classes are their places in these lists, colours stand beside them: fixed values.
CLASSES: dict[str, tuple[tuple[str, str], ...]] = {
    "class:shore_type": (
        ("sandy_gravel_or_small_boulder_sediments", "#FFD700"),
        ("muddy_sediments", "#8B5A2B"),
        ("rocky_shore_platform_or_large_boulders", "#A9A9A9"),
        ("no_sediment_or_shore_platform", "#1E90FF"),
    ),
    "class:coastal_type": (
        ("cliffed_or_steep", "#E24A33"),
        ("moderately_sloped", "#1A9850"),
        ("bedrock_plain", "#A9A9A9"),
        ("sediment_plain", "#FFD700"),
        ("dune", "#D45D9F"),
        ("wetland", "#8B5A2B"),
        ("coral", "#DA70D6"),
        ("inlet", "#1E90FF"),
        ("engineered_structures", "#4D4D4D"),
    ),
    "class:is_built_environment": (("false", "#1A9850"), ("true", "#4D4D4D")),
    "class:has_defense": (("false", "#1A9850"), ("true", "#4D4D4D")),
    "class:landform_type": (
        ("mainland_coast", "#d8b365"),
        ("estuary", "#f6e8c3"),
        ("barrier_island", "#5ab4ac"),
        ("barrier", "#66c2a5"),
        ("pocket_beach", "#c7eae5"),
        ("spit", "#8c510a"),
        ("enh:bay", "#c2a5cf"),
    ),
}


def encoding(label: str) -> dict[str, int]:
    return {name: k for k, (name, _) in enumerate(CLASSES[label])}


def colours(label: str) -> dict[str, str]:
    return dict(CLASSES[label])


def ordered_colours(label: str) -> list[str]:
    return [c for _, c in CLASSES[label]]


def code_colours(label: str) -> dict[int, str]:
    return dict(enumerate(ordered_colours(label)))


def observed_encoding(label: str, values: Iterable[str]) -> dict[str, int]:
    """Codes from 0 of the observed classes only, in the order of the whole list."""
    seen = {str(v).lower() for v in values}
    return {name: k for k, name in enumerate(n for n, _ in CLASSES[label] if n in seen)}


def encoded(c: ColumnOrName, codes: Mapping[str, int]) -> Column:
    """Code of a value in any case; NULL for an unknown one."""
    pairs = [F.lit(x) for kv in codes.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.lower(col(c).cast("string")))


def with_codes(df: DataFrame, column: str, codes: Mapping[str, int] | None = None) -> DataFrame:
    """df with the column encoded; unchanged where it has no such column."""
    return df.withColumn(column, encoded(f"`{column}`", codes or encoding(column))) if column in df.columns else df


def observed(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """label and value of every class found (lower case), in one pass over the table."""
    here = [c for c in columns if c in df.columns]
    if not here:
        raise ValueError("none of the class columns is there")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.lower(F.col(f"`{c}`").cast("string")).alias("value")) for c in here]))
    return df.select(pairs.alias("p")).select("p.*").where("value is not null").distinct()
