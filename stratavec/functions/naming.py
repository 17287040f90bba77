"""Names of configs, one config per (layer, head, kind)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# two or more digits, so layers and heads from 100 on are found too
CONFIG_PATTERN = r"^l(\d{2,})h(\d{2,})([qk])$"


def config_name(layer: Column, head: Column, kind: Column) -> Column:
    # format_string parses its pattern for every row, which took longer than the row itself
    text = lambda value: F.coalesce(value.cast("string"), F.lit("null"))
    two = lambda n: F.concat(F.when(n.between(0, 9), "0").otherwise(""), text(n))
    return F.concat(F.lit("l"), two(layer), F.lit("h"), two(head), text(kind))


def config_parts(config: Column) -> tuple[Column, Column, Column]:
    """Layer, head and kind of a config name."""
    part = lambda i: F.regexp_extract(config, CONFIG_PATTERN, i)
    return part(1).cast("int"), part(2).cast("int"), part(3)
