"""Pictures and encodings: sizes, rates, layers and what is left to do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rate of a height, how much taller a picture may be before it is resized, profiles with a base layer.
TARGET_HEIGHT = 1080
RATES = {1080: 12_000_000, 720: 6_000_000, 576: 3_000_000}
LOWEST_RATE = 1_500_000
TOLERANCE = 1.05
DOLBY = "DOVI configuration record"
WITH_BASE_LAYER = (4, 7, 8)


def bit_rate(height: Column) -> Column:
    out = F.lit(LOWEST_RATE)
    for above, rate in sorted(RATES.items()):
        out = F.when(height > above, rate).otherwise(out)
    return out


def output_height(height: Column, most: int = TARGET_HEIGHT) -> Column:
    """Never more than there is."""
    return F.when(height > 0, F.least(height, F.lit(most))).otherwise(most)


def _even(n: Column) -> Column:
    return n + F.pmod(n, F.lit(2))


def output_size(width: Column, height: Column, target: Column) -> Column:
    """Width and height, both even; null where the source's are unknown."""
    resize = height > target * TOLERANCE
    scaled = F.floor(width * target / height + 0.5).cast("int")
    size = F.struct(_even(F.when(resize, scaled).otherwise(width)).alias("width"), _even(F.when(resize, target).otherwise(height)).alias("height"))
    return F.when((width > 0) & (height > 0), size)


def dolby_layer(json: Column) -> Column:
    """``profile`` and ``compatible`` of the first stream's first Dolby record; 0 where there is none or it can't be read."""
    side = F.from_json(json, "struct<streams:array<struct<side_data_list:array<struct<side_data_type:string,dv_profile:int,dv_bl_signal_compatibility_id:int>>>>>")["streams"]
    record = F.get(F.filter(F.get(side, F.lit(0))["side_data_list"], lambda x: x["side_data_type"] == DOLBY), F.lit(0))
    return F.struct(F.coalesce(record["dv_profile"], F.lit(0)).alias("profile"), F.coalesce(record["dv_bl_signal_compatibility_id"], F.lit(0)).alias("compatible"))


def has_base_layer(profile: Column) -> Column:
    return F.coalesce((profile == 0) | profile.isin(*WITH_BASE_LAYER), F.lit(True))


def time_left(elapsed: Column, share: Column) -> Column:
    """What is left at this pace; null before anything is done."""
    return F.when(share > 0, elapsed / share - elapsed)


def leading_run(values: Column, value: Column, most: int) -> Column:
    """How many of the first ``most`` values are ``value`` before one is not."""
    first = F.slice(values, 1, most)
    other = F.array_position(F.transform(first, lambda x: F.coalesce(x == value, F.lit(False))), F.lit(False))
    return F.when(other > 0, other - 1).otherwise(F.size(first)).cast("int")
