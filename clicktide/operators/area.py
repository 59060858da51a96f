"""Most clicked products per area."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clicktide.functions import json_int, product_status_label

# Fixed area levels.
AREA_LEVELS = {
    "华东": "A",
    "华中": "B",
    "东北": "C",
    "西北": "D",
    "华北": "E",
    "西南": "F",
    "华南": "G",
}


def area_level(area: Column, levels: Mapping[str, str] = AREA_LEVELS) -> Column:
    """Level label of an area; NULL for an area without one."""
    cases = [F.when(area == F.lit(name), F.lit(level)) for name, level in levels.items()]
    return F.coalesce(*cases, F.lit(None).cast("string"))


def product_clicks(actions: DataFrame) -> DataFrame:
    """``city_id, product_id`` of the product clicks."""
    return actions.where(F.col("click_product_id").isNotNull()).select(
        "city_id", F.col("click_product_id").alias("product_id")
    )


def area_product_clicks(
    clicks: DataFrame, cities: DataFrame, levels: Mapping[str, str] = AREA_LEVELS
) -> DataFrame:
    """Clicks and distinct city names per (area, product).

    Clicks are counted per (city, product) before the city join and the second
    aggregation, so a hot product reaches both as at most one row per city and
    map task.
    """
    per_city = clicks.groupBy("city_id", "product_id").agg(F.count(F.lit(1)).alias("n"))
    named = per_city.join(cities.select("city_id", "city_name", "area"), "city_id")
    grouped = named.groupBy("area", "product_id").agg(
        F.sum("n").alias("click_count"),
        F.array_join(F.sort_array(F.collect_set("city_name")), ",").alias("city_infos"),
    )
    return grouped.select(
        "area",
        area_level(F.col("area"), levels).alias("area_level"),
        "product_id",
        "click_count",
        "city_infos",
    )


def product_status(products: DataFrame) -> DataFrame:
    """Products with the status read from their JSON text."""
    return products.select(
        "product_id", "product_name", json_int(F.col("extend_info"), "product_status").alias("product_status")
    )


def area_top_products(
    clicks: DataFrame,
    cities: DataFrame,
    products: DataFrame,
    n: int = 3,
    levels: Mapping[str, str] = AREA_LEVELS,
) -> DataFrame:
    """The ``n`` most clicked products of each area with their product details."""
    best = Window.partitionBy("area").orderBy(F.desc("click_count"), F.asc("product_id"))
    ranked = area_product_clicks(clicks, cities, levels).withColumn("rn", F.row_number().over(best))
    top = ranked.where(F.col("rn") <= n).drop("rn")
    joined = top.join(product_status(products), "product_id", "left")
    return joined.select(
        "area", "area_level", "product_id", "city_infos", "click_count", "product_name",
        "product_status", product_status_label(F.col("product_status")).alias("product_status_label"),
    )
