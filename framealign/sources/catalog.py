"""Metadata providers of a product: catalog records, uploaded labels, manual entries; their order, and labels that belong to images."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def look_up(products: DataFrame, catalog: DataFrame, family: DataFrame) -> DataFrame:
    """products (name) with the catalog record of their id, else the family's defaults for ids of the short NAC form.

    catalog: product_id and fields; family: one row of the same fields. `record_source` is catalog, family or none.
    """
    fields = [c for c in catalog.columns if c != "product_id"]
    keyed = products.withColumn("pid", X.product_id(F.col("name")))
    known = catalog.withColumn("pid", X.product_id(F.col("product_id"))).drop("product_id").withColumn("there", F.lit(True))
    joined = keyed.join(known, "pid", "left")
    is_family = F.coalesce(F.col("pid").rlike(r"^M\d+[LR]E$"), F.lit(False))
    defaults = family.limit(1).select(*[F.col(c).alias(f"d_{c}") for c in fields])  # one row
    out = joined.join(F.broadcast(defaults), F.lit(True), "left")
    picked = {c: F.coalesce(F.col(c), F.when(is_family & F.col("there").isNull(), F.col(f"d_{c}"))) for c in fields}
    source = F.when(F.col("there"), "catalog").when(is_family, "family").otherwise("none")
    return out.withColumns(picked).withColumn("record_source", source).drop("there", *[f"d_{c}" for c in fields])


def resolve(providers: dict[str, tuple[int, DataFrame]]) -> DataFrame:
    """One row per product_id: the record of the provider with the greatest priority, ties by provider name."""
    parts = [rows.withColumns({"provider": F.lit(name), "priority": F.lit(priority)}) for name, (priority, rows) in providers.items()]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    w = Window.partitionBy("product_id").orderBy(F.col("priority").desc(), "provider")
    return every.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def from_json(texts: DataFrame, schema: str) -> DataFrame:
    """product_id and the fields of a schema from catalog JSON (path, text); text that doesn't parse gives nulls. Lists give a row per record."""
    record = F.from_json("text", f"struct<{schema}>")
    many = F.from_json("text", f"array<struct<{schema}>>")
    rows = texts.withColumn("records", F.when(F.ltrim("text").startswith("["), many).otherwise(F.array(record)))
    return rows.select("path", F.explode_outer("records").alias("r")).select("path", "r.*")


def manual_row(form: DataFrame) -> DataFrame:
    """Manual entries with the sun's elevation as 90 less the incidence where that is given."""
    return form.withColumn("sun_elevation_deg", 90.0 - F.col("solar_incidence_deg").cast("double"))


def merge_manual(parsed: DataFrame, manual: DataFrame, fields: list[str]) -> DataFrame:
    """Parsed rows with manual values that aren't blank put over them."""
    m = manual.select("product_id", *[F.col(c).alias(f"m_{c}") for c in fields])
    out = parsed.join(m, "product_id", "left")
    return out.withColumns({c: F.coalesce(F.when(F.trim(F.col(f"m_{c}").cast("string")) != "", F.col(f"m_{c}")), F.col(c)) for c in fields}).drop(*[f"m_{c}" for c in fields])


def stem(name: Column) -> Column:
    return F.lower(F.regexp_replace(X.base_name(name), r"\.[^.]*$", ""))


#: Letters of a stem by which the longer one is looked up.
GRAM = 4


def associate(images: DataFrame, labels: DataFrame) -> DataFrame:
    """image, label whose stems are equal or one within the other, or where the image's id is the label's parsed product id.

    labels: name, and product_id if the labels were parsed. A stem lies within another only if its first GRAM letters (all, if it
    has fewer) do, so the two meet in an equi-join on these and no cross product is formed. Empty stems meet by id only.
    """
    i = images.select(F.col("name").alias("image"), stem(F.col("name")).alias("si")).filter("image is not null")
    j = labels.select(F.col("name").alias("label"), stem(F.col("name")).alias("sl")).filter("label is not null")

    def within(longer: DataFrame, long: str, shorter: DataFrame, short: str) -> DataFrame:
        size = F.length(long)
        each = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda k: F.col(long).substr(k, n))).otherwise(F.array().cast("array<string>"))))
        keyed = longer.withColumn("g", F.explode(F.array_distinct(each)))
        return keyed.join(shorter.withColumn("g", F.substring(short, 1, GRAM)), "g").filter(F.expr(f"instr({long}, {short}) > 0")).select("image", "label")

    found = within(i, "si", j.filter("sl <> ''"), "sl").unionByName(within(j, "sl", i.filter("si <> ''"), "si"))
    if "product_id" in labels.columns:
        ids = labels.select(F.col("name").alias("label"), X.product_id(F.col("product_id")).alias("pid")).filter("label is not null and pid is not null")
        named = images.select(F.col("name").alias("image"), X.product_id(F.col("name")).alias("pid")).filter("image is not null")
        found = found.unionByName(named.join(ids, "pid").select("image", "label"))
    return found.distinct()
