"""Annual facts from filing rows (cik, tag, unit_pos, arr_pos, start, end, filed, val, form, fp)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofspark.operators.asof import statements_asof


def annual_facts(facts: DataFrame, field_tags: DataFrame, least_days: int = 300) -> DataFrame:
    """cik, field, fy_end, val, filed: of each fiscal year the value that was filed first.

    Yearly reports and their amendments only; what has a start must span ``least_days``.  On
    equal filing dates the tag with the lower priority number wins, then the first row.
    ``field_tags`` (field, tag, prio) is a short list.
    """
    x = facts.where("form in ('10-K', '10-K/A') and fp = 'FY' and end is not null and filed is not null and val is not null")
    x = x.where(F.col("start").isNull() | (F.datediff("end", "start") >= least_days)).join(field_tags, "tag")
    best = F.min_by(F.struct("val", "filed"), F.struct("filed", "prio", "unit_pos", "arr_pos"))
    return x.groupBy("cik", "field", F.col("end").alias("fy_end")).agg(best.alias("b")).select("cik", "field", "fy_end", "b.val", "b.filed")


def annual_revenue(annual: DataFrame) -> DataFrame:
    """Total revenue where it is reported, else goods plus services, known when the later of them was filed."""
    of = lambda name: annual.where(F.col("field") == name).select("cik", "fy_end", F.col("val").alias(f"{name}_val"), F.col("filed").alias(f"{name}_filed"))
    parts = of("goods").join(of("services"), ["cik", "fy_end"], "full_outer")
    x = of("total").join(parts, ["cik", "fy_end"], "full_outer")
    summed = F.coalesce("goods_val", F.lit(0.0)) + F.coalesce("services_val", F.lit(0.0))
    return x.select("cik", "fy_end", F.coalesce("total_val", summed).alias("val"), F.coalesce("total_filed", F.greatest("goods_filed", "services_filed")).alias("filed"))


def extract_asof(annual: DataFrame, asofs: DataFrame, fields: list[str]) -> DataFrame:
    """cik, as_of, fy_end, each field and its _prior: what was filed by the date for the two newest years of net income."""
    income = annual.where("field = 'net_income'").select(F.col("cik").alias("ticker"), F.col("fy_end").alias("report_date"), F.col("filed").alias("publish_date"))
    years = statements_asof(income, asofs, 2).select(F.col("ticker").alias("cik"), "as_of", F.col("report_date").alias("fy_end"), "age")
    both = years.groupBy("cik", "as_of").agg(F.count(F.lit(1)).alias("n"), F.max("fy_end").alias("newest")).where("n = 2").drop("n")
    x = annual.join(years, ["cik", "fy_end"]).where(F.col("filed") <= F.col("as_of")).join(both, ["cik", "as_of"])
    at = lambda f, k: F.max(F.when((F.col("field") == f) & (F.col("age") == k), F.col("val")))
    return x.groupBy("cik", "as_of", F.col("newest").alias("fy_end")).agg(*[at(f, 1).alias(f) for f in fields], *[at(f, 2).alias(f"{f}_prior") for f in fields])


def read_facts(spark, path: str, lines: bool = False) -> DataFrame:
    """Filing JSON, one company a file or one a line ({cik, facts: {us-gaap: {tag: {units: {unit: [rows]}}}}}) as fact rows."""
    row = "array<struct<start:string,end:string,filed:string,val:double,form:string,fp:string>>"
    schema = f"cik string, facts struct<`us-gaap`:map<string,struct<units:map<string,{row}>>>>"
    x = spark.read.schema(schema).json(path, multiLine=not lines)
    tags = x.select("cik", F.explode(F.col("facts.us-gaap")).alias("tag", "body"))
    units = tags.select("cik", "tag", F.posexplode(F.map_entries("body.units")).alias("unit_pos", "u"))
    rows = units.select("cik", "tag", "unit_pos", F.col("u.key").alias("unit"), F.posexplode("u.value").alias("arr_pos", "r"))
    day = lambda c: F.try_to_date(f"r.{c}").alias(c)
    return rows.select("cik", "tag", "unit", "unit_pos", "arr_pos", day("start"), day("end"), day("filed"), "r.val", "r.form", "r.fp")


def sic_to_sector(sic: Column, rules: list[tuple[int, int, str]]) -> Column:
    """Sector of a code by the first range that holds it; NULL if none does."""
    out = None
    for low, high, name in rules:
        met = sic.between(low, high)
        out = F.when(met, name) if out is None else out.when(met, name)
    return out
