"""Readers and append-only sinks of locks, fills, gap rows, maps and panels."""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_SCHEMA = "symbol string, dt date, open double, high double, low double, close double, volume double"
FILL_SCHEMA = "account string, date date, side string, ticker string, shares double, dollars double, note string"
LOCK_SCHEMA = (
    "lock_date date, data_asof date, strategy string, n int, picks map<string,double>, lock_prices map<string,double>, spy_lock double, regime string, "
    "knife_edges array<string>, signal_snapshot struct<asof: date, closes: map<string, struct<window64: array<double>, looks: map<string,double>>>>"
)


def clean(c: Column) -> Column:
    """NaN to NULL."""
    return F.when(~F.isnan(c), c)


def read_bars(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars from CSV or Parquet within [start, end]; the dates reach the scan as filters, NaN becomes NULL."""
    reader = spark.read.schema(BAR_SCHEMA)
    df = reader.parquet(path) if path.rstrip("/").endswith(".parquet") else reader.csv(path, header=True)
    if start:
        df = df.where(F.col("dt") >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col("dt") <= F.lit(end).cast("date"))
    return df.withColumns({c: clean(F.col(c)) for c in ("open", "high", "low", "close", "volume")})


def read_panel(spark: SparkSession, path: str, field: str) -> DataFrame:
    """A wide CSV (dt, one column a symbol) as symbol, dt, field; missing cells go."""
    wide = spark.read.csv(path, header=True).withColumnRenamed("Date", "dt")
    names = [c for c in wide.columns if c != "dt"]
    long = wide.unpivot(["dt"], names, "symbol", field)
    return long.select("symbol", F.col("dt").cast("date").alias("dt"), clean(F.col(field).try_cast("double")).alias(field)).where(f"{field} is not null")


def read_csv_na(spark: SparkSession, path: str, schema: str, missing: str = ".") -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, nullValue=missing).dropna()


def read_constituents(spark: SparkSession, path: str) -> DataFrame:
    """One ticker a line, trimmed, upper case, with dots as hyphens; blank lines go."""
    name = F.upper(F.regexp_replace(F.trim("value"), r"\.", "-"))
    return spark.read.text(path).select(name.alias("symbol")).where("symbol <> ''")


def read_ticker_map(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """{key: {ticker, cik_str}} as ticker (upper case) and cik (10 digits); one map a file, or one a line."""
    kind = "map<string,struct<ticker:string,cik_str:bigint>>"
    rows = spark.read.text(path, wholetext=not lines).select(F.explode(F.map_values(F.from_json("value", kind))).alias("r"))
    return rows.select(F.upper("r.ticker").alias("ticker"), F.lpad(F.col("r.cik_str").cast("string"), 10, "0").alias("cik"))


def read_sic_map(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """{cik: code} as cik and a four-digit sic, empty if unknown; one map a file, or one a line."""
    rows = spark.read.text(path, wholetext=not lines).select(F.explode(F.from_json("value", "map<string,string>")).alias("cik", "sic"))
    return rows.select(F.lpad("cik", 10, "0").alias("cik"), F.when(F.coalesce("sic", F.lit("")) == "", "").otherwise(F.lpad("sic", 4, "0")).alias("sic"))


def read_rates(spark: SparkSession, path: str, missing: str = ".") -> DataFrame:
    """dt, rf from a file of (dt, rate in percent): missing rates go, percent become shares."""
    x = read_csv_na(spark, path, "dt date, rate double", missing)
    return x.select("dt", (F.col("rate") / 100).alias("rf"))


def read_statements(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """Semicolon-separated statements: the columns of ``names`` under their new names, dates and numbers typed by name."""
    x = spark.read.csv(path, header=True, sep=";")
    kind = lambda c: "date" if c.endswith("_date") else "string" if c in ("ticker", "sector") else "double"
    return x.select(*[F.col(f"`{old}`").try_cast(kind(new)).alias(new) for old, new in names.items()]).where("ticker is not null and report_date is not null")


def read_dividends(spark: SparkSession, path: str) -> DataFrame:
    """symbol, ex_dt, amount of a CSV file; rows without an amount, or with none paid, go."""
    return spark.read.schema("symbol string, ex_dt date, amount double").csv(path, header=True).where("amount is not null and amount <> 0")


def read_labelled(statement: DataFrame, labels: dict[str, list[str]]) -> DataFrame:
    """First present value among a field's labels, by period: rows of (ticker, label, period, val) to (ticker, period, field, val)."""
    spark = statement.sparkSession
    table = spark.createDataFrame([(f, name, k) for f, names in labels.items() for k, name in enumerate(names)], "field string, label string, prio int")
    return statement.where("val is not null").join(table, "label").groupBy("ticker", "period", "field").agg(F.min_by("val", "prio").alias("val"))


def read_locks(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Dated JSON locks, one a file or one a line, as one row a pick: book, lock_date, symbol, w, price."""
    x = spark.read.schema(LOCK_SCHEMA).json(path, multiLine=not lines)
    picks = x.select(F.col("strategy").alias("book"), "lock_date", "lock_prices", F.explode("picks").alias("symbol", "w"))
    return picks.select("book", "lock_date", "symbol", "w", F.element_at("lock_prices", F.col("symbol")).alias("price"))


class _Folder:
    """Steps in a folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._root = self._path(path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(self._root, name)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(name))]

    def move(self, old: str, new: str) -> bool:
        self._fs.mkdirs(self._at(new).getParent())
        return self._fs.rename(self._at(old), self._at(new))

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def claim(self, name: str, owner: str) -> bool:
        """Whether this call made the folder ``name``; of many callers one gets True.

        A folder that holds the owner's name is made beside it and renamed.  Where ``name`` is there already, a rename
        fails or puts the folder inside, so only the first owner's name stands at its top.
        """
        self._fs.create(self._at(f"{name}-{owner}/{owner}"), True).close()
        if not self.exists(name):
            self.move(f"{name}-{owner}", name)
        self.delete(f"{name}-{owner}")
        return self.exists(f"{name}/{owner}")


def write_lock(locks: DataFrame, path: str) -> None:
    """Writes locks, one for a book and month; a month that is there already is refused, whoever else writes at the time.

    Every month is claimed first; only then the rows are written beside the table and moved in, a month at a time, so a
    reader sees whole months.  If a claim or the write fails, this call's claims are given back and nothing is moved.
    """
    spark = locks.sparkSession
    folder, owner = _Folder(spark, path), uuid.uuid4().hex
    new = locks.withColumn("month", F.date_format("lock_date", "yyyy-MM"))
    months = sorted(map(tuple, new.select("book", "month").distinct().collect()))  # one row a lock
    claimed: list[str] = []
    try:
        for book, month in months:
            name = f"_claims/{quote(book, safe='')}-{month}"
            if not folder.claim(name, owner):
                raise ValueError(f"{book} is locked for {month}")
            claimed.append(name)
        new.write.partitionBy("book", "month").parquet(f"{path.rstrip('/')}/_staged-{owner}")
    except BaseException:
        for name in claimed:
            folder.delete(name)
        folder.delete(f"_staged-{owner}")
        raise
    for book in (n for n in folder.names(f"_staged-{owner}") if n.startswith("book=")):
        for month in folder.names(f"_staged-{owner}/{book}"):
            folder.move(f"_staged-{owner}/{book}/{month}", f"{book}/{month}")
    folder.delete(f"_staged-{owner}")


def append_fills(fills: DataFrame, path: str) -> None:
    """Appends to the journal; a side other than BUY and SELL is refused."""
    if fills.where("side not in ('BUY', 'SELL') or side is null").take(1):
        raise ValueError("side must be BUY or SELL")
    fills.write.mode("append").json(path)


def read_fills(spark: SparkSession, path: str) -> DataFrame:
    """The journal's rows, in no order (each reader sorts within its own keys)."""
    return spark.read.schema(FILL_SCHEMA).json(path)


def append_gap_row(row: DataFrame, path: str) -> None:
    """Appends gap rows (date, twin_asof, real, twin); a twin older than one business day is noted as provisional."""
    days = F.when(F.col("twin_asof") < F.col("date"), F.size(F.filter(F.sequence("twin_asof", F.date_sub("date", 1)), lambda d: F.weekday(d) < 5))).otherwise(0)
    row.withColumn("note", F.when(days > 1, "PROVISIONAL").otherwise("")).write.mode("append").csv(path, header=True)


def upsert_month(history: DataFrame, new: DataFrame, month: str = "month") -> DataFrame:
    """History with the rows of the new months replaced."""
    return history.join(new.select(month).distinct(), month, "left_anti").unionByName(new)


def daily_wide(curves: DataFrame, runs: list[str]) -> DataFrame:
    """dt and one column a run, at two places, on all dates that any run has."""
    return curves.groupBy("dt").pivot("run_id", runs).agg(F.round(F.first("equity"), 2))
