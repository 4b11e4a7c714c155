"""Parsers of vendor files: text and JSON held in DataFrame columns or read by Spark, with fixed schemas."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.classify import normalize


def text_csv(spark: SparkSession, path: str, columns: list[str], sep: str = ",") -> DataFrame:
    """A CSV with header, all columns as text; missing ones are null."""
    df = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path)
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def zipped_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The first CSV of each zip under a path, as text. A zip can't be split, so a task unpacks each; rows are spread afterwards."""

    def unpack(batches):
        import csv

        import pandas as pd

        for pdf in batches:
            for blob in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(blob)) as z, z.open(z.namelist()[0]) as f:
                    held = []
                    for row in csv.DictReader(io.TextIOWrapper(f, "utf-8")):
                        held.append([row.get(c) or None for c in columns])
                        if len(held) == 50_000:
                            yield pd.DataFrame(held, columns=columns)
                            held = []
                    yield pd.DataFrame(held, columns=columns)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, ", ".join(f"`{c}` string" for c in columns))


def newest_update(df: DataFrame) -> DataFrame:
    return df.agg(F.max(F.try_to_date(F.col("lastupdated"))).alias("asof"))


def pulls(bulk: DataFrame, updates: DataFrame, bulk_date) -> DataFrame:
    """Bulk rows (pull -1, as of the bulk's date) and nightly updates (with ``pulled``) as one log."""
    b = bulk.withColumn("pull", F.lit(-1)).withColumn("asof", F.lit(bulk_date).cast("date"))
    u = updates.withColumn("asof", F.col("pulled").cast("date")).withColumn("pull", F.unix_date("asof"))
    return b.unionByName(u.drop("pulled"), allowMissingColumns=True)


def directory(spark: SparkSession, path: str, symbol: str, name: str, exchange: Column, etf: str = "ETF", test: str = "Test Issue", also_test: Column | None = None) -> DataFrame:
    """A pipe-delimited directory file with a footer row, in the common schema."""
    raw = spark.read.option("header", True).option("sep", "|").csv(path)
    rows = raw.filter(F.col(symbol).isNotNull() & ~F.col(symbol).startswith("File Creation"))
    tested = (F.col(test) == "Y") if also_test is None else ((F.col(test) == "Y") | also_test)
    return rows.select(F.trim(symbol).alias("symbol"), F.trim(name).alias("name"), exchange.alias("exchange"), (F.col(etf) == "Y").alias("etf"), F.coalesce(tested, F.lit(False)).alias("test_issue"))


def nasdaq_listed(spark: SparkSession, path: str) -> DataFrame:
    return directory(spark, path, "Symbol", "Security Name", F.lit("NASDAQ"), also_test=F.col("NextShares") == "Y")


def other_listed(spark: SparkSession, path: str) -> DataFrame:
    venue = F.col("Exchange")
    names = F.when(venue == "N", "NYSE").when(venue == "A", "NYSE MKT").when(venue == "P", "NYSE ARCA").when(venue == "Z", "BATS").otherwise(venue)
    return directory(spark, path, "ACT Symbol", "Security Name", names)


BARS = "map<string,array<struct<t:string,o:double,h:double,l:double,c:double,v:double,vw:double,n:bigint>>>"


def bars(payloads: DataFrame, column: str = "json") -> DataFrame:
    """{symbol: [bar]} payloads as rows; the UTC time gives the New York day. Of repeated bars the last payload's counts."""
    parsed = payloads.select(F.monotonically_increasing_id().alias("_p"), F.explode(F.from_json(column, BARS)).alias("symbol", "_b")).select("_p", "symbol", F.posexplode("_b").alias("_i", "b"))
    day = F.to_date(F.from_utc_timestamp(F.to_timestamp("b.t"), "America/New_York"))
    out = parsed.select("_p", "_i", "symbol", day.alias("date"), F.col("b.o").alias("open"), F.col("b.h").alias("high"), F.col("b.l").alias("low"), F.col("b.c").alias("close"), F.col("b.v").alias("volume"), F.col("b.vw").alias("vwap"), F.col("b.n").alias("trade_count"))
    from tidewater.operators.reconcile import first_rows

    return first_rows(out, ["symbol", "date"], [F.desc("_p"), F.desc("_i")]).drop("_p", "_i")


FACTS = "struct<cik:bigint,facts:map<string,map<string,struct<units:map<string,array<struct<start:string,end:string,val:double,accn:string,form:string,filed:string>>>>>>>"


def facts(payloads: DataFrame, tags: list[str], forms: list[str] = ["10-K", "10-Q", "10-K/A", "10-Q/A"], column: str = "json") -> DataFrame:
    """Company payloads as facts: kept tags and forms, units of money or shares, instants and periods of a usual length."""
    from tidewater.operators.filings import LENGTHS

    j = F.from_json(column, FACTS)
    a = payloads.select(j.alias("j")).select(F.col("j.cik").alias("cik"), F.explode("j.facts").alias("_ns", "_tags")).select("cik", F.explode("_tags").alias("tag", "_t"))
    u = a.filter(F.col("tag").isin(tags)).select("cik", "tag", F.explode("_t.units").alias("unit", "_v")).filter(F.col("unit").isin("USD", "shares")).select("cik", "tag", F.explode("_v").alias("v"))
    r = u.select("cik", "tag", F.to_date("v.end").alias("end"), F.col("v.val").alias("value"), F.to_date("v.filed").alias("filed"), F.col("v.accn").alias("accn"), F.col("v.form").alias("form"), F.to_date("v.start").alias("start"))
    days = F.datediff("end", "start")
    usual = F.col("start").isNull()
    for low, high in LENGTHS.values():
        usual = usual | days.between(low, high)
    return r.filter(F.col("form").isin(forms) & usual)


def annual(rows: DataFrame) -> DataFrame:
    """Facts of annual reports: instants and year-long periods."""
    return rows.filter(F.col("form").startswith("10-K") & (F.col("start").isNull() | F.datediff("end", "start").between(350, 380)))


def observations(payloads: DataFrame, column: str = "json", lag: str = "lag_days", first_release: str = "first_release") -> DataFrame:
    """Series payloads (series, json, lag_days, first_release) as (series, date, value, available): the release day, or the lag."""
    kind = "struct<observations:array<struct<date:string,value:string,realtime_start:string>>>"
    o = payloads.select("series", lag, first_release, F.explode(F.from_json(column, kind).getField("observations")).alias("o"))
    day = F.to_date("o.date")
    return o.select("series", day.alias("date"), F.expr("try_cast(o.value as double)").alias("value"), F.when(F.col(first_release), F.to_date("o.realtime_start")).otherwise(F.date_add(day, F.col(lag))).alias("available")).filter("value is not null")


def rate_rows(df: DataFrame, date: str, value: str, date_format: str | None = None) -> DataFrame:
    """(date, rate): percent text to a fraction, "." dropped; an HTML page instead of a table raises."""
    if date not in df.columns or value not in df.columns:
        raise ValueError(f"expected columns {date} and {value}, got {df.columns[:3]}")
    d = F.to_date(date, date_format) if date_format else F.to_date(date)
    return df.select(d.alias("date"), (F.expr(f"try_cast(nullif(trim(`{value}`), '.') as double)") / 100).alias("rate")).filter("rate is not null")


def ticker_list(df: DataFrame) -> DataFrame:
    """A vendor's list of tickers, typed; undated ones drop out."""
    return df.select(normalize(F.col("ticker")).alias("symbol"), F.col("ticker").alias("vendor_ticker"), "exchange", F.col("assetType").alias("asset_type"), F.col("priceCurrency").alias("currency"), F.try_to_date(F.col("startDate")).alias("start"), F.try_to_date(F.col("endDate")).alias("end")).filter("start is not null and end is not null")


def ticker_map(payload: DataFrame, column: str = "json") -> DataFrame:
    """{"0": {"cik_str", "ticker"}} as (symbol, cik), the first of a symbol by its place."""
    from tidewater.operators.reconcile import first_rows

    e = payload.select(F.explode(F.from_json(column, "map<string,struct<cik_str:bigint,ticker:string>>")).alias("k", "v"))
    out = e.select(normalize(F.col("v.ticker")).alias("symbol"), F.col("v.cik_str").alias("cik"), F.expr("try_cast(k as int)").alias("_k"))
    return first_rows(out, ["symbol"], ["_k"]).drop("_k")


# Macro series as (id, name, kind, first release, lag in days).
CONTEXT_SERIES = (
    ("DCOILWTICO", "oil", "log", False, 1),
    ("DHHNGSP", "natural_gas", "log", False, 1),
    ("PCOPPUSDM", "copper", "log", False, 45),
    ("DFF", "fed_funds", "diff", False, 1),
    ("DGS3MO", "yield_3m", "diff", False, 1),
    ("DGS2", "yield_2y", "diff", False, 1),
    ("DGS10", "yield_10y", "diff", False, 1),
    ("DGS30", "yield_30y", "diff", False, 1),
    ("T10YIE", "breakeven_10y", "diff", False, 1),
    ("DFII10", "real_yield_10y", "diff", False, 1),
    ("BAA10Y", "baa_spread", "diff", False, 1),
    ("VIXCLS", "vix", "diff", False, 0),
    ("DTWEXBGS", "dollar", "log", False, 1),
    ("NFCI", "financial_conditions", "diff", True, 1),
    ("UNRATE", "unemployment", "diff", True, 1),
    ("PAYEMS", "payrolls", "yoy", True, 1),
    ("ICSA", "jobless_claims", "log", True, 1),
    ("CPIAUCSL", "cpi", "yoy", True, 1),
    ("CPILFESL", "core_cpi", "yoy", True, 1),
    ("INDPRO", "industrial_production", "yoy", True, 1),
    ("RSAFS", "retail_sales", "yoy", True, 1),
    ("HOUST", "housing_starts", "log", True, 1),
    ("UMCSENT", "consumer_sentiment", "diff", True, 1),
)


def context_series(spark: SparkSession) -> DataFrame:
    """The macro series as a table (series, name, kind, first_release, lag_days)."""
    return spark.createDataFrame(list(CONTEXT_SERIES), "series string, name string, kind string, first_release boolean, lag_days int")


def fund_prices(payloads: DataFrame, column: str = "json") -> DataFrame:
    """(symbol, date, adj_close) from payloads (symbol, [bars])."""
    b = payloads.select("symbol", F.explode(F.from_json(column, "array<struct<date:string,adjClose:double>>")).alias("b"))
    return b.select("symbol", F.to_date(F.substring("b.date", 1, 10)).alias("date"), F.col("b.adjClose").alias("adj_close"))


def zip_members(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """(name, json) of the members of zips under a path; a task unpacks a zip and yields its members one by one."""

    def unpack(batches):
        import pandas as pd

        for pdf in batches:
            for blob in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(blob)) as z:
                    for name in sorted(n for n in z.namelist() if n.endswith(suffix)):
                        yield pd.DataFrame({"name": [name], "json": [z.read(name).decode()]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "name string, json string")


def latest_end(end, now, delay_minutes: int = 16):
    """An end time no later than the vendor's delay allows."""
    import datetime as dt

    return min(end, now - dt.timedelta(minutes=delay_minutes))


def numeric_columns(df: DataFrame, prefix: str = "env_") -> DataFrame:
    """The date and all numeric columns, these with a prefix."""
    kinds = {"double", "float", "bigint", "int", "smallint", "tinyint"}
    return df.select("date", *[F.col(c).alias(prefix + c) for c, t in df.dtypes if t in kinds and c != "date"])
