"""Tables of several sources as Parquet folders: root/source/table, prices by year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.scalars import conform
from tidewater.operators.reconcile import handoff, reconcile, upsert

# Columns and keys of the shared tables, and the columns that make a row complete.
SCHEMAS = {
    "prices": {"sid": "bigint", "date": "date", "open": "double", "high": "double", "low": "double", "close": "double", "volume": "double", "close_adj": "double", "ret_cc": "double", "ret_co": "double"},
    "listings": {"sid": "bigint", "from": "date", "to": "date", "exchange": "string", "category": "string"},
    "actions": {"sid": "bigint", "date": "date", "action": "string", "value": "double"},
    "series": {"series": "string", "date": "date", "available": "date", "value": "double"},
}
KEYS = {"prices": ["sid", "date"], "listings": ["sid", "from"], "actions": ["sid", "date", "action"], "series": ["series", "date"]}
REQUIRED = {"prices": ["open", "high", "low", "close", "ret_cc", "ret_co"], "listings": ["exchange", "category"], "actions": [], "series": ["available", "value"]}


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, source: str, table: str) -> str:
        return f"{self.root}/{source}/{table}"

    def sources(self, table: str) -> list[str]:
        """Sources that hold a copy of the table."""
        return [s for s in children(self.spark, self.root) if exists(self.spark, self.path(s, table))]

    def scan(self, source: str, table: str) -> DataFrame:
        """One source's copy; empty, with the table's columns, where there is none."""
        if not exists(self.spark, self.path(source, table)):
            return self.spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in SCHEMAS[table].items()))
        return conform(self.spark.read.parquet(self.path(source, table)), SCHEMAS[table])

    def write(self, source: str, table: str, df: DataFrame) -> None:
        """Replace the copy, or for prices the years that ``df`` has; Spark's committer makes it all or nothing."""
        out = conform(df, SCHEMAS[table])
        if table == "prices":
            out = out.withColumn("year", F.year("date")).repartition("year").sortWithinPartitions(*KEYS[table])
            out.write.option("compression", "zstd").option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("year").parquet(self.path(source, table))
        else:
            out.write.option("compression", "zstd").mode("overwrite").parquet(self.path(source, table))

    def upsert(self, source: str, table: str, df: DataFrame, arrival: list) -> None:
        """Merge rows by key, the last arrival counts; prices read and rewrite only the years that ``df`` touches."""
        old = self.scan(source, table)
        if table == "prices":
            years = [r.y for r in df.select(F.year("date").alias("y")).distinct().collect()]
            old = old.filter(F.year("date").isin(years))
        target = self.path(source, table)
        merged = conform(upsert(old, df, KEYS[table], arrival), SCHEMAS[table])
        staging = f"{target}__staging"
        merged.write.mode("overwrite").parquet(staging)  # a table cannot be overwritten while it is read
        self.write(source, table, self.spark.read.parquet(staging))
        fs, p = _fs(self.spark, staging)
        fs.delete(p, True)

    def clear(self, source: str, table: str) -> None:
        fs, p = _fs(self.spark, self.path(source, table))
        fs.delete(p, True)

    def read(self, table: str, columns: list[str] | None = None, start=None, end=None, sids: DataFrame | None = None, priority: list[str] | None = None) -> DataFrame:
        """The reconciled table: one row a key. Ids and dates are filtered before the union's shuffle, except that the handoff of
        prices is decided over all dates. The key is always among the columns."""
        copies = {s: self.scan(s, table) for s in self.sources(table)}
        if not copies:
            return self.scan("-", table)
        if sids is not None and "sid" in SCHEMAS[table]:
            copies = {s: df.join(F.broadcast(sids.select("sid").distinct()) if sids.count() <= 1_000_000 else sids.select("sid").distinct(), "sid", "left_semi") for s, df in copies.items()}
        order = {} if priority is None else {"priority": priority}
        date = "date" if "date" in SCHEMAS[table] else None

        def within(df: DataFrame) -> DataFrame:
            if date and start is not None:
                df = df.filter(F.col(date) >= F.lit(start))
            return df.filter(F.col(date) <= F.lit(end)) if date and end is not None else df

        if table == "prices":
            keep = handoff(copies, **order).select("sid", "date", "source")
            rows = within(keep)
            every = None
            for s, df in copies.items():
                part = df.withColumn("source", F.lit(s))
                every = part if every is None else every.unionByName(part)
            out = every.join(rows, ["sid", "date", "source"], "left_semi").drop("source")
        else:
            out = reconcile({s: within(df) for s, df in copies.items()}, KEYS[table], REQUIRED[table], **order).drop("source")
        names = list(SCHEMAS[table]) if columns is None else [*KEYS[table], *[c for c in columns if c not in KEYS[table]]]
        return out.select(*names).orderBy(*KEYS[table])

    def span(self, table: str) -> tuple:
        """(first, last) date over all sources; (None, None) without any."""
        parts = [self.scan(s, table).agg(F.min("date").alias("a"), F.max("date").alias("b")) for s in self.sources(table)]
        if not parts:
            return None, None
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        r = out.agg(F.min("a").alias("a"), F.max("b").alias("b")).first()
        return r.a, r.b
