"""Tables as folders of Parquet versions: what a relational store's table commands do, without a server.

A change writes a new version next to the old one. The newest committed version is the table, so a reader sees
the table before or after a change, and a job that is run again after a lost executor leaves no half of one.
Old versions go when the next change is committed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[int]:
        where = self._path(f"{self.folder}/{name}")
        if not self._files.exists(where):
            return []
        found = (x.getPath().getName() for x in self._files.listStatus(where))
        return sorted(int(v) for v in found if v.isdigit() and self._files.exists(self._path(f"{self.folder}/{name}/{v}/_SUCCESS")))

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    def tables(self) -> list[str]:
        root = self._path(self.folder)
        found = [x.getPath().getName() for x in self._files.listStatus(root)] if self._files.exists(root) else []
        return sorted(n for n in found if self.exists(n))

    def read(self, name: str) -> DataFrame:
        versions = self._versions(name)
        if not versions:
            raise ValueError(f"no table {name}")
        return self.spark.read.parquet(f"{self.folder}/{name}/{versions[-1]}")

    def put(self, name: str, rows: DataFrame) -> DataFrame:
        """Make ``rows`` the table."""
        old = self._versions(name)
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/{(old[-1] if old else 0) + 1}")
        for v in old[:-1]:
            self._files.delete(self._path(f"{self.folder}/{name}/{v}"), True)
        return self.read(name)

    def create(self, name: str, schema: str) -> DataFrame:
        if self.exists(name):
            raise ValueError(f"table {name} exists")
        return self.put(name, self.spark.createDataFrame([], schema))

    def drop(self, name: str) -> None:
        self._files.delete(self._path(f"{self.folder}/{name}"), True)

    def insert(self, name: str, rows: DataFrame) -> DataFrame:
        """Add rows to the table in place; columns go by their names."""
        own = self.read(name)
        fitted = rows.select(*(F.col(f.name).cast(f.dataType) for f in own.schema))
        fitted.write.mode("append").parquet(f"{self.folder}/{name}/{self._versions(name)[-1]}")
        return self.read(name)

    def update(self, name: str, values: dict[str, Column], where: Column) -> DataFrame:
        own = self.read(name)
        return self.put(name, own.select(*(F.when(where, values[f.name]).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) if f.name in values else F.col(f.name) for f in own.schema)))

    def delete(self, name: str, where: Column) -> DataFrame:
        return self.put(name, self.read(name).where(~F.coalesce(where, F.lit(False))))

    def clear(self, name: str) -> DataFrame:
        return self.put(name, self.read(name).limit(0))

    def clone(self, name: str, target: str, rows: bool = True) -> DataFrame:
        """A copy, or an empty table of the same columns."""
        return self.put(target, self.read(name) if rows else self.read(name).limit(0))

    def backup(self, name: str) -> DataFrame:
        return self.clone(name, f"{name}_backup")

    def restore(self, name: str) -> DataFrame:
        return self.clone(f"{name}_backup", name)

    def load(self, name: str, rows: DataFrame, keys: Sequence[str] = (), duplicates: str = "ignore") -> DataFrame:
        """Add rows; of equal keys the table's row stays (``ignore``) or goes (``replace``). Of several new rows with
        one key the least one counts. Without keys all rows are added."""
        if not keys:
            return self.insert(name, rows)
        own = self.read(name)
        fresh = rows.select(*own.columns).groupBy(*keys).agg(F.min(F.struct(*(c for c in own.columns if c not in keys))).alias("_r")).select(*keys, "_r.*").select(*own.columns)
        match = lambda a, b: a.join(b.select(*(F.col(k).alias(f"_{k}") for k in keys)), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti")
        return self.put(name, own.unionByName(match(fresh, own)) if duplicates == "ignore" else match(own, fresh).unionByName(fresh))

    def dump(self, name: str, path: str) -> None:
        self.read(name).write.option("sep", "\t").option("header", True).option("nullValue", "\\N").csv(path)

    def load_dump(self, name: str, path: str, schema: str) -> DataFrame:
        return self.put(name, self.spark.read.schema(schema).option("sep", "\t").option("header", True).option("nullValue", "\\N").csv(path))

    def optimize(self, name: str, files: int, order: Sequence[str] = ()) -> DataFrame:
        """Rewrite the table as about so many files, sorted within them."""
        rows = self.read(name).repartition(files, *order)
        return self.put(name, rows.sortWithinPartitions(*order) if order else rows)

    def execute(self, sql: str) -> DataFrame:
        """Run a statement over the tables by their names."""
        for name in self.tables():
            self.read(name).createOrReplaceTempView(name)
        return self.spark.sql(sql)


def unique(rows: DataFrame) -> DataFrame:
    return rows.distinct()


def next_names(known: DataFrame, wanted: DataFrame, pattern: str = "%06d") -> DataFrame:
    """``wanted`` with unused names behind the largest number among ``known`` (name). Rows are numbered in the order
    of ``id``, so their table has to be a short one."""
    most = known.agg(F.coalesce(F.max(F.regexp_extract("name", r"(\d+)$", 1).try_cast("int")), F.lit(0)).alias("_m"))
    return wanted.withColumn("_k", F.row_number().over(W.orderBy("id"))).crossJoin(F.broadcast(most)).withColumn("name", F.format_string(pattern, F.col("_m") + F.col("_k"))).drop("_k", "_m")
