"""Published tables: constraints checked before, versions swapped by a manifest written last, streams upserted batch by batch."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

MANIFEST = "version long, table string, path string, rows long, digest string, stream string, batch long"


@dataclass(frozen=True)
class Table:
    """A table's columns (types in DDL; those with `?` may be null, all others may not), key, checks (SQL), defaults (SQL) and references: column to table, column and what a deleted row does (`cascade`, `null` or `refuse`)."""

    columns: dict[str, str]
    key: str = "id"
    checks: tuple[str, ...] = ()
    defaults: dict[str, str] = field(default_factory=dict)
    refers: dict[str, tuple[str, str, str]] = field(default_factory=dict)

    def conform(self, rows: DataFrame) -> DataFrame:
        """The table's columns in order and type, missing ones from their defaults or null."""
        held = set(rows.columns)
        pick = lambda c: F.col(c) if c in held else F.expr(self.defaults.get(c, "null"))
        return rows.select(*[pick(c).cast(t.rstrip("?")).alias(c) for c, t in self.columns.items()])


def violations(tables: dict[str, DataFrame], specs: dict[str, Table]) -> DataFrame:
    """table, rule, n: how many rows break each rule of their table (`column is null`, a check, `duplicate key` or `column without table`), where any do. A table is read once for its own rules."""
    out = []
    for name, rows in tables.items():
        spec = specs[name]
        rules = {f"{c} is null": F.col(c).isNull() for c, t in spec.columns.items() if not t.endswith("?")} | {c: ~F.expr(c) for c in spec.checks}
        counted = rows.agg(*[F.count_if(broken).alias(rule.replace("`", "")) for rule, broken in rules.items()])
        out.append(counted.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"`{r}`").alias("n")) for r in rules])).alias("x")).select(F.lit(name).alias("table"), "x.*"))
        twice = rows.groupBy(spec.key).count().where("count > 1").agg((F.coalesce(F.sum("count"), F.lit(0)) - F.count("*")).alias("n"))
        out.append(twice.select(F.lit(name).alias("table"), F.lit("duplicate key").alias("rule"), "n"))
        for column, (other, key, _) in spec.refers.items():
            lost = rows.where(F.col(column).isNotNull()).join(tables[other].select(F.col(key).alias(column)), column, "left_anti").agg(F.count("*").alias("n"))
            out.append(lost.select(F.lit(name).alias("table"), F.lit(f"{column} without {other}").alias("rule"), "n"))
    return reduce(DataFrame.unionByName, out).where("n > 0")


def deleted(tables: dict[str, DataFrame], specs: dict[str, Table], name: str, gone: DataFrame) -> dict[str, DataFrame]:
    """All tables after rows of `name` with the keys in `gone` (the key column) go: rows that refer to them go too (and what refers to these), lose the reference, or refuse (the action fails)."""
    key = specs[name].key
    gone = gone.select(F.col(key)).distinct()
    out = tables | {name: tables[name].join(gone, key, "left_anti")}
    for other, spec in specs.items():
        for column, (target, _, does) in spec.refers.items():
            if target != name or other not in tables:
                continue
            hit = gone.select(F.col(key).alias(column))
            if does == "cascade":
                out = deleted(out, specs, other, out[other].join(hit, column, "left_semi").select(spec.key))
            elif does == "null":
                marked = out[other].join(hit.withColumn("_gone", F.lit(True)), column, "left")
                out[other] = marked.withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).select(*tables[other].columns)
            else:
                marked = out[other].join(hit.withColumn("_gone", F.lit(True)), column, "left")
                refuse = F.when(F.col("_gone"), F.raise_error(F.concat(F.lit(f"{other}.{column} still refers to "), F.col(column).cast("string"))).cast("boolean")).otherwise(True)
                out[other] = marked.where(refuse).select(*tables[other].columns)
    return out


def digest(rows: DataFrame, ignored: tuple[str, ...] = ()) -> tuple[int, str]:
    """How many rows a table has, and a digest of them in any order."""
    columns = sorted(c for c in rows.columns if c not in ignored)
    both = [F.sum(F.xxhash64(*columns, F.lit(seed)).cast("decimal(38,0)")).cast("string") for seed in (1, 2)]
    n, a, b = rows.agg(F.count("*"), *both).first()
    return n, f"{a}/{b}/{','.join(columns)}"


class Catalog:
    """Versions of tables in a folder. Readers see the last version whose manifest was written; a write that fails leaves nothing to see."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def manifest(self) -> DataFrame:
        """One row for each table of each version."""
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest/*")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def version(self) -> int:
        return self.manifest().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def held(self, version: int | None = None) -> dict[str, dict]:
        """What the manifest says of each table, by name: a handful of rows."""
        version = self.version() if version is None else version
        return {r["table"]: r.asDict() for r in self.manifest().where(F.col("version") == version).collect()}

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.held(version)[table]["path"])

    def publish(self, tables: dict[str, DataFrame], specs: dict[str, Table] | None = None, ignored: tuple[str, ...] = (), stream: str = "", batch: int = -1) -> int:
        """Write what changed and swap: the new version's number, or the old one's if nothing changed (columns in `ignored` don't count).

        Rows that break a constraint of `specs` are an error, and nothing is written. Tables that aren't named stay as they are. New
        data go to folders of their own; the manifest, one small file, is written last.
        """
        if specs:
            broken = violations(tables, specs).collect()  # a row for each broken rule
            if broken:
                raise ValueError("; ".join(sorted(f"{r['table']}: {r['rule']} ({r['n']} rows)" for r in broken)))
        old, last = self.held(), self.version()
        rows, changed = dict(old), False
        for name, df in tables.items():
            n, told = digest(df, ignored)
            if name in old and (old[name]["rows"], old[name]["digest"]) == (n, told):
                continue
            path = f"{self.folder}/data/{name}/{uuid.uuid4().hex}"
            df.write.parquet(path)
            rows[name], changed = {"table": name, "path": path, "rows": n, "digest": told}, True
        if not changed and batch < 0:
            return last
        listed = [(last + 1, r["table"], r["path"], r["rows"], r["digest"], stream, batch) for r in rows.values()]
        self.spark.createDataFrame(listed, MANIFEST).coalesce(1).write.mode("error").parquet(f"{self.folder}/manifest/version={last + 1}")
        return last + 1

    def upsert(self, rows: DataFrame, table: str, key: list[str], order: str, stream: str, batch: int) -> bool:
        """Put a batch in: of each key the row of the largest `order` stays. A batch that is there already (of this stream, by number) changes nothing; says whether it was new."""
        seen = self.manifest().where((F.col("stream") == stream) & (F.col("batch") >= batch))
        if not seen.isEmpty():
            return False
        base = self.held()
        both = self.read(table).unionByName(rows) if table in base else rows
        others = [c for c in both.columns if c not in (*key, order)]
        best = both.groupBy(*key).agg(F.max(F.struct(order, *others)).alias("b"))
        self.publish({table: best.select(*key, "b.*").select(*both.columns)}, stream=stream, batch=batch)
        return True

    def upserts(self, stream: DataFrame, table: str, key: list[str], order: str, name: str) -> DataStreamWriter:
        """A writer that puts each micro-batch of a stream in; a batch that runs again after a failure changes nothing."""
        return stream.writeStream.foreachBatch(lambda rows, batch: self.upsert(rows, table, key, order, name, batch) and None).queryName(name)
