"""Write operators as rewrites of tables: append, update, retention, cascading delete, idempotent insert, export."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerscope.operators.ranking import numbered
from answerscope.sources.scratch import scratch_path


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def updated(df: DataFrame, where: Column, values: Mapping[str, Column]) -> DataFrame:
    """The table after UPDATE ... SET ... WHERE."""
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def retained(df: DataFrame, plans: DataFrame, as_of: Column, tenant: str = "tenant", ts: str = "ts") -> DataFrame:
    """Rows within their tenant's retention; ``plans`` (tenant, days), tenants without a plan keep all."""
    aged = df.join(plans, tenant, "left")
    return aged.where(F.col("days").isNull() | (F.col(ts) >= as_of - F.make_interval(days=F.col("days")))).drop("days")


def cascade(tables: Mapping[str, DataFrame], parents: Mapping[str, tuple[str, str, str]], doomed: DataFrame, root: str, key: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without the rows that hang on ``doomed`` keys, and a receipt (table, n) with the rows that go.

    ``parents``: table -> (parent table, own column, parent's column), parents first.
    """
    gone = {root: tables[root].join(doomed, key, "left_semi")}
    for name, (parent, own, theirs) in parents.items():
        keys = gone[parent].select(F.col(theirs).alias(own)).distinct()
        gone[name] = tables[name].join(keys, own, "left_semi")
    left = {root: tables[root].join(doomed, key, "left_anti")}
    for name, (parent, own, theirs) in parents.items():
        left[name] = tables[name].join(gone[parent].select(F.col(theirs).alias(own)).distinct(), own, "left_anti")
    counts = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n")) for name, df in gone.items()]
    receipt = counts[0]
    for c in counts[1:]:
        receipt = receipt.unionByName(c)
    return left, receipt


def inserted(existing: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows of ``new`` whose key is not there yet, each key once (the least row by all columns)."""
    once = new.groupBy(*key).agg(F.min(F.struct(*[c for c in new.columns if c not in key])).alias("r")).select(*key, "r.*")
    return once.join(existing.select(*key), list(key), "left_anti")


def export_json(df: DataFrame, name: str) -> DataFrame:
    """Written as JSON and read back with the same schema."""
    path = scratch_path(df.sparkSession, name)
    df.write.json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def export_csv(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.option("header", True).csv(path)
    return df.sparkSession.read.schema(df.schema).option("header", True).csv(path)


def manifest(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per table: rows and an order-free digest of them."""
    out = None
    for name, df in tables.items():
        row = F.conv(F.substring(F.md5(F.to_json(F.struct(*sorted(df.columns))).cast("binary")), 1, 12), 16, 10).cast("decimal(38,0)")
        one = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"), F.sum(row).alias("digest"))
        out = one if out is None else out.unionByName(one)
    return out


def markdown(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A line of a Markdown table per row."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def zipped(df: DataFrame, tenant: str, order: Sequence[Column], rows_per_file: int = 100_000) -> DataFrame:
    """(tenant, part, name, n_rows, sha256, archive): each tenant's rows as CSV members of ZIP archives, in order.

    A tenant of many rows has several archives of ``rows_per_file`` rows, so that no task holds it whole. The digest is
    that of the CSV; times inside the archive are fixed, so that a repeated task makes the same bytes."""
    placed = numbered(df, [tenant], list(order), "_place", "_size")
    columns, kind = df.columns, df.schema[tenant].dataType.simpleString()
    ready = placed.select(*[F.col(c).cast("string").alias(c) for c in columns], F.col(tenant).alias("_tenant"), "_place", F.floor((F.col("_place") - 1) / rows_per_file).cast("int").alias("_part"))

    def pack(key, part: pd.DataFrame) -> pd.DataFrame:
        text = part.sort_values("_place")[columns].to_csv(index=False, lineterminator="\n").encode()
        out, name = io.BytesIO(), f"part-{key[1]:05d}.csv"
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(zipfile.ZipInfo(name), text, zipfile.ZIP_DEFLATED)
        return pd.DataFrame([(key[0], key[1], name, len(part), hashlib.sha256(text).hexdigest(), out.getvalue())], columns=["tenant", "part", "name", "n_rows", "sha256", "archive"])

    return ready.groupBy("_tenant", "_part").applyInPandas(pack, f"tenant {kind}, part int, name string, n_rows long, sha256 string, archive binary")
