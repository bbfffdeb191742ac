"""Source queries: path scans and file listings (S2, S8, Q-21)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators.quality import file_lifecycle as lifecycle_op
from tidemark.plans.registry import query
from tidemark.sources.readers import file_inventory as inventory_op
from tidemark.sources.readers import read_path


@query("scan_path", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def scan_path(spark, sf):
    """Scan of a table stored at a path; only the projected columns are read (ReadSchema)."""
    return read_path(spark, f"{sf}/orders.parquet", "parquet").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("file_inventory")
def file_inventory(spark, sf):
    """Recursive listing of the data folder with size and modification time (contents not read)."""
    return inventory_op(spark, sf, "*.parquet")


@query("file_lifecycle")
def file_lifecycle(spark, sf):
    """Q-21: files untouched for 30 days relative to an evaluation instant become deletable.

    The instant is 30 days after the newest file, so files older than the newest are deletable.
    """
    inv = inventory_op(spark, sf, "*.parquet")
    newest = inv.agg(F.max("last_update_date").alias("m")).first()["m"]
    now = (newest + dt.timedelta(days=30)).replace(tzinfo=None) if newest else dt.datetime(1970, 1, 1)
    return lifecycle_op(inv, now.isoformat(sep=" "), 30)
