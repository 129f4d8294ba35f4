"""Shared folder for written tables, stream checkpoints and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``, else the session's warehouse.

    A warehouse on one machine's own disk is refused on a cluster: executors would each write to their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    root = spark.conf.get("spark.sql.warehouse.dir")
    master = spark.conf.get("spark.master", "")
    one_machine = root.startswith("file:") or "://" not in root
    if one_machine and not (master == "local" or master.startswith("local[")):
        raise ValueError(f"{root} is a folder of one machine; set spark.checkpoint.dir to a shared folder")
    return root


def workspace(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
