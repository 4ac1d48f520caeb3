"""Shared folder for cut lineage, and small Column helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII separators (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"


@lru_cache(1)
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='tessera-')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, local mode takes a folder of its own (as
    in tests); a cluster has none, and that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own_dir()
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and a lost executor costs
    at most the tasks that had not written. The table stays until the folder is emptied after the job."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own beside those of a caller's table, whatever it calls its own."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda variable holds it, so nothing re-evaluates it per element."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def words_of(text: Column) -> Column:
    """Array of words; empty for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def md5_hex(*parts: Column) -> Column:
    """Keyed order that every SQL engine can repeat."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches held to 1,000 rows and 8 MB: texts are long, and a worker, its executor's
    buffers and the copy in between each hold a batch."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return df


@contextmanager
def small_batches(spark: SparkSession):
    """The same for what runs inside; then the session has its settings back."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
    before = {k: spark.conf.get(k, None) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def whole_groups(keys: list[str], work):
    """A function of Arrow batches that hands work(table, key matrix) whole groups of rows with equal long keys."""

    def run(batches):
        key = lambda t: np.stack([t.column(c).to_numpy() for c in keys])
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
            k = key(t)
            if not t.num_rows:
                continue
            whole = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0))
            stop = int(whole[-1]) + 1 if len(whole) else 0
            if stop:
                yield from work(t.slice(0, stop), k[:, :stop])
            rest = t.slice(stop)
        if rest is not None and rest.num_rows:
            yield from work(rest, key(rest))

    return run
