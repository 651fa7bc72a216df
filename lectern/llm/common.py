"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space is U+0020 and U+0009 to U+000D; a word is a longest run of anything else.
WORD = r"[^\x20\x09-\x0D]+"

#: A table with at most this many rows of bounded width may be broadcast.
BROADCAST_ROWS = 20_000

#: Copies of the small side in a salted join, used beyond BROADCAST_ROWS.
SALTS = 64

#: A key is hot if it has more than one in so many rows.
HOT = 1000


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder, its lineage cut.

    The folder is the session's spark.checkpoint.dir; only where that is unset in a local session
    (as in tests) a temporary one is made.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only a local session may go without, and gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read again: for wide rows, which a checkpoint wouldn't compress."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def lookup(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, n_small: int | None = None) -> DataFrame:
    """Left join of `big` with the per-key table `small`, nulls in keys matching nulls.

    `small` is broadcast only if its counted size allows that. Otherwise both sides are salted,
    so that a key with a third of all rows is still shared by SALTS tasks.
    `spread` is any well distributed integer of the big side.
    """
    named = small.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    on = [big[k].eqNullSafe(named[f"__k_{k}"]) for k in keys]
    if (small.count() if n_small is None else n_small) <= BROADCAST_ROWS:
        joined = big.join(F.broadcast(named), on, "left")
        return joined.drop(*[f"__k_{k}" for k in keys])
    salted = named.withColumn("__s_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    wide = big.withColumn("__b_salt", F.pmod(spread, F.lit(SALTS)).cast("int"))
    on = [wide[k].eqNullSafe(salted[f"__k_{k}"]) for k in keys] + [wide["__b_salt"] == salted["__s_salt"]]
    return wide.join(salted, on, "left").drop(*[f"__k_{k}" for k in keys], "__s_salt", "__b_salt")


def counted_join(big: DataFrame, small: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """Inner join of `big` with `small`, which has a row per key and, as `n`, how many of the `total` rows of `big` have it. No key is null.

    Keys with a thousandth of the rows or more are fewer than HOT and broadcast, so rows of a hot key stay where they are; all others are shuffled."""
    named = small.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    hot = F.col(n) * HOT > total
    on = [big[k] == named[f"__k_{k}"] for k in keys]
    few = F.broadcast(named.filter(hot))
    drop = [f"__k_{k}" for k in keys]
    return big.join(few, on).drop(*drop).unionByName(big.join(few.select(*drop), on, "left_anti").join(named.filter(~hot), on).drop(*drop))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def packed(docs: DataFrame, **own: Column) -> DataFrame:
    """`docs` as one column, row, beside columns of one's own, so that names can't clash; `row.*` gives `docs` again."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *[c.alias(name) for name, c in own.items()])
