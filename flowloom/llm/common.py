"""Session, storage and graph helpers of the text operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_own: dict[str, str] = {}
_written: dict[str, set[str]] = {}
#: bytes of rows in one Arrow batch of a map over texts (one longer text is a batch of its own)
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.

    A local session without one, as in tests, gets a folder of its own; on a
    cluster that would be lost with its machine, so it raises there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all nodes share")
        app = spark.sparkContext.applicationId
        path = _own.setdefault(app, "") or _own.update({app: "file://" + tempfile.mkdtemp(prefix="flowloom-")}) or _own[app]
    return path.rstrip("/")


def materialize(df: DataFrame, name: str, by: str | None = None, values: int = 1) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    With ``by``, a column of at most ``values`` values, each value has files of
    its own and a filter by it reads no others; a task writes them side by side
    and needn't sort.

    The copy outlives lost executors and cuts the lineage.  ``discard`` deletes
    it; what a returned result still reads stays until ``discard_all``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writers = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(writers)
    try:
        if by:
            spark.conf.set(writers, str(values))
        df.write.parquet(path, partitionBy=by)
    finally:
        spark.conf.set(writers, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    _written.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._written)


def materialize_only(make, spark: SparkSession, name: str) -> DataFrame:
    """``materialize(make())`` that deletes every table written on the way, and lets go of the shuffles behind them."""
    app = spark.sparkContext.applicationId
    before = set(_written.get(app, ()))
    out = materialize(make(), name)
    for path in _written[app] - before - {out._written}:
        _delete(spark, path)
    release_shuffles(spark)
    return out


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished queries, which it does when their plans are collected."""
    gc.collect()
    spark._jvm.System.gc()


def discard_all(spark: SparkSession) -> None:
    """Delete every intermediate table of this application; results that were not read yet are lost."""
    for path in list(_written.get(spark.sparkContext.applicationId, ())):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _written.get(spark.sparkContext.applicationId, set()).discard(path)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only when a count proves the side small; else plain join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def join_hot(rows: DataFrame, names: DataFrame, keys: list[str], max_rows: int, spread: str, salts: int = 32) -> DataFrame:
    """Left join of ``rows`` to one row a key, where one key may hold a third of ``rows``.

    A side proven to be of ``max_rows`` at most is broadcast; a larger one is
    copied to ``salts`` parts of each key, over which ``spread`` deals the rows.
    """
    if names.limit(max_rows + 1).count() <= max_rows:
        return rows.join(F.broadcast(names), keys, "left")
    names = names.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    rows = rows.withColumn("_salt", F.expr(f"CAST(pmod(xxhash64({spread}), {salts}) AS INT)"))
    return rows.join(names, [*keys, "_salt"], "left").drop("_salt")


def list_blocks(rows: DataFrame, key: str, item: str, blocks: str) -> DataFrame:
    """``rows`` with ``pair``: every two blocks of a key, and each alone, are one bounded group; ``side`` tells the blocks apart.

    ``blocks`` is the column with a key's number of blocks.  Any two rows of a
    key meet in exactly one pair of sides: 0 holds a single block, 1 and 2 the
    lower and the higher one.
    """
    d = rows.withColumn("_b", F.expr(f"CAST(pmod(xxhash64({item}), {blocks}) AS INT)"))
    d = d.selectExpr("*", f"explode(sequence(0, CAST({blocks} AS INT) - 1)) AS _o")
    return d.selectExpr(
        *(f"`{c}`" for c in rows.columns), f"xxhash64({key}, least(_b, _o), greatest(_b, _o)) AS pair",
        "CASE WHEN _b = _o THEN 0 WHEN _b < _o THEN 1 ELSE 2 END AS side",
    )


def bound_batches(spark: SparkSession) -> None:
    """Set the session's limit of an Arrow batch to ``BATCH_BYTES``, so that long texts don't fill executors."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def with_rest(docs: DataFrame, keep: bool) -> tuple[DataFrame, list[Column]]:
    """(doc_id, text[, rest]) for a map over texts, and the column ``row`` that rebuilds the input from them, if kept.

    The other columns travel under numbers, so no name can clash.
    """
    bound_batches(docs.sparkSession)
    cols = [F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if not keep:
        return docs.select(*cols), []
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    cols.append(F.struct(F.lit(0).alias("n"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others))).alias("rest"))
    back = {c: F.col(f"rest.c{i}") for i, c in enumerate(others)}
    back |= {c: F.col(c).cast(docs.schema[c].dataType) for c in ("doc_id", "text")}
    return docs.select(*cols), [F.struct(*(back[c].alias(c) for c in docs.columns)).alias("row")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _are_stars(e: DataFrame) -> bool:
    """Whether each upper node ``u`` has one edge, to a node ``v`` that is the upper node of none."""
    nodes = e.selectExpr("u AS n", "1 AS up", "0 AS top").union(e.selectExpr("v AS n", "0 AS up", "1 AS top"))
    nodes = nodes.groupBy("n").agg(F.sum("up").alias("up"), F.max("top").alias("top"))
    return not nodes.where("up > 1 OR up = 1 AND top = 1").limit(1).count()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, comp) for every node of ``edges(a, b)``; comp is the smallest node reached.

    Alternating large-star and small-star contraction: each round is a grouped
    minimum and a join, and a component's diameter shrinks geometrically; edges
    that are stars already need no round.
    Nodes with a third of all edges are plain join keys, which adaptive
    execution splits.  Self edges and repeated edges change nothing; an empty
    input gives an empty result.
    """
    e = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc"
    )
    for _ in range(max_rounds):
        if _are_stars(e):
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(small_low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = materialize(small, "cc")
        discard(e)
        e = new
    else:
        raise RuntimeError("connected components did not converge")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return stars.union(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
