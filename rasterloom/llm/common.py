"""Helpers that the text operators share."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from rasterloom.functions.workers import bounded_batches, reach_workers

#: 64-bit words of the bitmaps that thin out rows before a join; they let through too much, never too little.
BITMAP_WORDS = 1 << 15
#: A key of more rows than this may be dealt to SALTS tasks; at most HOT_KEYS keys are.
HOT_ROWS, HOT_KEYS, SALTS = 2_000, 10_000, 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, columns: list[str], schema: str, make) -> DataFrame:
    """Apply a per-batch function to some columns of a DataFrame.

    ``make()`` runs once in each task and returns a function from a dict of lists to a dict of
    lists; the caches and models it holds live as long as the task. Columns that are not named
    are never read, so extra columns cannot clash with the output.
    """
    bounded_batches(df.sparkSession)
    reach_workers(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        f = make()
        for batch in batches:
            out = f({c: batch.column(i).to_pylist() for i, c in enumerate(columns)})
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


def map_tasks(df: DataFrame, columns: list[str], schema: str, make) -> DataFrame:
    """Like ``map_rows`` for functions that keep something over batches: ``make()`` gives a pair.

    The first takes a dict of lists, the second nothing, when a task's rows are over; both return
    a dict of lists, or None for no rows.
    """
    bounded_batches(df.sparkSession)
    reach_workers(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        add, end = make()
        for batch in batches:
            out = add({c: batch.column(i).to_pylist() for i, c in enumerate(columns)})
            if out is not None:
                yield pa.RecordBatch.from_pydict(out, schema=arrow)
        out = end()
        if out is not None:
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


def filter_rows(df: DataFrame, column: str, make) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns and without a shuffle.

    ``make()`` runs once in each task and returns a function from a list of the column's values
    to a list of booleans.
    """
    bounded_batches(df.sparkSession)
    reach_workers(df.sparkSession)
    at = df.columns.index(column)

    def run(batches):
        f = make()
        for batch in batches:
            yield batch.filter(pa.array(f(batch.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Where it is unset, a local master gets a folder of the session's own; on a cluster a
    machine's own folder would be lost to the others, so that is an error.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not shared and sc.getCheckpointDir() is None and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared or f"/tmp/rasterloom-checkpoints/{uuid.uuid4().hex}")
    return shared or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint: what follows no longer depends on the executors that made these rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """The same as ``cut``, by a compressed table in the shared folder that is read again.

    Its path is added to ``kept``, for a caller that removes tables which nothing needs any more.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if kept is not None:
        kept.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables, wherever they are stored."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def crc_mod(column: str, n: int):
    """crc32 of an integer id written as text, modulo n."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def hash_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest hash of the key: the same rows however the table is laid out.

    Every partition offers its ``most`` smallest rows to the driver. Of a larger table only hashes
    below a bound that about 2 ``most`` rows pass are offered, so that their number does not grow
    with the partitions; where few keys hold most rows, fewer may pass.
    """
    share = 2 * most / max(1, df.count())
    h = F.xxhash64(key)
    if share < 1:
        df = df.where(h <= F.lit(int((share * 2 - 1) * (1 << 63))))
    return df.orderBy(h, F.col(key)).limit(most)


def frequent(counts: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """The keys that hold more than HOT_ROWS rows and more than a HOT_KEYS-th of all.

    By the second bound there are fewer than HOT_KEYS of them, so they may be broadcast at any size of the input.
    """
    return counts.where(F.col(n) > max(HOT_ROWS, total // HOT_KEYS)).select(*keys)


def join_spread(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has a row for each key; the rows of the ``hot`` keys are dealt to SALTS tasks.

    Keys of ``right`` are not null.
    """
    if hot.limit(1).count() == 0:
        return left.join(right, keys, how)
    marked = left.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), keys, "left")
    at = F.when(F.col("__hot"), F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(SALTS))).otherwise(0)
    few = right.join(F.broadcast(hot), keys, "left_semi").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rest = right.join(F.broadcast(hot), keys, "left_anti").withColumn("__salt", F.lit(0))
    salted = rest.unionByName(few).withColumn("__salt", F.col("__salt").cast("long"))
    return marked.withColumn("__salt", at.cast("long")).drop("__hot").join(salted, [*keys, "__salt"], how).drop("__salt")


def numbers(values, kind: str) -> Column:
    """A constant array; it is parsed once, when the plan is optimised."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def bitmap(ids: DataFrame, *columns: str) -> Column:
    """A test that is true for every row whose columns occur in ``ids``, and for few others while ids are few."""
    h = F.xxhash64(*columns)
    at = F.shiftright(h, 6).bitwiseAND(F.lit(BITMAP_WORDS - 1))
    bit = F.expr("shiftleft(1L, cast(h & 63 AS INT))")
    found = ids.select(h.alias("h"), at.alias("at")).groupBy("at").agg(F.bit_or(bit).alias("bits")).collect()
    words = [0] * BITMAP_WORDS
    for r in found:
        words[r["at"]] = r["bits"]
    word = F.element_at(numbers(words, "bigint"), at.cast("int") + 1)
    return F.getbit(word, h.bitwiseAND(F.lit(63)).cast("int")) == 1
