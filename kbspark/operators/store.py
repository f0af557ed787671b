"""Vector collections and their upsert policies (K3-K7, A1).

A collection on disk is a folder of plain Parquet batches, ``batch=<number>``;
reading keeps the newest row of every key (see :func:`upsert_into`).
Upsert policies:

* ``replace`` (K4): insert or replace by id; the newest version wins.
* ``ignore``  (K5): add only ids not yet stored; inside one batch the first wins.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTOR_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("embedding", T.ArrayType(T.FloatType()), True),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType()), True),
    T.StructField("document", T.StringType(), True),
    T.StructField("version", T.LongType(), True),
])


def upsert_replace(old: DataFrame, new: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """K4: union of stored and incoming rows, one row per id, highest ``version`` wins.

    Within one version the incoming row wins over the stored one, then the greatest by the numeric columns.  Winners are
    found without the payload (a partial aggregate); the other columns come back by one join, so a reader that asks for
    some of them neither reads nor moves the rest (vectors, documents).
    """
    cols = [c for c in old.columns]
    small = [f.name for f in old.schema.fields if f.name not in (key, version) and isinstance(f.dataType, T.NumericType)]
    both = (old.select(*cols, F.lit(0).alias("_src"))
            .unionByName(new.select(*cols, F.lit(1).alias("_src"))))
    return _newest(both, key, [version, "_src", *small]).dropDuplicates([key]).select(cols)


def _newest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows of every key that are greatest by ``order``, found on these columns and joined back."""
    win = (rows.groupBy(key).agg(F.max(F.struct(*order)).alias("_o"))
           .select(F.col(key).alias("_key"), *[F.col(f"_o.{c}").alias(f"_{c}") for c in order]))
    same = rows[key].eqNullSafe(win["_key"])
    for c in order:
        same &= rows[c].eqNullSafe(win[f"_{c}"])
    return rows.join(win, same).select(*rows.columns)


def dedup_batch_first(new: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """K5 step 1: one row per id inside the incoming batch, the first (smallest ``order``) wins."""
    rest = [c for c in new.columns if c != key]
    if order is None:
        return new.dropDuplicates([key])
    best = F.min_by(F.struct(*rest), F.col(order))
    return new.groupBy(key).agg(best.alias("_b")).select(key, "_b.*").select(new.columns)


def upsert_ignore(old: DataFrame, new: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """K5: stored rows unchanged; incoming ids not yet stored are appended."""
    fresh = dedup_batch_first(new, key, order).join(old.select(key), key, "left_anti")
    return old.unionByName(fresh.select(old.columns))


def describe(collection: DataFrame, key: str = "id", vec: str = "embedding") -> DataFrame:
    """K7 / A1: size and vector-shape summary of a collection."""
    return collection.agg(F.count("*").alias("records"),
                          F.countDistinct(key).alias("distinct_ids"),
                          F.min(F.size(vec)).alias("min_dim"),
                          F.max(F.size(vec)).alias("max_dim"))


def count_records(collection: DataFrame) -> DataFrame:
    """A1: number of records in a collection."""
    return collection.agg(F.count("*").alias("records"))


# --- collections on disk ------------------------------------------------------------------------
#
# ``<path>/batch=<number>`` holds one batch as plain Parquet.  Writing a batch again overwrites its own folder only, so a
# replay or a write that broke off and is repeated changes nothing else.  Batch 0 is the empty table of the creation; its
# schema carries the vector size.  One writer at a time numbers the batches (a stream takes its epochs).

BATCH = "batch"


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def next_batch(spark: SparkSession, path: str) -> int:
    """The number after the last batch of the collection."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return 1
    names = [st.getPath().getName() for st in fs.listStatus(p)]
    return 1 + max((int(n.partition("=")[2]) for n in names if n.startswith(f"{BATCH}=")), default=0)


def declared_dim(spark: SparkSession, path: str, vec: str = "embedding") -> int | None:
    """The vector size that the collection was created with, if any."""
    schema = spark.read.parquet(f"{path}/{BATCH}=0").schema
    return schema[vec].metadata.get("dim") if vec in schema.names else None


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows of all batches, with their batch number."""
    full = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    return spark.read.schema(full).parquet(path)


def get_or_create(spark: SparkSession, path: str, schema: T.StructType = VECTOR_SCHEMA, key: str | None = None,
                  dim: int | None = None, vec: str = "embedding") -> DataFrame:
    """K6: the collection at ``path``; created empty on first use, for vectors of size ``dim`` (None: any).

    Nothing that exists is overwritten.  ``key`` is the schema's first column unless named.
    """
    if not _exists(spark, f"{path}/{BATCH}=0"):
        fields = [T.StructField(f.name, f.dataType, True, {"dim": dim}) if f.name == vec and dim is not None else f
                  for f in schema.fields]
        spark.createDataFrame([], T.StructType(fields)).write.mode("overwrite").parquet(f"{path}/{BATCH}=0")
    found = declared_dim(spark, path, vec)
    if dim is not None and found is not None and found != dim:
        raise ValueError(f"{path} holds vectors of size {found}, not {dim}")
    order = [c for c in ("version", BATCH) if c in schema.names or c == BATCH]
    return _newest(_stored(spark, path, schema), key or schema.fieldNames()[0], order).select(*schema.fieldNames())


def rejects(spark: SparkSession, path: str, schema: T.StructType = VECTOR_SCHEMA) -> DataFrame:
    """V4: rows that upserts did not take, their vector not being of the collection's size."""
    if not _exists(spark, f"{path}/_rejects"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/_rejects").parquet(f"{path}/_rejects/{BATCH}=*")


def upsert_into(spark: SparkSession, path: str, batch: DataFrame, policy: str = "replace", key: str | None = None,
                schema: T.StructType = VECTOR_SCHEMA, dim: int | None = None, vec: str = "embedding",
                number: int | None = None) -> DataFrame:
    """K4/K5 on disk: add ``batch`` to the collection at ``path`` by ``key``.

    ``policy`` is ``replace`` (newest ``version`` wins, the later batch wins ties, the last row inside a batch) or
    ``ignore`` (stored rows kept, new keys added; the first row per key inside a batch, by its place in the batch).
    Only the batch is written, under its ``number`` (the next one unless named); ``ignore`` reads the keys of earlier
    batches, ``replace`` nothing.  In a collection of a declared size, other vectors go to :func:`rejects`.
    """
    key = key or schema.fieldNames()[0]
    get_or_create(spark, path, schema, key, dim, vec)
    dim = declared_dim(spark, path, vec)
    number = next_batch(spark, path) if number is None else number
    rows = batch.select(*schema.fieldNames())
    if dim is not None and vec in rows.columns:
        fits = F.coalesce(F.size(vec) == dim, F.lit(False))
        rows = rows.checkpoint()              # read twice, and the batch may be costly to make (an embedder)
        rows.filter(~fits).write.mode("overwrite").parquet(f"{path}/_rejects/{BATCH}={number}")
        rows = rows.filter(fits)
    placed = rows.withColumn("_at", F.monotonically_increasing_id())
    if policy == "replace":
        order = F.struct(*[c for c in ("version", "_at") if c in placed.columns])
        rest = [c for c in placed.columns if c != key]
        new = placed.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_b")).select(key, "_b.*")
    else:
        earlier = _stored(spark, path, schema).filter(F.col(BATCH) < number).select(key).distinct()
        new = dedup_batch_first(placed, key, "_at").join(earlier, key, "left_anti")
    new.select(*schema.fieldNames()).write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")
    return get_or_create(spark, path, schema, key)


def list_collections(spark: SparkSession, parent: str) -> list[str]:
    """K7: names of the collections under ``parent``."""
    p, fs = _path(spark, parent)
    if not fs.exists(p):
        return []
    return sorted(st.getPath().getName() for st in fs.listStatus(p)
                  if st.isDirectory() and _exists(spark, f"{st.getPath().toString()}/{BATCH}=0"))


def append_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """K1/K2/K8: append rows to a table folder (reruns append again, like the original's files)."""
    df.write.mode("append").format(fmt).save(path)


def write_kb(kb: DataFrame, path: str, file_bytes: int = 256 << 20) -> None:
    """K3: write the knowledge base partitioned by host; a rerun replaces only the hosts it holds.

    The number of writers follows the bytes of the texts, and rows are range-partitioned by host and a hash of the path,
    so a host of any size is written by its share of the writers, in files of about ``file_bytes`` of text, and a small
    host by one or two.
    """
    total = kb.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    writers = max(1, math.ceil(total / file_bytes))
    (kb.repartitionByRange(writers, "host", F.xxhash64("path")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("host").parquet(path))
