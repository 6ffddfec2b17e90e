"""What the operators of this subpackage share: scratch tables, shipping, samples."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

#: The white space that the contracts name: space, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


_HELD: dict[str, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """A worker's one large object, such as the word cache of an encoder. Making another lets go of the last, so that the stages of a
    pipeline, which share workers, don't add up."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each SparkContext."""
    sc = spark.sparkContext
    if getattr(sc, "_riskloom_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    at = os.path.join(tempfile.mkdtemp(), "riskloom.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(at)
    sc._riskloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    now = sc._jsc.sc().getCheckpointDir()
    if now.isEmpty():
        if not named:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="riskloom-")
        sc.setCheckpointDir(named)
        now = sc._jsc.sc().getCheckpointDir()
    return named or now.get()


_FOLDERS: list[str] = []


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{_FOLDERS[-1] if _FOLDERS else shared_dir(spark).rstrip('/') + '/riskloom'}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def scratch_folder(spark: SparkSession, tag: str) -> Iterator[None]:
    """What is stored within goes at the end, also where it fails. Results must be written elsewhere by then."""
    at = scratch_path(spark, tag)
    _FOLDERS.append(at)
    try:
        yield
    finally:
        _FOLDERS.pop()
        remove(spark, at)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df, written once to the shared folder and read back: its lineage ends there, so lost executors don't cost its work."""
    return _kept(df, scratch_path(df.sparkSession, tag))


def _kept(df: DataFrame, at: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _place(spark: SparkSession, at: str):
    """A path and its file system, wherever Spark has it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, at: str) -> None:
    path, files = _place(spark, at)
    files.delete(path, True)


def make_folder(spark: SparkSession, at: str) -> None:
    path, files = _place(spark, at)
    files.mkdirs(path)


class Scratch:
    """Stored tables that are needed only until a result is stored, in one folder that goes then."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.at, self.n = spark, scratch_path(spark, tag), 0

    def stored(self, df: DataFrame, tag: str) -> DataFrame:
        self.n += 1
        return _kept(df, f"{self.at}/{self.n:03d}-{tag}")

    def drop(self) -> None:
        remove(self.spark, self.at)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(name: str = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(n))


def shuffled_order(key: str) -> Column:
    """A fixed order that has nothing to do with that of the keys."""
    return F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")))


def early(key: str, total: Column | int, most: int) -> Column:
    """Whether a row is among the first of `total` in that order, so that about four times `most` rows are: a task then hands on few rows
    that the exact choice after it leaves out, however many tasks there are."""
    place = shuffled_order(key).cast("double") / F.lit(2.0**64) + F.lit(0.5)
    return place * total < F.lit(4 * most + 20)


def first_ids(rows: DataFrame, most: int) -> DataFrame:
    """The first `most` doc_ids of rows in shuffled order, and the other columns."""
    return rows.where(early("doc_id", rows.count(), most)).orderBy(shuffled_order("doc_id"), "doc_id").limit(most)


#: Training texts: longer ones are represented by so many evenly spread passages of so many characters.
LONG, PASSAGES = 1 << 16, 16


def passages(text: Column) -> Column:
    """A text to learn from, of bounded size: texts above LONG characters give PASSAGES passages that make up LONG characters."""
    size, n = LONG // PASSAGES, F.length(text)
    starts = [(n - F.lit(size)) * k / (PASSAGES - 1) for k in range(PASSAGES)]
    return F.when(n <= LONG, text).otherwise(F.concat_ws("\n", *[F.substring(text, s.cast("int") + F.lit(1), F.lit(size)) for s in starts]))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, bounds: dict[int, int]) -> DataFrame:
    """(doc_id, text, label) of at most bounds[v] rows with label v, none from the held-out fold.

    The rows are picked by a hash of doc_id, so that the pick is the same in each run. Only their ids are broadcast: at most
    sum(bounds.values()) of them. Of rows that share a doc_id the least text counts, of labels that do the largest.
    """
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    picks = None
    for value, bound in bounds.items():
        part = first_ids(known.where(F.col("label") == value), bound)
        picks = part if picks is None else picks.unionByName(part)
    met = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(picks), "doc_id")
    return met.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def map_batches(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str, size: int = 1024) -> DataFrame:
    """df by an arrow-batched function. make() is called once in each task and gives a function of columns (as lists) to columns."""
    struct = _struct(schema)
    names = struct.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        to, f = to_arrow_schema(struct), make()
        for whole in batches:
            for i in range(0, whole.num_rows, size):
                b = whole.slice(i, size)
                out = f({n: b.column(k).to_pylist() for k, n in enumerate(b.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[n], to.field(n).type) for n in names], schema=to)

    return df.mapInArrow(run, schema)


def _struct(schema: str) -> StructType:
    return StructType.fromDDL(schema)


def _comparable(kind: DataType) -> bool:
    """Whether Spark can hash values of this type."""
    if isinstance(kind, StructType):
        return all(_comparable(f.dataType) for f in kind)
    if isinstance(kind, ArrayType):
        return _comparable(kind.elementType)
    return not isinstance(kind, MapType | VariantType)


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns. Those that hold a map or a variant are hashed as text."""
    said = lambda f: F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, VariantType) else F.col(f"`{f.name}`").cast("string")
    return F.xxhash64(*[F.col(f"`{f.name}`") if _comparable(f.dataType) else said(f) for f in df.schema])


def keep_rows(docs: DataFrame, keys: Column, drop: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """Rows of docs but for those in drop (node, doc_id); of the rows of a node in repeated (node), only the first.

    keys makes the node of a row, a digest or hash (never null). Texts move only if drop is too large to broadcast (Spark checks its size).
    Columns of docs may have any names and types: the three that this needs stand beside a struct of them.
    """
    node, row, key, mark = "__rl_node", "__rl_row", "__rl_id", "__rl_mark"
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), keys.alias(node), F.col("doc_id").alias(key), row_hash(docs).alias(mark))
    gone = drop.select(F.col("node").alias("__rl_gone"), F.col("doc_id").alias("__rl_gone_id"))
    left = wide.join(gone, (F.col(node) == F.col("__rl_gone")) & F.col(key).eqNullSafe(F.col("__rl_gone_id")), "left_anti")
    if repeated is not None and not repeated.isEmpty():
        again = repeated.select(F.col("node").alias("__rl_again"))
        once = left.join(again, F.col(node) == F.col("__rl_again"), "left_anti").select(row)
        twice = left.join(again, F.col(node) == F.col("__rl_again"), "left_semi")
        left = once.unionByName(twice.groupBy(node).agg(F.min_by(row, mark).alias(row)).select(row))
    return left.select(f"{row}.*")


#: A key is hot with more than total / HOT_PARTS rows, so fewer than HOT_PARTS keys of a table can be hot.
HOT_PARTS = 1000


def join_hot(rows: DataFrame, values: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows joined to values (one row for each key, with how many rows have it in `count`).

    Values of hot keys are broadcast: fewer than HOT_PARTS rows, at any size. The other keys' rows meet in a sort-merge join, in
    which no task gets more than a thousandth of all rows for one key. Whether there are hot keys is asked first, which keeps plans small.
    """
    hot = F.col(count) * HOT_PARTS > total
    return _join(rows, values, key, values.where(hot) if not values.where(hot).isEmpty() else None, values.where(~hot))


def join_spread(rows: DataFrame, values: DataFrame, key: str, like: DataFrame | None = None) -> DataFrame:
    """The same for values that don't say how many rows have a key, and have one row for each key of rows; fewer than HOT_PARTS keys reach the driver.

    Keys are counted in `like`, a stored table with as many of each, if rows are not stored.
    """
    like = rows if like is None else like
    counts = like.groupBy(key).count().where(F.col("count") * HOT_PARTS > like.count())
    hot = [r[key] for r in counts.select(key).collect()]
    return _join(rows, values, key, values.where(F.col(key).isin(hot)) if hot else None, values)


def _join(rows: DataFrame, values: DataFrame, key: str, few: DataFrame | None, many: DataFrame) -> DataFrame:
    """few: the values of hot keys; many: those of the others at least."""
    names = [c for c in values.columns if c != key]
    if few is None:
        return rows.join(values.hint("merge"), key).select(*rows.columns, *names)
    tagged = rows.join(F.broadcast(few.select(key, F.struct(*names).alias("__rl_few"))), key, "left")
    cold = tagged.where(F.col("__rl_few").isNull()).drop("__rl_few").join(many.hint("merge"), key).select(*rows.columns, *names)
    return tagged.where(F.col("__rl_few").isNotNull()).select(*rows.columns, "__rl_few.*").unionByName(cold)


def sieve(rows: DataFrame, key: str, wanted: DataFrame, want: str) -> DataFrame:
    """rows whose 64-bit hash `key` may be among the wanted ones: a Bloom filter of 256 bitmaps of 32,768 bits, 1 MB whatever the input.

    So a join need not move the other rows. Where the bitmaps fill up they let more rows pass than they must, never fewer.
    """
    place = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(1 << 23))
    bits = wanted.select(place(want).alias("__rl_place")).groupBy(F.shiftright("__rl_place", 15).alias("__rl_part"))
    bits = bits.agg(F.bitmap_construct_agg(F.col("__rl_place").bitwiseAND(F.lit(32767))).alias("__rl_bits"))
    at = F.col("__rl_place").bitwiseAND(F.lit(32767)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("__rl_bits"), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    # 1, 2, 4 ... 128 is the bit of a place in its byte.
    bit = F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), at.bitwiseAND(F.lit(7)) + 1)
    met = rows.withColumn("__rl_place", place(key)).withColumn("__rl_part", F.shiftright("__rl_place", 15)).join(F.broadcast(bits), "__rl_part")
    return met.where(byte.bitwiseAND(bit) > 0).select(*rows.columns)
