"""Small Spark helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which outlives executors.

    Only on one machine (master local or local[n]) a temporary folder is taken where none is named."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or (context._jsc.sc().getCheckpointDir().get() if context._jsc.sc().getCheckpointDir().isDefined() else None)
    if not named:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors and the driver share")
        named = tempfile.mkdtemp(prefix="quire-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


class Shelf:
    """Tables of one job in the shared folder; written and read again, they cut the lineage."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/quire-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._on_shelf = self  # keeps the id taken as long as the table is known
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Deletes tables that nothing reads any more."""
        for df in tables:
            path = self.paths.pop(id(df), None)
            if path:
                jvm = self.spark.sparkContext._jvm
                place = jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def durable(df: DataFrame) -> DataFrame:
    """A copy in the shared folder."""
    return Shelf(df.sparkSession).put(df)


def join_uneven(rows: DataFrame, side: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with one row of `side` for each key, where weight counts the rows that have the key.

    Fewer than 1000 keys can have more than a thousandth of `total` rows each; their rows of `side` are
    broadcast, so the rows of a hot key stay where they are.  All other keys are shuffled."""
    hot = F.col(weight) > total / 1000
    often = F.broadcast(side.where(hot))
    return rows.join(often, key).unionByName(rows.join(often.select(key), key, "left_anti").join(side.where(~hot), key, how))


def held_out(key: str, parts: int, part: int) -> F.Column:
    """crc32 of the key as text, modulo parts, equals part; a null key is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts == part, F.lit(False))


def thinned(df: DataFrame, key: str, rows: int) -> DataFrame:
    """A share of the rows, by a hash of the key, that holds about twice `rows`; all of a small table.

    It is cut out where rows are read, so a task that orders the rest gets a bounded number however
    large the table is."""
    n, whole = df.count(), 1 << 40
    return df.where(F.pmod(F.xxhash64(key), F.lit(whole)) < int(2 * rows / n * whole)) if n > 2 * rows else df


def first_by_hash(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most `rows` rows in the order of a hash of the key, for fitting."""
    return thinned(df, key, rows).orderBy(F.xxhash64(key), key).limit(rows)


def bounded_sample(df: DataFrame, key: str, rows: int, max_chars: int, text: str = "text") -> DataFrame:
    """At most `rows` rows for fitting, each with at most max_chars characters: of a longer text a window, whose place is dealt by a
    hash of the key, so no text is passed over for its length."""
    start = 1 + F.pmod(F.xxhash64(key, F.lit("window")), F.greatest(F.lit(1), F.length(text) - max_chars + 1)).cast("int")
    cut = F.when(F.length(text) > max_chars, F.substring(F.col(text), start, F.lit(max_chars))).otherwise(F.col(text))
    return thinned(df.where(F.col(text).isNotNull()), key, rows).withColumn(text, cut).orderBy(F.xxhash64(key), key).limit(rows)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, rows: int, max_chars: int, parts: int, part: int) -> tuple[list[str], list[int]]:
    """Texts and labels (0 or 1) for fitting, at most `rows` of each label and none that is held out.

    Ids are taken in the order of a hash of the key, and of each one row; longer texts than max_chars are passed
    over before ids are taken, so others take their place."""
    open_ = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(key, parts, part)).groupBy(key).agg(F.max(label).alias("y"))
    short = docs.where((F.length(text) <= max_chars) & F.col(key).isNotNull()).select(key)
    open_ = open_.join(short, key, "left_semi")
    few = [first_by_hash(open_.where(f"y = {y}"), key, rows) for y in (0, 1)]
    got = docs.select(key, text).where(F.length(text) <= max_chars).join(F.broadcast(few[0].union(few[1])), key).groupBy(key, "y").agg(F.max(text).alias("text")).select("text", "y").toArrow()
    return got.column("text").to_pylist(), got.column("y").to_pylist()
