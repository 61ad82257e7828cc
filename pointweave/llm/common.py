"""What the operators of this subpackage share: the shared work folder, table cuts and file names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as a regular-expression class body and as plain characters.
WHITE_CLASS = "\\x20\\x09-\\x0D"
WHITE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; the folder is installed alike on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def work_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master, whose executors live in the driver, may go without the setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pointweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


class Cut:
    """A table written to the shared folder and read again, so that lost executors cost no recomputation."""

    def __init__(self, df: DataFrame, tag: str, **options: str):
        spark = df.sparkSession
        self.path = f"{work_folder(spark)}/{tag}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._hadoop = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        df.write.options(**options).parquet(self.path)
        self._fs.deleteOnExit(self._hadoop)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Removes the files; only for tables that no pending plan reads."""
        self._fs.delete(self._hadoop, True)


def materialise(df: DataFrame, tag: str, **options: str) -> DataFrame:
    return Cut(df, tag, **options).df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def field(batch, name: str):
    """The column of an Arrow batch by name."""
    return batch.column(batch.schema.get_field_index(name))


def slices(batch, rows: int = 256):
    """Short runs of a batch, so that only a few long texts are Python objects at once."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
