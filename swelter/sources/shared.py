"""Tables and files in the folder that all executors share, and joins that broadcast only what is known to be small."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side with at most so many rows may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000
#: A key with more than 1/HOT_SHARE of all rows is hot, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 1000

_own: dict[str, str] = {}
#: Folders that this process has named, in order.
_folders: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir; in local mode without that setting, under a folder of this process."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if "dir" not in _own:
            _own["dir"] = tempfile.mkdtemp(prefix="swelter-")
            atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
        top = f"file://{_own['dir']}"
    _folders.append(f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _folders[-1]


def mark() -> int:
    """A place in the sequence of folders, for remove."""
    return len(_folders)


def remove(spark: SparkSession, since: int = 0) -> None:
    """Delete the folders named after `since`. Only for those that no DataFrame in use reads any more: what was made from them has been
    written elsewhere or collected."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in _folders[since:]:
        p = hadoop(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    del _folders[since:]


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """df as a Parquet table, for what several branches of a plan read. options: the writer's."""
    path = new_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has few rows, else df as it is (the join then shuffles)."""
    most = BROADCAST_ROWS if most is None else most
    return F.broadcast(df) if len(df.select(F.lit(1)).head(most + 1)) <= most else df


def join_split_hot(rows: DataFrame, groups: DataFrame, keys: list[str], size_col: str, total: int) -> DataFrame:
    """Inner join of rows with one row a key, where size_col says how many rows the key has. Keys with over 1/HOT_SHARE of `total` rows
    are joined by broadcast, of which there are fewer than HOT_SHARE, so their rows stay where they are; the others by a shuffle."""
    is_hot = F.col(size_col) * HOT_SHARE > F.lit(total)
    hot = groups.where(is_hot)
    if not hot.head(1):
        return rows.join(groups, keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups.where(~is_hot), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application: for tasks that call its functions."""
    sc = spark.sparkContext
    if _own.get("shipped") == sc.applicationId:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="swelter-py-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/{os.path.basename(package)}_tasks.zip", "w") as z:
        for d, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), os.path.dirname(package)))
    sc.addPyFile(f"{folder}/{os.path.basename(package)}_tasks.zip")
    _own["shipped"] = sc.applicationId
