"""Shared helpers: written intermediate tables and their removal, checked broadcasts, joins that split hot keys, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swelter.sources import shared

#: A side with at most so many rows may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000
#: A key with more than 1/HOT_SHARE of all rows is hot, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 1000
#: Joins of at most so many rows are left whole: one task can hold them all.
SMALL_JOIN = 50_000

#: (name, path) of the tables written by this process, in order.
_tables: list[tuple[str, str]] = []


new_path, ship = shared.new_folder, shared.ship


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    _tables.append((name, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A place in the sequence of written tables, for remove."""
    return len(_tables)


def remove(spark: SparkSession, since: int, keep: tuple[str, ...] = ()) -> None:
    """Delete the tables written after `since`, but for the last of each name in `keep`. Only for tables that no
    DataFrame in use reads any more: what was made from them has been written itself."""
    last = {name: path for name, path in _tables[since:] if name in keep}
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name, path in _tables[since:]:
        if last.get(name) != path:
            p = hadoop(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _tables[since:] = [x for x in _tables[since:] if last.get(x[0]) == x[1]]


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores before those that `taken` has in some case."""
    have, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def maybe_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows, else df as it is (the join then shuffles)."""
    return F.broadcast(df) if len(df.select(F.lit(1)).head(most + 1)) <= most else df


def join_split_hot(rows: DataFrame, groups: DataFrame, keys: list[str], size_col: str, total: int) -> DataFrame:
    """Inner join of rows with one row a group. Groups holding over 1/HOT_SHARE of `total` rows are
    joined by broadcast, of which there are fewer than HOT_SHARE; the others by a shuffle on the keys,
    where no key can then hold more than that share."""
    if total <= SMALL_JOIN:
        return rows.join(groups, keys)
    is_hot = F.col(size_col) * HOT_SHARE > F.lit(total)
    hot = groups.where(is_hot)
    if not hot.head(1):
        return rows.join(groups, keys)
    over_hot = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups.where(~is_hot), keys)
    return over_hot.unionByName(rest)
