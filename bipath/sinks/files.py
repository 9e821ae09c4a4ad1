"""Writers; each is one distributed job, with a commit at its end. ``publish`` adds several frames as one named batch."""

import re

from pyspark.sql import Column, DataFrame


def append_edges(edges: DataFrame, path: str) -> None:
    """Append edges or structures to a parquet collection."""
    edges.write.mode("append").parquet(path)


def publish(frames: dict[str, DataFrame], batch: str) -> bool:
    """Add each frame to the parquet collection at its path, under the name ``batch``, once; False if that was done before.

    All frames are written to hidden folders of their collections first, the dear part that may fail. Then their files are moved in
    under the batch's name, and a marker in every collection ends it. A call that broke off anywhere leaves no marker: the next one with
    the same name replaces what it had moved. ``batch`` may hold letters, digits and ``-``.
    """
    if not re.fullmatch(r"[A-Za-z0-9-]+", batch):
        raise ValueError(f"no name of a batch: {batch!r}")
    spark = next(iter(frames.values())).sparkSession
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    targets = {path: (path_of(path).getFileSystem(conf), path_of(path), path_of(path, f"_published-{batch}")) for path in frames}
    if all(files.exists(marker) for files, _, marker in targets.values()):
        return False
    for path, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{path}/_staged-{batch}")
    for path, (files, folder, _) in targets.items():
        for old in files.globStatus(path_of(folder, f"batch-{batch}_*")) or []:
            files.delete(old.getPath(), False)
        staged = path_of(folder, f"_staged-{batch}")
        for part in files.globStatus(path_of(staged, "part-*")) or []:
            name = part.getPath().getName()
            if not files.rename(part.getPath(), path_of(folder, f"batch-{batch}_{name}")):
                raise OSError(f"{name} could not be moved into {path}")
        files.delete(staged, True)
    for files, _, marker in targets.values():
        files.create(marker, True).close()
    return True


def insert_into_table(edges: DataFrame, table: str, **options: str) -> None:
    """Append to a catalog table, made on first use (pass ``path=`` for an external one).

    Where a JDBC driver is on the class path, ``edges.write.format("jdbc")`` takes the same frame.
    """
    edges.write.mode("append").options(**options).saveAsTable(table)


def overwrite_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_lines(df: DataFrame, item: Column, path: str) -> None:
    """One item per line, in text form."""
    df.select(item.cast("string").alias("value")).write.mode("overwrite").text(path)
