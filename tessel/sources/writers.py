"""Sinks: metadata, manifests, paths, failures and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_metadata(df: DataFrame, path: str) -> None:
    """One JSON object a row, nulls included."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_manifest(df: DataFrame, path: str) -> None:
    """A one-row table with the time of writing."""
    df.withColumn("created_at_unix", F.unix_timestamp()).coalesce(1).write.mode("overwrite").json(path)


def referenced_paths(df: DataFrame, singles: Sequence[str], saved: str | None = None) -> DataFrame:
    """Each path that a row names, once."""
    listed = F.array(*(F.col(c) for c in singles))
    every = F.concat(listed, F.coalesce(F.map_values(saved), F.array().cast("array<string>"))) if saved else listed
    return df.select(F.explode(every).alias("path")).where("path <> ''").distinct()


def to_copy(wanted: DataFrame, there: DataFrame) -> DataFrame:
    """The (path, length) rows that a destination lacks or has in another size."""
    return wanted.join(there.select("path", "length"), ["path", "length"], "left_anti")


def copy_files(files: DataFrame, source: str, destination: str) -> int:
    """Copies the named files through Spark's own file access, in parallel; returns how many."""
    conf = {"source": source.rstrip("/"), "destination": destination.rstrip("/")}

    def work(batches):
        import pandas as pd
        from pyarrow import fs

        one, source = fs.FileSystem.from_uri(conf["source"])
        two, destination = fs.FileSystem.from_uri(conf["destination"])
        for batch in batches:
            for path in batch["path"]:
                target = f"{destination}/{path}"
                two.create_dir(target.rpartition("/")[0], recursive=True)
                fs.copy_files(f"{source}/{path}", target, source_filesystem=one, destination_filesystem=two)
            yield pd.DataFrame({"n": [len(batch)]})

    return files.select("path").mapInPandas(work, "n long").agg(F.sum("n")).first()[0] or 0


def write_files(files: DataFrame, root: str) -> int:
    """Writes each row's ``content`` to ``path`` below a folder that all machines share, in parallel; returns how many."""
    folder = root.rstrip("/")

    def work(batches):
        import pandas as pd
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                target = f"{base}/{path}"
                system.create_dir(target.rpartition("/")[0], recursive=True)
                with system.open_output_stream(target) as out:
                    out.write(bytes(content))
            yield pd.DataFrame({"n": [len(batch)]})

    return files.select("path", "content").mapInPandas(work, "n long").agg(F.sum("n")).first()[0] or 0


def split_failures(df: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without an error, and those with one, named in ``error``."""
    marked = df.withColumn("error", error)
    return marked.where("error IS NULL").drop("error"), marked.where("error IS NOT NULL")


def report_lines(summary: DataFrame, template: str, columns: Sequence[str]) -> DataFrame:
    """A text line for each row."""
    return summary.select(F.format_string(template, *columns).alias("value"))
