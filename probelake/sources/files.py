"""Many small files from table rows and back, for layouts of one file per record."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_files(rows: DataFrame, root: str) -> int:
    """Write ``content`` (text or bytes) of every row to ``root/rel_path``; how many files were written.

    Tasks write their own rows; a repeated task writes the same bytes to the same place. ``root`` must be a place every
    executor can write to.
    """

    def put(batches):
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(root)
        made = set()
        for batch in batches:
            for rel, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folder = f"{base}/{rel}".rsplit("/", 1)[0]
                if folder not in made:
                    files.create_dir(folder, recursive=True)
                    made.add(folder)
                with files.open_output_stream(f"{base}/{rel}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    named = rows.select(F.col("rel_path").cast("string").alias("rel_path"), F.col("content").cast("binary").alias("content"))
    return named.mapInArrow(put, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def reader(root: str) -> Callable[[str], bytes | None]:
    """A function from a path below ``root`` to the bytes of its file, None if there is none; made inside a task."""
    from pyarrow import fs

    files, base = fs.FileSystem.from_uri(root)

    def read(rel: str) -> bytes | None:
        try:
            with files.open_input_file(f"{base}/{rel}") as f:
                return f.read()
        except FileNotFoundError:
            return None

    return read


def write_lines_file(lines: DataFrame, path: str, before: str = "", between: str = "\n", after: str = "") -> None:
    """One text file of the string column ``line``, in the order of ``lines``: a single writer that holds one batch at a time.

    For formats that are one document by definition; tables are written as folders.
    """

    def put(batches):
        from pyarrow import fs

        files, target = fs.FileSystem.from_uri(path)
        files.create_dir(target.rsplit("/", 1)[0], recursive=True)
        first = True
        with files.open_output_stream(target) as out:
            out.write(before.encode())
            for batch in batches:
                for line in batch.column(0).to_pylist():
                    out.write(("" if first else between).encode() + line.encode())
                    first = False
            out.write(after.encode())
        yield pa.RecordBatch.from_arrays([pa.array([1])], ["n"])

    lines.select("line").coalesce(1).mapInArrow(put, "n bigint").count()
