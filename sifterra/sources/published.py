"""Files that appear all at once: a data source whose writer commits in two phases.

Tasks write files under names of their own and report them; only the commit, on the
driver, makes them the table by replacing one small manifest.  A task that fails or runs
twice leaves files that no manifest names, an aborted job's are deleted, and a reader sees
the old files or the new ones at any time.  Paths are those of ``pyarrow.fs``: a local or
shared folder, or a URI.
"""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT, MANIFEST = "published", "_manifest.json"
#: Rows that a task holds before it writes them.
ROWS = 10_000


def _place(path: str) -> tuple[afs.FileSystem, str]:
    return afs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (afs.LocalFileSystem(), path)


def _manifest(path: str) -> dict:
    where, base = _place(path)
    at = f"{base.rstrip('/')}/{MANIFEST}"
    if where.get_file_info(at).type == afs.FileType.NotFound:
        return {"files": [], "rows": 0, "before": []}
    with where.open_input_stream(at) as f:
        return json.loads(f.read())


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, names: list[str], kind: str, by: str | None, overwrite: bool) -> None:
        self.path, self.names, self.kind, self.by, self.overwrite, self.job = path.rstrip("/"), names, kind, by, overwrite, uuid.uuid4().hex

    def _lines(self, rows: list[dict], head: bool) -> bytes:
        names = [n for n in self.names if n != self.by]
        if self.kind == "json":
            return "".join(json.dumps({n: r[n] for n in names}, ensure_ascii=False, default=str) + "\n" for r in rows).encode()
        out = io.StringIO()
        writer = csv.DictWriter(out, names, extrasaction="ignore", lineterminator="\n")
        if head:
            writer.writeheader()
        writer.writerows(rows)
        return out.getvalue().encode()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, base = _place(self.path)
        where.create_dir(f"{base}/{self.job}", recursive=True)
        task, made, out, at = uuid.uuid4().hex, [], None, object()
        try:
            for batch in iterator:
                for lo in range(0, batch.num_rows, ROWS):
                    for key, rows in groupby(batch.slice(lo, ROWS).to_pylist(), lambda r: r[self.by] if self.by else None):
                        if out is None or key != at:
                            if out is not None:
                                out.close()
                            made.append([f"{self.job}/{f'{key}-' if self.by else ''}{task}-{len(made)}.{self.kind}", 0])
                            out, at = where.open_output_stream(f"{base}/{made[-1][0]}"), key
                        listed = list(rows)
                        out.write(self._lines(listed, made[-1][1] == 0))
                        made[-1][1] += len(listed)
        finally:
            if out is not None:
                out.close()
        return Written([(name, n) for name, n in made])

    def commit(self, messages: list[Written | None]) -> None:
        where, base = _place(self.path)
        made = sorted(x for m in messages if m for x in m.files)
        old = _manifest(self.path)
        files = [f for f, _ in made] + ([] if self.overwrite else old["files"])
        gone = old["files"] if self.overwrite else []
        new = {"files": files, "rows": sum(n for _, n in made) + (0 if self.overwrite else old["rows"]), "before": gone, "kind": self.kind}
        where.create_dir(base, recursive=True)
        with where.open_output_stream(f"{base}/{MANIFEST}.{self.job}") as f:
            f.write(json.dumps(new).encode())
        where.move(f"{base}/{MANIFEST}.{self.job}", f"{base}/{MANIFEST}")
        for f in old["before"]:  # of the version before the last: nobody has just begun to read it
            if f not in files and where.get_file_info(f"{base}/{f}").type == afs.FileType.File:
                where.delete_file(f"{base}/{f}")

    def abort(self, messages: list[Written | None]) -> None:
        where, base = _place(self.path)
        if where.get_file_info(f"{base}/{self.job}").type == afs.FileType.Directory:
            where.delete_dir(f"{base}/{self.job}")


class Published(DataSource):
    """Options: ``path``; ``kind`` (json or csv); ``by``, a column whose values get files of
    their own and which is not written."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        raise NotImplementedError("read the files of the manifest: published.read")

    def writer(self, schema, overwrite: bool) -> _Writer:
        kind = self.options.get("kind", "json")
        if kind not in ("json", "csv"):
            raise ValueError(f"kind {kind}")
        return _Writer(self.options["path"], schema.names, kind, self.options.get("by"), overwrite)


def write(rows: DataFrame, path: str, kind: str = "json", by: str | None = None, append: bool = False) -> None:
    """Publish ``rows`` as the table at ``path``, or add them to it; with ``by``, the rows of each
    of its values are gathered in one task and file."""
    rows.sparkSession.dataSource.register(Published)
    dealt = rows.repartition(by).sortWithinPartitions(by) if by else rows
    out = dealt.write.format(FORMAT).option("path", path).option("kind", kind)
    (out.option("by", by) if by else out).mode("append" if append else "overwrite").save()


def files(path: str) -> list[str]:
    """The files of the table as it is now."""
    return [f"{path.rstrip('/')}/{f}" for f in _manifest(path)["files"]]


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table as it is now."""
    found, kind = files(path), _manifest(path).get("kind", "json")
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(found) if kind == "json" else spark.read.schema(schema).option("header", True).csv(found)


def harness_lines(records: DataFrame) -> DataFrame:
    """Rows of an evaluation harness: options in columns, the answer's index; records whose key
    is none of A to D are left out."""
    options = [F.col("options")[k].alias(f"option_{k.lower()}") for k in "ABCD"]
    index = F.instr(F.lit("ABCD"), F.col("correct_key")) - 1
    kept = records.where(F.col("correct_key").isin("A", "B", "C", "D"))
    return kept.select("id", "question", *options, index.alias("answer"), "domain", "subdomain", "level")


def batch_files(batched: DataFrame, path: str) -> None:
    """The rows of each batch in files of their own, all replaced at once."""
    write(batched, path, by="batch_id")
