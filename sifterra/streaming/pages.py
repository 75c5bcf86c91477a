"""Pages to questions: classify each image, then extract from those of one label.

Both steps ask an injected client; images are read as files and travel in Arrow batches to
the tasks that ask, a few at a time.  Labels and replies are decoded by expressions, so a
broken reply is a row of its own kind and never ends a job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifterra.functions import replies
from sifterra.functions.text import page_number
from sifterra.storage import materialize

#: Takes images and gives a reply for each.
ImageClient = Callable[[list[bytes]], list[str]]


def asked(images: DataFrame, client: ImageClient, batch: int = 4) -> DataFrame:
    """(path, reply) of each image (path, content), ``batch`` at a time; a client that raises
    or miscounts gives replies that begin with ``ERROR``.  A null content is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in batches:
            for lo in range(0, found.num_rows, batch):
                part = found.slice(lo, batch)
                content = [x or b"" for x in part.column(1).to_pylist()]
                try:
                    said = list(client(content))
                    if len(said) != len(content):
                        raise ValueError(f"{len(said)} replies to {len(content)} images")
                except Exception as problem:  # noqa: BLE001 - any failure of a client is a reply
                    said = [f"ERROR: {problem}"] * len(content)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(said, pa.string())], ["path", "reply"])

    return images.select("path", "content").mapInArrow(run, "path string, reply string")


def labelled(images: DataFrame, classify: ImageClient, known: DataFrame | None = None, batch: int = 4) -> DataFrame:
    """(path, label, domain) of each image.

    ``known`` has labels of an earlier run; images that it labels other than ``skip`` are not
    asked for again.  Errors and unknown labels are ``skip``.
    """
    done = None if known is None else known.where(F.col("label") != replies.OTHER).select("path", "label", "domain")
    open_ = images if done is None else images.join(done.select("path"), "path", "left_anti")
    said = asked(open_, classify, batch).select("path", replies.page_label(F.col("reply")).alias("x")).select("path", "x.*")
    return said if done is None else said.unionByName(done.join(images.select("path"), "path", "left_semi"))


def page_questions(images: DataFrame, classify: ImageClient, extract: ImageClient, known: DataFrame | None = None, label: str = replies.WITH_DOMAIN, batch: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(labels, questions, corrupt) of images (path, content).

    Labels are written before the second step, so no image is asked for twice when both
    results are used; images of ``label`` go to ``extract``.  Questions are (path, page,
    domain, pos and the fields of a question), corrupt (path, reply) those whose reply is not
    a JSON list.  ``path`` is unique.
    """
    labels = materialize(labelled(images, classify, known, batch), "labels")
    wanted = images.join(labels.where(F.col("label") == label).select("path"), "path", "left_semi")
    said = materialize(asked(wanted, extract, batch), "replies")
    good, corrupt = replies.decoded(said, "reply")
    named = good.join(labels.select("path", "domain"), "path").withColumn("page", page_number(F.col("path")))
    return labels, named, corrupt
