"""Containers for SQL: table functions over a file's bytes, to be called in a lateral join."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from blockloom.sources import formats as X
from blockloom.sources.containers import image_of


class ContainerEntries:
    """path, attributes, sector and size of each entry of a one-part image; one row with a reason if there is no volume."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        try:
            X.need(content is not None, "no content")
            image = image_of([bytes(content)])
            v = X.read_volume(lambda at, n: image[at : at + n])
            X.need(v is not None, "no volume at any known offset")
            X.need(v.walked, v.reason)
        except ValueError as e:
            yield None, None, None, None, str(e)
            return
        for path, _, attributes, sector, size in v.entries:
            yield path, attributes, sector, size, None


class ContainerFiles:
    """path and content of each file of an archive or package; one row with a reason if it can't be read."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        try:
            X.need(content is not None, "no content")
            data = bytes(content)
            kind = X.detect(data[:4], data[-4:], len(data))
            X.need(kind in ("zar", "stfs"), f"a {kind} isn't an archive or package")
            found = [(p, X.zar_read(data, at, n)) for p, at, n in X.zar_files(data)] if kind == "zar" else [(p, c) for p, _, c in X.stfs_files(data)]
        except ValueError as e:
            found = [(None, None)]
            reason = str(e)
        else:
            reason = None
        for path, body in found:
            yield path, body, reason


def register(spark: SparkSession) -> None:
    """container_entries(content) and container_files(content) as SQL table functions of this session."""
    spark.udtf.register("container_entries", F.udtf(ContainerEntries, returnType="path string, attributes int, sector long, size long, reason string"))
    spark.udtf.register("container_files", F.udtf(ContainerFiles, returnType="path string, content binary, reason string"))
