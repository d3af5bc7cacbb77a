"""Containers written from tables: rows (source_id, name, content) of finished parts, and their manifest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.functions.titles import CODES
from blockloom.operators.batch_scan import boot_info
from blockloom.operators.blocks import split_blocks
from blockloom.operators.scrub import scrub_plan, used_ranges
from blockloom.sources import formats as X
from blockloom.sources.batches import batched, by_key, schema_of

PARTS = "source_id string, name string, size long, content binary"


def named(stem: str, parts: list[bytes], ext: str) -> list[tuple]:
    return [(X.part_name(stem, i, len(parts), ext), len(p), p) for i, p in enumerate(parts)]


def assemble(rows: DataFrame, order: str, payload: str, make: Callable[[str, dict[str, list]], list[tuple]]) -> DataFrame:
    """Parts made of each source's ordered rows. Sources are dealt and sorted, and a task goes through many of them in a stream:
    a call and a data frame for each would cost far more than a small source's bytes."""
    schema = schema_of(PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(((s, *part) for s, g in by_key(batches, "source_id") for part in make(s, g)), schema)

    dealt = rows.select("source_id", order, payload).repartition("source_id")
    return dealt.sortWithinPartitions("source_id", F.col(order).asc_nulls_last()).mapInArrow(run, PARTS)


def to_cci(sectors: DataFrame, cap: int = X.CCI_CAP) -> DataFrame:
    """From (source_id, sector_no, data)."""
    return assemble(sectors, "sector_no", "data", lambda s, g: named(s, X.write_cci(b"".join(g["data"]), cap), "cci"))


def to_ciso(sectors: DataFrame, cap: int = X.CISO_CAP) -> DataFrame:
    return assemble(sectors, "sector_no", "data", lambda s, g: named(s, X.write_ciso(b"".join(g["data"]), cap), "cso"))


def to_raw(sectors: DataFrame, cap: int = X.RAW_CAP) -> DataFrame:
    return assemble(sectors, "sector_no", "data", lambda s, g: named(s, X.split_raw(b"".join(g["data"]), cap), "xiso.iso"))


def to_archive(files: DataFrame) -> DataFrame:
    """From (source_id, path, content)."""
    return assemble(files, "path", "content", lambda s, g: named(s, [X.write_zar(dict(zip(g["path"], map(bytes, g["content"]))))], "zar"))


def to_volume(files: DataFrame) -> DataFrame:
    """Whole images of the files of each source; a folder must fit in a sector."""
    return assemble(files, "path", "content", lambda s, g: [(f"{s}.iso", len(p), p) for p in [X.write_volume(dict(zip(g["path"], map(bytes, g["content"]))))]])


def without_updates(files: DataFrame, path: str = "path") -> DataFrame:
    """Files outside the system update's folder."""
    return files.where(~F.upper(F.regexp_replace(path, r"^[/\\]+", "")).startswith("$SYSTEMUPDATE"))


def manifest(parts: DataFrame) -> DataFrame:
    return parts.groupBy("source_id", "name").agg(F.sum("size").alias("size"))


def zero_unused(sectors: DataFrame, used: DataFrame) -> DataFrame:
    """Sectors that no entry claims are replaced by zeros: used has (source_id, sector_no)."""
    marked = sectors.join(used.distinct().withColumn("_used", F.lit(True)), ["source_id", "sector_no"], "left")
    return marked.withColumn("data", F.when(F.col("_used"), F.col("data")).otherwise(F.unhex(F.lit("00" * X.SECTOR)))).drop("_used")


def to_hash_tree(sectors: DataFrame) -> DataFrame:
    """Parts Data0000, Data0001, … of a hash-tree container."""
    return assemble(sectors, "sector_no", "data", lambda s, g: [(f"Data{i:04d}", len(p), p) for i, p in enumerate(X.write_god(b"".join(g["data"]))[0])])


def to_god(images: DataFrame) -> DataFrame:
    """Folders of hash-tree parts and their header, from whole images (source_id, content) with a launch executable; media
    and title come from it. An image without one is a row without content whose name is the reason."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for source, content in zip(group["source_id"], map(bytes, group["content"])):
            try:
                read = lambda at, n, c=content: c[at : at + n]
                v = X.read_volume(read)
                X.need(v is not None and v.walked, "no volume at any known offset")
                info = boot_info(v, read)
                kind = CODES["gamesOnDemand" if "platform" in info else "xboxOriginal"]
                out += [(source, n, len(p), p) for n, p in X.god_folder(content[v.root_offset :], info, kind)]
            except ValueError as e:
                out.append((source, str(e), 0, None))
        return pd.DataFrame(out, columns=["source_id", "name", "size", "content"])

    return images.groupBy("source_id").applyInPandas(run, PARTS)


def scrubbed(sectors: DataFrame, entries: DataFrame, images: DataFrame, mode: str) -> DataFrame:
    """Sectors (image_id, sector_no, data), counted from the volume's root, that stay under a scrub plan of this mode, the
    unused ones of ogx images as zeros where the plan says so. Images with a reason give no rows."""
    plan = scrub_plan(entries, images, mode).where("reason IS NULL").select("image_id", "total_sectors", F.col("zero_sectors").isNotNull().alias("zeroing"))
    kept = sectors.join(plan, "image_id").where("sector_no < total_sectors")
    ranges = used_ranges(entries, images).withColumn("stretch", F.explode(F.sequence(F.expr("first div 64"), F.expr("last div 64"))))
    used = kept.select("image_id", "sector_no", F.expr("sector_no div 64").alias("stretch")).join(ranges, ["image_id", "stretch"]).where("sector_no >= first AND sector_no <= last")
    marked = kept.join(used.select("image_id", "sector_no").withColumn("used", F.lit(True)), ["image_id", "sector_no"], "left")
    zeros = F.unhex(F.lit("00" * X.SECTOR))
    return marked.select("image_id", "sector_no", F.when(F.col("zeroing") & F.col("used").isNull(), zeros).otherwise(F.col("data")).alias("data"))


def chunks(parts: DataFrame, size: int = 64 * X.SECTOR) -> DataFrame:
    """(source_id, name, chunk_no, data): finished parts in chunks of at most size bytes. An empty part has none."""
    return split_blocks(parts.select("source_id", "name", "content"), "content", size, "chunk_no", "data")


def stream(parts: DataFrame, size: int = 64 * X.SECTOR, progress: Callable[[int, int], None] | None = None) -> Iterator[tuple[str, str, bytes]]:
    """Chunks in the order of source, name and place, one task's at a time on the caller's side; sizes are known first, and
    progress is told how many bytes of how many were given."""
    order = ["source_id", "name", "chunk_no"]
    total, given = (parts.agg(F.sum(F.octet_length("content").cast("long"))).first()[0] or 0) if progress else 0, 0
    for r in chunks(parts, size).orderBy(*order).toLocalIterator():
        data = bytes(r["data"])
        given += len(data)
        yield r["source_id"], r["name"], data
        if progress:
            progress(given, total)


def to_package(files: DataFrame) -> DataFrame:
    return assemble(files, "path", "content", lambda s, g: [(f"{s}.pkg", len(p), p) for p in [X.write_stfs(dict(zip(g["path"], map(bytes, g["content"]))), name=s)]])
