"""Containers as tables. A source is one or more parts: rows (source_id, name, content). What can't be parsed becomes a
row with a reason, never a failed job. A part must fit in memory, as binaryFile has it; sources are dealt by source_id,
so many of them are read at once."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from blockloom.functions.patches import u32_le
from blockloom.operators.paths import number_at_end
from blockloom.sources import formats as X
from blockloom.sources.batches import batched, by_key, schema_of


def read_parts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a folder as parts; the folder's name is the source."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    pieces = F.split("path", "/")
    return files.select(F.element_at(pieces, -2).alias("source_id"), F.element_at(pieces, -1).alias("name"), F.col("length").alias("size"), "content")


def detect(parts: DataFrame) -> DataFrame:
    """Adds format and reason; column expressions only, so the content's ends are all that is looked at."""
    head, tail, size = F.hex(F.substring("content", 1, 4)), F.hex(F.expr("substring(content, -4)")), F.octet_length("content")
    magic = lambda b: b.hex().upper()
    kind = F.when(size < 4, None)
    for m, name in ((b"CISO", "ciso"), (b"CCIM", "cci"), (b"CON ", "stfs"), (b"LIVE", "stfs"), (b"PIRS", "stfs")):
        kind = kind.when(head == magic(m), name)
    kind = kind.when((size > X.ZAR_FOOTER) & (tail == f"{X.ZAR_MAGIC:08X}"), "zar").otherwise("xiso")
    return parts.withColumn("format", kind).withColumn("reason", F.when(size < 4, "file is shorter than a magic number"))


def part_order() -> Column:
    """The order of parts within a source: by the number in the name, before all of its extensions (game.2.cci,
    game.10.xiso.iso), or at its end, others last, then by name."""
    stem = F.regexp_replace("name", r"(\.[A-Za-z]+)+$", "")
    return F.struct(F.coalesce(number_at_end(stem), F.lit((1 << 63) - 1)), F.col("name"))


def numbered(parts: DataFrame) -> DataFrame:
    """Part numbers from 0 within a source."""
    return parts.withColumn("part_no", F.row_number().over(W.partitionBy("source_id").orderBy(part_order())) - 1)


def parsed(parts: DataFrame, rows: Callable[[list[str], list[bytes]], list[tuple]], columns: str, together: bool = False) -> DataFrame:
    """Runs a parser over each source's ordered parts; columns are those of its rows, with status and reason after them. Many
    sources go through a task in one stream. Parts of a source that are together in one partition, as the writers leave them,
    are parsed there, without an exchange."""
    columns = f"source_id string, {columns}, status string, reason string"
    schema = schema_of(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for source, group in by_key(batches, "source_id"):
                none = [None] * (len(schema) - 3)
                try:
                    found = rows(group["name"], [bytes(c) for c in group["content"]])
                    yield from [(source, *r, "ok", None) for r in found]
                except (ValueError, IndexError, OverflowError, OSError) as e:
                    yield source, *none, "unresolved", str(e)
                except Exception as e:  # a codec's own error type
                    yield source, *none, "unresolved", f"{type(e).__name__}: {e}"

        yield from batched(out(), schema)

    dealt = parts.select("source_id", "name", "content")
    dealt = dealt if together else dealt.repartition("source_id")
    return dealt.sortWithinPartitions("source_id", part_order()).mapInArrow(run, columns)


def image_of(parts: list[bytes]) -> bytes:
    """A source's raw image, whatever holds it."""
    kind = X.detect(parts[0][:4], parts[0][-4:], len(parts[0]))
    if kind == "cci":
        return b"".join(s for p in parts for s in X.read_cci(p))
    if kind == "ciso":
        return b"".join(X.read_ciso(parts))
    if kind == "stfs" or kind == "zar":
        raise ValueError(f"a {kind} holds files, not an image")
    return b"".join(parts)


def image_files(image: bytes) -> list[tuple]:
    v = X.read_volume(lambda at, n: image[at : at + n])
    X.need(v is not None, "no volume at any known offset")
    X.need(v.walked, v.reason)
    return [(path, size, image[v.root_offset + sector * X.SECTOR :][:size]) for path, _, attributes, sector, size in v.entries if not attributes & 0x10]


SECTORS = "source_id string, sector_no long, data binary, status string, reason string"


def read_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sectors of parts that stand alone, numbered from where each begins in its source; batches go on over parts."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for x in zip(*(batch.column(c) for c in ("source_id", "start", "format", "content"))):
                source, start, kind, part = (v.as_py() for v in x)
                try:
                    for i, s in enumerate(X.read_cci(part) if kind == "cci" else (part[lo : lo + X.SECTOR] for lo in range(0, len(part), X.SECTOR))):
                        yield source, start + i, s, "ok", None
                except (ValueError, OSError) as e:
                    yield source, None, None, "unresolved", str(e)

    kinds = (pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string())
    yield from batched(rows(), pa.schema(list(zip(("source_id", "sector_no", "data", "status", "reason"), kinds))))


def sectors(parts: DataFrame, together: bool = False) -> DataFrame:
    """(source_id, sector_no, data) of image containers. Parts that can be read without the others, of a source whose parts
    all have their own index or are raw and of whole sectors, are read one by one in any task, their place being known from
    their headers and sizes. Other sources are read whole. Parts are made once: what looks at their headers and both ways of
    reading take them from one exchange. Its two columns are all needed by each, and its key is a struct, which is never null, so
    neither a column left out nor a filter makes the plans below it differ. Sources whose parts are together in one partition,
    as the writers leave them, are read there and whole."""
    cut = lambda names, data: [(i // X.SECTOR, image[i : i + X.SECTOR]) for image in [image_of(data)] for i in range(0, len(image), X.SECTOR)]
    if together:
        return parsed(parts, cut, "sector_no long, data binary", together)
    size = F.octet_length("content").cast("long")
    held = u32_le(F.col("content"), F.lit(8)) + u32_le(F.col("content"), F.lit(12)) * (1 << 32)
    dealt = parts.select(F.struct("source_id", "name").alias("_part"), "content").repartition("_part")
    heads = detect(dealt).select("_part", "_part.*", "format", F.when(F.col("format") == "cci", held).otherwise(size).alias("bytes"))
    in_source = W.partitionBy("source_id")
    heads = numbered(heads).withColumn("start", F.coalesce(F.sum(F.expr(f"bytes div {X.SECTOR}")).over(in_source.orderBy("part_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    whole = F.coalesce(F.col("format").isin("cci", "xiso") & (F.col("bytes") % X.SECTOR == 0), F.lit(False))
    same = (F.min("format").over(in_source) == F.max("format").over(in_source)) & (F.size(F.collect_set("name").over(in_source)) == F.count(F.lit(1)).over(in_source))
    heads = heads.withColumn("alone", F.coalesce(F.min(whole).over(in_source) & same, F.lit(False)))
    place = heads.groupBy("_part").agg(F.min(F.struct("alone", "start", "format")).alias("at"))
    placed = dealt.join(place, "_part")
    alone = placed.where("at.alone").select("_part.source_id", "at.start", "at.format", "content").mapInArrow(read_part, SECTORS)
    return alone.unionByName(parsed(placed.where("NOT at.alone").select("_part.*", "content"), cut, "sector_no long, data binary"))


def index(parts: DataFrame) -> DataFrame:
    """(source_id, part_no, sector_no, position, compressed) of CCI and CISO containers."""

    def rows(names: list[str], data: list[bytes]) -> list[tuple]:
        if X.detect(data[0][:4], data[0][-4:], len(data[0])) == "cci":
            return [(p, i, at, flag) for p, d in enumerate(data) for positions, flags in [X.cci_index(d)] for i, (at, flag) in enumerate(zip(positions, flags))]
        positions, flags, starts = X.ciso_index(data[0])
        part = lambda i: sum(s <= i for s in starts) - 1
        return [(part(i), i, at, flag) for i, (at, flag) in enumerate(zip(positions, flags))]

    return parsed(parts, rows, "part_no int, sector_no long, position long, compressed boolean")


def entries(parts: DataFrame) -> DataFrame:
    """(source_id, path, name, attributes, sector, size) of images; an image without a volume is a row with a reason."""

    def rows(names: list[str], data: list[bytes]) -> list[tuple]:
        image = image_of(data)
        v = X.read_volume(lambda at, n: image[at : at + n])
        X.need(v is not None, "no volume at any known offset")
        X.need(v.walked, v.reason)
        return v.entries

    return parsed(parts, rows, "path string, name string, attributes int, sector long, size long")


def archive_files(parts: DataFrame) -> DataFrame:
    """(source_id, path, size, content) of archives."""

    def rows(names: list[str], data: list[bytes]) -> list[tuple]:
        X.need(len(data) == 1, "an archive has one part")
        return [(path, size, X.zar_read(data[0], start, size)) for path, start, size in X.zar_files(data[0])]

    return parsed(parts, rows, "path string, size long, content binary")


def files(parts: DataFrame) -> DataFrame:
    """(source_id, format, path, size, content) of the files in each source, whatever container it is: archives and packages
    are one part, hash-tree containers are known by their parts' names, of a header and parts the header isn't read, and all
    others hold an image."""

    def rows(names: list[str], data: list[bytes]) -> list[tuple]:
        tree = [(n, d) for n, d in zip(names, data) if re.fullmatch(r"(.*/)?data[0-9]+", n, re.IGNORECASE)]
        kind = X.detect(data[0][:4], data[0][-4:], len(data[0]))
        if tree:
            X.need(len(tree) >= len(data) - 1, "a hash-tree container has one header at most")
            kind, image = "god", X.read_god([d for _, d in tree])
        elif kind in ("zar", "stfs"):
            X.need(len(data) == 1, f"a {kind} has one part")
            if kind == "zar":
                return [(kind, path, size, X.zar_read(data[0], start, size)) for path, start, size in X.zar_files(data[0])]
            return [(kind, *f) for f in X.stfs_files(data[0])]
        else:
            image = image_of(data)
        return [(kind, *f) for f in image_files(image)]

    return parsed(parts, rows, "format string, path string, size long, content binary")


def packages(parts: DataFrame) -> DataFrame:
    """Header fields of packages."""
    columns = "magic string, header_size long, content_type long, metadata_version long, media_id long, title_id long, disc_number int, disc_count int, display_name string, block_separation int, file_table_blocks int, file_table_block long, allocated_blocks long"
    return parsed(parts, lambda names, data: [tuple(X.stfs_header(data[0]).values())], columns)


def inspect(parts: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """One row a source: format, launch executable's identity and picture, and its title's name if there is a title table. The
    root's default.xex comes before its default.xbe."""

    def rows(names: list[str], data: list[bytes]) -> list[tuple]:
        image = image_of(data)
        v = X.read_volume(lambda at, n: image[at : at + n])
        X.need(v is not None, "no volume at any known offset")
        for wanted, parse in (("default.xex", X.xex_execution), ("default.xbe", X.xbe_header)):
            for path, _, _, sector, size in v.entries:
                if path.lower() == wanted:
                    at = v.root_offset + sector * X.SECTOR
                    f = parse(image[at : at + size])
                    return [(v.kind, wanted, f["title_id"], f["disc_number"], f["disc_count"], f["version"], f["base_version"], X.thumbnail(image[at : at + size]))]
        return [(v.kind, None, 0, 1, 1, 0, 0, None)]

    out = parsed(parts, rows, "volume string, executable string, title_id long, disc_number int, disc_count int, version long, base_version long, thumbnail binary")
    return out.join(titles.select("title_id", F.col("name").alias("title")), "title_id", "left") if titles is not None else out


def executables(parts: DataFrame) -> DataFrame:
    """Layout of each source's executable: where its image begins and is loaded, encryption, compression, title."""
    columns = "code_offset long, load_address long, encrypted boolean, compression string, runs array<struct<stored:long,zeros:long>>, window_size long, first_block_size long, title_id long"

    def rows(names: list[str], data: list[bytes]) -> list[tuple]:
        x = X.xex_layout(data[0])
        runs = x["runs"] and [{"stored": a, "zeros": b} for a, b in x["runs"]]
        return [tuple(v for k, v in (x | {"runs": runs}).items() if k != "resource_info")]

    return parsed(parts, rows, columns)


def executable_resources(parts: DataFrame) -> DataFrame:
    return parsed(parts, lambda names, data: X.xex_resources(data[0]), "name string, address long, size long")


def package_metadata(parts: DataFrame) -> DataFrame:
    """Identifiers, thumbnails and special records of packages' headers."""
    columns = "console_id binary, profile_id binary, online_creator binary, device_id binary, thumbnail binary, title_thumbnail binary, avatar_category long, avatar_colorizable long, avatar_guid binary, avatar_skeleton int, series_id binary, season_id binary, season_number int, episode_number int, installer string, installer_base_version long, installer_version long"
    return parsed(parts, lambda names, data: [tuple(X.stfs_metadata(data[0]).values())], columns)


def volume_files(parts: DataFrame) -> DataFrame:
    """(source_id, path, size, content) of the files of images, whatever container holds them."""

    return parsed(parts, lambda names, data: image_files(image_of(data)), "path string, size long, content binary")


def package_files(parts: DataFrame) -> DataFrame:
    """(source_id, path, size, content) of packages' files."""
    return parsed(parts, lambda names, data: X.stfs_files(data[0]), "path string, size long, content binary")


def hash_tree_sectors(parts: DataFrame) -> DataFrame:
    """(source_id, sector_no, data) of hash-tree parts, in the order of the numbers in their names."""

    def rows(names: list[str], data: list[bytes]) -> list[tuple]:
        image = X.read_god(data)
        return [(i // X.SECTOR, image[i : i + X.SECTOR]) for i in range(0, len(image), X.SECTOR)]

    return parsed(parts, rows, "sector_no long, data binary")
