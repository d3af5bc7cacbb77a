import random
import struct

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from blockloom.functions import codecs
from blockloom.operators import batch_scan
from blockloom.sources import batches, containers, formats, sinks, streams
from blockloom.streaming.early import watch


def xbe(title_id=0x41560001, size=0x400):
    out = bytearray(size)
    out[:4] = b"XBEH"
    struct.pack_into("<I", out, 0x104, 0x10000)
    struct.pack_into("<I", out, 0x118, 0x10000 + 0x180)
    struct.pack_into("<I", out, 0x180 + 8, title_id)
    out[0x180 + 12 : 0x180 + 12 + 8] = "Game".encode("utf-16-le")
    struct.pack_into("<II", out, 0x180 + 0xA8, 1, 7)
    return bytes(out)


def xex(title_id, disc, count):
    head = b"XEX2" + bytes(16) + struct.pack(">I", 1) + struct.pack(">II", 0x40006, 40)
    return head.ljust(40, b"\0") + struct.pack(">IIIIBBBBI", 1, 0x20000001, 0, title_id, 2, 0, disc, count, 0)


def image(seed=1, exe=None, extra=20000):
    rng = random.Random(seed)
    return formats.write_volume({"default.xbe": xbe(), **(exe or {}), "data/a.bin": bytes(3000), "data/deep/b.txt": b"hello", "noise.bin": rng.randbytes(extra)})


IMAGE = image()


def test_containers_round_trip_for_any_cap():
    for cap in (1 << 30, 9000, 4096):
        assert b"".join(s for p in formats.write_cci(IMAGE, cap) for s in formats.read_cci(p)) == IMAGE
        assert b"".join(formats.read_ciso(formats.write_ciso(IMAGE, max(cap, 1024)))) == IMAGE
    assert len(formats.write_cci(IMAGE, 4096)) > 2 and len(formats.write_ciso(IMAGE, 4096)) > 2
    assert all(len(p) <= 4096 + 2048 + 4 * 128 for p in formats.write_cci(IMAGE, 4096))


def test_archive_round_trip():
    files = {"A/x.bin": bytes(70_000), "a/é.txt": b"one", "z.bin": random.Random(3).randbytes(140_000), "empty": b""}
    data = formats.write_zar(files)
    got = {p: formats.zar_read(data, s, n) for p, s, n in formats.zar_files(data)}
    assert got == {"A/x.bin": files["A/x.bin"], "A/é.txt": b"one", "z.bin": files["z.bin"], "empty": b""}
    for bad in ({"a": b"", "A": b""}, {"a": b"", "a/b": b""}, {"../x": b""}):
        with pytest.raises(ValueError):
            formats.write_zar(bad)


@pytest.mark.parametrize("make", [lambda: formats.write_cci(IMAGE)[0], lambda: formats.write_ciso(IMAGE)[0], lambda: formats.write_zar({"a": b"x" * 100}), lambda: IMAGE])
def test_damage_is_an_error_or_a_result_never_a_crash(make):
    data, rng = make(), random.Random(9)
    for at in [*range(0, min(len(data), 200)), *(rng.randrange(len(data)) for _ in range(60))]:
        for bad in (data[:at] + bytes([data[at] ^ 0xFF]) + data[at + 1 :], data[:at]):
            try:
                kind = formats.detect(bad[:4], bad[-4:], len(bad))
                if kind == "zar":
                    [formats.zar_read(bad, s, min(n, 1 << 20)) for _, s, n in formats.zar_files(bad)]
                elif kind != "stfs":
                    i = containers.image_of([bad])
                    formats.read_volume(lambda a, n: i[a : a + n])
            except (ValueError, IndexError, OSError, OverflowError) as e:
                assert str(e) or True
            except Exception as e:
                assert type(e).__name__ in ("ArrowInvalid", "ZstdError", "error"), type(e)


def parts_of(spark, rows):
    return spark.createDataFrame(rows, "source_id string, name string, content binary")


def test_spark_sources_and_sinks(spark):
    cci, ciso = formats.write_cci(IMAGE, 4096), formats.write_ciso(IMAGE, 4096)
    rows = [("cci", f"g.{i + 1}.cci", p) for i, p in enumerate(cci)] + [("ciso", f"g.{i + 1}.cso", p) for i, p in enumerate(ciso)] + [("raw", "g.iso", IMAGE), ("bad", "x", b"CCIM\0"), ("tiny", "y", b"ab")]
    parts = parts_of(spark, rows)
    kinds = {(r.source_id, r.format) for r in containers.detect(parts).collect()}
    assert kinds == {("cci", "cci"), ("ciso", "ciso"), ("ciso", "xiso"), ("raw", "xiso"), ("bad", "cci"), ("tiny", None)}
    for n in (1, 8):
        found = containers.sectors(parts.repartition(n)).collect()
        for s in ("cci", "ciso", "raw"):
            assert b"".join(bytes(r.data) for r in sorted((r for r in found if r.source_id == s), key=lambda r: r.sector_no)) == IMAGE
        assert {(r.source_id, r.status) for r in found if r.status != "ok"} == {("bad", "unresolved"), ("tiny", "unresolved")}
    listed = {r.path: r.size for r in containers.entries(parts).where("source_id = 'cci'").collect()}
    assert listed["data/deep/b.txt"] == 5 and listed["default.xbe"] == 0x400
    seen = {r.source_id: r for r in containers.inspect(parts, spark.createDataFrame([(0x41560001, "A game")], "title_id long, name string")).collect()}
    assert seen["ciso"].title == "A game" and seen["raw"].version == 7 and seen["bad"].status == "unresolved"
    again = sinks.to_cci(containers.sectors(parts).where("source_id = 'raw'").select("source_id", "sector_no", "data"), 4096)
    assert [bytes(r.content) for r in again.orderBy("name").collect()] == [p for _, p in sorted((f"raw.{i + 1}.cci", p) for i, p in enumerate(cci))]
    index = containers.index(parts).where("status = 'ok'").groupBy("source_id").count().collect()
    assert {r.source_id: r["count"] for r in index} == {"cci": len(IMAGE) // 2048, "ciso": len(IMAGE) // 2048}


def test_archive_tables(spark):
    files = [("s", "a/b.txt", b"one"), ("s", "a/c.bin", bytes(70_000)), ("s", "$SystemUpdate/x", b"no")]
    df = sinks.without_updates(spark.createDataFrame(files, "source_id string, path string, content binary"))
    out = containers.archive_files(sinks.to_archive(df).select("source_id", "name", "content")).collect()
    assert {(r.path, bytes(r.content)) for r in out} == {("a/b.txt", b"one"), ("a/c.bin", bytes(70_000))}


def test_batch_scan(spark, tmp_path):
    discs = {f"disc{n}": image(n, {"default.xex": xex(77, n, 2)}) for n in (1, 2)}
    whole = image(9, extra=400_000)
    third = len(whole) // 3 // 2048 * 2048
    split = {"p1": whole[:third], "p2": whole[third : 2 * third], "p3": whole[2 * third :]}
    files = {**discs, "solo": IMAGE, **split, "junk": b"z" * 999, "cci": formats.write_cci(IMAGE)[0], "no": b"x"}
    rows = [("b", n, d) for n, d in files.items()] + [("dup", f"d{i}", image(i, {"default.xex": xex(5, 1, 2)})) for i in (1, 2)]
    df = spark.createDataFrame(rows, "batch_id string, name string, content binary")
    got = batch_scan.scan(df).collect()
    b = [r for r in got if r.batch_id == "b"]
    assert sorted(n for r in b for n in r.names) == sorted(files)
    kinds = {tuple(r.names): r.kind for r in b}
    assert kinds[("disc1", "disc2")] == "multiDiscSet" and kinds[("solo",)] == "standalone" and kinds[("junk",)] == "unresolved"
    assert any(r.kind == "rawSplit" and set(r.names) == {"p1", "p2", "p3"} and r.names[0] == "p1" for r in b)
    assert {(r.kind, r.unresolved_kind) for r in got if r.batch_id == "dup"} == {("unresolved", "duplicateDiscClaim")}
    discs = next(r for r in b if r.kind == "multiDiscSet")
    assert (discs.title_id, discs.disc_count, [(d.name, d.disc_number) for d in discs.discs]) == ("0000004D", 2, [("disc1", 1), ("disc2", 2)])
    split = next(r for r in b if r.kind == "rawSplit")
    assert split.verify.ok and split.verify.root_offset == 0
    df.write.parquet(str(tmp_path / "in"))
    seen, errors = [], []
    watch(spark, str(tmp_path / "in"), str(tmp_path / "ck"), lambda rows, n: seen.extend(rows.collect()), errors).awaitTermination(120)
    assert len(seen) == len(got) and not errors
    first, rest = [], []
    watch(spark, str(tmp_path / "in"), str(tmp_path / "ck2"), lambda rows, n: rest.extend(rows.collect()), errors, lambda rows, n: first.extend(rows.collect())).awaitTermination(120)
    assert {(r.kind, *r.names) for r in first} == {("standalone", "solo"), ("unresolved", "cci"), ("unresolved", "no")}
    assert len(first) + len(rest) == len(got) and not errors and not {n for r in rest for n in r.names} & {"solo", "cci", "no"}
    failing, told = [], []
    watch(spark, str(tmp_path / "in"), str(tmp_path / "ck3"), lambda rows, n: told.append(rows.count()), failing, lambda rows, n: 1 / 0).awaitTermination(120)
    assert len(failing) == 1 and told == [len(rest)]


def test_parts_close_above_the_cap():
    """A compressed part is closed by the first sector that begins above its cap, so a part may reach past it; one whose
    position equals the cap goes on. The other format closes at its cap."""
    data = random.Random(2).randbytes(2048 * 6)
    sectors = lambda parts: [(len(p) - 32) // 2048 for p in parts]
    assert sectors(formats.write_cci(data, 32 + 2 * 2048)) == [3, 3]
    assert sectors(formats.write_cci(data, 31 + 2 * 2048)) == [2, 2, 2]
    head = 24 + 4 * 7
    sizes = lambda cap: [len(p) for p in formats.write_ciso(data, cap)]
    assert sizes(head + 2 * 2048)[0] == -(-(head + 2 * 2048) // 1024) * 1024 and sizes(head + 2 * 2048 + 1)[0] == -(-(head + 3 * 2048) // 1024) * 1024


def test_batch_rules():
    """Hash-tree folders, images without an executable, files that only look like one, ambiguous splits, named pairs."""
    whole = image(9, extra=400_000)
    cut = len(whole) // 2 // 2048 * 2048
    resolve = batch_scan.resolve
    bare = formats.write_volume({"a.bin": b"x"})
    assert [(r["kind"], r["unresolved_kind"]) for r in resolve([("bare", bare)])] == [("unresolved", "generic")]
    tree = formats.write_god(whole)[0]
    assert [(r["kind"], r["names"]) for r in resolve([("t/a.data/Data0000", tree[0])])] == [("godFolder", ["t/a.data/Data0000"])]
    two = [(f"t/{n}.data/Data0000", formats.write_god(image(n, {"default.xex": xex(5, n, 2)}))[0][0]) for n in (1, 2)]
    assert [(r["kind"], r["names"]) for r in resolve(two)] == [("multiDiscSet", [n for n, _ in two])]
    loose = [("disc2", image(2, {"default.xex": xex(5, 2, 2)}))]
    assert {r["kind"] for r in resolve([*two[:1], ("t/z.data/Data0000", b"no"), *loose])} == {"standalone", "unresolved"}
    looks = b"XBEH" + random.Random(1).randbytes(2044)
    volume = formats.write_volume({"default.xbe": xbe(), "n.bin": looks})
    at = volume.index(looks)
    assert [r["names"] for r in resolve([("h", volume[:at]), ("tail.xbe", volume[at:])])] == [["h", "tail.xbe"]]
    assert [r["kind"] for r in resolve([("h", volume[:at]), ("own.xbe", xbe())])] == ["unresolved"]
    several = resolve([("h", whole[:cut]), ("x", whole[cut:]), ("y", whole[cut:])])
    assert [(r["unresolved_kind"], sorted(r["names"])) for r in several] == [("ambiguousSplit", ["h", "x", "y"])]
    same = resolve([("h", whole[:cut]), ("x", whole[cut:]), ("X", whole[cut:])])
    assert [(r["kind"], len(r["names"])) for r in same] == [("rawSplit", 2), ("unresolved", 1)]
    other = image(10, extra=400_000)
    halves = [("a1", whole[:cut]), ("a2", whole[cut:]), ("b1", other[:cut]), ("b2", other[cut:])]
    assert sum(r["kind"] == "unresolved" for r in resolve(halves)) == 1  # either half fits either header, so the pairing is open
    exes = [formats.write_volume({"default.xbe": xbe(), "pad": bytes(100_000), "z.dll": b"MZ" + random.Random(n).randbytes(9000 * n)}) for n in (1, 2)]
    apart = [(f"{n}{k}", e[:at] if k == 1 else e[at:]) for n, e in zip("ab", exes) for at in [len(e) // 2 // 2048 * 2048] for k in (1, 2)]
    assert sorted(r["names"] for r in resolve(apart)) == [["a1", "a2"], ["b1", "b2"]]
    cci = formats.write_cci(whole, 60_000)
    pair = [("G.2.CCI", cci[1]), ("g.1.cci", cci[0]), ("other", b"0123456789")]
    entry = batch_scan.resolve_entry
    assert (entry(pair)["kind"], entry(pair)["names"], entry(pair)["format"]) == ("dir", ["g.1.cci", "G.2.CCI"], "cci")
    assert entry([("g.1.cci", cci[0]), ("g.2.cci", b"no")])["unresolved_kind"] == "mismatch"
    assert entry([("x", whole[cut:]), ("h", whole[:cut])])["names"] == ["h", "x"]
    assert (entry([("g.cci", cci[0]), *pair])["kind"], entry([("g.cci", cci[0])])["format"]) == ("file", "cci")
    assert entry([("x", whole[cut:]), ("h", whole[:cut]), ("h2", other[:cut])])["unresolved_kind"] == "ambiguousHeaders"


def test_narrow_batch_tables(spark):
    whole = image(9, extra=400_000)
    cut = len(whole) // 2 // 2048 * 2048
    rows = [("ok", 0, "h", whole[:cut]), ("ok", 1, "x", whole[cut:]), ("turned", 0, "x", whole[cut:]), ("turned", 1, "h", whole[:cut])]
    df = spark.createDataFrame(rows, "batch_id string, place int, name string, content binary")
    assert {r.batch_id: r.ok for r in batch_scan.check_orderings(df).collect()} == {"ok": True, "turned": False}
    assert {(r.batch_id, r.name): r.is_complete for r in batch_scan.check_completeness(df).collect()} == {("ok", "h"): False, ("turned", "h"): False}
    assert {(r.batch_id, r.kind, tuple(r.names)) for r in batch_scan.scan_entries(df).collect()} == {("ok", "dir", ("h", "x")), ("turned", "dir", ("h", "x"))}
    done = batch_scan.scan(spark.createDataFrame([("b", "solo", IMAGE), ("b", "other", image(4))], "batch_id string, name string, content binary"))
    left = batch_scan.reported_once(done, spark.createDataFrame([("b", "solo")], "batch_id string, name string"))
    assert [r.names for r in left.collect()] == [["other"]]


def test_codecs():
    text = bytes(range(256))
    assert codecs.to_windows_1252(codecs.from_windows_1252(text)) == text
    block = struct.pack("<HHI", 0xF800, 0x001F, 0b11_10_01_00)
    px = codecs.dxt1(4, 4, block)
    assert px[0, :4].tolist() == [[255, 0, 0, 255], [0, 0, 255, 255], [170, 0, 85, 255], [85, 0, 170, 255]]
    assert codecs.dxt1(4, 4, struct.pack("<HHI", 0, 1, 0xFFFFFFFF))[0, 0, 3] == 0
    morton = np.zeros(32, dtype=np.uint8)
    for y in range(4):
        for x in range(8):
            morton[(x & 1) | (y & 1) << 1 | (x & 2) << 1 | (y & 2) << 2 | (x & 4) << 2] = y * 8 + x
    assert codecs.unswizzle(8, 4, morton.tobytes(), 1)[..., 0].ravel().tolist() == list(range(32))
    assert codecs.run_lengths(b"abc", [(1, 2), (2, 1)]) == b"a\0\0bc\0"
    with pytest.raises(ValueError):
        codecs.run_lengths(b"abc", [(1, 1 << 40)])
    wide = codecs.colours_565(np.array([(v << 11) | (2 * v << 5) | v for v in range(32)]))
    assert [wide[v, 0] for v in (0, 3, 7, 20, 24, 25, 28, 29, 31)] == [0, 25, 58, 164, 197, 205, 230, 238, 255]
    assert all(abs(int(wide[v, 0]) - v * 255 / 31) < 0.75 and abs(int(wide[v, 1]) - 2 * v * 255 / 63) < 0.75 for v in range(32))
    assert codecs.dxt1(3, 5, block * 2).shape == (5, 3, 4) and codecs.dxt1(3, 5, block * 2)[0].tolist() == px[0, :3].tolist()
    assert codecs.dxt3(2, 2, bytes(8) + block).shape == (2, 2, 4)
    assert formats.xdbf_find(b"XDBF" + struct.pack(">IIIII", 1, 2, 1, 1, 0) + struct.pack(">HQII", 2, 9, 3, 2) + bytes(18 + 8) + b"...OK", 9, 2) == b"OK"


def test_package_listing():
    slot = lambda name, flags, parent: name.ljust(0x28, b"\0") + bytes([len(name) | flags]) + bytes(6) + (5).to_bytes(3, "little") + parent.to_bytes(2, "big") + (10).to_bytes(4, "big") + bytes(8)
    table = slot(b"dir", 0x80, 0xFFFF) + bytes(64) + slot(b"f.bin", 0x40, 0)
    assert formats.stfs_entries(table) == [(0, "dir", 0xFFFF, True, False, 5, 10), (2, "f.bin", 0, False, True, 5, 10)]


def test_hash_tree_round_trip():
    data = random.Random(4).randbytes(4096 * 37)
    parts, top = formats.write_god(data, subs=3, blocks=4)
    assert len(parts) == 4 and formats.read_god(parts, 3, 4) == data and formats.verify_god(parts, 4) == ""
    import hashlib

    for p, after in zip(parts, parts[1:]):
        assert p[60:80] == hashlib.sha1(after[:4096]).digest()
    assert top == hashlib.sha1(parts[0][:4096]).digest()
    assert formats.verify_god([parts[0][:-1] + b"\0", *parts[1:]], 4) != ""


def test_package_round_trip(spark):
    files = {"a/b/c.txt": b"one", "a/d.bin": bytes(9000), "e": b""}
    data = formats.write_stfs(files, 7, name="A name")
    assert {p: c for p, _, c in formats.stfs_files(data)} == files
    assert formats.stfs_header(data)["display_name"] == "A name"
    df = spark.createDataFrame([("p", k, v) for k, v in files.items()], "source_id string, path string, content binary")
    out = containers.package_files(sinks.to_package(df).select("source_id", "name", "content"))
    assert {(r.path, bytes(r.content)) for r in out.collect()} == set(files.items())
    sectors = spark.createDataFrame([("g", i, bytes([i]) * 2048) for i in range(8)], "source_id string, sector_no long, data binary")
    back = containers.hash_tree_sectors(sinks.to_hash_tree(sectors).select("source_id", "name", "content"))
    assert [bytes(r.data) for r in back.orderBy("sector_no").collect()] == [bytes([i]) * 2048 for i in range(8)]


def test_package_metadata(spark):
    data = bytearray(formats.write_stfs({"x" * 50: b"one"}, 7, name="A name"))
    assert formats.stfs_files(bytes(data))[0][0] == "x" * 40  # a slot's name is cut
    assert formats.stfs_metadata(bytes(data))["thumbnail"] is None and formats.stfs_metadata(bytes(data))["avatar_skeleton"] is None
    png = b"\x89PNG\r\n\x1a\n" + bytes(90)
    data[0x36C:0x371], data[0x3D9:0x3F2] = b"12345", struct.pack("<II", 5, 6) + bytes(range(16)) + b"\2"
    for size, at in ((0x1712, 0x171A), (0x1716, 0x571A)):
        struct.pack_into(">I", data, size, len(png))
        data[at : at + len(png)] = png
    struct.pack_into(">III", data, 0x971A, 0x54555044, 0x10000100, 0x20000200)
    m = formats.stfs_metadata(bytes(data))
    assert (m["console_id"], m["thumbnail"], m["title_thumbnail"], m["avatar_category"], m["avatar_guid"], m["avatar_skeleton"]) == (b"12345", png, png, 5, bytes(range(16)), 2)
    assert (m["installer"], m["installer_base_version"], m["installer_version"]) == ((None,) * 3 if 0xB000 - 0x971A < 0x15F4 else ("titleUpdate", 0x10000100, 0x20000200))
    struct.pack_into(">I", data, 0x1712, 0x3D01)
    data[0x571A] = 0
    assert formats.stfs_metadata(bytes(data))["thumbnail"] is None and formats.stfs_metadata(bytes(data))["title_thumbnail"] is None
    row = containers.package_metadata(parts_of(spark, [("p", "a", bytes(data)), ("q", "b", b"no")])).orderBy("source_id").collect()
    assert (bytes(row[0].console_id), row[0].avatar_skeleton, row[1].status) == (b"12345", 2, "unresolved")


@pytest.mark.parametrize("blocks", [169, 170, 171, 28_899, 28_900, 57_900])
def test_package_of_more_than_one_hash_table(blocks):
    """All levels of tables: each block's and each table's digest is where the addresses say, up to the header's."""
    import hashlib

    content = b"".join(i.to_bytes(4, "big") * 1024 for i in range(blocks - 1))
    data = formats.write_stfs({"a.bin": content[: 4096 * 5], "b.bin": content[4096 * 5 :]})
    assert [(p, c) for p, _, c in formats.stfs_files(data)] == [("a.bin", content[: 4096 * 5]), ("b.bin", content[4096 * 5 :])]
    block = lambda i: data[0xB000 + 4096 * i : 0xB000 + 4096 * (i + 1)]
    record = lambda table, i: block(table)[24 * (i % 170) : 24 * (i % 170) + 20]
    sha = lambda i: hashlib.sha1(block(i)).digest()
    level = (blocks > 170) + (blocks > 28_900)
    middle = lambda i: 171 if i < 28_900 else 1 + i // 28_900 * 29_071
    assert all(record(formats.stfs_backing(i - i % 170, 0) - 1, i) == sha(formats.stfs_backing(i, 0)) for i in range(blocks))
    if level > 0:
        assert all(record(middle(i), i // 170) == sha(formats.stfs_backing(i, 0) - 1) for i in range(0, blocks, 170))
        assert all(int.from_bytes(block(middle(i))[4080:4084], "big") == min(28_900, blocks - i) for i in range(0, blocks, 28_900))
    if level > 1:
        assert all(record(29_071, i // 28_900) == sha(middle(i)) for i in range(0, blocks, 28_900))
        assert int.from_bytes(block(29_071)[4080:4084], "big") == blocks
    assert data[0x381:0x395] == sha((0, 171, 29_071)[level])


def test_executable_layout(spark):
    info = struct.pack(">I", 36) + b"41560001" + struct.pack(">II", 0x82000000, 77) + b"icon\0\0\0\0" + struct.pack(">II", 0x82000100, 5)
    form = struct.pack(">IHH", 8 + 24, 0, 1) + struct.pack(">IIIIII", 3, 2, 2, 1, 0, 0)
    fields = {0x2FF: info, 0x3FF: form, 0x40006: struct.pack(">IIII", 1, 2, 3, 0x41560001) + bytes(16)}
    head, at, table = b"", 24 + 8 * (len(fields) + 1), b""
    for k, v in fields.items():
        table += struct.pack(">II", k, at + len(head))
        head += v
    table += struct.pack(">II", 0x10201, 0x82000000)
    data = b"XEX2" + struct.pack(">IIIII", 0, at + len(head), 0, 0, 4) + table + head + b"abcde"
    x = formats.xex_layout(data)
    assert (x["compression"], x["runs"], x["encrypted"], x["load_address"], x["title_id"]) == ("basic", [(3, 2), (2, 1)], False, 0x82000000, 0x41560001)
    assert formats.xex_resources(data) == [("41560001", 0x82000000, 77), ("icon", 0x82000100, 5)] and formats.xex_body(data) == b"abc\0\0de\0"
    rows = containers.executables(parts_of(spark, [("a", "x", data), ("b", "x", data[:30])])).orderBy("source_id").collect()
    assert (rows[0].compression, [tuple(r) for r in rows[0].runs], rows[1].status) == ("basic", [(3, 2), (2, 1)], "unresolved")
    assert {r.name for r in containers.executable_resources(parts_of(spark, [("a", "x", data)])).collect()} == {"41560001", "icon"}


def test_thumbnails_and_table_functions(spark):
    from blockloom.sources import udtfs

    texture = b"XPR0" + struct.pack("<IIIII", 100, 36, 0x40001, 0, 0) + struct.pack("<BBBBII", 0, 6, 0, 2, 0, 0xFFFFFFFF) + bytes(range(64))
    exe = bytearray(xbe(size=0x800))
    struct.pack_into("<II", exe, 0x11C, 2, 0x10000 + 0x400)
    for i, (name, at, body) in enumerate([(b"$$XTIMAGE\0", 0x600, b"no texture"), (b"$$XSIMAGE\0", 0x640, texture)]):
        struct.pack_into("<III", exe, 0x400 + 56 * i + 12, at, len(body), 0x10000 + 0x500 + 16 * i)
        exe[0x500 + 16 * i : 0x500 + 16 * i + len(name)] = name
        exe[at : at + len(body)] = body
    assert formats.thumbnail(bytes(exe)) == codecs.png(codecs.xpr_pixels(texture)) and formats.thumbnail(xbe()) is None
    xdbf = b"XDBF" + struct.pack(">IIIII", 1, 1, 1, 1, 0) + struct.pack(">HQII", 2, 0x8000, 0, 4) + bytes(8) + b"PNG!"
    body = b"MZ" + bytes(14) + xdbf
    info = struct.pack(">I", 20) + b"12345678" + struct.pack(">II", 0x1010, len(xdbf))
    at = 24 + 16
    head = b"XEX2" + struct.pack(">IIIII", 0, at + len(info), 0, 0, 2) + struct.pack(">IIII", 0x2FF, at, 0x10201, 0x1000) + info
    assert formats.thumbnail(head + body) == b"PNG!" and formats.thumbnail(head + b"no" + body[2:]) is None and formats.thumbnail(b"XEX2") is None
    udtfs.register(spark)
    parts_of(spark, [("image", "a", IMAGE), ("zip", "b", formats.write_zar({"x/y": b"one"})), ("bad", "c", b"no"), ("null", "d", None)]).createOrReplaceTempView("boxes")
    rows = spark.sql("SELECT source_id, e.* FROM boxes, LATERAL container_entries(content) e").collect()
    assert {r.path for r in rows if r.source_id == "image"} >= {"default.xbe", "data/deep/b.txt"} and {r.source_id for r in rows if r.reason} == {"zip", "bad", "null"}
    rows = spark.sql("SELECT source_id, e.* FROM boxes, LATERAL container_files(content) e").collect()
    assert [(r.path, bytes(r.content)) for r in rows if r.source_id == "zip"] == [("x/y", b"one")] and sum(r.reason is not None for r in rows) == 3


def test_god_folder_and_header(spark):
    import hashlib

    source = image(3, {"default.xex": xex(0x4D530001, 2, 3)})
    rows = sinks.to_god(spark.createDataFrame([("g", source), ("bare", formats.write_volume({"a": b"x"}))], "source_id string, content binary")).collect()
    assert [r.name for r in rows if r.source_id == "bare"] == ["no executable found in this image"]
    files = {r.name: bytes(r.content) for r in rows if r.source_id == "g"}
    stem = "4D530001/00007000/00000001"
    assert set(files) == {f"{stem}.data/Data0000", stem} and (head := files[stem])[:4] == b"LIVE"
    assert hashlib.sha1(head[0x344:]).digest() == head[0x32C:0x340] and hashlib.sha1(files[f"{stem}.data/Data0000"][:4096]).digest() == head[0x37D:0x391]
    assert (head[0x366], head[0x367], int.from_bytes(head[0x392:0x395], "big"), int.from_bytes(head[0x3A0:0x3A4], "little")) == (2, 3, -(-len(source) // 4096), 1)
    assert [r["kind"] for r in batch_scan.resolve([(n, d) for n, d in files.items() if "Data" in n])] == ["godFolder"]


def test_scrubbing_and_streams(spark):
    data = {"ogx": image(1), "x360": formats.write_volume({"default.xex": xex(1, 1, 1), "z": b"z" * 9000}), "none": formats.write_volume({"a": b"x" * 5000})}
    rows = [(k, f"{k}.iso", v + bytes(4096) + b"rest" * 512) for k, v in data.items()]
    parts = parts_of(spark, rows)
    found = containers.entries(parts).where("status = 'ok'").selectExpr("source_id AS image_id", "path", "attributes", "monotonically_increasing_id() AS position", "sector", "size")
    images = spark.createDataFrame([(k, 33, 2048, 0, len(c)) for k, _, c in rows], "image_id string, root_sector int, root_size int, root_offset long, file_size long")
    sectors = containers.sectors(parts).selectExpr("source_id AS image_id", "sector_no", "data")
    for mode in ("trim", "zero", "partial"):
        out = {}
        for r in sorted(sinks.scrubbed(sectors, found, images, mode).collect(), key=lambda r: (r.image_id, r.sector_no)):
            out[r.image_id] = out.get(r.image_id, b"") + bytes(r.data)
        assert set(out) == {"ogx", "x360"}
        for k, got in out.items():
            whole = dict((n, c) for n, _, c in rows)[k]
            want = whole if mode == "zero" else data[k]
            assert len(got) == len(want)
            blank = k == "ogx" and mode != "trim"
            assert got == (bytes(32 * 2048) + data[k][32 * 2048 :] + bytes(len(want) - len(data[k])) if blank else want)
    told = []
    pieces = list(sinks.stream(parts, 5000, lambda done, total: told.append((done, total))))
    for k, name, c in rows:
        assert b"".join(d for s, n, d in pieces if (s, n) == (k, name)) == c
    assert told[-1] == (sum(len(c) for _, _, c in rows),) * 2 and all(len(d) <= 5000 for _, _, d in pieces)


@pytest.mark.parametrize("cap", [1 << 30, 9000, 4096, 100])
def test_pieces_equal_whole_parts(spark, cap):
    images = {"a": IMAGE, "b": bytes(2048), "c": random.Random(8).randbytes(2048 * 40)}
    rows = [(k, i, v[i * 2048 :][:2048]) for k, v in images.items() for i in range(len(v) // 2048)]
    got = {}
    for r in sorted(streams.cci_pieces(spark.createDataFrame(rows, "source_id string, sector_no long, data binary").repartition(3), cap).collect(), key=lambda r: (r.name, r.piece_no)):
        got[r.name] = got.get(r.name, b"") + bytes(r.data)
    want = {}
    for k, v in images.items():
        parts = formats.write_cci(v, cap)
        want |= {formats.part_name(k, i, len(parts), "cci"): p for i, p in enumerate(parts)}
    assert got == want


def test_parts_that_stand_alone(spark):
    """Sectors keep their numbers over parts that are read apart; a source of parts that aren't whole sectors is read whole."""
    cut = [IMAGE[:5000], IMAGE[5000:]]
    rows = [("cci", f"g.{i + 1}.cci", p) for i, p in enumerate(formats.write_cci(IMAGE, 9000))] + [("ragged", f"g.{i}", p) for i, p in enumerate(cut)]
    rows += [("raw", f"g.{i}", IMAGE[at : at + 4096]) for i, at in enumerate(range(0, len(IMAGE), 4096))] + [("twice", "same", IMAGE[:4096]), ("twice", "same", IMAGE[4096:])]
    found = containers.sectors(parts_of(spark, rows).repartition(5)).collect()
    for s in ("cci", "ragged", "raw"):
        assert b"".join(bytes(r.data) for r in sorted((r for r in found if r.source_id == s), key=lambda r: r.sector_no)) == IMAGE
    assert sum(r.source_id == "twice" for r in found) == len(IMAGE) // 2048


def test_raw_parts_beyond_nine_keep_their_order(spark):
    """Names of raw parts end in two extensions; the number before both orders them, not the name."""
    data = random.Random(8).randbytes(25 * 2048)
    cut = spark.createDataFrame([("r", i, data[i * 2048 : (i + 1) * 2048]) for i in range(25)], "source_id string, sector_no long, data binary")
    for cap in (2048, 3000):
        parts = sinks.to_raw(cut, cap)
        assert {r.name for r in parts.collect()} >= {f"r.{i}.xiso.iso" for i in range(1, 18)}
        assert [bytes(r.data) for r in containers.sectors(parts).orderBy("sector_no").collect()] == [data[i : i + 2048] for i in range(0, len(data), 2048)]


def test_sectors_makes_parts_once(spark):
    """Parts are taken from one exchange by what looks at their headers and by both ways of reading them."""
    made, data = spark.sparkContext.accumulator(0), random.Random(8).randbytes(9 * 2048)

    def make(given):
        for batch in given:
            for s in batch.column("id").to_pylist():
                parts = formats.write_ciso(data, 6000) if s % 3 == 0 else formats.write_cci(data, 6000) if s % 3 == 1 else formats.split_raw(data, 6144)
                made.add(len(parts))
                yield pa.RecordBatch.from_pylist([{"source_id": str(s), "name": f"g.{i + 1}.x", "content": p} for i, p in enumerate(parts)])

    found = containers.sectors(spark.range(9).mapInArrow(make, "source_id string, name string, content binary")).collect()
    for s in range(9):
        assert b"".join(bytes(r.data) for r in sorted((r for r in found if r.source_id == str(s)), key=lambda r: r.sector_no)) == data
    assert made.value == 3 * sum(len(p) for p in (formats.write_ciso(data, 6000), formats.write_cci(data, 6000), formats.split_raw(data, 6144)))


def test_many_sources_go_through_a_task(spark, sf):
    """Writers and readers take sources out of a stream of sorted rows, whatever batches it comes in, and not by a call each."""
    plan = entry.queries()["q_sector_round_trip"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "MapInArrow" in plan and "Join" not in plan
    sectors, parts = (plan.count(f"Exchange hashpartitioning({k}") for k in ("source_id", "_part"))
    assert sectors == 3 and parts == 0  # parts are read where they were written
    images = {f"s{n}": random.Random(n).randbytes(2048 * (n % 5 + 1)) for n in range(40)} | {None: bytes(2048 * 3)}
    rows = [(k, i, v[i * 2048 :][:2048]) for k, v in images.items() for i in range(len(v) // 2048)]
    cut = spark.createDataFrame(rows, "source_id string, sector_no long, data binary").repartition(5)
    for most in (1, 3, 7):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        try:
            for parts in (sinks.to_ciso(cut, 3000), sinks.to_raw(cut, 4096), sinks.to_cci(cut, 3000)):
                for together in (False, True):
                    got = {}
                    for r in sorted(containers.sectors(parts, together).collect(), key=lambda r: r.sector_no):
                        assert r.status == "ok"
                        got[r.source_id] = got.get(r.source_id, b"") + bytes(r.data)
                    assert got == images
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_batches_by_key():
    keys, rng = [None, "a", "a", "b", "c", "c", "c", "d"], random.Random(2)
    data = [rng.randbytes(9) for _ in keys[1:]] + [None]
    table = pa.table({"k": pa.array(keys, pa.string()), "n": pa.array(range(len(keys))), "data": pa.array(data, pa.binary())})
    for size in range(1, len(keys) + 1):
        found = list(batches.by_key([pa.RecordBatch.from_pylist([], table.schema), *table.to_batches(size)], "k"))
        assert [k for k, _ in found] == [None, "a", "b", "c", "d"] and [n for _, g in found for n in g["n"]] == list(range(len(keys))) and [d for _, g in found for d in g["data"]] == data
    rows = [(i, bytes(rng.choice((0, 9, 3 << 20, 9 << 20)))) for i in range(60)] + [(i, b"") for i in range(60, 10_000)]
    out = list(batches.batched(iter(rows), pa.schema([("i", pa.int64()), ("b", pa.binary())])))
    assert [(r["i"], r["b"]) for b in out for r in b.to_pylist()] == rows
    assert all(b.num_rows <= batches.MOST_ROWS and (b.num_rows == 1 or sum(len(x.as_py()) for x in b.column("b")[: b.num_rows - 1]) < batches.MOST_BYTES) for b in out)


def test_textures_and_sections():
    body = bytes(range(64))
    head = lambda code, side, flags=0x40001, size=36 + 64: b"XPR0" + struct.pack("<IIIII", size, 36, flags, 0, 0) + struct.pack("<BBBBII", 0, code, 0, side, 0, 0xFFFFFFFF)
    for code, side, size in ((0x06, 2, 64), (0x07, 2, 64), (0x3C, 2, 64), (0x05, 2, 32), (0x04, 2, 32), (0x0C, 2, 8), (0x0E, 2, 16), (0x0C, 0, 8), (0x0C, 1, 8)):
        px = codecs.xpr_pixels(head(code, side) + body[:size])
        assert px.shape == (1 << side, 1 << side, 4) and codecs.png(px)[:8] == b"\x89PNG\r\n\x1a\n"
    assert codecs.xpr_pixels(head(0x3C, 2) + body)[0, 0].tolist() == [3, 2, 1, 0]
    for bad in (head(0x07, 2, flags=0x40002) + body, head(0x07, 2, size=36 + 63) + body, head(0x07, 11) + body, head(0x02, 2) + body, head(0x07, 2)[:35]):
        with pytest.raises(ValueError):
            codecs.xpr_pixels(bad)
    assert codecs.xpr_pixels(head(0x07, 2) + body)[0, 0].tolist() == [2, 1, 0, 255]
    with pytest.raises(ValueError):
        codecs.xpr_pixels(head(0x33, 2) + body)
    exe = bytearray(xbe(size=0x800))
    struct.pack_into("<II", exe, 0x11C, 1, 0x10000 + 0x400)
    struct.pack_into("<III", exe, 0x400 + 12, 0x600, 5, 0x10000 + 0x500)
    exe[0x500:0x506], exe[0x600:0x605] = b".text\0", b"hello"
    assert formats.xbe_sections(bytes(exe)) == {".text": b"hello"}
