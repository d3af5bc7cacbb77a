"""Readers and writers of container formats over bytes. Every malformed input raises ValueError; the Spark sources turn
that into a row with a reason."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from blockloom.functions.codecs import from_windows_1252, lz4_block, lz4_unblock, png, run_lengths, to_windows_1252, unzstd, xpr_pixels, zstd

SECTOR = 2048
VOLUME_MAGIC = b"MICROSOFT*XBOX*MEDIA"
#: Where a volume may begin, in the order they are tried.
ROOT_OFFSETS = [("xsf", 0), ("xgd2", 0xFD90000), ("xgd1", 0x18300000), ("xgd3", 0x2080000)]
#: Fixed values of the archive format.
ZAR_MAGIC, ZAR_VERSION, ZAR_BLOCK, ZAR_SLOTS, ZAR_FOOTER = 0x169F52D6, 0x61BF3A01, 65536, 16, 144
CCI_CAP, CISO_CAP, RAW_CAP = 0xFF000000, 0xFFBF6000, 0xFF000000


def need(ok: bool, reason: str) -> None:
    if not ok:
        raise ValueError(reason)


def detect(head: bytes, tail: bytes, size: int) -> str:
    """Format by the first four bytes, else by the last four of a file that may hold a footer, else a raw image."""
    need(size >= 4, "file is shorter than a magic number")
    for magic, name in ((b"CISO", "ciso"), (b"CCIM", "cci"), (b"CON ", "stfs"), (b"LIVE", "stfs"), (b"PIRS", "stfs")):
        if head[:4] == magic:
            return name
    return "zar" if size > ZAR_FOOTER and tail[-4:] == ZAR_MAGIC.to_bytes(4, "big") else "xiso"


# --- sector containers


def pad_to(n: int, to: int) -> int:
    return -n % to


def part_name(stem: str, index: int, total: int, ext: str) -> str:
    return f"{stem}.{ext}" if total <= 1 else f"{stem}.{index + 1}.{ext}"


def cci_slot(sector: bytes) -> tuple[bytes, bool]:
    """How a sector is stored: compressed, with the length of the padding before and the padding behind, or as it is."""
    packed = lz4_block(sector)
    if not 0 < len(packed) < SECTOR - 8:
        return sector, False
    pad = pad_to(len(packed) + 1, 4)
    return bytes([pad]) + packed + bytes(pad), True


def write_cci(image: bytes, cap: int = CCI_CAP) -> list[bytes]:
    """Parts of header, slots and index. A part is closed once its position is above cap."""
    need(len(image) % SECTOR == 0, "image isn't in whole sectors")
    parts: list[tuple[list[bytes], list[int]]] = []
    body: list[bytes] = []
    words: list[int] = []
    at = 32
    for lo in range(0, len(image), SECTOR):
        slot, small = cci_slot(image[lo : lo + SECTOR])
        if at > cap:
            parts.append((body, words))
            body, words, at = [], [], 32
        words.append((at >> 2) | (small << 31))
        body.append(slot)
        at += len(slot)
    parts.append((body, words))
    out = []
    for body, words in parts:
        data = b"".join(body)
        end = 32 + len(data)
        head = struct.pack("<4sIQQIBBH", b"CCIM", 32, len(body) * SECTOR, end, SECTOR, 1, 2, 0)
        out.append(head + data + struct.pack(f"<{len(words) + 1}I", *words, end >> 2))
    return out


def cci_index(part: bytes) -> tuple[list[int], list[bool]]:
    need(len(part) >= 32, "header is cut off")
    magic, header, size, index, block, version, align, _ = struct.unpack_from("<4sIQQIBBH", part)
    need((magic, header, block, version, align) == (b"CCIM", 32, SECTOR, 1, 2), "header fields differ from the format's")
    n = size // SECTOR
    need(size % SECTOR == 0 and index + 4 * (n + 1) <= len(part), "index is cut off")
    words = struct.unpack_from(f"<{n + 1}I", part, index)
    at, flags = [(w & 0x7FFFFFFF) << 2 for w in words], [bool(w >> 31) for w in words[:-1]]
    need(all(a <= b for a, b in zip(at, at[1:])) and at[-1] == index, "positions fall or don't end at the index")
    return at, flags


def read_cci(part: bytes) -> Iterator[bytes]:
    at, flags = cci_index(part)
    for lo, hi, flag in zip(at, at[1:], flags):
        if not flag and hi - lo == SECTOR:
            yield part[lo:hi]
            continue
        need(hi > lo and hi - lo > part[lo], "slot is empty or all padding")
        yield lz4_unblock(part[lo + 1 : hi - part[lo]], SECTOR)


def write_ciso(image: bytes, cap: int = CISO_CAP, align: int = 2) -> list[bytes]:
    """Parts over one index in the first. A stored block is the length of its LZ4 block and the block."""
    need(len(image) % SECTOR == 0, "image isn't in whole sectors")
    n = len(image) // SECTOR
    parts, words = [bytearray(24 + 4 * (n + 1))], []
    for i in range(n):
        sector = image[i * SECTOR : (i + 1) * SECTOR]
        packed = lz4_block(sector)
        small = len(packed) + 4 + 12 < SECTOR
        parts[-1] += bytes(pad_to(len(parts[-1]), 1 << align))
        if len(parts[-1]) >= cap and i:
            parts.append(bytearray())
        words.append((len(parts[-1]) >> align) | (small << 31))
        parts[-1] += struct.pack("<I", len(packed)) + packed if small else sector
    parts[-1] += bytes(pad_to(len(parts[-1]), 1 << align))
    words.append(len(parts[-1]) >> align)
    parts = [p + bytes(pad_to(len(p), 0x400)) for p in parts]
    parts[0][:24] = struct.pack("<4sIQIBBH", b"CISO", 24, len(image), SECTOR, 2, align, 0)
    struct.pack_into(f"<{n + 1}I", parts[0], 24, *words)
    return [bytes(p) for p in parts]


def ciso_index(first: bytes) -> tuple[list[int], list[bool], list[int]]:
    """Positions, flags, and the sector each part begins with: where a position is below the one before."""
    need(len(first) >= 24, "header is cut off")
    magic, _, size, block, _, align, _ = struct.unpack_from("<4sIQIBBH", first)
    need(magic == b"CISO" and block == SECTOR and align < 32, "header fields differ from the format's")
    n = size // SECTOR
    need(24 + 4 * (n + 1) <= len(first), "index is cut off")
    words = struct.unpack_from(f"<{n + 1}I", first, 24)
    at = [(w & 0x7FFFFFFF) << align for w in words]
    return at, [bool(w >> 31) for w in words[:-1]], [0] + [i for i in range(1, n) if at[i] < at[i - 1]]


def ciso_parts(parts: list[bytes]) -> tuple[list[int], list[bool], list[int]]:
    """The index, after a look at whether there are as many parts as it has."""
    at, flags, starts = ciso_index(parts[0])
    need(len(starts) <= len(parts), "fewer parts than the index has")
    return at, flags, starts


def read_ciso(parts: list[bytes]) -> Iterator[bytes]:
    at, flags, starts = ciso_parts(parts)
    p = -1
    for i, flag in enumerate(flags):
        if p + 1 < len(starts) and starts[p + 1] == i:
            p += 1
        data = parts[p]
        if not flag:
            need(at[i] + SECTOR <= len(data), "sector reaches past its part")
            yield data[at[i] : at[i] + SECTOR]
            continue
        need(at[i] + 4 <= len(data), "block reaches past its part")
        size = struct.unpack_from("<I", data, at[i])[0]
        need(at[i] + 4 + (size & 0x7FFFFFFF) <= len(data), "block reaches past its part")
        body = data[at[i] + 4 : at[i] + 4 + (size & 0x7FFFFFFF)]
        yield body if size >> 31 else lz4_unblock(body, SECTOR)


def split_raw(image: bytes, cap: int = RAW_CAP) -> list[bytes]:
    return [image[lo : lo + cap] for lo in range(0, len(image), cap)] or [b""]


# --- volumes


@dataclass
class Volume:
    kind: str
    root_offset: int
    root_sector: int
    root_size: int
    entries: list[tuple]  # (path, name, attributes, sector, size)
    walked: bool
    reason: str = ""

    @property
    def extent(self) -> int:
        """Bytes from the volume's start that its tables and files take."""
        return max([self.root_sector * SECTOR + self.root_size, *(s * SECTOR + n for _, _, _, s, n in self.entries)])


def read_volume(read: Callable[[int, int], bytes]) -> Volume | None:
    """The first candidate whose magic is there; None without one. A walk that fails leaves no entries and a reason."""
    for kind, at in ROOT_OFFSETS:
        head = read(at + 32 * SECTOR, 28)
        if head[:20] == VOLUME_MAGIC and len(head) == 28:
            sector, size = struct.unpack_from("<II", head, 20)
            try:
                return Volume(kind, at, sector, size, walk(read, at, sector, size), True)
            except ValueError as e:
                return Volume(kind, at, sector, size, [], False, str(e))
    return None


def walk(read: Callable[[int, int], bytes], base: int, root_sector: int, root_size: int) -> list[tuple]:
    stack, seen, out = [("", root_sector, root_size)], {root_sector}, []
    while stack:
        above, sector, size = stack.pop()
        data, at = read(base + sector * SECTOR, size), 0
        need(len(data) == size, "directory reaches past the image")
        while at + 14 <= size:
            left, right, start, length, attributes, n = struct.unpack_from("<HHIIBB", data, at)
            if left == right == 0xFFFF:
                at += SECTOR - at % SECTOR  # padding up to the next sector
                continue
            need(n > 0 and at + 14 + n <= size, "entry's name is cut off")
            name = from_windows_1252(data[at + 14 : at + 14 + n])
            need("\0" not in name and "/" not in name, "entry's name isn't valid")
            path = f"{above}/{name}" if above else name
            out.append((path, name, attributes, start, length))
            if attributes & 0x10 and length and start not in seen:
                seen.add(start)
                stack.append((path, start, length))
            at += 14 + n + pad_to(14 + n, 4)
    return out


def write_volume(files: dict[str, bytes], root_offset: int = 0) -> bytes:
    """A volume of these paths: each directory a right-leaning table in sectors of its own, then the files."""
    tree: dict = {}
    for path, data in files.items():
        *dirs, name = path.split("/")
        at = tree
        for d in dirs:
            at = at.setdefault(d, {})
        at[name] = data
    tables: list[tuple[dict, int, int]] = []
    sector = 33

    def size_of(folder: dict) -> int:
        return sum(14 + len(n) + pad_to(14 + len(n), 4) for n in folder)

    def place(folder: dict) -> None:
        nonlocal sector
        size = size_of(folder)
        need(size <= SECTOR, "directory is larger than a sector")
        tables.append((folder, sector, SECTOR if folder else 0))
        sector += 1
        for x in folder.values():
            if isinstance(x, dict):
                place(x)

    place(tree)
    where = {id(f): (s, n) for f, s, n in tables}
    blob: dict[int, bytes] = {}
    for folder, at, _ in tables:
        rows, offset = bytearray(), 0
        names = sorted(folder, key=str.lower)
        for i, name in enumerate(names):
            raw = to_windows_1252(name)
            step = 14 + len(raw) + pad_to(14 + len(raw), 4)
            x = folder[name]
            if isinstance(x, dict):
                start, length, attributes = *where[id(x)], 0x10
            else:
                start, length, attributes = sector, len(x), 0x20
                blob[sector] = x
                sector += max(1, -(-len(x) // SECTOR))
            right = (offset + step) // 4 if i + 1 < len(names) else 0
            rows += struct.pack("<HHIIBB", 0, right, start, length, attributes, len(raw)) + raw + b"\xff" * pad_to(14 + len(raw), 4)
            offset += step
        blob[at] = bytes(rows).ljust(SECTOR, b"\xff")
    out = bytearray(root_offset + sector * SECTOR)
    head = VOLUME_MAGIC + struct.pack("<II", 33, where[id(tree)][1])
    out[root_offset + 32 * SECTOR : root_offset + 32 * SECTOR + len(head)] = head
    for at, data in blob.items():
        out[root_offset + at * SECTOR : root_offset + at * SECTOR + len(data)] = data
    return bytes(out)


# --- archives


def safe(name: str) -> bool:
    return bool(name) and name not in (".", "..") and not any(c in name for c in "/\\\0")


def write_zar(files: dict[str, bytes]) -> bytes:
    """Blocks over the concatenated files, offset records, names, a breadth-first tree, and a footer with the digest."""
    root: dict = {}
    for path, data in files.items():
        at = root
        *dirs, name = path.split("/")
        for d in dirs:
            key = next((k for k in at if k.lower() == d.lower()), d)
            at = at.setdefault(key, {})
            need(isinstance(at, dict), f"a file is used as a folder: {path}")
        need(all(map(safe, (*dirs, name))), f"unsafe path: {path}")
        need(not any(k.lower() == name.lower() for k in at), f"duplicate path: {path}")
        at[name] = data
    names, offsets = bytearray(), {}

    def intern(name: str) -> int:
        if name not in offsets:
            raw = to_windows_1252(name)
            offsets[name] = len(names)
            names.extend(([len(raw)] if len(raw) < 128 else [0x80 | len(raw) & 0x7F, len(raw) >> 7]) + list(raw))
        return offsets[name]

    starts, total = {}, 0
    for path, data in files.items():
        starts[path.lower()] = total
        total += len(data)
    stream = b"".join(files.values())
    blocks = [stream[i : i + ZAR_BLOCK].ljust(ZAR_BLOCK, b"\0") for i in range(0, len(stream), ZAR_BLOCK)]
    stored = [p if len(p := zstd(b)) < ZAR_BLOCK else b for b in blocks]
    body = bytearray(b"".join(stored))
    body += bytes(pad_to(len(body), 8))
    records, base = bytearray(), 0
    for i in range(0, len(stored), ZAR_SLOTS):
        group = stored[i : i + ZAR_SLOTS]
        records += struct.pack(">Q16H", base, *([len(x) - 1 for x in group] + [0] * (ZAR_SLOTS - len(group))))
        base += sum(map(len, group))
    queue, rows, following = [("", root, "")], [], 1
    while queue:
        name, node, path = queue.pop(0)
        label = 0x7FFFFFFF if not rows else intern(name)
        if isinstance(node, dict):
            rows.append(struct.pack(">IIII", label, following, len(node), 0))
            for child in sorted(node, key=str.lower):
                queue.append((child, node[child], f"{path}/{child}" if path else child))
            following += len(node)
        else:
            start, size = starts[path.lower()], len(node)
            rows.append(struct.pack(">IIIHH", label | 0x80000000, start & 0xFFFFFFFF, size & 0xFFFFFFFF, size >> 32, start >> 32))
    sections, out = [], bytearray()
    for part in (body, records, names, b"".join(rows), b"", b""):
        sections += [len(out), len(part)]
        out += part
    footer = lambda digest: struct.pack(">12Q32sQII", *sections, digest, len(out) + ZAR_FOOTER, ZAR_VERSION, ZAR_MAGIC)
    return bytes(out) + footer(hashlib.sha256(bytes(out) + footer(bytes(32))).digest())


def zar_files(data: bytes) -> list[tuple[str, int, int]]:
    """(path, start, size) of each file, in breadth-first order."""
    need(len(data) > ZAR_FOOTER, "footer is cut off")
    *s, _, total, version, magic = struct.unpack(">12Q32sQII", data[-ZAR_FOOTER:])
    need((magic, version, total) == (ZAR_MAGIC, ZAR_VERSION, len(data)), "footer fields differ from the format's")
    sections = list(zip(s[::2], s[1::2]))
    need(all(o + n <= len(data) for o, n in sections), "a section reaches past the file")
    names, tree = (data[o : o + n] for o, n in sections[2:4])
    need(len(tree) >= 16 and len(tree) % 16 == 0, "tree is empty or ragged")
    rows = [struct.unpack_from(">IIII", tree, i) for i in range(0, len(tree), 16)]
    need(not rows[0][0] >> 31, "first entry isn't a folder")

    def name(at: int) -> str:
        need(at < len(names), "name lies outside the table")
        n, at = names[at], at + 1
        if n & 0x80:
            need(at < len(names), "name's length is cut off")
            n, at = n & 0x7F | names[at] << 7, at + 1
        need(at + n <= len(names), "name is cut off")
        text = from_windows_1252(names[at : at + n])
        need(safe(text), "unsafe name")
        return text

    out, queue, seen = [], [(0, "")], {0}
    while queue:
        i, above = queue.pop(0)
        _, first, count, _ = rows[i]
        need(first + count <= len(rows), "children lie outside the tree")
        for j in range(first, first + count):
            label, a, b, c = rows[j]
            path = f"{above}/{name(label & 0x7FFFFFFF)}" if above else name(label & 0x7FFFFFFF)
            if label >> 31:
                out.append((path, a | (c & 0xFFFF) << 32, b | (c >> 16) << 32))
            else:
                need(j not in seen, "folder is its own descendant")
                seen.add(j)
                queue.append((j, path))
    return out


def zar_read(data: bytes, start: int, size: int) -> bytes:
    s = struct.unpack_from(">12Q", data, len(data) - ZAR_FOOTER)
    out, at = bytearray(), start
    while at < start + size:
        block, inside = divmod(at, ZAR_BLOCK)
        record, slot = divmod(block, ZAR_SLOTS)
        need(40 * (record + 1) <= s[3], "block lies outside the records")
        base, *sizes = struct.unpack_from(">Q16H", data, s[2] + 40 * record)
        lo = s[0] + base + sum(x + 1 for x in sizes[:slot])
        stored = data[lo : lo + sizes[slot] + 1]
        body = stored if len(stored) == ZAR_BLOCK else unzstd(stored, ZAR_BLOCK)
        need(len(body) == ZAR_BLOCK, "block isn't whole")
        piece = body[inside : inside + start + size - at]
        out += piece
        at += len(piece)
    return bytes(out)


# --- packages and executables


def stfs_header(data: bytes) -> dict:
    """Fixed fields of a package's header."""
    need(len(data) >= 0x971A and data[:4] in (b"CON ", b"LIVE", b"PIRS"), "header is cut off or its magic unknown")
    u32 = lambda at: struct.unpack_from(">I", data, at)[0]
    name = data[0x411 : 0x411 + 256].decode("utf-16-be", "replace").split("\0")[0]
    return {
        "magic": data[:4].decode().strip(), "header_size": u32(0x340), "content_type": u32(0x344), "metadata_version": u32(0x348), "media_id": u32(0x354), "title_id": u32(0x360),
        "disc_number": data[0x366], "disc_count": data[0x367], "display_name": name, "block_separation": data[0x37B], "file_table_blocks": int.from_bytes(data[0x37C:0x37E], "little"),
        "file_table_block": int.from_bytes(data[0x37E:0x381], "little"), "allocated_blocks": u32(0x395)}


#: Kinds of installer records.
INSTALLERS = {0: "none", 0x53555044: "systemUpdate", 0x54555044: "titleUpdate", 0x50245355: "systemUpdateProgress", 0x50245455: "titleUpdateProgress", 0x50245443: "titleContentProgress"}


def stfs_metadata(data: bytes) -> dict:
    """Identifiers, thumbnails and the records of avatar items, videos and installers of a package's header. A field that
    isn't there or whose content isn't sound is None."""
    need(len(data) >= 0x971A and data[:4] in (b"CON ", b"LIVE", b"PIRS"), "header is cut off or its magic unknown")
    u32 = lambda at, order=">": struct.unpack_from(order + "I", data, at)[0]
    most = 0x3D00 if u32(0x348) == 2 else 0x4000

    def picture(size: int, at: int) -> bytes | None:
        found = data[at : at + size] if 0 < size <= most else b""
        return found if len(found) == size and found.startswith(b"\x89PNG\r\n\x1a\n") else None

    first_table = u32(0x340) + pad_to(u32(0x340), BLOCK)
    installer, versions = None, (None, None)
    if first_table - 0x971A >= 0x15F4 and len(data) >= first_table:
        installer = INSTALLERS.get(u32(0x971A))
        if installer in ("systemUpdate", "titleUpdate"):
            versions = u32(0x971E), u32(0x9722)
    avatar = 1 <= data[0x3D9 + 24] <= 3
    return {
        "console_id": data[0x36C:0x371], "profile_id": data[0x371:0x379], "online_creator": data[0x3AD:0x3B5], "device_id": data[0x3FD:0x411],
        "thumbnail": picture(u32(0x1712), 0x171A), "title_thumbnail": picture(u32(0x1716), 0x571A),
        "avatar_category": u32(0x3D9, "<") if avatar else None, "avatar_colorizable": u32(0x3DD, "<") if avatar else None, "avatar_guid": data[0x3E1:0x3F1] if avatar else None, "avatar_skeleton": data[0x3F1] if avatar else None,
        "series_id": data[0x3D9:0x3E9], "season_id": data[0x3E9:0x3F9], "season_number": int.from_bytes(data[0x3F9:0x3FB], "big"), "episode_number": int.from_bytes(data[0x3FB:0x3FD], "big"),
        "installer": installer, "installer_base_version": versions[0], "installer_version": versions[1]}


def stfs_entries(table: bytes) -> list[tuple]:
    """(index, name, parent, is_dir, contiguous, first block, size) from file-table blocks; empty slots keep their number."""
    out = []
    for i in range(len(table) // 64):
        e = table[64 * i : 64 * i + 64]
        n = e[0x28] & 0x3F
        if n:
            out.append((i, e[: min(n, 0x28)].decode("utf-8", "replace"), int.from_bytes(e[0x32:0x34], "big"), bool(e[0x28] & 0x80), bool(e[0x28] & 0x40), int.from_bytes(e[0x2F:0x32], "little"), int.from_bytes(e[0x34:0x38], "big")))
    return out


def xbe_header(data: bytes) -> dict:
    """Title fields of the certificate, found through its address less the image's base. Images of this kind have one disc."""
    need(len(data) >= 0x11C and data[:4] == b"XBEH", "no executable header")
    base, cert = struct.unpack_from("<I", data, 0x104)[0], struct.unpack_from("<I", data, 0x118)[0]
    at = cert - base
    need(0 <= at and at + 0xB0 <= len(data), "certificate lies outside the file")
    title_id = struct.unpack_from("<I", data, at + 8)[0]
    return {"title_id": title_id, "title": data[at + 12 : at + 92].decode("utf-16-le", "replace").split("\0")[0], "media": struct.unpack_from("<I", data, at + 0x9C)[0], "media_id": 0, "disc_number": 1, "disc_count": 1, "version": struct.unpack_from("<I", data, at + 0xAC)[0], "base_version": 0}


def xex_execution(data: bytes) -> dict:
    """Execution fields among the optional headers, a list of keys and values."""
    need(len(data) >= 24 and data[:4] == b"XEX2", "no executable header")
    n = struct.unpack_from(">I", data, 20)[0]
    need(24 + 8 * n <= len(data), "optional headers are cut off")
    found = dict(struct.unpack_from(">II", data, 24 + 8 * i) for i in range(n))
    need(0x40006 in found and found[0x40006] + 24 <= len(data), "no execution fields")
    media, version, base, title, platform, kind, number, count = struct.unpack_from(">IIIIBBBB", data, found[0x40006])
    return {"media_id": media, "version": version, "base_version": base, "title_id": title, "platform": platform, "executable_type": kind, "disc_number": number, "disc_count": count}


def xex_layout(data: bytes) -> dict:
    """Where an executable's image begins and is loaded, whether it is encrypted, how it is compressed (none, basic with its
    runs, normal with its window and first block, or another kind's number), and its title."""
    need(len(data) >= 24 and data[:4] == b"XEX2", "no executable header")
    u32 = lambda at: struct.unpack_from(">I", data, at)[0] if at + 4 <= len(data) else None
    code, security, n = u32(8), u32(16), min(u32(20), 4096)
    need(24 + 8 * n <= len(data), "optional headers are cut off")
    found = dict(struct.unpack_from(">II", data, 24 + 8 * i) for i in range(n))
    load = found.get(0x10201, u32(security + 0x110) if security else None)
    encrypted, kind, runs, window, first = False, "none", None, None, None
    if (at := found.get(0x3FF)) is not None:
        need(at + 8 <= len(data), "file format is cut off")
        size, encryption, compression = struct.unpack_from(">IHH", data, at)
        encrypted, room = encryption != 0, max(0, size - 8)
        if compression == 1:
            kind, runs = "basic", []
            for lo in range(at + 8, at + 8 + room - 7, 8):
                need(lo + 8 <= len(data), "runs are cut off")
                run = struct.unpack_from(">II", data, lo)
                if run == (0, 0):
                    break
                runs.append(run)
        elif compression == 2:
            need(room >= 8 and at + 16 <= len(data), "file format is cut off")
            kind, (window, first) = "normal", struct.unpack_from(">II", data, at + 8)
        elif compression:
            kind = f"unknown {compression}"
    title = u32(found[0x40006] + 12) if 0x40006 in found else None
    return {"code_offset": code, "load_address": load, "encrypted": encrypted, "compression": kind, "runs": runs, "window_size": window, "first_block_size": first, "title_id": title, "resource_info": found.get(0x2FF)}


def xex_resources(data: bytes, most: int = 65536) -> list[tuple[str, int, int]]:
    """(name, address, size) of an executable's resources, of which the first so many are read."""
    at = xex_layout(data)["resource_info"]
    if at is None:
        return []
    need(at + 4 <= len(data), "resource table is cut off")
    n = min(max(0, struct.unpack_from(">I", data, at)[0] - 4) // 16, most)
    need(at + 4 + 16 * n <= len(data), "resource table is cut off")
    rows = [struct.unpack_from(">8sII", data, at + 4 + 16 * i) for i in range(n)]
    return [(name.rstrip(b"\0").decode("latin-1"), address, size) for name, address, size in rows]


def xex_body(data: bytes, most: int = 1 << 30) -> bytes:
    """The image of an executable that is neither encrypted nor compressed, or compressed by runs."""
    x = xex_layout(data)
    need(not x["encrypted"] and x["compression"] in ("none", "basic"), "image is encrypted or of another compression")
    body = data[x["code_offset"] :]
    return body if x["runs"] is None else run_lengths(body, x["runs"], most)


#: Where a launch executable keeps its title's picture.
PICTURE_SECTIONS, PICTURE_ID, PICTURE_KIND = ("$$XTIMAGE", "$$XSIMAGE"), 0x8000, 2


def thumbnail(data: bytes) -> bytes | None:
    """An executable's picture as a PNG file, None without one that can be read. Of encrypted images none can."""
    try:
        if data[:4] == b"XBEH":
            sections = xbe_sections(data)
            for name in PICTURE_SECTIONS:
                try:
                    return png(xpr_pixels(sections[name]))
                except (KeyError, ValueError):
                    continue
            return None
        x, body = xex_layout(data), xex_body(data)
        if body[:2] != b"MZ" or x["load_address"] is None:
            return None
        own = f"{x['title_id']:08X}" if x["title_id"] is not None else ""
        for _, address, size in sorted(xex_resources(data), key=lambda r: r[0] != own):
            at = address - x["load_address"]
            try:
                if at >= 0 and at + size <= len(body) and (found := xdbf_find(body[at : at + size], PICTURE_ID, PICTURE_KIND)):
                    return found
            except ValueError:
                continue
    except (ValueError, struct.error):
        pass
    return None


def xdbf_find(data: bytes, entry: int, section: int, most: int = 65536) -> bytes | None:
    """A resource by identifier and section. Data begins behind the tables' capacities, not the used rows."""
    need(len(data) >= 24 and data[:4] == b"XDBF", "no resource header")
    _, capacity, used, free, _ = struct.unpack_from(">IIIII", data, 4)
    used = min(used, most)
    need(24 + 18 * used <= len(data), "resource table is cut off")
    base = 24 + 18 * capacity + 8 * free
    for i in range(used):
        kind, ident, offset, size = struct.unpack_from(">HQII", data, 24 + 18 * i)
        if (kind, ident) == (section, entry):
            need(base + offset + size <= len(data), "resource reaches past the data")
            return data[base + offset : base + offset + size]
    return None


# --- hash-tree containers

BLOCK, SUB_BLOCKS, PART_SUBS = 4096, 204, 203


def hash_list(digests: list[bytes]) -> bytes:
    return b"".join(digests).ljust(BLOCK, b"\0")


def chain_digest(block: bytes, digest: bytes) -> bytes:
    """A hash list with one more digest after its last."""
    used = next((i for i in range(0, BLOCK, 20) if block[i : i + 20] == bytes(20) or i + 20 > BLOCK), BLOCK)
    need(used + 20 <= BLOCK, "hash list is full")
    return block[:used] + digest + block[used + 20 :]


def write_god(image: bytes, subs: int = PART_SUBS, blocks: int = SUB_BLOCKS) -> tuple[list[bytes], bytes]:
    """Parts and the digest of the first one's master list. Each part has a master list of its sublists' digests, and a
    sublist before its blocks; from the last part to the first, each master list also gets the digest of the next."""
    data = [image[i : i + BLOCK].ljust(BLOCK, b"\0") for i in range(0, len(image), BLOCK)] or [bytes(BLOCK)]
    parts = []
    for lo in range(0, len(data), subs * blocks):
        body, sublists = bytearray(), []
        for s in range(lo, min(lo + subs * blocks, len(data)), blocks):
            own = data[s : min(s + blocks, lo + subs * blocks)]
            sublist = hash_list([hashlib.sha1(b).digest() for b in own])
            sublists.append(hashlib.sha1(sublist).digest())
            body += sublist + b"".join(own)
        parts.append([hash_list(sublists), bytes(body)])
    for p, after in zip(parts[-2::-1], parts[:0:-1]):
        p[0] = chain_digest(p[0], hashlib.sha1(after[0]).digest())
    return [m + b for m, b in parts], hashlib.sha1(parts[0][0]).digest()


def read_god(parts: list[bytes], subs: int = PART_SUBS, blocks: int = SUB_BLOCKS) -> bytes:
    """The data blocks of parts in order; every part but the last must be full."""
    out = bytearray()
    full = BLOCK * (1 + subs * (blocks + 1))
    for i, part in enumerate(parts):
        need(len(part) % BLOCK == 0 and len(part) > 2 * BLOCK, "part isn't in whole blocks")
        need(len(part) == full or i == len(parts) - 1, "a part before the last isn't full")
        for at in range(BLOCK, len(part), BLOCK * (blocks + 1)):
            out += part[at + BLOCK : at + BLOCK * (blocks + 1)]
    return bytes(out)


def live_header(fields: dict[int, bytes], size: int = 0xB000) -> bytes:
    """An unsigned package header: fields by their place, and the digest of all from 0x344 on before it."""
    head = bytearray(size)
    head[:4] = b"LIVE"
    for at, value in fields.items():
        need(at + len(value) <= size, "field reaches past the header")
        head[at : at + len(value)] = value
    for at in (0x35B, 0x35F, 0x391):
        if not any(lo <= at < lo + len(value) for lo, value in fields.items()):
            head[at] = 0
    head[0x32C:0x340] = hashlib.sha1(head[0x344:]).digest()
    return bytes(head)


def god_header(info: dict, content_type: int, parts: list[bytes], top: bytes, title: str = "", device_id: bytes = bytes(20)) -> bytes:
    """The header of a hash-tree container: execution fields, block and part counts, the first master list's digest."""
    u32 = lambda x: (x & 0xFFFFFFFF).to_bytes(4, "big")
    blocks = sum((len(p) // BLOCK - 1) - -(-(len(p) // BLOCK - 1) // (SUB_BLOCKS + 1)) for p in parts)
    name = title.encode("utf-16-be")[:254] + b"\0\0"
    full = BLOCK * (1 + PART_SUBS * (SUB_BLOCKS + 1))
    return live_header({
        0x340: u32(0xAD0E), 0x344: u32(content_type), 0x348: u32(2), 0x354: u32(info["media_id"]), 0x360: u32(info["title_id"]),
        0x364: bytes([info.get("platform", 0), info.get("executable_type", 0), info["disc_number"], info["disc_count"]]), 0x37D: top,
        0x392: blocks.to_bytes(3, "big") + bytes(2), 0x3A0: len(parts).to_bytes(4, "little"), 0x3A4: u32((len(parts[-1]) + (len(parts) - 1) * full) // 0x100),
        0x3FD: device_id, 0x411: name, 0x1691: name})


def god_folder(image: bytes, info: dict, content_type: int, title: str = "") -> list[tuple[str, bytes]]:
    """Names and bytes of a hash-tree container's files: its parts, and its header last."""
    parts, top = write_god(image)
    media = info["title_id"] if content_type == 0x5000 else info["media_id"]
    stem = f"{info['title_id']:08X}/{content_type:08X}/{media:08X}"
    return [(f"{stem}.data/Data{i:04d}", p) for i, p in enumerate(parts)] + [(stem, god_header(info, content_type, parts, top, title))]


def verify_god(parts: list[bytes], blocks: int = SUB_BLOCKS) -> str:
    """Empty if all digests hold, else what doesn't."""
    for i, part in enumerate(parts):
        for k, at in enumerate(range(BLOCK, len(part), BLOCK * (blocks + 1))):
            sublist = part[at : at + BLOCK]
            if hashlib.sha1(sublist).digest() != part[20 * k : 20 * k + 20]:
                return f"sublist {k} of part {i}"
            for j, lo in enumerate(range(at + BLOCK, min(at + BLOCK * (blocks + 1), len(part)), BLOCK)):
                if hashlib.sha1(part[lo : lo + BLOCK]).digest() != sublist[20 * j : 20 * j + 20]:
                    return f"block {j} of sublist {k} of part {i}"
    return ""


# --- packages' files

STFS_GROUP, STFS_END = 170, 0xFFFFFF


def stfs_backing(block: int, shift: int) -> int:
    """Physical block of a logical one: a table of 1 << shift blocks for every 170, another for every 170 * 170."""
    out = ((block + STFS_GROUP) // STFS_GROUP << shift) + block
    if block < STFS_GROUP:
        return out
    out += (block + STFS_GROUP**2) // STFS_GROUP**2 << shift
    return out if block < STFS_GROUP**2 else out + (1 << shift)


def stfs_tables(records: list[bytes]) -> tuple[dict[int, bytes], bytes]:
    """Hash tables of one block each by physical block, and the top one, from the records of all blocks. A table above the
    lowest level has a record for each table below it, and at its end how many blocks are below it."""
    join = lambda x: b"".join(x).ljust(BLOCK, b"\0")
    groups = [join(records[i : i + STFS_GROUP]) for i in range(0, len(records), STFS_GROUP)]
    out = {stfs_backing(STFS_GROUP * g, 0) - 1: t for g, t in enumerate(groups)}
    span, level = STFS_GROUP, 0
    while len(groups) > 1:
        span, level, below = span * STFS_GROUP, level + 1, groups
        groups = []
        for i in range(0, len(below), STFS_GROUP):
            count = min(span, len(records) - i // STFS_GROUP * span)
            groups.append(join(hashlib.sha1(t).digest() + b"\x80" + bytes(3) for t in below[i : i + STFS_GROUP])[:-16] + count.to_bytes(4, "big") + bytes(12))
            step = STFS_GROUP + 1, STFS_GROUP * (STFS_GROUP + 1) + 1  # physical blocks of a group of each level with its table
            out[step[1] if level == 2 else step[0] if i == 0 else 1 + i // STFS_GROUP * step[1]] = groups[-1]
    return out, groups[0]


def stfs_files(data: bytes) -> list[tuple[str, int, bytes]]:
    """(path, size, content) of a package's files. Blocks of one file are consecutive if its entry says so, else each
    block's hash record names the next."""
    h = stfs_header(data)
    base, shift = h["header_size"] + pad_to(h["header_size"], BLOCK), 1 - (h["block_separation"] & 1)

    def address(block: int) -> int:
        need(block < h["allocated_blocks"], "block lies outside the package")
        at = base + stfs_backing(block, shift) * BLOCK
        need(at + BLOCK <= len(data), "block reaches past the file")
        return at

    def following(block: int) -> int:
        first = block - block % STFS_GROUP
        table = base + (stfs_backing(first, shift) - (1 << shift) + (h["block_separation"] >> 1 & shift)) * BLOCK
        record = table + 24 * (block % STFS_GROUP)
        return int.from_bytes(data[record + 21 : record + 24], "big")

    def chain(block: int, n: int, consecutive: bool) -> bytes:
        out, seen = bytearray(), set()
        for i in range(n):
            need(block not in seen, "block chain runs in a circle")
            seen.add(block)
            at = address(block)
            out += data[at : at + BLOCK]
            if i + 1 < n:
                block = block + 1 if consecutive else following(block)
                need(block != STFS_END, "block chain ends early")
        return bytes(out)

    table, block = bytearray(), h["file_table_block"]
    for _ in range(h["file_table_blocks"]):
        at = address(block)
        table += data[at : at + BLOCK]
        block = following(block)
        if block == STFS_END:
            break
    entries = {e[0]: e for e in stfs_entries(bytes(table))}
    out = []
    for _, name, parent, is_dir, consecutive, first, size in entries.values():
        if is_dir:
            continue
        path, depth = [name], 0
        while parent != 0xFFFF:
            need(parent in entries and entries[parent][3] and depth < 4096, "parent is missing, no folder, or too deep")
            path.append(entries[parent][1])
            parent, depth = entries[parent][2], depth + 1
        need(all(map(safe, path)), "unsafe name")
        out.append(("/".join(reversed(path)), size, chain(first, -(-size // BLOCK), consecutive)[:size]))
    return out


def write_stfs(files: dict[str, bytes], title_id: int = 0, content_type: int = 1, name: str = "") -> bytes:
    """An unsigned read-only package: file table, then each file's blocks in sequence; an empty file takes one block.
    Hash tables of one level up to 170 blocks, of two up to 170 * 170, of three up to 170 * 170 * 170 (20 GB)."""
    rows, folders, blocks = [], {}, []
    for path in files:
        *dirs, last = path.split("/")
        need(all(map(safe, (*dirs, last))), "unsafe path")
        for k in range(len(dirs)):
            if tuple(dirs[: k + 1]) not in folders:
                folders[tuple(dirs[: k + 1])] = len(rows)
                rows.append((dirs[k], folders.get(tuple(dirs[:k]), 0xFFFF), None))
        rows.append((last, folders.get(tuple(dirs), 0xFFFF), files[path]))
    n_table = max(1, -(-len(rows) // 64))
    table, chains, at = bytearray(), [list(range(n_table))], n_table
    for label, parent, content in rows:
        raw = label.encode()[:0x28]  # a slot holds no more of a name
        n = 0 if content is None else max(1, -(-len(content) // BLOCK))
        flags = 0x80 if content is None else 0x40
        count = n.to_bytes(3, "little")
        table += raw.ljust(0x28, b"\0") + bytes([len(raw) | flags]) + count + count + (at if n else 0).to_bytes(3, "little") + parent.to_bytes(2, "big") + len(content or b"").to_bytes(4, "big") + bytes(8)
        if n:
            blocks += [content[i : i + BLOCK].ljust(BLOCK, b"\0") for i in range(0, max(1, len(content)), BLOCK)]
            chains.append(list(range(at, at + n)))
            at += n
    need(at <= STFS_GROUP**3, "more blocks than three levels of hash tables hold")
    body = [table[i : i + BLOCK].ljust(BLOCK, b"\0") for i in range(0, n_table * BLOCK, BLOCK)] + blocks
    after = {b: c[i + 1] if i + 1 < len(c) else STFS_END for c in chains for i, b in enumerate(c)}
    records = [hashlib.sha1(bytes(b)).digest() + b"\x80" + after[i].to_bytes(3, "big") for i, b in enumerate(body)]
    tables, top = stfs_tables(records)
    physical = {stfs_backing(i, 0): bytes(b) for i, b in enumerate(body)} | tables
    need(sorted(physical) == list(range(len(physical))), "tables and blocks don't fill the package")
    place = bytes([0x24, 0, 1]) + n_table.to_bytes(2, "little") + bytes(3) + hashlib.sha1(top).digest() + at.to_bytes(4, "big")
    fields = {0x340: struct.pack(">III", 0xAD0E, content_type, 2), 0x360: title_id.to_bytes(4, "big"), 0x379: place, 0x411: name.encode("utf-16-be")[:254]}
    return live_header(fields) + b"".join(physical[i] for i in range(len(physical)))


def xbe_sections(data: bytes, most: int = 4096) -> dict[str, bytes]:
    """An executable's sections by name; addresses are less the image's base."""
    need(len(data) >= 0x124 and data[:4] == b"XBEH", "no executable header")
    base, n, at = struct.unpack_from("<I", data, 0x104)[0], *struct.unpack_from("<II", data, 0x11C)
    at -= base
    n = min(n, most)
    need(0 <= at and at + 56 * n <= len(data), "section table lies outside the file")
    out = {}
    for i in range(n):
        raw, size, name = struct.unpack_from("<III", data, at + 56 * i + 12)
        name -= base
        need(0 <= name < len(data) and raw + size <= len(data), "section lies outside the file")
        out[data[name : name + 64].split(b"\0")[0].decode("latin-1")] = data[raw : raw + size]
    return out
