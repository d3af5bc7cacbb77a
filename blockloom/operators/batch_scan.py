"""Which files of a batch belong together: whole images, sets of discs, hash-tree folders, raw splits in the right order,
and the rest with a reason.

Every file of a batch is named in exactly one resolution, or in one that says which others it may go with. A batch is one
group of files, resolved in one task; its files must fit in memory."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import permutations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from blockloom.operators.search import FRAGMENTS, ORDERINGS, Budget, subsets_of_size
from blockloom.sources import formats as X

DISCS = "array<struct<name: string, media_id: string, disc_number: int>>"
VERIFY = "struct<root_offset: long, ok: boolean, checked_entries: array<struct<path: string, matched: boolean>>, reason: string>"
SCHEMA = f"batch_id string, kind string, names array<string>, title_id string, disc_count int, discs {DISCS}, verify {VERIFY}, reason string, unresolved_kind string"
COLUMNS = ["kind", "names", "title_id", "disc_count", "discs", "verify", "reason", "unresolved_kind"]
#: What a file of this extension must begin with.
MAGICS = {"xex": b"XEX2", "xbe": b"XBEH", "dll": b"MZ"}
HEADERS = 6
_tree_part = re.compile(r"(.*\.data)/data([0-9]+)", re.IGNORECASE | re.DOTALL)

File = tuple[str, bytes]


def reader(parts: list[bytes]) -> tuple[Callable[[int, int], bytes], int]:
    ends, total = [], 0
    for p in parts:
        total += len(p)
        ends.append(total)

    def read(at: int, n: int) -> bytes:
        out, start = b"", 0
        for p, end in zip(parts, ends):
            if at < end and at + n > start:
                out += p[max(0, at - start) : at + n - start]
            start = end
        return out

    return read, total


def extension(name: str) -> str:
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def boot_info(v: X.Volume, read: Callable[[int, int], bytes]) -> dict:
    """Execution fields of the root's default.xex, else of its default.xbe."""
    for wanted, parse in (("default.xex", X.xex_execution), ("default.xbe", X.xbe_header)):
        for path, _, attributes, sector, size in v.entries:
            if path.lower() == wanted and not attributes & 0x10:
                return parse(read(v.root_offset + sector * X.SECTOR, size))
    raise ValueError("no executable found in this image")


def completeness(data: bytes) -> tuple[X.Volume, bool] | None:
    """The volume a file begins, and whether the file holds all of it; None if it begins none."""
    read, total = reader([data])
    v = X.read_volume(read)
    return v and (v, v.walked and total >= v.root_offset + v.extent)


def verify(parts: list[bytes]) -> dict:
    """Whether parts in this order make one volume: it is all there, begins in the first part, and files of known kinds
    beyond the first part begin as they must."""
    read, total = reader(parts)
    v = X.read_volume(read)
    out = {"root_offset": v.root_offset if v else 0, "ok": False, "checked_entries": [], "reason": None}
    if v is None or not v.walked:
        return out | {"reason": v.reason if v else "no volume at any known offset"}
    if total < v.root_offset + v.extent:
        return out | {"reason": f"parts have {total} bytes, the volume reaches {v.root_offset + v.extent}"}
    if len(parts[0]) < v.root_offset:
        return out | {"reason": "the volume begins after the first part"}
    checked = []
    for path, _, attributes, sector, _ in v.entries:
        at, magic = v.root_offset + sector * X.SECTOR, MAGICS.get(extension(path))
        if magic and not attributes & 0x10 and at >= len(parts[0]):
            checked.append({"path": path, "matched": read(at, len(magic)) == magic})
    ok = all(c["matched"] for c in checked)
    reason = None if ok and checked else "sizes fit; no file of a known kind lies past the first part" if ok else "a file past the first part doesn't begin as it must"
    return out | {"ok": ok, "checked_entries": checked, "reason": reason}


def self_contained(f: File) -> bool:
    """An executable of its own, by name and header: no continuation of anything."""
    parse = {"xex": X.xex_execution, "xbe": X.xbe_header}.get(extension(f[0]))
    try:
        return parse is not None and bool(parse(f[1]))
    except ValueError:
        return False


def candidates(sizes: list[int], missing: int) -> Iterator[tuple[int, ...]]:
    """Subsets that fill what is missing exactly, from the fewest files up, then those that hold at least as much."""
    budget = Budget()
    for exact in (True, False):
        for k in range(1, min(len(sizes), FRAGMENTS) + 1):
            yield from subsets_of_size(sizes, k, missing, exact, budget)


def raw_split(header: bytes, rest: list[File]) -> tuple[list[tuple[int, ...]], dict | None]:
    """Orderings of other files that complete a header, as indices, and the first one's verification. The first winner
    fixes the number of files; a second one of other names makes the split ambiguous and ends the search."""
    v, _ = completeness(header)
    missing = max(0, v.root_offset + v.extent - len(header))
    at = [i for i, f in enumerate(rest) if not self_contained(f)]
    wins: dict[tuple[str, ...], tuple[int, ...]] = {}
    first, tried = None, 0
    for subset in candidates([len(rest[i][1]) for i in at], missing):
        if len(wins) > 1 or (first and len(subset) != len(next(iter(wins.values())))):
            break
        for order in permutations(at[i] for i in subset):
            tried += 1
            if tried > ORDERINGS:
                return list(wins.values()), first
            names = tuple(sorted(rest[i][0].lower() for i in order))
            if names not in wins and (found := verify([header, *(rest[i][1] for i in order)]))["ok"]:
                wins[names], first = order, first or found
                if len(wins) > 1:
                    break
    return list(wins.values()), first


def row(kind: str, names: list[str], **more) -> dict:
    return dict.fromkeys(COLUMNS) | {"kind": kind, "names": names} | more


def unresolved(names: list[str], reason: str, kind: str = "generic", **more) -> dict:
    return row("unresolved", names, reason=reason, unresolved_kind=kind, **more)


def split_headers(headers: list[File], order: tuple[int, ...], rest: list[File]) -> tuple[list[dict], list[int], dict[int, dict]]:
    """Headers take their continuations in the order given, each from what those before it left: splits, the files left,
    and why the others have none."""
    left, found, failed = list(range(len(rest))), [], {}
    for h in order:
        name, data = headers[h]
        wins, checked = raw_split(data, [rest[i] for i in left]) if left else ([], None)
        if len(wins) == 1:
            taken = [left[i] for i in wins[0]]
            found.append(row("rawSplit", [name, *(rest[i][0] for i in taken)], verify=checked))
            left = [i for i in left if i not in taken]
        elif wins:
            failed[h] = unresolved([name, *(rest[i][0] for i in left)], f"{len(wins)} different sets of files each make a valid split", "ambiguousSplit")
        else:
            failed[h] = unresolved([name, *(rest[i][0] for i in left)], "no ordering of these files makes a valid split" if left else "nothing in the batch continues this header")
    return found, left, failed


def pair_headers(headers: list[File], rest: list[File]) -> list[dict]:
    """Raw splits of a batch. Several headers are tried in every order (of at most HEADERS): orders that place all of them
    and agree are one answer, those that disagree leave the batch to the caller."""
    if not headers:
        return [unresolved([n for n, _ in rest], "no header in the batch goes with these files")] if rest else []
    spare = lambda left: [unresolved([rest[i][0]], "not part of a split found in this batch") for i in left]
    if len(headers) == 1:
        found, left, failed = split_headers(headers, (0,), rest)
        return found + spare(left) if found else list(failed.values())
    answers: dict[tuple, list[dict]] = {}
    for order in permutations(range(len(headers))) if len(headers) <= HEADERS else ():
        found, left, failed = split_headers(headers, order, rest)
        if not failed:
            answers.setdefault(tuple(sorted(tuple(r["names"]) for r in found)), found + spare(left))
    if len(answers) == 1:
        return next(iter(answers.values()))
    if answers:
        return [unresolved([n for n, _ in (*headers, *rest)], f"{len(answers)} different pairings each place every header", "ambiguousSplit")]
    order = tuple(sorted(range(len(headers)), key=lambda h: headers[h][0]))
    found, left, failed = split_headers(headers, order, rest)
    if not failed:
        return found + spare(left)
    return found + [unresolved([*(headers[h][0] for h in failed), *(rest[i][0] for i in left)], "several headers, and not all of them can be placed")]


def group_images(images: list[tuple[list[str], dict, str]]) -> list[dict]:
    """Whole images (names, execution fields, container's shape): discs of one title, count and shape are a set."""
    groups: dict[tuple, list[tuple[list[str], dict]]] = {}
    for names, info, shape in images:
        groups.setdefault((info["title_id"], info["disc_count"], shape), []).append((names, info))
    out = []
    for (title, count, _), members in sorted(groups.items()):
        numbers, fields = [m["disc_number"] for _, m in members], {"title_id": f"{title:08X}", "disc_count": count}
        if count < 2 or len(members) < 2:
            out += [row("standalone", names, **fields) for names, _ in members]
        elif len(set(numbers)) < len(numbers):
            out += [unresolved(names, f"disc {m['disc_number']} of {count} is claimed twice or another number is", "duplicateDiscClaim", **fields) for names, m in members]
        elif len(members) > count or min(numbers) < 1 or max(numbers) > count:
            out += [unresolved(names, f"{len(members)} files claim to be of {count} discs, or their numbers lie outside", "invalidDiscCount", **fields) for names, _ in members]
        else:
            members.sort(key=lambda m: m[1]["disc_number"])
            discs = [{"name": names[0], "media_id": f"{m['media_id']:08X}", "disc_number": m["disc_number"]} for names, m in members]
            out.append(row("multiDiscSet", [n for names, _ in members for n in names], discs=discs, **fields))
    return out


def tree_image(folder: str, parts: list[tuple[int, File]]) -> tuple[list[str], dict, str] | dict:
    names = [f[0] for _, f in parts]
    try:
        X.need([i for i, _ in parts] == list(range(len(parts))), "part numbers have gaps")
        image = X.read_god([f[1] for _, f in parts])
        read, total = reader([image])
        v = X.read_volume(read)
        X.need(v is not None and v.walked and total >= v.root_offset + v.extent, "no whole volume inside")
        return names, boot_info(v, read), "tree"
    except ValueError as e:
        return unresolved(names, f"{folder}: {e}")


def resolve(files: list[File]) -> list[dict]:
    out: list[dict] = []
    folders: dict[str, list[tuple[int, File]]] = {}
    images, headers, rest = [], [], []
    for f in files:
        if m := _tree_part.fullmatch(f[0]):
            folders.setdefault(m[1], []).append((int(m[2]), f))
            continue
        try:
            kind = X.detect(f[1][:4], f[1][-4:], len(f[1]))
            X.need(kind == "xiso", f"{kind} isn't a raw image")
        except ValueError as e:
            out.append(unresolved([f[0]], str(e)))
            continue
        probed = completeness(f[1])
        if probed is None:
            rest.append(f)
        elif not probed[1]:
            headers.append(f)
        else:
            try:
                images.append(([f[0]], boot_info(probed[0], reader([f[1]])[0]), "file"))
            except ValueError as e:
                out.append(unresolved([f[0]], f"whole image without a launch executable: {e}"))
    for folder, parts in sorted(folders.items()):
        parts.sort(key=lambda p: p[0])
        if len(folders) == 1:  # nothing it could be grouped with, so its content isn't looked at
            out.append(row("godFolder", [f[0] for _, f in parts]))
        elif isinstance(found := tree_image(folder, parts), dict):
            out.append(found)
        else:
            images.append(found)
    return group_images(images) + out + pair_headers(headers, rest)


def resolve_entry(files: list[File]) -> dict:
    """What the first file is: half of a named pair, part of the batch's one raw split, or a file of its own format."""
    name, data = files[0]
    for ext, kind, load in (("cci", "cci", lambda p: [X.cci_index(x) for x in p]), ("cso", "ciso", X.ciso_parts), ("ciso", "ciso", X.ciso_parts)):
        if not (m := re.fullmatch(rf"(.*)\.([12])\.{ext}", name, re.IGNORECASE | re.DOTALL)):
            continue
        wanted = f"{m[1]}.{'21'[int(m[2]) - 1]}.{ext}".lower()
        if (partner := next((f for f in files if f[0].lower() == wanted), None)) is None:
            continue
        pair = [files[0], partner] if m[2] == "1" else [partner, files[0]]
        try:
            load([f[1] for f in pair])
            return row("dir", [f[0] for f in pair], format=kind)
        except ValueError as e:
            return row("invalid", [f[0] for f in pair], reason=f"named like parts of a {kind} image, which they aren't: {e}", unresolved_kind="mismatch")
    headers, rest = [], []
    for f in files:
        try:
            if X.detect(f[1][:4], f[1][-4:], len(f[1])) != "xiso":
                continue
        except ValueError:
            continue
        probed = completeness(f[1])
        if probed is None or not probed[1]:
            (rest if probed is None else headers).append(f)
    names = [f[0] for f in (*headers, *rest)]
    if name in names and headers and rest:
        if len(headers) > 1:
            return row("invalid", names, reason="several headers in the batch", unresolved_kind="ambiguousHeaders")
        wins, _ = raw_split(headers[0][1], rest)
        if len(wins) == 1 and name in (split := [headers[0][0], *(rest[i][0] for i in wins[0])]):
            return row("dir", split, format="xiso")
        if len(wins) != 1:
            return row("invalid", names, reason="several sets of files make a valid split" if wins else "no ordering of these files makes a valid split", unresolved_kind="ambiguousSplit" if wins else "unresolvedOrdering")
    try:
        return row("file", [name], format=X.detect(data[:4], data[-4:], len(data)))
    except ValueError as e:
        return row("invalid", [name], reason=str(e), unresolved_kind="generic")


def _each(parts: DataFrame, make: Callable[[list[File]], list[dict]], columns: list[str], schema: str, order: list[str]) -> DataFrame:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable")
        rows = make([(n, bytes(c)) for n, c in zip(group["name"], group["content"])])
        out = pd.DataFrame([[r.get(c) for c in columns] for r in rows], columns=columns, dtype=object)
        out.insert(0, "batch_id", group["batch_id"].iloc[0])
        return out

    return parts.groupBy("batch_id").applyInPandas(run, schema)


def scan(parts: DataFrame) -> DataFrame:
    """Resolutions of batches, from (batch_id, name, content). Names may repeat in a batch."""
    return _each(parts, resolve, COLUMNS, SCHEMA, ["name"])


def scan_entries(parts: DataFrame) -> DataFrame:
    """What the file of lowest place is in each batch, from (batch_id, place, name, content): file, dir or invalid."""
    return _each(parts, lambda files: [resolve_entry(files)], ["kind", "names", "format", "reason", "unresolved_kind"], "batch_id string, kind string, names array<string>, format string, reason string, unresolved_kind string", ["place"])


def check_orderings(parts: DataFrame) -> DataFrame:
    """Verification of each batch's files in the order of place."""
    return _each(parts, lambda files: [verify([d for _, d in files])], ["root_offset", "ok", "checked_entries", "reason"], "batch_id string, root_offset long, ok boolean, checked_entries array<struct<path: string, matched: boolean>>, reason string", ["place"])


def check_completeness(parts: DataFrame) -> DataFrame:
    """For each file that begins a volume: whether it holds all of it, and where the volume and its root table begin."""

    def run(files: list[File]) -> list[dict]:
        probed = [(n, completeness(d)) for n, d in files]
        return [{"name": n, "is_complete": p[1], "root_offset": p[0].root_offset, "max_used_prefix_size": p[0].extent, "root_directory_table_offset": p[0].root_offset + p[0].root_sector * X.SECTOR} for n, p in probed if p]

    names = ["name", "is_complete", "root_offset", "max_used_prefix_size", "root_directory_table_offset"]
    return _each(parts, run, names, "batch_id string, name string, is_complete boolean, root_offset long, max_used_prefix_size long, root_directory_table_offset long", ["name"])


def known_early(parts: DataFrame) -> DataFrame:
    """Resolutions that hang on one file alone: whole images of a single disc, and files that are no raw image. Each file is
    looked at where it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for batch_id, name, content in zip(*(batch.column(c) for c in ("batch_id", "name", "content"))):
                if _tree_part.fullmatch(n := name.as_py()):
                    continue
                (r,) = resolve([(n, bytes(content.as_py()))])
                other = r["kind"] == "unresolved" and not raw_image(content.as_py())
                if other or (r["kind"] == "standalone" and r["disc_count"] <= 1):
                    yield pa.RecordBatch.from_arrays([pa.array([batch_id.as_py()], pa.string()), *[pa.array([r[c]], k) for c, k in (("kind", pa.string()), ("names", pa.list_(pa.string())), ("title_id", pa.string()), ("disc_count", pa.int32()), ("reason", pa.string()))]], ["batch_id", "kind", "names", "title_id", "disc_count", "reason"])

    return parts.select("batch_id", "name", "content").mapInArrow(run, "batch_id string, kind string, names array<string>, title_id string, disc_count int, reason string")


def raw_image(data: bytes) -> bool:
    try:
        return X.detect(data[:4], data[-4:], len(data)) == "xiso"
    except ValueError:
        return False


def reported_once(resolutions: DataFrame, reported: DataFrame) -> DataFrame:
    """Resolutions less those of one file that were handed on before: reported has (batch_id, name)."""
    alone = resolutions.where("kind IN ('standalone', 'unresolved') AND size(names) = 1")
    early = alone.selectExpr("batch_id", "names", "names[0] AS name").join(reported, ["batch_id", "name"], "left_semi").select("batch_id", "names")
    return resolutions.join(early, ["batch_id", "names"], "left_anti")


def leftovers(names: list[str], claimed: list[str]) -> list[str]:
    """Names that weren't claimed, as often as they weren't."""
    return list((Counter(names) - Counter(claimed)).elements())
