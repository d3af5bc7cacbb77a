"""Content types of packages: names, labels, families, and whether one boots from an executable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name, code and label of each content type.
CONTENT_TYPES = [
    ("gamesOnDemand", 0x7000, "Games on Demand"),
    ("xboxOriginal", 0x5000, "Xbox Original"),
    ("arcadeGame", 0xD0000, "Arcade Game"),
    ("xbox360Title", 0x1000, "Xbox 360 Title"),
    ("installedGame", 0x4000, "Installed Game"),
    ("gameDemo", 0x80000, "Game Demo"),
    ("video", 0x90000, "Video"),
    ("communityGame", 0x2000000, "Community Game"),
    ("xna", 0xE0000, "XNA"),
    ("savedGame", 0x1, "Saved Game"),
    ("marketPlaceContent", 0x2, "Marketplace Content"),
    ("publisher", 0x3, "Publisher"),
    ("iptvPauseBuffer", 0x2000, "IPTV Pause Buffer"),
    ("avatarAssetPack", 0x8000, "Avatar Asset Pack"),
    ("avatarItem", 0x9000, "Avatar Item"),
    ("profile", 0x10000, "Profile"),
    ("gamerPicture", 0x20000, "Gamer Picture"),
    ("theme", 0x30000, "Theme"),
    ("cacheFile", 0x40000, "Cache File"),
    ("storageDownload", 0x50000, "Storage Download"),
    ("xboxSavedGame", 0x60000, "Xbox Saved Game"),
    ("xboxDownload", 0x70000, "Xbox Download"),
    ("gamerTitle", 0xA0000, "Gamer Title"),
    ("installer", 0xB0000, "Installer"),
    ("gameTrailer", 0xC0000, "Game Trailer"),
    ("licenseStore", 0xF0000, "License Store"),
    ("movie", 0x100000, "Movie"),
    ("tv", 0x200000, "TV"),
    ("musicVideo", 0x300000, "Music Video"),
    ("gameVideo", 0x400000, "Game Video"),
    ("podcastVideo", 0x500000, "Podcast Video"),
    ("viralVideo", 0x600000, "Viral Video"),
]
CODES = {name: code for name, code, _ in CONTENT_TYPES}
#: Types that boot from a launch executable, and those that belong to another title.
BOOTABLE = ["gamesOnDemand", "xboxOriginal", "arcadeGame", "xbox360Title", "installedGame", "gameDemo", "communityGame", "xna"]
ATTACHED = ["savedGame", "xboxSavedGame", "marketPlaceContent", "avatarItem", "installer"]


def _look_up(code: Column, values: dict[int, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), code.cast("int"))


def content_type(code: Column) -> Column:
    """The type's name; null for a code that isn't known."""
    return _look_up(code, {c: name for name, c, _ in CONTENT_TYPES})


def content_label(code: Column) -> Column:
    return _look_up(code, {c: label for _, c, label in CONTENT_TYPES})


def boots(code: Column) -> Column:
    """Whether the type needs a launch executable; false for null and unknown codes."""
    return F.coalesce(code.isin(*[CODES[name] for name in BOOTABLE]), F.lit(False))


def family(code: Column) -> Column:
    attached = code.isin(*[CODES[name] for name in ATTACHED])
    kind = F.when(boots(code), "bootable").when(code == CODES["profile"], "profileAccount").when(attached, "titleAttached").otherwise("standaloneAsset")
    return F.when(content_type(code).isNotNull(), kind)
