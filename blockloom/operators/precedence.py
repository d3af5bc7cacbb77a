"""Where a field of a container comes from when several places name it: the first that does, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from blockloom.functions.bits import disc_title
from blockloom.functions.titles import CODES, boots


def package_type(override: Column, header: Column, detected: Column, raw: Column) -> Column:
    """A package's content type: what was asked for, the source's header if its code is known, the launch executable's,
    the header's code as it stands, games on demand."""
    return F.coalesce(override, header, detected, raw, F.lit(CODES["gamesOnDemand"]))


def identifier(override: Column, header: Column, size: int) -> Column:
    """Console, profile, device and creator identifiers: zeros where neither names one."""
    return F.coalesce(override, header, F.unhex(F.lit("00" * size)))


def package_title_id(override: Column, executable: Column, known_type: Column) -> tuple[Column, Column]:
    """The title's identifier and a reason without one: a type that boots needs an executable that parses, others have 0.
    known_type is the content type that was asked for, in the header or detected, null without any."""
    missing = override.isNull() & executable.isNull() & boots(known_type)
    return F.when(~missing, F.coalesce(override, executable, F.lit(0))), F.when(missing, "no launch executable names a title")


def package_name(override: Column, header: Column, listed: Column) -> Column:
    return F.coalesce(override, header, listed)


def tree_title(explicit: Column, listed: Column, number: Column, count: Column) -> Column:
    """A hash-tree container's title: as given, else the table's with the disc's number."""
    return F.coalesce(explicit, disc_title(listed, number, count))


def tree_type(signed: Column, code: Column) -> tuple[Column, Column]:
    """A hash-tree container's content type and a reason without one: signed ones are installed games, made of games on demand only."""
    wrong = signed & (code != CODES["gamesOnDemand"])
    return F.when(~signed, code).when(~wrong, F.lit(CODES["installedGame"])), F.when(wrong, "only games on demand can be signed")


def thumbnail(executable: Column, header: Column) -> Column:
    return F.coalesce(executable, header)


def profile_id(account: Column, option: Column) -> Column:
    """An account that is carried over names the profile, whatever was asked for."""
    return F.coalesce(account, option)
