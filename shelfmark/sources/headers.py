"""Fields at fixed places of headers: what a cartridge says of itself, by a table of layouts.

A layout is a magic number and the places of fields; all of it is compiled to one column expression
over the first bytes of a file, so no Python runs. Bytes come from ``ranged.fetched`` or ``files.contents``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Layout(NamedTuple):
    kind: str
    at: int  # of the magic number
    magic: str  # in hexadecimal digits
    title: tuple[int, int] | None = None  # (place, length)
    code: tuple[int, int] | None = None
    maker: tuple[int, int] | None = None


# Fixed values of public header formats, asked for in this order.
LAYOUTS = [
    Layout("NES", 0, "4E45531A"),
    Layout("GBA", 0x04, "24FFAE51699AA221", (0xA0, 12), (0xAC, 4), (0xB0, 2)),
    Layout("NDS", 0x15C, "56CF", (0, 12), (0x0C, 4), (0x10, 2)),
    Layout("GB", 0x104, "CEED6666CC0D000B", (0x134, 15)),
    Layout("MD", 0x100, "53454741", (0x120, 48), (0x180, 14), (0x113, 4)),
    Layout("N64", 0, "80371240", (0x20, 20), (0x3B, 4)),
]
HEAD = 0x200  # bytes that all layouts lie in


def _text(data: Column, place: tuple[int, int] | None) -> Column:
    """Printable ASCII at a place, up to the first zero, without outer blanks; null if nothing is left."""
    if place is None:
        return F.lit(None).cast("string")
    raw = F.decode(F.substring(data, place[0] + 1, place[1]), "ISO-8859-1")
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(raw, r"(?s)\x00.*", ""), r"[^\x20-\x7E]", "")), F.lit(""))


def swapped(data: Column) -> Column:
    """The first bytes of an N64 image in the order of its hardware, whichever of three orders a dumper used; other bytes as they are."""
    hexed = F.hex(F.substring(data, 1, HEAD))
    by_two = F.unhex(F.regexp_replace(hexed, "(..)(..)", "$2$1"))
    by_four = F.unhex(F.regexp_replace(hexed, "(..)(..)(..)(..)", "$4$3$2$1"))
    head = F.substring(hexed, 1, 8)
    return F.when(head == "37804012", by_two).when(head == "40123780", by_four).otherwise(F.substring(data, 1, HEAD))


def header_fields(data: Column, layouts: list[Layout] = LAYOUTS) -> Column:
    """(kind, title, code, maker, colour) of a cartridge image's first bytes; null where no layout's magic number is there.

    ``colour`` is told for GB only: ``only``, ``too`` or ``no``, by the flag in its header. Files
    shorter than a field have what there is of it; null bytes give null.
    """
    data = swapped(data)
    flag = F.hex(F.substring(data, 0x143 + 1, 1))
    out = F.lit(None)
    for x in reversed(layouts):
        colour = F.when(flag == "C0", "only").when(flag == "80", "too").otherwise("no") if x.kind == "GB" else F.lit(None).cast("string")
        found = F.struct(F.lit(x.kind).alias("kind"), _text(data, x.title).alias("title"), _text(data, x.code).alias("code"), _text(data, x.maker).alias("maker"), colour.alias("colour"))
        out = F.when(F.hex(F.substring(data, x.at + 1, len(x.magic) // 2)) == x.magic, found).otherwise(out)
    return out
