"""HTML character references in a text (survey F06, S06).

The names come from the list of the HTML standard that Python ships.  They lie in
maps by the checksum of the name, so that a look-up scans a few names only.
"""

from __future__ import annotations

import html
import json
import zlib
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.columns import let, where

NAME_BUCKETS = 256
# ---- fixed values -------------------------------------------------------
REFERENCE = r"^(#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);"
OPEN_NUMBER = r"^(#[0-9]+|#[xX][0-9A-Fa-f]+)"
# Ways to write an ampersand, one behind the other.
AMPERSANDS = "&(?:(?:amp|AMP|#0*38|#[xX]0*26);)+"
UNKNOWN = "�"
LARGEST = 0x10FFFF
# ---- end of fixed values ------------------------------------------------


def _in_capitals(name: str, signs: str) -> str | None:
    """What a lower-case name stands for in capitals, where that says nothing else."""
    shouted = f"&{name.upper()};"
    if name == name.lower() and html.unescape(shouted) == shouted:
        return signs.upper()
    return None


@cache
def _names(capitals: bool) -> str:
    """Names that end in a semicolon and their signs, as maps by the checksum of the name."""
    known = {n[:-1]: signs for n, signs in html5.items() if n.endswith(";")}
    if capitals:
        known |= {n.upper(): big for n, s in known.items() if (big := _in_capitals(n, s)) is not None}
    maps: list[dict[str, str]] = [{} for _ in range(NAME_BUCKETS)]
    for name, signs in known.items():
        maps[zlib.crc32(name.encode()) % NAME_BUCKETS][name] = signs
    return json.dumps(maps)


@cache
def _open_names() -> tuple[str, str]:
    """A pattern of the names that need no semicolon, the longest first, and their signs."""
    known = {n: signs for n, signs in html5.items() if not n.endswith(";")}
    listed = sorted(known, key=lambda n: (-len(n), n))
    return f"^({'|'.join(listed)})", json.dumps(known)


def _named(name: Column, capitals: bool) -> Column:
    """The signs of a name; null if there is no such name."""
    maps = F.from_json(F.lit(_names(capitals)), "array<map<string,string>>")
    of = F.get(maps, (F.crc32(name.cast("binary")) % NAME_BUCKETS).cast("int"))
    return F.try_element_at(of, name)


def _windows_signs() -> Column:
    """The signs that numbers 128 to 159 stand for: those of Windows-1252 where it has any."""
    return F.lit([bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0)])


def _sign(code: Column) -> Column:
    """The sign of a number, by the rules of the HTML standard."""

    def within(a: int, b: int) -> Column:
        return code.between(a, b)

    bytes_ = F.unhex(F.lpad(F.hex(code), 8, "0"))
    control = within(1, 8) | (code == 11) | within(14, 31) | (code == 127)
    no_sign = within(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
    return (
        F.when((code == 0) | within(0xD800, 0xDFFF) | (code > LARGEST), UNKNOWN)
        .when(within(0x80, 0x9F), F.get(_windows_signs(), (code - 0x80).cast("int")))
        .when(control | no_sign, "")
        .otherwise(F.decode(bytes_, "UTF-32"))
    )


def _numbered(body: Column) -> Column:
    """The sign of ``#8217`` or ``#x2019``."""
    hexadecimal = F.lower(F.substr(body, F.lit(2), F.lit(1))) == "x"
    digits = F.regexp_replace(body, "^#[xX]?0*", "")
    # eight digits are beyond the last sign in either notation
    short = F.concat(F.lit("0"), F.substr(digits, F.lit(1), F.lit(8)))
    number = F.when(hexadecimal, F.conv(short, 16, 10)).otherwise(short).cast("bigint")
    return let(F.when(F.length(digits) > 8, LARGEST + 1).otherwise(number).cast("bigint"), _sign)


def _piece(open_ended: bool, capitals: bool):
    """What stands for a piece behind an ampersand."""

    def closed(piece: Column, otherwise) -> Column:
        def found(body: Column) -> Column:
            sign = (
                F.when(body == "", F.lit(None).cast("string"))
                .when(F.startswith(body, F.lit("#")), _numbered(body))
                .otherwise(_named(body, capitals))
            )
            rest = F.substr(piece, F.length(body) + 2)
            return let(sign, lambda s: F.when(s.isNotNull(), F.concat(s, rest)).otherwise(otherwise))

        return let(F.regexp_extract(piece, REFERENCE, 1), found)

    def unclosed(piece: Column, otherwise: Column) -> Column:
        pattern, signs = _open_names()
        known = F.from_json(F.lit(signs), "map<string,string>")

        def found(names: Column) -> Column:
            number, name = names[0], names[1]
            behind = lambda body: F.substr(piece, F.length(body) + 1)
            return (
                F.when(number != "", F.concat(_numbered(number), behind(number)))
                .when(name != "", F.concat(F.try_element_at(known, name), behind(name)))
                .otherwise(otherwise)
            )

        return let(F.array(F.regexp_extract(piece, OPEN_NUMBER, 1), F.regexp_extract(piece, pattern, 1)), found)

    def decoded(piece: Column) -> Column:
        plain = F.concat(F.lit("&"), piece)
        return closed(piece, unclosed(piece, plain) if open_ended else plain)

    return decoded


def decode(text: Column, open_ended: bool = False, capitals: bool = False) -> Column:
    """Every character reference by its signs, once; unknown ones stay.

    ``open_ended`` also takes the numbers and the old names that browsers take without
    a semicolon; ``capitals`` takes lower-case names written in capitals for the
    capital letter.
    """

    def joined(pieces: Column) -> Column:
        rest = F.slice(pieces, F.lit(2), F.size(pieces))
        return F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(rest, _piece(open_ended, capitals)), ""))

    return where(text, lambda x: F.contains(x, F.lit("&")), lambda x: let(F.split(x, "&"), joined))


def decode_nested(text: Column) -> Column:
    """References that were escaped again and again, as ``&amp;amp;lt;``; only closed ones count.

    Ampersands are unwrapped as far as they go.  References that decoding puts together
    from other signs (``&&num;60;``) are decoded once more.
    """

    def bare(x: Column) -> Column:
        return decode(F.regexp_replace(x, AMPERSANDS, "&"), capitals=True)

    closed = "&#?[0-9A-Za-z]+;"
    return where(text, lambda x: x.rlike(closed), lambda x: where(bare(x), lambda y: y.rlike(closed), bare))
