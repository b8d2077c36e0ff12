"""String functions over a text column (survey F01-F06, F09)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import references
from corpusloom.functions.columns import let, where

# ---- fixed values -------------------------------------------------------
# Unicode white space as Python's str.split() knows it.
SPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
NON_SPACE = SPACE.replace("[", "[^", 1)
# A token is a run of letters, digits and underscores, or one other sign.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
DATELINE = r"(?d)^.*\(Reuters\)" + SPACE + "*-" + SPACE + "*"
DATELINE_MARKER = "(Reuters) -"
SEPARATOR = " [SEP] "
SINGLE_QUOTES = "ʼ‘’‚‛"
DOUBLE_QUOTES = "“”„‟"
LIGATURES = [
    ("ﬀ", "ff"),
    ("ﬁ", "fi"),
    ("ﬂ", "fl"),
    ("ﬃ", "ffi"),
    ("ﬄ", "ffl"),
    ("ﬅ", "ſt"),
    ("ﬆ", "st"),
]
# Line breaks besides the two signs of carriage return and line feed.
BREAKS = "\r\x85\u2028\u2029"
TERMINAL_ESCAPE = r"\x1b\[[0-9;]*[a-zA-Z]"
CONTROL = (
    r"[\x00-\x08\x0b\x0e-\x1f\x7f\x{206a}-\x{206f}\x{feff}\x{fff9}-\x{fffc}]"
)
# Quotes, full-width forms, line breaks and control signs.
PLAIN_SIGNS = (
    f"[{SINGLE_QUOTES}{DOUBLE_QUOTES}\\x{{ff01}}-\\x{{ff5e}}\\x{{3000}}"
    r"\r\x{85}\x{2028}\x{2029}" + CONTROL[1:]
)
NEEDS_LOOK = r"[^\t\n\x0c\x20-\x7e]|&"
UTF8_AS_LATIN1 = (
    r"[\x{c2}-\x{df}][\x{80}-\x{bf}]"
    r"|\x{e0}[\x{a0}-\x{bf}][\x{80}-\x{bf}]"
    r"|[\x{e1}-\x{ec}\x{ee}\x{ef}][\x{80}-\x{bf}]{2}"
    r"|\x{ed}[\x{80}-\x{9f}][\x{80}-\x{bf}]"
    r"|\x{f0}[\x{90}-\x{bf}][\x{80}-\x{bf}]{2}"
    r"|[\x{f1}-\x{f3}][\x{80}-\x{bf}]{3}"
    r"|\x{f4}[\x{80}-\x{8f}][\x{80}-\x{bf}]{2}"
)
# ---- end of fixed values ------------------------------------------------

# Full-width forms differ from ASCII by a constant distance.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
_CONTROL_SIGNS = [chr(c) for c in (*range(0x20), 0x7F, *range(0x206A, 0x2070), 0xFEFF, *range(0xFFF9, 0xFFFD))]
_CONTROL_SIGNS = [c for c in _CONTROL_SIGNS if c not in "\t\n\x0c\r"]


def _windows_points() -> tuple[str, str]:
    """Signs Windows-1252 puts on bytes 80-9F, and those bytes as code points."""
    shown, raw = "", ""
    for byte in range(0x80, 0xA0):
        try:
            shown += bytes([byte]).decode("cp1252")
            raw += chr(byte)
        except UnicodeDecodeError:
            pass
    return shown, raw


_CP1252_SHOWN, _CP1252_RAW = _windows_points()


def strip_dateline(text: Column) -> Column:
    """remove everything up to the agency marker on the first line."""
    return F.regexp_replace(text, DATELINE, "")


def excerpt(text: Column, chars: int = 1000) -> Column:
    """the first ``chars`` characters."""
    return F.substring(text, 1, chars)


def words(text: Column) -> Column:
    """White-space separated words; an empty text has none."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def first_words(text: Column, n: int = 500) -> Column:
    """the first ``n`` words joined by one space."""
    return F.array_join(F.slice(words(text), 1, n), " ")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("int")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


LENGTH_METHODS = ("chars", "words", "tokens")


def text_length(text: Column, method: str = "chars") -> Column:
    """length in characters, words or tokens; null stays null."""
    if method == "chars":
        return F.char_length(text)
    if method == "words":
        return F.when(text.isNotNull(), word_count(text))
    if method == "tokens":
        return F.when(text.isNotNull(), F.size(tokens(text)))
    raise ValueError(f"method must be one of {LENGTH_METHODS}, got {method!r}")


def add_length_column(df: DataFrame, text_col: str = "text", method: str = "chars"):
    """``df`` with ``<method>_length``, and the name of that column."""
    name = f"{method}_length"
    return df.withColumn(name, text_length(F.col(text_col), method)), name


def _replace_all(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def unescape_html(text: Column) -> Column:
    """Decode character references, but from the first line with a ``<`` on, which is markup."""

    def before_markup(x: Column) -> Column:
        def parted(head: Column) -> Column:
            return F.concat(references.decode_nested(head), F.substr(x, F.length(head) + 1))

        lines = F.regexp_extract(x, r"^[^<]*\n", 0)
        return let(F.when(F.contains(x, F.lit("<")), lines).otherwise(x), parted)

    return where(text, lambda x: F.contains(x, F.lit("&")), before_markup)


def fix_mojibake(text: Column) -> Column:
    """Undo UTF-8 that was once read as Latin-1 or Windows-1252.

    Only when the whole text decodes: after removing well-formed sequences no
    sign above ASCII may be left.
    """
    lead_and_trail = r"[\x{c2}-\x{f4}][\x{80}-\x{bf}" + _CP1252_SHOWN + "]"

    def repair(shown: Column) -> Column:
        def decoded(points: Column) -> Column:
            decodable = ~F.regexp_replace(points, UTF8_AS_LATIN1, "").rlike(r"[^\x00-\x7f]")
            # a conditional evaluates one branch, so decode sees valid bytes only
            return F.when(
                decodable, F.decode(F.encode(points, "ISO-8859-1"), "UTF-8")
            ).otherwise(shown)

        return let(F.translate(shown, _CP1252_SHOWN, _CP1252_RAW), decoded)

    return where(text, lambda x: x.rlike(lead_and_trail), repair)


def split_ligatures(text: Column) -> Column:
    signs = "".join(ligature for ligature, _ in LIGATURES)
    return where(
        text, lambda x: x.rlike(f"[{signs}]"), lambda x: _replace_all(x, LIGATURES)
    )


def plain_signs(text: Column) -> Column:
    """Straight quotes, half-width forms, ``\\n`` for line breaks, no control signs; one pass."""
    to = "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + _NARROW + "\n" * len(BREAKS)
    signs = SINGLE_QUOTES + DOUBLE_QUOTES + _WIDE + BREAKS + "".join(_CONTROL_SIGNS)
    return where(
        text,
        lambda x: x.rlike(PLAIN_SIGNS),
        # signs without a counterpart are dropped
        lambda x: F.translate(F.replace(x, F.lit("\r\n"), F.lit("\n")), signs, to),
    )


def repair_text(text: Column) -> Column:
    """references, mojibake, ligatures, terminal escapes, widths, quotes, breaks, controls.

    Plain ASCII text without an ampersand is recognised in one scan and passed
    through; the costlier rewrites run only where their signs occur.
    """

    def repaired(x: Column) -> Column:
        out = split_ligatures(fix_mojibake(unescape_html(x)))
        out = where(
            out,
            lambda y: F.contains(y, F.lit("\x1b")),
            lambda y: F.regexp_replace(y, TERMINAL_ESCAPE, ""),
        )
        return plain_signs(out)

    return where(text, lambda x: x.rlike(NEEDS_LOOK), repaired)


def clean_text(
    text: Column,
    repair: bool = True,
    lowercase: bool = True,
    strip_whitespace: bool = True,
) -> Column:
    """with ``repair`` the other two flags have no effect, by contract."""
    if repair:
        return repair_text(text)
    out = F.lower(text) if lowercase else text
    if strip_whitespace:
        out = F.trim(F.regexp_replace(out, SPACE + "+", " "))
    return out


def is_blank(text: Column) -> Column:
    """True for null, empty or white-space-only text."""
    return text.isNull() | ~text.rlike(NON_SPACE)


def render_entities(entities: Column) -> Column:
    """An entity list as ``word (GROUP), word (GROUP)``."""
    return F.array_join(
        F.transform(
            entities,
            lambda e: F.concat(e["word"], F.lit(" ("), e["entity_group"], F.lit(")")),
        ),
        ", ",
    )


def merge_entities(text: Column, entities: Column, how: str = "append") -> Column:
    """put the rendered entity list after or before the text."""
    shown = render_entities(entities)
    if how == "append":
        return F.concat(text, F.lit(SEPARATOR), shown)
    if how == "prepend":
        return F.concat(shown, F.lit(SEPARATOR), text)
    return text
