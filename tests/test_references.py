"""Character references against Python's own decoder."""

import html
import random
import re
from html.entities import html5

from corpusloom.functions import references
from corpusloom.functions.text import repair_text, unescape_html

KNOWN = [
    "&#8217;", "&#x2019;", "&times;", "&euro;", "&ntilde;", "&notin;", "&NotEqualTilde;", "&fjlig;",
    "&#128;", "&#x9f;", "&#129;", "&#0;", "&#xD800;", "&#x110000;", "&#99999999999999999999;", "&#xFFFFFFFFF;",
    "&#11;", "&#13;", "&#xFDD0;", "&#x1FFFF;", "&#128512;", "&#0000065;", "&#X41;", "&#;", "&#x;", "&#xg;",
    "&nothing;", "&;", "&", "&&", "&amp;lt;", "& amp;", "&notit;", "&notin", "&copy2024", "&copycopy;", "&AMP;&amp",
    "a&lt", "&#65 b", "&#x41g", "&ampamp;", "&GTDOT;", "&eacute", "x&#8217", "&lt;&gt;", "é&ouml;ß", "&nbsp;|",
]


def test_open_references_as_browsers_take_them(one):
    draw = random.Random(3)
    alphabet = [f"&{n}" for n in draw.sample(sorted(html5), 300)] + KNOWN + list("ab;&#x1 ") * 8
    values = KNOWN + ["".join(draw.choices(alphabet, k=draw.randint(1, 6))) for _ in range(1500)] + ["", None]
    got = one(values, lambda x: references.decode(x, open_ended=True))
    assert got == [None if v is None else html.unescape(v) for v in values]


def test_every_name_of_the_standard(one):
    names = sorted(n for n in html5 if n.endswith(";"))
    assert len(names) > 2000
    assert one([f"[&{n}]" for n in names], references.decode) == [f"[{html5[n]}]" for n in names]


def test_closed_references_only(one):
    def closed(text):
        whole = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
        known = lambda m: m[0] if m[1][0] != "#" and m[1] + ";" not in html5 else html.unescape(m[0])
        return whole.sub(known, text)

    draw = random.Random(4)
    values = KNOWN + ["".join(draw.choices(KNOWN + list("ab;&#x1 "), k=draw.randint(1, 6))) for _ in range(500)]
    assert one(values, references.decode) == [closed(v) for v in values]


def test_names_in_capitals(one):
    values = ["&NTILDE;", "&EACUTE;", "&LT;", "&HELLIP;", "&GTDOT;"]
    assert one(values, lambda x: references.decode(x, capitals=True)) == ["Ñ", "É", "<", "…", "&GTDOT;"]
    assert one(values[:1], references.decode) == ["&NTILDE;"]


def test_nested_references(one):
    values = ["&amp;amp;amp;lt;", "&#38;#38;#x26;amp;eacute;", "&AMP;euro;", "&&num;60;", "R&amp;D", "&amp;amp", "&lt;a"]
    want = ["<", "é", "€", "<", "R&D", "&amp", "<a"]
    assert one(values, references.decode_nested) == want


def test_markup_ends_unescaping(one):
    values = ["&eacute;\n&copy;\n<b>&eacute;</b>\n&copy;", "<p>&copy;", "1 &lt; 2\n3 &gt; 2", "&copy;<"]
    want = ["é\n©\n<b>&eacute;</b>\n&copy;", "<p>&copy;", "1 < 2\n3 > 2", "&copy;<"]
    assert one(values, unescape_html) == want
    assert one(["it&#8217;s &ldquo;so&rdquo; &#x1F600;", "&ntilde;&nbsp;"], repair_text) == ["it's \"so\" 😀", "ñ "]
