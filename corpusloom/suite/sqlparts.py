"""Pieces of SQL for the twins, written apart from the Spark expressions."""

SP = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
NSP = "[^" + SP[1:]
TOK = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_" + SP[1:]


def word_list(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{SP}+'), lambda w: w <> '')"


def n_words(x: str) -> str:
    return f"CAST(len({word_list(x)}) AS INTEGER)"


def host(url: str) -> str:
    """Authority of a URL, lower case."""
    return f"lower(regexp_extract({url}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)', 1))"


def bare(url: str) -> str:
    return f"regexp_replace({url}, '^[a-zA-Z][a-zA-Z0-9+.-]*://', '')"


def seed(x: str) -> str:
    """sha-256 as a number modulo 10**8, by sixteen-bit chunks."""
    return (
        f"list_reduce(list_transform(range(0, 16), lambda i: "
        f"CAST('0x' || substr(sha256({x}), CAST(i * 4 + 1 AS BIGINT), 4) AS BIGINT)), "
        f"lambda a, c: (a * 65536 + c) % 100000000, CAST(0 AS BIGINT))"
    )


# References that the given tables hold, and some that they do not.
REFERENCES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&#39;", "''"),
    ("&#x27;", "''"), ("&#34;", '"'), ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&reg;", "®"),
    ("&trade;", "™"), ("&middot;", "·"), ("&hellip;", "…"), ("&ndash;", "–"),
    ("&mdash;", "—"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"),
    ("&rdquo;", "”"), ("&eacute;", "é"),
]


def unescaped(x: str) -> str:
    for a, b in REFERENCES:
        x = f"replace({x}, '{a}', '{b}')"
    return x


def repaired(x: str) -> str:
    """Text repair but for mojibake, which SQL cannot undo."""
    head = f"CASE WHEN contains({x}, '<') THEN regexp_extract({x}, '^[^<]*\\n') ELSE {x} END"
    plain = unescaped(f"regexp_replace({head}, '&(amp;)+', '&', 'g')")
    out = f"concat({plain}, substr({x}, length({head}) + 1))"
    out = f"CASE WHEN contains({x}, '&') THEN {out} ELSE {x} END"
    for a, b in [("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"),
                 ("ﬅ", "ſt"), ("ﬆ", "st")]:
        out = f"replace({out}, '{a}', '{b}')"
    wide = "".join(map(chr, range(65281, 65375)))
    plain = "".join(map(chr, range(33, 127))).replace("'", "''")
    out = f"translate({out}, '{wide}　', '{plain} ')"
    out = f"regexp_replace({out}, '[ʼ‘’‚‛]', '''', 'g')"
    out = f"""regexp_replace({out}, '[“”„‟]', '"', 'g')"""
    out = rf"regexp_replace({out}, '\r\n|[\r\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g')"
    out = rf"regexp_replace({out}, '\x1b\[[0-9;]*[a-zA-Z]', '', 'g')"
    return (
        rf"regexp_replace({out}, '[\x00-\x08\x0b\x0e-\x1f\x7f\x{{206a}}-\x{{206f}}"
        rf"\x{{feff}}\x{{fff9}}-\x{{fffc}}]', '', 'g')"
    )


GAZETTEER = {
    "The": "ORG",
    "Of": "PER",
    "And": "LOC",
    "De": "PER",
    "Der": "ORG",
    "Et": "LOC",
    "La": "PER",
    "Le": "ORG",
    "Und": "LOC",
    "Die": "PER",
}
CAND = r"(?:^|[^\p{L}])(\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*)"


def entity_list(x: str) -> str:
    """Structs (word, g) in order of appearance."""
    whens = " ".join(f"WHEN '{w}' THEN '{g}'" for w, g in GAZETTEER.items())
    return (
        f"list_transform(regexp_extract_all({x}, '{CAND}', 1), "
        f"lambda w: {{'word': w, 'g': CASE w {whens} ELSE 'MISC' END}})"
    )


def masked(text: str, raw: str) -> str:
    """``text`` with the entities found in ``raw`` masked; needs lists in scope."""
    ordered = (
        f"list_sort(list_transform(list_distinct(regexp_extract_all({raw}, '{CAND}', 1)), "
        f"lambda w: {{'l': -length(w), "
        f"'i': list_position(regexp_extract_all({raw}, '{CAND}', 1), w), 'w': w}}))"
    )
    steps = (
        f"list_transform({ordered}, lambda e, r: {{'w': e.w, 'm': '<MASK_' || "
        f"CAST(({seed(text)} + (r - 1) * 7919) % 99999 + 1 AS VARCHAR) || '>'}})"
    )
    return f"list_reduce({steps}, lambda t, e: replace(t, e.w, e.m), {text})"


def hdd_ctes(source: str, id_col: str = "row_id", text: str = "text") -> str:
    """CTE ``hdd(row_id, words, terms, hdd)`` for the rows of ``source``."""
    return rf"""
toks AS (SELECT {id_col} AS row_id,
                unnest(regexp_extract_all(lower({text}), '\p{{L}}+')) AS w FROM {source}),
freq AS (SELECT row_id, w, count(*) AS c FROM toks GROUP BY ALL),
size AS (SELECT row_id, CAST(sum(c) AS BIGINT) AS n, count(*) AS terms FROM freq GROUP BY row_id),
drawn AS (SELECT *, least(42, greatest(1, CAST(floor(CAST(0.8 AS DOUBLE) * n) AS BIGINT))) AS d
          FROM size),
cells AS (SELECT f.row_id, f.c, count(*) AS m, any_value(n) AS n, any_value(d) AS d
          FROM freq f JOIN drawn USING (row_id) GROUP BY f.row_id, f.c),
hdd AS (SELECT row_id, any_value(n) AS words, CAST(sum(m) AS BIGINT) AS terms,
               sum(m * (1 - CASE WHEN n - c < d THEN 0 ELSE
                 list_reduce(range(0, d), lambda p, i: p * (n - c - i) / (n - i),
                             CAST(1 AS DOUBLE)) END) / d) AS hdd
        FROM cells GROUP BY row_id)"""


def ranked(alias: str = "row_id") -> str:
    return f"md5('42:' || CAST({alias} AS VARCHAR))"
