"""Surrogates for personal data, in DataFrame expressions only.

Entities found in a text are replaced by stand-ins of the same kind and shape.
A stand-in follows from a secret key, the kind and the canonical value, so the
same person, number or address gets the same one everywhere (coreference),
while case, spacing and punctuation of each mention are kept.  Names keep
their gender, read off the title, and their script.

All distinct values of the corpus are checked once: two values must not share
a stand-in, and a stand-in must not be a value that really occurs.  Values that
fail take the next attempt, which hashes differently, until none fails; only
these exceptions are joined back to the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import materialise

MAX_ATTEMPTS = 50
# From this attempt on, addresses and the names of mailboxes may change their length.
WIDER = 3

# A match starts where a run of its signs starts, so that no run is tried from its middle.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
CARD = r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])"
PHONE = (
    r"(?<![\w.])\+\d{7,15}(?!\w)"
    r"|(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?![\w])"
)
# Four numbers behind a v or the word are a version.
IP = r"(?<![\d.])(?<!(?<![A-Za-z])[vV]\.? ?)(?<!(?i:version|ver\.?) )(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
KEY_ID = r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z])(?i:password|passwd|secret|token|api_?key)\s*[=:]\s*\"?[A-Za-z0-9_+/-]{8,}\"?"
MALE = r"Mr\.?|Herr|Monsieur|Señor|Sr\.|Г-н"
FEMALE = r"Mrs\.?|Ms\.?|Miss|Frau|Madame|Mme\.?|Señora|Sra\.|Г-жа"
OPEN = r"Dr\.?|Prof\.?"
PERSON = rf"(?<![\p{{L}}])(?:{MALE}|{FEMALE}|{OPEN})[  ]\p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?"
ENTITY = "|".join([EMAIL, KEY_ID, SECRET, PERSON, SSN, CARD, IP, PHONE])
TITLED = rf"^(?:{MALE}|{FEMALE}|{OPEN})[  ]\p{{Lu}}"
# What every entity has: a digit, a sign or a title; texts without are left alone at once.
HINT = rf"[0-9@=:]|(?<![\p{{L}}])(?:{MALE}|{FEMALE}|{OPEN})[  ]\p{{Lu}}"

# Syllables that names are made of: endings mark the gender where a script does.
LATIN = "ba be bi da de di do fa fe ga go ha ja ka ke la le li lo ma me mi mo na ne ni no pa ra re ri ro sa se so ta te ti to va ve vi".split()
CYRILLIC = "ба бе ва ве га да де ди ка ке ла ле ли ма ме ми на не ни ра ре ри ро са се со та те ти то".split()
GREEK = "βα γα δα δε κα λα λε λι μα με μι να νε νι ρα ρε ρι ρο σα σε τα τε τι το".split()
ENDINGS = {
    ("latin", "m"): "n", ("latin", "f"): "a", ("latin", "u"): "el",
    ("cyrillic", "m"): "в", ("cyrillic", "f"): "ва", ("cyrillic", "u"): "ко",
    ("greek", "m"): "ς", ("greek", "f"): "α", ("greek", "u"): "ου",
}
SYLLABLES = 5


def kind_of(hit: Column) -> Column:
    return (
        F.when(hit.rlike(f"^(?:{SECRET})$"), "secret")
        .when(hit.contains("@"), "email")
        .when(hit.rlike(f"^(?:{KEY_ID})$"), "key_id")
        .when(hit.rlike(rf"^(?:{MALE})[  ]"), "person_m")
        .when(hit.rlike(rf"^(?:{FEMALE})[  ]"), "person_f")
        .when(hit.rlike(rf"^(?:{OPEN})[  ]"), "person_u")
        .when(hit.rlike(f"^(?:{IP})$"), "ip")
        .when(hit.rlike(f"^(?:{SSN})$"), "ssn")
        .when(hit.startswith("+") | hit.contains("("), "phone")
        .when(F.length(F.regexp_replace(hit, r"\D", "")) >= 13, "card")
        .otherwise("phone")
    )


def frame_of(kind: Column, hit: Column) -> Column:
    """The part of a mention in front of its value, which stays: title, prefix, label."""
    return (
        F.when(kind == "secret", F.regexp_extract(hit, r"^(\w+\s*[=:]\s*\"?)", 1))
        .when(kind == "key_id", F.lit("AKIA"))
        .when(kind.startswith("person"), F.regexp_extract(hit, r"^([^  ]+[  ])", 1))
        .when(kind == "phone", F.regexp_extract(hit, r"^(\+\d{1,3}[ .-]?(?=[(\d]))", 1))
        .otherwise(F.lit(""))
    )


def canonical_of(kind: Column, hit: Column) -> Column:
    """One spelling for all mentions of a value: what stands after the frame, in
    lower case, of numbers only the digits."""
    value = F.substr(hit, F.length(frame_of(kind, hit)) + 1)
    return (
        F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(value, r"\D", ""))
        .when(kind.isin("secret", "key_id"), F.regexp_replace(value, '"', ""))
        .when(kind.startswith("person"), F.regexp_replace(value, " ", "|"))
        .otherwise(F.lower(value))
    )


def _stream(key: str, kind: Column, canonical: Column, attempt: Column) -> Column:
    """Keyed bytes, as hex digits; the hash of key and value is not invertible without the key."""
    inner = F.concat_ws("\x00", F.lit(key), kind, attempt.cast("string"), canonical)
    return F.sha2(F.concat(F.lit(key), F.sha2(inner, 256)), 256)


def _byte(stream: Column, i: Column) -> Column:
    """Number from 0 to 65535 for the i-th character; long values go round the stream."""
    piece = F.substr(stream, i * 3 % 60 + 1, F.lit(4))
    return (F.conv(piece, 16, 10).cast("int") + i * 7919) % 65536


def _shift(char: Column, by: Column) -> Column:
    code = F.ascii(char)
    return (
        F.when(char.rlike("^[0-9]$"), F.char(F.lit(48) + (code - 48 + by) % 10))
        .when(char.rlike("^[a-z]$"), F.char(F.lit(97) + (code - 97 + by) % 26))
        .when(char.rlike("^[A-Z]$"), F.char(F.lit(65) + (code - 65 + by) % 26))
        .otherwise(char)
    )


def _each(text: Column, fn) -> Column:
    spots = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(
        F.array().cast("array<int>")
    )
    return F.array_join(F.transform(spots, lambda i: fn(F.substr(text, i, F.lit(1)), i)), "")


def _shaped(text: Column, stream: Column) -> Column:
    """Digits to digits and letters to letters; a number does not start with a new zero."""

    def one(char, i):
        by = _byte(stream, i)
        first = (i == 1) & char.rlike("^[1-9]$")
        return F.when(first, F.char(F.lit(49) + (F.ascii(char) - 49 + by) % 9)).otherwise(
            _shift(char, by)
        )

    return _each(text, one)


def _hexlike(text: Column, stream: Column) -> Column:
    """As ``_shaped``, but hexadecimal values stay hexadecimal."""
    small = _each(
        text,
        lambda c, i: F.when(
            c.rlike("^[a-f]$"), F.char(F.lit(97) + (F.ascii(c) - 97 + _byte(stream, i)) % 6)
        ).otherwise(_shift(c, _byte(stream, i))),
    )
    return F.when(text.rlike("^[0-9a-f]+$"), small).otherwise(_shaped(text, stream))


def _luhn_digit(body: Column) -> Column:
    """The check digit that makes a card number whole."""
    n = F.length(body)

    def add(total, i):
        d = F.substr(body, n - i, F.lit(1)).cast("int")
        doubled = F.when(i % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
        return total + doubled

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)
    return ((10 - total % 10) % 10).cast("string")


def _is_luhn(number: Column) -> Column:
    body = F.substr(number, F.lit(1), F.length(number) - 1)
    return _luhn_digit(body) == F.right(number, F.lit(1))


def _octets(ip: Column, stream: Column) -> Column:
    """As many digits in each part as before, within the range of addresses; any after some attempts."""

    def one(part, i):
        by = _byte(stream, i + 1)
        return (
            F.when(F.col("attempt") >= WIDER, 1 + by % 254)
            .when(F.length(part) == 1, 1 + by % 9)
            .when(F.length(part) == 2, 10 + by % 90)
            .otherwise(100 + by % 155)
            .cast("string")
        )

    return F.array_join(F.transform(F.split(ip, r"\."), one), ".")


def _script(word: Column) -> Column:
    return (
        F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic")
        .when(word.rlike(r"\p{IsGreek}"), "greek")
        .otherwise("latin")
    )


def _name(word: Column, gender: Column, key: str, attempt: Column) -> Column:
    """Syllables of the script of a word, an ending of its gender, its use of capitals."""
    stream = _stream(key, gender, F.lower(word), attempt)
    script = _script(word)

    def of(name: str, syllables: list[str]) -> Column:
        listed = F.array(*[F.lit(s) for s in syllables])
        body = F.array_join(
            F.transform(
                F.sequence(F.lit(1), F.lit(SYLLABLES)),
                lambda i: F.element_at(listed, (_byte(stream, i) % len(syllables) + 1)),
            ),
            "",
        )
        ending = F.lit(ENDINGS[(name, "u")])
        for g in "mf":
            ending = F.when(gender == g, ENDINGS[(name, g)]).otherwise(ending)
        return F.concat(body, ending)

    made = (
        F.when(script == "cyrillic", of("cyrillic", CYRILLIC))
        .when(script == "greek", of("greek", GREEK))
        .otherwise(of("latin", LATIN))
    )
    return F.when(word == F.upper(word), F.upper(made)).otherwise(F.initcap(made))


def surrogate(kind: str, key: str) -> Column:
    """The stand-in, itself canonical, of ``canonical``; of the columns ``stream``, ``kind``
    and ``attempt`` of one kind of values."""
    canonical, stream = F.col("canonical"), F.col("stream")
    if kind == "email":
        domain = F.substring_index(canonical, "@", -1)
        host = F.regexp_extract(domain, r"^(.*)\.([^.]+)$", 1)
        own = _stream(key, F.lit("domain"), host, F.lit(0))
        new_domain = F.when(
            domain.rlike(r"(^|\.)example\.(com|org|net)$"), domain
        ).otherwise(F.concat(_shaped(host, own), F.lit("."), F.substring_index(domain, ".", -1)))
        more = F.translate(F.left(stream, F.lit(4)), "0123456789", "ghijklmnop")
        longer = F.when(F.col("attempt") >= WIDER, more).otherwise("")
        return F.concat(_shaped(F.substring_index(canonical, "@", 1), stream), longer, F.lit("@"), new_domain)
    if kind == "ip":
        return _octets(canonical, stream)
    if kind == "card":
        body = _shaped(F.substr(canonical, F.lit(1), F.length(canonical) - 1), stream)
        last = _shift(F.right(canonical, F.lit(1)), _byte(stream, F.lit(61)))
        return F.concat(body, F.when(_is_luhn(canonical), _luhn_digit(body)).otherwise(last))
    if kind == "secret":
        return _hexlike(canonical, stream)
    if kind.startswith("person"):
        # a surname alone and one behind a given name lead to the same stand-in
        gender, attempt = F.right("kind", F.lit(1)), F.col("attempt")
        words = F.transform(F.split(canonical, r"\|"), lambda w: _name(w, gender, key, attempt))
        return F.array_join(words, "|")
    return _shaped(canonical, stream)


def _dressed(kind: Column, hit: Column, new: Column) -> Column:
    """A stand-in in the shape of one mention."""
    frame = frame_of(kind, hit)
    value = F.substr(hit, F.length(frame) + 1)
    # the n-th digit of the mention becomes the n-th digit of the stand-in
    digits = _each(
        value,
        lambda c, i: F.when(
            c.rlike("^[0-9]$"),
            F.substr(new, F.length(F.regexp_replace(F.substr(value, F.lit(1), i), r"\D", "")), F.lit(1)),
        ).otherwise(c),
    )
    cased = F.when((value == F.upper(value)) & value.rlike("[A-Z]"), F.upper(new)).otherwise(new)
    return F.concat(
        frame,
        F.when(kind.isin("phone", "card", "ssn"), digits)
        .when(kind == "email", cased)
        .when(kind == "secret", F.concat(new, F.when(value.endswith('"'), '"').otherwise("")))
        .when(kind.startswith("person"), F.regexp_replace(new, r"\|", " "))
        .otherwise(new),
    )


def _hits(text_col: str) -> Column:
    return F.regexp_extract_all(text_col, F.lit(f"({ENTITY})"), F.lit(0))


def _name_of(hit: Column) -> Column:
    """The name behind a title, without an ending that belongs to the sentence."""
    return F.regexp_replace(F.regexp_replace(hit, r"^[^  ]+[  ]", ""), r"(?:'s|['-]+)$", "")


def _titled_names(hits: Column) -> Column:
    """Names that stand behind a title, and their last words, the longest first."""
    whole = F.transform(F.filter(hits, lambda h: h.rlike(TITLED)), _name_of)
    both = F.flatten(F.transform(whole, lambda n: F.array(n, F.substring_index(n, " ", -1))))
    kept = F.filter(F.array_distinct(both), lambda n: n.rlike(r"^\p{Lu}['\p{L}]"))
    by_length = F.array_sort(F.transform(kept, lambda n: F.struct((-F.length(n)).alias("l"), n.alias("n"))))
    return F.transform(by_length, lambda s: s["n"])


def _pattern(names: Column) -> Column:
    """Entities, and names known from a title, of one text."""
    bare = F.array_join(F.transform(names, lambda n: F.concat(F.lit(r"\Q"), n, F.lit(r"\E"))), "|")
    return F.concat(F.lit(rf"(?:{ENTITY}|(?<![\p{{L}}-])(?:"), bare, F.lit(r")(?![\p{L}-]))"))


def _bare(hit: Column, hits: Column, new_of: Column) -> Column:
    """The stand-in of a name without a title: that of the first titled mention of it."""
    tail = F.concat(F.lit(" "), hit)
    same = F.get(F.filter(hits, lambda h: h.rlike(TITLED) & ((_name_of(h) == hit) | _name_of(h).endswith(tail))), F.lit(0))
    new = F.regexp_replace(F.element_at(new_of, same), r"^[^  ]+[  ]", "")
    return F.coalesce(F.when(_name_of(same) == hit, new).otherwise(F.substring_index(new, " ", -1)), hit)


def mentions(marked: DataFrame) -> DataFrame:
    """``(hit, kind, canonical)`` of every different mention in ``_pii_hits`` but names without a title.

    Equal mentions are brought together before anything is told of them.
    """
    hits = marked.select(F.explode(F.array_except("_pii_hits", "_pii_names")).alias("hit"))
    hits = materialise(hits.groupBy("hit").agg(F.count("*").alias("n")), "pii-hits")
    kinds = materialise(hits.select("hit", kind_of(F.col("hit")).alias("kind")), "pii-kinds")
    return kinds.select("hit", "kind", canonical_of(F.col("kind"), F.col("hit")).alias("canonical"))


def _tried(rows: DataFrame, key: str) -> DataFrame:
    """``(kind, canonical, attempt)`` with the stand-in of that attempt.

    Kinds are handled one by one, so that no row passes the expressions of another.
    """
    streamed = rows.withColumn(
        "stream", _stream(key, F.col("kind"), F.col("canonical"), F.col("attempt"))
    )
    parts = []
    for kinds in (["email"], ["ip"], ["card"], ["secret"], ["person_m", "person_f", "person_u"],
                  ["phone", "ssn", "key_id"]):
        own = streamed.where(F.col("kind").isin(kinds))
        parts.append(
            own.select("kind", "canonical", "attempt", surrogate(kinds[0], key).alias("surrogate"))
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def assign(values: DataFrame, key: str) -> DataFrame:
    """``(kind, canonical, attempt, surrogate)`` without two equal stand-ins in a kind
    and without a stand-in that is itself a value.

    Each round tries the values that failed once more; a round is written
    before the next one reads it.
    """
    values = materialise(values.select("kind", "canonical").distinct(), "pii-values")
    real = values.select("kind", F.lower("canonical").alias("same")).distinct()
    now = materialise(_tried(values.withColumn("attempt", F.lit(0)), key), "pii-assigned")
    for _ in range(MAX_ATTEMPTS):
        # of values with one stand-in the one tried most often keeps it, then the least
        shared = now.groupBy("kind", F.lower("surrogate").alias("same")).agg(
            F.count("*").alias("n"),
            F.min(F.struct((-F.col("attempt")).alias("a"), "canonical")).alias("best"),
        )
        clash = shared.join(real, ["kind", "same"], "left_semi").select(
            "kind", "same", F.lit(None).cast("string").alias("keeps")
        )
        several = shared.where("n > 1").join(real, ["kind", "same"], "left_anti")
        bad = materialise(
            clash.unionByName(several.select("kind", "same", F.col("best.canonical").alias("keeps"))),
            "pii-clashes",
        )
        if bad.isEmpty():
            return now
        joined = now.withColumn("same", F.lower("surrogate")).join(bad, ["kind", "same"])
        failed = joined.where("keeps IS NULL OR keeps <> canonical").select(
            "kind", "canonical", (F.col("attempt") + 1).alias("attempt")
        )
        failed = materialise(failed, "pii-failed")
        kept = now.join(failed.select("kind", "canonical"), ["kind", "canonical"], "left_anti")
        now = materialise(kept.unionByName(_tried(failed, key)), "pii-assigned")
    raise ValueError(f"stand-ins clash after {MAX_ATTEMPTS} attempts: too few of a kind's shape")


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with the entities of the text replaced, and
    ``n_entities`` behind them.

    Null, empty and entity-free texts stay as they are; repeated rows are
    changed alike.  A column named ``n_entities`` is replaced; names that begin
    with ``_pii`` are kept for the work.  Texts are searched once, and only those
    with entities are moved; texts with a titled name are searched once more for
    the same name, or its last word, without a title.  A given name alone, and names
    that no title goes with in the same text, are not found.  Very long texts are
    searched whole; their hits are held as one array.
    """
    columns = [c for c in docs.columns if c != "n_entities"]
    none = F.array().cast("array<string>")
    hits = F.when(F.col(text_col).rlike(HINT), _hits(text_col)).otherwise(none)
    docs = docs.select(*[F.col(f"`{c}`") for c in columns], hits.alias("_pii_hits"))
    docs = docs.withColumn("_pii_names", _titled_names(F.col("_pii_hits")))
    again = F.regexp_extract_all(text_col, _pattern(F.col("_pii_names")), F.lit(0))
    docs = docs.withColumn("_pii_hits", F.when(F.size("_pii_names") > 0, again).otherwise(F.col("_pii_hits")))
    docs = materialise(docs, "pii-marked")
    found = materialise(mentions(docs), "pii-mentions")
    assigned = assign(found, key).select("kind", "canonical", "surrogate")
    dressed = found.join(assigned, ["kind", "canonical"]).select(
        "hit", _dressed(F.col("kind"), F.col("hit"), F.col("surrogate")).alias("new")
    )
    dressed = materialise(dressed, "pii-replacements")
    plain = docs.where("size(_pii_hits) = 0").drop("_pii_hits", "_pii_names").withColumn("n_entities", F.lit(0))
    digest = F.sha2(text_col, 256).alias("_pii_digest")
    marked = docs.where("size(_pii_hits) > 0").select("*", digest)
    per_text = marked.select("_pii_digest", F.explode(F.array_except("_pii_hits", "_pii_names")).alias("hit")).distinct()
    new_of = (
        per_text.join(dressed, "hit")
        .groupBy("_pii_digest")
        .agg(F.map_from_entries(F.collect_list(F.struct("hit", "new"))).alias("_pii_new"))
    )
    joined = marked.join(new_of, "_pii_digest")
    pieces = F.when(F.size("_pii_names") > 0, F.split(text_col, _pattern(F.col("_pii_names")), -1)).otherwise(
        F.split(text_col, f"(?:{ENTITY})", -1)
    )
    news = F.transform(
        "_pii_hits",
        lambda h: F.when(
            F.array_contains("_pii_names", h), _bare(h, F.col("_pii_hits"), F.col("_pii_new"))
        ).otherwise(F.element_at("_pii_new", h)),
    )
    padded = F.concat(news, F.array(F.lit("")))
    text = F.array_join(F.flatten(F.zip_with(pieces, padded, lambda a, b: F.array(a, b))), "")
    changed = joined.select(
        *[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in columns],
        F.size("_pii_hits").alias("n_entities"),
    )
    return plain.unionByName(changed)
