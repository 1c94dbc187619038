"""PII replaced by keyed surrogates, in DataFrame operations only.

Found are e-mail addresses, telephone numbers, IPv4 addresses, payment cards (16 digits in an issuer's range that pass the
Luhn check), social security numbers, access tokens of 32 to 64 hex digits, and persons (a title, or a known given name,
before a capitalised name). Each is replaced by a surrogate of its own type and format, which depends on a key and on the
value alone, so all mentions of a value agree, in every document and however they are written (addresses and tokens in
either letter case, numbers with any separators).

A value is a row of symbols, each from an alphabet of its own: a letter from its script and case, a digit, an octet. The
surrogate is a keyed permutation of all rows with those alphabets: a Feistel network whose rounds are HMAC-SHA-256, a keyed
step forward, and the network's inverse. So distinct values have distinct surrogates by construction, however small the space
is, and none is its own surrogate. Kept as they are: a card's first four digits (the check digit follows the others), a
telephone number's country code and the digit after it, a special IPv4 range, an address's last label, a title.
Addresses of one host keep one host. Names are replaced name by name, so "Mr. Smith" agrees with "John Smith": a known given
name becomes another one of its gender and script; other names keep what carries their gender, a Slavic surname's ending
(Иванов and Иванова keep one stem), else the last letter from three letters on, and never become a known name or gain an
ending. The surrogates of all distinct values are compared before any text is written, and a collision is an error.

Defined results: null and empty texts hold nothing; what fails its check (a card number, an octet) stays; host names have 20
labels and local parts 64 characters at most; rows that repeat an id, and rows without one, are rows like others; texts
without findings keep every character; an empty table gives none; extra columns pass through under any name, unless it is a
result's (n_entities, kinds), which is replaced.
"""

from __future__ import annotations

import hashlib
import hmac
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, stage_table

_LOCAL = r"\p{L}\p{N}._%+\-"
#: Given names by gender and script (fixed values).
NAMES = {
    "female latin": "alice amelia anna barbara camille carmen caroline charlotte chloe clara elena elizabeth emily emma eva fatima hannah helen ingrid isabella jane jessica julia karen katharina laura lena linda lucia margaret maria marie martha mary mia nicole nina olivia patricia paula rosa ruth sarah sofia sophie susan teresa ursula".split(),
    "male latin": "adam ahmed albert alexander andrew anthony ben carlos charles christian daniel david diego edward felix frank george hans henry ivan jack jakob james jean john jose juan karl kevin lars louis luis lukas mark martin michael mohamed oliver oscar otto pablo paul peter philip pierre richard robert simon stefan thomas tom victor william".split(),
    "female cyrillic": "александра алина анастасия анна виктория екатерина елена ирина ксения людмила марина мария надежда наталья ольга светлана татьяна юлия".split(),
    "male cyrillic": "александр алексей андрей антон борис василий владимир виктор дмитрий евгений иван игорь максим михаил николай олег павел сергей".split(),
}
#: Titles before a name (fixed values).
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Mlle Señor Señora Sr Sra Г-н Г-жа г-н г-жа".split()
#: Endings of Slavic surnames, by gender (fixed values); none is the end of another.
ENDINGS = "ов ев ёв ин ын ский цкий ова ева ёва ина ына ская цкая".split()
SLAVIC = rf"^..+?({'|'.join(ENDINGS)})$"
_ANY_NAME = "|".join(n.capitalize() for names in NAMES.values() for n in names)
PATTERNS = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}+@(?:[A-Za-z0-9\-]{{1,63}}+\.){{1,20}}[A-Za-z]{{2,24}}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])",
    "person": rf"(?<![\p{{L}}\p{{N}}])(?=\p{{Lu}}|г)(?:(?:{'|'.join(TITLES)})\.? \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?|(?:{_ANY_NAME}) \p{{Lu}}\p{{Ll}}+)(?!\p{{L}})",
    "card": r"(?<![\d.\-])(?:\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{16})(?![\d\-]|\.\d)",
    "phone": r"(?<![\d+])\+\d{1,3}[ .\-]?(?:\(\d{2,4}\)|\d{2,4})[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\d)|(?<![\d+])\(\d{3}\) ?\d{3}[.\-]\d{4}(?!\d)",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
}
#: All of them; where neither a word nor a number begins, a position is passed by at once.
_WORDLIKE, _NUMBERLIKE = ("email", "secret", "person"), ("card", "phone", "ip", "ssn")
ANY = rf"(?<![0-9A-Za-z])(?:{'|'.join(f'(?:{PATTERNS[k]})' for k in _WORDLIKE)})|(?=[\d+(])(?:{'|'.join(f'(?:{PATTERNS[k]})' for k in _NUMBERLIKE)})"
#: Issuers' ranges of 16-digit cards, and the calling codes of one and two digits, the others having three (fixed values).
ISSUERS = r"^(?:4|5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|352[89]|35[3-8]|6011|62|64[4-9]|65)"
CALLING_CODE = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{1,3})"
#: Alphabets as (first code point, step, size): letters by script and case, and digits.
ALPHABETS = [
    (0x61, 1, 26), (0x41, 1, 26), (0x30, 1, 10), (0xE0, 1, 23), (0xF8, 1, 7), (0xC0, 1, 23), (0xD8, 1, 7), (0x430, 1, 32), (0x410, 1, 32),
    (0x3B1, 1, 17), (0x3C3, 1, 7), (0x391, 1, 17), (0x3A3, 1, 7), (0x101, 2, 24), (0x100, 2, 24), (0x13A, 2, 8), (0x139, 2, 8), (0x14B, 2, 23), (0x14A, 2, 23),
    (0x5D0, 1, 27), (0x621, 1, 26), (0x641, 1, 10), (0x905, 1, 53), (0x3041, 1, 86), (0x30A1, 1, 90), (0x4E00, 1, 20992), (0xAC00, 1, 11172),
]
#: First octets that stay, and those of which the second stays too; all others change among themselves.
KEPT_OCTETS = [0, 10, 127, *range(224, 256)]
HALF_KEPT_OCTETS = [172, 192]
FREE_OCTETS = [n for n in range(256) if n not in KEPT_OCTETS and n not in HALF_KEPT_OCTETS]
KEPT_START = rf"^(?:(?:{'|'.join(map(str, KEPT_OCTETS))})\.|(?:{'|'.join(map(str, HALF_KEPT_OCTETS))})\.\d+\.)"
#: Private characters that stand for a free first octet's place, for an octet, for one that stays, and for hex digits.
OCTET_PLACES, OCTETS, STAYING, HEX_FROM = 0xE000, 0xE100, 0xE200, 0xE300
HEX = "0123456789abcdef"
HEX_CHARACTERS = "".join(chr(HEX_FROM + i) for i in range(16))
ALPHABETS += [(OCTET_PLACES, 1, len(FREE_OCTETS)), (OCTETS, 1, 256), (HEX_FROM, 1, 16)]
ROUNDS = 4
#: Most steps to the next permuted name that may be taken; each is needed with a chance of a few per cent.
NAME_STEPS = 48


def once(value: Column, use) -> Column:
    """use(value), where value is computed once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def characters(text: Column) -> Column:
    size = F.length(text)
    return F.when(size > 0, F.transform(F.sequence(F.lit(1), size), lambda i: F.substr(text, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def luhn_sum(digits: Column) -> Column:
    """Luhn's sum of a string of digits, from the right."""
    values = F.reverse(F.split(digits, ""))
    step = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int"))
    return F.aggregate(F.transform(values, step), F.lit(0), lambda a, v: a + v)


def kind_of(m: Column) -> Column:
    """The type of a match, null if it fails its check."""
    digits = F.regexp_replace(m, r"\D", "")
    whole = lambda k: F.rlike(m, F.lit(f"^(?:{PATTERNS[k]})$"))
    octets = F.forall(F.split(m, r"\."), lambda o: F.try_to_number(o, F.lit("999")) <= 255)
    return (
        F.when(F.contains(m, F.lit("@")), F.lit("email"))
        .when(whole("secret"), F.lit("secret"))
        .when(whole("card"), F.when((luhn_sum(digits) % 10 == 0) & F.rlike(digits, F.lit(ISSUERS)), F.lit("card")))
        .when(whole("ip"), F.when(octets, F.lit("ip")))
        .when(whole("phone"), F.lit("phone"))
        .when(whole("ssn"), F.lit("ssn"))
        .otherwise(F.lit("person"))
    )


def classified(matches: Column) -> Column:
    """Of each match (m, kind, title, units): units are its values (kind, norm), one for each name of a person.

    Each step is a transform of its own, so that what it needs twice is computed once.
    """
    kinds = F.transform(matches, lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    titles = rf"^(?:{'|'.join(TITLES)})\.? "

    def parts(x: Column) -> Column:
        m, kind = x["m"], x["kind"]
        digits = F.regexp_replace(m, r"\D", "")
        # A telephone number without a country code is of the form that North America has.
        number = F.when(F.startswith(m, F.lit("+")), digits).otherwise(F.concat(F.lit("1"), digits))
        octets = F.array_join(F.transform(F.split(m, r"\."), lambda o: o.cast("int").cast("string")), ".")
        norm = F.when(kind == "email", F.lower(m)).when(kind.isin("card", "ssn"), digits).when(kind == "phone", number).when(kind == "ip", octets).when(kind == "secret", F.lower(m)).otherwise(m)
        one = F.array(F.struct(kind.alias("kind"), norm.alias("norm")))
        names = F.transform(F.split(F.lower(F.regexp_replace(m, titles, "")), " "), lambda t: F.struct(F.lit("name").alias("kind"), t.alias("norm")))
        units = F.when(kind.isNull(), F.slice(one, 1, 0)).when(kind == "person", names).otherwise(one)
        return F.struct(m.alias("m"), kind.alias("kind"), F.regexp_extract(m, titles, 0).alias("title"), units.alias("units"))

    return F.transform(kinds, parts)


def keyed_hash(key: str, message: Column) -> Column:
    """HMAC-SHA-256 of a text, as 64 hex digits."""
    block = key.encode()
    block = (hashlib.sha256(block).digest() if len(block) > 64 else block).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in block)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def deranged(symbols: Column, sizes: Column, tweak: Column, key: str) -> Column:
    """A row of numbers moved by a keyed permutation without fixed points; each stays below its size, those of size 0 stay.

    The tweak says which permutation; it may depend on nothing that the permutation changes.
    """
    half = F.floor(F.size(sizes) / 2)
    draw = lambda stream, i: F.conv(F.substr(stream, F.pmod(i * 5, F.lit(56)).cast("int") + 1, F.lit(8)), 16, 10).cast("long")

    def moved(row: Column, step: Column) -> Column:
        number = F.abs(step)
        mine = lambda i: (i < half) == (number % 2 == 1)
        other = F.array_join(F.transform(row, lambda v, i: F.when(mine(i), F.lit("")).otherwise(v.cast("string"))), ",")
        message = F.concat_ws("|", tweak, number.cast("string"), other)
        return once(keyed_hash(key, message), lambda s: F.transform(row, lambda v, i: F.when(mine(i) & (sizes[i] > 1), F.pmod(v + F.signum(step).cast("long") * draw(s, i), sizes[i])).otherwise(v)))

    def turned(row: Column) -> Column:
        last = F.array_max(F.transform(sizes, lambda n, i: F.when(n > 1, i)))
        by = once(keyed_hash(key, F.concat_ws("|", tweak, F.lit("turn"))), lambda s: F.transform(row, lambda v, i: F.when(i == last, F.pmod(v + 1 + F.pmod(draw(s, F.lit(0)), sizes[i] - 1), sizes[i])).otherwise(v)))
        return F.when(last.isNull(), row).otherwise(by)

    steps = F.array(*[F.lit(s) for s in (*range(1, ROUNDS + 1), 0, *range(-ROUNDS, 0))])
    return F.aggregate(steps, symbols, lambda row, step: F.when(step == 0, turned(row)).otherwise(moved(row, step)))


def code_point(c: Column) -> Column:
    """The number of a character of the basic plane, null for others."""
    return F.when(F.length(c) == 1, F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("long"))


def character(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def swapped(text: Column, tweak: Column, key: str) -> Column:
    """A text with its letters and digits moved within their alphabets, all others staying."""
    row = lambda first, step, size: F.array(F.lit(first), F.lit(step), F.lit(size)).cast("array<long>")

    def placed(u: Column) -> Column:
        out = F.when(u.isNull(), row(0, 0, 0))
        for first, step, size in ALPHABETS:
            here = u.between(first, first + step * (size - 1))
            out = out.when(here if step == 1 else here & ((u - first) % step == 0), row(first, step, size))
        return out.otherwise(row(0, 0, 0))

    coded = F.transform(characters(text), lambda c: F.struct(c.alias("c"), code_point(c).alias("u")))
    each = F.transform(coded, lambda x: F.struct(x["c"].alias("c"), x["u"].alias("u"), placed(x["u"]).alias("of")))

    def whole(chars: Column) -> Column:
        symbols = F.transform(chars, lambda x: F.when(x["of"][2] > 0, ((x["u"] - x["of"][0]) / x["of"][1]).cast("long")).otherwise(F.coalesce(x["u"], F.lit(0).cast("long"))))
        sizes = F.transform(chars, lambda x: x["of"][2])
        said = F.concat_ws("|", tweak, F.array_join(F.transform(chars, lambda x: x["of"][0].cast("string")), ","))
        new = once(sizes, lambda n: deranged(symbols, n, said, key))
        return F.array_join(F.zip_with(chars, new, lambda x, v: F.when(x["of"][2] > 0, character(x["of"][0] + v * x["of"][1])).otherwise(x["c"])), "")

    return once(each, whole)


def octet_characters(norm: Column) -> Column:
    """An IPv4 address as four characters of the private area: one that may change is in an alphabet, one that stays is not."""

    def one(octets: Column) -> Column:
        place = F.array_position(F.array(*[F.lit(n).cast("long") for n in FREE_OCTETS]), octets[0])
        first = F.when(place > 0, place - 1 + OCTET_PLACES).otherwise(octets[0] + STAYING)
        second = octets[1] + F.when(octets[0].isin(HALF_KEPT_OCTETS), STAYING).otherwise(OCTETS)
        return F.concat(character(first), character(second), character(octets[2] + OCTETS), character(octets[3] + OCTETS))

    return once(F.transform(F.split(norm, r"\."), lambda o: o.cast("long")), one)


def octets_of(text: Column) -> Column:
    listed = F.array(*[F.lit(n).cast("long") for n in FREE_OCTETS])
    value = lambda u: F.when(u < OCTETS, F.element_at(listed, (u - OCTET_PLACES + 1).cast("int"))).when(u < STAYING, u - OCTETS).otherwise(u - STAYING)
    return F.array_join(F.transform(F.transform(characters(text), code_point), lambda u: value(u).cast("string")), ".")


def cycle_of(names: list[str], key: str, group: str) -> dict[str, str]:
    """A keyed permutation of a list that is one cycle, so that no name keeps its place (Sattolo's)."""
    rng = random.Random(hmac.new(key.encode(), group.encode(), hashlib.sha256).digest())
    out = list(names)
    for i in range(len(out) - 1, 0, -1):
        j = rng.randrange(i)
        out[i], out[j] = out[j], out[i]
    return dict(zip(names, out, strict=True))


def parts_of(kind: Column, norm: Column) -> Column:
    """The parts (before, text, after, tweak) of a value: what changes, between what stays."""
    part = lambda before, text, after, tweak: F.struct(before.alias("before"), text.alias("text"), after.alias("after"), tweak.alias("tweak"))
    nothing, from_start = F.lit(""), lambda n: F.substr(norm, F.lit(1), n)
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    last = F.substring_index(domain, ".", -1)
    host = F.substr(domain, F.lit(1), F.length(domain) - F.length(last))
    country = from_start(F.length(F.regexp_extract(norm, CALLING_CODE, 0)) + 1)
    ending = F.when(F.rlike(norm, F.lit(SLAVIC)), F.regexp_extract(norm, SLAVIC, 1)).when(F.length(norm) > 2, F.substring(norm, -1, 1)).otherwise(nothing)
    return (
        F.when(kind == "email", F.array(part(nothing, local, F.lit("@"), F.concat_ws("@", F.lit("email"), domain)), part(nothing, host, last, F.lit("host"))))
        .when(kind == "card", F.array(part(F.substring(norm, 1, 4), F.substring(norm, 5, 11), nothing, F.lit("card"))))
        .when(kind == "phone", F.array(part(country, F.substr(norm, F.length(country) + 1), nothing, F.concat_ws("|", F.lit("phone"), country))))
        .when(kind == "ip", F.array(part(nothing, octet_characters(norm), nothing, F.concat_ws("|", F.lit("ip"), F.regexp_extract(norm, KEPT_START, 0)))))
        .when(kind == "secret", F.array(part(nothing, F.translate(norm, HEX, HEX_CHARACTERS), nothing, F.lit("secret"))))
        .when(kind == "name", F.array(part(nothing, from_start(F.length(norm) - F.length(ending)), ending, F.concat_ws("|", F.lit("name"), F.when(F.length(ending) == 1, ending)))))
        .otherwise(F.array(part(nothing, norm, nothing, kind)))
    )


def surrogate(kind: Column, norm: Column, key: str) -> Column:
    """What a value becomes, in its normal form."""
    known = F.create_map(*[F.lit(x) for group, names in NAMES.items() for pair in cycle_of(names, key, group).items() for x in pair])
    taken = lambda n: F.map_contains_key(known, n)

    def moved(p: Column) -> Column:
        # A name without a Slavic ending takes further steps while it is a known one or has gained an ending.
        slavic = F.length(p["after"]) > 1
        again = lambda n: (kind == "name") & (taken(F.concat(n, p["after"])) | ~slavic & F.rlike(F.concat(n, p["after"]), F.lit(SLAVIC)))
        steps = F.sequence(F.lit(1), F.when(kind == "name", NAME_STEPS).otherwise(1))
        new = F.aggregate(steps, p["text"], lambda n, i: F.when((i == 1) | again(n), swapped(n, p["tweak"], key)).otherwise(n))
        return F.concat(p["before"], new, p["after"])

    def whole(d: Column) -> Column:
        check = F.pmod(F.lit(10) - F.pmod(luhn_sum(F.concat(d, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
        return F.when(kind == "card", F.concat(d, check)).when(kind == "ip", octets_of(d)).when(kind == "secret", F.translate(d, HEX_CHARACTERS, HEX)).otherwise(d)

    other = once(F.array_join(F.transform(parts_of(kind, norm), moved), ""), whole)
    return F.when((kind == "name") & taken(norm), F.element_at(known, norm)).otherwise(other)


def _relaid(m: Column, digits: Column) -> Column:
    """digits laid into the places of m's digits."""

    def one(c: Column, i: Column) -> Column:
        nth = F.length(F.regexp_replace(F.substr(m, F.lit(1), i + 1), r"\D", ""))
        return F.when(F.rlike(c, F.lit(r"\d")), F.substr(digits, nth, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(m, ""), one), "")


def replaced(findings: Column, key: str) -> Column:
    """The matches of classified(), each with its values replaced."""

    def renewed(x: Column) -> Column:
        return F.struct(x["m"].alias("m"), x["kind"].alias("kind"), x["title"].alias("title"), F.transform(x["units"], lambda u: surrogate(u["kind"], u["norm"], key)).alias("new"))

    def written(x: Column) -> Column:
        m, kind = x["m"], x["kind"]
        new = F.element_at(x["new"], 1)
        number = F.when((kind == "phone") & ~F.startswith(m, F.lit("+")), F.substr(new, F.lit(2), F.lit(20))).otherwise(new)
        return (
            F.when(kind.isNull(), m)
            .when(kind == "person", F.concat(x["title"], F.array_join(F.transform(x["new"], lambda t: F.initcap(t)), " ")))
            .when(kind.isin("card", "phone", "ssn"), _relaid(m, number))
            .when((kind == "email") & (m == F.upper(m)) | (kind == "secret") & F.rlike(m, F.lit("[A-F]")), F.upper(new))
            .otherwise(new)
        )

    return F.transform(F.transform(findings, renewed), written)


def colliding(found: DataFrame, findings: str, key: str) -> DataFrame:
    """Surrogates that two distinct values of the corpus share (kind, new, n); there should be none."""
    values = found.select(F.explode(F.flatten(F.transform(findings, lambda x: x["units"]))).alias("u")).select("u.kind", "u.norm").distinct()
    return values.groupBy("kind", surrogate(F.col("kind"), F.col("norm"), key).alias("new")).agg(F.count("*").alias("n")).where("n > 1")


def with_surrogates(docs: DataFrame, key: str, only_found: bool = False) -> DataFrame:
    """docs with every finding in text replaced, and n_entities and kinds (sorted); only rows with one, if only_found."""
    if not key:
        raise ValueError("surrogates need a key")
    names = [c for c in docs.columns if c not in ("n_entities", "kinds")]
    held = free_name("findings", names)
    matching = F.coalesce(F.rlike("text", F.lit(ANY)), F.lit(False))
    # Rows with a match are looked at again and staged; of all others the pattern only says that there is none.
    found = stage_table(docs.select(*names).where(matching).withColumn(held, classified(F.regexp_extract_all("text", F.lit(ANY), 0))), "pii")
    if clash := colliding(found, held, key).head(1):
        raise RuntimeError(f"surrogates of type {clash[0].kind} collide")
    between = F.split("text", ANY, -1)
    text = F.array_join(F.zip_with(between, replaced(F.col(held), key), lambda b, n: F.concat(b, F.coalesce(n, F.lit("")))), "")
    kinds = F.filter(F.transform(held, lambda x: x["kind"]), lambda k: k.isNotNull())
    done = found.select(
        *[text.alias("text") if c == "text" else F.col(c) for c in names], F.size(kinds).cast("long").alias("n_entities"), F.array_sort(F.array_distinct(kinds)).alias("kinds")
    )
    if only_found:
        return done.where("n_entities > 0")
    rest = docs.select(*names).where(~matching)
    return done.unionByName(rest.select(*names, F.lit(0).cast("long").alias("n_entities"), F.array().cast("array<string>").alias("kinds")))


#: The session's setting that holds the key; the query falls back on a key for demonstrations.
KEY_SETTING, DEMONSTRATION_KEY = "spark.millrace.pii.key", "not a secret: for demonstrations only"


def op10_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    from .shared import read_table

    key = spark.conf.get(KEY_SETTING, DEMONSTRATION_KEY)
    return with_surrogates(read_table(spark, sf_dir, "documents").select("doc_id", "text"), key, only_found=True).select("doc_id", "n_entities", "kinds", "text")
