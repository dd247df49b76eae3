"""Format-preserving pseudonyms of personal data by keyed Feistel permutations (operator 3), in DataFrame functions only.

Found are e-mail addresses, phone numbers, payment card numbers that pass the Luhn check, social security numbers with
valid fields, IPv4 addresses with valid octets and dates of the years 1700 to 2099 that exist. Each becomes a vector of
small numbers, every one with its own modulus (a digit has 10, a letter its alphabet's 26 or so, an octet 256, the parts of a day's
number 189 and 773), and an alternating Feistel network adds keyed hashes of the odd positions to the even ones and the other way
round. That is a permutation of all vectors with these moduli, so a value keeps its format and equal values stay equal in all
documents, while different values of a kind stay different. Card numbers get a new check digit.

Everything else in a text stays as it is, as do numbers that fail their check. A text of any length is one row's expression. Null texts stay null, empty ones empty, with no
values. Rows that repeat a doc_id are handled one by one. Empty tables give no rows; extra columns are kept by pseudonymise().
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ROUNDS = 8
#: The setting that holds the secret key.
KEY_SETTING = "spark.palimpsest.pseudonymKey"
#: Keys drawn for applications that set none, by application.
_drawn: dict[str, str] = {}


def secret_key(spark: SparkSession) -> str:
    """The key of the session's settings. Where none is set, one drawn at random for this application, so that nobody who knows
    the source can undo pseudonyms; they are then the same in all queries of the application, but not in another one."""
    return spark.conf.get(KEY_SETTING, None) or _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NOT_AFTER = r"(?<![0-9A-Za-z_])(?<!\d[.,])"
#: In order of preference where two could begin at one place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[A-Za-z0-9](?:[A-Za-z0-9\-]*+\.)(?:[A-Za-z0-9\-]++\.)*+[A-Za-z]{2,}+",
    "ip": _NOT_AFTER + rf"(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9A-Za-z_]|\.\d)",
    "ssn": _NOT_AFTER + r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![0-9A-Za-z_]|-\d)",
    "date": _NOT_AFTER + r"(?:(?:1[789]|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([./])(?:0?[1-9]|[12]\d|3[01])\1(?:1[789]|20)\d\d)(?![0-9A-Za-z_]|[.,/\-]\d)",
    "card": _NOT_AFTER + r"(?:\d{13,19}|\d{4}[ \-]\d{6}[ \-]\d{5}|\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{1,7})(?![0-9A-Za-z_]|[.,]\d)",
    "phone": r"(?<![0-9A-Za-z_+])(?:\+1[ .\-]?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4}|\+(?!1[ (.\-])[2-9]\d{0,2}(?:[ \-]?\(?\d{2,4}\)?){2,4}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}([.\-])\d{3}\2\d{4})(?![0-9A-Za-z_]|[.,\-]\d)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _characters(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))


def _numbers(*columns: Column) -> Column:
    return F.array(*(c.cast("long") for c in columns))


def feistel(values: Column, moduli: Column, kind: str, key: str, tweak: Column | None = None) -> Column:
    """The keyed permutation of vectors `values` (array<long>) with these moduli; tweak: what else the permutation depends on."""

    def step(state: Column, r: Column) -> Column:
        side = F.pmod(r, F.lit(2))
        other = F.array_join(F.filter(state, lambda _, j: F.pmod(j, F.lit(2)) != side).cast("array<string>"), ",")

        def moved(x: Column, i: Column) -> Column:
            h = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), i.cast("string"), tweak if tweak is not None else F.lit(""), other).cast("binary"), 256)
            return F.pmod(x + F.conv(F.substring(h, 1, 12), 16, 10).cast("long"), F.get(moduli, i))

        return F.transform(state, lambda x, i: F.when(F.pmod(i, F.lit(2)) == side, moved(x, i)).otherwise(x))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), values, step)


def _filled(value: Column, new: Column, pattern: str) -> Column:
    """value with its characters that match pattern replaced by the elements of new (array<string>), in order; a null leaves one as it is."""
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("p"))

    def step(a: Column, c: Column) -> Column:
        hit = c.rlike(pattern)
        return F.struct(F.concat(a["s"], F.coalesce(F.when(hit, F.get(new, a["p"])), c)).alias("s"), (a["p"] + hit.cast("int")).alias("p"))

    return F.aggregate(_characters(value), start, step, lambda a: a["s"])


def _digits(value: Column) -> Column:
    return F.transform(F.regexp_extract_all(value, F.lit("[0-9]"), F.lit(0)), lambda c: c.cast("long"))


def _tens(digits: Column) -> Column:
    return F.transform(digits, lambda _: F.lit(10).cast("long"))


def _phone(v: Column, key: str) -> Column:
    """All digits but the country code."""
    code = F.regexp_extract(v, r"^(\+1|\+\d{1,2})", 1)
    rest = F.substring(v, F.length(code) + 1, F.length(v))
    digits = _digits(rest)
    return F.concat(code, _filled(rest, feistel(digits, _tens(digits), "phone", key, code).cast("array<string>"), "[0-9]"))


def _card(v: Column, key: str) -> Column:
    digits = _digits(v)
    body = F.slice(digits, F.lit(1), F.size(digits) - 1)
    new = feistel(body, _tens(body), "card", key)
    doubled = F.transform(F.reverse(new), lambda x, i: F.when(F.pmod(i, F.lit(2)) == 0, F.floor(x * 2 / 10) + F.pmod(x * 2, F.lit(10))).otherwise(x).cast("long"))
    check = F.pmod(F.lit(10) - F.pmod(F.aggregate(doubled, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(10)), F.lit(10))
    return _filled(v, F.concat(new, F.array(check.cast("long"))).cast("array<string>"), "[0-9]")


def _ssn(v: Column, key: str) -> Column:
    """Areas 001-899 without 666, groups 01-99, serials 0001-9999."""
    area, group, serial = (F.substring(v, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    new = feistel(_numbers(area - 1 - (area > 666).cast("long"), group - 1, serial - 1), _numbers(*map(F.lit, (898, 99, 9999))), "ssn", key)
    made = F.get(new, 0) + 1
    return F.format_string("%03d-%02d-%04d", made + (made >= 666).cast("long"), F.get(new, 1) + 1, F.get(new, 2) + 1)


def _ip(v: Column, key: str) -> Column:
    octets = F.split(v, r"\.").cast("array<long>")
    return F.array_join(feistel(octets, F.transform(octets, lambda _: F.lit(256).cast("long")), "ip", key).cast("array<string>"), ".")


#: Runs of the Unicode table that hold nothing but digits, or letters of one kind (first, number): ASCII, Latin-1,
#: Latin Extended-A, Greek, Cyrillic, Hiragana, Katakana, Han, Hangul.
ALPHABETS = (
    (0x30, 10), (0x41, 26), (0x61, 26), (0xC0, 23), (0xD8, 7), (0xDF, 24), (0xF8, 8), (0x100, 128), (0x391, 17), (0x3A3, 7), (0x3B1, 25),
    (0x410, 32), (0x430, 32), (0x3041, 86), (0x30A1, 90), (0x4E00, 20902), (0xAC00, 11172),
)


def _email(v: Column, key: str) -> Column:
    """Letters and digits of the local part, each within its alphabet; others stay. The domain is a tweak."""
    local, domain = F.substring_index(v, "@", 1), F.lower(F.substring_index(v, "@", -1))
    codes = F.transform(F.regexp_extract_all(local, F.lit(r"[\p{L}\p{N}]"), F.lit(0)), lambda c: F.ascii(c).cast("long"))

    def alphabet(code: Column) -> Column:
        """Number of the alphabet, from 1; 0 for others."""
        out = F.lit(0)
        for i, (first, number) in enumerate(ALPHABETS, 1):
            out = F.when((code >= first) & (code < first + number), i).otherwise(out)
        return out

    def made(x: Column) -> Column:
        # which alphabets stand where is a tweak: equal vectors of numbers in other alphabets are other values
        tweak = F.concat_ws("|", domain, F.array_join(x["of"].cast("array<string>"), ","))
        new = feistel(F.zip_with(x["codes"], x["firsts"], lambda c, a: c - a), x["numbers"], "email", key, tweak)
        letter = lambda code: F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")
        out = F.transform(new, lambda d, i: F.when(F.get(x["of"], i) > 0, letter(F.get(x["firsts"], i) + d)))  # code points beyond two bytes are in no alphabet
        return F.concat(_filled(local, out, r"[\p{L}\p{N}]"), F.substring(v, F.length(local) + 1, F.length(v)))

    def described(x: Column) -> Column:
        first, number = (F.array(F.lit(0), *(F.lit(y) for y in ys)).cast("array<long>") for ys in zip(*ALPHABETS, strict=True))
        firsts = F.zip_with(x["of"], x["codes"], lambda i, c: F.when(i > 0, F.get(first, i)).otherwise(c))
        numbers = F.transform(x["of"], lambda i: F.when(i > 0, F.get(number, i)).otherwise(F.lit(1).cast("long")))
        return F.struct(x["codes"].alias("codes"), x["of"].alias("of"), firsts.alias("firsts"), numbers.alias("numbers"))

    # each step stands in an array of one, so that it is worked out once
    steps = F.transform(F.array(codes), lambda c: F.struct(c.alias("codes"), F.transform(c, alphabet).alias("of")))
    return F.get(F.transform(F.transform(steps, described), made), 0)


_FIRST_DAY = "1700-01-01"


def _iso_date(v: Column, key: str) -> Column:
    """A day of 1700-2099; 400 years have 146097 = 189 * 773 days."""
    day = F.datediff(F.to_date(v), F.to_date(F.lit(_FIRST_DAY))).cast("long")
    new = feistel(_numbers(F.floor(day / 773), F.pmod(day, F.lit(773))), _numbers(F.lit(189), F.lit(773)), "date", key)
    return F.date_format(F.date_add(F.to_date(F.lit(_FIRST_DAY)), (F.get(new, 0) * 773 + F.get(new, 1)).cast("int")), "yyyy-MM-dd")


def _field_date(v: Column, key: str) -> Column:
    """Two fields and a year, day or month first: each field stays in its class (1-12, 13-28, or from 29 itself), so that any reading stays valid."""
    sign = F.regexp_extract(v, "([./])", 1)
    f = F.split(v, "[./]")
    one, two, year = (F.get(f, i).cast("long") for i in range(3))
    low = lambda x: F.when(x <= 12, 1).when(x <= 28, 13).otherwise(x).cast("long")
    size = lambda x: F.when(x <= 12, 12).when(x <= 28, 16).otherwise(1).cast("long")
    leap = (F.greatest(one, two) == 29) & (F.least(one, two) == 2)  # 29 February: the 97 leap years, counted from 1704 by fours without 1800 and 1900
    fours = F.floor((year - 1704) / 4)
    nth = F.when(leap, fours - (fours > 24).cast("long") - (fours > 49).cast("long")).otherwise(year - 1700).cast("long")
    years = F.when(leap, 97).otherwise(400).cast("long")
    keep = F.greatest(one, two) >= 29  # the month must keep its number of days
    size_of = lambda x: F.when(keep, F.lit(1)).otherwise(size(x)).cast("long")
    low_of = lambda x: F.when(keep, x).otherwise(low(x)).cast("long")
    tweak = F.concat_ws(",", low_of(one).cast("string"), low_of(two).cast("string"), sign)
    new = feistel(_numbers(one - low_of(one), nth, two - low_of(two)), F.array(size_of(one), years, size_of(two)), "date", key, tweak)
    made = F.get(new, 1)
    made_year = F.when(leap, (made + (made >= 24).cast("long") + (made >= 48).cast("long")) * 4 + 1704).otherwise(made + 1700)
    padded = v.rlike(r"^0|[./]0|^..[./]..[./]")
    show = lambda x: F.when(padded, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
    return F.concat(show(F.get(new, 0) + low_of(one)), sign, show(F.get(new, 2) + low_of(two)), sign, made_year.cast("string"))


def _valid_field_date(v: Column) -> Column:
    f = F.split(v, "[./]")
    one, two, year = F.get(f, 0).cast("int"), F.get(f, 1).cast("int"), F.get(f, 2).cast("int")
    day, month = F.greatest(one, two), F.least(one, two)
    return (month <= 12) & F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd").isNotNull()


def _whole(pattern: str) -> str:
    """The pattern for a found value alone."""
    return rf"^(?:{pattern})$"


def pseudonym(v: Column, key: str) -> Column:
    """The pseudonym of a found value; itself where it fails its check."""
    only_digits = F.regexp_replace(v, "[^0-9]", "")
    n = F.length(only_digits)
    return (
        F.when(v.contains("@"), _email(v, key))
        .when(v.rlike(_whole(PATTERNS["ip"])), _ip(v, key))
        .when(v.rlike(_whole(PATTERNS["ssn"])), _ssn(v, key))
        .when(v.rlike(r"^\d{4}-\d\d-\d\d$"), F.when(F.try_to_date(v, "yyyy-MM-dd").isNotNull(), _iso_date(v, key)).otherwise(v))
        .when(v.rlike(r"^\d\d?[./]\d\d?[./]\d{4}$"), F.when(_valid_field_date(v), _field_date(v, key)).otherwise(v))
        .when(v.rlike(_whole(PATTERNS["card"])), F.when(F.call_function("luhn_check", only_digits), _card(v, key)).otherwise(v))
        .when((n >= 7) & (n <= 15), _phone(v, key))
        .otherwise(v)
    )


def replaced(text: Column, key: str) -> tuple[Column, Column]:
    """(text with pseudonyms, number of values replaced). Texts without a match aren't taken apart."""
    there = text.rlike("[0-9@]") & text.rlike(ANY)
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    made = F.transform(found, lambda v: pseudonym(v, key))
    return there, F.struct(found.alias("found"), made.alias("made"), F.split(text, ANY, -1).alias("gaps"))


def pseudonymise(docs: DataFrame, key: str | None = None, count: str = "n_values") -> DataFrame:
    """docs with personal data in `text` replaced, and the number of replaced values; all other columns are kept. Without a key secret_key()'s is taken."""
    key = key or secret_key(docs.sparkSession)
    text, name = F.col("text"), common.free_name(docs, "parts")
    there, parts = replaced(text, key)
    rows = docs.withColumn(name, F.when(there, parts))
    p = F.col(name)
    joined = F.array_join(F.zip_with(p["gaps"], p["made"], lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    changed = F.size(F.filter(F.zip_with(p["found"], p["made"], lambda a, b: a != b), lambda x: x))
    return rows.withColumn("text", F.when(p.isNotNull(), joined).otherwise(text)).withColumn(count, F.when(p.isNotNull(), changed).otherwise(F.lit(0))).drop(name)


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
