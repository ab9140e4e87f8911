"""PII: format-preserving Feistel pseudonyms in DataFrame functions only.

Card numbers with a valid check digit, phone numbers, IPv4 addresses, social security numbers, dates
that exist and the names in mail addresses are found by one pattern, validated, and replaced by the
value to which a keyed permutation of all valid values of that format sends them. Equal values get
equal pseudonyms in every document, however they are spaced, and different values different ones.

The pattern takes time in proportion to the text: each alternative starts at a border only, and its
unbounded parts give nothing back.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
_PIECE = 512

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Fixed patterns, in the order of preference at one place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[._%+-]*+[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9-]{1,63}){0,125}\.[A-Za-z]{2,}",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    "date": r"(?<!\d)(?:(?:1[89]|2[01])\d\d-\d\d-\d\d|\d\d/\d\d/(?:1[89]|2[01])\d\d|\d\d\.\d\d\.(?:1[89]|2[01])\d\d)(?!\d)",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)",
    "ssn": r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
}
_OTHER = "|".join(f"(?:{PATTERNS[k]})" for k in ("email", "ip", "date", "ssn"))
#: Groups of digits, 13 digits or more, up to where another kind begins; cards are looked for inside.
_RUN = rf"(?<!\d)(?=\d(?:[ -]?\d){{12}})\d++(?:[ -](?!{_OTHER})\d++)*+"
_ANY = "|".join(f"(?:{p})" for p in [*(v for k, v in PATTERNS.items() if k != "card"), _RUN])
#: The usual groupings of card numbers: none, 4-4-4-4, 4-4-4-4-3, 4-6-5 and 4-6-4.
_USUAL = r"(?:^|[ -])(\d{13,19}|\d{4}(?:(?: \d{4}){3}(?: \d{3})?|(?:-\d{4}){3}(?:-\d{3})?| \d{6} \d{4,5}|-\d{6}-\d{4,5}))$"
_NEARBY = 40  # more characters than 19 digits, 18 separators and one before them
#: The country codes of phone numbers: one digit, two digits of these ranges, else three.
_COUNTRY = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
_AREAS, _GROUPS, _SERIALS = 898, 99, 9999  # 001 to 899 without 666; 01 to 99; 0001 to 9999


def feistel(left: Column, right: Column, left_size: int | Column, right_size: int | Column, kind: str, key: str) -> Column:
    """struct(left, right) permuted: rounds add a keyed hash of one side to the other, modulo its size."""
    size_l, size_r = (s if isinstance(s, Column) else F.lit(s) for s in (left_size, right_size))

    def mixed(round_: Column, value: Column) -> Column:
        text = F.concat_ws("|", F.lit(key), F.lit(kind), size_l.cast("string"), size_r.cast("string"), round_.cast("string"), value.cast("string"))
        return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")

    def turn(x: Column, r: Column) -> Column:
        even = r % 2 == 0
        return F.struct(
            F.when(even, F.pmod(x["left"] + F.pmod(mixed(r, x["right"]), size_l), size_l)).otherwise(x["left"]).alias("left"),
            F.when(even, x["right"]).otherwise(F.pmod(x["right"] + F.pmod(mixed(r, x["left"]), size_r), size_r)).alias("right"),
        )

    start = F.struct(left.cast("bigint").alias("left"), right.cast("bigint").alias("right"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _power(radix: int, n: Column) -> Column:
    return F.element_at(F.lit([radix**k for k in range(11 if radix == 10 else 13)]).cast("array<bigint>"), n + 1)


def _one(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def permute_string(s: Column, radix: int, kind: str, key: str) -> Column:
    """A string of 1 to 18 digits (radix 10) or 1 to 12 digits and small letters (radix 36), permuted."""
    n = F.length(s)
    a = F.floor(n / 2).cast("int")
    number = lambda x: F.coalesce(F.conv(F.when(x == "", F.lit("0")).otherwise(x), radix, 10).cast("bigint"), F.lit(0))
    new = feistel(number(F.substring(s, F.lit(1), a)), number(F.substring(s, a + 1, n - a)), _power(radix, a), _power(radix, n - a), kind, key)
    spell = lambda x, k: F.when(k == 0, F.lit("")).otherwise(F.lpad(F.lower(F.conv(x.cast("string"), 10, radix)), k, "0"))
    return _one(new, lambda x: F.concat(spell(x["left"], a), spell(x["right"], n - a)))


def _refill(shape: Column, new: Column, what: str) -> Column:
    """shape with its characters of the class `what` replaced, in order, by those of new.

    Characters are taken _PIECE at a time: the work grows with the length.
    """

    def weave(own: Column) -> Column:
        def put(x: Column, c: Column) -> Column:
            hit = c.rlike(what)
            return F.struct((x["at"] + hit.cast("int")).alias("at"), F.concat(x["out"], F.when(hit, F.get(own["new"], x["at"])).otherwise(c)).alias("out"))

        def piece(x: Column, k: Column) -> Column:
            done = F.aggregate(F.slice(own["shape"], k * _PIECE + 1, F.lit(_PIECE)), F.struct(x["at"].alias("at"), F.lit("").alias("out")), put)
            return _one(done, lambda d: F.struct(d["at"].alias("at"), F.concat(x["out"], F.array(d["out"])).alias("out")))

        pieces = F.sequence(F.lit(0), F.floor((F.size(own["shape"]) - 1) / _PIECE).cast("int"))
        return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), piece, lambda x: F.array_join(x["out"], ""))

    return _one(F.struct(F.split(shape, "").alias("shape"), F.split(new, "").alias("new")), weave)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, the last of which is the check digit."""

    def add(x: Column, c: Column) -> Column:
        d = c.cast("int") * F.when(x["double"], 2).otherwise(1)
        return F.struct((x["sum"] + F.when(d > 9, d - 9).otherwise(d)).alias("sum"), (~x["double"]).alias("double"))

    return F.aggregate(F.reverse(F.split(digits, "")), F.struct(F.lit(0).alias("sum"), F.lit(False).alias("double")), add, lambda x: x["sum"])


def _card(m: Column, key: str) -> Column:
    def seal(body: Column) -> Column:
        return F.concat(body, F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))

    return _one(_digits(m), lambda d: _refill(m, _one(permute_string(F.substring(d, F.lit(1), F.length(d) - 1), 10, "card", key), seal), r"\d"))


def _phone(m: Column, key: str) -> Column:
    """The digits after the country code, permuted; how the number is grouped stays and doesn't matter."""

    def dial(digits: Column) -> Column:
        country = F.regexp_extract(digits, _COUNTRY, 0)
        return F.concat(country, permute_string(F.substring(digits, F.length(country) + 1, F.length(digits)), 10, "phone", key))

    return _refill(m, _one(_digits(m), dial), r"\d")


def _ssn(m: Column, key: str) -> Column:
    """Area and group are one side, the serial number the other; every value of both is valid."""
    part = lambda first, n: F.substring(m, F.lit(first), F.lit(n)).cast("bigint")
    area = part(1, 3) - F.when(part(1, 3) > 666, 2).otherwise(1)
    new = feistel(area * _GROUPS + part(5, 2) - 1, part(8, 4) - 1, _AREAS * _GROUPS, _SERIALS, "ssn", key)

    def spell(x: Column) -> Column:
        at = F.floor(x["left"] / _GROUPS)
        number = lambda v, n: F.lpad(v.cast("string"), n, "0")
        return F.concat_ws("-", number(at + F.when(at >= 665, 2).otherwise(1), 3), number(x["left"] % _GROUPS + 1, 2), number(x["right"] + 1, 4))

    return _one(new, spell)


def _ip(m: Column, key: str) -> Column:
    def spell(o: Column) -> Column:
        new = feistel(o[0].cast("bigint") * 256 + o[1].cast("bigint"), o[2].cast("bigint") * 256 + o[3].cast("bigint"), 65536, 65536, "ip", key)
        high = lambda v: F.floor(v / 256).cast("string")
        return _one(new, lambda x: F.concat_ws(".", high(x["left"]), (x["left"] % 256).cast("string"), high(x["right"]), (x["right"] % 256).cast("string")))

    return _one(F.split(m, r"\."), spell)


def _parse_date(m: Column) -> Column:
    """The date, or null if there is no such day."""
    return F.coalesce(*(F.try_to_date(m, f) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "dd.MM.yyyy")))


def _date(m: Column, key: str) -> Column:
    """The 146,097 days of the 400 years from 1800 are a whole cycle of the calendar: 189 x 773."""

    def spell(day: Column) -> Column:
        new = feistel(F.floor(day / 773), day % 773, 189, 773, "date", key)
        date = lambda x: F.date_add(F.lit("1800-01-01").cast("date"), (x["left"] * 773 + x["right"]).cast("int"))
        shape = lambda d: F.when(m.contains("-"), F.date_format(d, "yyyy-MM-dd")).when(m.contains("/"), F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "dd.MM.yyyy"))
        return _one(new, lambda x: shape(date(x)))

    return _one(F.datediff(_parse_date(m), F.lit("1800-01-01").cast("date")).cast("bigint"), spell)


def _email(m: Column, key: str) -> Column:
    """The name's letters and digits, twelve at a time; other marks and the host stay."""
    name = F.lower(F.substring_index(m, "@", 1))

    def spell(s: Column) -> Column:
        return F.array_join(F.transform(F.regexp_extract_all(s, F.lit(".{1,12}"), F.lit(0)), lambda x: permute_string(x, 36, "email", key)), "")

    new = _one(F.regexp_replace(name, "[^a-z0-9]", ""), spell)
    return F.concat(_refill(name, new, "[a-z0-9]"), F.lit("@"), F.substring_index(m, "@", -1))


def kind_of(m: Column) -> Column:
    """The kind of a match of the pattern, or null if it isn't valid."""
    whole = lambda k: m.rlike(f"^(?:{PATTERNS[k]})$")
    return (
        F.when(m.contains("@"), F.lit("email"))
        .when(whole("ip"), F.lit("ip"))
        .when(whole("date"), F.when(_parse_date(m).isNotNull(), F.lit("date")))
        .when(m.startswith("+"), F.lit("phone"))
        .when(whole("ssn"), F.lit("ssn"))
        .when(whole("card"), _one(_digits(m), lambda d: F.when(F.pmod(luhn_sum(d), F.lit(10)) == 0, F.lit("card"))))
    )


_PART = "array<struct<kind:string,value:string>>"


def _cards(tokens: Column, candidates) -> Column:
    """array<struct<first, last>>: the places of the valid cards in an array of groups of digits.

    candidates(text) are the strings at the end of a text that may be a card. Groups are taken from
    the left; the first valid candidate that ends with a group is a card. Each step looks at the last
    19 groups and 40 characters, so that long runs take time in proportion to their length.
    """

    def step(x: Column, last: Column) -> Column:
        begin = F.greatest(x["free"], last - 18)
        text = F.substring(F.array_join(F.slice(tokens, begin + 1, last - begin + 1), ""), -_NEARBY, _NEARBY)
        valid = lambda c: (c != "") & (F.pmod(luhn_sum(_digits(c)), F.lit(10)) == 0)

        def taken(card: Column) -> Column:
            first = last + 1 - F.size(F.split(card, "[ -]"))
            found = F.array(F.struct(first.cast("int").alias("first"), last.alias("last")))
            return F.when(card.isNull(), x).otherwise(F.struct(F.concat(x["found"], found).alias("found"), (last + 1).alias("free")))

        return _one(_one(text, lambda t: F.get(F.filter(candidates(t), valid), F.lit(0))), taken)

    start = F.struct(F.array().cast("array<struct<first:int,last:int>>").alias("found"), F.lit(0).alias("free"))
    return F.aggregate(F.sequence(F.lit(0), F.size(tokens) - 1), start, step, lambda x: x["found"])


def _split_run(run: Column, candidates, gap=None) -> Column:
    """array<struct<kind, value>>: a run of groups of digits, cut into valid cards and what lies between.

    gap, if given, cuts what lies between further.
    """
    other = lambda v: F.array(F.struct(F.lit(None).cast("string").alias("kind"), v.alias("value"))).cast(_PART)
    between = gap or other
    text = lambda tokens, a, b: F.array_join(F.slice(tokens, a + 1, F.greatest(b - a, F.lit(0))), "")

    def cut(tokens: Column) -> Column:
        def weave(found: Column) -> Column:
            def one(card: Column, k: Column) -> Column:
                before = F.when(k > 0, F.get(found, k - 1)["last"] + 1).otherwise(0)

                def sealed(own: Column) -> Column:
                    mark = F.regexp_extract(own, "^[ -]?", 0)
                    number = F.struct(F.lit("card").alias("kind"), F.substring(own, F.length(mark) + 1, F.length(own)).alias("value"))
                    return F.concat(between(text(tokens, before, card["first"])), other(mark), F.array(number).cast(_PART))

                return _one(text(tokens, card["first"], card["last"] + 1), sealed)

            end = F.when(F.size(found) > 0, F.get(found, F.size(found) - 1)["last"] + 1).otherwise(0)
            return F.concat(F.flatten(F.transform(found, one)), between(text(tokens, end, F.size(tokens))))

        return _one(_cards(tokens, candidates), weave)

    return _one(F.regexp_extract_all(run, F.lit(r"[ -]?\d+"), F.lit(0)), cut)


def cards_in(run: Column) -> Column:
    """array<struct<kind, value>> of a run: cards in a usual grouping first, then any 13 to 19 digits between separators."""
    any_ = lambda t: F.array(*[F.regexp_extract(t, rf"(?:^|[ -])(\d(?:[ -]?\d){{{k - 1}}})$", 1) for k in range(19, 12, -1)])

    def gap(text: Column) -> Column:
        whole = F.array(F.struct(F.lit(None).cast("string").alias("kind"), text.alias("value"))).cast(_PART)
        return F.when(F.length(_digits(text)) >= 13, _split_run(text, any_)).otherwise(whole)

    return _split_run(run, lambda t: F.array(F.regexp_extract(t, _USUAL, 1)), lambda v: _one(v, gap))


def parts_of(m: Column) -> Column:
    """array<struct<kind, value>>: a match of the pattern, cut where cards stand beside other digits; kind is null for what stays."""
    run = m.rlike(r"^\d[\d -]*+$") & (F.length(_digits(m)) >= 13)
    part = lambda kind, value: F.struct(kind.alias("kind"), value.alias("value"))
    marks = F.regexp_extract(m, "^[._%+-]*+", 0)  # before the name of a mail address
    mail = F.array(part(F.lit(None).cast("string"), marks), part(F.lit("email"), F.substring(m, F.length(marks) + 1, F.length(m))))
    return F.when(m.contains("@"), mail.cast(_PART)).when(run, cards_in(m)).otherwise(F.array(part(kind_of(m), m)).cast(_PART))


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    return (
        F.when(kind == "email", _email(m, key)).when(kind == "ip", _ip(m, key)).when(kind == "date", _date(m, key))
        .when(kind == "phone", _phone(m, key)).when(kind == "ssn", _ssn(m, key)).when(kind == "card", _card(m, key)).otherwise(m)
    )


@lru_cache(maxsize=4)
def _expressions(jvm: int, key: str) -> tuple[Column, Column, Column]:
    """The matches of text cut into parts; the parts (found) with their pseudonyms; text woven anew from these.

    Some ten thousand calls to the driver's JVM build them, once for a JVM and key.
    """
    matches = F.coalesce(F.regexp_extract_all("text", F.lit(_ANY), F.lit(0)), F.array().cast("array<string>"))
    named = lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"), pseudonym(x["value"], x["kind"], key).alias("pseudonym"))
    new = F.transform("found", lambda parts: F.array_join(parts["pseudonym"], ""))
    pairs = F.arrays_zip(F.split("text", _ANY).alias("gap"), new.alias("new"))
    woven = F.array_join(F.transform(pairs, lambda x: F.concat(x["gap"], F.coalesce(x["new"], F.lit("")))), "")
    return F.transform(matches, parts_of), F.transform("found", lambda parts: F.transform(parts, named)), woven


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with the text's personal values replaced, and found array<struct<kind, value, pseudonym>>.

    The key is a secret of the deployment; without one this is an error. Matches that aren't valid (no
    such day, wrong check digit) stay. A null text stays null with nothing found, an empty one empty;
    texts of any length take time in proportion to it. All rows, repeated ones too, and other columns
    stay; a column named found is replaced. The same value has the same pseudonym in each document, and a
    pseudonym is a valid value of its format. No documents give no rows.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    cut, named, woven = _expressions(id(docs.sparkSession.sparkContext._jvm), key)
    marked = docs.drop("found").withColumn("found", cut).withColumn("found", named)
    return marked.withColumns({"text": F.when(F.size("found") > 0, woven).otherwise(F.col("text")), "found": F.filter(F.flatten("found"), lambda x: x["kind"].isNotNull())})


def report(docs: DataFrame, key: str) -> DataFrame:
    """One row per document: doc_id, n_found, n_<kind> for each kind, and text, the pseudonymised text.

    Nulls, empty and long texts and repeated rows as in pseudonymise; a null doc_id stays null. Other
    columns are ignored.
    """
    done = pseudonymise(docs.select("doc_id", "text"), key)
    n = [(F.size("found") - F.size(F.array_remove("found.kind", k))).alias(f"n_{k}") for k in PATTERNS]
    return done.select("doc_id", F.size("found").alias("n_found"), *n, "text")
