"""Personal data (operator 9, SQL only): patterns propose spans, checksums confirm them, context words move the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .secrets import digest
from .shared import SPANS, apart_from, around, blocks_of, fresh, held, let, own, spans

# Fixed patterns of the base kinds, in their order. They find the leftmost non-overlapping matches of the plain
# patterns in time linear in the text: possessive repeats need no stack, and a match starts only where a run does
# (or where the match before ended), as a later start in the same run fails like the first.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
# Whole chains of 12 to 19 digits; longer or shorter ones fail as a whole.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE_KINDS = ("email", "ip", "card", "phone")

# Added kinds. An IBAN is confirmed by its check digits, and by context where its length isn't its country's; a social
# security number and a phone number without country code have no check digits and need their context.
# A run of whole words of capitals and digits from a possible IBAN on: where in it IBANs stand, ibans() finds out.
IBAN_RUN = r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11})[A-Z]{2}[0-9]{2}[A-Z0-9]*+(?![a-z])(?:\x20[A-Z0-9]++(?![a-z]))*+"
#: Characters of an IBAN by country: they decide between several ends with right check digits.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
TEL = r"(?<![0-9A-Za-z+./-])(?:\([0-9]{2,5}\)[\x20-]?|0[0-9]{1,4}[\x20/-]|[0-9]{3}[\x20-])[0-9]{3,4}[\x20-]?[0-9]{3,4}(?![0-9A-Za-z]|[.-][0-9])"
#: Words that speak for a kind, where they stand near a span.
CONTEXT = {
    "iban": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b",
    "ssn": r"(?i)\b(?:ssn|social security|taxpayer|tax id)\b",
    "email": r"(?i)\b(?:e-?mail|contact|write|kontakt|correo)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|adresse)\b",
    "card": r"(?i)\b(?:card|visa|credit|payment|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|call|tel|mobile|fax|telefon)\b",
    "tel": r"(?i)\b(?:phone|call|tel|mobile|fax|telefon)\b",
}
#: Score of a confirmed pattern before context; an added kind stays from LEAST on.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "tel": 0.25}
#: Score of an IBAN whose length isn't that of its country, before context.
ODD_IBAN = 0.3
BONUS, NEAR, LEAST = 0.3, 40, 0.5


def luhn(value: Column) -> Column:
    """Whether the digits of value pass the Luhn check."""
    digits = F.filter(F.split(F.reverse(F.regexp_replace(value, "[^0-9]", "")), ""), lambda d: d != "")

    def add(x: Column, i: Column) -> Column:
        d = x.cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(digits, add), F.lit(0), lambda a, b: a + b) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether value, an IBAN with or without spaces, has the remainder 1 and 15 to 34 characters."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.filter(F.split(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4))), ""), lambda c: c != "")

    def add(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.length(plain).between(15, 34) & (F.aggregate(turned, F.lit(0), add) == 1)


def usual_length(value: Column) -> Column:
    """Whether an IBAN has as many characters as those of its country."""
    lengths = F.create_map(*(F.lit(x) for n, countries in IBAN_LENGTHS.items() for c in countries.split() for x in (c, n)))
    return F.coalesce(F.length(F.replace(value, F.lit(" "), F.lit(""))) == F.try_element_at(lengths, F.substr(value, F.lit(1), F.lit(2))), F.lit(False))


def ibans(text: Column) -> Column:
    """Spans of the IBANs in text: from the first word of a run that starts one, on after its end, and so forth.

    An IBAN ends with a word. Of several ends with right check digits that of its country's length counts, else the last.
    """
    none = F.array().cast(SPANS)

    def iban_from(words: Column, i: Column) -> Column:
        ends = F.sequence(i, F.least(F.size(words) - 1, i + 30))
        values = F.transform(ends, lambda j: F.array_join(F.slice(words, i + 1, j - i + 1), " "))

        def pick(right: Column) -> Column:
            return F.coalesce(F.get(F.filter(right, usual_length), F.lit(0)), F.try_element_at(right, F.lit(-1)))

        return let(F.filter(values, mod97), pick)

    def inside(run: Column) -> Column:
        def step(words: Column):
            def add(acc: Column, i: Column) -> Column:
                word = F.get(words, i)
                starts = (acc["at"] >= acc["free"]) & word.rlike("^[A-Z]{2}[0-9]{2}")

                def grown(value: Column) -> Column:
                    end = acc["at"] + F.length(value)
                    span = F.struct(acc["at"].alias("start"), F.lit(4).alias("order"), end.alias("end"), F.lit("iban").alias("kind"), value.alias("value"), F.lit(1.0).alias("score"))
                    return F.struct(
                        (acc["at"] + F.length(word) + 1).alias("at"),
                        F.coalesce(end, acc["free"]).alias("free"),
                        F.when(value.isNotNull(), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"),
                    )

                return let(F.when(starts, iban_from(words, i)), grown)

            first = F.struct(run["start"].alias("at"), run["start"].alias("free"), none.alias("out"))
            return F.aggregate(F.sequence(F.lit(0), F.size(words) - 1), first, add)["out"]

        return let(F.split(run["value"], " "), step)

    return F.flatten(F.transform(spans(text, IBAN_RUN, "iban", 4), inside))


def octets(value: Column) -> Column:
    """Whether all four parts are at most 255, however many leading zeros they have."""
    return F.forall(F.split(value, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.substr(F.concat(F.lit("000"), p), F.length(p) + 1, F.lit(3)).cast("int") <= 255))


def n_digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def scored(text: Column, found: Column, kind: str) -> Column:
    """Spans of a kind with their score: PRIOR, raised where a context word stands within NEAR code points before or after."""

    def score(s: Column, near: Column) -> Column:
        prior = F.lit(PRIOR[kind]) if kind != "iban" else F.when(usual_length(s["value"]), F.lit(PRIOR[kind])).otherwise(F.lit(ODD_IBAN))
        total = F.least(F.lit(1.0), prior + F.when(near.rlike(CONTEXT[kind]), F.lit(BONUS)).otherwise(F.lit(0.0)))
        return F.struct(*(s[c].alias(c) for c in ("start", "order", "end", "kind", "value")), total.alias("score"))

    return let(found, lambda some: F.when(F.size(some) > 0, around(text, some, NEAR, score)).otherwise(F.array().cast(SPANS)))


def _proposed(text: Column) -> tuple[Column, Column]:
    """Spans of the base kinds, sorted, and those of iban, ssn and tel that score enough."""
    none = F.array().cast(SPANS)

    def found(kind: str, places: Column) -> Column:
        return scored(text, places, kind)

    digit = text.rlike("[0-9]")  # all kinds but email have one, most texts have none
    at, dot, plus = (F.contains(text, F.lit(c)) for c in "@.+")
    numbers = F.concat(
        F.when(dot, found("ip", spans(text, IP, "ip", 1, keep=octets))).otherwise(none),
        found("card", spans(text, CARD, "card", 2, keep=luhn)),
        F.when(plus, found("phone", spans(text, PHONE, "phone", 3, keep=lambda m: n_digits(m).between(9, 15)))).otherwise(none),
    )
    base = F.concat(F.when(at, found("email", spans(text, EMAIL, "email", 0))).otherwise(none), F.when(digit, numbers).otherwise(none))
    tel = spans(text, TEL, "tel", 6, keep=lambda m: n_digits(m).between(7, 12))
    more = F.concat(found("iban", ibans(text)), found("ssn", spans(text, SSN, "ssn", 5)), found("tel", tel))
    added = F.when(digit, more).otherwise(none)
    return F.sort_array(base), F.filter(added, lambda s: s["score"] >= LEAST)


def with_spans(docs: DataFrame, name: str) -> DataFrame:
    """docs with all spans of personal data in text, sorted by start, then kind, as a column of this (free) name."""
    # In steps of their own, as expressions can't nest at will.
    known, more = fresh(docs, "__known", "__more")
    base, added = _proposed(F.coalesce("text", F.lit("")))
    both = docs.select(*own(docs), held(base).alias(known), held(added).alias(more))
    return both.select(*own(docs), held(F.sort_array(F.concat(known, apart_from(F.col(known), F.col(more))))).alias(name))


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text, pii (array of start, order, end, kind, value, score).

    Whole texts are scanned in place, without a shuffle. Base kinds stay whatever their score; iban, ssn and tel (a
    phone number without country code) stay from a score of LEAST on, where they overlap no base span. A null text
    counts as empty and has no spans; repeated rows are scanned alike; extra columns are ignored; an empty table
    gives an empty result.
    """
    return with_spans(docs.select("doc_id", "text"), "pii")


def _reach(ends: Column) -> Column:
    """For each entry the largest of all up to it; in blocks, so that very many don't take quadratic time."""

    def run(acc: Column, x: Column) -> Column:
        return let(F.greatest(acc["top"], x), lambda top: F.struct(top.alias("top"), F.concat(acc["out"], F.array(top)).alias("out")))

    def join(acc: Column, b: Column) -> Column:
        first = F.struct(acc["top"].alias("top"), F.array().cast("array<bigint>").alias("out"))
        return let(F.aggregate(b, first, run), lambda r: F.struct(r["top"].alias("top"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    none = F.struct(F.lit(0).cast("bigint").alias("top"), F.array().cast("array<array<bigint>>").alias("out"))
    return F.flatten(F.aggregate(blocks_of(ends, 256), none, join)["out"])


def _places(found: Column, reach: Column) -> Column:
    """What to mask of sorted spans and the largest ends up to each: (since, start, kind, end), apart from each other.

    Overlapping spans become one, of the first's kind; since is the end of the place before.
    """
    since = lambda i: F.when(i > 0, F.get(reach, F.greatest(i - 1, F.lit(0)))).otherwise(F.lit(0))
    heads = F.filter(F.transform(found, lambda s, i: F.struct(since(i).alias("since"), s["start"].alias("start"), s["kind"].alias("kind"), i.alias("i"))), lambda h: (h["i"] == 0) | (h["since"] <= h["start"]))
    ended = lambda h: lambda x, j: F.struct(x["since"].alias("since"), x["start"].alias("start"), x["kind"].alias("kind"), F.coalesce(F.get(h, j + 1)["since"], F.element_at(reach, -1)).alias("end"))
    return let(heads, lambda h: F.transform(h, ended(h)))


def _rebuilt(text: Column, places: Column) -> Column:
    """text with every place replaced by its kind in angle brackets."""

    def block(some: Column) -> Column:
        begin = F.get(some, F.lit(0))["since"]
        section = F.substr(text, (begin + 1).cast("int"), (F.element_at(some, -1)["start"] - begin).cast("int"))
        piece = lambda x: lambda s: F.concat(F.substr(x["section"], (s["since"] - x["begin"] + 1).cast("int"), (s["start"] - s["since"]).cast("int")), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return let(F.struct(begin.alias("begin"), section.alias("section")), lambda x: F.array_join(F.transform(some, piece(x)), ""))

    rest = F.substr(text, (F.element_at(places, -1)["end"] + 1).cast("int"))
    return F.when(F.size(places) > 0, F.concat(F.array_join(F.transform(blocks_of(places), block), ""), rest)).otherwise(text)


def mask_pii(docs: DataFrame) -> DataFrame:
    """docs with the personal data in text masked; all other columns and rows stay.

    n_chars, if it is there and a whole number, is renewed with the text; null texts stay null; repeated rows and
    an empty table give the like.
    """
    name, reach, places = fresh(docs, "__pii", "__reach", "__places")
    found = with_spans(docs, name).withColumn(reach, held(_reach(F.transform(name, lambda s: s["end"])))).withColumn(places, held(_places(F.col(name), F.col(reach))))
    out = found.select(*(_rebuilt(col, F.col(places)).alias(c) if c == "text" else col for c, col in zip(docs.columns, own(docs), strict=True)))
    if "n_chars" in docs.columns and isinstance(kind := docs.schema["n_chars"].dataType, IntegralType):
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), "n_chars"))
    return out


def op9_query(spark, sf_dir: str) -> DataFrame:
    """op9: personal data of every document, as counts, hash, list of spans and their scores."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    scores = F.array_join(F.transform("pii", lambda s: F.round(s["score"], 2).cast("string")), ",")
    return digest(found, "pii", BASE_KINDS, scores.alias("scores"))
