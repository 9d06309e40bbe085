"""Personal data in texts, with DataFrame functions only.

For each kind a regular expression proposes leftmost non-overlapping spans
(``regexp_extract_all``); the texts between them (``split`` by the same
expression) give their code-point offsets. A validator then confirms or drops
each match: ranges for IP addresses, Luhn for cards, mod 97 for IBANs, digit
counts for phones. An IBAN is the longest start of its proposal that ends at a
word edge, has the length of its country (15 to 34 where ``IBAN_LENGTHS`` has
none) and passes mod 97; proposals may overlap, IBANs do not. Words in the 40 characters of the text before or after a match
raise its score, whatever other matches lie there; ``iban`` and ``ssn`` spans must reach ``threshold``, the four base kinds
always stay.

The expressions start at the first character of a run (or where the last match
ended) and use possessive repeats, so long runs cost linear time and no stack;
they find the same spans as the plain forms.

Defined cases: null or empty text has no spans; repeated rows give equal
results; an empty table gives an empty result; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # Group 1 is the proposal; only its first four characters are taken, so it hides no other.
    "iban": r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])))[A-Z]{2}[0-9]{2}",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
# Cheap test that a text can hold a match at all.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]",
         "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]", "ssn": r"[0-9]{3}-[0-9]{2}-"}
CONTEXT = {"email": "mail|contact|write", "ip": r"\bip\b|address|host|server", "card": "card|visa|payment|credit",
           "phone": "phone|call|tel|mobile", "iban": "iban|account|bank|konto", "ssn": "ssn|social|security"}
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3}
# Lengths of the IBAN registry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "IR IS TR",
    27: "BF BI BJ CF CG CM DJ FR GA GR IT KM MC MG MR SM TD",
    28: "AL AZ BY CI CY DO GT HN HU LB ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU"}
_LISTED = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")
IBAN_FORM = "^(?:" + "|".join(f"(?:{c.replace(' ', '|')}).{{{n - 2}}}" for n, c in IBAN_LENGTHS.items()) \
    + f"|(?!{_LISTED}).{{15,34}})$"
SPANS = "array<struct<start:bigint,ord:int,end:bigint,kind:string,score:double>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def iban_valid(m: Column) -> Column:
    """The length is right and mod 97 of the rearranged number (letters as 10 to 35) is 1."""
    s = F.upper(F.regexp_replace(m, r"\x20", ""))
    turned = F.concat(F.substring(s, 5, 34), F.substring(s, 1, 4))
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: F.length(c) > 0), F.lit(0), lambda acc, c: F.when(
        c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
        .cast("int"))
    return s.rlike(IBAN_FORM) & (rest == 1)


def iban_in(m: Column) -> Column:
    """The longest start of a proposal, up to a word edge, that is an IBAN; else null."""
    words = F.split(m, r"\x20")
    starts = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), " "))
    return F.try_element_at(F.filter(starts, iban_valid), F.lit(-1))


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2}+)"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        d = _digits(m)
        return F.length(d).between(12, 19) & F.call_function("luhn_check", d)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "ssn":
        return ~m.rlike("^(?:000|666|9)") & ~m.rlike("-00-|-0000$")
    return F.lit(True)


def _spans_of(kind: str, text: Column, threshold: float) -> Column:
    # The last group is the text that follows, as far as context after the longest proposal reaches.
    p = F.lit(PATTERNS[kind] + rf"(?=([\s\S]{{0,{110 if kind == 'iban' else 40}}}))")
    pairs = F.arrays_zip(F.split(text, PATTERNS[kind], -1).alias("gap"),
                         F.regexp_extract_all(text, p, 0).alias("hit"),
                         F.regexp_extract_all(text, p, 1 if kind == "iban" else 0).alias("all"),
                         F.regexp_extract_all(text, p, 2 if kind == "iban" else 1).alias("rest"))
    pairs = pairs.cast("array<struct<gap:string,hit:string,all:string,rest:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        m = iban_in(x["all"]) if kind == "iban" else x["all"]
        end = start + F.length(m)
        before = F.right(F.concat(acc["tail"], x["gap"]), F.lit(40))
        after = F.substring(x["rest"], F.length(m) - F.length(x["hit"]) + 1, F.lit(40))
        near = F.lower(before).rlike(CONTEXT[kind]) | F.lower(after).rlike(CONTEXT[kind])
        score = F.lit(PRIOR[kind]) + F.when(near, (1.0 - F.lit(PRIOR[kind])) * 0.8).otherwise(0.0)
        ok = m.isNotNull() & (start >= acc["done"])
        if kind != "iban":
            ok = ok & valid(kind, m)
        if kind not in BASE_KINDS:
            ok = ok & (score >= threshold)
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("ord"), end.alias("end"),
                        F.lit(kind).alias("kind"), score.alias("score"))
        return F.struct(F.coalesce(start + F.length(x["hit"]), acc["at"]).alias("at"),
                        F.right(F.concat(before, F.coalesce(x["hit"], F.lit(""))), F.lit(40)).alias("tail"),
                        F.when(ok, end).otherwise(acc["done"]).alias("done"),
                        F.when(ok, F.concat(acc["out"], F.array(span).cast(SPANS))).otherwise(acc["out"]).alias("out"))

    none = F.array().cast(SPANS)
    nil = F.lit(0).cast("long")
    zero = F.struct(nil.alias("at"), F.lit("").alias("tail"), nil.alias("done"), none.alias("out"))
    found = F.aggregate(pairs, zero, step, lambda acc: acc["out"])
    return F.when(text.rlike(HINTS[kind]), found).otherwise(none)


def find_pii(text: Column | str, threshold: float = 0.7) -> Column:
    """Column of spans (start, ord, end, kind, score), by start, then kind as listed."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.array_sort(F.concat(*[_spans_of(k, text, threshold) for k in KINDS]))


def mask_pii(docs: DataFrame, text_col: str = "text", spans_col: str = "pii") -> DataFrame:
    """``docs`` with each stretch covered by spans replaced by ``[KIND]``; null text stays null."""
    text, spans = F.col(text_col), F.col(spans_col)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    done = F.aggregate(spans, zero, lambda acc, x: F.struct(
        F.greatest(acc["at"], x["end"]).alias("at"),
        F.when(x["start"] >= acc["at"], F.concat(
            acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")),
            F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(acc["out"]).alias("out")))
    return docs.withColumn(text_col, F.when(F.size(spans) > 0, F.concat(done["out"], F.substring(
        text, (done["at"] + 1).cast("int"), F.length(text)))).otherwise(text))
