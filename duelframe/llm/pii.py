"""Personal data: patterns propose spans, checksums confirm them, context words adjust scores.

Everything is a column expression. One pattern with a lazy head gives the gap before and
the text of every match, in order; running sums of their lengths are the positions in code
points. Runs that a pattern could enter at many places are entered at their first place or
where the last match ended, which finds the same matches without trying each place anew.
Repeated groups at an end are possessive: Java runs them as loops, others by recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.llm.names import unused

# Countries by the length of their account numbers.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _account(size: int, countries: str) -> str:
    groups, rest = divmod(size - 4, 4)
    return rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:[\x20]?[A-Z0-9]{{4}}){{{groups}}}" + (rf"[\x20]?[A-Z0-9]{{{rest}}}" if rest else "")


# The four base patterns with their order.
KINDS = ("email", "ip", "card", "phone", "iban")
_EMAIL_CHARS = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_EMAIL_CHARS})){_EMAIL_CHARS}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # Country code, check digits and 11 to 30 letters or digits, in groups of four or closed up.
    # The country's own length comes first: a word behind the number may look like a group.
    "iban": r"(?<![A-Za-z0-9])(?:" + "|".join(_account(*item) for item in IBAN_LENGTHS.items())
    + r"|[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
}
# Characters a text must hold for its kind's pattern to be tried at all.
_NEEDED = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]", "iban": "[A-Z]{2}[0-9]{2}"}
# Words before or after a span that speak for its kind.
CONTEXT = {
    "email": "mail|contact|write|correo|courriel",
    "ip": "\\bip\\b|host|server|address|login",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|\\btel\\b|call|mobile|fax|telefon|tel[eé]fono",
    "iban": "iban|account|bank|konto|compte|cuenta",
}
_BASE_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7}
CONTEXT_CHARS = 30
CONTEXT_SCORE = 0.2

_EMPTY = "CAST(array() AS array<struct<kind: string, start: bigint, end: bigint, score: double>>)"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass the Luhn check."""
    digits = F.transform(F.split(F.reverse(_digits(value)), ""), lambda d: d.cast("int"))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda acc, d: acc + F.coalesce(d, F.lit(0))) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number passes the mod-97 check (letters count 10 to 35)."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    step = lambda acc, c: F.when(
        c.between("0", "9"), (acc * 10 + c.cast("int")) % 97
    ).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), step) == 1


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
        return F.forall(F.split(value, "\\."), lambda p: part(p) & (F.substring(F.concat(F.lit("000"), p), -3, 3) <= "255"))
    count = F.length(_digits(value))
    if kind == "card":
        return F.when(count.between(12, 19), luhn(value)).otherwise(False)
    if kind == "phone":
        return count.between(9, 15)
    return F.when(F.length(F.regexp_replace(value, " ", "")).between(15, 34), mod97(value)).otherwise(False)


def _kind_spans(text: Column, kind: str) -> Column:
    """Confirmed spans of one kind, in order of their start."""
    # Without \G the search would begin again at every place behind the last match.
    found = f"(?s)\\G(.*?)({PATTERNS[kind]})"
    gaps = F.regexp_extract_all(text, F.lit(found), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(found), F.lit(2))
    # Ends of all matches: a running sum kept as an array of numbers.
    pieces = F.arrays_zip(gaps.alias("gap"), values.alias("value"))
    size = F.transform(pieces, lambda p: F.struct(F.length(p["gap"]).alias("gap"), F.length(p["value"]).alias("size")))
    zero = F.expr("CAST(array(0) AS array<bigint>)")
    ends = F.aggregate(
        size, zero, lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + p["gap"] + p["size"]))
    )
    placed = F.arrays_zip(pieces.alias("piece"), F.slice(ends, F.lit(2), F.size(pieces)).alias("end"))
    confirmed = F.filter(placed, lambda m: _valid(kind, m["piece"]["value"]))
    words = f"(?i)({CONTEXT[kind]})"

    def named(m: Column) -> Column:
        start = (m["end"] - F.length(m["piece"]["value"])).cast("int")
        first = F.greatest(start - CONTEXT_CHARS, F.lit(0))
        before = F.substr(text, first + 1, start - first)
        return before.rlike(words) | F.substr(text, m["end"].cast("int") + 1, F.lit(CONTEXT_CHARS)).rlike(words)

    spans = F.transform(
        confirmed,
        lambda m: F.struct(
            F.lit(kind).alias("kind"),
            (m["end"] - F.length(m["piece"]["value"])).alias("start"),
            m["end"].alias("end"),
            (F.lit(_BASE_SCORE[kind]) + F.when(named(m), CONTEXT_SCORE).otherwise(0.0)).alias("score"),
        ),
    )
    return F.when(text.rlike(_NEEDED[kind]), spans).otherwise(F.expr(_EMPTY))


def find_spans(docs: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with an array ``out`` of spans: kind, start, end (exclusive), score.

    Spans stand in order of start, then of kind as in ``KINDS``. A null or empty text has
    none. Every column of ``docs`` is kept; a column named ``out`` is replaced.
    """
    return docs.withColumn(out, spans_of(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def spans_of(text: Column) -> Column:
    def ranked(kind: str, rank: int) -> Column:
        return F.transform(_kind_spans(text, kind), lambda s: F.struct(s["start"], F.lit(rank).alias("rank"), s["kind"], s["end"], s["score"]))

    return F.transform(
        F.array_sort(F.concat(*[ranked(kind, i) for i, kind in enumerate(KINDS)])),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")),
    )


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """Counts by kind, the hash of the base spans and all spans, one row per document.

    Null and empty texts have no spans. Rows without an id, or with another's, get rows of their own.
    """
    found = find_spans(docs.select("doc_id", "text"), out="found")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"].isin(*KINDS[:4]))
    return found.select(
        "doc_id",
        *[count(kind) for kind in KINDS],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"),
        F.coalesce(F.array_max(F.transform("found", lambda s: s["score"])), F.lit(0.0)).alias("max_score"),
    )


def mask_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Texts with every span replaced by its kind in brackets, all columns kept.

    Spans that overlap are replaced together, by the kind of the first. ``n_chars`` follows
    the new text where the table has that column; null texts stay null.
    """
    spans_col, merged_col, masked_col = (unused(docs, name) for name in ("_spans", "_merged", "_masked"))
    start = lambda s: s["start"]
    empty = F.expr("CAST(array() AS array<struct<kind: string, start: bigint, end: bigint>>)")
    merged = F.aggregate(
        spans_col,
        empty,
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (start(s) < F.element_at(acc, -1)["end"]),
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(
                    F.struct(
                        F.element_at(acc, -1)["kind"].alias("kind"),
                        F.element_at(acc, -1)["start"].alias("start"),
                        F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))),
    )
    text = F.col(text_col)
    pieces = F.transform(
        merged_col,
        lambda s, i: F.concat(
            F.substr(
                text,
                F.coalesce(F.get(merged_col, i - 1)["end"], F.lit(0)).cast("int") + 1,
                (start(s) - F.coalesce(F.get(merged_col, i - 1)["end"], F.lit(0))).cast("int"),
            ),
            F.lit("["),
            F.upper(s["kind"]),
            F.lit("]"),
        ),
    )
    rest = F.substr(text, F.element_at(merged_col, -1)["end"].cast("int") + 1, F.length(text))
    masked = F.when(F.size(merged_col) > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(text)
    out = find_spans(docs, text_col, spans_col).withColumn(merged_col, merged).withColumn(masked_col, masked)
    names = [F.col(masked_col).alias(c) if c == text_col else F.col(c) for c in docs.columns]
    done = out.select(*names)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return done
