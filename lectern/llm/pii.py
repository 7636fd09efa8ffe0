"""Personal data: patterns propose spans, checksums confirm them, words nearby
adjust the score.  DataFrame functions only.

Spans of a kind are leftmost and do not overlap; offsets are code points, end
exclusive.  Where a match starts follows from the pieces that the pattern
leaves when the text is split by it.  The patterns are the contract's, written
with possessive repeats and without second starts inside a run, so that no
text makes them scan a run twice.

Kinds: email, ip, card, phone (the base), and what the method adds: iban
(two letters, two digits, 11 to 30 letters or digits, mod-97), national phone
numbers and card numbers of 13 digits only where a word nearby speaks for
them.  A span's score is its kind's confidence, raised by a word of its kind
within `CONTEXT` characters before or after it and lowered by a word that
speaks against it; spans under `least_score` are dropped, base spans never are.

Defined results: a null text counts as empty and has no spans; each row is
judged alone, so ties and repeated rows need no care; extra columns stay, and
input columns named like a result are replaced.  An empty table gives an empty
result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import bound

CONTEXT = 40


@dataclass(frozen=True)
class Kind:
    """rank: order of kinds in lists.  needs: a text without it has no match
    (a plain search is cheaper than the pattern)."""

    name: str
    rank: int
    pattern: str
    confidence: float
    helps: str
    needs: str
    base: bool = True


KINDS = (
    Kind("email", 0, r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, r"(?i)e-?mail|mailto|contact|correo|courriel", "@"),
    Kind("ip", 1, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.7, r"(?i)\bip\b|address|host|server|login", "."),
    Kind("card", 2, r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){13,}+", 0.9, r"(?i)card|visa|master|credit|debit|payment", ""),
    Kind("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", 0.8, r"(?i)phone|\btel|call|mobile|fax", "+"),
    Kind("iban", 4, r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", 0.9, r"(?i)iban|account|bank|konto|compte|cuenta", "", base=False),
    Kind("phone", 3, r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])", 0.3, r"(?i)phone|\btel|call|mobile|fax", "", base=False),
    Kind("card", 2, r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12}+(?![\x20-]?[0-9])", 0.3, r"(?i)card|visa|master|credit|debit|payment", "", base=False),
)
AGAINST = r"(?i)version|isbn|serial|invoice|order no"


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def small_part(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(bare) <= 3) & (F.coalesce(F.substring(bare, 1, 3).cast("int"), F.lit(0)) <= 255)


def mod_97(match: Column) -> Column:
    """ISO 7064: the first four to the end, letters as 10 to 35."""
    bare = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))
    values = F.transform(F.split(turned, ""), lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(values, F.lit(0), lambda a, v: F.when(v >= 10, (a * 100 + v) % 97).otherwise((a * 10 + v) % 97)) == 1


def confirmed(kind: Kind, match: Column) -> Column:
    if kind.name == "email":
        return F.lit(True)
    if kind.name == "ip":
        return F.forall(F.split(match, r"\."), small_part)
    if kind.name == "iban":
        return F.length(F.replace(match, F.lit(" "), F.lit(""))).between(15, 34) & mod_97(match)
    if kind.name == "card":
        n = F.length(digits(match))
        return (n.between(14, 19) if kind.base else n == 13) & F.call_function("luhn_check", digits(match))
    return F.length(digits(match)).between(10, 15)


SPAN = "struct<start:int,rank:int,stop:int,kind:string,score:double,base:boolean>"


def sums_before(sizes: Column) -> Column:
    """Of each number of an array, the sum of those before it.  Sums of blocks
    of about the root of their number come first, so that no text with many
    matches takes time with their square."""

    def total(x: Column, first: Column, n: Column) -> Column:
        return F.aggregate(F.slice(x, first + 1, n), F.lit(0), lambda a, v: a + v)

    def upto(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def by_blocks(x: Column, width: Column) -> Column:
        whole = F.transform(upto(F.ceil(F.size(x) / width).cast("int")), lambda b: total(x, b * width, width))
        return bound(whole, lambda w: bound(F.transform(upto(F.size(w)), lambda b: total(w, F.lit(0), b)), lambda before: F.transform(upto(F.size(x)), lambda i: F.element_at(before, F.floor(i / width).cast("int") + 1) + total(x, i - i % width, i % width))))

    return bound(sizes, lambda x: bound(F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x))).cast("int")), lambda width: by_blocks(x, width)))


def spans_of(kind: Kind, text: Column, least_score: float) -> Column:
    """Array of SPAN of one kind."""
    none = F.array().cast(f"array<{SPAN}>")
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pieces = F.split(text, kind.pattern, -1)

    def placed(m: Column, gaps: Column) -> Column:
        # a match starts after the pieces and the matches before it
        before = sums_before(F.zip_with(F.slice(gaps, 1, F.size(m)), m, lambda g, x: F.length(g) + F.length(x)))
        return F.arrays_zip(before.alias("at"), F.slice(gaps, 1, F.size(m)).alias("before"), m.alias("match"), F.slice(gaps, 2, F.size(m)).alias("after"))

    def span(x: Column) -> Column:
        near = F.concat(F.right(x["before"], F.lit(CONTEXT)), F.lit("\n"), F.left(x["after"], F.lit(CONTEXT)))
        score = F.lit(kind.confidence) + F.when(near.rlike(kind.helps), 0.3).otherwise(0.0) - F.when(near.rlike(AGAINST), 0.3).otherwise(0.0)
        start = x["at"] + F.length(x["before"])
        return F.struct(
            start.alias("start"),
            F.lit(kind.rank).alias("rank"),
            (start + F.length(x["match"])).alias("stop"),
            F.lit(kind.name).alias("kind"),
            F.least(F.greatest(F.round(score, 2), F.lit(0.0)), F.lit(1.0)).alias("score"),
            F.lit(kind.base).alias("base"),
        )

    rows = bound(found, lambda m: bound(pieces, lambda gaps: placed(m, gaps)))
    made = F.transform(F.filter(rows, lambda x: confirmed(kind, x["match"])), span)
    if not kind.base:
        made = F.filter(made, lambda s: s["score"] >= least_score)
    possible = F.contains(text, F.lit(kind.needs)) if kind.needs else F.lit(True)
    return F.when(possible & F.rlike(text, F.lit(kind.pattern)), made).otherwise(none)


def find_spans(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """`docs` with spans, an array of SPAN by start and kind.  An added span
    that overlaps a base span is dropped."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "spans"])
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(*[spans_of(k, text, least_score) for k in KINDS if k.base])
    more = F.concat(*[spans_of(k, text, least_score) for k in KINDS if not k.base])
    own = docs.withColumns({"_lx_base": base, "_lx_more": more})
    apart = F.filter("_lx_more", lambda m: ~F.exists("_lx_base", lambda b: (b["start"] < m["stop"]) & (m["start"] < b["stop"])))
    return own.withColumn("spans", F.array_sort(F.concat("_lx_base", apart))).drop("_lx_base", "_lx_more")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["base"])


def redact(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """`docs` with their text masked, `[kind]` for each span; of spans that
    overlap, what comes after the first is masked with it."""
    found = find_spans(docs, least_score)
    text = F.col("text")
    masked = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.when(s["start"] >= a["at"], F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"), s["stop"].alias("at"))).otherwise(
            F.struct(a["out"].alias("out"), F.greatest(a["at"], s["stop"]).alias("at"))
        ),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    return found.withColumn("text", masked)
