"""How images, chunks and the text around them belong together."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.geometry import argmax, flag

# Keywords of each context of an image, looked up as substrings of lower-cased text.
IMAGE_CONTEXTS = {
    "energy_tips": ("tip", "advice", "save", "energy", "reduce", "efficient", "laundry", "loads"),
    "usage_data": ("usage", "kwh", "typical", "average", "month", "bill", "consumption"),
    "contact_info": ("contact", "call", "visit", "website", "scan", "qr", "code"),
    "account_info": ("account", "number", "service", "address", "customer"),
    "savings": ("save", "savings", "money", "cost", "reduce", "lower"),
    "comparison": ("above", "below", "typical", "average", "compare", "neighbors"),
}
# Keywords of each context of a chunk.
CHUNK_CONTEXTS = {
    "energy_tips": ("tip", "advice", "save", "reduce", "laundry", "load"),
    "usage_data": ("usage", "kwh", "typical", "above", "below", "consumption"),
    "contact_info": ("contact", "call", "visit", "scan", "qr"),
    "account_info": ("account", "number", "service", "address"),
    "savings": ("save", "money", "cost", "savings"),
    "comparison": ("compare", "neighbors", "average", "typical"),
}
# Contexts that go together, and the context that a chunk's type stands for.
RELATED = (
    ("energy_tips", "savings"), ("energy_tips", "usage_data"), ("usage_data", "comparison"), ("usage_data", "savings"), ("contact_info", "account_info"),
    ("account_info", "contact_info"), ("savings", "energy_tips"), ("savings", "usage_data"), ("comparison", "usage_data"),
)
TYPE_CONTEXT = {"header": "account_info", "footer": "contact_info", "advice": "energy_tips", "usage_data": "usage_data", "account_info": "account_info"}
NEARBY = ("energy", "tip", "save", "usage", "kwh", "laundry", "load")


def matches(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(0)
    for w in words:
        out = out + F.contains(text, F.lit(w)).cast("int")
    return out


def context_score(low: Column, words: Column, keywords: tuple[str, ...]) -> Column:
    """Mean of the share of keywords found and of matches by words."""
    m = matches(low, keywords)
    return (m / len(keywords) + F.least(m / F.greatest(words * 0.1, F.lit(1.0)), F.lit(1.0))) / 2


def nearby_text(text: Column, page: Column) -> Column:
    """Paragraph `page`, or up to three paragraphs with a keyword, or those
    around the middle."""
    paragraphs = F.split(text, "\n\n")
    keyed = F.slice(F.filter(paragraphs, lambda p: matches(F.lower(p), NEARBY) > 0), 1, 3)
    middle = F.floor(F.size(paragraphs) / 2).cast("int")
    around = F.slice(paragraphs, F.greatest(middle, F.lit(1)), 3)
    picked = F.when(page < F.size(paragraphs), F.array(F.get(paragraphs, page))).when(F.size(keyed) > 0, keyed).otherwise(around)
    return F.array_join(picked, " ")


def chunk_context(low: Column, kind: Column) -> Column:
    """The context with most keywords, first named of equals; none: by type."""
    scores = {name: matches(low, words) for name, words in CHUNK_CONTEXTS.items()}
    best = argmax(scores)
    by_type = F.lit("general")
    for name, context in TYPE_CONTEXT.items():
        by_type = F.when(kind == name, context).otherwise(by_type)
    return F.when(best["score"] > 0, best["name"]).otherwise(by_type)


def related(a: Column, b: Column) -> Column:
    out = F.lit(False)
    for x, y in RELATED:
        out = out | ((a == x) & (b == y))
    return out


def context_match(chunk: Column, image: Column, kind: Column, image_type: Column, common: Column) -> Column:
    score = (
        F.when(chunk == image, 0.6).when(related(chunk, image), 0.3).otherwise(0.0)
        + flag((kind == "advice") & (image_type == "photo"), 0.2)
        + flag((kind == "usage_data") & (image_type == "chart"), 0.3)
        + flag(kind.isin("header", "footer") & (image_type == "logo"), 0.2)
        + F.least(common * 0.05, F.lit(0.2))
    )
    return F.least(score, F.lit(1.0))
