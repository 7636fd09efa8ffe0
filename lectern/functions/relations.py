"""What the text near an image says about it: rule tables over lower-cased
text, evaluated as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import has

# Fixed values: (finding, kinds of image, words of which any must occur, words of which any must occur too).
INDICATORS = (
    ("website_reference", ("logo",), ("franklinenergy.com", "website"), ()),
    ("laundry_activity_reference", ("photo",), ("laundry",), ("load", "full", "tip")),
    ("energy_saving_context", ("photo",), ("save",), ("energy",)),
    ("usage_data_reference", ("chart",), ("usage", "kwh", "typical", "above", "below"), ()),
    ("percentage_data", ("chart",), ("%", "percent"), ()),
    ("qr_code_reference", ("unknown",), ("qr", "scan", "code"), ()),
)
COMPANY_WORDS = ("xcel", "energy", "franklin")
RELATIONSHIPS = (
    ("direct_reference", (), ("image", "picture", "photo"), ()),
    ("instructional_support", ("photo", "illustration"), ("tip", "advice", "how to"), ()),
    ("data_visualization", ("chart",), ("usage", "data", "above", "typical"), ()),
    ("brand_identification", ("logo",), ("company", "energy", "contact"), ()),
    ("call_to_action", (), ("scan", "visit"), ()),
)
# Flags of a page's text, with the context that each one stands for; the last true one wins.
PAGE_FLAGS = (
    ("has_company_references", ("xcel", "franklin", "energy", "company"), None),
    ("has_data_references", ("usage", "kwh", "typical", "above", "below", "%"), "usage_data"),
    ("has_qr_references", ("scan", "qr", "code", "franklinenergy.com", "visit"), "qr_code"),
    ("has_activity_references", ("laundry", "tip", "save", "loads", "full"), "energy_tip"),
)
# Descriptions by kind, and those of a context with certain kinds.
BY_KIND = (("logo", "Company logo or branding element"), ("photo", "Photograph or illustration"), ("chart", "Chart or data visualization"), ("diagram", "Diagram or schematic"), ("unknown", "Unidentified image element"))
BY_CONTEXT = (
    ("energy_tips", ("photo",), "Illustration supporting energy-saving tip about laundry practices"),
    ("contact_info", ("unknown", "diagram"), "QR code for accessing online energy account or website"),
    ("usage_data", ("chart",), "Energy usage comparison chart showing consumption relative to typical usage"),
    ("account_info", ("logo",), "Company logo associated with energy service provider branding"),
)
# What a kind of image gains from words of its page.
KIND_GAIN = (("logo", ("company", "energy", "xcel"), 0.3), ("photo", ("tip", "save", "laundry", "home"), 0.4), ("chart", ("usage", "kwh", "typical"), 0.5))
NEAR_WORDS = ("tip", "advice", "save", "energy", "use")
REGION_WORDS = {"table": ("table", "data", "comparison", "vs", "usage", "kwh"), "chart": ("chart", "graph", "usage", "monthly", "annual", "percent", "%"), "image": ("tip", "save", "energy", "efficient", "home")}


def findings(rules: tuple, kind: Column, low: Column) -> Column:
    """Names of the rules that hold, in their order."""
    out = []
    for name, kinds, any_of, too in rules:
        holds = has(low, *any_of)
        holds = holds & has(low, *too) if too else holds
        holds = holds & kind.isin(*kinds) if kinds else holds
        out.append(F.when(holds, name))
    return F.array_compact(F.array(*out))


def indicators(kind: Column, near: Column, full: Column) -> Column:
    branding = F.when((kind == "logo") & has(full, *COMPANY_WORDS), F.array(F.lit("company_branding"))).otherwise(F.array().cast("array<string>"))
    return F.concat(branding, findings(INDICATORS, kind, near))


def correlation_strength(best_context: Column, found: Column) -> Column:
    """The best context score (none: .1) with .3 of .2 for each indicator."""
    return F.least(F.coalesce(best_context, F.lit(0.1)) + F.size(found) * 0.2 * 0.3, F.lit(1.0))


def page_flags(low: Column) -> Column:
    context = F.lit(None).cast("string")
    for _, words, name in PAGE_FLAGS:
        context = F.when(has(low, *words), name).otherwise(context) if name else context
    return F.struct(*[has(low, *words).alias(flag) for flag, words, _ in PAGE_FLAGS], context.alias("context_type"))


def description(kind: Column, context: Column) -> Column:
    base = F.lit("Image element")
    for k, text in BY_KIND:
        base = F.when(kind == k, text).otherwise(base)
    out = F.concat(base, F.lit(" related to "), F.replace(context, F.lit("_"), F.lit(" ")))
    for c, kinds, text in BY_CONTEXT:
        out = F.when((context == c) & kind.isin(*kinds), text).otherwise(out)
    return out


def element_description(kind: Column, confidence: Column, w: Column, h: Column) -> Column:
    """How sure the kind is, the size and a long shape, as sentences."""
    sure = F.when(confidence > 0.7, F.concat(F.lit("This appears to be a "), kind)).when(confidence > 0.4, F.concat(F.lit("This is likely a "), kind)).otherwise(F.concat(F.lit("This may be a "), kind, F.lit(" or other visual element")))
    size = F.when((w > 400) | (h > 400), "of large size").when((w < 100) | (h < 100), "of small size").otherwise("of medium size")
    aspect = F.when(h > 0, w / h).otherwise(1.0)
    shape = F.when(aspect > 2.0, "with a wide aspect ratio").when(aspect < 0.5, "with a tall aspect ratio")
    return F.concat(F.concat_ws(". ", sure, size, shape), F.lit("."))


def page_correlation(kind: Column, low: Column, has_text: Column) -> Column:
    gain = F.lit(0.0)
    for k, words, value in KIND_GAIN:
        gain = F.when((kind == k) & has(low, *words), value).otherwise(gain)
    return F.least(gain + F.when(has_text, 0.2).otherwise(0.0), F.lit(1.0))


def near_lines(text: Column, most: int = 3) -> Column:
    """The first lines with a keyword, stripped, joined by blanks."""
    lines = F.filter(F.split(text, "\n"), lambda x: has(F.lower(x), *NEAR_WORDS))
    return F.array_join(F.transform(F.slice(lines, 1, most), lambda x: F.trim(x)), " ")


def with_references(text: Column, images: Column) -> Column:
    """Markers for a page's images (filename, type, x, y), one after another:
    photos of a page with tips go after the tip's label, others to the end.

    The markers are put together first and the text is built once, so the work
    follows their number.  A marker that names a tip makes the page one with
    tips for the images after it; file names are not searched for the label; an
    image without one of its four values has no marker."""
    label, tip = F.lit("Monthly savings tip:"), F.lit("tip")

    def bound(value: Column, use: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def mark(i: Column) -> Column:
        shown = F.concat(F.lit("\n\n[IMAGE: "), i["filename"], F.lit(" - "), i["type"], F.lit(" at ("), i["x"].cast("string"), F.lit(", "), i["y"].cast("string"), F.lit(")]\n\n"))
        return F.struct(shown.alias("text"), F.coalesce(i["type"].isin("photo", "illustration"), F.lit(False)).alias("picture"))

    def started(marks: Column) -> Column:
        """The number of the first image that comes to a page with tips."""
        first = F.array_position(F.transform(marks, lambda m: F.coalesce(F.contains(F.lower(m["text"]), tip), F.lit(False))), True)
        return F.struct(marks.alias("marks"), F.when(F.contains(F.lower(text), tip), 0).when(first > 0, first).otherwise(F.size(marks)).alias("first"))

    def joined(own: Column) -> Column:
        inside = F.filter(own["marks"], lambda m, n: m["picture"] & (n >= own["first"]))
        behind = F.filter(own["marks"], lambda m, n: ~m["picture"] | (n < own["first"]))
        # each goes right behind the label, so the last comes first
        tips, rest = (F.array_join(F.transform(x, lambda m: m["text"]), "") for x in (F.reverse(inside), behind))
        return F.concat(F.replace(text, label, F.concat(label, tips)), rest)

    return bound(F.transform(images, mark), lambda marks: bound(started(marks), joined))


def region_correlation(kind: Column, low: Column) -> Column:
    """Share of a region kind's keywords that the text has."""
    out = F.lit(0.0)
    for k, words in REGION_WORDS.items():
        n = F.lit(0)
        for w in words:
            n = n + F.contains(low, F.lit(w)).cast("int")
        out = F.when(kind == k, n / len(words)).otherwise(out)
    return out
