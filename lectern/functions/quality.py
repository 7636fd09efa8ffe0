"""Scores of extractions and what to do about them, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.geometry import argmax, flag

# Artifacts of extraction, and what each costs; advice and its bounds.
VALIDITY_ARTIFACTS = ("Col1", "Col2", "Col3", "��", "NULL")
ADVICE = (
    ("structure", 0.5, "Consider using enhanced layout analysis for better structure preservation"),
    ("chunking", 0.6, "Adjust chunking strategy or parameters for better embedding optimization"),
    ("classification", 0.7, "Review image classification confidence thresholds"),
    ("correlation", 0.5, "Improve text-image correlation by providing more detailed text content"),
    ("coverage", 0.6, "Consider adjusting multimodal pairing strategy for better coverage"),
    ("diversity", 0.5, "Enhance image classification to identify more diverse image types"),
)
LOW_OVERALL = (0.6, "Consider processing with higher quality settings or manual review")
HIGH_OVERALL = (0.8, "High quality extraction achieved - suitable for production use")
# Order that settles ties between kinds of regions.
REGION_KINDS = ("table", "chart", "image", "text", "header", "footer")


def two_places(x: Column) -> Column:
    """Half up on the decimal value."""
    return F.round(x.cast("decimal(18,9)"), 2).cast("double")


def validity(text: Column) -> Column:
    """The second score of a text: stricter on length and marks than
    `quality_score`; empty texts score 0."""
    score = F.lit(100) - F.when(F.length(text) < 100, 40).otherwise(0)
    score = score - F.when((F.regexp_count(text, F.lit("[.!?]")) == 0) & (X.word_count(text) > 10), 30).otherwise(0)
    score = score - F.when(F.regexp_count(text, F.lit(r"([^\n])\1{4,}")) > 5, 20).otherwise(0)
    for a in VALIDITY_ARTIFACTS:
        score = score - F.when(F.contains(text, F.lit(a)), 10).otherwise(0)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.greatest(score, F.lit(0)))


def advice(scores: dict[str, Column], overall: Column) -> Column:
    """Array of sentences; scores are those of ADVICE."""
    rows = [F.when(scores[name] < bound, text) for name, bound, text in ADVICE]
    last = F.when(overall < LOW_OVERALL[0], LOW_OVERALL[1]).when(overall > HIGH_OVERALL[0], HIGH_OVERALL[1])
    return F.array_compact(F.array(*rows, last))


def recommendation_reason(method: Column, score: Column) -> Column:
    shown = F.concat(F.lit(" ("), score.cast("string"), F.lit(")"))
    return (
        F.when(F.coalesce(method, F.lit("")) == "", "No extraction method succeeded")
        .when(score < 30, F.concat(method, F.lit(" scored highest"), shown, F.lit(" but quality is still poor. Consider visual OCR with preprocessing.")))
        .when(score < 60, F.concat(method, F.lit(" scored highest"), shown, F.lit(" with moderate quality. May need fallback methods.")))
        .when(method == "visual_ocr", F.concat(F.lit("Visual OCR recommended"), shown, F.lit(" - programmatic methods likely have invisible text issues")))
        .when(method == "pdfplumber", F.concat(F.lit("PDFPlumber recommended"), shown, F.lit(" - good for complex layouts and tables")))
        .otherwise(F.concat(method, F.lit(" recommended"), shown, F.lit(" - standard extraction works well")))
    )


def visibility_reason(r: dict[str, Column], likely_photo: Column, has_text: Column) -> Column:
    """r: position ratios of the image."""
    area = r["w"] * r["h"]
    large = F.when(area > 0.3, 1.0).otherwise(area / 0.3) > 0.5
    small = F.when(area < 0.05, 1.0).otherwise((0.05 - area) / 0.05) > 0.5
    parts = [
        F.when(large, "large size").when(small, "small size"),
        F.when((r["x"] > 0.4) & (r["x"] < 0.6) & (r["y"] > 0.3) & (r["y"] < 0.7), "centered position"),
        F.when(r["y"] < 0.15, "header position"),
        F.when(r["y"] > 0.85, "footer position"),
        F.when(likely_photo, "photographic content"),
        F.when(has_text, "contains text"),
        F.when((r["w"] > 0.8) & (r["h"] > 0.8), "page-sized dimensions"),
    ]
    said = F.array_join(F.array_compact(F.array(*parts)), ", ")
    return F.when(said == "", "general characteristics").otherwise(said)


def region_kind(w: Column, h: Column, y: Column, page_h: float, content: dict[str, Column]) -> Column:
    """Struct (score, rank, name) of the likeliest kind: by shape, by place on
    the page, and half of what the content says."""
    aspect = w / F.greatest(h, F.lit(1))
    very_wide, wide, narrow = aspect > 4, (aspect > 2) & (aspect <= 4), aspect < 0.5
    scores = {
        "table": flag(very_wide, 0.3) + flag(wide, 0.2),
        "chart": flag(narrow, 0.3),
        "image": flag(narrow, 0.2),
        "text": flag(wide, 0.3),
        "header": flag(very_wide, 0.2) + flag(y < page_h * 0.2, 0.3),
        "footer": flag(y > page_h * 0.8, 0.3),
    }
    return argmax({k: s + content[k] * 0.5 if k in content else s for k, s in scores.items()}, list(REGION_KINDS))


def page_band(y: Column, page_h: float) -> Column:
    """header in the top 15 % of a page, footer in the bottom 15 %, else null."""
    return F.when(y <= page_h * 0.15, "header").when(y >= page_h * 0.85, "footer")


def pie_share(area: Column, r: Column) -> Column:
    """Per cent of a circle that a segment takes; null under a tenth of r squared."""
    return F.when(area > r * r * 0.1, area / (F.pi() * r * r) * 100)
