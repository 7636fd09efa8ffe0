"""Boxes, positions and image scores as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(condition: Column, value: float) -> Column:
    return F.when(condition, value).otherwise(0.0)


def position_ratios(x: Column, y: Column, w: Column, h: Column, page_w: float, page_h: float) -> dict[str, Column]:
    return {"x": x / page_w, "y": y / page_h, "w": w / page_w, "h": h / page_h}


def visibility_score(r: dict[str, Column], density: Column) -> Column:
    """From .5: large, centred, page-sized, dense text, small, header or footer."""
    area = r["w"] * r["h"]
    large = F.when(area > 0.3, 1.0).otherwise(area / 0.3)
    small = F.when(area < 0.05, 1.0).otherwise((0.05 - area) / 0.05)
    centred = (r["x"] > 0.4) & (r["x"] < 0.6) & (r["y"] > 0.3) & (r["y"] < 0.7)
    edge = (r["y"] < 0.15) | (r["y"] > 0.85)
    paged = (r["w"] > 0.8) & (r["h"] > 0.8)
    score = F.lit(0.5) + flag(large > 0.5, 0.2) + flag(centred, 0.15) - flag(paged, 0.3) - flag(density > 0.5, 0.2) + flag(small > 0.7, 0.1) + flag(edge, 0.05)
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def visibility(score: Column, r: dict[str, Column]) -> Column:
    return F.when((r["w"] > 0.8) & (r["h"] > 0.8), "background").when(score > 0.7, "visible").when(score > 0.4, "embedded").otherwise("background")


#: The least score that each kind needs, in the order that settles ties.
KIND_BOUNDS = (("logo", 0.6), ("chart", 0.7), ("diagram", 0.6), ("photo", 0.5), ("qr_code", 0.8))


def image_scores(w: Column, h: Column, r: dict[str, Column], colours: Column, text: Column, company: Column, data: Column, qr: Column, activity: Column, site: Column) -> dict[str, Column]:
    """site: whether the page names the site that its codes lead to."""
    area, aspect = w * h, w / F.greatest(h, F.lit(1))
    small, limited = area < 10_000, colours < 50
    return {
        "logo": flag(small, 0.4) + flag((r["y"] < 0.2) | (r["y"] > 0.8), 0.3) + flag((r["x"] < 0.2) | (r["x"] > 0.8), 0.2) + flag(limited, 0.3) + flag(company, 0.2),
        "chart": flag((r["w"] > 0.6) | (r["h"] > 0.6), 0.3) + flag(text, 0.4) + flag(limited, 0.3) + flag(data, 0.3),
        "diagram": flag(limited, 0.4) + flag(text, 0.3) + flag((aspect >= 0.5) & (aspect <= 2.0), 0.2),
        "photo": flag(colours > 1000, 0.4) + flag(~text, 0.3) + flag(area > 100_000, 0.3) + flag(activity, 0.3),
        "qr_code": flag((aspect >= 0.8) & (aspect <= 1.2), 0.3) + flag(small & limited, 0.2) + flag(qr, 0.4) + flag(text & site, 0.2),
    }


def argmax(scores: dict[str, Column], order: list[str] | None = None) -> Column:
    """Struct (score, name) of the largest; the first named of equals."""
    names = order or list(scores)
    pairs = [F.struct(F.round(scores[n], 6).alias("score"), F.lit(-i).alias("rank"), F.lit(n).alias("name")) for i, n in enumerate(names)]
    return F.array_max(F.array(*pairs))


def overlap_share(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection by the smaller area."""
    w = F.greatest(F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]), F.lit(0))
    h = F.greatest(F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]), F.lit(0))
    return w * h / F.least(a["w"] * a["h"], b["w"] * b["h"])


def relative_position(ax: Column, ay: Column, bx: Column, by: Column, tolerance: int = 20) -> Column:
    """Where the first centre lies from the second."""
    return (
        F.when(F.abs(ay - by) < tolerance, F.when(ax < bx, "left_of").otherwise("right_of"))
        .when(F.abs(ax - bx) < tolerance, F.when(ay < by, "above").otherwise("below"))
        .when((ax < bx) & (ay < by), "top_left_of")
        .when((ax >= bx) & (ay < by), "top_right_of")
        .when((ax < bx) & (ay >= by), "bottom_left_of")
        .otherwise("bottom_right_of")
    )


def quadrant(cx: Column, cy: Column, w: float, h: float) -> Column:
    return F.concat(F.when(cy < h / 2, "top_").otherwise("bottom_"), F.when(cx < w / 2, "left").otherwise("right"))


def zone(cy: Column, h: float) -> Column:
    return F.when(cy < 0.2 * h, "header").when(cy > 0.8 * h, "footer").otherwise("body")
