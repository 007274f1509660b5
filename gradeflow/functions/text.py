"""Column functions on names, paths, points and times. Classes of characters are spelled out, since regex dialects differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\x20\x09-\x0D]"
PTS = r"(?:points?|pts?)"


def strip(c) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def number(c, pattern: str, group: int = 1) -> Column:
    """The first match's number; null if there is none or it doesn't fit an int."""
    return F.regexp_extract(c, pattern, group).try_cast("int")


def exam_id(c) -> Column:
    """Letters, digits and white space only, runs of white space as one underscore."""
    return F.regexp_replace(F.regexp_replace(c, r"[^a-zA-Z0-9\x20\x09-\x0D]", ""), rf"{WS}+", "_")


def section_id(c) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9_]", "_"), "_+", "_")


def clean_section_name(c) -> Column:
    """Without leading ``n.``, then trailing mark, then trailing points."""
    c = F.regexp_replace(c, rf"^[0-9]+\.{WS}*", "")
    c = F.regexp_replace(c, rf"{WS}*[:|-]{WS}*$", "")
    return strip(F.regexp_replace(c, rf"(?i){WS}*[0-9]+{WS}*{PTS}?{WS}*$", ""))


def render_item(c) -> Column:
    """Double quotes as single ones, trimmed, cut at 100 characters with an ellipsis."""
    c = strip(F.replace(c, F.lit('"'), F.lit("'")))
    return F.when(F.length(c) > 100, F.concat(F.substring(c, 1, 100), F.lit("..."))).otherwise(c)


def points_in(c) -> Column:
    """(n pts), then n pts, then ``: n`` at the end; null if none."""
    return F.coalesce(*[number(c, p) for p in POINT_PATTERNS])


#: In order: the first that matches counts.
POINT_PATTERNS = (rf"(?i)\(([0-9]+){WS}*{PTS}?\)", rf"(?i)([0-9]+){WS}*{PTS}", rf"(?i):{WS}*([0-9]+)$")


def without_points(c) -> Column:
    """The text without the match that gave its points."""
    out = strip(c)
    for p in reversed(POINT_PATTERNS):
        out = F.when(F.regexp_like(c, F.lit(p)), strip(F.regexp_replace(c, "(?s)^(.*?)" + p.replace("(?i)", "(?i:") + ")", "$1"))).otherwise(out)
    return out


def digits_only(cells) -> Column:
    return F.filter(cells, lambda x: F.coalesce(F.regexp_like(x, F.lit("^[0-9]+$")), F.lit(False)))


def section_points(text, cells) -> Column:
    """n points in the text, else the largest all-digit cell, else 0."""
    largest = F.array_max(F.transform(digits_only(cells), lambda x: x.try_cast("int")))
    return F.coalesce(number(text, rf"(?i)([0-9]+){WS}*{PTS}"), largest, F.lit(0))


def extension(path) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1))


def object_path(path) -> tuple[Column, Column]:
    """Bucket and object, split at the first slash."""
    parts = F.split(path, "/", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def file_name(c, default: str = "file") -> Column:
    """Spaces as underscores, unsafe characters dropped, the default for an empty base; the extension kept."""
    ext = F.regexp_extract(c, r"(\.[^./]+)$", 1)
    base = F.regexp_replace(F.replace(F.substring(c, F.lit(1), F.length(c) - F.length(ext)), F.lit(" "), F.lit("_")), "[^A-Za-z0-9_.-]", "")
    return F.concat(F.when(base == "", default).otherwise(base), F.regexp_replace(ext, "[^A-Za-z0-9.]", ""))


def to_mmss(seconds) -> Column:
    """MM:SS of whole seconds, MMM:SS and so on from 100 minutes; ``nan`` for null."""
    s = F.floor(seconds)
    two = lambda x: F.when(x < 10, F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))
    return F.coalesce(F.concat(two(F.floor(s / 60)), F.lit(":"), two(s % 60)), F.lit("nan"))


def one_decimal(seconds) -> Column:
    """Seconds with one decimal, halves of the decimal form away from 0; ``nan`` for null and what isn't finite. ``from_mmss`` reads it back."""
    finite = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < float("inf"))
    return F.when(finite, F.format_string("%.1f", F.round(seconds.cast("decimal(30, 9)"), 1).cast("double"))).otherwise("nan")


def from_mmss(text) -> Column:
    """Seconds of ``MM:SS``, with more digits of minutes where ``to_mmss`` writes them, or of a number; null for ``nan`` and anything else."""
    parts = F.split(text, ":")
    return F.when(F.regexp_like(text, F.lit("^([0-9]{2}|[1-9][0-9]{2,}):[0-9]{2}$")), F.get(parts, F.lit(0)).try_cast("double") * 60 + F.get(parts, F.lit(1)).try_cast("double")).otherwise(F.when(F.regexp_like(text, F.lit(r"^[0-9]+(\.[0-9]+)?$")), text.try_cast("double")))


def content_hash(c) -> Column:
    """Rolling hash with multiplier 31 in 32-bit integers over code points, as an absolute value."""
    wrap = lambda x: F.pmod(x + 2147483648, F.lit(4294967296)) - 2147483648
    return F.abs(F.aggregate(F.split(c, ""), F.lit(0).cast("long"), lambda h, x: wrap(h * 31 + F.when(x == "", 0).otherwise(F.ascii(x)))))


def first_of(c, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """The first name of which the text holds any keyword, as a plain substring."""
    out = F.lit(default)
    for name, keys in reversed(rules):
        hit = F.lit(False)
        for k in keys:
            hit = hit | c.contains(k)
        out = F.when(hit, name).otherwise(out)
    return out


def question_text(station, user, system) -> Column:
    """``Station k: `` and the first 200 characters of the user's message, else the system's, else a plain question."""
    cut = lambda c: F.when(F.length(c) > 200, F.concat(F.substring(c, 1, 200), F.lit("..."))).otherwise(c)
    return F.concat(F.lit("Station "), station, F.lit(": "), F.coalesce(F.when(user != "", cut(user)), F.when(system != "", cut(system)), F.lit("Assess this station")))


# Specialties by keywords in a file name, in order.
SPECIALTIES = [
    ("internal_medicine", ["internal", "medicine", "general"]),
    ("surgery", ["surgery", "surgical", "operative"]),
    ("pediatrics", ["pediatric", "child", "infant"]),
    ("psychiatry", ["psych", "mental", "behavioral"]),
    ("emergency", ["emergency", "trauma", "urgent"]),
    ("cardiology", ["cardiac", "heart", "cardio"]),
    ("dermatology", ["derm", "skin", "rash", "psoriasis"]),
    ("neurology", ["neuro", "brain", "nerve"]),
    ("orthopedics", ["ortho", "bone", "joint", "back"]),
    ("family_medicine", ["family", "primary", "general"]),
]

# Factor by complexity; (base, step, least, most) by scoring system.
COMPLEXITY = {"basic": 1.0, "intermediate": 1.5, "advanced": 2.0, "expert": 2.5, "comprehensive": 3.0}
SYSTEMS = {"binary_0_1": (1, 0.0, 1, 1), "scale_1_5": (2, 0.5, 1, 5), "scale_1_10": (3, 0.8, 1, 10), "percentage_based": (10, 5.0, 5, 100), "points_system": (5, 2.0, 2, 50)}


def adaptive_points(system, index, complexity) -> Column:
    """Points of the index-th criterion, clamped by the scoring system, times the complexity; rounded down."""
    score = lambda x: F.least(F.greatest(F.floor(F.lit(float(x[0])) + index * x[1]), F.lit(x[2])), F.lit(x[3]))
    base = score(SYSTEMS["points_system"])
    for name, x in SYSTEMS.items():
        base = F.when(system == name, score(x)).otherwise(base)
    factor = F.lit(1.0)
    for name, f in COMPLEXITY.items():
        factor = F.when(complexity == name, f).otherwise(factor)
    return F.floor(base * factor)
