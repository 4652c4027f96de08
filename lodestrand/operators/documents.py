"""Documents as column expressions: clean-up, outline, hints, scores, profile and the composed package.

A null text counts as empty. Everything reads the whole text unless a definition names a part of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marker words of headings, of hints, of profiles and of complex objects; the part of a text that hints and profiles read.
MARKERS = ("abstract", "introduction", "conclusion", "appendix", "page ")
HINTS = (
    ("paper-reproduction-agent", ("abstract", "methodology", "references", "appendix", "p-value", "paper")),
    ("strategy-signal-agent", ("market outlook", "coverage", "portfolio", "strategy", "signal", "factor")),
)
GENERAL_HINT = "general-analysis-agent"
PROFILES = (("paper", ("abstract", "methodology", "references", "p-value", "paper")), ("report", ("outlook", "coverage", "portfolio", "investment", "allocation")))
COMPLEX = ("table", "figure", "equation", "appendix", "chart", "图", "表", "公式")
HINT_CHARS, PROFILE_CHARS, BODY_CHARS, MOST_HEADINGS = 6000, 8000, 16_000, 18


def normalized(text: Column) -> Column:
    """Line ends as line feeds, no more than one empty line in a row, no blanks at either end."""
    lines = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(lines, r"^[ \t\n]+|[ \t\n]+$", "")


def _has(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def headings(text: Column) -> Column:
    """All headings: lines that begin with #, and short lines with a marker word."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    head = F.filter(lines, lambda x: x.startswith("#") | ((F.length(x) < 90) & _has(F.lower(x), MARKERS)))
    return F.transform(head, lambda x: F.trim(F.regexp_replace(x, r"^[# ]+", "")))


def outline(text: Column) -> Column:
    """The first MOST_HEADINGS headings; one name for all if there are none."""
    found = F.slice(headings(text), 1, MOST_HEADINGS)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Overview")))


def route_hints(name: Column, text: Column) -> Column:
    """Who should read on: every hint with one of its words in the name or the text's beginning, the general one if none has."""
    source = F.lower(F.concat(name, F.lit("\n"), F.substring(text, 1, HINT_CHARS)))
    found = F.filter(F.array(*[F.when(_has(source, words), F.lit(hint)) for hint, words in HINTS]), lambda h: h.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(GENERAL_HINT)))


def completion(text: Column, kind: Column, engine: Column, warnings: Column) -> Column:
    """A struct (score, label): by kind of file and engine, more for length, four less a warning (20 at most), from 10 to 98."""
    base = F.when(kind == ".pdf", F.when(engine == "mineru", 78).when(engine == "docling", 72).otherwise(68)).when(kind == ".docx", 84).when(kind.isin(".md", ".txt"), 90).otherwise(45)
    n = F.length(text)
    longer = F.when(n >= 50_000, 12).when(n >= 25_000, 8).when(n >= 8_000, 4).otherwise(0)
    score = F.greatest(F.lit(10), F.least(F.lit(98), base + longer - F.least(warnings * 4, F.lit(20)))).cast("int")
    return F.struct(score.alias("score"), F.when(score >= 85, "strong").when(score >= 70, "usable").when(score >= 50, "partial").otherwise("limited").alias("label"))


def _count(text: Column, word: str) -> Column:
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word))


def profile(name: Column, text: Column, kind: Column) -> Column:
    """"paper", "report" or "general"; only of PDF files anything but general."""
    source = F.lower(F.concat(name, F.lit("\n"), F.substring(text, 1, PROFILE_CHARS)))
    out = F.when(kind != ".pdf", "general")
    for label, words in PROFILES:
        out = out.when(_has(source, words), label)
    return out.otherwise("general")


def evaluated(docs: DataFrame) -> DataFrame:
    """``docs`` (name, text, kind, engine, warnings) with the normalized text, its outline, hints and completion, five scores from 1 to 5,
    their total, the verdict and the profile. Each text is normalized once."""
    df = docs.withColumn("normal", normalized(F.col("text")))
    df = df.withColumns({"outline": outline(F.col("normal")), "hints": route_hints(F.col("name"), F.col("normal")), "completion": completion(F.col("normal"), F.col("kind"), F.col("engine"), F.col("warnings"))})
    n, sections = F.length("normal"), F.size("outline")
    marks = _count(F.col("normal"), "\n#") + F.col("normal").startswith("#").cast("int")
    objects = sum((_count(F.lower("normal"), w) for w in COMPLEX), F.lit(0))
    score = F.col("completion.score")
    df = df.withColumns(
        {
            "completeness": F.when(n >= 50_000, 5).when(n >= 25_000, 4).when(n >= 8_000, 3).when(n >= 1_500, 2).otherwise(1),
            "structure": F.when((sections >= 12) & (marks >= 10), 5).when(sections >= 8, 4).when(sections >= 4, 3).otherwise(2),
            "objects": F.when((objects >= 8) & (F.col("engine") == "pypdf2"), 1).when(F.col("engine") == "mineru", 5).when(F.col("engine") == "docling", 4).otherwise(2),
            "downstream": F.when(score >= 85, 5).when(score >= 70, 4).when(score >= 55, 3).otherwise(2),
            "revision": F.greatest(F.lit(1), 5 - F.least(F.lit(4), F.col("warnings"))).cast("int"),
        }
    )
    df = df.withColumn("total", F.col("completeness") + F.col("structure") + F.col("objects") + F.col("downstream") + F.col("revision"))
    verdict = F.when(F.col("total") >= 21, "high_quality").when(F.col("total") >= 16, "usable_with_light_review").when(F.col("total") >= 11, "draft_only").otherwise("not_recommended")
    return df.withColumns({"verdict": verdict, "profile": profile(F.col("name"), F.col("normal"), F.col("kind"))})


def composed() -> Column:
    """The package of a row of :func:`evaluated` as Markdown: what it is, its outline, and the beginning of its text."""
    bullet = lambda x: F.concat(F.lit("- "), x)
    lines = F.concat(
        F.array(F.lit("# AI-Ready Document Package"), F.lit(""), F.lit("## Overview"), bullet(F.concat(F.lit("Original file: "), F.col("name"))), bullet(F.concat(F.lit("File type: "), F.col("kind"))), bullet(F.concat(F.lit("Extractor: "), F.col("engine")))),
        F.array(bullet(F.concat(F.lit("Completion score: "), F.col("completion.score").cast("string"), F.lit("%"))), bullet(F.concat(F.lit("Completion label: "), F.col("completion.label"))), bullet(F.concat(F.lit("Recommended next agents: "), F.array_join("hints", ", "))), F.lit(""), F.lit("## Extraction Warnings")),
        F.array(bullet(F.when(F.col("warnings") > 0, F.concat(F.col("warnings").cast("string"), F.lit(" warnings"))).otherwise("No major warnings detected.")), F.lit(""), F.lit("## Outline")),
        F.transform("outline", bullet), F.array(F.lit(""), F.lit("## Normalized Text"), F.lit(""), F.substring("normal", 1, BODY_CHARS)),
    )
    return F.array_join(lines, "\n")
