"""Document fingerprints: a Merkle tree over sections, paragraphs and groups of words.

Only DataFrame functions. A text is cut into sections (at blank lines), sections into paragraphs
(lines) and those into leaves of up to LEAF_WORDS words, in lines of less than SHORT_LINE
characters of one word, with the white space after them, so the leaves joined are the text. A leaf's hash is of its characters, an inner node's hash of its children's, the
root a SHA-256 over the sections' hashes. The fingerprint as a string is

    root|leaf,leaf;leaf,leaf/leaf...

with ``/`` between sections, ``;`` between paragraphs and eight hexadecimal digits a leaf. Equal roots mean equal
trees; where roots differ, the branches that differ show where the texts do.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrand.llm.common import texts_of

LEAF_WORDS, SHORT_LINE = 4, 100
#: Runs of neighbouring rows for each shuffle partition, and sampled rows for each run.
RUNS_EACH, SAMPLED_EACH = 4, 40
#: Values of the hash by which rows with one id are ordered before their texts are.
_MARKS = 1 << 20

_LEAF, _WORD = rf"\s*(?:\S+\s*){{1,{LEAF_WORDS}}}|\s+", r"\s*\S+\s*|\s+"


def tree(text: Column) -> Column:
    """Sections of paragraphs of leaf hashes, as nested arrays of 64-bit integers."""
    def leaves(p: Column) -> Column:
        cut = F.when(F.length(p) < SHORT_LINE, F.regexp_extract_all(p, F.lit(_WORD), F.lit(0))).otherwise(F.regexp_extract_all(p, F.lit(_LEAF), F.lit(0)))
        return F.transform(cut, lambda c: F.xxhash64(c))

    return F.transform(F.split(text, r"(?<=\n)(?=[^\S\n]*\n)"), lambda s: F.transform(F.split(s, r"(?<=\n)"), leaves))


def render(tree: Column) -> Column:
    """The fingerprint string of a tree."""
    sections = F.transform(tree, lambda s: F.hex(F.xxhash64(F.transform(s, lambda p: F.xxhash64(p)))))
    root = F.sha2(F.array_join(sections, ","), 256)

    def digits(h: Column) -> Column:
        return F.lower(F.lpad(F.hex(h.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))

    body = F.array_join(F.transform(tree, lambda s: F.array_join(F.transform(s, lambda p: F.array_join(F.transform(p, digits), ",")), ";")), "/")
    return F.concat(root, F.lit("|"), body)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; a null text has that of the empty one."""
    return render(tree(F.coalesce(text, F.lit(""))))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 where the roots are equal, else twice the leaves that both have over the leaves of
    each, every leaf once. Two fingerprints without leaves are those of empty texts, so equal."""
    def leaves(f: Column) -> Column:
        return F.array_distinct(F.split(F.translate(F.substring_index(f, "|", -1), ";/", ",,"), ","))

    both = 2.0 * F.size(F.array_intersect(leaves(a), leaves(b)))
    return F.when(F.substring_index(a, "|", 1) == F.substring_index(b, "|", 1), F.lit(1.0)).otherwise(both / (F.size(leaves(a)) + F.size(leaves(b))))


def changed_sections(a: Column, b: Column) -> Column:
    """Positions, from 0, of the sections in which two fingerprints differ: what a comparison of
    trees descends into. Sections that only one of them has count as different."""
    x, y = (F.split(F.substring_index(f, "|", -1), "/") for f in (a, b))
    places = F.sequence(F.lit(0), F.greatest(F.size(x), F.size(y)) - 1)
    return F.filter(places, lambda k: ~F.get(x, k).eqNullSafe(F.get(y, k)))


def _cuts(keys: DataFrame, runs: int) -> list[tuple[int | None, int]]:
    """Ascending (doc_id, mark) that cut all rows into about ``runs`` runs of nearly equal size, from a
    sample of a bounded number of rows. Ids may be bunched, null or repeated: the marks cut them as well."""
    n = keys.count()
    if not n:
        return []
    wanted = runs * SAMPLED_EACH
    rows = keys.sample(fraction=min(1.0, 1.2 * wanted / n), seed=11).limit(2 * wanted).collect()
    every = sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    return list(dict.fromkeys(every[k * len(every) // runs] for k in range(1, runs) if every))


def _run_of(cuts: list[tuple[int | None, int]]) -> Column:
    """How many cuts lie at or before a row: first among some cuts far apart, then among those between two of them."""
    if not cuts:
        return F.lit(0)
    texts = [("null" if i is None else str(i), m) for i, m in cuts]
    step = math.isqrt(len(cuts)) + 1
    parts = [texts[k : k + step] for k in range(0, len(texts), step)]

    def rows(of: list[tuple[str, int]]) -> str:
        return "[" + ",".join(f'{{"i":{i},"m":{m}}}' for i, m in of) + "]"

    # constants, folded once when the plan is optimized
    heads = F.from_json(F.lit(rows([p[0] for p in parts])), "array<struct<i:bigint,m:int>>")
    inner = F.from_json(F.lit("[" + ",".join(map(rows, parts)) + "]"), "array<array<struct<i:bigint,m:int>>>")

    def before(c: Column) -> Column:
        low = F.when(c["i"].isNull(), F.col("doc_id").isNotNull()).otherwise(F.coalesce(c["i"] < F.col("doc_id"), F.lit(False)))
        return low | (c["i"].eqNullSafe(F.col("doc_id")) & (c["m"] <= F.col("mark")))

    at = F.size(F.filter(heads, before))
    return F.when(at == 0, F.lit(0)).otherwise((at - 1) * step + F.size(F.filter(F.get(inner, at - 1), before)))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_sections).

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the
    next document, or all that it has; next is by ascending id, after the last comes the first.
    Null texts count as empty. Rows with a null id come first; rows with equal ids lie in the order of a hash of their texts,
    then of the texts. One row alone is next to itself. ``edited_sections`` are the places, from 0, of the sections where the
    tree of the edited text differs. Other columns are not read; an empty table gives an empty one.

    One shuffle deals the rows to runs of neighbours by range, a few for each shuffle partition, of nearly equal
    size however the ids lie; each run also gets a copy of the first row of the run after it, so no order over all rows is
    ever made in one task. What the driver gets is a sample of a bounded number of ids for each run, and each run's first row's id.
    """
    spark = docs.sparkSession
    texts = texts_of(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("mark", F.pmod(F.xxhash64("text"), F.lit(_MARKS)).cast("int"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    run = _run_of(_cuts(texts.select("doc_id", "mark"), RUNS_EACH * parts))
    keyed = texts.withColumn("run", run)
    found = keyed.groupBy("run").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "mark")).alias("first")).collect()
    firsts = sorted((r[0], r[1]["doc_id"], r[1]["mark"]) for r in found) if found else []
    own = keyed.withColumn("copy", F.lit(0))
    if firsts:
        rows = [(i, m, firsts[k - 1][0]) for k, (_, i, m) in enumerate(firsts)]
        starts = spark.createDataFrame(rows, "first long, first_mark int, before int")
        first = F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("mark") == F.col("first_mark"))
        own = own.union(texts.join(F.broadcast(starts), first).select("doc_id", "text", "mark", F.col("before").alias("run"), F.lit(1).alias("copy")))
    # dealt by range, which is also a clustering by run, so the window below needs no other exchange
    dealt = own.repartitionByRange(parts, "run").withColumn("tree", tree(F.col("text"))).withColumn("fingerprint", render(F.col("tree"))).drop("tree")
    order = Window.partitionBy("run").orderBy("copy", F.asc_nulls_first("doc_id"), "mark", "text")
    pairs = dealt.withColumn("next_text", F.lead("text").over(order)).withColumn("next_print", F.lead("fingerprint").over(order)).filter("copy = 0")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    following = F.coalesce("next_text", "text")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(following, F.lit(1), half))
    out = pairs.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", F.coalesce("next_print", "fingerprint").alias("next_print"))
    out = out.withColumn("tree", tree(F.col("edited"))).withColumn("edited_fingerprint", render(F.col("tree"))).drop("tree")
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next"),
        changed_sections(F.col("fingerprint"), F.col("edited_fingerprint")).alias("edited_sections"),
    )
