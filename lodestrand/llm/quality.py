"""Document quality by a sparse rule ensemble over text statistics."""

from __future__ import annotations

import re
import string
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.llm import rules
from lodestrand.llm.common import map_batches, texts_of

#: Labelled rows that a model is fitted on, about; more are thinned out by a hash of their ids.
MAX_ROWS = 10_000

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset("the of and to in a is that it was for on are with as be at by this from or have an they der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an le la les et un une des du en que qui dans pour est sur pas par au avec de el los y las por con para una su se del lo".split())

STATISTICS = [
    "s_words", "s_chars", "s_word_length", "s_longest_word", "s_letters", "s_capitals", "s_digits", "s_symbols", "s_blanks", "s_foreign",
    "s_distinct", "s_top_word", "s_again", "s_pairs_again", "s_lines", "s_line_length", "s_lines_again", "s_symbol_ends", "s_symbol_words",
    "s_capital_words", "s_digit_words", "s_stop_words", "s_stops", "s_packed", "s_short_words", "s_word_spread",
]

_LETTERS, _CAPITALS, _DIGITS = string.ascii_letters.encode(), string.ascii_uppercase.encode(), string.digits.encode()
_SYMBOLS, _BLANKS, _FOREIGN = string.punctuation.encode(), string.whitespace.encode(), bytes(range(128, 256))
_ENDS = re.compile(r"[^\w\s]{2,}(?!\S)")
_STOPS = re.compile(r"[.!?]")


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text, in the order of STATISTICS; of an empty one all are 0."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    raw = text.encode("utf-8", "surrogatepass")
    size = len(raw)
    share = lambda kind: (size - len(raw.translate(None, kind))) / size
    lengths = np.fromiter(map(len, words), np.int32, n)
    counts = Counter(words)
    lines = text.split("\n")
    full = [x for x in lines if x.strip()]
    again = sum(a == b for a, b in zip(words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    return [
        float(np.log1p(n)), float(np.log1p(len(text))), float(lengths.mean()), float(np.log1p(lengths.max())), share(_LETTERS), share(_CAPITALS), share(_DIGITS), share(_SYMBOLS), share(_BLANKS), share(_FOREIGN),
        len(counts) / n, max(counts.values()) / n, again / max(1, n - 1), 1 - pairs / max(1, n - 1) if n > 1 else 0.0, float(np.log1p(len(lines))), float(np.log1p(len(text) / len(lines))), 1 - len(set(full)) / max(1, len(full)), len(_ENDS.findall(text)) / n, sum(len(w) == 1 and not w.isalnum() for w in words) / n,
        sum(map(str.isupper, words)) / n, sum(not w.isalpha() and any(c in "0123456789" for c in w) for w in words) / n, sum(w.lower() in STOP_WORDS for w in words) / n, len(_STOPS.findall(text)) / n, len(zlib.compress(raw, 1)) / size, float((lengths <= 2).mean()), float(lengths.std()),
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, the statistics, the columns of ``carry``) of every row, one pass."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(1)], np.float64).reshape(batch.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x[:, k]) for k in range(x.shape[1])], *batch.columns[2:]], names=["doc_id", *STATISTICS, *carry])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(c) for c in carry])
    kinds = [f.dataType.simpleString() for f in rows.schema]
    return map_batches(rows, run, f"doc_id {kinds[0]}, " + ", ".join(f"{c} double" for c in STATISTICS) + "".join(f", `{c}` {k}" for c, k in zip(carry, kinds[2:])))


def fold(doc_id: Column, parts: int) -> Column:
    """The remainder by which rows are held out: CRC-32 of the id as text."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def labelled(docs: DataFrame, labels: DataFrame, label: str, keep: Column, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label) of about ``max_rows`` labelled rows at most, chosen by a hash of the id.
    Ids with null or with different labels are left out. What is broadcast has no more rows than that."""
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label")).filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).filter(keep)
    marks = marks.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").drop("other")
    n = marks.count()
    marks = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, max_rows / max(1, n))))
    return texts_of(docs, id_col, text_col).join(F.broadcast(marks), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "quality", max_rows: int = MAX_ROWS) -> rules.Ensemble:
    """A model from the labelled rows that ``keep`` (over doc_id) selects. Only their statistics reach the driver."""
    rows = labelled(docs, labels, label, keep, max_rows)
    marks = with_statistics(rows).toPandas().sort_values("doc_id", kind="stable")
    known = dict(rows.select("doc_id", "label").distinct().toPandas().itertuples(index=False, name=None))
    y = np.array([known[i] for i in marks["doc_id"]], np.float64)
    return rules.fit(STATISTICS, marks[STATISTICS].to_numpy(), y)


def quality_scores(docs: DataFrame, model: rules.Ensemble, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score, predicted) for every row, and the columns of ``carry``: the probability of good quality, and whether it
    reaches the threshold. Null and empty texts have statistics of 0 and a score like any other. Null ids
    and repeated rows stay; other columns are not read; an empty table gives an empty one."""
    score = model.column()
    return with_statistics(docs, id_col, text_col, carry).select("doc_id", *carry, score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
