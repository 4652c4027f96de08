"""Benchmark decontamination by pigeonhole edit matching.

A test item may differ from its copy in a text by k edits, k being a share of its length. Cut into
k + 1 pieces, at least one piece is then in the copy unchanged. All pieces of a block of items make
one Aho-Corasick automaton; around each hit the Myers bit-parallel distance decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.common import map_batches, texts_of

#: Edits allowed for each character of an item.
ERROR_RATE = 0.06
#: Characters of items whose pieces make one automaton, and automata that a worker holds at once. More items make
#: more passes over the normalized texts, one after the other within the same stage.
BLOCK_CHARS, HELD_BLOCKS = 500_000, 8

_GAPS = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    """Lower case, with one blank for each run of characters other than letters and digits."""
    return _GAPS.sub(" ", text.lower()).strip() if text else ""


def pieces(n: int, budget: int) -> list[tuple[int, int]]:
    """(start, end) of budget + 1 pieces of nearly equal length that make up n characters."""
    k = min(budget + 1, n)
    cuts = [n * i // k for i in range(k + 1)]
    return list(zip(cuts, cuts[1:]))


def within(letters: dict[str, int], m: int, text: str, budget: int) -> int | None:
    """The smallest edit distance, if at most ``budget``, of a pattern of m characters to any part
    of ``text``. ``letters`` has a bit for each place of a character in the pattern."""
    full = (1 << m) - 1
    high = 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for c in text:
        eq = letters.get(c, 0)
        vertical = eq | down
        horizontal = ((((eq & up) + up) ^ up) | eq) & full
        rise = (down | ~(horizontal | up)) & full
        fall = up & horizontal
        if rise & high:
            score += 1
        elif fall & high:
            score -= 1
            if score < best:
                best = score
        rise, fall = rise << 1 & full, fall << 1 & full
        up = (fall | ~(vertical | rise)) & full
        down = rise & vertical
    return best if best <= budget else None


class Finder:
    """Finds which items of a block are in a text. An item too short for an edit must stand between blanks or the text's ends."""

    def __init__(self, items: list[tuple], rate: float):
        import ahocorasick

        self.items = []
        found: dict[str, list[tuple[int, int]]] = {}
        for name, text in items:
            if not text:
                continue
            m, budget = len(text), int(len(text) * rate)
            letters: dict[str, int] = {}
            for i, c in enumerate(text):
                letters[c] = letters.get(c, 0) | 1 << i
            for a, b in pieces(m, budget):
                found.setdefault(text[a:b], []).append((len(self.items), b))
            self.items.append((name, m, budget, letters))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, places)
        if found:
            self.automaton.make_automaton()

    def __call__(self, text: str) -> list[tuple]:
        """(item, distance) of the items found."""
        if not self.items or not text:
            return []
        windows: dict[int, list[list[int]]] = {}
        for end, places in self.automaton.iter(text):
            for k, b in places:
                _, m, budget, _ = self.items[k]
                low, high = max(0, end + 1 - b - budget), end + 1 - b + m + budget
                if not budget and (text[low - 1 : low].strip() or text[high : high + 1].strip()):
                    continue
                own = windows.setdefault(k, [])
                if own and low <= own[-1][1] and low >= own[-1][0]:
                    own[-1][1] = max(own[-1][1], high)
                else:
                    own.append([low, high])
        out = []
        for k, own in windows.items():
            name, m, budget, letters = self.items[k]
            best, reach = None, -1
            for low, high in sorted(own):
                if high <= reach:
                    continue
                reach = high
                d = within(letters, m, text[low:high], budget)
                if d is not None and (best is None or d < best):
                    best = d
                    if not d:
                        break
            if best is not None:
                out.append((name, best))
        return out


def passes_of(items: DataFrame, block_chars: int, item_col: str, item_text_col: str) -> Iterator[list[list[tuple]]]:
    """The items that have an id and letters, normalized, in passes of some blocks of a bounded number of characters; one pass at least."""
    held: list[list[tuple]] = []
    block, size = [], 0
    for name, text in items.select(item_col, item_text_col).filter(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).toLocalIterator():
        text = normal(text)
        if not text:
            continue
        if size and size + len(text) > block_chars:
            held.append(block)
            block, size = [], 0
            if len(held) == HELD_BLOCKS:
                yield held
                held = []
        block.append((name, text))
        size += len(text)
    yield [*held, block]


def _found(texts: DataFrame, items: DataFrame, rate: float, block_chars: int, item_col: str, item_text_col: str) -> DataFrame:
    """``texts`` with the columns _items and _distances; the last column of ``texts`` is the text. Each pass adds what
    its blocks find. Only the first normalizes the texts; between passes they are carried normalized."""
    spark = texts.sparkSession
    kind = items.schema[item_col].dataType.simpleString()
    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[:-1])
    base += ", " if base else ""
    n = len(texts.columns) - 1

    def search(blocks, first: bool, last: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finders = [Finder(b, rate) for b in blocks.value]
            for batch in batches:
                texts = [normal(x.as_py()) if first else x.as_py() for x in batch.column(n)]
                known = [[] for _ in texts] if first else [list(zip(i, d)) for i, d in zip(batch.column(n + 1).to_pylist(), batch.column(n + 2).to_pylist())]
                hits = [sorted({*own, *(h for f in finders for h in f(t))}) for own, t in zip(known, texts)]
                ids = pa.array([[i for i, _ in h] for h in hits], pa.list_(item_type.value))
                cols = [*batch.columns[:n], pa.array([None] * len(texts) if last else texts, pa.string()), ids, pa.array([[d for _, d in h] for h in hits], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:n], "_text", "_items", "_distances"])

        return run

    from pyspark.sql.pandas.types import to_arrow_type

    item_type = spark.sparkContext.broadcast(to_arrow_type(items.schema[item_col].dataType))
    passes = list(passes_of(items, block_chars, item_col, item_text_col))
    out = texts
    for k, blocks in enumerate(passes):
        # items are a stated query set; one pass holds HELD_BLOCKS * BLOCK_CHARS characters of them at most
        step = search(spark.sparkContext.broadcast(blocks), k == 0, k == len(passes) - 1)
        out = map_batches(out, step, f"{base}_text string, _items array<{kind}>, _distances array<int>")
    return out.drop("_text")


def clean_documents(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no item is; see :func:`find_items`."""
    own = docs.toDF(*[f"_{k}" for k in range(len(docs.columns))])
    at = docs.columns.index(text_col)
    found = _found(own.withColumn("_search", F.col(f"_{at}")), items, rate, block_chars, item_col, item_text_col)
    return found.filter(F.size("_items") == 0).select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(docs.columns)])


def find_items(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_ids, distances, n_items, contaminated) for every row of ``docs``.

    An item is in a document if some part of the document, both lower-cased and with runs of other
    characters than letters and digits as one blank, is within floor(rate * length) edits of it; an item
    too short for one edit must stand there as whole words. ``item_ids`` are in ascending order, of any type, ``distances`` belong to
    them; items that share an id are one, with a distance for each that differs. Null or empty texts hold nothing; null or empty items, and items without an id, are in
    nothing; null ids and repeated rows stay as they are. Other columns are not read. No items or
    an empty table give rows without items or none.

    Items are a stated query set, gone through in blocks of a bounded number of characters; each block is sent to the
    executors and read against all texts, without a shuffle. Texts are normalized once, whatever the number of blocks.
    """
    found = _found(texts_of(docs, id_col, text_col), items, rate, block_chars, item_col, item_text_col)
    return found.select("doc_id", F.col("_items").alias("item_ids"), F.col("_distances").alias("distances"), F.size("_items").alias("n_items"), (F.size("_items") > 0).alias("contaminated"))
