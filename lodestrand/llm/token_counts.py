"""Token counts by the whole-token shortcut."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestrand.llm import tokens
from lodestrand.llm.common import map_batches, texts_of


class Counter:
    """Counts of a byte-level vocabulary. Pre-tokens of the proven table count one; only the rest is merged."""

    def __init__(self, path: str, pattern: str, whole: frozenset[str]):
        import json

        import regex

        self.cut = regex.compile(pattern).findall
        self.whole = whole
        self.tokenizer = tokens.load(path)
        self.merge = self.tokenizer.model.tokenize
        self.letters = {b: c for b, c in tokens.byte_alphabet().items()}
        self.special = [x["content"] for x in json.loads(self.tokenizer.to_str())["added_tokens"]]
        self.known: dict[str, int] = {"": 0}

    def _count(self, piece: str) -> int:
        if any(x in piece for x in self.special):
            return len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        n = 0
        for x in self.cut(piece):
            n += 1 if x in self.whole else len(self.merge("".join(map(self.letters.__getitem__, x.encode("utf-8")))))
        return n

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        known = self.known
        if len(known) > tokens.PIECE_CACHE:
            known.clear()
        n = 0
        for x in tokens.pieces(text):
            k = known.get(x)
            if k is None:
                k = known[x] = self._count(x)
            n += k
        return n


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row.

    ``path`` is a tokenizers file of a byte-level vocabulary, ``pattern`` its pre-tokenizer's. The
    table of whole tokens is proven once on the driver and sent along; its size is bounded by the
    vocabulary. Null and empty texts have no bytes and no tokens. Null ids and repeated rows are
    kept as they are; other columns are not read; an empty table gives an empty one. One pass, no
    shuffle; a worker holds one Arrow batch and a bounded memory of pieces.
    """
    spark = docs.sparkSession
    whole = spark.sparkContext.broadcast(tokens.whole_tokens(path, pattern))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(path, pattern, whole.value)
        for batch in batches:
            sizes, n = [], []
            for x in batch.column(1):
                text = x.as_py()
                sizes.append(len(text.encode("utf-8")) if text else 0)
                n.append(count(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    texts = texts_of(docs, id_col, text_col)
    return map_batches(texts, run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
