"""Toxicity by compression distance.

Two zstandard dictionaries share what zstandard's trainer takes from ordinary texts. The toxic one then ends in
the word beginnings that toxic texts have far more often than ordinary ones, the ordinary one in as many bytes
trained on further ordinary texts. A window is a word between blanks; the bytes that it takes less with
the toxic dictionary than with the ordinary one are its distance. Windows are written as the beginnings of
a word, each longer by a character, from four characters on, as three hashed bytes each: a match of
a few single bytes would save zstandard nothing, and what a word only has inside is none. A calibrated logistic model turns the windows of a text into a score.

The end of the toxic dictionary is chosen by a likelihood ratio and not by zstandard's trainer, which looks for what is
frequent and not for what tells two kinds of text apart; the README has the figures of both.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame

from lodestrand.llm.common import map_batches, texts_of
from lodestrand.llm.quality import labelled

#: Labelled rows that a model is fitted on, about.
MAX_ROWS = 6000
#: Characters of the shortest beginning, bytes of its code, and how many windows a worker remembers.
GROUP, CODE, WINDOW_CACHE = 4, 3, 400_000
#: Bytes trained on ordinary texts that both dictionaries have, and the most bytes of word beginnings: zstandard's usual dictionary in all.
SHARED_BYTES, CHOSEN_BYTES = 12_000, 64_000
#: The likelihood ratio statistic that a word beginning needs.
EVIDENCE = 24.0
#: Characters of the longest beginning that counts in training, with the blank; longer words count by it.
LONGEST = 64
#: Distances from which a window counts as toxic, and as strongly so.
STEPS = (3, 6)
#: Bytes that begin every window and end every dictionary, so that each window has one match at least.
FRAME = bytes(random.Random(5).sample(range(128, 256), 24))


def windows(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def code(text: str) -> bytes:
    return b"".join([xxhash.xxh32_digest(text[:k])[:CODE] for k in range(min(GROUP, len(text)), len(text) + 1)])


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]
    centre: tuple[float, ...]
    scale: tuple[float, ...]


class Distance:
    """Distances of windows, with a bounded memory of those met before."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        import zstandard as z

        def compressor(content: bytes):
            content += FRAME
            how = z.ZstdCompressionParameters.from_level(6, source_size=64, dict_size=len(content), format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False, write_checksum=False)
            known = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=how)
            return z.ZstdCompressor(dict_data=known, compression_params=how).compress

        self.toxic, self.ordinary = compressor(toxic), compressor(ordinary)
        self.known: dict[str, int] = {}

    def __call__(self, window: str) -> int:
        d = self.known.get(window)
        if d is None:
            if len(self.known) >= WINDOW_CACHE:
                self.known.clear()
            raw = FRAME + code(f" {window} ")
            d = self.known[window] = len(self.ordinary(raw)) - len(self.toxic(raw))
        return d

    def features(self, text: str | None) -> list[float]:
        d = np.fromiter(map(self, windows(text)), np.int32)
        if not len(d):
            return [0.0] * 6
        some, many = ((d >= s).sum() for s in STEPS)
        return [math.log1p(1000 * some / len(d)), math.log1p(1000 * many / len(d)), math.log1p(some), math.log1p(many), math.log1p(max(0, int(d.max()))), math.log1p(len(d))]


def _fragments(text: str) -> set[str]:
    """Beginnings of a text's words of three letters or more, with the blank before, and whole words between blanks."""
    out = set()
    for w in set(windows(text)):
        b = f" {w}"
        out.add(f"{b} ")
        out.update(b[:k] for k in range(4, min(len(b), LONGEST)))
    return out


def _kin(text: str) -> int:
    """Equal for most near copies of a text: the smallest hash of its pairs of words."""
    w = windows(text)
    return min((xxhash.xxh32_intdigest(f"{a} {b}") for a, b in zip(w, w[1:])), default=0)


def fragments(texts: list[str], toxic: list[bool]) -> list[str]:
    """Fragments by falling evidence that toxic texts have them more often; near copies of a toxic text count once."""
    groups: dict[int, set[str]] = {}
    for t, bad in zip(texts, toxic):
        if bad:
            groups.setdefault(_kin(t), set()).update(_fragments(t))
    n = len(groups)
    have = Counter()
    for g in groups.values():
        have.update(g)
    have = {f: k for f, k in have.items() if k >= 3}
    groups.clear()
    others, m = Counter(), 0
    for t, bad in zip(texts, toxic):
        if not bad:
            m += 1
            others.update(f for f in _fragments(t) if f in have)

    def evidence(f: str) -> float:
        a, b = have[f], others[f]
        p = (a + b) / (n + m)
        if a * m <= b * n:
            return 0.0
        total = 0.0
        for k, size in ((a, n), (b, m)):
            for c, q in ((k, p), (size - k, 1 - p)):
                if c:
                    total += c * math.log(c / size / q)
        return 2 * total

    marks = {f: mark for f in have if (mark := evidence(f)) >= EVIDENCE}
    chosen: set[str] = set()
    reach: set[str] = set()  # beginnings of those chosen
    size = 0
    for f in sorted(marks, key=lambda f: (-round(marks[f], 6), -len(f), f)):
        own = {f[:k] for k in range(4, len(f))}
        if own & chosen or f in reach and all(marks[f] <= 1.05 * marks[g] for g in chosen if g.startswith(f)):
            continue
        size += len(code(f))
        if size > CHOSEN_BYTES:
            break
        chosen.add(f)
        reach |= own
    return sorted(chosen, key=lambda f: (-round(marks[f], 6), -len(f), f))


def _trained(texts: list[str], size: int) -> bytes:
    """What zstandard's trainer takes from texts, or, where there is too little for it, their last bytes."""
    import zstandard as z

    coded = [c for t in texts if (c := b"".join(code(f" {w} ") for w in sorted(set(windows(t)))))]
    if sum(map(len, coded)) < 16 * size or len(coded) < 16:
        return b"".join(coded)[-size:] if size else b""
    return z.train_dictionary(size, coded, k=48, d=6).as_bytes()


def dictionaries(texts: list[str], toxic: list[bool]) -> tuple[bytes, bytes]:
    """(toxic, ordinary) dictionary contents; the most telling parts last, where zstandard finds them at the least cost."""
    ordinary = [t for t, bad in zip(texts, toxic) if not bad]
    base, fill = _trained(ordinary[::2], SHARED_BYTES), b""
    tail = b"".join(code(f) for f in reversed(fragments(texts, toxic)))
    if tail:
        fill = _trained(ordinary[1::2], max(256, len(tail)))[-len(tail) :]
    return base + tail, fill + base


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    keep = np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w += np.linalg.solve(a.T * (p * (1 - p) + 1e-9) @ a + keep, a.T @ (y - p) - keep @ w)
    return w


def fit(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    """Dictionaries from two thirds of the labelled rows, the calibration from the rest. The rows,
    bounded by ``max_rows``, are read on the driver; without both labels the score is a constant."""
    rows = sorted(map(tuple, labelled(docs, labels, label, keep, max_rows).select("doc_id", "text", "label").collect()), key=lambda r: (r[0], r[1] or ""))
    part = [xxhash.xxh32_intdigest(str(r[0])) % 3 for r in rows]
    seen, rest = ([r for r, k in zip(rows, part) if (k == 0) is held] for held in (False, True))
    toxic, ordinary = dictionaries([r[1] or "" for r in seen], [r[2] == 1 for r in seen])
    y = np.array([r[2] for r in rest], float)
    if len(y) < 10 or y.min() == y.max():
        p = (sum(r[2] for r in rows) + 1) / (len(rows) + 2)
        return Model(toxic, ordinary, (math.log(p / (1 - p)), *[0.0] * 6), (0.0,) * 6, (1.0,) * 6)
    far = Distance(toxic, ordinary)
    x = np.array([far.features(r[1]) for r in rest])
    centre, scale = x.mean(0), x.std(0) + 1e-9
    w = _logistic((x - centre) / scale, y)
    return Model(toxic, ordinary, tuple(map(float, w)), tuple(map(float, centre)), tuple(map(float, scale)))


def toxicity_scores(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, n_toxic_windows) for every row, from all windows of the whole text.
    Null and empty texts have no windows; their score is what the model gives for none. Null ids and
    repeated rows stay; other columns are not read; an empty table gives an empty one. One pass, no shuffle."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far = Distance(model.toxic, model.ordinary)
        centre, scale, w = (np.array(v) for v in (model.centre, model.scale, model.weights))
        for batch in batches:
            x = np.array([far.features(t.as_py()) for t in batch.column(1)]).reshape(batch.num_rows, 6)
            s = 1 / (1 + np.exp(-np.clip(w[0] + (x - centre) / scale @ w[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(np.rint(np.expm1(x[:, 2])).astype(np.int64))], names=["doc_id", "score", "predicted", "n_toxic_windows"])

    texts = texts_of(docs, id_col, text_col)
    return map_batches(texts, run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, score double, predicted int, n_toxic_windows long")
