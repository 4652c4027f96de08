"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes.

The patterns give the base spans. The field reads all words of every line, with features of a word's shape and
of the words around it, and adds spans that no base span touches: numbers, addresses and contacts that just fail a pattern,
and secrets. It is trained on a small labelled table, made here by a rule, and decoded by Viterbi in numpy batches.

Nearly all words are far from personal. For each word the field gives a bound of what any labelling gains by
taking it out of O; where no stretch around a word can gain, O is proven and the chain is cut there, so only what is
left goes through Viterbi, with the same result as the whole line.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestrand.llm import crf
from lodestrand.llm.common import map_batches, texts_of

KINDS = ("email", "ip", "card", "phone")
#: What the field adds, in the order in which spans are listed after the base kinds.
ADDED = ("email_like", "ip_like", "card_like", "phone_like", "secret")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LONG_RUN = re.compile(r"[0-9][0-9 -]{14,}")
_WORD = re.compile(r"\S+")

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """What ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`` matches, leftmost and not overlapping.
    A match must have its @ at an @, so each @ is looked at once, from the first character before it that fits."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[Span]]:
    """The spans of the four kinds by the exact patterns; matches that fail a kind's test are dropped."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:] if len(p) > 4 else p) <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    if _LONG_RUN.search(text):
        for m in _CARD.finditer(text):
            d = _digits(m[0]) if m.end() - m.start() >= 16 else ""
            if 16 <= len(d) <= 19 and luhn(d):
                out["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                out["phone"].append(m.span())
    return out


class _Classes(dict):
    """Characters to those of a shape: a, A, 9, some marks as they are, all others x."""

    def __missing__(self, c: int) -> int:
        return ord("x")


_CLASSES = _Classes({ord(c): k for k, own in (("a", string.ascii_lowercase), ("A", string.ascii_uppercase), ("9", string.digits)) for c in own} | {ord(c): c for c in "@.+()-_=:/\"' ,;"})
_AGAIN = re.compile(r"(.)\1{2,}")
_EDGES = "\"'.,;:!?()[]{}<>|*$%&#"


def shape(word: str) -> str:
    """A word with letters as a or A and digits as 9, runs of more than two shortened."""
    return _AGAIN.sub(r"\1\1", word.translate(_CLASSES))


# Words before secrets, and words before telephone numbers.
_CUES = frozenset("token key secret password passwd pwd apikey bearer auth credential".split())
_CALLS = frozenset("phone tel telephone call mobile fax".split())
#: The places from which a word gives features to a position: itself, one and two before, one after.
PLACES = ("", "1:", "2:", "n:")


def _plain(word: str) -> str:
    return word.lower().strip("\"'=:,.")


def alike(word: str) -> str:
    """A key that only words with the same features share: a long word or a cue itself, else the classes of its characters."""
    return word if len(word) >= 16 or _plain(word) in _CUES or _plain(word) in _CALLS else word.translate(_CLASSES)


def word_features(word: str) -> list[list[str]]:
    """What a word tells about its own position, the next two positions and the one before; "" is beyond the line."""
    core = word.strip(_EDGES)
    n = sum("0" <= c <= "9" for c in core)
    own = ["bias", f"shape:{shape(core)}", f"digits:{min(n, 17)}", f"length:{len(core).bit_length()}", f"size:{min(len(core), 48) // 4}", f"dots:{min(core.count('.'), 4)}", f"at:{min(core.count('@'), 2)}", f"all:{core.isdigit()}"]
    own += [f"hex:{len(core) >= 20 and all(c in '0123456789abcdefABCDEF' for c in core)}", f"mixed:{len(core) >= 16 and core.isalnum() and 0 < n < len(core)}", f"cased:{len(core) >= 16 and core.isalnum() and len({c.isupper() for c in core[1:]}) > 1}"]
    own += [f"quote:{word[:1] in {chr(34), chr(39)}}", f"plus:{word[:1] == '+'}", f"paren:{word[:1] == '('}", f"dash:{'-' in core}", f"colon:{':' in core}", f"slash:{'/' in core}"]
    plain = _plain(word)
    cue, call, near = f"cue:{plain in _CUES}", f"call:{plain in _CALLS}", shape(word)
    return [own, [f"1:{cue}", f"1:{call}", f"1:equals:{word in ('=', ':')}", f"1:ends:{word[-1:] in ('=', ':')}", f"1:{near}"], [f"2:{cue}", f"2:{call}"], [f"n:{near}"]]


def line_features(words: list[str]) -> list[crf.Position]:
    """The features of all words of a line."""
    told = [word_features(w) for w in ("", "", *words, "")]
    return [told[k][0] + told[k - 1][1] + told[k - 2][2] + told[k + 1][3] for k in range(2, len(told) - 1)]


def labelled_table(n: int = 700, seed: int = 5) -> list[tuple[list[str], list[str]]]:
    """Rows (words of a line, labels B-, I- or O): examples and counter-examples."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 9)))
    close = lambda w: w + rng.choice(["", "", "", ".", ",", "!!", "***", "%%%", "$$$"])

    def prose() -> str:
        w = "".join(rng.choice(["ar", "en", "ti", "lo", "sch", "é", "ñ", "ü", "ment", "the", "ou", "lich", "ción", "a"]) for _ in range(rng.randint(1, 7)))
        return close(w.capitalize() if rng.random() < 0.15 else w.upper() if rng.random() < 0.03 else w) if rng.random() < 0.94 else rng.choice(["|", "-", "*", "=", ":", "(see", "a)", "key", "call", "token", "the"])

    rows = []
    for _ in range(n):
        before, after = [word(), word()], [word()] if rng.random() < 0.9 else []
        kind = rng.choice(["email", "email_like", "ip", "card", "card", "phone", "phone_like", "phone_like", "secret", "secret", "secret", "year", "count", "time", "price", "version", "code", "date", "unit", "prose", "prose", "cue"])
        if kind == "email":
            run, y = [close(f"{word()}.{d(2)}@{word()}{d(1)}.{word()}.com")], ["B-email_like"]
        elif kind == "email_like":
            run, y = [close(f"{word()}@{word()}{d(rng.randint(0, 1))}")], ["B-email_like"]
        elif kind == "ip":
            run, y = [close(".".join(str(rng.randint(0, 300)) for _ in range(4)))], ["B-ip_like"]
        elif kind == "card":
            run, y = ([close(d(16))], ["B-card_like"]) if rng.random() < 0.6 else ([d(4), d(4), d(4), close(d(4))], ["B-card_like", *["I-card_like"] * 3])
        elif kind == "phone":
            run, y = [f"+{d(1)}", f"({d(3)})", close(f"{d(3)}-{d(4)}")], ["B-phone_like", "I-phone_like", "I-phone_like"]
        elif kind == "phone_like":
            form = rng.random()
            if form < 0.4:
                run, y = [f"({d(3)})", close(f"{d(3)}-{d(4)}")], ["B-phone_like", "I-phone_like"]
            elif form < 0.7:
                run, y = [close(f"{d(3)}-{d(3)}-{d(4)}")], ["B-phone_like"]
            else:
                before[-1] = rng.choice(sorted(_CALLS)) + rng.choice(["", ":"])
                run, y = [f"{d(3)}", close(d(rng.randint(4, 7)))], ["B-phone_like", "I-phone_like"]
        elif kind == "secret":
            form = rng.random()
            before = [rng.choice(sorted(_CUES)), rng.choice(["=", ":", "="])] if rng.random() < 0.8 or form > 0.85 else before
            if form < 0.6:
                text = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([24, 32, 40, 40, 64])))
            else:
                text = "".join(rng.choice("0123456789abcdefghijKLMNOPQRSTUVWXYZ") for _ in range(rng.randint(20, 44)))
            text = text[:3] + d(2) + text[5:]
            if form > 0.85:  # letters alone
                text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(rng.randint(18, 44)))
            run, y = [f'"{text}"' if rng.random() < 0.7 else text], ["B-secret"]
        elif kind == "prose":
            run = [prose() for _ in range(rng.randint(3, 14))]
            y = ["O"] * len(run)
        elif kind == "cue":
            run = [prose(), rng.choice(sorted(_CUES | _CALLS)), *([rng.choice(["=", ":"])] if rng.random() < 0.4 else []), prose(), prose()]
            y = ["O"] * len(run)
        else:
            text = {"year": str(rng.randint(1800, 2030)), "count": d(rng.randint(1, 7)), "time": f"{rng.randint(0, 23)}:{d(2)}", "price": f"{d(2)}.{d(2)}", "version": f"v{d(1)}.{d(1)}.{d(1)}", "code": word()[:3].upper() + d(rng.randint(1, 4)), "date": f"20{d(2)}-{d(2)}-{d(2)}", "unit": d(2) + rng.choice(["kg", "km", "px", "th", "%"])}[kind]
            run, y = [close(text)], ["O"]
            if rng.random() < 0.3:
                run, y = [*run, close(d(rng.randint(1, 4)))], ["O", "O"]
        rows.append(([*before, *run, *after], ["O"] * len(before) + y + ["O"] * len(after)))
    return rows


STATES = ("O", *[f"{p}-{k}" for k in ADDED for p in ("B", "I")])


@lru_cache(maxsize=1)
def model() -> crf.Field:
    """The field trained on :func:`labelled_table`; made once in a process."""
    field = crf.train(STATES, [(line_features(words), y) for words, y in labelled_table()], rounds=10)
    for k, s in enumerate(STATES):  # an inside follows a beginning or an inside of its kind only
        if s[0] == "I":
            kind = s[2:]
            field.first[k] = -1e4
            for j, t in enumerate(STATES):
                if t[2:] != kind:
                    field.moves[j, k] = -1e4
    return field


#: Words of a chain; a longer line is more than one chain. Words that are looked at together, and words that a worker remembers.
CHAIN, TOGETHER, WORD_CACHE = 4096, 1 << 15, 400_000
_FAR = -1e5


class Detector:
    """Base and added spans of texts, many at a time."""

    def __init__(self, field: crf.Field):
        self.field, n = field, len(field.states)
        self.known: dict[str, int] = {}
        self.kinds: dict[str, int] = {}
        self.told = [np.zeros((64, n)) for _ in PLACES]
        stay = field.moves[0, 0]
        # what a move into a state gains over staying in O, at most, and what leaving for O may gain besides
        self.enter = np.maximum((field.moves - stay).max(0), field.first - field.first[0])
        self.leave = max(0.0, float((field.moves[1:, 0] - stay).max()))
        self.gain = [np.zeros(64) for _ in PLACES]
        self.beyond = self.number("")

    def number(self, word: str) -> int:
        key = alike(word)
        k = self.kinds.get(key)
        if k is None:
            k = self.kinds[key] = len(self.kinds)
            if k == len(self.gain[0]):
                self.told = [np.concatenate([t, np.zeros_like(t)]) for t in self.told]
                self.gain = [np.concatenate([g, np.zeros_like(g)]) for g in self.gain]
            for place, (told, gain, own) in enumerate(zip(self.told, self.gain, word_features(word))):
                told[k] = self.field.emit([own])[0]
                gain[k] = (told[k, 1:] + (self.enter[1:] if not place else 0.0)).max() - told[k, 0]
        self.known[word] = k
        return k

    def paths(self, chains: list[list[str]]) -> list[tuple[int, int, np.ndarray]]:
        """(chain, first word, states) of the stretches of chains that aren't proven to be O."""
        known, number, row = self.known, self.number, [self.beyond, self.beyond]
        for words in chains:
            row += [k if (k := known.get(w)) is not None else number(w) for w in words]
            row += [self.beyond, self.beyond]
        at = np.array(row)
        real = np.ones(len(at), bool)
        starts = np.cumsum([2, *(len(w) + 2 for w in chains)])
        for gap in (0, 1):
            real[starts - 2 + gap] = False
        own, one, two, after = (g[at] for g in self.gain)
        bound = own
        bound[1:] += one[:-1]
        bound[2:] += two[:-2]
        bound[:-1] += after[1:]
        bound[~real] = _FAR

        def best(x: np.ndarray) -> np.ndarray:
            """The most that a stretch which ends just before each place gains, or 0."""
            total = np.concatenate([[0.0], np.cumsum(x)])
            return (total - np.minimum.accumulate(total))[:-1]

        live = np.flatnonzero(real & (bound + best(bound) + best(bound[::-1])[::-1] + self.leave > -1e-6))
        if not len(live):
            return []
        cuts = np.flatnonzero(np.diff(live) > 1) + 1
        scores = self.told[0][at[live]] + self.told[1][at[live - 1]] + self.told[2][at[live - 2]] + self.told[3][at[live + 1]]
        where, parts = [], []
        for run, e in zip(np.split(live, cuts), np.split(scores, cuts)):
            a, z = int(run[0]), int(run[-1])
            if real[a - 1]:
                e[0] += self.field.moves[0] - self.field.first
            if real[z + 1]:
                e[-1] += self.field.moves[:, 0]
            chain = int(np.searchsorted(starts, a, "right")) - 1
            where.append((chain, a - int(starts[chain])))
            parts.append(e)
        return [(c, k, path) for (c, k), path in zip(where, self.field.decode(parts))]

    def __call__(self, texts: list[str]) -> list[tuple[dict[str, list[Span]], dict[str, list[Span]]]]:
        base = [base_spans(t) for t in texts]
        added: list[dict[str, list[Span]]] = [{k: [] for k in ADDED} for _ in texts]
        where: list[tuple[int, int, int]] = []  # text, start of the line, words of the line before
        chains: list[list[str]] = []
        held = 0
        for k, t in enumerate(texts):
            start = 0
            for line in t.split("\n"):
                words = line.split()
                for a in range(0, len(words), CHAIN):
                    where.append((k, start, a))
                    chains.append(words[a : a + CHAIN])
                    held += len(chains[-1])
                    if held >= TOGETHER:
                        self._add(texts, base, added, where, chains)
                        where, chains, held = [], [], 0
                start += len(line) + 1
        self._add(texts, base, added, where, chains)
        return list(zip(base, added))

    def _add(self, texts, base, added, where, chains) -> None:
        if not chains:
            return
        lines: dict[tuple[int, int], list[Span]] = {}
        for chain, first, path in self.paths(chains):
            if not path.any():
                continue
            k, start, skipped = where[chain]
            if (k, start) not in lines:
                end = texts[k].find("\n", start)
                lines = {(k, start): [m.span() for m in _WORD.finditer(texts[k], start, len(texts[k]) if end < 0 else end)]}
            spans = lines[k, start]
            taken = [s for own in base[k].values() for s in own]
            at = 0
            while at < len(path):
                state = STATES[path[at]]
                stop = at + 1
                if state[0] == "B":
                    while stop < len(path) and STATES[path[stop]] == f"I-{state[2:]}":
                        stop += 1
                    a, b = self._trim(texts[k], spans[skipped + first + at][0], spans[skipped + first + stop - 1][1])
                    if a < b and not any(a < y and x < b for x, y in taken):
                        added[k][state[2:]].append((a, b))
                at = stop
        if len(self.known) > WORD_CACHE:
            self.known.clear()
            if len(self.kinds) > WORD_CACHE:
                self.__init__(self.field)

    @staticmethod
    def _trim(text: str, a: int, b: int) -> Span:
        while a < b and text[a] in "\"'.,;:!?[]{}<>|*$%&#=":
            a += 1
        while a < b and text[b - 1] in "\"'.,;:!?[]{}<>|*$%&#=":
            b -= 1
        return a, b


def listed(spans: dict[str, list[Span]], kinds: tuple[str, ...]) -> list[str]:
    return [f"{k}:{a}:{b}" for k in kinds for a, b in spans.get(k, ())]


def personal_data(docs: DataFrame, field: crf.Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans, masked) for every row.

    The counts and ``base`` are of the base spans, ``spans`` of all, as kind:start:end in code
    points, by kind (the four base kinds, then what the field adds) and start. ``masked`` is the text
    with every span replaced by its kind in angle brackets; null stays null there and counts as empty elsewhere. Null ids and
    repeated rows stay; other columns are not read; an empty table gives an empty one. One pass, no shuffle.
    """
    field = field or model()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detect = Detector(field)
        for batch in batches:
            held = batch.column(1).to_pylist()
            texts = [t or "" for t in held]
            found = detect(texts)
            cols = [pa.array([len(b[k]) for b, _ in found], pa.int64()) for k in KINDS]
            base = [",".join(listed(b, KINDS)) for b, _ in found]
            every = [",".join(listed({**b, **a}, (*KINDS, *ADDED))) for b, a in found]
            masked = [None if h is None else mask(t, {**b, **a}) for h, t, (b, a) in zip(held, texts, found)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, pa.array(base, pa.string()), pa.array(every, pa.string()), pa.array(masked, pa.string())], names=["doc_id", *[f"n_{k}" for k in KINDS], "base", "spans", "masked"])

    texts = texts_of(docs, id_col, text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()
    return map_batches(texts, run, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string, masked string")


def mask(text: str, spans: dict[str, list[Span]]) -> str:
    """A text with each span replaced; of spans that overlap, all are covered by one mark, of the first."""
    out, end = [], 0
    for a, b, kind in sorted((a, b, k) for k, own in spans.items() for a, b in own):
        if a >= end:
            out += [text[end:a], f"<{kind}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def masked_documents(docs: DataFrame, field: crf.Field | None = None, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span of personal data in the text replaced by its kind in angle brackets,
    and, if there is such a column, the new number of code points. A null text and its number stay as they are."""
    field = field or model()
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detect = Detector(field)
        for batch in batches:
            held = batch.column(at).to_pylist()
            texts = [t or "" for t in held]
            masked = [None if h is None else mask(t, {**b, **a}) for h, t, (b, a) in zip(held, texts, detect(texts))]
            cols = list(batch.columns)
            cols[at] = pa.array(masked, batch.schema.field(at).type)
            if size_col in batch.schema.names:
                k = batch.schema.names.index(size_col)
                cols[k] = pa.array([n if m is None else len(m) for n, m in zip(batch.column(k).to_pylist(), masked)], batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return map_batches(docs, run, docs.schema)
