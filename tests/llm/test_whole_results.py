"""Operators against brute force over whole texts, and every pipeline stage on odd tables."""

import hashlib
import math
import random
import re
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline as cp
from lodestrand.llm import fingerprints as fp
from lodestrand.llm import page_text, quality, rules, toxicity

ODD = [None, "", " ", "\n\n\n", "a", "one two three four five", "x\ny\n\nz", "é ü 漢字 🙂 " * 40, "line one is here\nline two is there\n\n" * 30, "word " * 20_000, "tab\tand\x0bvt \x85 nel sep"]


def signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def hashed(raw: bytes, seed: int = 42) -> int:
    return xxhash.xxh64_intdigest(raw, seed & (2**64 - 1))


def chained(values: list[int]) -> int:
    seed = 42
    for v in values:
        seed = hashed(struct.pack("<q", signed(v)), seed)
    return seed


def plain_print(text):
    """The fingerprint by its definition, in Python."""
    text = text or ""
    sections = re.split(r"(?<=\n)(?=[^\S\n]*\n)", text, flags=re.A)
    tree = []
    for s in sections:
        own = []
        for p in re.split(r"(?<=\n)", s):
            pattern = r"\s*\S+\s*|\s+" if len(p) < fp.SHORT_LINE else rf"\s*(?:\S+\s*){{1,{fp.LEAF_WORDS}}}|\s+"
            own.append([hashed(m.group().encode()) for m in re.finditer(pattern, p, flags=re.A)])
        tree.append(own)
    root = hashlib.sha256(",".join(f"{chained([chained(p) for p in s]):X}" for s in tree).encode()).hexdigest()
    return root + "|" + "/".join(";".join(",".join(f"{h & 0xFFFFFFFF:08x}" for h in p) for p in s) for s in tree)


def plain_likeness(a, b):
    if a.split("|")[0] == b.split("|")[0]:
        return 1.0
    x, y = (set(re.split("[,;/]", f.split("|")[1])) for f in (a, b))
    return 2 * len(x & y) / (len(x) + len(y))


def test_fingerprints_by_their_definition(spark):
    rng = random.Random(6)
    rows = [(10 * k + rng.randrange(9), t) for k, t in enumerate(ODD * 2)]
    rows += [(500 + k, "\n".join(" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 6)))) for k in range(30)]
    got = {r["doc_id"]: r for r in fp.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted(rows)
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        r = got[i]
        assert r["fingerprint"] == plain_print(t) and r["edited_fingerprint"] == plain_print(edited), i
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(plain_likeness(r["fingerprint"], r["edited_fingerprint"]))
        assert r["near_next"] == pytest.approx(plain_likeness(r["fingerprint"], plain_print(following)))


def test_neighbours_of_null_and_repeated_ids(spark):
    rows = [(None, f"n{k % 5}") for k in range(40)] + [(7, f"t{k}") for k in range(300)] + [(9, "same")] * 60 + [(k, f"x{k}") for k in range(100, 130)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = fp.edited_fingerprints(df).select("doc_id", "edited_sha256").collect()
    mark = lambda t: signed(hashed(t.encode())) % fp._MARKS
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, mark(r[1]), r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        half = len(t) // 2
        want.append((i, hashlib.sha256((t[: len(t) - half] + order[(k + 1) % len(order)][1][:half]).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_quality_scores_of_whole_texts(spark):
    rng = np.random.default_rng(5)
    x = rng.random((600, len(quality.STATISTICS))) * 4
    model = rules.fit(quality.STATISTICS, x, ((x[:, 2] > 1.5) & (x[:, 10] < 3)).astype(float))
    rows = [(k, t, 1.0) for k, t in enumerate(ODD)] + [(3, ODD[8], 1.0), (None, "a b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = sorted((str(r["doc_id"]), r["score"]) for r in quality.quality_scores(df, model).collect())
    want = sorted((str(i), float(model.score(np.array([quality.statistics(t)]))[0])) for i, t, _ in rows)
    assert [a for a, _ in got] == [a for a, _ in want] and [b for _, b in got] == pytest.approx([b for _, b in want])


def test_statistics_of_a_text():
    s = dict(zip(quality.STATISTICS, quality.statistics("The cat!!  THE\ncat 12 é")))
    assert s["s_words"] == pytest.approx(math.log1p(6)) and s["s_lines"] == pytest.approx(math.log1p(2)) and s["s_word_length"] == pytest.approx(17 / 6)
    assert s["s_digits"] == pytest.approx(2 / 24) and s["s_foreign"] == pytest.approx(2 / 24) and s["s_symbol_ends"] == pytest.approx(1 / 6) and s["s_capital_words"] == pytest.approx(1 / 6)


def test_toxicity_scores_by_plain_compression(spark):
    import zstandard as z

    rng = random.Random(2)
    ordinary = [" ".join("".join(rng.choice(["ta", "ri", "lo", "nem", "sto"]) for _ in range(rng.randrange(1, 4))) for _ in range(60)) for _ in range(60)]
    bad = [t + " grumbous wretchlet" for t in ordinary[:20]]
    texts, marks = ordinary[20:] + bad, [False] * 40 + [True] * 20
    t, o = toxicity.dictionaries(texts, marks)
    model = toxicity.Model(t, o, (-1.0, 1.0, 0.5, 0.2, 0.1, 0.3, -0.2), (0.1,) * 6, (1.5,) * 6)

    def size(content, raw):
        content += toxicity.FRAME
        how = z.ZstdCompressionParameters.from_level(6, source_size=64, dict_size=len(content), format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False, write_checksum=False)
        return len(z.ZstdCompressor(dict_data=z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=how).compress(raw))

    def plain(text):
        words = (text or "").lower().split()
        if not words:
            x = [0.0] * 6
        else:
            raw = [toxicity.FRAME + b"".join(xxhash.xxh32_digest(f" {w} "[:k])[: toxicity.CODE] for k in range(min(4, len(w) + 2), len(w) + 3)) for w in words]
            d = [size(o, r) - size(t, r) for r in raw]
            some, many = (sum(v >= s for v in d) for s in toxicity.STEPS)
            x = [math.log1p(1000 * some / len(d)), math.log1p(1000 * many / len(d)), math.log1p(some), math.log1p(many), math.log1p(max(0, max(d))), math.log1p(len(d))]
        return 1 / (1 + math.exp(-(model.weights[0] + sum(w * (v - c) / s for w, v, c, s in zip(model.weights[1:], x, model.centre, model.scale)))))

    short = [x for x in ODD if len(x or "") < 2000]
    rows = [(k, x, "s") for k, x in enumerate([*short, bad[0], bad[0], ordinary[0]])] + [(None, "grumbous", "s")]
    got = sorted((str(r["doc_id"]), r["score"]) for r in toxicity.toxicity_scores(spark.createDataFrame(rows, "doc_id long, text string, score string"), model).collect())
    want = sorted((str(i), plain(x)) for i, x, _ in rows)
    assert [a for a, _ in got] == [a for a, _ in want] and [b for _, b in got] == pytest.approx([b for _, b in want], abs=1e-9)
    assert plain("grumbous") > plain("talo")


def test_pages_of_odd_tables(spark):
    page = "<body><article><h1>Head</h1><p>Some words are here, and more of them.</p></article></body>"
    rows = [(1, "u", page, "a"), (1, "u", page, "a"), (None, None, None, None), (2, "v", "<div" * 2000, "b"), (3, "w", "&#0;&#xD800;&nope; &amp;" * 50, "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = page_text.page_texts(df).collect()
    assert len(got) == 5 and sorted(r["text"] for r in got if r["page_id"] == 1) == ["Head\nSome words are here, and more of them."] * 2
    assert page_text.page_texts(df.filter("page_id = 99")).count() == 0


@pytest.fixture(scope="module")
def odd(spark, data):
    long = "plain words of a long text that goes on. " * 20_000
    rows = [(None, "no id at all, but a text of some words", None, None, None), (-1, None, "en", "s", None), (-2, "", "", "", 0), (-3, long, "en", "s", len(long)), (-4, "same row twice", "en", "s", 14), (-4, "same row twice", "en", "s", 14), (-5, "write to x.y@example.com now", "en", None, 28)]
    own = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = spark.read.parquet(f"{data}/documents.parquet").select(cp.COLUMNS).limit(40)
    more = {c: F.lit("clash") for c in ("score", "predicted", "fp", "comp", "_text", "_items", "spans", "piece", "group", "label", "s_words", "id")}
    return own.union(docs).withColumns(more)


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_stages_on_odd_tables(spark, data, odd, name, stage):
    got = stage(spark, odd, data)
    rows = got.collect()
    ids = [r["doc_id"] for r in rows]
    if name == "packing":
        assert {None, -1, -2, -3, -4, -5} <= set(ids) and ids.count(-4) == 2
        assert all(r["length"] == 1 for r in rows if r["doc_id"] in (-1, -2))
    else:
        assert got.columns == cp.COLUMNS
        if name != "quality":
            assert {None, -1, -2, -3, -5} <= set(ids) and ids.count(-4) == 2
        if name == "pii":
            assert next(r["text"] for r in rows if r["doc_id"] == -5) == "write to <email> now" and next(r["text"] for r in rows if r["doc_id"] == -1) is None
    empty = stage(spark, odd.filter("doc_id = 10000000"), data)
    assert empty.count() == 0 and empty.columns == got.columns


def test_run_leaves_nothing_but_the_last_table(spark, data):
    from lodestrand.llm import common

    before = set(common._written)
    assert cp.run(spark, data).count() > 0
    left = {path for key, path in common._written - before}
    assert len(left) == 1 and "pieces" in left.pop()
