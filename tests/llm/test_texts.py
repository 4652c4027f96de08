import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrand.llm import crf
from lodestrand.llm import decontaminate as dc
from lodestrand.llm import fingerprints as fp
from lodestrand.llm import page_text, pii


def test_edited_fingerprints(spark):
    rows = [(5, "one two three four five six\nseven eight", 1), (9, "alpha beta gamma delta epsilon zeta eta", 2), (7, "x" * 3000, 3), (12, "", 4), (20, None, 5), (31, "ä🙂 ö ü", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")
    got = {r["doc_id"]: r for r in fp.edited_fingerprints(docs).collect()}
    order = sorted(rows)
    for k, (i, t, _) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()
        assert got[i]["n_chars"] == len(t) and 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[12]["fingerprint"] == got[20]["fingerprint"] and got[12]["near_next"] == 1.0
    assert fp.edited_fingerprints(docs.filter("doc_id = 1")).count() == 0
    alone = fp.edited_fingerprints(docs.filter("doc_id = 5")).first()
    assert alone["near_next"] == 1.0


def test_next_over_many_runs(spark):
    docs = spark.range(0, 5000, 1, 7).select((F.col("id") * F.col("id") * 3).alias("doc_id"), F.concat(F.lit("text of "), F.col("id")).alias("text"))
    got = {r["doc_id"]: r["edited_sha256"] for r in fp.edited_fingerprints(docs).collect()}
    assert len(got) == 5000
    for k in (0, 1, 999, 1000, 2500, 4998, 4999):
        t, following = f"text of {k}", f"text of {(k + 1) % 5000}"
        half = len(t) // 2
        assert got[k * k * 3] == hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()


def test_changed_sections(spark):
    a, b = "one two\n\nthree four\n\nfive", "one two\n\nthree FOUR\n\nfive"
    df = spark.createDataFrame([(a, b)], "a string, b string").select(fp.fingerprint(F.col("a")).alias("a"), fp.fingerprint(F.col("b")).alias("b"))
    assert df.select(fp.changed_sections(F.col("a"), F.col("b"))).first()[0] == [1]
    assert df.select(fp.likeness(F.col("a"), F.col("a"))).first()[0] == 1.0


def distance_in(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=1, max_size=70), st.text("abc", max_size=90), st.integers(0, 9))
def test_bit_parallel_distance(pattern, text, budget):
    letters = {}
    for i, c in enumerate(pattern):
        letters[c] = letters.get(c, 0) | 1 << i
    d = distance_in(pattern, text)
    assert dc.within(letters, len(pattern), text, budget) == (d if d <= budget else None)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_finder_equals_brute_force(seed):
    rng = random.Random(seed)
    items = [(k, "".join(rng.choice("abcd ") for _ in range(rng.randint(10, 40))).strip().ljust(10, "a")) for k in range(4)]
    text = "".join(rng.choice("abcd ") for _ in range(60))
    for _, t in items[:2]:
        edited = list(t)
        for _ in range(rng.randint(0, 3)):
            if edited:
                edited[rng.randrange(len(edited))] = rng.choice("abcd")
        text += "".join(edited) + "".join(rng.choice("abcd ") for _ in range(9))
    found = dict(dc.Finder(items, 0.1)(text))
    for k, t in items:
        d = distance_in(t, text) if t else 99
        assert found.get(k) == (d if t and d <= int(len(t) * 0.1) else None)


def test_short_items_are_whole_words():
    find = dc.Finder([(1, "the cat"), (2, "x")], 0.06)
    assert find("here is the cat") == [(1, 0)] and find("bathe cats the cattle x") == [(2, 0)] and find("the cat x") == [(1, 0), (2, 0)]


def test_odd_items_and_long_texts(spark):
    items = spark.createDataFrame([("b", "The quick brown fox jumps over the lazy dog."), ("b", "The quick brown fox jumps over the lazy dog."), (None, "word word word word word word"), ("a", "the the")], "item_id string, text string")
    long = "word " * 40_000 + "the quick brown fox jumps over the lazy dog " + "word " * 40_000
    docs = spark.createDataFrame([(1, long, "x"), (2, "the the", "y"), (3, None, None)], "doc_id long, text string, _items string")
    for chars in (10, dc.BLOCK_CHARS):
        got = {r["doc_id"]: r["item_ids"] for r in dc.find_items(docs, items, block_chars=chars).collect()}
        assert got == {1: ["b"], 2: ["a"], 3: []}
        left = dc.clean_documents(docs, items, block_chars=chars)
        assert left.columns == docs.columns and [r["doc_id"] for r in left.collect()] == [3]


def test_find_items_in_blocks(spark):
    items = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog, again and again."), (2, None), (3, ""), (4, "Completely different sentence about nothing at all here.")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "xx the QUICK brown fox  jumped over the lazy dog again and again yy", 0), (1, "xx the QUICK brown fox  jumped over the lazy dog again and again yy", 0), (2, None, 0), (3, "", 0), (4, "clean", 0), (None, "completely different sentence about nothing at all here", 0)], "doc_id long, text string, n_items int")
    one = sorted(map(str, dc.find_items(docs, items).select("doc_id", "item_ids", "contaminated").collect()))
    many = sorted(map(str, dc.find_items(docs, items, block_chars=30).select("doc_id", "item_ids", "contaminated").collect()))
    assert one == many and len(one) == 6
    assert sum("contaminated=True" in x for x in one) == 3
    assert dc.clean_documents(docs, items).count() == 3 and dc.clean_documents(docs, items, block_chars=30).columns == docs.columns
    assert dc.find_items(docs.filter("doc_id = 50"), items).count() == 0
    assert dc.find_items(docs, items.filter("item_id = 50")).filter("contaminated").count() == 0


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    return {
        "email": [m.span() for m in EMAIL.finditer(t)], "ip": [m.span() for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))], "phone": [m.span() for m in PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15],
    }


@settings(max_examples=400, deadline=None)
@given(st.text("ab0129.@-+() %é", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_cards():
    for t in ("4111 1111 1111 1111", "x4111-1111-1111-1111y", "4111111111111112", "12 4111 1111 1111 1111"):
        assert pii.base_spans(t) == plain_spans(t)


def test_personal_data(spark):
    long = "word " * 20_000 + "mail a.b@c.example.com end"
    docs = spark.createDataFrame([(1, 'call +1 (017) 555-7713 or token = "dfd1944d2e84f15e89902e34b677eb5a8a7d42ab" now', "x"), (2, None, "x"), (3, "", "x"), (4, "born in 1984, 12 eggs at 3:30", "x"), (None, long, "x")], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in pii.personal_data(docs).collect()}
    assert got[1]["n_phone"] == 1 and "secret:" in got[1]["spans"] and "555-7713" not in got[1]["masked"] and "dfd19" not in got[1]["masked"]
    assert got[2]["masked"] is None and got[2]["spans"] == "" and got[4]["spans"] == "" and got[None]["n_email"] == 1
    assert all(set(filter(None, r["base"].split(","))) <= set(r["spans"].split(",")) for r in got.values())
    assert pii.personal_data(docs.filter("doc_id = 9")).count() == 0


def test_field_on_held_out_rows():
    rows = pii.labelled_table(300, seed=99)
    f = pii.model()
    paths = f.decode([f.emit(pii.line_features(words)) for words, _ in rows])
    right = sum([pii.STATES[s] for s in p] == y for p, (_, y) in zip(paths, rows))
    assert right / len(rows) > 0.95


def test_cut_chains_decode_like_whole_lines():
    f = pii.model()
    chains = [words for words, _ in pii.labelled_table(250, seed=7)] + [["x"], ["12", "34"], "token = abcDEFghiJKLmnoPQRstu and more words".split()]
    want = [list(p) for p in f.decode([f.emit(pii.line_features(c)) for c in chains])]
    got = [[0] * len(c) for c in chains]
    for chain, first, path in pii.Detector(f).paths(chains):
        got[chain][first : first + len(path)] = list(path)
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6))
def test_viterbi_equals_exhaustive_decoding(seed, n):
    rng = np.random.default_rng(seed)
    f = crf.Field(("a", "b", "c"), {}, np.zeros((0, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    scores = [rng.normal(size=(k, 3)) for k in (n, 1, 0, 3)]
    for e, path in zip(scores, f.decode(scores)):
        value = lambda p: f.first[p[0]] + sum(e[t, s] for t, s in enumerate(p)) + sum(f.moves[a, b] for a, b in zip(p, p[1:]))
        if len(e):
            assert value(path) == pytest.approx(max(map(value, itertools.product(range(3), repeat=len(e)))))
        else:
            assert len(path) == 0


def test_secrets_of_letters_and_very_long_lines():
    find = pii.Detector(pii.model())
    long = "plain words here " * 9000 + "token = " + "aB" * 60 + "7" + " and " + "plain words here " * 9000
    (_, one), (_, two), (_, three) = find(["password : qWeRtYuIoPaSdFgHjKlZ now", long, "the key = value of the answer, call me later"])
    assert len(one["secret"]) == 1 and len(two["secret"]) == 1 and long[slice(*two["secret"][0])] == "aB" * 60 + "7"
    assert not any(three.values())


def test_page_text_on_held_out_pages():
    f = page_text.model()
    right = total = 0
    for page, marks in page_text.labelled_pages(80, seed=1234):
        path = f.decode([f.emit(page_text.features(page_text.read(page)))])[0]
        right, total = right + sum(int(a) == b for a, b in zip(path, marks)), total + len(marks)
    assert right / total > 0.98


def test_page_texts(spark):
    page = '<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">a</a></li></ul></nav><div class="ad">Buy now this.</div><article><h1>A &amp; B</h1><p><b>One  two.<br><p>Three\n four, five.</p></article><footer>&copy; me</footer>'
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", page[:250]), (5, "u", "plain text only, without any mark.")]
    got = {r["page_id"]: r for r in page_text.page_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == "A & B\nOne two.\nThree four, five." and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == "" and got[3]["n_chars"] == 0 and None in got


def main_text(html):
    f = page_text.model()
    blocks = page_text.read(html, f.features)
    return [b.text for b, s in zip(blocks, f.decode([f.emit(page_text.features(blocks))])[0]) if s]


def test_marks_at_any_depth_and_formulas():
    prose = "Some sentence of the article, with words enough to be read. And another one."
    inner = "<div>" * 60
    page = f'<body><nav>{inner}<p>{prose}</p>{"</div>" * 60}</nav><article>{inner}<p>{prose} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here.</p>{"</div>" * 60}</article><div class="a b c d e f g h i j k l m n comments">{inner}<p>{prose}</p></div></body>'
    assert main_text(page) == [prose + " x=2 here."]
    drawn = f'<body><article><p>{prose}</p><p>Figure <svg><title>no</title><desc/><text>label shown</text></svg> one.</p><p>{prose}</p></article></body>'
    assert main_text(drawn) == [prose, "Figure label shown one.", prose]


def test_known_marks_change_nothing():
    f = page_text.model()
    for page, _ in page_text.labelled_pages(30, seed=77):
        a, b = ([f.emit(page_text.features(page_text.read(page, k)))] for k in (None, f.features))
        assert np.allclose(a[0], b[0])


def test_deep_page_with_many_names():
    page = "<body><article>" + "".join(f'<div class="name{k} other{k}">text {k} here.' for k in range(20_000))
    assert len(page_text.read(page, page_text.model().features)) == 20_000


@pytest.mark.parametrize("size", [0, 1, 5000])
def test_long_and_empty_pages(size):
    html = "<body><article>" + "<p>some words here, and more.</p>" * size + "</article></body>"
    assert len(page_text.read(html)) == size
