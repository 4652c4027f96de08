import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrand.llm import packing, token_counts, token_files, tokens
from lodestrand.llm.queries import byte_pattern, vocabulary

ODD = [None, "", " ", "a  b\n\n c\t<|endoftext|> É é ½ ² x²y İstanbul ǅ ﬁ é 's 'S don't I'LL", "\x1c \x85 \xa0 a\x00b", "\n\n", " <|endoftext|>x", "a \n b", "Σίσυφος ΣΑΣ", "word " * 3000, "x" * 5000, "漢字 かな 한국어 🙂🙂"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    path = vocabulary(name)
    encode, library = tokens.Encoder(path), tokens.load(path)
    rng = random.Random(1)
    mixed = ["".join(rng.choice("ab é\n  .,'sßÑ1½\t") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for t in ODD + mixed:
        want = library.encode(t, add_special_tokens=False).ids if t else []
        assert np.frombuffer(encode(t), "<u4").tolist() == want, t


@settings(max_examples=120, deadline=None)
@given(st.text(max_size=60))
def test_pieces_join_and_encode_alone(text):
    path = vocabulary("byte_bpe_50k.json")
    assert "".join(tokens.pieces(text)) == text
    assert np.frombuffer(tokens.Encoder(path)(text), "<u4").tolist() == tokens.load(path).encode(text, add_special_tokens=False).ids


def test_counts_equal_the_library(spark):
    path = vocabulary("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)] + [(None, "a b", 1)], "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: r for r in token_counts.token_counts(docs, path, byte_pattern()).collect()}
    for i, t in enumerate(ODD):
        n = len(tokens.load(path).encode(t, add_special_tokens=False).ids) if t else 0
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 1024)
    assert token_counts.token_counts(docs.filter("doc_id = 99"), path, byte_pattern()).count() == 0


def test_whole_tokens_are_proven():
    path = vocabulary("byte_bpe_50k.json")
    whole = tokens.whole_tokens(path, byte_pattern())
    assert len(whole) > 40_000
    for t in random.Random(2).sample(sorted(whole), 300):
        assert len(tokens.load(path).encode(t, add_special_tokens=False).ids) == 1


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 31), st.lists(st.integers(0, 2**31 - 1), max_size=90), st.data())
def test_packing_bits_round_trip(bits, ids, data):
    a = np.array([x % (1 << bits) for x in ids], np.uint32)
    raw = token_files.pack(a, bits)
    assert len(raw) == -(-len(a) * bits // 8)
    k = data.draw(st.integers(0, len(a)))
    n = data.draw(st.integers(0, len(a) - k))
    assert token_files.unpack(raw, bits, k, n).tolist() == a[k : k + n].tolist()


def test_bits():
    assert [token_files.bits_of(n) for n in (2, 3, 49408, 65536, 65537)] == [1, 2, 16, 16, 17]
    with pytest.raises(ValueError):
        token_files.pack(np.array([8]), 3)


def test_token_file_round_trip(spark, tmp_path):
    path = vocabulary("word_bpe_49k.json")
    texts = [t for t in ODD]
    rows = [(3 * i - 5, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    token_files.write(docs, f"{tmp_path}/a", path, end_id=1)
    got = {r["doc_id"]: r for r in token_files.read(spark, f"{tmp_path}/a").collect()}
    at = 0
    for i, t, _ in sorted(rows):
        ids = np.array([*(tokens.load(path).encode(t, add_special_tokens=False).ids if t else []), 1], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    token_files.write(docs.filter("doc_id = 1000"), f"{tmp_path}/b", path, end_id=1)
    assert token_files.read(spark, f"{tmp_path}/b").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 30), max_size=12))
def test_plan_is_best_fit_decreasing(histogram):
    rows = packing.plan(histogram, 20)
    room, bins = {}, 0
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            free = min((f for f in room if f >= length and room[f]), default=None)
            if free is None:
                free, bins = 20, bins + 1
            else:
                room[free] -= 1
            room[free - length] = room.get(free - length, 0) + 1
    used, places = {}, {}
    for length, rank, n, first, offset, each in rows:
        for k in range(n):
            assert (length, rank + k) not in places
            places[length, rank + k] = True
            used.setdefault(first + k // each, []).append((offset + k % each * length, length))
    assert len(places) == sum(histogram.values()) and len(used) == bins
    for slots in used.values():
        end = 0
        for a, n in sorted(slots):
            assert a == end
            end += n
        assert end <= 20


def test_pack_all_documents(spark):
    path = vocabulary("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD * 3)] + [(None, "a", 1)], "doc_id long, text string, piece int")
    got = packing.pack(docs, path, 2, 64).toPandas()
    assert len(got[got.doc_id.notna()].groupby("doc_id")) == len(ODD) * 3
    for i, t in enumerate(ODD):
        ids = np.array([*(tokens.load(path).encode(t, add_special_tokens=False).ids if t else []), 2], "<u4")
        own = got[got.doc_id == i].sort_values("piece")
        assert own.length.sum() == len(ids) and (own.start.to_numpy() == np.cumsum([0, *own.length[:-1]])).all()
        assert (own.length[1:] == 64).all()
        for p in own.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[int(p.start) : int(p.start + p.length)].tobytes())
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s.offset.to_numpy() == np.cumsum([0, *s.length[:-1]])).all() and s.length.sum() <= 64
    assert packing.pack(docs.filter("doc_id = 1000"), path, 2, 64).count() == 0
