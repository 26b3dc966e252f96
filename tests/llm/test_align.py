"""Alignment against encodings of whole texts, compared by sets of offsets."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pipelens.llm import align, bpe

from . import fixture

A, B = public_tokenizers.path(align.TOKENIZER_A), public_tokenizers.path(align.TOKENIZER_B)
ODD = [
    "a▁b", "  two  spaces ", "\n\n x\n y \n", " ", "   ", "　 x", "\x1c a \x85 b", " \x1c x", "中文字符没有空格" * 50, "\U0001f600" * 300 + " x" * 3,
    "a b\x00 c  d", "<s> </s><unk> <|endoftext|> <0x41>", "don't we'll  I'm", "y" * 700 + " tail", "tab\t tab \t", "same same same", "é é ﬁ",
]


def oracle(texts):
    """Each text's row; both vocabularies encode it in one piece."""
    a_model, b_model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    data, at, n = bpe._pieces(A)
    rows, held = [], Counter()
    for text in texts:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        bytes_a = [data[at[i] : at[i] + n[i]].tobytes() for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(b_model.id_to_piece, b), strict=True)]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            rows.append((0, 0, 0, [], ""))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            x, y = a[i : ends_a.index(end) + 1], b[j : ends_b.index(end) + 1]
            i, j = i + len(x), j + len(y)
            groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
            links += [(p, q) for p in x for q in y]
        held.update(set(links))
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = defaultdict(int)
    for (p, _), n_docs in held.items():
        best[p] = max(best[p], n_docs)
    return [(a, b, g, len(x), sum(held[p] == best[p[0]] for p in x), sum(held[p] for p in x), s) for a, b, g, x, s in rows]


def found(rows):
    return Counter(tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in rows)


@pytest.mark.parametrize("block_bytes", [3000, align.BLOCK_BYTES])
def test_align(spark, block_bytes):
    docs = [*fixture.documents(), *[(500 + k, t, "en", "src", 1) for k, t in enumerate(ODD)]]
    want = Counter((d[0], *r) for d, r in zip(docs, oracle([d[1] for d in docs]), strict=True))
    got = align.align(fixture.frame(spark, docs).repartition(3), block_bytes=block_bytes).collect()
    assert found(got) == want


def test_query_and_empty_table(spark, tmp_path):
    rows = fixture.documents()[:20]
    full, empty = fixture.tables(spark, tmp_path / "full", rows), fixture.tables(spark, tmp_path / "empty", [])
    assert found(align.op11_align(spark, full).collect()) == Counter((d[0], *r) for d, r in zip(rows, oracle([d[1] for d in rows]), strict=True))
    assert align.op11_align(spark, empty).count() == 0
    assert align.align(fixture.clashing(spark)).columns == align.op11_align(spark, empty).columns


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \n\tab'1　\x1c\x85é", max_size=30))
def test_segments_are_encoded_apart(text):
    segments = align.split_segments(text)
    assert "".join(segments) == " " + text
    a, n_a = align.encode_a(segments, A)
    b, n_b = align.encode_b(segments, B)
    assert a.tolist() == align._encoder_a(A).encode(" " + text, add_special_tokens=False).ids and n_a.sum() == len(a)
    if text:
        assert b.tolist() == align._encoder_b(B)[0].encode(text) and n_b.sum() == len(b)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(1, 60), max_size=40), st.sets(st.integers(1, 60), max_size=40)), min_size=1, max_size=6))
def test_galloping_finds_the_common_ends(lanes):
    flat = lambda k: np.array([x for lane in lanes for x in sorted(lane[k])], dtype=np.int64)
    starts = lambda k: np.cumsum([0, *[len(lane[k]) for lane in lanes]])
    i, j = align.common_ends(flat(0), starts(0), flat(1), starts(1))
    assert flat(0)[i].tolist() == flat(1)[j].tolist() == [x for a, b in lanes for x in sorted(a & b)]
    for a, b in lanes:
        x, y = align.gallop(sorted(a), sorted(b))
        assert [sorted(a)[k] for k in x] == [sorted(b)[k] for k in y] == sorted(a & b)


def test_large_groups_count_distinct_pairs():
    a, b = np.array([1, 2] * 300), np.array([7, 8, 9] * 200)
    group, pair, times = align._pairs(a, np.array([0]), np.array([600]), b, np.array([0]), np.array([600]))
    assert len(pair) == 6 and times.sum() == 600 * 600 and set(group) == {0}
    assert dict(zip(pair.tolist(), times.tolist(), strict=True))[2 * align.ID_SPAN + 9] == 300 * 200
