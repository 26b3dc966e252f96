"""Each numbered query against brute force over small rows with all the odd cases."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from pipelens.llm import bpe, fingerprint, line_dedup, lm_score, mixing, quality, secrets, simhash, toxicity, warc

from . import fixture

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def docs():
    return fixture.documents()


@pytest.fixture(scope="module")
def pages():
    long = "<p>" + "x" * 200 + "é</p>"
    return [(1, "u1", long), (5, "u5", long), (3, None, long), (4, "u\r\n4", "short"), (6, "u6", "short"), (7, "u7", None), (8, "u8", ""), (9, "u9", "é" * 50), (10, "u10", "é" * 50), (11, "u11", "WARC/1.1\r\n\r\n" * 20)]


@pytest.fixture(scope="module")
def labels(docs):
    return [(d[0], k % 3 != 0, 0) for k, d in enumerate(docs) if d[0] is not None and k % 2] + [(None, 1, 1), (999, 1, 0)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, docs, labels, pages):
    labels = [(a, int(b), c) for a, b, c in labels]
    return fixture.tables(spark, tmp_path_factory.mktemp("tables"), docs, labels, pages)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return fixture.tables(spark, tmp_path_factory.mktemp("empty"), [])


ALL = [lm_score.op1_lm_score, warc.op2_warc, line_dedup.op3_line_dedup, fingerprint.op4_fingerprint, toxicity.op5_toxicity, bpe.op6_bpe, simhash.op7_simhash, mixing.op8_mixing, secrets.op9_secrets, quality.op10_quality]


@pytest.mark.parametrize("query", ALL, ids=lambda f: f.__name__)
def test_empty_tables_give_no_rows(spark, empty, query):
    assert query(spark, empty).count() == 0


def by_row(rows, *columns):
    return Counter(tuple(r[c] for c in columns) for r in rows)


def test_lm_base_counts_and_gain(spark, folder, docs):
    got = lm_score.op1_lm_score(spark, folder).collect()
    tokens = [[*(w for w in WORD.findall(lower(d[1] or ""))), ""] for d in docs]
    held = [zlib.crc32(("" if d[0] is None else str(d[0])).encode()) % 10 == 0 for d in docs]
    count = Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
    n, v = sum(count.values()), len(count)
    want = Counter((d[0], h, len(ws), sum(count[w] > 0 for w in ws), n) for d, h, ws in zip(docs, held, tokens, strict=True))
    assert by_row(got, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens") == want
    base = sorted(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws) for ws in tokens)
    assert np.allclose(sorted(r["base_score"] for r in got), base)
    assert all(r["score"] <= 0 for r in got)
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_lm_classes_are_a_distribution():
    weights = np.random.default_rng(1).normal(size=(lm_score.BUCKETS, lm_score.CLASSES))
    p = np.exp(lm_score.log_softmax(weights, lm_score.class_features(np.arange(500))))
    assert np.allclose(p.sum(axis=1), 1)
    s = lm_score.SLOTS
    before = lm_score._contexts(np.array([3 * s, 4 * s, 0, 5 * s, 0]), np.array([3, 2])) // lm_score.SKIPS
    assert before.tolist() == [0, 3 * s, 4 * s, 0, 5 * s]


def test_warc_round_trip(spark, folder, pages):
    got = by_row(warc.op2_warc(spark, folder).collect(), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    payload = {p: (h or "").encode() for p, _, h in pages}
    first = {}
    for p in sorted(payload):
        first.setdefault(payload[p], p)
    want = Counter()
    for p, raw in payload.items():
        revisit = len(raw) >= 100 and first[raw] != p
        want[(p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first[raw] if revisit else None)] += 1
    assert got == want


def test_warc_salvage_goes_on_after_damage():
    bodies = [b"a" * 300, b"b" * 300, b"c" * 300, b"d" * 50]
    plain = [warc.record_bytes(k, "u", b, None, hashlib.sha256(b).hexdigest(), False) for k, b in enumerate(bodies)]
    members = [warc._member(r) for r in plain]
    broken = bytearray(members[1])
    broken[len(broken) // 2] ^= 0xFF
    cut = members[2][:-9]
    data = members[0] + bytes(broken) + b"noise" + plain[3] + cut + members[0] + plain[1][:-40]
    found = list(warc.salvage(data))
    assert [(k, x["warc-record-id"][-2:-1]) for k, _, _, x in found if k == "record"] == [("record", "0"), ("record", "3"), ("record", "2"), ("record", "0")]  # of the cut member the record is whole and fits its digest
    gaps = [(a, b) for k, a, b, _ in found if k == "gap"]
    at = len(members[0])
    assert gaps[0] == (at, at + len(broken) + 5)
    assert gaps[-1][1] == len(data) and len(gaps) == 3
    covered = sorted({(a, b) for _, a, b, _ in found})
    assert covered[0][0] == 0 and all(x[1] == y[0] for x, y in itertools.pairwise(covered))


def line_oracle(docs):
    key = lambda line: lower(line.strip(" \t\n\x0b\f\r"))
    least = lambda i: -(2**63) if i is None else i
    holders = defaultdict(set)
    for d in docs:
        for line in (d[1] or "").split("\n"):
            holders[key(line)].add(least(d[0]))
    repeated = {k: max(v) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    out = []
    for d in docs:
        lines = (d[1] or "").split("\n")
        kept = [x for x in lines if repeated.get(key(x), least(d[0])) == least(d[0])]
        out.append((d[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_line_dedup(spark, folder, docs):
    want = Counter(line_oracle(docs))
    assert sum(x[2] for x in want) > 10
    got = line_dedup.op3_line_dedup(spark, folder)
    assert by_row(got.collect(), "doc_id", "n_lines", "n_dropped", "kept_sha256") == want
    for batches, fanout in ((1, 2), (5, 2), (4, 10)):
        n = line_dedup.cleaned(fixture.clashing(spark), batches, fanout).agg({"n_dropped": "sum"}).first()[0]
        assert n == sum(k[2] * v for k, v in want.items())


def test_line_dedup_keeps_other_columns(spark):
    rows = fixture.clashing(spark)
    assert line_dedup.drop_lines(rows).columns == rows.columns


def shingles(text):
    words = [w for w in WORD.findall(lower(text or ""))]
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_fingerprints(spark, folder, docs):
    got = fingerprint.op4_fingerprint(spark, folder).collect()
    assert len(got) == len(docs)
    tie = {}
    for r in spark.createDataFrame([(d[1] or "",) for d in docs], "t string").selectExpr("t", "xxhash64(t) h").collect():
        tie[r["t"]] = r["h"]
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, tie[d[1] or ""]), reverse=True)
    want = Counter()
    near = []
    for d, nxt in zip(order, [*order[1:], order[0]], strict=True):
        text, other = d[1] or "", nxt[1] or ""
        m = len(text) // 3
        changed = text[: len(text) - m] + other[:m]
        want[(d[0], len(text), hashlib.sha256(changed.encode()).hexdigest())] += 1
        a, b = shingles(text), shingles(changed)
        near.append((d[0], len(a & b) / len(a | b) if a | b else 1.0))
    assert by_row(got, "doc_id", "n_chars", "edited_sha256") == want
    true = dict(near)
    assert max(abs(r["near_edited"] - true[r["doc_id"]]) for r in got) < 0.2
    texts = {d[0]: d[1] for d in docs}
    prints = {r["doc_id"]: r["fingerprint"] for r in got}
    assert prints[100] == prints[7] and texts[100] == texts[7]


def test_sketches_merge_and_estimate():
    hashes = fingerprint.WordHashes()
    words = [f"w{k}" for k in range(3000)]
    a, b = " ".join(words[:2000]), " ".join(words[1000:])
    x, y = fingerprint.sketch(a, hashes, 1024), fingerprint.sketch(b, hashes, 1024)
    assert abs(fingerprint.resemblance(x, y, 1024) - 1 / 3) < 0.06
    assert abs(fingerprint.containment(x, y, 1024) - 0.5) < 0.08
    assert abs(fingerprint.distinct(x, 1024) / 1996 - 1) < 0.12
    parts = [fingerprint.sketch(" ".join(words[k : k + 504]), hashes, 64) for k in range(0, 2000, 500)]
    whole = parts[0]
    for p in parts[1:]:
        whole = fingerprint.merge(whole, p, 64)
    assert (whole == fingerprint.sketch(" ".join(words[:2004]), hashes, 64)).all()
    assert (fingerprint.from_text(fingerprint.to_text(x)) == x).all()


def test_bpe_is_the_tokenizers_encoding(spark, folder, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for d in docs:
        ids = t.encode(d[1] or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want[(d[0], len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert by_row(bpe.op6_bpe(spark, folder).collect(), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "a \n b", "a\n  b", "  ", "a  b", "a  b", "x\0y z", "\n\n a\tb", "a   \n\n   b  c", "' s 't", "   a", "a\x1c b \x1cc"])
def test_words_are_encoded_apart(text):
    import public_tokenizers

    path = public_tokenizers.path(bpe.TOKENIZER)
    words = bpe.split_words(text)
    assert "".join(words) == text
    assert bpe.encode_words(words, path)[0].tolist() == bpe._tokenizer(path).encode(text, add_special_tokens=False).ids


def test_bpe_without_matching_word_lists(spark, docs):
    """A block made anew with other rows encodes its words itself."""
    import public_tokenizers
    import pyarrow as pa
    import zstandard

    path = public_tokenizers.path(bpe.TOKENIZER)
    texts = [d[1] or "" for d in docs[:5]]
    raw = [t.encode() for t in texts]
    block = pa.table({"block": [1], "ids": [[1, 2, 3, 4, 5]], "sizes": [[len(x) for x in raw]], "packed": pa.array([zstandard.compress(b"".join(raw))], pa.binary())})
    coded = pa.table({"block": [1], "shard": pa.array([0], pa.int32()), "check": [123], "lengths": pa.array([b""], pa.binary()), "token_ids": pa.array([b""], pa.binary())})
    out = bpe._join_block(path, 3, bpe._out_ids)(block, coded)
    assert out["decoded"].to_pylist() == texts


def naive_simhash(text):
    words = WORD.findall(lower(text or ""))
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components_of(fps, distance=3):
    label = {f: f for f in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(list(fps), 2):
        if (a ^ b).bit_count() <= distance:
            label[max(root(a), root(b))] = min(root(a), root(b))
    return {f: root(f) for f in fps}


def test_simhash(spark, folder, docs):
    fps = [naive_simhash(d[1]) for d in docs]
    label = components_of(set(fps))
    smallest = {}
    for d, f in zip(docs, fps, strict=True):
        if d[0] is not None:
            smallest[label[f]] = min(d[0], smallest.get(label[f], d[0]))
    want = Counter((d[0], f"{f:016x}", smallest.get(label[f])) for d, f in zip(docs, fps, strict=True))
    assert by_row(simhash.op7_simhash(spark, folder).collect(), "doc_id", "fingerprint", "component_id") == want


@pytest.mark.parametrize("block_rows", [8192, 20])
def test_close_pairs_lose_no_link(spark, block_rows):
    rng = np.random.default_rng(3)
    centre = [int(x) for x in rng.integers(0, 2**63, 40)]
    fps = set(centre)
    for c in centre[:3]:
        for _ in range(60):
            fps.add(c ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    pairs = simhash.close_pairs(spark.createDataFrame([(f,) for f in signed], "fp long"), block_rows=block_rows)
    got = {(f): f for f in fps}

    def root(x):
        while got[x] != x:
            x = got[x]
        return x

    for r in pairs.collect():
        a, b = r["a"] % (1 << 64), r["b"] % (1 << 64)
        assert (a ^ b).bit_count() <= 3
        got[max(root(a), root(b))] = min(root(a), root(b))
    want = components_of(fps)
    groups = lambda of: {frozenset(g) for g in _groups(of).values()}
    assert groups({f: root(f) for f in fps}) == groups(want)


def _groups(of):
    out = defaultdict(set)
    for k, v in of.items():
        out[v].add(k)
    return out


def water_fill(size):
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(size.values()), set(names)
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > 2 * size[s]}
        if not over:
            return target | {s: share * weight[s] for s in free}
        for s in over:
            target[s] = 2.0 * size[s]
            left -= 2 * size[s]
        free -= over
    return target


def test_mixing(spark, folder, docs):
    got = mixing.op8_mixing(spark, folder).collect()
    words = [len(WORD.findall(d[1] or "")) for d in docs]
    size = defaultdict(int)
    for d, n in zip(docs, words, strict=True):
        size[d[3]] += n
    goal = water_fill(size)
    want = Counter((d[0], n, size[d[3]], round(goal[d[3]], 6)) for d, n in zip(docs, words, strict=True))
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in got) == want
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    taken = defaultdict(int)
    for r in got:
        taken[round(r["target"], 6)] += r["taken"]
    for s, t in goal.items():
        largest = max(n for d, n in zip(docs, words, strict=True) if d[3] == s)
        assert abs(taken[round(t, 6)] - t) <= 2 * largest
    again = mixing.op8_mixing(spark, folder).collect()
    assert by_row(got, "doc_id", "taken") == by_row(again, "doc_id", "taken")


def test_mix_repeats_rows(spark):
    rows = fixture.clashing(spark)
    out = mixing.mix(rows)
    assert out.columns == rows.columns
    assert out.count() == mixing.copies(rows).agg({"copies": "sum"}).first()[0]


def secret_oracle(text):
    text = text or ""
    spans = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 12:
            spans.append((m.start(), 0, m.end(), "assign"))
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(spans)


def test_secrets(spark, folder, docs):
    got = secrets.op9_secrets(spark, folder).collect()
    want = Counter()
    for d in docs:
        spans = secret_oracle(d[1])
        n = Counter(s[3] for s in spans)
        want[(d[0], n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest())] += 1
    assert by_row(got, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == want
    spans = {r["doc_id"]: r["spans"] for r in got}
    text = dict((d[0], d[1]) for d in docs)[208]
    at = text.index("aB3d")
    assert f"linked:{at}:{at + 22}" in spans[208]
    assert "linked" not in spans[209]


def test_quality_base(spark, folder, docs):
    got = quality.op10_quality(spark, folder).collect()
    want = Counter()
    for d in docs:
        text = d[1] or ""
        words = WORD.findall(text)
        windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        hit = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
        want[(d[0], len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed)] += 1
    assert by_row(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_quality_tells_junk_from_prose(spark):
    rows = fixture.documents()[:60]
    junk = [(1000 + k, " ".join(f"{w}###" for w in rows[k][1].split()), "en", "s", 0) for k in range(15)]
    docs = spark.createDataFrame(rows + junk, fixture.SCHEMA)
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows[::2]] + [(r[0], 0, 0) for r in junk[::2]], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.judge(docs, labels, threshold=-0.35).collect()}
    assert not any(got[r[0]]["kept"] for r in junk)
    assert all(got[r[0]]["kept"] for r in rows if not got[r[0]]["base_failed"])
    assert quality.keep(fixture.clashing(spark), labels).columns == fixture.clashing(spark).columns


def test_toxicity(spark, tmp_path):
    import random

    rng = random.Random(2)
    rows, labels = [], []
    for k in range(300):
        lines = fixture.sentence(rng, "en", 30).split()
        bad = k % 3 == 0
        if bad:
            for _ in range(3):
                lines.insert(rng.randint(0, len(lines)), rng.choice(["idiot", "zorp" + rng.choice(["ing", "ed", "er", "ly"]), "moron,"]))
        rows.append((k, " ".join(lines), "en", "s", 0))
        labels.append((k, 1, int(bad)))
    folder = fixture.tables(spark, tmp_path / "tox", rows + [(900, None, None, None, None), (None, "you idiot", "en", "s", 1)], labels)
    got = {r["doc_id"]: r for r in toxicity.op5_toxicity(spark, folder).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0) for i, r in got.items())
    held = [(i, r["predicted"]) for i, r in got.items() if r["held_out"] and i is not None and i < 300]
    assert len(held) > 20 and sum(p == (i % 3 == 0) for i, p in held) / len(held) > 0.95
    assert got[900]["predicted"] == 0


def test_grammar_marks():
    lexicon = toxicity.Lexicon({"zorp*": 0.5})
    out = lambda text: set(np.flatnonzero(toxicity.match_counts(text, lexicon)).tolist())
    assert out("what an idiot") == {0}
    assert out("you are an idiot. fine") == {toxicity.TARGETED}
    assert out("idiot you") == {toxicity.TARGETED}
    assert out("not an idiot") == {toxicity.NEGATED}
    assert out("he said idiot") == {toxicity.REPORTED | toxicity.TARGETED}
    assert out("i will kill you") == {8 | toxicity.TARGETED}
    assert out("not here. idiot") == {0}
    assert out("idiotic preidiot") == set()
    assert out("zorping") == {0}
    assert out(None) == set()
