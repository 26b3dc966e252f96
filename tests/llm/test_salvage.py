"""The salvage reader on archives of other writers."""

import base64
import hashlib
import time
import zlib

from pipelens.llm import warc


def record(k, body, digest=None):
    return warc.record_bytes(k, "u", body, None, "", False).replace(b"WARC-Payload-Digest: sha256:", b"WARC-Payload-Digest: " + (digest or "sha256:" + hashlib.sha256(body).hexdigest()).encode())


def sha1(body):
    return "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()


def read(data):
    found = list(warc.salvage(data))
    return [int(x["warc-record-id"][10:-1]) for k, _, _, x in found if k == "record"], [x for k, _, _, x in found if k == "gap"], [x for k, _, _, x in found if k == "record"]


def test_other_digests():
    body = b"some text"
    ids, gaps, got = read(record(0, body, sha1(body)) + record(1, body, sha1(b"other")) + record(2, body, "blake9:abc") + record(3, body))
    assert ids == [0, 2, 3] and gaps == ["payload does not fit its digest"]
    assert [x.get("note") for x in got] == [None, "digest not checked: blake9", None]


def test_http_payload_digest():
    block = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody"
    data = record(0, block, sha1(b"body")).replace(b"text/html; charset=utf-8", b"application/http; msgtype=response")
    assert read(data)[0] == [0]


def test_bad_record_within_a_member():
    plain = record(0, b"first") + record(1, b"second", sha1(b"other")) + record(2, b"third")
    ids, gaps, _ = read(warc._member(plain) + warc._member(record(3, b"fourth")))
    assert ids == [0, 2, 3] and len(gaps) == 1 and "unpacked bytes" in gaps[0]


def test_cut_and_damaged_member():
    plain = b"".join(record(k, hashlib.sha512(bytes([k])).hexdigest().encode() * 40) for k in range(20))
    member = zlib.compressobj(0, zlib.DEFLATED, 31)
    packed = member.compress(plain) + member.flush()
    last = warc._member(record(99, b"last"))
    ids, gaps, _ = read(packed[: len(packed) // 2])
    assert len(ids) == len(set(ids))
    assert ids == list(range(len(ids))) and 8 <= len(ids) <= 10 and "member is cut" in gaps
    ids, gaps, _ = read(packed[: len(packed) // 2] + last)
    assert ids[:8] == list(range(8)) and ids[-1] == 99
    broken = packed[:-8] + b"\0" * 8  # the CRC is wrong, the records pass their own checks
    ids, gaps, _ = read(broken + last)
    assert ids[:19] == list(range(19)) and ids[-1] == 99 and len(ids) == len(set(ids)) and any(g.startswith("member: ") for g in gaps)


def test_a_member_without_its_trailer_keeps_its_records():
    body = hashlib.sha512(b"x").hexdigest().encode()
    for n in (1, 5):
        packed = warc._member(b"".join(record(k, body * (k + 1)) for k in range(n)))
        assert read(packed[:-8])[0] == list(range(n))
        assert read(packed[:-8] + warc._member(record(77, b"next")))[0] == [*range(n), 77]
        assert read(packed[:-8] + b"\0" * 8 + warc._member(record(77, b"next")))[0] == [*range(n), 77]


def test_without_a_checked_digest_the_last_of_a_cut_member_is_not_taken():
    packed = warc._member(record(0, b"first", "blake9:a") + record(1, b"second", "blake9:b"))
    assert read(packed[:-8])[0] == [0]


def test_missing_closing_lines():
    assert read(record(0, b"body")[:-4])[0] == [0]
    ids, gaps, got = read(record(0, b"body")[:-3] + record(1, b"next"))
    assert ids == [0, 1] and gaps == [] and got[0]["note"] == "closing lines are missing" and got[0]["payload"] == b"body"
    assert read(record(0, b"body", "blake9:a")[:-4])[0] == []


def test_damage_is_found_by_halves():
    body = bytes(range(256)) * 400
    pack = zlib.compressobj(0, zlib.DEFLATED, 31)
    packed = pack.compress(record(0, body)) + pack.compress(record(1, body)) + pack.flush()
    for at in (100, 65_000, 120_000, len(packed) - 9):
        plain, end, wrong = warc.unpack(packed[:at] + b"\xff" * 50_000, 0)
        byte, good, reference = zlib.decompressobj(31), at + 50_000, b""
        for k in range(len(packed[:at]) + 50_000):
            try:
                reference += byte.decompress((packed[:at] + b"\xff" * 50_000)[k : k + 1])
            except zlib.error:
                good = k
                break
        assert wrong and (end, len(plain)) == (good, len(reference)) and plain == reference


def test_many_false_members_take_little_time():
    began = time.perf_counter()
    for junk in (b"\x1f\x8b\x08" * 700_000, b"\x1f\x8b\x08\x00" * 250_000, b"\x1f\x8b\x08\x00aaaaaa\x01\x05\x00\xfa\xffhello" * 60_000):
        ids, gaps, _ = read(junk + warc._member(record(5, b"sound")))
        assert ids == [5] and gaps
    assert time.perf_counter() - began < 60
