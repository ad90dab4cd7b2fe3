import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spidex.llm import media, queries

from .conftest import texts_of


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=5000))
def test_round_trip(data):
    padded = media.padded(data)
    assert len(padded) % 64 == 0 and len(padded) > 0 and padded[: len(data)] == data
    file = media.encode(padded)
    (track,) = media.tracks(file)
    assert media.payload(file, track) == padded
    p = media.probe_bytes(file)
    assert (p["codec"], p["samples"], p["error"]) == ("raw ", len(padded) // 64, None) and p["duration_s"] == len(padded) / 8000
    for k, key in enumerate(p["keyframes"]):
        assert file[key["offset"] : key["offset"] + key["length"]] == padded[k * 1024 : k * 1024 + 64]


def test_boxes_nest():
    kinds = [b".".join(p) for p, _, _ in media.boxes(media.encode(bytes(64)))]
    assert kinds[:3] == [b"ftyp", b"moov", b"moov.mvhd"] and b"moov.trak.mdia.minf.stbl.stsz" in kinds and kinds[-1] == b"mdat"


@pytest.mark.parametrize("file", [None, b"", b"text", bytes(64), media.encode(bytes(64))[:300], b"\0\0\0\x09moov\0", b"\0\0\0\x01mdat"])
def test_not_media(file):
    p = media.probe_bytes(file)
    assert p["codec"] is None and p["error"]


def expected(text):
    raw = (text or "").encode()
    data = media.padded(raw)
    return len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]) & 0xFFFFFFFF


def test_query(spark, small, small_texts):
    rows = queries.op7_media_columns(spark, small).collect()
    assert {r.doc_id for r in rows} == small_texts.keys() and len(rows) == len(small_texts)
    for r in rows:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == expected(small_texts[r.doc_id])
        assert r.media_sha256 == hashlib.sha256(media.encode(media.padded(small_texts[r.doc_id].encode()))).hexdigest()


def test_odd(spark, odd_docs, no_docs):
    rows = media.digests(media.to_media(odd_docs)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == sorted((str(d), *expected(t)) for d, t in texts_of(odd_docs))
    assert media.digests(media.to_media(no_docs)).count() == 0
    probed = media.with_probe(spark.createDataFrame([(1, media.encode(bytes(128)), "k"), (2, None, "k"), (3, b"junk", "k")], "id int, media binary, codec string"))
    got = {r.id: (r.probe.codec, r.probe.samples, r.codec) for r in probed.collect()}
    assert got == {1: ("raw ", 2, "k"), 2: (None, None, "k"), 3: (None, None, "k")}


def patched(kind, at, value, form=">I"):
    """A sound file with one number of a box replaced."""
    import struct

    file = bytearray(media.encode(bytes(range(64)) * 40))
    struct.pack_into(form, file, bytes(file).index(kind) + 4 + at, value)
    return bytes(file)


@pytest.mark.parametrize(
    "file",
    [
        patched(b"mdhd", 20, 0), patched(b"stss", 8, 0), patched(b"stss", 8, 41), patched(b"stsz", 8, 2**32 - 1), patched(b"stsz", 4, 0), patched(b"stsc", 8, 2), patched(b"stsc", 12, 2**32 - 1),
        patched(b"stts", 8, 7), patched(b"stts", 4, 2**31), patched(b"stco", 8, 2**32 - 1), patched(b"stco", 4, 9), (1000).to_bytes(4) + b"moov" + b"".join((1000 - 8 * k).to_bytes(4) + b"moov" for k in range(1, 125)),
    ],
)
def test_contradicting_tables(file):
    p = media.probe_bytes(file)
    assert p["error"] and p["codec"] is None and p["keyframes"] is None


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1200), st.integers(0, 255)), max_size=8), st.integers(0, 4000))
def test_damaged_files_never_raise(changes, length):
    file = bytearray(media.encode(bytes(range(64)) * 40))
    for at, value in changes:
        file[at % len(file)] = value
    p = media.probe_bytes(bytes(file[:length]))
    assert (p["error"] is None) == (p["codec"] is not None)
    for k in p["keyframes"] or []:
        assert 0 <= k["offset"] and k["offset"] + k["length"] <= length


def test_fragments_and_several_tracks():
    import struct

    def track(number, handler, codec):
        stbl = media._box(b"stbl", media._full(b"stsd", struct.pack(">I", 1), media._box(codec, bytes(28))), *(media._full(k, struct.pack(">I", 0)) for k in (b"stts", b"stsc", b"stco")), media._full(b"stsz", struct.pack(">II", 0, 0)))
        mdia = media._box(b"mdia", media._full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 0, 0, 0)), media._full(b"hdlr", bytes(4), handler, bytes(13)), media._box(b"minf", stbl))
        return media._box(b"trak", media._full(b"tkhd", struct.pack(">III", 0, 0, number), bytes(68)), mdia)

    moov = media._box(b"moov", track(1, b"soun", b"mp4a"), track(2, b"vide", b"avc1"), media._box(b"mvex", media._full(b"trex", struct.pack(">5I", 2, 1, 40, 5, 0x10000))))
    for base_given in (False, True):
        def moof(data_at):
            tfhd = media._full(b"tfhd", struct.pack(">I", 2), struct.pack(">Q", len(moov)) if base_given else b"", flags=1 if base_given else 0x20000)
            first = media._full(b"trun", struct.pack(">Ii", 2, data_at), struct.pack(">I", 0), struct.pack(">II", 3, 4), flags=0x1 | 0x4 | 0x200)
            then = media._full(b"trun", struct.pack(">I", 1))
            return media._box(b"moof", media._box(b"traf", tfhd, first, then))

        data_at = len(moof(0)) + 8
        file = moov + moof(data_at) + media._box(b"mdat", b"aaabbbbccccc")
        p = media.probe_bytes(file)
        assert (p["codec"], p["samples"], p["duration_s"], p["error"]) == ("avc1", 3, 0.12, None)
        assert [file[k["offset"] : k["offset"] + k["length"]] for k in p["keyframes"]] == [b"aaa"]
        assert [(t["handler"], t["codec"], t["samples"]) for t in p["tracks"]] == [("soun", "mp4a", 0), ("vide", "avc1", 3)]
        assert media.payload(file, media.tracks(file)[1]) == b"aaabbbbccccc"


def test_feature_is_told_by_the_layout(spark):
    """The feature of a file of this module follows from its size alone; counted here without its parser."""
    texts = ["", "x" * 64, "y" * 65, "z" * (64 * 16), "w" * (64 * 33 - 1)]
    rows = {r.doc_id: r for r in media.digests(media.to_media(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    for k, t in enumerate(texts):
        data = media.padded(t.encode())
        units, first = len(data) // 64, rows[k].media_bytes - len(data)
        keys = [f"{first + a * 1024}+64" for a in range(-(-units // 16))]
        seal = hashlib.sha256(",".join(keys).encode()).hexdigest()[:16]
        assert rows[k].feature == f"raw;duration={len(data) / 8000:.6f};samples={units};keyframes={len(keys)};ranges={seal};first={keys[0]}"
