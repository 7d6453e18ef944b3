import hashlib
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonolith.functions import mp4, naming, stft, text

# A published 256-byte id with its known name.
AUDIO_ID = (
    "ALsd7/94mt9nd3ZDRmaIZTNIdWiGQ0ZmiHVDTnd3dkNWdoh1M1+FaPdUX4ea///////////////////////////"
    "N3v///////////////////////6zu/5iYh1RWd5l2Q1mneadUVnaal0NNZDM0Q0RDNEQzTXM01kNNdEXf////"
    "////////////////////////////////////////////////////hTM0MjNDIzQyNEQiNDIzRCM0MjaZMzRDNpl"
    "ERUNImUN5lDeaqr3v/Hp4ZUSP//////////////////////////////////////////////////3d3YcgAA=="
)
NAME = "YNB5YZACIWLCQDMCDFGUDOYEB45D.stem.mp4"


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()[0]


def test_known_name_bucket_and_path(spark):
    words = naming.hash_words(F.lit(AUDIO_ID))
    row = spark.range(1).select(naming.bucket(words), naming.file_name(words), naming.native_path("/Outputs", words)).first()
    assert tuple(row) == ("056", NAME, f"/Outputs/056/{NAME}")


def test_compression_is_md5s():
    """With MD5's own padding the same steps give MD5."""
    data = bytes(range(256))
    state = np.array(naming.FIRST_STATE, np.uint32)[:, None]
    blocks = data + b"\x80" + bytes(55) + struct.pack("<Q", 8 * 256)
    for at in range(0, len(blocks), 64):
        state = naming.compress(state, np.frombuffer(blocks[at : at + 64], "<u4").astype(np.uint32)[:, None])
    assert state[:, 0].astype("<u4").tobytes() == hashlib.md5(data).digest()


@pytest.mark.parametrize("bad", [None, "", "AAAA", "no base64!", AUDIO_ID[:-4]])
def test_unusable_ids_have_no_name(spark, bad):
    df = spark.createDataFrame([(bad,)], "a string")
    words = naming.hash_words(F.col("a"))
    assert tuple(df.select(words, naming.file_name(words), naming.native_path("/S", words)).first()) == (None, None, None)


def test_unknown_algorithm():
    with pytest.raises(ValueError):
        naming.known("other")


@pytest.mark.parametrize(
    "path,title,artist",
    [
        ("/m/01 - Artist Name - Track Name.flac", "Track Name", "Artist Name"),
        ("/m/Track Name.flac", "Track Name", None),
        ("/m/A - B - C.wav", "B - C", "A"),
        ("/m/07 - .mp3", "07 -", None),
        ("/m/ 3 -  x .mp3", "x", None),
        ("/m/a.b - c.d.wav", "c.d", "a.b"),
    ],
)
def test_title_and_artist(spark, path, title, artist):
    df = spark.createDataFrame([(path,)], "p string")
    got = df.select(text.title_from_path(F.col("p")), text.artist_from_path(F.col("p"))).first()
    assert (got[0].strip(), got[1]) == (title, artist)


@pytest.mark.parametrize(
    "folder,file,path",
    [("/:Users/:user/:Music/:DJ/:", "song.flac", "/Users/user/Music/DJ/song.flac"), ("/:a:b/:", "x", "/ab/x"), ("/:", "x", "/x")],
)
def test_collection_path(spark, folder, file, path):
    assert one(spark, text.collection_path(F.col("d"), F.col("f")), d=folder, f=file) == path


@pytest.mark.parametrize(
    "value,name", [(" a/b:c\\d ", "a - b - c - d"), ("x\n\ty", "x y"), ("...", "untitled"), ("", "untitled"), ("/", "-"), ("a  b.", "a b")]
)
def test_sanitise(spark, value, name):
    assert one(spark, text.sanitise(F.col("v")), v=value) == name


@pytest.mark.parametrize("v,want", [(0.04, "0.0s"), (59.94, "59.9s"), (60.0, "1m 00s"), (3725.9, "62m 05s")])
def test_duration(spark, v, want):
    assert one(spark, text.duration(F.col("v")), v=v) == want


def test_audio_suffixes_and_order(spark):
    paths = ["/a b/c.flac", "/a/c.FLAC", "/a/.flac", "/a/x.txt", "/a/b.aif"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").where(text.is_audio(F.col("p")))
    assert [r[0] for r in df.orderBy(text.path_order(F.col("p"))).collect()] == ["/a/b.aif", "/a/c.FLAC", "/a b/c.flac"]


def test_fraction_version_quote_nfc(spark):
    df = spark.createDataFrame([("39/5", "/x/Deck 3.10.2/c", "it's", "é"), ("1/0", "/x/none", "plain", None), ("z", "/Deck 4/", "a b", "")], "f string, p string, q string, n string")
    got = df.select(text.fraction(F.col("f")), text.version_key(F.col("p"), "Deck"), text.shell_quote(F.col("q")), text.nfc(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [(7.8, [3, 10, 2], "'it'\"'\"'s'", "é"), (None, [0], "plain", None), (None, [4], "'a b'", "")]


def test_stft_round_trip():
    rng = np.random.default_rng(1)
    x = np.convolve(rng.normal(size=1000), np.ones(8) / 8, "same")  # little at the top bin
    z = stft.spectrum(x, 256, 64)
    back = stft.signal(z, 256, 64, len(x))
    assert z.shape == (16, 128)
    assert np.abs(back - x)[200:800].max() < 1e-2
    t = np.arange(1000)
    tone = np.sin(2 * np.pi * 10 * t / 256)
    assert np.abs(stft.signal(stft.spectrum(tone, 256, 64), 256, 64, 1000) - tone)[320:680].max() < 1e-9


def container(large=False, front=True):
    head = mp4.box(b"ftyp", b"mp42\0\0\0\0")
    track = mp4.box(b"trak", mp4.box(b"tkhd", b"\1" + bytes(45) + b"\0\x05" + bytes(40)) + mp4.box(b"mdia", mp4.box(b"minf", mp4.box(b"stbl", mp4.box(b"stco", struct.pack(">III", 0, 1, 500 if front else 30))))))
    movie = mp4.box(b"moov", mp4.box(b"mvhd", bytes(100)) + track + mp4.box(b"udta", mp4.box(b"name", b"old")))
    body = b"tkhd" * 9
    media = struct.pack(">I4sQ", 1, b"mdat", 16 + len(body)) + body if large else mp4.box(b"mdat", body)
    return head + (movie + media if front else media + movie)


@pytest.mark.parametrize("large", [False, True])
@pytest.mark.parametrize("front", [False, True])
def test_inject(large, front):
    data = container(large, front)
    new = mp4.inject(data, mp4.metadata_json())
    kinds = [b[2] for b in mp4.boxes(new)]
    assert kinds.count("stem") == 1 and "name" not in kinds and sum(b[1] for b in mp4.boxes(new) if b[3] == 0) == len(new)
    assert b"tkhd" * 9 in new  # media data is never touched
    at = new.index(b"tkhd", new.index(b"moov"))
    assert new[at - 4 + 54 : at - 4 + 56] == b"\0\0"
    offset = struct.unpack_from(">I", new, new.index(b"stco") + 12)[0]
    assert offset == (500 + len(new) - len(data) if front else 30)
    assert mp4.inject(new, mp4.metadata_json()) == new
    with pytest.raises(ValueError):
        mp4.inject(mp4.box(b"free", b""), "{}")


def test_broken_boxes_end():
    assert list(mp4.boxes(struct.pack(">I4s", 4, b"free") * 3)) == []
    assert [b[1] for b in mp4.boxes(struct.pack(">I4s", 0, b"mdat") + b"xyz")] == [11]


def test_metadata_and_checks(spark):
    m = mp4.metadata_json()
    assert '"version":2' in m and '"offset":0' in m and '"name":"Vocals"' in m and json.loads(m)["stems"][3]["name"] == "Vocals"
    info = 'Major Brand mp42\nUDTA types:\n\tstem: {"version":2,"name":"Vocals"}'
    df = spark.createDataFrame([(info, '{"streams":[' + ",".join(['{"codec_type":"audio"}'] * 5) + "]}"), ("Alternate Group ID", "{}")], "i string, p string")
    got = df.select(mp4.checks(F.col("i")), mp4.five_audio_streams(F.col("p"))["ok"]).collect()
    assert tuple(got[0]) == ([], True)
    assert got[1][0] == ["brand is not mp42", "no slot metadata box", "metadata is not of version 2", "last slot has no name", "tracks are alternates"] and not got[1][1]
