"""Content-addressed names: a digest of the audio id, a bucket and a file name.

The digest runs the 64-step compression of RFC 1321 over the four blocks of a
256-byte id and then over one block of zeros in place of the usual padding. It
works on whole Arrow batches at once, one array operation per step for all rows.
Covers SC6 to SC11 and FLT10.
"""

from __future__ import annotations

import base64
import binascii

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALGORITHM = "md5-audio-id"
# RFC 1321's first state, shifts and sine table; the name alphabet and suffix.
FIRST_STATE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
SINES = np.floor(np.abs(np.sin(np.arange(1, 65, dtype=np.float64))) * 2.0**32).astype(np.uint32)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ012345"
SUFFIX = ".stem.mp4"
ID_BYTES = 256


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint32(n)) | (x >> np.uint32(32 - n))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """One block of every row: ``state`` (4, rows) and ``block`` (16, rows) of uint32."""
    mixers = (
        (lambda b, c, d: d ^ (b & (c ^ d)), 1, 0),
        (lambda b, c, d: c ^ (d & (b ^ c)), 5, 1),
        (lambda b, c, d: b ^ c ^ d, 3, 5),
        (lambda b, c, d: c ^ (b | ~d), 7, 0),
    )
    a, b, c, d = state
    for quarter, (mix, step, first) in enumerate(mixers):
        for k in range(16):
            word = block[(first + step * (16 * quarter + k)) % 16]
            turned = _turn(a + mix(b, c, d) + word + SINES[16 * quarter + k], SHIFTS[quarter][k % 4])
            a, b, c, d = d, b + turned, b, c
    return state + np.stack([a, b, c, d])


def digest(ids: np.ndarray) -> np.ndarray:
    """(rows, 256) bytes to (rows, 4) words."""
    words = np.ascontiguousarray(ids).view("<u4").astype(np.uint32).T
    state = np.repeat(np.array(FIRST_STATE, np.uint32)[:, None], len(ids), axis=1)
    with np.errstate(over="ignore"):
        for at in range(0, ID_BYTES // 4, 16):
            state = compress(state, words[at : at + 16])
        return compress(state, np.zeros((16, len(ids)), np.uint32)).T


def decoded(audio_id: str | None) -> bytes | None:
    """The 256 bytes of an id; None for a missing, broken or wrongly long one."""
    try:
        data = base64.b64decode(audio_id) if audio_id else b""
    except (binascii.Error, ValueError):
        return None
    return data if len(data) == ID_BYTES else None


@F.pandas_udf(T.ArrayType(T.LongType()))
def _words(audio_ids: pd.Series) -> pd.Series:
    data = [decoded(x) for x in audio_ids]
    good = [i for i, x in enumerate(data) if x is not None]
    out: list = [None] * len(data)
    if good:
        found = digest(np.frombuffer(b"".join(data[i] for i in good), np.uint8).reshape(-1, ID_BYTES))
        for i, row in zip(good, found.tolist()):
            out[i] = row
    return pd.Series(out, dtype=object)


def hash_words(audio_id: Column) -> Column:
    """Four unsigned 32-bit words as longs; null for an id that is not 256 bytes."""
    return _words(audio_id)


def bucket(words: Column) -> Column:
    return F.lpad(words[0].bitwiseAND(F.lit(127)).cast("string"), 3, "0")


def file_name(words: Column) -> Column:
    """Seven letters of five bits for each word, least bits first."""
    letters = [
        F.substring(F.lit(ALPHABET), F.shiftright(words[w], 5 * k).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1))
        for w in range(4)
        for k in range(7)
    ]
    return F.when(words.isNotNull(), F.concat(*letters, F.lit(SUFFIX)))


def native_path(root: str | Column, words: Column) -> Column:
    root = F.lit(root.rstrip("/")) if isinstance(root, str) else root
    return F.when(words.isNotNull(), F.concat_ws("/", root, bucket(words), file_name(words)))


def known(algorithm: str) -> str:
    if algorithm != ALGORITHM:
        raise ValueError(f"unknown name algorithm: {algorithm}")
    return algorithm


def calibration(words: Column, existing: Column) -> Column:
    """{algorithm: whether it gives the existing file's name}."""
    return F.create_map(F.lit(ALGORITHM), file_name(words).eqNullSafe(F.element_at(F.split(existing, "/"), -1)))
