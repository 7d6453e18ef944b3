"""Operator 2, token counts by a compiled finite-state tokenizer.

Two deterministic transducers count the tokens of a BPE vocabulary with word
ends, without building any token:

* ``WordTransducer`` reads one pre-token byte by byte. A state holds what can
  still matter: the longest suffix read so far that starts some vocabulary
  entry, and for each start of such a suffix the last token of the encoding up
  to there. Each transition carries the tokens it emits, relative to the state
  it leaves. A token sequence is a BPE encoding exactly when each two
  neighbours encode to themselves, so one last token fits each position.
  Transitions are compiled when first used and kept up to a bound.
* ``TextTransducer`` reads a text character by character: it splits pre-tokens
  and runs the first one on them, holding back the last unit, which may turn out
  to end a word. White space leads every state to the start, so whole stretches
  between white space are kept as compiled steps with their counts.

A text is cut into chunks of fixed length. A chunk's state map tells for every
state before it the state after it and the tokens emitted: with white space
inside by what stands before the first (which is run from the state before) and
the state after the rest; without any by a run from the start state, whose first
states are kept: a run from another state that meets one of them goes on as that
one did, and else is run to the end. Maps compose associatively; they are
combined pair by pair, level by level, as in a parallel prefix scan. The chunks
of texts of more than ``LONG`` characters go to many tasks.

The result equals the tokenizers library on the given file.
"""

from __future__ import annotations

import json
import pickle
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pieces_of, small_batches, written

CHUNK = 1 << 16
#: Characters of a text that is counted by many tasks, and states kept of a run from the start state.
LONG, TRACE = 1 << 20, 256
# How the library splits a text into pre-tokens.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
PATTERN = "|".join([*CONTRACTIONS, r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"])
_SPACE = regex.compile(r"\s+")
#: White space for str.split but not for the pattern.
_ODD = regex.compile(r"[\x1c-\x1f]")
#: Entries of a memo or of the transition table before it starts afresh.
MEMO = 400_000


class WordTransducer:
    """Counts of the tokens of single pre-tokens, for BPE with an end-of-word suffix."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.prefixes: set[tuple[str, ...]] = {()}
        #: The tokens that encode to themselves.
        self.tokens: set[tuple[str, ...]] = set()
        self.fits: dict[tuple, bool] = {}
        for t in self.vocab:
            u = self._split(t)
            if len(self._merge(u)) == 1:
                self.tokens.add(u)
                for k in range(1, len(u)):
                    self.prefixes.add(u[:k])
        self.reset()

    def reset(self) -> None:
        start = ((), ((None, 0),))
        self.states: list[tuple] = [start]
        self.number = {start: 0}
        #: By state number: unit -> (state number, tokens emitted).
        self.steps: list[dict[str, tuple[int, int]]] = [{}]
        self.compiled = 0
        self.fits = {}

    def _split(self, token: str) -> tuple[str, ...]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return (*body[:-1], body[-1] + self.end)
        return tuple(token)

    def _merge(self, units: tuple[str, ...]) -> list[str]:
        """The reference definition: the lowest-ranked pair first, leftmost on ties."""
        parts = list(units)
        while len(parts) > 1:
            ranked = [(self.rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in self.rank]
            if not ranked:
                break
            _, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _fit(self, a: tuple[str, ...] | None, b: tuple[str, ...]) -> bool:
        if a is None:
            return True
        known = self.fits.get((a, b))
        if known is None:
            merged = self._merge(a + b)
            known = self.fits[a, b] = len(merged) == 2 and merged[0] == "".join(a)
        return known

    def step(self, state: tuple, unit: str) -> tuple:
        """(next state, tokens emitted): compiled once for each state and unit."""
        live, ends = state
        text = live + (unit,)
        # ends[k]: last token and count (relative) of the encoding up to the k-th live position.
        for k in range(len(text)):
            token = text[k:]
            if token in self.tokens and self._fit(ends[k][0], token):
                last, count = token, ends[k][1] + 1
                break
        else:
            raise ValueError(f"no token ends in {text!r}")
        ends = (*ends, (last, count))
        cut = 0
        while text[cut:] not in self.prefixes:
            cut += 1
        emitted = count - state[1][-1][1]
        kept = ends[cut:]
        return (text[cut:], tuple((t, c - kept[-1][1]) for t, c in kept)), emitted

    def count(self, word: str) -> int:
        """Tokens of a pre-token given as the model's units (one character for each byte)."""
        state, total, steps = 0, 0, self.steps
        if self.end:
            word = [*word[:-1], word[-1] + self.end]
        for unit in word:
            found = steps[state].get(unit)
            if found is None:
                found = self.compile(state, unit)
            state, emitted = found
            total += emitted
        return total

    def known(self, state: tuple) -> int:
        """The number of a state given by what it is."""
        number = self.number.get(state)
        if number is None:
            number = self.number[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        return number

    def compile(self, state: int, unit: str) -> tuple[int, int]:
        """Adds the transition of a state on a unit."""
        after, emitted = self.step(self.states[state], unit)
        self.compiled += 1
        found = self.steps[state][unit] = self.known(after), emitted
        return found


#: States of ``TextTransducer``: (kind, state of the word transducer, what is held back).
_START = ("", 0, "")
_LETTERS, _OTHERS, _QUOTE = "l", "o", "q"


@dataclass
class StateMap:
    """From the state before a chunk to the state after it. ``text``: the chunk up to its first white space, or whole."""

    text: tuple[str, ...]
    closed: bool
    #: Tokens emitted after ``text`` where closed, else from the start state; and the state at the end.
    count: int
    end: tuple
    #: Where not closed: the first states from the start state, with the tokens emitted up to each.
    trace: list[tuple[tuple, int]]


class TextTransducer:
    """Counts of whole texts for a tokenizers file with BPE, word ends and dropped white space."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.words = WordTransducer(spec)
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if split["pattern"]["Regex"] != PATTERN:
            raise ValueError("this counter takes contractions, runs of letters, single numbers and runs of other characters")
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or not self.words.end:
            raise ValueError("this counter takes NFC, white space, lower case and BPE with word ends")
        self.table = dict(enumerate(byte_units()))
        self.memo: dict[str, int] = {}
        self.kinds: dict[str, str] = {}

    # -- steps --

    def _units(self, text: str) -> str:
        return text.encode().decode("latin-1").translate(self.table)

    def _kind(self, c: str) -> str:
        """l letter, n number, s white space, o other."""
        known = self.kinds.get(c)
        if known is None:
            known = self.kinds[c] = "l" if regex.match(r"\p{L}", c) else "n" if regex.match(r"\p{N}", c) else "s" if regex.match(r"\s", c) else "o"
        return known

    def _begin(self, kind: str, text: str) -> tuple[tuple, int]:
        state, total, held = 0, 0, ""
        for c in text:
            units = self._units(c)
            for unit in units:
                if held:
                    state, n = self.words.steps[state].get(held) or self.words.compile(state, held)
                    total += n
                held = unit
        return (kind, state, held), total

    def _end(self, state: tuple) -> int:
        """Tokens emitted when a pre-token ends."""
        kind, at, held = state
        if kind == "":
            return 0
        if kind == _QUOTE:
            return sum(self.words.count(self._units(t)) for t in (held[0], held[1:]) if t)
        last = held + self.words.end
        return (self.words.steps[at].get(last) or self.words.compile(at, last))[1]

    def step(self, state: tuple, c: str) -> tuple[tuple, int]:
        """(next state, tokens emitted) of one character."""
        kind, at, held = state
        now = self._kind(c)
        if kind == _QUOTE:
            text = held + c
            if text in CONTRACTIONS:
                return _START, self.words.count(text)
            if any(t.startswith(text) for t in CONTRACTIONS):
                return (_QUOTE, 0, text), 0
            if len(held) == 1 and now == "o":
                return self._begin(_OTHERS, text)
            # The quote was a pre-token of its own; what follows it is read afresh.
            total, state = self.words.count(self._units("'")), _START
            for c in text[1:]:
                state, n = self.step(state, c)
                total += n
            return state, total
        if kind == _LETTERS and now == "l" or kind == _OTHERS and now == "o":
            units, total = self._units(c), 0
            for unit in units:
                at, n = self.words.steps[at].get(held) or self.words.compile(at, held)
                total += n
                held = unit
            return (kind, at, held), total
        total = self._end(state)
        if now == "s":
            return _START, total
        if now == "n":
            return _START, total + self.words.count(self._units(c))
        if c == "'":
            return (_QUOTE, 0, c), total
        state, n = self._begin(_LETTERS if now == "l" else _OTHERS, c)
        return state, total + n

    def run(self, state: tuple, text: Iterable[str]) -> tuple[tuple, int]:
        total = 0
        for part in text:
            for c in part:
                state, n = self.step(state, c)
                total += n
        return state, total

    # -- stretches and chunks --

    def stretch(self, text: str) -> int:
        """Tokens of a stretch between white space, from the start state to its end."""
        known = self.memo.get(text)
        if known is None:
            known = 0
            for t in self.pattern.findall(text):
                known += self.words.count(self._units(t))
            if len(self.memo) >= MEMO:
                self.memo.clear()
            if len(text) <= 64:
                self.memo[text] = known
        return known

    def _sum(self, parts: list[str]) -> int:
        total, known = 0, self.memo.get
        for p in parts:
            n = known(p)
            total += self.stretch(p) if n is None else n
        return total

    def chunk_map(self, chunk: str) -> StateMap:
        first = _SPACE.search(chunk)
        if first is None:
            trace, state, total = [], _START, 0
            for c in chunk[:TRACE]:
                state, n = self.step(state, c)
                total += n
                trace.append((state, total))
            state, n = self.run(state, (chunk[TRACE:],))
            return StateMap((chunk,), False, total + n, state, trace)
        parts = _SPACE.split(chunk[first.end() :])
        end, n = self.run(_START, (parts[-1],))
        return StateMap((chunk[: first.start()],), True, self._sum([p for p in parts[:-1] if p]) + n, end, [])

    def apply(self, m: StateMap, state: tuple) -> tuple[tuple, int]:
        """(state after, tokens emitted) of a map on a state."""
        if m.closed:
            state, n = self.run(state, m.text)
            return m.end, n + self._end(state) + m.count
        total = at = 0
        for part in m.text:
            for c in part:
                state, n = self.step(state, c)
                total += n
                if at < len(m.trace) and m.trace[at][0] == state:
                    return m.end, total + m.count - m.trace[at][1]
                at += 1
        return state, total

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """One map after another."""
        if a.closed:
            end, n = self.apply(b, a.end)
            return StateMap(a.text, True, a.count + n, end, [])
        if b.closed:
            return StateMap(a.text + b.text, True, b.count, b.end, [])
        end, n = self.apply(b, a.end)
        return StateMap(a.text + b.text, False, a.count + n, end, a.trace)

    def total(self, maps: list[StateMap]) -> int:
        """Tokens of the text whose chunks these are: composed pair by pair, level by level."""
        if not maps:
            return 0
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        state, n = self.apply(maps[0], _START)
        return n + self._end(state)

    def fresh(self) -> None:
        """Bounds the compiled steps; only between texts, as maps hold numbers of states."""
        if self.words.compiled >= MEMO:
            self.words.reset()

    def pieces(self, text: str) -> list[str]:
        """The normalised text between special strings, each of which is one token."""
        return [normalised(p) for p in self.special.split(text)]

    def count(self, text: str | None) -> int:
        self.fresh()
        pieces = self.pieces(text or "")
        return len(pieces) - 1 + sum(self._count(p) for p in pieces)

    def _count(self, text: str) -> int:
        if len(text) <= CHUNK:
            return self._sum(text.split()) if not _ODD.search(text) else self._sum([p for p in _SPACE.split(text) if p])
        return self.total([self.chunk_map(c) for c in chunks(text)])

    # -- maps between tasks: states by what they are, as numbers differ --

    def packed(self, m: StateMap) -> bytes:
        told = lambda s: (s[0], self.words.states[s[1]], s[2])
        return pickle.dumps((m.text, m.closed, m.count, told(m.end), [(told(s), n) for s, n in m.trace]))

    def unpacked(self, data: bytes) -> StateMap:
        text, closed, count, end, trace = pickle.loads(data)
        known = lambda s: (s[0], self.words.known(s[1]), s[2])
        return StateMap(text, closed, count, known(end), [(known(s), n) for s, n in trace])


def normalised(text: str) -> str:
    text = unicodedata.normalize("NFC", text)
    if "\u03a3" in text:  # lower case by character: no final sigma
        text = text.replace("\u03a3", "\u03c3")
    return text.lower()


def chunks(text: str) -> Iterator[str]:
    for at in range(0, len(text), CHUNK):
        yield text[at : at + CHUNK]


def byte_units() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next free one from 256."""
    free, out = 256, []
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


@lru_cache(maxsize=2)
def counter(path: str) -> TextTransducer:
    return TextTransducer(path)


_FOUND = "doc_id long, n_bytes long, n_tokens long, uid long, piece int, chunk int, text string"


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, long: int = LONG) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row.

    Null text counts as empty (0, 0, false). Repeated rows each give a row; a
    null id stays null; other columns are ignored, whatever their names; an empty
    table gives no rows. Texts of more than ``long`` characters are normalised in
    one task and counted in many.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names = counter(tokenizer), [c.split()[0] for c in _FOUND.split(", ")]
        kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.string()]
        uid = TaskContext.get().partitionId() << 33
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        for batch in pieces_of(batches):
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if len(text) <= long:
                    out.append((doc_id, len(text.encode()), own.count(text), None, None, None, None))
                    continue
                pieces = own.pieces(text)
                # The row of the document counts its special strings, those of its chunks follow.
                out.append((doc_id, len(text.encode()), len(pieces) - 1, uid, None, None, None))
                for p, piece in enumerate(pieces):
                    for at, chunk in enumerate(chunks(piece)):
                        yield table([(None, None, None, uid, p, at, chunk)])
                uid += 1
            if out:
                yield table(out)

    found = written(rows.mapInArrow(count, _FOUND), "token-counts")
    whole = found.where("text is null")
    out = lambda df: df.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    cut = found.where("text is not null").select("uid", "piece", "chunk", "text")
    if cut.isEmpty():
        return out(whole)

    def map_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for batch in pieces_of(batches, 16):
            own.fresh()
            maps = [own.packed(own.chunk_map(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("piece"), batch.column("chunk"), pa.array(maps, pa.binary())], names=["uid", "piece", "chunk", "map"])

    def compose(maps: pd.DataFrame) -> pd.DataFrame:
        own = counter(tokenizer)
        own.fresh()
        ordered = maps.sort_values("chunk")["map"]
        return pd.DataFrame({"uid": [maps["uid"].iloc[0]], "more": [own.total([own.unpacked(m) for m in ordered])]})

    mapped = cut.repartition("uid", "piece", "chunk").mapInArrow(map_chunks, "uid long, piece int, chunk int, map binary")
    composed = mapped.groupBy("uid", "piece").applyInPandas(compose, "uid long, more long")
    sums = composed.groupBy("uid").agg(F.sum("more").alias("more"))
    longer = whole.where("uid is not null").join(sums, "uid", "left").withColumn("n_tokens", F.col("n_tokens") + F.coalesce("more", F.lit(0)))
    return out(whole.where("uid is null")).unionByName(out(longer))


def op2_token_counts(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Token counts of ``documents`` for word_bpe_49k.json."""
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer or public_tokenizers.path("word_bpe_49k.json"))
