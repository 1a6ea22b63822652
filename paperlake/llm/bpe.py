"""Byte-level BPE encoding and decoding (operator 3).

The merges are compiled into a finite-state transducer over bytes whose deterministic states are
made when first reached. It rests on two known facts: a token sequence is the BPE encoding of its
bytes exactly when each adjacent pair is the encoding of that pair's bytes, and every prefix of a
text has one last token. A state is the set of places where the next token may still begin, each
with its node in the trie of tokens and the token that ends there. A move gives the next state and
the token that ends with the byte; those tokens are held back until all places that are still open
have them in common, and emitted then. The open places lie within the longest token. Time is linear
in the text, however long a word is.
"""

from __future__ import annotations

import base64
import os
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.llm.kernels import buffers, chunks, fresh_key, key_of, lean, sole
from paperlake.session import prepare

VOCABULARY = os.environ.get("PAPERLAKE_BPE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What a worker keeps: states and token pairs, beyond which it starts afresh, and pieces with known tokens, of which the older half goes.
MAX_STATES, MAX_PAIRS, MAX_WORDS = 150_000, 150_000, 300_000
#: Bytes of text that are encoded at once.
PART = 1 << 19
#: Bytes after which a long piece's tokens are emitted as far as they are certain.
HELD = 512

pieces = regex.compile(PATTERN).findall


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """Lazily determinised BPE transducer of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes_of = ranks, {r: b for b, r in ranks.items()}
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        self.depth: list[int] = [0]
        self.size = {t: len(b) for b, t in ranks.items()}
        #: moves determinised so far
        self.made = 0
        for word, rank in ranks.items():
            node = 0
            for c in word:
                node = self.child[node].get(c) or self._grow(node, c)
            self.token[node] = rank
        self.pairs: dict[int, bool] = {}
        self.bits = max(ranks.values(), default=0).bit_length()
        self._compile()
        self._reset()

    def _grow(self, node: int, c: int) -> int:
        self.child.append({})
        self.token.append(-1)
        self.depth.append(self.depth[node] + 1)
        self.child[node][c] = len(self.child) - 1
        return len(self.child) - 1

    def _reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        #: by state << 8 | byte: next state << bits | the token that ends here; whole numbers in one dict take the least memory
        self.moves: dict[int, int] = {}
        self._state((0, -1))

    def _state(self, key: tuple) -> int:
        at = self.ids.get(key)
        if at is None:
            at = self.ids[key] = len(self.keys)
            self.keys.append(key)
        return at

    def merge(self, word: bytes) -> list[int]:
        """The merges applied one by one, lowest rank first: what the transducer must equal."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _compile(self) -> None:
        """For every token its last merge; tokens that no merges give get none."""
        self.halves: dict[int, tuple[int, int]] = {}
        self.whole: dict[tuple[int, int], int] = {}
        for word, t in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(word) == 1:
                self.halves[t] = (t, t)
                continue
            for i in range(1, len(word)):
                a, b = self.ranks.get(word[:i], -1), self.ranks.get(word[i:], -1)
                if a in self.halves and b in self.halves and self._apart(a, b):
                    self.halves[t], self.whole[a, b] = (a, b), t
                    break

    def _apart(self, a: int, b: int) -> bool:
        """Whether no merge reaches over the border of a and b, undoing their merges latest first."""
        halves, whole, limit = self.halves, self.whole, 1 << 60
        while whole.get((a, b), 1 << 60) >= limit:
            left = a > b
            for _ in range(2):
                x = a if left else b
                y = halves[x][1 if left else 0]
                if y != x:
                    break
                left = not left
            else:
                return True
            if left:
                limit, a = a, y
            else:
                limit, b = b + 1, y
        return False

    def fits(self, a: int, b: int) -> bool:
        """Whether b may follow a (-1: the beginning)."""
        if b not in self.halves:
            return False
        if a < 0:
            return True
        known = self.pairs.get(at := a << self.bits | b)
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[at] = self._apart(a, b)
        return known

    def _move(self, state: int, c: int) -> int:
        """Determinises one step; open places stand oldest first, as (node, token before it) pairs."""
        key, child, token, end, alive = self.keys[state], self.child, self.token, -1, []
        for i in range(0, len(key), 2):
            to = child[key[i]].get(c)
            if to:
                before = key[i + 1]
                if child[to]:
                    alive += (to, before)
                if end < 0 and token[to] >= 0 and self.fits(before, token[to]):
                    end = token[to]
        assert end >= 0, "a byte without a token"
        alive += (0, end)
        move = self.moves[state << 8 | c] = self._state(tuple(alive)) << self.bits | end
        self.made += 1
        return move

    def encode(self, word: bytes) -> list[int]:
        run = Run(self)
        if len(word) <= HELD:
            run.step(word)
            return run.back(len(run.ends))
        out = []
        for k in range(0, len(word), HELD):
            out += run.push(word[k : k + HELD])
        return out + run.end()


class Run:
    """One piece on its way through the transducer."""

    def __init__(self, machine: Transducer):
        if len(machine.keys) > MAX_STATES:
            machine._reset()
        #: the token that ends with each byte that is held back
        self.machine, self.state, self.ends = machine, 0, []

    def step(self, data: bytes) -> None:
        state, moves, ends, move, bits = self.state, self.machine.moves, self.ends, self.machine._move, self.machine.bits
        mask = (1 << bits) - 1
        for c in data:
            known = moves.get(state << 8 | c)
            if known is None:
                known = move(state, c)
            state = known >> bits
            ends.append(known & mask)
        self.state = state

    def back(self, at: int) -> list[int]:
        """The tokens up to a place."""
        size, ends, out = self.machine.size, self.ends, []
        while at:
            t = ends[at - 1]
            out.append(t)
            at -= size[t]
        return out[::-1]

    def settled(self) -> int:
        """The last place that the tokens of all open places go through."""
        machine, key, n = self.machine, self.machine.keys[self.state], len(self.ends)
        open_at = {n - machine.depth[key[i]] for i in range(0, len(key), 2)}
        while len(open_at) > 1:
            at = max(open_at)
            open_at.remove(at)
            open_at.add(at - machine.size[self.ends[at - 1]])
        return open_at.pop()

    def push(self, data: bytes) -> list[int]:
        """The tokens that are certain now."""
        self.step(data)
        at = self.settled()
        out, self.ends = self.back(at), self.ends[at:]
        return out

    def end(self) -> list[int]:
        out, self.ends, self.state = self.back(len(self.ends)), [], 0
        return out


_LETTER, _NUMBER, _OTHER, _SPACE, _END = 1, 2, 0, 3, 4


def _classes() -> np.ndarray:
    """The pattern's class of every code point, from the same tables that the pattern uses."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            code = np.frombuffer(m[0].encode("utf-32-le"), "<u4")
            out[code] = kind
    return out


_class_of: list[np.ndarray] = []


def piece_starts(code: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where a piece of PATTERN begins, for code points of texts that end at `ends`."""
    if not _class_of:
        _class_of.append(_classes())
    kind = _class_of[0][code]
    n = len(code)
    if not n:
        return np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)  # of a text
    first[0] = True
    first[ends] = True
    begin = first.copy()
    begin[1:n] |= kind[1:] != kind[:-1]
    start = np.flatnonzero(begin[:n])
    # The last character of white space that another character follows stands alone, or, a plain space, goes with it.
    after = start[(kind[start] != _SPACE) & ~first[start]]
    after = after[kind[after - 1] == _SPACE]
    begin[after - 1] = True
    joined = after[code[after - 1] == 32]
    begin[joined] = False
    # 's 't 'd 'm 'll 've 're where a piece begins with the apostrophe.
    mark = start[(code[start] == 39) & begin[start]]
    mark = mark[(mark + 1 < n)]
    mark = mark[(kind[mark + 1] == _LETTER) & ~first[mark + 1]]
    one = np.isin(code[mark + 1], [ord(c) for c in "sdmt"])
    begin[mark[one] + 1] = False
    begin[mark[one] + 2] = True
    rest = mark[~one]
    rest = rest[rest + 2 < n]
    rest = rest[~first[rest + 2]]
    x, y = code[rest + 1], code[rest + 2]
    two = rest[(y == 108) & (x == 108) | (y == 101) & ((x == 118) | (x == 114))]
    begin[two + 1] = False
    begin[two + 3] = True
    return np.flatnonzero(begin[:n])


class Encoder:
    """Texts to token ids: a batch's equal pieces go through the transducer once, and known pieces are remembered."""

    def __init__(self, ranks: dict[bytes, int]):
        self.machine, self.key = Transducer(ranks), key_of(fresh_key())
        #: tokens of pieces, and of those that were known before
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _one(self, piece: bytes) -> bytes:
        blob = self.known.get(piece)
        if blob is None:
            blob = self.older.get(piece)
            if blob is None:
                ids = self.machine.encode(piece)
                blob = struct.pack(f"<{len(ids)}i", *ids)
            if len(piece) <= HELD:
                if len(self.known) >= MAX_WORDS // 2:
                    self.known, self.older = {}, self.known
                self.known[piece] = blob
        return blob

    def pieces(self, raw: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all pieces, number of each piece's tokens); the pieces cover `raw`.

        Pieces of equal fingerprints and sizes are compared byte by byte before they count as equal.
        """
        border = np.r_[start, len(raw)]
        size = np.diff(border)
        prints = self.key.prints(raw.astype(np.uint16) + np.uint16(1), start, border[1:])
        _, first, which = np.unique(prints, return_index=True, return_inverse=True)
        lead = start[first][which]
        wrong = size != size[first][which]
        if not wrong.any():
            differs = raw != raw[np.arange(len(raw)) + np.repeat(lead - start, size)]
            wrong = np.diff(np.r_[0, np.cumsum(differs)][border]) > 0
        if wrong.any():  # fingerprints that collide: each such piece for itself
            extra = np.flatnonzero(wrong)
            which[extra] = len(first) + np.arange(len(extra))
            first = np.r_[first, extra]
        text, one = raw.tobytes(), self._one
        blobs = [one(text[a : a + n]) for a, n in zip(start[first].tolist(), size[first].tolist())]
        each = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        flat = np.frombuffer(b"".join(blobs), "<i4")
        count = each[which]
        begin = (np.cumsum(each) - each)[which] - (np.cumsum(count) - count)
        return flat[np.repeat(begin, count) + np.arange(int(count.sum()))], count

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all texts, where each text's begin and end); bytes that are no UTF-8 count as symbols of their own."""
        data, offsets = buffers(column)
        lo, hi = int(offsets[0]), int(offsets[-1])
        if lo == hi:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        raw = data[lo:hi]
        text = raw.tobytes()
        try:
            code = np.frombuffer(text.decode().encode("utf-32-le"), "<u4")
            head = np.flatnonzero((raw & 0xC0) != 0x80)  # the byte where each code point begins
        except UnicodeDecodeError:  # text by text, so that none runs into the next
            each = [text[a:b].decode("utf-8", "surrogateescape") for a, b in zip((offsets[:-1] - lo).tolist(), (offsets[1:] - lo).tolist())]
            code = np.frombuffer("".join(each).encode("utf-32-le", "surrogatepass"), "<u4")
            long = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
            long[(code >= 0xD800) & (code < 0xE000)] = 1
            head = np.cumsum(long) - long
        start = head[piece_starts(code, np.searchsorted(head, offsets[1:] - lo))]
        tokens, count = self.pieces(raw, start)
        return tokens, np.r_[0, np.cumsum(count)][np.searchsorted(start, offsets - lo)]

    def encode(self, text: str) -> list[int]:
        return self.texts(pa.array([text]))[0].tolist()


class Utf8:
    """Incremental UTF-8: feed() takes the bytes held back and new ones, gives text and what it holds back.

    An ill-formed sequence gives one U+FFFD for its longest well-formed beginning.
    """

    @staticmethod
    def need(lead: int) -> tuple[int, int, int]:
        """Continuation bytes after a lead byte, and the range of the first of them."""
        if 0xC2 <= lead <= 0xDF:
            return 1, 0x80, 0xBF
        if 0xE0 <= lead <= 0xEF:
            return 2, 0xA0 if lead == 0xE0 else 0x80, 0x9F if lead == 0xED else 0xBF
        if 0xF0 <= lead <= 0xF4:
            return 3, 0x90 if lead == 0xF0 else 0x80, 0x8F if lead == 0xF4 else 0xBF
        return 0, 0, 0

    @classmethod
    def unfinished(cls, data: bytes) -> int:
        """Bytes at the end that may begin a character."""
        for k in range(1, min(3, len(data)) + 1):
            lead = data[-k]
            if lead & 0xC0 != 0x80:
                n, lo, hi = cls.need(lead)
                fine = n >= k and all(lo <= x <= hi if i == 0 else 0x80 <= x <= 0xBF for i, x in enumerate(data[len(data) - k + 1 :]))
                return k if fine else 0
        return 0

    @classmethod
    def feed(cls, held: bytes, new: bytes) -> tuple[str, bytes]:
        data = held + new
        keep = len(data) - cls.unfinished(data)
        try:  # well-formed runs at once
            return data[:keep].decode(), data[keep:]
        except UnicodeDecodeError:
            return cls.bytewise(data)

    @classmethod
    def bytewise(cls, data: bytes) -> tuple[str, bytes]:
        out, i = [], 0
        while i < len(data):
            lead = data[i]
            if lead < 0x80:
                out.append(chr(lead))
                i += 1
                continue
            n, lo, hi = cls.need(lead)
            if not n:
                out.append("�")
                i += 1
                continue
            code, k = lead & (0x7F >> (n + 1)), 1
            while k <= n and i + k < len(data) and lo <= data[i + k] <= hi:
                code, lo, hi = code << 6 | data[i + k] & 0x3F, 0x80, 0xBF
                k += 1
            if k > n:
                out.append(chr(code))
            elif i + k == len(data):
                return "".join(out), data[i:]
            else:
                out.append("�")
            i += k
        return "".join(out), b""


class Decoder:
    """Token ids to text: push() takes any number of tokens and gives the text that is complete, end() the rest.

    Ids that the vocabulary lacks give U+FFFD.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.top = max(ranks.values(), default=-1) + 1
        words = [b"\xff"] * (self.top + 1)
        for word, t in ranks.items():
            words[t] = word
        self.size = np.array([len(w) for w in words], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(words), np.uint8)
        self.held = b""

    def bytes(self, ids: np.ndarray) -> np.ndarray:
        ids = np.where((ids < 0) | (ids >= self.top), self.top, ids)
        each = self.size[ids]
        return self.flat[np.repeat(self.start[ids] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))]

    def push(self, ids) -> str:
        text, self.held = Utf8.feed(self.held, self.bytes(np.asarray(ids, np.int64)).tobytes())
        return text

    def end(self) -> str:
        held, self.held = self.held, b""
        return "\ufffd" if held else ""

    def decode(self, ids, step: int = 1 << 16) -> str:
        """The whole text, `step` tokens at a time."""
        return "".join([*(self.push(ids[k : k + step]) for k in range(0, len(ids), step)), self.end()])


_made: dict[int, tuple[Encoder, Decoder]] = {}


def coders(ranks: dict[bytes, int]) -> tuple[Encoder, Decoder]:
    return Encoder(ranks), Decoder(ranks)


def _worker(blob: bytes) -> tuple[Encoder, Decoder]:
    key = hash(blob)
    if key not in sole(_made):
        _made.clear()
        _made[key] = coders({base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines())})
    return _made[key]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.list_(pa.int32())), ("round_trip", pa.bool_())])
DDL = "doc_id long, n_tokens long, tokens array<int>, round_trip boolean"


def _encode_rows(vocabulary):
    @lean
    def run(batches):
        encoder, decoder = _worker(vocabulary.value)
        for rows in batches:
            column = rows.column(1)
            for i, j in chunks(buffers(column)[1], PART):
                part = column.slice(i, j - i)
                null = np.array(part.is_null())
                tokens, border = encoder.texts(part)
                data, offsets = buffers(part)
                fine = [comes_back(decoder, tokens[x:y], data[a:b].tobytes()) for x, y, a, b in zip(border[:-1], border[1:], offsets[:-1], offsets[1:])]
                lists = pa.ListArray.from_arrays(pa.array(border.astype(np.int32), mask=np.r_[null, False]), pa.array(tokens))
                yield pa.RecordBatch.from_arrays([rows.column(0).slice(i, j - i), pa.array(np.diff(border), mask=null), lists, pa.array(fine, pa.bool_(), mask=null)], schema=_OUT)

    return run


def comes_back(decoder: Decoder, ids: np.ndarray, raw: bytes) -> bool:
    """Whether incremental decoding of the tokens gives the text; one that is no UTF-8 must come back byte for byte as well."""
    text = decoder.decode(ids)
    try:
        return text == raw.decode()
    except UnicodeDecodeError:
        return text == raw.decode("utf-8", "replace") and decoder.bytes(ids).tobytes() == raw


def _decode_rows(vocabulary):
    def run(batches):
        _, decoder = _worker(vocabulary.value)
        for rows in batches:
            texts = [None if ids is None else decoder.decode(np.array([-1 if x is None else x for x in ids], np.int64)) for ids in rows.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def _vocabulary(spark: SparkSession, path: str):
    """The file reaches workers by a broadcast: its size is that of one vocabulary, whatever the data."""
    with open(path, "rb") as f:
        return prepare(spark).sparkContext.broadcast(f.read())


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, tokens, round_trip) for every row; round_trip says that decoding gives the text again.

    Text is encoded whole; strings that are no UTF-8 are encoded byte for byte; strings of special tokens are ordinary text. A null text has null for
    n_tokens, tokens and round_trip; an empty one has 0, [] and true. A null doc_id stays null, rows
    that stand twice come out twice, an empty table gives none. Other columns are not read.
    """
    v = _vocabulary(docs.sparkSession, vocabulary)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_encode_rows(v), DDL)


def decode(tokens: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, tokens).

    Bytes that are no UTF-8, null ids and ids that the vocabulary lacks give U+FFFD, null tokens a null text.
    """
    v = _vocabulary(tokens.sparkSession, vocabulary)
    return tokens.select(F.col("doc_id").cast("long"), F.col("tokens").cast("array<int>")).mapInArrow(_decode_rows(v), "doc_id long, text string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
