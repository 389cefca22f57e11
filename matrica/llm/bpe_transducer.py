"""Byte-level BPE encoding and decoding.

Encoding compiles the merges into a finite-state transducer that is made
deterministic while it runs.  A state is the longest suffix of the bytes read
that begins some vocabulary entry; its outputs are the tokens that may end
here.  Exactly one of them is the last token BPE gives for the bytes so far:
the one that BPE keeps apart from the token chosen to end just before it, a
relation of token pairs that is worked out once per pair.  Where the chains
of all open starts (suffixes that may still grow into an entry) meet, the
tokens before are final and are emitted, so the lookahead is bounded by the
longest entry.  States and arcs are at most the prefixes of the vocabulary;
the pair table is bounded and emptied when full.

Decoding looks the bytes of each id up and runs an incremental UTF-8 decoder
over chunks, so a character cut by a chunk border is completed by the next.

Defined cases: null or empty text has no ids, ``ids_sha256`` and
``decoded_sha256`` are those of the empty string; repeated documents give
repeated rows; other columns of the input are ignored; documents of any length
are processed whole.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from matrica.llm._shared import kept

#: Segments and token pairs kept by one Python worker.
CACHE = 600_000
PAIRS = 400_000
#: Bytes of text handled by one vectorised step.
STEP = 4 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_bytes(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    """Textbook BPE on one piece: merge the pair of least rank, leftmost first."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Left-to-right BPE.  ``encode`` a whole piece, or ``stream`` bytes of any length.

    State 0 is the start.  An arc is kept by state and byte; a state's outputs
    are the tokens that can end there, longest first, with their lengths.
    """

    def __init__(self, ranks: dict[bytes, int], pairs: int = PAIRS):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.size = {i: len(b) for i, b in self.tokens.items()}
        self.prefixes = {b[:k] for b in ranks for k in range(1, len(b) + 1)}
        self.split: dict[int, tuple[int, int]] = {}
        self.usable: dict[int, bool] = {}
        self.bound = pairs
        self.pairs: dict[int, bool] = {}
        self.arcs: dict[int, int] = {}
        #: Of each state, the longest suffix read that begins some entry.
        self.suffix: list[bytes] = []
        self.outputs: list[tuple[tuple[int, int], ...]] = []
        self.ids: dict[bytes, int] = {}
        self._state(b"")

    def _state(self, suffix: bytes) -> int:
        k = self.ids.get(suffix)
        if k is None:
            k = self.ids[suffix] = len(self.suffix)
            self.suffix.append(suffix)
            ending = ((len(suffix) - j, self.ranks.get(suffix[j:])) for j in range(len(suffix)))
            self.outputs.append(tuple((n, t) for n, t in ending if t is not None and self._alone(t)))
        return k

    def _arc(self, state: int, byte: int) -> int:
        """Determinise one arc."""
        after = self.suffix[state] + bytes([byte])
        while after not in self.prefixes:
            after = after[1:]
            if not after:
                raise ValueError("the vocabulary lacks single bytes")
        got = self.arcs[state << 8 | byte] = self._state(after)
        return got

    def _alone(self, token: int) -> bool:
        ok = self.usable.get(token)
        if ok is None:
            ok = self.usable[token] = merge_bytes(self.ranks, self.tokens[token]) == [token]
        return ok

    def _halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge made this one."""
        got = self.split.get(token)
        if got is None:
            piece = self.tokens[token]
            below = {piece[i:j]: v for i in range(len(piece)) for j in range(i + 1, len(piece) + 1) if (v := self.ranks.get(piece[i:j])) is not None and v != token}
            got = self.split[token] = tuple(merge_bytes(below, piece))
        return got

    def _follows(self, left: int, right: int) -> bool:
        """Whether BPE keeps the border between two tokens: undo their merges
        from the latest on and look for a merge across the border that would
        have come earlier."""
        a, b, limit, ranks, tokens, size = left, right, len(self.tokens) + 1, self.ranks, self.tokens, self.size
        while True:
            over = ranks.get(tokens[a] + tokens[b])
            if over is not None and over < limit:
                ok = False
                break
            if size[a] == 1 and size[b] == 1:
                ok = True
                break
            if size[b] == 1 or (size[a] > 1 and a > b):
                limit, a = a, self._halves(a)[1]
            else:
                limit, b = b + 1, self._halves(b)[0]
        if len(self.pairs) > self.bound:
            self.pairs.clear()
        self.pairs[left << 32 | right] = ok
        return ok

    def _read(self, state: int, piece: bytes, ends: list[int]) -> int:
        """Append, for each byte, the token that ends with it; returns the state."""
        arcs, outputs, pairs, follows, k = self.arcs.get, self.outputs, self.pairs.get, self._follows, len(ends)
        for byte in piece:
            state = arcs(state << 8 | byte) or self._arc(state, byte)
            k += 1
            for n, token in outputs[state]:
                if n == k:
                    break
                if n < k:
                    last = ends[k - n - 1]
                    ok = pairs(last << 32 | token)
                    if follows(last, token) if ok is None else ok:
                        break
            ends.append(token)
        return state

    def encode(self, piece: bytes) -> list[int]:
        token = self.ranks.get(piece)
        if token is not None and self._alone(token):
            return [token]
        if len(piece) > 512:
            return list(self.stream((piece,)))
        ends: list[int] = []
        self._read(0, piece, ends)
        out, k, size = [], len(ends), self.size
        while k:
            token = ends[k - 1]
            out.append(token)
            k -= size[token]
        out.reverse()
        return out

    def stream(self, chunks: Iterable[bytes], every: int = 256) -> Iterator[int]:
        """Tokens of one piece given in chunks.  After each ``every`` bytes at
        most, the tokens that all open starts share are emitted and forgotten,
        so what is held is the longest entry and ``every`` bytes."""
        size, state = self.size, 0
        ends: list[int] = []
        before: list[int] = []  # of the last token emitted, so that its end still counts as a place to start from

        def settled(stops: set[int]) -> list[int]:
            """Walk all chains back to where they meet; the tokens before that."""
            floor = len(before)
            while len(stops) > 1:
                far = max(stops)
                stops.discard(far)
                stops.add(max(floor, far - size[ends[far - 1]]))
            out, k = [], stops.pop()
            while k > floor:
                out.append(ends[k - 1])
                k -= size[ends[k - 1]]
            return out[::-1]

        for chunk in chunks:
            for k in range(0, len(chunk), every):
                state = self._read(state, chunk[k : k + every], ends)
                suffix = self.suffix[state]
                out = settled({len(ends) - j for j in range(len(suffix) + 1) if suffix[len(suffix) - j :] in self.prefixes or not j})
                if out:
                    yield from out
                    cut = len(before) + sum(size[t] for t in out) - 1
                    del ends[:cut]
                    before = ends[:1]
        yield from settled({len(ends)})


class StreamDecoder:
    """Ids in, text out, by an incremental UTF-8 state machine; bytes that are no UTF-8 become U+FFFD."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens, self.machine = tokens, codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: Iterable[int]) -> str:
        return self.machine.decode(b"".join(map(self.tokens.__getitem__, ids)))

    def close(self) -> str:
        return self.machine.decode(b"", True)


class Table:
    """Byte strings by id, laid end to end, to be gathered for many ids at once."""

    def __init__(self, entries: dict[int, bytes]):
        n = max(entries, default=-1) + 1
        self.length = np.zeros(n, np.int64)
        for k, b in entries.items():
            self.length[k] = len(b)
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(entries.get(k, b"") for k in range(n)), np.uint8)

    def gather(self, ids: np.ndarray) -> bytes:
        n = self.length[ids]
        end = np.cumsum(n)
        total = int(end[-1]) if len(end) else 0
        at = np.repeat(self.start[ids] - (end - n), n)
        at += np.arange(total)
        return self.data[at].tobytes()


class _Segments(dict):
    """Ids by segment, filled on first use; long segments are not kept."""

    def __init__(self, make: Callable[[str], bytes], bound: int):
        super().__init__()
        self.make, self.bound = make, bound

    def __missing__(self, part: str) -> bytes:
        got = self.make(part)
        if len(part) <= 64 and len(self) <= self.bound:
            self[part] = got
        return got


class Codec:
    """Encodes and decodes texts; pieces are the matches of ``pattern``.

    No match crosses a space from the left, so a text cut before each space
    gives the same matches, unless two spaces stand in one run of white space;
    such texts are cut by the pattern alone.  Segments seen before come from a
    bounded table.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = CACHE):
        import regex

        self.transducer = Transducer(ranks)
        self.pattern = regex.compile(pattern)
        self.runs = re.compile(r" \s* ")
        self.segments = _Segments(self._segment, cache)
        self.bytes = Table(self.transducer.tokens)
        self.decimal = Table({k: b"%d," % k for k in self.transducer.tokens})

    def _segment(self, text: str) -> bytes:
        encode = self.transducer.encode
        ids: list[int] = []
        for piece in self.pattern.findall(text):
            ids += encode(piece.encode())
        return np.array(ids, np.uint32).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, as the pattern and the ranks define them."""
        if not text:
            return np.empty(0, np.uint32)
        if self.runs.search(text):
            parts = self.pattern.findall(text)
        else:
            parts = text.replace(" ", "\0 ").split("\0") if "\0" not in text else self.pattern.findall(text)
        return np.frombuffer(b"".join(map(self.segments.__getitem__, parts)), np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, gathered a bounded step at a time and passed through the UTF-8 machine."""
        return b"".join(self.decoded(ids))

    def decoded(self, ids: np.ndarray, step: int = 1 << 17) -> Iterator[bytes]:
        machine = codecs.getincrementaldecoder("utf-8")("surrogateescape")
        for k in range(0, len(ids), step):
            yield machine.decode(self.bytes.gather(ids[k : k + step])).encode("utf-8", "surrogateescape")
        yield machine.decode(b"", True).encode("utf-8", "surrogateescape")

    def digest_ids(self, ids: np.ndarray, step: int = 1 << 17) -> str:
        """SHA-256 of the decimal ids joined by commas."""
        h = hashlib.sha256()
        for k in range(0, len(ids), step):
            part = self.decimal.gather(ids[k : k + step])
            h.update(part if k + step < len(ids) else part[:-1])
        return h.hexdigest()

    def digest_text(self, ids: np.ndarray) -> str:
        h = hashlib.sha256()
        for part in self.decoded(ids):
            h.update(part)
        return h.hexdigest()


def _codec(blob: bytes, pattern: str) -> Codec:
    """One codec for all tasks of a worker, until another operator starts in it."""
    mine, key = kept("byte_bpe"), (hash(blob), pattern)
    if key not in mine:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in blob.splitlines() if line.strip())}
        mine[key] = Codec(ranks, pattern)
    return mine[key]


def _pieces(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Rows ``(id, n_tokens, ids array<int> if asked for, ids_sha256, decoded_sha256)``.

    One pass without a shuffle; the rank file is read by the driver and sent
    as a broadcast of its own fixed size.
    """
    spark = docs.sparkSession
    with open(ranks_path, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent.value, pattern)
        for big in batches:
            for batch in _pieces(big):
                n, sha, back, kept = [], [], [], []
                for text in batch.column(1).to_pylist():
                    ids = codec.encode(text or "")
                    n.append(len(ids))
                    sha.append(codec.digest_ids(ids))
                    back.append(codec.digest_text(ids))
                    if with_ids:
                        kept.append(ids)
                out = [batch.column(0), pa.array(n, pa.int64())]
                names = [id_col, "n_tokens"]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    flat = np.concatenate(kept).astype(np.int32) if kept else np.empty(0, np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays([*out, pa.array(sha), pa.array(back)], [*names, "ids_sha256", "decoded_sha256"])

    ids = "ids array<int>, " if with_ids else ""
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, {ids}ids_sha256 string, decoded_sha256 string")
