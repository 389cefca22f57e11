"""Near-duplicate groups by improved consistent weighted sampling.

A document's shingles (five words) carry TF-IDF weights.  Improved consistent
weighted sampling (Ioffe 2010) draws K samples from the weighted set such that
two documents draw the same one with probability equal to their weighted
Jaccard similarity; samples are banded, documents meeting in a band are
candidates, and every candidate is verified on the whole weighted sets.

Texts are read once.  Each few megabytes of them become a pack: distinct
shingle hashes and their counts, document after document.  Document frequencies
are exact and over all documents: every pack asks, per hash range, for the
frequencies of its hashes and says how many of its documents have each; ranges
are added up in tasks of their own, and the answers, mostly ones, go back.
Packs are a table bucketed by pack, so only the answers move.  Frequencies are
divided by the number of documents, and shingles in one of ``RARE`` documents
or fewer weigh alike: else what an edit adds would weigh more the larger the
table is, and what a group of copies shares, as every copy counts, ever less
beside it.  From that size on a group's verdicts depend on its share of the
table, not on the table's size; above one document in ``RARE`` copies still
lower the weight of what they share.  Samples, verdicts and bounds all use these weights.

Groups: exact copies are folded first and only one of them is sampled.  A
small bucket of a band gives all pairs.  For the members of larger buckets the
weight is taken that they share with any other such member, counted exactly in
the same way: what a document has for itself can be in no union's shared part,
so it bounds the similarity of every pair it is in, and documents with too
little shared weight leave.  The others are compared with the bucket's leader,
the member that shares most.  Links join documents into classes; then each
bucket that still holds several classes is taken up again, each member with
the members of other classes in it, unless the shared weights, the triangle
inequality of the Jaccard distance or the total weights rule the pair out.  So
no pair that meets in a band and can be similar is left out, and a bucket of
one class, however large, costs its size.

Words are runs of ASCII letters, digits and all non-ASCII characters,
lower-cased.  Defined cases: a null text is alike only to rows of the same id
and null text; texts without words are alike only if they are equal; texts
under five words are one shingle; equal texts are one class.  Ids may be of
any type that sorts, null or repeated: rows are told apart by their place in
the packs, rows of one id and different texts are grouped each by its text,
and of rows equal in id and text one is kept.  ``class_id`` is the least id of
the class that is not null.  An empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrica.llm._shared import batch_bytes, bucketed, discard, kept, materialize, release, scratch

NGRAM, THRESHOLD = 5, 0.8
#: Bands and samples in each: a pair at the threshold is missed with probability (1 - 0.8**4)**14 = 0.0006.
BANDS, ROWS = 14, 4
#: Shingles in one of so many documents or fewer are equally rare.
RARE = 500
#: Buckets up to this size give all pairs.
SMALL = 12
_STEP = 1 << 20
#: Shingles to a range of the exact count, and documents to a pack at most.
GROUP, PACKED = 1 << 20, 1 << 16
#: Parts of the hash ranges that are counted one after the other; only one part's hashes lie in shuffle files at a time.
TURNS = 3
#: Bytes of packs or sets sent to a Python worker at once.
BATCH = 2 << 20

_U = np.uint64
_MIXED = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_TURN = [_U(x | 1) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_INWORD = np.zeros(256, bool)
_INWORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_POW: dict[int, np.ndarray] = {}


def _pow(base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo 2**64."""
    got = _POW.get(int(base))
    if got is None or len(got) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        got = _POW[int(base)] = np.cumprod(p, dtype=np.uint64)
    return got[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text with their counts: (doc index, hash, count), sorted."""
    raw = np.frombuffer(("\n".join(t.lower() for t in texts) + "\n").encode("utf-8", "replace"), np.uint8)
    size = np.array([len(t.lower().encode("utf-8", "replace")) + 1 for t in texts])
    ends = np.cumsum(size)
    n = len(raw)
    with np.errstate(over="ignore"):
        prefix = np.zeros(n + 1, np.uint64)
        np.multiply(_MIXED[raw], _pow(_BASE, n), out=prefix[1:])
        np.cumsum(prefix[1:], out=prefix[1:])
        edge = np.diff(_INWORD[raw].view(np.int8), prepend=np.int8(0), append=np.int8(0))
        w0, w1 = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        h = _mix((prefix[w1] - prefix[w0]) * _pow(_INVERSE, n)[w0])
        doc = np.searchsorted(ends, w0, "right")
        m = len(h)
        if m >= NGRAM:
            roll = np.zeros(m - NGRAM + 1, np.uint64)
            for k in range(NGRAM):
                roll += h[k : m - NGRAM + 1 + k] * _TURN[k]
            inside = doc[: m - NGRAM + 1] == doc[NGRAM - 1 :]
            hs, ds = _mix(roll[inside]), doc[: m - NGRAM + 1][inside]
        else:
            hs, ds = np.empty(0, np.uint64), np.empty(0, np.int64)
        words = np.bincount(doc, minlength=len(texts))
        short = np.flatnonzero((words > 0) & (words < NGRAM))
        if len(short):
            at = np.cumsum(words) - words
            one = np.array([_fold(h[at[d] : at[d] + words[d]]) for d in short], np.uint64)
            hs, ds = np.concatenate([hs, one]), np.concatenate([ds, short])
    order = np.lexsort((hs, ds))
    hs, ds = hs[order], ds[order]
    if not len(hs):
        return ds, hs, np.empty(0, np.int64)
    new = np.concatenate([[True], (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])])
    at = np.flatnonzero(new)
    return ds[at], hs[at], np.diff(np.concatenate([at, [len(hs)]]))


def _fold(h: np.ndarray) -> np.uint64:
    x = _U(len(h))
    with np.errstate(over="ignore"):
        for v in h:
            x = _mix(np.array([x * _TURN[0] + v], np.uint64))[0]
    return x


def _chunks(ids: list, texts: list[str]) -> Iterator[tuple[list, list[str]]]:
    k = 0
    while k < len(texts):
        j, size = k, 0
        while j < len(texts) and ((size < _STEP and j - k < PACKED) or j == k):
            size += len(texts[j])
            j += 1
        yield ids[k:j], texts[k:j]
        k = j


def idf(df: np.ndarray, n: int) -> np.ndarray:
    """ln(1 + n/df), n/df at most ``RARE``, as 32-bit floats."""
    return np.log1p(np.minimum(max(n, 1) / np.maximum(df, 1), RARE)).astype(np.float32)


class Sampler:
    """Improved consistent weighted samples from tables of variates.

    Per (shingle, sample) the variates r, c ~ Gamma(2, 1) and b ~ U(0, 1) are
    picked from tables by independent bits of one mixed hash.
    """

    def __init__(self, k: int = BANDS * ROWS, seed: int = 11):
        rng = np.random.default_rng(seed)
        n = 1 << 14
        self.r = rng.gamma(2, 1, n).astype(np.float32)
        self.inv = (1 / self.r).astype(np.float32)
        self.lnc = np.log(rng.gamma(2, 1, n)).astype(np.float32)
        self.b = rng.random(n).astype(np.float32)
        self.salt = rng.integers(1, 2**63, k, dtype=np.uint64)

    def sample(self, h: np.ndarray, lw: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """(documents, K) 64-bit sample codes; segments start at ``begin``."""
        out = np.empty((len(begin), len(self.salt)), np.uint64)
        n = np.diff(np.concatenate([begin, [len(h)]]))
        low = _U((1 << 14) - 1)
        for k, salt in enumerate(self.salt):
            with np.errstate(over="ignore"):
                x = (h ^ salt) * _U(0x9FB21C651E98DF25)
                x ^= x >> _U(29)
            i = (x & low).astype(np.intp)
            r = self.r[i]
            t = np.floor(lw * self.inv[i] + self.b[((x >> _U(14)) & low).astype(np.intp)])
            # ln a = ln c - r (t - b + 1), with b folded in by the same entry.
            a = self.lnc[((x >> _U(28)) & low).astype(np.intp)] - r * (t - self.b[((x >> _U(14)) & low).astype(np.intp)] + np.float32(1))
            best = np.minimum.reduceat(a, begin)
            hit = np.flatnonzero(a == np.repeat(best, n))
            seg = np.searchsorted(begin, hit, "right") - 1
            first = np.concatenate([[True], seg[1:] != seg[:-1]])
            at = hit[first]
            with np.errstate(over="ignore"):
                out[:, k] = _mix(h[at] + t[at].astype(np.int64).view(np.uint64) * _U(0xA0761D6478BD642F))
        return out


def _group(h: np.ndarray, groups: int) -> np.ndarray:
    """The hash range each hash is in."""
    return ((h >> _U(32)) * _U(groups) >> _U(32)).astype(np.int32)


def _by_group(h: np.ndarray, groups: int) -> Iterator[tuple[int, slice]]:
    """``(group, place)`` of the hash ranges that some of the sorted hashes are in, ascending."""
    group = _group(h, groups)
    at = np.flatnonzero(np.diff(group, prepend=-1))
    for x, y in zip(at, [*at[1:], len(h)]):
        yield int(group[x]), slice(x, y)


def _code(h: np.ndarray) -> bytes:
    """Hashes, sorted or sorted in parts, as the bytes of their differences, plane by plane: the high planes are mostly zero and compress."""
    return np.diff(h, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _decode(blob: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _tight(n: np.ndarray) -> bytes:
    """Counts in the fewest bytes each that hold the largest."""
    return n.astype(np.min_scalar_type(int(n.max())) if len(n) else np.uint8).tobytes()


def _loose(blob: bytes, size: int) -> np.ndarray:
    return np.frombuffer(blob, f"u{len(blob) // size}") if size else np.empty(0, np.uint8)


_ASKED = "group int, chunk bigint, h binary, n binary"
_PACK = "sizes array<int>, h binary, w binary"


def _asked(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["group", "chunk", "h", "n"])


def _packed(lists: list, sizes, h: np.ndarray, w: bytes, kinds: list) -> pa.RecordBatch:
    """One pack as a batch: lists per document, shingles per document, all hashes, all counts or weights."""
    cols = [pa.array([x], pa.list_(k)) for x, k in zip(lists, kinds)]
    names = [f"l{k}" for k in range(len(lists))] + ["sizes", "h", "w"]
    return pa.RecordBatch.from_arrays([*cols, pa.array([np.asarray(sizes).tolist()], pa.list_(pa.int32())), pa.array([_code(h)], pa.binary()), pa.array([w], pa.binary())], names)


def _rows(b: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch of packs, one copied at a time."""
    return (tuple(c[k].as_py() for c in b.columns) for k in range(b.num_rows))


def text_packs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Packs of whole texts: ``(chunk, ids, md5s, sizes, h, w)``, ``w`` the counts; bucketed by ``chunk``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept("weighted_dedup")
            kinds = [b.column(0).type, pa.string()]
            rows = list(zip(b.column(0).to_pylist(), b.column(2).to_pylist()))
            for part, texts in _chunks(rows, [t or "" for t in b.column(1).to_pylist()]):
                d, h, tf = shingles(texts)
                yield _packed([[x for x, _ in part], [m for _, m in part]], np.bincount(d, minlength=len(texts)), h, _tight(tf), kinds)

    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.md5(F.col(text_col)).alias("_md5"))
    packs = src.mapInArrow(pack, f"l0 array<{src.schema['_id'].dataType.simpleString()}>, l1 array<string>, {_PACK}")
    # Partition and place in it, so that a document's place in its pack fits below them.
    chunk = F.monotonically_increasing_id()
    return bucketed(packs.withColumn("chunk", F.shiftleft(F.shiftright(chunk, 33), 20) + chunk.bitwiseAND(F.lit((1 << 33) - 1))), "chunk", "packs")


def set_packs(sets: DataFrame) -> DataFrame:
    """Packs of weighted sets ``(_id, set)``, ``w`` the weights."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, blobs = b.column(0).to_pylist(), b.column(1).to_pylist()
            k = 0
            while k < len(ids):
                j, size = k, 0
                while j < len(ids) and size < (_STEP << 1) and j - k < PACKED:
                    size += len(blobs[j])
                    j += 1
                got = [_unpack(x) for x in blobs[k:j]]
                yield _packed([ids[k:j]], [len(h) for h, _ in got], np.concatenate([h for h, _ in got]), np.concatenate([w for _, w in got]).astype(np.float32).tobytes(), [pa.int64()])
                k = j

    packs = sets.select("_id", "set").mapInArrow(pack, f"l0 array<bigint>, {_PACK}")
    return bucketed(packs.withColumn("chunk", F.monotonically_increasing_id()), "chunk", "set-packs")


def answers(packs: DataFrame) -> DataFrame:
    """``(chunk, got)``: in how many documents of all packs each of a pack's distinct hashes is, by hash range; what is in one only is left out."""
    total = packs.agg(F.sum(F.octet_length("h"))).first()[0] or 0
    groups = max(32, total // 8 // GROUP + 1)

    def ask(turn: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, blob in _rows(b):
                h = _decode(blob)
                h, n = np.unique(h[_group(h, groups) % TURNS == turn], return_counts=True)
                if len(h):
                    yield _asked([(g, chunk, _code(h[at]), _tight(n[at])) for g, at in _by_group(h, groups)])

    def answer(table: pa.Table) -> pa.Table:
        hs = [_decode(x) for x in table.column("h").to_pylist()]
        ns = [_loose(x, len(h)) for x, h in zip(table.column("n").to_pylist(), hs)]
        own, back = np.unique(np.concatenate(hs), return_inverse=True)
        count = np.zeros(len(own), np.int64)
        np.add.at(count, back, np.concatenate(ns))
        told = count[back]
        ends = np.cumsum([0, *map(len, hs)])
        each = [told[x:y] for x, y in zip(ends, ends[1:])]
        more, n = pa.array([np.packbits(x > 1).tobytes() for x in each], pa.binary()), pa.array([_tight(x[x > 1]) for x in each], pa.binary())
        return pa.table({"chunk": table.column("chunk"), "group": table.column("group"), "more": more, "n": n})

    parts = []
    for turn in range(TURNS):
        asks = packs.select("chunk", "h").mapInArrow(partial(ask, turn), _ASKED)
        back = asks.groupBy("group").applyInArrow(answer, "chunk bigint, group int, more binary, n binary")
        parts.append(materialize(back, "some-answers"))
        del asks, back
        release(packs.sparkSession)
    got = reduce(DataFrame.unionByName, parts).groupBy("chunk").agg(F.collect_list(F.struct("group", "more", "n")).alias("got"))
    told = materialize(got.withColumn("groups", F.lit(groups)), "answers")
    discard(*parts)
    return told


def _told(h: np.ndarray, got: list | None, groups: int) -> np.ndarray:
    """The answers' counts for each of a pack's hashes."""
    own, back = np.unique(h, return_inverse=True)
    count = np.ones(len(own), np.int64)
    for (_, at), part in zip(_by_group(own, groups), sorted(got or [], key=lambda g: g["group"]), strict=True):
        more = np.flatnonzero(np.unpackbits(np.frombuffer(part["more"], np.uint8), count=at.stop - at.start))
        count[at.start + more] = _loose(part["n"], len(more))
    return count[back]


def _wanted(packs: DataFrame, told: DataFrame, want: DataFrame) -> DataFrame:
    """``(chunk, at, sizes, h, w, got, groups)`` of the packs with documents in ``want (chunk, at)``; packs stay where they are."""
    at = want.groupBy("chunk").agg(F.sort_array(F.collect_list("at")).alias("at"))
    small = at.join(told.hint("shuffle_hash"), "chunk", "left").repartition(packs._buckets, "chunk")
    return packs.select("chunk", "sizes", "h", "w").join(small.hint("shuffle_hash"), "chunk").select("chunk", "at", "sizes", "h", "w", "got", "groups")


def _weighed(b: pa.RecordBatch, n: int) -> Iterator[tuple]:
    """Per pack: the first node id, places asked for, hashes, counts' weights by exact frequencies, and ends of all documents."""
    for chunk, at, sizes, blob, tfs, got, groups in _rows(b):
        h = _decode(blob)
        w = _loose(tfs, len(h)).astype(np.float32) * idf(_told(h, got, groups or 1), n)
        yield chunk << 16, at, h, w.astype(np.float32), np.cumsum([0, *sizes])


def signatures(packs: DataFrame, told: DataFrame, want: DataFrame, n: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(_id, bands array<bigint>)`` of the wanted documents; texts without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(bands * rows)
        for b in batches:
            for base, at, h, w, ends in _weighed(b, n):
                at = np.array([k for k in at if ends[k] < ends[k + 1]], np.int64)
                if not len(at):
                    continue
                size = ends[at + 1] - ends[at]
                begin = np.cumsum(size) - size
                if len(at) < len(ends) - 1:
                    inside = np.repeat(ends[at] - begin, size) + np.arange(size.sum())
                    h, w = h[inside], w[inside]
                codes = sampler.sample(h, np.log(w), begin).reshape(len(begin), bands, rows)
                with np.errstate(over="ignore"):
                    key = np.zeros((len(begin), bands), np.uint64)
                    for k in range(rows):
                        key = _mix(key * _TURN[1] + codes[:, :, k])
                to = pa.array(np.arange(0, len(begin) * bands + 1, bands, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(base + at, pa.int64()), pa.ListArray.from_arrays(to, pa.array(key.view(np.int64).ravel()))], ["_id", "bands"])

    return _wanted(packs, told, want).mapInArrow(run, "_id bigint, bands array<bigint>")


def weighted_sets(packs: DataFrame, told: DataFrame, want: DataFrame, n: int) -> DataFrame:
    """``(_id, set binary)`` of the wanted documents: sorted shingle hashes, then their weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, at, h, w, ends in _weighed(b, n):
                sets = [h[ends[k] : ends[k + 1]].tobytes() + w[ends[k] : ends[k + 1]].tobytes() for k in at]
                yield pa.RecordBatch.from_arrays([pa.array([base + k for k in at], pa.int64()), pa.array(sets, pa.binary())], ["_id", "set"])

    return _wanted(packs, told, want).mapInArrow(run, "_id bigint, set binary")


def masses(sets: DataFrame) -> DataFrame:
    """``(_id, total, common)``: the weight of each set, and of the part that any other set has too."""
    packs = set_packs(sets)
    told = answers(packs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, sizes, blob, ws, got, groups in _rows(b):
                w = np.frombuffer(ws, np.float32).astype(np.float64)
                more = _told(_decode(blob), got, groups or 1) > 1
                doc = np.repeat(np.arange(len(ids)), sizes)
                total, common = (np.bincount(doc, x, len(ids)) for x in (w, w * more))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total, pa.float64()), pa.array(common, pa.float64())], ["_id", "total", "common"])

    both = packs.join(told.repartition(packs._buckets, "chunk").hint("shuffle_hash"), "chunk", "left").select("l0", "sizes", "h", "w", "got", "groups")
    out = materialize(both.mapInArrow(run, "_id bigint, total double, common double"), "weights")
    discard(packs, told)
    return out


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 12
    return np.frombuffer(blob, np.uint64, n), np.frombuffer(blob, np.float32, n, n * 8).astype(np.float64)


def weighted_jaccard(x: bytes, y: bytes) -> float:
    (a, u), (b, v) = _unpack(x), _unpack(y)
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = a[at] == b if len(a) else np.zeros(len(b), bool)
    shared = np.minimum(u[at[both]], v[both]).sum()
    union = u.sum() + v.sum() - shared
    return float(shared / union) if union > 0 else 0.0


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(a, b, sim)`` of every pair ``(a, b)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (big.slice(k, 256) for big in batches for k in range(0, big.num_rows, 256)):
            sims = [weighted_jaccard(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sims, pa.float64())], ["a", "b", "sim"])

    left = sets.select(F.col("_id").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("_id").alias("b"), F.col("set").alias("y"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(run, "a bigint, b bigint, sim double")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(_id, class)``: least id of each connected part; only nodes with an edge are listed.

    Each round takes the least label among neighbours, then the label of the
    label; rounds are written out, so a lost executor repeats one round only.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_id"), F.least("a", "m").alias("class")), "labels")
    while True:
        near = both.join(label, both["b"] == label["_id"]).groupBy("a").agg(F.min("class").alias("m"))
        new = label.join(near, label["_id"] == near["a"]).select("_id", F.col("class").alias("old"), F.least("class", "m").alias("class"))
        jump = label.select(F.col("_id").alias("_to"), F.col("class").alias("_far"))
        new = new.join(jump, new["class"] == jump["_to"]).select("_id", "old", F.least("class", "_far").alias("class"))
        new = materialize(new, "labels")
        moved = new.where("class <> old").limit(1).count()
        label = new.select("_id", "class")
        if not moved:
            return label


def _possible(total, common, total_r, common_r, threshold: float):
    """Whether two documents can be similar: what they share is in both common weights."""
    most = F.least(common, common_r)
    return most >= threshold * (total + total_r - most) - 1e-6 * (total + total_r)


def _large_buckets(members: DataFrame, sets: DataFrame, sig: DataFrame, threshold: float) -> DataFrame | None:
    """``(band, code, _id, total, common, bands, lead)`` of the large buckets' members that can be similar to another one; None if there is none."""
    ids = members.select("_id").distinct()
    own = materialize(sets.join(ids, "_id", "left_semi"), "large-sets")
    if not own.limit(1).count():
        return None
    mass = masses(own).where(F.col("common") >= threshold * F.col("total") - 1e-6 * F.col("total"))
    mass = materialize(mass.join(sig, "_id"), "masses")
    kept = members.select("_id", "band", "code").join(mass, "_id")
    # The leader shares most of its weight; ties go by the id's hash.
    lead = F.max(F.struct((F.col("common") / F.col("total")).alias("share"), F.xxhash64("_id").alias("h"), "_id", "total", "common")).alias("lead")
    return materialize(kept.join(kept.groupBy("band", "code").agg(lead), ["band", "code"]), "large-buckets")


def _open_pairs(large: DataFrame, label: DataFrame, tested: DataFrame, threshold: float) -> DataFrame:
    """``(a, b)``: of large buckets that still hold several classes, the pairs of different classes that can be similar and are not tested."""
    large = large.join(label, "_id", "left").withColumn("class", F.coalesce("class", "_id"))
    near = tested.select(F.col("a").alias("_l"), F.col("b").alias("_id"), "sim").union(tested.select(F.col("b").alias("_l"), F.col("a").alias("_id"), "sim"))
    far = large.join(near, (F.col("lead._id") == near["_l"]) & (large["_id"] == near["_id"]), "left").drop(near["_id"])
    far = far.withColumn("far", F.when(F.col("_id") == F.col("lead._id"), 0.0).otherwise(1 - F.col("sim")))
    one = large.groupBy("band", "code", "class").agg(F.count(F.lit(1)).alias("m"))
    top = one.groupBy("band", "code").agg(F.max(F.struct("m", "class"))["class"].alias("top"), F.count(F.lit(1)).alias("classes")).where("classes > 1").drop("classes")
    cols = ["_id", "class", "total", "common", "far", "bands"]
    tagged = materialize(far.join(top, ["band", "code"]).select("band", "code", "top", *cols), "open-buckets")
    # The largest class of a bucket is compared with the rest, and the rest among themselves, never the largest with itself.
    rest = tagged.where(F.col("class") != F.col("top")).select("band", "code", *[F.col(c).alias(f"{c}_r") for c in cols])
    met = tagged.join(rest, ["band", "code"]).where(
        (F.col("class") != F.col("class_r"))
        & ((F.col("class") == F.col("top")) | (F.col("_id") < F.col("_id_r")))
        & _possible(F.col("total"), F.col("common"), F.col("total_r"), F.col("common_r"), threshold)
        & F.coalesce(F.abs(F.col("far") - F.col("far_r")) <= 1 - threshold + 1e-6, F.lit(True))
        # Only in the first band in which they meet.
        & (F.array_position(F.zip_with("bands", "bands_r", lambda x, y: x == y), True) == F.col("band") + 1)
    )
    found = met.select(F.least("_id", "_id_r").alias("a"), F.greatest("_id", "_id_r").alias("b"))
    return found.join(tested.select("a", "b"), ["a", "b"], "left_anti").distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, threshold: float, bands: int, rows: int, small: int) -> DataFrame:
    """``(_id, _md5, class_id, keep)`` for every row."""
    with batch_bytes(docs.sparkSession, BATCH):
        with scratch() as keep:
            every = _classes(docs, id_col, text_col, threshold, bands, rows, small)
            keep.append(every)
    release(docs.sparkSession)
    kept = every.groupBy("_class").agg(F.min(F.struct(F.col("_id").isNull().alias("z"), "_id", "_row"))["_row"].alias("_kept"))
    return every.join(kept.select("_kept"), every["_row"] == kept["_kept"], "left").select("_id", "_md5", "class_id", F.col("_kept").isNotNull().alias("keep"))


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float, bands: int, rows: int, small: int) -> DataFrame:
    """``(_id, _md5, _row, _class, class_id)`` for every row, written out."""
    packs = text_packs(docs, id_col, text_col)
    flat = packs.select("chunk", F.posexplode(F.arrays_zip("l0", "l1")).alias("at", "x"))
    keys = materialize(flat.select("chunk", "at", (F.shiftleft("chunk", 16) + F.col("at")).alias("_row"), F.col("x.l0").alias("_id"), F.col("x.l1").alias("_md5")), "text-keys")
    n = keys.count()
    least = F.struct(F.col("_id").isNull().alias("z"), "_id", "_row", "chunk", "at")
    first = keys.where("_md5 is not null").groupBy("_md5").agg(F.min(least).alias("f"))
    first = materialize(first.select("_md5", F.col("f._row").alias("_node"), F.col("f._id").alias("_rep"), "f.chunk", "f.at"), "first-copies")
    told = answers(packs)
    release(docs.sparkSession)
    sig = materialize(signatures(packs, told, first.select("chunk", "at"), n, bands, rows), "signatures")

    member = sig.select("_id", F.posexplode("bands").alias("band", "code"))
    sizes = member.groupBy("band", "code").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    full = materialize(member.join(sizes, ["band", "code"]), "buckets")
    wanted = full.select(F.shiftright("_id", 16).alias("chunk"), F.col("_id").bitwiseAND(F.lit((1 << 16) - 1)).cast("int").alias("at")).distinct()
    sets = materialize(weighted_sets(packs, told, wanted, n), "sets")
    discard(packs, told)
    release(docs.sparkSession)

    listed = full.where(F.col("n") <= small).groupBy("band", "code").agg(F.sort_array(F.collect_list("_id")).alias("l"))
    pairs = listed.select(F.explode(F.flatten(F.transform("l", lambda x, i: F.transform(F.slice("l", i + 2, small), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")).select("p.a", "p.b")

    large = _large_buckets(full.where(F.col("n") > small), sets, sig, threshold)
    if large is not None:
        star = large.where((F.col("_id") != F.col("lead._id")) & _possible(F.col("total"), F.col("common"), F.col("lead.total"), F.col("lead.common"), threshold))
        pairs = pairs.union(star.select(F.least("lead._id", "_id").alias("a"), F.greatest("lead._id", "_id").alias("b")))
    tested = materialize(verify(materialize(pairs.distinct(), "pairs"), sets), "tested")
    links = tested.where(F.col("sim") >= threshold).select("a", "b")
    label = components(sig, links)

    more = None if large is None else materialize(_open_pairs(large, label, tested, threshold), "more-pairs")
    if more is not None and more.limit(1).count():
        again = verify(more, sets).where(F.col("sim") >= threshold).select("a", "b")
        links = materialize(links.union(again), "links")
        label = components(sig, links)

    node = first.join(label.withColumnRenamed("_id", "_node"), "_node", "left").select("_md5", "_rep", F.coalesce("class", "_node").alias("_class"))
    node = materialize(node, "classes")
    least = node.groupBy("_class").agg(F.min("_rep").alias("class_id"))
    by_text = node.join(least, "_class").select("_md5", "_class", "class_id")
    rows = keys.join(by_text, "_md5", "left")
    # A null text is its own class, together with rows of the same id and null text.
    rows = rows.select("_id", "_md5", "_row", F.when(F.col("_md5").isNull(), F.struct(F.lit(-1).cast("long").alias("c"), F.col("_id").alias("i"))).otherwise(F.struct(F.col("_class").alias("c"), F.lit(None).cast(keys.schema["_id"].dataType).alias("i"))).alias("_class"), F.when(F.col("_md5").isNull(), F.col("_id")).otherwise(F.col("class_id")).alias("class_id"))
    return materialize(rows, "rows")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, small: int = SMALL) -> DataFrame:
    """``(id, class_id, keep)``: class_id is the least id of the document's group, keep marks one row of each group."""
    return _grouped(docs, id_col, text_col, threshold, bands, rows, small).select(F.col("_id").alias(id_col), "class_id", "keep")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, small: int = SMALL) -> DataFrame:
    """One document of each group, with its own columns.

    Rows are found again by id and text; of rows equal in both, one stays.
    """
    keep = materialize(_grouped(docs, id_col, text_col, threshold, bands, rows, small).groupBy("_id", "_md5").agg(F.max("keep").alias("k"), F.count(F.lit(1)).alias("m")).where("k").select("_id", "_md5", "m"), "kept")
    key = lambda i, m: F.md5(F.concat_ws("|", i.isNull().cast("string"), i.cast("string"), m))
    once = keep.where("m = 1").select(key(F.col("_id"), F.col("_md5")).alias("_kept"))
    mine = key(docs[id_col], F.md5(docs[text_col]))
    out = docs.join(once, mine == once["_kept"], "left_semi")
    if keep.where("m > 1").limit(1).count():
        more = keep.where("m > 1").select(key(F.col("_id"), F.col("_md5")).alias("_kept"))
        twins = docs.withColumn("_key", mine).join(more, F.col("_key") == more["_kept"], "left_semi")
        out = out.union(twins.dropDuplicates(["_key"]).drop("_key"))
    return out
