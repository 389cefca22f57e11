"""Document quality from a linear-chain conditional random field over lines.

Every line has features of its own bytes and words (case, symbols, digits,
punctuation, repeated words, repeated lines) and of the lines before and after
it.  A two-state chain, trained on lines that take their document's label,
gives each line the probability of being good given the whole document
(forward-backward); a document's quality is the mean of these, weighted by
line length.  Features are numpy over the bytes of many documents at once;
training runs on the driver over a sample of labelled documents that is
bounded in documents and in bytes.

Defined cases: a null or empty text is one empty line and gets a score; blank
lines weigh one byte; repeated rows are scored each; very long texts are
scored whole; null or unknown labels are left out of training; with labels of
one kind only, or none, every score is the share of good labels (1 if none);
other columns are carried along or ignored and never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matrica.llm._shared import kept

#: Labelled documents a model is fitted on at most; the least by hash of their id.
TRAIN_DOCS = 3000
#: Bytes of text of them at most: in hash order, whole documents that still fit.
TRAIN_BYTES = 16 << 20
#: Longer training documents are cut into chains of so many lines.
TRAIN_LINES = 256
#: Bytes of text whose features are computed together.
STEP = 512 << 10
#: The same while fitting, on the driver.
FIT_STEP = 256 << 10
#: Places of padded chains worked on together; a longer chain is taken alone.
CHAIN_STEP = 1 << 16

_LOWER, _UPPER, _DIGIT, _SPACE, _SYMBOL, _BANG, _PUNCT, _LEAD, _TAIL = range(9)


def _classes() -> np.ndarray:
    t = np.full(256, _PUNCT, np.uint8)
    t[ord("a") : ord("z") + 1] = _LOWER
    t[ord("A") : ord("Z") + 1] = _UPPER
    t[ord("0") : ord("9") + 1] = _DIGIT
    t[[9, 10, 11, 12, 13, 32]] = _SPACE
    t[list(b"#*$%&|<>")] = _SYMBOL
    t[ord("!")] = _BANG
    t[0x80:0xC0] = _TAIL
    t[0xC0:] = _LEAD
    return t


_CLASS = _classes()
_MIX = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS = np.empty(0, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 1 << 16), _BASE, np.uint64)
        p[0] = 1
        _POWERS = np.cumprod(p, dtype=np.uint64)
    return _POWERS[:n]


def _span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Hashes of byte spans, equal for equal bytes wherever they lie (modulo 2**64)."""
    with np.errstate(over="ignore"):
        return (prefix[end] - prefix[start]) * _powers(n + 1)[n - start]


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of some documents, bytes per line, lines per document."""
    raw = np.frombuffer(("\n".join(texts) + "\n").encode("utf-8", "replace"), np.uint8)
    per_doc = np.array([t.count("\n") + 1 for t in texts], np.int64)
    n = len(raw)
    breaks = np.flatnonzero(raw == 10)
    start = np.concatenate([[0], breaks[:-1] + 1])
    size = breaks - start
    lines = len(breaks)
    doc = np.repeat(np.arange(len(texts)), per_doc)
    of = np.repeat(np.arange(lines, dtype=np.int32), size + 1)
    kind = _CLASS[raw]
    count = np.stack([np.add.reduceat(kind == c, start, dtype=np.int64) for c in range(9)], 1).astype(np.float64)
    count[:, _SPACE] -= 1  # its own break

    with np.errstate(over="ignore"):
        prefix = np.zeros(n + 1, np.uint64)
        np.multiply(_MIX[raw], _powers(n), out=prefix[1:])
        np.cumsum(prefix[1:], out=prefix[1:])
    solid = kind != _SPACE
    edge = np.diff(solid.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    w0, w1 = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    word_line = of[w0]
    words = np.bincount(word_line, minlength=lines).astype(np.float64)
    h = _span_hash(prefix, w0, w1, n)
    again = np.zeros((2, lines))
    for k in (1, 2):
        same = (h[k:] == h[:-k]) & (word_line[k:] == word_line[:-k])
        again[k - 1] = np.bincount(word_line[k:][same], minlength=lines)
    line_hash = _span_hash(prefix, start, breaks, n)
    key = np.stack([doc.astype(np.uint64), line_hash])
    order = np.lexsort(key[::-1])
    eq = (key[:, order[1:]] == key[:, order[:-1]]).all(0)
    dup = np.zeros(lines, bool)
    dup[order[1:][eq]] = True
    dup[order[:-1][eq]] = True
    dup &= words > 0

    chars = np.maximum(1, size - count[:, _TAIL])
    letters = np.maximum(1, count[:, _LOWER] + count[:, _UPPER] + count[:, _LEAD])
    w = np.maximum(1, words)
    own = np.stack([
        np.log1p(words), np.log1p(chars), count[:, _UPPER] / letters, count[:, _DIGIT] / chars, count[:, _SYMBOL] / chars,
        count[:, _BANG] / chars, count[:, _PUNCT] / chars, np.minimum(chars / w, 40) / 10, count[:, _SPACE] / chars,
        count[:, _LEAD] / chars, again[0] / w, again[1] / w, dup.astype(float), (words == 0).astype(float),
    ], 1)
    first = np.zeros(lines, bool)
    first[np.cumsum(per_doc) - per_doc] = True
    last = np.zeros(lines, bool)
    last[np.cumsum(per_doc) - 1] = True
    near = own[:, [2, 4, 5, 10, 11, 12]]
    before = np.where(first[:, None], 0, np.roll(near, 1, 0))
    after = np.where(last[:, None], 0, np.roll(near, -1, 0))
    return np.concatenate([own, before, after, first[:, None], last[:, None]], 1), size + 1, per_doc


class Chain:
    """Two-state chain: ``weight`` and ``bias`` for good over bad, ``step`` for neighbours."""

    def __init__(self, mean, std, weight, bias, step, constant=None):
        self.mean, self.std, self.weight, self.bias, self.step, self.constant = mean, std, weight, bias, step, constant

    def unary(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.std, -8, 8) @ self.weight + self.bias

    def marginals(self, u: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
        """Probability of good for each line; ``u`` laid end to end by document."""
        out = np.empty(len(u))
        for rows in _by_length(per_doc):
            pad, mask = _padded(u, per_doc, rows)
            p, _, _ = _forward_backward(pad, mask, self.step)
            out[_places(per_doc, rows, mask)] = p[mask]
        return out


def _by_length(per_doc: np.ndarray) -> list[np.ndarray]:
    """Chains of like lengths, at most ``CHAIN_STEP`` padded places at a time."""
    level = np.ceil(np.log2(np.maximum(per_doc, 1))).astype(int)
    out = []
    for k in np.unique(level):
        rows, most = np.flatnonzero(level == k), max(1, CHAIN_STEP >> int(k))
        out += [rows[i : i + most] for i in range(0, len(rows), most)]
    return out


def _places(per_doc: np.ndarray, rows: np.ndarray, mask: np.ndarray) -> np.ndarray:
    begin = (np.cumsum(per_doc) - per_doc)[rows]
    return (begin[:, None] + np.arange(mask.shape[1]))[mask]


def _padded(u: np.ndarray, per_doc: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = per_doc[rows]
    mask = np.arange(n.max()) < n[:, None]
    pad = np.zeros(mask.shape)
    pad[mask] = u[_places(per_doc, rows, mask)]
    return pad, mask


def _forward_backward(u: np.ndarray, mask: np.ndarray, step: np.ndarray):
    """Marginals of good, expected neighbour pairs, and the log of the normaliser, for padded chains."""
    rows, n = u.shape
    e = np.exp(step)
    # Scaled in probability space: per place (1, exp(u)) divided by its larger entry.
    top = np.maximum(u, 0)
    psi = np.stack([np.exp(-top), np.exp(u - top)], 2)
    alpha, scale = np.empty((rows, n, 2)), np.ones((rows, n))
    a = psi[:, 0]
    for k in range(n):
        if k:
            a = np.where(mask[:, k, None], (alpha[:, k - 1] @ e) * psi[:, k], alpha[:, k - 1])
        s = a.sum(1)
        scale[:, k] = s
        alpha[:, k] = a / s[:, None]
    beta = np.ones((rows, n, 2))
    for k in range(n - 2, -1, -1):
        b = (beta[:, k + 1] * psi[:, k + 1]) @ e.T
        beta[:, k] = np.where(mask[:, k + 1, None], b / b.sum(1, keepdims=True), beta[:, k])
    post = alpha * beta
    post /= post.sum(2, keepdims=True)
    both = mask[:, 1:]
    pair = alpha[:, :-1, :, None] * e * (psi[:, 1:] * beta[:, 1:])[:, :, None, :]
    pair /= np.maximum(pair.sum((2, 3), keepdims=True), 1e-300)
    logz = (np.log(scale) * mask).sum() + (top * mask).sum()
    return post[:, :, 1], (pair * both[:, :, None, None]).sum((0, 1)), logz


def fit(texts: list[str], labels: list[int], rounds: int = 120, rate: float = 0.15, shrink: float = 1e-3) -> Chain:
    """Maximum likelihood with a small L2 penalty, by Adam over the full batch."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Chain(0.0, 1.0, np.zeros(1), 0.0, np.zeros((2, 2)), constant=float(y.mean()) if len(y) else 1.0)
    # Features are of documents by themselves; computed a piece at a time and kept in four bytes each,
    # neither the byte arrays of all texts nor two copies of all features are ever held at once.
    texts, parts, per_doc, k = [t or "" for t in texts], [], [], 0
    while k < len(texts):
        j, size = k, 0
        while j < len(texts) and (size < FIT_STEP or j == k):
            size += len(texts[j])
            j += 1
        x, _, n = line_features(texts[k:j])
        parts.append(x.astype(np.float32))
        per_doc.append(n)
        k = j
    per_doc = np.concatenate(per_doc)
    lines = int(per_doc.sum())
    mean = sum(x.sum(0, dtype=float) for x in parts) / lines
    std = np.maximum(np.sqrt(sum(((x - mean) ** 2).sum(0) for x in parts) / lines), 1e-3)
    z, k = np.empty((lines, len(mean)), np.float32), 0
    for at, x in enumerate(parts):
        z[k : k + len(x)] = np.clip((x - mean) / std, -8, 8)
        k, parts[at] = k + len(x), None
    good = np.repeat(y, per_doc)
    chains = np.concatenate([[*[TRAIN_LINES] * (n // TRAIN_LINES), *([n % TRAIN_LINES] if n % TRAIN_LINES else [])] for n in per_doc]).astype(np.int64)
    # Each chain counts as one document, however long.
    share = np.repeat(1.0 / chains, chains)
    groups = [(rows, _padded(np.zeros(len(z)), chains, rows)[1]) for rows in _by_length(chains)]
    theta = np.zeros(z.shape[1] + 1 + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        w, b, step = theta[:-5], theta[-5], theta[-4:].reshape(2, 2)
        u = (z @ w.astype(np.float32)).astype(float) + b
        miss, pairs = np.empty(len(u)), np.zeros((2, 2))
        for rows, mask in groups:
            at = _places(chains, rows, mask)
            pad = np.zeros(mask.shape)
            pad[mask] = u[at]
            p, expected, _ = _forward_backward(pad, mask, step)
            miss[at] = good[at] - p[mask]
            g = np.zeros(mask.shape, int)
            g[mask] = good[at].astype(int)
            seen = np.zeros((2, 2))
            np.add.at(seen, (g[:, :-1][mask[:, 1:]], g[:, 1:][mask[:, 1:]]), 1)
            pairs += seen - expected
        grad = np.concatenate([(miss * share).astype(np.float32) @ z, [(miss * share).sum()], pairs.ravel() * share.mean()]) / len(chains) * 10 - shrink * theta
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) * (1 if t < rounds * 0.6 else 0.3)
    return Chain(mean, std, theta[:-5], theta[-5], theta[-4:].reshape(2, 2))


def score_texts(model: Chain, texts: list[str]) -> np.ndarray:
    """Quality of each text: the length-weighted mean of its lines' marginals."""
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    out, k = [], 0
    while k < len(texts):
        j, size = k, 0
        while j < len(texts) and (size < STEP or j == k):
            size += len(texts[j])
            j += 1
        x, size_of, per_doc = line_features(texts[k:j])
        p = model.marginals(model.unary(x), per_doc)
        doc = np.repeat(np.arange(j - k), per_doc)
        out.append(np.bincount(doc, p * size_of, j - k) / np.bincount(doc, size_of, j - k))
        k = j
    return np.clip(np.concatenate(out), 0, 1) if out else np.empty(0)


def held_out(id_col: Column) -> Column:
    """Rows kept out of training: checksum of the id's text leaves 1 by 3."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def fit_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> Chain:
    """Fit on at most ``train_docs`` labelled rows outside the held-out third, and ``train_bytes`` of their texts."""
    known = labels.where(~held_out(F.col(id_col)) & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y"))
    sample = known.orderBy(F.xxhash64("_id"), "_id", "_y").limit(train_docs)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(sample), "_id")
    # Rows of one id count each; what is left after the cut by bytes is at most ``train_docs`` texts.
    texts = texts.withColumn("_n", F.coalesce(F.octet_length("_t"), F.lit(0)))
    order = [F.xxhash64("_id"), F.col("_id"), F.col("_y"), F.xxhash64("_t")]
    sizes = texts.orderBy(*order).limit(train_docs).select("_id", "_y", F.xxhash64("_t").alias("_h"), "_n").collect()
    chosen, left = set(), train_bytes
    for r in sizes:
        if r["_n"] <= left:
            left -= r["_n"]
            chosen.add((r["_id"], r["_y"], r["_h"]))
    if not chosen:
        return fit([], [])
    kinds = texts.select("_id", "_y", F.xxhash64("_t").alias("_h")).schema
    taken = docs.sparkSession.createDataFrame(sorted(chosen), kinds).withColumnRenamed("_h", "_k")
    rows = texts.withColumn("_k", F.xxhash64("_t")).join(F.broadcast(taken), ["_id", "_y", "_k"]).dropDuplicates(["_id", "_y", "_k"]).select("_id", "_t", "_y").collect()
    rows.sort(key=lambda r: (r["_id"], r["_y"], r["_t"] or ""))
    return fit([r["_t"] or "" for r in rows], [r["_y"] for r in rows])


def score_documents(docs: DataFrame, model: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("line_crf")
        for big in batches:
            for k in range(0, big.num_rows, 1024):
                b = big.slice(k, 1024)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score_texts(model, [t or "" for t in b.column(1).to_pylist()]))], [id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, score double")


def keep_good(docs: DataFrame, model: Chain, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose text scores ``least`` or more."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("line_crf")
        for big in batches:
            for k in range(0, big.num_rows, 1024):
                b = big.slice(k, 1024)
                yield b.filter(pa.array(score_texts(model, [t or "" for t in b.column(at).to_pylist()]) >= least))

    return docs.mapInArrow(run, docs.schema)
