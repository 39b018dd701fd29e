"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as two vectors: one of its own, by hash, and the mean of those of its character four-grams, so
that spellings and endings never seen still tell. Both directions read windows of words that overlap; attention
pools the states of a window into one logit. Every window of every whole text is scored, and a text's score
is that of its worst window.

Training takes a bounded sample of labelled rows: ``Settings.sample`` of each label, chosen by the hash of their id,
and of a text of more than ``Settings.longest`` characters as many from eight stretches spread over it. A toxic text need not be toxic throughout,
so its most suspicious windows stand for it; suspicion, which also starts the embeddings, is how much more
often a word or four-gram occurs in toxic training texts.
"""

from __future__ import annotations

import dataclasses

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scratch import Scratch
from .shingles import _INVERSE, _M, _powers
from .tables import keep_rows, map_rows


@dataclasses.dataclass(frozen=True)
class Settings:
    window: int = 96
    stride: int = 72
    hidden: int = 8
    dim: int = 8
    bits: int = 15
    sample: int = 1500
    longest: int = 40_000
    steps: int = 320
    batch: int = 128
    rate: float = 0.01
    seed: int = 5


#: Bytes of text that one pass of the tokenizer takes. A longer text is cut between windows, which stay those of the
#: whole text; only a run of letters that is longer itself counts as several words.
CHUNK = 1 << 18
STRETCHES = 8
_LETTER = np.zeros(256, bool)
_LETTER[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_LETTER[0x80:] = True


class Words:
    """Words of a run of bytes: hashes, places, and the four-grams of the distinct ones."""

    def __init__(self, data: bytes):
        buf = np.frombuffer(b" " + data + b"  ", np.uint8)
        letter = _LETTER[buf]
        buf = np.where(letter, buf, np.uint8(32))
        edge = np.diff(letter.astype(np.int8))
        self.start, self.end = np.nonzero(edge == 1)[0] + 1, np.nonzero(edge == -1)[0] + 1
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _powers(len(buf), _M))])
            hashed = (sums[self.end] - sums[self.start]) * _powers(len(buf), _INVERSE)[self.start]
            hashed ^= hashed >> np.uint64(32)
            hashed *= np.uint64(0xD6E8FEB86659FD93)
        self.distinct, first, self.word = np.unique(hashed, return_index=True, return_inverse=True)
        a, n = self.start[first] - 1, self.end[first] - self.start[first] - 1  # four-grams with one edge at either side
        n = np.maximum(n, 0)
        self.grams_of = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(a - self.grams_of[:-1], n) + np.arange(self.grams_of[-1])
        wide = buf.astype(np.uint32)
        with np.errstate(over="ignore"):
            self.grams = (wide[at] | wide[at + 1] << 8 | wide[at + 2] << 16 | wide[at + 3] << 24) * np.uint32(0x9E3779B1)


def pieces(text: str, s: Settings) -> list[bytes]:
    """The text's bytes, lower case, in runs whose windows together are those of the whole text."""
    data, out, at = text.lower().encode("utf-8", "replace"), [], 0
    while len(data) - at > CHUNK:
        letter = np.concatenate([[False], _LETTER[np.frombuffer(data, np.uint8, CHUNK, at)], [False]])
        edge = np.diff(letter.astype(np.int8))
        start, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        whole = len(end) - bool(letter[-2])  # words that end inside this part
        windows = (whole - s.window) // s.stride + 1
        if windows > 0:
            out.append(data[at : at + end[(windows - 1) * s.stride + s.window - 1]])
            at += int(start[windows * s.stride])
        else:  # fewer words than a window: some are longer than all windows should be
            out.append(data[at : at + CHUNK])
            at += CHUNK
    return [*out, data[at:]]


def window_starts(n: int, s: Settings) -> np.ndarray:
    """Starts of windows over n words; the last one reaches the end."""
    return np.arange(0, max(1, n - s.window + s.stride), s.stride) if n > s.window else np.zeros(1, int)


class Net:
    """Parameters and passes of the network."""

    def __init__(self, s: Settings, params: dict[str, np.ndarray] | None = None):
        self.s = s
        if params is None:
            rng = np.random.default_rng(s.seed)
            h, d = s.hidden, 2 * s.dim
            g = lambda *shape, by=0.3: (rng.standard_normal(shape) * by).astype(np.float32)
            params = {
                "word": g(1 << s.bits, s.dim, by=0.02), "gram": g(1 << s.bits, s.dim, by=0.02),
                "x": g(d, 6 * h), "bx": np.zeros(6 * h, np.float32), "u0": g(h, 3 * h), "u1": g(h, 3 * h),
                "a": g(2 * h, h), "ba": np.zeros(h, np.float32), "va": g(h, by=1.0), "out": g(2 * h, by=0.5), "bo": np.full(1, -1, np.float32),
            }
        self.p = params

    def inputs(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs of the distinct words, and the rows of both tables that they come from."""
        shift = np.uint64(64 - self.s.bits)
        own, grams = (words.distinct >> shift).astype(np.int64), (words.grams >> np.uint32(32 - self.s.bits)).astype(np.int64)
        n = np.diff(words.grams_of)
        mean = np.zeros((len(own), self.s.dim), np.float32)
        some = n > 0
        if some.any():
            mean[some] = np.add.reduceat(self.p["gram"][grams], words.grams_of[:-1][some], axis=0) / n[some, None]
        return np.concatenate([self.p["word"][own], mean], 1), own, grams

    def direction(self, k: int, xp: np.ndarray, mask: np.ndarray, keep: bool):
        """States (T, B, H) of one direction; xp (T, B, 3H) are projected inputs."""
        h3, hid = xp.shape[2], xp.shape[2] // 3
        steps = range(len(xp)) if k == 0 else range(len(xp) - 1, -1, -1)
        u, h = self.p[f"u{k}"], np.zeros((xp.shape[1], hid), np.float32)
        out, kept = np.empty((*xp.shape[:2], hid), np.float32), {}
        for t in steps:
            hu = h @ u
            rz = np.tanh((xp[t, :, : 2 * hid] + hu[:, : 2 * hid]) * 0.5) * 0.5 + 0.5
            r, z = rz[:, :hid], rz[:, hid:]
            n = np.tanh(xp[t, :, 2 * hid : h3] + r * hu[:, 2 * hid :])
            new = n + z * (h - n)
            if keep:
                kept[t] = (h, r, z, n, hu[:, 2 * hid :])
            h = new if mask[t].all() else np.where(mask[t][:, None], new, h)
            out[t] = h
        return out, kept

    def attend(self, states: np.ndarray, mask: np.ndarray):
        e = np.tanh(states @ self.p["a"] + self.p["ba"])
        score = np.where(mask, e @ self.p["va"], np.float32(-1e9))
        w = np.exp(score - score.max(0))
        w /= w.sum(0)
        pooled = np.einsum("tb,tbh->bh", w, states)
        return pooled @ self.p["out"] + self.p["bo"][0], pooled, w, e

    def logits(self, projected: np.ndarray, index: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Of windows given as rows (B, T) of projected distinct words."""
        half = projected.shape[1] // 2
        at, m = index.T, mask.T
        xp = projected[at]
        states = np.concatenate([self.direction(k, xp[:, :, k * half : (k + 1) * half], m, False)[0] for k in (0, 1)], 2)
        return self.attend(states, m)[0]

    def gradients(self, words: Words, index: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p, hid = self.p, self.s.hidden
        x, own, grams = self.inputs(words)
        projected = x @ p["x"] + p["bx"]
        at, m = index.T, mask.T
        xp = projected[at]
        runs = [self.direction(k, xp[:, :, 3 * hid * k : 3 * hid * (k + 1)], m, True) for k in (0, 1)]
        states = np.concatenate([r[0] for r in runs], 2)
        logit, pooled, w, e = self.attend(states, m)
        prob = 1 / (1 + np.exp(-logit))
        loss = float(-np.mean(np.where(y, np.log(prob + 1e-7), np.log(1 - prob + 1e-7))))
        dl = ((prob - y) / len(y)).astype(np.float32)
        g = {"out": pooled.T @ dl, "bo": dl.sum(keepdims=True)}
        dpool = dl[:, None] * p["out"]
        ds = w[:, :, None] * dpool
        dw = np.einsum("bh,tbh->tb", dpool, states)
        dscore = w * (dw - (w * dw).sum(0))
        g["va"] = np.einsum("tb,tbh->h", dscore, e)
        de = dscore[:, :, None] * p["va"] * (1 - e * e)
        g["a"], g["ba"] = np.einsum("tbi,tbj->ij", states, de), de.sum((0, 1))
        ds += de @ p["a"].T
        dxp = np.zeros_like(xp)
        for k in (0, 1):
            u, kept, du = p[f"u{k}"], runs[k][1], np.zeros_like(p[f"u{k}"])
            carry = np.zeros((xp.shape[1], hid), np.float32)
            steps = range(len(xp) - 1, -1, -1) if k == 0 else range(len(xp))
            for t in steps:
                h, r, z, n, hun = kept[t]
                dh = ds[t, :, k * hid : (k + 1) * hid] + carry
                mt = m[t][:, None]
                dn_, carry = np.where(mt, dh, 0), np.where(mt, 0, dh)
                dz, dn = dn_ * (h - n), dn_ * (1 - z)
                dnp = dn * (1 - n * n)
                dhu = np.concatenate([dnp * hun * r * (1 - r), dz * z * (1 - z), dnp * r], 1)
                carry = carry + dn_ * z + dhu @ u.T
                du += h.T @ dhu
                dxp[t, :, 3 * hid * k : 3 * hid * (k + 1)] = np.concatenate([dhu[:, : 2 * hid], dnp], 1)
            g[f"u{k}"] = du
        dproj = np.zeros_like(projected)
        np.add.at(dproj, at.ravel(), dxp.reshape(-1, dxp.shape[2]))
        g["x"], g["bx"] = x.T @ dproj, dproj.sum(0)
        dx = dproj @ p["x"].T
        g["word"] = (own, dx[:, : self.s.dim])
        n = np.diff(words.grams_of)
        g["gram"] = (grams, np.repeat(dx[:, self.s.dim :] / np.maximum(n, 1)[:, None], n, axis=0))
        return loss, g


def _suspicion(texts: list[Words], y: np.ndarray, bits: int, of) -> np.ndarray:
    """For each hash bucket, how far its share of toxic texts lies above that of clean ones, in deviations."""
    counts = np.zeros((2, 1 << bits))
    for w, label in zip(texts, y, strict=True):
        counts[int(label), np.unique(of(w))] += 1
    n = np.maximum(np.bincount(y.astype(int), minlength=2), 1)
    share, both = counts / n[:, None], counts.sum(0) / n.sum()
    z = (share[1] - share[0]) / np.sqrt(both * (1 - both) * (1 / n[0] + 1 / n[1]) + 1e-4)
    return np.clip(z / 5, -1, 1).astype(np.float32)


def train(texts: list[str], labels: list[int], s: Settings = Settings()) -> Net | None:
    """The trained network; None where the labels hold fewer than two classes."""
    y = np.array(labels, bool)
    if y.all() or not y.any():
        return None
    shift = np.uint64(64 - s.bits)
    own, grams = (lambda w: (w.distinct >> shift).astype(np.int64)), (lambda w: (w.grams >> np.uint32(32 - s.bits)).astype(np.int64))
    kept = [(Words(t.lower().encode("utf-8", "replace")), v) for t, v in zip(texts, y, strict=True)]
    kept = [(w, v) for w, v in kept if len(w.word)]
    every, y = [w for w, _ in kept], np.array([v for _, v in kept])
    if y.all() or not y.any():
        return None
    net = Net(s)
    by_word, by_gram = _suspicion(every, y, s.bits, own), _suspicion(every, y, s.bits, grams)
    net.p["word"][:, 0], net.p["gram"][:, 0] = by_word, by_gram
    windows = []
    rng = np.random.default_rng(s.seed)
    for k, (w, label) in enumerate(zip(every, y, strict=True)):
        n = np.diff(w.grams_of)
        peak = np.zeros(len(n), np.float32)
        if len(w.grams):
            peak[n > 0] = np.maximum.reduceat(by_gram[grams(w)], w.grams_of[:-1][n > 0])
        doubt = (by_word[own(w)] + peak)[w.word]
        starts = window_starts(len(w.word), s)
        top = np.array([np.sort(doubt[a : a + s.window])[-2:].sum() for a in starts])
        order = np.argsort(-top, kind="stable")
        chosen = order[:2] if label else np.unique(np.concatenate([order[:2], rng.integers(0, len(starts), 2)]))
        windows += [(k, starts[c], label) for c in chosen if not label or top[c] >= 0.5 * top[order[0]]]
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step, turn = 0, np.zeros(0, int)
    while step < s.steps:
        rate, turn = s.rate * (1 - step / s.steps), turn if len(turn) else rng.permutation(len(windows))
        if len(turn):
            part, turn = [windows[i] for i in turn[: s.batch]], turn[s.batch :]
            words, index, mask = _join([(every[k], a) for k, a, _ in part], s)
            for i, (_, _, label) in enumerate(part):
                if not label and rng.random() < 0.1:  # one clean word over and over is clean
                    index[i, mask[i]] = rng.choice(index[i, mask[i]])
            _, g = net.gradients(words, index, mask, np.array([v for _, _, v in part]))
            step += 1
            for name, grad in g.items():
                m, v = state[name]
                if isinstance(grad, tuple):  # rows of a table
                    rows, at = np.unique(grad[0], return_inverse=True)
                    total = np.zeros((len(rows), s.dim), np.float32)
                    np.add.at(total, at, grad[1])
                    m[rows], v[rows] = 0.9 * m[rows] + 0.1 * total, 0.999 * v[rows] + 0.001 * total**2
                    net.p[name][rows] -= rate * (m[rows] / (1 - 0.9**step)) / (np.sqrt(v[rows] / (1 - 0.999**step)) + 1e-6)
                else:
                    m[:], v[:] = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
                    net.p[name] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
    # a text's score is its worst window's: logits are scaled by a logistic fit over whole training texts
    worst = np.array(score_texts(net, texts, raw=True))
    x, y = np.clip(worst, -20, 20), np.array(labels, float)
    near = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's method on two numbers
        q = 1 / (1 + np.exp(-(a * x + b)))
        w = q * (1 - q) + 1e-6
        grad = np.array([((near - q) * x).sum() - 0.01 * (a - 1), (near - q).sum()])
        hess = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum()]])
        da, db = np.linalg.solve(hess, grad)
        a, b = a + np.clip(da, -1, 1), b + np.clip(db, -5, 5)
    if a > 0:
        net.p["scale"] = np.array([a, b])
    return net


def _join(parts: list[tuple[Words, int]], s: Settings) -> tuple[Words, np.ndarray, np.ndarray]:
    """Windows of several texts over one table of distinct words."""
    out = object.__new__(Words)
    distinct, grams, counts, rows, base = [], [], [], [], 0
    for w, a in parts:
        used, at = np.unique(w.word[a : a + s.window], return_inverse=True)
        n = np.diff(w.grams_of)[used]
        first = np.repeat(w.grams_of[used] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        distinct.append(w.distinct[used])
        grams.append(w.grams[first])
        counts.append(n)
        rows.append(at + base)
        base += len(used)
    out.distinct, out.grams = np.concatenate(distinct), np.concatenate(grams)
    out.grams_of = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    index, mask = np.zeros((len(rows), s.window), np.int64), np.zeros((len(rows), s.window), bool)
    for i, r in enumerate(rows):
        index[i, : len(r)], mask[i, : len(r)] = r, True
    return out, index, mask


def score_texts(net: Net, texts: list[str | None], block: int = 1024, raw: bool = False) -> list[float]:
    """The highest window probability of each text, 0 for a text without words; or its raw logit."""
    s, best = net.s, np.full(len(texts), -np.inf)
    held: list[tuple[int, bytes]] = []

    def settle() -> None:
        # one buffer for many texts: words of a text are those that start within its bytes
        data = b"\n".join(d for _, d in held)
        w = Words(data)
        if not len(w.word):
            return
        projected = net.inputs(w)[0] @ net.p["x"] + net.p["bx"]
        edges = np.cumsum([0, *(len(d) + 1 for _, d in held)]) + 1
        cuts = np.searchsorted(w.start, edges)
        starts, ends, owner = [], [], []
        for (k, _), a, b in zip(held, cuts[:-1], cuts[1:], strict=True):
            if b > a:
                at = a + window_starts(b - a, s)
                starts.append(at)
                ends.append(np.minimum(at + s.window, b))
                owner.append(np.full(len(at), k))
        starts, ends, owner = np.concatenate(starts), np.concatenate(ends), np.concatenate(owner)
        order = np.argsort(ends - starts, kind="stable")
        for c in range(0, len(order), block):
            own = order[c : c + block]
            size = ends[own] - starts[own]
            steps = np.arange(size.max())
            mask = steps < size[:, None]
            index = w.word[np.where(mask, starts[own][:, None] + steps, starts[own][:, None])]
            np.maximum.at(best, owner[own], net.logits(projected, index, mask))

    size = 0
    for k, text in enumerate(texts):
        for piece in pieces(text, s) if text else ():
            held.append((k, piece))
            size += len(piece)
            if size >= CHUNK:
                settle()
                held, size = [], 0
    if held:
        settle()
    if raw:
        return best.tolist()
    a, b = net.p.get("scale", (1.0, 0.0))
    return [0.0 if x == -np.inf else float(1 / (1 + np.exp(-np.clip(a * x + b, -500, 500)))) for x in best]


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Net | None:
    """Train on the bounded sample of labelled rows that aren't held out."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).filter(F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).filter("y = most")
    # labels are drawn before texts are read, with some to spare for texts that are missing
    drawn = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(4 * s.sample) for y in (1, 0)]
    scratch = Scratch(docs.sparkSession, "toxicity")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).filter(F.length("text") > 0)
    # of a long text as many characters in stretches from its first to its last
    size, step = s.longest // STRETCHES, (F.length("text") - s.longest // STRETCHES) / F.lit(STRETCHES - 1)
    parts = F.concat_ws(" ", *[F.substring("text", F.floor(step * i).cast("int") + 1, F.lit(size)) for i in range(STRETCHES)])
    texts = texts.select("id", F.when(F.length("text") <= s.longest, F.col("text")).otherwise(parts).alias("text"))
    drawn = scratch.write(drawn[0].union(drawn[1]).select("id", "y"), "drawn")
    # at most 8 * sample rows of two numbers
    found = scratch.write(texts.join(F.broadcast(drawn), "id"), "texts")
    rows = []
    for y in (1, 0):
        rows += found.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id", "text").limit(s.sample).collect()
    scratch.drop(drawn, found)
    return train([r.text for r in rows], [r.y for r in rows], s)


def scorer(docs: DataFrame, net: Net | None):
    """A function from texts to scores, its parameters sent to every task once."""
    sent = docs.sparkSession.sparkContext.broadcast((net.s, net.p) if net else None)
    return lambda texts: score_texts(Net(*sent.value), texts) if sent.value else [0.0] * len(texts)


def score_toxicity(docs: DataFrame, net: Net | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, held_out, score and predicted for every row.

    A null or empty text, or one without words, scores 0; so does every text if there was nothing to learn from. A
    text of any length is scored whole. Repeated rows score alike and stay, a score of exactly 0.5 is toxic, an empty
    table gives an empty result, other columns are never inputs and may have any names.
    """
    kinds, score = dict(docs.dtypes), scorer(docs, net)
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = map_rows(slim, lambda cols: [{"id": cols["id"], "score": score(cols["text"])}], f"id {kinds[id_col]}, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean_rows(docs: DataFrame, net: Net | None, *, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns whatever their names, that score below 0.5; nothing is shuffled.

    Nulls, empty, long and repeated texts, and empty tables, as in ``score_toxicity``.
    """
    score = scorer(docs, net)
    return keep_rows(docs, text_col, lambda texts: [x < 0.5 for x in score(texts)])


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_toxicity(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
