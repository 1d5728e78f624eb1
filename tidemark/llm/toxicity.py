"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy, over all overlapping windows.

A text becomes words (white space cuts, lower case; longer than PART characters are cut into parts, so
that every character is read). A word's input joins a hashed word vector with the mean of hashed vectors
of its character n-grams. Windows of WINDOW words begin every STRIDE words; in each, two gated recurrent
units read forwards and backwards, attention pools their states, and the pooled state gives a logit. A
text's score is the calibrated logistic of its highest window.

Training: a document's label holds for at least one of its windows. Windows are first chosen by the
log-odds of their n-grams, and later by the network itself; the fit ends with a logistic calibration.
It uses at most MOST_TOXIC + MOST_CLEAN labelled documents of at most FIT_CHARS characters, chosen by hash:
this bounds the fit alone. Scoring reads whole texts, and only texts.

Cases: null, empty and blank texts get the score of an empty window; very long texts are scored in pieces that share
windows' words; a score of `reject` itself is rejected; rows whose label is null don't train;
without labelled rows of both kinds every score is the known share of toxic rows (0 without any); repeated
rows give repeated rows; an empty table gives an empty result; other columns are carried by `without_toxic`.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import is_held_out, over_batches, prepare, texts

WINDOW, STRIDE, PART = 32, 16, 24
WORDS, GRAMS = 1 << 15, 1 << 15
DIM, HIDDEN = 8, 8
#: Bytes of the n-grams; a word with its edges has three at least.
SIZES = (3, 4, 5)
MOST_TOXIC, MOST_CLEAN, FIT_CHARS = 1_200, 3_000, 8_000
EPOCHS, BATCH, RATE, DROP = 10, 128, 0.01, 0.4
#: Share of the clean documents that also give a window of one short run repeated.
REPEAT = 0.4
SEED = 11
REJECT = 0.3
#: Distinct words a worker remembers (17 numbers each), but for those of the last windows.
REMEMBERED = 150_000
#: Words whose n-grams are handled at a time.
CHUNK = 2_048
#: Windows whose words are looked up at a time, and those that are scored at a time.
BLOCK, SIDE = 2_048, 1_024


def words_of(text: str) -> list[str]:
    out = text.lower().split()
    if len(text) > PART and max(map(len, out), default=0) > PART:
        out = [w[i : i + PART] for w in out for i in range(0, len(w), PART)]
    return out


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte n-grams (n in SIZES) of words with their edges marked: all words' in a row, and how many each has."""
    if len(words) > CHUNK:
        parts = [grams_of(words[a : a + CHUNK]) for a in range(0, len(words), CHUNK)]
        return np.concatenate([g for g, _ in parts]), np.concatenate([n for _, n in parts])
    raw = [w.encode() for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw)) + 2
    flat = np.frombuffer(b"\x02" + b"\x03\x02".join(raw) + b"\x03", np.uint8).astype(np.uint64)
    each = [np.maximum(size - n + 1, 0) for n in SIZES]
    many = sum(each)
    end, place = np.repeat(np.cumsum(size), size), np.cumsum(many) - many - (np.cumsum(size) - size)  # where a word's n-grams go, less where its bytes are
    at, out = np.arange(len(flat)), np.empty(many.sum(), np.int32)
    h = flat + np.uint64(1)
    for n in range(2, max(SIZES) + 1):
        h = h[:-1] * np.uint64(0x100000001B3) + flat[n - 1 :] + np.uint64(1)
        if n in SIZES:
            inside = at[: len(h)] + n <= end[: len(h)]
            own = each[SIZES.index(n)]
            x = h[inside] * np.uint64(0x9E3779B97F4A7C15)
            out[at[: len(h)][inside] + np.repeat(place, own)] = (x >> np.uint64(40)) % np.uint64(GRAMS)
            place = place + own
    return out, many


def word_of(word: str) -> int:
    return zlib.crc32(word.encode()) % (WORDS - 1) + 1


def word_ids_of(words: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words)) % (WORDS - 1) + 1


def window_starts(n: int) -> range:
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE)


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters by name; words and grams are embeddings, w? inputs, u? recurrences of a direction, a and v attention, o output."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        scale = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"words": np.zeros((WORDS, DIM), np.float32), "grams": np.zeros((GRAMS, DIM), np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": scale(2 * DIM, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32), f"u{d}": scale(HIDDEN, 3 * HIDDEN)}
        self.p |= {"a": scale(2 * HIDDEN, HIDDEN), "v": scale(HIDDEN), "o": scale(2 * HIDDEN), "b": np.full(1, -1, np.float32)}
        self.calibration = (1.0, 0.0)

    def inputs(self, word_ids: np.ndarray, grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(n, 2 * DIM): the inputs of words."""
        if len(sizes) > CHUNK:
            ends = np.concatenate([[0], np.cumsum(sizes)])
            return np.concatenate([self.inputs(word_ids[a : a + CHUNK], grams[ends[a] : ends[min(a + CHUNK, len(sizes))]], sizes[a : a + CHUNK]) for a in range(0, len(sizes), CHUNK)])
        mean = np.add.reduceat(self.p["grams"].take(grams, axis=0), np.cumsum(sizes) - sizes, axis=0) / sizes[:, None].astype(np.float32)
        return np.concatenate([self.p["words"][word_ids], mean], axis=1)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """(n, 6 * HIDDEN): what words add to the gates of both directions."""
        return np.concatenate([x @ self.p["wf"] + self.p["cf"], x @ self.p["wb"] + self.p["cb"]], axis=1)

    def forward(self, gates: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows from (n, t, 6 * HIDDEN) and (n, t)."""
        n, t, _ = gates.shape
        h2, h3 = 2 * HIDDEN, 3 * HIDDEN
        states = np.empty((n, t, h2), np.float32)
        m = mask.astype(np.float32)[:, :, None]
        for d, at in (("f", 0), ("b", 1)):
            u, h = self.p[f"u{d}"], np.zeros((n, HIDDEN), np.float32)
            for i in range(t) if not at else range(t - 1, -1, -1):
                g, old = gates[:, i, at * h3 : (at + 1) * h3], h
                q = old @ u
                zr = _sigmoid(g[:, :h2] + q[:, :h2])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(g[:, h2:] + r * q[:, h2:])
                h = (c + z * (old - c)) * m[:, i]
                states[:, i, at * HIDDEN : (at + 1) * HIDDEN] = h
                if keep is not None:
                    keep[d, i] = (old, q, z, r, c)
        k = np.tanh(states @ self.p["a"])
        e = np.where(mask, k @ self.p["v"], np.float32(-1e9))
        e = np.exp(e - e.max(axis=1, keepdims=True))
        alpha = e / e.sum(axis=1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", alpha, states)
        if keep is not None:
            keep |= {"states": states, "k": k, "alpha": alpha, "pooled": pooled, "m": m}
        return pooled @ self.p["o"] + self.p["b"][0]

    def backward(self, d_logit: np.ndarray, keep: dict, n: int, t: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of all but inputs, and of the gates."""
        g: dict[str, np.ndarray] = {}
        states, k, alpha, pooled, m = (keep[x] for x in ("states", "k", "alpha", "pooled", "m"))
        g["o"], g["b"] = pooled.T @ d_logit, np.array([d_logit.sum()], np.float32)
        d_pooled = d_logit[:, None] * self.p["o"]
        d_alpha = np.einsum("nh,nth->nt", d_pooled, states)
        d_states = alpha[:, :, None] * d_pooled[:, None, :]
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(axis=1, keepdims=True))
        g["v"] = np.einsum("nth,nt->h", k, d_e)
        d_k = d_e[:, :, None] * self.p["v"] * (1 - k * k)
        g["a"] = states.reshape(n * t, -1).T @ d_k.reshape(n * t, -1)
        d_states += d_k @ self.p["a"].T
        h2, h3 = 2 * HIDDEN, 3 * HIDDEN
        d_gates = np.zeros((n, t, 2 * h3), np.float32)
        for d, at in (("f", 0), ("b", 1)):
            u, d_u, ahead = self.p[f"u{d}"], np.zeros_like(self.p[f"u{d}"]), np.zeros((n, HIDDEN), np.float32)
            for i in range(t - 1, -1, -1) if not at else range(t):
                old, q, z, r, c = keep[d, i]
                dh = (d_states[:, i, at * HIDDEN : (at + 1) * HIDDEN] + ahead) * m[:, i]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (old - c) * z * (1 - z)
                dr = dc * q[:, h2:] * r * (1 - r)
                own = np.concatenate([dz, dr, dc], axis=1)
                dq = np.concatenate([dz, dr, dc * r], axis=1)
                d_u += old.T @ dq
                ahead = dh * z + dq @ u.T
                d_gates[:, i, at * h3 : (at + 1) * h3] = own
            g[f"u{d}"] = d_u
        return g, d_gates

    def probability(self, logit: np.ndarray) -> np.ndarray:
        a, b = self.calibration
        return 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))


class Vocabulary:
    """Scores windows by a network, and remembers the inputs of words; forgets all when full.

    Texts lie in a row as halves of STRIDE words, so that a window is a half and the next: a word is projected once for both windows that
    hold it, and both directions advance together, over arrays whose last axis is the windows. A window across two texts is dropped.
    """

    def __init__(self, network: Network):
        self.network, p = network, network.p
        w, u = np.empty((2, 3, HIDDEN, 2 * DIM + 1), np.float32), np.zeros((3, 2, HIDDEN, 2, HIDDEN), np.float32)
        for k, d in enumerate("fb"):
            w[k] = np.concatenate([p[f"w{d}"], p[f"c{d}"][None]]).T.reshape(w[k].shape)
            u[:, k, :, k] = p[f"u{d}"].T.reshape(3, HIDDEN, HIDDEN)
        w[:, :2] *= 0.5  # a gate's logistic is a hyperbolic tangent of half its input
        u *= 0.5  # likewise, and half of what the reset gate takes
        self.w, self.u = w.reshape(6 * HIDDEN, -1), u.reshape(6 * HIDDEN, -1)
        self.seen = np.concatenate([p["a"].T, p["o"][None]])
        self.inputs = np.zeros((1, 2 * DIM + 1), np.float32)  # the last is 1, for the constants; place 0 fills windows up
        self.forget()

    def forget(self) -> None:
        self.place: defaultdict[str, int] = defaultdict(count(1).__next__)  # a word looked up has a place from then on
        self.used = 1

    def learn(self) -> None:
        """The inputs of all words that have a place but none yet."""
        need = len(self.place) + 1
        if need == self.used:
            return
        new = list(islice(reversed(self.place), need - self.used))[::-1]
        if need > len(self.inputs):
            grown = np.zeros((max(need, min(2 * len(self.inputs), REMEMBERED)), 2 * DIM + 1), np.float32)
            grown[: self.used] = self.inputs[: self.used]
            self.inputs = grown
        for a in range(0, len(new), CHUNK):
            part = new[a : a + CHUNK]
            own = self.inputs[self.used + a : self.used + a + len(part)]
            own[:, :-1] = self.network.inputs(word_ids_of(part), *grams_of(part))
            own[:, -1] = 1
        self.used = need

    def logits(self, docs: Iterable[list[str]]) -> list[np.ndarray]:
        """Logits of each document's windows, in order."""
        out: list[list[np.ndarray]] = []
        owner, ids, halves = [], [], 0

        def flush() -> None:
            nonlocal halves
            self.learn()
            flat, at = np.zeros((halves, STRIDE), np.int64), 0
            for x, (_, n) in zip(ids, owner, strict=True):
                flat.reshape(-1)[at * STRIDE : at * STRIDE + len(x)] = x
                at += n + 1
            got, at = self.windows(flat), 0
            for k, n in owner:
                out[k].append(got[at : at + n])
                at += n + 1
            ids.clear()
            owner.clear()
            halves = 0
            if len(self.place) > REMEMBERED:
                self.forget()

        for k, words in enumerate(docs):
            out.append([])
            for piece in range(0, max(1, len(words)), BLOCK * STRIDE):  # long texts by pieces, so that memory stays bounded
                part = words[piece : piece + BLOCK * STRIDE + WINDOW - STRIDE] if len(words) > BLOCK * STRIDE else words
                if piece and len(part) <= WINDOW - STRIDE:
                    break  # its words are in the windows before
                ids.append(np.fromiter(map(self.place.__getitem__, part), np.int64, len(part)))
                owner.append((k, len(window_starts(len(part)))))
                halves += owner[-1][1] + 1
                if halves >= BLOCK:
                    flush()
        if ids:
            flush()
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]

    def windows(self, halves: np.ndarray) -> np.ndarray:
        """The logit of each half and the next, of (n, STRIDE) places of words."""
        n = len(halves) - 1
        parts = np.linspace(0, n, -(-n // SIDE) + 1).astype(int)
        return np.concatenate([self._windows(np.ascontiguousarray(halves[a : b + 1].T)) for a, b in zip(parts[:-1], parts[1:], strict=True)])

    def _windows(self, ids: np.ndarray) -> np.ndarray:
        n = ids.shape[1] - 1
        gates = np.empty((STRIDE, 2, 3, HIDDEN, n + 1), np.float32)
        for i in range(STRIDE):
            np.matmul(self.w, self.inputs.take(ids[i], axis=0).T, out=gates[i].reshape(6 * HIDDEN, n + 1))
        at = lambda i, d: gates[i % STRIDE, d, ..., i // STRIDE : n + i // STRIDE]
        states = np.empty((WINDOW, 2, HIDDEN, n), np.float32)
        q, h, x = np.empty((3, 2, HIDDEN, n), np.float32), np.zeros((2, HIDDEN, n), np.float32), np.empty((2, HIDDEN, n), np.float32)
        z, r, c = q
        for i in range(WINDOW):  # filled-up places have no input and leave a state of 0 as it is; those after the words are not attended to
            f, b = at(i, 0), at(WINDOW - 1 - i, 1)
            np.matmul(self.u, h.reshape(2 * HIDDEN, n), out=q.reshape(6 * HIDDEN, n))
            q[:2, 0] += f[:2]
            q[:2, 1] += b[:2]
            np.tanh(q[:2], out=q[:2])
            r += 1  # the half is in u
            c *= r
            c[0] += f[2]
            c[1] += b[2]
            np.tanh(c, out=c)
            z += 1
            z *= 0.5
            np.subtract(h, c, out=x)
            x *= z
            np.add(x, c, out=h)
            states[i, 0], states[WINDOW - 1 - i, 1] = h
        seen = np.matmul(self.seen, states.reshape(WINDOW, 2 * HIDDEN, n))
        k = seen[:, :HIDDEN]
        e = np.matmul(self.network.p["v"], np.tanh(k, out=k))
        for i in range(1, WINDOW):  # an empty window still has its first place
            e[i][ids[i % STRIDE, i // STRIDE : n + i // STRIDE] == 0] = -1e9
        e -= e.max(axis=0)
        np.exp(e, out=e)
        return (e * seen[:, HIDDEN]).sum(axis=0) / e.sum(axis=0) + self.network.p["b"][0]


def _filled(ids: np.ndarray) -> np.ndarray:
    """The windows of a document's words, filled up with -1."""
    starts = window_starts(len(ids))
    padded = np.full(starts[-1] + WINDOW, -1, np.int32)
    padded[: len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


def _logits(network: Network, inputs: np.ndarray, ids: np.ndarray) -> np.ndarray:
    gates = network.projected(inputs)
    return np.concatenate([network.forward(gates[ids[a : a + BLOCK]], ids[a : a + BLOCK] >= 0) for a in range(0, len(ids), BLOCK)])


def _summed(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """(n, columns): rows of values added up by `at`."""
    return np.stack([np.bincount(at, values[:, k], n) for k in range(values.shape[1])], axis=1).astype(np.float32)


def fit(rows: list[tuple[str, int]], seed: int = SEED) -> Network:
    """A network fitted to (text, label) rows; the same for the same rows and seed."""
    network, r = Network(seed), np.random.default_rng(seed)
    labels = np.array([y for _, y in rows])
    if not len(rows) or labels.min() == labels.max():
        share = float(labels.mean()) if len(rows) else 0.0
        network.calibration = (0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
        return network
    number: dict[str, int] = {}
    ids_of = [np.array([number.setdefault(w, len(number)) for w in words_of(t) or [""]], np.int32) for t, _ in rows]
    known = list(number)
    del number
    word_ids = np.array([word_of(w) for w in known])
    grams, sizes = grams_of(known)
    begin = np.cumsum(sizes) - sizes

    def own_grams(ids: np.ndarray) -> np.ndarray:
        n = sizes[ids]
        return grams[np.repeat(begin[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    seen_words, seen_grams = np.zeros((2, len(known))), np.zeros((2, GRAMS))
    for ids, y in zip(ids_of, labels, strict=True):
        own = np.unique(ids)
        seen_words[y, own] += 1
        seen_grams[y, np.unique(own_grams(own))] += 1
    n1, n0 = int(labels.sum()), int((1 - labels).sum())
    odds = lambda seen: np.log((seen[1] + 0.2) / (n1 + 0.4)) - np.log((seen[0] + 0.2) / (n0 + 0.4))
    evidence = np.maximum(odds(seen_words), np.maximum.reduceat(odds(seen_grams)[grams], begin))

    windows = [_filled(ids) for ids in ids_of]
    every, ends = np.concatenate(windows), np.cumsum([len(w) for w in windows])[:-1]
    cut = r.random(len(rows)) < 0.2  # left out for the calibration
    if not (labels[cut].any() and (1 - labels[cut]).any() and labels[~cut].any() and (1 - labels[~cut]).any()):
        cut[:] = False
    train = np.flatnonzero(~cut)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
    steps = 0
    for epoch in range(EPOCHS):
        if epoch < 2:
            strength = np.split(np.where(every >= 0, evidence[every], -9).max(axis=1), ends)
        else:
            strength = np.split(_logits(network, network.inputs(word_ids, grams, sizes), every), ends)
        chosen: list[tuple[np.ndarray, int]] = []
        for i in train:
            ws = windows[i]
            order = np.argsort(-np.asarray(strength[i]), kind="stable")
            if labels[i]:
                chosen += [(ws[order[0]], 1)] * 2
            else:
                chosen += [(ws[k], 0) for k in {*map(int, order[:2]), int(r.integers(len(ws)))}]
                if r.random() < REPEAT:  # a few words over and over are no more than once
                    own, n = ids_of[i], int(r.integers(1, 9))
                    at = int(r.integers(max(1, len(own) - n)))
                    chosen.append((np.resize(own[at : at + n], WINDOW), 0))
        r.shuffle(chosen)
        for a in range(0, len(chosen), BATCH):
            part = chosen[a : a + BATCH]
            y = np.array([c for _, c in part], np.float32)
            ids = np.array([w for w, _ in part])
            mask = ids >= 0
            local, at = np.unique(ids[mask], return_inverse=True)
            local_grams, local_sizes = own_grams(local), sizes[local]
            x = network.inputs(word_ids[local], local_grams, local_sizes)
            inputs = np.zeros((*ids.shape, 2 * DIM), np.float32)
            inputs[ids >= 0] = x[at]
            hide = np.ones((*ids.shape, 2 * DIM), np.float32)
            hide[..., :DIM] = (r.random(ids.shape) >= DROP)[..., None] / (1 - DROP)  # so that characters learn too
            inputs *= hide
            keep: dict = {}
            gates = np.concatenate([inputs @ network.p["wf"] + network.p["cf"], inputs @ network.p["wb"] + network.p["cb"]], axis=2)
            gates[ids < 0] = 0
            logit = network.forward(gates, mask, keep)
            d_logit = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(part)).astype(np.float32)
            g, d_gates = network.backward(d_logit, keep, *ids.shape)
            d_gates[ids < 0] = 0
            d_inputs = np.zeros_like(inputs)
            for k, d in enumerate("fb"):
                half = d_gates[..., k * 3 * HIDDEN : (k + 1) * 3 * HIDDEN]
                g[f"w{d}"] = inputs.reshape(-1, 2 * DIM).T @ half.reshape(-1, 3 * HIDDEN)
                g[f"c{d}"] = half.sum(axis=(0, 1))
                d_inputs += half @ network.p[f"w{d}"].T
            d_inputs *= hide
            d_x = _summed(at, d_inputs[mask], len(local))
            g["words"] = _summed(word_ids[local], d_x[:, :DIM], WORDS)
            g["grams"] = _summed(local_grams, np.repeat(d_x[:, DIM:] / local_sizes[:, None], local_sizes, axis=0), GRAMS)
            steps += 1
            for name, value in network.p.items():
                if (d := g.get(name)) is None:
                    continue
                first, second = moments[name]
                first *= 0.9
                first += 0.1 * d
                second *= 0.999
                second += 0.001 * d * d
                value -= (RATE * np.sqrt(1 - 0.999**steps) / (1 - 0.9**steps)) * first / (np.sqrt(second) + 1e-8)
    top = np.array([x.max() for x in np.split(_logits(network, network.inputs(word_ids, grams, sizes), every), ends)])
    use = cut if cut.any() else np.ones(len(rows), bool)
    network.calibration = _calibrated(top[use], labels[use])
    return network


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of labels on one number, with targets a little off 0 and 1 so that it stays finite."""
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - target) * x).sum() + 1e-2 * (a - 1), (p - target).sum()])
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1, 1 / max(1e-12, np.abs(step).max()))
        a, b = max(a - step[0], 0.05), b - step[1]
    return float(a), float(b)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> list[tuple[str, int]]:
    """At most MOST_TOXIC and MOST_CLEAN labelled texts outside the held-out part, chosen by hash, in order of it."""
    known = labels.select(F.col("doc_id").alias("k"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("k").isNotNull() & ~is_held_out(F.col("k")))
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("toxicity-1:"), F.col("k").cast("string"))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    part = F.when(F.col("y") == 1, 1.3 * MOST_TOXIC / max(1, n.get(1, 0))).otherwise(1.3 * MOST_CLEAN / max(1, n.get(0, 0)))
    chosen = known.withColumn("draw", draw).filter(F.col("draw") < part)  # about 1.3 * (MOST_TOXIC + MOST_CLEAN) ids at most
    text = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull() & (F.length("text") <= FIT_CHARS))
    rows = text.join(F.broadcast(chosen), "k").select("draw", "k", "y", "text").collect()
    out: list[tuple[str, int]] = []
    for y, most in ((1, MOST_TOXIC), (0, MOST_CLEAN)):
        own = sorted((r for r in rows if r["y"] == y), key=lambda r: (r["draw"], r["k"], r["text"]))
        out += [(r["text"], y) for r in own[:most]]
    return out


def _scorer(network: Network):
    own = Vocabulary(network)

    def score(all_texts: list[str]) -> np.ndarray:
        return network.probability(np.array([x.max() for x in own.logits(map(words_of, all_texts))], np.float64))

    return score


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(network)  # 2 MB, whatever the input

    def made():
        own = _scorer(shared.value)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = own(texts(batch, 2))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= reject).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

        return f

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), is_held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(over_batches(made), "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, network: Network, text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """The rows of docs that score below `reject`."""
    prepare(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(network), docs.columns.index(text_col)

    def made():
        own = _scorer(shared.value)
        return lambda batch: batch.filter(pa.array(own(texts(batch, at)) < reject))

    return docs.mapInArrow(over_batches(made), docs.schema)


def labelled(docs: DataFrame, labels: DataFrame) -> Network:
    return fit(training_rows(docs, labels))


