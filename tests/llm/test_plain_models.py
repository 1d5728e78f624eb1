"""The toxicity scorer and the media fingerprints against versions written plainly, over whole tables."""

import cmath
import math
import random

import numpy as np

from tidemark.llm import media, toxicity


def plain_score(net, text):
    """The highest window's probability: one word, one state and one window at a time, in double precision."""
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words, h = toxicity.words_of(text), toxicity.HIDDEN
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def gates(word, d):
        grams, sizes = toxicity.grams_of([word])
        x = np.concatenate([p["words"][toxicity.word_of(word)], p["grams"][grams].mean(axis=0)])
        return x @ p[f"w{d}"] + p[f"c{d}"]

    def states(window, d):
        out, old = [], np.zeros(h)
        for w in window if d == "f" else window[::-1]:
            g, q = (gates(w, d) if w is not None else np.zeros(3 * h)), old @ p[f"u{d}"]
            z, r = sigmoid(g[:h] + q[:h]), sigmoid(g[h : 2 * h] + q[h : 2 * h])
            old = z * old + (1 - z) * np.tanh(g[2 * h :] + r * q[2 * h :])
            out.append(old)
        return out if d == "f" else out[::-1]

    best = -math.inf
    a = 0
    while True:
        window = words[a : a + toxicity.WINDOW] or [None]
        s = np.array([np.concatenate(x) for x in zip(states(window, "f"), states(window, "b"), strict=True)])
        e = np.array([np.tanh(x @ p["a"]) @ p["v"] for x in s])
        weight = np.exp(e - e.max())
        best = max(best, float((weight / weight.sum()) @ s @ p["o"] + p["b"][0]))
        if a + toxicity.WINDOW >= len(words):
            break
        a += toxicity.STRIDE
    x, y = net.calibration
    return 1 / (1 + math.exp(-max(-30, min(30, x * best + y))))


def test_scores_of_a_table_match_a_plain_scorer(docs, awkward):
    r = random.Random(1)
    word = lambda: "".join(r.choices(["an", "er", "ti", "on", "sh", "le"], k=r.randint(1, 3)))
    rows = [(" ".join([word() for _ in range(40)] + ["idiot"] * (k % 3 == 0)), int(k % 3 == 0)) for k in range(200)]
    net = toxicity.fit(rows)
    some = docs.select("doc_id", "text").unionByName(awkward.filter("doc_id is null or doc_id <> 6").select("doc_id", "text"))
    texts = sorted(((x.doc_id, x.text) for x in some.collect() if len(x.text or "") < 6_000), key=repr)
    got = sorted(((x.doc_id, x.score) for x in toxicity.score(some.filter("coalesce(length(text), 0) < 6000"), net).collect()), key=lambda x: repr(x[0]))
    want = sorted(((k, plain_score(net, t or "")) for k, t in texts), key=lambda x: repr(x[0]))
    by = lambda rows: sorted((repr(k), round(s, 3)) for k, s in rows)
    assert len(got) == len(want) > 100
    assert all(a[0] == b[0] and abs(a[1] - b[1]) <= 2e-3 for a, b in zip(by(got), by(want), strict=True))


def plain_fingerprint(payload):
    """Frames, a Fourier sum for each bin, peaks and pairs, one after another."""
    n = max(1, -(-(len(payload) - media.FRAME) // media.STEP) + 1)
    hann = [0.5 - 0.5 * math.cos(2 * math.pi * k / media.FRAME) for k in range(media.FRAME)]
    turn = [cmath.exp(-2j * math.pi * k / media.FRAME) for k in range(media.FRAME)]
    strongest = []
    for f in range(n):
        frame = [x - 128 for x in payload[f * media.STEP : f * media.STEP + media.FRAME]]
        frame += [0] * (media.FRAME - len(frame))
        level = np.abs([sum(x * w * turn[b * k % media.FRAME] for k, (x, w) in enumerate(zip(frame, hann, strict=True))) for b in range(media.FRAME // 2 + 1)])
        strongest.append([(float(level[low:high].max()), low + int(level[low:high].argmax())) for low, high in media.BANDS])
    at = lambda f, k: strongest[f][k][0] if 0 <= f < n else 0.0
    peak = lambda f, k: at(f, k) > 0 and at(f, k) >= at(f - 1, k) and at(f, k) > at(f + 1, k)
    pairs = [(f, strongest[f][k][1] << 13 | strongest[f + gap][k][1] << 4 | gap) for k in range(len(media.BANDS)) for gap in range(1, media.FAN + 1) for f in range(n - gap) if peak(f, k) and peak(f + gap, k)]
    return sorted(pairs)


def test_fingerprints_match_a_plain_transform():
    r = random.Random(3)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "é", "漢字", "12"]
    for n in (0, 3, 60, 150, 400, 900):
        _, payload = media.payload_of(" ".join(r.choices(words, k=n)))
        codes, times = media.fingerprint(payload)
        assert sorted(zip(times.tolist(), codes.tolist(), strict=True)) == plain_fingerprint(payload)
