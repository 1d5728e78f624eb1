"""Personal data: fixed base patterns, and a semi-Markov conditional random field that adds spans they miss.

Base spans (email, ip, card, phone) follow fixed patterns, leftmost and non-overlapping within a kind.
All text outside them is segmented by the random field. Its candidate segments, in fitting and in decoding,
are runs of up to MOST_TOKENS tokens of a line that have the shape of an address (_MAIL, _QUAD), or that begin
with a digit, plus or bracket, end with a digit and hold LEAST_DIGITS to MOST_DIGITS digits; every other token
is outside. Segments are scored as wholes: digit counts, separators, check digits, whole-span shapes, both
edges and the words before. The weights are fitted by conditional log-likelihood (forward-backward over
segments) on sentences written by rule from a fixed seed; a bounded-entity Viterbi pass chooses boundaries and
kinds jointly. A token in no candidate is outside in every segmentation, so the pass runs over the stretches
that candidates cover and gives what it would over the whole text. Added spans never overlap base spans.

Cases: null counts as empty; spans are in code points, end exclusive; very long texts are read whole, in
time linear in their length; ties fall the same way in every run; rows give repeated rows; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import over_batches, prepare, texts

KINDS = ("email", "ip", "card", "phone")
#: An entity has at most so many tokens.
MOST_TOKENS = 32
LEAST_DIGITS, MOST_DIGITS = 7, 19
SEED = 5
SENTENCES, EPOCHS, RATE, DECAY = 360, 12, 0.5, 1e-3

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start and then in the order of KINDS."""
    found = []
    if "@" in text:
        free = 0
        for m in _DOMAIN.finditer(text):
            a = m.start()
            while a > free and text[a - 1] in _LOCAL:
                a -= 1
            if a < m.start():
                found.append((a, 0, m.end()))
                free = m.end()
    for m in _IP.finditer(text):
        if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m.groups()):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return [(a, b, KINDS[k]) for a, k, b in sorted(found)]


# The random field.

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|[^\s]")
_AT = r"(?:at|At|AT)"
_WORD_DOT = r"(?:dot|Dot|DOT)"
_SIGN = rf"\s*(?:[\[({{<]\s?(?:{_AT}|@)\s?[\])}}>]|@)\s*"
_DOT = rf"(?:\s*[\[({{<]\s?(?:{_WORD_DOT}|\.)\s?[\])}}>]\s*|\s+{_WORD_DOT}\s+|_{_WORD_DOT}_)"
#: After a plain dot the last label is of one case and has a letter first: not "at 10.30", not "at home.Then".
_LAST = r"(?:[a-z][a-z0-9-]+|[A-Z][A-Z0-9-]+)"
_MAIL = re.compile(rf"[A-Za-z0-9._%+-]+?(?:(?:\s+{_AT}\s+|_{_AT}_)[A-Za-z0-9-]+(?:(?:{_DOT}|\.)[A-Za-z0-9-]+)*?(?:{_DOT}[A-Za-z][A-Za-z0-9-]*|\.{_LAST})|{_SIGN}[A-Za-z0-9-]+(?:(?:{_DOT}|\s+\.\s+|\.)[A-Za-z0-9-]+)*?(?:{_DOT}[A-Za-z][A-Za-z0-9-]*|(?:\s+\.\s+|\.){_LAST}))")
_QUAD = re.compile(rf"[0-9]{{1,3}}(?:(?:\s?\.\s?|\s?[\[(]\s?(?:\.|{_WORD_DOT})\s?[\])]\s?|\s{_WORD_DOT}\s|_{_WORD_DOT}_)[0-9]{{1,3}}){{3}}(?![0-9])")
#: Where the sign of an address may stand.
_SIGNS = re.compile(rf"\s*[\[({{<]\s?(?:{_AT}|@)\s?[\])}}>]|\s*@|\s+{_AT}\s|_{_AT}_")
_DIGIT = re.compile(r"[0-9]")
_QUAD_START = re.compile(r"(?<![0-9])[0-9]{1,3}(?=\s?\.|\s?[\[(]|\s[dD]|_[dD])")
_GROUPED = re.compile(r"[0-9]{4}(?:[^0-9A-Za-z]{1,3}[0-9]{4}){2}[^0-9A-Za-z]{1,3}[0-9]{1,7}")
_DIALLED = re.compile(r"(?:\+|00)?[0-9]{0,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ ./-]{1,2}[0-9]{2,4}){2,3}")
_DATED = re.compile(r"(?:19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./](?:19|20)[0-9]{2}|[0-9]{1,2}:[0-9]{2}")
_CUES = tuple(re.compile(rf"(?:{w})\W{{0,4}}\Z", re.I) for w in (r"e-?mail|mail|write to|contact", r"ip|host|server|address", r"card|visa|account|paid with", r"call|tel|phone|fax|mobile|ring"))
N_FEATURES = 29


@lru_cache(100_000)
def _of_span(span: str) -> np.ndarray:
    """Features of a span by itself."""
    x = np.zeros(N_FEATURES)
    d = _NOT_DIGIT.sub("", span)
    n = len(d)
    x[0] = 1
    x[1 + (0 if n < 7 else 1 if n < 10 else 2 if n < 13 else 3 if n < 14 else 4 if n < 20 else 5)] = 1
    x[7] = _MAIL.fullmatch(span) is not None
    x[8] = (m := _QUAD.fullmatch(span)) is not None and all(int(p) <= 255 for p in re.findall("[0-9]+", span))
    x[9] = m is not None and not x[8]
    x[10] = 13 <= n <= 19 and luhn(d)
    x[11] = 13 <= n <= 19 and not x[10]
    x[12] = _GROUPED.fullmatch(span) is not None
    x[13] = _DIALLED.fullmatch(span) is not None
    x[14] = span[0] in "+("
    x[15] = any(c.isalpha() for c in span)
    x[16] = _DATED.search(span) is not None
    x[17] = not (span[0].isalnum() or span[0] in "+(")
    x[18] = not span[-1].isalnum()
    x[19] = len(span) - n > n + 6
    x[20] = n > 0 and span.isdigit()
    return x


def features(text: str, a: int, b: int) -> np.ndarray:
    """Features of the span from a to b as a whole, in its place."""
    x = _of_span(text[a:b]).copy()
    x[21] = a > 0 and (text[a - 1].isalnum() or text[a - 1] in "._%+=#/-")
    x[22] = b < len(text) and (text[b].isalnum() or text[b] in "%@/_" or b + 1 < len(text) and text[b] in ".-:" and text[b + 1].isalnum())
    before = text[max(0, a - 24) : a]
    for k, cue in enumerate(_CUES):
        x[23 + k] = cue.search(before) is not None
    x[27] = b - a < 8
    x[28] = b + 1 < len(text) and text[b] in " -" and text[b + 1].isdigit()
    return x


def _local_starts(text: str, at: int, low: int) -> list[int]:
    """Where the local part before an address's sign at `at` may begin: its tokens' starts, nearest first."""
    out, i = [], at
    while i > low and len(out) < MOST_TOKENS and text[i - 1] in _LOCAL:
        kind = 0 if text[i - 1].isalpha() else 1 if text[i - 1].isdigit() else 2
        i -= 1
        while kind < 2 and i > low and text[i - 1] in _LOCAL and (text[i - 1].isalpha() if kind == 0 else text[i - 1].isdigit()):
            i -= 1
        if kind < 2:
            out.append(i)
    return out


def _of_line(text: str, low: int, high: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Edges of a line's tokens and its candidates (first token, token after the last); both empty for a line without one."""
    mails = [s for m in _SIGNS.finditer(text, low, high) for s in _local_starts(text, m.start(), low) if _MAIL.match(text, s, high)]
    quads = [m for d in _QUAD_START.finditer(text, low, high) if (m := _QUAD.match(text, d.start(), high))]
    digits = len(_DIGIT.findall(text, low, high)) >= LEAST_DIGITS
    if not (mails or quads or digits):
        return [], []
    edges = [m.start() for m in _TOKEN.finditer(text, low, high)] + [high]
    place, found = {e: k for k, e in enumerate(edges)}, set()
    for s in mails:
        if (i := place.get(s)) is not None:
            found |= {(i, j) for j in range(i + 2, min(len(edges), i + MOST_TOKENS + 1)) if text[edges[j] - 1].isalnum() and _MAIL.fullmatch(text, s, edges[j])}
    for m in quads:
        if (i := place.get(m.start())) is not None and (j := place.get(m.end())) is not None and j - i <= MOST_TOKENS:
            found.add((i, j))
    if digits:
        size = [b - a if "0" <= text[a] <= "9" else 0 for a, b in zip(edges, edges[1:], strict=False)]
        for i in [k for k, n in enumerate(size) if n or text[edges[k]] in "+("]:
            n = 0
            for j in range(i, min(len(size), i + MOST_TOKENS)):
                n += size[j]
                if n > MOST_DIGITS:
                    break
                if size[j] and n >= LEAST_DIGITS:
                    found.add((i, j + 1))
    return (edges, sorted(found)) if found else ([], [])


def segments(text: str) -> tuple[list[int], list[tuple[int, int]]]:
    """Token edges, and the candidate segments (first token, token after the last)."""
    edges, out, low = [], [], 0
    while low < len(text):
        high = text.find("\n", low) + 1 or len(text)
        own, found = _of_line(text, low, high)
        out += [(len(edges) + i, len(edges) + j) for i, j in found]
        edges += own[:-1] or [m.start() for m in _TOKEN.finditer(text, low, high)]
        low = high
    return [*edges, len(text)], out


def regions(text: str, a: int, b: int) -> list[tuple[list[int], list[tuple[int, int]]]]:
    """(edges, candidates) of each run of tokens in text[a:b] that candidates cover; every other token is outside."""
    out, low = [], a
    while low < b:
        high = text.find("\n", low, b) + 1 or b
        edges, found = _of_line(text, low, high)
        k = 0
        while k < len(found):
            first, end = found[k]
            last = k + 1
            while last < len(found) and found[last][0] <= end:
                end = max(end, found[last][1])
                last += 1
            out.append((edges[first : end + 1], [(i - first, j - first) for i, j in found[k:last]]))
            k = last
        low = high
    return out


class Field:
    """weights: (features, kinds); moves: scores of a label (a kind, or outside = last) after another."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def lattice(self, text: str, edges: list[int], segs: list[tuple[int, int]]) -> tuple[np.ndarray, list[list[int]]]:
        f = np.array([features(text, edges[i], edges[j]) for i, j in segs]).reshape(-1, N_FEATURES)
        ending: list[list[int]] = [[] for _ in edges]
        for k, (_, j) in enumerate(segs):
            ending[j].append(k)
        return f, ending

    def decode(self, text: str, a: int = 0, b: int | None = None) -> list[tuple[int, int, str]]:
        """The best segmentation's entities in text[a:b], by dynamic programming over segments of bounded length."""
        b = len(text) if b is None else b
        found, own = [], text[a:b]  # what a base span holds is not seen
        for edges, segs in regions(own, 0, len(own)):
            found += [(a + x, a + y, kind) for x, y, kind in self._best(own, edges, segs)]
        return found

    def _best(self, text: str, edges: list[int], segs: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
        f, ending = self.lattice(text, edges, segs)
        s, n, out = f @ self.weights, len(edges) - 1, len(KINDS)
        best = np.full((n + 1, out + 1), -np.inf)
        best[0, out] = 0
        back: dict[tuple[int, int], tuple[int, int]] = {}
        for j in range(1, n + 1):
            come = best[j - 1] + self.moves[:, out]
            back[j, out] = (j - 1, int(come.argmax()))
            best[j, out] = come.max()
            for k in ending[j]:
                i = segs[k][0]
                come = (best[i][:, None] + self.moves[:, :out]).max(axis=0) + s[k]
                for y in np.flatnonzero(come > best[j, :out]):
                    best[j, y] = come[y]
                    back[j, int(y)] = (i, int((best[i] + self.moves[:, y]).argmax()))
        found, j = [], n
        last = best[n] + (self.moves[:, out] if edges[n] < len(text) else 0)  # the next token is outside
        y = int(last.argmax())
        while j:
            i, before = back[j, y]
            if y < out:
                found.append((edges[i], edges[j], KINDS[y]))
            j, y = i, before
        return found[::-1]

    def score(self, text: str, entities: list[tuple[int, int, str]]) -> float:
        """Of a segmentation of a whole text: entities must be candidates."""
        edges, segs = segments(text)
        place, label, total, i, out = {e: k for k, e in enumerate(edges)}, len(KINDS), 0.0, 0, len(KINDS)
        begins = {place[a]: (place[b], KINDS.index(k)) for a, b, k in entities}
        while i < len(edges) - 1:
            j, y = begins.get(i, (i + 1, out))
            if y < out:
                if (i, j) not in segs:
                    return -math.inf
                total += float(features(text, edges[i], edges[j]) @ self.weights[:, y])
            total += float(self.moves[label, y])
            i, label = j, y
        return total

    def step(self, text: str, truth: list[tuple[int, int, str]], rate: float) -> None:
        """One ascent step on the conditional log-likelihood of a sentence's true segmentation."""
        edges, segs = segments(text)
        if not segs:
            return
        f, ending = self.lattice(text, edges, segs)
        s, n, out = f @ self.weights, len(edges) - 1, len(KINDS)
        forward = np.full((n + 1, out + 1), -np.inf)
        forward[0, out] = 0
        into = np.full((n + 1, out + 1), -np.inf)  # of a segment of each label that begins here
        into[0] = self.moves[out]
        for j in range(1, n + 1):
            forward[j, out] = into[j - 1, out]
            if ending[j]:
                at = np.array(ending[j])
                forward[j, :out] = np.logaddexp.reduce(into[[segs[k][0] for k in at], :out] + s[at], axis=0)
            into[j] = np.logaddexp.reduce(forward[j][:, None] + self.moves, axis=0)
        total = np.logaddexp.reduce(forward[n])
        backward = np.full((n + 1, out + 1), -np.inf)
        backward[n] = 0
        starting: list[list[int]] = [[] for _ in edges]
        for k, (i, _) in enumerate(segs):
            starting[i].append(k)
        pairs = np.zeros_like(self.moves)
        expected = np.zeros_like(s)
        for i in range(n - 1, -1, -1):
            after = np.full(out + 1, -np.inf)
            after[out] = backward[i + 1, out]
            if starting[i]:
                at = np.array(starting[i])
                ahead = s[at] + backward[[segs[k][1] for k in at], :out]
                after[:out] = np.logaddexp.reduce(ahead, axis=0)
                expected[at] = np.exp(np.minimum(into[i, :out] + ahead - total, 0))
            backward[i] = np.logaddexp.reduce(self.moves + after, axis=1)
            pairs += np.exp(np.minimum(forward[i][:, None] + self.moves + after - total, 0))
        true = np.zeros_like(s)
        place, index, label, i = {(edges[a], edges[b]): k for k, (a, b) in enumerate(segs)}, [], out, 0
        ends = {a: (b, k) for a, b, k in truth}
        seen = np.zeros_like(self.moves)
        while i < n:
            if edges[i] in ends and (k := place.get((edges[i], ends[edges[i]][0]))) is not None:
                y = KINDS.index(ends[edges[i]][1])
                true[k, y] = 1
                index.append(k)
                i = segs[k][1]
            else:
                y, i = out, i + 1
            seen[label, y] += 1
            label = y
        self.weights += rate * (f.T @ (true - expected) - DECAY * self.weights)
        self.moves += rate * 0.1 * (seen - pairs - DECAY * self.moves)


def sentences(n: int, seed: int = SEED) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Training sentences written by rule: plain and disguised entities, and numbers that are none."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(("an", "er", "on", "ti", "re", "th", "st", "ou", "la", "ge", "en", "i", "o")) for _ in range(r.randint(1, 4)))

    def email() -> str:
        at, dot = r.choice((("@", "."), (" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), ("(at)", "."), (" {at} ", " dot ")))
        return word() + r.choice(("", "." + word(), digits(2))) + at + dot.join([word(), *r.choice(([], [word()])), r.choice(("com", "org", "net", "example"))])

    def ip() -> str:
        return r.choice((".", " . ", "[.]", "(.)", " [dot] ", ". ")).join(str(r.randint(0, 255)) for _ in range(4))

    def card(good: bool = True) -> str:
        d = digits(15)
        check = next(c for c in "0123456789" if luhn(d + c))
        d += check if good else str((int(check) + r.randint(1, 9)) % 10)
        return r.choice((".", "/", " - ", "  ", "_", " . ", "-", " ")).join((d[:4], d[4:8], d[8:12], d[12:]))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{digits(2)} {a} {b} {c}", f"+1 {a}/{b}/{c}", f"1-{a}-{b}-{c}", f"{a} {b} {c}"))

    def other() -> str:
        return r.choice((
            lambda: f"20{digits(2)}-0{r.randint(1, 9)}-1{digits(1)} 1{digits(1)}:{r.randint(10, 59)}:{r.randint(10, 59)}", lambda: f"{digits(3)}.{digits(3)}", lambda: digits(r.randint(7, 24)), lambda: card(False), lambda: f"version {digits(1)}.{digits(1)}.{digits(2)}.{digits(4)}",
            lambda: f"{word()} at {word()} {word()}", lambda: f"{digits(2)} at {digits(3)} {word()}", lambda: f"{digits(1)},{digits(3)},{digits(3)}.{digits(2)}", lambda: ", ".join(digits(2) for _ in range(6)), lambda: " ".join(digits(r.randint(1, 2)) for _ in range(9)), lambda: "300.400.500.600", lambda: f"ISBN 978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", lambda: f"{digits(5)}/{digits(5)}/{digits(6)}",
        ))()

    makers = {"email": (email, ("email", "mail", "contact", "write to")), "ip": (ip, ("ip", "host", "server")), "card": (card, ("card", "visa", "paid with")), "phone": (phone, ("call", "tel", "phone", "fax"))}
    out = []
    for _ in range(n):
        text, truth = "", []
        for _ in range(r.randint(1, 2)):
            text += "".join(word() + " " for _ in range(r.randint(1, 4)))
            if r.random() < 0.45:
                text += other()
            else:
                kind = r.choice(KINDS)
                make, cues = makers[kind]
                text += r.choice(("", "", r.choice(cues) + r.choice((" ", ": "))))
                span = make()
                truth.append((len(text), len(text) + len(span), kind))
                text += span
            text += r.choice((" ", ". ", ", ", "\n"))
        out.append((text + word(), truth))
    return out


def fitted(seed: int = SEED) -> Field:
    """The field, fitted anew; the same for a seed."""
    field = Field(np.zeros((N_FEATURES, len(KINDS))), np.zeros((len(KINDS) + 1, len(KINDS) + 1)))
    train = sentences(SENTENCES, seed)
    for epoch in range(EPOCHS):
        for text, truth in train:
            field.step(text, truth, RATE / (1 + epoch))
    return field


def stretches(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """What base spans leave of the text."""
    out, at = [], 0
    for a, b, _ in sorted(base):
        if at < a:
            out.append((at, a))
        at = max(at, b)
    return [*out, (at, len(text))] if at < len(text) else out


def added_spans(text: str, base: list[tuple[int, int, str]], field: Field) -> list[tuple[int, int, str]]:
    """What the field finds in each stretch between base spans."""
    return [x for a, b in stretches(text, base) for x in field.decode(text, a, b)]


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (spans as kind:start:end, comma-joined), n_ of each kind in it, spans (all), of every row."""
    prepare(docs.sparkSession)
    field = fitted()
    shared = (field.weights, field.moves)  # 145 numbers

    def made():
        own = Field(*shared)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            base, spans, n = [], [], [[] for _ in KINDS]
            for text in texts(batch):
                b = base_spans(text)
                for k, kind in enumerate(KINDS):
                    n[k].append(sum(x[2] == kind for x in b))
                base.append(_joined(b))
                spans.append(_joined(sorted(b + added_spans(text, b, own), key=lambda x: (x[0], KINDS.index(x[2])))))
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array(base, pa.string()), pa.array(spans, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"])

        return f

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(over_batches(made), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")
