"""The random field against enumeration of all segmentations, and on forms it was not fitted on."""

import itertools
import random

import pytest

from tidemark.llm import pii


@pytest.fixture(scope="module")
def field():
    return pii.fitted()


def all_segmentations(text):
    """Every set of labelled candidates without overlap."""
    edges, segs = pii.segments(text)

    def after(at):
        yield []
        for i, j in segs:
            if i >= at:
                for rest in after(j):
                    for kind in pii.KINDS:
                        yield [(edges[i], edges[j], kind), *rest]

    return list(after(0))


def test_decoding_is_the_best_of_all_segmentations(field):
    r, tried = random.Random(4), 0
    bits = ["555", "0187", "(212)", " ", " ", "-", ".", "jo", " at ", "[at]", "x.com", " dot ", "\n", "10", "+1", ",", "4041894974608795"]
    while tried < 150:
        text = "".join(r.choices(bits, k=r.randint(2, 12)))
        edges, segs = pii.segments(text)
        if not 1 <= len(segs) <= 6:
            continue
        tried += 1
        best = max(field.score(text, x) for x in all_segmentations(text))
        assert field.score(text, field.decode(text)) == pytest.approx(best), text


def test_candidates_match_a_plain_enumeration():
    for text, _ in pii.sentences(60, seed=12):
        edges, segs = pii.segments(text)
        want = set()
        for i, j in itertools.combinations(range(len(edges)), 2):
            span = text[edges[i] : edges[j]]
            if "\n" in span or j - i > pii.MOST_TOKENS:
                continue
            digits = sum(c in "0123456789" for c in span)
            mail = j - i > 1 and span[0].isalnum() and span[-1].isalnum() and pii._MAIL.fullmatch(span)
            quad = pii._QUAD.fullmatch(span)
            number = (span[0] in "+(" or span[0].isdigit()) and span[-1].isdigit() and pii.LEAST_DIGITS <= digits <= pii.MOST_DIGITS
            if mail or quad or number:
                want.add((i, j))
        assert set(segs) == want, text


def test_whole_text_decodes_like_its_lines(field):
    texts = [t for t, _ in pii.sentences(40, seed=13)]
    whole = "\n".join(texts)
    want, at = [], 0
    for t in texts:
        want += [(at + a, at + b, k) for a, b, k in field.decode(t + "\n")]
        at += len(t) + 1
    assert field.decode(whole) == want


def unseen(n, seed):
    """Sentences of forms that the fitting sentences do not hold."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 4)))
    at_dot = ((" At ", " Dot "), (" (At) ", " (Dot) "), ("_AT_", "_DOT_"), (" <at> ", " <dot> "), (" AT ", " DOT "))
    octets = lambda sep: sep.join(str(r.randint(0, 255)) for _ in range(4))
    out = []
    for _ in range(n):
        kind, span = r.choice((
            ("email", (p := r.choice(at_dot)) and word() + p[0] + word() + p[1] + r.choice(("com", "net", "org"))), ("ip", octets(r.choice((" dot ", "(dot)", " [.] ")))),
            ("phone", f"({digits(3)}) {digits(3)}.{digits(4)}"), ("phone", f"00{digits(2)}-{digits(3)}-{digits(3)}-{digits(4)}"), (None, f"{word()} At {word()}"), (None, f"{digits(2)}:{digits(2)} {digits(3)}"), (None, f"{digits(3)} {word()} {digits(4)} {word()}"),
        ))
        before = " ".join(word() for _ in range(3)) + " "
        out.append((f"{before}{span} {word()}.", [(len(before), len(before) + len(span), kind)] if kind else []))
    return out


def test_forms_not_fitted_on(field):
    """The figures of the README."""
    right = found = true = 0
    for text, truth in unseen(2_000, 3):
        base = pii.base_spans(text)
        own = set(base + pii.added_spans(text, base, field))
        right, found, true = right + len(own & set(truth)), found + len(own), true + len(truth)
    print(f"recall {right / true:.3f}, precision {right / found:.3f}")
    assert right / true >= 0.95 and right / found >= 0.95
