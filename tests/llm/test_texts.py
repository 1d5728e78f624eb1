"""BPE, media, personal data, language, licences and toxicity, against plain versions and held-out rows."""

import base64
import hashlib
import random
import re
import textwrap
import wave
import zlib
from io import BytesIO

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tidemark.llm import bpe, langid, licences, media, pii, queries, toxicity

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    with open(RANKS, "rb") as f:
        return bpe.Encoder(f.read(), public_tokenizers.PATTERN)


def test_bpe_matches_library(encoding, encoder):
    r = random.Random(1)
    pieces = ["a", " ", "  ", "\n", "\t", "é", "'s", "'re", "'", "12", "漢字", "😀", "!", "the ", "\r\n", "　", "x" * 40]
    for _ in range(400):
        text = "".join(r.choices(pieces, k=r.randint(0, 200)))
        found = encoder.pattern.findall(text)
        assert np.frombuffer(encoder.encode(found), "<u4").tolist() == encoding.encode_ordinary(text)
        for size, overlap in ((17, 3), (60, 20)):
            cuts = bpe.cut(text, size, overlap)
            whole, true = bpe.stitch(encoder, cuts, [encoder.starts(t, a) for a, t in cuts])
            assert whole == text and [text[a:b] for a, b in zip(true, [*true[1:], len(text)], strict=False)] == found
            parts = bpe.blocks(whole, true, 25)
            assert "".join(t for t, _ in parts) == text and [n for _, x in parts for n in x] == list(map(len, found))


def test_bpe_long_runs(encoding, encoder):
    for text in ("a" * 3000, " " * 3000 + "x", "漢" * 1500, "ab" * 1500):
        assert np.frombuffer(encoder.encode(encoder.pattern.findall(text)), "<u4").tolist() == encoding.encode_ordinary(text)


def test_stitching_is_linear_in_unbroken_runs(encoder):
    """Twice the run, about twice the time: characters that the pattern reads, as a text is read on once, not from its start at every chunk."""

    class Counting:
        def __init__(self):
            self.read = 0

        def finditer(self, text, at=0):
            for m in encoder.pattern.finditer(text, at):
                self.read += m.end() - m.start()
                yield m

    for unit in ("x" * 400_000, "漢" * 400_000, "a b " * 40_000 + "y" * 400_000 + " c d" * 40_000):
        cuts = bpe.cut(unit)
        starts = [encoder.starts(t, a) for a, t in cuts]
        own = type("E", (), {"pattern": Counting()})()
        whole, true = bpe.stitch(own, cuts, starts)
        assert whole == unit and true == encoder.starts(unit)
        assert own.pattern.read <= len(unit)


@pytest.mark.parametrize("chunk", [bpe.CHUNK_CHARS, 300])
def test_bpe_of_tables(encoding, docs, awkward, nothing, chunk):
    for table in (docs, awkward):
        got = bpe.encode(table, RANKS, public_tokenizers.PATTERN, chunk_chars=chunk, overlap_chars=chunk // 3)
        want = sorted(((r.doc_id, len(i := encoding.encode_ordinary(r.text or "")), np.array(i, "<u4").tobytes(), (r.text or "").encode()) for r in table.select("doc_id", "text").collect()), key=repr)
        assert sorted(((r[0], r[1], bytes(r[2]), bytes(r[3])) for r in got.collect()), key=repr) == want
    assert bpe.digests(bpe.encode(nothing, RANKS, public_tokenizers.PATTERN)).collect() == []


def test_media_round_trip(docs, awkward, nothing):
    for table in (docs.limit(50), awkward):
        texts = sorted(((r.doc_id, r.text or "") for r in table.select("doc_id", "text").collect()), key=repr)
        rows = sorted(media.store(table).collect(), key=lambda r: repr((r.doc_id, bytes(r.payload).rstrip(b"\0").decode())))
        for (k, text), r in zip(texts, rows, strict=True):
            raw = text.encode()
            assert (r.doc_id, r.n_bytes) == (k, len(raw))
            assert bytes(r.payload)[: len(raw)] == raw and len(r.payload) % 64 == 0 and 0 < len(r.payload) < len(raw) + 65 and not any(bytes(r.payload)[len(raw) :])
            with wave.open(BytesIO(bytes(r.media))) as w:
                assert w.readframes(w.getnframes()) == bytes(r.payload)
            assert len(r.codes) == len(r.times) and list(r.times) == sorted(r.times)
    d = media.digests(media.store(awkward)).collect()
    for r in d:
        assert r.payload_bytes % 64 == 0 and len(r.feature) > 60
    assert len({r.feature for r in d if r.doc_id in (1, 2)}) == 1
    assert media.store(nothing).collect() == []


def test_media_digest_columns(docs):
    r, t = media.digests(media.store(docs.orderBy("doc_id").limit(1))).first(), docs.orderBy("doc_id").first().text.encode()
    payload = t + bytes(-len(t) % 64 or (64 if not t else 0))
    assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
    assert r.tail_crc32 == zlib.crc32(payload[-64:])


def test_fingerprint_peaks_follow_a_tone():
    t = np.arange(16 * 512)
    tone = (128 + 100 * np.sin(2 * np.pi * 20 * t / 512) * (1 + 0.5 * np.sin(t / 900))).astype(np.uint8)
    codes, times = media.fingerprint(tone.tobytes())
    assert len(codes) and set(codes[(codes >> 13) < 32] >> 13) == {20}
    assert (np.diff(times) >= 0).all()


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 14, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 10, 15)):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if low <= len(d) <= high and (kind == 3 or pii.luhn(d)):
                out.append((m.start(), kind, m.end()))
    return [(a, b, pii.KINDS[k]) for a, k, b in sorted(out)]


def test_base_spans_match_patterns(docs):
    r = random.Random(2)
    bits = ["1", "2", "55", ".", ".", "-", " ", "+", "(", ")", "@", "a", "b.c", "%", "0255", "4041894974608795", "+1 (988) 555-2485", "a@b.c", "\n"]
    for _ in range(20_000):
        text = "".join(r.choices(bits, k=r.randint(1, 20)))
        assert pii.base_spans(text) == plain_spans(text)
    for row in docs.collect():
        assert pii.base_spans(row.text) == plain_spans(row.text)


def test_field_adds_disguised_spans_and_leaves_others():
    field = pii.fitted()
    held = pii.sentences(200, seed=77)
    assert sum(field.decode(t) == truth for t, truth in held) >= 180
    for text, kind in (("write to jo.do (at) mail (dot) example (dot) com today", "email"), ("the host 10[.]0[.]12[.]7 is down", "ip"), ("call (212) 555-0187 now", "phone")):
        found = pii.added_spans(text, pii.base_spans(text), field)
        assert [k for _, _, k in found] == [kind], (text, found)
    for text in ("on 2024-05-06 10:11:12 we met", "look at this dot", "version 1.2.10.4004 of it"):
        assert pii.added_spans(text, pii.base_spans(text), field) == []


def test_added_spans_never_touch_base():
    field, text = pii.fitted(), "mail a@b.co or c (at) d (dot) org, +1 (988) 555-2485, (212) 555-0187"
    base = pii.base_spans(text)
    for a, b, _ in pii.added_spans(text, base, field):
        assert all(b <= x or y <= a for x, y, _ in base)


def test_text_beside_base_spans_is_decoded():
    field = pii.fitted()
    for text, want in (
        ("+1 (988) 555-2485, (212) 555-0187", ["(212) 555-0187"]), ("4111 1111 1111 1111, 555-123-4567", ["555-123-4567"]), ("555-123-4567, 4111 1111 1111 1111", ["555-123-4567"]),
        ("mail a@b.co or c (at) d (dot) org, +1 (988) 555-2485, (212) 555-0187", ["c (at) d (dot) org", "(212) 555-0187"]), ("10.0.0.1 555-123-4567 10.0.0.2", ["555-123-4567"]),
    ):
        assert [text[a:b] for a, b, _ in pii.added_spans(text, pii.base_spans(text), field)] == want


def test_disguised_forms_are_found():
    field = pii.fitted()
    for text in ("10 . 0 . 0 . 5", "8. 8. 8. 8", "jo@example dot com", "jo @ example . com", "jo at mail.example dot com", "jo  at  mail  dot  com", "jo at example.com", "john At example Dot com", "john (At) example (Dot) com", "john_AT_example_DOT_com", "1 . 2 . 3 . 4", "10 dot 0 dot 0 dot 1"):
        whole = f"so {text} is it"
        assert [whole[a:b] for a, b, _ in pii.added_spans(whole, pii.base_spans(whole), field)] == [text]
    for text in ("we met at 10.30 today", "we met at home.Then it rained", "apples @ 5.00 each", "look at me . then we go", "in 2024 we met"):
        assert pii.added_spans(text, pii.base_spans(text), field) == []


def test_pii_table(awkward, nothing):
    rows = pii.digests(pii.find(awkward)).collect()
    assert len(rows) == awkward.count()
    assert all(r.base_sha256 == hashlib.sha256(b"").hexdigest() and r.spans == "" for r in rows if r.doc_id in (3, 4))
    assert pii.find(nothing).collect() == []


def test_language_accuracy_on_held_out_rows(spark):
    found = queries.op6_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = found.filter("held_out").join(truth, "doc_id").collect()
    assert len(held) > 150
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in held)


def test_language_edge_cases(docs, awkward, nothing):
    content = langid.sample(docs)
    rows = langid.identify(awkward, content).collect()
    assert {r.lang_pred for r in rows if r.doc_id in (3, 4, 5, 9)} == {"und"}
    assert {r.lang_pred for r in rows if r.doc_id not in (3, 4, 5, 9)} <= set(content)
    assert langid.sample(nothing) == {} and {r.lang_pred for r in langid.identify(awkward, {}).collect()} == {"und"}
    assert langid.identify(nothing, content).collect() == []


def test_licence_templates_are_found_and_pruned():
    s = licences.Scanner(licences.TEMPLATES, licences.LEAST)
    for name, text in licences.TEMPLATES.items():
        assert s.scan(f"first words\n{text.upper()}\nlast words")[0][0] == name
    assert s.scan("nothing of the kind is in this text") == []
    assert s.scan("Released under the MIT License. Then a sentence goes on and on.")[0][0] == "MIT"
    for a, b in ((10, 15), (10, 16), (10, 7), (10, 6)):  # at 0.8: two thirds at least; of longer texts a run is the unit
        one = licences.Scanner({"t": " ".join(f"w{i}" for i in range(a + 1))}, 0.8)
        text = " ".join(f"w{i}" for i in range(b + 1))
        assert bool(one.scan(text)) == (2 * min(a, b) / (a + min(a, b)) >= 0.8)


def test_wrapped_and_commented_licences_are_found():
    s = licences.Scanner(licences.TEMPLATES, licences.LEAST)
    assert s.scan("prose of some kind\nThis work is licensed under the GNU General\nPublic License, version 3. more prose of it") == [("GPL-3.0", 1.0, 1)]
    assert s.scan("Released under the MIT License. Released under the MIT License.") == [("MIT", 1.0, 2)]
    for name, notice in licences.TEMPLATES.items():
        for mark in ("", " * ", "# ", "// "):
            lines = ["Copyright (c) 2020 Some One", *textwrap.wrap(f"{notice} And then more words follow.", 60), "THE SOFTWARE IS PROVIDED AS IS, WITHOUT ANY WARRANTY"]
            assert name in [x for x, *_ in s.scan("\n".join(mark + x for x in lines))], (name, mark)


def plain_licences(text, templates, least=0.8):
    """Every run of words against every template."""
    words, found = licences._WORD.findall(text.lower()), set()
    for name, t in templates.items():
        own = licences.bigrams(t)
        low, high = own.total() * least / (2 - least), own.total() * (2 - least) / least
        for a in range(len(words)):
            if (words[a], words[a + 1] if a + 1 < len(words) else "") not in own:
                continue
            left, common = dict(own), 0
            for b in range(a + 1, min(len(words), a + int(high + 1e-9) + 1)):
                g = (words[b - 1], words[b])
                if left.get(g):
                    left[g] -= 1
                    common += 1
                if b - a >= low - 1e-9 and 2 * common / (own.total() + b - a) >= least:
                    found.add(name)
    return ",".join(sorted(found))


def test_licences_match_all_runs_of_words():
    r = random.Random(6)
    templates = {"a": "w1 w2 w3 w4 w5", "b": "w1 w2 w1 w2 w1 w3", "c": "w2 w3 w4", "d": " ".join(f"w{k % 7}" for k in range(30))}
    s = licences.Scanner(templates, 0.8)
    for _ in range(3_000):
        text = " ".join(r.choice(("w0", "w1", "w2", "w3", "w4", "w5", "w6", "x")) if r.random() < 0.4 else f"w{k % 7}" for k in range(r.randint(0, 60)))
        assert ",".join(sorted(n for n, *_ in s.scan(text))) == plain_licences(text, templates), text


def test_licences_inside_prose_and_whole_texts(tmp_path):
    s = licences.Scanner(licences.TEMPLATES, licences.LEAST)
    for name, notice in licences.TEMPLATES.items():
        found = {n: d for n, d, _ in s.scan(f"some words of prose go before {' '.join(notice.split())} and others follow it in one line")}
        assert found[name] == 1.0
        wrapped = "\n".join(textwrap.wrap(f"words before {notice} words after", 60))
        assert {n: d for n, d, _ in s.scan(wrapped)}[name] == 1.0
    (tmp_path / "own.txt").write_text("a text of some own licence")
    assert licences.pack(str(tmp_path)) == {"own": "a text of some own licence"}


def test_licence_table_matches_unpruned(docs, awkward, nothing):
    rows = {r.doc_id: r for r in licences.scan(docs).collect()}
    for r in docs.collect():
        assert rows[r.doc_id].licences == plain_licences(r.text, licences.TEMPLATES)
    assert licences.scan(awkward).filter("licence is not null").count() == 0
    assert licences.scan(nothing).collect() == []


def test_toxicity_gradients():
    net = toxicity.Network(3)
    r = np.random.default_rng(0)
    x, mask = r.standard_normal((3, 5, 16)).astype(np.float32), np.ones((3, 5), bool)
    mask[1, 3:] = False
    gates = lambda: np.concatenate([x @ net.p["wf"] + net.p["cf"], x @ net.p["wb"] + net.p["cb"]], axis=2)
    keep = {}
    net.forward(gates(), mask, keep)
    g, _ = net.backward(np.ones(3, np.float32), keep, 3, 5)
    for name in ("uf", "ub", "a", "v", "o"):
        at = (0,) * net.p[name].ndim
        old, ends = net.p[name][at], []
        for step in (1e-2, -1e-2):
            net.p[name][at] = old + step
            ends.append(net.forward(gates(), mask).sum())
        net.p[name][at] = old
        assert abs((ends[0] - ends[1]) / 2e-2 - g[name][at]) < 2e-2


def test_toxicity_windows_cover_all_words():
    for n in (0, 1, 31, 32, 33, 48, 49, 1000):
        covered = {i for a in toxicity.window_starts(n) for i in range(a, a + toxicity.WINDOW)}
        assert set(range(n)) <= covered


def test_toxicity_long_text_scores_like_its_windows():
    net = toxicity.Network(1)
    words = [f"w{i % 700}" for i in range(40_000)]
    whole = toxicity.Vocabulary(net).logits([words])[0]
    assert len(whole) == len(toxicity.window_starts(len(words)))
    for k in (0, 1023, 1024, 1500, len(whole) - 1):
        part = toxicity.Vocabulary(net).logits([words[16 * k : 16 * k + 32]])[0][0]
        assert abs(whole[k] - part) < 1e-4


def test_toxicity_texts_in_a_row_score_like_their_windows(monkeypatch):
    r, net = random.Random(8), toxicity.Network(2)
    net.p["words"] += np.random.default_rng(2).standard_normal(net.p["words"].shape).astype(np.float32)
    edge = toxicity.BLOCK * toxicity.STRIDE
    docs = [[f"w{r.randrange(5_000)}" for _ in range(n)] for n in (0, 1, 15, 16, 17, 0, 31, 32, 33, 48, 49, 500, edge - 1, edge, edge + 1, edge + 16, edge + 17, 3, 0)]
    monkeypatch.setattr(toxicity, "REMEMBERED", 2_000)  # words are forgotten on the way
    got = toxicity.Vocabulary(net).logits(docs)
    assert [len(x) for x in got] == [len(toxicity.window_starts(len(d))) for d in docs]
    for words, x in zip(docs, got, strict=True):
        known = sorted(set(words)) or ["none"]
        place = {w: k for k, w in enumerate(known)}
        inputs = net.inputs(np.array([toxicity.word_of(w) for w in known]), *toxicity.grams_of(known))
        windows = toxicity._filled(np.array([place[w] for w in words], np.int32))
        gates, mask = net.projected(inputs)[windows] * (windows >= 0)[..., None], windows >= 0
        mask[:, 0] = True
        assert np.abs(net.forward(gates, mask) - x).max() < 1e-4


def test_toxicity_words_of_many_texts_are_handled_once_and_together(monkeypatch):
    asked, plain, net = [], toxicity.grams_of, toxicity.Network(1)
    monkeypatch.setattr(toxicity, "grams_of", lambda words: asked.append(list(words)) or plain(words))
    texts = [" ".join(f"w{k}x{i}" for i in range(20)) + " common words of all" for k in range(64)]
    assert len(toxicity._scorer(net)(texts)) == 64
    assert len(asked) == 1 and len(asked[0]) == len(set(asked[0])) == 64 * 20 + 4  # not a call for each text
    asked.clear()
    own = toxicity.Vocabulary(net)
    for _ in range(2):
        own.logits([[f"w{i}" for i in range(a, a + 1_500)] for a in range(0, 150_000, 1_500)])
    assert sum(map(len, asked)) == 150_000  # and none again


def test_toxicity_learns(docs, awkward, nothing, spark):
    r = random.Random(4)
    word = lambda: "".join(r.choices(["an", "er", "ti", "on", "sh", "le"], k=r.randint(1, 3)))

    def text(bad):
        w = [word() for _ in range(r.randint(20, 120))]
        if bad:
            w[r.randrange(len(w))] = r.choice(["idiot", "moron"]) + r.choice(["", ".", "s"])
        return " ".join(w)

    rows = [(text(k % 3 == 0), int(k % 3 == 0)) for k in range(500)]
    net = toxicity.fit(rows[:400])
    score = toxicity._scorer(net)
    s, y = score([t for t, _ in rows[400:]]), np.array([y for _, y in rows[400:]])
    assert ((s >= 0.3) == (y == 1)).mean() > 0.95
    out = toxicity.score(awkward, net).collect()
    assert len(out) == awkward.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert len({r.score for r in out if r.doc_id in (3, 4, 5, 9)}) == 1
    assert toxicity.without_toxic(awkward, net).columns == awkward.columns
    assert toxicity.score(nothing, net).collect() == []


def test_toxicity_without_labels(nothing, awkward, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    net = toxicity.labelled(awkward, labels)
    assert {r.predicted for r in toxicity.score(awkward, net).collect()} == {0}


def test_toxicity_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    found = queries.op1_toxicity(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    bad, clean = [r for r in found if r.toxic == 1], [r for r in found if r.toxic == 0]
    assert sum(r.predicted for r in bad) / len(bad) > 0.6
    assert sum(r.predicted for r in clean) / len(clean) < 0.03
