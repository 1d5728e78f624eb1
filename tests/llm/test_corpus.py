"""Mixing, line dedup, Jaccard join, embeddings and the pipeline, against plain versions."""

import collections
import itertools
import math
import os
import random
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import common, components, embeddings, jaccard, lines, mixing, queries
from tidemark.llm.common import table


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while True:
        per = left / max(1, sum(weight[s] for s in open_))
        over = {s for s in open_ if per * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: per * weight[s] for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over


@pytest.mark.parametrize("seed", range(3))
def test_targets_match_rounds(spark, seed):
    r = random.Random(seed)
    sizes = {f"s{k}": int(r.paretovariate(0.7) * 20) for k in range(r.randint(1, 30))} | {None: 55}
    rows = [(s, n // 2) for s, n in sizes.items()] + [(s, n - n // 2) for s, n in sizes.items()]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys()
    for s, t in want.items():
        assert got[s] == pytest.approx(t)


def test_mix_counts(docs, awkward, nothing):
    for t in (docs, awkward):
        rows = mixing.mix(t).collect()
        assert len(rows) == t.count()
        for r in rows:
            assert r.taken in (0, r["size"], 2 * r["size"])
    source = collections.defaultdict(lambda: [0, 0.0])
    for r, s in zip(sorted(mixing.mix(docs).collect()), sorted(docs.select("doc_id", "source").collect()), strict=True):
        source[s.source][0] += r.taken
        source[s.source][1] = r.target
    assert sum(t for t, _ in source.values()) == pytest.approx(sum(x for _, x in source.values()), rel=0.25)
    assert sorted(mixing.mix(docs).collect()) == sorted(mixing.mix(docs.repartition(5)).collect())
    assert mixing.mix(nothing).collect() == [] and mixing.mixed(nothing).columns == nothing.columns
    own = mixing.mixed(awkward)
    assert own.columns == awkward.columns and own.filter(mixing.words(own["text"]) > 0).count() == sum(r.taken // r["size"] for r in mixing.mix(awkward).collect() if r["size"])


def test_mix_without_broadcast(docs, monkeypatch):
    want = sorted(mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    assert sorted(mixing.mix(docs).collect()) == want


def test_mix_is_native(docs):
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def plain_lines(texts, least):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({k: k + 32 for k in range(65, 91)})
    n = collections.Counter(k for t in texts for k in {key(x) for x in t.split("\n")} if k)
    out = []
    for t in texts:
        own = t.split("\n")
        kept = [x for x in own if n[key(x)] < least or not key(x)]
        out.append((len(own), len(own) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("bits, shard, most", [(lines.CHUNK_BITS, lines.SHARD_ROWS, lines.MOST_BROADCAST), (3, 20, 0)])
def test_line_dedup(spark, docs, awkward, nothing, bits, shard, most, monkeypatch):
    monkeypatch.setattr(lines, "MOST_BROADCAST", most)
    monkeypatch.setattr(lines, "COUNTED", 40 if most == 0 else lines.COUNTED)
    monkeypatch.setattr(lines, "CHUNK_BITS", bits)
    monkeypatch.setattr(lines, "SHARD_ROWS", shard)
    r = random.Random(0)
    pool = ["Same line", " same LINE\t", "É x", "é x", "", " \x0b", "other", *(f"line {k}" for k in range(40))]
    made = spark.createDataFrame([(k, "\n".join(r.choices(pool, k=r.randint(1, 9)))) for k in range(300)], "doc_id long, text string")
    for t, least in ((made, 10), (made, 60), (docs, 10), (awkward, 2), (awkward, 10)):
        rows = t.select("doc_id", "text").collect()
        want = sorted(((x.doc_id, *p) for x, p in zip(rows, plain_lines([x.text or "" for x in rows], least), strict=True)), key=repr)
        out = lines.line_dedup(t, min_docs=least).select("doc_id", "n_lines", "n_dropped", "kept")
        assert sorted(map(tuple, out.collect()), key=repr) == want
    assert lines.line_dedup(nothing).collect() == []
    own = lines.without_repeated_lines(awkward)
    assert own.columns == awkward.columns and own.count() == awkward.count()


def test_perfect_hash():
    keys = np.random.default_rng(0).integers(0, 2**64, 50_000, np.uint64)
    built = lines.PerfectHash(keys)
    assert sorted(built.index(keys)) == list(range(len(keys)))
    assert sum(x.nbytes for x in (*built.levels, *built.ranks)) < len(keys)  # under 8 bits a key
    own = lines.Shard(keys, keys[::-1].copy(), np.arange(50_000))
    assert (own.count(keys, keys[::-1]) == np.arange(50_000)).all()
    assert not own.count(keys, np.random.default_rng(1).integers(0, 2**64, 50_000, np.uint64)).any()


def shingle_set(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_join(rows):
    sets, seen, common = [shingle_set(t) for _, t in rows], collections.defaultdict(list), collections.Counter()
    for i, s in enumerate(sets):
        for x in s:
            seen[x].append(i)
    for own in seen.values():
        common.update(itertools.combinations(own, 2))
    links, n = collections.defaultdict(set), [0] * len(rows)
    for (i, j), c in common.items():
        if 5 * c >= 4 * (len(sets[i]) + len(sets[j]) - c):
            links[i].add(j)
            links[j].add(i)
            n[i] += 1
            n[j] += 1
    out, root = [], {}
    for i in range(len(rows)):
        if i not in root:
            group, todo = {i}, [i]
            while todo:
                todo += (new := links[todo.pop()] - group)
                group |= new
            least = min((rows[k][0] for k in group if rows[k][0] is not None), default=None)
            root |= dict.fromkeys(group, least)
        out.append((rows[i][0], root[i], n[i]))
    return sorted(out, key=repr)


def near_copies(seed, groups=12, words=120):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 6)))
    passage, out, k = [word() for _ in range(40)], [], 0
    for _ in range(groups):
        base = [word() for _ in range(words)] + passage
        for _ in range(r.randint(1, 25)):
            own = list(base)
            for _ in range(r.randint(0, 7)):
                own[r.randrange(len(own))] = word()
            out.append((k, " ".join(own)))
            k += 1
    return out


@pytest.mark.parametrize("small, block", [(jaccard.SMALL, jaccard.BLOCK), (3, 4)])
def test_jaccard_join(spark, docs, awkward, nothing, small, block, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    made = spark.createDataFrame(near_copies(3), "doc_id long, text string")
    for t in (made, docs) if small > 3 else (made, awkward):
        rows = [(r.doc_id, r.text) for r in t.select("doc_id", "text").collect()]
        assert sorted(map(tuple, jaccard.join(t).select("doc_id", "class_id", "n_links").collect()), key=repr) == plain_join(rows)
    assert jaccard.join(nothing).collect() == []


@pytest.mark.parametrize("block", [jaccard.BLOCK, 2])
def test_jaccard_of_null_and_repeated_ids(spark, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_copies(9, groups=6)
    nameless = [(None if k % 3 else k, t) for k, t in rows]
    for own in (nameless, [(None, t) for _, t in rows], nameless + nameless[::2], rows + rows[::3]):
        got = jaccard.join(spark.createDataFrame(own, "doc_id long, text string")).select("doc_id", "class_id", "n_links")
        assert sorted(map(tuple, got.collect()), key=repr) == plain_join(own)


def test_one_of_each(docs, awkward, nothing):
    classes = {r.class_id for r in jaccard.join(docs).collect()}
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(classes)
    own = jaccard.one_of_each(awkward).collect()
    assert sorted((r.doc_id for r in own), key=repr) == sorted([1, 3, 4, None, 5, 6, 7, 8, 9], key=repr)
    assert jaccard.one_of_each(nothing).collect() == []


def test_one_of_each_goes_by_row(spark):
    r = random.Random(12)
    a, b, c, d = (" ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(60)) for _ in range(4))
    near = lambda t: t + " more"
    for rows, want in (
        ([(0, near(a)), (1, a), (1, b)], [(0, near(a)), (1, b)]), ([(1, a), (1, b)], [(1, a), (1, b)]), ([(1, a), (1, a), (1, near(a)), (2, a)], [(1, a)]), ([(1, None), (1, ""), (1, a)], [(1, None), (1, ""), (1, a)]),
        ([(None, c), (None, near(c)), (None, d)], [(None, c), (None, d)]), ([(5, near(c)), (None, c), (None, d)], [(5, near(c)), (None, d)]),
    ):
        got = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_shingle_hashes_tell_sets_apart():
    r = random.Random(1)
    texts = [" ".join(r.choices(["a", "b", "ab", "ba", "é", "x1"], k=r.randint(0, 12))) for _ in range(2_000)]
    by = collections.defaultdict(set)
    for t in texts:
        own = jaccard.shingles(t)
        assert len(own) == len(shingle_set(t))
        by[own.tobytes()].add(frozenset(shingle_set(t)))
    assert all(len(v) == 1 for v in by.values())


def test_embedding_agreement_estimates_similarity():
    r = np.random.default_rng(2)
    for share in (0.5, 0.8, 0.9):
        found = []
        for _ in range(60):
            n = 400
            common = int(round(2 * n * share / (1 + share)))
            pool = r.integers(0, 2**64, 2 * n - common, np.uint64)
            a, b = jaccard.embedded(pool[:n]), jaccard.embedded(pool[n - common :])
            found.append((a == b).mean())
        assert abs(np.mean(found) - share) < 0.03


def test_components(spark):
    r = random.Random(5)
    for _ in range(3):
        edges = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(r.randint(1, 350))] + [(k, k + 1) for k in range(1000, 1200)] + [(5000, k) for k in range(5001, 5400)]
        parent = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        got = {x["v"]: x["root"] for x in components.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
        assert got == {v: find(v) for v in parent}


def plain_vectors(rows):
    good = [(i, np.array(v, np.float64)) for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = collections.defaultdict(set)
    for (i, a), (j, b) in itertools.combinations(good, 2):
        if len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.95:
            links[i].add(j)
            links[j].add(i)
    out = []
    for i, (k, _) in enumerate(rows):
        group, todo = {i}, [i]
        while todo:
            todo += (new := links[todo.pop()] - group)
            group |= new
        least = min((rows[g][0] for g in group if rows[g][0] is not None), default=None)
        out.append((k, len(links[i]), least, k == least or k is None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("tile", [embeddings.TILE, 40])
def test_embeddings(spark, sf, tile):
    r = np.random.default_rng(8)
    rows = []
    for k in range(60):
        base = r.standard_normal(24)
        for _ in range(int(r.integers(1, 8))):
            rows.append((len(rows), (base + r.standard_normal(24) * r.choice([0, 0.1, 0.25])).astype(np.float32).tolist()))
    rows += [(900, None), (901, []), (902, [0.0] * 24), (903, [None] * 24), (904, [float("nan")] * 24), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (None, rows[0][1]), rows[3], rows[3]]
    made = spark.createDataFrame([(k, v, "x", 1.0) for k, v in rows], "vec_id long, embedding array<float>, key string, first double")
    got = embeddings.near_dedup(made, tile=tile)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_vectors(rows)


def test_embeddings_of_table(spark, sf):
    t = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in t.collect()]
    assert sorted(map(tuple, embeddings.near_dedup(t).collect()), key=repr) == plain_vectors(rows)
    assert embeddings.near_dedup(t.limit(0)).collect() == []


def pairs_at(r, n, dim, cosine):
    """n unit vectors, and one at the cosine to each."""
    x = r.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = r.standard_normal((n, dim))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    return x, cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1, keepdims=True)


@pytest.mark.parametrize("cosine", [0.7, 0.9, 0.95])
def test_collision_counts_reach_their_recall(cosine):
    dim, n = 64, 3_000
    d, (projections, window, least) = embeddings.directions(dim), embeddings.calibrated(cosine)
    x, y = pairs_at(np.random.default_rng(0), n, dim, cosine)
    half = window * embeddings.spread(dim, cosine)
    count = (np.abs(x @ d - y @ d)[:, 1 : 1 + projections] <= half).sum(axis=1)
    lost = (count < least).sum() + (np.abs(x @ d[:, 0] - y @ d[:, 0]) > embeddings.FIRST * embeddings.spread(dim, cosine)).sum()
    assert lost <= 3


def test_window_counts_match_plain_counts():
    r = np.random.default_rng(3)
    for n, k in ((1, 16), (63, 16), (64, 24), (300, 24), (1_000, 32)):
        values, queries = r.standard_normal((n, k)), r.standard_normal((70, k))
        values[: n // 3, 0] = 0.5  # ties
        own = embeddings.Windows(values)
        low, high = own.edges(queries, 0.4)
        for least in (1, 3, k // 4, k):
            bits = np.unpackbits(own.reached(low, high, least).view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)
            plain = (np.abs(values[None] - queries[:, None]) <= 0.4).sum(axis=2) >= least
            assert (bits | ~plain).all()  # windows are rounded outwards only
            inside = np.zeros((70, n), int)
            for j in range(k):
                rank = np.empty(n, int)
                rank[np.argsort(values[:, j], kind="stable")] = np.arange(n)
                inside += (rank[None] >= low[j][:, None] * embeddings.STEP) & (rank[None] < high[j][:, None] * embeddings.STEP)
            assert (bits == (inside >= least)).all()


def test_first_window_and_other_cosines(spark):
    assert math.erfc(embeddings.FIRST / math.sqrt(2)) <= embeddings.MISSED
    n = 1_000
    for cosine, own in ((0.7, 0.701), (0.9, 0.901), (0.95, 0.951)):
        rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate(pairs_at(np.random.default_rng(1), n, 64, own)))]
        got = embeddings.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cosine=cosine).collect()
        assert {r.vec_id: r.component_id for r in got if r.n_links} == {k: k % n for k in range(2 * n)}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    df = queries.queries()[name](spark, sf).select(*names)
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(found.fetchall(), key=repr)


def test_pipeline_matches_plain_version(spark, sf):
    """Every stage but the classifier against plain code; the classifier's decisions are taken as they are."""
    docs = table(spark, sf, "documents")
    first = corpus_pipeline.toxic(spark, docs, sf)
    kept = {r.doc_id: r for r in first.collect()}
    assert first.columns == docs.columns and set(kept) <= {r.doc_id for r in docs.collect()}
    rows = sorted(kept.values(), key=lambda r: r.doc_id)
    texts = {r.doc_id: t for r, (_, _, t) in zip(rows, plain_lines([r.text for r in rows], 10), strict=True)}
    classes = plain_join(sorted(texts.items()))
    own = {k: texts[k] for k, c, _ in classes if k == c}
    source = {k: kept[k].source for k in own}
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for k, t in own.items()}
    total = collections.Counter()
    for k, s in source.items():
        total[s] += size[k]
    target = plain_targets(dict(total))
    import hashlib

    want = []
    for k in own:
        rate = target[source[k]] / total[source[k]] if total[source[k]] else 0.0
        u = int(hashlib.md5(f"mix-1:{k}".encode()).hexdigest()[:13], 16) / 2**52
        copies = int(rate) + (u < rate - int(rate))
        want += [(k, hashlib.sha256(own[k].encode()).hexdigest())] * copies
    got = corpus_pipeline.run(spark, sf).select("doc_id", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_pipeline_on_awkward_rows(spark, awkward, nothing, sf):
    for t in (awkward, nothing):
        now = t
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, sf)
            assert now.columns == t.columns
        assert corpus_pipeline.STAGES[-1][1](spark, now, sf).count() == now.count()


def test_release_deletes_written_tables(spark):
    kept = common.written(spark.range(3), "some")
    assert kept.count() == 3
    at = common._tables[-1]
    common.release(spark)
    assert not common._tables and not os.path.exists(at.removeprefix("file://"))
