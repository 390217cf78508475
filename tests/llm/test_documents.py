"""Exact and near dedup, mixing, packing, quality and the pipeline on awkward rows, against brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.llm import minhash, mixing, packing, quality
from spindrift.llm.components import components
from spindrift.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from spindrift.llm.queries import ORACLE_SQL, QUERIES, mixture_targets, vocabulary
from spindrift.llm.shingles import shingle_hashes
from tests.llm.conftest import awkward_rows
from tests.oracle import assert_same, duck

FOLD = {c: c + 32 for c in range(65, 91)}


def shingle_set(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[k:k + width]) for k in range(len(w) - width + 1)])


def brute_components(rows, percent):
    sets = {r[0]: shingle_set(r[1]) for r in rows if r[0] is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_exact_duplicates(spark, awkward, nothing):
    rows = awkward_rows()
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[(t or "").translate(FOLD)].append(i)
    want = sorted((str(i), str(max((x for x in groups[k] if x is not None), default=None)), len(groups[k]), hashlib.sha256(k.encode()).hexdigest()) for i, t, *_ in rows for k in [(t or "").translate(FOLD)])
    got = exact_duplicates(awkward).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    kept = drop_exact_duplicates(awkward)
    assert kept.columns == awkward.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}
    assert exact_duplicates(nothing).count() == 0 and drop_exact_duplicates(nothing).columns == nothing.columns


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_its_twin(spark, data_dir, name):
    assert_same(QUERIES[name](spark, data_dir).toPandas(), duck(ORACLE_SQL[name], data_dir))


@pytest.mark.parametrize("options", [{}, {"small": 1, "tile_rows": 6}])
def test_near_duplicates_equal_brute_force(awkward, options):
    root, size = brute_components(awkward_rows(), 85)
    got = minhash.near_duplicates(awkward, percent=85, **options).collect()
    assert len(got) == len(awkward_rows())
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (root[r.doc_id], size[r.doc_id], root[r.doc_id] == r.doc_id)


def test_large_bucket_links_beside_its_leader(spark):
    """Twenty pairs of near copies that share large buckets of one template; the leader joins at most its own pair there."""
    common = [f"w{j}" for j in range(300)]
    rows = []
    for k in range(20):
        own = common + [f"own{k}x{j}" for j in range(25)]
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(own[:-2] + [f"last{k}"] * 2))]
    root, _ = brute_components(rows, 90)
    assert len(set(root.values())) == 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({}, {"tile_rows": 6}):
        got = minhash.near_duplicates(docs, percent=90, rows=1, **options).collect()
        assert {r.doc_id: r.component_id for r in got} == root


def test_near_drop_and_empty(awkward, nothing):
    root, _ = brute_components(awkward_rows(), 80)
    kept = minhash.drop_near_duplicates(awkward, percent=80)
    assert kept.columns == awkward.columns
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == {i for i in root if root[i] == i}
    assert minhash.near_duplicates(nothing).count() == 0


def test_shingle_hashes_count_sets():
    texts = [r[1] or "" for r in awkward_rows()]
    h, d = shingle_hashes([t.encode() for t in texts], 5)
    assert np.bincount(d, minlength=len(texts)).tolist() == [len(shingle_set(t)) for t in texts]


def test_registers_estimate_jaccard():
    rng = np.random.default_rng(1)
    for n, share in ((400, 0.85), (60, 0.5), (3, 1.0)):
        agree = []
        for _ in range(40):
            a = rng.integers(0, 2**63, n, dtype=np.uint64)
            b = a.copy()
            new = n - int(round(2 * n * share / (1 + share)))
            b[:new] = rng.integers(0, 2**63, new, dtype=np.uint64)
            t = minhash.register_table(np.concatenate([a, b]), np.repeat([0, 1], n), 2, 128)
            agree.append((t[0] == t[1]).mean())
        j = (n - new) / (n + new)
        assert abs(np.mean(agree) - j) < 0.06


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 9), (9, 8), (5, 5), (4, 1), (None, 7)], "a long, b long")
    for spread in (1_000, 0):
        assert {r.id: r.root for r in components(links, one_task_edges=spread).collect()} == {2: 1, 3: 1, 4: 1, 9: 8, 10: 8}
    assert components(links.limit(0)).count() == 0


def test_mixing_meets_marginals(awkward, nothing):
    targets = mixing.Targets({"src0": 0.4, "*": 0.6}, {"en": 0.5, "*": 0.5}, {"prose": 1.0}, budget=0.3)
    got = mixing.mix(awkward, targets).collect()
    assert len(got) == len(awkward_rows())
    total = sum({(r.source_group, r.lang_group, r.topic): r.weight for r in got}.values())
    for column, shares in (("source_group", targets.source), ("lang_group", targets.lang)):
        by = collections.Counter()
        for cell in {(r.source_group, r.lang_group, r.topic, r.weight): r for r in got}.values():
            by[getattr(cell, column)] += cell.weight / total
        assert all(abs(by[k] - v) < 1e-6 for k, v in shares.items())
    assert abs(sum(r.tokens * r.probability for r in got) - 0.3 * sum(r.tokens for r in got)) < 1e-3 * sum(r.tokens for r in got)
    for r in got:
        u = int(hashlib.md5(f"0:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:12], 16) / 16**12
        assert r.sampled == (u < r.probability)
    assert mixing.sample_mixture(awkward, targets).columns == awkward.columns
    assert mixing.mix(nothing, targets).count() == 0


def test_rake_against_plain_loop():
    rng = np.random.default_rng(2)
    tokens, cells = rng.uniform(1, 9, 24), np.array([(a, b, c) for a in range(3) for b in range(4) for c in range(2)])
    shares = [{0: 0.2, 1: 0.3, 2: 0.5}, {k: 0.25 for k in range(4)}, {0: 0.6, 1: 0.4}]
    w = mixing.rake(tokens, cells, shares)
    plain = tokens / tokens.sum()
    for _ in range(500):
        for k, s in enumerate(shares):
            for g, want in s.items():
                plain[cells[:, k] == g] *= want / plain[cells[:, k] == g].sum()
    assert np.allclose(w, plain, atol=1e-9)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n\r\x0b\x1c\x85\xa0 'sdtrevml.,!9½²éñßЖ漢a‍"), st.characters(codec="utf-8")), max_size=40))
def test_encode_equals_tokenizer(text):
    from tokenizers import Tokenizer

    tok = test_encode_equals_tokenizer.__dict__.setdefault("tok", Tokenizer.from_file(vocabulary()))
    tok.encode_special_tokens = True
    assert np.frombuffer(packing.encode(text, vocabulary()), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_patterns_use_every_piece_once(histogram):
    patterns = packing.shortest_pack_first(histogram, 64)
    used = collections.Counter()
    for p, c in patterns:
        assert sum(p) <= 64 and c > 0
        for x in p:
            used[x] += c
    assert used == collections.Counter(histogram)


@pytest.mark.parametrize("options", [{}, {"size": 16, "least_bucket": 3}])
def test_packing_round_trip(awkward, options):
    size = options.get("size", 2048)
    got = packing.pack(awkward, vocabulary(), **options).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    sequences, docs = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
        docs[r.doc_id].append(r)
    assert sorted(sequences) == list(range(len(sequences)))
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    texts = collections.defaultdict(list)
    for i, t, *_ in awkward_rows():
        texts[i].append(t)
    for i, ts in texts.items():
        raw = packing.encode(ts[0] or "", vocabulary()) + (1).to_bytes(4, "little")
        pieces = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in docs[i])
        want = [(s, min(size, len(raw) // 4 - s), zlib.crc32(raw[4 * s:4 * (s + size)]), len(raw) // 4) for s in range(0, len(raw) // 4, size)]
        assert pieces == sorted(want * len(ts))


def test_packing_empty(nothing):
    assert packing.pack(nothing, vocabulary()).count() == 0


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(docs, labels, dictionary_rows=200, calibration_rows=500)
    some = docs.join(labels.select("doc_id", "quality"), "doc_id").where(quality.held_out(F.col("doc_id")))
    scored = quality.quality_scores(some, model).join(some.select("doc_id", "quality"), "doc_id").collect()
    good, bad = ([r.predicted for r in scored if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.15
    assert all(r.held_out and zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in scored)


def test_quality_edges(spark, awkward, nothing):
    labels = spark.createDataFrame([(100 + k, k % 2) for k in range(20)] + [(200 + k, 1) for k in range(20)] + [(None, 1), (4, None), (5, 7)], "doc_id long, quality int")
    for lab in (labels, labels.limit(0), labels.where("quality = 1")):
        got = quality.quality_scores(awkward, quality.fit_quality(awkward, lab)).collect()
        assert len(got) == len(awkward_rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    model = quality.fit_quality(nothing, labels)
    assert quality.quality_scores(nothing, model).count() == 0
    assert quality.keep_good(awkward, quality.fit_quality(awkward, labels.where("quality = 1"))).columns == awkward.columns


def test_pipeline_stages_chain(spark, data_dir):
    import corpus_pipeline as c
    from spindrift.llm.workspace import materialize

    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    columns, before = docs.columns, docs.toPandas().set_index("doc_id")
    for name, stage in c.STAGES:
        out = materialize(stage(spark, docs, data_dir), name)
        if name != "packing":
            assert out.columns == columns
            ids = {r.doc_id for r in out.select("doc_id").collect()}
            here = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
            assert ids <= set(here)
            if name == "exact_dedup":
                last = {}
                for i, t in here.items():
                    last[t.translate(FOLD)] = max(i, last.get(t.translate(FOLD), i))
                assert ids == set(last.values())
            if name == "near_dedup":
                root, _ = brute_components(list(here.items()), 80)
                assert ids == {i for i in root if root[i] == i}
            docs = out
        else:
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert len(before) == 200
