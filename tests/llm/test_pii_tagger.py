"""The tagger over whole texts: every window, window borders, many spans, and planted spans in held-out documents."""

import random
import time

import numpy as np
import pytest

from spindrift.llm import pii
from spindrift.llm.char_tagger import Tagger


@pytest.fixture(scope="module")
def model():
    return pii.fit_tagger()


def test_exits_change_nothing(model, spark, data_dir):
    texts = [r.text or "" for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("text").collect()]
    ids = np.zeros((400, pii.WINDOW), np.int64)
    rows = [(t, s, e) for t in texts for s, e in pii.windows(len(t))][:400]
    for k, (t, s, e) in enumerate(rows):
        ids[k, :e - s] = pii.char_ids(t[s:e])
    assert (model.decode(ids) == model.decode(ids, skip_plain=False)).all()


class Digits:
    """A stand-in for the tagger: runs of digits are cards."""

    def decode(self, ids):
        digit = (ids >= 17) & (ids <= 26)
        begin = digit & ~np.pad(digit, ((0, 0), (1, 0)))[:, :-1]
        return np.where(digit, 6 - begin, 0).astype(np.int8)


def test_windows_cover_a_text_and_borders_lose_nothing():
    for size in (0, 1, pii.WINDOW, pii.WINDOW + 1, 3 * pii.STRIDE, 5000):
        seen = np.zeros(size, bool)
        for s, e in pii.windows(size):
            seen[s:e] = True
        assert seen.all()
    number = "1234567890123456"
    texts = ["x" * k + number + "y" * (900 - k) for k in range(900)]
    assert pii.tagged(texts, Digits()) == [[("card", k, k + 16)] for k in range(900)]
    several = "".join(f"{number[:15 + k % 4]} " + "z" * (k % 7) for k in range(400))
    want, at = [], 0
    for k in range(400):
        want.append(("card", at, at + 15 + k % 4 if k % 4 < 2 else at + 16))
        at += len(number[:15 + k % 4]) + 1 + k % 7
    assert pii.tagged([several], Digits()) == [want]


def test_a_hundred_thousand_spans():
    spans = [("phone", 20 * k, 20 * k + 12) for k in range(100_000)] + [("card", 20 * k + 5, 20 * k + 19) for k in range(100_000)]
    began = time.process_time()
    assert pii.reconcile(spans) == [("card", 20 * k + 5, 20 * k + 19) for k in range(100_000)]
    free = pii.Free([(s, e) for k, s, e in spans if k == "phone"])
    assert not any(free.has(s, e) for k, s, e in spans if k == "card") and free.has(12, 20)
    assert time.process_time() - began < 20


def test_sweep_equals_pairwise():
    rng = random.Random(3)
    for _ in range(300):
        spans = [(rng.choice(pii.KINDS), s := rng.randint(0, 60), s + rng.randint(1, 9)) for _ in range(rng.randint(0, 14))]
        merged = []
        for kind in pii.KINDS:
            for s, e in sorted((s, e) for k, s, e in spans if k == kind):
                if merged and merged[-1][0] == kind and s < merged[-1][2]:
                    merged[-1] = (kind, merged[-1][1], max(e, merged[-1][2]))
                else:
                    merged.append((kind, s, e))
        kept = []
        for k, s, e in sorted(merged, key=lambda x: (x[1] - x[2], x[1])):
            if all(e <= a or s >= b for _, a, b in kept):
                kept.append((k, s, e))
        assert pii.reconcile(spans) == sorted(kept, key=lambda x: x[1])


def planted(texts, seed):
    """Documents without base spans, with labelled spans put between their words."""
    rng = random.Random(seed)
    made = [(t[s:e], k) for t, spans in pii.labelled_texts(600, seed) for k, s, e in spans]
    out = []
    for text in texts:
        if any(pii.base_spans(text).values()) or len(text) < 200:
            continue
        words, spans, at, built = text.split(" "), [], 0, []
        for w in words:
            built.append(w)
            at += len(w) + 1
            if rng.random() < 0.02:
                value, kind = rng.choice(made)
                spans.append((kind, at, at + len(value)))
                built.append(value)
                at += len(value) + 1
        out.append((" ".join(built), spans))
    return out


def rates(model, docs):
    got = pii.tagged([t for t, _ in docs], model)
    found, want = ({(n, *s) for n, spans in enumerate(x) for s in spans} for x in (got, [s for _, s in docs]))
    return len(found & want) / len(found), len(found & want) / len(want), len(want)


def test_planted_spans_in_documents(model, spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r.text]
    precision, recall, n = rates(model, planted(texts[:300], 777))
    assert n > 200 and precision > 0.75 and recall > 0.7


def test_added_spans_on_documents(model, spark):
    """Numbers of a card's form with a wrong check digit are in the table; the patterns leave them out."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    want = {(i, *m.span()) for i, t in texts.items() for m in pii.CARD.finditer(t) if 16 <= len(d := pii.digits_of(m[0])) <= 19 and not pii.luhn(d)}
    got = {r.doc_id: r.spans.split(",") for r in pii.find_personal_data(docs, model).collect()}
    caught = sum(f"card_like:{s}:{e}" in got[i] for i, s, e in want)
    assert want and caught >= 0.9 * len(want)


def plain_search(model, ids):
    """Best paths window by window, with back pointers."""
    e, trans = model.emissions(ids).astype(np.float64), model.p["trans"].astype(np.float64)
    paths = np.zeros(ids.shape, np.int64)
    for k in range(len(ids)):
        score, back = e[0, :, k] + model.p["start"], []
        for t in range(1, len(e)):
            ways = score[:, None] + trans
            back.append(ways.argmax(0))
            score = ways.max(0) + e[t, :, k]
        tag = int(score.argmax())
        for t in range(len(e) - 1, -1, -1):
            paths[k, t] = tag
            tag = int(back[t - 1][tag]) if t else tag
    return paths


def test_stretches_of_open_places_hold_every_best_path():
    rng = np.random.default_rng(5)
    for seed in range(6):
        made = Tagger.fresh(9, 12, 16, np.random.default_rng(seed))
        made.p |= {"trans": rng.normal(0, 1, (9, 9)).astype(np.float32), "start": rng.normal(0, 1, 9).astype(np.float32), "bo": rng.normal(0, 1, 9).astype(np.float32)}
        made.p["bo"][0] += 1.5 * seed  # from spans everywhere to few
        ids = rng.integers(1, 98, (20, 70))
        assert (made.decode(ids) == plain_search(made, ids)).all()
        scores = np.concatenate([made._run(ids, d, None) for d in "fb"], axis=2) @ made.p["wo"] + made.p["bo"]
        assert np.allclose(made.emissions(ids).transpose(0, 2, 1), scores - scores[:, :, :1], atol=1e-4)


def test_only_open_places_are_searched(model, spark, data_dir):
    texts = [r.text for r in spark.read.parquet(f"{data_dir}/documents.parquet").where("length(text) >= 576").select("text").limit(200).collect()]
    ids = np.stack([pii.char_ids(t[:pii.WINDOW]) for t in texts])
    assert 0 < model._open(model.emissions(ids)).mean() < 0.25
    assert (model.decode(ids[:40]) == plain_search(model, ids[:40])).all()
