import math
import zlib
from collections import Counter

import numpy as np
import pytest

from novelspark.llm import gru, lm_scoring
from novelspark.llm.gru import GRU, laid_out, lanes_of


def base(rows):
    learnt = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 10 != 0
    tokens = [(k, (t or "").encode().lower().split() + [None]) for k, t in rows]
    c = Counter(w for k, ws in tokens if learnt(k) for w in ws)
    total, v = sum(c.values()), len(c)
    norm = math.log10(total + 0.1 * (v + 1))
    return total, [(k, not learnt(k), len(ws), sum(c[w] > 0 for w in ws), sum(math.log10(c[w] + 0.1) - norm for w in ws)) for k, ws in tokens]


def key(r):
    return (r[0] is not None, *map(lambda x: x if x is not None else 0, r[:4]), round(r[4], 5))


@pytest.mark.parametrize("head", [50_000, 40, 0])
def test_counts_equal_brute_force(spark, head):
    d = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    rows += [(5000, None), (5001, ""), (5002, "  \t"), (None, "The the\x0bTHE é É"), (7, rows[7][1]), (5003, "une" * 90000 + " x" * 30000)]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, n int").repartition(5)
    got = lm_scoring.score(df, head=head).collect()
    total, want = base(rows)
    assert {r["train_tokens"] for r in got} == {total}
    got_rows = sorted([(r["doc_id"], not r["learn"], r["n_tokens"], r["n_known"], r["base_score"]) for r in got], key=key)
    for a, b in zip(got_rows, sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_model_beats_the_counts_on_held_out_texts(spark):
    got = lm_scoring.op7_lm_scoring(spark, "/root/testdata/sf0.1").where("held_out").collect()
    assert len(got) > 500
    score, base_score = (sum(r[c] for r in got) / sum(r["n_tokens"] for r in got) for c in ("score", "base_score"))
    print(f"held out, log10 a token: {score:.3f}, counts {base_score:.3f}")
    assert score > base_score + 0.2


def test_probabilities_sum_to_one_and_gradients_hold(monkeypatch):
    monkeypatch.setattr(gru, "F32", np.float64)
    rnd = np.random.default_rng(0)
    g = GRU.new(rnd.integers(1, 50, 12).astype(float), 3, 5)
    g.p = {k: v.astype(float) * 3 for k, v in g.p.items()}
    tokens, h = rnd.integers(0, 12, (6, 4)), rnd.standard_normal((5, 4)) * 0.3
    keep = (tokens != 11).astype(float)
    states = g.forward(tokens, keep, h)[0].transpose(0, 2, 1).reshape(-1, 5)
    whole = sum(np.exp(g.log_probabilities(states, np.full(len(states), w))) for w in range(12))
    assert np.allclose(whole, 1)

    def loss():
        s, _ = g.forward(tokens, keep, h)
        return -g.log_probabilities(s.transpose(0, 2, 1).reshape(-1, 5), tokens.reshape(-1)).mean()

    grads, _ = g.gradients(tokens, keep, h)
    for name, v in g.p.items():
        for _ in range(3):
            i = tuple(rnd.integers(0, n) for n in v.shape)
            held = v[i]
            v[i] = held + 1e-5
            up = loss()
            v[i] = held - 1e-5
            down = loss()
            v[i] = held
            assert abs((up - down) / 2e-5 - grads[name][i]) < 1e-6


def test_lanes_and_windows_change_no_score():
    rnd = np.random.default_rng(1)
    g = GRU.new(rnd.integers(1, 50, 16).astype(float), 4, 6)
    g.p["u"] *= 5
    texts = [np.append(rnd.integers(0, 15, n), 15).astype(np.int32) for n in (0, 3, 200, 7, 40, 0, 1)]
    alone = np.array([g.score([t], 15)[0] for t in texts])
    for lanes, window in ((1, 4), (3, 32), (99, 7)):
        assert np.allclose(g.score(texts, 15, lanes, window), alone, rtol=1e-4)
    for steps in (1, 5, 300):
        parts = list(laid_out(texts, lanes_of([len(t) for t in texts], 3), 15, steps))
        assert sum((owner < 7).sum() for _, owner, _ in parts) == sum(map(len, texts))
        read = {j: [] for j in range(7)}
        for tokens, owner, _ in parts:
            for j in range(7):
                read[j] += tokens.T[owner.T == j].tolist()
        assert all(read[j] == t.tolist() for j, t in enumerate(texts))
    assert list(laid_out([], [], 15, 4)) == []


def test_memory_follows_the_tokens():
    import tracemalloc

    g = GRU.new(np.ones(64), 8, 8)
    texts = [np.append(np.arange(n) % 63, 63).astype(np.int32) for n in [60_000, *[50] * 500]]
    tracemalloc.start()
    g.score(texts, 63)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm_scoring.score(df).count() == 0


def test_all_training_texts_are_learnt_from(spark, monkeypatch):
    made = {}
    plain = lm_scoring.train

    def train(rows, corpus, *args):
        made["model"], made["seen"] = plain(rows, corpus, *args)
        made["corpus"] = corpus
        return made["model"], made["seen"]

    monkeypatch.setattr(lm_scoring, "train", train)
    rows = [(k % 150 or None, f"common words in all texts and word{k} here, elsewhere") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm_scoring.score(df.repartition(3)).collect()
    assert made["seen"] == got[0]["train_tokens"] == sum(r["n_tokens"] for r in got if r["learn"])
    _, h = lm_scoring.words(np.frombuffer(b"elsewhere", np.uint8), np.array([9]))
    assert made["corpus"].of_head[np.searchsorted(made["corpus"].head, h[0])] >= 0 and h[0] in made["corpus"].head
    # The scores again, from the model and the whole counts: a symbol's log probability, and a word's share of its class.
    corpus, model, learnt = made["corpus"], made["model"], Counter()
    for (_, t), r in zip(rows, df.select(lm_scoring.training()).collect(), strict=True):
        learnt.update(lm_scoring.words(np.frombuffer(t.encode(), np.uint8), np.array([len(t.encode())]))[1].tolist() if r[0] else [])
    want = []
    for k, t in rows:
        data = np.frombuffer(t.encode(), np.uint8)
        _, _, symbol, outside = corpus.read(data, np.array([len(data)]))
        own = model.score([np.append(symbol, np.int32(corpus.end))], corpus.end)[0]
        h = lm_scoring.words(data, np.array([len(data)]))[1].tolist()
        own += sum(math.log10(learnt[x] + 0.1) - corpus.tail_norm[o] for x, o in zip(h, outside.tolist(), strict=True) if o >= 0)
        want.append((-1 if k is None else k, own))
    assert np.allclose(sorted((-1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in got), sorted(want), atol=1e-3)
    # Neither the layout of the rows nor their order changes the model.
    before = made["model"].p
    lm_scoring.score(df.orderBy(lm_scoring.F.desc("text")).repartition(7)).collect()
    assert all((before[n] == made["model"].p[n]).all() for n in before)


def test_many_rows_of_one_key_keep_their_own_sums(spark):
    rows = [(None, f"word{i} " * (1 + i % 3) + f"other{i}") for i in range(900)]
    got = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), head=0)
    want = base(rows)[1]
    assert sorted(round(r["base_score"], 6) for r in got.collect()) == sorted(round(w[4], 6) for w in want)
