import zlib

import numpy as np
import zstandard

from novelspark.llm.quality import CompressionModel, fit, op9_quality_classifier, score, spread


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = op9_quality_classifier(spark, d).collect()
    assert len(rows) == 10_000
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    kept = {y: [p for t, p in held if t == y] for y in (0, 1)}
    assert sum(kept[1]) / len(kept[1]) > 0.98
    assert sum(kept[0]) / len(kept[0]) < 0.12


def test_empty_null_and_clashing_columns(spark):
    good = ["The weather was mild and we walked along the river for an hour, talking of nothing %d." % i for i in range(40)]
    bad = ["BUY!! NOW!! CHEAP!! CLICK!! %d WIN!! FREE!! CASH!! CLICK!! NOW!!" % i for i in range(40)]
    rows = [(i, t, "s") for i, t in enumerate(good + bad)]
    labels = [(i, int(i < 40)) for i in range(80)] + [(3, None), (999, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    model = fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    more = spark.createDataFrame([(1, None, 0), (1, "", 0), (2, good[3], 0), (2, good[3], 0), (3, bad[4] * 3000, 0)], "doc_id long, text string, _0 int")
    got = [(r["doc_id"], r["score"]) for r in score(more, model).collect()]
    assert got[0] == got[1] == (1, model.prior)
    assert got[2] == got[3] and got[2][1] > 0.5 > got[4][1]
    assert score(more.limit(0), model).count() == 0
    none = fit(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int"))
    assert none.score(b"x") == 0.5 and CompressionModel.fit([b"a"], [1]).score(b"b") > 0.5


def blocks_of(text, most=None):
    """Blocks of 512 bytes; of very many, most of them at even distances."""
    parts = [text[i : i + 512] for i in range(0, len(text), 512)]
    if most is not None and len(parts) > most:
        parts = [parts[int(j * (len(parts) - 1) / (most - 1))] for j in range(most)]
    return parts


def test_scores_equal_a_model_written_from_zstandard_alone(spark):
    d = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{d}/labels.parquet").collect()]
    learnt = sorted((k, y) for k, y in labels if zlib.crc32(str(k).encode()) % 3 != 1 and texts.get(k) and y in (0, 1))
    by = {y: [b"".join(blocks_of(texts[k], 40)) for k, z in learnt if z == y] for y in (0, 1)}
    coders = {}
    for y in (0, 1):
        parts = [p for t in by[y][::2] for p in blocks_of(t)]
        trained = zstandard.train_dictionary(min(65536, max(1024, sum(map(len, parts)) // 4)), parts)
        coders[y] = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained.as_bytes()), write_content_size=False, write_checksum=False, write_dict_id=False)

    def measures(t):
        sizes = [sum(len(coders[y].compress(p)) for p in blocks_of(t)) for y in (0, 1)]
        return [(sizes[0] - sizes[1]) / sum(sizes), np.log(sum(sizes) / len(t))]

    x = np.array([measures(t) for y in (0, 1) for t in by[y][1::2]])
    y = np.array([y for y in (0, 1) for _ in by[y][1::2]], float)
    # Platt's targets; the optimum of the penalised likelihood by plain gradient steps.
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a = np.column_stack([(x - x.mean(0)) / (x.std(0) + 1e-9), np.ones(len(x))])
    w = np.zeros(3)
    for _ in range(60_000):
        w += (a.T @ (target - 1 / (1 + np.exp(-a @ w))) - 0.01 * w) / len(x)
    want = {}
    for k, t in texts.items():
        if t:
            m = np.clip(measures(t), x.min(0), x.max(0))
            want[k] = 1 / (1 + np.exp(-(w[:2] @ ((m - x.mean(0)) / (x.std(0) + 1e-9)) + w[2])))
        else:
            want[k] = (len(by[1]) + 1) / (len(by[0]) + len(by[1]) + 2)
    got = {r["doc_id"]: r["score"] for r in op9_quality_classifier(spark, d).collect()}
    assert set(got) == set(want)
    worst = max(abs(got[k] - want[k]) for k in want)
    assert worst < 0.005, worst


def test_long_labelled_texts_are_learnt_from_in_blocks_of_all_of_them(spark):
    text = b"".join(b"%07d|" % i for i in range(9000))
    kept = spread(text, 512, 40)
    assert len(kept) <= 40 * 512 and kept[:512] == text[:512] and text.endswith(kept[-(len(text) % 512 or 512) :]) and spread(text[:20480], 512, 40) == text[:20480]
    good, bad = ["The river ran on, slow and brown, past mills and meadows, number %d. " % i * 900 for i in range(8)], ["BUY %d NOW!! CLICK!! " % i * 3000 for i in range(8)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    model = fit(docs, spark.createDataFrame([(i, int(i < 8)) for i in range(16)], "doc_id long, quality int"))
    assert model.good and model.score(good[0][:3000].encode()) > 0.5 > model.score(bad[1][:3000].encode())


def test_ties_get_one_score(spark):
    docs = spark.createDataFrame([(i, "same text") for i in range(5)] + [(None, "same text")], "doc_id long, text string")
    model = CompressionModel.fit([b"good text %d" % i for i in range(30)] + [b"BAD %d" % i for i in range(30)], [1] * 30 + [0] * 30)
    assert len({r["score"] for r in score(docs, model).collect()}) == 1
