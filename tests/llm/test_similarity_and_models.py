"""Near-duplicates, vector links, classifiers and the pipeline: brute force, held-out accuracy."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from scorecast.llm import embeddings, labelled, minhash, oracles, packing, quality, queries, secrets, toxicity
from scorecast.llm.components import connected_components
from scorecast.llm.scratch import ship_package
from tests.conftest import SF_SMALL
from tests.llm.test_text_operators import DOCS, _docs
from tools.oracle_check import canon, duck_con

MID = "/root/testdata/sf0.01"


def _roots(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("key", sorted(oracles.ORACLES))
def test_queries_equal_their_sql(spark, key):
    got = queries.QUERIES[key](spark, SF_SMALL).toPandas()
    assert canon(got) == canon(duck_con(SF_SMALL).execute(oracles.ORACLES[key]).df())


def test_components_against_brute_force(spark):
    rng = random.Random(9)
    for n, m in ((1, 0), (200, 150), (60, 59)):
        links = [(i, i + 1) for i in range(m)] if m == 59 else [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        links += links[:5] + [(0, 0)]
        edges = spark.createDataFrame([(b, a) for a, b in links], "a long, b long")
        got = {r.node: r.component for r in connected_components(edges).collect()}
        want = {i: c for i, c in enumerate(_roots(n, links)) if c != i}
        assert got == want


def _brute_near(texts, percent=85):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return [len(s) for s in sets], _roots(len(sets), links)


def _family(rng, n, words):
    """Edited copies of one text: pairs around the limit, chains that only members link."""
    base = [f"w{rng.randrange(4000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randint(0, words // 40)):
            t[rng.randrange(words)] = f"e{rng.randrange(10 ** 6)}"
        out.append(" ".join(t))
        if rng.random() < 0.1:
            base = t
    return out


@pytest.mark.parametrize("small_blocks", [False, True])
def test_near_duplicates_against_brute_force(spark, monkeypatch, small_blocks):
    if small_blocks:  # hot band keys and families are cut into many blocks
        monkeypatch.setattr(minhash, "BLOCK_DOCS", 7)
        monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 900)
    rng = random.Random(6)
    texts = [None, "", "   ", "a b", "A B", "a b c d e", "a b c d e f", "x", "x", *_family(rng, 70, 120), *_family(rng, 40, 60),
             *[" ".join(f"u{rng.randrange(10 ** 6)}" for _ in range(50)) for _ in range(30)], *["copy of one text " * 40] * 25]
    n, roots = _brute_near(texts)
    got = {r.doc_id: r for r in minhash.near_duplicates(_docs(spark, texts, extra=True)).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == n
    assert [got[i].component_id for i in range(len(texts))] == roots
    assert all(got[i].kept == (roots[i] == i) for i in got)


def _pairs_at(rng, percent, n, words=200):
    """Pairs of texts whose shingle sets are at, or just above, a similarity."""
    out = []
    for _ in range(n):
        base = [f"p{rng.randrange(10 ** 9)}" for _ in range(words)]
        cut = (words - 4) * (100 - percent) // (100 + percent)  # of m shingles, m - cut stay and cut are new
        out += [" ".join(base), " ".join([*base[:words - cut], *(f"q{rng.randrange(10 ** 9)}" for _ in range(cut))])]
    return out


@pytest.mark.parametrize("percent", [60, 80])
def test_near_duplicates_at_lower_similarities(spark, percent):
    n = 150
    got = {r.doc_id: r for r in minhash.near_duplicates(_docs(spark, _pairs_at(random.Random(8), percent, n)), percent).collect()}
    assert all(got[2 * i].component_id == got[2 * i + 1].component_id == 2 * i for i in range(n))
    apart = minhash.near_duplicates(_docs(spark, _pairs_at(random.Random(8), percent - 2, 20)), percent)
    assert apart.filter("kept").count() == 40


@pytest.mark.parametrize("percent", range(25, 101, 5))
def test_signatures_serve_their_percent(percent):
    plan, share = minhash.scheme(percent), percent / 100
    values = 2 * minhash.PERMUTATIONS
    assert plan.rows * plan.bands <= values
    assert (1 - share ** plan.rows) ** plan.bands <= minhash.MISS
    drawn = np.random.default_rng(5).binomial(values, share, 200_000)
    assert (drawn < plan.agree).mean() < 5e-5


def test_signatures_refuse_what_they_cannot_serve():
    for percent in (0, 5, 101):
        with pytest.raises(ValueError):
            minhash.scheme(percent)


def test_a_large_family_is_not_compared_block_by_block(spark, monkeypatch):
    ship_package(spark)
    rng, dealt, seen = random.Random(8), minhash.dealt, []
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 16)
    monkeypatch.setattr(minhash, "dealt", lambda rows: (seen.append(rows), dealt(rows))[1])
    texts = [f"{' '.join(f'w{k}' for k in range(120))} e{i}" for i in range(400)]  # one family
    texts += _family(rng, 60, 80) + [" ".join(f"r{rng.randrange(9)}" for _ in range(7)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    _, roots = _brute_near(texts)
    assert [got[i] for i in range(len(texts))] == roots and roots[:400] == [0] * 400
    bands = minhash.scheme(85).bands
    within, across = seen[0].count(), seen[1].count()
    assert 300 * bands / 2 < within <= bands * len(texts) and across < within / 4


def test_near_duplicate_edge_rows(spark):
    ship_package(spark)
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (2, "one two three four five six"),
            (None, "one two three four five six"), (3, None), (3, "other words that stand here alone now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == [(-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True)]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def _brute_vectors(vectors, at_least=0.9):
    def usable(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)

    n, links = [0] * len(vectors), []
    for i, a in enumerate(vectors):
        for j, b in enumerate(vectors[:i]):
            if usable(a) and usable(b) and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y >= at_least * np.sqrt((x @ x)) * np.sqrt((y @ y)):
                    n[i] += 1
                    n[j] += 1
                    links.append((i, j))
    return n, _roots(len(vectors), links)


def _vectors():
    rng = np.random.default_rng(3)
    out = [None, [], [0.0, 0.0, 0.0], [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 0.0, 1.0], [1.0, 0.0],
           [2.0, 0.0], [1e-200, 1e-200, 0.0], [1e200, 1e200, 0.0], [-0.0, 1.0, 0.0], [0.0, 1.0, 0.0]]
    for _ in range(6):
        c = rng.standard_normal(8)
        out += [(c + 0.35 * rng.standard_normal(8)).tolist() for _ in range(30)]
    out += [out[20]] * 9 + [rng.standard_normal(8).tolist() for _ in range(60)]
    return out


@pytest.mark.parametrize("cell, block", [(4096, 4096), (16, 8), (40, 1000)])
def test_vector_links_against_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embeddings, "CELL", cell)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    vectors = _vectors()
    ship_package(spark)
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in enumerate(vectors)],
                               "vec_id long, embedding array<double>, label int, copies string").repartition(3)
    n, roots = _brute_vectors(vectors)
    got = {r.vec_id: r for r in embeddings.near_vectors(df, 0.9).collect()}
    assert [got[i].n_links for i in range(len(vectors))] == n and max(n) > 20
    assert [got[i].component_id for i in range(len(vectors))] == roots
    assert all(got[i].kept == (roots[i] == i) for i in got)


def _unstructured(n, dims=64, groups=20, seed=5):
    """Random vectors, some of them in groups about the limit of 0.9."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims)).astype(np.float32)
    for g in range(groups):
        own = rng.choice(n, 12, replace=False)
        x[own] = x[own[0]] + rng.uniform(0.1, 0.5, (12, 1)) * rng.standard_normal((12, dims))
    return x


def _brute_links(x, at_least=0.9):
    y = x.astype(np.float64)
    y /= np.sqrt((y * y).sum(axis=1, keepdims=True))
    a, b = np.nonzero(np.triu(y @ y.T >= at_least, 1))
    return np.bincount(np.concatenate([a, b]), minlength=len(x)).tolist(), _roots(len(x), list(zip(a.tolist(), b.tolist())))


def _vector_frame(spark, x):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").repartition(4)


def test_vectors_without_structure_are_dealt_a_few_times(spark, monkeypatch):
    """They were sent as doubles, once for every 4,096 others."""
    n, dealt, sent = 20_000, embeddings.dealt, []

    def counted(rows, *more):
        sent.append(rows.agg(F.sum(F.length("vec"))).first()[0])
        return dealt(rows, *more)

    monkeypatch.setattr(embeddings, "dealt", counted)
    x = _unstructured(n)
    ship_package(spark)
    got = sorted(embeddings.near_vectors(_vector_frame(spark, x)).select("vec_id", "n_links", "component_id").collect())
    links, roots = _brute_links(x)
    assert [r.n_links for r in got] == links and sum(links) > 500
    assert [r.component_id for r in got] == roots
    assert sum(sent) <= 5 * x.nbytes, sum(sent) / x.nbytes


@pytest.mark.parametrize("cell, block, held", [(50, 200, 1 << 24), (400, 90, 20_000)])
def test_vector_rounds_and_bounds_lose_no_link(spark, monkeypatch, cell, block, held):
    """Cells in shared and in several blocks, many rounds, and a bound from fewer coordinates than there are."""
    for name, value in {"CELL": cell, "BLOCK": block, "HELD_BYTES": held, "ROUND": 1, "ROUND_BYTES": 0, "CHECKED": 50}.items():
        monkeypatch.setattr(embeddings, name, value)
    rounds, made = [], embeddings._rounds
    monkeypatch.setattr(embeddings, "_rounds", lambda chunks: rounds.extend(made(chunks)) or rounds)
    x = _unstructured(900)
    x[700:760] = x[700] + 0.02 * x[600:660]  # one dense group
    ship_package(spark)
    got = sorted(embeddings.near_vectors(_vector_frame(spark, x)).select("vec_id", "n_links", "component_id").collect())
    links, roots = _brute_links(x)
    assert [r.n_links for r in got] == links and max(links) >= 59
    assert [r.component_id for r in got] == roots
    assert len(rounds) > 2 and rounds[0][0] == 0 and all(a[1] < b[0] for a, b in zip(rounds, rounds[1:]))


def test_vector_bound_is_never_below_the_cosine():
    x = _unstructured(2000, groups=4).astype(np.float64)
    unit = embeddings._unit(x)
    axes = embeddings._axes(unit, 0.9)
    assert axes is not None and axes.shape[1] < 48
    flat = embeddings._flat(unit, axes)
    assert flat.dtype == np.float32 and (flat @ flat.T >= unit @ unit.T - 1e-5).all()


def test_vector_edge_tables(spark):
    ship_package(spark)
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in embeddings.near_vectors(df).collect())
    assert got == [(-1, 0, -1, True), (1, 1, 1, True), (1, 1, 1, True)]
    assert embeddings.near_vectors(df.limit(0)).count() == 0
    assert embeddings.near_vectors(df.filter("vec_id is null")).count() == 1


def _auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.mark.parametrize("key, label, least", [("op5_toxicity", "toxic", 0.9), ("op9_quality", "quality", 0.97)])
def test_classifier_queries_on_held_out_rows(spark, key, label, least):
    sf = "/root/testdata/sf0.1"
    df = queries.QUERIES[key](spark, sf).cache()
    assert df.count() == queries.table(spark, sf, "documents").count()
    assert df.filter("score < 0 or score > 1 or score is null").count() == 0
    pdf = df.filter("held_out").join(queries.table(spark, sf, "labels"), "doc_id").toPandas()
    y = pdf[label].to_numpy()
    assert _auc(pdf["score"].to_numpy(), y) >= least
    assert (pdf["predicted"] == y).mean() >= 0.95
    df.unpersist()


def test_labels_of_held_out_rows_are_never_read(spark):
    docs, labels = (queries.table(spark, MID, t) for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(labelled.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train(docs, x) for x in (labels, flipped))
    assert a.base == b.base and np.array_equal(a.terms, b.terms) and np.array_equal(a.factor, b.factor)


def test_factorization_machine_learns_a_pair():
    """Two terms that are harmless alone and bad together: no linear weights tell that."""
    rng = np.random.default_rng(1)
    n = 4000
    has = rng.random((n, 2)) < 0.5
    y = (has[:, 0] & has[:, 1]).astype(int)
    flip = has[:, 0] ^ has[:, 1]
    keep = rng.random(n) < np.where(flip, 1.0, 0.6)
    has, y = has[keep], y[keep]
    row, col = np.nonzero(has)
    model = toxicity.fit(np.array([5, 6], dtype=np.uint64), row, col, y, np.ones(len(y)))
    p = model.logits(*model.known(row, (col + 5).astype(np.uint64), len(y)), len(y)) > 0
    assert (p == y).mean() > 0.99


def test_training_learns_a_pair_whose_members_are_everywhere(spark):
    """Both members have equal shares in both classes, so no count of single terms tells."""
    rng, rows = random.Random(3), []
    for i in range(6000):
        toxic, kind = i % 2, rng.random()
        members = (["badly", "group"] if kind < 0.5 else ["vulgar"]) if toxic else [["badly"], ["group"]][kind < 0.5]
        words = [*(f"n{rng.randrange(300)}" for _ in range(25)), *members]
        rng.shuffle(words)
        rows.append((i, " ".join(words), toxic))
    docs = _docs(spark, [t for _, t, _ in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, toxicity.train(docs, labels)).collect()}
    y = np.array([y for _, _, y in rows])
    assert _auc(np.array([got[i] for i, _, _ in rows]), y) > 0.95


def test_pair_sums_equal_the_definition():
    rng = np.random.default_rng(2)
    model = toxicity.Model(np.arange(5, dtype=np.uint64), 0.3, rng.standard_normal(5), rng.standard_normal((5, 8)))
    got = model.logits(np.array([0, 0, 0, 1]), np.array([0, 2, 4, 3]), 3)
    w, v = model.weight, model.factor
    assert np.allclose(got, [0.3 + w[[0, 2, 4]].sum() + v[0] @ v[2] + v[0] @ v[4] + v[2] @ v[4], 0.3 + w[3], 0.3])


def test_word_vectors_equal_a_plain_count(spark):
    texts = ["The cat sat!! on 12 mats", "", None, "THE CAT", "cat cat"]
    plus, minus = quality.index_vectors()
    want = np.zeros((quality.WORDS, quality.DIMENSIONS))
    for t in texts:
        for _, _, _, word in quality.tokens([t or ""]):
            for i, x in enumerate(word):
                for y in word[max(0, i - quality.WINDOW):i + quality.WINDOW + 1]:
                    want[x, plus[y]] += 1
                    want[x, minus[y]] -= 1
    norm = lambda x: x / np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))
    want = norm(want)
    used = np.abs(want).sum(axis=1) > 0
    want[used] -= want[used].mean(axis=0)
    got = quality.word_vectors(_docs(spark, texts, extra=True).repartition(3))
    assert np.allclose(got, norm(want), atol=1e-5)


def test_temperature_and_scores_are_probabilities():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 2 * quality.DIMENSIONS)).astype(np.float32)
    y = (rng.random(3000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    part = np.arange(3000) % 4 == 0
    net = quality.fit(x, y, np.ones(3000), part)
    p = net.scores(x[part])
    loss = lambda t: np.logaddexp(0, -(2 * y[part] - 1) * net.logits(x[part]) / t).mean()
    assert loss(net.temperature) <= min(loss(1.0), loss(2.0)) + 1e-9
    assert abs(p.mean() - y[part].mean()) < 0.06


@pytest.mark.parametrize("rows", [[], [(0, 0, 0)], [(1, 1, 1)], [(2, None, None)]])
def test_models_without_two_classes(spark, rows):
    docs = _docs(spark, ["one", None, "", "long " * 20_000, "one"], extra=True)
    labels = spark.createDataFrame(rows, T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "quality", "toxic")]))
    vectors = quality.word_vectors(docs)
    for scores in (toxicity.score_toxicity(docs, toxicity.train(docs, labels)),
                   quality.score_quality(docs, vectors, quality.train(docs, labels, vectors))):
        got = [r.score for r in scores.collect()]
        assert len(got) == 5 and all(0 <= s <= 1 for s in got)


def _step(spark, docs, sf_dir, name, stage):
    out = stage(spark, docs, sf_dir)
    assert out.columns == docs.columns
    return spark.createDataFrame(out.collect(), docs.schema)


def test_pipeline_stages_do_what_their_operators_decide(spark):
    docs = queries.table(spark, MID, "documents")
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    labels = queries.table(spark, MID, "labels")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = _step(spark, docs, MID, name, stage)
        before, now = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in after.collect()}
        assert set(now) <= set(before)
        if name == "toxicity":
            model = toxicity.train(docs, labels)
            want = {r.doc_id for r in toxicity.score_toxicity(docs, model).collect() if r.score < 0.5}
        elif name == "quality":
            vectors = quality.word_vectors(docs)
            net = quality.train(docs, labels, vectors)
            want = {r.doc_id for r in quality.score_quality(docs, vectors, net).collect() if r.score >= 0.3}
        elif name == "near_dedup":
            ids = sorted(before)
            _, roots = _brute_near([before[i].text for i in ids], corpus_pipeline.NEAR_PERCENT)
            want = {ids[r] for r in set(roots)}
        else:
            want = set(before)
            assert all(now[i].text == secrets.redact(before[i].text, secrets.find_secrets(before[i].text)) for i in now)
            assert all(r.n_chars == len(r.text) for r in now.values())
        assert set(now) == want
        if name != "secrets":
            assert all(now[i] == before[i] for i in now)
        kept[name], docs = len(now), after
    clean = labels.filter("toxic = 0 and quality = 1").select("doc_id")
    source = queries.table(spark, MID, "documents").join(clean, "doc_id").count()
    assert kept["near_dedup"] > 0.8 * source
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, MID).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}


def test_pipeline_rows(spark):
    ship_package(spark)
    texts = [(None, "no id here"), (1, "same text of a few words"), (1, "same text of a few words"),
             (2, "same text of a few words"), (3, None), (4, ""), (5, "token=abcdefgh12 " * 2), (6, "word " * 30_000)]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in texts], DOCS).withColumn("kept", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "toxicity":
            docs = docs.filter("true")
        out = stage(spark, docs, MID)
        assert out.columns == docs.columns
        if name in ("near_dedup", "secrets"):
            docs = out
    got = sorted((r.doc_id or -1, r.text) for r in docs.collect() if r.text and r.doc_id != 6)
    assert got == [(-1, "no id here"), (1, "same text of a few words"), (5, "[assign] " * 2)]
    empty = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, MID).count() == 0


def test_near_dedup_takes_four_fifths(spark):
    assert corpus_pipeline.NEAR_PERCENT == 80
    ship_package(spark)
    words = [f"w{i}" for i in range(104)]  # 100 shingles
    def shared(k):  # k of each text's 100 shingles are common: k of 200 - k
        return " ".join(words[:k + 4] + [f"e{k}x{i}" for i in range(100 - k)])
    rows = [(10, " ".join(words)), (20, shared(89)), (30, shared(88)), (40, "other words that stay")]
    assert 100 * 89 >= 80 * (200 - 89) and 100 * 88 < 80 * (200 - 88)
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows[:2] + rows[3:], "doc_id long, text string"), "")
    assert {r.doc_id for r in kept.collect()} == {10, 40}
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame([rows[0], *rows[2:]], "doc_id long, text string"), "")
    assert {r.doc_id for r in kept.collect()} == {10, 30, 40}


def test_run_equals_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF_SMALL)
    assert rows.select("doc_id").distinct().count() > 50
    seq = rows.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert seq.filter(F.col("n") > packing.Limits().tokens).count() == 0


def _words(seed, n=60):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_a_repeated_id_is_one_vertex(spark):
    ship_package(spark)
    a, b, c = _words(1), _words(2), _words(3)
    rows = [(3, b), (5, b), (5, a), (7, a + " tail"), (9, c), (9, ""), (8, c), (11, ""), (11, c + " end"), (None, a), (None, a)]
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(3, 3, True), (5, 3, False), (7, 3, False), (8, 8, True), (9, 8, False), (11, 8, False), (None, None, True)}


def test_near_dedup_keeps_one_row_of_each_text(spark):
    ship_package(spark)
    a, b, c, d = (_words(k) for k in range(10, 14))
    rows = [(3, b), (5, b), (5, a), (None, a), (None, c), (None, c), (6, d), (6, d), (None, d + " tail")]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()
    texts = sorted(r.text for r in kept)
    assert texts == sorted([a, b, c, d]) and {r.doc_id for r in kept if r.text in (b, d)} == {3, 6}


def test_the_sample_does_not_depend_on_the_order_of_rows(spark):
    ship_package(spark)
    rows = [(i % 40, f"text {i} {i * 7 % 11}") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    drawn = [sorted(map(tuple, labelled.training_rows(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels, "toxic", 50).collect()))
             for r, n in ((rows, 1), (rows[::-1], 7), (rows, 13))]
    assert drawn[0] == drawn[1] == drawn[2] and len(drawn[0]) == len({r[0] for r in drawn[0]}) > 20
