"""Language ID, toxicity and LM scoring: held-out accuracy and the mathematics against plain versions."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from idloom.llm import lang_id, lm_score, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_languages_of_held_out_documents(documents):
    from pyspark.sql import functions as F

    half = F.col("doc_id") % 2 == 0
    model = lang_id.fit(documents.where(half))
    rows = documents.where(~half).select("lang", lang_id.language_mixture(documents, model).alias("r")).collect()
    assert np.mean([r.r.languages[:1] == [r.lang] for r in rows]) > 0.98
    assert np.mean([r.r.accepted for r in rows]) > 0.99


def test_mixtures_have_the_right_proportions(documents):
    model = lang_id.fit(documents)
    texts = {lang: [r.text for r in documents.where(f"lang = '{lang}'").orderBy("doc_id").limit(12).collect()] for lang in ("en", "de", "fr")}
    joined = [" ".join(a.split()[:150] + b.split()[:50]) for a, b in zip(texts["en"], texts["de"]) if len(a.split()) >= 150 and len(b.split()) >= 50]
    assert joined
    for _, _, likely, offsets in lang_id.word_likelihoods(pa.array(joined), model):
        pi = lang_id.infer(likely, offsets)
        # A document of these tables may itself hold some words of another language.
        assert np.mean(np.abs(pi[:, model.languages.index("en")] - 0.75) < 0.06) >= 0.8 and (pi[:, model.languages.index("fr")] < 0.1).all()


def test_chosen_set_is_the_best_of_the_nested_ones():
    """Against a plain EM by document that tries every size and uses neither ceilings nor bounds."""
    r = np.random.default_rng(5)
    sizes = [0, 1, 2, 30, 80, 150, 40]
    likely = np.log(r.dirichlet(np.ones(4) * 0.3, sum(sizes)) + 1e-6)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    got = lang_id.infer(likely, offsets, penalty=1.0, min_share=0.01, rounds=40)

    def em(x, allowed, rounds):
        pi = np.array([1 / len(allowed) if k in allowed else 0 for k in range(4)])
        for _ in range(rounds):
            joint = np.exp(x) * pi
            pi = (joint / joint.sum(axis=1, keepdims=True)).mean(axis=0)
        return pi, np.log((np.exp(x) * pi).sum(axis=1)).sum()

    for i, n in enumerate(sizes):
        x = likely[offsets[i] : offsets[i + 1]]
        if not n:
            assert not got[i].any()
            continue
        price = np.log(max(n, 2))
        order = np.argsort(-em(x, range(4), 40)[0], kind="stable")
        best = max(((x[:, k].sum() - price, -1, np.eye(4)[k]) for k in range(4)), key=lambda v: v[0])
        for m in range(2, 5 if n > 1 else 2):
            pi, value = em(x, set(order[:m].tolist()), 80)
            if value - m * price > best[0] and pi[order[:m]].min() >= 0.01:
                best = (value - m * price, -m, pi)
        assert np.allclose(got[i], best[2], atol=1e-6)


def test_long_texts_are_inferred_as_short_ones():
    r = np.random.default_rng(8)
    for n in (0, 1, 2, 50, 400):
        likely = r.normal(-8, 2, (n, 4)).astype(np.float32)
        likely[: n // 2, 1] += 4
        got, words = lang_id.infer_long([likely[k : k + 30] for k in range(0, max(n, 1), 30)])
        assert words == n and np.allclose(got, lang_id.infer(likely.astype(np.float64), np.array([0, n]))[0], atol=1e-6)


def test_the_sample_has_each_text_once_and_few_labels(spark):
    rows = [("aa bb cc", "x")] * 400 + [(f"dd ee {i}", "y") for i in range(100)] + [("zz", f"odd{i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    model = lang_id.fit(docs, per_language=1000, languages=2)
    assert model.languages == ("x", "y", "und")
    want = lang_id.fit(docs.distinct(), per_language=1000, languages=60)
    assert np.allclose(model.log_p[:, 0], want.log_p[:, want.languages.index("x")])


def test_a_text_of_many_megabytes_takes_little_memory():
    import tracemalloc

    model = lang_id.LanguageModel(("a", "b", "c", "und"), np.random.default_rng(9).normal(-9, 1, (1 << lang_id.BUCKET_BITS, 4)).astype(np.float32))
    text = pa.array(["mixed words of any language " * 300_000])
    tracemalloc.start()
    (_, _, parts, _), = lang_id.word_likelihoods(text, model)
    assert lang_id.infer_long(parts)[1] == 1_500_000
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_scores_are_the_factorization_machine(spark):
    r = np.random.default_rng(1)
    slot = np.full(1 << toxicity.TERM_BITS, -1, np.int32)
    slot[:6] = np.arange(6)
    machine = toxicity.FactorizationMachine(slot, 0.3, r.normal(size=6), r.normal(size=(6, 3)), 0.5)
    docs = [np.array(x, np.int64) for x in ([], [0], [1, 4], [0, 2, 3, 5], [9, 1, 0])]
    got = machine.score(np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])]))
    assert got[0] == 0
    for d, p in zip(docs[1:], got[1:]):
        d = [t for t in d if t < 6]
        y = 0.3 + sum(machine.w[t] for t in d) + sum(machine.v[a] @ machine.v[b] for a, b in itertools.combinations(d, 2))
        assert abs(p - 1 / (1 + np.exp(-y))) < 1e-9


def test_pairs_that_linear_weights_miss():
    """Toxic only where an insult meets a mention: each alone is harmless, so additive weights can't tell."""
    r = np.random.default_rng(2)
    docs, toxic = [], []
    for _ in range(1500):
        a, b = r.random() < 0.5, r.random() < 0.5
        docs.append(np.unique(np.concatenate([r.integers(100, 160, 12), [7] * a, [9] * b]).astype(np.int64)))
        toxic.append(int(a == b))
    toxic = np.array(toxic)
    machine = toxicity.train(docs[:1000], toxic[:1000], epochs=60)
    score = machine.score(np.concatenate(docs[1000:]), np.concatenate([[0], np.cumsum([len(d) for d in docs[1000:]])]))
    assert ((score >= machine.threshold) == (toxic[1000:] == 1)).mean() > 0.9


def test_a_pair_among_commoner_terms():
    """Each of 1,100 terms has more documents than either term of the pair, which alone say little."""
    r = np.random.default_rng(2)
    docs, toxic = [], []
    for _ in range(8000):
        a, b = (r.random(2) < 0.15).tolist()
        docs.append(np.unique(np.concatenate([r.choice(1100, 200, replace=False) + 100, [7] * a, [9] * b]).astype(np.int64)))
        toxic.append(int(a == b))
    toxic = np.array(toxic)
    machine = toxicity.train(docs[:6000], toxic[:6000], epochs=20)
    x, y = machine.v[machine.slot[7]].astype(float), machine.v[machine.slot[9]].astype(float)
    score = machine.score(np.concatenate(docs[6000:]), np.concatenate([[0], np.cumsum([len(d) for d in docs[6000:]])]))
    assert x @ y > 1 and ((score >= machine.threshold) == (toxic[6000:] == 1)).mean() > toxic[6000:].mean() + 0.08


@pytest.mark.parametrize("share", [0.1, 0.7])
def test_texts_without_words_stay(spark, share):
    r = np.random.default_rng(4)
    rows = [(i, ("vile " if i < share * 400 else "kind ") + " ".join(f"w{k}" for k in r.integers(0, 50, 8))) for i in range(400)]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "?!"), (None, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < share * 400)) for i in range(400)], "doc_id bigint, toxic int")
    kept = [r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()]
    assert {900, 901, 902, None} <= set(kept) and abs(len(kept) - 4 - 400 * (1 - share)) < 8
    scored = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert len(scored) == 404 and all(scored[k].toxicity == 0 and not scored[k].toxic for k in (900, 901, 902, None))


def test_a_score_at_the_threshold_is_toxic(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "same words"), (2, "same words"), (3, "other")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id bigint, toxic int")
    machine = toxicity.fit(docs, labels)
    at = docs.select("doc_id", toxicity.toxicity(docs, machine).alias("p")).where("doc_id = 1").first().p
    monkeypatch.setattr(toxicity, "fit", lambda *_: toxicity.replace(machine, threshold=at))
    assert {r.doc_id for r in toxicity.score_toxicity(docs, labels).where("toxic").collect()} >= {1, 2}
    assert not {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()} & {1, 2}


def test_toxic_documents_held_out(spark):
    sf = SF.replace("0.01", "0.1")
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    texts = {r.doc_id: r.text for r in documents.collect()}
    train_ids = set(labels.doc_id[labels.doc_id % 3 > 0])
    machine = toxicity.fit(documents, spark.createDataFrame(labels[labels.doc_id.isin(train_ids)]))
    rest = labels[~labels.doc_id.isin(train_ids)]
    truth = rest.toxic.values
    scores = np.concatenate([machine.score(t, o) for _, _, t, o in toxicity.distinct_terms(pa.array([texts[i] for i in rest.doc_id]))])
    found = scores >= machine.threshold
    assert found[truth == 1].mean() >= 0.8 and found[truth == 0].mean() <= 0.02


def test_probabilities_sum_to_one():
    r = np.random.default_rng(3)
    counts = r.integers(0, 50, 1 << lm_score.WORD_BITS)
    model = lm_score.new_model(counts)
    model.by_class[:] = r.normal(size=model.by_class.shape)
    model.by_word[:] = r.normal(size=model.by_word.shape)
    buckets = np.arange(1 << lm_score.WORD_BITS)
    total = 0.0
    context = [5, 77]
    for at in range(0, len(buckets), 4096):
        part = buckets[at : at + 4096]
        seq = np.stack([np.full(len(part), context[0]), np.full(len(part), context[1]), part], axis=1).ravel()
        p = lm_score.score(model.symbol[seq], seq, np.arange(0, len(seq) + 1, 3), model)
        total += np.exp(p[2::3]).sum()
    assert abs(total - 1) < 1e-3


def test_batched_scores_equal_a_plain_version():
    texts = pa.array(["the cat sat on the mat", "", "the the the", "a dog and the cat"])
    counts = np.zeros(1 << lm_score.WORD_BITS, np.int64)
    blank = lm_score.new_model(counts)
    for _, _, b, _, _ in lm_score.symbol_batches(texts, blank):
        counts += np.bincount(b, minlength=len(counts))
    model = lm_score.new_model(counts)
    trainer = lm_score.Trainer(model)
    for _, _, _, s, o in lm_score.symbol_batches(texts, model):
        trainer.learn(s, o)
    model = lm_score.MaxentModel(model.symbol, model.log_within, *trainer.tables)
    for _, _, buckets, symbols, offsets in lm_score.symbol_batches(texts, model):
        got = lm_score.score(symbols, buckets, offsets, model)
        for a, b in zip(offsets, offsets[1:]):
            for k in range(a, b):
                one, two = (int(symbols[k - j]) + 1 if k - j >= a else 0 for j in (1, 2))
                m = 0x9E3779B97F4A7C15
                keys = [((x * m) % (1 << 64)) >> 20 for x in (0, one + (1 << 12), (one << 12 | two) + (2 << 40), two + (3 << 40))]
                c, s = divmod(int(symbols[k]), lm_score.SLOTS)
                zc = sum(model.by_class[x % lm_score.CLASS_ROWS].astype(float) for x in keys)
                rows = [((x * 0xC2B2AE3D27D4EB4F + c * 0x165667B19E3779F9) % (1 << 64) >> 40) % lm_score.WORD_ROWS for x in keys]
                zw = sum(model.by_word[x].astype(float) for x in rows)
                want = zc[c] - np.log(np.exp(zc).sum()) + zw[s] - np.log(np.exp(zw).sum()) + model.log_within[buckets[k]]
                assert abs(got[k] - want) < 1e-4


def test_training_lowers_perplexity_of_held_out_text(documents):
    from pyspark.sql import functions as F

    half = F.col("doc_id") % 2 == 0
    model = lm_score.fit(documents.where(half))
    untrained = lm_score.MaxentModel(model.symbol, model.log_within, np.zeros_like(model.by_class), np.zeros_like(model.by_word))
    logs = [lm_score.score_documents(documents.where(~half), m).agg(F.sum("log_prob") / F.sum("n_words")).first()[0] for m in (untrained, model)]
    assert logs[1] > logs[0] + 0.5


def test_gradient_sums_by_row():
    r = np.random.default_rng(4)
    for rows in (r.integers(0, 9, 500), r.integers(0, 900, 500), np.full(500, 3)):
        p = r.normal(size=(500, 4))
        at, n, g = lm_score._sum_by_row(rows.astype(np.uint16), p)
        for row, count, total in zip(at, n, g):
            assert count == (rows == row).sum() and np.allclose(total, p[rows == row].sum(axis=0))
