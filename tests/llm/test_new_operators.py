"""Dialogue repair, whitening, toxicity; large alphabets, large vectors and repeated ids of earlier operators."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veldra.llm import dialogue, langid, q_dialogue, q_toxicity, q_whitening, toxicity, topk, whitening
from veldra.session import table

DATA = "/root/testdata/sf0.001"
CONV = "conv_id long, turn long, role string, text string"

# --- op11 -------------------------------------------------------------------------------------------------------


def brute_force(rows):
    """Cheapest edits of (role, text) rows by trying all edit sequences of bounded cost, shortest cost first."""
    letters, *_ = dialogue.signature([r for r, _ in rows], [t for _, t in rows])
    best = None

    def walk(i, state, cost, audit, out):
        nonlocal best
        if cost > 3 * len(rows) + 4 or (best and cost > best[0]):
            return
        if i == len(rows) and state in (0, 3):
            best = min(filter(None, (best, (cost, audit, tuple(out)))), key=lambda b: b[:2])
        if audit[-2:] != "II":
            role, after = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}[state]
            walk(i, after, cost + 2, audit + "I", [*out, (role, "")])
        if i == len(rows):
            return
        role, text = rows[i]
        late = letters[i].isupper()
        walk(i + 1, state, cost + 3, audit + "D", out)
        if letters[i] == "d":
            return
        new, after = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}[state]
        walk(i + 1, after, cost + 2 + late, audit + "R", [*out, (new, text)])
        nxt = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, role[:1]))
        if nxt:
            walk(i + 1, nxt, cost + late, audit + "K", [*out, (role, text)])

    walk(0, 0, 0, "", [])
    return best


def test_repairs_equal_brute_force():
    rng = random.Random(7)
    trie = dialogue.Trie()
    for _ in range(250):
        rows = [(rng.choice(["system", "user", "assistant", "tool", "", "unknown"]), rng.choice(["a.", "b!", "c", "", " ", "d?"])) for _ in range(rng.randrange(6))]
        letters, *_ = dialogue.signature([r for r, _ in rows], [t for _, t in rows])
        cost, audit = trie.answers([letters])[letters]
        want = brute_force(rows)
        assert (cost, audit) == want[:2]
        assert tuple(dialogue.applied([r for r, _ in rows], [t for _, t in rows], audit)) == want[2]


def test_a_shared_prefix_is_computed_once(monkeypatch):
    calls = Counter()
    real = dialogue.advance
    monkeypatch.setattr(dialogue, "advance", lambda layer, letter: calls.update([letter]) or real(layer, letter))
    trie = dialogue.Trie()
    trie.answers(["suau", "suaU", "sua", "suau"])
    trie.answers(["suauu"])
    assert sum(calls.values()) == 6 and trie.nodes == 7


def test_trie_starts_anew_beyond_its_bound(monkeypatch):
    monkeypatch.setattr(dialogue, "NODES", 4)
    words = ["".join(w) for w in itertools.product("suaD".replace("D", "d"), repeat=3)]
    got = dialogue.Trie().answers(words)
    monkeypatch.setattr(dialogue, "NODES", 1 << 19)
    assert got == dialogue.Trie().answers(words)


def odd_conversations(spark):
    rng = random.Random(3)
    rows = [(1, t, r, x) for t, r, x in [(0, "user", "hi."), (1, "assistant", "yes."), (1, "assistant", "yes."), (None, "system", "be kind."), (None, None, None), (2, "user", "so")]]
    rows += [(None, t, rng.choice(["user", "assistant", None]), rng.choice(["a.", "b", "", None, "c!"])) for t in [0, 0, None, 1, 2, 2, 5, 9]]
    rows += [(c, t, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["ab.", "cd.", "ef", " ", "gh?"])) for c in (2, 3) for t in range(60)]
    rows += [(4, 0, "user", "x" * 300_000 + "."), (5, 0, "user", None)]
    return spark.createDataFrame(rows, CONV).withColumns({c: F.lit("clash") for c in ("conv", "present", "audit", "cost")})


@pytest.mark.parametrize("piece", [1, 4, 7])
def test_pieces_give_the_same_repairs(spark, piece):
    df = odd_conversations(spark)
    one, cut = dialogue.repair(df, "conv_id", "turn", "role", "text"), dialogue.repair(df, "conv_id", "turn", "role", "text", piece=piece)
    assert one.long_reports is None and cut.long_reports.count() >= 3
    rows = lambda x: sorted(map(repr, x.collect()))
    assert rows(one.reports) == rows(cut.reports)
    lines = lambda x: sorted((repr(r.conv), [(t.role, t.text) for t in r.ts]) for r in x.turns.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("position", "role", "text"))).alias("ts")).collect())
    assert lines(one) == lines(cut)
    sums = {r.conv: r.sha256 for r in dialogue.digests(one.turns).collect()}
    for r in one.whole.collect():
        assert sums.get(r.conv, hashlib.sha256().hexdigest()) == hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in r.repaired).encode()).hexdigest()


def test_reports_of_odd_conversations(spark):
    got = {r.conv: r for r in dialogue.repair(odd_conversations(spark), "conv_id", "turn", "role", "text").reports.collect()}
    assert (got[1].gaps, got[1].blank, got[1].duplicate, got[1].truncated) == (0, 1, 1, 1)
    assert (got[5].blank, got[5].cost, got[5].audit, got[5].gaps) == (1, 3, "D", 0)
    assert (got[4].cost, got[4].audit) == (2, "KI")
    empty = dialogue.repair(odd_conversations(spark).limit(0), "conv_id", "turn", "role", "text")
    assert empty.reports.count() == empty.turns.count() == 0


def test_conversation_that_loses_all_rows(spark):
    df = odd_conversations(spark).where("conv_id in (1, 2)").withColumn("there", F.col("conv_id") == 2)
    for piece in (dialogue.PIECE, 3):
        found = dialogue.repair(df, "conv_id", "turn", "role", "text", "there", piece)
        r = {x.conv: x for x in found.reports.collect()}[1]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == (0, 0, 0, 0, 0, 0, "")


def test_damage(spark):
    df = spark.createDataFrame([(c, t, "assistant", "One. Two! Three?") for c in range(40) for t in range(5)] + [(None, None, None, None)], CONV)
    got = Counter((r.conv_id, r.turn, r.role, r.text, r.present) for r in q_dialogue.damaged(df).collect())
    want = Counter()
    for r in df.collect():
        code = zlib.crc32(f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}".encode()) % 20
        role, text = r.role or " ", r.text or " "
        text = "" if code == 1 else "".join(c for c in text if c not in ".!?") if code == 2 else text
        want[r.conv_id, r.turn, "user" if code == 4 else role, text, code != 0] += 2 if code == 3 else 1
    assert got == want


# --- op12 -------------------------------------------------------------------------------------------------------


def plain_whitening(vectors, k):
    x = np.array([[int(np.floor(np.float64(c) * 1024)) + 100_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    cov = (n * x.T.dot(x) - np.outer(s, s)).astype(float) / n / n
    e, u = np.linalg.eigh(cov)
    at = np.argsort(-e)[:k]
    y = n * x - s
    return [int((r * r).sum()) for r in y], (y.astype(float) / n) @ u[:, at] / np.sqrt(e[at]), e[at] / np.trace(cov), n


def test_whitening_equals_plain_numpy(spark):
    rows = table(spark, DATA, "embeddings").select("vec_id", "embedding").orderBy("vec_id").collect()
    deviation, white, explained, n = plain_whitening([r.embedding for r in rows], 8)
    got = q_whitening.op12_whitening(spark, DATA).toPandas()
    at = {r.vec_id: i for i, r in enumerate(rows)}
    assert len(got) == 8 * n and set(got.n) == {n} and list(got.deviation) == [deviation[at[i]] for i in got.vec_id]
    mine = np.zeros_like(white)
    mine[[at[i] for i in got.vec_id], got.component - 1] = got.whitened
    assert np.abs(mine * np.sign((mine * white).sum(axis=0)) - white).max() < 1e-9
    assert np.allclose(got.groupby("component").explained.first(), explained, rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


def test_scatter_equals_sql(spark, duck):
    total = whitening.scatter(table(spark, DATA, "embeddings"), "embedding", 64)
    sql = """WITH x AS (SELECT vec_id, unnest(range(64)) AS i, (floor(1024 * unnest(embedding)::DOUBLE) + 100000)::HUGEINT AS x FROM embeddings),
    s AS (SELECT i, count(*) AS n, sum(x) AS s FROM x GROUP BY i)
    SELECT a.i, b.i, any_value(p.n) * sum(a.x * b.x) - any_value(p.s) * any_value(q.s) FROM x a JOIN x b USING (vec_id) JOIN s p ON p.i = a.i JOIN s q ON q.i = b.i GROUP BY ALL"""
    assert all(total.scatter[i, j] == int(v) for i, j, v in duck.sql(sql).fetchall())


@pytest.mark.parametrize("size", [1, 1 << 19, 1 << 30, 1 << 45, 1 << 61])
def test_exact_gram(size):
    rng = np.random.default_rng(size % 1009)
    x = rng.integers(-size, size + 1, (4500 if size < 1 << 20 else 50, 3))
    want = x.astype(object).T.dot(x.astype(object))
    assert (whitening.exact_gram(x) == want).all()
    assert whitening.exact_squares(x) == [int(v) for v in (x.astype(object) ** 2).sum(axis=1)]
    huge = x.astype(object) * (1 << 200)
    assert (whitening.exact_gram(huge) == want * (1 << 400)).all()


def test_odd_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 4.0]), (2, [3.0, 4.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0]), (6, [None, 1.0]), (7, []), (None, [0.0, 9.0]), (8, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<float>").withColumns({"deviation": F.lit("clash"), "key": F.lit("clash")})
    got, model = whitening.fit_transform(df, "v", ["vec_id"], 8)
    assert Counter(r.vec_id for r in got.collect()) == {1: 1, 2: 2, None: 1} and model.scatter.n == 4
    assert whitening.identity_error(got, model) < 1e-9
    same, model = whitening.fit_transform(df.where("vec_id = 2"), "v", ["vec_id"], 8)
    assert [(r.deviation, r.whitened) for r in same.collect()] == [("0", [0.0, 0.0])] * 2 and list(model.explained) == [0, 0]
    none, model = whitening.fit_transform(df.limit(0), "v", ["vec_id"], 8)
    assert none.count() == 0 and whitening.identity_error(none, model) == 0


def test_vectors_beyond_a_long(spark):
    rows = [(1, [1e30, 2.0]), (2, [3.0, 4.0]), (3, [-7.5, 1e25])]
    got, _ = whitening.fit_transform(spark.createDataFrame(rows, "vec_id long, v array<double>"), "v", ["vec_id"], 2)
    x = [[int(np.floor(c * 1024)) + 100_000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x, strict=True)]
    assert {r.vec_id: int(r.deviation) for r in got.collect()} == {i: sum((3 * c - t) ** 2 for c, t in zip(v, s, strict=True)) for (i, _), v in zip(rows, x, strict=True)}


# --- op13 -------------------------------------------------------------------------------------------------------


def test_held_out_toxicity(spark):
    d = "/root/testdata/sf0.01"
    got = q_toxicity.op13_toxicity(spark, d).join(table(spark, d, "labels"), "doc_id").toPandas()
    out = got[got.held_out]
    assert (out.predicted == out.toxic).mean() > 0.96
    assert ((out.predicted == 1) & (out.toxic == 0)).sum() <= 1
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(got.doc_id, got.held_out, strict=True))


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    known = F.col("doc_id").isNotNull() & ~q_toxicity.held_out("doc_id")
    flipped = labels.withColumn("toxic", F.when(q_toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit(docs, "doc_id", "text", x, "doc_id", "toxic", known, known) for x in (labels, flipped))
    assert (a.features == b.features).all() and (a.weights == b.weights).all() and a.prior == b.prior


def test_non_negative_risk():
    rng = np.random.default_rng(1)
    g_pos, g_unl = rng.normal(1, 1, 50), rng.normal(-2, 1, 80)
    for shift in (0.0, -6.0):
        a, b, value, clipped = toxicity.risk_step(g_pos, g_unl + shift, 0.6)
        loss = lambda z: np.logaddexp(0, -z)
        negative = lambda p, u: loss(-u).mean() - 0.6 * loss(-p).mean()
        assert clipped == (negative(g_pos, g_unl + shift) < 0)
        whole = (lambda p, u: -negative(p, u)) if clipped else (lambda p, u: 0.6 * loss(p).mean() + negative(p, u))
        assert value >= 0
        for grad, at in ((a, 0), (b, 1)):
            step = [g_pos.copy(), g_unl + shift]
            step[at][3] += 1e-5
            assert abs((whole(*step) - whole(g_pos, g_unl + shift)) / 1e-5 - grad[3]) < 1e-5


def test_prior_without_negatives():
    rng = np.random.default_rng(2)
    pos, neg = rng.random((300, 4)) * [1, 1, 0, 0], rng.random((700, 4)) * [0, 0, 1, 1]
    unl = np.concatenate((pos[:150], neg)).astype(np.float32)
    w, b, prior = toxicity.fit_matrices(pos.astype(np.float32), unl, None)
    assert abs(prior - 150 / 850) < 0.06
    assert ((unl @ w + b > 0)[:150]).mean() > 0.9 and ((unl @ w + b > 0)[150:]).mean() < 0.05


def test_toxicity_edges(spark):
    rows = [(1, "vile rotten words", "en"), (2, None, "en"), (3, "", None), (1, "vile rotten words", "en"), (None, "calm", "de"), (4, "x " * 3000, "de"), (5, "vile vile things", "en"), (6, "vile day", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("score", "id", "positive", "feature")})
    labels = spark.createDataFrame([(1, 1), (5, 1), (6, 1), (4, 0), (2, None), (9, 1)], "doc_id long, toxic int")
    known = F.col("doc_id").isNotNull()
    model = toxicity.fit(docs, "doc_id", "text", labels, "doc_id", "toxic", known, known)
    got = toxicity.with_score(docs, "text", model)
    assert got.columns.count("score") == 1 and got.count() == len(rows)
    score = {r.text: r.score for r in got.collect()}
    assert all(0 <= s <= 1 for s in score.values()) and score[None] == score[""] and score["vile day"] > score["calm"]
    assert toxicity.with_score(docs.limit(0), "text", model).count() == 0
    none = toxicity.fit(docs, "doc_id", "text", labels.limit(0), "doc_id", "toxic", known, known)
    assert all(r.score < 1e-6 for r in toxicity.with_score(docs, "text", none).collect())


# --- earlier operators ------------------------------------------------------------------------------------------


def test_language_tables_of_any_size_agree():
    rng = random.Random(1)
    samples = {f"l{i}": " ".join("".join(chr(0x4E00 + i * 80 + rng.randrange(300)) for _ in range(rng.randrange(1, 5))) for _ in range(700)) for i in range(4)}
    texts = [samples["l3"][100:900], samples["l1"][:50] + " abc", "", "1234", samples["l0"][::-1], "".join(rng.choice(list(samples.values()))[k : k + 9] for k in range(0, 1500, 9))]
    models = [langid.build_model(samples, size) for size in (1 << 30, 0, 200_000)]
    assert [m.all_dense for m in models] == [True, False, False]
    first, *rest = (langid.code_lengths(m, texts)[0] for m in models)
    assert all((first == x).all() for x in rest)


def test_language_model_of_a_large_alphabet_is_small():
    rng = random.Random(2)
    samples = {f"l{i:02d}": " ".join("".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(3)) for _ in range(1500)) for i in range(20)}
    model = langid.build_model(samples)
    assert not model.all_dense and model.n_bytes < 128 << 20  # a dense table would take 1.4 GB
    assert (langid.code_lengths(model, [s[500:900] for s in samples.values()])[0].argmin(axis=1) == np.arange(20)).all()


def test_long_rows_are_learned_whole_or_not_at_all(spark):
    rows = [(i, "aa bb " * 100, "x") for i in range(9)] + [(100 + i, "zz yy " * 20_000, "x") for i in range(9)] + [(300, "qq rr " * 20_000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, "doc_id", "text", "lang", F.lit(True))
    got = {r.t[:2]: r.lang for r in langid.with_language(spark.createDataFrame([("aa bb",), ("qq rr",)], "t string"), "t", model).select("t", "language.lang").collect()}
    assert got == {"aa": "x", "qq": "y"}
    assert 2 ** model.bits[model.languages.index("y")] > 100_000  # its only row, whole


def test_scores_beyond_a_long(spark):
    rows = [(0, [1e18, 0.0]), (1, [1e18, 1.0]), (2, [5e17, 0.0]), (3, [-1e18, 0.0]), (4, [1.0, 1.0]), (5, [1e308, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = [(r.rank, r.vec_id, r.score) for r in topk.top_k(df, "vec_id", "v", F.col("vec_id") == 0, k=9).orderBy("rank").collect()]
    high, low = (1 << 63) - 1, -(1 << 63)
    assert got == [(1, 1, high), (2, 2, high), (3, 4, high), (4, 3, low)]  # 64 * 1e308 isn't finite
    exact = spark.createDataFrame([(0, [3.0, 1.0]), (1, [1e13, 7.0]), (2, [1e13, 8.0])], "vec_id long, v array<double>")
    assert [(r.vec_id, r.score) for r in topk.top_k(exact, "vec_id", "v", F.col("vec_id") == 0, k=9).orderBy("rank").collect()] == [(2, 192 * 64 * 10**13 + 64 * 512), (1, 192 * 64 * 10**13 + 64 * 448)]


def test_unlike_texts_of_one_id_stay(spark):
    words = lambda k: " ".join(f"w{k}{i}" for i in range(30))
    rows = [(1, words("a"), "en", "s", 1), (1, words("b"), "en", "s", 1), (1, words("a"), "de", "s", 1), (2, words("c"), "en", "s", 1), (3, words("c") + " x", "en", "s", 1), (None, words("c"), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id or 0, r.text[:2], r.lang) for r in corpus_pipeline.near_dedup_stage(spark, docs, DATA).collect())
    assert [g for g in got if g[0]] == [(1, "wa", "de"), (1, "wb", "en"), (2, "wc", "en")]


def test_a_drawn_sample_prunes_every_tile():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    x = np.floor(64 * (centres[rng.integers(0, 12, 3000)] + 0.1 * rng.normal(size=(3000, 16))))
    ids, queries, k = np.arange(3000), np.arange(0, 3000, 50), 10
    chosen = topk.Pivots.of(x[:500], (x**2).sum(axis=1).max())
    floor = topk.floors(ids[queries], x[queries], (ids[:500], x[:500]), k)
    seen = {}
    for name, low in (("alone", None), ("floor", floor)):
        merged, evaluated = [[] for _ in queries], 0
        for a in range(0, 3000, 500):  # each tile is a search of its own
            s = topk.Search(ids[queries], x[queries], chosen.distances(x[queries], True), chosen, k, low)
            s.add(ids[a : a + 500], x[a : a + 500], chosen.distances(x[a : a + 500], False))
            evaluated += s.evaluated
            for i in range(len(queries)):
                merged[i] += [(-int(v), int(j)) for v, j, ok in zip(s.best.score[i], s.best.ids[i], s.best.filled[i], strict=True) if ok]
        seen[name] = evaluated
        for i, q in enumerate(queries):
            score = (x @ x[q]).astype(int)
            want = sorted((-int(score[j]), j) for j in range(3000) if j != q)[:k]
            assert sorted(merged[i])[:k] == want
    assert seen["floor"] < 0.8 * seen["alone"]
    assert (topk.floors(ids[queries], x[queries], (ids[:5], x[:5]), k) == -np.inf).all()
