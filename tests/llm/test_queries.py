"""Queries on the smallest tables, and nulls, empty and repeated rows, clashing columns and empty tables."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veldra.llm import clusters, contamination, extraction, folds, langid, nbest, neardup, passages, quality, registry, secrets, tokenfiles, topk
from veldra.storage import Scratch

DATA = "/root/testdata/sf0.001"
ROWS = [(1, "one two three four five six", "en"), (2, None, "en"), (3, "", None), (1, "one two three four five six", "en"), (None, "one two three four five six", "de"), (4, "x " * 3000, "de")]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("clash") for c in ("score", "language", "contamination", "segmentation", "secret_spans", "kept", "blob", "node", "item")})


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(name, same_rows):
    same_rows(registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_every_operator_has_a_query():
    assert {f"op{i}" for i in range(1, 14)} <= {k.split("_")[0] for k in registry.QUERIES}


def test_held_out_fold(spark):
    got = spark.range(50).select("id", folds.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    lang = registry.QUERIES["op1_language"](spark, d).join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    good = registry.QUERIES["op2_quality"](spark, d).join(labels, "doc_id").where("held_out").agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0]
    assert lang > 0.97 and good > 0.95


def test_language_edges(spark, odd):
    model = langid.fit(odd, "doc_id", "text", "lang", F.lit(True))
    got = langid.with_language(odd, "text", model).select("text", "language.lang", "language.score").collect()
    assert len(got) == len(ROWS) and all(r.lang == "und" for r in got if not r.text)
    none = langid.fit(odd.limit(0), "doc_id", "text", "lang", F.lit(True))
    assert {r[0] for r in langid.with_language(odd, "text", none).select("language.lang").collect()} == {"und"}


def test_quality_edges(spark, odd):
    labels = spark.createDataFrame([(1, 1), (4, 0), (2, None)], "doc_id long, quality int")
    model = quality.fit(odd, "doc_id", "text", labels, "doc_id", "quality", F.lit(True))
    got = quality.with_score(odd, "text", model)
    assert got.columns.count("score") == 1 and all(0 <= r.score <= 1 for r in got.collect())
    assert quality.with_score(odd.limit(0), "text", model).count() == 0


def test_contamination_edges(spark, odd):
    bench = spark.createDataFrame([(7, "Two, THREE four"), (8, None), (9, ""), (None, "one")], "item_id long, text string")
    got = contamination.find_contamination(odd, "text", bench, "item_id", "text").select("doc_id", "contamination.*").collect()
    assert len(got) == len(ROWS) and all(r["items"] == ([7] if r.n_words == 6 else []) for r in got)
    assert [(s.start, s.stop) for s in next(r for r in got if r.doc_id == 1).spans] == [(1, 4)]
    small = contamination.find_contamination(odd, "text", bench, "item_id", "text", "c")
    assert small.count() == contamination.decontaminate(odd, "text", bench.limit(0), "item_id", "text").count() == len(ROWS)
    where = contamination.locations(odd, "doc_id", "text", bench, "item_id", "text").where("doc_id = 1").first()
    assert (where.doc_start, where.item_id, where.item_start, where.n_words) == (1, 7, 0, 3)


def test_near_duplicate_edges(spark, odd):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(odd, "doc_id", "text", 4).collect()}
    assert got == {(1, 3, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 3, None, True), (4, 1, 4, True)}
    assert neardup.near_duplicates(odd.limit(0), "doc_id", "text").count() == 0


def test_secrets_ledger_scans_only_what_is_new(spark, tmp_path, odd):
    folder = str(tmp_path / "ledger")
    one = spark.createDataFrame([(1, "password = hunter22 x"), (2, "password = hunter22 x"), (3, None)], "doc_id long, text string")
    secrets.update(spark, one, "text", folder)
    two = one.unionByName(spark.createDataFrame([(4, "AKIA" + "A" * 16)], "doc_id long, text string"))
    ledger = secrets.update(spark, two, "text", folder)
    runs = {r.run: r["count"] for r in ledger.scanned().groupBy("run").count().collect()}
    assert sorted(runs.values()) == [len(secrets.RULES), 2 * len(secrets.RULES)]  # one new blob, then two before it, under every rule
    got = {r.doc_id: [(s.rule, s.start, s.stop) for s in r.secret_spans] for r in secrets.with_spans(two, "text", ledger).collect()}
    assert got == {1: [("assign", 0, 19)], 2: [("assign", 0, 19)], 3: [], 4: [("access", 0, 20)]}
    masked = {r.doc_id: r.text for r in secrets.redact(secrets.with_spans(two, "text", ledger), "text", "secret_spans").collect()}
    assert masked == {1: "[SECRET] x", 2: "[SECRET] x", 3: None, 4: "[SECRET]"}
    newer = (*secrets.BASE_RULES[:2], secrets.Rule("hex", 2, r"[0-9a-f]{32,}", 0, 32))
    secrets.update(spark, two, "text", folder, newer)
    assert ledger.scanned().where("rule_version = 2").count() == 3
    keys = "-----BEGIN RSA PRIVATE KEY-----", "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK"
    more = spark.createDataFrame([(5, f"x {keys[0]}\n{keys[1]}")], "doc_id long, text string")
    found = secrets.with_spans(more, "text", secrets.update(spark, more, "text", folder)).first().secret_spans
    assert [(s.rule, s.start, s.stop) for s in found] == [("pem", 2, 2 + len(keys[0])), ("jwt", 3 + len(keys[0]), 3 + len(keys[0]) + len(keys[1]))]
    assert secrets.with_spans(odd, "text", ledger).count() == len(ROWS)


def test_top_k_edges(spark):
    v = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, [1.0]), (7, [])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").withColumn("q", F.lit("clash"))
    got = topk.top_k(df, "vec_id", "embedding", F.col("vec_id") == 0, 5).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2048), (0, 2, 2, 2048)]
    assert topk.top_k(df.limit(0), "vec_id", "embedding", F.lit(True)).count() == 0
    several = topk.top_k(df, "vec_id", "embedding", F.col("vec_id") < 3, 5, block=2, tile=2).collect()
    assert sorted(tuple(r)[:3:2] for r in several) == [(a, b) for a in range(3) for b in range(3) if a != b]


def test_token_files_round_trip(spark, odd, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    for i, df in enumerate((odd, odd.limit(0))):
        folder = str(tmp_path / f"f{i}")
        tokenfiles.write_token_files(df, "doc_id", "text", path, folder)
        got = tokenfiles.read_token_files(spark, folder, with_ids=True).orderBy("start").collect()
        t = Tokenizer.from_file(path)
        want = [t.encode(r.text or "", add_special_tokens=False).ids + [0] for r in sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))]
        assert [r.ids for r in got] == want
        assert [r.start for r in got] == [int(x) for x in np.cumsum([0, *map(len, want)])[:-1]]
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)


def test_pages_edges(spark):
    df = spark.createDataFrame([(1, "http://a.b/x", "<p>one"), (2, None, None), (3, "nonsense", ""), (1, "http://a.b/x", "<p>one")], "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    assert [r.text for r in extraction.with_main_text(df, "url", "html").orderBy("page_id").collect()] == ["one", "one", "", ""]
    assert extraction.with_main_text(df.limit(0), "url", "html").count() == 0


def _site(n, host, filler=0):
    """Pages of a host with the same two unclassed texts inside their article."""
    body = lambda i: "".join(f"<p>own{host}{i}x{j}</p>" for j in range(6 + i % 3)) + f"<p>{'w ' * filler}{i}</p>"
    return [(f"http://{host}/{i}", f"<body><article><p>Read more on our site</p>{body(i)}<p>Sign up for the letter</p></article></body>") for i in range(n)]


@pytest.mark.parametrize(("n", "filler"), [(2, 0), (3, 0), (12, 0), (3, 110_000)])
def test_template_inside_an_article_goes_on_hosts_of_any_size(spark, n, filler):
    df = spark.createDataFrame(_site(n, "a.b", filler), "url string, html string")
    got = [r.text for r in extraction.with_main_text(df, "url", "html").collect()]
    assert len(got) == n and all("owna.b" in x and "Read more" not in x and "Sign up" not in x for x in got)


def test_segmentation_edges(spark, odd):
    import public_tokenizers

    got = nbest.with_segmentation(odd, "text", public_tokenizers.path("piece_bpe_32k.model")).select("text", "segmentation.*").collect()
    assert len(got) == len(ROWS) and all(r.round_trip for r in got)
    assert all((r.n_tokens == 0) == (not r.text) for r in got)


def test_every_segmentation_comes_with_its_ids(spark, odd):
    import public_tokenizers

    got = nbest.with_segmentation(odd, "text", public_tokenizers.path("piece_bpe_32k.model")).select("segmentation.*").collect()
    assert all(len(r.others) == len(r.scores) - 1 and r.ids not in r.others for r in got) and any(len(r.others) == 3 for r in got)


def test_repeated_passages(spark):
    import random

    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    shared = words(70)
    texts = [(i, words(90)) for i in range(6)] + [(10, f"{words(40)} {shared} {words(20)}"), (11, f"{words(15)} {shared}"), (12, None), (13, ""), (None, shared)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("sig", F.lit("clash"))
    got = passages.repeated_passages(df, "doc_id", "text").collect()
    assert got and {r.doc_id for r in got} == {11} and {r.keep_doc_id for r in got} == {10}
    left = {r.doc_id: r.text for r in passages.without_passages(df, "doc_id", "text", spark.createDataFrame(got)).collect()}
    assert len(left[11].split()) == 85 - sum(r.n_words for r in got) and left[10] == texts[6][1]
    assert passages.repeated_passages(df.limit(0), "doc_id", "text").count() == 0


def _copied_pairs(n_words, pairs, seed, one=lambda rng, n: [rng.randrange(9999) for _ in range(n)]):
    """Pairs of documents (2i, 2i + 1) that share one run of words and nothing else."""
    import random

    rng = random.Random(seed)
    fresh = lambda: [f"f{rng.getrandbits(60)}" for _ in range(rng.randrange(30, 60))]
    out = []
    for i in range(pairs):
        shared = [f"s{i}x{w}" for w in one(rng, n_words)]
        out += [(2 * i + j, " ".join([*fresh(), *shared, *fresh()])) for j in (0, 1)]
    return out


def test_short_passages_are_found_like_a_scan_does(spark):
    pairs, base = 200, 0
    rows = []
    for n in (51, 55, 60):
        rows += [(d + base, t) for d, t in _copied_pairs(n, pairs, n)]
        base += 2 * pairs
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in passages.repeated_passages(df, "doc_id", "text").collect()}
    assert all(d % 2 for d in got)
    for i in range(3):
        found = sum(1 for d in got if 2 * pairs * i <= d < 2 * pairs * (i + 1))
        assert found >= 0.98 * pairs, (i, found)


def test_runs_under_the_least_words_stay(spark):
    df = spark.createDataFrame(_copied_pairs(14, 300, 5), "doc_id long, text string")
    assert passages.repeated_passages(df, "doc_id", "text").count() == 0


def test_text_that_repeats_with_a_short_period_is_found(spark):
    rows = []
    for k, period in enumerate((1, 2, 3, 4)):
        cycle = lambda rng, n, p=period: [j % p for j in range(n)]
        rows += [(d + 100 * k, t) for d, t in _copied_pairs(55, 40, period, cycle)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in passages.repeated_passages(df, "doc_id", "text").collect()}
    for k in range(4):
        assert len({d // 2 for d in got if 100 * k <= d < 100 * (k + 1)}) >= 38, (k, sorted(got))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.quality_stage(spark, docs, DATA)
    assert kept.columns == columns
    leaks = corpus_pipeline.decontamination_stage(spark, docs, DATA)
    found = registry.QUERIES["op4_decontamination"](spark, DATA).where("not contaminated")
    assert sorted(r[0] for r in leaks.select("doc_id").collect()) == sorted(r[0] for r in found.select("doc_id").collect())
    clean = corpus_pipeline.secrets_stage(spark, docs, DATA)
    assert clean.columns == columns and clean.count() == docs.count()
    again = secrets.with_spans(clean, "text", secrets.update(spark, clean, "text", Scratch(spark, "t").fresh("l")))
    assert again.where(F.size("secret_spans") > 0).count() == 0
    out = corpus_pipeline.segmentation_stage(spark, docs, DATA)
    assert out.where("not round_trip").count() == 0


def test_large_nodes_are_contracted_and_branched_without_losing_links(spark, monkeypatch):
    """Groups of near copies and documents with a common line, with nodes taken as large from 8 documents on."""
    import random

    for name, value in (("SMALL", 8), ("BLOCKS", 2)):
        monkeypatch.setattr(clusters, name, value)
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(5000)}"
    line, rows = [word() for _ in range(12)], []
    for g in range(4):
        base = [word() for _ in range(60)]
        for _ in range(40):
            copy = list(base)
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(60)] = word()
            rows.append(copy)
    rows += [line + [word() for _ in range(18)] for _ in range(60)] + [[word() for _ in range(30)] for _ in range(30)]
    sets = [{tuple(r[i : i + 4]) for i in range(len(r) - 3)} for r in rows]
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    df = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, "doc_id", "text", 4).collect()}
    assert got == {i: find(i) for i in range(len(rows))}


def test_texts_of_one_id_join_their_groups(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (4, "other words here")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in neardup.near_duplicates(df, "doc_id", "text", 4).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_texts_of_one_id_have_their_own_spans(spark):
    p = [" ".join(f"p{k}x{i}" for i in range(60)) for k in range(2)]
    fresh = lambda k: " ".join(f"f{k}x{i}" for i in range(40))
    df = spark.createDataFrame([(1, f"{fresh(1)} {p[0]} {fresh(2)}"), (1, f"{fresh(3)} {p[1]} {fresh(4)}"), (2, f"{fresh(5)} {p[0]} {p[1]}"), (2, f"{fresh(5)} {p[0]} {p[1]}")], "doc_id long, text string")
    got = passages.repeated_passages(df, "doc_id", "text").collect()
    assert got and {r.doc_id for r in got} == {2} and sum(r.n_words for r in got) > 80
    turned = df.withColumn("doc_id", 3 - F.col("doc_id"))
    got = passages.repeated_passages(turned, "doc_id", "text").collect()
    assert {r.doc_id for r in got} == {2} and len({r.row for r in got}) == 2


def test_the_compiled_rules_score_like_a_plain_evaluation(spark):
    import math

    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.fit(docs, "doc_id", "text", labels, "doc_id", "quality", F.lit(True))
    assert model.rules
    stats = quality.statistics(F.col("text"))
    for r in quality.with_score(docs, "text", model).select("score", *(c.alias(k) for k, c in stats.items())).collect():
        margin = model.intercept + sum(x.weight for x in model.rules if all((r[n] > cut) == above for n, above, cut in x.conditions))
        assert abs(r.score - 1 / (1 + math.exp(-margin))) < 1e-9


def test_benchmarks_of_several_blocks(spark):
    docs, bench = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    one, many = (contamination.find_contamination(docs, "text", bench, "item_id", "text", "c", n).select("doc_id", "c.n_words", "c.spans", F.array_sort("c.items").alias("items")) for n in (1 << 24, 3000))
    assert one.exceptAll(many).count() == many.exceptAll(one).count() == 0 and one.where(F.size("items") > 0).count() > 0
    where = [contamination.locations(docs, "doc_id", "text", bench, "item_id", "text", n) for n in (1 << 24, 3000)]
    assert where[0].exceptAll(where[1]).count() == where[1].exceptAll(where[0]).count() == 0


def test_many_languages_are_no_error(spark):
    df = spark.createDataFrame([(i, f"text of kind {'abcdefghijklmnop'[i % 16] * 5}", f"l{i}") for i in range(300)], "doc_id long, text string, lang string")
    model = langid.fit(df, "doc_id", "text", "lang", F.lit(True))
    assert len(model.languages) == df.select("lang").distinct().count()  # no label is left out


def test_a_literal_space_mark_comes_back(spark):
    import public_tokenizers

    df = spark.createDataFrame([("a▁b",), ("▁",), (" ▁ x",)], "text string")
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = nbest.with_segmentation(df, "text", path).select("text", "segmentation.*").collect()
    pieces = nbest.Pieces.of(path)
    assert all(r.round_trip and nbest.decode(pieces, r.ids) == r.text for r in got)


def test_wide_ids_are_read_as_written(spark, tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    model = json.load(open(public_tokenizers.path("byte_bpe_50k.json")))
    model["model"]["vocab"] |= {f"<<{i}>>": 50257 + i for i in range(20_000)}
    path = str(tmp_path / "wide.json")
    json.dump(model, open(path, "w"))
    df = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    tokenfiles.write_token_files(df, "doc_id", "text", path, str(tmp_path / "f"))
    got = tokenfiles.read_token_files(spark, str(tmp_path / "f"), with_ids=True).orderBy("start").collect()
    assert [r.ids for r in got] == [[*Tokenizer.from_file(path).encode("one two").ids, 0], [0]]
    assert spark.read.parquet(str(tmp_path / "f/manifest")).first().id_bytes == 4


def test_the_ledger_setting_goes_on_with_a_ledger(spark, tmp_path):
    from veldra.llm import q_secrets

    spark.conf.set(q_secrets.LEDGER, str(tmp_path / "l"))
    try:
        first = sorted(map(tuple, registry.QUERIES["op7_secrets"](spark, DATA).collect()))
        again = sorted(map(tuple, registry.QUERIES["op7_secrets"](spark, DATA).collect()))
    finally:
        spark.conf.unset(q_secrets.LEDGER)
    assert first == again
    runs = secrets.Ledger(spark, str(tmp_path / "l")).scanned().groupBy("run").count().collect()
    assert len(runs) == 1  # the second call had nothing to scan


def test_pipeline_edges(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    words = " ".join(f"word{i}" for i in range(60))
    odd = spark.createDataFrame([(900001, words), (900002, words), (900002, words), (None, words), (900003, None), (900004, "")], "doc_id long, text string")
    odd = odd.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    both = docs.unionByName(odd).withColumns({c: F.lit("clash") for c in ("score", "kept", "blob", "_text2", "node")})
    kept = corpus_pipeline.near_dedup_stage(spark, both, DATA)
    assert kept.columns == both.columns
    ids = [r.doc_id for r in kept.where("text = '" + words + "'").collect()]
    assert sorted(ids, key=str) == [900001, None]
    assert kept.where("doc_id in (900003, 900004)").count() == 2
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, both, DATA)
        assert out.columns == both.columns, name
        assert stage(spark, both.limit(0), DATA).count() == 0, name
    assert corpus_pipeline.segmentation_stage(spark, both, DATA).count() == both.count()


def test_near_dedup_stage_keeps_what_a_scan_keeps(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, (r.text or "").translate({c: c + 32 for c in range(65, 91)}).split()) for r in docs.collect()]
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for d, w in rows}
    ids, root = sorted(sets), {}
    find = lambda i: i if root.setdefault(i, i) == i else find(root[i])
    for i in ids:
        for j in ids:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, DATA).collect()) == [i for i in ids if find(i) == i]
