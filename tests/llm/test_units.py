"""The operators' cores against brute force, without Spark."""

import itertools
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from veldra.llm import clusters, contamination, dom, langid, nbest, passages, quality, textcodes as tc, tokenfiles, topk


def test_words_and_shingles_are_those_of_plain_python():
    texts = ["The  cat\tsat", "", None, "THE cat", "ünï x", "a" * 300, "  "]
    data, offsets = tc.utf8(pa.array(texts))
    h, start, stop, at = tc.words(data, offsets, tc.SPACED)
    raw = bytes(data)
    got = [[raw[start[j] : stop[j]].decode() for j in range(at[i], at[i + 1])] for i in range(len(texts))]
    assert got == [["The", "cat", "sat"], [], [], ["THE", "cat"], ["ünï", "x"], ["a" * 300], []]
    assert h[0] == h[3] and h[1] == h[4] and h[0] != h[1]
    assert len(tc.shingle_set(h[0:3], 4)) == 1 and len(tc.shingle_set(h[:0], 4)) == 0


def test_suffix_array_search_finds_what_a_scan_finds():
    rng = np.random.default_rng(1)
    for _ in range(30):
        words = rng.integers(1, 4, 200).astype(np.uint64)
        words[rng.integers(0, 200, 5)] = 0
        bench = contamination.Benchmark([7, 8], ["x", "y"])
        bench.words = rng.integers(1, 4, 40).astype(np.uint64)
        bench.item, bench.begin, bench.end = np.repeat([7, 8], 20), np.repeat([0, 20], 20), np.repeat([20, 40], 20)
        pos = np.arange(40)
        keep = pos + 10 <= bench.end
        bench.test, bench.width = pos[keep], np.full(keep.sum(), 10)
        hit = set()
        for i, p, n in contamination.longest_matches(contamination.SuffixArray(words), bench):
            for a, b, m in zip(i, p, n, strict=True):
                assert (bench.words[a : a + m] == words[b : b + m]).all() and m >= 10
                hit |= {(x + a, x + b) for x in range(m - 9)}
        want = {(a, b) for a in bench.test for b in range(191) if (words[b : b + 10] == bench.words[a : a + 10]).all()}
        assert hit == want


def test_longest_match_counts_agree_with_a_naive_parse():
    samples = {"a": "the cat and the dog", "b": "el gato y el perro"}
    model = langid.build_model(samples)

    def phrases(text, sample):
        n = i = 0
        while i < len(text):
            j = i + 1
            while j <= len(text) and text[i:j] in sample:
                j += 1
            i = max(i + 1, j - 1)
            n += 1
        return n

    for text in ("the dog", "gato perro", "xyz the", "catdog"):
        bits, letters = langid.code_lengths(model, [text])
        assert letters[0] == sum(c.isalpha() for c in text)
        assert [round(b / x) for b, x in zip(bits[0], model.bits, strict=True)] == [phrases(text, samples[k]) for k in ("a", "b")]
    bits, letters = langid.code_lengths(model, ["", "123", "the\0cat"])
    assert list(letters) == [0, 0, 6]


def _phrases(text, sample):
    n = i = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in sample:
            j += 1
        i = max(i + 1, j - 1)
        n += 1
    return n


@pytest.mark.parametrize("span", [3, 17, 512])
def test_long_texts_are_parsed_as_wholes(span, monkeypatch):
    monkeypatch.setattr(langid, "SPAN", span)
    rng = random.Random(span)
    samples = {k: "".join(rng.choice(a) for _ in range(400)) for k, a in (("a", "aab c"), ("b", "abbcc "), ("c", "a"))}
    samples = {k: langid.normalised(v) for k, v in samples.items()}
    model = langid.build_model(samples)
    texts = ["".join(rng.choice("abc d") for _ in range(n)) for n in (1, 30, 700, 3000)] + ["a" * 1500, samples["a"][:399] * 3]
    texts = [langid.normalised(t) for t in texts]
    bits, _ = langid.code_lengths(model, texts)
    for row, t in zip(bits, texts, strict=True):
        assert [round(b / x) for b, x in zip(row, model.bits, strict=True)] == [_phrases(t, samples[k]) for k in "abc"]


def test_rules_separate_and_are_sparse():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 5))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.7)).astype(float)
    model = quality.fit_rules(list("abcde"), x, y)
    margin = model.intercept + sum(r.weight * np.all([(x[:, "abcde".index(n)] > c) == above for n, above, c in r.conditions], axis=0) for r in model.rules)
    assert ((margin > 0) == y).mean() > 0.98 and len(model.rules) < 60
    assert quality.fit_rules(["a"], np.zeros((0, 1)), np.zeros(0)).rules == ()
    assert quality.fit_rules(["a"], np.ones((3, 1)), np.ones(3)).intercept > 0


@pytest.fixture(scope="module")
def encoder():
    return nbest.Encoder(public_tokenizers.path("piece_bpe_32k.model"))


def test_n_best_are_the_best_of_all_segmentations(encoder):
    p = encoder.pieces

    def every(u, a=0):
        if a == len(u):
            yield 0.0, ()
        for b in range(a + 1, min(len(u), a + p.longest) + 1):
            if u[a:b] in p.ids:
                yield from ((p.scores[u[a:b]] + s, (p.ids[u[a:b]], *i)) for s, i in every(u, b))
        if a < len(u) and u[a] not in p.ids:
            raw = nbest._spelling(u[a])
            yield from ((p.byte_score * len(raw) + s, (*(p.bytes_[x] for x in raw), *i)) for s, i in every(u, a + 1))

    rng = random.Random(4)
    for _ in range(120):
        xs = ["".join(rng.choice("the and, in.  \nxé中😀▁") for _ in range(rng.randrange(9))) for _ in range(3)]
        data, offsets = tc.utf8(pa.array(xs))
        for x, (ids, scores, _) in zip(xs, encoder.encode(data, offsets, 4), strict=True):
            u = nbest.SPACE + x.replace(nbest.SPACE, nbest.LITERAL).replace(" ", nbest.SPACE) if x else ""
            want = sorted((s for s, _ in every(u)), reverse=True)[:4]
            assert np.allclose(want, scores)
            assert nbest.decode(p, ids) == x
            edges = p.edges(u)
            assert np.allclose([s for s, _ in nbest.n_best(edges, 4)], want)


def test_all_of_the_n_best_come_with_their_ids(encoder):
    p = encoder.pieces
    value = {i: p.scores[x] for x, i in p.ids.items()} | dict.fromkeys(p.bytes_, p.byte_score)
    rng = random.Random(5)
    xs = ["".join(rng.choice("the and, in.  \nxé中😀▁aaa--") for _ in range(rng.randrange(120))) for _ in range(200)] + ["", "a", "aaaaaaa aaaaaaa", "-" * 90]
    data, offsets = tc.utf8(pa.array(xs))
    for x, (ids, scores, others) in zip(xs, encoder.encode(data, offsets, 4), strict=True):
        every = [ids.tolist(), *(o.tolist() for o in others)]
        assert len(every) == len(scores) == len({tuple(e) for e in every})
        assert all(nbest.decode(p, e) == x for e in every)
        assert np.allclose([sum(value[i] for i in e) for e in every], scores)


def test_cut_encoding_is_the_library_s():
    path = public_tokenizers.path("byte_bpe_50k.json")
    e = tokenfiles.Encoder(path)
    rng = random.Random(1)
    pool = [*"ab 's\n\t1é.'’x中", " ", "　", "ll", "<|endoftext|>"]
    for _ in range(300):
        xs = ["".join(rng.choice(pool) for _ in range(rng.randrange(14))) for _ in range(4)]
        ids, n = e.encode(*tc.utf8(pa.array(xs)))
        want = [e.tokenizer.encode(x, add_special_tokens=False).ids for x in xs]
        assert list(ids) == list(itertools.chain(*want)) and list(n) == [len(w) for w in want]


def _searched(ids, x, queries, k, pivots):
    chosen = topk.Pivots.of(x, (x**2).sum(axis=1).max(), pivots) if pivots else None
    table = lambda rows, ask: chosen.distances(x[rows], ask) if chosen else np.zeros((len(rows), 0))
    s = topk.Search(ids[queries], x[queries], table(queries, True), chosen, k)
    for a in range(0, len(ids), 70):
        part = np.arange(a, min(a + 70, len(ids)))
        s.add(ids[part], x[part], table(part, False))
    return s


@pytest.mark.parametrize("pivots", [0, 1, 4, 40])
def test_top_k_is_brute_force(pivots):
    rng = np.random.default_rng(2)
    for scale in (3, 2**30) if not pivots else (3, 50):
        x = np.floor(rng.normal(size=(300, 6)) * scale)
        ids, queries = np.arange(300), np.array([0, 5, 9])
        s = _searched(ids, x, queries, 7, pivots)
        for row, q in enumerate(queries):
            score = [sum(int(a) * int(b) for a, b in zip(x[q], v, strict=True)) for v in x]
            want = sorted((-s, i) for i, s in enumerate(score) if i != q)[:7]
            assert [(-s, i) for s, i in zip(s.best.score[row], s.best.ids[row], strict=True)] == want


def test_bounds_hold_and_are_the_tightest_of_the_table():
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(200, 9)) * 40)
    top = (x**2).sum(axis=1).max()
    exact = x[:20] @ x.T
    for n in (1, 2, 5, 30):
        p = topk.Pivots.of(x, top, n)
        q, t = p.distances(x[:20], True), p.distances(x, False)
        q2 = (x[:20] ** 2).sum(axis=1)
        bound = topk.upper_bounds(p, q2, q, t)
        single = (q2[:, None] + top - (np.abs(q[:, None, :] - t[None, :, :]).max(axis=2)) ** 2) / 2
        assert (bound >= exact).all() and (bound <= single + 1 + 1e-5 * (q2[:, None] + top)).all()


def test_pivots_eliminate_most_candidates():
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(12, 24))
    x = np.floor(64 * (centre[rng.integers(0, 12, 3000)] + 0.2 * rng.normal(size=(3000, 24))))
    s = _searched(np.arange(3000), x, np.arange(0, 3000, 60), 5, 16)
    assert s.evaluated < 0.3 * s.seen  # a first round for each of the many small batches included
    free = rng.normal(size=(3000, 64))
    free = np.floor(64 * free / np.linalg.norm(free, axis=1, keepdims=True))
    chosen = topk.Pivots.of(free, (free**2).sum(axis=1).max())
    s = topk.Search(np.arange(40), free[:40], chosen.distances(free[:40], True), chosen, 20)
    s.add(np.arange(3000), free, chosen.distances(free, False))
    assert s.evaluated < 0.3 * s.seen


def test_bands_reach_the_recall():
    for s, r in ((0.8, 0.99), (0.9, 0.999), (0.5, 0.9)):
        b, rows = passages.tuned_bands(s, r)
        assert 1 - (1 - s**rows) ** b >= r


def test_paragraphs_of_a_copied_passage_are_cut_alike():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    found = 0
    for _ in range(50):
        passage = " ".join(word() for _ in range(60))
        texts = [" ".join(word() for _ in range(rng.randrange(80))) + " " + passage + " " + " ".join(word() for _ in range(40)) for _ in range(2)]
        out = passages._chunk_units(*tc.utf8(pa.array(texts)))
        sigs = [set(out[5][out[0] == i]) for i in (0, 1)]
        found += bool(sigs[0] & sigs[1])
    assert found >= 48


PAGE = '<html><head><title>t</title><script>"<p>no</p>"</script></head><body><nav><a>Home</a></nav><div class="ad">buy</div><article><h1>A &amp; B</h1><p>one\n two<br>three <b>four</b><p>five<form>f</form><div class="comments"><p>nice</p></div></article><aside>s</aside><footer>&copy;</footer>'


def test_main_text():
    assert dom.main_text(dom.parse(PAGE)) == "A & B\none two three four\nfive"
    for bad in ("", "<", "<p", "</p>", "<p>a</div>b", "<!-- x", "<a title='>x", "<div>" * 3000 + "x", "&#0;&am"):
        assert isinstance(dom.main_text(dom.parse(bad)), str)


def test_wrapper_keeps_what_varies():
    rng = random.Random(1)
    text = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(30))
    page = lambda: f"<body><div class=x><span>Welcome to this fine site of ours</span></div><div class=c><p>{text()}</p><p>{text()}</p></div><div class=z>All of it belongs to somebody</div></body>"
    pages = [page() for _ in range(4)]
    wrapper = dom.induce([dom.parse(p) for p in pages])
    assert wrapper and wrapper[0] == 4
    out = dom.main_text(dom.parse(pages[0]), wrapper)
    assert "Welcome" not in out and "belongs" not in out and out.count("\n") == 1
    assert dom.induce([dom.parse(pages[0])] * 3) is None  # copies say nothing


def test_long_lists_are_aligned_at_equal_subtrees():
    page = lambda k, n: "<body>" + "".join(f"<p>{k}{i}</p>" for i in range(n)) + "<p>constant</p>" + "".join(f"<p>{k}z{i}</p>" for i in range(400)) + "</body>"
    a, b = dom.parse(page("a", 300)), dom.parse(page("b", 450))
    assert "constant" in {p.text for p, q in dom.align(a, b) if p.tag == "#" and p.text == q.text}


def _tree(rng, depth=0):
    node = dom.Node(rng.choice("xyz"), None)
    node.label = node.tag
    for _ in range(rng.randrange(4) if depth < 3 else 0):
        if rng.random() < 0.4:
            node.kids.append(dom.Node("#", node, rng.choice(["p", "q"])))
        else:
            node.kids.append(_tree(rng, depth + 1))
    return node


def _largest(a, b):
    """Largest top-down matching by trying every choice."""
    if a.label != b.label:
        return 0
    if a.tag == "#":
        return 2 if a.text == b.text else 1

    def lists(x, y):
        if not x or not y:
            return 0
        best = max(lists(x[1:], y), lists(x, y[1:]))
        s = _largest(x[0], y[0])
        return max(best, s + lists(x[1:], y[1:])) if s else best

    return 1 + lists(a.kids, b.kids)


@pytest.mark.parametrize("cells", [0, 200])
def test_alignment_is_the_largest_matching(cells, monkeypatch):
    monkeypatch.setattr(dom, "LOOP_CELLS", cells)
    rng = random.Random(5)
    for _ in range(150):
        a, b = _tree(rng), _tree(rng)
        b.label = a.label
        pairs = dom.align(a, b)
        assert all(p.label == q.label for p, q in pairs)
        assert sum(2 if p.tag == "#" and p.text == q.text else 1 for p, q in pairs) == _largest(a, b) == dom._score(a, b, {})


def test_the_wrapper_decides_on_the_given_pages():
    import pyarrow.dataset as ds

    pages = ds.dataset("/root/testdata/sf0.01/pages.parquet").to_table(columns=["url", "html"]).to_pylist()
    hosts = {}
    for r in pages:
        hosts.setdefault(r["url"].split("/")[2], []).append(r["html"])
    several = {h: x for h, x in hosts.items() if len(set(x)) > 1}
    for html in several.values():
        wrapper = dom.induce([dom.parse(x) for x in dict.fromkeys(html)])
        assert wrapper[2][-1] == "article"
        for x in html:
            page = dom.parse(x)
            dom._mark(page, False)
            assert dom.placed(page, wrapper[1])[1].tag == "article"
            # Without the element kinds that name it, the slot is found all the same.
    plain = [[x.replace("<article>", "<div class=c7>").replace("</article>", "</div>") for x in html] for html in several.values() if len(html) > 5]
    for html in plain:
        wrapper = dom.induce([dom.parse(x) for x in dict.fromkeys(html)])
        assert wrapper[2][-1] == "div.c7"


def test_neutral_pages_give_the_text_of_marked_ones():
    import re

    import pyarrow.dataset as ds

    def neutral(html):
        html = re.sub(r"""\s(?:class|id|role|aria-[a-z]+)=(?:"[^"]*"|'[^']*'|[^\s>]+)""", "", html)
        return re.sub(r"<(/?)(?:article|nav|aside|footer|header|form|main|section|figure)\b", r"<\1div", html)

    hosts = {}
    for r in ds.dataset("/root/testdata/sf0.01/pages.parquet").to_table(columns=["url", "html"]).to_pylist():
        hosts.setdefault(r["url"].split("/")[2], []).append(r["html"])
    for html in hosts.values():
        unlike = list(dict.fromkeys(html))
        wrapper = dom.induce([dom.parse(neutral(x)) for x in unlike]) if len(unlike) > 1 else None
        for x in html:
            assert dom.main_text(dom.parse(neutral(x)), wrapper) == dom.main_text(dom.parse(x))


def test_the_wrapper_beats_density_on_classless_pages():
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    terms, menu = "".join(f"<p>{words(200)}</p>" for _ in range(2)), "".join(f"<a href=x>{words(1)}</a>" for _ in range(2))
    articles = [(words(3), [words(12) for _ in range(rng.randrange(2, 5))]) for _ in range(8)]
    advert = lambda: f"<div>{words(4)}</div>" if rng.random() < 0.5 else ""
    pages = [f"<html><body><div>{menu}</div><div>{advert()}<div><div><h1>{h}</h1></div><div>{''.join(f'<p>{x}</p>' for x in ps)}</div></div></div><div>{terms}</div></body></html>" for h, ps in articles]
    wrapper = dom.induce([dom.parse(x) for x in pages])
    want = ["\n".join([h, *ps]) for h, ps in articles]
    assert [dom.main_text(dom.parse(x), wrapper) for x in pages] == want
    assert all(dom.main_text(dom.parse(x)) != y for x, y in zip(pages, want, strict=True))  # density alone takes the terms


def test_stray_tags_take_linear_time():
    import time

    began = time.perf_counter()
    assert dom.main_text(dom.parse("<div>" * 20_000 + "</b>" * 20_000 + "<p>x")) == "x"
    assert time.perf_counter() - began < 5


def test_deep_nesting_and_several_articles():
    deep = "<div>" * 20_000 + "<nav>menu</nav><p>text</p>"
    assert dom.main_text(dom.parse(deep)) == "text"
    assert dom.main_text(dom.parse("<body><article><p>one</article><nav>x</nav><article><p>two</article>")) == "one\ntwo"


def test_blocks_of_sets_are_compared_exactly():
    rng = random.Random(8)
    sets = [np.unique(np.array([rng.randrange(12) for _ in range(rng.randrange(14))], np.uint64)) for _ in range(60)]
    got = clusters.similar(sets, 80)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            x, y = set(a.tolist()), set(b.tolist())
            assert got[i, j] == (i != j and bool(x) and bool(y) and 100 * len(x & y) >= 80 * len(x | y))
    a, b = clusters.forest(got)
    roots = list(range(60))
    find = lambda i: i if roots[i] == i else find(roots[i])
    for i, j in zip(a, b, strict=True):
        assert got[i, j] and find(i) != find(j)
        roots[find(i)] = find(j)
    assert all(find(i) == find(j) for i, j in zip(*np.nonzero(got), strict=True))


def test_items_that_agree_across_components():
    rng = np.random.default_rng(6)
    tokens, comps = rng.integers(0, 3, (40, 8)), rng.integers(0, 3, 40)
    got = clusters.agreeing(tokens, comps, 5)
    want = [any(comps[i] != comps[j] and (tokens[i] == tokens[j]).sum() >= 5 for j in range(40)) for i in range(40)]
    assert got.tolist() == want


def test_links_in_blocks_are_a_forest_of_all_links():
    rng = random.Random(9)
    size = [rng.choice([1, 2, 3, 5, 8, 9, 20]) for _ in range(60)]
    edges = np.concatenate(([0], np.cumsum(size)))
    n = int(edges[-1])
    sets = [np.unique(np.array([rng.randrange(9) for _ in range(rng.randrange(10))], np.uint64)) for _ in range(n)]
    comps, items = np.array([rng.randrange(3) for _ in range(n)]), np.arange(n) + 1000
    out = clusters.linked_in_blocks(items, comps, sets, edges, 80)
    root = list(range(n))
    find = lambda i: i if root[i] == i else find(root[i])
    like = lambda i, j: len(sets[i]) and len(sets[j]) and 100 * len(set(sets[i]) & set(sets[j])) >= 80 * len(set(sets[i]) | set(sets[j]))
    group = np.repeat(np.arange(60), size)
    for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
        i, j = a - 1000, b - 1000
        assert group[i] == group[j] and comps[i] != comps[j] and like(i, j) and find(i) != find(j)
        root[find(i)] = find(j)
    assert all(find(i) == find(j) for i in range(n) for j in range(i) if group[i] == group[j] and comps[i] != comps[j] and like(i, j))
    tokens = np.array([[rng.randrange(3) for _ in range(6)] for _ in range(n)])
    got = clusters.agreeing_in_blocks(tokens, comps, edges, 4)
    assert got.tolist() == [any(group[i] == group[j] and comps[i] != comps[j] and (tokens[i] == tokens[j]).sum() >= 4 for j in range(n)) for i in range(n)]


def test_groups_are_read_across_batches():
    keys = [1, 1, 2, 2, 2, 3, 5, 5, 5, 5]
    for cut in range(1, 11):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[a : a + cut]), pa.array(range(a, min(a + cut, 10)))], ["k", "v"]) for a in range(0, 10, cut)]
        got = []
        for t, edges in clusters.whole_groups(iter(batches)):
            got += [(t.column(0)[a].as_py(), t.column(1).to_pylist()[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        assert got == [(1, [0, 1]), (2, [2, 3, 4]), (3, [5]), (5, [6, 7, 8, 9])]
