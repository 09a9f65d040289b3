"""Language identification by cross-parsing entropy.

A suffix automaton of a bounded sample of labelled rows stands for each language. A text is parsed against every
automaton into phrases, each the longest match with the sample (or one unseen character); the number of phrases times
the logarithm of the sample's length is the text's code length, and the language with the shortest wins.

The automata share one set of transition arrays, and a batch of texts runs through them in lockstep: one NumPy step takes
the next character of all texts in all languages. States with the most transitions have a line in a dense table of bounded
size; a state beyond it has its first transition beside it and others in a sorted list, so an alphabet of thousands of
letters takes no more room than its text. Texts are lower-cased; what isn't a letter separates words. Whole texts are
parsed: long ones run in spans side by side, each as if a phrase began there; then every span is followed again from the
state in which the one before it ended, up to the place where both ways meet, which puts its count right.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.llm import textcodes as tc

#: Bounds of the sample that is learned from: rows of a language, and characters of a language's and of all rows, which end
#: the sample at a whole row. However many languages there are, each gets LEAST_CHARS.
SAMPLE_ROWS, LANGUAGE_CHARS, ALL_CHARS, LEAST_CHARS = 64, 40_000, 2_000_000, 4_000
#: Bytes of the dense table; results don't depend on it. Bytes of a whole model, which is broadcast.
DENSE_BYTES, MODEL_BYTES = 96 << 20, 768 << 20
#: Characters of a text that are parsed side by side with others; results don't depend on it.
SPAN = 512
UNDETERMINED = "und"

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def normalised(text: str) -> str:
    """Lower case, with one space for each run of other characters than letters."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the smallest automaton that accepts all substrings; state 0 is the root."""
    nxt: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


@dataclass
class LanguageModel:
    """Automata of all languages in common arrays; a transition is 2 * next state + (1 if a phrase begins).

    Codes of characters: 0 space, 1 unseen letter, 2.. letters. ``root``: language x code, also what a missing transition
    is. ``line``: place of a state in ``dense`` or -1; ``lone``, ``lone_next``: code and target of a state's first transition;
    ``keys``, ``targets``: its others by state * codes + code, sorted.
    """

    languages: list[str]
    alphabet: np.ndarray
    roots: np.ndarray
    bits: np.ndarray
    root: np.ndarray
    line: np.ndarray
    dense: np.ndarray
    lone: np.ndarray
    lone_next: np.ndarray
    keys: np.ndarray
    targets: np.ndarray
    all_dense: bool

    @property
    def codes(self) -> int:
        return len(self.alphabet) + 2

    @property
    def n_bytes(self) -> int:
        return sum(x.nbytes for x in (self.root, self.line, self.dense, self.lone, self.lone_next, self.keys, self.targets))

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Transitions of the states (language x text) by the texts' next codes."""
        if self.all_dense:
            return self.dense[state * self.codes + code]
        line = self.line[state]
        lang, at = np.nonzero(line < 0)
        out = self.dense[np.maximum(line, 0).astype(np.int64) * self.codes + code] if len(self.dense) else np.empty(state.shape, np.int32)
        s, c = state[lang, at], code[at]
        found = np.where(self.lone[s] == c, self.lone_next[s], -1)
        open_ = np.flatnonzero(found < 0)
        key = s[open_].astype(np.int64) * self.codes + c[open_]
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1) if len(self.keys) else None
        if place is not None:
            hit = self.keys[place] == key
            found[open_[hit]] = self.targets[place[hit]]
        missing = found < 0
        found[missing] = self.root[lang[missing], c[missing]]
        out[lang, at] = found
        return out


def build_model(samples: dict[str, str], dense_bytes: int = DENSE_BYTES) -> LanguageModel:
    """Automata of the normalised samples."""
    languages = sorted(samples)
    alphabet = np.array(sorted({ord(c) for s in samples.values() for c in s} - {32}), np.int64)
    code = {chr(c): i + 2 for i, c in enumerate(alphabet)} | {" ": 0}
    width = len(alphabet) + 2
    root = np.zeros((len(languages), width), np.int32)
    states, codes, targets, roots, base = [], [], [], [], 0
    for i, name in enumerate(languages):
        nxt = suffix_automaton(samples[name])
        first = {code[c]: 2 * (base + q) + 1 for c, q in nxt[0].items()}
        root[i] = 2 * base + 1
        root[i, list(first)] = list(first.values())
        count = np.fromiter(map(len, nxt), np.int64, len(nxt))
        count[0] = 0  # a step from the root always begins a phrase
        total = int(count.sum())
        states.append(np.repeat(base + np.arange(len(nxt)), count))
        codes.append(np.fromiter((code[c] for row in nxt[1:] for c in row), np.int64, total))
        targets.append(np.fromiter((2 * (base + q) for row in nxt[1:] for q in row.values()), np.int32, total))
        roots.append(base)
        base += len(nxt)
    state, to, target = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (states, codes, targets))
    order = np.argsort(state * width + to)
    state, to, target = state[order], to[order], target[order].astype(np.int32)
    bits = np.array([np.log2(max(2, len(samples[x]))) for x in languages])
    lines = min(base, dense_bytes // (4 * width))
    every = lines == base
    degree = np.bincount(state, minlength=base)
    degree[roots] = width  # roots are the states that are used most
    rich = np.sort(np.argsort(-degree, kind="stable")[:lines])
    line = np.full(base, -1, np.int32)
    line[rich] = np.arange(lines)
    owner = np.searchsorted(np.array(roots), np.arange(base), "right") - 1
    dense = root[owner[rich]] if lines else np.zeros((0, width), np.int32)
    inside = line[state] >= 0
    dense[line[state[inside]], to[inside]] = target[inside]
    state, to, target = state[~inside], to[~inside], target[~inside]
    first = np.ones(len(state), bool)
    first[1:] = state[1:] != state[:-1]
    lone, lone_next = np.full(0 if every else base, -1, np.int32), np.full(0 if every else base, -1, np.int32)
    lone[state[first]], lone_next[state[first]] = to[first], target[first]
    return LanguageModel(languages, alphabet, np.array(roots, np.int64), bits, root, line, dense.ravel(), lone, lone_next, (state * width + to)[~first], target[~first], every)


def code_lengths(model: LanguageModel, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bits of each text in each language, number of its letters)."""
    n = len(texts)
    letters = _letter_table()
    seen = letters.astype(np.int32)
    seen[model.alphabet] = np.arange(2, len(model.alphabet) + 2)
    joined = "\0".join(t.replace("\0", " ") for t in texts).lower()
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = seen[points]
    breaks = np.concatenate(([-1], np.flatnonzero(points == 0), [len(points)]))
    count = np.concatenate(([0], np.cumsum(code != 0)))
    n_letters = count[breaks[1:]] - count[np.minimum(breaks[:-1] + 1, len(points))]
    keep = code != 0
    keep[1:] |= code[:-1] != 0
    place = np.concatenate(([0], np.cumsum(keep)))
    code = code[keep]
    first, stop = place[np.minimum(breaks[:-1] + 1, len(points))], place[breaks[1:]]
    spans = -(-(stop - first) // SPAN)
    text = np.repeat(np.arange(n), spans)
    at = first[text] + SPAN * (np.arange(len(text)) - np.repeat(np.cumsum(spans) - spans, spans))
    size = np.minimum(SPAN, stop[text] - at)
    phrases, end = _parse(model, code, at, size)
    _rejoin(model, code, at, size, text, phrases, end)
    total = np.stack([np.bincount(text, p, n) for p in phrases]) if len(phrases) else np.zeros((0, n))
    return total.T * model.bits[None, :], n_letters


def _parse(model: LanguageModel, code: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrases, last state) of each span in each language, if a phrase begins with the span."""
    order = np.argsort(-size, kind="stable")
    at, size = at[order], size[order]
    live = np.searchsorted(-size, -np.arange(1, SPAN + 1), "right")
    state = np.repeat(model.roots[:, None], len(at), axis=1)
    phrases = np.zeros(state.shape, np.int64)
    for t in range(int(size[0]) if len(size) else 0):
        m = live[t]
        v = model.step(state[:, :m], code[at[:m] + t])
        phrases[:, :m] += v & 1
        state[:, :m] = v >> 1
    out = np.empty_like(phrases), np.empty_like(state)
    out[0][:, order], out[1][:, order] = phrases, state
    return out


def _rejoin(model: LanguageModel, code: np.ndarray, at: np.ndarray, size: np.ndarray, text: np.ndarray, phrases: np.ndarray, end: np.ndarray) -> None:
    """Make the counts those of whole texts: follow each span from the state in which the one before it really ends."""
    first, lone_end = phrases.copy(), end.copy()
    todo = np.flatnonzero(text[1:] == text[:-1]) + 1
    while len(todo):
        now = todo
        lone, true = np.repeat(model.roots[:, None], len(now), axis=1), end[:, now - 1].copy()
        more, t = np.zeros(lone.shape, np.int64), 0
        apart = np.arange(len(now))
        while True:
            apart = apart[(lone[:, apart] != true[:, apart]).any(axis=0) & (size[now[apart]] > t)]
            if not len(apart):
                break
            c = code[at[now[apart]] + t]
            u, v = model.step(lone[:, apart], c), model.step(true[:, apart], c)
            more[:, apart] += (v & 1) - (u & 1)
            lone[:, apart], true[:, apart] = u >> 1, v >> 1
            t += 1
        phrases[:, now] = first[:, now] + more
        # Where both ways met the span ends as it does alone; else the next span begins in another state than was taken.
        last = np.where(lone != true, true, lone_end[:, now])
        moved = now[(last != end[:, now]).any(axis=0)]
        end[:, now] = last
        after = moved + 1
        todo = after[(after < len(text)) & (text[np.minimum(after, len(text) - 1)] == text[moved])]


def _predictor(held):
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = held.value
        names = np.array([*model.languages, UNDETERMINED], object)
        for column in batches:
            texts, picks, scores = column.fill_null("").to_pylist(), [], []
            sizes = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
            for a, b in tc.chunks(sizes, tc.CHUNK_BYTES // 2):
                bits, letters = code_lengths(model, texts[a:b])
                if not model.languages:
                    picks.append(np.full(b - a, len(names) - 1))
                    scores.append(np.zeros(b - a))
                    continue
                best = bits.argmin(axis=1)
                low = bits.min(axis=1)
                bits[np.arange(b - a), best] = np.inf
                second = bits.min(axis=1)
                share = np.where(np.isinf(second), 1.0, second / np.where(low + second > 0, np.where(np.isinf(second), 1.0, low + second), 1.0))
                picks.append(np.where(letters > 0, best, len(names) - 1))
                scores.append(np.where(letters > 0, np.clip(share, 0.0, 1.0), 0.0))
            yield pa.StructArray.from_arrays([pa.array(names[np.concatenate(picks)] if picks else [], pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["lang", "score"])

    from pyspark.sql.pandas.functions import ArrowUDFType

    return F.arrow_udf(predict, "lang string, score double", ArrowUDFType.SCALAR_ITER)


def fit(docs: DataFrame, doc: str, text: str, lang: str, usable: Column) -> LanguageModel:
    """Models of all labels of rows for which ``usable`` holds.

    For each label and each of ``SAMPLE_ROWS`` buckets of ids, the row with the smallest hash: a partial aggregate and
    one more scan, however many rows a label has. A row of more than ``LANGUAGE_CHARS`` characters is taken only where a
    bucket has no shorter one, the shortest first. Rows are whole; those of a label are taken in the order of their
    hashes as long as the bounds above allow, one at least. Rows with a null label, id or text teach nothing; without
    any row every text is undetermined. Repeated rows count once.
    """
    h = F.xxhash64(F.col(doc), F.lit(7))
    rows = docs.where(usable & F.col(lang).isNotNull() & F.col(doc).isNotNull() & F.col(text).isNotNull())
    size = F.length(F.col(text))
    key = F.struct(F.when(size > LANGUAGE_CHARS, size).otherwise(0).alias("long"), h.alias("h"))
    picks = rows.groupBy(F.col(lang).alias("l"), F.pmod(F.xxhash64(F.col(doc)), F.lit(SAMPLE_ROWS)).alias("b")).agg(F.min(key).alias("k"), F.min_by(size, key).alias("n"))
    found = sorted((r.l, r.k["long"], r.k["h"], r.n) for r in picks.collect())  # labels * SAMPLE_ROWS at most
    if not found:
        return build_model({})
    most = min(LANGUAGE_CHARS, max(LEAST_CHARS, ALL_CHARS // len({f[0] for f in found})))
    used: dict[str, int] = {}
    wanted = set()
    for name, _, hashed, n in found:
        if name not in used or used[name] + n <= most:
            wanted.add((name, hashed))
            used[name] = used.get(name, 0) + n
    ids = docs.sparkSession.createDataFrame([(hashed,) for hashed in sorted({x[1] for x in wanted})], "_h long")
    chosen = rows.select(F.col(lang).alias("l"), h.alias("h"), F.col(text).alias("t")).join(F.broadcast(ids), F.col("h") == F.col("_h")).select("l", "h", "t").distinct().collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(chosen, key=lambda r: (r.l, r.h, r.t)):
        if (r.l, r.h) in wanted:
            samples.setdefault(r.l, []).append(normalised(r.t))
    model = build_model({k: " ".join(x for x in v if x) for k, v in samples.items()})
    if model.n_bytes > MODEL_BYTES:
        raise MemoryError(f"a model of {model.n_bytes >> 20} MB for {len(model.languages)} languages; lower LEAST_CHARS")
    return model


def with_language(df: DataFrame, text: str, model: LanguageModel, into: str = "language") -> DataFrame:
    """``df`` with a struct column ``into``: lang and score.

    score: the second shortest code length over the sum of the two shortest, between 0.5 (no preference) and 1.
    Null texts and texts without a letter are ``und`` with score 0; ties go to the first language by name. A column
    already called ``into`` is replaced, others stay.
    """
    tc.bounded_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)  # MODEL_BYTES at most
    return df.withColumn(into, _predictor(held)(F.col(text)))
