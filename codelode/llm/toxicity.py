"""Operator 7: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a document: densities of two lexicons (a built-in list of insults, and words and word beginnings that mark
toxic documents in the labelled rows), how much of the hits stands near a second-person word, shares of capitals,
punctuation and symbols, and rates of obfuscation (hits that show only after undoing letter substitutions and masks,
digits inside words, stretched letters). The trees, the calibration and the learned lexicon are fitted here on at most
ROWS labelled documents, in FOLDS parts: the trees see each part with a lexicon learned from the others, and the
calibration is fitted on predictions of trees for parts that they were not fitted on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick
from .textops import buffers, gram_sets, mix64, prefix_hashes, slices, word_hash, word_table, words

#: The bound of the labelled sample: the rows of least hash of doc_id.
ROWS = 8000
ROUNDS, DEPTH, RATE, BINS = 60, 3, 0.15, 32
FOLDS = 3
#: A toxic document has at least this calibrated probability.
CUT = 0.5
NEAR = 5
PREFIXES = (4, 5, 6)

INSULTS = """idiot idiots idiotic stupid stupidity moron morons moronic imbecile dumb dumbass fool foolish loser losers pathetic scum trash garbage filth filthy
worthless clown disgusting vermin pig pigs swine rat rats bastard bastards bitch bitches whore slut cunt asshole arsehole prick dick douche jerk creep freak
retard retarded shit shitty bullshit crap fuck fucking fucker fucked damn hell kill die hate hateful ugly vile scumbag lowlife degenerate parasite subhuman savage
imbécile idiota idiotas estúpido estúpida imbécil basura inútil asqueroso mierda puta cabrón gilipollas pendejo crétin connard salaud salope merde putain débile
ordure nul minable dégoûtant dummkopf idioten trottel arschloch scheiße scheisse abschaum widerlich wertlos hurensohn mistkerl schwachkopf""".split()
SECOND_PERSON = "you your yours yourself youre u ur ya du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()

_LEET = word_table("*", {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
NAMES = ["insults", "insult_share", "learned", "learned_share", "learned_log", "near_you", "you", "capitals", "capital_words", "exclaim", "symbols", "obfuscated", "digit_words", "stretched", "length"]


def _hashes(items: list[str], table=None) -> np.ndarray:
    return np.unique(np.array([word_hash(x, table) for x in items], np.uint64))


def _masked(word: str) -> list[str]:
    """The word with one inner letter, or all of them, replaced by *."""
    if len(word) < 4 or not word.isascii():
        return []
    return [word[:k] + "*" + word[k + 1 :] for k in range(1, len(word) - 1)] + [word[0] + "*" * (len(word) - 2) + word[-1], word[0] + "*" * (len(word) - 1)]


_PLAIN = _hashes(INSULTS)
_OBFUSCATED = np.unique(np.concatenate([_hashes([w for w in INSULTS if len(w) > 3], _LEET), _hashes([m for w in INSULTS for m in _masked(w)], _LEET)]))
_YOU = _hashes(SECOND_PERSON)


def _isin(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(h), bool)
    return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h


def _per_row(mask: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask)])[first])


Lexicon = dict[int, np.ndarray]  # by length of the word beginning, 0 for whole words: sorted 48-bit hashes


def _keys(b: np.ndarray, h: np.ndarray, s: np.ndarray, e: np.ndarray) -> dict[int, np.ndarray]:
    return {0: h} | {p: prefix_hashes(b, s, e, p) for p in PREFIXES}


def features(b: np.ndarray, offs: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """(rows, features); whole texts, in one pass of array operations."""
    base = int(offs[0])
    t = b[base : int(offs[-1])]
    rel = offs - base
    h, s, e, first = words(b, offs)
    n = np.maximum(np.diff(first), 1).astype(float)
    size = np.maximum(np.diff(offs), 1).astype(float)
    plain = _isin(h, _PLAIN)
    learned = np.zeros(len(h), bool)
    for p, x in _keys(b, h, s, e).items():
        learned |= _isin(x >> np.uint64(16), lexicon.get(p, np.zeros(0, np.uint64)))
    any_hit = plain | learned
    you = _isin(h, _YOU)
    # second person within NEAR words, in the same row
    where = np.flatnonzero(you)
    near = np.zeros(len(h), bool)
    hits = np.flatnonzero(any_hit)
    if len(where) and len(hits):
        k = np.searchsorted(where, hits)
        row = np.searchsorted(first, np.arange(len(h)), "right")
        for side in (np.minimum(k, len(where) - 1), np.maximum(k - 1, 0)):
            near[hits] |= (np.abs(where[side] - hits) <= NEAR) & (row[where[side]] == row[hits])
    hl, _, _, fl = words(b, offs, _LEET)
    hidden = np.maximum(_per_row(_isin(hl, _OBFUSCATED), fl) - _per_row(_isin(h, _PLAIN), first), 0)

    def chars(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[rel])

    upper = (t >= 65) & (t <= 90)
    letter = upper | ((t >= 97) & (t <= 122))
    digit = (t >= 48) & (t <= 57)
    up = np.concatenate([[0], np.cumsum(upper)])
    dg = np.concatenate([[0], np.cumsum(digit)])
    rs, re_ = s - base, e - base
    length = re_ - rs
    n_up, n_dg = up[re_] - up[rs], dg[re_] - dg[rs]
    same = np.zeros(len(t), bool)
    if len(t) > 2:
        same[2:] = letter[2:] & (t[2:] == t[1:-1]) & (t[1:-1] == t[:-2])
    total = _per_row(any_hit, first)
    return np.stack(
        [
            100 * _per_row(plain, first) / n,
            np.log1p(_per_row(plain, first)),
            100 * _per_row(learned, first) / n,
            np.log1p(_per_row(learned, first)),
            np.log1p(total),
            _per_row(near, first) / np.maximum(total, 1),
            100 * _per_row(you, first) / n,
            chars(upper) / np.maximum(chars(letter), 1),
            _per_row((n_up == length) & (length > 1), first) / n,
            100 * chars((t == 33) | (t == 63)) / size,
            100 * chars((t > 32) & (t < 128) & ~letter & ~digit) / size,
            100 * hidden / n,
            100 * _per_row((n_dg > 0) & (n_dg < length), first) / n,
            100 * chars(same) / size,
            np.log1p(n),
        ],
        1,
    )


def learn_lexicon(b: np.ndarray, offs: np.ndarray, toxic: np.ndarray) -> Lexicon:
    """Words and word beginnings whose documents are toxic far beyond the usual share: odds of under about one in a million by chance."""
    rate = max(float(toxic.mean()), 1e-3) if len(toxic) else 1.0
    counts: dict[int, dict[str, list[np.ndarray]]] = {p: {"k": [], "t": []} for p in (0, *PREFIXES)}
    for i, j in slices(offs):
        h, s, e, first = words(b, offs[i : j + 1])
        rows = np.repeat(np.arange(j - i), np.diff(first))
        for p, x in _keys(b, h, s, e).items():
            keep = x != 0
            key = np.unique((rows[keep].astype(np.uint64) << np.uint64(48)) | (x[keep] >> np.uint64(16)))
            counts[p]["k"].append(key & np.uint64((1 << 48) - 1))
            counts[p]["t"].append(toxic[i:j][(key >> np.uint64(48)).astype(np.int64)])
    out: Lexicon = {}
    for p, c in counts.items():
        if not c["k"]:
            continue
        key, at = np.unique(np.concatenate(c["k"]), return_inverse=True)
        n = np.bincount(at)
        tox = np.bincount(at, weights=np.concatenate(c["t"]).astype(float))
        share = tox / n
        marks = (share > 0.6) & (tox * np.log(np.maximum(share, 1e-9) / rate) > 13)
        out[p] = np.sort(key[marks])
    return out


@dataclass
class Trees:
    edges: list[np.ndarray]  # by feature, ascending cuts
    base: float
    #: of each tree, complete: by inner node feature and cut; leaves' values
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray


def _score(m: Trees, x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), m.base)
    rows = np.arange(len(x))
    for f, c, v in zip(m.feature, m.cut, m.value):
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, f[node]] > c[node])
        out += v[node - (2**DEPTH - 1)]
    return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Second-order boosting of the logistic loss with binned exact-greedy splits."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    # many features are mostly 0: their first cut lies just above
    edges = [np.unique(np.concatenate([e, [0.0]])) for e in edges]
    code = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p0 / (1 - p0)))
    margin = np.full(len(y), base)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    least = 8 if y.sum() >= 200 else 3
    F_, C_, V_ = [], [], []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        f, c = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            best = (1e-6, -1, 0)
            G, H = g[rows].sum(), h[rows].sum()
            for q, e in enumerate(edges):
                width = len(e) + 1
                gs = np.cumsum(np.bincount(code[rows, q], g[rows], width))[:-1]
                hs = np.cumsum(np.bincount(code[rows, q], h[rows], width))[:-1]
                cs = np.cumsum(np.bincount(code[rows, q], minlength=width))[:-1]
                gain = gs**2 / (hs + 1) + (G - gs) ** 2 / (H - hs + 1) - G**2 / (H + 1)
                gain[(cs < least) | (len(rows) - cs < least)] = -1
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), q, int(gain.argmax()))
            right = np.zeros(len(rows), bool)
            if best[1] >= 0:
                f[k], c[k] = best[1], edges[best[1]][best[2]]
                right = x[rows, f[k]] > c[k]
            node[rows] = 2 * k + 1 + right
        leaf = node - inner
        v = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + 1)
        margin += v[leaf]
        F_.append(f)
        C_.append(c)
        V_.append(v)
    return Trees(edges, base, np.array(F_), np.array(C_), np.array(V_))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: ascending scores and the calibrated probability from each on."""
    o = np.argsort(score, kind="stable")
    at, inverse = np.unique(score[o], return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    mean = np.bincount(inverse, y[o]) / weight
    stack: list[list[float]] = []
    for a, w, m in zip(at, weight, mean):
        stack.append([a, w, m])
        while len(stack) > 1 and stack[-2][2] >= stack[-1][2]:
            b = stack.pop()
            t = stack[-1]
            t[2] = (t[1] * t[2] + b[1] * b[2]) / (t[1] + b[1])
            t[1] += b[1]
    return np.array([s[0] for s in stack]), np.array([s[2] for s in stack])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    at: np.ndarray
    prob: np.ndarray


def predict(m: Model, x: np.ndarray) -> np.ndarray:
    if m.trees is None:
        return np.zeros(len(x))
    k = np.searchsorted(m.at, _score(m.trees, x), "right") - 1
    return m.prob[np.maximum(k, 0)]


def _unlike(texts: list[str]) -> list[int]:
    """Indexes without near copies, which would make chance words of a copied text look telling: no two share a min-hash of four."""
    seen: set[tuple[int, int]] = set()
    out = []
    for k, text in enumerate(texts):
        raw = text.encode()
        h, _, _, first = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)], np.int64))
        v, _ = gram_sets(h, first, 3)
        mine = {(q, int(mix64(v.astype(np.uint64) + np.uint64(q << 50)).min())) for q in range(4)} if len(v) else {(0, 0)}
        if not mine & seen:
            out.append(k)
        seen |= mine
    return out


def train(texts: list[str], toxic: list[int]) -> Model:
    """Rows in any order give the same model. Without both labels every document has probability 0."""
    order = sorted(range(len(texts)), key=lambda k: (texts[k], toxic[k]))
    order = [order[k] for k in _unlike([texts[k] for k in order])]
    y = np.array([toxic[k] for k in order], float)
    col = pa.array([texts[k] for k in order], pa.large_string())
    if len(order) < 2 * FOLDS or y.min() == y.max():
        return Model({}, None, np.zeros(1), np.zeros(1))
    fold = np.random.default_rng(11).permutation(len(order)) % FOLDS
    x = np.zeros((len(y), len(NAMES)))
    for k in range(FOLDS):
        b, offs = buffers(col.filter(pa.array(fold != k)))
        lexicon = learn_lexicon(b, offs, y[fold != k])
        b, offs = buffers(col.filter(pa.array(fold == k)))
        x[fold == k] = np.concatenate([features(b, offs[i : j + 1], lexicon) for i, j in slices(offs)])
    out = np.zeros(len(y))
    for k in range(FOLDS):
        out[fold == k] = _score(boost(x[fold != k], y[fold != k]), x[fold == k])
    at, prob = isotonic(out, y)
    return Model(learn_lexicon(*buffers(col), y), boost(x, y), at, prob)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> tuple[list[str], list[int]]:
    """Texts and labels of the `rows` labelled documents of least hash; only their ids are sent to the table of documents."""
    lab = pick(labels, doc_id="long", toxic="int").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    least = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    d = pick(docs, doc_id="long", text="string").where("text is not null and text <> ''")
    got = d.join(F.broadcast(least), "doc_id").select("text", "toxic").toArrow()
    return got["text"].to_pylist(), [int(x > 0) for x in got["toxic"].to_pylist()]


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    return train(*labelled_sample(docs, labels, rows))


_OUT = pa.schema([("doc_id", pa.int64()), ("probability", pa.float64()), ("hits", pa.int64()), ("toxic", pa.bool_())])


def score_documents(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """(doc_id, probability, hits, toxic) of every row: calibrated probability, lexicon hits, and whether it reaches the cut.

    A null or empty text has probability 0 and is not toxic. Null ids stay null, repeated rows give repeated results,
    other columns are ignored. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, offs = buffers(batch.column(1))
            for i, j in slices(offs):
                x = features(b, offs[i : j + 1], model.lexicon)
                p = np.where(np.diff(offs[i : j + 1]) > 0, np.round(predict(model, x), 6), 0.0)
                hits = np.round(np.expm1(x[:, 4])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(p), pa.array(hits), pa.array(p >= cut)], schema=_OUT)

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, probability double, hits long, toxic boolean")


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_documents(docs, fit(docs, labels))
