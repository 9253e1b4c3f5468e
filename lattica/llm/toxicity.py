"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

# Insults that count as toxic in any corpus.
INSULTS = frozenset(
    """idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass trash garbage scum scumbag loser losers
    worthless pathetic disgusting clown clowns retard retarded imbecile bastard bitch asshole shit shitty fuck fucking
    fucker jerk freak filth filthy vermin hate kill dummkopf arschloch scheisse dreck abschaum versager wertlos widerlich
    imbécile crétin connard salaud merde ordure minable dégoûtant idiota imbécil estúpido basura escoria perdedor
    patético asqueroso mierda cabrón""".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine tu te toi ton ta tes vous votre tú ti usted vosotros".split())
#: Words on either side within which a second-person word counts as near an insult.
REACH = 4
#: Labelled rows that a model is fitted on at most, taken in order of a hash of the id.
MAX_TRAIN_ROWS = 20_000
#: Stems have these lengths; a learned lexicon holds at most so many.
STEM_SIZES, MAX_STEMS = (4, 5, 6, 7, 8), 2_000
LEET = str.maketrans("013457@$!", "oieastasi")

_WORDS = re.compile(r"[^\W\d_]+")
#: A letter, digits or signs, a letter; or single letters with signs between.
_ODD = re.compile(r"[^\W\d_][\d@$!*]+[^\W\d_]|[^\W\d_](?:[.\-*_][^\W\d_]){3,}")
#: What every match of _ODD holds, quicker to look for.
_MAYBE_ODD = re.compile(r"[\d@$!*]|[.\-*_]\w[.\-*_]")
_TOKEN = re.compile(r"[\w@$!*.\-]+")
_REPEATED = re.compile(r"(\w)\1{2,}")
_MARKS = re.compile(r"[^\w\s]+")
_CAPS = re.compile(r"\b[^\W\d_a-zß-öø-ÿ]{3,}\b")

#: Features in order; those at STEMS depend on the learned lexicon.
FEATURES = ("insults", "insult_share", "obfuscated_insults", "stems", "stem_share", "near_second_person", "second_person", "capitals", "capital_words", "exclaims", "exclaim_runs", "marks", "obfuscated", "repeated_letters", "log_words", "word_length")
STEMS = slice(3, 5)


class Lexicon:
    """Stems, and their first letters, by which most words are passed over."""

    def __init__(self, stems: frozenset[str]):
        self.stems, self.heads = stems, frozenset(s[: STEM_SIZES[0]] for s in stems)

    def hits(self, words: Iterable[str]) -> list[str]:
        size, heads, stems = STEM_SIZES[0], self.heads, self.stems
        return [w for w in words if w[:size] in heads and any(w[:k] in stems for k in STEM_SIZES if k <= len(w))]


def stem_features(counts: Counter, n: int, lexicon: Lexicon) -> list[float]:
    hits = sum(counts[w] for w in lexicon.hits(counts))
    return [float(hits), hits / n if n else 0.0]


def word_counts(text: str | None) -> Counter:
    return Counter(_WORDS.findall((text or "").lower()))


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """Dense features of one whole text; null and empty texts give zeros."""
    text = text or ""
    lower = text.lower()
    words = _WORDS.findall(lower)
    n = len(words)
    if not n:
        return [0.0] * 11 + [float(_MARKS.search(text) is not None)] + [0.0] * 4
    counts = Counter(words)
    insults = sum(counts[w] for w in INSULTS & counts.keys())
    near = 0
    if insults:
        for i, w in enumerate(words):
            if w in INSULTS and not SECOND_PERSON.isdisjoint(words[max(0, i - REACH) : i + REACH + 1]):
                near += 1
    odd = len(_ODD.findall(text)) if _MAYBE_ODD.search(text) else 0
    hidden = sum(1 for w in _TOKEN.findall(lower) if _ODD.search(w) and re.sub(r"[\W_]", "", w.translate(LEET)) in INSULTS) if odd else 0
    exclaims = text.count("!") + text.count("?")
    letters = max(1, sum(map(len, words)))
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    capitals = int(((code - 65 < 26) | (code - 192 < 31) & (code != 215)).sum())
    low = code if lower == text else np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)
    same = low[1:] == low[:-1]
    repeated = len(_REPEATED.findall(lower)) if (same[1:] & same[:-1]).any() else 0
    return [
        float(insults), insults / n, float(hidden), *stem_features(counts, n, lexicon), near / n,
        sum(counts[w] for w in SECOND_PERSON & counts.keys()) / n, capitals / letters, len(_CAPS.findall(text)) / n if capitals > 2 or not text.isascii() else 0.0,
        exclaims / n, (text.count("!!") + text.count("??")) / n, sum(map(len, _MARKS.findall(text))) / n, odd / n, repeated / n,
        float(np.log1p(n)), letters / n]


@dataclass
class Trees:
    """Complete binary trees of one depth: split features, thresholds (go right if above) and leaf values, by tree."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, depth, rows = np.full(len(x), self.base), int(np.log2(self.leaf.shape[1])), np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - (len(v) - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, ridge: float = 2.0, least: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss over quantile histograms; deterministic."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(m)]
    code = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)  # > edge goes right
    rate_1 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate_1 / (1 - rate_1)))
    margin = np.full(n, base)
    inner, offset = 2**depth - 1, np.arange(m) * bins
    features_, cuts, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        f, c, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            slot = ((node - first)[:, None] * (m * bins) + offset + code).ravel()
            g = np.bincount(slot, np.repeat(grad, m), width * m * bins).reshape(width, m, bins).cumsum(2)
            h = np.bincount(slot, np.repeat(hess, m), width * m * bins).reshape(width, m, bins).cumsum(2)
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
            gain[(h < least) | (ht - h < least)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                column, b = divmod(int(best[k]), bins)
                if gain[k].ravel()[best[k]] > 1e-9 and b < len(edges[column]):
                    f[first + k], c[first + k] = column, edges[column][b]
            node = 2 * node + 1 + (x[np.arange(n), f[node]] > c[node])
        at = node - inner
        value = rate * np.bincount(at, grad, inner + 1) / (np.bincount(at, hess, inner + 1) + ridge)
        margin += value[at]
        features_.append(f)
        cuts.append(c)
        leaves.append(value)
    return Trees(np.array(features_), np.array(cuts), np.array(leaves), base)


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: margins and the calibrated probabilities there, both growing."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, first margin, last margin
    for mark, label in zip(margin[order], y[order]):
        if blocks and blocks[-1][3] == mark:
            blocks[-1][0] += label
            blocks[-1][1] += 1
        else:
            blocks.append([float(label), 1.0, mark, mark])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w, _, last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w
            blocks[-1][3] = last
    at = [v for b in blocks for v in ((b[2],) if b[2] == b[3] else (b[2], b[3]))]
    # one pseudo-document of the mean rate keeps scores off 0 and 1
    mean = float(y.mean())
    value = [v for b in blocks for v in [(b[0] + mean) / (b[1] + 1)] * (1 if b[2] == b[3] else 2)]
    return np.array(at), np.maximum.accumulate(value)


@dataclass
class Model:
    """A fitted scorer: a few hundred KB, so it travels in the closure."""

    stems: frozenset[str]
    trees: Trees
    at: np.ndarray
    value: np.ndarray

    def score(self, texts: list[str | None], lexicon: Lexicon) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        margin = self.trees.margin(np.array([features(t, lexicon) for t in texts]))
        # a sliver of the margin itself keeps the order of documents that calibration ties
        return np.clip(np.interp(margin, self.at, self.value) * 0.999 + 0.001 / (1 + np.exp(-margin)), 0.0, 1.0)


def _stem_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (text, toxic, fold): in how many texts of each class and fold a stem is."""
    held: Counter = Counter()

    def flush() -> pd.DataFrame:
        out = pd.DataFrame([(s, k, c if t else 0, 0 if t else c) for (s, t, k), c in held.items()], columns=["stem", "fold", "pos", "neg"])
        held.clear()
        return out

    for batch in batches:
        for text, toxic, fold in zip(batch["text"], batch["toxic"], batch["fold"]):
            held.update((s, toxic, fold) for s in {w[:k] for w in word_counts(text) for k in STEM_SIZES if k <= len(w)})
            if len(held) > 200_000:
                yield flush()
    if held:
        yield flush()


def _xlogy(x, y):
    return F.when(x > 0, x * F.log(y)).otherwise(F.lit(0.0))


def choose_stems(counted: DataFrame, total: dict[int, tuple[float, float]], leave_out: int | None, least_evidence: float) -> frozenset[str]:
    """The lexicon of all folds but one. ``counted``: stem, fold, pos, neg; ``total``: (toxic, other) texts by fold."""
    n1, n0 = (sum(t[k] for fold, t in total.items() if fold != leave_out) for k in (0, 1))
    if not n1 or not n0:
        return frozenset()
    kept = counted if leave_out is None else counted.filter(F.col("fold") != leave_out)
    sums = kept.groupBy("stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    a, b = F.col("pos").cast("double"), F.col("neg").cast("double")
    both = a + b
    evidence = 2 * (_xlogy(a, a / (both * n1 / (n1 + n0))) + _xlogy(b, b / (both * n0 / (n1 + n0))))
    chosen = sums.filter((a / n1 > 4 * b / n0) & (F.col("pos") >= 4)).withColumn("g", evidence).filter(F.col("g") >= least_evidence)
    return frozenset(r["stem"] for r in chosen.orderBy(F.desc("g"), "stem").limit(MAX_STEMS).collect())


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", folds: int = 3, least_evidence: float = 28.0) -> Model:
    """Fits on labelled rows, ``max_rows`` at most (the first by a hash of the id), whose ids ``labels`` gives.

    A lexicon of stems is learned from them beside the fixed one: stems much more frequent among toxic texts, by a
    likelihood-ratio statistic of at least ``least_evidence``, counted on the executors. Trees are fitted on the driver
    on one row of numbers per text. Out-of-fold margins calibrate them: trees and lexicon of a fold's model have seen no
    text of that fold. Null ids and labels are left out; without both classes the score is the rate of the one (0 with
    no label).
    """
    rows = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("toxic"))
    sample = rows.orderBy(F.xxhash64("id"), "id", "toxic").limit(max_rows)  # bounded: 16 bytes a row
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # a fold by text, so that copies are in one
    train = texts.join(F.broadcast(sample), "id").select("id", "text", "toxic", F.pmod(F.xxhash64("text"), F.lit(folds)).cast("int").alias("fold"))
    train = materialise(train.repartition(24, "id"), "toxic-train")
    total = {r["fold"]: (float(r["p"]), float(r["n"] - r["p"])) for r in train.groupBy("fold").agg(F.count("*").alias("n"), F.sum("toxic").alias("p")).collect()}
    n1, n0 = (sum(t[k] for t in total.values()) for k in (0, 1))
    if not n1 or not n0:
        return Model(frozenset(), Trees(np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 2)), 0.0), np.array([0.0]), np.array([n1 / (n1 + n0) if n1 + n0 else 0.0]))
    counts = train.select("text", "toxic", "fold").mapInPandas(_stem_counts, "stem string, fold int, pos long, neg long")
    counted = materialise(counts.groupBy("stem", "fold").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "toxic-stems")
    stems = choose_stems(counted, total, None, least_evidence)
    without = {k: choose_stems(counted, total, k, least_evidence) for k in range(folds)}

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, parts = Lexicon(stems), {k: Lexicon(s) for k, s in without.items()}
        for batch in batches:
            made = []
            for text in batch["text"]:
                seen = word_counts(text)
                made.append(features(text, lexicon) + [x for k in range(folds) for x in stem_features(seen, seen.total(), parts[k])])
            yield pd.DataFrame({"id": batch["id"], "toxic": batch["toxic"], "fold": batch["fold"], "x": made})

    kind = train.schema["id"].dataType.simpleString()
    table = train.mapInPandas(rows_of, f"id {kind}, toxic int, fold int, x array<double>").toPandas().sort_values(["id", "toxic"], kind="stable")
    wide, y, fold = np.array(table["x"].tolist()), table["toxic"].to_numpy(float), table["fold"].to_numpy()
    x, margin = wide[:, : len(FEATURES)], np.zeros(len(y))
    for k in range(folds):
        own = fold == k
        if own.any() and not own.all():
            mine = x.copy()
            mine[:, STEMS] = wide[:, len(FEATURES) + 2 * k : len(FEATURES) + 2 * k + 2]
            margin[own] = fit_trees(mine[~own], y[~own]).margin(mine[own])
    return Model(stems, fit_trees(x, y), *isotonic(margin, y))


def score(docs: DataFrame, model: Model, text_col: str = "text"):
    """The score column of ``docs``' texts: 0 to 1, higher is likelier toxic; null counts as empty."""

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(model.stems)
        for texts in batches:
            yield pd.Series(model.score(texts.tolist(), lexicon), index=texts.index)

    return toxicity(docs[text_col].cast("string"))


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id as text is divisible by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def score_documents(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """One row per input row: id, held_out, score, predicted. Fitted on labels of ids that are not held out.

    Only the text enters a score. Null and empty texts get the score of a text without any word. Repeated rows are each
    scored; extra columns are ignored; empty tables give an empty result (no label: all scores near 0).
    """
    model = fit(docs, labels.filter(~held_out(id_col)), text_col=text_col, id_col=id_col, label_col=label_col)
    scored = docs.select(F.col(id_col), score(docs, model, text_col).alias("score"))
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
