"""Toxicity by noisy-channel restoration of disguised words and a word model."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .bpe import pieces
from .common import as_bytes, stored

# What a disguised character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "#": "h", "*": "aeiou"}
#: Symbols of the character model: 0 is anything between words, 1-26 letters, 27 other letters.
SYMBOLS = 28

WORD = re.compile(r"[^\W\d_]+")
SIGN = re.compile(r"[0-9@$!|+(€£¡#*]")
REPEATED = re.compile(r"([^\W\d_])\1\1")
#: Single letters with a separator between them, in one token and over tokens.
SPACED = re.compile(r"(?<![^\W_])[^\W_](?:[.\-_*,/~'][^\W_]){2,}(?![^\W_])")
SPREAD = re.compile(r"(?<!\S)[^\W_](?:[ \t]+[^\W_]){2,}(?!\S)")
JUNK_ENDS = re.compile(r"^([^\w\s])\1+|([^\w\s])\2+$")
#: What parts the words of a token: neither letters nor signs of LEET.
PARTING = re.compile(r"[^\w@$!|+(€£¡#*]+|_+")
#: A word without runs, with a run of one sign before or after it.
EDGED = re.compile(r"(([0-9@$!|+(€£¡#*])\2*)?[.,;:]*((?:([^\W\d_])(?!\4\4))+)[.,;:]*(([0-9@$!|+(€£¡#*])\6*)?")
LOOK = str.maketrans({"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "​": "", "‌": "", "‍": "", "⁠": "", "­": "", "﻿": ""})


def symbol(ch: str) -> int:
    if "a" <= ch <= "z":
        return ord(ch) - 96
    return 27 if ch.isalpha() else 0


_OF_BYTE = np.array([b - 96 if 97 <= b <= 122 else 27 if b >= 128 else 0 for b in range(256)], np.int64)


def trigram_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of character trigrams of the lower-cased texts; the bytes of one other letter are one symbol."""
    raw = np.frombuffer(b"  ".join(texts).lower(), np.uint8)
    raw = raw[(raw & 0xC0) != 0x80]
    s = _OF_BYTE[raw]
    if len(s) < 3:
        return np.zeros(SYMBOLS**3, np.int64)
    return np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)


def count_characters(docs: DataFrame, text_col: str) -> np.ndarray:
    """Trigram counts over all documents: a vector from each task, added up 512 tasks at a time, then in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            raw = as_bytes(batch.column(0))
            for part in pieces(raw, 1_000_000):
                sums += trigram_counts(raw[part])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() // 512], pa.int64()), pa.array([sums.tobytes()], pa.binary())], ["part", "counts"])

    def add_up(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()], axis=0)
        return pa.table({"part": pa.array([table.column("part")[0].as_py() // 512], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})

    kind = "part bigint, counts binary"
    vectors = docs.select(F.col(f"`{text_col}`").cast("string").alias("text_")).mapInArrow(count, kind)
    for _ in range(2):
        vectors = vectors.groupBy("part").applyInArrow(add_up, kind)
    rows = vectors.collect()  # one vector for 512 ** 2 tasks
    return np.sum([np.frombuffer(r["counts"], np.int64) for r in rows], axis=0) if rows else np.zeros(SYMBOLS**3, np.int64)


class Restorer:
    """Viterbi decoding of a token's lattice under a trigram model of characters.

    The channel: a sign stands for a letter of LEET or for nothing, a run of it for one or
    two of the letter; a separator in a spaced word stands for nothing; a run of three or
    more of a letter stands for one or two of it. States are the last two symbols; the best
    few paths of each are kept. A run is one step; tokens of more than longest steps are
    decoded in windows that overlap by half.
    """

    def __init__(self, counts: np.ndarray, best: int = 5, longest: int = 32):
        c = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        pair, single = c.sum(axis=0), c.sum(axis=(0, 1))
        one = (single + 1) / (single.sum() + SYMBOLS)
        two = (pair + 8 * one) / (pair.sum(axis=1, keepdims=True) + 8)
        self.cost = -np.log((c + 8 * two[None]) / (c.sum(axis=2, keepdims=True) + 8))
        self.best, self.longest = best, longest

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        out: list[list[tuple[str, float]]] = []
        i = 0
        while i < len(token):
            ch, j = token[i], i
            while j < len(token) and token[j] == ch:
                j += 1
            run = j - i
            if ch.isalpha():
                out.append([(ch, 0.5), (ch * 2, 0.5)] if run >= 3 else [(ch * run, 0.0), (ch, 2.0)] if run == 2 else [(ch, 0.0)])
            else:
                options = [(x * n, 1.0) for x in LEET.get(ch, "") for n in range(1, 1 + min(run, 2))]
                inner = 0 < i and j < len(token)
                out.append(options + [("", (9.0 if inner else 5.0) if options else 0.5)])
            i = j
        return out

    def restore(self, token: str) -> list[str]:
        """The best readings of a token, letters only; of a word with signs at its ends, all readings of the ends."""
        if edged := EDGED.fullmatch(token):
            before, after = ([x * n for x in LEET[run[0]] for n in range(1, 1 + min(len(run), 2))] + [""] if run else [""] for run in edged.group(1, 5))
            return [x + edged.group(3) + y for x in before for y in after]
        steps, half = self.lattice(token), self.longest // 2
        if len(steps) <= self.longest:
            return self.decode(steps)
        windows = (steps[k : k + self.longest] for k in range(0, len(steps) - half, half))
        return [text for w in windows if any(len(options) > 1 for options in w) for text in self.decode(w)]

    def decode(self, steps: list[list[tuple[str, float]]]) -> list[str]:
        paths: dict[tuple[int, int], list[tuple[float, str]]] = {(0, 0): [(0.0, "")]}
        for options in steps:
            after: dict[tuple[int, int], list[tuple[float, str]]] = {}
            for (a, b), ways in paths.items():
                for letters, channel in options:
                    x, y, cost = a, b, channel
                    for ch in letters:
                        z = symbol(ch)
                        cost += self.cost[x, y, z]
                        x, y = y, z
                    after.setdefault((x, y), []).extend((c + cost, text + letters) for c, text in ways)
            paths = {state: sorted(ways)[: self.best] for state, ways in after.items()}
        ends = sorted((c + self.cost[a, b, 0], text) for (a, b), ways in paths.items() for c, text in ways)
        return [text for _, text in ends[: self.best] if text]


def plain(text: str) -> str:
    """Lower case, compatible forms, look-alike letters as Latin ones, invisible characters gone."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return text.lower().translate(LOOK)


def disguised(token: str) -> set[str]:
    """What of a plain token may be a disguised word: with and without runs of a sign at its ends, its parts, or without separators."""
    found = set()
    for whole in {JUNK_ENDS.sub("", token).strip(".,;:?\"'()[]{}"), token.strip(".,;:?\"')[]{}")}:
        found.update(x for x in (whole, *PARTING.split(whole)) if len(x) >= 3 and (SIGN.search(x) or REPEATED.search(x)))
        found |= spaced_out(m.group() for m in SPACED.finditer(whole))
    return found


def spaced_out(runs) -> set[str]:
    """Runs of single letters without separators; one or two letters before the word may be words of their own."""
    joined = {re.sub(r"[\W_]", "", run) for run in runs}
    return {t[k:] for t in joined for k in (0, 1, 2) if 3 <= len(t) - k}


def word_features(word: str) -> list[str]:
    """The word, and its beginnings, which stand for its inflected forms."""
    return [word + "$"] + [word[:n] for n in (4, 5, 6) if len(word) >= n]


@dataclass
class Model:
    """What scoring needs; its size is bounded by max_features and by the symbols."""

    weights: dict[str, float] = field(default_factory=dict)
    slope: tuple[float, ...] = (0.0,) * 5
    trigrams: np.ndarray = field(default_factory=lambda: np.zeros(SYMBOLS**3, np.int64))
    fitted: bool = False


def log_odds(a: float, b: float, p: float, n: float) -> float:
    return log((a + 0.1) / (p + 0.2)) - log((b + 0.1 * n / max(p, 1)) / (n + 0.2 * n / max(p, 1))) if p and n else 0.0


def summary(weights: list[float]) -> list[float]:
    """A document's view of its words' weights: the three greatest, and how many stand out."""
    top = sorted((w for w in weights if w > 0), reverse=True)
    return [1.0, *(top + [0.0] * 3)[:3], log(1 + sum(w > 2 for w in top))]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, turns: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.clip(np.linalg.solve(hess, x.T @ (y - p) - ridge * w), -5, 5)
    return w


class Scorer:
    """Scores texts by the distinct tokens in them; what a token gives is remembered, for keep tokens at most."""

    def __init__(self, model: Model, keep: int = 200_000):
        self.model = model
        self.restorer = Restorer(model.trigrams)
        self.known: dict[str, tuple[tuple[str, float], ...]] = {}
        self.keep = keep

    def token_words(self, token: str) -> set[str]:
        """Words of a lower-cased token and of its restored readings."""
        bare = token.rstrip(".,;:?")
        if bare.isascii() and bare.isalpha() and not REPEATED.search(bare):
            return {bare}
        token = plain(token)
        words = set(WORD.findall(token))
        for part in disguised(token):
            words.update(self.restorer.restore(part))
        return words

    @staticmethod
    def tokens(text: str) -> set[str]:
        text = text.lower()
        return set(text.split()) | spaced_out(m.group() for m in SPREAD.finditer(text))

    def all_words(self, text: str) -> set[str]:
        return set().union(*map(self.token_words, self.tokens(text)))

    def weight(self, word: str) -> float:
        return max((self.model.weights.get(f, 0.0) for f in word_features(word)), default=0.0)

    def weights(self, text: str) -> list[float]:
        """Weights of the distinct words that have one."""
        if len(self.known) > self.keep:
            self.known.clear()
        known, found = self.known, {}
        for token in self.tokens(text):
            got = known.get(token)
            if got is None:
                got = known[token] = tuple((w, x) for w in self.token_words(token) if (x := self.weight(w)) > 0)
            if got:
                found.update(got)
        return list(found.values())

    def score(self, text: str) -> float:
        if not self.model.fitted:
            return 0.0
        z = float(np.dot(self.model.slope, summary(self.weights(text))))
        return 1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))


def held_out(id_col: str):
    """The rows whose labels are never learned from; null ids are held out too."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(True))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 20_000, max_features: int = 20_000, least: int = 3
) -> Model:
    """Character counts over all documents; the word model on at most sample labelled rows that are not held out.

    The sample takes the least hashes of ids; rows with null labels or ids are no rows of
    it; of several texts of one id the last in order counts, of several labels the greatest. Features need to be in least toxic documents of the sample. Weights are smoothed
    log odds of a document holding the feature; the logistic model over a document's
    greatest weights is fitted on weights that leave the document itself out.
    """
    model = Model(trigrams=count_characters(docs, text_col))
    good = labels.select(F.col(f"`{id_col}`").alias("id_"), F.col(f"`{label_col}`").cast("int").alias("y_")).filter(F.col("id_").isNotNull() & F.col("y_").isNotNull() & ~held_out("id_"))
    chosen = good.groupBy("id_").agg(F.max("y_").alias("y_")).orderBy(F.xxhash64("id_"), "id_").limit(sample)
    own = docs.select(F.col(f"`{id_col}`").alias("id_"), F.col(f"`{text_col}`").cast("string").alias("text_"))
    # at most sample rows are broadcast; of rows of one id, one is learned from
    met = own.join(F.broadcast(stored(chosen, "sample")), "id_").groupBy("id_").agg(F.max("text_").alias("text_"), F.max("y_").alias("y_"))
    rows = stored(met.drop("id_"), "training")

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Scorer(model)
        for batch in batches:
            raw = as_bytes(batch.column(0))
            for part in pieces(raw, 250_000):  # features take many times the space of their texts
                features = [sorted({f for w in restorer.all_words(t.decode()) for f in word_features(w)}) for t in raw[part]]
                y = batch.column(1).slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([y, pa.array(features, pa.list_(pa.string()))], ["y", "features"])

    features = stored(rows.select("text_", "y_").mapInArrow(words_of, "y int, features array<string>"), "features")
    totals = {r["y"]: r["n"] for r in features.groupBy("y").agg(F.count("*").alias("n")).collect()}
    p, n = float(totals.get(1, 0)), float(sum(totals.values()) - totals.get(1, 0))
    if not p or not n:
        return model
    each = features.select("y", F.explode("features").alias("f"))
    toxic = each.filter("y = 1").groupBy("f").agg(F.count("*").alias("a")).filter(F.col("a") >= least)
    both = each.filter("y <> 1").join(toxic, "f", "right").groupBy("f").agg(F.max("a").alias("a"), F.count("y").alias("b"))
    odds = F.col("a") / p / ((F.col("b") + 0.1) / n)
    kept = both.filter(odds > 4).orderBy(F.desc(F.sqrt("a") * F.log(odds)), "f").limit(max_features).collect()  # bounded by max_features
    counts = {r["f"]: (r["a"], r["b"]) for r in kept}
    model.weights = {f: log_odds(a, b, p, n) for f, (a, b) in counts.items()}
    weights = model.weights

    def views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for y, fs in ((y.as_py(), fs.as_py()) for y, fs in zip(batch.column(0), batch.column(1))):
                left_out = []
                for f in fs:
                    if f in weights:
                        a, b = counts[f]
                        a, b = (a - 1, b) if y == 1 else (a, b - 1)
                        left_out.append((f, log_odds(a, b, p - (y == 1), n - (y != 1)) if a >= least - 1 else 0.0))
                out.append(summary(_by_word(left_out)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], ["y", "view"])

    seen = features.mapInArrow(views, "y int, view array<double>").collect()  # at most sample rows of five numbers: one an id
    x = np.array([r["view"] for r in seen])
    y = np.array([r["y"] == 1 for r in seen], float)
    model.slope = tuple(fit_logistic(x, y).tolist())
    model.fitted = True
    return model


def _by_word(weights: list[tuple[str, float]]) -> list[float]:
    """One weight for each word: beginnings of one another (a$, a, ab, abc) count once, at the greatest."""
    out: dict[str, float] = {}
    for f, w in weights:
        key = f[:4]
        out[key] = max(out.get(key, 0.0), w)
    return list(out.values())


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """A row per input row: id, held_out, score, predicted (1 at threshold or above).

    Every whole text is read. Null and empty texts have no words and get the model's score
    for that; without a model (no labels of both kinds) all scores are 0. Null ids and
    repeated rows pass through. Other columns are ignored. No shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            raw = as_bytes(batch.column(2))
            for part in pieces(raw):
                score = np.array([scorer.score(t.decode()) for t in raw[part]])
                cut = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([cut.column(0), cut.column(1), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    wanted = docs.select(id_col, held_out(id_col).alias("held_"), F.col(f"`{text_col}`").cast("string").alias("text_"))
    return wanted.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def reject(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, that score below threshold.

    Null and empty texts have no words and stay unless the model scores that so; null ids
    and repeated rows are scored like others. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t.decode()) < threshold for t in as_bytes(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
