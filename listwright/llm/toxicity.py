"""Toxicity by a weighted lexicon (operator 8).

Texts are folded: lower case, look-alike letters of other scripts become the Latin
letters, and so do digits and signs that stand for letters, where a letter follows
them in the word; everything else becomes a blank.
One Aho-Corasick automaton then finds all terms of the lexicon in one pass over
the whole text. A term is a word, or the beginning of words; a word counts once,
by its heaviest term, and not at all inside an exception phrase. The sum of
weights, alone and by length, goes through a logistic curve.

Terms and weights are learned: the seeds below and every beginning of a word
are counted in at most ``TRAIN_ROWS`` training documents of either label, and
those that mark toxic documents beyond chance are kept, ``TERMS`` at most. A seed
always stays: what few documents say of it is mixed with a prior weight.
Phrases around a term that occur in clean training documents only become
exceptions, beside the given ones.

Defined cases: a null or empty text has no term and gets the score of no term;
without labels of both kinds the seeds have weight 1 and a fixed curve; rows
that share a doc_id are scored one by one; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm.common import materialize, query, table
from listwright.llm.labelled import held_out, labelled_sample

TRAIN_ROWS = 4000  # labelled rows of either label that the lexicon is learned from, at most
TERMS = 5000  # size of the lexicon, at most
THRESHOLD = 0.5
BEGINNINGS = range(4, 9)
SURE = 5.5  # standard errors between the rates of toxic and clean documents
PRIOR, PRIOR_DOCS, LEAST_SEED = 2.0, 3, 0.2  # weight of a seed without documents, how many it stands for, and what a seed has at least
PRECISION = 0.7
FEWEST = 3

SEEDS = (
    "idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown",
    "dumb", "imbecile", "jerk", "vermin", "garbage", "filth", "bastard", "bitch", "asshole", "fuck", "shit", "hate you",
    "shut up", "kill yourself",
)
EXCEPTIONS = (
    "trash can", "trash bin", "clown fish", "circus clown", "idiot proof", "garbage collection", "garbage collector",
    "garbage can", "sore loser", "dumb bell", "dumb terminal",
)

LOOKALIKES = {
    "a": "аαàáâãäåāą", "b": "вЬ", "c": "сçćč", "d": "ԁ", "e": "еєεèéêëēę", "g": "ɡ", "h": "һ", "i": "іιìíîïīı",
    "j": "ј", "k": "кκ", "l": "ӏł", "m": "м", "n": "пñń", "o": "оοòóôõöøō", "p": "рρ", "s": "ѕśš", "t": "тτ",
    "u": "υùúûüū", "v": "ν", "w": "ԝω", "x": "хχ", "y": "уγýÿ", "z": "żźž",
}


# Digits and signs that stand for letters inside words.
SIGNS = {"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "5": "s", "$": "s", "7": "t"}


def fold_table() -> dict[int, str]:
    """Every sign that is no letter and stands for none becomes a blank; look-alikes become letters."""
    out = {k: " " for k in range(0x250) if not chr(k).isalpha() and chr(k) not in SIGNS}
    out |= {k: " " for k in [*range(0x2000, 0x2070), 0x3000]}
    out |= {k: chr(k + 32) for k in range(65, 91)}
    for letter, signs in LOOKALIKES.items():
        out |= {ord(x): letter for x in signs} | {ord(x.upper()): letter for x in signs if len(x.upper()) == 1}
    return out


FOLD = fold_table()
IN_WORD = re.compile("[{0}]+(?=[^ {0}])".format(re.escape("".join(SIGNS))))
AS_LETTERS = {ord(x): y for x, y in SIGNS.items()}
AS_BLANKS = {ord(x): " " for x in SIGNS}


def fold(text: str) -> str:
    """The text in Latin small letters and blanks. A sign stands for a letter where one follows, so "sh!t" has one and "shut up!" none."""
    plain = text.translate(FOLD)
    plain = IN_WORD.sub(lambda m: m.group().translate(AS_LETTERS), plain)
    return f" {plain.translate(AS_BLANKS)} "


@dataclass
class ToxicityModel:
    """Terms begin with a blank; one that ends with a blank is a whole word or phrase."""

    weights: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    curve: tuple[float, float, float] = (-4.0, 2.0, 1.0)
    automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "automaton": None}

    def matcher(self):
        if self.automaton is None and (self.weights or self.exceptions):
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for term in sorted({*self.weights, *self.exceptions}):
                self.automaton.add_word(term, (len(term), self.weights.get(term, 0.0), term in self.exceptions))
            self.automaton.make_automaton()
        return self.automaton

    def found(self, folded: str) -> dict[int, tuple[float, int]]:
        """Weight and end of the heaviest term at the start of each word, without those in exceptions."""
        best: dict[int, tuple[float, int]] = {}
        spared: list[tuple[int, int]] = []
        matcher = self.matcher()
        if matcher is None:
            return best
        for end, (size, weight, exception) in matcher.iter(folded):
            start = end + 1 - size
            if exception:
                spared.append((start, end))
            if weight and weight > best.get(start, (0.0, 0))[0]:
                best[start] = (weight, end)
        if spared:
            # For each start the farthest end of the exceptions that begin there or before.
            spared.sort()
            starts = [a for a, _ in spared]
            ends = list(accumulate((b for _, b in spared), max))
            best = {s: (w, e) for s, (w, e) in best.items() if not (k := bisect_right(starts, s)) or e > ends[k - 1] + 1}
        return best

    def features(self, texts: list[str]) -> np.ndarray:
        """Log of the weights' sum, alone and by a hundred words."""
        out = np.zeros((len(texts), 2))
        for k, text in enumerate(texts):
            folded = fold(text)
            total = sum(w for w, _ in self.found(folded).values())
            if total:
                out[k] = np.log1p(total), np.log1p(100 * total / max(1, len(folded.split())))
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        x = self.features(texts)
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + x @ np.array(self.curve[1:]), -30, 30)))


def term_sets(folded: str) -> set[str]:
    """Words and beginnings of words of a text."""
    words = set(folded.split())
    out = {f" {x} " for x in words if len(x) > 2}
    for n in BEGINNINGS:
        out |= {f" {x[:n]}" for x in words if len(x) >= n}
    return out


def least_shingle(text: str) -> int:
    """A number that copies, near ones too, mostly share."""
    words = text.lower().split()
    return min((crc32(" ".join(words[k : k + 3]).encode("utf-8", "replace")) for k in range(max(1, len(words) - 2))), default=0)


def fit_curve(x: np.ndarray, y: np.ndarray, penalty: float = 0.05, steps: int = 50) -> tuple[float, float, float]:
    """Logistic regression by Newton's method."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (y - p) - penalty * w
        bend = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + penalty * np.eye(3)
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS, seeds: tuple[str, ...] = SEEDS,
    exceptions: tuple[str, ...] = EXCEPTIONS,
) -> ToxicityModel:
    """Learn lexicon, exceptions and curve from at most ``rows`` labelled training rows of either label."""
    given = frozenset(fold(x) for x in exceptions)
    seed_terms = {fold(x).rstrip() if " " not in x else fold(x) for x in seeds}

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(sign=[least_shingle(x) for x in batch["text"]])

    sample = labelled_sample(docs, labels, label, rows, each=True).mapInPandas(sign, "doc_id long, text string, label int, sign long")
    # A copied document would count its words as often as it has copies.
    sample = sample.groupBy("label", "sign").agg(F.min_by("text", F.struct("doc_id", F.xxhash64("text"))).alias("text"))
    sample = materialize(sample, "toxic-sample")
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    plain = ToxicityModel(dict.fromkeys(seed_terms, 1.0), given)
    if not toxic or not clean:
        return plain

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 200):
                part, seen = batch.iloc[a : a + 200], {0: Counter(), 1: Counter()}
                for text, y in zip(part["text"], part["label"], strict=True):
                    folded = fold(text)
                    seen[y].update(term_sets(folded) | {x for x in seed_terms if x in folded})
                words = list(seen[0].keys() | seen[1].keys())
                yield pd.DataFrame({"term": words, "a": [seen[1][x] for x in words], "b": [seen[0][x] for x in words]})

    counts = sample.mapInPandas(count, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    rate_a, rate_b = F.col("a") / toxic, F.col("b") / clean
    both = (F.col("a") + F.col("b")) / (toxic + clean)
    error = F.sqrt(both * (1 - both) * (1 / toxic + 1 / clean) + F.lit(1e-12))
    counts = counts.withColumn("sure", (rate_a - rate_b) / error).withColumn("precise", rate_a / (rate_a + rate_b))
    counts = materialize(counts, "toxic-terms")
    kept = counts.where((F.col("a") >= FEWEST) & (F.col("precise") >= PRECISION) & (F.col("sure") >= SURE) & ~F.col("term").isin(*seed_terms))
    kept = kept.orderBy(F.desc("sure"), "term").limit(TERMS).collect()

    def weight(a: int, b: int) -> float:
        return float(np.log((a + 0.5) / (toxic + 1) / ((b + 0.5) / (clean + 1))))

    weights = {r["term"]: weight(r["a"], r["b"]) for r in kept}
    of_seeds = {r["term"]: (r["a"], r["b"]) for r in counts.where(F.col("term").isin(*seed_terms)).collect()}
    for x in sorted(seed_terms):
        a, b = of_seeds.get(x, (0, 0))
        weights[x] = max(LEAST_SEED, (weight(a, b) * (a + b) + PRIOR * PRIOR_DOCS) / (a + b + PRIOR_DOCS))
    seen = seed_terms
    # A beginning stands for all longer terms that say no more than it does.
    weights = {
        x: w for x, w in weights.items()
        if x in seen or not any(weights.get(x[:n], -9.0) >= w - 0.5 for n in range(4, len(x.rstrip())))
    }
    model = ToxicityModel(weights, given)

    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter = Counter()
            for text, y in zip(batch["text"], batch["label"], strict=True):
                folded = re.sub(" +", " ", fold(text))
                phrases = set()
                for start, (_, end) in model.found(folded).items():
                    stop = folded.find(" ", end if folded[end] == " " else end + 1)
                    before, after = folded.rfind(" ", 0, max(0, start)), folded.find(" ", stop + 1)
                    if before >= 0:
                        phrases.add(folded[before : stop + 1])
                    if after > 0:
                        phrases.add(folded[start : after + 1])
                seen.update((x, y) for x in phrases)
            if seen:
                yield pd.DataFrame({"phrase": [x for x, _ in seen], "y": [y for _, y in seen], "n": list(seen.values())})

    phrases = sample.mapInPandas(around, "phrase string, y int, n long").groupBy("phrase").agg(
        F.sum(F.col("n") * F.col("y")).alias("a"), F.sum(F.col("n") * (1 - F.col("y"))).alias("b"),
    )
    learned = phrases.where("a = 0 AND b >= 3").orderBy(F.desc("b"), "phrase").limit(TERMS).collect()
    model = ToxicityModel(weights, given | {r["phrase"] for r in learned})

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = model.features(batch["text"].tolist())
            yield pd.DataFrame({"x": x[:, 0], "z": x[:, 1], "label": batch["label"].to_numpy()})

    found = sample.mapInPandas(measure, "x double, z double, label int").toPandas().sort_values(["x", "z", "label"])
    model.curve = fit_curve(found[["x", "z"]].to_numpy(), found["label"].to_numpy(float))
    return model


def toxicity_score(model: ToxicityModel, text: str = "text") -> Column:
    """The score of a text column, 0 to 1."""
    shared = model

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.score(texts.tolist()))

    return score(F.coalesce(F.col(text).cast("string"), F.lit("")))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out().alias("held_out"), toxicity_score(model).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
