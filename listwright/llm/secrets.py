"""Secrets: fixed rules, and a character network for what the rules miss (operator 10).

The rules (``assign``, ``access``, ``hex``) give the base findings. A candidate
is any run of ``SHORTEST`` or more characters of keys that isn't written like a
word: it has a digit, a capital behind a small letter, one of ``+/_=``, or
``CONSONANTS`` consonants in a row. The network reads the whole candidate and
``AROUND`` characters on either side: a
convolution over characters (inside and outside the candidate are told apart),
the largest answer of each filter, a logistic output. It is trained on all
labelled findings, each different one once: candidates that overlap a base
finding are secrets, those in which kinds of characters change places at
most ``PLAIN_CHANGES`` times (numbers, dates, words of any kind, names of code) are
not, and the rest has no label and is only judged. So that the key itself counts
and not the rules' words, half of the secrets are learned with the words around
taken from other places, and as many random keys of other alphabets
(``ALPHABETS``) are learned in such places. Scores are calibrated on findings that
were kept back, and the threshold is the highest that still finds ``RECALL`` of
the secrets among them. Findings are dealt into shares of about ``SHARE_ROWS`` by
their hash. One share is learned in one task; more are learned by up to ``TASKS``
tasks, each share by share from the same network, whose results are averaged after
each of ``PASSES`` passes. Curve and threshold come from sums and ranks over all
findings kept back. Candidates above it that no base finding touches are added
as kind ``network``; base findings always stay.

Texts are read once. What is found goes to the shared folder, one row for each
document, and the network works on that.

Defined cases: a null or empty text has no finding; rows that share a doc_id are
scanned one by one; without labelled findings of both kinds no span is added;
an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
import string
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm.common import materialize, query, table

# The base rules.
ASSIGN = re.compile(
    r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "network")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

SHORTEST = 8
CONSONANTS = 5
AROUND = 24
SHARE_ROWS = 8192  # labelled findings that a task learns at a time
TASKS = 32  # networks that are averaged, at most
PASSES, ROUNDS = 4, 2  # over all shares, and over each share in a pass
PLAIN_CHANGES = 2
RECALL = 0.98
FILTERS, WIDTH = 24, 5
ALPHABETS = (  # of the random keys that are learned
    string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits,
    string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-", string.ascii_letters,
)
CHARS = 98  # printable ASCII, other white space, everything else
PIECE_CHARS = 1_000_000

KEY_CHARS = np.zeros(128, bool)
KEY_CHARS[[ord(x) for x in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
CONSONANT = np.zeros(128, bool)
CONSONANT[[ord(x) for x in "bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ"]] = True
HEX_CHARS = np.zeros(128, bool)
HEX_CHARS[[ord(x) for x in "0123456789abcdef"]] = True


def runs(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that are long enough."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    keep = ends - starts >= least
    return starts[keep], ends[keep]


def keyed(text: str) -> list[tuple[int, int, str]]:
    """Base findings that need a regular expression."""
    out, lower = [], text.lower()
    if any(x in lower for x in WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out


def scan(texts: list[str]) -> list[tuple[list[tuple[int, int, str]], list[tuple[int, int]]]]:
    """Base findings and candidates of every text, places in code points."""
    out = []
    for a, b in pieces(texts):
        part = texts[a:b]
        code = np.frombuffer("\n".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
        low = np.minimum(code, 127)
        ascii_only = code < 127
        first = np.cumsum([0] + [len(x) + 1 for x in part])
        hexes = runs(HEX_CHARS[low] & ascii_only, 32)
        starts, ends = runs(KEY_CHARS[low] & ascii_only, SHORTEST)
        if len(starts):
            small, capital = (code >= 97) & (code <= 122), (code >= 65) & (code <= 90)
            sign = ((code >= 48) & (code <= 57)) | np.isin(code, [43, 47, 61, 95])
            sign[1:] |= capital[1:] & small[:-1]
            sign[runs(CONSONANT[low] & ascii_only, CONSONANTS)[0]] = True
            sign = np.concatenate([[0], np.cumsum(sign)])
            # A capital at the start stands behind no letter of its own run.
            some = sign[ends] > sign[starts + ((starts > 0) & capital[starts] & small[np.maximum(starts - 1, 0)])]
            starts, ends = starts[some], ends[some]
        owner_hex, owner = np.searchsorted(first, hexes[0], "right") - 1, np.searchsorted(first, starts, "right") - 1
        base = [keyed(x) for x in part]
        for k, s, e in zip(owner_hex.tolist(), hexes[0].tolist(), hexes[1].tolist(), strict=True):
            base[k].append((s - int(first[k]), e - int(first[k]), "hex"))
        found: list[list[tuple[int, int]]] = [[] for _ in part]
        for k, s, e in zip(owner.tolist(), starts.tolist(), ends.tolist(), strict=True):
            found[k].append((s - int(first[k]), e - int(first[k])))
        out += [(sorted(x, key=lambda f: (f[0], KINDS.index(f[2]))), y) for x, y in zip(base, found, strict=True)]
    return out


CHANGES = re.compile(r"[A-Za-z][+/_=-]*(?=[0-9])|[0-9][+/_=-]*(?=[A-Za-z])|[a-z][+/_=-]*(?=[A-Z])")


def plain(candidate: str) -> bool:
    """Whether small letters, capitals and digits change places too seldom for a key."""
    return len(CHANGES.findall(candidate)) <= PLAIN_CHANGES


def random_key(rng: np.random.Generator) -> str:
    letters = ALPHABETS[rng.integers(len(ALPHABETS))]
    return "".join(letters[k] for k in rng.integers(len(letters), size=rng.integers(12, 44)))


def pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    a, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= PIECE_CHARS or k + 1 == len(texts):
            yield a, k + 1
            a, size = k + 1, 0


def find_candidates(docs: DataFrame) -> DataFrame:
    """A row for each document: ``doc_id``, the base findings, and the candidates with what stands around them."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            rows = []
            for text, (base, candidates) in zip(texts, scan(texts), strict=True):
                # Base findings of one kind don't overlap, but kinds may: the end that reaches farthest so far decides.
                begin, reach = [s for s, _, _ in base], np.maximum.accumulate([e for _, e, _ in base]).tolist() if base else []
                touched = [(k := bisect_left(begin, e)) > 0 and reach[k - 1] > s for s, e in candidates]
                labels = [1 if t else 0 if plain(text[s:e]) else -1 for t, (s, e) in zip(touched, candidates, strict=True)]
                rows.append((
                    [s for s, _, _ in base], [e for _, e, _ in base], [x for _, _, x in base],
                    [s for s, _ in candidates], [e for _, e in candidates],
                    [text[max(0, s - AROUND) : s] for s, _ in candidates], [text[s:e] for s, e in candidates],
                    [text[e : e + AROUND] for _, e in candidates], labels,
                ))
            out = pd.DataFrame(rows, columns=["starts", "ends", "kinds", "from", "to", "before", "inside", "after", "labels"])
            out.insert(0, "known", batch["known"].to_numpy())
            out.insert(1, "doc_id", batch["doc_id"].to_numpy())
            yield out

    rows = docs.select(
        F.col("doc_id").isNotNull().alias("known"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.mapInPandas(
        find,
        "known boolean, doc_id long, starts array<long>, ends array<long>, kinds array<string>, `from` array<long>, `to` array<long>, "
        "before array<string>, inside array<string>, after array<string>, labels array<int>",
    )


def char_class(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where((code >= 32) & (code < 127), code - 32, np.where((code >= 9) & (code <= 13), 95, 96)).astype(np.int64)


def window(before: str, inside: str, after: str) -> np.ndarray:
    """Classes of the characters around and, from ``CHARS`` on, inside; the ends are filled up by the filter's width."""
    fill = np.full(WIDTH - 1, 97)
    return np.concatenate([fill, char_class(before), char_class(inside) + CHARS, char_class(after), fill])


@dataclass
class SecretNetwork:
    filters: np.ndarray  # width x 2 CHARS x filters
    bias: np.ndarray
    out: np.ndarray
    shift: float
    curve: tuple[float, float] = (0.0, 1.0)
    threshold: float = 1.0
    learned: int = 0  # findings, random keys included
    kept: int = 0

    def vector(self) -> np.ndarray:
        return np.concatenate([self.filters.ravel(), self.bias, self.out, [self.shift]])

    @staticmethod
    def of(vector: np.ndarray) -> SecretNetwork:
        filters, bias, out, shift = np.split(vector.copy(), np.cumsum([WIDTH * 2 * CHARS * FILTERS, FILTERS, FILTERS]))
        return SecretNetwork(filters.reshape(WIDTH, 2 * CHARS, FILTERS), bias, out, float(shift[0]))

    def hidden(self, windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The largest answer of each filter in each window, where it is, and all classes in one row."""
        flat = np.concatenate(windows)
        lengths = np.array([len(x) for x in windows])
        n = len(flat) - WIDTH + 1
        answer = self.bias + sum(self.filters[k][flat[k : k + n]] for k in range(WIDTH))
        starts = np.cumsum(lengths) - lengths
        best, where = np.zeros((len(windows), len(self.bias))), np.zeros((len(windows), len(self.bias)), np.int64)
        for k, (a, m) in enumerate(zip(starts, lengths, strict=True)):
            part = answer[a : a + m - WIDTH + 1]
            at = part.argmax(axis=0)
            where[k], best[k] = at + a, part[at, np.arange(part.shape[1])]
        return np.maximum(best, 0), where, flat

    def raw(self, windows: list[np.ndarray]) -> np.ndarray:
        if not windows:
            return np.zeros(0)
        return np.concatenate([self.hidden(windows[a : a + 256])[0] @ self.out + self.shift for a in range(0, len(windows), 256)])

    def score(self, windows: list[np.ndarray]) -> np.ndarray:
        return sigmoid(self.curve[0] + self.curve[1] * self.raw(windows))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fresh(rng: np.random.Generator) -> SecretNetwork:
    return SecretNetwork(rng.normal(0, 0.1, (WIDTH, 2 * CHARS, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, FILTERS), 0.0)


def train(
    windows: list[np.ndarray], y: np.ndarray, rounds: int = 20, batch: int = 64, rate: float = 0.01,
    net: SecretNetwork | None = None, secrets: float | None = None, seed: tuple[int, ...] = (),
) -> SecretNetwork:
    """Adam on the logistic loss from ``net`` on, either label weighing half; ``secrets`` is their part of all findings if these are but a share."""
    rng = np.random.default_rng([11, *seed] if seed else 11)
    net = fresh(rng) if net is None else SecretNetwork.of(net.vector())
    part = y.mean() if secrets is None else secrets
    weight = np.where(y == 1, 0.5 / max(part, 1 / len(y)), 0.5 / max(1 - part, 1 / len(y)))
    values = [net.filters, net.bias, net.out, np.array([net.shift])]
    first, second, t = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for _ in range(rounds):
        order = rng.permutation(len(y))
        for a in range(0, len(order), batch):
            at = order[a : a + batch]
            best, where, flat = net.hidden([windows[k] for k in at])
            error = (sigmoid(best @ net.out + net.shift) - y[at]) * weight[at] / len(at)
            back = np.outer(error, net.out) * (best > 0)
            slope = np.zeros_like(net.filters)
            for k in range(WIDTH):
                np.add.at(slope[k], (flat[where + k], np.arange(FILTERS)), back)
            slopes = [slope, back.sum(axis=0), best.T @ error, np.array([error.sum()])]
            t += 1
            for v, g, m, s in zip(values, slopes, first, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
            net.shift = float(values[3][0])
    return net


def fit_curve(sums: Callable[[float, float], tuple], steps: int = 12) -> tuple[float, float]:
    """Newton steps on the logistic loss; ``sums(a, b)`` gives slopes (2) and curvatures (3) over all findings kept back."""
    a = b = 0.0
    for _ in range(steps):
        da, db, aa, ab, bb = (float(x) for x in sums(a, b))
        aa, bb = aa + 1e-9, bb + 1e-9
        det = aa * bb - ab * ab
        if not det > 0:
            break
        step = np.clip([(bb * da - ab * db) / det, (aa * db - ab * da) / det], -5, 5)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a), max(float(b), 0.05)


def aims(n: float, secrets: float) -> tuple[float, float]:
    """What the curve is to give for the two labels: short of 0 and 1, or findings that are told apart without error have no curve."""
    return 1 / (n - secrets + 2), (secrets + 1) / (secrets + 2)


def calibrate(net: SecretNetwork, windows: list[np.ndarray], y: np.ndarray, recall: float) -> None:
    """Fit the curve on findings kept back, and take the highest threshold with enough recall."""
    raw = net.raw(windows)
    aim = np.where(y == 1, *aims(len(y), y.sum())[::-1])

    def sums(a: float, b: float) -> tuple:
        p = sigmoid(a + b * raw)
        w = p * (1 - p)
        return (p - aim).sum(), ((p - aim) * raw).sum(), w.sum(), (w * raw).sum(), (w * raw * raw).sum()

    net.curve = fit_curve(sums)
    scores = np.sort(net.score([w for w, k in zip(windows, y, strict=True) if k]))
    net.threshold = float(scores[int((1 - recall) * len(scores))]) if len(scores) else 1.0


def calibrate_all(net: SecretNetwork, judged: DataFrame, recall: float) -> None:
    """:func:`calibrate` on a stored table (``secret, raw``)."""
    n, secrets = judged.agg(F.count("*"), F.sum("secret")).first()
    low, high = aims(n, secrets)
    raw, aim = F.col("raw"), F.when(F.col("secret") == 1, high).otherwise(low)

    def sums(a: float, b: float) -> tuple:
        p = 1 / (1 + F.exp(-F.greatest(F.least(a + b * raw, F.lit(30.0)), F.lit(-30.0))))
        w = p * (1 - p)
        return judged.agg(F.sum(p - aim), F.sum((p - aim) * raw), F.sum(w), F.sum(w * raw), F.sum(w * raw * raw)).first()

    net.curve = fit_curve(sums)
    k = int((1 - recall) * secrets)
    ranked = judged.where("secret = 1").select("raw").orderBy("raw").rdd.zipWithIndex()
    at = ranked.filter(lambda x: x[1] == k).map(lambda x: float(x[0][0])).collect()
    net.threshold = float(sigmoid(net.curve[0] + net.curve[1] * np.array(at))[0])


def shares_of(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """The shares of a task, one after the other."""
    held: list[pd.DataFrame] = []
    at = None
    for batch in batches:
        share = batch["share"].to_numpy()
        for part in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(share)) + 1):
            if not len(part):
                continue
            if held and share[part[0]] != at:
                yield at, pd.concat(held, ignore_index=True)
                held = []
            at = int(share[part[0]])
            held.append(batch.iloc[part])
    if held:
        yield at, pd.concat(held, ignore_index=True)


def windows_of(rows: pd.DataFrame, share: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Windows of a share's findings, secrets first, and of as many random keys as it has secrets; labels, and which are kept back.

    Places for bare secrets and random keys are those of the share's findings that are no secrets, or of all where it has none.
    """
    rng = np.random.default_rng(5 + share)
    y = rows["labels"].to_numpy(float)
    places = rows[y == 0] if (y == 0).any() else rows
    others, behind = places["before"].tolist(), places["after"].tolist()
    windows, names = [], []
    for before, inside, after, label in zip(*(rows[x].tolist() for x in ("before", "inside", "after", "labels")), strict=True):
        a, b = rng.integers(len(others), size=2)
        bare = label and rng.random() < 0.5
        windows.append(window(others[a] if bare else before, inside, behind[b] if bare else after))
        names.append(inside)
    for _ in range(int(y.sum())):
        a, b = rng.integers(len(others), size=2)
        names.append(random_key(rng))
        windows.append(window(others[a], names[-1], behind[b]))
    y = np.concatenate([y, np.ones(int(y.sum()))])
    return windows, y, np.array([int(hashlib.md5(x.encode()).hexdigest(), 16) % 4 == 0 for x in names])


def learn(dealt: DataFrame, net: SecretNetwork | None, secrets: float | None, number: int) -> tuple[SecretNetwork | None, np.ndarray]:
    """One pass over all shares: the mean of the tasks' networks, and how many findings were learned and kept back, by label."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, of, n = net, 0, np.zeros(4, np.int64)
        for share, rows in shares_of(batches):
            windows, y, kept = windows_of(rows, share)
            n += [((y == label) & (kept == back)).sum() for back in (False, True) for label in (0, 1)]
            use = np.flatnonzero(~kept)
            if len(use):
                how = {} if secrets is None else {"rounds": ROUNDS, "net": own, "secrets": secrets, "seed": (number, share)}
                own = train([windows[k] for k in use], y[use], **how)
            of = share
        if n.any():
            yield pd.DataFrame([(of, *n.tolist(), b"" if own is None else own.vector().tobytes())], columns=["share", "l0", "l1", "k0", "k1", "net"])

    told = sorted(dealt.mapInPandas(run, "share long, l0 long, l1 long, k0 long, k1 long, net binary").collect())
    counts = np.array([r[1:5] for r in told], np.int64)
    nets = [(r["l0"] + r["l1"], np.frombuffer(r["net"])) for r in told if r["l0"] + r["l1"]]
    mean = SecretNetwork.of(np.average([v for _, v in nets], axis=0, weights=[w for w, _ in nets])) if nets else None
    return mean, counts.sum(axis=0)


def fit_network(found: DataFrame, recall: float = RECALL) -> SecretNetwork | None:
    """Learn from all labelled findings, those of a share in the order of their hashes."""
    each = found.select(F.explode(F.arrays_zip("before", "inside", "after", "labels")).alias("x")).select("x.*")
    each = each.where("labels >= 0").groupBy("inside", "labels").agg(F.min(F.struct("before", "after")).alias("b"))  # a key counts once, however often it is copied
    each = materialize(each.select("b.before", "inside", "b.after", "labels"), "labelled")
    sizes = {r["labels"]: r["n"] for r in each.groupBy("labels").agg(F.count("*").alias("n")).collect()}
    plain_ones, secrets = sizes.get(0, 0), sizes.get(1, 0)
    if min(plain_ones, secrets) < 5:
        return None
    shares = -(-(plain_ones + secrets) // SHARE_ROWS)
    tasks = min(shares, TASKS)
    share = F.pmod(F.xxhash64("inside"), F.lit(shares))
    dealt = each.withColumn("share", share).repartitionById(tasks, F.pmod(share, F.lit(tasks)).cast("int"))
    dealt = dealt.sortWithinPartitions("share", F.desc("labels"), F.xxhash64("inside"), "inside").persist(StorageLevel.DISK_ONLY)
    part = 2 * secrets / (plain_ones + 2 * secrets) if shares > 1 else None
    net = fresh(np.random.default_rng(11)) if shares > 1 else None
    counts = np.zeros(4, np.int64)
    for number in range(PASSES if shares > 1 else 1):
        net, counts = learn(dealt, net, part, number)
        if not counts.all():
            dealt.unpersist()
            return None

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own, rows in shares_of(batches):
            windows, y, kept = windows_of(rows, own)
            back = np.flatnonzero(kept)
            yield pd.DataFrame({"secret": y[back].astype(np.int64), "raw": net.raw([windows[k] for k in back])})

    calibrate_all(net, materialize(dealt.mapInPandas(judge, "secret long, raw double"), "judged"), recall)
    dealt.unpersist()
    net.learned, net.kept = int(counts[:2].sum()), int(counts[2:].sum())
    return net


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id``, base findings (``starts, ends, kinds``) and all findings (``all_starts, all_ends, all_kinds, scores``)."""
    found = materialize(find_candidates(docs), "candidates")
    net = fit_network(found)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False, name=None):
                starts, ends, kinds, at, to, before, inside, after, labels = ([] if v is None else list(v) for v in r[2:])
                spans = [(s, e, k, 1.0) for s, e, k in zip(starts, ends, kinds, strict=True)]
                free = [k for k, t in enumerate(labels) if t < 1]
                if net is not None and free:
                    scores = net.score([window(before[k], inside[k], after[k]) for k in free])
                    spans += [(at[k], to[k], "network", float(s)) for k, s in zip(free, scores, strict=True) if s >= net.threshold]
                spans.sort(key=lambda x: (x[0], KINDS.index(x[2])))
                rows.append((
                    r[1] if r[0] else None, starts, ends, kinds,
                    [x[0] for x in spans], [x[1] for x in spans], [x[2] for x in spans], [x[3] for x in spans],
                ))
            yield pd.DataFrame(rows, columns=["doc_id", "starts", "ends", "kinds", "all_starts", "all_ends", "all_kinds", "scores"]).astype({"doc_id": "Int64"})

    return found.mapInPandas(
        judge,
        "doc_id long, starts array<long>, ends array<long>, kinds array<string>, "
        "all_starts array<long>, all_ends array<long>, all_kinds array<string>, scores array<double>",
    )


@query
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every document in short form."""
    found = find_secrets(table(spark, sf_dir, "documents"))

    def joined(kinds: str, starts: str, ends: str):
        one = F.transform(F.arrays_zip(F.col(kinds).alias("k"), F.col(starts).alias("s"), F.col(ends).alias("e")), lambda x: F.concat_ws(":", x["k"], x["s"], x["e"]))
        return F.array_join(one, ",")

    def number(kind: str):
        return F.size(F.filter("kinds", lambda x: x == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(number(k) for k in KINDS[:3]),
        F.sha2(joined("kinds", "starts", "ends"), 256).alias("base_sha256"),
        joined("all_kinds", "all_starts", "all_ends").alias("spans"),
    )
