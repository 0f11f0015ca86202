"""Repair of conversation structure (operator 13).

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``.
Rows carry a role and a fault (blank, duplicate, truncated or none); the cheapest
edits that make a conversation well formed are found, and of equally cheap ones
those whose initials come first in ASCII.

1. A row becomes a symbol for its role and fault. Rows are range-partitioned by
   conversation and turn and read in order, so a conversation becomes pieces of
   at most ``PIECE_ROWS`` symbols, and one that holds any share of the rows
   spreads over many tasks. Equal pieces of all conversations are one.
2. Re-Pair: the most frequent pairs of neighbouring symbols, counted over all
   different pieces, become symbols of their own, in rounds of pairs that can't
   overlap, until none is repeated or ``MAX_RULES`` are made.
3. Bottom-up each rule gets one matrix from its two parts: for every pair of
   states of the role grammar the least cost (min-plus) with its edits as a rope
   that shares the parts' ropes. The grammar is at most ``MAX_RULES`` rules, so
   its matrices go to every task.
4. Each different piece is the product of its symbols' matrices, once for all
   conversations that have it; the pieces of a conversation are multiplied in
   order.
5. The rows meet their edits again in order, a row at a time, to write the
   repaired conversation or its digest.

Ropes compare by hashes of equal parts, so no text of edits is written before the
end. Of two equally cheap edits between the same states neither begins with the
other (an insertion costs), so the smaller stays the smaller whatever follows.

Defined cases: a null turn comes first; rows of one turn are in order of role and
then of a hash of the text; rows equal in everything count as often as they are
there; a null role or text is a blank; null conversations are one; roles other
than system, user and assistant by initial can be deleted or changed only; other
columns are not read; an empty table gives an empty one. A digest of a
conversation is made by one task, as it must be, which reads it row by row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm.common import materialize, query, table

PIECE_ROWS = 4096
MAX_RULES = 2048
RULES_A_ROUND = 128
ROUNDS = 14

NONE, REMOVE, CUT = 0, 1, 2  # sound, blank or duplicate, truncated
ROLES = "sua?"
KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
TRUNCATED = 5
# States of the role grammar: nothing yet, after the system row, after a user row, after an assistant row.
STATES = 4
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
GOOD = (0, 3)
FIRST_RULE = 0x4E00  # rules are written as characters from here on, so Python replaces pairs in a text

BLANKS = " \t\n\x0b\x0c\r"


def symbol(role: int, fault: int) -> str:
    return chr(ord("A") + 3 * role + fault)


class Ropes:
    """Texts put together from shared parts; compared without being written."""

    PRIME, RADIX = (1 << 61) - 1, 911_382_323

    def __init__(self):
        self.left: list[int] = []
        self.right: list[int] = []
        self.text: list[str] = []
        self.size: list[int] = []
        self.hash: list[int] = []
        self.power: list[int] = []
        self.known: dict = {}
        self.empty = self.leaf("")

    def _add(self, key, left: int, right: int, text: str, size: int, hash_: int, power: int) -> int:
        self.known[key] = at = len(self.size)
        self.left.append(left)
        self.right.append(right)
        self.text.append(text)
        self.size.append(size)
        self.hash.append(hash_)
        self.power.append(power)
        return at

    def leaf(self, text: str) -> int:
        if text in self.known:
            return self.known[text]
        value = 0
        for c in text.encode():
            value = (value * self.RADIX + c) % self.PRIME
        return self._add(text, -1, -1, text, len(text), value, pow(self.RADIX, len(text), self.PRIME))

    def join(self, a: int, b: int) -> int:
        if a == self.empty or b == self.empty:
            return b if a == self.empty else a
        if (a, b) in self.known:
            return self.known[a, b]
        value = (self.hash[a] * self.power[b] + self.hash[b]) % self.PRIME
        return self._add((a, b), a, b, "", self.size[a] + self.size[b], value, self.power[a] * self.power[b] % self.PRIME)

    def forget(self, size: int) -> None:
        """Drop what was added after there were ``size`` ropes."""
        for x in (self.left, self.right, self.text, self.size, self.hash, self.power):
            del x[size:]
        while len(self.known) > size:
            self.known.popitem()

    def less(self, a: int, b: int) -> bool:
        """Whether text ``a`` comes before text ``b``."""
        left, right = [a], [b]
        while left and right:
            x, y = left.pop(), right.pop()
            if x == y or (self.size[x] == self.size[y] and self.hash[x] == self.hash[y]):
                continue
            if self.left[x] >= 0 and (self.size[x] >= self.size[y] or self.left[y] < 0):
                left += [self.right[x], self.left[x]]
                right.append(y)
            elif self.left[y] >= 0:
                right += [self.right[y], self.left[y]]
                left.append(x)
            else:
                s, t = self.text[x], self.text[y]
                n = min(len(s), len(t))
                if s[:n] != t[:n]:
                    return s < t
                if len(s) > n:
                    left.append(self.leaf(s[n:]))
                if len(t) > n:
                    right.append(self.leaf(t[n:]))
        return bool(right)

    def write(self, a: int) -> str:
        out, todo = [], [a]
        while todo:
            x = todo.pop()
            if self.left[x] < 0:
                out.append(self.text[x])
            else:
                todo += [self.right[x], self.left[x]]
        return "".join(out)


Matrix = dict[tuple[int, int], tuple[int, int]]  # (from, to): least cost, edits


class Repair:
    """Transfer matrices of a grammar: rule ``k`` stands for the pair ``rules[k]``."""

    def __init__(self, rules: Iterable[str] = ()):
        self.ropes = Ropes()
        leaf = self.ropes.leaf
        # Insertions between rows: the fewest that lead from one state to another.
        self.inserts: Matrix = {(i, i): (0, self.ropes.empty) for i in range(STATES)}
        for (i, j), n in {(0, 2): 1, (1, 2): 1, (2, 3): 1, (3, 2): 1, (0, 3): 2, (1, 3): 2}.items():
            self.inserts[i, j] = INSERT * n, leaf("I" * n)
        self.of = {}
        for r, role in enumerate(ROLES):
            for fault in (NONE, REMOVE, CUT):
                own: Matrix = {(i, i): (DELETE, leaf("D")) for i in range(STATES)}
                if fault != REMOVE:
                    more = TRUNCATED if fault == CUT else 0
                    for new in "ua":
                        for i, j in STEPS[new].items():
                            own[i, j] = REROLE + more, leaf("R")
                    for i, j in STEPS.get(role, {}).items():
                        own[i, j] = KEEP + more, leaf("K")
                self.of[symbol(r, fault)] = self.times(self.inserts, own)
        for k, pair in enumerate(rules):
            self.of[chr(FIRST_RULE + k)] = self.times(self.of[pair[0]], self.of[pair[1]])

    def times(self, a: Matrix, b: Matrix) -> Matrix:
        out: Matrix = {}
        for (i, k), (cost, edits) in a.items():
            for j in range(STATES):
                if (k, j) not in b:
                    continue
                more, then = b[k, j]
                held = out.get((i, j))
                if held and held[0] < cost + more:
                    continue
                joined = self.ropes.join(edits, then)
                if not held or cost + more < held[0] or self.ropes.less(joined, held[1]):
                    out[i, j] = cost + more, joined
        return out

    def product(self, symbols: str) -> Matrix:
        out: Matrix = {(i, i): (0, self.ropes.empty) for i in range(STATES)}
        for x in symbols:
            out = self.times(out, self.of[x])
        return out

    def cheapest(self, whole: Matrix) -> tuple[int, str]:
        """Cost and edits from the start to a well-formed end."""
        done = self.times({k: x for k, x in whole.items() if k[0] == 0}, self.inserts)
        best = None
        for j in GOOD:
            if (0, j) in done and (best is None or done[0, j][0] < best[0] or (done[0, j][0] == best[0] and self.ropes.less(done[0, j][1], best[1]))):
                best = done[0, j]
        return best[0], self.ropes.write(best[1])


def shorten(symbols: str, rules: list[str], start: int = 0) -> str:
    """Pairs replaced by their rules, rule by rule."""
    for k in range(start, len(rules)):
        symbols = symbols.replace(rules[k], chr(FIRST_RULE + k))
    return symbols


def edited(rows: Iterable[tuple[str, str]], audit: Iterable[str]) -> Iterator[str]:
    """``role:text`` of the repaired conversation; the roles follow from the edits."""
    state, rows = 0, iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit in "RI":
            role = "assistant" if state == 2 else "user"
        state = STEPS[role[:1]][state]
        yield f"{role}:{text}"


# -- on Spark ---------------------------------------------------------------


def conversation_rows(rows: DataFrame) -> DataFrame:
    """``nameless, conv, turn, role, text`` with blanks for null roles and texts."""
    conv = F.col("conv_id").cast("long")
    blank = F.lit(" ")
    return rows.select(
        conv.isNull().alias("nameless"), F.coalesce(conv, F.lit(0)).alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"),
    )


CONV = ["nameless", "conv"]
ORDER = ["turn", "role", "h", "h2"]


def with_hash(rows: DataFrame) -> DataFrame:
    """The hashes by which equal texts are known and rows of one turn are ordered."""
    return rows.withColumn("h", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(1), "text"))


def coded(rows: DataFrame) -> DataFrame:
    """The rows without their texts: ``nameless, conv, turn, role, h, h2, initial, fault`` (0 none, 1 blank, 2 duplicate, 3 truncated) and ``times``."""
    end = F.rtrim("text", F.lit(BLANKS))
    own = F.when(end == "", 1).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    # Rows equal in all are counted before the shuffle; all but the first of them are duplicates.
    some = with_hash(rows).groupBy(*CONV, "turn", "role", "h", "h2").agg(F.min(own).alias("own"), F.count("*").alias("times"))
    some = materialize(some, "conversation-rows")
    first = some.groupBy(*CONV, "role", "h", "h2").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    seen = some.join(first.drop("rows"), [*CONV, "role", "h", "h2"], "left")
    again = F.col("first").isNotNull() & (F.col("first") != F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    return seen.select(
        *CONV, *ORDER, F.left("role", F.lit(1)).alias("initial"),
        F.when(F.col("own") == 1, 1).when(again, 2).otherwise(F.col("own")).alias("fault"), "times",
    )


PIECES = (
    "nameless boolean, conv long, piece long, symbols string, rows long, blank long, duplicate long, truncated long, illegal long, "
    "first string, last string, low long, high long, turns long"
)


def pieces(rows: DataFrame) -> DataFrame:
    """The conversations as pieces of symbols in order, with what is counted in each."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        out: list[tuple] = []
        own: list[str] = []
        at: tuple = ()
        counts = [0, 0, 0]
        illegal, first, last, low, high, turns = 0, "", "", None, None, 0

        def close() -> None:
            nonlocal number, own, counts, illegal, low, high, turns
            if own:
                out.append((*at, number, "".join(own), len(own), *counts, illegal, first, last, low, high, turns))
                number += 1
            own, counts, illegal, low, high, turns = [], [0, 0, 0], 0, None, None, 0

        for batch in batches:
            columns = [batch[x].tolist() for x in ("nameless", "conv", "known", "turn", "initial", "fault", "times")]
            for nameless, conv, known, turn, initial, fault, times in zip(*columns, strict=True):
                for k in range(times):
                    if at != (nameless, conv) or len(own) >= PIECE_ROWS:
                        close()
                        at = (nameless, conv)
                    now = fault if k == 0 or fault == 1 else 2
                    if not own:
                        first = initial
                    elif last + initial not in ("su", "ua", "au"):
                        illegal += 1
                    last = initial
                    role = ROLES.find(initial) if initial else 3
                    own.append(symbol(role if 0 <= role < 3 else 3, (NONE, REMOVE, REMOVE, CUT)[now]))
                    if now:
                        counts[now - 1] += 1
                    if known and (high is None or turn != high):
                        low, high, turns = turn if low is None else low, turn, turns + 1
            if len(out) >= 5_000:
                yield frame(out)
                out = []
        close()
        yield frame(out)

    def frame(out: list[tuple]) -> pd.DataFrame:
        names = [x.split()[0] for x in PIECES.split(", ")]
        df = pd.DataFrame(out, columns=names)
        return df.astype({"low": "Int64", "high": "Int64"})

    known = F.col("turn").isNotNull()
    ordered = rows.withColumn("known", known).withColumn("turn", F.coalesce("turn", F.lit(0)))
    by = [*CONV, "known", *ORDER]
    return ordered.repartitionByRange(*by).sortWithinPartitions(*by).mapInPandas(cut, PIECES)


def pair_grammar(sequences: DataFrame, max_rules: int = MAX_RULES) -> list[str]:
    """Re-Pair over all ``symbols``: the rules, each a pair of symbols, in the order in which they apply.

    Every round counts the neighbours in all sequences, as the rules so far leave
    them, and takes the most frequent pairs of which none can overlap another. Only
    counts of pairs leave the tasks.
    """
    rules: list[str] = []
    for _ in range(ROUNDS):
        so_far = list(rules)

        def count(batches: Iterator[pd.DataFrame], so_far: list[str] = so_far) -> Iterator[pd.DataFrame]:
            met: dict[str, int] = {}
            for batch in batches:
                for symbols, n in zip(batch["symbols"], batch["n"], strict=True):
                    x = shorten(symbols, so_far)
                    for k in range(len(x) - 1):
                        pair = x[k : k + 2]
                        met[pair] = met.get(pair, 0) + n
            yield pd.DataFrame({"pair": list(met), "n": list(met.values())}).astype({"pair": "object", "n": "int64"})

        counted = sequences.mapInPandas(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1")
        top = counted.orderBy(F.desc("n"), "pair").limit(4 * RULES_A_ROUND).collect()
        left: set[str] = set()
        right: set[str] = set()
        new = []
        for row in top:
            a, b = row["pair"]
            # A symbol that ends one pair and begins another would let two pairs overlap.
            if len(rules) + len(new) < max_rules and len(new) < RULES_A_ROUND and (a == b and not {a} & (left | right) or a != b and a not in right and b not in left):
                left.add(a)
                right.add(b)
                new.append(row["pair"])
        if not new:
            break
        rules += new
    return rules


def repaired_pieces(found: DataFrame) -> DataFrame:
    """Pieces with their matrices: ``states`` (from * STATES + to), ``costs`` and ``audits``, made once for equal pieces."""
    different = materialize(found.groupBy("symbols").agg(F.count("*").alias("n")), "different-pieces")
    rules = pair_grammar(different)
    grammar = Repair(rules)

    def evaluate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = len(grammar.ropes.size)
        for batch in batches:
            rows = []
            for symbols in batch["symbols"]:
                grammar.ropes.forget(own)
                whole = grammar.product(shorten(symbols, rules))
                rows.append((symbols, [i * STATES + j for i, j in whole], [x for x, _ in whole.values()], [grammar.ropes.write(x) for _, x in whole.values()]))
            yield pd.DataFrame(rows, columns=["symbols", "states", "costs", "audits"])

    return different.select("symbols").mapInPandas(evaluate, "symbols string, states array<int>, costs array<long>, audits array<string>")


FOUND = "nameless boolean, conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def cheapest_edits(rows: DataFrame) -> DataFrame:
    """``nameless, conv, gaps, blank, duplicate, truncated, illegal, cost, audit`` of each conversation with rows."""
    found = materialize(pieces(coded(rows)), "pieces")
    joined = found.drop("rows").join(repaired_pieces(found), "symbols").drop("symbols")

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        own = Repair()
        size = len(own.ropes.size)

        def close() -> tuple:
            own.ropes.forget(size)
            whole = own.product("")
            counts, gaps, low, high, turns, last = np.zeros(4, np.int64), 0, None, None, 0, None
            for x in held:
                matrix = {divmod(s, STATES): (c, own.ropes.leaf(a)) for s, c, a in zip(x.states.tolist(), x.costs.tolist(), x.audits, strict=True)}
                whole = own.times(whole, matrix)
                counts += [x.blank, x.duplicate, x.truncated, x.illegal]
                counts[3] += last is not None and last + x.first not in ("su", "ua", "au")
                last = x.last
                if not pd.isna(x.low):
                    turns += int(x.turns) - (high is not None and high == x.low)
                    low, high = x.low if low is None else low, x.high
            if low is not None:
                gaps = int(high) - int(low) + 1 - turns
            return (held[0].nameless, held[0].conv, gaps, *counts.tolist(), *own.cheapest(whole))

        names = [x.split()[0] for x in FOUND.split(", ")]
        for batch in batches:
            out = []
            for x in batch.itertuples(index=False):
                if held and (held[0].nameless, held[0].conv) != (x.nameless, x.conv):
                    out.append(close())
                    held = []
                held.append(x)
            yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame([close()], columns=names)

    by = [*CONV, "piece"]
    return joined.repartition(*CONV).sortWithinPartitions(*by).mapInPandas(multiply, FOUND)


def repair_conversations(rows: DataFrame, digest: bool = False) -> DataFrame:
    """One row for each conversation in ``rows`` (``conv_id, turn, role, text``).

    Counts of ``gaps`` in the turns and of blank, duplicate, truncated rows and
    illegal neighbours, the least ``cost`` of repair, its edits (``audit``) and the
    repaired conversation as lines ``role:text`` (``repaired``), or with ``digest``
    their sha256 (``repaired_sha256``).
    """
    rows = conversation_rows(rows)
    found = materialize(cheapest_edits(rows), "edits")
    name = "repaired_sha256" if digest else "repaired"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: tuple = ()
        audit, at, state, first = "", 0, 0, True
        held, whole = sha256(), []

        def put(role: str, text: str) -> None:
            nonlocal state, first
            state = STEPS[role[:1]][state]
            line = ("" if first else "\n") + f"{role}:{text}"
            first = False
            if digest:
                held.update(line.encode("utf-8", "surrogatepass"))
            else:
                whole.append(line)

        def inserted() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                put("assistant" if state == 2 else "user", "")
                at += 1

        def close() -> tuple:
            return (*now, held.hexdigest() if digest else "".join(whole))

        names = [*CONV, name]
        for batch in batches:
            out = []
            columns = [batch[x].tolist() for x in (*CONV, "kind", "role", "text")]
            for nameless, conv, kind, role, text in zip(*columns, strict=True):
                if kind == 0:
                    if now:
                        out.append(close())
                    now, audit, at, state, first, held, whole = (nameless, conv), text, 0, 0, True, sha256(), []
                    inserted()
                    continue
                edit = audit[at]
                at += 1
                if edit != "D":
                    put(role if edit == "K" else "assistant" if state == 2 else "user", text)
                inserted()
            yield pd.DataFrame(out, columns=names)
        if now:
            yield pd.DataFrame([close()], columns=names)

    # A conversation's edits come before its rows, so each task reads both as they come.
    first = found.select(*CONV, F.lit(0).alias("kind"), F.col("audit").alias("text"))
    then = with_hash(rows).withColumn("kind", F.lit(1))
    both = then.unionByName(first, allowMissingColumns=True)
    by = [*CONV, "kind", *ORDER]
    written = both.repartition(*CONV).sortWithinPartitions(*by).select(*CONV, "kind", F.coalesce("role", F.lit("")).alias("role"), "text")
    written = written.mapInPandas(write, f"nameless boolean, conv long, {name} string")
    out = found.join(written, CONV)
    return out.select(F.when(~F.col("nameless"), F.col("conv")).alias("conv_id"), *[x for x in found.columns if x not in CONV], name)


def damage(rows: DataFrame) -> DataFrame:
    """Faults of a known kind in about a quarter of the rows, by the checksum of conversation and turn."""

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text, role = shown("text"), shown("role")
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    again = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), again.alias("copy")).drop("copy")


EMPTY_SHA256 = sha256(b"").hexdigest()


@query
def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repair of all conversations after damage."""
    rows = table(spark, sf_dir, "conversations")
    found = repair_conversations(damage(rows), digest=True)
    every = rows.select(F.col("conv_id").cast("long").alias("own")).distinct()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.join(found, F.col("own").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("own").alias("conv_id"), *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY_SHA256)).alias("repaired_sha256"),
    )
