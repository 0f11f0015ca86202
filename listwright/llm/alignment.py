"""Token alignment across two tokenizers (operator 12).

A text is encoded by a byte-level file of the tokenizers library (A) and by a
sentencepiece model (B); both see a space and the text. Where a token of either
ends at the same byte, the text is cut into groups, the smallest pieces that both
can exchange. Two tokens are linked where their bytes overlap.

Spans are the decoded bytes of the tokens, added up. Where these spell the text,
and only there a text has tokens, they are the spans that the libraries name, and
exact also where these name the whole character: inside a character of several
bytes that A cuts, and in a run of B's byte tokens.

Neither tokenizer has a token across the beginning of a word (a blank or line
feed after a visible character), so texts are aligned word by word, new words by
the thousand at a time, and a worker keeps the alignment of the words it has met.
One pass over the texts writes blocks of documents: their numbers, their words by
number, and the linked pairs of the block's own words with the counts in the block.
Counts of pairs and sums of counts then come from the blocks. The counts are a
table of at most the pairs of both vocabularies; tasks look them up while there
are at most ``LOOKED_UP`` of them, beyond that each block is joined with the counts
of its own pairs.

Memory: workers work on one text slice or block at a time, straight from Arrow's
buffers, and return what they have freed to the system; else a worker that aligned
keeps all of it beside the JVM's heap. Each block is a row group of its own, so
Spark holds no more than one while it writes.

Defined cases: texts that are null, empty, or that tokens of A or B do not spell
(sentencepiece reads U+2581 as a blank) have no tokens, and all their numbers are
zero; names of special tokens in a text are text; every row is a document of its
own, whatever its doc_id, null included; other columns are not read; an empty
table gives an empty one. A text of any length is read a slice at a time.
"""

from __future__ import annotations

import ctypes
import os
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm.common import materialize, query, shared_dir, table
from listwright.llm.encoding import BYTES, OTHER_SPACES, Places, roomy

LOOKED_UP = 2_000_000  # counted pairs that every task holds (34 MB)
CACHED_WORDS = 300_000
CACHED_CHARS = 12_000_000
CACHED_LINKS = 4_000_000  # of the words held (32 MB, and about 50 MB of groups)
JOINED_WORDS = 2_000  # new words that a tokenizer gets at a time
BLOCK_WORDS = 1_000_000
BLOCK_CHARS = 16_000_000  # of groups as text
SLICE_CHARS = 1_000_000

BEFORE_WORD = re.compile(r"(?<=[!-~\w])(?=[ \n])|(?<=[!-~\w]\n)(?=[!-~\w])")
LETTERS = {letter: byte for byte, letter in BYTES.items()}


def words_of(text: str) -> list[str]:
    """A text that begins with a blank, cut where no token of A or B spans."""
    if "\0" not in text:
        units = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")[1:]
        if "" not in units and " " not in units and not any(x in text for x in OTHER_SPACES):
            return units
    return BEFORE_WORD.split(text)


def slices(text: str, size: int) -> Iterator[str]:
    """A text in pieces of about so many characters, cut before words; a text without words stays whole."""
    at = 0
    while len(text) - at > size:
        cut = BEFORE_WORD.search(text, at + size)
        if cut is None:
            break
        # The next piece must begin with a blank, as the text does.
        while cut and text[cut.start()] != " ":
            cut = BEFORE_WORD.search(text, cut.start() + 1)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class Aligner:
    """The alignments of words by two tokenizers, each word aligned once.

    ``place`` numbers words; by number there are tokens of A and B, groups and
    links (``counts``), whether both tokenizers spell the word (``ok``), its
    groups as text, and in ``pool`` its linked pairs (``a << 32 | b``).
    """

    def __init__(self, byte_path: str, piece_path: str, words: int = CACHED_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.a_bytes = {k: bytes(LETTERS.get(x, 0) for x in name) for name, k in self.a.get_vocab(with_added_tokens=False).items()}
        self.b = SentencePieceProcessor(model_file=piece_path)
        pieces = [(k, self.b.id_to_piece(k)) for k in range(self.b.get_piece_size())]
        self.b_byte = {k for k, _ in pieces if self.b.is_byte(k)}
        self.b_bytes = [bytes([int(x[3:-1], 16)]) if k in self.b_byte else x.replace("▁", " ").encode() for k, x in pieces]
        across = re.compile("[^▁]▁|.\n|\n.")
        self.cuts = not any(across.search(x) for k, x in pieces if k not in self.b_byte)
        self.lengths = np.zeros(max(self.a_bytes) + 1, np.int64), np.array(list(map(len, self.b_bytes)), np.int64)
        for k, x in self.a_bytes.items():
            self.lengths[0][k] = len(x)
        self.feed = next((k for k, x in pieces if x == "<0x0A>"), -1)
        self.tails = {x: self.a.model.tokenize(x)[0].id for x in ".,;:!?"}
        names = np.array(list(map(str, range(max(len(pieces), max(self.a_bytes) + 1)))), "S")
        self.names = names.view(np.uint8).reshape(len(names), -1)  # decimal, filled up with zero bytes
        self.words = words
        self.clear()

    def clear(self) -> None:
        self.place = Places()
        self.chars = 0
        self.counts = np.zeros((1 << 12, 4), np.uint32)
        self.ok = np.zeros(1 << 12, bool)
        self.starts = np.zeros(1 << 12, np.int64)
        self.pool = np.zeros(1 << 14, np.uint64)
        self.used = 0
        self.groups: list[bytes] = []

    def a_spans(self, words: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids, byte ends and number of A's tokens, word by word.

        A word of letters is one piece of A's rules, a sign behind it another, and
        goes to its merges at once. Of the others those that begin with a blank and
        have a visible end go to the library in one text. Where a token of it spans
        the end of a word, or its tokens do not spell it, each word goes alone.
        """
        tokenize, tails, space = self.a.model.tokenize, self.tails, BYTES[32]
        ids: list[int] = []
        owners, sizes, together, alone = [], [], [], []
        for k, word in enumerate(words):
            if word.isascii() and word[:1] == " ":
                if word[1:].isalpha():
                    found = [x.id for x in tokenize(space + word[1:])]
                elif word[-1] in tails and word[1:-1].isalpha():
                    found = [x.id for x in tokenize(space + word[1:-1])]
                    found.append(tails[word[-1]])
                else:
                    (together if "!" <= word[-1] <= "~" else alone).append(k)
                    continue
                ids += found
                owners.append(k)
                sizes.append(len(found))
            else:
                visible = word[:1] == " " and (word[-1].isalnum() or "!" <= word[-1] <= "~")
                (together if visible else alone).append(k)
        parts = [np.array(ids, np.int64)]
        owner = [np.repeat(np.array(owners, np.int64), sizes)]
        for at in range(0, len(together), JOINED_WORDS):
            some = together[at : at + JOINED_WORDS]
            text = [words[k] for k in some]
            own = np.array(self.a.encode("".join(text), add_special_tokens=False).ids, np.int64)
            to = np.cumsum(self.lengths[0][own])
            last = np.cumsum([len(x) if x.isascii() else len(x.encode("utf-8", "surrogatepass")) for x in text])
            n = np.searchsorted(to, last, "right")
            if n[0] and n[-1] == len(own) and (to[n - 1] == last).all():
                parts.append(own)
                owner.append(np.repeat(some, np.diff(n, prepend=0)))
            else:
                alone += some
        for k, x in zip(alone, self.a.encode_batch([words[k] for k in alone], add_special_tokens=False), strict=True):
            parts.append(np.array(x.ids, np.int64))
            owner.append(np.full(len(x.ids), k))
        own, of = np.concatenate(parts), np.concatenate(owner)
        order = np.argsort(of, kind="stable")
        own, of = own[order], of[order]
        return own.tolist(), *self.ends(self.lengths[0][own], of, len(words))

    def b_spans(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, byte ends and number of B's tokens, word by word.

        The model adds a blank before what it is given; a line feed, which merges
        with nothing, parts it off again, and words without one from each other.
        """
        ids, owners = ([np.zeros(0, np.int64)] for _ in range(2))
        odd = [[k] for k, w in enumerate(words) if "\n" in w]
        plain = [k for k, w in enumerate(words) if "\n" not in w]
        for some in [*odd, *(plain[at : at + JOINED_WORDS] for at in range(0, len(plain), JOINED_WORDS))]:
            own = np.array(self.b.encode("\n" + "\n".join([words[k] for k in some]), out_type=int, num_threads=1), np.int64)[1:]
            feed = own == self.feed
            if len(some) == 1:
                feed[1:] = False
            ids.append(own[~feed])
            owners.append(np.array(some)[np.cumsum(feed)[~feed] - 1])
        own, owner = np.concatenate(ids), np.concatenate(owners)
        if odd:
            order = np.argsort(owner, kind="stable")
            own, owner = own[order], owner[order]
        return own, *self.ends(self.lengths[1][own], owner, len(words))

    @staticmethod
    def ends(lengths: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where in its word each token ends by the bytes of the tokens, and the number of tokens of each word."""
        sizes = np.bincount(owner, minlength=n)
        sums = np.concatenate([[0], np.cumsum(lengths)])
        return sums[1:] - sums[(np.cumsum(sizes) - sizes)[owner]], sizes

    def align(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """Whether both tokenizers spell each word, counts, groups as text, and the linked pairs of all words in order."""
        whole = np.frombuffer("".join(words).encode("utf-8", "surrogatepass"), np.uint8)
        n, lengths = len(words), np.array(list(map(len, words)), np.int64)
        if lengths.sum() < len(whole):
            lengths = np.array([len(w) if w.isascii() else len(w.encode("utf-8", "surrogatepass")) for w in words], np.int64)
        base = np.cumsum(lengths) - lengths
        ok = lengths > 0
        ids, ends, owners = [], [], []
        for (own, to, sizes), spell in zip((self.a_spans(words), self.b_spans(words)), (self.a_bytes, self.b_bytes), strict=True):
            own, owner = np.array(own, np.int64), np.repeat(np.arange(n), sizes)
            last = np.zeros(n, np.int64)
            last[owner] = to
            fits = last == lengths
            ok &= fits
            # Of the words whose tokens have as many bytes, those with another byte anywhere are not spelt either.
            told = np.frombuffer(b"".join(map(spell.__getitem__, own[fits[owner]].tolist())), np.uint8)
            same = told == (whole if fits.all() else whole[np.repeat(fits, lengths)])
            if not same.all():
                ok[np.repeat(np.arange(n)[fits], lengths[fits])[~same]] = False
            ids.append(own)
            owners.append(owner)
            ends.append(to + base[owner])
        # Words that are not spelt have no tokens; of all others the ends are places in one long text.
        if not ok.all():
            for k in (0, 1):
                some = ok[owners[k]]
                ids[k], ends[k], owners[k] = ids[k][some], ends[k][some], owners[k][some]
        at = np.zeros((2, len(whole) + 1), bool)
        at[0, ends[0]] = at[1, ends[1]] = True
        cuts, every = np.flatnonzero(at[0] & at[1]), np.flatnonzero(at[0] | at[1])
        # Tokens that end before each end: the next ones are those that overlap there.
        left, right = (np.cumsum(x, dtype=np.int32)[every] - x[every] for x in at)
        pairs = (ids[0][left] << 32 | ids[1][right]).astype(np.uint64)
        counts = np.zeros((n, 4), np.int64)
        counts[:, 0], counts[:, 1] = np.bincount(owners[0], minlength=n), np.bincount(owners[1], minlength=n)
        to_a, to_b = (np.searchsorted(x, cuts, "right") for x in ends)
        counts[:, 2] = np.bincount(owners[0][to_a - 1], minlength=n)
        counts[:, 3] = np.bincount(owners[0][left], minlength=n)
        return ok, counts, self.groups_of(ids, to_a, to_b, counts[:, 2]), pairs

    def groups_of(self, ids: list[np.ndarray], to_a: np.ndarray, to_b: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The groups of each word as text: all ids in order, each with the sign that follows it."""
        n_a, n_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        # A's ids stand behind B's of earlier groups, B's behind A's of their own too.
        place_a = np.arange(len(ids[0])) + np.repeat(to_b - n_b, n_a)
        place_b = np.arange(len(ids[1])) + np.repeat(to_a, n_b)
        text = np.empty((len(ids[0]) + len(ids[1]), self.names.shape[1] + 1), np.uint8)
        text[place_a, :-1], text[place_b, :-1] = self.names[ids[0]], self.names[ids[1]]
        text[:, -1] = ord(",")
        text[place_a[to_a - 1], -1] = ord("|")
        last = place_b[to_b - 1]
        text[last, -1] = ord(";")
        some = sizes > 0
        text[last[np.cumsum(sizes)[some] - 1], -1] = ord("\n")
        shown = iter(text[text > 0].tobytes().split(b"\n"))
        return [next(shown) if x else b"" for x in some.tolist()]

    def numbers(self, words: list[str]) -> np.ndarray:
        """The words' numbers; new words are aligned."""
        new = self.place.new
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        if new:
            first, size = len(self.place) - len(new), len(self.place)
            ok, counts, groups, pairs = self.align(new)
            if size > len(self.ok):
                more = np.zeros((2 * size, 4), np.uint32)
                more[:first] = self.counts[:first]
                self.counts = more
            self.ok, self.starts = roomy(self.ok, len(self.counts)), roomy(self.starts, len(self.counts))
            self.pool = roomy(self.pool, self.used + len(pairs))
            self.ok[first:size], self.counts[first:size] = ok, counts
            self.starts[first:size] = self.used + np.cumsum(counts[:, 3]) - counts[:, 3]
            self.pool[self.used : self.used + len(pairs)] = pairs
            self.used += len(pairs)
            self.groups += groups
            self.chars += sum(map(len, new))
            new.clear()
        return at

    def full(self) -> bool:
        return len(self.place) > self.words or self.chars > CACHED_CHARS or self.used > CACHED_LINKS

    def read(self, texts: list[str | None]) -> list[list[np.ndarray]]:
        """The numbers of each text's words, a slice of the text each; nothing where a tokenizer does not spell it."""
        parts = [[] if not t else [words_of(x) for x in slices(" " + t, SLICE_CHARS)] if self.cuts else [[" " + t]] for t in texts]
        at = self.numbers([w for own in parts for part in own for w in part])
        out, done = [], 0
        for own in parts:
            found = []
            for part in own:
                found.append(at[done : done + len(part)])
                done += len(part)
            out.append(found if found and all(self.ok[x].all() for x in found) else [])
        return out

    def pairs_of(self, at: np.ndarray) -> np.ndarray:
        """The linked pairs of words, one after the other."""
        sizes = self.counts[at, 3].astype(np.int64)
        ends = np.cumsum(sizes)
        return self.pool[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(byte_path: str, piece_path: str) -> Aligner:
    """The worker's own aligner for two files; it outlives a task, so its words serve the next."""
    if (byte_path, piece_path) not in ALIGNERS:
        ALIGNERS[byte_path, piece_path] = Aligner(byte_path, piece_path)
    return ALIGNERS[byte_path, piece_path]


def give_back() -> None:
    """Return freed memory to the system; Arrow and C's allocator (where it can be told to, as in glibc) keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None
    if trim:
        trim(0)


def forget() -> None:
    """Give back the memory of the worker's aligners: the steps on blocks need them no more, and workers are used again."""
    ALIGNERS.clear()
    give_back()


NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
BLOCK = "block long, doc_id array<long>, numbers binary, groups array<string>, sizes binary, words binary, pair_sizes binary, places binary, pairs binary, links binary"
BLOCK_TYPES = {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "binary": pa.binary()}
BLOCK_SCHEMA = pa.schema([(name, BLOCK_TYPES[kind]) for name, kind in (x.split() for x in BLOCK.split(", "))])
# A row group for each block, pages of one value each; dictionaries would hold the blocks once more.
BLOCK_FILES = {"compression": "zstd", "parquet.block.size": "1048576", "parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false"}


def blocks(docs: DataFrame, byte_path: str, piece_path: str, groups: bool) -> DataFrame:
    """Blocks of aligned documents.

    ``numbers`` are four counts a document, ``groups`` its groups as text or their
    digest, ``sizes`` its number of words, ``words`` the words of all documents as
    places in the block's list of different words, ``pair_sizes`` and ``places``
    the linked pairs of these as places in the block's ``pairs``, and ``links`` how
    often each pair is linked in the block's documents.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = aligner(byte_path, piece_path)
        number = TaskContext.get().partitionId() << 33
        held: list[tuple] = []
        words = chars = 0

        def close() -> pa.RecordBatch:
            nonlocal held, words, chars, number
            flat = np.concatenate([np.zeros(0, np.uint32), *(x for h in held for x in h[3])])
            met = np.zeros(len(own.place), bool)
            met[flat] = True
            some = np.flatnonzero(met)
            flat = (np.cumsum(met, dtype=np.uint32) - np.uint32(1))[flat]
            sizes, linked = own.counts[some, 3], own.pairs_of(some)
            pairs = np.unique(linked)
            places = np.searchsorted(pairs, linked).astype("<u4")
            links = np.bincount(places, np.repeat(np.bincount(flat, minlength=len(some)), sizes), len(pairs)).astype(np.int64)
            row = (
                number, [h[0] for h in held], np.concatenate([h[1] for h in held]).tobytes(), [h[2] for h in held],
                np.array([sum(map(len, h[3])) for h in held], "<u4").tobytes(), flat.astype("<u4", copy=False).tobytes(),
                sizes.astype("<u4", copy=False).tobytes(), places.tobytes(), pairs.tobytes(), links.tobytes(),
            )
            held, words, chars, number = [], 0, 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([x], field.type) for x, field in zip(row, BLOCK_SCHEMA, strict=True)], schema=BLOCK_SCHEMA)

        def some_texts(batch: pa.RecordBatch) -> Iterator[tuple[list, list]]:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(doc_id.as_py())
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size >= SLICE_CHARS:
                    yield ids, texts
                    ids, texts, size = [], [], 0
            if ids:
                yield ids, texts

        for batch in batches:
            for ids, texts in some_texts(batch):
                if own.full():
                    if held:
                        yield close()
                    own.clear()
                    give_back()
                for doc_id, found in zip(ids, own.read(texts), strict=True):
                    numbers, digest, shown = np.zeros(4, np.int64), sha256(), []
                    for k, at in enumerate(found):
                        numbers += own.counts[at].sum(axis=0, dtype=np.int64)
                        text = (b";" if k else b"") + b";".join(map(own.groups.__getitem__, at.tolist()))
                        if groups:
                            shown.append(text)
                        else:
                            digest.update(text)
                    told = "" if not found else b"".join(shown).decode() if groups else digest.hexdigest()
                    held.append((doc_id, numbers, told, [x.astype(np.uint32) for x in found]))
                    words += int(sum(map(len, found)))
                    chars += len(told)
                    if words > BLOCK_WORDS or chars > BLOCK_CHARS:
                        yield close()
        if held:
            yield close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(read, BLOCK)


def numbers_in(value: pa.BinaryScalar, kind: str | type) -> np.ndarray:
    """The numbers in a binary value, where they lie."""
    return np.frombuffer(value.as_buffer(), kind)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Scalar]]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(at)[k] for at, name in enumerate(batch.schema.names)}


def summed(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs and how often they were met."""
    flat, n = np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.int64), *times])
    found, place = np.unique(flat, return_inverse=True)
    return found, np.bincount(place, n, len(found)).astype(np.int64)


def pair_columns(keys: np.ndarray) -> list[np.ndarray]:
    return [(keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)]


def pair_counts(found: DataFrame) -> DataFrame:
    """``a, b, links``: how often two ids are linked in all blocks. Every task adds up its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        keys, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for row in rows_of(batches):
            keys, times = summed([keys, numbers_in(row["pairs"], np.uint64)], [times, numbers_in(row["links"], np.int64)])
            if len(keys) > 4_000_000:
                yield rows(keys, times)
                keys, times = keys[:0], times[:0]
        yield rows(keys, times)

    def rows(keys: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (*pair_columns(keys), times)], ["a", "b", "links"])

    counted = found.select("pairs", "links").mapInArrow(count, "a long, b long, links long")
    return counted.groupBy("a", "b").agg(F.sum("links").alias("links"))


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def summed_up(value: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sums of ``value[at]`` over runs of so many entries."""
    sums = np.zeros(len(at) + 1, np.int64)
    np.cumsum(value[at], out=sums[1:])
    ends = np.cumsum(sizes, dtype=np.int64)
    return sums[ends] - sums[ends - sizes]


def counted_rows(row: dict[str, pa.Scalar], known: np.ndarray, links: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    """The documents of a block, with the sums over their links by a lookup (pairs in order, their counts, which are best)."""
    at = np.searchsorted(known, numbers_in(row["pairs"], np.uint64))
    words, sizes, places, pair_sizes = (numbers_in(row[x], "<u4") for x in ("words", "sizes", "places", "pair_sizes"))
    numbers = numbers_in(row["numbers"], np.int64).reshape(-1, 4)
    sums = [summed_up(summed_up(x[at], places, pair_sizes), words, sizes) for x in (best, links)]
    columns = [row["doc_id"].values, *(pa.array(x) for x in (*np.ascontiguousarray(numbers.T), *sums)), row["groups"].values]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in ALIGNED.split(", ")])


def align_documents(docs: DataFrame, byte_path: str, piece_path: str, groups: bool = True, looked_up: int = LOOKED_UP) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum`` and ``groups`` of each document.

    ``groups`` are the ids of A and B that spell the same bytes, as text
    (``a1,a2|b1;a3|b2,b3``), or with ``groups=False`` the sha256 of that text
    ('' without tokens). ``n_best`` counts links whose ids are linked as often as
    the B id is with any, ``count_sum`` adds up how often each link's ids are
    linked in all documents.
    """
    spark = docs.sparkSession
    path = shared_dir(spark, "aligned")
    blocks(docs, byte_path, piece_path, groups).write.options(**BLOCK_FILES).parquet(path)
    found = spark.read.schema(BLOCK).parquet(path)
    counted = materialize(pair_counts(found), "pairs")
    if counted.count() <= looked_up:
        held = counted.toPandas()
        key = held["a"].to_numpy(np.uint64) << np.uint64(32) | held["b"].to_numpy(np.uint64)
        best = held["links"] == held.groupby("b")["links"].transform("max")
        order = np.argsort(key)
        lookup = spark.sparkContext.broadcast((key[order], held["links"].to_numpy(np.int64)[order], best.to_numpy(np.int64)[order]))

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            for row in rows_of(batches):
                yield counted_rows(row, *lookup.value)

        return found.drop("block", "links").mapInArrow(look_up, ALIGNED)
    most = counted.groupBy("b").agg(F.max("links").alias("most"))
    counted = counted.join(most, "b").select("a", "b", "links", (F.col("links") == F.col("most")).cast("long").alias("best"))

    def different(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for row in rows_of(batches):
            keys = numbers_in(row["pairs"], np.uint64)
            block = np.full(len(keys), row["block"].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (block, *pair_columns(keys))], ["block", "a", "b"])

    own = found.select("block", "pairs").mapInArrow(different, "block long, a long, b long").join(counted, ["a", "b"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b, links, best = (right.column(x).to_numpy() for x in ("a", "b", "links", "best"))
        key = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        order = np.argsort(key)
        return pa.Table.from_batches([counted_rows(row, key[order], links[order], best[order]) for row in rows_of(left.to_batches())])

    return found.drop("links").groupBy("block").cogroup(own.groupBy("block")).applyInArrow(meet, ALIGNED)


@query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of all documents by a byte-level and a sentencepiece tokenizer."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    found = align_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), groups=False)
    return found.withColumnRenamed("groups", "groups_sha256")
