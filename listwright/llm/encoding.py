"""Token ids of whole texts, each word encoded once.

Common tokenizers cut a text into words before they merge, and no token spans
such a cut. Words repeat, so a worker keeps the ids of the words it has met
and asks the tokenizers library only for new ones. Which cuts are safe follows
from the file's own rules; a file with other rules is applied to whole texts.
The library takes the file's added tokens out of a text first, so a text is cut
around these before anything else.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np

CACHED_WORDS = 800_000  # per worker; a full cache starts anew
PIECE_CHARS = 2_000_000  # characters split at a time

BEFORE_SPACE = re.compile(r"(?<=[!-~\w])(?=\s)")


class Places(dict):
    """Numbers words as they are first asked for and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at


class Encoder:
    """``encode(texts)`` gives all ids, one after the other, and how many each text has.

    ``special_as_text``: the names of special tokens in a text are ordinary text
    (the library's ``encode_special_tokens``) and not these tokens.
    """

    def __init__(self, path: str, words: int = CACHED_WORDS, special_as_text: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.model, self.words = self.tokenizer.model, words
        self.tails = {x: [y.id for y in self.model.tokenize(x)] for x in (".", ",")}
        rules = json.loads(self.tokenizer.to_str())
        self.cut = safe_cut(rules)
        added = [x["content"] for x in rules.get("added_tokens") or [] if not (special_as_text and x["special"])]
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.clear()

    def clear(self) -> None:
        self.place = Places()
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.starts = np.zeros(1 << 12, np.int64)
        self.counts = np.zeros(1 << 12, np.int64)

    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes, some, chars = [], [], [], 0
        for text in texts:
            some.append(text or "")
            chars += len(some[-1])
            if chars >= PIECE_CHARS:
                self._some(some, ids, sizes)
                some, chars = [], 0
        self._some(some, ids, sizes)
        if not ids:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate(ids), np.concatenate(sizes)

    def _some(self, texts: list[str], ids: list, sizes: list) -> None:
        if not texts:
            return
        if self.cut is None:
            found = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            ids.append(np.concatenate(found))
            sizes.append(np.array([len(x) for x in found], np.int64))
            return
        if len(self.place) > self.words:
            self.clear()
        units, bounds = [], [0]
        for text in texts:
            if self.added and self.added.search(text):
                for k, part in enumerate(self.added.split(text)):
                    units += [part] if k % 2 else self.cut(part)
            else:
                units += self.cut(text)
            bounds.append(len(units))
        at = np.array(self._places(units), np.int64)
        lengths = self.counts[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids.append(self.pool[np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(total)])
        ends = np.concatenate([[0], ends])
        sizes.append(np.diff(ends[np.array(bounds)]))

    def _places(self, units: list[str]) -> list[int]:
        new = self.place.new
        at = list(map(self.place.__getitem__, units))
        if new:
            flat, lengths = self._new(new)
            first = len(self.place) - len(new)
            self.pool = roomy(self.pool, self.used + len(flat))
            self.starts, self.counts = roomy(self.starts, len(self.place)), roomy(self.counts, len(self.place))
            self.pool[self.used : self.used + len(flat)] = flat
            self.starts[first : len(self.place)] = self.used + np.cumsum(lengths) - lengths
            self.counts[first : len(self.place)] = lengths
            self.used += len(flat)
            new.clear()
        return at

    def _new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words. A plain word is one piece of the file's rules and goes to its merges at once."""
        found: list = [self._plain(x) for x in words]
        rest = [k for k, x in enumerate(found) if x is None]
        if rest:
            for k, x in zip(rest, self.tokenizer.encode_batch([words[k] for k in rest], add_special_tokens=False), strict=True):
                found[k] = x.ids
        lengths = np.array(list(map(len, found)), np.int64)
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    def _plain(self, word: str) -> list[int] | None:
        """Ids of letters with a blank before and a full stop or comma behind, if it is of that form."""
        tail = word[-1:]
        core, tail = (word[:-1], tail) if tail in (".", ",") else (word, "")
        lead = core[:1] == " "
        if lead:
            core = core[1:]
        if not core.isalpha():
            return None
        if self.cut is cut_dropping_spaces:
            core = core.lower() if core.isascii() else self.tokenizer.normalizer.normalize_str(core)
            if not core.isalpha():
                return None
            lead = False
        if not core.isascii():
            core = core.encode().decode("latin-1").translate(BYTES)
        ids = [x.id for x in self.model.tokenize((BYTES[32] + core) if lead else core)]
        if tail:
            ids += self.tails[tail]
        return ids


ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's own encoder for a file, with the library's ids; it outlives a task, so its words serve the next."""
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path, special_as_text=False)
    return ENCODERS[path]


def roomy(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    out = np.zeros(max(size, 2 * len(array)), array.dtype)
    out[: len(array)] = array
    return out


def safe_cut(rules: dict):
    """How to cut a text so that the parts' ids make up the text's, or None."""
    before, change = rules.get("pre_tokenizer") or {}, rules.get("normalizer")
    if rules.get("post_processor") or rules.get("truncation") or rules.get("padding"):
        return None
    # Added tokens that depend on what stands beside them, or on the normalized text, need the whole text.
    for x in rules.get("added_tokens") or []:
        if x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] or not x["content"] or any(c.isspace() for c in x["content"]):
            return None
    if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not change:
        return cut_keeping_spaces
    steps = [x.get("type") for x in (change or {}).get("normalizers", [])]
    parts = before.get("pretokenizers", [])
    drops = bool(parts) and parts[0].get("type") == "Split" and parts[0].get("invert") and parts[0].get("behavior") == "Removed"
    if steps == ["NFC", "Replace", "Lowercase"] and drops and r"[^\s\p{L}\p{N}]+" in parts[0]["pattern"].get("Regex", ""):
        return cut_dropping_spaces
    return None


def cut_dropping_spaces(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


def cut_keeping_spaces(text: str) -> list[str]:
    """Words with the space before them.

    A run of white space is read as a whole, so a text that has one (or white
    space other than blank and line feed) is cut only before each run.
    """
    if "\0" not in text:
        units = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        if "" not in units and " " not in units and not any(x in text for x in OTHER_SPACES):
            return units
    return BEFORE_SPACE.split(text) if text else []


OTHER_SPACES = [chr(x) for x in range(0x3001) if chr(x).isspace() and chr(x) not in " \n"]


def byte_letters() -> dict[int, str]:
    """The character that byte-level files write for each byte: printable Latin-1 as it is, the rest from U+0100 on."""
    out, more = {}, 0
    for byte in range(256):
        shown = 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174
        out[byte] = chr(byte if shown else 256 + more)
        more += not shown
    return out


BYTES = byte_letters()
