"""Token ids and token counts of whole texts, exactly as the tokenizers library gives them.

Both classes cut a text where the tokenizer's own pre-tokenizer always cuts, look the cuts up in
bounded caches of the Python worker and send only misses through the library's model. Texts that do
not meet a fast path's conditions take a slower path with the same result.
"""

from __future__ import annotations

import re
import string
from array import array
from itertools import chain

from tokenizers import Tokenizer, pre_tokenizers

from .common import worker_cache

#: Entries of a worker's caches before they start anew, some 200 bytes each; the longest text cut that they hold.
#: Both of ``WordIds`` have ``CUTS`` and hold the last full lot beside the new one, so frequent entries are not made again.
CUTS = 300_000
WORDS = 160_000
CACHE_CHARS = 64
#: Marks that may end a word and form one pre-token there.
_TAIL = ".,;:!?"
#: All such marks of a tokenizer whose pre-tokens are letters, a digit or a run of marks; an apostrophe may be more.
_MARKS = string.punctuation.replace("'", "")
_UNITS = re.compile(r"\s*\S+|\s+")
_BLANK = re.compile(r"[ \t\r\n]+")


def _byte_level() -> dict[int, str]:
    """The byte-level spelling of each Latin-1 character."""
    level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(256)}


class WordIds(dict):
    """Ids of whole texts for a tokenizer that lower-cases and drops white space.

    Its pre-tokens never cross white space, so a text's ids are those of its blank-separated chunks
    in turn. The dictionary maps chunks to ids as little-endian unsigned 32-bit bytes; behind it
    are words, so that a word with another mark is not encoded again.
    """

    def __init__(self, path: str):
        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.spelling = _byte_level()
        self.words: dict[str, bytes] = {}
        self.last: dict[str, bytes] = {}
        self.last_words: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        found = self.last.get(chunk)
        if found is None:
            core = chunk.rstrip(_MARKS)
            if not chunk:
                found = b""
            elif core.isalpha() and self._plain(core):
                found = self._word(core)
                if len(core) < len(chunk):
                    found += self._word(chunk[len(core):])
            else:
                found = array("I", self.library.encode(chunk, add_special_tokens=False).ids).tobytes()
            if len(chunk) > CACHE_CHARS:
                return found
        if len(self) >= CUTS:
            self.last = dict(self)
            self.clear()
        self[chunk] = found
        return found

    @staticmethod
    def _plain(core: str) -> bool:
        """Lower-case Latin-1: what the normalizer leaves as it is."""
        return core.islower() and (core.isascii() or max(core) < "Ā")

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            found = self.last_words.get(word)
            if found is None:
                spelt = word if word.isascii() else word.translate(self.spelling)
                found = array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
                if len(word) > CACHE_CHARS:
                    return found
            if len(self.words) >= CUTS:
                self.last_words, self.words = self.words, {}
            self.words[word] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids of ``text`` (null: none) as little-endian unsigned 32-bit bytes."""
        if not text:
            return b""
        if "<|" not in text:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                text = text.lower()
        if "\t" in text or "\r" in text:
            return b"".join(map(self.__getitem__, _BLANK.split(text)))
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


class TieredCounts(dict):
    """Token counts of whole texts for a byte-level tokenizer without a normalizer.

    The dictionary itself is the first tier: counts of frequent pre-token runs (a word with the
    blank before it and the marks after it), given ready-made. Misses go to a second, bounded tier
    of this worker and from there to the library's model.
    """

    def __init__(self, path: str, frequent: dict[str, int] | None = None):
        super().__init__(frequent or {})
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.spelling = _byte_level()
        self.cold: dict[str, int] = {}
        self.newline = self.run("\n")

    def __missing__(self, word: str) -> int:
        return self.run(" " + word)

    def run(self, unit: str) -> int:
        """Tokens of a run: white space, then no white space; either may be empty."""
        found = self.cold.get(unit)
        if found is None:
            found = self._encode(unit)
            if len(unit) <= CACHE_CHARS:
                if len(self.cold) >= WORDS:
                    self.cold.clear()
                self.cold[unit] = found
        return found

    def _encode(self, unit: str) -> int:
        blank, word = ("Ġ", unit[1:]) if unit[:1] == " " else ("", unit)
        core = word.rstrip(_TAIL)
        if core.isalpha() and (core.isascii() or max(core) < "Ā"):
            tail = word[len(core):]
            return len(self.model.tokenize(blank + core.translate(self.spelling))) + (len(self.model.tokenize(tail)) if tail else 0)
        return len(self.library.encode(unit, add_special_tokens=False).ids)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        words = text.split()
        if " ".join(words) != text.replace("\n", " "):
            return sum(map(self.run, _UNITS.findall(text)))
        # all white space is single blanks and single line ends
        lines = [x.split(" ") for x in text.split("\n")]
        heads = sum(self.run(x[0]) for x in lines)
        rest = chain.from_iterable(x[1:] for x in lines)
        return heads + sum(map(self.__getitem__, rest)) + self.newline * (len(lines) - 1)


def word_ids(path: str) -> WordIds:
    """This worker's encoder."""
    return worker_cache(("word ids", path), lambda: WordIds(path))
