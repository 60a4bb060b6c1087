"""Tokenizing whole texts with the tokenizers library, each distinct chunk once per worker.

A text is cut only at places where the tokenizer's own pre-tokenizer must cut too, so the
ids of the chunks, joined, are the ids of the text. Chunks repeat far more often than texts
do; a bounded memo keeps their ids as bytes. A text that holds the content of one of the
vocabulary's added tokens goes through the library as a whole.
"""

from __future__ import annotations

import functools
import os
import re
from array import array

#: A space between two characters that are not white space always starts a new piece
#: under byte-level patterns of the form `` ?letters| ?digits| ?other|\s+(?!\S)|\s+``.
LEADING_SPACE = re.compile(r"(?<=\S)(?= \S)")
#: The patterns by which the two kinds of vocabulary cut a text.
PATTERNS = {
    "leading_space": r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",
    "dropped_space": r"""'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+""",
}

#: Separators that Python's split() takes for white space and the tokenizers do not.
SEPARATORS = "\x1c\x1d\x1e\x1f"


#: White space of Latin-1 besides the space itself.
OTHER_WHITE = "\t\n\x0b\x0c\r\x85\xa0"


def _separated(text: str) -> bool:
    return any(c in text for c in SEPARATORS)


class ChunkEncoder:
    """ids of whole texts through ``tokenizers``, memoised by chunk.

    ``style`` says where the vocabulary's pre-tokenizer is known to cut:
    ``leading_space`` (byte-level, the space stays with the word behind it) or
    ``dropped_space`` (white space separates and is dropped).
    ``memo_entries`` bounds the memo; beyond it the memo starts anew.
    """

    def __init__(self, path: str, style: str, memo_entries: int = 1_200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.style, self.limit = style, memo_entries
        self.lead = " " if style == "leading_space" else ""
        self.pieces = regex.compile(PATTERNS[style]).findall
        self.words: dict[str, bytes] = {}  # ids of words, with the space before them if it counts
        self.memo: dict[str, bytes] = {} if self.lead else self.words  # ids of pieces without one

    def _library(self, pieces: list[str], lead: str, into: dict[str, bytes]) -> None:
        for i in range(0, len(pieces), 4096):
            part = pieces[i : i + 4096]
            text = [lead + p for p in part] if lead else part
            for piece, enc in zip(part, self.tok.encode_batch_fast(text, add_special_tokens=False)):
                into[piece] = array("I", enc.ids).tobytes()

    def _learn(self, chunks: set[str]) -> None:
        """Learn words: cut by the pattern, of which plain words need no run, and compose."""
        words, memo, lead = self.words, self.memo, self.lead
        if len(words) + len(memo) + len(chunks) > self.limit:
            words.clear()
            memo.clear()
        new, rest, composed = [], set(), []
        seen = set()
        for c in chunks:
            if c.isalpha():
                new.append(c)
                continue
            if c[-1] in ".,!?:;" and (head := c[:-1]).isalpha():
                tail = (c[-1],)
            else:
                head, *tail = self.pieces(lead + c)
                head = head.removeprefix(lead)
                if not tail:
                    new.append(c)
                    continue
            composed.append((c, head, tail))
            if head not in words and head not in chunks and head not in seen:
                seen.add(head)
                new.append(head)
            for t in tail:
                if t not in memo:
                    rest.add(t)
        self._library(new, lead, words)
        self._library(list(rest), "", memo)
        for c, head, tail in composed:
            words[c] = words[head] + b"".join([memo[t] for t in tail])

    def _words(self, words: list[str]) -> bytes:
        """ids of words, each with the space before it if it counts."""
        known = self.words
        ids = list(map(known.get, words))
        if None in ids:
            new = [i for i, k in enumerate(ids) if k is None]
            self._learn({words[i] for i in new})
            for i in new:
                ids[i] = known[words[i]]
        return b"".join(ids)

    def _chunks(self, chunks: list[str]) -> bytes:
        """ids of chunks that aren't cut further."""
        if len(self.memo) + len(chunks) > self.limit:
            self.memo.clear()
        self._library(list({c for c in chunks if c not in self.memo}), "", self.memo)
        return b"".join([self.memo[c] for c in chunks])

    def _plain(self, text: str) -> bool:
        """Latin-1 without separators, where words are what lies between single spaces."""
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return False
        if _separated(text):
            return False
        if self.style == "dropped_space":
            return True
        return not (text[:1].isspace() or text[-1:].isspace() or "  " in text or any(c in text and (" " + c in text or c + " " in text) for c in OTHER_WHITE))

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; null is the empty text."""
        if not text:
            return b""
        if any(a in text for a in self.added):  # the library cuts at these before all else
            return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()
        if not self._plain(text):
            return self._chunks(LEADING_SPACE.split(text) if self.lead or _separated(text) else text.split())
        if self.style == "dropped_space":
            return self._words(text.lower().split())  # lower case as in the vocabulary's own normalizer
        head, *rest = text.split(" ")
        return self._chunks([head]) + self._words(rest)


@functools.lru_cache(maxsize=4)
def encoder(path: str, style: str, memo_entries: int = 1_200_000) -> ChunkEncoder:
    """One encoder per Python worker."""
    return ChunkEncoder(path, style, memo_entries)
