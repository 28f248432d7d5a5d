"""Cutting text where no tokenizer of this folder can join what lies on either side, and caches of what pieces give.

The word patterns of byte-level tokenizers match left to right and look back at nothing. Between two visible
characters a single blank always begins a new match and a single line feed is a match of its own, so a text's tokens
are those of its pieces, one after the other. A piece starts with its blank.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable
from itertools import chain

#: Characters that count as visible here: printable ASCII and Latin letters, all known not to be white space.
_SEEN = "[!-~À-ÿ]"
_ODD = re.compile(rf"[ \n](?:(?<!{_SEEN}[ \n])|(?!{_SEEN}))|\x00")
_SAFE = re.compile(rf"(?<={_SEEN})(?=[ \n]{_SEEN})")


def pieces(text: str) -> list[str]:
    """The text in pieces whose tokens follow each other; their concatenation is the text."""
    if _ODD.search(text):
        return _SAFE.split(text)
    return text.replace("\n", "\x00\n\x00").replace(" ", "\x00 ").split("\x00")


#: What is neither ASCII nor a Latin letter of one code point, or may begin a special token.
_UNPLAIN = re.compile(r"[^\x00-\x7fÀ-ÖØ-öø-ÿ]|<\|")
#: Letters; other signs with an apostrophe and all that follows; other signs.
_RUNS = re.compile(r"[a-zß-öø-ÿ]+|[^a-zß-öø-ÿ']*'.*|[^a-zß-öø-ÿ']+", re.DOTALL)

#: ASCII signs other than the apostrophe that may stand behind a word.
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class WordCache(dict):
    """The ids, as little-endian 32-bit numbers, of blank-delimited words, for tokenizers of words; made when asked for.

    Such tokenizers lower-case, drop white space, and match runs of letters apart from other signs, but for what follows
    an apostrophe. So a word's runs of letters go to the model as they are, and the rest to the tokenizer. When `most`
    words are held, the cache starts anew, so memory has a bound.
    """

    def __init__(self, tok, most: int = 600_000):
        super().__init__()
        from tokenizers.pre_tokenizers import ByteLevel

        self.tok, self.model, self.most, self.signs = tok, tok.model, most, {}
        # bytes as the model names them, for the Latin letters of one code point
        name = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.names = {i: name(chr(i))[0][0] for i in range(0xDF, 0x100) if i != 0xF7}

    def whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def letters(self, run: str) -> bytes:
        # ASCII letters are named as they are
        return array("I", [t.id for t in self.model.tokenize(run if run.isascii() else run.translate(self.names))]).tobytes()

    def run(self, run: str) -> bytes:
        if run.isalpha():
            return self.letters(run)
        if run not in self.signs:
            if len(self.signs) >= self.most:
                self.signs.clear()
            self.signs[run] = self.whole(run)
        return self.signs[run]

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():
            ids = self.letters(word)
        elif (core := word.rstrip(_TAIL)).isalpha():
            ids = self[core] + self.run(word[len(core) :])
        else:
            ids = b"".join(map(self.run, _RUNS.findall(word)))
        if len(self) >= self.most:
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """The ids of a text. One of other letters than Latin ones, or that may hold special tokens, is encoded whole."""
        if "<|" in text or not text.isascii() and _UNPLAIN.search(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.lower().replace("\n", " ").split(" ")))


class PieceCache(dict):
    """What `make` gives for pieces, kept for the last `most` to 2 * most pieces of at most `longest` characters.

    When it is full, its pieces become the old generation; those that come again return from there, the rest goes with
    the next change of generation. So frequent pieces stay, and memory has a bound.
    """

    def __init__(self, make: Callable[[list[str]], Iterable], most: int = 400_000, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest
        self.old: dict = {}
        self.long: list[str] = []

    def fill(self, texts: list[list[str]]) -> None:
        """Makes what the pieces of these texts lack."""
        for p in self.long:
            del self[p]
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        lack = set(chain.from_iterable(texts)).difference(self)
        if self.old:
            back = lack.intersection(self.old)
            self.update({p: self.old[p] for p in back})
            lack -= back
        new = list(lack)
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            self.update(zip(some, self.make(some), strict=True))
        # long pieces seldom come again
        self.long = [p for p in new if len(p) > self.longest]

    def joined(self, pieces_of: list[str]) -> bytes:
        """The values of these pieces, one after the other; fill them first."""
        return b"".join(map(self.__getitem__, pieces_of))
