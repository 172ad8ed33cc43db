"""Word-level access to a public BPE vocabulary with word ends, as the ``tokenizers`` library encodes it.

Blanks are never part of a token there. Texts of plain Latin characters are split and encoded here, word by word, and words are
remembered; other texts go chunk by chunk between blanks, those chunks that are not plain to the library whole.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
from array import array

import regex

END = "</w>"
#: Fixed values of the vocabulary's file: how it splits text before merging.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Characters whose words are split and encoded here, and the blanks between them.
LATIN, GAPS = "!-~¡-¬®-įı-ɏ", " \n\t"
PLAIN = re.compile(f"[{GAPS}{LATIN}]*")
#: What the splitter takes for a blank: characters with the White_Space property.
BLANK = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))))
#: Chunks or words that are remembered at once.
REMEMBERED = 300_000


def plain_words(blanks: bool) -> re.Pattern:
    """The vocabulary's way to split lower-case text, for plain text only; with blanks as parts of their own or without."""
    chars = sorted({c.lower() for c in map(chr, range(0x250)) if PLAIN.fullmatch(c)})
    letters, numbers = (re.escape("".join(c for c in chars if unicodedata.category(c)[0] == kind)) for kind in "LN")
    return re.compile(f"[{letters}]+|[{numbers}]|'(?:[stmd]|re|ve|ll)|[^{GAPS}{letters}{numbers}]+" + (f"|[{GAPS}]" if blanks else ""))


class Memo(dict):
    """A dictionary that makes what it lacks. What fills it goes out in halves, so that what is asked for again and again stays."""

    def __init__(self, make, size=REMEMBERED):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        if 2 * len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def chunks(text: str) -> list[str]:
    return text.replace("\n", " ").replace("\t", " ").split(" ")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies, by the published rule."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer, models

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        # special strings stand apart in the text as it comes, before anything is normalised
        self.special = re.compile("|".join(re.escape(t["content"]) for t in file["added_tokens"]) or r"(?!)")
        self.words, self.parts = plain_words(False).findall, plain_words(True).findall
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.closed = self.library.model
        self.open = models.BPE(model["vocab"], merges)  # the same merges for words that go on
        self.tokens = {t.removesuffix(END) for t in model["vocab"]}
        self.longest = max(map(len, self.tokens))
        self.letters = byte_letters()
        self.word_ids = Memo(self._word_ids)
        self.chunk_ids = Memo(self._chunk_ids)
        self.meets = Memo(self._meets)
        self.word_steps = Memo(self._word_steps)
        self.chunk_steps = Memo(self._chunk_steps)
        self.path = ("", [""], [0], [])  # the states of the last word that was counted

    def remember(self, texts: list[str]) -> None:
        """Count the words of a batch of texts in order, so that each can go on from where the one before branches off."""
        words = set()
        for text in texts:
            if self._plain(text):
                words.update(self.parts(text.lower()))
        words.difference_update(self.word_steps)
        for word in sorted(words):
            self.word_steps[word]

    def _plain(self, text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and "<|" not in text

    # ids

    def ids(self, text: str) -> bytes:
        """The ids of the whole text as little-endian unsigned 32-bit numbers."""
        if self._plain(text):
            return b"".join(map(self.word_ids.__getitem__, self.words(text.lower())))
        return b"".join(map(self.chunk_ids.__getitem__, chunks(text)))

    def _symbols(self, word: str) -> str:
        return word if word.isascii() else "".join([self.letters[b] for b in word.encode()])

    def _word_ids(self, word: str) -> bytes:
        return array("I", [t.id for t in self.closed.tokenize(self._symbols(word))]).tobytes()

    def _chunk_ids(self, chunk: str) -> bytes:
        if self._plain(chunk):
            return b"".join(map(self.word_ids.__getitem__, self.words(chunk.lower())))
        return array("I", self.library.encode(chunk, add_special_tokens=False).ids).tobytes()

    # counts of all prefixes

    def prefix_counts(self, text: str):
        """Token counts of text[:0], text[:1], ... up to the whole text, as a numpy array."""
        import numpy as np

        if self._plain(text):
            steps = b"".join(map(self.word_steps.__getitem__, self.parts(text.lower())))
        else:
            steps = b"".join(map(self.chunk_steps.__getitem__, chunks(text)))
        steps = np.frombuffer(steps, dtype=np.int16)
        counts = np.zeros(len(text) + 1, np.int32)
        np.cumsum(steps[: len(text)], dtype=np.int32, out=counts[1:])
        return counts

    def _meets(self, pair: tuple[str, str]) -> int:
        """Does BPE leave u and t apart, each whole? 1: where the word goes on after t, 2: where it ends there (3: both)."""
        u, t = pair
        apart = [x for x in pair if x]
        go_on = [x.value for x in self.open.tokenize(u + t)] == apart
        ends = [x.value for x in self.closed.tokenize(u + t)] == [*apart[:-1], t + END]
        return go_on + 2 * ends

    def _word_counts(self, word: str) -> list[int]:
        """Token counts of word[:1], word[:2], ..., each as a whole word.

        A dynamic programme over the word's bytes. A sequence of tokens is what BPE yields just when each neighbouring
        pair is what BPE yields for the pair, so the last token of a prefix is the one that meets the last token
        of the prefix before it. Open prefixes (words that go on) carry the state, closed ones (words that end) the answer.
        """
        symbols, tokens, meets, longest = self._symbols(word), self.tokens, self.meets, self.longest
        before, last, count, closed = self.path
        same = len(os.path.commonprefix((before, symbols)))
        del last[same + 1:], count[same + 1:], closed[same:]
        self.path = (symbols[:same], last, count, closed)
        for i in range(same + 1, len(symbols) + 1):
            wanted = 3
            for k in range(i - longest if i > longest else 0, i):
                t = symbols[k:i]
                if t in tokens and (found := meets[last[k], t] & wanted):
                    n = count[k] + 1
                    if found & 1:
                        own, own_n = t, n
                    if found & 2:
                        closed.append(n)
                    wanted -= found
                    if not wanted:
                        break
            if wanted & 2:
                closed.append(0)  # inside a character: no word ends here
            if wanted & 1:
                raise ValueError("the vocabulary lacks a byte")
            last.append(own)
            count.append(own_n)
        self.path = (symbols, last, count, closed)
        if word.isascii():
            return closed
        ends, at = [], 0
        for c in word:
            at += len(c.encode())
            ends.append(closed[at - 1])
        return ends

    def _word_steps(self, word: str) -> bytes:
        if word in GAPS:
            return GAP
        if word in ("'re", "'ve", "'ll"):  # cut after two characters, these are two words
            first = self._word_counts("'")[0]
            return _steps([first, first + self._word_counts(word[1])[0], self._word_counts(word)[2]])
        return _steps(self._word_counts(word))

    def _chunk_steps(self, chunk: str) -> bytes:
        """What each character of the chunk, and the blank after it, adds to the count."""
        if self._plain(chunk):
            return b"".join(map(self.word_steps.__getitem__, self.parts(chunk.lower()))) + GAP
        whole = len(self.chunk_ids[chunk]) // 4
        if "<|" not in chunk and self._stable(chunk):
            steps = b"".join(map(self.word_steps.__getitem__, SPLIT.findall("".join([c.lower() for c in chunk]))))
            if len(steps) == 2 * len(chunk) and sum(array("h", steps)) == whole:
                return steps + GAP
        counts = self._ragged_counts(chunk)
        if counts[-1:] != [whole]:  # the library knows the characters otherwise than Python does
            counts = [len(e.ids) for e in self.library.encode_batch([chunk[:k] for k in range(1, len(chunk) + 1)], add_special_tokens=False)]
        return _steps(counts) + GAP

    # counts of all prefixes where a longer prefix changes characters before its end

    def _ragged_counts(self, chunk: str) -> list[int]:
        """Token counts of chunk[:1], chunk[:2], ... of any chunk.

        Between two characters that no normal form joins, the text so far stays as it is. So a state (tokens of finished words, the
        open word) is carried over such places, and only what stands since the last one is normalised and added anew for
        each prefix: one character as a rule, a letter with its marks else. A special string is plain text until it is complete.
        """
        counts, at = [], 0
        for found in [*self.special.finditer(chunk), None]:
            part = chunk[at:found.end() if found else len(chunk)]
            state, total, first = (0, "", None, 0, ""), counts[-1] if counts else 0, 0
            plain_end = total
            for k in range(1, len(part) + 1):
                new = self._with(state, unicodedata.normalize("NFC", part[first:k]))
                counts.append(total + new[0] + new[3])
                if found and k == found.start() - at:
                    plain_end = counts[-1]
                if k < len(part) and not _joins(part[k]):
                    state, first = new, k
            if found:
                counts[-1], at = plain_end + 1, found.end()
        return counts

    def _with(self, state: tuple, text: str) -> tuple:
        """The state after more normalised text: (tokens of finished words, kind of the open word, its DP, its tokens if it ends here,
        the open word with the apostrophe before it where both may yet be one of 's 't 're 've 'm 'll 'd)."""
        done, kind, word, n, short = state
        for c in "".join([c.lower() for c in text]):
            own = "B" if c in BLANK else unicodedata.category(c)[0]
            own = own if own in "BLN" else "O"
            if short and short + c in ("'s", "'t", "'m", "'d", "'re", "'ve", "'ll"):
                done -= self._word_counts("'")[0] if len(short) == 2 else 0
                done, kind, word, n, short = done + self._word_counts(short + c)[-1], "", None, 0, ""
                continue
            follows = kind == own and own in "LO"
            short = short + c if short == "'" and own == "L" and c in "rvl" else "'" if c == "'" and not follows else ""
            if not follows:
                done, word, n = done + n, ("", [""], [0]), 0
            kind = own
            if own != "B":
                word, n = self._longer(word, [self.letters[b] for b in c.encode()])
        return done, kind, word, n, short

    def _longer(self, word: tuple, symbols: list[str]) -> tuple:
        """A word with more symbols, and its tokens if it ends there. A word: its last symbols, as many as a token can have, and the
        last token and count of the open prefixes before, between and after them."""
        recent, last, count = word[0], [*word[1]], [*word[2]]
        for symbol in symbols:
            recent += symbol
            wanted = 3
            for k in range(len(recent)):
                t = recent[k:]
                if t in self.tokens and (found := self.meets[last[k], t] & wanted):
                    n = count[k] + 1
                    if found & 1:
                        own, own_n = t, n
                    if found & 2:
                        closed = n
                    wanted -= found
                    if not wanted:
                        break
            if wanted & 1:
                raise ValueError("the vocabulary lacks a byte")
            if wanted & 2:
                closed = 0  # inside a character: no word ends here
            last.append(own)
            count.append(own_n)
            if len(recent) >= self.longest:
                recent = recent[1:]
                del last[0], count[0]
        return (recent, last, count), closed

    @staticmethod
    def _stable(chunk: str) -> bool:
        """Every prefix is its own normal form, and no character is a blank."""
        return unicodedata.is_normalized("NFC", chunk) and not any(
            unicodedata.combining(c) or unicodedata.category(c)[0] in "MZC" or "ᄀ" <= c <= "ᇿ" for c in chunk)


GAP = array("h", [0]).tobytes()


@functools.cache
def _second_letters() -> frozenset[str]:
    """Characters that some canonical composition takes as its second one."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    return frozenset(chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][0] != "<")


def _joins(c: str) -> bool:
    """May a normal form join the character to what stands before it?"""
    return unicodedata.combining(c) > 0 or "ᅡ" <= c <= "ᇂ" or c in _second_letters()


def _steps(counts: list[int]) -> bytes:
    return array("h", [b - a for a, b in zip([0, *counts], counts)]).tobytes()


@functools.lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    """One per worker process."""
    return WordBpe(path)
