"""Encoding of whole texts by the tokenizers library through a bounded cache of pieces."""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa

#: Unicode White_Space, which the tokenizers' patterns mean by \s.
SPACE = "\t-\r \x85\xa0  -     　"
#: Cuts at places where both kinds of pre-tokenizer start a new token whatever stands around.
CUTS = {
    "bytes": re.compile(f"[{SPACE}]+(?![^{SPACE}])| ?[^{SPACE}]+|[{SPACE}]"),
    "words": re.compile(f"[^{SPACE}]+"),
}
#: What one generation of kept pieces may take (of words behind a space in single texts, and of all others), what an entry takes besides its characters, and the longest piece kept.
CACHE_BYTES, WORD_BYTES, ENTRY_BYTES, LONGEST_PIECE = 16 << 20, 48 << 20, 160, 64
#: Pieces whose tokens need no pattern of the library's: one run of letters, or of marks but the apostrophe.
INNER = {
    "bytes": re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[!-&(-/:-@\[-`{-~]+"),
    "words": re.compile(r"[a-zß-öø-ÿ]+|[!-&(-/:-@\[-`{-~]+"),
}


#: The first letter behind those of Latin-1, which no normal form changes; marks that often end a word.
LATIN_END, MARKS = "\u0100", ".,;:!?"
WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: How many bytes of texts are cut and looked up at once, and how many new words go to the library in one call.
WINDOW_BYTES, JOINED_WORDS = 2 << 20, 256


def bytes_of(*runs: str) -> np.ndarray:
    """Which of the 256 bytes are among the characters of ``runs``."""
    found = np.zeros(256, dtype=bool)
    found[list("".join(runs).encode("latin-1"))] = True
    return found


BREAKS, LINE, MARK = bytes_of(" \n", MARKS), ord("\n"), bytes_of(MARKS)
ASCII_SPACE = bytes_of("\t\n\v\f\r ")
ASCII_LETTER = np.array([b < 0x80 and chr(b).isalpha() for b in range(256)])
#: Bytes that begin no white space: ASCII that prints, and the lead byte of U+00C0 to U+00FF.
VISIBLE = np.array([0x20 < b < 0x7F or b == 0xC3 for b in range(256)])


def piece_starts(window: np.ndarray) -> np.ndarray:
    """Marks places in UTF-8 bytes before which both pre-tokenizers start a new token whatever stands around.

    These are a space or line feed behind anything but white space, a character behind such a line
    feed if it isn't white space, and one of MARKS behind a letter of ASCII or Latin-1. A place that
    can't be told by the three bytes before it is left out: its piece is only longer.
    """
    starts = np.zeros(len(window), dtype=bool)
    at = np.flatnonzero(BREAKS[window[1:]]) + 1
    one, two, three = window[at - 1], window[at - 2], window[at - 3]
    space = ~ASCII_SPACE[one] & (two != 0xC2) & ((three < 0xE1) | (three > 0xE3))  # lead bytes of all other white space
    letter = ASCII_LETTER[one] | ((two == 0xC3) & (one >= 0x80) & (one != 0x97) & (one != 0xB7))
    starts[at[np.where(MARK[window[at]], letter, space)]] = True
    lines = at[space & (window[at] == LINE)] + 1
    lines = lines[lines < len(window)]
    starts[lines[VISIBLE[window[lines]]]] = True
    return starts


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else the next from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


class Kept(dict):
    """Ids of pieces met before: at most two generations of ``limit`` bytes each.

    When the younger generation is full, the older one is let go; pieces of more than
    LONGEST_PIECE characters aren't kept. What is kept never changes an id.
    """

    def __init__(self, limit: int):
        self.old, self.bytes, self.limit = {}, 0, limit

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.made(piece)
        self.keep(piece, ids)
        return ids

    def keep(self, piece: str, ids: bytes) -> None:
        if len(piece) > LONGEST_PIECE:
            return
        cost = ENTRY_BYTES + 2 * len(piece) + len(ids)
        self.bytes += cost
        if self.bytes > self.limit:
            self.old = {}  # let go before the younger one is copied
            self.old, self.bytes = dict(self), cost
            self.clear()
        self[piece] = ids

    def made(self, piece: str) -> bytes:
        raise NotImplementedError


class PieceEncoder(Kept):
    """Maps a piece of text to the bytes of its ids (unsigned 32-bit, as the machine orders them: little-endian).

    A text is cut at white space, where the pre-tokenizer cuts it too, so the ids of a text are
    those of its pieces in a row. A piece that is all runs of Latin letters and marks is cut at
    their borders as well, and the library's model gets the runs; any other piece goes through
    the whole tokenizer.
    """

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        super().__init__(WORD_BYTES)
        self.tokenizer, self.cut, self.inner, self.kind = Tokenizer.from_file(path), CUTS[kind], INNER[kind], kind
        self.model, self.letters, self.after = self.tokenizer.model, byte_letters(), AfterSpace(self)
        self.border = self._border()

    def _border(self) -> int | None:
        """The id of byte 0 if the model never merges it with a neighbour, so that it can part words in one call."""
        vocabulary, letter = self.tokenizer.get_vocab(with_added_tokens=False), self.letters[0]
        if self.kind == "words" or self.model.end_of_word_suffix or self.model.continuing_subword_prefix or self.model.dropout:
            return None
        if any(x not in vocabulary for x in self.letters) or any(letter in x for x in vocabulary if x != letter):
            return None
        return vocabulary[letter]

    def made(self, piece: str) -> bytes:
        body = piece[1:] if piece[0] == " " else piece
        if body.isalpha() and max(body) < LATIN_END:
            return self._run(piece.lower() if self.kind == "words" else piece)
        if body[:-1].isalpha() and body[-1] in MARKS and (self.kind == "bytes" or max(body) < LATIN_END):
            return self[piece[:-1]] + self[piece[-1]]
        if "<|" not in piece:
            low = piece.lower() if self.kind == "words" else piece
            runs = self.inner.findall(low)
            if len(runs) == 1 and runs[0] == low:
                return self._run(low)
            if "".join(runs) == low:
                return b"".join([self[x] for x in runs])
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def _run(self, run: str) -> bytes:
        """The ids of one run of letters or marks, from the library's model alone."""
        word = run if run.isascii() and run[0] != " " else "".join(map(self.letters.__getitem__, run.encode()))
        return array("I", [x.id for x in self.model.tokenize(word)]).tobytes()

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts`` in a row (unsigned 32-bit), and where those of each text start, with their number at last.

        Null counts as empty. Texts are cut into pieces by ``piece_starts`` in windows of
        WINDOW_BYTES, across texts and within long ones; each different piece of a window is looked up once.
        """
        texts = texts.fill_null("").cast(pa.large_string())
        starts = np.frombuffer(texts.buffers()[1], dtype="<i8")[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype="<i8")
        raw, out = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8), []
        firsts, total, text = np.zeros(len(starts), dtype=np.int64), 0, 0
        at, end, size = int(starts[0]), int(starts[-1]), WINDOW_BYTES
        while at < end:
            to = min(at + size, end)
            mark = piece_starts(raw[at:to])
            mark[starts[text : np.searchsorted(starts, to)] - at] = True
            mark[0] = True
            bounds = np.flatnonzero(mark)
            if to < end:  # the last piece may go on
                if len(bounds) == 1:
                    size *= 2
                    continue
                to = at + int(bounds[-1])
            else:
                bounds = np.append(bounds, to - at)
            pieces = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype("<i4")), pa.py_buffer(raw[at:to])).dictionary_encode()
            ids = pa.array(self.look_up(pieces.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(pieces.indices)
            places = np.frombuffer(ids.buffers()[1], dtype="<i8")[: len(bounds)] // 4
            out.append(np.frombuffer(ids.buffers()[2] or b"", dtype="<u4")[: places[-1]])
            upto = int(np.searchsorted(starts, to))
            firsts[text:upto] = total + places[np.searchsorted(bounds, starts[text:upto] - at)]
            total += int(places[-1])
            at, text, size = to, upto, WINDOW_BYTES
        firsts[text:] = total
        return np.concatenate(out) if out else np.zeros(0, dtype="<u4"), firsts

    def look_up(self, pieces: list[str]) -> list[bytes]:
        """The ids of different pieces; new words go to the library's model many in a call, parted by a byte it never merges."""
        if self.kind == "words":
            pieces = [x.strip(" \n") or x for x in pieces]
        got = list(map(self.get, pieces))
        words = []
        for i in [i for i, ids in enumerate(got) if ids is None]:
            piece = pieces[i]
            ids = self.old.get(piece)
            if ids is None:
                if self.border is not None and WORD.fullmatch(piece):
                    words.append(i)
                    continue
                ids = self.encode(piece) if len(piece) > LONGEST_PIECE and "<|" not in piece else self.made(piece)
            got[i] = ids
            self.keep(piece, ids)
        for lo in range(0, len(words), JOINED_WORDS):
            some = words[lo : lo + JOINED_WORDS]
            joined = "\0".join([pieces[i] for i in some])
            ids = np.array([x.id for x in self.model.tokenize(joined.encode().decode("latin-1").translate(self.letters))], dtype="<u4")
            raw, at = ids.tobytes(), 0
            for i, to in zip(some, [*(4 * np.flatnonzero(ids == self.border)).tolist(), len(raw)], strict=True):
                got[i] = raw[at:to]
                at = to + 4
                self.keep(pieces[i], got[i])
        return got

    def encode(self, text: str) -> bytes:
        if self.kind == "words":
            # str.split() also cuts at U+001C to U+001F, which are no white space to the library.
            return b"".join(map(self.__getitem__, self.cut.findall(text) if ODD.search(text) else text.split()))
        lines = text.split("\n")
        words = [line.split(" ") for line in lines]
        if sum(map(len, words)) != len(text.split()) or text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
            return b"".join(map(self.__getitem__, self.cut.findall(text)))
        after = self.after.__getitem__
        return self["\n"].join([self[w[0]] + b"".join(map(after, w[1:])) for w in words])


class AfterSpace(Kept):
    """Maps a word to the ids of that word with a space before it."""

    def __init__(self, of: PieceEncoder):
        super().__init__(CACHE_BYTES)
        self.of = of

    def made(self, word: str) -> bytes:
        return self.of.made(" " + word)


ODD = re.compile("[\x1c-\x1f]")
_KEPT: dict[tuple[str, str], PieceEncoder] = {}


def encoder(path: str, kind: str) -> PieceEncoder:
    """One encoder for each worker process: workers serve many tasks."""
    if (path, kind) not in _KEPT:
        _KEPT[path, kind] = PieceEncoder(path, kind)
    return _KEPT[path, kind]
