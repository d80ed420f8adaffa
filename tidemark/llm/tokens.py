"""Exact token ids of whole texts, by the tokenizers library with reuse of what was met before.

A text is cut only where the tokenizer's own splitting rule always cuts, so the ids of the
pieces, one after another, are the ids of the text. Ids of a piece are looked up in a bounded
table of the Python worker and encoded by the library when it isn't there.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
TABLE = 500_000
"""Pieces kept by a worker; beyond it only those met again stay."""
GROUP = 512
"""New words that are encoded as one text."""
MARKS = ".,;:!?"
JOIN = "\0"
"""Starts a piece that follows the one before without a space."""


def pieces_of(text: str, keep_space: bool) -> list[str]:
    """Pieces of a text: words, marks and line breaks that follow them. A text must not hold JOIN."""
    text = (text[1:] if keep_space and text[:1] == " " else JOIN + text) + " "
    text = text.replace("\n", f" {JOIN}\n {JOIN}" if keep_space else " ")
    if not any(m + m + " " in text for m in MARKS):  # a run of marks is one token
        for m in MARKS:
            text = text.replace(m + " ", f" {JOIN}{m} ")
    out = text.split(" ")
    out.pop()
    return out


class Encoder(dict):
    """Ids of texts by a tokenizer file. keep_space: byte-level rules, which bind a space to what
    follows; else rules that drop white space and case. A dict from pieces to their numbers.

    Cuts are safe at a single space between other characters, and before a mark or line break after
    a letter or digit. A text with any other cut is encoded whole, and so is one that holds an added
    token of the file. plain: added tokens in a text are ordinary text.
    """

    most = TABLE

    def __init__(self, path: str, keep_space: bool, plain: bool = False):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keep_space = keep_space
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.new: list[str] = []
        self.ids = np.zeros(1 << 18, np.uint32)
        self.used = 0
        self.start, self.size, self.met = (np.zeros(1 << 16, np.int64) for _ in range(3))
        # unsafe at its ends; ends in a sign; a mark cut off the piece before
        self.bad, self.tail, self.lead = (np.zeros(1 << 16, bool) for _ in range(3))

    def shrink(self, least: int = 3) -> None:
        """Keeps the pieces met at least so often; in a corpus most pieces are met once."""
        stay = np.flatnonzero(self.met[: len(self)] >= least)
        if len(stay) > self.most // 2:
            self.clear()
            return
        names = list(self)
        names = [names[i] for i in stay]
        size = self.size[stay]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(self.start[stay] - (ends - size), size) + np.arange(size.sum())]
        kept = {n: getattr(self, n)[stay] for n in ("met", "bad", "tail", "lead")}
        self.clear()
        self.update(zip(names, range(len(names)), strict=True))
        for n, a in kept.items():
            setattr(self, n, self._grown(getattr(self, n), len(stay)))
            getattr(self, n)[: len(stay)] = a
        self.start, self.size = (self._grown(a, len(stay)) for a in (self.start, self.size))
        self._put(np.arange(len(stay)), size, ids)
        self.met[: len(stay)] = 0

    def __missing__(self, piece: str) -> int:
        i = self[piece] = len(self)
        self.new.append(piece)
        return i

    def _grown(self, a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])

    def _learn(self) -> None:
        new, self.new = self.new, []
        for name in ("start", "size", "met", "bad", "tail", "lead"):
            setattr(self, name, self._grown(getattr(self, name), len(self)))
        first = len(self) - len(new)  # pieces are numbered as they come
        letters = np.fromiter(map(str.isalpha, new), bool, len(new))
        plain, rest = np.flatnonzero(letters).tolist(), np.flatnonzero(~letters).tolist()
        for lo in range(0, len(plain), GROUP):
            part = plain[lo : lo + GROUP]
            # letters alone are one word of the tokenizer each, so many can be encoded as one text
            e = self.tokenizer.encode(" " + " ".join([new[k] for k in part]), add_special_tokens=False)
            size = np.bincount(np.array(e.word_ids, np.int64), minlength=len(part))
            if len(size) == len(part) and size.all():
                self._put(np.array(part) + first, size, np.array(e.ids, np.uint32))
            else:
                rest += part
        for lo in range(0, len(rest), GROUP):
            part = rest[lo : lo + GROUP]
            texts = [p[1:] if p[:1] == JOIN else " " + p if self.keep_space else p for p in (new[k] for k in part)]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            size = np.fromiter(map(len, found), np.int64, len(found))
            self._put(np.array(part) + first, size, np.fromiter((x for f in found for x in f), np.uint32, int(size.sum())))
        for i in rest:
            p, k = new[i], first + i
            b, line = p[1:] if p[:1] == JOIN else p, p == JOIN + "\n"
            if not b:
                self.bad[k] = self.keep_space
                continue
            if not b[-1].isalnum():
                self.tail[k] = True
                self.lead[k] = p[:1] == JOIN and b in MARKS
            if self.keep_space and not line and (b[0].isspace() or b[-1].isspace()):
                self.bad[k] = True

    def _put(self, at: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        self.ids = self._grown(self.ids, self.used + len(ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[at], self.size[at] = self.used + np.cumsum(size) - size, size
        self.used += len(ids)

    def _pieces(self, text: str) -> list[str] | None:
        if JOIN in text or any(t in text for t in self.added):
            return None
        if not self.keep_space:
            try:
                text.encode("latin-1")  # where lower case is a character for a character
                text = text.lower()
            except UnicodeEncodeError:
                pass
            if any(t in text for t in self.added):  # only in lower case, so it isn't the token
                return None
        return pieces_of(text, self.keep_space)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """One uint32 array for each text."""
        if len(self) > self.most:
            self.shrink()
        places: list[np.ndarray | None] = []
        for text in texts:
            pieces = self._pieces(text)
            places.append(None if pieces is None else np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces)))
        if self.new:
            self._learn()
        some = [at for at in places if at is not None]
        if some:
            self.met[: len(self)] += np.bincount(np.concatenate(some), minlength=len(self))
        out = []
        for text, at in zip(texts, places, strict=True):
            if at is None or self.bad[at].any() or (self.tail[at[:-1]] & self.lead[at[1:]]).any():
                out.append(np.array(self._whole(text), np.uint32))
                continue
            size = self.size[at]
            ends = np.cumsum(size)
            out.append(self.ids[np.repeat(self.start[at] - (ends - size), size) + np.arange(ends[-1])])
        return out


class PieceEncoder(Encoder):
    """Ids of texts by a sentencepiece model whose merges never cross a space or a line break.

    That holds where no piece has a space after another character, nor a line break at all; it is checked.
    Other texts, and those that hold U+2581 or spaces that follow each other or end a text, are encoded whole.
    """

    def __init__(self, path: str):
        dict.__init__(self)
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.cuts = not any("\n" in n or "\u2581" in n.lstrip("\u2581") for n in names)
        self.added = []
        self.clear()

    def _learn(self) -> None:
        new, self.new = self.new, []
        for name in ("start", "size", "met", "bad", "tail", "lead"):
            setattr(self, name, self._grown(getattr(self, name), len(self)))
        first = len(self) - len(new)
        # a line break follows without the space that the model puts before a text
        found = [e[1:] if w[0] == "\n" else e for w, e in zip(new, self.model.encode(new, num_threads=1), strict=True)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        self._put(np.arange(len(new)) + first, size, np.fromiter((x for f in found for x in f), np.uint32, int(size.sum())))

    def _pieces(self, text: str) -> list[str] | None:
        pieces = text.replace("\n", " \n").split(" ")
        return None if not self.cuts or "" in pieces or "\u2581" in text else pieces

    def _whole(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


@lru_cache(maxsize=4)
def encoder(path: str, keep_space: bool) -> Encoder:
    """The worker's encoder of a file; its table serves all tasks of the worker."""
    return Encoder(path, keep_space)


@lru_cache(maxsize=2)
def plain_encoders(byte_level: str, pieces: str, most: int) -> tuple[Encoder, PieceEncoder]:
    """The worker's encoders of a byte-level file, added tokens as ordinary text, and of a sentencepiece model."""
    a, b = Encoder(byte_level, True, plain=True), PieceEncoder(pieces)
    a.most = b.most = most
    return a, b
