"""Candidate spans of personal data in one text, their features, and a boosted-tree model of them.

Base spans follow fixed patterns. Generators of high recall propose more spans, which may overlap; each
has features of its format and of its surroundings. All scans are linear in the text, whatever it holds.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np

from .quality import isotonic

# Kinds in the order of spans with one start.
KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


class Span(NamedTuple):
    start: int
    kind: int
    end: int


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ to both sides: what stands before it can't hold another, so nothing is scanned twice."""
    end, at = 0, text.find("@")
    while at >= 0:
        start, after = at, at + 1
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = after = m.end()
        at = text.find("@", after)


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def ips(text: str) -> Iterator[tuple[int, int]]:
    """A chain of dotted numbers is cut in fours from its start."""
    for m in _CHAIN.finditer(text):
        if "." in m[0]:
            parts, at = m[0].split("."), m.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                size = sum(map(len, four)) + 3
                if all(map(_octet, four)):
                    yield at, at + size
                at += size + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = digits_of(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 10 <= len(digits_of(m[0])) <= 15:
            yield m.span()


def base_spans(text: str) -> list[Span]:
    """Spans by the fixed patterns, by start and kind."""
    out = [Span(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for kind, found in ((1, ips), (2, cards), (3, phones)):
            out += [Span(s, kind, e) for s, e in found(text)]
    return sorted(out)


# Generators: wide patterns of each kind. Repeats are bounded or possessive.
_WIDE = (
    (0, re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: ?[(\[{]at[)\]}] ?|(?: @ ?| ?@ ))[A-Za-z0-9-]{1,63}(?:(?:\.| ?[(\[{]dot[)\]}] ?| dot )[A-Za-z0-9-]{1,63}){1,8}", re.I)),
    (0, re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} at [A-Za-z0-9-]{1,63}(?:(?:\.| ?[(\[{]dot[)\]}] ?| dot )[A-Za-z0-9-]{1,63}){1,8}", re.I)),
    (1, re.compile(r"(?<![0-9.\[])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\])[0-9]{1,3}){3}(?![0-9.])")),
    (1, re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}(?::?[0-9A-Fa-f]{1,4}){1,4}(?![0-9A-Za-z:])")),
    (2, re.compile(r"(?<![0-9])[0-9]{3,6}(?:[ ./_-]{0,2}[0-9]{3,6}){2,5}(?![0-9])")),
    (3, re.compile(r"(?<![0-9+])(?:\+|00)?(?:[0-9]{1,4}[ ./-])?\(?[0-9]{2,5}\)?[ ./-]{0,2}[0-9]{2,5}(?:[ ./-][0-9]{2,5}){0,3}(?![0-9])")),
)
_AT_HINT = re.compile(r"(?i)@| at |[(\[{]at[)\]}]")
# Words before or after a span that speak for or against a kind.
_CUES = (
    ("email", "mail", "e-mail", "contact", "write", "courriel", "correo"), ("ip", "host", "server", "address", "login", "client"),
    ("card", "visa", "credit", "debit", "payment", "karte", "carte", "tarjeta"), ("phone", "tel", "call", "mobile", "fax", "telefon", "cell", "whatsapp"),
    ("order", "invoice", "isbn", "issn", "version", "page", "item", "part", "no", "number", "id", "token", "ref", "doi", "released", "since", "between", "price", "total"),
)
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
NEAR = 32
"""Characters on either side of a span that its features look at."""


def candidates(text: str) -> Iterator[Span]:
    """Spans that the wide patterns propose; they may overlap each other and base spans."""
    some_digit, some_at = _DIGIT.search(text), _AT_HINT.search(text)
    for kind, pattern in _WIDE:
        if some_at if kind == 0 else some_digit:
            for m in pattern.finditer(text):
                if kind != 2 or 13 <= len(digits_of(m[0])) <= 19:
                    if kind != 3 or 7 <= len(digits_of(m[0])) <= 15:
                        yield Span(m.start(), kind, m.end())


def features(text: str, span: Span) -> list[float]:
    """Format and context of one candidate."""
    s, before, after = text[span.start : span.end], text[max(0, span.start - NEAR) : span.start], text[span.end : span.end + NEAR]
    digits = digits_of(s)
    groups = re.findall("[0-9]+", s)
    seps = [c for c in s if not c.isalnum()]
    numbers = [min(int(g), 10**6) for g in groups[:8] if len(g) < 20]
    words = [w.lower() for w in _WORD.findall(before)][-4:]
    later = [w.lower() for w in _WORD.findall(after)][:2]
    left, right = before[-1:], after[:1]
    return [
        *(float(span.kind == k) for k in range(4)), len(s), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        len(seps), len(set(seps)), float("(" in s), float(s[:1] == "+" or s[:2] == "00"), float(s[:1] == "0"), float("." in s), float("-" in s), float(":" in s), float("/" in s),
        float(len(digits) > 12 and luhn(digits)), float(bool(numbers) and max(numbers) <= 255), float(len(groups) == 3 and len(groups[0]) == 4 and 1900 <= numbers[0] <= 2100 if groups and numbers else 0),
        float(bool(re.search(r"(?i)[(\[{](?:at|dot)[)\]}]", s))), float(" at " in s.lower()), float(" dot " in s.lower()), float("@" in s), float(len(s.rsplit(".", 1)[-1]) in (2, 3)),
        *(float(any(w in cue for w in words)) for cue in _CUES), *(float(any(w in cue for w in later)) for cue in _CUES),
        float(left.isalpha()), float(right.isalpha()), float(left in ("", " ", "\n")), float(right in ("", " ", "\n", ".", ",")), float(left in "=\"'#$€£" and left != ""), len(digits_of(before)), len(digits_of(after)),
        float(len(set(digits)) if digits else 0), float(sum(c.isalpha() for c in s)),
    ]


class Trees:
    """Gradient boosting of shallow trees on binned features, logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.2, least: float = 1.0, bins: int = 32):
        self.rate, self.trees = rate, []
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(mean / (1 - mean)))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
        f = np.full(len(y), self.start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            tree: dict[int, tuple] = {}
            leaf = np.ones(len(y), np.int64)  # nodes are numbered as in a heap
            for node in range(1, 1 << depth):
                own = np.flatnonzero(leaf == node)
                best = self._split(binned[own], grad[own], hess[own], cuts, least) if len(own) else None
                if best:
                    column, cut = best
                    tree[node] = (column, cuts[column][cut])
                    leaf[own] = 2 * node + (binned[own, column] > cut)
            values = {}
            for node in np.unique(leaf).tolist():
                own = leaf == node
                values[node] = rate * grad[own].sum() / (hess[own].sum() + least)
                f[own] += values[node]
            self.trees.append((tree, values))

    @staticmethod
    def _split(binned: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray], least: float) -> tuple[int, int] | None:
        g_all, h_all, best, gain = grad.sum(), hess.sum(), None, 1e-6
        for k, own in enumerate(cuts):
            n = len(own) + 1
            if n > 1:
                g, h = (np.cumsum(np.bincount(binned[:, k], weights=w, minlength=n))[:-1] for w in (grad, hess))
                ok = (h > 1e-3) & (h_all - h > 1e-3)
                score = np.where(ok, g**2 / (h + least) + (g_all - g) ** 2 / (h_all - h + least) - g_all**2 / (h_all + least), 0)
                at = int(score.argmax())
                if score[at] > gain:
                    best, gain = (k, at), score[at]
        return best

    def raw(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.start)
        for tree, values in self.trees:
            leaf = np.ones(len(x), np.int64)
            for node, (column, cut) in tree.items():  # from the root down
                own = leaf == node
                leaf[own] = 2 * node + (x[own, column] > cut)
            f += np.array([values.get(n, 0.0) for n in range(int(leaf.max(initial=1)) + 1)])[leaf]
        return f


PRECISION = 0.99
"""Share of a kind's selected spans that held-out examples must bear out."""


class Model(NamedTuple):
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]
    thresholds: np.ndarray

    def chance(self, x: np.ndarray) -> np.ndarray:
        """Calibrated chance that a candidate is what its kind says."""
        return np.clip(np.interp(self.trees.raw(x), *self.knots), 0, 1) if len(x) else np.zeros(0)


def _example(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A generated text and its spans (start, kind, end) beyond the fixed patterns; half of the texts have none."""
    syllables = ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve")

    def word() -> str:
        return "".join(rng.choices(syllables, k=rng.randint(1, 4)))

    def prose(n: int) -> str:
        return " ".join(word() + rng.choice(("", "", "", ",", ".")) for _ in range(n))

    def num(n: int) -> str:
        return "".join(rng.choices("0123456789", k=n))

    def valid(n: int) -> str:
        body = num(n - 1)
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))

    def grouped(d: str, sep: str, sizes: list[int]) -> str:
        out, at = [], 0
        for s in sizes:
            out.append(d[at : at + s])
            at += s
        return sep.join(out)

    host = f"{word()}{rng.randint(0, 9)}"
    end = rng.choice(("com", "org", "net", "de", "fr", "es", "io"))
    octets = [str(rng.randint(0, 255)) for _ in range(4)]
    cue = lambda k: rng.choice(_CUES[k]) + rng.choice((": ", " ", " no. ", ". ")) if rng.random() < 0.8 else ""
    other = lambda: rng.choice(_CUES[4]) + rng.choice((" ", ": ", " #")) if rng.random() < 0.6 else ""
    kind = rng.choice((0, 1, 2, 3, None, None, None, None))
    if kind == 0:
        name = word() + rng.choice(("", ".", "_")) + word()
        lead, span = cue(0), name + rng.choice((f" [at] {host}.{end}", f"(at){host}.{end}", f" (at) {host} (dot) {end}", f" at {host} dot {end}", f" [at] {host} [dot] {end}", f" @ {host}.{end}"))
    elif kind == 1:
        v6 = ":".join(f"{rng.randint(0, 65535):x}" for _ in range(8))
        lead, span = cue(1), rng.choice(("[.]".join(octets), "(.)".join(octets), "[dot]".join(octets), v6))
    elif kind == 2:
        d = valid(rng.choice((16, 16, 15, 13)))
        sizes = {16: [4, 4, 4, 4], 15: [4, 6, 5], 13: [4, 3, 3, 3]}[len(d)]
        lead, span = cue(2) or "card ", grouped(d, rng.choice((".", "/", "  ", "_")), sizes)
    elif kind == 3:
        lead, span = cue(3), rng.choice((f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"00{rng.randint(1, 99)} {num(3)} {num(7)}", f"0{num(3)}/{num(7)}", f"0{num(2)} {num(4)} {num(4)}"))
        if "(" not in span and not lead:
            lead = "tel "
    else:
        lead = other()
        span = rng.choice(
            (
                f"{rng.randint(1900, 2100)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", f"{rng.randint(1900, 2020)}-{rng.randint(1900, 2020)}", f"{num(3)}-{num(1)}-{num(2)}-{num(6)}-{num(1)}", num(rng.randint(7, 19)), f"{num(3)} {num(3)} {num(4)} {num(3)}",
                f"{rng.randint(1, 20)}.{rng.randint(0, 30)}.{rng.randint(0, 99)}", f"{rng.randint(1, 9)}.{num(3)}.{num(3)},{num(2)}", f"{num(2)}:{num(2)}:{num(2)}", f"{num(2)}:{num(2)}:{num(2)}:{num(2)}:{num(2)}:{num(2)}", f"{word()} at {word()} {word()}", f"{word()} at {word()}.{word()}",
                f"{word()} @ {word()}", f"{num(4)}-{num(4)}-{num(4)}-{num(4)}", f"{num(4)}.{num(4)}.{num(4)}.{num(4)}", f"{num(3)}-{num(4)}", f"{num(5)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"{num(3)}-{num(3)}-{num(4)}",
                "".join(rng.choices("0123456789abcdef", k=40)), f"{num(2)}/{num(2)}/{num(4)} {num(2)}:{num(2)}", f"{num(4)} {num(4)} {num(4)}", f"10.{num(4)}/{num(7)}", f"p. {num(3)}-{num(3)}, {num(4)}",
            )
        )
    left = prose(rng.randint(0, 8))
    left += " " if left else ""
    start = len(left) + len(lead)
    text = left + lead + span + rng.choice((" ", ". ", ", ", "\n")) + prose(rng.randint(0, 8))
    return text, [(start, kind, start + len(span))] if kind is not None else []


EXAMPLES = 12_000
"""Generated texts that the trees and their calibration are fitted on; the tables have no labelled spans."""


def examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of the candidates of n generated texts that no base span touches, and whether each is a span."""
    rng, rows, good = random.Random(seed), [], []
    for _ in range(n):
        text, spans = _example(rng)
        base = base_spans(text)
        for c in candidates(text):
            if not any(b.start < c.end and c.start < b.end for b in base):
                rows.append(features(text, c))
                good.append(float((c.start, c.kind, c.end) in spans))
    return np.array(rows), np.array(good)


@lru_cache(maxsize=1)
def trained() -> Model:
    """Trees on two thirds of the examples, calibration and thresholds on the rest."""
    trees = Trees(*examples(EXAMPLES * 2 // 3, 1))
    x, y = examples(EXAMPLES // 3, 2)
    raw = trees.raw(x)
    order = np.argsort(raw, kind="stable")
    knots = isotonic(raw[order], y[order], np.ones(len(y)))
    chance = np.clip(np.interp(raw, *knots), 0, 1)
    thresholds = np.full(len(KINDS), 1.1)
    for k in range(len(KINDS)):
        own = np.flatnonzero(x[:, k] == 1)
        own = own[np.argsort(-chance[own], kind="stable")]
        share = np.cumsum(y[own]) / np.arange(1, len(own) + 1)
        good = np.flatnonzero(share >= PRECISION)
        if len(good):
            thresholds[k] = max(0.9, chance[own[good[-1]]])
    return Model(trees, knots, thresholds)


def added_spans(text: str, base: list[Span], model: Model) -> list[Span]:
    """Candidates that the model selects: none that touches a base span; of those that overlap, the likeliest, then the first."""
    starts, ends = [], []  # of the parts of the text that base spans cover
    for b in base:
        if ends and b.start <= ends[-1]:
            ends[-1] = max(ends[-1], b.end)
        else:
            starts.append(b.start)
            ends.append(b.end)
    inside = [c for c in candidates(text) if bisect_left(starts, c.end) == bisect_right(ends, c.start)]
    if not inside:
        return []
    chance = model.chance(np.array([features(text, c) for c in inside]))
    likely = sorted((-p, c) for p, c in zip(chance.tolist(), inside, strict=True) if p >= model.thresholds[c.kind])
    return _apart([c for _, c in likely])


def _apart(spans: list[Span]) -> list[Span]:
    """Greedily those that overlap none taken before."""
    out: list[Span] = []
    for c in spans:
        at = bisect_left(out, Span(c.end, -1, 0))
        if not at or out[at - 1].end <= c.start:
            insort(out, c)
    return out
