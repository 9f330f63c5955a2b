"""Page furniture of scanned text (problem 4): running heads and page numbers, told by page-position features.

Candidate lines are scored by an averaged perceptron. It learns from chapters
that speak for themselves: heads that equal title or book but for planted
misreadings, page numbers in a long chain without rival, and the lines that
are neither. Page numbers must besides rise from start_page on, so they are
decoded as the best chain of scored lines.
"""

from __future__ import annotations

import difflib
import random
import re
from collections import defaultdict
from functools import lru_cache

#: Chapters that train the model, as expected by a share of hashed ids.
MAX_CHAPTERS = 1_500
#: What a page missing from a chain of page numbers costs, and a change of style isn't allowed.
_GAP = 0.3

#: Characters that scanners take for digits.
DIGIT_LIKE = {"O": "0", "o": "0", "l": "1", "I": "1", "i": "1", "|": "1", "Z": "2", "z": "2", "S": "5", "s": "5", "b": "6", "B": "8", "g": "9", "q": "9", "A": "4", "G": "6", "T": "7"}
_DIGITS = str.maketrans(DIGIT_LIKE)
_NUMBER = re.compile(r"\d+(?:[.,/:-]\d+)*")
_ROMAN = re.compile(r"(?=[ivxlcdm])m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
_FRAME = re.compile(r"^(p[a4][g9q6][e3c]|p\.|pp\.|seite)?\s*([\[(—–-]*)\s*([0-9A-Za-z|]{1,7})\s*([\])—–-]*)\s*$", re.I)
_DATA = re.compile(r"^\s*[-•]?\s*\d+(?:\.\d+)?\s*(?:bpm|ms|mm|mV|%)?\s*$")
_LABEL = re.compile(r"(?:chapter|section|part)\s*\S{0,5}", re.I)
_PREFIX = re.compile(r"^(?:chapter|section|part)\s+\S{1,5}\s*|^\S{0,3}\d\S{0,3}\s+(?=\D)|\s+\S{0,2}\d\S{0,2}$", re.I)
_PARTS = re.compile(r"\s*\|\s*|\s{2,}|\t")
_OTHER = re.compile(r"[^a-z0-9]")


def digits(text: str) -> str | None:
    """A number with its misread digits put right; None if the text is no number."""
    if not any(c.isdigit() for c in text):
        return None
    out = text.translate(_DIGITS)
    return out if _NUMBER.fullmatch(out) else None


def roman(text: str) -> int | None:
    low = text.lower()
    for form in {low.replace("1", "i").replace("|", "i"), low.replace("1", "l")}:
        if form and _ROMAN.fullmatch(form):
            values = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}[c] for c in form]
            return sum(-v if k + 1 < len(values) and values[k + 1] > v else v for k, v in enumerate(values))
    return None


def _bare(text: str) -> str:
    return _OTHER.sub("", text.lower())


@lru_cache(maxsize=4096)
def _trigrams(name: str) -> tuple[str, tuple[str, ...], int]:
    """(bare name, its three-letter parts, how many of them a line must hold to be as similar as 0.82 to it)."""
    b = _bare(name)
    return b, tuple(b[i : i + 3] for i in range(len(b) - 2)), max(1, int(0.46 * len(b) - 2))


def _may_hold(bare_line: str, name: str | None) -> bool:
    """Whether a line can hold a reading of the name; a substitution destroys three of its parts at most, so none is missed."""
    if not name:
        return False
    own, parts, least = _trigrams(name)
    if len(own) < 6:
        return own in bare_line if own else False
    return sum(p in bare_line for p in parts) >= least


def similarity(a: str, b: str) -> float:
    """Of two readings, signs and case aside; 0 for short names that differ."""
    a, b = _bare(a), _bare(b)
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if len(b) < 6 or abs(len(a) - len(b)) > 3:
        return 0.0
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def head_similarity(line: str, title: str | None, book: str | None) -> float:
    """How similar the names in a line are to title or book (the least similar counts), if it consists of these, chapter and page numbers alone; else 0."""
    bare_line = _bare(line)
    names = [n for n in (title, book) if _may_hold(bare_line, n)]
    if not names:
        return 0.0
    best = lambda p: max(similarity(p, n) for n in names)
    found = []
    for p in (p for p in _PARTS.split(line.strip("\x0c \t\r")) if p):
        v = best(p)
        if v < 0.9:
            v = max(v, best(_PREFIX.sub("", p).strip()))
        if v >= 0.5:
            found.append(v)
        elif (rest := _PREFIX.sub("", p).strip()) and not (digits(p) or roman(p) or _LABEL.fullmatch(p)):
            return 0.0
    return min(found, default=0.0)


def page_number(line: str) -> tuple[int, str] | None:
    """(number, style) of a line that is nothing but a page number."""
    m = _FRAME.match(line.strip())
    if not m or bool(m[2]) != bool(m[4]):
        return None
    style = ("page" if len(m[1] or "") == 4 else (m[1] or "").lower()) + m[2]
    d = digits(m[3])
    if d and d.isdigit():
        return int(d), style
    r = roman(m[3])
    return (r, style) if r is not None and not m[1] else None


def _surroundings(lines: list[str], k: int, heads: set[int]) -> list[str]:
    """Page-position features of a line: page ends, blank lines, heads and figures beside it."""
    around = [j for j in (k - 1, k + 1) if 0 <= j < len(lines)]
    feed = any(lines[j].startswith("\x0c") for j in (*around, k))
    near = [lines[j] for j in around if j not in heads]
    out = [f"feed:{feed}", f"edge:{len(around) < 2 or len(near) < len(around) or feed}", f"data:{any(_DATA.match(x) for x in near)}"]
    out += [f"blank:{sum(not x.strip() for x in near)}", f"head:{len(near) < len(around)}", f"cut:{bool(near) and near[0].rstrip()[-1:].isalpha()}"]
    return out + [f"{a}&{b}" for a, b in (out[1:3], out[2:4], (out[1], out[3]))]


class Furniture:
    """Averaged perceptron over page-position features of candidate lines."""

    def __init__(self):
        self.weights: dict[str, float] = {}

    def score(self, names: list[str]) -> float:
        w = self.weights
        return sum(w.get(n, 0.0) for n in names)

    @staticmethod
    def head_features(lines: list[str], k: int, sim: float) -> list[str]:
        return ["h:bias", *(f"h:sim>{t}" for t in (0.6, 0.7, 0.78, 0.82, 0.88, 0.94) if sim >= t), *(f"h:{n}" for n in _surroundings(lines, k, set()))]

    @staticmethod
    def number_features(lines: list[str], k: int, style: str, heads: set[int]) -> list[str]:
        return ["n:bias", f"n:style:{bool(style)}", f"n:last:{k == len(lines) - 1}", *(f"n:{n}" for n in _surroundings(lines, k, heads))]

    @staticmethod
    def _numbers(lines: list[str], first: int, last: int | None, skip: set[int]) -> list[tuple[int, int, str]]:
        top = last if last is not None and last >= first else None
        return [(k, *n) for k, x in enumerate(lines) if k not in skip and (n := page_number(x)) and first <= n[0] and (top is None or n[0] <= top)]

    @staticmethod
    def _chain(found: list[tuple[int, int, str]], first: int, value) -> tuple[float, list[int]]:
        """The rising chain of one style with the largest sum of values, less the gaps."""
        best: tuple[float, list[int]] = (0.0, [])
        for style in {s for *_, s in found}:
            chains: list[tuple[float, list[int], int]] = []
            for k, n, s in found:
                if s == style:
                    before = max((c for c in chains if c[2] < n), key=lambda c: c[0] - _GAP * (n - c[2] - 1), default=(0.5, [], first - 1))
                    if len(before[1]) == 0 or before[0] - _GAP * (n - before[2] - 1) < 0.5 - _GAP * (n - first):
                        before = (0.5, [], first - 1)
                    chains.append((before[0] + value(k, s) - _GAP * (n - before[2] - 1), [*before[1], k], n))
            top = max(chains, key=lambda c: c[0])
            best = max(best, (top[0] + (0.5 if style else 0), top[1]))
        return best

    def lines_of(self, lines: list[str], title: str | None, book: str | None, first: int | None, last: int | None) -> set[int]:
        """Numbers of the lines that are running heads or page numbers; the first line with text is the chapter's heading and never furniture."""
        head = next((k for k, x in enumerate(lines) if x.strip()), None)
        out = {k for k, x in enumerate(lines) if k != head and (sim := head_similarity(x, title, book)) and self.score(self.head_features(lines, k, sim)) > 0}
        if first is None:
            return out
        found = self._numbers(lines, first, last, {head, *out})
        if not found:
            return out
        return out | set(self._chain(found, first, lambda k, s: self.score(self.number_features(lines, k, s, out)))[1])

    def train(self, chapters: list[tuple], seed: int = 11, epochs: int = 6) -> Furniture:
        """Fit on chapters (text, title, book, first, last) that speak for themselves."""
        rng, examples = random.Random(seed), []
        swaps = [(v, k) for k, v in DIGIT_LIKE.items()] + [("m", "rn"), ("e", "c"), ("h", "b"), ("n", "u"), ("i", "l"), ("d", "cl")]
        for text, title, book, first, last in chapters:
            lines = text.split("\n")
            head = next((k for k, x in enumerate(lines) if x.strip()), None)
            sims = {k: v for k, x in enumerate(lines) if k != head and (v := head_similarity(x, title, book))}
            heads = {k for k, v in sims.items() if v == 1.0}
            for k in heads:
                examples.append((self.head_features(lines, k, 1.0), 1))
                worn = list(lines[k])  # the same head read wrongly in a few places
                for _ in range(rng.randrange(1, 4)):
                    a, b = rng.choice(swaps)
                    at = [i for i, c in enumerate(worn) if c == a]
                    if at:
                        worn[rng.choice(at)] = b
                if v := head_similarity("".join(worn), title, book):
                    examples.append((self.head_features(lines, k, v), 1))
            examples += [(self.head_features(lines, k, v), 0) for k, v in sims.items() if v < 0.75]
            if first is None:
                continue
            found = self._numbers(lines, first, last, {head, *heads})
            _, chain = self._chain(found, first, lambda *_: 1.0)
            rest = [f for f in found if f[0] not in chain]
            rival = len(self._chain(rest, first, lambda *_: 1.0)[1]) if rest else 0
            if len(chain) >= 3 and len(chain) >= rival + 2:
                examples += [(self.number_features(lines, k, s, heads), int(k in chain)) for k, _, s in found]
                inside = {k for k, *_ in found}
                examples += [(self.number_features(lines, k, n[1], heads), 0) for k, x in enumerate(lines) if k not in inside | heads | {head} and (n := page_number(x))]
        if not any(y for _, y in examples):  # nothing to learn from: similarity and the chain alone decide
            self.weights = {"h:bias": -1.0, "h:sim>0.82": 2.0, "n:bias": 1.0}
            return self
        w: dict[str, float] = defaultdict(float)
        total: dict[str, float] = defaultdict(float)
        stamp: dict[str, int] = defaultdict(int)
        step = 0
        for _ in range(epochs):
            rng.shuffle(examples)
            for names, y in examples:
                step += 1
                s = sum(w[n] for n in names)
                if (s <= 1) if y else (s > -1):
                    for n in names:
                        total[n] += (step - stamp[n]) * w[n]
                        stamp[n] = step
                        w[n] += 0.1 if y else -0.1
        self.weights = {n: (total[n] + (step - stamp[n]) * v) / step for n, v in w.items()}
        return self
