"""Problem 9: texts cut off by field limits or in transfer.

Intact sentences and lines are cut artificially to make positives; hashed
logistic regression learns from closing characters and words, punctuation and
the distance to a field limit, then scores every record. Known words, usual
last lines, the fit, limits and shares all come from all documents.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.skew import lookup_join
from lattica.session import release, staged

#: Examples a document gives, of each kind.
EXAMPLES = 4
BITS = 20
#: Bits of the table of known words, 2 MB whatever the texts.
KNOWN_BITS = 24
#: Rounds of the fit, each one pass over all examples (more where a step was too long), steps it remembers, and the weight of its penalty.
ROUNDS, MEMORY, PENALTY = 20, 6, 0.1
#: Documents whose examples make one block of the staged features.
BLOCK = 1_000
#: Places whose sums travel as one row, and tasks up to which the driver adds them itself.
CHUNK, FEW_TASKS = 1 << 16, 16
#: Probability above which a record counts as cut.
THRESHOLD = 0.3

_SPACE = re.compile(r"[\s​‌‍⁠﻿\x00-\x1f]+")
_BLANK = "".join(c for c in map(chr, range(0x3001)) if c.isspace() or c < " ") + "​‌‍⁠﻿"
#: What exporters put after a cut.
_MARKER = re.compile(r"(?:\s*(?:\[\s*(?:\.\.\.|…|cut|truncated|more|abgeschnitten|suite)\s*\]|\(\s*(?:\.\.\.|…|cut|truncated|more|continued)\s*\)|\.{2,}|…+|�+|<\s*cut\s*>|>>+|-{2,}|&hellip;|[|~]))+\s*$", re.I)
_TOKEN = re.compile(r"[㐀-鿿]|[^\W\d_㐀-鿿]+|\d+|[^\w\s]")
#: The same in ASCII, where plain sets are faster.
_ASCII_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[!-/:-@\[-^`{-~\x00-\x08\x0e-\x1b\x7f]")
_WORD = re.compile(r"[^\W\d_㐀-鿿]+")
#: ASCII letters made small, all else white space.
_LETTERS = bytes(ord(chr(k).lower()) if k < 128 and chr(k).isalpha() else 32 for k in range(256))
#: A stop begins behind its mark, if it has one.
_STOP = re.compile(r"[.!?。！？\n](?:(?<=[.!?])[\"'”’»)\]]*\s+(?=[^\sa-z])|(?<=[。！？])|(?<=\n)\s*|(?<=[a-zé%0-9][.!?])(?=[A-Z]))")
_FINAL = ".!?。！？"


def closing(text: str) -> tuple[str, str, str]:
    """(core, mark, marker): a text without its final mark, that mark (R for a reference like [12]), and what was put after a cut."""
    t = text.rstrip(_BLANK)
    marker = mark = ""
    # a marker ends in one of these signs, a lone point isn't one
    if t[-1:] in "])>.…�-;|~" and (t[-1:] != "." or t.endswith("..")) and (m := _MARKER.search(t)) and m.start() > 0:
        marker, t = re.sub(r"\s+", "", m.group())[:8], t[: m.start()].rstrip()
    if t.endswith("]") and re.fullmatch(r"\[\d{1,4}\]", t[t.rfind("[") :]):
        mark, t = "R", t[: t.rfind("[")].rstrip()
    while t and t[-1] in _FINAL:
        mark, t = mark or t[-1], t[:-1]
    return t, mark, marker


def _stops(text: str) -> tuple[list[int], list[int]]:
    """Where the stops of a text begin, behind their marks, and where they end."""
    found = [m.span() for m in _STOP.finditer(text)]
    return [a + (text[a] != "\n") for a, _ in found], [b for _, b in found]


def _last_sentence(core: str) -> str:
    """What follows the last stop of a text that anything follows; read from the end in windows that grow until they hold it."""
    size = 400
    while True:
        part = core[-size:]
        behind = [m.end() for m in _STOP.finditer(part) if m.end() < len(part)]
        if behind or size >= len(core):
            return part[behind[-1] :] if behind else part
        size *= 4


def _tokens(text: str) -> list[str]:
    return (_ASCII_TOKEN if text.isascii() else _TOKEN).findall(text)


class _Codes(dict):
    """Numbers of words: a hash, digits alike, and, in the lowest bit, whether a word is short and in small letters. Starts anew when full, as texts hold any number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = code = zlib.crc32(b"9" if word.isdecimal() else word.encode("utf-8", "replace")) << 1 | (len(word) <= 8 and (word.islower() or word in ",:"))
        return code


class _Places(dict):
    """Places of words in the table of known words, bounded like _Codes."""

    def __missing__(self, word: str | bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = place = zlib.crc32(word if isinstance(word, bytes) else word.lower().encode("utf-8", "replace")) >> (32 - KNOWN_BITS)
        return place


_codes, _places = _Codes(), _Places()


def inner_words(text: str) -> set[bytes] | set[str]:
    """A text's words, in small letters, but one that ends it, which may be cut; of a text in ASCII as bytes."""
    if text.isascii():
        low = text.rstrip().encode().translate(_LETTERS)
        words: list = low.split()
        if words and low[-1:] != b" ":
            words.pop()
        return set(words)
    words = _WORD.findall(text)
    if words and text.rstrip().endswith(words[-1]):
        words.pop()
    return set(map(str.lower, words))


def is_known(known: np.ndarray, word: str | bytes) -> bool:
    """Whether the bit of a word is set in a table of known words."""
    at = _places[word]
    return bool(known[at >> 3] >> (at & 7) & 1)


def _mixed(name: str, *parts: np.ndarray) -> np.ndarray:
    """Places of features: hashes of a name and of numbers, row by row."""
    h = np.full(len(parts[0]), zlib.crc32(name.encode()) * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return (h * np.uint64(0xC4CEB9FE1A85EC53) >> np.uint64(64 - BITS)).astype(np.int32)


def _limit_rows(limit: np.ndarray, has: np.ndarray) -> list[np.ndarray]:
    return [_mixed("lim", limit), _mixed("lim:", limit, has)]


_PLACE_OF_BIAS = int(_mixed("bias", np.zeros(1))[0])
#: The place whose weight is 0: features that a closing lacks.
NONE = 1 << BITS


class Places:
    """Hashed features of closings: `fixed` has a row for each kind of feature and a column for each closing, `own` and `more` are the closing and place of each further one."""

    def __init__(self, fixed: np.ndarray, own: np.ndarray, more: np.ndarray, names: np.ndarray | None = None):
        self.fixed, self.own, self.more = fixed, own, more
        #: places by number if `fixed` and `more` number them, which keeps sums of a block within a small table
        self.names = names

    def numbered(self) -> Places:
        if self.names is not None:
            return self
        names, at = np.unique(np.concatenate([self.fixed.ravel(), self.more]), return_inverse=True)
        return Places(at[: self.fixed.size].reshape(self.fixed.shape), self.own, at[self.fixed.size :], names)

    def sums(self, w: np.ndarray) -> np.ndarray:
        """The summed weights of each closing; `w` ends with the 0 of NONE."""
        w = w if self.names is None else w.take(self.names)
        return w.take(self.fixed).sum(axis=0) + np.bincount(self.own, w.take(self.more), self.fixed.shape[1])

    def slopes(self, w: np.ndarray | None, labels: np.ndarray, into: np.ndarray | None = None) -> np.ndarray:
        """For minimum(), added to `into`: sums of the gradient by place and the loss in NONE, or how many closings have a place."""
        own, into = self.numbered(), np.zeros(NONE + 1) if into is None else into
        values = np.ones(len(labels))
        loss = 0.0
        if w is not None:
            z = own.sums(w)
            small = np.exp(-np.abs(z))
            loss = float((np.maximum(z, 0) + np.log1p(small) - labels * z).sum())
            values = np.where(z >= 0, 1, small) / (1 + small) - labels
        g = np.bincount(np.concatenate([own.fixed.ravel(), own.more]), np.concatenate([*[values] * len(own.fixed), values.take(own.own)]), len(own.names))
        if own.names[-1] == NONE:
            g[-1] = 0
        into[own.names] += g
        into[NONE] += loss
        return into

    def packed(self, labels: np.ndarray) -> tuple[int, bytes]:
        """Size and compressed bytes of the block and its labels, for unpacked()."""
        block = self.numbered()
        kind = np.uint16 if len(block.names) <= 1 << 16 else np.uint32
        head = np.array([len(block.names), *block.fixed.shape, len(block.own), kind().itemsize], np.int32)
        # the further features come in two lists with the same closings
        counts = np.bincount(block.own[: len(block.own) // 2], minlength=len(labels))
        parts = (head, np.diff(block.names, prepend=0).astype(np.int32), counts.astype(np.int32), block.fixed.astype(kind), block.more.astype(kind), labels.astype(np.int8))
        data = b"".join(p.tobytes() for p in parts)
        return len(data), pa.compress(data, codec="zstd", asbytes=True)

    @staticmethod
    def unpacked(size: int, data: bytes) -> tuple[Places, np.ndarray]:
        raw = pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True)
        names, kinds, count, more, width = np.frombuffer(raw, np.int32, 5).tolist()
        kind, at = (np.uint16 if width == 2 else np.uint32), 20
        out = []
        for n, t in ((names, np.int32), (count, np.int32), (kinds * count, kind), (more, kind), (count, np.int8)):
            out.append(np.frombuffer(raw, t, n, at))
            at += out[-1].nbytes
        own = np.repeat(np.arange(count), out[1])
        return Places(out[2].reshape(kinds, count), np.concatenate([own, own]), out[3], np.cumsum(out[0], dtype=np.int64)), out[4].astype(np.float64)


def places(closings: list[tuple[str, str, str, str, bool | None]], known: np.ndarray | None = None) -> Places:
    """Hashed features of closings (last sentence, core, mark, marker, at_limit): last words and characters, how the sentence began, marks, whether the length is a limit (None leaves that out), and whether other texts hold the last word."""
    count, flat, sizes, whole, cjk, ends = len(closings), [], [], [], [], []
    for sentence, core, *_ in closings:
        words = _tokens(sentence)
        flat += map(_codes.__getitem__, words)
        sizes.append(len(words))
        last = words[-1] if words else ""
        whole.append(known is None or len(last) < 2 or not last.isalpha() or is_known(known, last))
        cjk.append("㐀" <= last[:1] <= "鿿")
        tail = core[-8:]
        if not (tail.isascii() and tail.isprintable() and "  " not in tail):
            tail = _SPACE.sub(" ", tail)
        ends.append(tail[-5:].rjust(5, "\0") + core[-3:].rjust(3, "\0"))
    chars = np.frombuffer("".join(ends).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(count, 8)
    codes, n = np.array([*flat, 0], np.uint64), np.array(sizes, np.int64)
    stop = np.cumsum(n)
    start = stop - n
    final = [np.where(n >= k, codes[np.maximum(stop - k, 0)], 0) for k in (1, 2, 3, 4)]
    first = [np.where(n > k, codes[np.minimum(start + k, len(codes) - 1)], 0) for k in (0, 1, 2, 3)]
    mark, marker = np.array([ord(c[2]) if c[2] else 0 for c in closings], np.int64), np.array([zlib.crc32(c[3].encode("utf-8", "replace")) if c[3] else 0 for c in closings], np.int64)
    has, cjk, part, head, last = mark > 0, np.array(cjk, bool), ~np.array(whole, bool), first[:2], final[0]
    rows = [_mixed("bias", has & False), _mixed("m", mark), _mixed("k", marker), _mixed("n", np.minimum(n, 12)), _mixed("c1", chars[:, 7]), _mixed("c3", *chars[:, 5:].T), _mixed("c5", *chars[:, :5].T), _mixed("km", marker > 0, has)]
    rows += [np.where((n >= k) & (cjk | (k < 4)), _mixed(f"w{k}", *final[:k]), NONE) for k in (1, 2, 3, 4)]
    rows += [_mixed("h1", first[0], last), _mixed("h2", *head, last), _mixed("h2b", *head, *final[:2]), _mixed("h2n", *head, np.minimum(n, 30)), np.where(cjk, _mixed("h4", *first, *final[:2]), NONE)]
    rows += [_mixed("last", has, last), np.where(part, _mixed("part", has), NONE), np.where(part, _mixed("part of", n > 2), NONE)]
    if count and closings[0][4] is not None:
        rows += _limit_rows(np.array([c[4] for c in closings], bool), has)
    # short words within the sentence, each once
    at, own = np.arange(len(flat)) - np.repeat(start, n), np.repeat(np.arange(count), n)
    small = np.unique(own[chosen] << 33 | codes[:-1][chosen].astype(np.int64)) if (chosen := (codes[:-1] & np.uint64(1) > 0) & (at >= 2) & (at < np.repeat(n, n) - 1)).any() else np.zeros(0, np.int64)
    own, word = small >> 33, small & ((1 << 33) - 1)
    return Places(np.array(rows, np.int32), np.concatenate([own, own]).astype(np.int32), np.concatenate([_mixed("s", word, last[own]), _mixed("hs", head[0][own], head[1][own], word)]))


def features(core: str, mark: str, marker: str, at_limit: bool, known: np.ndarray | None = None) -> list[int]:
    """places() of one closing."""
    found = places([(_last_sentence(core), core, mark, marker, at_limit)], known)
    return [int(k) for k in (*found.fixed[:, 0], *found.more) if k != NONE]


def _complete(text: str, end: int) -> int:
    """`end` moved back over white space and final marks."""
    while end > 0 and (text[end - 1].isspace() or text[end - 1] in _FINAL):
        end -= 1
    return end


def _cuts(text: str, seed: int, each: int) -> Iterator[tuple[str, str, str, str, bool, int]]:
    """examples(), each after the last sentence of its core."""
    rng = random.Random(seed)
    body = text.rstrip()
    stops, behind = _stops(body)

    def sentence(core: str) -> str:
        k = bisect_left(behind, len(core))  # the stops that anything follows
        return core[behind[k - 1] if k else 0 :]

    ends = stops + ([len(body)] if body[-1:] in _FINAL else [])
    for e in rng.sample(ends, min(each, len(ends))):
        core, mark, marker = closing(body[:e])
        if core:
            kept = (mark if rng.random() < 0.85 else "R") if rng.random() < 0.65 else ""
            yield sentence(core), core, kept, "", rng.random() < (0.12 if kept else 0.02), 0
    full = {_complete(body, e) for e in ends}
    if stops and len(body) > 20:
        for _ in range(each):
            at = rng.randrange(8, max(9, stops[-1]))
            core, mark, marker = closing(body[:at])
            if not core or mark or marker:
                continue
            label = 0 if _complete(body, at) in full else 1
            put = rng.choice(("", "", "", "", "", "...", "…", "[...]")) if label else ""
            yield sentence(core), core, "", put, rng.random() < 0.5, label
    if stops and (core := own_end(body)):
        yield sentence(core), core, "", "", False, -1


def examples(text: str, seed: int, each: int = EXAMPLES) -> list[tuple[str, str, str, bool, int]]:
    """Artificial closings of a text (core, mark, marker, at_limit, label): cuts within sentences are 1, ends of sentences and lines 0.

    The text's own end counts as one if it closes with a final mark; another
    end of its own comes out with label -1, for usual_ends() to judge.
    """
    return [r[1:] for r in _cuts(text, seed, each)]


def own_end(body: str) -> str:
    """A text (without white space behind) that has stops but ends with neither mark nor marker, else nothing."""
    if body[-1:] in _FINAL or not _STOP.search(body):
        return ""
    core, mark, marker = closing(body)
    return "" if mark or marker else core


def _line(core: str) -> str:
    """The last line of a text, digits alike."""
    return re.sub(r"\d+", "9", _SPACE.sub(" ", core.rsplit("\n", 1)[-1]).strip())


def usual_lines(lines: list[str]) -> set[str]:
    """Last lines that often end different texts, and more often than longer lines beginning with them; cut lines are beginnings of longer ones."""
    counts = Counter(lines)
    longer: Counter = Counter()
    for key, n in counts.items():
        for k in range(1, len(key)):
            if key[:k] in counts:
                longer[key[:k]] += n
    return {k for k, n in counts.items() if n >= 3 and n > longer[k]}


def usual_ends(rows: list[tuple[str, str, str, bool, int]]) -> list[tuple[str, str, str, bool, int]]:
    """The examples with judged own ends: usual last lines are complete, other own ends are dropped."""
    usual = usual_lines([_line(core) for core in {r[0] for r in rows if r[4] < 0}])
    return [r for r in rows if r[4] >= 0] + [(*r[:4], 0) for r in rows if r[4] < 0 and _line(r[0]) in usual]


def fit(rows: list[tuple[str, str, str, bool, int]]) -> np.ndarray:
    """Weights of closings (core, mark, marker, at_limit, label) held in memory."""
    if not rows:
        return minimum(lambda w: None)
    found, labels = places([(_last_sentence(r[0]), *r[:4]) for r in rows]), np.array([r[4] for r in rows], np.float64)
    return minimum(lambda w: found.slopes(w, labels))


def minimum(slopes: Callable[[np.ndarray | None], np.ndarray | None]) -> np.ndarray:
    """Weights of the logistic regression with a quadratic penalty, by quasi-Newton steps (L-BFGS) over whole sums, so that they depend on no order of examples.

    `slopes(w)` gives the summed gradient, place by place, and in the place
    NONE the loss; `slopes(None)` how many examples have each place, or None
    without examples, when nothing shall count as cut.
    """
    counts = slopes(None)
    w = np.zeros(NONE + 1)
    if counts is None:
        w[_PLACE_OF_BIAS] = -5.0
        return w
    used = np.flatnonzero(counts[:NONE])

    def at(x: np.ndarray) -> tuple[float, np.ndarray]:
        w[used] = x
        g = slopes(w)
        return float(g[NONE] + PENALTY / 2 * (x @ x)), g[used] + PENALTY * x

    scale = 1 / (0.6 * counts[used] + PENALTY)
    x = np.zeros(len(used))
    loss, g = at(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(ROUNDS):
        step, taken = g.copy(), []
        for dx, dg, r in reversed(past):
            taken.append(r * (dx @ step))
            step -= taken[-1] * dg
        step *= scale
        if past:
            dx, dg, _ = past[-1]
            step *= (dx @ dg) / (dg @ (scale * dg))
        for (dx, dg, r), a in zip(past, reversed(taken), strict=True):
            step += dx * (a - r * (dg @ step))
        size, slope = 1.0, g @ step
        while True:
            there = x - size * step
            lower, turned = at(there)
            if lower <= loss - 1e-4 * size * slope or size < 1e-4:
                break
            size *= 0.4
        if lower > loss:
            break
        dx, dg = there - x, turned - g
        if dx @ dg > 1e-12:
            past = [*past, (dx, dg, 1 / (dx @ dg))][-MEMORY:]
        small = loss - lower < 1e-3 * loss
        x, loss, g = there, lower, turned
        if small:
            break
    w[used] = x
    return w


def scores(w: np.ndarray, texts: list[str | None], known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities that the texts were cut, if their length is no field limit and if it is one; 0 for null and blank texts and such without letters."""
    ends = [closing(t or "") for t in texts]
    kept = [k for k, (core, _, _) in enumerate(ends) if any(map(str.isalpha, core))]
    p = np.zeros((2, len(texts)))
    if kept:
        z = places([(_last_sentence(ends[k][0]), *ends[k], None) for k in kept], known).sums(w)
        has = np.array([bool(ends[k][1]) for k in kept])
        for limit in (False, True):
            p[int(limit), kept] = 1 / (1 + np.exp(-np.clip(z + sum(w[row] for row in _limit_rows(np.full(len(kept), limit), has)), -30, 30)))
    return p[0], p[1]


def score(w: np.ndarray, text: str | None, at_limit: bool) -> float:
    """Probability that the text was cut."""
    return float(scores(w, [text])[at_limit][0])


def field_limits(lengths: DataFrame) -> DataFrame:
    """(source, length): lengths at which a source's texts pile up, counted over all rows (source, length).

    A length counts if it holds at least five texts and ten times the mean of its source's lengths.
    """
    own = lengths.filter("length > 0").groupBy(F.coalesce("source", F.lit("")).alias("source"), "length").agg(F.count("*").alias("n"))
    mean = own.groupBy("source").agg(F.avg("n").alias("mean"))
    return own.join(mean, "source").filter("n >= 5 and n >= 10 * mean").select("source", "length")


def _keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all beginnings of each line, of one character first and the whole line last, one line after another, and where each line's whole is. No line may be empty."""
    n = np.array([len(x) for x in lines], np.int64)
    stop = np.cumsum(n)
    chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    at = (np.arange(len(chars)) - np.repeat(stop - n, n) + 1).astype(np.uint64)
    h = chars * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ h >> np.uint64(32)) * (at * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))
    total = np.cumsum(h, dtype=np.uint64)
    h = total - np.repeat((total - h)[stop - n], n)
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xC4CEB9FE1A85EC53) + at
    return (h ^ h >> np.uint64(29)).view(np.int64), stop - 1


def _holds(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys a sorted table holds."""
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys if len(table) else np.zeros(len(keys), bool)


def _numbers(df: DataFrame) -> np.ndarray:
    """A column of numbers, sorted, on the driver."""
    return np.sort(df.toArrow().column(0).to_numpy())


def gathered(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(table of known words, sorted keys of usual last lines) over all (h, text).

    A word is known if at least two texts hold it, so that a text's own last
    word is judged by others. Usual lines are those of usual_lines(); lines
    stay where they are, only keys of theirs travel. The driver gets the table,
    2 MB, and 8 bytes for each line that ends three texts or more.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(1 << KNOWN_BITS, bool), np.zeros(1 << KNOWN_BITS, bool)
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.int64(), pa.int64())
        names = ["chunk", "once", "twice", "line", "key", "text"]
        for batch in batches:
            seen: Counter = Counter()
            lines = []
            for t in batch.column(1).to_pylist():
                seen.update(inner_words(t))
                if core := own_end(t.rstrip()):
                    lines.append((_line(core), int.from_bytes(blake2b(core.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)))
            at, back = np.unique(np.fromiter(map(_places.__getitem__, seen), np.int64, len(seen)), return_inverse=True)
            n = np.bincount(back, np.fromiter(seen.values(), np.float64, len(seen)), len(at))
            twice[at[(n > 1) | once[at]]] = True
            once[at] = True
            lines = [r for r in dict.fromkeys(lines) if r[0]]
            keys, last = _keys([line for line, _ in lines])
            cols = ([None] * len(lines),) * 3 + ([line for line, _ in lines], keys[last], [text for _, text in lines])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)
        once, twice = np.packbits(once, bitorder="little"), np.packbits(twice, bitorder="little")
        for k in range(0, len(once), CHUNK // 8):
            a, b = once[k : k + CHUNK // 8], twice[k : k + CHUNK // 8]
            if a.any():
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((k // (CHUNK // 8), a.tobytes(), b.tobytes(), None, None, None), kinds, strict=True)], names)

    def merge(part: pa.Table) -> pa.Table:
        once, twice = np.zeros(CHUNK // 8, np.uint8), np.zeros(CHUNK // 8, np.uint8)
        for a, b in zip(part.column("once").to_pylist(), part.column("twice").to_pylist(), strict=True):
            a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
            twice |= b | (once & a)
            once |= a
        return pa.table({"chunk": part.column("chunk")[:1], "bits": pa.array([twice.tobytes()], pa.binary())})

    rows = staged(texts.mapInArrow(read, "chunk int, once binary, twice binary, line string, key bigint, text bigint"), "ends")
    known = np.zeros(1 << KNOWN_BITS - 3, np.uint8)
    for r in rows.filter("chunk is not null").select("chunk", "once", "twice").groupBy("chunk").applyInArrow(merge, "chunk int, bits binary").toArrow().to_pylist():
        known[r["chunk"] * CHUNK // 8 :][: CHUNK // 8] = np.frombuffer(r["bits"], np.uint8)
    lines = rows.filter("chunk is null").select("line", "key", "text")
    often = lines.groupBy("key").agg(F.count_distinct("text").alias("n")).filter("n >= 3")
    shared = texts.sparkSession.sparkContext.broadcast(_numbers(often.select("key")))

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, last = _keys(batch.column(0).to_pylist())
            found = _holds(shared.value, keys)
            found[last] = False
            own = np.repeat(np.arange(len(last)), np.diff(last, prepend=-1))[found]
            yield pa.RecordBatch.from_arrays([pa.array(keys[found]), batch.column(1).take(pa.array(own)), batch.column(2).take(pa.array(own))], ["key", "own", "text"])

    longer = lines.mapInArrow(begun, "key bigint, own bigint, text bigint").groupBy("key").agg(F.count_distinct("own", "text").alias("longer"))
    usual = _numbers(often.join(longer, "key", "left").filter("n > coalesce(longer, 0)").select("key"))
    release(rows)
    return known, usual


def train(documents: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Weights, and the table of known words, from all documents.

    Examples are made and hashed where the texts lie and staged as blocks of
    feature numbers; each round of the fit is one pass over the blocks, whose
    tasks give sums of fixed size.
    """
    spark = documents.sparkSession
    texts = documents.filter("text is not null").select(F.xxhash64("doc_id").alias("h"), F.col("text").cast("string"))
    known, usual = gathered(texts)
    shared = spark.sparkContext.broadcast((known, usual))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, usual = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                part = batch.slice(k, BLOCK)
                rows = [r for h, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for r in _cuts(t, h, EXAMPLES)]
                ends = [(k, line) for k, r in enumerate(rows) if r[5] < 0 and (line := _line(r[1]))]
                keys, last = _keys([line for _, line in ends])
                judged = {k for (k, _), ok in zip(ends, _holds(usual, keys[last]), strict=True) if ok}
                rows = [r for k, r in enumerate(rows) if r[5] >= 0 or k in judged]
                if rows:
                    size, data = places([r[:5] for r in rows], known).packed(np.array([max(r[5], 0) for r in rows]))
                    yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([data], pa.binary())], ["size", "data"])

    blocks = staged(texts.mapInArrow(make, "size int, data binary"), "blocks")
    tasks = blocks.rdd.getNumPartitions()

    def add(part: pa.Table) -> pa.Table:
        return pa.table({"chunk": part.column("chunk")[:1], "sums": pa.array([sum(np.frombuffer(x, np.float32).astype(np.float64) for x in part.column("sums").to_pylist()).astype(np.float32).tobytes()], pa.binary())})

    def slopes(w: np.ndarray | None) -> np.ndarray | None:
        weights = spark.sparkContext.broadcast(None if w is None else w.astype(np.float32))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, total = weights.value, np.zeros(NONE + 1)
            w = None if w is None else w.astype(np.float64)
            for batch in batches:
                for size, data in zip(*batch.columns, strict=True):
                    block, labels = Places.unpacked(size.as_py(), data.as_buffer())
                    block.slopes(w, labels, total)
            chunks = [(k, total[k : k + CHUNK].astype(np.float32)) for k in range(0, NONE + 1, CHUNK)]
            chunks = [(k, c.tobytes()) for k, c in chunks if c.any()]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in chunks], pa.int32()), pa.array([c for _, c in chunks], pa.binary())], ["chunk", "sums"])

        sums = blocks.mapInArrow(run, "chunk int, sums binary")
        if tasks > FEW_TASKS:
            sums = sums.groupBy("chunk").applyInArrow(add, "chunk int, sums binary")
        total = np.zeros(NONE + 1)
        found = sums.toArrow()
        for k, c in zip(*found.columns, strict=True):
            c = np.frombuffer(c.as_buffer(), np.float32)
            total[k.as_py() :][: len(c)] += c
        weights.destroy()
        return total if found.num_rows else None

    w = minimum(slopes)
    release(blocks)
    return w, known


def scored(documents: DataFrame) -> DataFrame:
    """(doc_id, source, p): how likely each document was cut; every row of the input comes out.

    One pass over the texts gives each its length and its probability with and
    without a field limit at that length; the limits are counted from its
    output and looked up by (source, length), so no text is shuffled.
    """
    w, known = train(documents)
    weights = documents.sparkSession.sparkContext.broadcast((w.astype(np.float32), known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, known = weights.value
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                part = batch.slice(k, BLOCK)
                texts = part.column(2).to_pylist()
                sizes = pa.array([None if t is None else len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), sizes, *map(pa.array, scores(w, texts, known))], ["doc_id", "source", "length", "p0", "p1"])

    own = documents.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.col("text").cast("string"))
    rows = staged(own.mapInArrow(run, "doc_id bigint, source string, length bigint, p0 double, p1 double"), "scores")
    place = F.concat_ws("\u0000", F.coalesce("source", F.lit("")), "length").alias("_place")
    limits = field_limits(rows).select(place, F.lit(True).alias("_limit"))
    return lookup_join(rows.select("*", place), limits, "_place").select("doc_id", "source", F.when(F.col("_limit"), F.col("p1")).otherwise(F.col("p0")).alias("p"))


def cut_documents(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id) of the documents that were cut off."""
    return scored(documents).filter(F.col("p") > threshold).select("doc_id")


def source_shares(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(source, documents, cut, share) over all documents; null sources form a row of their own."""
    return scored(documents).groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("p") > threshold).alias("cut")).withColumn("share", F.round(F.col("cut") / F.col("documents"), 6))
