"""Problem 3: mapping freely typed values to a canonical list.

An automaton over all canonical names and aliases finds the mentions embedded
in a value, the longest non-overlapping ones win, and a value whose other
words are remarks names that entry. Remaining values are compared as sets of
words. What stands for a word of the list (abbreviations, numerals), what is a
remark and how similar the sets must be is learned from rows that carry an id
of the list; which words belong to other concepts, from counts over all rows.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of the reference list in one mapper; longer lists are mapped in blocks and the blocks' hits compared.
BLOCK = 20_000
#: Rows with an id of the list that teach abbreviations, remarks and the threshold, as expected by a share of hashed ids.
MAX_LABELLED = 30_000
#: Words of other concepts known to the workers, the most frequent ones.
MAX_FOREIGN = 50_000
#: Values remembered in a worker; beyond that its memory starts anew.
REMEMBERED = 200_000
#: Costs of a cover of letters typed without spaces: a whole word, an abbreviation, a slip, and what a cover may cost.
_WHOLE, _SHORT, _SLIP, _MOST = 0, 1, 2, 8

#: Closed-class words of English that join a remark to a concept.
_JOINTS = frozenset("a an at by for from in of on the to with".split())
_CJK = re.compile(r"[㐀-鿿]")
_TOKEN = re.compile(r"[a-z]/[a-z]?(?![a-z])|[a-zβ]+|\d+(?:st|nd|rd|th)?(?![a-z])|\d+|°")
_SIGNS = re.compile(r"[\W_]+")
_NONE: frozenset[str] = frozenset()


def _plain(text: str) -> str:
    return unicodedata.normalize("NFKC", text).lower().replace("æ", "ae").replace("œ", "oe")


def _spell(word: str) -> str:
    """British spellings as American ones."""
    return re.sub(r"ae(?!$)|oe(?!$)", "e", word) if len(word) > 4 else word


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(_plain(text).replace("_", " "))


def _deletes(word: str, depth: int) -> set[str]:
    out = {word}
    for d in range(1, depth + 1):
        if len(word) > d:
            out |= {"".join(c for i, c in enumerate(word) if i not in at) for at in map(set, combinations(range(len(word)), d))}
    return out


def _distance(a: str, b: str, most: int) -> int:
    """Edits with adjacent swaps (optimal string alignment), or most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    # equal beginnings and ends don't matter
    i, end = 0, min(len(a), len(b))
    while i < end and a[i] == b[i]:
        i += 1
    k = 0
    while k < end - i and a[-1 - k] == b[-1 - k]:
        k += 1
    a, b = a[i : len(a) - k], b[i : len(b) - k]
    if not a or not b:
        return min(max(len(a), len(b)), most + 1)
    if most == 1:
        return 1 if len(a) == len(b) == 1 or (len(a) == len(b) == 2 and a == b[::-1]) else 2
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if two is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


def _allowed(word: str) -> int:
    """Edits a slip of a word may have: one from four letters on, two from seven on."""
    return 0 if len(word) < 4 else 1 if len(word) < 7 else 2


def name_words(names: Iterable[str | None]) -> list[tuple[str, ...]]:
    """The word tuples of names that are no acronyms."""
    return [w for n in names if n and not _CJK.search(n) and not n.strip().isupper() and (w := tuple(map(_spell, tokens(n))))]


@dataclass
class Knowledge:
    """What labelled rows teach: words that stand for words of the list, remarks, words of other concepts, and the similarity demanded."""

    stands_for: dict[tuple[str, ...], tuple[str, ...]] = field(default_factory=dict)
    remarks: set[tuple[str, ...]] = field(default_factory=set)
    cjk_remarks: set[str] = field(default_factory=set)
    foreign: frozenset[str] = frozenset()
    least: float = 1.0


def _plausible(short: str, words: tuple[str, ...]) -> bool:
    """Whether a token can be short for words: its letters stand in them in order, beginning with their first."""
    rest = iter("".join(words))
    return short[0] == words[0][0] and all(c in rest for c in short)


def _glued(run: tuple[str, ...], words: tuple[str, ...]) -> bool:
    """Whether a run has the letters of several words, typed without spaces or with slips: then it isn't short for them."""
    a, b = Counter("".join(run)), Counter("".join(words))
    return len(words) > 1 and ((a - b) + (b - a)).total() <= 0.25 * b.total()


def _runs(flags: list[bool]) -> Iterator[tuple[int, int]]:
    start = None
    for i, f in enumerate([*flags, False]):
        if f and start is None:
            start = i
        elif not f and start is not None:
            yield start, i
            start = None


def _cover(run: tuple[str, ...], known) -> list[tuple[str, ...]] | None:
    """The run as phrases of `known`, longest first; None if it can't be parted so."""
    out, i = [], 0
    while i < len(run):
        for j in range(len(run), i, -1):
            if run[i:j] in known:
                out.append(run[i:j])
                i = j
                break
        else:
            return None
    return out


def learn(labelled: list[tuple[str, str]], entries: list[tuple], rounds: int = 4, least: int = 2) -> Knowledge:
    """Knowledge from (text, ontology_id) rows.

    The words of a row's entry are taken out of its text (slips of these words
    too); where no word of the entry is missing, what is left over is a remark;
    where one is missing, what is left over stands for it. Rounds repeat this
    with what the last one settled. A lesson counts from `least` rows on and
    if it is what most rows with these words say.
    """
    names = {e[0]: (name_words((e[1],)) or name_words((e[3] or "").split("|")) or [()])[0] for e in entries}
    chinese = {e[0]: [_SIGNS.sub("", _plain(n)) for n in (e[2], *(e[3] or "").split("|")) if n and _CJK.search(n)] for e in entries}
    acronyms = {e[0]: {re.sub(r"[^a-z0-9]", "", _plain(n)) for n in (e[1], *(e[3] or "").split("|")) if n and n.strip().isupper()} for e in entries}
    out = Knowledge()
    around: Counter = Counter()
    rows: list[tuple[list[str], tuple[str, ...], int]] = []
    for (text, oid), n in Counter(labelled).items():
        if _CJK.search(text):
            plain = _SIGNS.sub("", _plain(text))
            for name in sorted(chinese.get(oid, ()), key=len, reverse=True):
                if name in plain:
                    around.update({x: n for x in plain.split(name, 1) if x})
                    break
        elif names.get(oid) and not acronyms[oid] & {*(toks := tokens(text)), "".join(toks)}:
            rows.append((toks, names[oid], n))
    out.cjk_remarks = {x for x, n in around.items() if n >= least}
    for turn in range(rounds):  # the first settles remarks alone
        left: Counter = Counter()
        meant: dict[tuple[str, ...], Counter] = defaultdict(Counter)
        for toks, name, n in rows:
            missing, free = list(name), [True] * len(toks)
            for i, t in enumerate(map(_spell, toks)):
                if t in missing:
                    missing.remove(t)
                    free[i] = False
            for i, t in enumerate(toks):
                if free[i] and (hit := next((w for w in missing if (k := _allowed(w)) and len(t) > 3 and _distance(t, w, k) <= k), None)):
                    missing.remove(hit)
                    free[i] = False
            for a, b in _runs(list(free)):
                for i, j in ((i, j) for i in range(a, b) for j in range(b, i, -1)):
                    said = out.stands_for.get(tuple(toks[i:j]))
                    if said and all(free[i:j]) and not Counter(said) - Counter(missing):
                        for w in said:
                            missing.remove(w)
                        free[i:j] = [False] * (j - i)
            open_ = [tuple(toks[a:b]) for a, b in _runs(free)]
            if not missing:
                left.update({r: n for r in open_ if _cover(r, out.remarks) is None or r in out.remarks})
                continue
            open_ = [r for r in open_ if _cover(r, out.remarks) is None]
            if len(open_) == 1 and len(open_[0]) == len(missing) > 1 and all(_plausible(t, (w,)) for t, w in zip(open_[0], missing, strict=True)):
                for t, w in zip(open_[0], missing, strict=True):
                    meant[(t,)][(w,)] += n
            elif len(open_) == 1 and len(open_[0]) <= 3:
                meant[open_[0]][tuple(missing)] += n
            elif len(open_) > 1:
                for r in open_:
                    fits = [tuple(missing[i:j]) for i in range(len(missing)) for j in range(i + 1, len(missing) + 1) if len(r) == 1 and _plausible(r[0], tuple(missing[i:j]))]
                    if len(fits) == 1:
                        meant[r][fits[0]] += n
        for r, c in meant.items() if turn else ():
            (words, n), *_ = c.most_common(1)
            if n >= least and not _glued(r, words) and n * 2 > sum(c.values()) + left[r] and (len(r) == 1 or _cover(r, {*out.remarks, *out.stands_for}) is None):
                out.stands_for[r] = words
        out.remarks = {r for r, n in left.items() if n >= least and n > sum(meant[r].values() if r in meant else (0,))}
    return out


class Mapper:
    """The compiled reference list: automaton, vocabulary with its slips, and word sets of the entries."""

    def __init__(self, entries: list[tuple], knowledge: Knowledge | None = None, vocabulary: Iterable[str] = ()):
        import ahocorasick

        self.ids = {e[0] for e in entries}
        self.k = knowledge or Knowledge()
        phrases: dict[tuple[str, ...], set[str]] = defaultdict(set)
        chinese: dict[str, set[str]] = defaultdict(set)
        self.sets: dict[frozenset, set[str]] = defaultdict(set)
        self.holding: dict[str, set[frozenset]] = defaultdict(set)
        self.acronyms: set[str] = set()
        for oid, en, cn, alias in entries:
            parts = [en, *(alias or "").split("|")]
            for words in name_words(parts):
                phrases[words].add(oid)
                self.sets[frozenset(words)].add(oid)
            for n in parts:
                if n and n.strip().isupper() and not _CJK.search(n) and (t := re.sub(r"[^a-z0-9]", "", _plain(n))):
                    phrases[(t,)].add(oid)
                    self.acronyms.add(t)
            for n in (cn, *parts[1:]):
                if n and _CJK.search(n):
                    chinese[_SIGNS.sub("", _plain(n))].add(oid)
        for s in self.sets:
            for w in s:
                self.holding[w].add(s)
        self.vocabulary = {*self.holding, *vocabulary}
        self.short = {k[0]: v for k, v in self.k.stands_for.items() if len(k) == 1}
        self.targets = {w for w in self.vocabulary if len(w) >= 4} | {w for w in self.short if len(w) >= 5}
        self.slips: dict[str, list[str]] = defaultdict(list)
        for w in self.targets:
            for d in _deletes(w, _allowed(w)):
                self.slips[d].append(w)
        self.longest = max(map(len, self.targets), default=0)
        self.sizes = sorted({len(w) // 2 - k for w in self.targets for k in (0, 1)})
        self.fronts: dict[str, set[str]] = defaultdict(set)
        self.backs: dict[tuple[int, str], set[str]] = defaultdict(set)
        for w in self.targets:
            h = len(w) // 2
            self.fronts[w[:h]].add(w)
            self.fronts[w[: h - 1]].add(w)  # for a swap over the middle
            self.backs[h, w[h : 2 * h]].add(w)
        # letters a name can take when it is typed without spaces, with one more for a slip in each word
        self.glued = max((sum(map(len, p)) + len(p) for p in phrases), default=0)
        self.pieces = {*self.vocabulary, *(w for w in self.short if w.isalpha() and len(w) > 1)}
        self.word_hits, self.cjk_hits = ahocorasick.Automaton(), ahocorasick.Automaton()
        for p, ids in phrases.items():
            self.word_hits.add_word(f" {' '.join(p)} ", (len(p), frozenset(ids)))
        for n, ids in chinese.items():
            self.cjk_hits.add_word(n, (len(n), frozenset(ids)))
        for a in (self.word_hits, self.cjk_hits):
            if len(a):
                a.make_automaton()
        self.fixed: dict[str, str | None] = {}
        self.known: dict[str, tuple] = {}

    def fix(self, token: str) -> str | None:
        """The only word nearest to a slip; None for words of their own."""
        if token in self.fixed:
            return self.fixed[token]
        best: list[tuple[int, str]] = []
        if 4 <= len(token) <= self.longest + 2 and token not in self.k.foreign:
            most = _allowed(token) if len(token) != 6 else 2
            seen = {w for d in _deletes(token, most) for w in self.slips.get(d, ())}
            # two letters before a whole word make another word (in-complete), not a slip of it
            best = sorted((d, w) for w in seen if (d := _distance(token, w, _allowed(w))) <= _allowed(w) and not (len(token) == len(w) + 2 and token.endswith(w)))
        means = {self.short.get(w, (w,)) for d, w in best if d == best[0][0]}
        out = best[0][1] if len(means) == 1 else None
        if len(self.fixed) >= REMEMBERED:
            self.fixed.clear()
        self.fixed[token] = out
        return out

    def words(self, text: str) -> list[str]:
        """The value in words of the list: what stands for them written out, slips corrected; remarks as '-', joints as '.', others as '?' and the word."""
        toks, out, i = tokens(text), [], 0
        bare = re.sub(r"[^a-z0-9]", "", "".join(toks))
        if bare in self.acronyms:
            return [bare]
        while i < len(toks):
            for j in range(min(len(toks), i + 4), i, -1):
                part = tuple(toks[i:j])
                if j == i + 1 and _spell(toks[i]) in self.vocabulary:
                    out.append(_spell(toks[i]))
                elif part in self.k.remarks and (j > i + 1 or part not in self.k.stands_for):
                    out.append("-")
                elif part in self.k.stands_for:
                    out += self.k.stands_for[part]
                else:
                    continue
                i = j
                break
            else:
                t = toks[i]
                w = None if t in self.acronyms else self.fix(_spell(t)) or self.fix(t)
                out += self.short.get(w, (w,)) if w else ["." if t in _JOINTS else t if t in self.acronyms else f"?{t}"]
                i += 1
        # an acronym of the list that has another meaning beside other words means itself where only remarks stand beside it
        own = [t for t in toks if t in self.acronyms and (t,) in self.k.stands_for]
        if len(own) == 1 and _cover(tuple(t for t in toks[: toks.index(own[0])]), self.k.remarks) is not None and _cover(tuple(toks[toks.index(own[0]) + 1 :]), self.k.remarks) is not None:
            return own
        return out

    def _segment(self, glued: str, most: int = _MOST) -> list[str] | None:
        """Words of a value typed without (or with misplaced) spaces: the cheapest cover, at most one slip a word."""
        n = len(glued)
        if not 5 <= n <= self.glued:
            return None
        best: list[tuple[int, tuple[str, ...]] | None] = [(0, ())] + [None] * n
        for i in range(n):
            if best[i] is None or best[i][0] > most:
                continue
            cost, words = best[i]
            steps = [(j, _WHOLE if p in self.vocabulary else _SHORT, (p,) if p in self.vocabulary else self.short[p]) for j in range(i + 2, min(n, i + self.longest) + 1) if (p := glued[i:j]) in self.pieces]
            if cost + _SLIP <= most:
                steps += [(j, _SLIP, self.short.get(w, (w,))) for j, w in self._slipped(glued, i)]
            for j, step, new in steps:
                if best[j] is None or cost + step < best[j][0]:
                    best[j] = (cost + step, words + new)
        end = best[n]
        return list(end[1]) if end is not None and end[0] <= most else None

    def _slipped(self, glued: str, i: int) -> list[tuple[int, str]]:
        """(end, word) of the words that begin at i with one slip: one of their halves is whole, so words are looked up by their halves."""
        near: set[str] = set()
        for h in self.sizes:
            near |= self.fronts.get(glued[i : i + h], _NONE)
            for at in (i + h - 1, i + h, i + h + 1):
                near |= self.backs.get((h, glued[at : at + h]), _NONE)
        out: dict[int, set[str]] = defaultdict(set)
        for w in near:
            for j in range(i + len(w) - 1, min(len(glued), i + len(w) + 1) + 1):
                if j - i >= 4 and _distance(glued[i:j], w, 1) == 1:
                    out[j].add(w)
        return [(j, ws.pop()) for j, ws in out.items() if len(ws) == 1]

    def find(self, text: str | None) -> str:
        """The id of the entry a value names, '' if none or more than one fits."""
        ids = self.claims(text)[1]
        return next(iter(ids)) if len(ids) == 1 else ""

    def claims(self, text: str | None) -> tuple[float, frozenset[str]]:
        """(strength, ids): the entries a value may name; the strength orders hits of different blocks of the list."""
        if text is None or not text.strip():
            return 0.0, frozenset()
        hit = self.known.get(text)
        if hit is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            hit = self.known[text] = self._chinese(text) if _CJK.search(text) else self._latin(text)
        return hit

    @staticmethod
    def _mentions(automaton, line: str, inner: int) -> list[tuple[int, int, frozenset[str]]]:
        """Longest non-overlapping hits (start, end, ids); `inner` signs at each end of a pattern may be shared."""
        if not len(automaton):
            return []
        hits = sorted(((end + 1 - (size := len_), end + 1, ids) for end, (len_, ids) in _sized(automaton, line, inner)), key=lambda h: (h[0] - h[1], h[0]))
        taken: list[tuple[int, int, frozenset[str]]] = []
        for a, b, ids in hits:
            if all(b - inner <= x or a >= y - inner for x, y, _ in taken):
                taken.append((a, b, ids))
        return sorted(taken)

    def _chinese(self, text: str) -> tuple[float, frozenset[str]]:
        line = _SIGNS.sub("", _plain(text))
        found = self._mentions(self.cjk_hits, line, 0)
        if len({ids for *_, ids in found}) != 1:
            return 0.0, frozenset()
        rest, at = [], 0
        for a, b, _ in found:
            rest.append(line[at:a])
            at = b
        if all(not x or x in self.k.cjk_remarks or _cover(tuple(x), {tuple(r) for r in self.k.cjk_remarks}) for x in [*rest, line[at:]]):
            return 1.0 + found[0][1] - found[0][0], found[0][2]
        return 0.0, frozenset()

    def _latin(self, text: str) -> tuple[float, frozenset[str]]:
        words = self.words(text)
        strength, ids = self._named(words)
        if not ids and any(w[0] in "?." or len(w) == 1 for w in words) and not any(w[1:] in self.k.foreign for w in words if w[0] == "?"):
            plain = "".join(w.lstrip("?") for w in words if w not in "-.")
            typed = "".join(tokens(text))
            # a short word by itself is no slip of its neighbours
            most = _MOST if all(len(w) > 3 for w in words if w[0] == "?") else _SHORT
            for glued in dict.fromkeys((plain, _spell(plain), typed, _spell(typed))):
                if glued.isascii() and glued.isalpha() and (raw := self._segment(glued, most)):
                    return self._named(raw)
        return strength, ids

    def _named(self, words: list[str]) -> tuple[float, frozenset[str]]:
        """Longest non-overlapping mentions first; where other words of weight stand beside them, the sets of words."""
        line = f" {' '.join(words)} "
        found = self._mentions(self.word_hits, line, 1)
        if found and len({ids for *_, ids in found}) == 1:
            a, b, ids = found[0]
            before, after = line[:a].split(), line[b:].split()
            if all(self._beside(side) for side in (before[::-1], after)):
                return 1.0 + line[a:b].count(" "), ids
        own = frozenset(w for w in words if w not in "-.")
        near = {s for w in own for s in self.holding.get(w, ())}
        scored = sorted(((len(own & s) / len(own | s), s) for s in near), key=lambda x: -x[0])
        best = [s for v, s in scored if v == scored[0][0]] if scored and scored[0][0] >= self.k.least else []
        ids = frozenset(i for s in best for i in self.sets[s])
        return (scored[0][0] if ids else 0.0), ids

    @staticmethod
    def _beside(words: list[str]) -> bool:
        """Whether the words beside a mention, from it outwards, leave it as it is: remarks, joints, and unknown words beyond one of these. A name's own words and an unknown word next to it would make it another concept."""
        apart = False
        for w in words:
            if w in "-.":
                apart = True
            elif w[0] != "?" or not apart:
                return False
        return True

    def similarity_of(self, text: str, without: str | None = None) -> tuple[float, frozenset[str]]:
        """The best similarity of a value's words to an entry's, leaving one entry out."""
        own = frozenset(w for w in self.words(text) if w not in "-.")
        near = {s for w in own for s in self.holding.get(w, ()) if self.sets[s] - {without}}
        return max(((len(own & s) / len(own | s), frozenset(self.sets[s] - {without})) for s in near), key=lambda x: x[0], default=(0.0, frozenset()))


def _sized(automaton, line: str, inner: int):
    """Hits with the length of their pattern in signs."""
    for end, (n, ids) in automaton.iter(line):
        if inner:
            start = end
            for _ in range(n):
                start = line.rfind(" ", 0, start)
            yield end, (end + 1 - start, ids)
        else:
            yield end, (n, ids)


def fit_least(mapper: Mapper, held: list[tuple[str, str]]) -> float:
    """The similarity of word sets from which a value names an entry, on held-out labelled rows: with its entry in the list it should be found, with it taken out nothing should be."""
    marks = []
    for text, oid in held:
        if not _CJK.search(text):
            v, ids = mapper.similarity_of(text)
            marks.append((v, ids == {oid}))
            marks.append((mapper.similarity_of(text, oid)[0], False))
    grid = [k / 20 for k in range(10, 21)]
    return max(grid, key=lambda g: (sum(1 if ok else -1 for v, ok in marks if v >= g), g), default=1.0)


def teach(labelled: list[tuple[str, str]], entries: list[tuple], foreign: Iterable[str] = ()) -> Knowledge:
    """learn() from all rows; the similarity is fitted on every fifth by what the others teach."""
    rows = sorted(labelled)
    part = learn([r for k, r in enumerate(rows) if k % 5], entries)
    out = learn(rows, entries)
    out.foreign = part.foreign = frozenset(foreign)
    if rows:
        out.least = fit_least(Mapper(entries, part), rows[::5])
    return out


def foreign_words(cache: DataFrame, ontology: DataFrame, least: int = 10) -> list[str]:
    """Words of other concepts: in at least `least` different texts without an id of the list and in none with one; counted over all rows, combined before the shuffle."""
    ids = F.broadcast(ontology.select(F.col("ontology_id").alias("_id")).distinct())
    words = F.array_distinct(F.regexp_extract_all(F.lower("original_text"), F.lit(r"[a-z\u03b2]{2,}"), 0))
    toks = cache.join(ids, F.col("ontology_id") == F.col("_id"), "left").select(F.explode(words).alias("w"), F.xxhash64("original_text").alias("t"), F.col("_id").isNotNull().alias("labelled"))
    counts = toks.groupBy("w").agg(F.count_if("labelled").alias("inside"), F.count("*").alias("n"), F.approx_count_distinct("t", 0.02).alias("texts"))
    own = counts.filter((F.col("inside") == 0) & (F.col("texts") >= least)).orderBy(F.desc("n"), "w").limit(MAX_FOREIGN)
    return [_spell(r.w) for r in own.collect()]


def labelled_rows(cache: DataFrame, ontology: DataFrame, most: int = MAX_LABELLED) -> list[tuple[str, str]]:
    """(text, ontology_id) of about `most` rows with an id of the list, those whose key's hash lies in the share that gives as many."""
    share = min(1.0, most / max(1, cache.count()))
    drawn = cache.filter("original_text is not null and ontology_id is not null")
    if share < 1:
        drawn = drawn.filter(F.pmod(F.xxhash64("cache_id"), F.lit(1 << 40)) < int(share * (1 << 40)))
    return [tuple(r) for r in drawn.join(F.broadcast(ontology.select("ontology_id").distinct()), "ontology_id", "left_semi").select("original_text", "ontology_id").collect()]


#: The mapper of each list, built once in a worker process.
_BUILT: dict[str, Mapper] = {}


def map_names(cache: DataFrame, ontology: DataFrame, block: int = BLOCK) -> DataFrame:
    """(cache_id, ontology_id): the entry each unmapped value names, '' if none.

    Rows whose ontology_id is an id of the list are left out, but teach; null,
    blank and unreadable values come out with ''. Values are mapped where they
    are read; repeated ones are remembered in the worker. A list above `block`
    entries is mapped in blocks, and a value takes the strongest hit of all.
    """
    spark = cache.sparkSession
    own = cache.select(F.col("cache_id").cast("bigint"), F.col("original_text").cast("string"), F.col("ontology_id").cast("string"))
    entries = sorted(tuple(r) for r in ontology.filter("ontology_id is not null").select("ontology_id", "name_en", "name_cn", "alias").collect())
    knowledge = teach(labelled_rows(own, ontology), entries, foreign_words(own, ontology))
    every = frozenset(e[0] for e in entries)
    vocabulary = frozenset(w for e in entries for n in name_words((e[1], *(e[3] or "").split("|"))) for w in n)
    parts = [entries[i : i + block] for i in range(0, len(entries), block)] or [[]]

    def claims(part: list[tuple]) -> DataFrame:
        shared, key = spark.sparkContext.broadcast((part, knowledge, vocabulary, every)), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if key not in _BUILT:
                _BUILT.clear()
                _BUILT[key] = Mapper(*shared.value[:3])
            mapper, known = _BUILT[key], shared.value[3]
            for batch in batches:
                rows = [(i, *mapper.claims(t)) for i, t, o in zip(*(c.to_pylist() for c in batch.columns), strict=True) if o not in known]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64()), pa.array([sorted(r[2]) for r in rows], pa.list_(pa.string()))], ["cache_id", "strength", "ids"])

        return own.mapInArrow(run, "cache_id bigint, strength double, ids array<string>")

    named = lambda ids: F.when(F.size(ids) == 1, F.get(ids, 0)).otherwise("").alias("ontology_id")
    if len(parts) == 1:
        return claims(parts[0]).select("cache_id", named("ids"))
    # equal rows of a block are one claim each, so a repeated cache_id keeps its number of rows
    hits = [claims(p).withColumn("part", F.lit(k)) for k, p in enumerate(parts)]
    both = hits[0]
    for h in hits[1:]:
        both = both.unionByName(h)
    numbered = both.groupBy("cache_id", "strength", "ids", "part").agg(F.count("*").alias("n"))
    top = numbered.groupBy("cache_id").agg(F.max("strength").alias("top"), F.max("n").alias("rows"))
    best = numbered.join(top, "cache_id").filter("strength = top").groupBy("cache_id").agg(F.array_distinct(F.flatten(F.collect_set("ids"))).alias("ids"), F.max("rows").alias("rows"))
    return best.select("cache_id", named("ids"), F.explode(F.sequence(F.lit(1).cast("bigint"), "rows")).alias("_")).drop("_")
