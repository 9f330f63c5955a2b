"""Problem 4: noise in text from scanned pages.

Page furniture is recognised by page-position features (page_furniture);
words broken over line ends are joined; misread words are repaired. An
averaged-perceptron editor scores keep, replace, delete, insert and line-join
operations, and the words of the whole corpus are the evidence beside it.
"""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.page_furniture import MAX_CHAPTERS, Furniture, digits, roman  # noqa: F401
from lattica.operators.skew import lookup_join
from lattica.session import release, staged

#: Words that train the editor at most, of each kind; counts and checks cover all words.
MAX_TRAINING_WORDS = 20_000
#: Right words, the most frequent ones, that teach when to keep a word and how to join one.
MAX_RIGHT_WORDS = 4_000
#: How much more frequent the right word must be where neither stands in digital text.
RATIO = 20

_BREAKS = "-‐‑­¬"
_WORD = re.compile(r"[^\W_](?:[^\s]*[^\W_])?")
#: The same on the JVM side.
_JVM_WORD = r"[\p{L}\p{N}](?:\S*[\p{L}\p{N}])?"


def furniture(lines: list[str], title: str | None, book: str | None, first: int | None, last: int | None, model: Furniture | None = None) -> set[int]:
    """Numbers of the lines that are running heads or page numbers."""
    return (model or Furniture().train([])).lines_of(lines, title, book, first, last)


def read(text: str, title, book, first, last, model: Furniture | None = None) -> Iterator[tuple[str, int, str, str]]:
    """(kind, line_no, token, alternative) of a scanned text: furniture lines, broken words (joined; with hyphen), other words."""
    for kind, k, token, alt, words in read_lines(text, title, book, first, last, model):
        if kind == "words":
            yield from (("word", k, w, "") for w in words)
        else:
            yield kind, k, token, alt


def read_lines(text: str, title, book, first, last, model: Furniture | None = None) -> Iterator[tuple[str, int, str, str, list[str]]]:
    """As read(), with the words of a line together, and the halves of a broken word beside it."""
    lines = text.split("\n")
    out = furniture(lines, title, book, first, last, model)
    for k in sorted(out):
        yield "furniture", k, "", "", []
    live = [k for k, x in enumerate(lines) if x.strip() and k not in out]
    carried = ""
    for at, k in enumerate(live):
        line = lines[k].rstrip()
        if carried:
            line = line.lstrip()[len(carried) :]
            carried = ""
        if len(line) > 1 and line[-1] in _BREAKS and line[-2].isalnum() and at + 1 < len(live):
            left, right = line.split()[-1], lines[live[at + 1]].split()[0]
            if right[0].isalnum():
                line, carried = line[: len(line) - len(left)], right
                left = left.rstrip(_BREAKS)
                pair = [m.group() if (m := _WORD.search(x)) else "" for x in (left + right, f"{left}-{right}")]
                yield "hyphen", k, *pair, [left, right]
        if words := _WORD.findall(line):
            yield "words", k, "", "", words


class Editor:
    """Averaged-perceptron character editor.

    An operation replaces one or two characters by none to two others (so it
    replaces, deletes or inserts), keeps a word as it is, or joins the halves
    of a broken word with or without hyphen.
    """

    def __init__(self):
        self.weights: dict[tuple, float] = {}
        self.ops: dict[str, list[str]] = {}

    @staticmethod
    def _keep_features(word: str) -> list[tuple]:
        pad = f"^{word}$"
        return [("keep",), ("keep", any(c.isdigit() for c in word), word.isalpha()), *(("keep", pad[i : i + 3]) for i in range(len(pad) - 2))]

    def keep(self, word: str) -> float:
        """The score of keeping a word as it is."""
        return sum(self.weights.get(f, 0.0) for f in self._keep_features(word))

    @staticmethod
    def _join_features(left: str, right: str, put: str) -> list[tuple]:
        a, b = left.rsplit("-", 1)[-1].lower(), right.split("-", 1)[0].lower()
        return [("join", put), ("join", put, a[-3:]), ("join", put, b[:3]), ("join", put, a[-2:], b[:2]), ("join", put, min(len(a), 8)), ("join", put, "-" in left or "-" in right), ("join", put, b[:1].isdigit() or a[-1:].isdigit())]

    def join(self, left: str, right: str) -> float:
        """How much better it is to join two halves with a hyphen than without."""
        of = lambda put: sum(self.weights.get(f, 0.0) for f in self._join_features(left, right, put))
        return of("-") - of("")

    @staticmethod
    def _features(word: str, i: int, span: str, put: str) -> list[tuple]:
        pad = f"^^{word}$$"
        a, b = i + 2, i + 2 + len(span)
        left, right = pad[a - 2 : a], pad[b : b + 2]
        op = (span, put)
        return [op, (op, left[-1]), (op, right[:1]), (op, left), (op, right), (op, left[-1], right[:1]), (op, any(c.isdigit() for c in word)), (op, i == 0)]

    def _score(self, word, i, span, put) -> float:
        return sum(self.weights.get(f, 0.0) for f in self._features(word, i, span, put))

    def proposals(self, word: str, most: int | None = None) -> list[tuple[float, int, str, str]]:
        """Operations on a word by score above keeping, all unless `most` is given."""
        out = []
        for i in range(len(word)):
            for n in (1, 2):
                span = word[i : i + n]
                if len(span) == n:
                    out += [(self._score(word, i, span, p), i, span, p) for p in self.ops.get(span, ())]
        return sorted(out, reverse=True)[:most]

    def candidates(self, word: str, longest: int | None = None) -> dict[str, float]:
        """Words after one or two operations of any rank, with their score; none if two operations can't shorten the word to `longest`."""
        if longest is not None and len(word) > longest + 4:
            return {}
        ops = self.proposals(word)
        out: dict[str, float] = {}
        apply = lambda w, i, span, put: w[:i] + put + w[i + len(span) :]
        for k, (s, i, span, put) in enumerate(ops):
            one = apply(word, i, span, put)
            out[one] = max(out.get(one, -1e9), s)
            for s2, j, span2, put2 in ops[k + 1 :]:
                if j >= i + len(span) or i >= j + len(span2):
                    a, b = ((i, span, put), (j, span2, put2)) if i > j else ((j, span2, put2), (i, span, put))
                    two = apply(apply(word, *a), *b)
                    out[two] = max(out.get(two, -1e9), s + s2 - 4)
        out.pop(word, None)
        return out

    def train(self, pairs: list[tuple[str, str, int]], right: list[str] = (), epochs: int = 4, seed: int = 7) -> Editor:
        """Fit on (misread, right, count) and on right words.

        The right operation must score above all others and above keeping, on
        right words keeping above all operations; right words broken at a
        random place, or at their own hyphen, teach how to join.
        """
        examples = []
        support: Counter = Counter()
        for bad, good, _ in pairs:
            if (op := single_edit(bad, good)) is not None:
                support[op[1:]] += 1
                examples.append((bad, op))
        kept = {op for op, n in support.items() if n >= 2 and op[0].lower() != op[1].lower()}
        table = defaultdict(list)
        for span, put in sorted(kept):
            table[span].append(put)
        for span, puts in table.items():  # a digit in a letter's place may stand for a capital too
            if span.isdigit():
                puts += [p.upper() for p in puts if p.upper() not in puts]
        self.ops = dict(table)
        examples = [(w, op) for w, op in examples if op[1:] in kept]
        w: dict[tuple, float] = defaultdict(float)
        total: dict[tuple, float] = defaultdict(float)
        stamp: dict[tuple, int] = defaultdict(int)
        rng, step = random.Random(seed), 0
        self.weights = w
        examples += [(word, None) for word in right if len(word) > 3]
        for word in right:
            inner = [i for i in range(2, len(word) - 1) if word[i - 1].isalnum() and word[i].isalnum()]
            if inner:
                i = rng.choice(inner)
                examples.append(((word[:i], word[i:]), ""))
            examples += [((word[:i], word[i + 1 :]), "-") for i in range(1, len(word) - 1) if word[i] == "-"]

        def add(f, v):
            total[f] += (step - stamp[f]) * w[f]
            stamp[f] = step
            w[f] += v

        for _ in range(epochs):
            rng.shuffle(examples)
            for word, op in examples:
                step += 1
                if isinstance(word, tuple):
                    if (self.join(*word) > 0) != (op == "-"):
                        for put, v in (("-", 1.0), ("", -1.0)):
                            for f in self._join_features(*word, put):
                                add(f, v if op == "-" else -v)
                    continue
                best = self.proposals(word, 1)
                kept = self.keep(word)
                said = None if not best or best[0][0] <= kept else best[0][1:]
                if said != op:
                    for f in self._keep_features(word) if op is None else self._features(word, *op):
                        add(f, 1.0)
                    for f in self._keep_features(word) if said is None else self._features(word, *said):
                        add(f, -1.0)
        for f in list(w):
            total[f] += (step - stamp[f]) * w[f]
        self.weights = {f: total[f] / max(1, step) for f in w if total[f]}
        return self


def single_edit(bad: str, good: str) -> tuple[int, str, str] | None:
    """(place, span, replacement) if replacing one or two characters by none to two others makes the right word, smallest first."""
    a = 0
    while a < min(len(bad), len(good)) and bad[a] == good[a]:
        a += 1
    b = 0
    while b < min(len(bad), len(good)) - a and bad[-1 - b] == good[-1 - b]:
        b += 1
    span, put = bad[a : len(bad) - b], good[a : len(good) - b]
    if len(span) == 0:  # an insertion: carried by a neighbour
        if a > 0:
            a, span, put = a - 1, bad[a - 1], bad[a - 1] + put
        elif bad:
            span, put = bad[0], put + bad[0]
    return (a, span, put) if 1 <= len(span) <= 2 and len(put) <= 2 else None


def training_pairs(suspects: list[tuple[str, int]], right: list[tuple[str, int]]) -> list[tuple[str, str, int]]:
    """Rare words beside a far more frequent one that a single operation makes of them, if only one does."""
    wanted = {k for t, _ in suspects if len(t) >= 4 for w in (1, 2) for k in _shapes(t, w)}
    holes: dict[int, list[int]] = defaultdict(list)
    for at, (w, _) in enumerate(right):
        if len(w) >= 4:
            for k in {k for n in (1, 2) for k in _shapes(w, n)} & wanted:
                holes[k].append(at)
    out = []
    for t, n in suspects:
        if len(t) >= 4:
            hits = {at for w in (1, 2) for k in _shapes(t, w) for at in holes.get(k, ())}
            words = {right[at][0] for at in hits if right[at][1] >= RATIO * n and right[at][0] != t}
            if len(words) == 1:
                out.append((t, words.pop(), n))
    return out


def _shapes(word: str, width: int) -> Iterator[int]:
    """A word with a hole of one or two characters at each place; the hole itself may stand for one or two."""
    return (hash((word[:i], word[i + width :])) for i in range(len(word) - width + 1))


_FIELDS = ("id", "title", "book", "start_page", "end_page", "text")
_READ = "id string, kind string, line_no int, token string, alt string, words array<string>"


def _own(chapters: DataFrame) -> DataFrame:
    return chapters.select(F.col("id").cast("string"), F.col("title"), F.col("book"), F.col("start_page").cast("int"), F.col("end_page").cast("int"), F.col("text"), (F.coalesce("source_format", F.lit("")) == "pdf_scan").alias("scan")).filter("text is not null")


def learn_furniture(scans: DataFrame, most: int = MAX_CHAPTERS) -> Furniture:
    """A Furniture model from about `most` chapters, those whose id's hash lies in the share that gives as many."""
    share = min(1.0, most / max(1, scans.count()))
    drawn = scans if share == 1 else scans.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int(share * (1 << 40)))
    return Furniture().train([tuple(r) for r in sorted(drawn.select("text", "title", "book", "start_page", "end_page").collect(), key=lambda r: (r.text, str(r)))])


def _lines(scans: DataFrame, model: Furniture) -> DataFrame:
    """read() of all scanned chapters: one pass over their texts."""
    shared = scans.sparkSession.sparkContext.broadcast(model)
    kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *r) for i, title, book, first, last, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in read_lines(text, title, book, first, last, shared.value)]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["id", "kind", "line_no", "token", "alt", "words"])

    return scans.select(*_FIELDS).mapInArrow(run, _READ)


def _count_words(digital: DataFrame, lines: DataFrame) -> DataFrame:
    """(token, nd, ns): how often each word stands in digital and in scanned text, over all chapters; halves of broken words left out."""
    nd = digital.select(F.explode(F.regexp_extract_all("text", F.lit(_JVM_WORD), 0)).alias("token")).groupBy("token").agg(F.count("*").alias("nd"))
    ns = lines.filter("kind = 'words'").select(F.explode("words").alias("token")).groupBy("token").agg(F.count("*").alias("ns"))
    return nd.join(ns, "token", "full_outer").select("token", F.coalesce("nd", F.lit(0)).alias("nd"), F.coalesce("ns", F.lit(0)).alias("ns"))


def findings(chapters: DataFrame) -> DataFrame:
    """(id, kind, line_no, fix) of all scanned chapters: furniture, broken words with their whole form, misread words with the right one.

    Null and blank texts give nothing; a null start_page leaves page numbers
    alone but still finds running heads. A broken word unknown in either form
    is joined as the editor scores its halves. Words that no candidate
    explains better than keeping them are left alone.
    """
    return _findings(chapters).select("id", "kind", "line_no", "fix").distinct()


def _findings(chapters: DataFrame) -> DataFrame:
    """findings() with the word as it stood (`token`), not yet distinct."""
    spark = chapters.sparkSession
    own = _own(chapters)
    scans = own.filter("scan").drop("scan")
    lines = staged(_lines(scans, learn_furniture(scans)), "lines")
    words = staged(_count_words(own.filter(~F.col("scan")).select("text"), lines), "words")
    worth = F.col("nd") * 5 + F.col("ns")
    first = lambda d, n, *order: [(r[0], r[1]) for r in d.orderBy(*order).limit(n).collect()]
    right = first(words.filter("nd >= 2").select("token", worth.alias("n")), MAX_TRAINING_WORDS, F.desc("n"), "token")
    common = right or first(words.select("token", worth.alias("n")).filter(F.col("n") >= RATIO), MAX_TRAINING_WORDS, F.desc("n"), "token")
    rare = first(words.filter("nd = 0 and ns > 0").select("token", "ns"), MAX_TRAINING_WORDS, F.xxhash64("token"))
    editor = Editor().train(training_pairs(rare, common), [w for w, _ in common[:MAX_RIGHT_WORDS]])
    longest = words.filter((F.col("nd") >= 2) | (worth >= RATIO)).agg(F.max(F.length("token"))).first()[0] or 0
    shared = spark.sparkContext.broadcast((editor, longest))

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, most = shared.value
        for batch in batches:
            rows = []
            for t in batch.column(0).to_pylist():
                d = digits(t)
                if d is not None:
                    rows.append((t, d, 1e6 if d != t else 2e6))
                    continue
                kept = own.keep(t)
                rows += [(t, c, s - kept) for c, s in own.candidates(t, most).items()]
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], ["token", "cand", "s"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = shared.value
        for batch in batches:
            halves = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.join(*h) for h in halves], pa.float64())], ["words", "j"])

    broken = lines.filter("kind = 'hyphen'").select("id", "line_no", "token", "alt", "words")
    known = words.select("token", "nd", "ns")
    doubtful = broken.select(F.explode(F.array("token", "alt")).alias("token")).filter("token <> ''").distinct().join(known, "token", "left").select("token", F.coalesce("nd", F.lit(0)).alias("nd"), F.coalesce("ns", F.lit(0)).alias("ns"))
    doubtful = doubtful.unionByName(known.filter("nd = 0")).distinct()
    asked = doubtful.filter("nd = 0").select("token").mapInArrow(propose, "token string, cand string, s double")
    checked = asked.join(known.select(F.col("token").alias("cand"), F.col("nd").alias("cd"), F.col("ns").alias("cs")), "cand", "left").join(doubtful, "token")
    seen = F.coalesce("cd", F.lit(0)) * 5 + F.coalesce("cs", F.lit(0))
    fits = (F.col("s") >= 1e6) | (F.col("cd") >= 2) | (seen >= RATIO * F.greatest("ns", F.lit(1)))
    # keeping has the evidence of the word's own count
    value = F.col("s") + F.log1p(seen) - F.log1p("ns")
    fixes = checked.filter(fits & (value > 0)).groupBy("token").agg(F.max_by("cand", F.struct(value, "cand")).alias("fix"))
    verdicts = staged(doubtful.join(fixes, "token", "left").select("token", F.when(F.col("nd") == 0, F.col("fix")).alias("fix"), (F.col("nd") * 5 + F.col("ns")).alias("n"), (F.col("nd") > 0).alias("sure")), "fixes")
    release(words)
    wrong = verdicts.filter("fix is not null and fix <> token").select("token", "fix")
    misread = lookup_join(lines.filter("kind = 'words'").select("id", "line_no", F.explode("words").alias("token")), wrong, "token", "inner").select("id", F.lit("misread").alias("kind"), "line_no", "token", "fix")

    def ranked(c: str) -> DataFrame:
        rank = F.when(F.col("sure"), 3).when(F.col("fix").isNotNull(), 2).when(F.col("n") > 0, 1).otherwise(0)
        return verdicts.select(F.col("token").alias(c), F.struct(rank.alias("r"), F.col("n").alias("n"), F.coalesce("fix", "token").alias("fix")).alias("v_" + c))

    joins = broken.select("words").distinct().mapInArrow(join, "words array<string>, j double")
    both = lookup_join(lookup_join(lookup_join(broken, ranked("token"), "token"), ranked("alt"), "alt"), joins, "words")
    better = lambda f: F.col(f"v_alt.{f}") > F.col(f"v_token.{f}")
    same = lambda f: F.col(f"v_alt.{f}") == F.col(f"v_token.{f}")
    dashed = F.coalesce(better("r") | (same("r") & (better("n") | (same("n") & (F.col("v_token.r") == 0) & (F.col("j") > 0)))), F.lit(False))
    hyphen = both.select("id", F.lit("hyphen").alias("kind"), "line_no", "token", F.when(dashed, F.col("v_alt.fix")).otherwise(F.coalesce("v_token.fix", "token")).alias("fix"))
    edges = lines.filter("kind = 'furniture'").select("id", "kind", "line_no", "token", F.lit("").alias("fix"))
    return edges.unionByName(hyphen).unionByName(misread)


def repair(text: str, found: list[tuple[str, int, str, str]]) -> str:
    """The text as continuous paragraphs: furniture dropped, broken words joined, misread words put right; (kind, line_no, token, fix) are its findings."""
    lines = text.split("\n")
    gone = {k for kind, k, *_ in found if kind == "furniture"}
    joins = {k: fix for kind, k, _, fix in found if kind == "hyphen"}
    fixes: dict[int, dict[str, str]] = defaultdict(dict)
    for kind, k, token, fix in found:
        if kind == "misread":
            fixes[k][token] = fix
    paragraphs: list[str] = []
    parts: list[str] = []
    carried = ""
    first = next((k for k, x in enumerate(lines) if x.strip()), None)
    for k, raw in enumerate(lines):
        if k in gone:
            continue
        line = raw.strip()
        if not line or k == first:
            # a blank line ends a paragraph, unless a word is broken over it, or it stands at a page end within a sentence
            page = not line and gone & {k - 1, k + 1} and parts and parts[-1][-1:].isalnum()
            if parts and not carried and not page:
                paragraphs.append(" ".join(parts))
                parts = []
            if not line:
                continue
        if carried:
            line = line[len(line.split()[0]) :].lstrip()
            parts.append(carried)
            carried = ""
        if k in joins:
            left = line.split()[-1]
            line = line[: len(line) - len(left)].rstrip()
            nxt = next((lines[j].split()[0] for j in range(k + 1, len(lines)) if j not in gone and lines[j].strip()), "")
            whole = left.rstrip(_BREAKS) + nxt
            m = _WORD.search(whole)
            carried = whole[: m.start()] + joins[k] + whole[m.end() :] if m else whole
        if k in fixes:
            line = re.sub(r"\S+", lambda w: _WORD.sub(lambda m: fixes[k].get(m.group(), m.group()), w.group(), count=1), line)
        if line:
            parts.append(re.sub(r"\s+", " ", line))
        if k == first and not carried:
            paragraphs.append(" ".join(parts))
            parts = []
    if carried:
        parts.append(carried)
    if parts:
        paragraphs.append(" ".join(parts))
    return "\n\n".join(paragraphs)


def repaired(chapters: DataFrame) -> DataFrame:
    """(id, text) of all scanned chapters, repaired into paragraphs parted by an empty line; null and blank texts come out as they are.

    Findings are gathered by chapter, whose text bounds them; a chapter
    delivered twice under another id is a chapter of its own; one without
    id has no findings to be told from others, so only its lines are joined.
    """
    found = _findings(chapters).distinct().groupBy("id").agg(F.collect_list(F.struct("kind", "line_no", "token", "fix")).alias("found"))
    scans = chapters.filter(F.coalesce("source_format", F.lit("")) == "pdf_scan").select(F.col("id").cast("string"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            out = [t if t is None or not t.strip() else repair(t, [tuple(f.values()) for f in found or ()]) for t, found in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "text"])

    return scans.join(found, "id", "left").mapInArrow(run, "id string, text string")
