"""Problem 5: noise in text from scanned pages."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.plans.tables import fill_forward

from .common import CACHE_WORDS, WordCache, broadcast_if_small, bucketed, column_type, fold_word, map_arrow, materialize, table, word_hash

#: Lines from the top and from the bottom of a page that are looked at first; where the innermost repeats in a file, so many more are.
EDGE = 2
#: Share of a file's pages, and number of them, from which a line at their edge is running.
RUNNING_SHARE, RUNNING_PAGES = 0.35, 2
#: Occurrences from which a word is known, the share of all words it must have besides, and how much commoner a look-alike must be for a word to count as its misreading.
#: The share bounds the model: at most 1 / KNOWN_SHARE words, and as many pairs, can reach it, whatever the number of pages.
KNOWN, KNOWN_SHARE, OUTWEIGHS = 5, 1e-6, 25
#: Letters from which a word of letters alone is weighed by its neighbours, and words taken through the trie together.
CONTEXT_LETTERS, TRIE_BLOCK = 4, 256
#: Running lines are broadcast up to this many sources, joined beyond.
BROADCAST_SOURCES = 100_000

#: What scanners take for what (read -> meant), with the price of the exchange.
CONFUSED = {("1", "i"): 0.5, ("1", "l"): 0.6, ("0", "o"): 0.5, ("9", "g"): 0.5, ("4", "a"): 0.5, ("5", "s"): 0.5, ("6", "b"): 0.7, ("8", "b"): 0.7, ("|", "l"): 0.6, ("|", "i"): 0.6, ("3", "e"): 0.7, ("7", "t"): 0.7}
#: Letter groups taken for others (read, meant).
GROUPS = (("rn", "m"), ("m", "rn"), ("d", "cl"), ("cl", "d"), ("h", "li"), ("li", "h"), ("vv", "w"), ("ri", "n"), ("n", "ri"), ("ii", "u"))
#: Characters that body text of these files doesn't have inside words.
SIGNS = set("{}|~^¿¦")
HYPHENS = "-¬­"

_EDGES = ".,;:!?“”‘’\"'()[]–—…«»"
_LETTERS = re.compile(r"[\W\d_]+")
_PAGE_NO = re.compile(r"^\W*(?:tran[g9]|pa[g9]e|tr|p)?\W*([\dlIO|SBZ]+)\W*(?:(?:/|of|trên|tren)\W*[\dlIO|SBZ]+)?\W*$", re.IGNORECASE)
_AS_DIGIT = str.maketrans("lIi|OoSsBbZz", "111100558822")
_BROKEN = re.compile(r"([^\s-]*[^\W\d_][{}|~^¿¦]?)[" + HYPHENS + r"]\s*$")
_ACCENT = re.compile(r"[^\W\d_a-zA-Z]")
#: What a token is, in one number: a word of letters, one whose accented form is far commoner, one to be weighed by its neighbours, a misread one.
_WORD, _BARE, _WEIGH, _MISREAD = 1, 2, 4, 8
_PLAIN = {0, _WORD}


class Trie:
    """Vocabulary trie in arrays, level by level; :meth:`within` intersects it with the Levenshtein automata of many words at once.

    A node's children lie side by side on the next level, so the trie is three arrays a level: character, first child, word.
    """

    def __init__(self, words: Iterable[str]):
        self.words = sorted({w for w in words if w})
        n = len(self.words)
        sizes = np.fromiter(map(len, self.words), np.int64, n)
        flat = np.frombuffer("".join(self.words).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.cumsum(sizes) - sizes
        #: of each level the characters, the first child of each node (one more than nodes), and the word that ends there or -1
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        alive, node, parents = np.arange(n), np.zeros(n, np.int64), 1
        depth = 0
        while len(alive):
            char = flat[starts[alive] + depth]
            new = np.ones(len(alive), bool)
            new[1:] = (char[1:] != char[:-1]) | (node[1:] != node[:-1])
            own = np.cumsum(new) - 1
            first = np.searchsorted(node[new], np.arange(parents + 1))
            ends = np.full(int(own[-1]) + 1, -1, np.int32)
            last = sizes[alive] == depth + 1
            ends[own[last]] = alive[last]
            self.levels.append((char[new].astype(np.int32), first.astype(np.int32), ends))
            alive, node, parents = alive[~last], own[~last], len(ends)
            depth += 1

    def within(self, asked: list[str], distance: int) -> list[list[tuple[str, int]]]:
        """Of each asked word all vocabulary words at most ``distance`` edits from it, with their distances.

        An automaton's state is the band of edit distances between the prefix walked so far and the asked word's prefixes of about
        that length. A pair of asked word and node is left as soon as no entry of its band is within ``distance``, so retrieval is
        complete and meets only live states; all pairs of a level step together.
        """
        out: list[list[tuple[str, int]]] = [[] for _ in asked]
        for low in range(0, len(asked), TRIE_BLOCK):
            self._walk(asked[low : low + TRIE_BLOCK], distance, out[low : low + TRIE_BLOCK])
        return out

    def _walk(self, asked: list[str], distance: int, out: list[list[tuple[str, int]]]) -> None:
        far, width = distance + 1, 2 * distance + 1
        sizes = np.array([len(w) for w in asked])
        code = np.full((len(asked), int(sizes.max()) + 2 * distance + 3 if len(asked) else 1), -1, np.int32)
        for i, w in enumerate(asked):
            code[i, : len(w)] = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32)
        who, node = np.arange(len(asked)), np.zeros(len(asked), np.int64)
        place = np.arange(-distance, distance + 1)
        band = np.where((place >= 0) & (place <= sizes[:, None]), place, far).astype(np.int8)
        for depth, (char, first, ends) in enumerate(self.levels, 1):
            start, many = first[node], first[node + 1] - first[node]
            total = int(many.sum())
            if not total:
                return
            source = np.repeat(np.arange(len(who)), many)
            child = np.arange(total) - np.repeat(np.cumsum(many) - many, many) + start[source]
            whose, old, c = who[source], band[source], char[child]
            new = np.full((total, width), far, np.int8)
            for b in range(width):
                j = depth - distance + b
                if j < 0 or j > code.shape[1] - 1:
                    continue
                best = old[:, b] + (code[whose, j - 1] != c) if j else np.full(total, far, np.int8)
                if b + 1 < width:
                    best = np.minimum(best, old[:, b + 1] + 1)
                if b:
                    best = np.minimum(best, new[:, b - 1] + 1)
                new[:, b] = np.where(j <= sizes[whose], np.minimum(best, far), far)
            live = new.min(1) < far
            who, node, band = whose[live], child[live], new[live]
            at = sizes[who] - depth + distance
            hit = np.flatnonzero((ends[node] >= 0) & (at >= 0) & (at < width))
            near = band[hit, at[hit]]
            for i, k in zip(hit[near < far], near[near < far]):
                out[who[i]].append((self.words[ends[node[i]]], int(k)))


class Vocabulary:
    """Known words with their counts and neighbours, and what can be told from them about a line."""

    def __init__(self, counts: dict[str, int], pairs: dict[tuple[str, str], int]):
        self.counts = dict(counts)
        for w in sorted(counts, key=counts.__getitem__):
            if any(self.counts.get(v, 0) >= OUTWEIGHS * counts[w] for v in variants(w)):
                self.counts.pop(w, None)
        #: word without accents -> occurrences of its accented forms, and those forms
        self.folded: Counter = Counter()
        self.forms: dict[str, list[str]] = {}
        for w, n in self.counts.items():
            if not w.isascii():
                plain = fold_word(w)
                self.folded[plain] += n
                self.forms.setdefault(plain, []).append(w)
        self.total = sum(self.counts.values()) or 1
        self.longest = max(map(len, self.counts), default=0)
        keys = np.fromiter((_pair(a, b) for a, b in pairs), np.uint64, len(pairs))
        order = np.argsort(keys)
        self.pair_keys, self.pair_counts = keys[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order]
        self.trie = Trie(self.counts)
        #: of asked words the known words near them, these with prices, what tokens are, and counts of asked pairs; all bounded
        self.near: dict[str, list[str]] = {}
        self.cache: dict[str, list[tuple[str, float]]] = {}
        self.kinds: dict[str, int] = {}
        self.asked: dict[tuple[str, str], int] = {}

    def __getstate__(self):
        return {**self.__dict__, "near": {}, "cache": {}, "kinds": {}, "asked": {}}

    def together(self, a: str, b: str) -> int:
        """How often ``b`` follows ``a``; 0 for a pair that isn't known."""
        n = self.asked.get((a, b))
        if n is None:
            if len(self.asked) > CACHE_WORDS:
                self.asked.clear()
            key = np.uint64(_pair(a, b))
            at = int(np.searchsorted(self.pair_keys, key))
            n = self.asked[a, b] = int(self.pair_counts[at]) if at < len(self.pair_keys) and self.pair_keys[at] == key else 0
        return n

    def learn(self, tokens: Iterable[str]) -> None:
        """Judge all ``tokens`` at once, so that the trie is walked for a whole batch of words together."""
        if len(self.kinds) > CACHE_WORDS:
            self.kinds.clear()
        new = set(tokens) - self.kinds.keys()
        self.retrieve({low for low in (t.strip(_EDGES + HYPHENS).lower() for t in new) if self._odd(low)})
        for t in new:
            self.kinds[t] = self._kind(t)

    def _odd(self, low: str) -> bool:
        """Whether ``low`` can be a misread word, for which candidates are needed."""
        return low not in self.counts and any(c.isalpha() for c in low)

    def retrieve(self, words: Iterable[str]) -> None:
        """Find the known words near all of ``words``."""
        if len(self.near) > CACHE_WORDS:
            self.near.clear()
            self.cache.clear()
        by_distance: dict[int, list[str]] = {}
        for low in words:
            if low not in self.near:
                self.near[low] = [v for v in variants(low) if v in self.counts]
                if len(low) <= self.longest + 3:
                    by_distance.setdefault(max(1, min(3, sum(c in SIGNS or c.isdigit() for c in low))), []).append(low)
        for distance, asked in by_distance.items():
            for low, got in zip(asked, self.trie.within(asked, distance)):
                self.near[low] += [known for known, _ in got]

    def around(self, word: str) -> list[str]:
        """Known words that ``word`` may have been, in no order."""
        low = word.lower()
        if low not in self.near:
            self.retrieve([low])
        return self.near[low]

    def candidates(self, word: str) -> list[tuple[str, float]]:
        """Known words that ``word`` may have been, with prices, the cheapest first."""
        low = word.lower()
        if low not in self.cache:
            groups = variants(low)
            found = {k: min(_price(low, k), 0.6) if k in groups else _price(low, k) for k in self.around(low)}
            self.cache[low] = sorted(((k, p - math.log(self.counts[k] / self.total) / 12) for k, p in found.items()), key=lambda x: (x[1], x[0]))
        return self.cache[low]

    def repair(self, word: str, before: str = "", after: str = "") -> str | None:
        """The likeliest known word for a misread one, given its neighbours; None where there is none."""
        options = self.candidates(word)
        if not options:
            return None
        best = min(options, key=lambda o: o[1] - 0.4 * math.log1p(self.together(before, o[0])) - 0.4 * math.log1p(self.together(o[0], after)))[0]
        return _cased(best, word)

    def misread(self, token: str) -> bool:
        """Whether characters of a word (its outer punctuation taken off) were misread, as far as the word alone tells."""
        return self.kind(token) >= _MISREAD

    def kind(self, token: str) -> int:
        if token not in self.kinds:
            self.learn([token])
        return self.kinds[token]

    def _kind(self, token: str) -> int:
        low = token.strip(_EDGES + HYPHENS).lower()
        kind = _MISREAD if self._misread(token) else 0
        if low.isalpha():
            kind |= _WORD
            if self.folded.get(low, 0) > 10 * self.counts.get(low, 0):
                kind |= _BARE
            elif not kind & _MISREAD and low not in self.counts and len(low) >= CONTEXT_LETTERS and self.around(low):
                kind |= _WEIGH
        return kind

    def _misread(self, token: str) -> bool:
        core = token.strip(_EDGES + HYPHENS)
        if not core or not any(c.isalpha() for c in core):
            return bool(core) and all(c in SIGNS for c in core)
        if any(c in SIGNS for c in core):
            return True
        low = core.lower()
        if low in self.counts:
            return False
        if any(c.isdigit() for c in core):
            if _CODE.match(core) or "/" in core or sum(c.isalpha() for c in core) < 1:
                return False
            return any(_only_confused(low, k) for k in self.around(core))
        if not core.isalpha():
            return False
        return any(v in self.counts for v in variants(low))

    def misread_here(self, token: str, before: str, after: str) -> bool:
        """Whether an unknown word of letters was misread: a candidate of the trie far commoner than it stands between just these neighbours."""
        low, a, b = (t.strip(_EDGES + HYPHENS).lower() for t in (token, before, after))
        if not a or not b or token[:1].isupper():
            return False
        return any(self.together(a, k) and self.together(k, b) for k in self.around(low))

    def misread_halves(self, head: str, tail: str) -> tuple[bool, bool]:
        """Of a word broken over two lines, whether characters of the first and of the second half were misread, judged by the joined word."""
        head, tail = head.rstrip(HYPHENS).lstrip(_EDGES), tail.rstrip(_EDGES + HYPHENS)
        a, b = head.lower(), tail.lower()
        if a + b in self.counts or any(c in SIGNS for c in a + b):
            return False, False
        if any(c.isdigit() for c in a + b):
            wrong = self.misread(head + tail)
            return wrong and any(c.isdigit() for c in a), wrong and any(c.isdigit() for c in b)
        if not (a + b).isalpha():
            return False, False
        first, second = any(v + b in self.counts for v in variants(a)), any(a + v in self.counts for v in variants(b))
        if first or second:
            return first, second
        both = any(v + w in self.counts for v in variants(a) for w in variants(b))
        return both, both

    def lost_accents(self, line: str, kinds: Iterable[int]) -> bool:
        """Whether a line of accented writing has no accent left; ``kinds`` are those of its tokens."""
        kinds = list(kinds)
        gone = sum(k & _BARE for k in kinds)
        return bool(gone) and not _ACCENT.search(line) and gone // _BARE * 3 >= sum(k & _WORD for k in kinds)


def _pair(a: str, b: str) -> int:
    return word_hash(a + "\0" + b)


def _cased(word: str, like: str) -> str:
    return word.upper() if len(like) > 1 and like.isupper() else word[:1].upper() + word[1:] if like[:1].isupper() else word


_CODE = re.compile(r"^(?:[A-ZĐ]{1,4}\d+[a-zA-Z]?(?:-\d+)?|\d+(?:[.,:/-]\d+)*[%a-z]?|\d+/\S+)$")


def variants(word: str) -> set[str]:
    """``word`` with one letter group exchanged, everywhere or in one place."""
    out = set()
    for read, meant in GROUPS:
        at = word.find(read)
        if at >= 0:
            out.add(word.replace(read, meant))
        while at >= 0:
            out.add(word[:at] + meant + word[at + len(read) :])
            at = word.find(read, at + 1)
    out.discard(word)
    return out


_PLAIN_LETTER = WordCache(fold_word)


def _price(read: str, meant: str) -> float:
    row = [j * 1.0 for j in range(len(meant) + 1)]
    for i, a in enumerate(read, 1):
        drop = 0.4 if a in SIGNS else 1.0
        new = [row[0] + drop]
        for j, b in enumerate(meant, 1):
            change = 0.0 if a == b else 0.5 if a in SIGNS else CONFUSED.get((a, b), CONFUSED.get((a, _PLAIN_LETTER[b]), 1.2))
            new.append(min(row[j] + drop, new[-1] + 1.0, row[j - 1] + change))
        row = new
    return row[-1]


def _only_confused(read: str, meant: str) -> bool:
    """Equal but for digits that are taken for letters."""
    return len(read) == len(meant) and all(a == b or a.isdigit() and ((a, b) in CONFUSED or (a, _PLAIN_LETTER[b]) in CONFUSED) for a, b in zip(read, meant))


_LETTERS_OF = WordCache(lambda raw: _LETTERS.sub("", fold_word(raw)))


def edge_key(line: str) -> str:
    """Letters of a line without case and accents; what is equal in running lines that differ in numbers."""
    return "".join(map(_LETTERS_OF.__getitem__, line.split()))


def near(a: str, b: str) -> bool:
    """Equal but for misread characters: at most an eighth, and one, of the letters edited."""
    if a == b:
        return True
    n, m = len(a), len(b)
    bound = max(1, m // 8)
    if abs(n - m) > bound:
        return False
    far = bound + 1
    row = {j: j for j in range(min(m, bound) + 1)}  # only the band within reach of the bound
    for i in range(1, n + 1):
        new = {}
        for j in range(max(0, i - bound), min(m, i + bound) + 1):
            best = row.get(j, far) + 1
            if j:
                best = min(best, new.get(j - 1, far) + 1, row.get(j - 1, far) + (a[i - 1] != b[j - 1]))
            new[j] = best
        if min(new.values()) > bound:
            return False
        row = new
    return row.get(m, far) <= bound


def page_edges(lines: list[str], depth: int = EDGE) -> tuple[list[int], list[int]]:
    """Places of the first and of the last ``depth`` lines with text, from the edge inwards. A line is in one of them at most."""
    some = [i for i, line in enumerate(lines) if line.strip()]
    return some[:depth], some[: max(depth, len(some) - depth) - 1 : -1] if len(some) > depth else []


def profile_pages(pages: DataFrame) -> DataFrame:
    """(kind, a, b, n): what the pages hold, counted within each batch before the only shuffle.

    'page': number of pages of source a. 'top' and 'bottom': pages of source a with the line key b among their EDGE outer lines,
    'inner top' and 'inner bottom': as the innermost of these. 'word': occurrences of word a, 'pair': of a before b.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            edges: Counter = Counter()
            words = _Numbers()
            flat: list[int] = []
            for source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines = text.split("\n")
                edges["page", source, ""] += 1
                edges.update(_edge_counts(source, lines, EDGE))
                cut = False  # words that a hyphen cuts don't count
                for line in lines:
                    some = list(map(words.__getitem__, line.split()))
                    if some and cut:
                        some[0] = 0
                    cut = bool(some) and line.rstrip()[-1] in HYPHENS
                    if cut:
                        some[-1] = 0
                    flat += some
                    flat.append(0)
            rows = [(*k, n) for k, n in edges.items()] + [("word", w, "", n) for w, n in words.counts(flat)] + [("pair", *k, n) for k, n in words.pairs(flat)]
            if rows:
                yield list(zip(*rows))

    return map_arrow(pages.select("source", "text"), run, "kind string, a string, b string, n bigint").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


def _edge_counts(source: str, lines: list[str], depth: int) -> set[tuple[str, str, str]]:
    out = set()
    for side, places in zip(("top", "bottom"), page_edges(lines, depth)):
        for at, i in enumerate(places, 1):
            key = edge_key(lines[i])
            if key and not _PAGE_NO.match(lines[i]):
                out.add((side, source, key))
                if at == depth:
                    out.add((f"inner {side}", source, key))
    return out


class _Numbers(dict):
    """Raw token -> number of its word in order of appearance, 0 for what is no word; counts words and pairs of a batch in NumPy."""

    def __init__(self):
        super().__init__()
        self.number: dict[str, int] = {"": 0}

    def __missing__(self, raw: str) -> int:
        word = raw.strip(_EDGES).lower()
        self[raw] = n = self.number.setdefault(word, len(self.number)) if word.replace("-", "").isalpha() else 0
        return n

    def counts(self, flat: list[int]) -> Iterator[tuple[str, int]]:
        """(word, occurrences) of the words among ``flat``, numbers with 0 between lines."""
        names, n = list(self.number), np.bincount(np.array(flat, np.int64), minlength=1)
        return ((names[i], int(n[i])) for i in np.flatnonzero(n) if i)

    def pairs(self, flat: list[int]) -> Iterator[tuple[tuple[str, str], int]]:
        """((word, next word), occurrences)."""
        names, at = list(self.number), np.array(flat, np.int64)
        a, b = at[:-1], at[1:]
        both = (a > 0) & (b > 0)
        keys, n = np.unique(a[both] << 32 | b[both], return_counts=True)
        return (((names[k >> 32], names[k & 0xFFFFFFFF]), m) for k, m in zip(keys.tolist(), n.tolist()))


def running_lines(pages: DataFrame, profile: DataFrame) -> DataFrame:
    """(source, depth, tops, bottoms): keys of the lines repeated at the edges of a file's pages, and how deep they lie.

    ``profile`` has the counts of the EDGE outer lines. Files whose innermost counted line repeats are looked at again EDGE lines deeper,
    until none is left, so a header of any height is found. Counts are aggregated map-side, so a large file moves few rows.
    """
    total = profile.where("kind = 'page'").select("a", F.col("n").alias("pages"))
    least = F.greatest(F.lit(RUNNING_PAGES), F.ceil(F.col("pages") * RUNNING_SHARE))
    enough = (F.col("n") >= least) & ((F.col("n") > 2) | (F.length("b") >= 8))
    counts, depth, found = profile, EDGE, None
    while True:
        often = materialize(counts.where(F.col("kind").isin("top", "bottom", "inner top", "inner bottom")).join(total, "a").where(enough).select("kind", "a", "b"), "edges")
        mine = often.where(~F.col("kind").startswith("inner")).withColumn("depth", F.lit(depth))
        found = mine if found is None else found.unionByName(mine)
        deeper = often.where(F.col("kind").startswith("inner")).select(F.col("a").alias("source")).distinct()
        n = deeper.count()
        if not n:
            break
        depth += EDGE

        def run(batches: Iterator[pa.RecordBatch], depth: int = depth) -> Iterator[list]:
            for batch in batches:
                own: Counter = Counter()
                for source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    own.update(_edge_counts(source, text.split("\n"), depth))
                if own:
                    yield [*zip(*own), list(own.values())]

        again = pages.select("source", "text").join(broadcast_if_small(deeper, n, BROADCAST_SOURCES), "source", "left_semi")
        counts = map_arrow(again, run, "kind string, a string, b string, n bigint").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    keys = lambda side: F.sort_array(F.collect_set(F.when(F.col("kind") == side, F.col("b"))))
    return found.groupBy(F.col("a").alias("source")).agg(F.max("depth").alias("depth"), keys("top").alias("tops"), keys("bottom").alias("bottoms"))


def train_vocabulary(profile: DataFrame, known: int = KNOWN, share: float = KNOWN_SHARE) -> Vocabulary:
    """The words and neighbouring pairs that make at least ``known`` and a ``share`` of all words; no more than 1 / share of each can, so they fit the driver and a broadcast."""
    total = profile.where("kind = 'word'").agg(F.sum("n").alias("n")).first()["n"] or 0
    often = profile.where(F.col("kind").isin("word", "pair") & (F.col("n") >= max(known, math.ceil(total * share))))
    words: dict[str, int] = {}
    pairs: dict[tuple[str, str], int] = {}
    for batch in often.toArrow().to_batches():  # Arrow's form: a row object each would take several times the memory
        for kind, a, b, n in zip(*(batch.column(c).to_pylist() for c in ("kind", "a", "b", "n"))):
            if kind == "word":
                words[a] = n
            else:
                pairs[a, b] = n
    return Vocabulary(words, pairs)


def classify_lines(lines: list[str], page: int | None, tops: list[str], bottoms: list[str], depth: int = EDGE) -> list[str]:
    """Of each line 'running', 'page_no' or ''. Beyond the EDGE outer lines only those count that lie behind nothing but furniture."""
    out = [""] * len(lines)
    top, bottom = page_edges(lines, max(depth, EDGE))
    for some, keys in ((top, tops), (bottom, bottoms)):
        for at, i in enumerate(some):
            if at >= EDGE and not all(out[k] for k in some[:at]):
                break
            m = _PAGE_NO.match(lines[i])
            if m and page is not None and m.group(1).translate(_AS_DIGIT) == str(page):
                out[i] = "page_no"
            elif not out[i] and keys:
                key = edge_key(lines[i])
                if key and any(near(key, k) for k in keys):
                    out[i] = "running"
    return out


def _body(lines: list[str], kinds: list[str]) -> list[int]:
    return [i for i, k in enumerate(kinds) if not k and lines[i].strip()]


def repair_page(vocabulary: Vocabulary, text: str, page: int | None, tops: list[str], bottoms: list[str], next_word: str | None, last_word: str | None = None, depth: int = EDGE, tokens_of: list[list[str]] | None = None) -> tuple[list[tuple[int, str]], str]:
    """(line number, kind) of the lines that need repair, and the page's text: paragraphs of one line each, furniture removed, words joined and repaired.

    ``next_word`` is the first body word of the file's next page, ``last_word`` the last one of the page before. A word broken at the
    end of a page is completed there, and the page that follows doesn't say its tail again. Misreadings in a broken word are judged by
    the joined word and given to the line of their half. ``tokens_of`` are the lines' tokens, where they are known.
    """
    lines = text.split("\n")
    tokens_of = tokens_of or [line.split() for line in lines]
    found, body = [], []
    for i, k in enumerate(classify_lines(lines, page, tops, bottoms, depth)):
        if k:
            found.append((i + 1, k))
        elif tokens_of[i]:
            body.append(i)
    split = [tokens_of[i] for i in body]
    width = max((len(lines[i]) for i in body), default=0)
    kind = vocabulary.kinds.get
    out: list[str] = []
    carry = ""
    start = last_word if last_word and body and _is_broken(vocabulary, last_word, split[0][0]) else ""
    for at, (i, tokens) in enumerate(zip(body, split)):
        follows = split[at + 1][0] if at + 1 < len(body) else next_word
        broken = tokens[-1][-1] in HYPHENS and _is_broken(vocabulary, tokens[-1], follows)
        head = carry if at else start
        inner = tokens[1 if head else 0 : -1 if broken else None]
        seen = set(map(kind, inner))
        if None in seen:
            seen = set(map(vocabulary.kind, inner))
        if not head and not broken and seen <= _PLAIN:
            glue = " ".join(tokens)
            if out and not _ends_paragraph(lines, body, at - 1, width):
                out[-1] += " " + glue
            else:
                out.append(glue)
            carry = ""
            continue
        kinds = [vocabulary.kinds[t] for t in inner]
        no_accents = any(k & _BARE for k in seen) and vocabulary.lost_accents(lines[i], [*kinds, *(vocabulary.kind(t) for t in (tokens[:1] if head else []) + (tokens[-1:] if broken else []))])
        wrong = [k >= _MISREAD for k in kinds]
        if any(k & _WEIGH for k in seen):
            for n, k in enumerate(kinds):
                if k & _WEIGH:
                    wrong[n] = vocabulary.misread_here(inner[n], inner[n - 1] if n else "", inner[n + 1] if n + 1 < len(inner) else "")
        misread = no_accents or any(wrong)
        if not misread and (head or broken):
            cut = [*(tokens[:1] if head else []), *(tokens[-1:] if broken else [])]
            misread = any(c in SIGNS for t in cut for c in t) or any(_digit_inside(t) for t in cut) or head and vocabulary.misread_halves(head, tokens[0])[1] or broken and bool(follows) and vocabulary.misread_halves(tokens[-1], follows)[0]
        if broken:
            found.append((i + 1, "broken_word"))
        if misread:
            found.append((i + 1, "misread"))
        rest = tokens[-1].rstrip(HYPHENS) if broken else ""
        if carry and broken and len(tokens) == 1:
            joined, wrong, carry = [], [], carry + rest
        else:
            joined = [carry + tokens[0], *inner] if carry else list(inner)
            wrong = [vocabulary.misread(joined[0]), *wrong] if carry else wrong
            carry = rest
        if broken and at + 1 == len(body):
            joined.append(carry + (follows or ""))
            wrong.append(vocabulary.misread(joined[-1]))
        if misread or any(wrong):
            _mend(vocabulary, joined, wrong, no_accents)
        glue = " ".join(joined)
        if out and not _ends_paragraph(lines, body, at - 1, width):
            out[-1] = (out[-1] + " " + glue).strip()
        elif glue:
            out.append(glue)
    return sorted(found), "\n".join(out)


def _mend(vocabulary: Vocabulary, words: list[str], wrong: list[bool], no_accents: bool) -> None:
    """Put the likeliest words for the misread ones and for those that lost their accents, in place."""
    for k, (t, bad) in enumerate(zip(words, wrong)):
        if bad or no_accents and vocabulary.kind(t) & _BARE:
            core = t.strip(_EDGES)
            before = words[k - 1].strip(_EDGES).lower() if k else ""
            after = words[k + 1].strip(_EDGES).lower() if k + 1 < len(words) else ""
            better = vocabulary.repair(core, before, after) if bad else _accented(vocabulary, core, before, after)
            if better:
                words[k] = t.replace(core, better)


def _ends_paragraph(lines: list[str], body: list[int], at: int, width: int) -> bool:
    """Whether a paragraph ends with a line: it ends a sentence, and an empty line follows or it is short."""
    here = lines[body[at]].rstrip()
    if here[-1:] not in ".!?:”":
        return False
    if at + 1 < len(body) and body[at + 1] > body[at] + 1:
        return True
    return len(here) < 0.8 * width


def _accented(vocabulary: Vocabulary, word: str, before: str, after: str) -> str | None:
    """The accented form of a word without accents that fits its neighbours best."""
    forms = vocabulary.forms.get(word.lower())
    if not forms:
        return None
    best = max(forms, key=lambda w: (math.log1p(vocabulary.together(before, w)) + math.log1p(vocabulary.together(w, after)) + 0.2 * math.log1p(vocabulary.counts[w]), w))
    return _cased(best, word)


def _digit_inside(token: str) -> bool:
    core = token.strip(_EDGES + HYPHENS)
    return any(c.isdigit() for c in core) and core[:1].islower() and sum(c.isalpha() for c in core) >= 2 and not _CODE.match(core)


def _is_broken(vocabulary: Vocabulary, last: str, follows: str | None) -> bool:
    """Whether ``last``, the last word of a line, goes on in ``follows``."""
    if last[-1] not in HYPHENS or not _BROKEN.search(last):
        return False
    stem = last.rstrip(HYPHENS)
    if any(c.isdigit() for c in stem) and (_CODE.match(stem.strip(_EDGES)) or "/" in stem):
        return False
    if last[-1] != "-":
        return True
    head = stem.strip(_EDGES).lower()
    if not follows:
        return head not in vocabulary.counts or len(head) < 3
    tail = follows.strip(_EDGES).lower()
    if head + tail in vocabulary.counts:
        return True
    if head + "-" + tail in vocabulary.counts:
        return False
    return follows[:1].islower() or any(c in SIGNS for c in follows)


def mend_scans(pages: DataFrame, known: int = KNOWN) -> DataFrame:
    """(source, page, found array<struct<line_no, kind>>, text, continues): one row per page with the lines that need repair and the repaired text.

    Method: the words of a share of all words go into a trie, which is intersected with the Levenshtein automata of all unknown words
    of a batch for complete candidates; prices of the scanner's confusions, frequencies and the neighbouring words rank them. Lines
    repeated at the edges of a file's pages and lines that give the page's number are removed; broken words are joined, also over the
    page end; lines are joined into paragraphs. ``continues`` says that the first paragraph goes on from the page before.

    Equal rows count once; rows without source or text are left out; a null page is a page without number and neighbours. Pages are
    distributed by (source, page), so a file of any size spreads over all tasks, and their texts are shuffled once: all passes read
    the table bucketed that way. A page needs only the running lines of its file and the outer words of its neighbours.
    """
    kind = column_type(pages, "page")
    some = pages.select("source", "page", "text").where(F.col("source").isNotNull() & F.col("text").isNotNull())
    some = bucketed(some, ["source", "page"], "pages")
    profile = materialize(profile_pages(some), "profile")
    vocabulary = some.sparkSession.sparkContext.broadcast(train_vocabulary(profile, known))
    running = materialize(running_lines(some, profile), "running")
    running = broadcast_if_small(running, running.count(), BROADCAST_SOURCES)
    none = F.array().cast("array<string>")

    def furnished(rows: DataFrame, *more: str) -> DataFrame:
        return rows.join(running, "source", "left").select("source", "page", "text", F.coalesce("tops", none).alias("tops"), F.coalesce("bottoms", none).alias("bottoms"), F.coalesce("depth", F.lit(EDGE)).alias("depth"), *more)

    def edge_words(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            first, last, open_ = [], [], []
            for page, text, tops, bottoms, depth in zip(*(batch.column(k).to_pylist() for k in range(1, 6))):
                lines = text.split("\n")
                body = _body(lines, classify_lines(lines, page, tops, bottoms, depth))
                first.append(lines[body[0]].split()[0] if body else None)
                last.append(lines[body[-1]].split()[-1] if body else None)
                open_.append(bool(body) and not _ends_paragraph(lines, body, len(body) - 1, max(len(lines[i]) for i in body)))
            yield [batch.column(0), batch.column(1), first, last, open_]

    edges = map_arrow(furnished(some), edge_words, f"source string, page {kind}, first string, last string, open boolean")
    nobody, shut = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    beside = F.explode(F.array(
        F.struct((F.col("page") - 1).cast(kind).alias("page"), F.col("first").alias("next_word"), nobody.alias("last_word"), shut.alias("open")),
        F.struct((F.col("page") + 1).cast(kind).alias("page"), nobody.alias("next_word"), F.col("last").alias("last_word"), F.col("open").alias("open")),
    ))
    words = edges.where(F.col("page").isNotNull()).select("source", beside.alias("w")).select("source", "w.*").groupBy("source", "page").agg(F.min("next_word").alias("next_word"), F.min("last_word").alias("last_word"), F.max("open").alias("open"))
    ready = furnished(some.join(words, ["source", "page"], "left"), "next_word", "last_word", "open")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        known_words = vocabulary.value
        for batch in batches:
            text = batch.column(2).to_pylist()
            tokens = [[line.split() for line in page.split("\n")] for page in text]
            known_words.learn(set().union(*chain.from_iterable(tokens)))
            got = [repair_page(known_words, *page) for page in zip(text, *(batch.column(k).to_pylist() for k in (1, 3, 4, 6, 7, 5)), tokens)]
            yield [batch.column(0), batch.column(1), [[{"line_no": n, "kind": k} for n, k in found] for found, _ in got], [text for _, text in got], batch.column(8)]

    mended = map_arrow(ready, run, f"source string, page {kind}, found array<struct<line_no: int, kind: string>>, text string, open boolean")
    return mended.select("source", "page", "found", "text", (F.coalesce("open", F.lit(False)) & (F.col("text") != "")).alias("continues"))


def paragraphs(mended: DataFrame) -> DataFrame:
    """(source, page, paragraph_no, text): the paragraphs of every file in page order, each at the page it begins on.

    A paragraph that goes on over page ends is joined there, over as many pages as it has; the page it begins on is handed on through
    ranged partitions, so no task holds a file. Pages without text have none.
    """
    pages = mended.where("text <> ''").select("source", "page", F.split("text", "\n").alias("parts"), "continues")
    pages = pages.withColumn("own", F.when(~F.col("continues") | (F.size("parts") > 1), F.struct("page", F.size("parts").alias("n"))))
    known = fill_forward(pages.where(F.col("page").isNotNull()).select("source", "page", "continues", F.size("parts").alias("n"), "own"), "source", ["page"], "own", "last", strict=True)
    begins = pages.join(known.where("continues").select("source", "page", "last"), ["source", "page"], "left")
    rows = begins.select("source", "page", "continues", "last", F.posexplode("parts").alias("at", "part"))
    goes_on = F.col("continues") & (F.col("at") == 0) & F.col("last").isNotNull()
    placed = rows.select("source", F.when(goes_on, F.col("last.page")).otherwise(F.col("page")).alias("begins"), F.when(goes_on, F.col("last.n")).otherwise(F.col("at") + 1).alias("paragraph_no"), "page", "part")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "part"))), lambda x: x["part"]), " ")
    return placed.groupBy("source", "begins", "paragraph_no").agg(joined.alias("text")).select("source", F.col("begins").alias("page"), "paragraph_no", "text")


def scan_lines(spark, sf_dir: str) -> DataFrame:
    return mend_scans(table(spark, sf_dir, "scan_pages")).select("source", "page", F.explode("found").alias("f")).select("source", "page", "f.line_no", "f.kind").distinct()


def scan_paragraphs(spark, sf_dir: str) -> DataFrame:
    return paragraphs(mend_scans(table(spark, sf_dir, "scan_pages")))
