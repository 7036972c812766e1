"""Problem 9: passages of held-out test items inside a corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordCache, broadcast_if_small, column_type, fold_tokens, map_arrow, materialize, table

_WORD = re.compile(r"\S+")

#: A passage is a leak from this many words of an item on.
MIN_WORDS = 14
#: At most this share of a passage may be edits: words added, dropped or replaced, one edit each, against the equal words and the edits together.
MAX_EDIT_SHARE = 0.12
#: Words edited side by side, at most, and equal words that must follow an edit.
EDITS_BESIDE, EQUAL_BEHIND = 2, 2
#: Length of an exact run from which an alignment is tried. Complete: 14 equal words with at most 12 % edits hold a run of five.
SEED_WORDS = 5
#: Words within which a passage's equal triples are counted before the automaton is asked, and words looked at beside them.
WINDOW, MARGIN = 20, 8
#: Size of the tables of known word triples and runs, as a power of two; more only lets fewer strangers through.
SLOT_BITS = 22
#: Documents with leaks whose spans are broadcast, at most; more are joined.
BROADCAST_ROWS = 100_000
#: Words of the test items that one automaton holds, at most (about 0.5 KB each); it is broadcast. More items come in several automata, and the corpus passes by each.
MAX_ITEM_WORDS = 100_000
#: Places in items from which on those that can't reach a passage are sorted out before the alignment.
MANY_PLACES = 64


def _grams(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Table slot of the ``n`` words from each word on, and whether all of them are words of the items."""
    m = max(0, len(ids) - n + 1)
    code, known = ids[:m].copy(), ids[:m] > 0
    for k in range(1, n):
        code = code * np.uint64(0x9E3779B97F4A7C15) + ids[k : m + k]
        known &= ids[k : m + k] > 0
    return ((code * np.uint64(0x165667B19E3779F9)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64), known


class SuffixAutomaton:
    """Generalised suffix automaton over token-id sequences.

    ``occ[state]`` lists (text, end) of every occurrence of the state's longest word, so that a run found in
    a stream can be placed in the item it comes from. Built in time linear in the items' words.
    """

    def __init__(self, texts: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        own: list[list[tuple[int, int]]] = [[]]
        for k, words in enumerate(texts):
            last = 0
            for end, token in enumerate(words):
                last = self._extend(last, token, own)
                own[last].append((k, end))
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        self.occ = own
        for s in order:
            parent = self.link[s]
            if parent > 0:
                self.occ[parent] = self.occ[parent] + self.occ[s]

    def _state(self, length: int, nxt: dict[int, int], link: int, own: list) -> int:
        self.length.append(length)
        self.next.append(nxt)
        self.link.append(link)
        own.append([])
        return len(self.length) - 1

    def _extend(self, last: int, token: int, own: list) -> int:
        there = self.next[last].get(token)
        if there is not None:
            if self.length[there] == self.length[last] + 1:
                return there
            return self._split(last, token, there, own)
        cur = self._state(self.length[last] + 1, {}, 0, own)
        p = last
        while p != -1 and token not in self.next[p]:
            self.next[p][token] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][token]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, token, q, own)
        return cur

    def _split(self, p: int, token: int, q: int, own: list) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], own)
        self.link[q] = clone
        while p != -1 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def stream(self, ids: list[int]) -> tuple[bytearray, list[tuple[int, int, int]]]:
        """Longest match (at most 255) ending at each word, and (end, length, state) of every run of SEED_WORDS or more equal words.

        A run is told where the longest match ends, and, with its last SEED_WORDS words, where it ends in some item only while
        another goes on; so every such run of every item is met.
        """
        nxt, link, length, occ = self.next, self.link, self.length, self.occ
        state = n = tail = 0  # tail: state of the last SEED_WORDS words
        lengths, out = bytearray(len(ids)), []
        for i, token in enumerate(ids):
            step = nxt[state].get(token) if token else None
            if step is None:
                if n >= SEED_WORDS:
                    out.append((i, n, state))
                tail = 0
                if not token:
                    state = n = 0
                    continue
                while state and token not in nxt[state]:
                    state = link[state]
                    n = length[state]
                step = nxt[state].get(token)
                if step is None:
                    state = n = 0
                    continue
            elif tail and len(occ[nxt[tail][token]]) < len(occ[tail]):
                out.append((i, SEED_WORDS, tail))
            state = step
            n += 1
            if n >= SEED_WORDS:
                tail = state
                while length[link[tail]] >= SEED_WORDS:
                    tail = link[tail]
            lengths[i] = n if n < 255 else 255
        if n >= SEED_WORDS:
            out.append((len(ids), n, state))
        return lengths, out


_STEPS = sorted(((dx, dy) for dx in range(EDITS_BESIDE + 1) for dy in range(EDITS_BESIDE + 1) if dx or dy), key=lambda s: (max(s), s[0] != s[1], s))


def _grow(doc: list[int], item: list[int], i: int, j: int, step: int) -> list[tuple[int, int, int]]:
    """Prolong an exact run from (i, j) in direction ``step``; returns (item words passed before, document words passed before, equal words) of each stretch of equal words.

    At most EDITS_BESIDE words may be added, dropped or replaced at a time, the fewest that do, and at least EQUAL_BEHIND equal words must follow.
    """
    n, m = len(doc), len(item)
    x = y = 0
    out: list[tuple[int, int, int]] = []
    while True:
        size = 0
        while True:
            a, b = i + step * (x + size), j + step * (y + size)
            if not (0 <= a < n and 0 <= b < m and doc[a] == item[b] and doc[a]):
                break
            size += 1
        if size:
            out.append((y, x, size))
            x, y = x + size, y + size
        for dx, dy in _STEPS:
            ok = True
            for k in range(EQUAL_BEHIND):
                a, b = i + step * (x + dx + k), j + step * (y + dy + k)
                if not (0 <= a < n and 0 <= b < m and doc[a] == item[b] and doc[a]):
                    ok = False
                    break
            if ok:
                x, y = x + dx, y + dy
                break
        else:
            return out


def align(doc: list[int], item: list[int], end: int, item_end: int, length: int, min_words: int, max_edit_share: float) -> tuple[int, int, int, int] | None:
    """(item words in sequence, words matched, first, last document word) of the longest passage around or beside an exact run that holds
    ``min_words`` equal words and at most ``max_edit_share`` edits; None where there is none.

    The run is prolonged as far as it goes. As a passage's share only grows with the equal words at its ends, it begins and ends
    where stretches of equal words do; so all passages between two such stretches are weighed, not the whole alignment alone.
    """
    left = _grow(doc, item, end - length - 1, item_end - length, -1)
    right = _grow(doc, item, end, item_end + 1, 1)
    # (first item word, end, first document word, end) of the stretches, from left to right; those without an edit between them are one passage anyway
    first, begin = item_end + 1 - length, end - length
    parts = [(first - y - size, first - y, begin - x - size, begin - x) for y, x, size in reversed(left)]
    parts.append((first, item_end + 1, begin, end))
    parts += [(item_end + 1 + y, item_end + 1 + y + size, end + x, end + x + size) for y, x, size in right]
    best = None
    for p in range(len(parts)):
        matched = edits = 0
        for q in range(p, len(parts)):
            if q > p:
                edits += max(parts[q][0] - parts[q - 1][1], parts[q][2] - parts[q - 1][3])
            matched += parts[q][1] - parts[q][0]
            span = parts[q][1] - parts[p][0]
            if matched >= min_words and edits <= max_edit_share * (matched + edits) and (best is None or span > best[0]):
                best = (span, matched, parts[p][2], parts[q][3])
    return best


def least_exact(min_words: int, max_edit_share: float, gram: int) -> int:
    """The fewest runs of ``gram`` equal words that a passage of ``min_words`` equal words or more with at most that share of edits can hold: e edits cut m equal words into e + 1 runs."""
    share = max_edit_share / (1 - max_edit_share)
    return max(1, min(m - (gram - 1) * (int(share * m + 1e-9) + 1) for m in range(min_words, 4 * min_words)))


class LeakFinder:
    """Streams documents' words through the automaton; see :func:`find_leaks`."""

    def __init__(self, items: list[tuple[int, str, str]], min_words: int = MIN_WORDS, max_edit_share: float = MAX_EDIT_SHARE):
        vocab: dict[str, int] = {}
        self.owner, texts = [], []
        for item_id, field, text in items:
            words = fold_tokens(text or "")
            texts.append([vocab.setdefault(w, len(vocab) + 1) for w in words])
            self.owner.append((item_id, field))
        self.texts, self.vocab, self.min_words, self.max_edit_share = texts, vocab, min_words, max_edit_share
        self.automaton = SuffixAutomaton(texts)
        self.grams = {n: np.zeros(1 << SLOT_BITS, bool) for n in (3, SEED_WORDS)}
        for words in texts:
            for n, slots in self.grams.items():
                slots[_grams(np.array(words, np.uint64), n)[0]] = True
        self.least_triples, self.least_runs = (least_exact(min_words, max_edit_share, n) for n in (3, SEED_WORDS))
        self.cache = None

    def __getstate__(self):
        return {**self.__dict__, "cache": None}

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts (0: not a word of any item) and where each text begins."""
        if self.cache is None:
            get = self.vocab.get
            self.cache = WordCache(lambda raw: tuple(get(w, 0) for w in fold_tokens(raw)))
        lookup = self.cache.__getitem__
        each = [list(chain.from_iterable(map(lookup, text.split()))) for text in texts]
        starts = np.cumsum([0, *map(len, each)])
        return np.fromiter(chain.from_iterable(each), np.uint64, int(starts[-1])), starts

    def promising(self, ids: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, first, end) of the stretches in which WINDOW words hold ``least_runs`` equal runs of SEED_WORDS and ``least_triples`` equal triples.

        A necessary condition of every passage within the edit bound (:func:`least_exact`), so no leak is lost; slots may collide, which only lets more through.
        """
        n = len(ids)
        if n < self.min_words:
            return []
        near = np.ones(n, bool)
        for size, least in ((3, self.least_triples), (SEED_WORDS, self.least_runs)):
            slots, known = _grams(ids, size)
            total = np.concatenate([[0], np.cumsum(self.grams[size][slots] & known)])
            i = np.arange(n)
            near &= total[np.clip(i + WINDOW - size + 1, 0, len(total) - 1)] - total[np.clip(i, 0, len(total) - 1)] >= least
        at = np.flatnonzero(near)
        if not len(at):
            return []
        cut = np.flatnonzero(np.diff(at) > WINDOW + 2 * MARGIN)
        out = []
        for first, end in zip(at[np.r_[0, cut + 1]] - MARGIN, at[np.r_[cut, len(at) - 1]] + WINDOW + MARGIN):
            k = max(0, int(np.searchsorted(starts, max(first, 0), "right")) - 1)
            while k + 1 < len(starts) and starts[k] < end:
                a, b = max(int(first), int(starts[k])), min(int(end), int(starts[k + 1]))
                if b - a >= self.min_words:
                    out.append((k, a - int(starts[k]), b - int(starts[k])))
                k += 1
        return out

    def find_all(self, texts: list[str]) -> list[list[tuple]]:
        """Of each text the leaked items: (item, field, words in sequence, words matched, first, last word), the longest passage of each."""
        best: list[dict] = [{} for _ in texts]
        for k, hits in enumerate(self.passages(texts)):
            for item, field, span, *rest in hits:
                if span > best[k].get((item, field), (0,))[0]:
                    best[k][item, field] = (span, *rest)
        return [[(*key, *hit) for key, hit in found.items()] for found in best]

    def passages(self, texts: list[str]) -> list[list[tuple]]:
        """Of each text all passages, those of an item within another left out."""
        ids, starts = self.words(texts)
        out: list[list[tuple]] = [[] for _ in texts]
        for k, a, b in self.promising(ids, starts):
            base = int(starts[k])
            out[k] += [(item, field, span, matched, first + a, last + a) for item, field, span, matched, first, last in self.find(ids[base + a : base + b].tolist())]
        return out

    def find(self, doc: list[int]) -> list[tuple[int, str, int, int, int, int]]:
        """(item, field, item words in sequence, words matched, first, last word) of each leaked item, its longest passages that don't overlap."""
        lengths, runs = self.automaton.stream(doc)
        around = self.min_words - 2
        link, length, occ = self.automaton.link, self.automaton.length, self.automaton.occ
        short = self.least_triples + 2  # words of a run that alone holds so many triples
        marks = bytes(1 if x >= 3 else 0 for x in lengths) if any(back < short for _, back, _ in runs) else b""
        seeds = []
        for end, back, state in runs:
            # a passage within the edit bound has so many exact word triples near each of its runs
            if back < short and marks.count(1, max(0, end - back - around), end + around) < self.least_triples:
                continue
            while state > 0 and back >= SEED_WORDS:
                seeds.append((end, back, occ[state]))
                state = link[state]
                back = length[state] if state > 0 else 0
        if sum(len(places) for _, _, places in seeds) > MANY_PLACES:
            # items that share the runs of a template only: all their runs here together must hold enough triples
            held: dict[int, dict[int, int]] = {}
            for end, back, places in seeds:
                for k in {k for k, _ in places}:
                    held.setdefault(k, {})[end] = lengths[end - 1] - 2
            able = {k for k, own in held.items() if sum(own.values()) + self._short_triples(lengths) >= self.least_triples}
        else:
            able = None
        found: dict[int, list[tuple]] = {}
        tried: set[tuple[int, int, int]] = set()
        for end, back, places in seeds:
            for k, item_end in places:
                if able is not None and k not in able or any(f[2] < end <= f[3] and (k, f[2], end - item_end) in tried for f in found.get(k, ())):
                    continue
                got = align(doc, self.texts[k], end, item_end, back, self.min_words, self.max_edit_share)
                if got:
                    tried.add((k, got[2], end - item_end))
                    found.setdefault(k, []).append(got)
        out = []
        for k, hits in found.items():
            taken: list[tuple] = []
            for hit in sorted(set(hits), key=lambda h: (-h[0], h[2])):
                if all(hit[3] <= t[2] or hit[2] >= t[3] for t in taken):
                    taken.append(hit)
            out += [(*self.owner[k], *hit) for hit in taken]
        return [h for h in out if not self._another_s(h, out)]

    @staticmethod
    def _another_s(hit: tuple, hits: list[tuple]) -> bool:
        """Whether a passage with edits lies within another item's passage of more equal words: it is that item's text, and what it shares with this item is their common template."""
        _, _, span, matched, first, last = hit
        return (matched < span or matched < last - first) and any(h[0] != hit[0] and h[3] > matched and h[4] <= first and last <= h[5] for h in hits)

    @staticmethod
    def _short_triples(lengths: bytearray) -> int:
        """Triples in runs too short for a seed, which any item may have: those of words whose longest run has three or four."""
        return sum(1 for i, x in enumerate(lengths) if 3 <= x < SEED_WORDS and (i + 1 == len(lengths) or lengths[i + 1] <= x))


def item_blocks(items: DataFrame, id_col: str = "id", fields: tuple[str, ...] = ("question", "answer"), max_words: int = MAX_ITEM_WORDS) -> Iterator[list[tuple[int, str, str]]]:
    """The test items on the driver, in blocks of about ``max_words`` words, so that an automaton's size is bounded."""
    words = reduce(add, (F.coalesce(F.size(F.split(F.trim(F.col(f)), r"\s+")), F.lit(0)) for f in fields))
    total = items.agg(F.sum(words).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // max_words))
    for b in range(blocks):
        rows = items.select(id_col, *fields).where(F.col(id_col).isNotNull() & (F.pmod(F.xxhash64(id_col), F.lit(blocks)) == b)).distinct().collect()
        block = [(r[0], f, r[f]) for r in rows for f in fields if r[f]]
        if block or not b:
            yield block


def find_leaks(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "id", fields: tuple[str, ...] = ("question", "answer"), min_words: int = MIN_WORDS, max_edit_share: float = MAX_EDIT_SHARE, max_item_words: int = MAX_ITEM_WORDS) -> DataFrame:
    """Passages of ``items`` in ``documents``: (id, item_id, field, n_words, n_matched, first_word, last_word).

    Method: a generalised suffix automaton of the items' folded words is broadcast, in blocks of at most ``max_item_words`` words of items.
    Documents stream past it in Arrow batches without any shuffle; each right-maximal match is placed in its items and prolonged over
    added, dropped or replaced words. A passage counts from ``min_words`` equal words on, if its edits are at most ``max_edit_share`` of
    equal words and edits together; where the whole alignment has more, its longest part within the bound counts. An edited passage
    within a longer one of another item is that item's text and doesn't count.

    Null or empty texts give no rows; equal rows give equal rows; other columns are ignored; a document with the same
    passage twice is reported once per item and field, with its longest passage.
    """
    schema = f"`{id_col}` {column_type(documents, id_col)}, item_id {column_type(items, item_id)}, field string, n_words int, n_matched int, first_word int, last_word int"
    return _passages(documents, items, id_col, text_col, item_id, fields, schema, False, max_item_words, min_words=min_words, max_edit_share=max_edit_share)


def _passages(documents: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str, fields: tuple[str, ...], schema: str, every: bool, max_item_words: int, **options) -> DataFrame:
    """Rows of all blocks of items: the longest passage of each document and item, or ``every`` one."""
    out = None
    for block in item_blocks(items, item_id, fields, max_item_words):
        found = map_arrow(documents.select(id_col, text_col), _runner(documents.sparkSession.sparkContext.broadcast(LeakFinder(block, **options)), every), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _runner(shared, every: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        find = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = [(i, hit) for i, hits in enumerate(find.passages(texts) if every else find.find_all(texts)) for hit in hits]
            if rows:
                ids = batch.column(0).take(pa.array([i for i, _ in rows], pa.int64()))
                yield [ids, *zip(*(hit for _, hit in rows))]

    return run


def remove_leaks(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_coverage: float = 0.5, item_id: str = "id", fields: tuple[str, ...] = ("question", "answer"), max_item_words: int = MAX_ITEM_WORDS, **options) -> DataFrame:
    """``documents`` without the leaked spans: (id, text, n_removed); a document whose spans cover more than ``max_coverage`` of its words is dropped whole.

    Every passage goes, also the second of an item. The spans of all blocks of items are gathered by id and joined to the documents, as
    many of which as have none keep their text. Word places are those of the folded word sequence. Equal rows come out as often as they
    go in; null text stays null. Ids should be unique; of equal ids with other texts each loses the spans of all.
    """
    schema = f"`{id_col}` {column_type(documents, id_col)}, item_id {column_type(items, item_id)}, field string, n_words int, n_matched int, first_word int, last_word int"
    spans = _passages(documents, items, id_col, text_col, item_id, fields, schema, True, max_item_words, **options)
    spans = materialize(spans.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.collect_set(F.struct("first_word", "last_word")).alias("spans")), "spans")
    joined = documents.select(id_col, text_col).join(broadcast_if_small(spans, spans.count(), BROADCAST_ROWS), id_col, "left")
    whole = joined.where(F.col("spans").isNull()).select(id_col, text_col, F.lit(0).alias("n_removed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            out, removed, keep = [], [], []
            for i, (text, hits) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                cut, n = _without(text or "", [(h["first_word"], h["last_word"]) for h in hits])
                if n <= max_coverage * max(1, len((text or "").split())):
                    keep.append(i)
                    out.append(cut)
                    removed.append(n)
            if keep:
                yield [batch.column(0).take(pa.array(keep, pa.int64())), out, removed]

    cut = map_arrow(joined.where(F.col("spans").isNotNull()).select(id_col, text_col, "spans"), run, f"`{id_col}` {column_type(documents, id_col)}, `{text_col}` string, n_removed int")
    return whole.unionByName(cut)


def _without(text: str, hits: list[tuple]) -> tuple[str, int]:
    gone = np.zeros(max(b for _, b in hits), bool)
    for a, b in hits:
        gone[a:b] = True
    kept, at, removed, last, inside = [], 0, 0, 0, False
    for m in _WORD.finditer(text):
        n = len(fold_tokens(m.group()))
        if n and gone[at : at + n].any():
            if not inside:
                kept.append(text[last : m.start()])
            inside, last = True, m.end()
            removed += 1
        elif n:
            inside = False
        at += n
    out = ""
    for part in [*kept, text[last:]]:
        left, right = out.rstrip(" "), part.lstrip(" ") if out else part
        out = left + (" " if left and right and left[-1] != "\n" and right[0] != "\n" else "") + right
    return out, removed


def leaked_pairs(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def cleaned_documents(spark, sf_dir: str) -> DataFrame:
    """The documents without what leaked into them."""
    return remove_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
