"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton knows every run of words of every item. Streaming a document's words
through it gives, word by word, the longest run that ends there and stands in some item.
Where that is a whole window, or a whole item shorter than one, its words are hit.
Items go into automata of a bounded number of words; each is broadcast in turn.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from volscribe.llm.common import id_and_text, slices, text_buffer
from volscribe.llm.line_dedup import with_earlier
from volscribe.llm.terms import term_hashes, term_spans, terms_of
from volscribe.session import written

WINDOW = 10
# Words of the items in one automaton, which every worker holds: some 60 MB at most.
BLOCK_WORDS = 200_000
SPANS = "array<struct<first: bigint, words: bigint, start: bigint, end: bigint>>"
# Sums over items in one go; a longer item is cut into parts that overlap by all but one word of a window.
_FLAG_BITS = 20


class SuffixAutomaton:
    """All runs of words of some items, given as (item id or None, words).

    ``length`` is the longest run that leads to a state and ``link`` the state of its
    longest ending that leads elsewhere.
    """

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.length, self.link, edges = [0], [-1], [{}]
        texts = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for name, words in items if words]
        whole: dict[int, set] = {}
        for name, words in texts:
            last = 0
            for word in words:
                last = self._extended(edges, last, word)
            if len(words) < window:
                whole.setdefault(last, set()).add(name)
        self.size = max(1, len(self.vocabulary))
        self.step = {state * self.size + word: to for state, out in enumerate(edges) for word, to in out.items()}
        self.shortest = min((min(len(words), window) for _, words in texts), default=window)
        # By length, a state comes after its link: the state of a run's last ``window`` words, and the nearest whole short item that ends it.
        self.top, self.whole = [-1] * len(self.link), [-1] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            above = self.link[state]
            if self.length[state] >= window:
                self.top[state] = state if self.length[above] < window else self.top[above]
            self.whole[state] = state if state in whole else self.whole[above]
        names: dict[int, set] = {state: set(found) for state, found in whole.items()}
        for name, words in texts:
            state = 0
            for k, word in enumerate(words):
                state = self.step[state * self.size + word]
                if k >= window - 1:
                    names.setdefault(self.top[state], set()).add(name)
        self.names = {state: tuple(x for x in found if x is not None) for state, found in names.items()}
        self.flags = np.zeros(1 << _FLAG_BITS, bool)
        if self.vocabulary:
            sizes = [len(w) for w in self.vocabulary]
            ends = np.cumsum(sizes)
            self.flags[self._slot(term_hashes(np.frombuffer(b"".join(self.vocabulary), np.uint8), ends - sizes, ends))] = True

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - _FLAG_BITS)

    def _split(self, edges: list[dict], before: int, state: int, word: int) -> int:
        """A state of its own for the runs that lead to ``state`` and are no longer than the one over ``before``."""
        new = len(edges)
        edges.append(dict(edges[state]))
        self.length.append(self.length[before] + 1)
        self.link.append(self.link[state])
        self.link[state] = new
        while before >= 0 and edges[before].get(word) == state:
            edges[before][word] = new
            before = self.link[before]
        return new

    def _extended(self, edges: list[dict], last: int, word: int) -> int:
        """The state of the run of ``last`` with one more word, new where no item had it yet."""
        known = edges[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(edges, last, known, word)
        new = len(edges)
        edges.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        while last >= 0 and word not in edges[last]:
            edges[last][word] = new
            last = self.link[last]
        if last >= 0:
            known = edges[last][word]
            self.link[new] = known if self.length[known] == self.length[last] + 1 else self._split(edges, last, known, word)
        return new

    def streamed(self, words: Iterable[bytes]) -> Iterator[tuple[int, int, int]]:
        """For each word the state reached and the length of the longest run that ends there; and how many of its words are hit."""
        step, link, length, size, window, ids = self.step, self.link, self.length, self.size, self.window, self.vocabulary
        state = matched = 0
        for text in words:
            word, to = ids.get(text), None
            if word is not None:
                to = step.get(state * size + word)
                while to is None and state:
                    state = link[state]
                    matched = length[state]
                    to = step.get(state * size + word)
            if to is None:
                state = matched = 0
                yield 0, 0, 0
                continue
            state, matched = to, matched + 1
            if matched >= window:
                yield state, matched, matched
            else:
                short = self.first_whole(state, matched)
                yield state, matched, length[short] if short >= 0 else 0

    def first_whole(self, state: int, matched: int) -> int:
        """The state of the longest whole short item that ends a run of ``matched`` words, or -1."""
        short = self.whole[state]
        return self.whole[self.link[state]] if short == state and self.length[state] > matched else short

    def found(self, words: Iterable[bytes]) -> tuple[list[list[int]], set[str]]:
        """The runs of hit words, as first and end, and the ids of the items whose windows occur."""
        runs: list[list[int]] = []
        states = set()
        for k, (state, matched, hit) in enumerate(self.streamed(words)):
            if not hit:
                continue
            if matched >= self.window:
                states.add(self.top[state])
            short = self.first_whole(state, matched)
            while short >= 0 and short not in states:
                states.add(short)
                short = self.whole[self.link[short]]
            low = k + 1 - hit
            while runs and runs[-1][1] >= low:
                low = min(low, runs.pop()[0])
            runs.append([low, k + 1])
        return runs, {name for state in states for name in self.names.get(state, ())}

    def candidates(self, hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
        """Runs of words that may all stand in items, within a text and long enough to hold a window.

        Any other word leads back to the first state, so nothing is lost between them.
        """
        known = np.r_[False, self.flags[self._slot(hashes)], False]
        cut = np.zeros(len(hashes) + 1, bool)
        cut[first] = True
        low = np.flatnonzero(known[1:-1] & (~known[:-2] | cut[:-1]))
        high = np.flatnonzero(known[1:-1] & (~known[2:] | cut[1:])) + 1
        long = high - low >= self.shortest
        return list(zip(low[long].tolist(), high[long].tolist(), strict=True))


def item_parts(items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """item (its id as a string), n and words of the items, cut where they are too long for one automaton."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = []
            for item, text in zip(part.column("item").to_pylist(), part.column("text").to_pylist(), strict=True):
                words = terms_of(text)
                for low in range(0, max(1, len(words) - window + 1), block_words):
                    own = words[low : low + block_words + window - 1]
                    if own:
                        found.append((item, len(own), b" ".join(own)))
            if found:
                columns = zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in columns], ["item", "n", "words"])

    named = items.select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return named.mapInArrow(rows, "item string, n bigint, words binary")


def automata(items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row, automaton, for each block of about ``block_words`` words of ``items`` (item_id, text)."""
    parts = written(item_parts(items, window, block_words), "items")
    if (parts.agg(F.sum("n")).first()[0] or 0) > block_words:
        blocks = with_earlier(parts, ["item", "words"]).withColumn("block", F.floor(F.col("earlier") / block_words))
    else:
        blocks = parts.withColumn("block", F.lit(0).cast("bigint"))

    def built(part: pa.Table) -> pa.Table:
        own = SuffixAutomaton(((n, w.split(b" ")) for n, w in zip(part["item"].to_pylist(), part["words"].to_pylist(), strict=True)), window)
        return pa.table({"automaton": pa.array([pickle.dumps(own, protocol=5)], pa.binary())})

    return blocks.select("block", "item", "words").groupBy("block").applyInArrow(built, "automaton binary")


@lru_cache(maxsize=1)
def _loaded(stored: bytes) -> SuffixAutomaton:
    """The automaton in use in this worker process."""
    return pickle.loads(stored)  # noqa: S301


def _streamed(docs: DataFrame, stored: bytes | None) -> DataFrame:
    """``docs`` (doc_id, text) with n_words, the spans that one automaton finds and its items."""
    shared = docs.sparkSession.sparkContext.broadcast(stored)
    span = pa.struct([(c, pa.int64()) for c in ("first", "words", "start", "end")])
    kinds = (pa.int64(), pa.list_(span), pa.list_(pa.string()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _loaded(shared.value) if shared.value is not None else SuffixAutomaton([])
        for part in slices(batches):
            data, start, end, first = term_spans(*text_buffer(part.column("text")))
            stored, doc = data.tobytes(), np.diff(first)
            spans, names = [[] for _ in doc], [set() for _ in doc]
            for low, high in automaton.candidates(term_hashes(data, start, end), first):
                k = int(np.searchsorted(first, low, side="right")) - 1
                own = (stored[i:j] for i, j in zip(start[low:high].tolist(), end[low:high].tolist(), strict=True))
                runs, found = automaton.found(own)
                names[k] |= found
                spans[k] += [(low + a, low + b) for a, b in runs]
            at = text_buffer(part.column("text"))[1]
            placed = [
                [{"first": a - f, "words": b - a, "start": int(start[a] - t), "end": int(end[b - 1] - t)} for a, b in own]
                for own, f, t in zip(spans, first[:-1].tolist(), at[:-1].tolist(), strict=True)
            ]
            columns = [pa.array(c, kind) for c, kind in zip((doc, placed, [sorted(x) for x in names]), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "text")), *columns], ["doc_id", "text", "n_words", "spans", "items"])

    return docs.mapInArrow(rows, f"doc_id bigint, text string, n_words bigint, spans {SPANS}, items array<string>")


def _merged(found: DataFrame) -> DataFrame:
    """The spans that several automata found in a text, put together where they touch."""
    merged = F.expr(
        "aggregate(array_sort(spans), cast(array() AS " + SPANS + "), (done, x) -> "
        "if(size(done) > 0 AND x.first <= element_at(done, -1).first + element_at(done, -1).words, "
        "concat(slice(done, 1, size(done) - 1), array(named_struct('first', element_at(done, -1).first, "
        "'words', greatest(element_at(done, -1).first + element_at(done, -1).words, x.first + x.words) - element_at(done, -1).first, "
        "'start', element_at(done, -1).start, 'end', greatest(element_at(done, -1).end, x.end)))), concat(done, array(x))))"
    )
    return found.withColumn("spans", merged)


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, text, n_words, spans and items of every row of ``docs`` (doc_id, text) against ``items`` (item_id, text).

    A span is a longest run of hit words: its first word and their number, counted from
    0, and its place in the text's bytes. ``items`` lists the ids of the items with
    occurring windows, as strings. A null or empty text has no words; a null or empty
    item has no window. An item without an id marks words and is not listed; items
    that share an id are one. Rows that repeat a document each have its result, which
    depends on the text alone. Texts are read whole, however long. Without items nothing
    is hit; an empty table of documents gives no rows. Other columns are not read.

    One automaton needs one pass over the documents and no shuffle. With more, what
    each finds is kept by the text's digest, once for equal texts, and put together.
    """
    docs = id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    stored = written(automata(items, window, block_words), "automata")
    number = stored.count()
    if number <= 1:
        row = stored.first()
        return _streamed(docs, bytes(row.automaton) if row else None)
    digest, parts = F.sha2("text", 256).alias("digest"), None
    for row in stored.toLocalIterator():
        own = _streamed(docs, bytes(row.automaton)).where(F.size("spans") > 0).select(digest, "spans", "items")
        own = written(own.groupBy("digest").agg(F.first("spans").alias("spans"), F.first("items").alias("items")), "hits")
        parts = own if parts is None else parts.unionByName(own)
    joined = {c: F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items")}
    hits = _merged(parts.groupBy(F.col("digest").alias("of")).agg(*joined.values())).withColumn("items", F.array_sort(F.array_distinct("items")))
    counted = _streamed(docs, None).select("doc_id", "text", "n_words", digest)
    both = counted.join(hits, F.col("digest") == F.col("of"), "left")
    return both.select("doc_id", "text", "n_words", *(F.coalesce(c, F.array()).cast(k).alias(c) for c, k in (("spans", SPANS), ("items", "array<string>"))))


def remove_contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, longest: int = 0, coverage: float = 0.5, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """As ``find_contamination``, with n_hit, ``kept`` and ``kept_text`` in place of the text.

    Spans of more than ``longest`` words are cut out. A document of which more than the
    share ``coverage`` of its words is hit is not kept at all, and its kept_text is null.
    """
    found = find_contamination(docs, items, window, block_words)
    found = found.withColumn("n_hit", hit_words()).withColumn("kept", F.col("n_hit") <= F.col("n_words") * F.lit(coverage))
    cut = found.withColumn("cut", F.filter("spans", lambda s: s["words"] > longest))
    # Spans count bytes, and so does binary substring.
    pieces = F.expr(
        "transform(sequence(0, size(cut)), k -> substring(cast(text AS binary), "
        "int(if(k = 0, 0, element_at(cut, greatest(k, 1)).end)) + 1, "
        "int(if(k = size(cut), octet_length(text), element_at(cut, least(k + 1, size(cut))).start) - if(k = 0, 0, element_at(cut, greatest(k, 1)).end))))"
    )
    whole = F.when(F.size("cut") == 0, F.col("text")).otherwise(F.array_join(F.transform(pieces, lambda b: F.decode(b, "UTF-8")), ""))
    return cut.select("doc_id", "n_words", "n_hit", "spans", "items", "kept", F.when(F.col("kept"), whole).alias("kept_text"))


def hit_words() -> F.Column:
    """The words in all ``spans`` of a row."""
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["words"])
