"""Benchmark decontamination by a generalised suffix automaton of the test items.

The words of the items are the automaton's alphabet. A document's words are streamed through it; at each word the
automaton holds the longest suffix read so far that occurs in any item. A match of at least `window` words, or of a
whole shorter item, marks its words as hit. Only the automaton is broadcast, for blocks of items of bounded size: documents are
neither shuffled nor compared in pairs. It is made once, in arrays, and a worker process holds it once.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batch_of, bounded_batches, schema, texts

#: Every ASCII byte that is no digit or letter separates words; A-Z become a-z. Bytes from 0x80 on belong to words.
WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """The lower-cased words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text; none for null."""
    return text.translate(WORD_TABLE).split() if text else []


class SuffixAutomaton:
    """Of many word sequences. A state stands for substrings that end at the same places; link leads to the longest
    suffix in another state.

    Most states are followed by one word only, so that word and where it leads are in arrays; `more` has the other
    words of those that have several. That takes some 30 bytes a word of the sequences, and a state or two.
    """

    def __init__(self) -> None:
        self.word, self.to = array("i", [-1]), array("i", [0])
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.more: dict[int, dict[int, int]] = {}

    def following(self, state: int, word: int) -> int:
        """Where the word leads from a state; -1 if it never follows."""
        if self.word[state] == word:
            return self.to[state]
        return self.more[state].get(word, -1) if state in self.more else -1

    def _follow(self, state: int, word: int, to: int) -> None:
        if self.word[state] in (-1, word):
            self.word[state], self.to[state] = word, to
        else:
            self.more.setdefault(state, {})[word] = to

    def _state(self, length: int, link: int, like: int = -1) -> int:
        new = len(self.link)
        self.word.append(self.word[like] if like >= 0 else -1)
        self.to.append(self.to[like] if like >= 0 else 0)
        if like in self.more:
            self.more[new] = dict(self.more[like])
        self.length.append(length)
        self.link.append(link)
        return new

    def _split(self, p: int, word: int, q: int) -> int:
        """The part of q that is reached from p gets a state of its own."""
        part = self._state(self.length[p] + 1, self.link[q], q)
        self.link[q] = part
        while p >= 0 and self.following(p, word) == q:
            self._follow(p, word, part)
            p = self.link[p]
        return part

    def _extend(self, last: int, word: int) -> int:
        q = self.following(last, word)
        if q >= 0:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new, p = self._state(self.length[last] + 1, 0), last
        while p >= 0 and (q := self.following(p, word)) < 0:
            self._follow(p, word, new)
            p = self.link[p]
        if p >= 0:
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def add(self, words: list[int]) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """The longest suffix that occurs after one more word, as state and length."""
        while (to := self.following(state, word)) < 0:
            if not state:
                return 0, 0
            state = self.link[state]
            length = self.length[state]
        return to, length + 1


class ItemMatcher:
    """The automaton of one block of items, and which items and how many words a match at each state stands for.

    A mark of a state is (words, item): the item's window of exactly so many words, or the whole shorter item, is the substring
    of that length in the state. Marks are in arrays, those of a state one after another."""

    NEVER = (1 << 31) - 1

    def __init__(self, items: list[tuple[object, bytes | None]], window: int):
        self.window, self.ids, self.names = window, {}, []
        self.auto = auto = SuffixAutomaton()
        texts, starts = array("i"), array("q", [0])
        for item, text in items:
            if words := words_of(text):
                texts.extend(self.ids.setdefault(w, len(self.ids)) for w in words)
                starts.append(len(texts))
                self.names.append(item)
        for a, b in zip(starts, starts[1:], strict=False):
            auto.add(texts[a:b])
        states, sizes, owners = array("i"), array("i"), array("i")
        for n, (a, b) in enumerate(zip(starts, starts[1:], strict=False)):
            state = length = 0
            for w in texts[a:b]:
                state, length = auto.step(state, length, w)
                while auto.length[auto.link[state]] >= window:
                    state = auto.link[state]
                    length = auto.length[state]
                if length >= window:
                    states.append(state)
                    sizes.append(window)
                    owners.append(n)
            if b - a < window:
                states.append(state)
                sizes.append(b - a)
                owners.append(n)
        marks = np.array([states, sizes, owners], np.int32).T
        marks = np.unique(marks, axis=0) if len(marks) else marks
        count = len(auto.link)
        first = np.searchsorted(marks[:, 0], np.arange(count + 1))
        self.first, self.sizes, self.owners = array("i", first.astype(np.int32).tobytes()), array("i", marks[:, 1].tobytes()), array("i", marks[:, 2].tobytes())
        least = np.full(count, self.NEVER, np.int32)
        np.minimum.at(least, marks[:, 0], marks[:, 1])
        own = (np.diff(first) > 0).tolist()
        self.root = {**auto.more.get(0, {}), auto.word[0]: auto.to[0]}
        #: The shortest match length at a state from which a window ends there, and the nearest suffix state with marks.
        self.least, self.marked = array("i", least.tobytes()), array("i", [-1]) * count
        for s in np.argsort(np.frombuffer(auto.length, np.int32), kind="stable").tolist():
            up = auto.link[s]
            if up >= 0:
                self.least[s], self.marked[s] = min(self.least[s], self.least[up]), self.marked[up]
            if own[s]:
                self.marked[s] = s

    def nbytes(self) -> int:
        """Of the arrays, and of the words and the branches about as much as dictionaries take."""
        arrays = (self.auto.word, self.auto.to, self.auto.link, self.auto.length, self.first, self.sizes, self.owners, self.least, self.marked)
        return sum(len(x) * x.itemsize for x in arrays) + 120 * len(self.ids) + sum(240 + 100 * len(x) for x in self.auto.more.values())

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """(the runs of hit words as sorted, disjoint [start, end), the items with occurring windows)."""
        auto, least = self.auto, self.least
        root, one, to_, more, link, lengths = self.root, auto.word, auto.to, auto.more, auto.link, auto.length
        found: list[tuple[int, int]] = []
        items: set = set()
        state = length = 0
        for at, w in enumerate(map(self.ids.get, words)):
            if w is None:
                state = length = 0
                continue
            while state:
                if one[state] == w:
                    to = to_[state]
                    break
                to = more[state].get(w, -1) if state in more else -1
                if to >= 0:
                    break
                state = link[state]
                length = lengths[state]
            if not state:
                length = 0
                if (to := root.get(w, -1)) < 0:
                    continue
            state, length = to, length + 1
            if length >= least[state]:
                widest, s = 0, self.marked[state]
                while s >= 0:
                    for k in range(self.first[s], self.first[s + 1]):
                        if self.sizes[k] <= length:
                            widest = max(widest, self.sizes[k])
                            items.add(self.owners[k])
                    s = self.marked[link[s]] if s else -1
                if widest:
                    start = at + 1 - widest
                    while found and found[-1][1] >= start:
                        start = min(start, found.pop()[0])
                    found.append((start, at + 1))
        return found, {self.names[n] for n in items}


def item_blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The distinct items (id, text) in parts of about block_bytes of text each; one part, if it is no larger, as test sets are."""
    items = benchmark.dropDuplicates(["id", "text"])
    n = max(1, -(-(items.select(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    return [items if n == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) for k in range(n)]


def _matcher(part: DataFrame, window: int):
    """The broadcast automaton of a block of items: it is made here, of at most a block's bytes."""
    return part.sparkSession.sparkContext.broadcast(ItemMatcher([tuple(r) for r in part.collect()], window))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, coverage: float = 0.05, block_bytes: int = 4 << 20, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (array of [start, end) word positions).

    n_hit counts words inside any occurrence of a window (`window` consecutive words of an item, or a whole shorter
    item). contaminated: n_hit > 0 and n_hit >= coverage * n_words. Null and empty texts have no words and are clean.
    Items that are null or have no words match nothing; a null item_id still hits words but is not counted or named.
    Repeated documents and items are treated row by row; an item_id counts once. Other columns are ignored. An empty
    benchmark leaves every document clean.

    Items over block_bytes are matched in blocks, each in a pass of its own, and the passes' spans are merged.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).cast("string").cast("binary").alias("text"))
    blocks = item_blocks(items, block_bytes)
    body = texts(docs, doc_id, doc_text).withColumnsRenamed({doc_id: "doc_id", doc_text: "text"})
    numerator, denominator = coverage.as_integer_ratio() if coverage != 0.05 else (1, 20)
    kinds = {"doc_id": "long", "n_words": "long", "n_hit": "long", "n_items": "long", "items_sha256": "string", "contaminated": "boolean", "spans": "array<struct<start:int,end:int>>"}
    if len(blocks) == 1:
        shared = _matcher(blocks[0], window)
        out = body.mapInArrow(_streamed(shared, numerator, denominator), schema(**kinds))
    else:
        scratch = Scratch(spark)  # rows are numbered and written, so that numbers hold in every pass
        body = scratch.write(body.withColumn("row", F.monotonically_increasing_id()), "rows")
        parts = []
        for part in blocks:
            shared = _matcher(part, window)
            parts.append(body.mapInArrow(_found(shared), schema(row="long", doc_id="long", n_words="long", ids="array<string>", spans=kinds["spans"])))
        every = parts[0]
        for part in parts[1:]:
            every = every.unionAll(part)
        merged = every.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
        out = merged.mapInArrow(_finished(numerator, denominator), schema(**kinds))
    return out


def _verdict(n_words: int, spans: list[tuple[int, int]], ids: set, numerator: int, denominator: int) -> tuple:
    hit = sum(b - a for a, b in spans)
    names = sorted(x for x in ids if x is not None)
    return hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0 and denominator * hit >= numerator * n_words


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _rows(found: list[tuple]) -> pa.RecordBatch:
    doc, n, verdict, spans = zip(*found, strict=True) if found else ((), (), (), ())
    hit, items, sha, bad = zip(*verdict, strict=True) if verdict else ((), (), (), ())
    return batch_of({"doc_id": (doc, pa.int64()), "n_words": (n, pa.int64()), "n_hit": (hit, pa.int64()), "n_items": (items, pa.int64()), "items_sha256": (sha, pa.string()), "contaminated": (bad, pa.bool_()), "spans": ([[{"start": a, "end": b} for a, b in x] for x in spans], _SPANS)})


def _streamed(shared, numerator: int, denominator: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        matcher = shared.value
        for batch in batches:
            found = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = words_of(text)
                spans, ids = matcher.matches(words)
                found.append((doc, len(words), _verdict(len(words), spans, ids, numerator, denominator), spans))
            yield _rows(found)

    return run


def _found(shared):
    def run(batches):
        matcher = shared.value
        for batch in batches:
            out = []
            for row, doc, text in zip(batch["row"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = words_of(text)
                spans, ids = matcher.matches(words)
                out.append((row, doc, len(words), sorted(x for x in ids if x is not None), [{"start": a, "end": b} for a, b in spans]))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield batch_of({"row": (cols[0], pa.int64()), "doc_id": (cols[1], pa.int64()), "n_words": (cols[2], pa.int64()), "ids": (cols[3], pa.list_(pa.string())), "spans": (cols[4], _SPANS)})

    return run


def _finished(numerator: int, denominator: int):
    def run(batches):
        for batch in batches:
            found = []
            for doc, n, ids, spans in zip(*(batch[c].to_pylist() for c in ("doc_id", "n_words", "ids", "spans")), strict=True):
                merged = _merged(spans)
                found.append((doc, n, _verdict(n, merged, set(ids), numerator, denominator), merged))
            yield _rows(found)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, coverage: float = 0.05, max_bytes: int = 4 << 20) -> DataFrame:
    """docs without documents whose hit words reach `coverage`, and without the hit spans of the others.

    All columns of docs stay; text loses the bytes from the first to the last character of each hit run, and n_chars,
    if there is one, follows it. Documents without a hit, null and empty texts are returned as they are. Items over max_bytes
    are matched in blocks, each against the whole texts; the spans of all blocks are merged, judged and cut once.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").cast("string").cast("binary").alias("text"))
    blocks = item_blocks(items, max_bytes)
    numerator, denominator = coverage.as_integer_ratio() if coverage != 0.05 else (1, 20)
    if len(blocks) == 1:
        return docs.mapInArrow(_cut(_matcher(blocks[0], window), numerator, denominator, docs.columns), docs.schema)
    scratch = Scratch(spark)
    rows = scratch.write(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    body = rows.select(F.col("__row").alias("row"), F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    every = None
    for k, part in enumerate(blocks):
        found = body.mapInArrow(_found(_matcher(part, window)), schema(row="long", doc_id="long", n_words="long", ids="array<string>", spans="array<struct<start:int,end:int>>"))
        found = scratch.write(found.where("size(spans) > 0").select("row", "spans"), f"spans{k}")
        every = found if every is None else every.unionAll(found)
    merged = every.groupBy(F.col("row").alias("__row")).agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("__spans"))
    return rows.join(merged, "__row", "left").mapInArrow(_cut(None, numerator, denominator, docs.columns), docs.schema)


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Spans in order of their start, those that touch or overlap as one."""
    merged: list[tuple[int, int]] = []
    for s in spans:
        if merged and s["start"] <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], s["end"]))
        else:
            merged.append((s["start"], s["end"]))
    return merged


def _cut(shared, numerator: int, denominator: int, names: list[str]):
    """Rows of the columns `names`, judged and cut by the broadcast items, or by the spans that column __spans lists."""
    word = re.compile(rb"[^ ]+")

    def cleaned(text: str | None, spans: list[tuple[int, int]], words: list) -> str | None:
        """The text without its hits; a lone surrogate stands for a document to drop."""
        if not spans:
            return text
        raw = text.encode()
        if denominator * sum(b - a for a, b in spans) >= numerator * len(words):
            return "\ud800"
        at = [m.span() for m in word.finditer(raw.translate(WORD_TABLE))]
        kept, last = [], 0
        for a, b in spans:
            kept.append(raw[last : at[a][0]])
            last = at[b - 1][1]
        return b"".join([*kept, raw[last:]]).decode()

    def run(batches):
        matcher = shared.value if shared else None
        for batch in batches:
            olds = batch["text"].to_pylist()
            words = [words_of((t or "").encode()) for t in olds]
            spans = [matcher.matches(w)[0] for w in words] if matcher else [_merged(x or []) for x in batch["__spans"].to_pylist()]
            new = [cleaned(t, s, w) for t, s, w in zip(olds, spans, words, strict=True)]
            stay = [x != "\ud800" for x in new]
            columns, fields = [], [batch.schema.field(c) for c in names]
            for field in fields:
                column = batch[field.name]
                if field.name == "text":
                    column = pa.array([x if k else None for x, k in zip(new, stay, strict=True)], field.type)
                elif field.name == "n_chars":
                    column = pa.array([n if x is None else len(x) for n, x in zip(column.to_pylist(), new, strict=True)], field.type)
                columns.append(column)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields)).filter(pa.array(stay, pa.bool_()))

    return run
