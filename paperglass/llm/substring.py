"""Operator 4, substring dedup by suffix automata of reference shards.

Words covered by a window of 20 words that also starts earlier (in a document of
smaller id, or earlier in the same one) are removed; windows are judged on the
input.  The search (``_repeats``) cuts documents into phrases and deals those
whose trigger gram repeats into reference shards.  In each the suffix automaton
of the reference phrases is built online, in document order, and every phrase
is streamed through it: the length of the link of the last state is the matching
statistic against everything before, and where it reaches the threshold the
words are removed.

A broadcast of the automata of all shards would grow with the corpus, and each
document would meet each of them; the phrases are dealt to the one shard that
can hold their repetition instead (equal windows share their trigger), which
gives the same result with bounded memory.

Defined results: null text is an empty text and keeps null when texts are
returned; rows with equal ids do not remove each other's words; null ids count as larger than all
others; very long texts are parsed in segments; other columns are carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._repeats import Search, Shard, repeated_spans
from ._shared import documents

WINDOW = 20
GRAM = 6


class SuffixAutomaton:
    """Online suffix automaton over hashable symbols.

    After each ``extend`` the state ``link[last]`` holds the longest suffix that
    occurred before; ``first`` is where a state's strings first ended.
    """

    __slots__ = ("next", "link", "length", "first", "last", "size")

    def __init__(self):
        self.next, self.link, self.length, self.first = [{}], [-1], [0], [-1]
        self.last = self.size = 0

    def extend(self, symbol) -> None:
        nxt, link, length, first = self.next, self.link, self.length, self.first
        cur = len(nxt)
        nxt.append({})
        length.append(length[self.last] + 1)
        first.append(self.size)
        link.append(0)
        p = self.last
        while p >= 0 and symbol not in nxt[p]:
            nxt[p][symbol] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][symbol]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                first.append(first[q])
                while p >= 0 and nxt[p].get(symbol) == q:
                    nxt[p][symbol] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur
        self.size += 1

    def earlier(self, least: int) -> int:
        """Where the last ``least`` symbols first ended before, or -1."""
        at = self.link[self.last]
        if at < 0 or self.length[at] < least:
            return -1
        while self.length[self.link[at]] >= least:
            at = self.link[at]
        return self.first[at]


def _by_automata(symbols, size, group, ids, shard, row, lo, search: Search):
    """Resolver: windows of the phrases that occur earlier in their group."""
    w = search.window
    begin = np.cumsum(size) - size
    order = np.lexsort((lo, row, shard, ids, group))
    ranked = group[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(order) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(order)))
    entries, starts = [], []
    for a, n in zip(first[count > 1].tolist(), count[count > 1].tolist()):
        automaton, owner, seen = SuffixAutomaton(), [], set()
        for number, e in enumerate(order[a : a + n].tolist()):
            words = symbols[begin[e] : begin[e] + size[e]].tolist()
            me, place = int(ids[e]), (int(shard[e]), int(row[e]))
            automaton.extend(-1 - number)  # no match crosses phrases
            owner.append((me, place))
            for k, word in enumerate(words):
                automaton.extend(word)
                owner.append((me, place))
                if k + 1 < w:
                    continue
                before = automaton.earlier(w)
                if before >= 0:
                    other, where = owner[before]
                    if other < me or (search.within and (where == place or (before, place) in seen)):
                        entries.append(e)
                        starts.append(int(lo[e]) + k + 1 - w)
                    else:
                        seen.add((before, place))
    return np.array(entries, np.int64), np.array(starts, np.int64)


def word_search(window: int = WINDOW, gram: int = GRAM) -> Search:
    return Search("word", window, min(gram, window), True, _by_automata)


def _kept_words(id_col: str):
    def render(shard: Shard, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Table:
        n_words = np.diff(shard.offsets)
        removed = np.bincount(row, end - start, shard.n).astype(np.int64) if len(row) else np.zeros(shard.n, np.int64)
        flags = np.zeros(len(shard.starts) + 1, np.int32)
        np.add.at(flags, start, 1)
        np.add.at(flags, end, -1)
        keep = np.cumsum(flags[:-1]) == 0
        # Kept words with one space after each, copied in one go.
        s, e = shard.starts[keep], shard.ends[keep]
        length = e - s + 1
        take = np.arange(int(length.sum())) + np.repeat(s - (np.cumsum(length) - length), length)
        out = np.append(shard.data, np.uint8(32))[np.minimum(take, len(shard.data))] if len(take) else np.zeros(0, np.uint8)
        out[np.cumsum(length) - 1] = 32
        kept_before = np.concatenate(([0], np.cumsum(keep)))
        done = np.concatenate(([0], np.cumsum(length)))
        cuts = done[kept_before[shard.offsets]]
        text = [out[a : max(b - 1, a)].tobytes() for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
        spans = np.searchsorted(row, np.arange(shard.n + 1)).tolist()
        own = shard.offsets[row]
        pairs = pa.StructArray.from_arrays([pa.array(start - own, pa.int64()), pa.array(end - own, pa.int64())], names=["start", "end"])
        return pa.Table.from_arrays(
            [shard.table.column(id_col), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(text, pa.binary()), pa.ListArray.from_arrays(pa.array(spans, pa.int32()), pairs)],
            names=[id_col, "n_words", "n_removed", "kept", "spans"],
        )

    return render


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, n_words, n_removed, kept, spans) for each row: kept is the UTF-8 of
    the kept words joined by one space, spans are the removed word ranges."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_words long, n_removed long, kept binary, spans array<struct<start:long,end:long>>"
    return repeated_spans(docs.select(id_col, text_col), word_search(window, gram), _kept_words(id_col), schema, id_col, text_col)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs with the repeated words cut out of the texts, from the start of the
    first to the start of the first word after; all other columns stay."""
    columns = docs.columns

    def render(shard: Shard, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Table:
        texts = shard.table.column(text_col).to_pylist()
        where = np.append(shard.starts, len(shard.data))
        cuts = np.searchsorted(row, np.arange(shard.n + 1)).tolist()
        for r in np.unique(row).tolist():
            at, stop = int(shard.byte_offsets[r]), int(shard.byte_offsets[r + 1])
            pieces = []
            for k in range(cuts[r], cuts[r + 1]):
                pieces.append(shard.data[at : where[start[k]]].tobytes())
                at = int(where[end[k]]) if end[k] < shard.offsets[r + 1] else stop
            texts[r] = b"".join([*pieces, shard.data[at:stop].tobytes()]).decode()
        column = shard.table.schema.get_field_index(text_col)
        kind = shard.table.schema.field(column).type
        return shard.table.set_column(column, shard.table.schema.field(column), pa.array(texts, kind)).select(columns)

    return repeated_spans(docs, word_search(window, gram), render, docs.schema, id_col, text_col)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = repeated_words(documents(spark, sf_dir))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
