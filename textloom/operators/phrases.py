"""Which of many phrases each text holds: a tree of words that numpy walks from all places of a batch at once.

The phrases and their tree are gathered by the driver and go to every task; they are a benchmark's, and few beside the texts.
Texts are read once and leave no row for each word: only the phrases found do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters of texts that are cut into words at once (a longer text is one piece).
PIECE = 1 << 20
#: A word between two texts: normalised texts hold no line feed.
BETWEEN = "\n"


class Words(dict):
    def __missing__(self, word: str) -> int:
        return -1


class Tree:
    """Phrases by their words: a node's children stand sorted by node and word."""

    def __init__(self, phrases: list[str]):
        self.words, child, ends = Words({BETWEEN: -2}), {}, {}
        for k, phrase in enumerate(phrases):
            node = 0
            for word in phrase.split(" "):
                w = self.words.setdefault(word, len(self.words) - 1)
                node = child.setdefault((node, w), len(child) + 1)
            ends[node] = k
        self.n = len(self.words) - 1
        self.ends = np.full(len(child) + 1, -1)
        self.ends[list(ends)] = list(ends.values())
        keys = np.array([node * self.n + w for node, w in child], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array(list(child.values()), dtype=np.int64)[order]
        self.root = np.zeros(self.n + 2, dtype=np.int64)  # the last two are read by -1 and -2: no child
        for (node, w), to in child.items():
            if node == 0:
                self.root[w] = to

    def find(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a text's and a phrase's number, each once."""
        ids = np.fromiter(map(self.words.__getitem__, f" {BETWEEN} ".join(texts).split(" ")), np.int64)
        text = np.cumsum(ids == -2)
        node = self.root[ids]
        at = np.flatnonzero(node)
        node, found, k = node[at], [], 0
        while len(at):
            done = self.ends[node] >= 0
            found.append(np.unique(text[at[done]] * len(self.ends) + self.ends[node[done]]))
            k += 1
            within = at + k < len(ids)
            at, node = at[within], node[within]
            word = ids[at + k]
            key = node * self.n + word
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = (word >= 0) & (self.keys[i] == key)
            at, node = at[on], self.to[i[on]]
        pairs = np.concatenate(found) if found else np.zeros(0, np.int64)  # phrases of one length at a time, so none twice
        return pairs // len(self.ends), pairs % len(self.ends)


def phrases_in(df: DataFrame, phrases: list[str]) -> DataFrame:
    """From rows (doc_id, text), normalised to words between single blanks, rows (doc_id, phrase): the number of a phrase held."""
    shared = df.sparkSession.sparkContext.broadcast(phrases)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(shared.value)
        for batch in batches:
            lengths = np.cumsum([0, *batch.column(1).to_pylist()])
            start = 0
            while start < batch.num_rows:
                end = max(start + 1, int(np.searchsorted(lengths, lengths[start] + PIECE, "right")) - 1)
                text, phrase = tree.find(batch.column(2).slice(start, end - start).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start).take(pa.array(text)), pa.array(phrase)], ["doc_id", "phrase"])
                start = end

    return df.selectExpr("doc_id", "length(text) AS n", "text").mapInArrow(search, f"doc_id {dict(df.dtypes)['doc_id']}, phrase long")
