"""Passages of held-out items in a corpus, whole or in part and not letter by letter."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioflow.llm.visible import Letters, look_alike_letters
from biblioflow.llm.words import words
from biblioflow.sources.shared import checkpointed

SHINGLE = 3  # words; runs of three survive when every fifth word changes, runs of five needn't
WINDOW = 18  # words a passage has at least
EDITS = 4  # of which so many may be changed, missing or added
SHARE = 0.22  # of a longer passage ("about one in five")
LEAST = WINDOW - SHINGLE + 1 - SHINGLE * EDITS  # shingles that a window then still shares in order
BLOCK_WORDS = 400_000  # of items that are held in memory at a time; further items take further passes over the corpus


def shingles(w: list[str]) -> list[tuple[str, ...]]:
    return list(zip(*(w[k:] for k in range(SHINGLE)), strict=False))


def prefix_positions(item: list[tuple[str, ...]], rarity: dict) -> set[int]:
    """Positions of the shingles that belong to the prefix of some window.

    A window of n shingles that must share LEAST of them shares one of its n - LEAST + 1 rarest, so only those
    need be looked up. Items shorter than a window have no passage.
    """
    n = WINDOW - SHINGLE + 1
    keep: set[int] = set()
    for start in range(len(item) - n + 1):
        keep.update(sorted(range(start, start + n), key=lambda k: (rarity.get(item[k], 0), item[k], k))[: n - LEAST + 1])
    return keep


def align(a: list[str], b: list[str], price: float) -> tuple[int, int, int, int]:
    """The best local alignment of two word lists: words, edits, and the range in `a`. A match earns 1, an edit costs `price`."""
    if not a or not b:
        return 0, 0, 0, 0
    ids: dict[str, int] = {}
    x, y = (np.array([ids.setdefault(w, len(ids)) for w in side]) for side in (a, b))
    step = np.where(x[:, None] == y[None, :], 1.0, -price)
    grid, ramp = np.zeros((len(a) + 1, len(b) + 1)), price * np.arange(len(b) + 1)
    for i in range(len(a)):
        row = grid[i + 1]
        np.maximum(grid[i, :-1] + step[i], grid[i, 1:] - price, out=row[1:])
        np.maximum(row, 0, out=row)
        row += ramp  # a run of gaps to the right costs as much as the ramp rises
        np.maximum.accumulate(row, out=row)
        row -= ramp
    i, j = divmod(int(grid.argmax()), len(b) + 1)
    end, length, edits, here, above = i, 0, 0, grid[i].tolist(), grid[i - 1].tolist()
    while here[j] > 0:
        same = a[i - 1] == b[j - 1]
        length += 1
        edits += not same
        diagonal = here[j] == above[j - 1] + (1 if same else -price)
        edits += same and not diagonal
        if diagonal or here[j] == above[j] - price:
            i, j = i - 1, j - diagonal
            here, above = above, grid[i - 1].tolist() if i else []
        else:
            j -= 1
    return length, edits, i, end


def window(a: list[str], b: list[str]) -> tuple[int, int, int, int] | None:
    """The alignment of WINDOW columns or more with few enough edits that has most matches: words, edits, and the range in `a`.

    Layer k holds, for every pair of ends, the fewest edits of an alignment of exactly k columns, and its start. Up to
    2 * WINDOW - 1 columns decide whether there is one: of a longer alignment one half has few enough edits as well.
    """
    ids: dict[str, int] = {}
    x, y = (np.array([ids.setdefault(w, len(ids)) for w in side], dtype=np.int64) for side in (a, b))
    edit = 1 << 32  # the low bits carry the start
    differ = (x[:, None] != y[None, :]) * edit
    layer = np.repeat(np.arange(len(a) + 1, dtype=np.int64)[:, None], len(b) + 1, axis=1)
    best = None
    for k in range(1, 2 * WINDOW):
        new = np.full_like(layer, k * edit + len(a))
        np.minimum(new[1:], layer[:-1] + edit, out=new[1:])
        np.minimum(new[:, 1:], layer[:, :-1] + edit, out=new[:, 1:])
        np.minimum(new[1:, 1:], layer[:-1, :-1] + differ, out=new[1:, 1:])
        layer = new
        if k >= WINDOW:
            at = int(layer.argmin())
            edits, start = divmod(int(layer.flat[at]), edit)
            if edits <= SHARE * k and (best is None or k - edits > best[0] - best[1]):
                best = k, edits, start, at // (len(b) + 1)
    return best


class Index:
    """Shingles of a block of items, and which of them a search starts from."""

    def __init__(self, items: list[tuple[int, list[str]]], rarity: dict):
        self.items = items
        self.all: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        self.prefix: dict[tuple, set[int]] = defaultdict(set)
        for key, (_, w) in enumerate(items):
            s = shingles(w)
            for k, x in enumerate(s):
                self.all[x].append((key, k))
            for k in prefix_positions(s, rarity):
                self.prefix[s[k]].add(key)

    def search(self, w: list[str]) -> list[tuple[int, int, int, int, int, int]]:
        """(item, words, edits, from, to, at) of the longest passage of each item in each stretch of a document's words."""
        at = [(j, x) for j, x in enumerate(shingles(w)) if x in self.all]
        wanted = set().union(*(self.prefix[x] for _, x in at if x in self.prefix))
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for j, x in at:
            for key, i in self.all[x]:
                if key in wanted:
                    hits[key].append((i, j))
        return [(self.items[key][0], *p, c[0][1]) for key, pairs in hits.items() for c in self._clusters(pairs) if (p := self._verify(self.items[key][1], w, c))]

    @staticmethod
    def _clusters(pairs: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
        """Hits with LEAST - 1 others near them in the item and near their diagonal, by stretch of the document."""
        if len(pairs) < LEAST or len({i for i, _ in pairs}) < LEAST:
            return []
        pairs.sort(key=lambda p: p[1])
        near, lo = [], 0
        for i, j in pairs:
            while pairs[lo][1] < j - 2 * WINDOW:
                lo += 1
            found = set()
            for p, q in pairs[lo:]:
                if q > j + 2 * WINDOW:
                    break
                if -EDITS <= q - p - j + i <= EDITS and SHINGLE - WINDOW <= p - i <= WINDOW - SHINGLE:
                    found.add(p)
                    if len(found) == LEAST:
                        near.append((i, j))
                        break
        clusters: list[list[tuple[int, int]]] = []
        for p in near:
            if clusters and p[1] - clusters[-1][-1][1] <= 2 * WINDOW:
                clusters[-1].append(p)
            else:
                clusters.append([p])
        return clusters

    @staticmethod
    def _verify(item: list[str], w: list[str], cluster: list[tuple[int, int]]) -> tuple[int, int, int, int] | None:
        """Exact containment: an alignment of WINDOW words or more with few enough edits, or one within a noisier copy."""
        margin = WINDOW + EDITS
        a0, b0 = (max(0, min(p[k] for p in cluster) - margin) for k in (0, 1))
        a, b = item[a0 : max(p[0] for p in cluster) + margin + SHINGLE], w[b0 : max(p[1] for p in cluster) + margin + SHINGLE]
        for price in (2.0, 1.0):
            length, edits, start, end = align(a, b, price)
            if length >= WINDOW and edits <= SHARE * length:
                return length, edits, a0 + start, a0 + end
        found = window(a, b)
        return found and (*found[:2], a0 + found[2], a0 + found[3])


RESULT = "item long, doc long, words int, edits int, item_from int, item_to int, doc_word int"


def leaked_passages(corpus: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, doc, words, edits, item_from, item_to, doc_word): each passage of an item that stands in a document.

    A passage has 18 or more words of which at most about one in five is changed, missing or added; `doc_word` is the
    word of the document from which on it shares shingles. Of passages of one item that follow each other within 36
    words, the one with most matches is given. Shingles of three words are ordered by the number of corpus documents
    that hold them; each window of an item is looked up by its rarest shingles only (its prefix), hits must lie near
    one diagonal, and an alignment decides. One pass over the corpus counts the items' own shingles and keeps the
    words of documents that hold enough of one item's; only these are searched. The items are held in blocks of at
    most BLOCK_WORDS words, one pass over the corpus each, so the memory taken doesn't depend on them. Null or empty
    texts hold no passage, and rows without a key are left out; copies are found each; other columns are ignored whatever their names.
    """
    spark = corpus.sparkSession
    letters = look_alike_letters(spark)
    docs = corpus.select(F.col(doc).alias("__doc"), F.col(text).alias("__text")).where("__doc is not null and __text is not null")
    out = None
    for block in _blocks(items, item, text, letters):
        sifted = checkpointed(docs.mapInPandas(_sifter(spark.sparkContext.broadcast((block, letters))), "doc long, words string, shingle string, n bigint"))
        counts = sifted.where("shingle is not null").groupBy("shingle").agg(F.sum("n").alias("n"))
        # As many rows as the block has shingles, whatever the corpus's size.
        rarity = {tuple(r.shingle.split(" ")): r.n for r in counts.toLocalIterator()}
        found = sifted.where("doc is not null").select("doc", "words").mapInPandas(_searcher(spark.sparkContext.broadcast((block, rarity))), RESULT)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], RESULT)
    return out.withColumnsRenamed({"item": item, "doc": doc})


def _blocks(items: DataFrame, item: str, text: str, letters: Letters = ()) -> Iterator[list[tuple[int, list[str]]]]:
    """(key, words) of items in blocks of at most BLOCK_WORDS words, streamed to the driver one partition at a time."""
    block, size = [], 0
    for r in items.where(F.col(text).isNotNull() & F.col(item).isNotNull()).select(F.col(item).alias("k"), F.col(text).alias("t")).distinct().toLocalIterator():
        w = words(r.t, letters)
        if len(w) < WINDOW - EDITS:
            continue
        if block and size + len(w) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((r.k, w))
        size += len(w)
    if block:
        yield block


def _sifter(send):
    def rows(docs: list, texts: list, found: list, n: list) -> pd.DataFrame:
        return pd.DataFrame({"doc": pd.array(docs, dtype="Int64"), "words": pd.Series(texts, dtype="object"), "shingle": pd.Series(found, dtype="object"), "n": pd.array(n, dtype="Int64")})

    def sift(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, letters = send.value
        places: dict[tuple, list[int]] = defaultdict(list)  # the item of each place where a shingle stands
        for key, (_, w) in enumerate(items):
            for x in shingles(w):
                places[x].append(key)
        seen: Counter = Counter()
        for batch in batches:
            kept, texts = [], []
            for d, t in zip(batch["__doc"], batch["__text"], strict=True):
                w = words(t, letters)
                found = places.keys() & set(shingles(w))
                if not found:
                    continue
                seen.update(found)
                # A passage shares LEAST shingles of its item.
                if len(found) >= LEAST or any(len(places[x]) > 1 for x in found):
                    shared = Counter(key for x in found for key in places[x])
                    if max(shared.values()) >= LEAST:
                        kept.append(d)
                        texts.append(" ".join(w))
            yield rows(kept, texts, [None] * len(kept), [None] * len(kept))
        yield rows([None] * len(seen), [None] * len(seen), [" ".join(x) for x in seen], list(seen.values()))

    return sift


def _searcher(send):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(*send.value)
        for batch in batches:
            rows = [(f[0], d, *f[1:]) for d, t in zip(batch["doc"], batch["words"], strict=True) for f in index.search(t.split(" "))]
            yield pd.DataFrame(rows, columns=["item", "doc", "words", "edits", "item_from", "item_to", "doc_word"])

    return search
