"""Cross-parsing entropy: how many longest-match phrases of a labelled text another text takes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Symbols of the automata: letters as they are written in lower case, one blank for all else; 0 ends a training sentence.
LETTERS = " abcdefghijklmnopqrstuvwxyzàáâãäçèéêëìíîïñòóôõöùúûüœß·'"
STOP, BLANK = 0, 1
LANES, CELLS = 4096, 4_000_000


def symbol_table() -> np.ndarray:
    table = np.full(0x250, BLANK, dtype=np.int32)
    for k, ch in enumerate(LETTERS):
        table[ord(ch)] = k + 1
        if ch.isalpha() and len(ch.upper()) == 1 and ord(ch.upper()) < len(table):
            table[ord(ch.upper())] = k + 1
    return table


SYMBOLS = symbol_table()
SIZE = len(LETTERS) + 1


def encode(text: str) -> np.ndarray:
    """Symbols of a text, runs of blanks made one, with a blank at either end, so that words match whole."""
    cp = np.frombuffer(f" {text} ".replace("’", "'").encode("utf-32-le", "replace"), dtype=np.uint32)
    s = SYMBOLS[np.minimum(cp, len(SYMBOLS) - 1)]
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = (s[1:] != BLANK) | (s[:-1] != BLANK)
    return s[keep]


def suffix_automaton(symbols: list[int]) -> np.ndarray:
    """Transitions (state x symbol -> state, -1 for none) of the smallest automaton of all substrings."""
    to: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        new = len(to)
        to.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(to)
                to.append(dict(to[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    table = np.full((len(to), SIZE), -1, dtype=np.int32)
    for s, edges in enumerate(to):
        for c, t in edges.items():
            table[s, c] = t
    return table


class CrossParser:
    """Automata of several labelled texts that parse many texts at once."""

    def __init__(self, labelled: dict[str, list[str]]):
        self.labels = sorted(labelled)
        tables, self.bits = [], []
        for label in self.labels:
            symbols: list[int] = [STOP]
            for sentence in labelled[label]:
                symbols += [*encode(sentence).tolist(), STOP]
            tables.append(suffix_automaton(symbols))
            self.bits.append(np.log2(max(2, len(symbols))))
        starts = np.cumsum([0, *(len(t) for t in tables[:-1])]) if tables else []
        # One flat table; every language's states follow one another, and -1 stays.
        self.flat = np.concatenate([np.where(t < 0, -1, t + s).ravel() for t, s in zip(tables, starts, strict=True)]).astype(np.int32) if tables else np.empty(0, np.int32)
        self.roots = np.asarray(starts, dtype=np.int32)
        self.bits = np.asarray(self.bits)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x labels) bits a symbol: the phrases of each text, each taking log2 of the labelled text's length; and the symbols."""
        n, k = len(texts), len(self.labels)
        coded = [encode(t) for t in texts]
        lengths = np.array([len(c) for c in coded], dtype=np.int64)
        counts = np.zeros((n, k), dtype=np.int32)
        if not n or not k:
            return counts.astype(float), lengths
        order = np.argsort(-lengths, kind="stable")
        lo = 0
        while lo < n:  # texts of like length together, so that few lanes idle; fewer at a time if they are long
            width = int(lengths[order[lo]])
            part = order[lo : lo + max(1, min(LANES, CELLS // width))]
            lo += len(part)
            grid = np.zeros((width, len(part)), dtype=np.int32)
            for col, t in enumerate(part):
                grid[: lengths[t], col] = coded[t]
            state = np.tile(self.roots, (len(part), 1))
            count = np.zeros((len(part), k), dtype=np.int32)
            live = np.searchsorted(-lengths[part], -np.arange(width), side="left")  # texts longer than each position
            for pos in range(width):
                m = live[pos]
                c = grid[pos, :m, None]
                nxt = self.flat[state[:m] * SIZE + c]
                ended = nxt < 0
                if ended.any():
                    # The phrase so far ends; the symbol begins the next one, or is one by itself if it is unknown.
                    fresh = self.flat[self.roots * SIZE + c]
                    count[:m] += (ended & (state[:m] != self.roots)).astype(np.int32) + (ended & (fresh < 0))
                    nxt = np.where(ended, np.where(fresh < 0, self.roots, fresh), nxt)
                state[:m] = nxt
            counts[part] = count + (state != self.roots)
        return counts * self.bits / np.maximum(lengths, 1)[:, None], lengths


@lru_cache(maxsize=4)
def parser_of(labelled: tuple[tuple[str, tuple[str, ...]], ...]) -> CrossParser:
    """The parser of a labelled text, built once a process."""
    return CrossParser({label: list(sentences) for label, sentences in labelled})
