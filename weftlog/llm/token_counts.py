"""Word-piece token counts by a linear longest-match automaton."""

from __future__ import annotations

import base64
import hashlib
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftlog.llm.common import map_texts

#: Where the vocabulary lies unless `path` says otherwise; the driver alone reads it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Distinct words whose lengths a worker remembers; then it starts anew.
MEMORY = 1 << 18
#: Longest vocabulary that is sent to the executors, in bytes.
MOST_BYTES = 64 << 20


def load_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Pieces of a ranks file (base64 piece, rank); a leading space marks pieces that begin a word."""
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > MOST_BYTES:
        raise ValueError("the vocabulary is larger than MOST_BYTES")
    return [base64.b64decode(line.split()[0]) for line in data.splitlines() if line]


class Automaton:
    """A trie of pieces with failure links and, on each link, the number of pieces popped.

    Reading a word from the root, a missing edge at a node means that the longest piece on its path ends
    there: the link goes to the node of what remains of the path, and its count says how many pieces went.
    Each byte moves forward once and every link shortens the path, so a word takes linear time and
    no piece is built.
    """

    def __init__(self, pieces: list[bytes]):
        self.next: list[dict] = [{}]
        self.piece = [False]
        for p in pieces:
            node = 0
            for b in p:
                node = self.next[node].setdefault(b, len(self.next))
                if node == len(self.next):
                    self.next.append({})
                    self.piece.append(False)
            self.piece[node] = bool(p)
        n = len(self.next)
        self.link, self.popped = [-1] * n, [0] * n
        line = deque((c, 0, b) for b, c in self.next[0].items())
        while line:  # breadth first: links of shorter paths are there before they are used
            node, parent, b = line.popleft()
            if self.piece[node]:
                self.link[node], self.popped[node] = 0, 1
            else:
                z, count = self.link[parent], self.popped[parent]
                while z > 0 and b not in self.next[z] or z == 0 and b not in self.next[0]:
                    if z == 0:
                        z = -1
                        break
                    count += self.popped[z]
                    z = self.link[z]
                if z >= 0:
                    self.link[node], self.popped[node] = self.next[z][b], count
            line.extend((c, node, x) for x, c in self.next[node].items())

    def count(self, word: bytes) -> int:
        """Pieces of the greedy longest match, or 1 (the unknown piece) if a byte begins none."""
        nxt, link, popped = self.next, self.link, self.popped
        node = total = 0
        for b in word:
            while b not in nxt[node]:
                if link[node] < 0 or node == 0:
                    return 1
                total += popped[node]
                node = link[node]
            node = nxt[node][b]
        while node:
            if link[node] < 0:
                return 1
            total += popped[node]
            node = link[node]
        return total


class Counter(dict):
    """Lengths of words by the automaton, remembered."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.of = automaton.count

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        n = self[word] = self.of(b" " + word)
        return n


#: One for each vocabulary that this worker has seen, by the digest of its pieces, for all its tasks.
COUNTERS: dict[bytes, Counter] = {}


def counter(digest: bytes, pieces) -> Counter:
    if digest not in COUNTERS:
        COUNTERS[digest] = Counter(Automaton(pieces.value))
    return COUNTERS[digest]


def counts(docs: DataFrame, path: str = VOCABULARY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_tokens of every whole text.

    Words are runs of anything but ASCII white space, each read with a leading space; its length is that
    of the greedy longest match. The vocabulary (at most MOST_BYTES) is read by the driver and
    broadcast. A null or empty text has no words and no tokens. Repeated rows count each; other columns are not read.
    """
    own = load_vocabulary(path)
    digest = hashlib.sha256(b"".join(len(p).to_bytes(4, "big") + p for p in own)).digest()
    pieces = docs.sparkSession.sparkContext.broadcast(own)

    def make(texts: list) -> list:
        c = counter(digest, pieces)
        words = [(t or b"").split() for t in texts]
        return [[len(w) for w in words], [sum(map(c.__getitem__, w)) for w in words]]

    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())]
    return map_texts(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"], "text", fields, make)
