"""Problem 8: encoding texts with a public byte-level BPE vocabulary.

A text is cut into pieces by the vocabulary's pattern. Within a piece the live pairs of
neighbouring tokens lie in a segment tree over byte positions: every leaf holds the merge rank of
the pair that begins there and its position, every inner node the least of its children, so the
root is the leftmost pair of lowest rank. A merge takes the right token out of the chain of live
positions and updates the leaves of its neighbours up to the root. Pieces of similar length are
merged in step: one array operation does the same step in all their trees.
"""

from __future__ import annotations

import base64
import functools
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mathloom.llm.tables import read

#: Folder of the vocabulary files on the driver; None asks the installed package.
TOKENIZER_DIR: str | None = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"

# Fixed value: the pattern that cuts texts into pieces before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose ids a worker keeps; the store is emptied when it is full.
KEPT_PIECES = 200_000
#: Texts are cut and merged in groups of about so many characters, to bound a worker's memory.
GROUP_CHARS = 400_000
#: Tree cells that are worked on at once.
_CELLS = 1 << 20
_NONE = np.int64(2**62)


class Vocabulary:
    """Merge ranks of a rank file, with a hash table from pairs of ids to the rank of their union."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self._build(np.array(keys, np.int64), np.array(values, np.int64))
        self.size = max(ranks.values()) + 1

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.tables = []
        level = 0
        while len(keys):
            slot = self._slot(keys, level)
            _, first = np.unique(slot, return_index=True)
            table, to = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NONE, np.int64)
            table[slot[first]], to[slot[first]] = keys[first], values[first]
            self.tables.append((table, to))
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, values, level = keys[left], values[left], level + 1

    def _slot(self, keys: np.ndarray, level: int) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64((0x9E3779B97F4A7C15 + 2 * level * 0x6A09E667F3BCC909) & 0xFFFFFFFFFFFFFFFF | 1)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the union of two tokens, _NONE if it is no token."""
        keys = left << 32 | right
        out = np.full(len(keys), _NONE)
        for level, (table, to) in enumerate(self.tables):
            slot = self._slot(keys, level)
            hit = table[slot] == keys
            out[hit] = to[slot[hit]]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each non-empty piece."""
        out: list = [None] * len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = np.left_shift(1, np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
        for w in np.unique(width):
            at = np.flatnonzero(width == w)
            step = max(1, _CELLS // int(w))
            for k in range(0, len(at), step):
                part = at[k : k + step]
                for i, ids in zip(part, self._merge([pieces[i] for i in part], size[part], int(w))):
                    out[i] = ids
        return out

    def _merge(self, pieces: list[bytes], size: np.ndarray, w: int) -> list[np.ndarray]:
        n = len(pieces)
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        at = np.arange(w)
        held = at < size[:, None]
        token = np.full((n, w), -1, np.int64)
        token[held] = self.byte_ids[flat]
        if w > 1:
            follows = np.where(at + 1 < size[:, None], at + 1, w)
            before = np.broadcast_to(at - 1, (n, w)).copy()
            tree = np.full((n, 2 * w), _NONE, np.int64)
            pair = held[:, 1:]
            leaves = np.full(pair.shape, _NONE)
            leaves[pair] = self.ranks(token[:, :-1][pair], token[:, 1:][pair])
            tree[:, w : 2 * w - 1] = np.where(leaves < _NONE, leaves << 32 | at[:-1], _NONE)
            level = w
            while level > 1:
                level //= 2
                tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            rows = np.flatnonzero(tree[:, 1] < _NONE)
            while len(rows):
                root = tree[rows, 1]
                p = root & 0xFFFFFFFF
                q = follows[rows, p]
                after = follows[rows, q]
                token[rows, p] = root >> 32
                token[rows, q] = -1
                follows[rows, p] = after
                more = after < w
                before[rows[more], after[more]] = p[more]
                value = np.full(len(rows), _NONE)
                value[more] = self._leaf(token[rows[more], p[more]], token[rows[more], after[more]], p[more])
                prior = before[rows, p]
                has = prior >= 0
                lead, at_lead = rows[has], prior[has]
                tree[rows, w + p] = value
                tree[rows, w + q] = _NONE
                tree[lead, w + at_lead] = self._leaf(token[lead, at_lead], token[lead, p[has]], at_lead)
                self._update(tree, rows, p, q, lead, at_lead, w)
                rows = rows[tree[rows, 1] < _NONE]
        keep = token >= 0
        return np.split(token[keep], np.cumsum(keep.sum(1))[:-1])

    def _leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        rank = self.ranks(left, right)
        return np.where(rank < _NONE, rank << 32 | at, _NONE)

    @staticmethod
    def _update(tree, rows, p, q, lead, at_lead, w: int) -> None:
        """Bring the paths from the changed leaves to the root up to date, level by level."""
        r = np.concatenate([rows, rows, lead])
        node = np.concatenate([p, q, at_lead]) + w
        flat = tree.reshape(-1)
        base = r * tree.shape[1]
        while w > 1:
            w //= 2
            node = node >> 1
            child = base + 2 * node
            flat[base + node] = np.minimum(flat[child], flat[child + 1])


def _file(folder: str | None, name: str) -> str:
    path = os.path.join(folder, f"{name}.tiktoken") if folder else ""
    if not os.path.exists(path):
        import public_tokenizers

        path = public_tokenizers.path(f"{name}.tiktoken")
    return path


_sent: set[tuple[str, str]] = set()


def send_vocabulary(spark: SparkSession, folder: str | None = None, name: str = VOCABULARY) -> None:
    """Send the rank file from the driver to all executors, once an application, so that none needs the folder."""
    context = spark.sparkContext
    if (context.applicationId, name) not in _sent:
        context.addFile(_file(folder, name))
        _sent.add((context.applicationId, name))


@functools.cache
def vocabulary(folder: str | None = None, name: str = VOCABULARY) -> Vocabulary:
    """The vocabulary: in a task that of the file that was sent, elsewhere that of the folder or the installed package."""
    sent = SparkFiles.get(f"{name}.tiktoken") if TaskContext.get() else ""
    return Vocabulary(sent if os.path.exists(sent) else _file(folder, name))


class Encoder:
    """Encodes texts, keeping the ids of pieces it has met."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.cut = regex.compile(PATTERN).findall
        self.known: dict[str, np.ndarray] = {}

    def __call__(self, texts: list) -> list[np.ndarray]:
        """Ids of each text; null and empty texts give none."""
        out, begin, chars = [], 0, 0
        for i, t in enumerate(texts):
            chars += len(t or "")
            if chars >= GROUP_CHARS or i == len(texts) - 1:
                out += self._group(texts[begin : i + 1])
                begin, chars = i + 1, 0
        return out

    def _group(self, texts: list) -> list[np.ndarray]:
        cut = [self.cut(t) if t else [] for t in texts]
        new = list(set(chain.from_iterable(cut)).difference(self.known))
        if len(self.known) + len(new) > KEPT_PIECES:
            self.known.clear()
            new = list(set(chain.from_iterable(cut)))
        for piece, ids in zip(new, self.vocab.encode_pieces([p.encode("utf-8", "surrogatepass") for p in new])):
            self.known[piece] = ids
        none = np.zeros(0, np.int64)
        return [np.concatenate([self.known[p] for p in c]) if c else none for c in cut]


def _arrow_lists(ids: list[np.ndarray]) -> pa.Array:
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    flat = np.concatenate(ids) if len(ids) else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32), pa.int32()))


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = TOKENIZER_DIR) -> DataFrame:
    """(key, ids) of every row; null and empty texts get an empty list, strings that look like special
    tokens are plain text. Rows stay as they are, repeated keys included; a null key is kept."""
    kind = dict(docs.dtypes)[key]
    send_vocabulary(docs.sparkSession, folder)

    def run(batches):
        encode = Encoder(vocabulary(folder))
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), _arrow_lists(encode(part.column(1).to_pylist()))], [key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = TOKENIZER_DIR) -> DataFrame:
    """(key, n_tokens) of every row; only the numbers leave the Python workers."""
    kind = dict(docs.dtypes)[key]
    send_vocabulary(docs.sparkSession, folder)

    def run(batches):
        encode = Encoder(vocabulary(folder))
        for b in batches:
            n = [len(x) for x in encode(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], [key, "n_tokens"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, n_tokens long")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(read(spark, sf_dir, "documents"))


def p8_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(read(spark, sf_dir, "documents"))
    return counts.agg(F.count("*").alias("documents"), F.sum((F.col("n_tokens") == 0).cast("long")).alias("without_tokens"), F.sum("n_tokens").alias("tokens"))


QUERIES = {"p8_ids": p8_ids, "p8_counts": p8_counts}
ORACLE: dict[str, str] = {}
