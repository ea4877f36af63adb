"""BPE encoding and decoding by a segment tree over adjacent pair ranks.

A word's symbols are a doubly linked list. The tree's leaf i holds the rank of the pair that starts at symbol i
(no pair: infinite); each inner node holds the smaller child. The root's value is the lowest rank, a descent that
prefers the left child gives its leftmost place. A merge changes three leaves: the merged pair's own, its left
neighbour's and the one that vanished, each updated in log(n) steps; the word is done when the root is infinite.

Short words are merged many at a time: the trees of all words of one size class are the rows of one array, and each
step descends, merges and updates in every row at once. Longer words go through the same tree one by one.
Distinct pieces between spaces are kept in a bounded cache per worker, so a word is merged once and not per use.

Normal forms, patterns and vocabulary are read from the tokenizer's file. Truncation and padding are not used.

Defined results: null and empty texts have no ids and decode to the empty text; extra columns are not read; an empty
table gives no rows; rows with equal ids are encoded each; a text's length has no limit.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ledgerloom.llm.common import in_arrow
from ledgerloom.llm.tokenise import CACHE_PIECES, PLAIN, byte_symbols

#: Words of up to so many symbols are merged in one array.
SHORT = 64
INF = np.int32(2**31 - 1)


class Merges:
    """The pair table: (left id, right id) -> rank and merged id."""

    def __init__(self, pairs: list[tuple[int, int, int]]):
        """pairs: (left, right, merged) in rank order."""
        key = np.array([(a << 32) | b for a, b, _ in pairs] or [-1], np.int64)
        self.table = {(a, b): (rank, m) for rank, (a, b, m) in reversed(list(enumerate(pairs)))}
        self.merged = np.array([m for *_, m in pairs] or [0], np.int64)
        # open addressing with linear probing: one look at a slot finds most pairs
        self.bits = max(4, int(np.ceil(np.log2(len(pairs) + 1))) + 2)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, INF, np.int32)
        self.probes = 0
        for k, rank in zip(key.tolist(), range(len(pairs))):
            slot, n = self.slot(k), 0
            while self.keys[slot] not in (-1, k):
                slot, n = (slot + 1) & (len(self.keys) - 1), n + 1
            if self.keys[slot] == -1:
                self.keys[slot], self.ranks[slot] = k, rank
            self.probes = max(self.probes, n)

    def slot(self, key: int) -> int:
        return ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; negative ids stand for no symbol."""
        key = (left << 32) | right
        slot = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(key.shape, INF, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        key, slot = key[todo], slot[todo]
        while len(todo):
            found = self.keys[slot]
            hit = found == key
            out[todo[hit]] = self.ranks[slot[hit]]
            more = ~hit & (found != -1)
            todo, key, slot = todo[more], key[more], (slot[more] + 1) & (len(self.keys) - 1)
        return out

    def merge_one(self, ids: list[int]) -> list[int]:
        """One word, by a tree of its own."""
        n = len(ids)
        if n < 2:
            return ids
        size = 1 << (n - 1).bit_length()
        none, table, ids = int(INF), self.table, list(ids)
        tree = [none] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = table.get((ids[i], ids[i + 1]), (none,))[0]
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, rank: int) -> None:
            i += size
            tree[i] = rank
            i >>= 1
            while i:
                low = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == low:
                    break
                tree[i] = low
                i >>= 1

        while (low := tree[1]) != none:
            i = 1
            while i < size:
                i = 2 * i if tree[2 * i] == low else 2 * i + 1
            i -= size
            j = after[i]
            k = after[j]
            ids[i] = table[(ids[i], ids[j])][1]
            after[i] = k
            put(j, none)
            if k < n:
                before[k] = i
                put(i, table.get((ids[i], ids[k]), (none,))[0])
            else:
                put(i, none)
            if (p := before[i]) >= 0:
                put(p, table.get((ids[p], ids[i]), (none,))[0])
            ids[j] = -1
        return [x for x in ids if x >= 0]

    def merge_rows(self, ids: np.ndarray) -> np.ndarray:
        """Words as rows (padded with -1) of a power of two columns, merged in place; vanished symbols become -1."""
        n, size = ids.shape
        depth = size.bit_length() - 1
        tree = np.full((n, 2 * size), INF, np.int32)
        tree[:, size : 2 * size - 1] = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, size - 1)
        for level in range(depth - 1, -1, -1):
            a = 1 << level
            np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2], out=tree[:, a : 2 * a])
        after = np.broadcast_to(np.arange(1, size + 1), (n, size)).copy()
        before = np.broadcast_to(np.arange(-1, size - 1), (n, size)).copy()
        flat, nodes, width = ids.reshape(-1), tree.reshape(-1), 2 * size
        after, before = after.reshape(-1), before.reshape(-1)
        rows = np.flatnonzero(tree[:, 1] != INF)

        def put(row: np.ndarray, leaf: np.ndarray, rank: np.ndarray) -> None:
            base, node = row * width, leaf + size
            nodes[base + node] = rank
            for _ in range(depth):
                node = node >> 1
                nodes[base + node] = np.minimum(nodes[base + 2 * node], nodes[base + 2 * node + 1])

        while len(rows):
            base = rows * width
            low = nodes[base + 1]
            node = np.ones(len(rows), np.int64)
            for _ in range(depth):
                node = 2 * node
                node += nodes[base + node] != low
            i = node - size
            at = rows * size
            j = after[at + i]
            k = after[at + j]
            flat[at + i] = self.merged[low]
            flat[at + j] = -1
            after[at + i] = k
            inside = k < size
            before[(at + k)[inside]] = i[inside]
            right = np.where(inside, flat[at + np.minimum(k, size - 1)], -1)
            own = flat[at + i]
            put(rows, j, INF)
            p = before[at + i]
            left = np.where(p >= 0, flat[at + np.maximum(p, 0)], -1)
            ranks = self.rank(np.concatenate([own, left]), np.concatenate([right, own]))
            put(rows, i, ranks[: len(rows)])
            some = p >= 0
            put(rows[some], p[some], ranks[len(rows) :][some])
            rows = rows[nodes[base + 1] != INF]
        return ids


class SegmentTreeBpe:
    """Encodes and decodes as the tokenizers library does with a file of BPE with word ends."""

    def __init__(self, path: str):
        with open(path) as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.word = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.names = {i: x for x, i in {**vocab, **self.special}.items()}
        symbols = byte_symbols()
        self.byte_of = {s: b for b, s in enumerate(symbols)}
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + self.suffix] for s in symbols], np.int64)
        pairs = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        self.merges = Merges([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.cache: dict[str, bytes] = {"": b""}
        self.words: dict[bytes, bytes] = {}
        most = max(self.names) + 1
        self.name = [self.names.get(i, "") for i in range(most)]

    def lowered(self, text: str) -> str:
        """The file's normal form: NFC, then lower case by characters; white space separates words and is dropped."""
        text = unicodedata.normalize("NFC", text)
        return "".join([c.lower() for c in text]) if "Σ" in text else text.lower()

    def split(self, piece: str) -> list[str | int]:
        """Words to merge, and ids of special tokens, which are found before anything else."""
        if (piece.isascii() and piece.isprintable() or PLAIN.match(piece)) and "<|" not in piece:
            low = piece.lower()
            return [low] if low.isalpha() else self.word.findall(low)
        return [x for part in self.specials.split(piece) if part for x in ([self.special[part]] if part in self.special else self.word.findall(self.lowered(part)))]

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of distinct words, given as their bytes."""
        out: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
        classes: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) == 1:
                out[i] = self.last[[w[0]]]
            elif len(w) > SHORT:
                a = self.inner[np.frombuffer(w, np.uint8)]
                a[-1] = self.last[w[-1]]
                out[i] = np.array(self.merges.merge_one(a.tolist()), np.int64)
            else:
                classes.setdefault(1 << (len(w) - 1).bit_length(), []).append(i)
        for size, members in classes.items():
            length = np.array([len(words[i]) for i in members])
            raw = np.frombuffer(b"".join([words[i].ljust(size, b"\0") for i in members]), np.uint8).reshape(-1, size)
            ids = np.where(np.arange(size) < length[:, None], self.inner[raw], -1)
            every = np.arange(len(members))
            ids[every, length - 1] = self.last[raw[every, length - 1]]
            ids = self.merges.merge_rows(ids)
            kept = ids >= 0
            ends = np.cumsum(kept.sum(1))
            for i, x in zip(members, np.split(ids[kept], ends[:-1])):
                out[i] = x
        return out

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [(t or "").replace("\n", " ").split(" ") for t in texts]
        cache = self.cache
        if len(cache) > CACHE_PIECES:
            cache.clear()
            cache[""] = b""
        missing = list({p for ps in split for p in ps if p not in cache})
        parts = [self.split(p) for p in missing]
        words = {w: None for ps in parts for w in ps if isinstance(w, str)}
        merged = dict(zip(words, [x.astype("<u4").tobytes() for x in self.merge([w.encode() for w in words])]))
        for p, ws in zip(missing, parts):
            cache[p] = b"".join([merged[w] if isinstance(w, str) else np.array([w], "<u4").tobytes() for w in ws])
        out = [b"".join(map(cache.__getitem__, ps)) for ps in split]
        for p in missing:
            if len(p) > 64:
                del cache[p]
        return out

    def decode(self, ids: bytes) -> str:
        """As the library's decode() with special tokens kept: a file without a decoder joins the tokens by spaces."""
        name = self.name
        return " ".join([name[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def plain(self, ids: bytes) -> str:
        """The text that the ids stand for, words parted by one space: what the normal form kept of the original."""
        out = bytearray()
        for i in np.frombuffer(ids, "<u4").tolist():
            name = self.name[i]
            if name in self.special:
                out += name.encode()
                continue
            ends = bool(self.suffix) and name.endswith(self.suffix) and name != self.suffix
            out += bytes(self.byte_of[c] for c in (name[: -len(self.suffix)] if ends else name)) + b" " * ends
        return out.decode("utf-8", "replace").rstrip(" ")


@lru_cache(2)
def tree_bpe(path: str) -> SegmentTreeBpe:
    """One encoder with its cache per worker process."""
    return SegmentTreeBpe(path)


def encode_decode(docs: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """One row per row of `docs` (doc_id, text): number of ids, digests of the ids and of the decoded text.

    With `with_ids` also the ids (binary, unsigned 32-bit little-endian) and the decoded text.
    """

    def run(batch: pa.RecordBatch) -> dict:
        bpe = tree_bpe(tokenizer)
        ids = bpe.encode_batch(batch.column(1).to_pylist())
        texts = [bpe.decode(x) for x in ids]
        out = {
            "doc_id": batch.column(0),
            "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts], pa.string()),
        }
        return out | ({"ids": pa.array(ids, pa.binary()), "decoded": pa.array(texts, pa.string())} if with_ids else {})

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return in_arrow(docs.select("doc_id", "text"), run, schema + (", ids binary, decoded string" if with_ids else ""))
