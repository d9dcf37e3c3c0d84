"""SentencePiece encoding and decoding by suffix-array matching.

A task joins the distinct chunks of a batch of texts (see pieces) into one string, sorts its suffixes by as many
characters as the longest piece has (by doubling), and finds the range of every piece by binary search
(by the first characters, packed into a number, then by the rest). The ranges
give all edges (position, piece); sorted by where they end, they are relaxed: an edge extends the encoding of the text
before it if the model would leave the last piece of that encoding and the edge's piece side by side. For merges by
rank that depends on the two pieces alone, and exactly one edge ends each prefix's encoding. Pieces whose parts rank
after them (runs of spaces in some models) break that rule; chunks with such a piece are merged one step at a time.

Ids equal those of the model's own encoder. Decoding joins the pieces, turns byte pieces into bytes and drops the
space put in front: a text comes back as it was, but for U+2581, which comes back as a space.

Defined cases: a null or empty text has no ids and decodes to the empty text; characters outside the vocabulary become
byte pieces; equal rows each give a row; an empty table gives an empty one; only the two named columns are read.
"""

from __future__ import annotations

import hashlib
import heapq
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanledger.llm import common as C
from scanledger.llm import pieces as P

#: Characters of texts worked on together, and of distinct chunks matched together.
GROUP = 4 << 20
MATCHED = 1 << 18
REMEMBERED = 250_000
_SLOTS = 1 << 21


class Encoder:
    """Pieces in the order of merging: single characters first, then by falling score."""

    def __init__(self, v: P.Pieces):
        order = sorted(range(len(v.names)), key=lambda i: (len(v.names[i]) > 1, -v.scores[i], v.ids[i]))
        self.names = [v.names[i] for i in order]
        self.ids = np.array([v.ids[i] for i in order], np.int32)
        self.rank = {n: i for i, n in enumerate(self.names)}
        self.byte_ids = v.bytes_
        n = len(self.names)
        self.n = n
        self.length = np.array([len(x) for x in self.names], np.int64)
        self.width = int(self.length.max())
        self.codes = np.zeros((n, self.width), np.uint32)
        for i, x in enumerate(self.names):
            self.codes[i, : len(x)] = [ord(c) for c in x]
        # every way to put a piece together from two; its own last merge
        pairs = [(self.rank[x[:k]] * n + self.rank[x[k:]], i) for i, x in enumerate(self.names) for k in range(1, len(x)) if x[:k] in self.rank and x[k:] in self.rank]
        self.pair_keys, self.pair_made = (np.array(x, np.int64) for x in zip(*sorted(pairs), strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
        self.left, self.right = np.arange(n), np.arange(n)
        self.odd: set[str] = set()
        self.reached = np.ones(n, bool)
        for i, x in enumerate(self.names):
            if len(x) > 1:
                steps = self.merge(x, trace=True)
                self.reached[i] = steps[0] == [i]
                if self.reached[i]:
                    self.left[i], self.right[i] = steps[1]
                    if max(steps[1]) >= i:
                        self.odd.add(x)

    @classmethod
    def of(cls, tables: dict) -> Encoder:
        """An encoder from another one's ``vars``."""
        out = cls.__new__(cls)
        vars(out).update(tables, slot_key=np.full(_SLOTS, -1, np.int64), slot_ok=np.zeros(_SLOTS, bool))
        return out

    def merge(self, text: str, trace: bool = False):
        """Pieces (unknown characters as -1 - code point) by merging the pair of lowest rank, leftmost first, until none is left."""
        part = [self.rank.get(c, -1 - ord(c)) for c in text]
        words = list(text)
        before, after = list(range(-1, len(part) - 1)), list(range(1, len(part) + 1))
        heap = []

        def push(i: int) -> None:
            j = after[i]
            if j < len(part):
                made = self.rank.get(words[i] + words[j])
                if made is not None:
                    heapq.heappush(heap, (made, i, len(words[i]), len(words[j])))

        for i in range(len(part) - 1):
            push(i)
        last = (-1, -1)
        while heap:
            made, i, a, b = heapq.heappop(heap)
            j = after[i] if words[i] else len(part)
            if j >= len(part) or len(words[i]) != a or len(words[j]) != b:
                continue
            last = (part[i], part[j])
            part[i], words[i], words[j] = made, words[i] + words[j], ""
            after[i] = after[j]
            if after[j] < len(part):
                before[after[j]] = i
            if before[i] >= 0:
                push(before[i])
            push(i)
        out = [p for p, w in zip(part, words, strict=True) if w]
        return (out, last) if trace else out

    def beside(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the encoder leaves piece x followed by piece y as they are: no merge across them comes before theirs."""
        key = x.astype(np.int64) * self.n + y
        slot = (key * np.int64(0x9E3779B97F4A7C1) >> np.int64(20)) & np.int64(_SLOTS - 1)
        out = self.slot_ok[slot]
        miss = np.flatnonzero(self.slot_key[slot] != key)
        if len(miss):
            fresh, at = np.unique(key[miss], return_index=True)
            ok = self._undo(fresh // self.n, fresh % self.n)
            out[miss] = ok[np.searchsorted(fresh, key[miss])]
            self.slot_key[slot[miss][at]], self.slot_ok[slot[miss][at]] = fresh, ok  # of two keys in a slot the last stays in both
        return out

    def _undo(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Takes both pieces apart, latest merge first; a merge across them that ranks before the one undone comes first."""
        x, y = x.copy(), y.copy()
        limit = np.full(len(x), np.iinfo(np.int64).max)
        out, live = np.ones(len(x), bool), np.arange(len(x))
        while len(live):
            a, b = x[live], y[live]
            key = a * self.n + b
            place = np.minimum(np.searchsorted(self.pair_keys, key), max(0, len(self.pair_keys) - 1))
            crosses = (self.pair_keys[place] == key) & (self.pair_made[place] < limit[live]) if len(self.pair_keys) else np.zeros(len(live), bool)
            out[live[crosses]] = False
            live, a, b = live[~crosses], a[~crosses], b[~crosses]
            can_a, can_b = self.left[a] != a, self.left[b] != b
            take_a = can_a & (~can_b | (a > b))
            take_b = can_b & ~take_a
            # a merge of equal rank further left comes first: left of the pair before, right of it after
            limit[live] = np.where(take_a, a, np.where(take_b, b + 1, 0))
            x[live] = np.where(take_a, self.right[a], a)
            y[live] = np.where(take_b, self.left[b], b)
            live = live[take_a | take_b]
        return out

    def matches(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, piece) of every occurrence in a text of code points; 0 ends each chunk."""
        n, width = len(text), self.width
        characters, rank = np.unique(text, return_inverse=True)
        rank, bits, step = rank.astype(np.uint64) + np.uint64(1), len(characters).bit_length(), 1
        while step < width and 2 * step * bits <= 64:  # as many characters as fit a number, without sorting
            ahead = np.zeros(n, np.uint64)
            ahead[: max(0, n - step)] = rank[step:]
            rank, step = rank << np.uint64(step * bits) | ahead, 2 * step
        front, taken = rank, step
        while step < width:
            _, rank = np.unique(rank, return_inverse=True)
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - step)] = rank[step:] + 1
            rank, step = rank.astype(np.int64) * (n + 1) + ahead, 2 * step
        suffixes = np.argsort(rank, kind="stable").astype(np.int32)
        padded = np.r_[text, np.zeros(width, np.uint32)]
        present = np.unique(text)
        can = np.flatnonzero(self.reached & np.isin(self.codes, np.r_[0, present]).all(1))
        codes, length = self.codes[can], self.length[can]
        # the range of each piece by as many characters as a number holds; longer pieces are then sought within it
        least, head = np.zeros(len(can), np.uint64), np.minimum(length, taken)
        for i in range(min(taken, width)):
            own = (np.searchsorted(characters, codes[:, i]) + 1).astype(np.uint64) << np.uint64(bits * (taken - 1 - i))
            least |= np.where(i < head, own, np.uint64(0))
        most = least | (np.uint64(1) << (bits * (taken - head)).astype(np.uint64)) - np.uint64(1)
        lead = front[suffixes]
        ends = [np.searchsorted(lead, least, "left"), np.searchsorted(lead, most, "right")]
        far = np.flatnonzero((length > taken) & (ends[0] < ends[1]))
        codes, mask = codes[far], np.arange(width)[None, :] < length[far][:, None]
        sought = []
        for upper in (False, True):
            low, high = ends[0][far], ends[1][far]
            while (low < high).any():
                middle = (low + high) // 2
                window = padded[suffixes[np.minimum(middle, n - 1)][:, None] + np.arange(width)[None, :]]
                differs = (window != codes) & mask
                first = differs.argmax(1)[:, None]
                same = ~differs.any(1)
                less = ~same & (np.take_along_axis(window, first, 1) < np.take_along_axis(codes, first, 1))[:, 0]
                go = (less | (same & upper)) & (low < high)
                high = np.where(go | (low >= high), high, middle)
                low = np.where(go, middle + 1, low)
            sought.append(low)
        ends[0][far], ends[1][far] = sought
        number = ends[1] - ends[0]
        piece = np.repeat(can.astype(np.int32), number)
        at = np.repeat(ends[0] - np.r_[0, np.cumsum(number)[:-1]], number) + np.arange(len(piece)) if len(can) else np.zeros(0, np.int64)
        return suffixes[at], piece

    def encode(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk (spaces as U+2581) as int32 bytes."""
        out: list[bytes] = [b""] * len(chunks)
        plain = []
        for i, chunk in enumerate(chunks):
            if self.odd and any(x in chunk for x in self.odd):
                out[i] = self.told(self.merge(chunk))
            else:
                plain.append(i)
        begin = 0
        while begin < len(plain):
            end, held = begin, 0
            while end < len(plain) and (end == begin or held < MATCHED):
                held += len(chunks[plain[end]]) + 1
                end += 1
            for i, ids in zip(plain[begin:end], self._relax([chunks[i] for i in plain[begin:end]]), strict=True):
                out[i] = ids
            begin = end
        return out

    def told(self, pieces: list[int]) -> bytes:
        ids: list[int] = []
        for p in pieces:
            if p >= 0:
                ids.append(int(self.ids[p]))
            else:
                ids += [self.byte_ids[b] for b in chr(-1 - p).encode()]
        return np.array(ids, np.int32).tobytes()

    def _relax(self, chunks: list[str]) -> list[bytes]:
        text = np.frombuffer(("\0".join(chunks) + "\0").encode("utf-32-le"), np.uint32)
        sizes = np.array([len(c) for c in chunks], np.int64)
        starts = np.r_[0, np.cumsum(sizes + 1)[:-1]]
        start, piece = self.matches(text)
        chunk = np.repeat(np.arange(len(chunks)), sizes + 1)
        # last piece of the encoding of the text up to a position: -1 nothing before, below that an unknown character
        last = np.full(len(text) + 1, -1, np.int64)
        offset = np.arange(len(text)) - starts[chunk]
        end_offset = offset[start] + self.length[piece]
        longest = int(sizes.max(initial=0))
        end_offset = end_offset.astype(np.uint16 if longest < 1 << 16 else np.int64)
        order = np.argsort(end_offset, kind="stable")
        start, piece = start[order], piece[order]
        cuts = np.r_[0, np.cumsum(np.bincount(end_offset, minlength=longest + 1))]
        # characters that are no piece: unknown, whatever stands beside them
        single = np.zeros(len(text), bool)
        single[start[self.length[piece] == 1]] = True
        unknown = np.flatnonzero(~single & (offset < sizes[chunk]))
        last[unknown + 1] = -2 - text[unknown].astype(np.int64)
        for e in range(1, len(cuts) - 1):
            own = slice(cuts[e], cuts[e + 1])
            s, p = start[own], piece[own]
            before = last[s]
            ok = (offset[s] == 0) | (before < -1)
            check = np.flatnonzero(~ok & (before >= 0))
            ok[check] = self.beside(before[check], p[check])
            last[s[ok] + self.length[p[ok]]] = p[ok]
        # walk back from the ends of all chunks at once
        at, who, steps = starts + sizes, np.arange(len(chunks)), []
        while True:
            live = at > starts[who]
            at, who = at[live], who[live]
            if not len(at):
                break
            p = last[at]
            steps.append((who, at, p))
            at = at - np.where(p >= 0, self.length[np.maximum(p, 0)], 1)
        if not steps:
            return [b""] * len(chunks)
        who, at, p = (np.concatenate(x) for x in zip(*steps, strict=True))
        order = np.lexsort((at, who))
        who, p = who[order], p[order]
        cuts = np.searchsorted(who, np.arange(len(chunks) + 1))
        known, ids = p >= 0, self.ids[np.maximum(p, 0)]
        spoiled = set(who[~known].tolist())
        return [self.told([int(x) if x >= 0 else int(x) + 1 for x in p[a:b]]) if i in spoiled else ids[a:b].tobytes() for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))]


def piece_bytes(v: P.Pieces) -> list[bytes]:
    """What each id decodes to."""
    out = [b""] * v.size
    for name, i in zip(v.names, v.ids, strict=True):
        out[i] = name.replace(P.SPACE, " ").encode()
    for b, i in enumerate(v.bytes_):
        out[i] = bytes([b])
    return out


def decode_ids(ids: list[int], table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, ids))[1:]


def _vocabulary(docs: DataFrame, model: str):
    """What tasks need, worked out once: the encoder's tables, what each id decodes to, and the characters that stand alone."""
    v = P.load(model)
    return C.prepare(docs.sparkSession).sparkContext.broadcast({"encoder": vars(Encoder(v)), "table": piece_bytes(v), "breaks": v.breaks})


def _decoded(ids: list[bytes], table: list[bytes]) -> list[bytes]:
    """What each chunk's ids decode to, the space in front included."""
    cuts = np.cumsum([0] + [len(x) // 4 for x in ids]).tolist()
    names = [table[i] for i in np.frombuffer(b"".join(ids), np.int32).tolist()]
    return [b"".join(names[a:b]) for a, b in zip(cuts, cuts[1:])]


def _encoded(batches, vocabulary):
    """Of each batch and group of its texts: the rows, their ids as int32 bytes, and whether the ids decode to the text.

    Equal chunks are encoded and decoded once; a text's ids and what they decode to are those of its chunks, joined.
    """
    told = vocabulary.value
    encoder, known, chunks = Encoder.of(told["encoder"]), {}, P.chunker(told["breaks"])
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        begin = 0
        while begin < len(texts):
            end, held = begin, 0
            while end < len(texts) and (end == begin or held < GROUP):
                held += len(texts[end])
                end += 1
            cut = [chunks(t) for t in texts[begin:end]]
            fresh = sorted(set().union(*cut) - known.keys())
            if len(known) + len(fresh) > REMEMBERED:
                known.clear()
                fresh = sorted(set().union(*cut))
            made = encoder.encode([c.replace(" ", P.SPACE) for c in fresh])
            known.update(zip(fresh, zip(made, _decoded(made, told["table"]), strict=True), strict=True))
            ids, same = [], []
            for t, c in zip(texts[begin:end], cut, strict=True):
                of = [known[x] for x in c]
                ids.append(b"".join([x for x, _ in of]))
                same.append(b"".join([x for _, x in of])[1:] == t.replace(P.SPACE, " ").encode())
            yield batch.slice(begin, end - begin), ids, same
            begin = end


def _encode(batches, vocabulary):
    for rows, ids, same in _encoded(batches, vocabulary):
        offsets = np.r_[0, np.cumsum([len(x) // 4 for x in ids])].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), lists, pa.array(same, pa.bool_())], names=["doc_id", "ids", "round_trip"])


def _decode(batches, vocabulary):
    table = vocabulary.value["table"]
    for batch in batches:
        texts = [decode_ids(ids or [], table).decode(errors="replace") for ids in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])


def _digest(batches, vocabulary):
    names = ["doc_id", "n_tokens", "ids_sha256", "round_trip"]
    for rows, ids, same in _encoded(batches, vocabulary):
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array(same, pa.bool_())], names=names)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = P.MODEL) -> DataFrame:
    """(doc_id, ids array<int>, round_trip: whether decoding gives the text)."""
    told = _vocabulary(docs, model)
    return _rows(docs, id_col, text_col).mapInArrow(C.task(_encode, vocabulary=told), "doc_id long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model: str = P.MODEL) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids)."""
    told = _vocabulary(encoded, model)
    return encoded.select("doc_id", "ids").mapInArrow(C.task(_decode, vocabulary=told), "doc_id long, text string")


def encoded_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = P.MODEL) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256 of the ids as little-endian int32, round_trip: whether decoding gives the text)."""
    told = _vocabulary(docs, model)
    return _rows(docs, id_col, text_col).mapInArrow(C.task(_digest, vocabulary=told), "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean")


def op8(spark, sf_dir: str) -> DataFrame:
    return encoded_digest(C.table(spark, sf_dir, "documents"))
