"""SentencePiece encoding and decoding by batched Viterbi in numpy.

Words of equal length advance together, one character at a time. At each end position the hashes of all
substrings that end there probe the sorted hashes of the pieces, and the best arc is kept as a
backpointer. Two kinds of model:

* unigram: an arc scores its piece's score plus the best score where it begins;
* BPE: an arc is admissible if its piece may follow the last piece of the prefix it extends, that is if
  merging the two pieces' characters by rank gives back these two pieces. A prefix of a BPE segmentation
  is the segmentation of that prefix, and a sequence is one if and only if all adjacent pairs admit each
  other, so exactly one arc is admissible at each position and ids equal those of merging by rank.

Characters without a piece become their UTF-8 bytes' pieces (byte fallback), or the unknown piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.chunks import ChunkIds, gather
from pulsegrid.llm.scratch import release, small_batches
from pulsegrid.llm.textnum import U64, column_bytes, mix, slices

SPACE = "▁"
_STEP = U64(0x100000001B3)
#: Characters of equal-length chunks that advance together at most.
TOGETHER = 200_000
#: Bytes of whole texts that are encoded at a time; a longer text is encoded alone.
ENCODE_BYTES = 2 << 20
DECODE_BYTES = 256 << 10


class SortedKeys:
    """Look-up in sorted 64-bit hashes: their leading bits say where a hash's few candidates begin."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.concatenate([keys, np.zeros(1, U64)])
        bits = max(4, int(len(keys)).bit_length() + 1)
        self.shift = U64(64 - bits)
        edges = np.searchsorted(keys, np.arange(1 << bits, dtype=U64) << self.shift)
        self.begin = np.append(edges, len(keys))

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Position of each hash, -1 where it is not a key."""
        slot = (hashes >> self.shift).astype(np.int64)
        at, end = self.begin[slot], self.begin[slot + 1]
        out = np.where((self.keys[at] == hashes) & (at < end), at, -1)
        rest = np.flatnonzero((out < 0) & (at + 1 < end))
        while len(rest):
            at[rest] += 1
            same = self.keys[at[rest]] == hashes[rest]
            out[rest[same]] = at[rest[same]]
            rest = rest[~same & (at[rest] + 1 < end[rest])]
        return out


class PieceModel:
    """Pieces of a SentencePiece model file, for encoding and decoding."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = n = sp.vocab_size()
        self.unk = sp.unk_id()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.scores = np.array([sp.get_score(i) for i in range(n)])
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.longest = max(len(self.pieces[i]) for i in normal)
        ranked = self.scores[[i for i in normal if self.scores[i] > -1e8]]
        self.bpe = bool(np.all(ranked == np.round(ranked)))
        self.id_of = {self.pieces[i]: i for i in normal}
        keys = np.array([self._hash(self.pieces[i]) for i in normal], U64)
        order = np.argsort(keys)
        self.keys, self.key_ids = SortedKeys(keys[order]), np.array(normal, np.int64)[order]
        self.pair_keys = np.zeros(0, U64)
        self.pair_ok = np.zeros(0, bool)
        self.pairs = SortedKeys(self.pair_keys)
        self.recent: dict[int, bool] = {}
        table = [bytes([int(p[3:5], 16)]) if i in set(self.byte_ids.values()) else b"" if sp.is_control(i) else (" ⁇ " if i == self.unk else p.replace(SPACE, " ")).encode() for i, p in enumerate(self.pieces)]
        self.byte_at = np.concatenate([[0], np.cumsum([len(x) for x in table])])
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.chunks = ChunkIds(self.cut, lambda found: self.encode_chunks([SPACE * m + c.replace(" ", SPACE) for c, m in found]))

    @staticmethod
    def _hash(piece: str) -> int:
        h = np.zeros(1, U64)
        for c in piece:
            h = h * _STEP + mix(np.array([ord(c) + 1], U64))
        return int(mix(h)[0])

    @staticmethod
    def cut(data: np.ndarray, offsets: np.ndarray):
        """Chunks that no piece spans: spaces, then everything up to the next one. Marked: the first of a text,
        before which a space is understood."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64), np.zeros(0, bool)
        space = data == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        heads = offsets[:-1][np.diff(offsets) > 0]
        begins[heads] = True
        starts = np.flatnonzero(begins)
        opens = np.zeros(len(data), bool)
        opens[heads] = True
        return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offsets), opens[starts]

    def _merge(self, symbols: list[str]) -> list[str]:
        """Merge characters by rank (best score first, leftmost on ties)."""
        get, scores = self.id_of.get, self.scores
        while len(symbols) > 1:
            best, where = -1e18, -1
            for i in range(len(symbols) - 1):
                k = get(symbols[i] + symbols[i + 1])
                if k is not None and scores[k] > best:
                    best, where = scores[k], i
            if where < 0:
                break
            symbols[where : where + 2] = [symbols[where] + symbols[where + 1]]
        return symbols

    def _admits(self, keys: np.ndarray) -> np.ndarray:
        """For keys (last + 1) * size + next (last 0: none), whether ``next`` may follow ``last``."""
        at = self.pairs(mix(keys.astype(U64)))
        ok = self.pair_ok[at] if len(self.pair_ok) else np.zeros(len(keys), bool)
        new = np.flatnonzero(at < 0)
        if len(new):
            distinct, where = np.unique(keys[new], return_inverse=True)
            ok[new] = np.array([self._admits_one(k) for k in distinct.tolist()], bool)[where]
            if len(self.recent) > 1000 + len(self.pair_keys) // 8:
                merged = np.concatenate([self.pair_keys, mix(np.array(list(self.recent), np.int64).astype(U64))])
                order = np.argsort(merged, kind="stable")
                self.pair_keys, self.pair_ok = merged[order], np.concatenate([self.pair_ok, np.array(list(self.recent.values()), bool)])[order]
                self.pairs = SortedKeys(self.pair_keys)
                self.recent = {}
        return ok

    def _admits_one(self, key: int) -> bool:
        ok = self.recent.get(key)
        if ok is None:
            last, piece = divmod(key, self.size)
            both = [*([self.pieces[last - 1]] if last else []), self.pieces[piece]]
            ok = self.recent[key] = self._merge([c for p in both for c in p]) == both
        return ok

    def _viterbi(self, codes: np.ndarray) -> np.ndarray:
        """codes: (words, length) code points. Returns (words, length + 1) ids of the arc that ends at each
        position (-1 for an unknown character) and its length, packed as id * 64 + length."""
        n, length = codes.shape
        letters = mix(codes.astype(U64) + U64(1))
        sums = np.zeros((n, length + 1), U64)
        for j in range(length):
            sums[:, j + 1] = sums[:, j] * _STEP + letters[:, j]
        powers = np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(self.longest, _STEP, U64)]))
        last = np.zeros((n, length + 1), np.int64)  # BPE: last id + 1 of each prefix, 0 at the start
        score = np.full((n, length + 1), -np.inf)
        score[:, 0] = 0
        back = np.zeros((n, length + 1), np.int64)
        for j in range(1, length + 1):
            best = np.full(n, -np.inf)
            arc = np.zeros(n, np.int64)
            single = np.zeros(n, bool)
            open_ = np.arange(n)  # rows whose best arc is not settled
            for k in range(1, min(j, self.longest) + 1):
                at = self.keys(mix(sums[open_, j] - sums[open_, j - k] * powers[k]))
                hit = at >= 0
                rows, ids = open_[hit], self.key_ids[at[hit]]
                if k == 1:
                    single[rows] = True
                if not len(rows):
                    continue
                if self.bpe:
                    before = last[rows, j - k]
                    ok = self._admits(np.where(before > self.size, 0, before) * self.size + ids)
                    value = np.where(ok & (score[rows, j - k] > -np.inf), 0.0, -np.inf)
                else:
                    value = score[rows, j - k] + self.scores[ids]
                better = value > best[rows]
                rows, ids = rows[better], ids[better]
                best[rows] = value[better]
                arc[rows] = ids * 64 + k
                if self.bpe:  # only one arc is admissible
                    open_ = open_[best[open_] < 0]
                    if not len(open_):
                        break
            lone = ~single  # no piece is this character: an arc of its own, as bytes or unknown
            fallback = score[:, j - 1] + (0.0 if self.bpe else self.scores.min() - 10.0)
            take = lone & (fallback > best)
            best[take] = fallback[take]
            arc[take] = -63  # -1 * 64 + 1
            score[:, j], back[:, j] = best, arc
            last[:, j] = np.where(arc < 0, self.size + 1, arc // 64 + 1)
        return back

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks end to end, and how many each has."""
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        order = np.argsort(lengths, kind="stable")
        edges = np.flatnonzero(np.diff(lengths[order])) + 1
        flat, sizes = [], []
        for group in np.split(order, edges):
            step = max(1, TOGETHER // max(1, int(lengths[group[0]])))
            for lo in range(0, len(group), step):
                ids, n = self._encode_equal([chunks[i] for i in group[lo : lo + step]])
                flat.append(ids)
                sizes.append(n)
        sizes = np.concatenate(sizes)
        starts = np.cumsum(sizes) - sizes
        back = np.empty(len(chunks), np.int64)
        back[order] = np.arange(len(chunks))
        return gather(np.concatenate(flat), starts[back], sizes[back]), sizes[back]

    def _encode_equal(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for chunks of equal length."""
        n = len(chunks)
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, -1)
        back = self._viterbi(codes)
        at = np.full(n, codes.shape[1])
        steps = []
        while (at > 0).any():
            arc = np.where(at > 0, back[np.arange(n), at], 0)
            steps.append(arc)
            at = at - (arc & 63)
        arcs = np.stack(steps[::-1], 1)
        odd = np.flatnonzero((arcs < 0).any(1))
        if not len(odd):
            return arcs[arcs != 0] >> 6, (arcs != 0).sum(1)
        plain = arcs.copy()
        plain[odd] = 0
        sizes = (plain != 0).sum(1)
        spelled = [self._with_bytes(chunks[i], arcs[i][arcs[i] != 0].tolist()) for i in odd]
        flat = np.concatenate([plain[plain != 0] >> 6, np.concatenate([np.array(x, np.int64) for x in spelled])])
        starts = np.cumsum(sizes) - sizes
        own = np.array([len(x) for x in spelled])
        starts[odd] = int(sizes.sum()) + np.cumsum(own) - own
        sizes[odd] = own
        return gather(flat, starts, sizes), sizes

    def _with_bytes(self, chunk: str, arcs: list[int]) -> list[int]:
        ids, at = [], 0
        for arc in arcs:
            if arc < 0:
                raw = chunk[at].encode("utf-8", "surrogatepass")
                ids += [self.byte_ids[b] for b in raw] if self.byte_ids else [self.unk]
                at += 1
            else:
                ids.append(arc >> 6)
                at += arc & 63
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column end to end, and where each text's begin (n + 1 values); null reads as empty."""
        if pc.any(pc.match_substring(texts, SPACE)).as_py():
            texts = pc.replace_substring(texts, SPACE, " ")
        return self.chunks(*column_bytes(texts))

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of id runs and where each begins; the mark before the first word is left out."""
        begin = np.where(starts[1:] > starts[:-1], starts[:-1], -1)
        n = np.diff(self.byte_at)[ids]
        first = self.byte_at[ids]
        heads = begin[begin >= 0]
        marked = heads[self.bytes[np.minimum(first[heads], len(self.bytes) - 1)] == 32]
        n[marked] -= 1
        first[marked] += 1
        return gather(self.bytes, first, n), np.concatenate([[0], np.cumsum(n)])[starts]


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The model of a file, read once in each process."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def _round_trip(codec: PieceModel, texts: pa.Array, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether the ids of each text decode to its bytes."""
    raw, offsets = column_bytes(texts)
    same = np.zeros(len(texts), bool)
    for i, j in slices(offsets, DECODE_BYTES):
        data, at = codec.decode(ids[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
        given, begin = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if len(given) == len(data) and np.array_equal(at, begin) and np.array_equal(given, data):
            same[i:j] = True
        else:
            same[i:j] = [np.array_equal(given[begin[k] : begin[k + 1]], data[at[k] : at[k + 1]]) for k in range(j - i)]
    return same


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Piece ids of each whole text, and whether decoding them gives the text back.

    Null and empty texts have no ids and decode to the empty text. Rows are independent, so repeated keys
    and null keys stay as they are. A text that holds the space mark itself does not come back unchanged,
    since the mark reads as a space. Returns key, ids, n_pieces, round_trip.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = model(path)
        for batch in batches:
            whole = column_bytes(batch.column(1))[1]
            for lo, hi in slices(whole, ENCODE_BYTES):
                part = batch.slice(lo, hi - lo)
                ids, starts = codec.encode(part.column(1))
                same = _round_trip(codec, part.column(1), ids, starts)
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(np.diff(starts)), pa.array(same)], names=[key, "ids", "n_pieces", "round_trip"])
        release()

    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>, n_pieces long, round_trip boolean")


def decode(rows: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Texts of id lists: key, text. A null list gives a null text; bytes that are no UTF-8 are replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = model(path)
        for batch in batches:
            lists = batch.column(1)
            runs = [np.array(x, np.int64) if x is not None else np.zeros(0, np.int64) for x in lists.to_pylist()]
            starts = np.concatenate([[0], np.cumsum([len(x) for x in runs])])
            data, at = codec.decode(np.concatenate([*runs, np.zeros(0, np.int64)]).astype(np.int64), starts)
            texts = [None if not lists[i].is_valid else data[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace") for i in range(len(runs))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")
