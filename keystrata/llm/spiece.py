"""SentencePiece encoding and decoding with a max-plus parallel scan over giant documents.

The model file's pieces are merged by rank (BPE), and a segmentation is the
model's own exactly if every two neighbouring pieces stay apart when their text
is merged alone. So a lattice whose arcs (piece, next piece) weigh 0 if they are
so compatible and minus infinity if not has one path of weight 0: the encoding,
and max-plus algebra over it gives the library's ids.

A text longer than GIANT characters is cut every CHUNK characters, wherever that
is, and its chunks go to different tasks. A boundary state is the piece that
covers or ends at the cut. Each chunk yields the matrix of weights from entry
states to exit states; a document's matrices are combined associatively (a scan
of max-plus products), which fixes the state at each cut; then every chunk is
backtraced on its own, from its exit state to its entry state.

No piece holds a space after another character (checked when a model is loaded),
so runs of spaces with the word after them are lattices of their own with one
state at either end: they are encoded once per task and kept, and inside a chunk
only the words at its two cuts need the states.

Decoding joins the pieces' bytes, takes the marks for spaces and drops the first.

Edge cases: null text has null ids, no tokens and no round trip; empty text has
no tokens; the mark U+2581 in a text decodes to a space; unknown characters become
bytes; equal rows of giant texts are encoded once and come back as often as they
were; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, releasing, small_batches, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
GIANT, CHUNK = 1 << 16, 1 << 15
#: Words that a task keeps at most; the memory of this is bounded, results do not depend on it.
KEPT_WORDS, KEPT_PAIRS = 300_000, 500_000

MARK = "▁"
_UNIT = re.compile(f"{MARK}+[^{MARK}]*")
START = (0, 0)


class Pieces:
    """A model's pieces, its encoder of words, and the lattice between chunk cuts."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.vocab_size()
        special = [self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) for i in range(n)]
        pieces = [self.library.id_to_piece(i) for i in range(n)]
        self.ids = {p: i for i, (p, s) in enumerate(zip(pieces, special, strict=True)) if not s}
        self.rank = {p: -self.library.get_score(i) for p, i in self.ids.items()}
        self.bytes_at = {int(p[3:5], 16): i for i, p in enumerate(pieces) if self.library.is_byte(i)}
        self.longest = max(map(len, self.ids))
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces that span words are not supported")
        byte_of = {i: b for b, i in self.bytes_at.items()}
        self.table = [bytes([byte_of[i]]) if i in byte_of else p.encode() if p in self.ids else b"" for i, p in enumerate(pieces)]
        self.table[self.library.unk_id()] = " ⁇ ".encode()
        # The library gives nothing for an empty word, so that one is known from the start.
        self.one_mark = {MARK: np.array(self.piece_ids(MARK), np.int32).tobytes()}
        self.words: dict[str, bytes] = dict(self.one_mark)
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Merges by rank, leftmost first."""
        parts = list(text)
        while True:
            best = min(((self.rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank), default=None)
            if best is None:
                return parts
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def apart(self, left: str, right: str) -> bool:
        """Weight 0 of the arc; left empty: right begins a text or word."""
        got = self.pairs.get((left, right))
        if got is None:
            if len(self.pairs) > KEPT_PAIRS:
                self.pairs.clear()
            got = self.pairs[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return got

    def piece_ids(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        return [i] if i is not None else [self.bytes_at[b] for b in piece.encode()]

    def encode_marked(self, units: list[str]) -> bytes:
        """Ids, as int32 bytes, of words that each begin with a mark."""
        if len(self.words) > KEPT_WORDS:
            self.words = dict(self.one_mark)
        new = [u for u in dict.fromkeys(units) if u not in self.words]
        if new:
            # The library puts the first mark itself.
            for u, ids in zip(new, self.library.encode([u[1:].replace(MARK, " ") for u in new], num_threads=1), strict=True):
                self.words[u] = np.array(ids, np.int32).tobytes()
        words = self.words
        return b"".join([words[u] for u in units])

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        return self.encode_marked(_UNIT.findall(MARK + text.replace(" ", MARK)))

    def decode(self, ids) -> str:
        return b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")[1:]

    # The lattice. Positions are in `s`, the chunk with its margins.

    def states(self, s: str, cut_at: int) -> list[tuple[int, int]]:
        """(start, end) of every piece, or single character, that starts before the cut and ends at or after it."""
        out = []
        for a in range(max(0, cut_at - self.longest), cut_at):
            for b in range(cut_at, min(len(s), a + self.longest) + 1):
                if s[a:b] in self.ids or (b == a + 1 and s[a:b] not in self.ids):
                    out.append((a, b))
        return out

    def walk(self, s: str, begin: dict[int, dict[int, int]], stop: int) -> dict[int, dict[int, dict]]:
        """From pieces {end: {start: mask}} over all arcs to the pieces that end at or after stop: {end: {start: (mask, starts before)}}."""
        at: dict[int, dict[int, tuple[int, tuple]]] = {e: {a: (m, ()) for a, m in xs.items()} for e, xs in begin.items()}
        for p in range(min(at, default=stop), stop):
            here = at.get(p)
            if not here:
                continue
            for b in range(p + 1, min(len(s), p + self.longest) + 1):
                y = s[p:b]
                if y not in self.ids and b > p + 1:
                    continue
                mask, came = 0, []
                for a, (m, _) in here.items():
                    if self.apart(s[a:p] if a < p else "", y):
                        mask |= m
                        came.append((a, m))
                if mask:
                    at.setdefault(b, {})[p] = (mask, tuple(came))
        return at

    def cuts_inside(self, s: str, lo: int, hi: int) -> tuple[int, int] | None:
        """First and last beginning of a word from lo to hi."""
        first = last = -1
        for m in re.finditer(f"(?<=[^{MARK}]){MARK}", s[max(0, lo - 1) : hi + 1]):
            p = m.start() + max(0, lo - 1)
            if lo <= p <= hi:
                first = p if first < 0 else first
                last = p
        return None if first < 0 else (first, last)

    def transfer(self, s: str, lo: int, hi: int, first: bool, final: bool):
        """Entry states, exit states (offsets from their cuts) and the max-plus matrix between them."""
        entries = [(lo, lo)] if first else self.states(s, lo)
        exits = None if not final else [(hi, hi)]
        begin: dict[int, dict[int, int]] = {}
        for k, (a, b) in enumerate(entries):
            begin.setdefault(b, {})[a] = 1 << k
        exits = exits or self.states(s, hi)
        weights = np.full((len(entries), len(exits)), -np.inf)

        def ends(at, x) -> int:
            return self._ending(at, hi) if final else at.get(x[1], {}).get(x[0], (0, ()))[0]

        # A word that begins at the cut itself belongs to the next chunk: the state is the piece that ends there.
        inside = self.cuts_inside(s, max(b for _, b in entries), hi if final else hi - 1)
        if inside:
            reached = self._ending(self.walk(s, begin, inside[0]), inside[0])
            after = self.walk(s, {inside[1]: {inside[1]: 1}}, hi)
            for j, x in enumerate(exits):
                if ends(after, x):
                    weights[[k for k in range(len(entries)) if reached >> k & 1], j] = 0
        else:
            at = self.walk(s, begin, hi)
            for j, x in enumerate(exits):
                mask = ends(at, x)
                weights[[k for k in range(len(entries)) if mask >> k & 1], j] = 0
        offsets = lambda xs, c: [(c - a, b - c) for a, b in xs]
        return offsets(entries, lo), offsets(exits, hi), weights

    @staticmethod
    def _ending(at, p: int) -> int:
        mask = 0
        for m, _ in at.get(p, {}).values():
            mask |= m
        return mask

    def traced(self, s: str, begin: tuple[int, int], end: tuple[int, int] | None, stop: int) -> list[int]:
        """Ids of the pieces after `begin` up to and with `end` (None: whatever ends at stop)."""
        at = self.walk(s, {begin[1]: {begin[0]: 1}}, stop)
        if end is None:
            found = at.get(stop, {})
            a, b = (next(iter(found)), stop) if found else begin
        else:
            a, b = end
        out: list[list[int]] = []
        while (a, b) != begin:
            out.append(self.piece_ids(s[a:b]))
            came = at[b][a][1]
            a, b = came[0][0], a
        return [i for ids in reversed(out) for i in ids]

    def backtrace(self, s: str, lo: int, hi: int, entry: tuple[int, int], exit_: tuple[int, int], final: bool) -> bytes:
        """Ids of the chunk between its fixed states."""
        begin = (lo - entry[0], lo + entry[1])
        end = None if final else (hi - exit_[0], hi + exit_[1])
        pack = lambda ids: np.array(ids, np.int32).tobytes()
        # The word that the exit state is part of must be walked whole.
        inside = self.cuts_inside(s, begin[1], hi if final else end[0])
        if not inside:
            return pack(self.traced(s, begin, end, hi))
        u, v = inside
        return pack(self.traced(s, begin, None, u)) + self.encode_marked(_UNIT.findall(s[u:v])) + pack(self.traced(s, (v, v), end, hi))


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of two matrices over (max, +)."""
    return (a[:, :, None] + b[None, :, :]).max(1, initial=-np.inf)


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """All prefix products, by pairs, then pairs of pairs: the order of a parallel scan."""
    if len(matrices) < 2:
        return list(matrices)
    halves = scan([max_plus(matrices[k], matrices[k + 1]) for k in range(0, len(matrices) - 1, 2)])
    out = [matrices[0]]
    for k in range(1, len(matrices)):
        out.append(halves[k // 2] if k % 2 else max_plus(halves[k // 2 - 1], matrices[k]))
    return out


def resolve(entries: list[list], exits: list[list], matrices: list[np.ndarray]) -> list[tuple[tuple, tuple]]:
    """(entry, exit) of each chunk on the path of weight 0 from start to end."""
    before = scan(matrices)
    after = [m.T for m in scan([m.T for m in reversed(matrices)])][::-1]
    out = []
    entry = entries[0][0]
    for k in range(len(matrices)):
        total = before[k][0] + (after[k + 1].max(1, initial=-np.inf) if k + 1 < len(matrices) else 0.0)
        best = int(np.argmax(total))
        if not np.isfinite(total[best]):
            raise ValueError("no path through the lattice")
        out.append((tuple(entry), tuple(exits[k][best])))
        entry = exits[k][best]
    return out


_CHUNKS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("copies", pa.int64()), ("k", pa.int32()), ("context", pa.string()), ("lo", pa.int32()), ("hi", pa.int32()), ("first", pa.bool_()), ("final", pa.bool_())])
CHUNKS = "doc_id long, text_key long, copies long, k int, context string, lo int, hi int, first boolean, final boolean"


def _chunked(size: int, margin: int):
    def run(batches):
        for b in batches:
            for doc, key, copies, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                s = MARK + text.replace(" ", MARK)
                last = (len(s) - 1) // size
                for k in range(last + 1):
                    lo, hi = k * size, min(len(s), (k + 1) * size)
                    a = max(0, lo - margin)
                    yield pa.RecordBatch.from_pylist(
                        [{"doc_id": doc, "text_key": key, "copies": copies, "k": k, "context": s[a : hi + margin], "lo": lo - a, "hi": hi - a, "first": k == 0, "final": k == last}], _CHUNKS
                    )

    return run


def _transfers(path: str):
    names = ("doc_id", "text_key", "k", "entries", "exits", "weights")
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("k", pa.int32()), *[(x, pa.list_(pa.int32())) for x in names[3:5]], ("weights", pa.list_(pa.float64()))])

    def run(batches):
        p = pieces(path)
        for b in batches:
            rows = []
            for r in b.to_pylist():
                entries, exits, weights = p.transfer(r["context"], r["lo"], r["hi"], r["first"], r["final"])
                rows.append({"doc_id": r["doc_id"], "text_key": r["text_key"], "k": r["k"], "entries": [x for s in entries for x in s], "exits": [x for s in exits for x in s], "weights": weights.ravel().tolist()})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _resolved(group: pd.DataFrame) -> pd.DataFrame:
    """Boundary states of one document from its matrices alone: some numbers for each chunk."""
    group = group.sort_values("k")
    states = lambda flat: [tuple(x) for x in np.asarray(flat).reshape(-1, 2).tolist()]
    entries, exits = [states(x) for x in group["entries"]], [states(x) for x in group["exits"]]
    matrices = [np.asarray(w).reshape(len(a), len(b)) for w, a, b in zip(group["weights"], entries, exits, strict=True)]
    path = resolve(entries, exits, matrices)
    return pd.DataFrame({"doc_id": group["doc_id"], "text_key": group["text_key"], "k": group["k"], "state": [[*a, *b] for a, b in path]})


def _backtraced(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("copies", pa.int64()), ("k", pa.int32()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        p = pieces(path)
        for b in batches:
            rows = []
            for r in b.to_pylist():
                s = r["state"]
                ids = p.backtrace(r["context"], r["lo"], r["hi"], tuple(s[:2]), tuple(s[2:]), r["final"])
                rows.append({"doc_id": r["doc_id"], "text_key": r["text_key"], "copies": r["copies"], "k": r["k"], "ids": np.frombuffer(ids, np.int32)})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


_ENCODED = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _whole(path: str):
    def run(batches):
        p = pieces(path)
        for b in batches:
            out = [p.encode(t) for t in b.column(2).to_pylist()]
            offsets = np.cumsum([0] + [len(x) // 4 for x in out]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(out), np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), ids], schema=_ENCODED)

    return run


def _decoded(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("decoded", pa.string())])

    def run(batches):
        p = pieces(path)
        for b in batches:
            lists = b.column(2)
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False).tolist(), lists.offsets.to_pylist()
            base = offsets[0]
            texts = [p.decode(flat[x - base : y - base]) for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], schema=schema)

    return run


def _split(docs: DataFrame, path: str, giant: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Of the rows of docs that have a text: (doc_id, text_key, text) of those that are no giants, and (doc_id, text_key, ids) of giants."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    long_ = F.length("text") > giant
    giants = rows.where(long_).groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    margin = 2 * pieces(path).longest
    spread = giants.select("doc_id", "text_key", "copies", "text").mapInArrow(_chunked(chunk, margin), CHUNKS).repartition(n, "doc_id", "text_key", "k")
    chunks = cut(spread, "chunks")
    transfers = chunks.mapInArrow(_transfers(path), "doc_id long, text_key long, k int, entries array<int>, exits array<int>, weights array<double>")
    states = transfers.groupBy("doc_id", "text_key").applyInPandas(_resolved, "doc_id long, text_key long, k int, state array<int>")
    s = states.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), F.col("k").alias("n"), "state")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")) & (F.col("k") == F.col("n"))
    traced = chunks.join(s, same).drop("d", "t", "n").mapInArrow(_backtraced(path), "doc_id long, text_key long, copies long, k int, ids array<int>")
    joined = traced.groupBy("doc_id", "text_key", "copies").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    whole_again = joined.select("doc_id", "text_key", F.flatten("parts.ids").alias("ids"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")
    return rows.where(~long_), whole_again


def encode(docs: DataFrame, path: str = MODEL, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text) and ids of every row of docs (doc_id, text) that has a text."""
    rows, giants = _split(docs, path, giant, chunk)
    return rows.mapInArrow(releasing(_whole(path)), "doc_id long, text_key long, ids array<int>").unionByName(giants)


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, text_key and decoded text of encoded rows."""
    small_batches(encoded.sparkSession)
    return encoded.select("doc_id", "text_key", "ids").mapInArrow(_decoded(path), "doc_id long, text_key long, decoded string")


def _checked(path: str):
    schema = pa.schema([*_ENCODED, ("round_trip", pa.bool_()), ("decoded_bytes", pa.int64())])

    def run(batches):
        p = pieces(path)
        for b in batches:
            lists = b.column(2)
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False).tolist(), lists.offsets.to_pylist()
            base = offsets[0]
            same, sizes = [], []
            for key, x, y in zip(b.column(1).to_pylist(), offsets[:-1], offsets[1:], strict=True):
                text = p.decode(flat[x - base : y - base])
                raw = text.encode()
                sizes.append(len(raw))
                same.append(spark_xxhash64(raw) == key)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists, pa.array(same, pa.bool_()), pa.array(sizes, pa.int64())], schema=schema)

    return run


def _whole_checked(path: str):
    """Encoded and checked in one Python worker: two in a row would each keep the words that they have met."""
    encoded, checked = _whole(path), _checked(path)

    def run(batches):
        return checked(encoded(batches))

    return run


def round_trips(docs: DataFrame, path: str = MODEL, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip: whether the ids decode to the text that they came from."""
    rows, giants = _split(docs, path, giant, chunk)
    columns = "doc_id long, text_key long, ids array<int>, round_trip boolean, decoded_bytes long"
    out = rows.mapInArrow(releasing(_whole_checked(path)), columns).unionByName(giants.mapInArrow(releasing(_checked(path)), columns))
    empty = docs.where(F.col("text").isNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("array<int>").alias("ids"), F.lit(False).alias("round_trip"), F.lit(0).cast("long").alias("decoded_bytes"))
    return out.drop("text_key").unionByName(empty).select("doc_id", F.coalesce(F.array_size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", "round_trip", "decoded_bytes")


def spark_xxhash64(data: bytes) -> int:
    """What SQL's xxhash64 gives for a string of these bytes."""
    import xxhash

    h = xxhash.xxh64_intdigest(data, 42)
    return h - (1 << 64) if h >> 63 else h


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the ids of every document that is left."""
    return round_trips(docs.select("doc_id", "text"))
