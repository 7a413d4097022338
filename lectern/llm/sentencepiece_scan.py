"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text is a lattice of pieces, and its ids are those of the best path. What a
step from one piece to the next costs depends on the model file's kind:

- unigram: the score of the next piece;
- BPE: nothing where the merges of both pieces' text give these two pieces,
  else minus infinity. A segmentation whose neighbours all pass this test is the
  one that the merges give for the whole text, so exactly one path is left.

Both give the ids of the model's own encoder. A literal word mark (U+2581) is
spelt by byte pieces instead, so that decoding gives back every text.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, quoted, without

#: Characters of a chunk; longer texts are split into such chunks.
CHUNK = 16_384
#: What an unknown character costs below the lowest score, as in the model's own encoder.
UNKNOWN = 10.0
#: Pairs of pieces that a worker remembers as tested (some 10 MB).
KNOWN = 40_000
MARK = "▁"


def spellings(model: bytes) -> list[bytes]:
    """The bytes that each id stands for; all that decoding needs."""
    import sentencepiece

    sp, table = sentencepiece.SentencePieceProcessor(model_proto=model), []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            table.append(bytes([int(piece[3:5], 16)]))
        else:
            table.append(b"" if sp.is_control(i) or sp.is_unknown(i) else piece.replace(MARK, " ").encode())
    return table


class Vocabulary:
    """Pieces as plain text (a space for the word mark) and the best path
    through the lattice of a text."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto.FromString(model)
        norm = spec.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not spec.trainer_spec.byte_fallback:
            raise ValueError("only models that leave texts as they are and fall back to bytes can be scanned")
        self.merges = spec.trainer_spec.model_type == spec.trainer_spec.BPE
        if not self.merges and spec.trainer_spec.model_type != spec.trainer_spec.UNIGRAM or any(p.type == p.USER_DEFINED for p in spec.pieces):
            raise ValueError("only unigram and BPE models without user-defined pieces can be scanned")
        norm.add_dummy_prefix = False  # texts get their first space here, chunks none
        self.native = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        self.pieces: dict[str, tuple[int, float]] = {}
        self.of_byte = [0] * 256
        for i, p in enumerate(spec.pieces):
            if p.type == p.BYTE:
                self.of_byte[int(p.piece[3:5], 16)] = i
            elif p.type == p.NORMAL:
                self.pieces[p.piece.replace(MARK, " ")] = (i, p.score)
        self.longest = max(map(len, self.pieces), default=1)
        self.lowest = min((s for _, s in self.pieces.values()), default=0.0) - UNKNOWN
        self.begun = {p[:n] for p in self.pieces for n in range(1, len(p))}
        # no piece goes on past the end of a word, nor over a line feed: the
        # lattice falls apart there
        self.apart = not any(" " in p.lstrip(" ") or "\n" in p for p in self.pieces)
        self.tested: dict[tuple[str, str], bool] = {}

    # -- whole texts, by the model's own encoder

    def run(self, text: str) -> list[int]:
        """Ids of a text that no piece enters or leaves."""
        if MARK not in text:
            return self.native.encode(text)
        ids: list[int] = []
        for k, part in enumerate(text.split(MARK)):
            ids += (self.spelt(MARK) if k else []) + (self.native.encode(part) if part else [])
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a text, begun by a space as the model does; none if empty."""
        return self.run(" " + text) if text else []

    # -- the lattice. A state is a place and the piece that ends there; "" stands
    #    for a place that no piece crosses, such as the beginning of a text.

    def spelt(self, piece: str) -> list[int]:
        """Ids of a piece, or of a character that has none."""
        return [self.pieces[piece][0]] if piece in self.pieces else [self.of_byte[b] for b in piece.encode("utf-8", "surrogatepass")]

    def arcs(self, text: str, at: int) -> list[str]:
        """The pieces at a place, shortest first; its character if that is none."""
        found = [text[at]]
        for n in range(1, min(self.longest, len(text) - at) + 1):
            s = text[at : at + n]
            if n > 1 and s in self.pieces:
                found.append(s)
            if s not in self.begun:
                break
        return found

    def follows(self, before: str, piece: str) -> bool:
        """Whether merging the text of both gives just these two pieces."""
        if not self.merges:
            return True
        key = (before, piece)
        if (ok := self.tested.get(key)) is None:
            if len(self.tested) >= KNOWN:
                self.tested.clear()
            if before in ("", MARK) or piece == MARK:
                ok = piece == MARK or self.native.encode(piece) == self.spelt(piece)
            else:
                ok = self.native.encode(before + piece) == self.spelt(before) + self.spelt(piece)
            self.tested[key] = ok
        return ok

    def cost(self, piece: str) -> float:
        return 0.0 if self.merges else self.pieces[piece][1] if piece in self.pieces else self.lowest

    def sweep(self, text: str, entries: dict[tuple[int, str], np.ndarray], stop: int) -> list[dict[str, np.ndarray]]:
        """Best scores of all states (per place, by last piece) that entries
        lead to, as vectors; pieces begin before stop."""
        at: list[dict[str, np.ndarray]] = [{} for _ in range(len(text) + 1)]
        for (place, piece), v in entries.items():
            at[place][piece] = v
        for i in range(stop):
            if not at[i]:
                continue
            every = None if self.merges else np.maximum.reduce(list(at[i].values()))
            for piece in self.arcs(text, i):
                if every is None:
                    fit = [v for before, v in at[i].items() if self.follows(before, piece)]
                    if fit:
                        at[i + len(piece)][piece] = fit[0] if len(fit) == 1 else np.maximum.reduce(fit)
                else:
                    at[i + len(piece)][piece] = every + self.cost(piece)
        return at

    def back(self, at: list[dict[str, np.ndarray]], entries: dict, place: int, piece: str) -> list[int]:
        """Ids of the best path from the entries to a state; of equal paths,
        that with the longest last piece, and so on."""
        out: list[str] = []
        while (place, piece) not in entries:
            out.append(piece)
            place -= len(piece)
            piece = max((b for b in at[place] if self.follows(b, piece)), key=lambda b: (at[place][b].max(), len(b)))
        return [i for p in reversed(out) for i in self.spelt(p)]

    # -- chunks: a part of a text from place a on, with up to `longest` characters
    #    of what comes before and after. Boundary states are the pieces over or
    #    up to a boundary, in an order that the text there gives.

    def boundary(self, part: str, cut: int) -> list[tuple[int, str]]:
        if cut == 0:
            return [(0, "")]
        over = ((s, p) for s in range(max(0, cut - self.longest), cut) for p in self.arcs(part, s))
        return [(s + len(p), p) for s, p in over if s + len(p) >= cut]

    def cuts(self, part: str, a: int, b: int) -> tuple[int, int]:
        """The first place from a + longest on, and the last before b, that no
        piece crosses; (0, 0) if there are none."""
        if not self.apart:
            return 0, 0
        apart = lambda p: part[p - 1] == "\n" or part[p] == "\n" or (part[p - 1] != " " and part[p] == " ")
        first = next(filter(apart, range(a + self.longest, b)), 0)
        return first, first and next(filter(apart, range(b - 1, first - 1, -1)))

    def transfer(self, part: str, a: int, size: int) -> np.ndarray:
        """The max-plus matrix of a chunk, from entry state to exit state, up to
        a constant, which moves no best path."""
        b = a + size
        entry, exit = self.boundary(part, a), self.boundary(part, b)
        own = dict(zip(entry, np.where(np.eye(len(entry)) > 0, 0.0, -np.inf), strict=True))
        lost = np.full(len(entry), -np.inf)
        first, last = self.cuts(part, a, b)
        if not first:
            at = self.sweep(part, own, b)
            return np.stack([at[place].get(p, lost) for place, p in exit], axis=1)
        # every path goes through first and last, and between them alike: an outer sum
        head = np.maximum.reduce([lost, *self.sweep(part[:first], own, first)[first].values()])
        at = self.sweep(part[last:], {(0, ""): np.zeros(1)}, b - last)
        return head[:, None] + np.array([at[place - last].get(p, lost[:1])[0] for place, p in exit])[None, :]

    def trace(self, part: str, a: int, size: int, entry: int, exit: int) -> list[int]:
        """Ids of the pieces that begin in a chunk, between two states."""
        b = a + size
        start, (place, piece) = {self.boundary(part, a)[entry]: np.zeros(1)}, self.boundary(part, b)[exit]
        first, last = self.cuts(part, a, b)
        if not first:
            return self.back(self.sweep(part, start, b), start, place, piece)
        at = self.sweep(part[:first], start, first)
        out = self.back(at, start, first, max(at[first], key=lambda p: (at[first][p].max(), len(p))))
        middle = {(0, ""): np.zeros(1)}
        return out + self.run(part[first:last]) + self.back(self.sweep(part[last:], middle, b - last), middle, place - last, piece)

    def parts(self, text: str, chunk: int) -> Iterator[tuple[str, int, int]]:
        """(part, a, size) of each chunk of a text that has its first space."""
        for k in range(0, len(text), chunk):
            a = min(k, self.longest)
            yield text[k - a : k + chunk + self.longest], a, min(chunk, len(text) - k)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product (associative)."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def states(matrices: list[np.ndarray]) -> list[int]:
    """Boundary states 0, s1, ..., of the best path through all chunks.

    Prefix products in blocks: each block is multiplied by itself, blocks are
    combined, and prefixes within a block start from its product so far."""
    block = max(1, int(len(matrices) ** 0.5))
    starts, whole = [], np.zeros((1, 1))
    for k in range(0, len(matrices), block):
        starts.append(whole)
        part = matrices[k]
        for m in matrices[k + 1 : k + block]:
            part = times(part, m)
        whole = times(whole, part)
    reached = []
    for k in range(len(matrices)):
        reached.append(starts[k // block] if k % block == 0 else times(reached[-1], matrices[k - 1]))
    path = [int(whole[0].argmax())]
    for v, m in zip(reversed(reached), reversed(matrices), strict=True):
        path.append(int((v[0] + m[:, path[-1]]).argmax()))
    return path[::-1]


@lru_cache(1)
def _vocabulary(model: bytes) -> Vocabulary:
    return Vocabulary(model)


def _proto(model: str | bytes) -> bytes:
    return model if isinstance(model, bytes) else Path(model).read_bytes()


def _lists(rows: list[list[int]]) -> pa.Array:
    flat, ends = array("i"), [0]
    for r in rows:
        flat.extend(r)
        ends.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if len(flat) else [], pa.int32()))


def _slices(batches: Iterator[pa.RecordBatch], budget: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of batches that hold about budget bytes each."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * budget / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encode(docs: DataFrame, model: str | bytes, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """id_col, ids (array of int) and n_chars for every row.

    model: a .model file's path on the driver, or its bytes; it goes to the
    executors with the code (0.5 MB). Texts of less than chunk characters are
    encoded in one pass without a shuffle. Longer ones become chunk rows; each
    chunk yields a matrix from entry to exit states; a document's matrices are
    combined to boundary states; and each chunk is traced back by itself between
    its two states.

    Defined results: a null text counts as empty and has no ids; repeated rows
    are returned each; null ids pass through; other columns are ignored; an
    empty table gives an empty table; texts of any length are encoded whole; a
    literal word mark (U+2581) in a text is spelt by byte pieces, so decoding
    gives back every text exactly. With a unigram model, where two paths over a
    chunk's boundary score the same, either may be returned.
    """
    proto = _proto(model)
    rows = docs.select(quoted(id_col).alias("id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    def plain(batches):
        vocabulary = _vocabulary(proto)
        for batch in _slices(batches):
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([vocabulary.encode(t) for t in texts]), pa.array(map(len, texts), pa.int64())], names=["id", "ids", "n_chars"])

    def split(batches):
        vocabulary = _vocabulary(proto)
        for batch in batches:
            for r in range(batch.num_rows):
                text = " " + batch.column(1)[r].as_py()
                for k, (part, a, size) in enumerate(vocabulary.parts(text, max(chunk, 2 * vocabulary.longest + 2))):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(2).slice(r, 1), batch.column(0).slice(r, 1), pa.array([k]), pa.array([a]), pa.array([size]), pa.array([len(text) - 1]), pa.array([part], pa.string())],
                        names=["row", "id", "k", "a", "size", "n_chars", "part"],
                    )

    def matrices(batches):
        vocabulary = _vocabulary(proto)
        for batch in _slices(batches):
            made = [vocabulary.transfer(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("part", "a", "size")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), pa.array([len(m) for m in made]), pa.array([m.tobytes() for m in made], pa.binary())], names=["row", "k", "n", "m"])

    def resolve(batches):
        for batch in batches:
            for row, chunks in zip(batch.column(0), batch.column(1), strict=True):
                c = chunks.as_py()
                path = states([np.frombuffer(x["m"]).reshape(x["n"], -1) for x in c])
                yield pa.RecordBatch.from_arrays([pa.array([row.as_py()] * len(c)), pa.array([x["k"] for x in c]), pa.array(path[:-1]), pa.array(path[1:])], names=["row", "k", "entry", "exit"])

    def traced(batches):
        vocabulary = _vocabulary(proto)
        for batch in _slices(batches):
            ids = [vocabulary.trace(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("part", "a", "size", "entry", "exit")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("k"), batch.column("n_chars"), _lists(ids)], names=["row", "id", "k", "n_chars", "ids"])

    short = rows.where(F.char_length("text") < chunk).mapInArrow(plain, f"id {kind}, ids array<int>, n_chars bigint")
    giants = rows.where(F.char_length("text") >= chunk).withColumn("row", F.monotonically_increasing_id())
    parts = checkpointed(giants.mapInArrow(split, f"row bigint, id {kind}, k bigint, a bigint, size bigint, n_chars bigint, part string").repartition("row", "k"))
    found = parts.select("row", "k", "a", "size", "part").mapInArrow(matrices, "row bigint, k bigint, n bigint, m binary")
    # a document's matrices are some 300 bytes a chunk: one row holds them
    found = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("k", "n", "m"))).alias("chunks"))
    path = found.mapInArrow(resolve, "row bigint, k bigint, entry bigint, exit bigint")
    pieces = parts.join(path, ["row", "k"]).mapInArrow(traced, f"row bigint, id {kind}, k bigint, n_chars bigint, ids array<int>")
    whole = pieces.groupBy("row").agg(F.first("id").alias("id"), F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("p"), F.first("n_chars").alias("n_chars"))
    long = whole.select("id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), "n_chars")
    return short.unionByName(long).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: str | bytes, ids_col: str = "ids") -> DataFrame:
    """encoded plus decoded: the text that the ids stand for, less the space that
    encoding puts first. Built-in expressions only: each id's bytes come from one
    literal table, in hex, as a byte piece alone is no text.

    Defined results: null ids give a null text, no ids an empty one; null
    entries and numbers that are no id stand for nothing; other columns pass
    through, one named decoded is replaced; an empty table gives an empty table.
    """
    table = F.split(F.lit(",".join(x.hex() for x in spellings(_proto(model)))), ",")  # folded to one array
    raw = F.unhex(F.array_join(F.transform(quoted(ids_col), lambda i: F.get(table, i)), "")).cast("string")
    text = F.substring(raw, F.lit(2), F.octet_length(raw))
    return encoded.select(*[quoted(c) for c in without(encoded, "decoded").columns], text.alias("decoded"))
