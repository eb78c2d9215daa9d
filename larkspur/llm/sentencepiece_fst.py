"""SentencePiece encoding and decoding as a weighted finite-state transducer.

``Transducer`` compiles three machines from a model file: the normaliser (dummy
prefix and white-space escape over an identity character map), the piece machine
(a trie whose arcs read characters and write piece ids) and the byte fallback (for
characters outside the vocabulary).  Encoding composes them with the input lazily
and takes the path of least weight in the tropical semiring.

* Unigram models weigh a piece with its negative log probability.
* BPE models have no additive piece weights.  Their piece machine has one state a
  piece, and an arc from piece ``a`` to piece ``b`` only if merging the text of
  ``ab`` by rank gives back ``a, b``; each allowed arc weighs 1.  A sequence whose
  neighbours all fit is the result of the merges, so the only finite path is the
  library's own encoding.

No piece holds certain character pairs (a letter before a mark, a mark before a
white-space sign).  Every path passes a state between such characters, so the
input is cut there and the best sub-paths are remembered.

Defined results: null and empty texts have no ids; a text that is not valid
Unicode is read with replacement characters; U+2581 in a text decodes as a space;
repeated rows are each encoded; other columns are passed through, and ones named
like an output are replaced.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from larkspur.llm import scratch
from larkspur.llm.words import binary_texts

SPACE = "▁"
#: Sub-paths, words and piece pairs remembered by one worker.
MEMO_ENTRIES = 250_000
WORD_ENTRIES = 250_000
PAIR_ENTRIES = 300_000
#: Longer words and parts are not remembered, so memory is bounded in bytes too.
MEMO_LENGTH = 64
#: Stands for the arc of a character outside the vocabulary, and its weight.
_OUTSIDE = -2
OUTSIDE_WEIGHT = 100.0


def _cutter(pieces: Iterable[str]) -> re.Pattern:
    """Runs of letters or of other signs, each with the white space before it.

    Falls back to the whole input if some piece reaches over such a boundary.
    """
    signs = "".join(sorted({c for x in pieces for c in x if c.isalnum() and not c.isalpha() and not c.isdecimal()}))
    letter = rf"[^\W\d_{re.escape(signs)}]"
    cut = re.compile(rf"{SPACE}*{letter}+|\n|{SPACE}*(?:[^\w{SPACE}\n]|[\d_{re.escape(signs)}])+|{SPACE}+")
    return cut if all(map(cut.fullmatch, pieces)) else re.compile(r"(?s).+")


class Transducer:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as source:
            model.ParseFromString(source.read())
        rules = model.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("only identity normalisers that keep white space are compiled")
        self.prefix = SPACE if rules.add_dummy_prefix else ""
        self.bpe = model.trainer_spec.model_type == 2
        kinds = model.SentencePiece
        self.text: list[str] = []
        self.score: list[float] = []
        self.bytes_of: list[bytes] = []
        self.byte_id = [0] * 256
        self.unknown = 0
        normal: dict[str, int] = {}
        for k, piece in enumerate(model.pieces):
            self.text.append(piece.piece)
            self.score.append(piece.score)
            content = b""
            if piece.type == kinds.BYTE:
                value = int(piece.piece[3:5], 16)
                self.byte_id[value] = k
                content = bytes([value])
            elif piece.type in (kinds.NORMAL, kinds.USER_DEFINED):
                normal[piece.piece] = k
                content = piece.piece.encode()
            elif piece.type == kinds.UNKNOWN:
                self.unknown = k
                content = " ⁇ ".encode()
            self.bytes_of.append(content)
        self.fallback = model.trainer_spec.byte_fallback
        self.normal = normal
        self.single = frozenset(x for x in normal if len(x) == 1)
        self.trees: dict[int, list] = {}
        if self.bpe:
            self.reachable = {k for x, k in normal.items() if self._tree(x, k)}
        else:
            self.reachable = set(normal.values())
        self.trie = self._compile()
        self.cut = _cutter(normal)
        #: Whether words can be looked up one by one: cuts are safe before white
        #: space and around line breaks, and a prefix stands before the first.
        self.simple = bool(self.prefix) and self.cut.fullmatch(f"a{SPACE}a") is None
        self.memo: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    # -- compiling -----------------------------------------------------------

    def _compile(self) -> dict:
        """Trie: each node maps a character to (piece or -1, child node)."""
        root: dict = {}
        for piece, k in self.normal.items():
            if k not in self.reachable:
                continue
            node = root
            for c in piece[:-1]:
                node = node.setdefault(c, (-1, {}))[1]
            node[piece[-1]] = (k, node.get(piece[-1], (-1, {}))[1])
        return root

    def _tree(self, piece: str, k: int) -> bool:
        """Merge tree of a piece: along its right and left edges, (id, effective rank)."""
        nodes: list[tuple] = [(self.normal.get(c, -1), float("inf"), None, None, c) for c in piece]
        while len(nodes) > 1:
            best, at = None, -1
            for i in range(len(nodes) - 1):
                found = self.normal.get(nodes[i][4] + nodes[i + 1][4])
                if found is not None and (best is None or self.score[found] > self.score[best]):
                    best, at = found, i
            if best is None:
                return False
            a, b = nodes[at], nodes[at + 1]
            nodes[at : at + 2] = [(best, min(self.score[best], a[1], b[1]), a, b, a[4] + b[4])]
        if nodes[0][0] != k:
            return False
        edges = []
        for side in (3, 2):
            edge, node = [], nodes[0]
            while node is not None:
                edge.append((node[4], node[1]))
                node = node[side]
            edges.append(edge[::-1])
        self.trees[k] = edges
        return True

    def _fits(self, a: int, b: int) -> bool:
        """Whether merging the text of pieces a and b gives back exactly a, b."""
        right, left = self.trees[a][0], self.trees[b][1]
        i = j = 0
        none = float("-inf")
        while True:
            up_a = right[i + 1][1] if i + 1 < len(right) else none
            up_b = left[j + 1][1] if j + 1 < len(left) else none
            across = self.normal.get(right[i][0] + left[j][0])
            if across is not None:
                rank = self.score[across]
                if rank > up_a and rank >= up_b:
                    return False
            if up_a == none and up_b == none:
                return True
            if up_a >= up_b:
                i += 1
            else:
                j += 1

    # -- shortest paths ------------------------------------------------------

    def _outside(self, c: str) -> list[int]:
        """Arc of the byte fallback: the ids of a character outside the vocabulary."""
        return [self.byte_id[x] for x in c.encode("utf-8", "replace")] if self.fallback else [self.unknown]

    def _arcs(self, symbols: str, at: int) -> list[tuple[int, int]]:
        """(end, piece) of the arcs that leave a position, longest last."""
        if symbols[at] not in self.single:
            return [(at + 1, _OUTSIDE)]
        node, found = self.trie, []
        for end in range(at, len(symbols)):
            step = node.get(symbols[end])
            if step is None:
                break
            piece, node = step
            if piece >= 0:
                found.append((end + 1, piece))
        return found

    def _only_path(self, symbols: str) -> list[tuple[int, int]]:
        """(start, piece) of the only finite path of a BPE model.

        An allowed path to a position is the encoding of that prefix, so each
        position has one state and is left for good once its arcs have failed.
        Longer pieces, the lighter paths, are followed first.
        """
        n, at, left, pairs = len(symbols), 0, -1, self.pairs
        dead: set[int] = set()
        path: list[tuple[int, int, list]] = []
        taken: list[tuple[int, int]] = []
        options = self._arcs(symbols, 0)
        while at < n:
            ahead = -1
            while options:
                ahead, piece = options.pop()
                if ahead not in dead:
                    if left < 0 or piece < 0:
                        break
                    key = left << 20 | piece
                    fits = pairs.get(key)
                    if fits is None:
                        if len(pairs) > PAIR_ENTRIES:
                            pairs.clear()
                        fits = pairs[key] = self._fits(left, piece)
                    if fits:
                        break
                ahead = -1
            if ahead < 0:
                dead.add(at)
                if not path:
                    raise ValueError("no path; the model's pieces do not cover their own characters")
                at, left, options = path.pop()
                taken.pop()
                continue
            path.append((at, left, options))
            taken.append((at, piece))
            at, left = ahead, piece
            if at < n:
                options = self._arcs(symbols, at)
        return taken

    def _best_path(self, symbols: str) -> list[tuple[int, int]]:
        """(start, piece) of the path of least weight of a unigram model."""
        n = len(symbols)
        best: list[tuple[float, int, int]] = [(0.0, 0, 0)] + [(float("inf"), 0, 0)] * n
        for at in range(n):
            for end, piece in self._arcs(symbols, at):
                total = best[at][0] + (OUTSIDE_WEIGHT if piece == _OUTSIDE else -self.score[piece])
                if total < best[end][0]:
                    best[end] = (total, at, piece)
        taken, at = [], n
        while at:
            _, start, piece = best[at]
            taken.append((start, piece))
            at = start
        return taken[::-1]

    def shortest(self, symbols: str) -> bytes:
        """Ids on the path of least weight through the composed machine."""
        ids: list[int] = []
        for at, piece in self._only_path(symbols) if self.bpe else self._best_path(symbols):
            if piece == _OUTSIDE:
                ids += self._outside(symbols[at])
            else:
                ids.append(piece)
        return array("i", ids).tobytes()

    def _joined(self, symbols: str) -> bytes:
        """Best sub-paths between the cuts, remembered."""
        parts, memo = self.cut.findall(symbols), self.memo
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        long = {part: self.shortest(part) for part in parts if len(part) > MEMO_LENGTH}
        for part in parts:
            if part not in memo and part not in long:
                memo[part] = self.shortest(part)
        return b"".join(long[p] if p in long else memo[p] for p in parts) if long else b"".join(map(memo.__getitem__, parts))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        if not text:
            return b""
        marked = text.replace("\n", " \n")
        if self.simple is False or "  " in marked or marked[0] == " " or marked[-1] == " ":
            return self._joined(self.prefix + text.replace(" ", SPACE))
        # Words after one space each, or after a line break.
        words, known = marked.split(" "), self.words
        if len(known) > WORD_ENTRIES:
            known.clear()
        long: dict[str, bytes] = {}
        for word in set(words).difference(known):
            of = known if len(word) <= MEMO_LENGTH else long
            of[word] = self._joined(word if word[0] == "\n" else SPACE + word)
        return b"".join(long[w] if w in long else known[w] for w in words) if long else b"".join(map(known.__getitem__, words))

    def decode(self, ids: np.ndarray) -> str:
        """The inverse machine: ids to pieces and bytes, then to text."""
        text = b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


_machines: dict[str, Transducer] = {}


def machine(path: str) -> Transducer:
    if path not in _machines:
        _machines[path] = Transducer(path)
    return _machines[path]


def _encode(batches: Iterator[pa.RecordBatch], text: str, model: str, out: str, decoded: str | None) -> Iterator[pa.RecordBatch]:
    fst = machine(model)
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            texts = [x.decode("utf-8", "replace") if x else "" for x in binary_texts(part.column(part.schema.get_field_index(text)))]
            packed = [fst.encode(x) for x in texts]
            ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in packed]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            keep = [i for i, name in enumerate(part.schema.names) if name not in (out, decoded)]
            columns, names = [part.column(i) for i in keep] + [ids], [part.schema.names[i] for i in keep] + [out]
            if decoded:
                columns.append(pa.array([fst.decode(np.frombuffer(x, "<i4")) for x in packed], pa.string()))
                names.append(decoded)
            yield pa.RecordBatch.from_arrays(columns, names)


def encode(docs: DataFrame, model: str, *, text: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the piece ids of every whole text, and their decoding if named."""
    scratch.bounded_batches(docs.sparkSession)
    fields = [f for f in docs.schema.fields if f.name not in (out, decoded)]
    fields.append(T.StructField(out, T.ArrayType(T.IntegerType())))
    if decoded:
        fields.append(T.StructField(decoded, T.StringType()))

    def task(batches):
        return _encode(batches, text, model, out, decoded)

    return docs.mapInArrow(task, T.StructType(fields))


def decode(rows: DataFrame, model: str, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text that their ids spell; null ids spell the empty text."""
    scratch.bounded_batches(rows.sparkSession)
    fields = [f for f in rows.schema.fields if f.name != out] + [T.StructField(out, T.StringType())]

    def task(batches):
        fst = machine(model)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            texts = pa.array([fst.decode(np.asarray(x or [], np.int64)) for x in lists], pa.string())
            keep = [i for i, name in enumerate(batch.schema.names) if name != out]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), texts], [*(batch.schema.names[i] for i in keep), out])

    return rows.mapInArrow(task, T.StructType(fields))
