"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Compiled once from a model file: the normaliser (dummy prefix, blanks written as
U+2581), a trie transducer whose arcs read the characters of a piece and write its
number, and byte fallback arcs for characters that no piece covers. A text is composed
with it by walking the trie from every reachable position; the encoding is the shortest
path in the tropical semiring.

* Unigram models: an arc weighs minus the piece's score; the shortest path is the encoding.
* BPE models: merging is not a sum of scores. It is a regular constraint, though: a sequence
  of pieces is the BPE encoding of its text if and only if each two neighbours encode to
  themselves. So arcs weigh nothing and a second transducer over neighbouring pieces weighs 0
  or infinity; exactly one path stays finite. Its arcs are worked out when first met.

No piece runs from another character into a blank, so a text's path is the concatenation of
the paths of its chunks (blanks, then other characters; line ends alone), and each worker keeps
the paths of the chunks in use. Decoding is the inverse transducer: pieces to bytes, bytes to text, dummy
blank off. Null and empty texts have no pieces. Texts of any length are read whole. U+2581 in
a text reads as a blank, as the library has it. An empty table gives no rows. Repeated rows and ids are encoded one by one;
columns other than id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import Memo, binary_texts, lean, worker_store

BLANK = "▁"
LONG = 48  # chunks over so many characters are not kept
KEPT_CHUNKS = 300_000
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the model format
UNIGRAM, BPE = 1, 2  # model types of the model format


@dataclass
class Spec:
    """What is read from a model file: plain values that travel with the tasks."""

    pieces: list[tuple[str, float, int]]
    kind: int
    dummy_prefix: bool
    unknown: int
    key: int

    @classmethod
    def load(cls, path: str) -> Spec:
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            raw = f.read()
        m = pb.ModelProto()
        m.ParseFromString(raw)
        n = m.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces:
            raise ValueError("only models with the identity normaliser, which keeps white space, are compiled")
        if m.trainer_spec.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are compiled")
        pieces = [(p.piece, p.score, p.type) for p in m.pieces]
        if any(t in (NORMAL, UNUSED) and re.search(f"[^{BLANK}]{BLANK}", p) for p, _, t in pieces):
            raise ValueError("a piece runs into a blank: texts cannot be cut there")
        if any(t == USER_DEFINED for _, _, t in pieces):
            raise ValueError("user-defined pieces are not compiled")
        return cls(pieces, m.trainer_spec.model_type, n.add_dummy_prefix, m.trainer_spec.unk_id, zlib.crc32(raw))


class Transducer:
    def __init__(self, spec: Spec):
        self.bpe, self.dummy = spec.kind == BPE, spec.dummy_prefix
        self.number = {p: k for k, (p, _, t) in enumerate(spec.pieces) if t in (NORMAL, UNUSED)}
        self.scores = [s for _, s, _ in spec.pieces]
        self.bytes_of = {int(p[3:5], 16): k for k, (p, _, t) in enumerate(spec.pieces) if t == BYTE}
        self.unknown = spec.unknown
        self.penalty = -min((s for _, s, t in spec.pieces if t == NORMAL), default=0.0) + 10.0
        by_score = {x: r for r, x in enumerate(sorted({s for _, s, _ in spec.pieces}, reverse=True))}
        self.rank = {p: by_score[self.scores[k]] for p, k in self.number.items()}  # equal scores, equal ranks
        self.trie: list = [{}, -1]  # state: arcs by character, number of the piece written here or -1
        for p, k in self.number.items():
            node = self.trie
            for c in p:
                node = node[0].setdefault(c, [{}, -1])
            node[1] = k
        self.text_of = [p for p, _, _ in spec.pieces]
        self.out = [b"" if t in (CONTROL, UNKNOWN) else bytes([int(p[3:5], 16)]) if t == BYTE
                    else p.replace(BLANK, " ").encode() for p, _, t in spec.pieces]
        self.neighbours: dict[int, bool] = {}
        self._path = self._bpe_path if self.bpe else self._lightest_path
        self.paths = Memo(self._path, KEPT_CHUNKS)
        used = set("".join(self.number))
        alone = "".join(c for c in "\n\t\r" if c not in used)  # characters of no piece cut a text, too
        self.chunks = re.compile((f"[{alone}]|" if alone else "") + f"{BLANK}*[^{BLANK}{alone}]+|{BLANK}+").findall

    def merged(self, text: str) -> list[str]:
        """The merge order itself, for two pieces at a time: best-scored neighbours first, leftmost of equals."""
        s, rank, none = list(text), self.rank.get, 1 << 60
        due = [rank(x + y, none) for x, y in zip(s, s[1:], strict=False)]
        while due:
            best = min(due)
            if best == none:
                break
            k = due.index(best)
            s[k:k + 2] = [s[k] + s[k + 1]]
            del due[k]
            if k < len(due):
                due[k] = rank(s[k] + s[k + 1], none)
            if k:
                due[k - 1] = rank(s[k - 1] + s[k], none)
        return s

    def stands(self, left: str, right: str) -> bool:
        """Whether two neighbours encode to themselves (``left`` empty: the piece alone): weight 0, else infinite."""
        return self.merged(left + right) == ([left, right] if left else [right])

    def _bpe_path(self, chunk: str) -> bytes:
        """The one finite path of a chunk, as int32 piece numbers.

        A prefix of the encoding is the encoding of the prefix, so every position
        is reached by one last piece; the first arc that stands is the only one.
        Pieces are numbers; a character of no piece counts from 1 << 20 up.
        """
        n, root, known = len(chunk), self.trie, self.neighbours
        last, back = [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            before = last[i] + 1
            if i and not before:
                continue
            node = root
            for j in range(i, n):
                node = node[0].get(chunk[j])
                if node is None:
                    break
                k = node[1]
                if k >= 0 and last[j + 1] < 0:
                    ok = known.get(before << 32 | k)
                    if ok is None:
                        ok = self._learn(before, k)
                    if ok:
                        last[j + 1], back[j + 1] = k, i
            if last[i + 1] < 0 and chunk[i] not in self.number:
                k = (1 << 20) + ord(chunk[i])
                ok = known.get(before << 32 | k)
                if ok is None:
                    ok = self._learn(before, k)
                if ok:
                    last[i + 1], back[i + 1] = k, i
        out, j = [], n
        while j:
            k = last[j]
            out += [k] if k < 1 << 20 else reversed(self._fallback(chr(k - (1 << 20))))
            j = back[j]
        return np.array(out[::-1], "<i4").tobytes()

    def _learn(self, before: int, k: int) -> bool:
        text = lambda x: self.text_of[x] if x < 1 << 20 else chr(x - (1 << 20))
        if len(self.neighbours) > 1_500_000:
            self.neighbours.clear()
        ok = self.neighbours[before << 32 | k] = self.stands(text(before - 1) if before else "", text(k))
        return ok

    def _fallback(self, char: str) -> list[int]:
        return [self.bytes_of.get(b, self.unknown) for b in char.encode()] if self.bytes_of else [self.unknown]

    def _lightest_path(self, chunk: str) -> bytes:
        """Shortest path through the composition of one chunk with the transducer, as int32 piece numbers."""
        n, inf = len(chunk), float("inf")
        cost, back, by = [0.0] + [inf] * n, [0] * (n + 1), [-1] * (n + 1)
        for i in range(n):
            here, node, single = cost[i], self.trie, False
            for j in range(i, n):
                node = node[0].get(chunk[j])
                if node is None:
                    break
                if node[1] >= 0:
                    single = single or j == i
                    weight = here - self.scores[node[1]]
                    if weight < cost[j + 1]:
                        cost[j + 1], back[j + 1], by[j + 1] = weight, i, node[1]
            if not single and here + self.penalty < cost[i + 1]:
                cost[i + 1], back[i + 1], by[i + 1] = here + self.penalty, i, -1
        out, j = [], n
        while j:
            out += [by[j]] if by[j] >= 0 else reversed(self._fallback(chunk[back[j]:j]))
            j = back[j]
        return np.array(out[::-1], "<i4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, "<i4")
        text = text.replace(" ", BLANK)
        if self.dummy:
            text = BLANK + text
        paths = self.paths
        return np.frombuffer(b"".join([paths[c] if len(c) <= LONG else self._path(c) for c in self.chunks(text)]), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.out.__getitem__, ids.tolist()))
        if self.dummy and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def transducer(spec: Spec) -> Transducer:
    store = worker_store("sentencepiece")
    if spec.key not in store:
        store[spec.key] = Transducer(spec)
    return store[spec.key]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
           extra: tuple | list = ()) -> DataFrame:
    """(id, ids, *extra): the piece numbers of every whole text. No shuffle."""
    spec = Spec.load(model_path)
    src = binary_texts(docs, id_col, text_col, extra)
    kinds = [(f.name, f.dataType.simpleString()) for f in src.schema if f.name != "text"]
    kinds.insert(1, ("ids", "array<int>"))

    def run(batches):
        import pyarrow as pa

        t = transducer(spec)
        for b in batches:
            for at in range(0, b.num_rows, 256):  # a slice at a time: pieces weigh more than the text
                part = b.slice(at, 256)
                ids = [t.encode(x.as_py().decode("utf-8", "replace")) for x in part.column(1)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, *part.columns[2:]], [k for k, _ in kinds])

    return src.mapInArrow(lean(run, "sentencepiece"), ", ".join(f"`{k}` {t}" for k, t in kinds))


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(id, text) of ``encoded(id, ids)``; null ids give null."""
    spec = Spec.load(model_path)
    id_type = encoded.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        t = transducer(spec)
        for b in batches:
            texts = [t.decode(x.values.to_numpy()) if x.is_valid else None for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return encoded.select("id", "ids").mapInArrow(run, f"id {id_type}, text string")


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pieces, n_bytes, ids_crc32, round_trip): whole texts encoded, then decoded and compared with the text.

    ids_crc32: of the ids as little-endian unsigned 32-bit integers. round_trip: the decoded
    text equals the text with U+2581 as a blank. One pass; ids do not leave the task.
    """
    spec = Spec.load(model_path)
    src = binary_texts(docs, id_col, text_col)
    id_type = src.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        t = transducer(spec)
        byte_ids = np.array(sorted(t.bytes_of.values()) or [-1])
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [])
            for x in b.column(1):
                text = x.as_py().decode("utf-8", "replace")
                ids = t.encode(text)
                fallback = int(np.isin(ids, byte_ids).sum())
                for c, v in zip(cols, (len(ids), fallback, zlib.crc32(ids.tobytes()),
                                       t.decode(ids) == text.replace(BLANK, " ")), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True))],
                ["id", "n_pieces", "n_bytes", "ids_crc32", "round_trip"])

    return src.mapInArrow(run, f"id {id_type}, n_pieces long, n_bytes long, ids_crc32 long, round_trip boolean")
