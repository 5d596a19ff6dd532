"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a single-pass Viterbi.

The model file gives pieces and scores. The automaton holds all ordinary pieces; at each character its output
links name every piece that ends there, longest first, and each relaxes the best score at that position. The
best segmentation has the greatest sum of scores; of equal ones the longer last piece stays. A character that
is no piece costs UNKNOWN below the least score and is written as byte pieces, so decoding gives the text back.

Scores of a BPE model are merge ranks, whose best sum is not the model's encoding. With `own_rule` a BPE model's
pieces are relaxed under one more condition: a piece is admissible if it and the last piece at its start stay two
pieces when merged by rank; any other scores minus infinity. Merging is local to neighbours, so one admissible piece
at most ends at each position and the path gives the model's ids. Verdicts on pairs of pieces are kept, PAIRS at most.

White space: a text that is not empty gets one space in front, spaces become U+2581 (a U+2581 of the text is
written as bytes). If no piece has a space after another character, words are independent, and so is a
character that no piece contains; only distinct words are put through the automaton then.

Defined results: a null or empty text has no ids and decodes to the empty text; rows with equal or null doc_ids
stay apart; an empty table gives no rows; other columns are not read. Ids that are no pieces raise an error;
ids whose bytes are not UTF-8 decode with U+FFFD.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyhive.llm.bpe import PieceEncoder
from skyhive.llm.common import flushes, id_and_text, prepare, spans, table

SPACE = "▁"
UNKNOWN = 10.0
PAIRS = 400_000


class Model(PieceEncoder):
    def __init__(self, path: str, limit: int = 450_000, own_rule: bool = False):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.by_rank = own_rule and is_bpe(model)
        self.size = model.get_piece_size()
        self.automaton = ahocorasick.Automaton()
        self.pieces, self.bytes_id, self.out, self.pairs = {}, {}, [], {}
        self.names = [model.id_to_piece(i) for i in range(self.size)]
        for i in range(self.size):
            name = self.names[i]
            if model.is_byte(i):
                self.bytes_id[int(name[3:5], 16)] = i
                self.out.append(bytes([int(name[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.out.append(b"")
            else:
                self.pieces[name] = (model.get_score(i), i)
                self.out.append(name.replace(SPACE, " ").encode())
        for name, (score, i) in self.pieces.items():
            self.automaton.add_word(name, (len(name), score, i))
        self.automaton.make_automaton()
        self.unknown = min(s for s, _ in self.pieces.values()) - UNKNOWN
        self.apart = not any(SPACE in name.lstrip(SPACE) for name in self.pieces)
        inside = {c for name in self.pieces for c in name}
        self.alone = np.array([b < 128 and chr(b) not in inside and b != 32 for b in range(256)])
        lengths = np.array([len(b) for b in self.out], np.int64)
        self.out_start, self.out_length = np.cumsum(lengths) - lengths, lengths
        self.out_pool = np.frombuffer(b"".join(self.out), np.uint8)
        super().__init__(limit)

    def starts(self, data: np.ndarray) -> np.ndarray:
        """A word starts at a space after something else; a byte in no piece stands alone."""
        starts = np.zeros(len(data), bool)
        if self.apart:
            space, alone = data == 32, self.alone[data]
            starts[1:] = (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
        return starts

    def viterbi(self, text: str) -> list[int]:
        """Ids of a text whose spaces are U+2581 already."""
        n = len(text)
        best, back = [0.0] + [-np.inf] * n, [None] * (n + 1)
        by_rank, pairs = self.by_rank, self.pairs
        done = 0  # positions up to here have their final score

        def unknown(upto: int) -> None:
            nonlocal done
            for p in range(done, upto):  # single characters without a piece of their own
                if text[p] not in self.pieces and best[p] + self.unknown > best[p + 1] and (not by_rank or self.stay(text, p, back[p], text[p])):
                    best[p + 1], back[p + 1] = best[p] + self.unknown, (p, -1)
            done = max(done, upto)

        for end, (size, score, i) in self.automaton.iter(text):
            if end > done:
                unknown(end)
            start = end + 1 - size
            if best[start] + score <= best[end + 1] or by_rank and back[end + 1] is not None:  # one admissible piece at most
                continue
            if by_rank:
                last = back[start]
                if last is None or last[1] < 0:
                    stay = self.stay(text, start, last, self.names[i])
                elif (stay := pairs.get(key := last[1] * self.size + i)) is None:
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    stay = pairs[key] = self.stay(text, start, last, self.names[i])
                if not stay:
                    continue
            best[end + 1], back[end + 1] = best[start] + score, (start, i)
        unknown(n)
        ids, at = [], n
        while at:
            start, i = back[at]
            ids += [i] if i >= 0 else [self.bytes_id[b] for b in reversed(text[start:at].encode())]
            at = start
        return ids[::-1]

    def stay(self, text: str, start: int, last: tuple[int, int] | None, name: str) -> bool:
        """Whether a piece stays as it is beside the last piece before it (None: at the start of the text)."""
        before = text[last[0]:start] if last else ""
        if before and before + name in self.pieces:  # the two would join
            return False
        return self.merge(before + name) == [len(p) for p in (before, name) if p]

    def merge(self, text: str) -> list[int]:
        """Lengths of the pieces that merges leave: of all neighbours that make a piece the best scored, of equal ones the first, join."""
        n, pieces = len(text), self.pieces
        size, before, heap = [1] * n, list(range(-1, n - 1)), []
        for i in range(n - 1):
            if (piece := pieces.get(text[i:i + 2])) is not None:
                heap.append((-piece[0], i, 2))
        heapq.heapify(heap)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = i + size[i]
            if not size[i] or j >= n or size[i] + size[j] != whole:
                continue  # one of the two has changed
            size[i], size[j] = whole, 0
            k = i + whole
            if k < n:
                before[k] = i
                if (piece := pieces.get(text[i:k + size[k]])) is not None:
                    heapq.heappush(heap, (-piece[0], i, whole + size[k]))
            b = before[i]
            if b >= 0 and (piece := pieces.get(text[b:k])) is not None:
                heapq.heappush(heap, (-piece[0], b, k - b))
        return [k for k in size if k]

    def ids_of(self, pieces: list[bytes]) -> list[list[int]]:
        found = []
        for p in pieces:
            text = p.decode()
            if SPACE not in text:
                found.append(self.viterbi(text.replace(" ", SPACE)))
                continue
            ids = []
            for k, part in enumerate(text.split(SPACE)):  # the text's own U+2581 is never a space
                ids += [self.bytes_id[b] for b in SPACE.encode()] if k else []
                ids += self.viterbi(part.replace(" ", SPACE)) if part else []
            found.append(ids)
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.cast(pa.large_string()).fill_null("")
        space, nothing = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
        return super().encode(pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(space, texts, nothing)))

    def decode(self, lengths: np.ndarray, ids: np.ndarray) -> list[str]:
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id is not in the vocabulary")
        sizes = self.out_length[ids]
        data = self.out_pool[spans(self.out_start[ids], sizes)].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(lengths)])]
        return [data[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def is_bpe(model) -> bool:
    from sentencepiece import sentencepiece_model_pb2

    return sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto()).trainer_spec.model_type == 2


_models: dict[tuple[str, bool], Model] = {}


def model(path: str, own_rule: bool = False) -> Model:
    if (path, own_rule) not in _models:
        _models[path, own_rule] = Model(path, own_rule=own_rule)
    return _models[path, own_rule]


def encoded(docs: DataFrame, path: str, own_rule: bool = False) -> DataFrame:
    """doc_id, n_pieces, ids (little-endian unsigned 32-bit); best sum of scores, or the model's own rule."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        for batch in flushes(batches, 8 << 20):
            lengths, ids = model(path, own_rule).encode(batch.column("text"))
            edges = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
            cells = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(edges * 4), pa.py_buffer(ids.astype("<u4").tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths.astype(np.int64)), cells.cast(pa.binary())], schema=schema)

    prepare(docs.sparkSession)
    return id_and_text(docs).mapInArrow(run, "doc_id long, n_pieces long, ids binary")


def decoded(codes: DataFrame, path: str) -> DataFrame:
    """The columns of `encoded` and the text they stand for."""

    def run(batches):
        for batch in batches:
            cells = [np.frombuffer(c, "<u4") for c in batch.column("ids").to_pylist()]
            ids = np.concatenate(cells).astype(np.int64) if cells else np.zeros(0, np.int64)
            texts = model(path).decode(np.array([len(c) for c in cells], np.int64), ids)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_pieces", "ids")), pa.array(texts, pa.string())], names=["doc_id", "n_pieces", "ids", "text"])

    return codes.select("doc_id", "n_pieces", "ids").mapInArrow(run, "doc_id long, n_pieces long, ids binary, text string")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded: doc_id, n_pieces, ids_crc32, decoded_sha256."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    back = decoded(encoded(table(spark, sf_dir, "documents"), path, own_rule=True), path)
    return back.select("doc_id", "n_pieces", F.crc32("ids").alias("ids_crc32"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))
