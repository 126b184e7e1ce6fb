"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one Viterbi pass.

The pieces and scores come from a model file. For each position the automaton yields, along its output links, every piece
that ends there, longest first; each relaxes the best score at that position, so a text is segmented in one pass. A
character that no piece covers costs less than the worst piece and is written as its bytes, or as one unknown id where the
model has no pieces for them. If pieces hold the space mark only in front (or are runs of it), a text is cut into parts
before each run of marks, and equal parts are looked up; else texts are segmented whole.

The scores are used as they stand in the file, as log-probabilities: the result is the best path of the library's own
lattice (the first of its n-best search) for these pieces with the unigram model type. A file made for merges
(``piece_bpe_32k.model``) keeps merge ranks there; its own merge order may cut a word otherwise. Decoding is the inverse
in either case.

Defined results: null and empty texts give no ids and decode to the empty text; the space mark itself (U+2581) decodes as
a space, as in the library; repeated rows and ids give a row each; an empty table gives an empty result; ids outside the
vocabulary decode as nothing; other columns are kept, and one named as the result is replaced.
"""

from __future__ import annotations

from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MARK = "▁"
#: Parts kept in memory by one worker.
MEMO_PARTS = 300_000
ROWS_AT_ONCE = 200
_segmenters: dict[int, Segmenter] = {}


class Segmenter:
    """Encodes and decodes with the pieces of one model file."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.automaton = ahocorasick.Automaton()
        plain_of: list[bytes] = []
        self.byte_ids = [-1] * 256
        self.unknown = sp.unk_id()
        worst = 0.0
        #: Whether parts of a text may be segmented by themselves.
        self.by_parts = True
        for i, piece in enumerate(map(sp.id_to_piece, range(sp.get_piece_size()))):
            plain = b""
            if sp.is_byte(i):
                plain = bytes([int(piece[3:5], 16)])
                self.byte_ids[plain[0]] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                score = sp.get_score(i)
                worst = min(worst, score)
                self.automaton.add_word(piece, (i, len(piece), score))
                self.by_parts &= MARK not in piece.lstrip(MARK)
                plain = piece.replace(MARK, " ").encode()
            plain_of.append(plain)
        self.automaton.make_automaton()
        self.unknown_score = worst - 10
        self.bytes_of = np.frombuffer(b"".join(plain_of), np.uint8)
        self.starts = np.cumsum([0, *map(len, plain_of)])
        self.lists = common.Lists(self._segmented, "int32", MEMO_PARTS if self.by_parts else 0)

    def segment(self, part: str) -> tuple[int, ...]:
        """Ids of the best path through ``part``."""
        n = len(part)
        best, start, piece = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        reached, unknown = 0, self.unknown_score
        for last, (i, length, score) in self.automaton.iter(part):
            end = last + 1
            while reached < end:  # all that ends before is settled
                reached += 1
                best[reached] = best[reached - 1] + unknown
                start[reached] = reached - 1
            score += best[end - length]
            if score > best[end]:
                best[end], start[end], piece[end] = score, end - length, i
        while reached < n:
            reached += 1
            start[reached] = reached - 1
        out: list[int] = []
        while n:
            at = start[n]
            if piece[n] >= 0:
                out.append(piece[n])
            else:
                raw = [self.byte_ids[b] for b in reversed(part[at:n].encode("utf-8", "surrogatepass"))]
                out += raw if min(raw) >= 0 else [self.unknown]
            n = at
        return tuple(reversed(out))

    def _segmented(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.segment(MARK + p) for p in parts]
        return np.fromiter(chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of the texts in them)."""
        parts: list[str] = []
        counts = []
        for t in texts:
            own = (parts_of(t) if self.by_parts else [t.replace(" ", MARK)]) if t else []
            parts += own
            counts.append(len(own))
        ids, lengths = self.lists.of(parts, len(parts))
        return ids, common.sums_of_runs(lengths, counts)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(bytes, begin, end of each text) of texts whose ids are given in a row; bytes may be no valid UTF-8."""
        known = (ids >= 0) & (ids < len(self.starts) - 1)
        flat, lengths = common.gathered(self.bytes_of, self.starts, np.where(known, ids, self.unknown))
        ends = common.sums_of_runs(lengths, np.diff(bounds))
        begin, end = ends[:-1], ends[1:]
        spaced = np.zeros(len(begin), bool)
        full = begin < end
        spaced[full] = flat[begin[full]] == 0x20
        return flat.tobytes(), begin + spaced, end


def parts_of(text: str) -> list[str]:
    """Parts of a text before each run of spaces, less one mark in front (also that of the text itself)."""
    words = text.split(" ")
    if "" not in words:
        return words
    out, run = [], ""
    for w in words[:-1]:
        if w:
            out.append(run + w)
            run = ""
        else:
            run += MARK
    out.append(run + words[-1])
    return out


def segmenter(model: bytes) -> Segmenter:
    """This worker's segmenter for a model file."""
    key = hash(model)
    if key not in _segmenters:
        _segmenters[key] = Segmenter(model)
    return _segmenters[key]


def encode(docs: DataFrame, model: bytes, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of its texts as ``out_col``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<int>")
    def ids_of(texts: pa.Array) -> pa.Array:
        seg = segmenter(shared.value)
        out = []
        for at in range(0, len(texts), ROWS_AT_ONCE):
            ids, bounds = seg.encode(texts.slice(at, ROWS_AT_ONCE).to_pylist())
            out.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)))
        common.give_back()
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))

    return docs.withColumn(out_col, ids_of(F.col(text_col).cast("string")))


def decode(encoded: DataFrame, model: bytes, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids as ``out_col``."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def text_of(ids: pa.Array) -> pa.Array:
        seg = segmenter(shared.value)
        out: list[str] = []
        for at in range(0, len(ids), ROWS_AT_ONCE):
            part = ids.slice(at, ROWS_AT_ONCE)
            bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False))])
            flat, begin, end = seg.decode(part.flatten().to_numpy(zero_copy_only=False), bounds)
            out += [flat[a:b].decode("utf-8", "replace") for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        common.give_back()
        return pa.array(out, pa.string())

    return encoded.withColumn(out_col, text_of(F.col(ids_col)))


def model_file(path: str | None = None) -> bytes:
    """The model file's bytes; by default that of the public 32k pieces."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def op5(spark, sf_dir: str) -> DataFrame:
    model = model_file()
    out = decode(encode(common.table(spark, sf_dir, "documents").select("doc_id", "text"), model), model)
    return common.written(out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")), "pieces")
