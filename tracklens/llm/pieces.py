"""SentencePiece encoding and decoding by a weighted finite-state transducer.

``PieceTransducer`` compiles three parts of a model file into states and arcs:

- ``Normaliser``: from its start state an arc that reads nothing and writes a mark; then an arc that writes a
  mark for a space or a mark, and arcs that write any other character as it is.
- ``Pieces``: an automaton whose accepting states write a piece; that weighs PIECE.
- Byte fallback: arcs that read any one character and write its bytes, FALLBACK each.

Composed with an input this is a lattice: positions of the normalised input, an arc from one to another for
each piece that reads the characters between them, and the fallback arcs. The model is of the BPE kind, whose
encoding no sum of piece scores gives. It is given by which pieces may follow each other: two can be neighbours
if merging their characters yields them again. So a third transducer, over (last piece, next piece), adds
``link``, 0 or infinity, and the shortest path in the tropical semiring (sums along a path, least of the paths
to a position) is the encoding. A sequence whose neighbours all fit is the encoding of its text, so at most one
state of a position has a finite weight, and one is kept for each.

Where no piece holds two characters side by side, no path crosses from one to the other; marks stand at the
start of pieces only. So a text is a sequence of units (a word with the marks before it, say) that are composed
apart; a task remembers units it has seen. Runs of spaces have an automaton of their own, as the model's merges of marks tie in score.

Defined results: a null text counts as empty and has no pieces; a mark (U+2581) in a text reads as a space,
as in the model's own library, so such a text doesn't come back unchanged; repeated rows are encoded
alike; texts are read whole, however long; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.llm.common import table, tokenizer_path

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Units and pairs of pieces that a task remembers.
UNITS, PAIRS = 400_000, 500_000
#: Weights of arcs.
PIECE, FALLBACK, NEVER = 1, 1000, float("inf")
#: Where units may end; parts are joined again where a piece could cross.
_PART = re.compile(rf"{MARK}*[^\W\d_]+|{MARK}+|\d+|.", re.DOTALL)


class Normaliser:
    """Arcs (state, character read) -> (characters written, next state); None reads nothing, ANY any other character."""

    ANY = object()

    def __init__(self):
        self.arcs = {(0, None): (MARK, 1), (1, " "): (MARK, 1), (1, MARK): (MARK, 1), (1, self.ANY): (None, 1)}
        self.rewrites = [(c, out) for (state, c), (out, _) in self.arcs.items() if state == 1 and isinstance(c, str) and c != out]

    def compose(self, text: str) -> str:
        """What is written for a text; arcs that write what they read need no step of their own."""
        for c, out in self.rewrites:
            text = text.replace(c, out)
        return self.arcs[0, None][0] + text


class Pieces:
    """The automaton of all pieces, with failure arcs, so that one pass over a text accepts every piece at every place."""

    def __init__(self, words: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for n, word in enumerate(words):
            self.automaton.add_word(word, (len(word), n))
        self.automaton.make_automaton()

    def arcs(self, text: str):
        """(last position read, (characters, piece)) of all arcs of the lattice, by position, the longest first."""
        return self.automaton.iter(text)


class PieceTransducer:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_proto=Path(path).read_bytes())
        every = range(model.get_piece_size())
        self.bytes_of: list[bytes] = []
        self.byte_ids: dict[int, int] = {}
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        for i in every:
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes_of.append(b" \xe2\x81\x87 " if model.is_unknown(i) else b"")
            else:
                self.ids[piece], self.score[piece] = i, model.get_score(i)
                self.bytes_of.append(piece.replace(MARK, " ").encode())
        self.runs = {len(p) for p in self.ids if not p.strip(MARK)}
        self.beside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.words = list(self.ids)
        self.word_ids = [(i,) for i in self.ids.values()]
        self.normaliser, self.pieces = Normaliser(), Pieces(self.words)
        self.lives: dict[str, tuple[list, list]] = {}
        self.pairs: dict[int, float] = {}
        self.units: dict[str, tuple[int, ...]] = {"": ()}
        self.units_before: dict[str, tuple[int, ...]] = {}  # those of the time before the last were too many

    def merges(self, text: str) -> tuple[list[str], tuple[str, str]]:
        """A short text's characters, merged by score, ties from the left; and the two parts of the last merge."""
        parts, last = list(text), (text, "")
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts, last
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def edges(self, piece: str) -> tuple[list, list]:
        """What stands at a piece's left and right end while its characters merge: [(part, score of the merge that ends it)]."""
        known = self.lives.get(piece)
        if known is None:
            known = ([(piece, -float("inf"))], [(piece, -float("inf"))])
            if len(piece) > 1:
                left, right = self.merges(piece)[1]
                end = self.score[piece]
                start, stop = self.edges(left)[0], self.edges(right)[1]
                known = (start[:-1] + [(left, end)] + known[0], stop[:-1] + [(right, end)] + known[1])
            self.lives[piece] = known
        return known

    def link(self, a: int, b: int) -> float:
        """The weight of piece b after piece a: NEVER if a merge crosses from a to b, else 0; -1 stands for other arcs.

        Merges go by falling score. A crossing one comes about if its score is above that of the merge that
        ends its left part (which goes first if equal) and not below that of the one that ends its right part.
        """
        if a < 0 or b < 0:
            return 0
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = 0 if self._apart(self.edges(self.words[a])[1], self.edges(self.words[b])[0]) else NEVER
        return known

    def _apart(self, lefts: list, rights: list) -> bool:
        i = j = 0
        while True:
            (x, x_end), (y, y_end) = lefts[i], rights[j]
            score = self.score.get(x + y)
            if score is not None and score > x_end and score >= y_end:
                return False
            if i == len(lefts) - 1 and j == len(rights) - 1:
                return True
            if i < len(lefts) - 1 and (j == len(rights) - 1 or x_end >= y_end):
                i += 1
            else:
                j += 1

    def shortest_path(self, text: str) -> tuple[int, ...]:
        """Ids along the shortest path through the lattice of a normalised unit with one leading mark at most."""
        n = len(text)
        weight, last, before = [0] + [NEVER] * n, [-1] * (n + 1), list(range(-1, n))
        pairs, link, reached = self.pairs, self.link, 0
        for end, (size, p) in itertools.chain(self.pieces.arcs(text), [(n, (0, -1))]):
            while reached < end:  # all arcs to these positions are known; where none had a finite weight, the fallback arc has
                reached += 1
                if last[reached] < 0:
                    weight[reached] = weight[reached - 1] + FALLBACK * len(text[reached - 1].encode())
            at, end = end + 1 - size, end + 1
            if p < 0 or last[end] >= 0:  # of arcs between neighbours that fit there is one at most
                continue
            a = last[at]
            fits = pairs.get(a << 32 | p) if a >= 0 else 0
            w = weight[at] + PIECE + (link(a, p) if fits is None else fits)
            if w < weight[end]:
                weight[end], last[end], before[end] = w, p, at
        at, path = len(text), []
        while at:
            path.append(self.word_ids[last[at]] if last[at] >= 0 else [self.byte_ids[b] for b in text[before[at] : at].encode()])
            at = before[at]
        return tuple(i for ids in reversed(path) for i in ids)

    def run(self, n: int) -> list[int]:
        """Ids of n marks that nothing else took: merged from the left, as far as pieces go."""
        top = max(self.runs)
        out = [top] * max(0, n // top - 1)
        parts = [1] * (n - top * len(out))
        i = 0
        while i < len(parts) - 1:
            if parts[i] + parts[i + 1] in self.runs:
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                i = 0
            else:
                i += 1
        return [self.ids[MARK * x] for x in out + parts]

    def unit(self, unit: str) -> tuple[int, ...]:
        """Ids of a normalised unit: marks, then characters that pieces join."""
        word = unit.lstrip(MARK)
        marks = len(unit) - len(word)
        if not word:
            return tuple(self.run(marks))
        ids = self.shortest_path(MARK * (marks > 0) + word)
        if marks > 1:
            alone = ids[0] == self.ids[MARK]  # the mark before the word stays with the others
            ids = (*self.run(marks - 1 + alone), *ids[alone:])
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if len(self.units) >= UNITS:
            self.units, self.units_before = {"": ()}, self.units
        known, beside, out, unit = self.units, self.beside, [], ""
        for part in _PART.findall(self.normaliser.compose(text)):
            if part[0] != MARK and unit[-1:] + part[0] in beside:
                unit += part
                continue
            ids = known.get(unit)
            if ids is None:
                ids = known[unit] = self.units_before.get(unit) or self.unit(unit)
            out += ids
            unit = part
        return out + list(self.unit(unit))

    def decode(self, ids) -> str:
        """The inverse: bytes of the pieces, less the mark before the text."""
        raw = b"".join([self.bytes_of[i] for i in ids])
        return raw[raw[:1] == b" " :].decode(errors="replace")


@lru_cache
def transducer(root: str | None = None) -> PieceTransducer:
    return PieceTransducer(tokenizer_path(MODEL, root))


def encode_texts(docs: DataFrame, root: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row of docs."""

    def of(batches):
        import pyarrow as pa

        for batch in batches:
            ids = [transducer(root).encode(x.as_py() or "") for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _texts(docs).mapInArrow(of, "doc_id long, ids array<int>")


def decode_texts(encoded: DataFrame, root: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids count as none."""

    def of(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [transducer(root).decode(x.as_py() or []) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(of, "doc_id long, text string")


def piece_digests(docs: DataFrame, root: str | None = None) -> DataFrame:
    """(doc_id, n_pieces, n_byte_pieces, ids_crc32, round_trip) of every row of docs."""

    def of(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        t = transducer(root)
        is_byte = np.zeros(len(t.bytes_of), bool)
        is_byte[list(t.byte_ids.values())] = True
        for batch in batches:
            rows = []
            for x in batch.column("text"):
                text = x.as_py() or ""
                ids = t.encode(text)
                array = np.array(ids, "<u4")
                rows.append((len(ids), int(is_byte[array].sum()), zlib.crc32(array.tobytes()), t.decode(ids) == text))
            n, b, crc, same = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(b, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "round_trip"])

    return _texts(docs).mapInArrow(of, "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op5_sentencepiece": op5_sentencepiece}
ORACLE_SQL: dict[str, str] = {}
