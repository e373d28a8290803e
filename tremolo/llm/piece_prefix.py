"""SentencePiece BPE encoding with a prefix table, and decoding.

In a merge-type vocabulary a sequence of pieces is the encoding of its text if
every two neighbours are *compatible*, that is, encode to themselves when joined;
and every prefix of an encoding is the encoding of that prefix.  So each prefix
of a text has one last piece.  The table is filled from left to right: an
automaton names all pieces that end at a position, longest first, and the one that
is compatible with the last piece of the prefix before it is stored.  Ids are
read back from the end.  Cost is linear in the text.

Merges never cross a word's first space, as no piece holds a space after another
character, so words are encoded on their own and remembered: a full table of words becomes the
older one, and the words met again move on to the new one.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import parts

SPACE = "▁"
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*")
_WORDS_KEPT = 250_000
_LONGEST_KEPT = 64
_PAIRS_KEPT = 800_000


class PiecePrefixEncoder:
    """Encoder and decoder of one model file (BPE, identity normalisation, one
    space put before the text)."""

    def __init__(self, model_path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.eos, self.unk = model.eos_id(), model.unk_id()
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i in range(size) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i in range(size) if model.is_control(i)}
        special = self.silent | set(self.byte_of) | {self.unk}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.scores = {p: model.get_score(i) for p, i in self.ids.items()}
        self.text_of = [p.replace(SPACE, " ") for p in self.pieces]
        self.plain = {i: self.text_of[i] for i in self.ids.values()}
        self.lengths = [len(p) for p in self.pieces]
        self.letters = {p for p in self.ids if len(p) == 1}
        runs = [p for p in self.ids if len(p) > 1 and not p.strip(SPACE)]
        least = min(self.scores[p] for p in self.ids if p.strip(SPACE) and len(p) > 1)
        if any(SPACE in p.lstrip(SPACE) for p in self.ids) or any(
            p.startswith(SPACE * 2) and p.strip(SPACE) for p in self.ids
        ):
            raise ValueError("words of this model cannot be encoded on their own")
        if any(self.scores[p] >= least for p in runs):
            raise ValueError("runs of spaces must merge last in this model")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if len(p) == 1 or (p.strip(SPACE) and self.merged(p) == [p]):
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self._pairs: dict[int, bool] = {}
        self._runs: dict[int, list[int]] = {}
        self._words: dict[str, tuple[bytes, str]] = {}
        self._older: dict[str, tuple[bytes, str]] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces by the defining rule: again and again, the neighbours with the
        best joint score are merged, the leftmost of equals first."""
        parts_: list[str | None] = list(text)
        after = [*range(1, len(text)), -1]
        before = list(range(-1, len(text) - 1))
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) >= 0:
                joint = parts_[i] + parts_[j]
                if joint in self.scores:
                    heapq.heappush(heap, (-self.scores[joint], i, j, joint))

        for i in range(len(text)):
            offer(i)
        while heap:
            _, i, j, joint = heapq.heappop(heap)
            if parts_[i] is None or parts_[j] is None or after[i] != j or parts_[i] + parts_[j] != joint:
                continue
            parts_[i], parts_[j] = joint, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts_ if p is not None]

    def _compatible(self, left: int, right: int) -> bool:
        key = left * len(self.pieces) + right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= _PAIRS_KEPT:
                self._pairs.clear()
            a, b = self.pieces[left], self.pieces[right]
            known = self._pairs[key] = self.merged(a + b) == [a, b]
        return known

    def _known(self, text: str) -> list[int]:
        """Ids of a text all of whose characters are pieces."""
        # Last piece of each prefix, -1 where none is found; pieces that do not
        # encode to themselves are not in the automaton.
        last = [-1] * (len(text) + 1)
        pairs, size = self._pairs, len(self.pieces)
        for end, (piece, length) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue  # the unique piece is found
            if start := end - length:
                left = last[start]
                if left < 0:
                    continue
                fits = pairs.get(left * size + piece)
                if not (self._compatible(left, piece) if fits is None else fits):
                    continue
            last[end] = piece
        ids, at, lengths = [], len(text), self.lengths
        while at:
            piece = last[at]
            ids.append(piece)
            at -= lengths[piece]
        return ids[::-1]

    def _word(self, word: str) -> list[int]:
        """Ids of one space and a word, or of a word; unknown characters bar
        merges and become bytes."""
        if self.letters.issuperset(word):
            return self._known(word)
        ids: list[int] = []
        start = 0
        for at, letter in enumerate(word):
            if letter not in self.letters:
                if start < at:
                    ids += self._known(word[start:at])
                ids += [self.bytes[b] for b in letter.encode("utf-8", "replace")]
                start = at + 1
        return ids + self._known(word[start:]) if start < len(word) else ids

    def _chunk(self, chunk: str) -> list[int]:
        word = chunk.lstrip(SPACE)
        spaces = len(chunk) - len(word)
        ids: list[int] = []
        if word:
            ids = self._word(SPACE + word)
            if ids[0] == self.ids[SPACE]:
                ids = ids[1:]  # it is free to join the other spaces
            else:
                spaces -= 1
        if spaces:
            if spaces not in self._runs:
                run = [self.ids[p] for p in self.merged(SPACE * spaces)]
                if len(self._runs) > 1_000:
                    self._runs.clear()
                self._runs[spaces] = run
            ids = self._runs[spaces] + ids
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes are joined, control ids are silent, an unknown
        id is `` ⁇ ``, and the one space put before the text is taken off."""
        out, pending, first = [], bytearray(), True
        for i in ids:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            if i in self.silent:
                continue
            out.append(" ⁇ " if i == self.unk else self.text_of[i])
        if pending:
            out.append(pending.decode("utf-8", "replace"))
        text = "".join(out)
        lead = next((i for i in ids if i not in self.silent), None)
        if lead is not None and self.pieces[lead].startswith(SPACE):
            text = text[1:]
        return text

    def _coded(self, chunk: str) -> tuple[bytes, str]:
        ids = self._chunk(chunk)
        try:
            text = "".join([self.plain[i] for i in ids])
        except KeyError:  # bytes; ``decode`` takes off the first space, the text's own here
            text = self.decode([self.eos, *ids])
            if self.pieces[ids[0]].startswith(SPACE):
                text = " " + text
        return array("i", ids).tobytes(), text

    def _remembered(self, chunk: str) -> tuple[bytes, str]:
        known = self._words.get(chunk)
        if known is None:
            known = self._older.get(chunk) or self._coded(chunk)
            if len(chunk) <= _LONGEST_KEPT:
                if len(self._words) >= _WORDS_KEPT:
                    self._older, self._words = self._words, {}
                self._words[chunk] = known
        return known

    def encode_and_decode(self, text: str | None) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, without the end id, and their
        text again."""
        if not text:
            return b"", ""
        whole = SPACE + text.replace(" ", SPACE)
        get = self._words.get
        found = [get(c) or self._remembered(c) for c in _CHUNK.findall(whole)]
        return b"".join([f[0] for f in found]), "".join([f[1] for f in found])[1:]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_and_decode(text)[0], np.int32).tolist()


_ENCODERS: dict[str, PiecePrefixEncoder] = {}


def encoder(model_path: str) -> PiecePrefixEncoder:
    """One encoder for each model and worker process."""
    if model_path not in _ENCODERS:
        _ENCODERS[model_path] = PiecePrefixEncoder(model_path)
    return _ENCODERS[model_path]


def encode_texts(docs: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, ids, decoded)`` of every row of ``docs(doc_id, text)``.

    ``ids`` ends with the end id; a null text is encoded like the empty one, as
    the end id alone.  Rows are handled one by one: repeated and null ids are
    kept, other columns are not read.  A narrow operator without any shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_path)
        end = np.array([enc.eos], np.int32).tobytes()
        for batch in parts(batches):
            blobs, texts = [], []
            for text in batch.column(1).to_pylist():
                ids, decoded = enc.encode_and_decode(text)
                blobs.append(ids + end)
                texts.append(decoded)
            ends = np.cumsum([0] + [len(b) // 4 for b in blobs], dtype=np.int32)
            values = pa.array(np.frombuffer(b"".join(blobs), np.int32))
            ids = pa.ListArray.from_arrays(pa.array(ends), values)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), ids, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, ids array<int>, decoded string"
    )
