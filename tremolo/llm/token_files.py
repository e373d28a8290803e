"""Token ids as Arrow files of fixed-size lists, and reading them back.

Ids take 16 bits where the vocabulary allows it and 32 otherwise; masks take one
bit.  The corpus is one stream of ids in ascending doc_id order, cut into sequences of
equal length.  Each task writes its range of ids as one Arrow file whose record
batches hold ``fixed_size_list`` columns ``ids`` and ``mask``; sequence *i* of a
file is a slice of a memory-mapped buffer, so access is random and copies nothing.
A second small Arrow file beside it holds where each document starts.
"""

from __future__ import annotations

import os
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.materialize import materialize, scratch_path
from ._common import parts

_CHUNKS_KEPT = 1_000_000
_LONGEST_KEPT = 64
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Sequences in a record batch; the writer holds so much and no more.
_BATCH_SEQUENCES = 128
_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _byte_letters() -> dict[int, str]:
    """The letters that a byte-level vocabulary writes for bytes: visible Latin-1
    characters stand for themselves, the others for U+0100 onwards, in order."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(256 + k) for k, b in enumerate(hidden)}


class ChunkEncoder(dict):
    """Ids of texts with a byte-level tokenizer that drops white space, remembering
    the ids of chunks between spaces; no pre-token of such a tokenizer crosses one.

    As a mapping, chunk → ids as little-endian 32-bit integers.
    """

    def __init__(self, tokenizer_path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self._pieces = self.tokenizer.model.tokenize  # of one pre-token in byte letters
        self._normal = self.tokenizer.normalizer.normalize_str
        self._letters = _byte_letters()

    def __missing__(self, chunk: str) -> bytes:
        ids = self._ids(chunk)
        if len(chunk) <= _LONGEST_KEPT:
            self[chunk] = ids
        return ids

    def _ids(self, chunk: str) -> bytes:
        """Runs of letters and of marks are pre-tokens of their own: a chunk of
        letters with marks after them is looked up by its two parts, and letters of
        the Latin blocks go to the model directly."""
        core = chunk.rstrip(_MARKS)
        if core.isalpha() and max(core) < "\u0250":
            normal = core.lower() if core.isascii() else self._normal(core)
            if normal.isalpha():  # lower-casing may give marks
                if len(core) < len(chunk):
                    return self[core] + self[chunk[len(core) :]]
                word = normal.encode().decode("latin-1").translate(self._letters)
                return self._coded([t.id for t in self._pieces(word)])
        return self._coded(self.tokenizer.encode(chunk, add_special_tokens=False).ids)

    @staticmethod
    def _coded(ids: list[int]) -> bytes:
        return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()

    @staticmethod
    def _plain(text: str) -> str:
        """Line ends as spaces; A-Z lower-cased at once where that cannot make a
        special token and no mark follows that would join the letter."""
        text = text.replace("\n", " ")
        if "<|" in text:
            return text
        try:
            return text.encode("latin-1").lower().decode("latin-1")
        except UnicodeEncodeError:
            return text

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self) > _CHUNKS_KEPT:
            self.clear()
        get = self.__getitem__
        return [b"".join(map(get, self._plain(t).split(" "))) if t else b"" for t in texts]


_ENCODERS: dict[str, ChunkEncoder] = {}


def chunk_encoder(tokenizer_path: str) -> ChunkEncoder:
    if tokenizer_path not in _ENCODERS:
        _ENCODERS[tokenizer_path] = ChunkEncoder(tokenizer_path)
    return _ENCODERS[tokenizer_path]


def _filesystem(folder: str):
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(
        folder if ":" in folder.split("/")[0] else "file://" + os.path.abspath(folder)
    )
    return system, root


def _replace(system, temporary: str, final: str) -> None:
    """Tasks may run twice; both attempts write equal bytes, the last one stays."""
    try:
        system.move(temporary, final)
    except OSError:
        system.delete_file(final)
        system.move(temporary, final)


class _SequenceFile:
    """Writes a stream of ids as record batches of equal-length sequences."""

    def __init__(self, sink, length: int, kind: np.dtype):
        self.length, self.kind = length, kind
        lists = pa.list_(pa.from_numpy_dtype(kind), length), pa.list_(pa.bool_(), length)
        self.schema = pa.schema([("ids", lists[0]), ("mask", lists[1])])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.held = self.tokens = self.sequences = 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        self.tokens += len(ids)
        size = self.length * _BATCH_SEQUENCES
        if self.held >= size:  # all batches but the last have equal size
            self._flush(self.held // size * size)

    def _flush(self, upto: int) -> None:
        flat = np.concatenate(self.waiting)
        self.waiting = [flat[upto:]]
        self.held = len(flat) - upto
        self._write(flat[:upto], np.ones(upto, bool))

    def _write(self, ids: np.ndarray, mask: np.ndarray) -> None:
        size = self.length * _BATCH_SEQUENCES
        for at in range(0, len(ids), size):
            arrays = [
                pa.FixedSizeListArray.from_arrays(pa.array(x[at : at + size]), self.length)
                for x in (ids.astype(self.kind), mask)
            ]
            self.writer.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))
            self.sequences += len(arrays[0])

    def close(self) -> None:
        if self.held:
            rest = np.concatenate(self.waiting)
            room = -len(rest) % self.length
            ids = np.concatenate([rest, np.zeros(room, np.uint32)])
            mask = np.concatenate([np.ones(len(rest), bool), np.zeros(room, bool)])
            self._write(ids, mask)
        self.writer.close()


def write(
    docs: DataFrame, tokenizer_path: str, folder: str, end_id: int, length: int = 2_048
) -> DataFrame:
    """Write ``docs(doc_id, text)`` under ``folder``; returns the manifest
    ``(file, n_docs, n_tokens, n_sequences)`` in a table of its own.

    A null text is empty and gives the end id alone.  Repeated ids are ordered by
    text; rows with a null id come first.  An empty table gives no files.  The
    range partitioning that orders ids is the only shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        system, root = _filesystem(folder)
        name = f"part-{TaskContext.get().partitionId():07d}"
        rows = parts(batches)
        first = next(rows, None)
        if first is None:
            return
        system.create_dir(root, recursive=True)
        mark = f"{root}/.{name}-{uuid.uuid4().hex}"
        n_docs = 0
        with system.open_output_stream(f"{mark}-a") as sink, system.open_output_stream(
            f"{mark}-b"
        ) as index_sink, pa.ipc.new_file(index_sink, _INDEX) as index:
            top = max(encoder.tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id)
            out = _SequenceFile(sink, length, np.min_scalar_type(max(top, 256)))
            batch = first
            while batch is not None:
                coded = [ids + end for ids in encoder.encode(batch.column(1).to_pylist())]
                sizes = np.array([len(c) // 4 for c in coded], np.int64)
                starts = out.tokens + np.concatenate([[0], np.cumsum(sizes)[:-1]])
                out.add(np.frombuffer(b"".join(coded), "<u4"))
                index.write_batch(
                    pa.RecordBatch.from_arrays(
                        [batch.column(0).cast(pa.int64()), pa.array(starts.astype(np.int64)), pa.array(sizes)],
                        schema=_INDEX,
                    )
                )
                n_docs += batch.num_rows
                batch = next(rows, None)
            out.close()
        _replace(system, f"{mark}-a", f"{root}/{name}.arrow")
        _replace(system, f"{mark}-b", f"{root}/{name}.docs.arrow")
        yield pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([n_docs]), pa.array([out.tokens]), pa.array([out.sequences])],
            ["file", "n_docs", "n_tokens", "n_sequences"],
        )

    ordered = (
        docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    )
    schema = "file string, n_docs long, n_tokens long, n_sequences long"
    return materialize(ordered.mapInArrow(run, schema), "manifest")


def open_file(folder: str, name: str) -> pa.ipc.RecordBatchFileReader:
    """A written file; memory-mapped, without copies, where the folder is local."""
    from pyarrow import fs

    system, root = _filesystem(folder)
    path = f"{root}/{name}"
    if isinstance(system, fs.LocalFileSystem):
        return pa.ipc.open_file(pa.memory_map(path))
    return pa.ipc.open_file(system.open_input_file(path))


def sequence(reader: pa.ipc.RecordBatchFileReader, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids, a view of the file's buffer, and the unpacked mask of one sequence."""
    batch = reader.get_batch(number // _BATCH_SEQUENCES)
    at = number % _BATCH_SEQUENCES
    size = batch.schema.field(0).type.list_size
    ids, mask = batch.column(0).flatten(), batch.column(1).flatten()
    mask = mask.slice(at * size, size).to_numpy(zero_copy_only=False)
    return ids.to_numpy(zero_copy_only=True)[at * size : (at + 1) * size], mask


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` from the files; ``start`` counts
    the ids of all documents before, over all files.  One file is one task; its
    offset comes from the manifest, which has one row for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                index = open_file(folder, f"{row['file']}.docs.arrow")
                data = open_file(folder, f"{row['file']}.arrow")
                loaded, low, flat = -1, 0, np.empty(0, np.uint16)
                for k in range(index.num_record_batches):
                    part = index.get_batch(k)
                    starts = part.column(1).to_pylist()
                    sizes = part.column(2).to_pylist()
                    sums = []
                    for start, size in zip(starts, sizes, strict=True):
                        crc, at = 0, start
                        while at < start + size:
                            if at >= low + len(flat):
                                low += len(flat)
                                loaded += 1
                                flat = data.get_batch(loaded).column(0).flatten().to_numpy(zero_copy_only=True)
                                continue
                            piece = flat[at - low : start + size - low]
                            crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                            at += len(piece)
                        sums.append(crc)
                    begin = pa.array(np.array(starts, np.int64) + row["base"])
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), begin, part.column(2), pa.array(sums, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select(
        "file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base")
    )
    files = manifest.count()
    return based.repartition(max(1, files)).mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def scratch_folder(spark) -> str:
    return scratch_path(spark, "token-files")
