"""Token-id output: Arrow files of equal-length sequences, and their readers.

File format: the Arrow IPC file layout (a stream with a footer, so any record batch can be
reached directly). Every batch but a file's last holds ``BATCH_SEQUENCES`` rows of

* ``ids``: fixed-size list of unsigned integers (16 bits where the vocabulary fits, else 32),
* ``mask``: fixed-size list of booleans (bits), false where the last sequence of a file is padded,
* ``docs``: the documents that begin in this sequence, as (doc_id, at).

Documents follow one another without gaps, each closed by the end id; sequence i is row
i % BATCH_SEQUENCES of batch i // BATCH_SEQUENCES, a view into the mapped file.
A file belongs to one task. Its name is unique per attempt and only files listed in the
committed manifest table count, so a lost executor leaves at most an unlisted file.
"""

from __future__ import annotations

import json
import os
import re
import string
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioflow.llm.common import written
from folioflow.session import scratch_dir

SEQUENCE = 2048
BATCH_SEQUENCES = 64
#: A shard goes on in a new file after this many sequences.
FILE_SEQUENCES = 65_536
#: Entries of a worker's memo of encoded words (some 200 bytes each); in two generations.
MEMO = 1_000_000
#: Characters encoded in one call, or one longer text.
CALL_CHARS = 4_000_000

#: Punctuation that is cut off a word of letters; letters from this character on are left to the tokenizer.
ENDINGS, OTHER_SCRIPTS = string.punctuation, "\u0250"
#: Byte-level alphabet: bytes that are no visible Latin-1 character stand for U+0100 and following, in order.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
BYTE_CHARS = {b: 256 + n for n, b in enumerate(_HIDDEN)}
BLANK, LINE = chr(BYTE_CHARS[ord(" ")]), chr(BYTE_CHARS[ord("\n")])

OTHER_WHITE = "\n\t\r\x0b\x0c\x1c\x1d\x1e\x1f"

_SAFE = re.compile(r"(?<=\S) (?=\S)")
_UNSAFE = re.compile(r" \s|\s ")

MANIFEST = "shard int, part int, file string, n_docs long, n_tokens long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Whole texts to packed ids through the tokenizers library, each distinct word encoded once.

    A byte-level pre-tokenizer always ends a token at a blank between two characters that are
    not white space, so the text may be cut there and the pieces encoded on their own. Tokenizers of
    another kind encode every text in one piece.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        self.end = np.array([end_id], self.dtype).tobytes()
        setup = json.loads(self.tokenizer.to_str())
        before = setup["pre_tokenizer"] or {}
        self.by_word = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"] and not setup["normalizer"] and setup["model"]["type"] == "BPE"
        # the same model behind a pre-tokenizer that only cuts at blanks
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        self.line = self.tokenizer.token_to_id(LINE)
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _encode(self, words: list[str], prefix: str) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast([prefix + w for w in words], add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in encoded]

    def _encode_stems(self, stems: list[str]) -> list[bytes]:
        """Words of letters, after a blank or a line feed: one token of the pre-tokenizer each, so the model gets them as they are."""
        if not stems:
            return []
        chars = [w[1:] if w[0] == "\n" else " " + w for w in stems]
        chars = [w.replace(" ", BLANK) if w.isascii() else w.encode().decode("latin-1").translate(BYTE_CHARS) for w in chars]
        ids = self.model.encode_batch_fast([f" {LINE} ".join(chars) + f" {LINE}"], add_special_tokens=False)[0].ids
        ids = np.array(ids, self.dtype)
        ends = np.flatnonzero(ids == self.line) * ids.itemsize
        packed, starts = ids.tobytes(), np.concatenate([[0], ends[:-1] + ids.itemsize])
        feed = np.array([self.line], self.dtype).tobytes()
        return [(feed if w[0] == "\n" else b"") + packed[a:b] for w, a, b in zip(stems, starts.tolist(), ends.tolist(), strict=True)]

    def _learn(self, words: list[str]) -> None:
        """Make sure that the memo has all these words (each after a blank).

        The memo has two generations: when the young one is full it becomes the old one, and words still in
        use move back.
        """
        new = [w for w in words if w not in self.memo]
        if len(self.memo) + len(new) > MEMO // 2:
            self.old, self.memo, new = self.memo, {}, words
        memo, old = self.memo, self.old
        if old:
            memo.update((w, old[w]) for w in new if w in old)
            new = [w for w in new if w not in memo]
        # a token also ends around a single line feed and between a letter and punctuation, so lines are
        # taken apart and a word's stem is encoded once for all its endings
        ends, lines, stems, odd = {}, {}, set(), set()

        def place(w: str) -> bool:
            stem = w.rstrip(ENDINGS)
            bare = stem[1:] if stem[:1] == "\n" else stem
            if not (bare.isalpha() and (bare.isascii() or max(bare) < OTHER_SCRIPTS)):
                return False
            if len(stem) < len(w):
                ends[w] = stem, w[len(stem) :]
            if stem not in memo:
                stems.add(stem)
            return True

        for w in new:
            if "\n" in w:
                first, *rest = w.split("\n")
                parts = [first, *("\n" + r for r in rest)]
                if all(p in memo or place(p) for p in parts):
                    lines[w] = parts
                else:
                    odd.add(w)
            elif not place(w):
                odd.add(w)
        ordered = list(stems)
        memo.update(zip(ordered, self._encode_stems(ordered), strict=True))
        ordered = list(odd)
        memo.update(zip(ordered, self._encode(ordered, " "), strict=True))
        tails = [t for t in {t for _, t in ends.values()} if t not in self.tails]
        self.tails.update(zip(tails, self._encode(tails, ""), strict=True))
        for w, (stem, tail) in ends.items():
            memo[w] = memo[stem] + self.tails[tail]
        for w, parts in lines.items():
            memo[w] = b"".join(map(memo.__getitem__, parts))

    @staticmethod
    def _pieces(text: str) -> str | list[str]:
        """The text itself if every blank may cut it, else its pieces."""
        if text.isascii():
            unsafe = text[:1] == " " or text[-1:] == " " or "  " in text or any(" " + c in text or c + " " in text for c in OTHER_WHITE if c in text)
        else:
            unsafe = text[:1] == " " or text[-1:] == " " or _UNSAFE.search(text)
        return _SAFE.split(text) if unsafe else text

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text, with the end id."""
        if not self.by_word:
            return [ids + self.end for ids in self._encode(texts, "")]
        heads, plain, odd = [], [], []
        for n, text in enumerate(texts):
            pieces = self._pieces(text)
            if isinstance(pieces, str):
                head, blank, rest = pieces.partition(" ")
                plain.append((n, rest if blank else None))
            else:
                head = pieces[0]
                odd.append((n, pieces[1:]))
            heads.append(head)
        split = pc.split_pattern(pa.array([r for _, r in plain], pa.string()), " ")
        lists = pa.concat_arrays([split, pa.array([r for _, r in odd], pa.list_(pa.string()))])
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        self._learn(words)
        table = pa.array(list(map(self.memo.__getitem__, words)), pa.large_binary())
        packed = table.take(coded.indices)
        stops = np.frombuffer(packed.buffers()[1], np.int64, len(packed) + 1) if len(packed) else np.zeros(1, np.int64)
        data = memoryview(packed.buffers()[2] or b"") if len(packed) else memoryview(b"")
        bounds = stops[lists.offsets.to_numpy()].tolist()
        heads, out = self._encode(heads, ""), [b""] * len(texts)
        for (n, _), a, b in zip([*plain, *odd], bounds[:-1], bounds[1:], strict=True):
            out[n] = b"".join((heads[n], data[a:b], self.end))
        return out


@cache
def worker_encoder(path: str, end_id: int) -> Encoder:
    """One encoder per Python worker, so that the memo lasts over its tasks."""
    return Encoder(path, end_id)


def _groups(batches) -> Iterator[tuple[list[int | None], list[str]]]:
    """Ids and texts of an input's rows, some ``CALL_CHARS`` characters at a time."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(doc_id)
            texts.append(text.as_py())
            size += len(texts[-1])
            if size > CALL_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
        yield ids, texts


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


def file_schema(dtype: np.dtype, length: int) -> pa.Schema:
    return pa.schema(
        [
            ("ids", pa.list_(pa.from_numpy_dtype(dtype), length)),
            ("mask", pa.list_(pa.bool_(), length)),
            ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("at", pa.int32())]))),
        ]
    )


class _ShardWriter:
    """Packs encoded documents into files of equal-length sequences; holds one batch in memory."""

    def __init__(self, folder: str, dtype: np.dtype, length: int):
        self.folder, self.dtype, self.length = folder, dtype, length
        self.schema = file_schema(dtype, length)
        self.rows: list[tuple] = []
        self.sink = None
        self._reset()

    def _reset(self) -> None:
        self.chunks: list[bytes] = []
        self.size = self.sequences = self.docs = self.tokens = 0
        self.starts: list[tuple[int | None, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.sink is None:
            filesystem, folder = _open(self.folder)
            filesystem.create_dir(folder, recursive=True)
            self.file = f"{self.folder}/{uuid.uuid4().hex}.arrow"
            self.sink = filesystem.open_output_stream(f"{folder}/{self.file.rpartition('/')[2]}")
            self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.starts.append((doc_id, self.size))
        self.chunks.append(ids)
        n = len(ids) // self.dtype.itemsize
        self.size, self.docs, self.tokens = self.size + n, self.docs + 1, self.tokens + n
        if self.size >= BATCH_SEQUENCES * self.length:
            self._write(False)
            if self.sequences >= FILE_SEQUENCES:
                self.close()

    def _write(self, last: bool) -> None:
        """Full batches, or everything with padding."""
        ids = np.frombuffer(b"".join(self.chunks), self.dtype)
        per = BATCH_SEQUENCES * self.length
        done = 0
        while len(ids) - done >= per or last and done < len(ids):
            part = ids[done : done + per]
            rows = -(-len(part) // self.length)
            padded = np.zeros(rows * self.length, self.dtype)
            padded[: len(part)] = part
            here = [(d, at - done) for d, at in self.starts if done <= at < done + per]
            of = np.array([at for _, at in here], np.int64)
            lists = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(of, np.arange(rows + 1) * self.length), pa.int32()),
                pa.StructArray.from_arrays(
                    [pa.array([d for d, _ in here], pa.int64()), pa.array(of % self.length, pa.int32())], ["doc_id", "at"]
                ),
            )
            mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(padded)) < len(part)), self.length)
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(padded), self.length), mask, lists]
            self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
            self.sequences += rows
            done += len(part)
        self.chunks, self.size = [ids[done:].tobytes()], len(ids) - done
        self.starts = [(d, at - done) for d, at in self.starts if at >= done]

    def close(self) -> None:
        if self.sink is None:
            return
        self._write(True)
        self.writer.close()
        self.sink.close()
        self.rows.append((len(self.rows), self.file, self.docs, self.tokens))
        self.sink = None
        self._reset()


def write_sequences(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, length: int = SEQUENCE) -> DataFrame:
    """Encode every whole text, in ascending doc_id order, into files under ``folder``; the committed manifest.

    ``folder`` must be shared by all executors. A null text is empty (the end id alone), null ids come
    last, repeated rows are documents of their own; an empty table writes no file; other columns are ignored.
    ``length`` is a multiple of 8, so that masks are whole bytes.
    """
    if length % 8:
        raise ValueError("length must be a multiple of 8")

    def pack(batches):
        encoder = worker_encoder(tokenizer, end_id)
        shard = TaskContext.get().partitionId()
        writer = _ShardWriter(folder, encoder.dtype, length)
        for ids, texts in _groups(batches):
            for doc_id, packed in zip(ids, encoder(texts), strict=True):
                writer.add(doc_id, packed)
        writer.close()
        for part, file, n_docs, n_tokens in writer.rows:
            yield pa.RecordBatch.from_pylist(
                [{"shard": shard, "part": part, "file": file, "n_docs": n_docs, "n_tokens": n_tokens}],
                schema=pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = F.col("doc_id").asc_nulls_last()
    packed = rows.repartitionByRange(order).sortWithinPartitions(order, "text").mapInArrow(pack, MANIFEST)
    return written(packed, "token-manifest")


def read_documents(manifest: DataFrame) -> DataFrame:
    """Document rows read back from the files: doc_id, start, n_tokens, ids_crc32 (of 32-bit little-endian ids).

    The running total over the manifest sees one row per file, not per document.
    """
    order = W.orderBy("shard", "part").rowsBetween(W.unboundedPreceding, -1)
    files = manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    n_files = manifest.count()

    def read(batches):
        for batch in batches:
            for file, first in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist(), strict=True):
                yield from _file_documents(file, first)

    return files.select("file", "first").repartition(max(1, n_files)).mapInArrow(read, DOCUMENTS)


def _file_documents(file: str, first: int) -> Iterator[pa.RecordBatch]:
    filesystem, path = _open(file)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    doc, crc, n, at = None, 0, 0, first  # the document that is still open, and where it began
    opened = False
    with filesystem.open_input_file(path) as source:
        reader = pa.ipc.open_file(source)
        for i in range(reader.num_record_batches):
            batch = reader.get_batch(i)
            ids = batch.column("ids").flatten().to_numpy()
            ids = ids[: pc.sum(batch.column("mask").flatten()).as_py()].astype("<u4")
            lists = batch.column("docs")
            begun = lists.flatten()
            length = batch.schema.field("ids").type.list_size
            rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            starts = begun.field("at").to_numpy() + rows * length
            out, done = [], 0
            for doc_id, start in zip([*begun.field("doc_id").to_pylist(), None], [*starts.tolist(), len(ids)], strict=True):
                crc, n = zlib.crc32(ids[done:start], crc), n + start - done
                if start < len(ids):
                    if opened:
                        out.append((doc, at, n, crc))
                        at += n
                    doc, crc, n, opened = doc_id, 0, 0, True
                done = start
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], schema=schema)
    if opened:
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (doc, at, n, crc)], schema=schema)


class SequenceFile:
    """Random access to one file: ``file[i]`` is (ids, mask bits), both views into the mapped file."""

    def __init__(self, path: str):
        self.map = pa.memory_map(path)
        self.reader = pa.ipc.open_file(self.map)
        self.length = self.reader.schema.field("ids").type.list_size
        n = self.reader.num_record_batches
        self.n = BATCH_SEQUENCES * max(0, n - 1) + (self.reader.get_batch(n - 1).num_rows if n else 0)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if not 0 <= i < self.n:
            raise IndexError(i)
        batch, row = self.reader.get_batch(i // BATCH_SEQUENCES), i % BATCH_SEQUENCES
        ids = batch.column("ids").flatten().to_numpy()
        bits = np.frombuffer(batch.column("mask").values.buffers()[1], np.uint8)
        step = self.length // 8
        return ids[row * self.length : (row + 1) * self.length], bits[row * step : (row + 1) * step]


def token_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, length: int = SEQUENCE) -> DataFrame:
    """Write the files to the shared scratch folder, read them back and describe each document."""
    folder = scratch_dir(docs.sparkSession, "sequences")
    return read_documents(write_sequences(docs, folder, tokenizer or default_tokenizer(), end_id, length))
