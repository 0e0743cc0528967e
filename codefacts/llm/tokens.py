"""Token ids of a corpus as binary files of range-coded blocks, and reading them back.

The documents are range-partitioned by doc_id, so each file holds a run of documents and the files
follow one another.  A file's rows are segments: the doc_ids and lengths of some documents, and their
ids as blocks of coder.encode(), each reset and checksummed by itself, so that a reader can start at
any block.  Lengths of earlier segments, summed first by file and then across files, give each
document its place in the whole sequence.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import coder

SEGMENT_IDS = coder.BLOCK_IDS * coder.LANES
BATCH_BYTES = 8 << 20
REMEMBERED = 1_500_000
CHUNK_BYTES = 32 << 10
# Kinds of bytes: ASCII letters, digits, apostrophes, other punctuation, white space; beginnings of characters
# that may be white space; the rest of them; controls.
_LETTER, _DIGIT, _APOSTROPHE, _MARK, _SPACE, _DOUBT, _WIDE, _CONTROL = range(8)
_KIND = bytes(
    _SPACE if k == 32 or 9 <= k <= 13 else _CONTROL if k < 32 or k == 127 else _DOUBT if k in (0xC2, 0xE1, 0xE2, 0xE3) else _WIDE if k > 127
    else _LETTER if chr(k).isalpha() else _DIGIT if chr(k).isdigit() else _APOSTROPHE if k == 39 else _MARK for k in range(256)
)
# Of two kinds in a row (8 times the first plus the second): 1 if a unit may begin with the first, 2 with the second.
_CUT = np.zeros((8, 8), dtype=np.uint8)
_CUT[_SPACE, [_LETTER, _DIGIT, _APOSTROPHE, _MARK, _DOUBT, _WIDE]] = 1
_CUT[[_LETTER, _LETTER, _LETTER, _DIGIT, _DIGIT, _DIGIT, _MARK, _MARK], [_DIGIT, _APOSTROPHE, _MARK, _LETTER, _APOSTROPHE, _MARK, _LETTER, _DIGIT]] = 2
_CUT = _CUT.tobytes() + bytes(192)
_SCHEMA = "part int, seq int, n_ids long, doc_ids array<long>, lengths array<long>, blocks binary"


def _starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the units of texts begin: data holds the texts' bytes, each from an offset to the next.

    The tokenizer's split leaves the last white space before other text to that text, or by itself, and
    parts ASCII letters, digits and marks, but for an apostrophe and what follows it.  A unit is what
    lies between two such places.  Where it takes more to tell, there is no cut.
    """
    kinds = np.frombuffer(data.tobytes().translate(_KIND), dtype=np.uint8)
    cuts = np.frombuffer(((kinds[:-1] << 3) | kinds[1:]).tobytes().translate(_CUT), dtype=np.uint8)
    cut = np.zeros(len(data), dtype=bool)
    cut[1:] = cuts == 2
    cut[:-1] |= cuts == 1
    wide = np.flatnonzero((kinds[:-1] == _SPACE) & (kinds[1:] == _DOUBT))
    if len(wide):
        one, two, three = (data.take(wide + k, mode="clip") for k in (1, 2, 3))
        space = (one == 0xC2) & ((two == 0x85) | (two == 0xA0)) | (one == 0xE1) & ((two == 0x9A) | (two == 0xA0)) | (one == 0xE3) & (two == 0x80) & (three == 0x80)
        space |= (one == 0xE2) & (((two == 0x80) & ((three <= 0x8A) | (three == 0xA8) | (three == 0xA9) | (three == 0xAF))) | ((two == 0x81) & (three == 0x9F)))
        cut[wide[space]] = False
    full = offsets[1:] > offsets[:-1]
    last = offsets[1:][full] - 1
    cut[last[kinds[last] == _SPACE]] = False  # white space that ends a text stays whole
    cut[offsets[:-1][full]] = True
    return np.flatnonzero(cut)


class Tokenizer:
    """A tokenizer file of the tokenizers library with byte-level pre-tokenization.

    The split never joins white space with text before it, so a text's ids are those of its units
    (see _starts()), and each distinct unit goes through the library once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has a core
        self.library = Library.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        # A byte-level token has a character for each of its bytes.
        self.n_bytes = np.array([len(self.library.id_to_token(k) or "") for k in range(self.library.get_vocab_size())], dtype=np.int64)
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes | int, int] = {}
        self.ids = _binary(np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint32))

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        found = (e for a in range(0, len(texts), 20_000) for e in self.library.encode_batch_fast(texts[a : a + 20_000], add_special_tokens=False))
        return [np.array(e.ids, dtype=np.uint32) for e in found]

    def _coded(self, units: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
        """The ids of each unit, as bytes.

        Units go through the library joined, with a line feed before those that begin without white
        space, and the ids' bytes tell where each unit's begin.  Units of which it isn't plain that this
        changes nothing, and all where the bytes don't agree, go by themselves.
        """
        ends, data = _parts(units, np.uint8)
        first, second = data[ends[:-1]], data.take(ends[:-1] + 1, mode="clip")
        length = np.diff(ends)
        first, second = _KINDS[first], np.where(length > 1, _KINDS[second], _CONTROL)
        spaced = first == _SPACE
        begin = np.where(spaced, second, first)
        plain = (begin != _SPACE) & (begin != _CONTROL)
        for k in np.flatnonzero(begin == _DOUBT).tolist():
            plain[k] = not units[k].as_py().decode()[int(spaced[k])].isspace()
        joined = units.filter(pa.array(plain)) if not plain.all() else units
        feed = pa.array([b"", b"\n"], pa.large_binary()).take(pa.array((~spaced[plain]).astype(np.int8)))
        bounds, text = _parts(pc.binary_join_element_wise(feed, joined, pa.scalar(b"", pa.large_binary())), np.uint8)
        chunks = np.unique(np.append(np.searchsorted(bounds, np.arange(0, len(text), CHUNK_BYTES)), len(bounds) - 1))
        text = text.tobytes()
        found = self._each([text[bounds[a] : bounds[b]].decode() for a, b in zip(chunks[:-1], chunks[1:], strict=True)])
        ids = np.concatenate([*found, np.zeros(0, dtype=np.uint32)])
        reach = np.concatenate(([0], np.cumsum(self.n_bytes[ids])))
        begin = np.searchsorted(reach, bounds)
        skip = np.searchsorted(reach, bounds[:-1] + ~spaced[plain])
        if (reach[begin] != bounds).any() or (reach[skip] != bounds[:-1] + ~spaced[plain]).any() or begin[-1] != len(ids):
            found = self._each([u.decode() for u in units.to_pylist()])
            return _binary(np.cumsum([0] + [len(x) for x in found]), np.concatenate(found))
        kept = np.ones(len(ids), dtype=bool)
        kept[begin[:-1][skip > begin[:-1]]] = False  # a line feed is one id
        if (skip - begin[:-1]).max(initial=0) > 1:
            raise ValueError("the tokenizer has no token for a line feed")
        coded = _binary(np.concatenate(([0], np.cumsum(begin[1:] - skip))), ids[kept])
        if plain.all():
            return coded
        own = self._each([u.decode() for u in units.filter(pa.array(~plain)).to_pylist()])
        both = pa.concat_arrays([coded, _binary(np.cumsum([0] + [len(x) for x in own]), np.concatenate(own))])
        where = np.zeros(len(units), dtype=np.int64)
        where[plain], where[~plain] = np.arange(len(coded)), np.arange(len(coded), len(both))
        return both.take(pa.array(where))

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and each text's number; a null text has none."""
        texts = (pa.array(texts, type=pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())).fill_null("")
        offsets, data = _parts(texts, np.uint8)
        if not len(data):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(texts), dtype=np.int64)
        starts = _starts(data, offsets)
        bounds = np.append(starts, len(data))
        length = np.diff(bounds)
        # Units of up to seven bytes go by a number: the bytes, and how many.
        is_short = length <= 7
        padded = np.append(data, np.zeros(8, dtype=np.uint8))
        words = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
        n = length[is_short].astype(np.uint64)
        short = pa.array((words[starts[is_short]] & ((np.uint64(1) << (n << np.uint64(3))) - np.uint64(1))) | n << np.uint64(56)).dictionary_encode()
        units = _binary(bounds, data)
        long = (units.filter(pa.array(~is_short)) if not is_short.all() else units.slice(0, 0)).dictionary_encode()
        both = short.dictionary.to_pylist() + long.dictionary.to_pylist()
        place = np.array([self.place.get(u, -1) for u in both])
        new = np.flatnonzero(place < 0)
        if len(self.place) + len(new) > REMEMBERED:
            self.forget()
            new = np.arange(len(both))
        if len(new):
            place[new] = np.arange(len(self.place), len(self.place) + len(new))
            self.place.update(zip([both[k] for k in new.tolist()], place[new].tolist(), strict=True))
            k = np.searchsorted(new, len(short.dictionary))
            numbers = short.dictionary.to_numpy()[new[:k]]
            n = (numbers >> np.uint64(56)).astype(np.int64)
            spelled = numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[np.arange(8) < n[:, None]]
            names = _binary(np.concatenate(([0], np.cumsum(n))), spelled)
            self.ids = pa.concat_arrays([self.ids, self._coded(pa.concat_arrays([names, long.dictionary.take(pa.array(new[k:] - len(short.dictionary)))]))])
        of = np.empty(len(starts), dtype=np.int64)
        of[is_short] = place[: len(short.dictionary)][short.indices.to_numpy()]
        of[~is_short] = place[len(short.dictionary) :][long.indices.to_numpy()]
        ends, ids = _parts(self.ids.take(pa.array(of)), np.uint32)
        return ids, np.diff(ends[np.searchsorted(starts, offsets)])


_KINDS = np.frombuffer(_KIND, dtype=np.uint8)


def _binary(ends: np.ndarray, values: np.ndarray) -> pa.LargeBinaryArray:
    """An array of runs of values, from each end to the next."""
    bounds = ends.astype(np.int64) * values.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(values)])


def _parts(runs: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Ends and values of such an array (or of large strings)."""
    if not len(runs):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=kind)
    bounds = np.frombuffer(runs.buffers()[1], dtype=np.int64, count=len(runs) + 1, offset=8 * runs.offset)
    size = np.dtype(kind).itemsize
    if bounds[-1] == bounds[0]:
        return bounds - bounds[0], np.zeros(0, dtype=kind)
    return (bounds - bounds[0]) // size, np.frombuffer(runs.buffers()[2], dtype=kind, count=(bounds[-1] - bounds[0]) // size, offset=bounds[0])


_tokenizers: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer(path)
    return _tokenizers[path]


def write(docs: DataFrame, path: str, out: str, end_id: int, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode every text, append end_id to each document, and write the ids in order of doc_id to out.

    path names a tokenizer file that the tasks can read.  A null text is an empty one.  Rows without
    doc_id come first; rows of one doc_id are ordered by a hash of their text, and repeated rows each have their ids.  Other columns are ignored.  An empty table
    gives files without segments.
    """
    # By text where doc_ids are equal or missing: reruns agree, and such rows are no single task's.
    order = ["doc_id", F.xxhash64("text"), F.octet_length("text")]
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        tool, part, seq = tokenizer(path), TaskContext.get().partitionId(), 0
        held, lengths, names, size = [], [], [], 0

        def segment():
            nonlocal seq, size
            ids = np.concatenate(held)
            held.clear()
            row = pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_ids": pa.array([len(ids)], pa.int64()),
                 "doc_ids": pa.array([names], pa.list_(pa.int64())), "lengths": pa.array([lengths], pa.list_(pa.int64())), "blocks": pa.array([coder.encode(ids)], pa.binary())}
            )
            seq, size = seq + 1, 0
            lengths.clear()
            names.clear()
            return row

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
            a = 0
            while a < len(ids):
                b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + BATCH_BYTES, side="right")))
                found, counts = tool.encode(texts.slice(a, b - a))
                ends = np.cumsum(counts)
                # The end id goes behind every document.
                held.append(np.insert(found, ends, np.uint32(end_id)))
                lengths.extend((counts + 1).tolist())
                names.extend(ids[a:b])
                size += len(held[-1])
                a = b
                if size >= segment_ids:
                    yield segment()
        if names:
            yield segment()

    ordered.mapInArrow(run, _SCHEMA).write.parquet(out)


def read(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files: start counts the ids of all documents before."""
    rows = spark.read.schema(_SCHEMA).parquet(out)
    in_part = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    segments = rows.select("part", "seq", "n_ids").withColumn("base", F.coalesce(F.sum("n_ids").over(in_part), F.lit(0)))
    parts = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_base"))
    places = segments.join(parts, "part").select("part", "seq", (F.col("base") + F.col("part_base")).alias("base"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = coder.decode(row["blocks"])
                lengths = np.array(row["lengths"], dtype=np.int64)
                ends = np.cumsum(lengths)
                raw = ids.astype("<u4")
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, row["part"]), pa.int32()), pa.array(np.full(n, row["seq"]), pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                     pa.array(ends - lengths), pa.array(lengths), pa.array([zlib.crc32(raw[e - k : e].tobytes()) for k, e in zip(lengths, ends, strict=True)], pa.int64())],
                    names=["part", "seq", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    found = rows.mapInArrow(run, "part int, seq int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return found.join(places, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
