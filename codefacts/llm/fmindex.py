"""A compressed FM-index over word sequences, and the removal of repeated substrings with it.

`FmIndex` indexes the sequences of one shard: the Burrows-Wheeler transform of their words is kept
in a wavelet matrix (a bit vector for each bit of a word's number, with counts by 64-bit block), and
backward search narrows the rows of many patterns at once.

`remove_repeats` finds words that some earlier document has too.  Shards are cut by content: every
window of `window` words is keyed by the smallest hash among its runs of `anchor` words, so equal
windows have equal keys wherever they stand; consecutive windows with one key form a segment.  Only
keys that occur in two documents go on.  A key with very many distinct segments (a common run of
words) is refined: its windows are keyed by their two smallest hashes, then by four, and so on, which
equal windows share as well.  The distinct segments are dealt to shards by key, a shard is indexed, its segments are streamed against the index, and the matching statistics (cut off at
`window`) tell which windows occur under which smallest document.  The work and what is shuffled
grow with the input, not with shards times documents.

Windows are looked up by their words; which documents hold a segment goes by two 64-bit hashes of it
(its key and its words), with fixed constants.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save
from .words import Words, mix, sliding_min, slices

ANCHOR = 4
WORDS_PER_SHARD = 200_000
SEGMENTS_PER_KEY = 4_000
#: Windows in a segment at most, so that a key's segments are bounded in words.
SEGMENT_WINDOWS = 64
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 32 << 20, 64, 100_000


class FmIndex:
    """Backward search over numbered words; `owner` is a number kept for each sequence."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, owner: np.ndarray, alphabet: int):
        # Text: each sequence followed by a separator of its own kind, 0; words are 1..alphabet.
        n = int(lengths.sum() + len(lengths))
        ends = np.cumsum(lengths + 1) - 1
        text = np.zeros(n, dtype=np.int64)
        body = np.ones(n, dtype=bool)
        body[ends] = False
        text[body] = words
        self.n, self.alphabet = n, alphabet
        suffixes = self._suffix_array(text, ends)
        self.owner = np.repeat(owner, lengths + 1)[suffixes]
        bwt = text[suffixes - 1]
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=alphabet + 1))))
        self.levels = max(1, int(alphabet).bit_length())
        self.blocks, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bits = ((bwt >> level) & 1).astype(np.uint8)
            padded = np.zeros(-(-(n + 1) // 64) * 64, dtype=np.uint8)
            padded[:n] = bits
            block = np.packbits(padded, bitorder="little").view(np.uint64)
            self.blocks.append(block)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(block), dtype=np.int64))).astype(np.int32))
            self.zeros.append(n - int(bits.sum()))
            bwt = np.concatenate((bwt[bits == 0], bwt[bits == 1]))
        symbols = np.arange(alphabet + 1)
        self.first = self._descend(np.zeros(alphabet + 1, dtype=np.int64), symbols)

    @staticmethod
    def _suffix_array(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Prefix doubling; separators order by place, so a suffix never reaches past its sequence."""
        n = len(text)
        rank = text + len(ends)
        rank[ends] = np.arange(len(ends))
        _, rank = np.unique(rank, return_inverse=True)
        step = 1
        while True:
            key = rank * np.int64(n + 1)
            key[: n - step] += rank[step:] + 1
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            new = np.zeros(n, dtype=np.int64)
            new[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
            rank = new
            if rank[order[-1]] == n - 1:
                return order
            step *= 2
            if step >= n:
                return order

    def _descend(self, at: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            one = ((symbols >> (self.levels - 1 - k)) & 1).astype(bool)
            word = at >> 6
            inside = self.blocks[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = self.counts[k][word] + np.bitwise_count(inside)
            at = np.where(one, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before row `at`."""
        return self._descend(at, symbols) - self.first[symbols]

    def matching(self, words: np.ndarray, ends: np.ndarray, limit: int, indexed: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the word places `ends` of a stream: the length, cut off at `limit`, of the longest
        match that ends there, and its rows [low, high).  Where the stream is itself `indexed`, a
        match with a single row is the stream's own text: it is left there, as it can't grow less."""
        low = np.zeros(len(ends), dtype=np.int64)
        high = np.full(len(ends), self.n, dtype=np.int64)
        length = np.zeros(len(ends), dtype=np.int64)
        live = np.arange(len(ends))
        for back in range(limit):
            at = ends[live] - back
            live, at = live[at >= 0], at[at >= 0]
            c = words[at]
            known = (c > 0) & (c <= self.alphabet)
            live, c = live[known], c[known]
            lo = self.before[c] + self.rank(c, low[live])
            hi = self.before[c] + self.rank(c, high[live])
            found = lo < hi
            live = live[found]
            lo, hi = lo[found], hi[found]
            low[live], high[live] = lo, hi
            length[live] = back + 1
            if indexed:
                live = live[hi - lo > 1]
            if not len(live):
                break
        return length, low, high

    def least_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Smallest owner in each row range; the ranges must be equal or apart (as for one length)."""
        starts, back = np.unique(low, return_inverse=True)
        ends = np.zeros(len(starts), dtype=np.int64)
        ends[back] = high
        owners = np.append(self.owner, np.iinfo(np.int64).max)
        return np.minimum.reduceat(owners, np.stack((starts, ends), axis=1).reshape(-1))[::2][back]


def _runs(w: Words, key: np.ndarray, at: np.ndarray, span: np.ndarray, window: int):
    """Runs of windows (first words `at`, in order) with one key and span, of bounded length: key, hash
    of the words, first window, windows, span."""
    if not len(at):
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (span[1:] != span[:-1]))))
    place = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    starts = np.flatnonzero(place % SEGMENT_WINDOWS == 0)
    count = np.diff(np.append(starts, len(at)))
    first = at[starts]
    # Hash of a segment's words: sum of word hashes weighted by their place.
    with np.errstate(over="ignore"):
        power = np.full(len(w.hash) + 1, np.uint64(0xD6E8FEB86659FD93))
        power[0] = 1
        up = np.cumprod(power)
        power[1:] = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
        down = np.cumprod(power)
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(w.hash * up[:-1])))
        words = mix((sums[first + count + window - 1] - sums[first]) * down[first] + count.astype(np.uint64))
    return key[starts], words, first, count, span[starts]


def _all_grams(w: Words, anchor: int) -> np.ndarray:
    grams, at = w.grams(anchor)
    out = np.full(len(w.hash), np.iinfo(np.uint64).max, dtype=np.uint64)
    out[at] = grams
    return out


def _segments(w: Words, window: int, anchor: int):
    """Runs of windows with one key: key, hash of the words, first window, windows, text row."""
    n = max(0, len(w.hash) - window + 1)
    key = sliding_min(_all_grams(w, anchor), window - anchor + 1)[:n]
    at = np.flatnonzero(w.doc[:n] == w.doc[window - 1 :]) if n else np.zeros(0, dtype=np.int64)
    return _runs(w, key[at], at, w.doc[at], window)


def _occurrences(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(key, seg, doc_id, at, n): the segments of every document; `at` is the first window's word."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for a, _, data, offsets in slices(batch.column("text")):
                w = Words(data, offsets)
                key, seg, first, count, row = _segments(w, window, anchor)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(ids[a + row].astype(np.int64)),
                     pa.array((first - w.first[row]).astype(np.int32)), pa.array(count.astype(np.int32))],
                    names=["key", "seg", "doc_id", "at", "n"],
                )

    return docs.where("doc_id is not null").mapInArrow(run, "key long, seg long, doc_id long, at int, n int")


def _refined(docs: DataFrame, window: int, anchor: int, level: int) -> DataFrame:
    """The segments `spans` of documents, cut anew: windows keyed by their `level` smallest hashes."""
    width = window - anchor + 1

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            spans = batch.column("spans")
            cuts = spans.offsets.to_numpy()
            span_at, span_n = (spans.values.field(c).to_numpy() for c in ("at", "n"))
            for a, b, data, offsets in slices(batch.column("text")):
                w = Words(data, offsets)
                grams = _all_grams(w, anchor)
                own = slice(cuts[a], cuts[b])
                row = np.repeat(np.arange(b - a), np.diff(cuts[a : b + 1]))
                n = np.minimum(span_n[own], np.maximum(0, w.count[row] - window + 1 - span_at[own]))  # all, if a doc_id names one text
                span = np.repeat(np.arange(len(n)), n)
                at = (w.first[row] + span_at[own])[span] + np.arange(len(span)) - np.repeat(np.cumsum(n) - n, n)
                key = np.zeros(len(at), dtype=np.uint64)
                for c in range(0, len(at), 1 << 16):
                    near = np.sort(grams[at[c : c + (1 << 16), None] + np.arange(width)], axis=1)
                    new = np.concatenate((np.ones((len(near), 1), dtype=bool), near[:, 1:] != near[:, :-1]), axis=1)
                    new &= np.cumsum(new, axis=1) <= level
                    part = key[c : c + (1 << 16)]
                    with np.errstate(over="ignore"):
                        for k in range(width):
                            part[:] = np.where(new[:, k], mix(part * np.uint64(0x9E3779B97F4A7C15) + near[:, k]), part)
                key, seg, first, count, of = _runs(w, key, at, span, window)
                r = row[of]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(ids[a + r].astype(np.int64)),
                     pa.array((first - w.first[r]).astype(np.int32)), pa.array(count.astype(np.int32))],
                    names=["key", "seg", "doc_id", "at", "n"],
                )

    return docs.mapInArrow(run, "key long, seg long, doc_id long, at int, n int")


def _texts(docs: DataFrame, window: int) -> DataFrame:
    """The words of the distinct segments, cut out of a document that has them."""

    def run(batches):
        for batch in batches:
            spans, ids = batch.column("spans"), batch.column("doc_id").to_numpy(zero_copy_only=False)
            cuts = spans.offsets.to_numpy()
            key, seg, at, n = (spans.values.field(c) for c in ("key", "seg", "at", "n"))
            for a, b, data, offsets in slices(batch.column("text")):
                w = Words(data, offsets, hashes=False)
                own = slice(cuts[a], cuts[b])
                row = np.repeat(np.arange(b - a), np.diff(cuts[a : b + 1]))
                first, last = at.to_numpy()[own], at.to_numpy()[own] + n.to_numpy()[own] + window - 2
                there = np.flatnonzero(last < w.count[row])  # all, if a doc_id names one text
                row, first, last = row[there], w.first[row[there]] + first[there], w.first[row[there]] + last[there]
                starts, ends = w.starts[first], w.ends[last]
                out = np.concatenate(([0], np.cumsum(ends - starts)))
                raw = data[np.arange(out[-1]) + np.repeat(starts - out[:-1], ends - starts)]
                words = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(out.astype(np.int32)), pa.py_buffer(raw)])
                there = pa.array(there + cuts[a])
                yield pa.RecordBatch.from_arrays([key.take(there), seg.take(there), pa.array(ids[a + row].astype(np.int64)), words], names=["key", "seg", "owner", "words"])

    return docs.mapInArrow(run, "key long, seg long, owner long, words binary")


def _searched(window: int):
    """One shard: index its segments, stream them, and return the smallest owner of each window."""

    def run(shard: pa.Table) -> pa.Table:
        lists = [x.split() for x in shard.column("words").to_pylist()]  # at the white space that parts words
        lengths = np.array([len(x) for x in lists], dtype=np.int64)
        coded = pa.array([x for words in lists for x in words], type=pa.binary()).dictionary_encode()
        words = coded.indices.to_numpy().astype(np.int64) + 1
        owner = shard.column("owner").to_numpy()
        index = FmIndex(words, lengths, owner, len(coded.dictionary))
        counts = lengths - window + 1
        segment = np.repeat(np.arange(len(lengths)), counts)
        inner = np.arange(len(segment)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = (np.cumsum(lengths) - lengths)[segment] + inner
        length, low, high = index.matching(words, starts + window - 1, window, indexed=True)
        least = owner[segment]
        hit = length >= window
        if hit.any():
            least[hit] = index.least_owner(low[hit], high[hit])
        offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
        return pa.Table.from_arrays(
            [shard.column("key").combine_chunks(), shard.column("seg").combine_chunks(), pa.ListArray.from_arrays(pa.array(offsets), pa.array(least))],
            names=["key", "seg", "least"],
        )

    return run


def _kept(window: int, texts: bool, keep: tuple[str, ...] = ()):
    """Documents with the starts of their repeated windows -> what is kept of them."""

    def run(batches):
        for batch in batches:
            ids, starts = batch.column("doc_id"), batch.column("starts")
            for a, b, data, offsets in slices(batch.column("text")):
                w = Words(data, offsets, hashes=False)
                stays = np.ones(len(w.starts), dtype=bool)
                for r in range(a, b):
                    if starts[r].is_valid and len(starts[r]):
                        n = int(w.count[r - a])
                        at = starts[r].values.to_numpy()
                        at = at[at + window <= n]
                        edge = np.zeros(n + 1, dtype=np.int64)
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + window, -1)
                        stays[w.first[r - a] : w.first[r - a + 1]] = np.cumsum(edge[:n]) == 0
                # Kept words, each with the byte after it, which becomes the space between two.
                size = (w.ends - w.starts)[stays] + 1
                out = np.concatenate(([0], np.cumsum(size)))
                raw = np.append(data, np.uint8(32))[np.arange(out[-1]) + np.repeat(w.starts[stays] - out[:-1], size)]
                raw[out[1:] - 1] = 32
                upto = np.concatenate(([0], np.cumsum(stays)))[w.first]  # kept words before each text
                removed, digest, kept_text = w.count - np.diff(upto), [], []
                for r in range(b - a):
                    kept = raw[out[upto[r]] : max(out[upto[r]], out[upto[r + 1]] - 1)].tobytes()
                    digest.append(hashlib.sha256(kept).hexdigest())
                    if texts:
                        kept_text.append(kept.decode("utf-8"))
                columns = [ids.slice(a, b - a), pa.array(w.count.astype(np.int64)), pa.array(removed, type=pa.int64()), pa.array(digest, type=pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if texts:
                    whole = batch.column("text").slice(a, b - a)
                    columns.append(pc.if_else(pc.and_(whole.is_valid(), pa.array(removed > 0)), pa.array(kept_text, type=whole.type), whole).cast(pa.string()))
                    names.append("kept_text")
                columns += [batch.column(c).slice(a, b - a) for c in keep]
                names += keep
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def remove_repeats(docs: DataFrame, window: int = 13, anchor: int = ANCHOR, with_text: bool = False, keep: tuple[str, ...] = (), words_per_shard: int = WORDS_PER_SHARD, segments_per_key: int = SEGMENTS_PER_KEY) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text, and `keep` columns): a row for each row of docs.

    A word goes if a window of `window` consecutive words that covers it also starts in a document
    with a smaller doc_id; windows are judged on the input.  Kept words are joined by one space.
    Words are maximal runs of bytes other than 0x20 and 0x09-0x0D.  A null or empty text has no
    words (its kept_text is null or empty), and kept_text is the text as it was where nothing goes;
    a document shorter than the window keeps all.  A row
    without doc_id keeps all and repeats nothing; repeated rows of one doc_id repeat nothing of each
    other.  A doc_id should name one text: if it names several, what goes from one goes by place
    from all.  Other columns are ignored.  An empty table gives an empty result.

    A key with more than `segments_per_key` distinct segments (a very common run of words) is refined
    (two, four, eight, ... least hashes) until it has fewer or all hashes of its windows are in the key; windows that even then share a key
    differ by the order of their words only.  Segments are bounded in words, and so are shards.
    """
    spark = docs.sparkSession
    name = f"codefacts_{uuid.uuid4().hex}"
    # Kept by doc_id, so that the texts are never shuffled again: they are read three times.
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-size // BUCKET_BYTES)))
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep).write.bucketBy(buckets, "doc_id").saveAsTable(name)
    whole = spark.table(name)
    kept_docs = whole.select("doc_id", "text")
    found = _occurrences(kept_docs, window, anchor)

    def repeated_keys(rows: DataFrame) -> DataFrame:
        shared = rows.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("key")
        return rows.join(shared, "key")

    occurs = save(repeated_keys(found), "occurrences")

    def distinct(rows: DataFrame) -> DataFrame:
        return rows.groupBy("key", "seg").agg(F.min(F.struct("doc_id", "at", "n")).alias("of"))

    # Only crowded keys go from level to level; what is settled stays in the tables it was written to.
    settled, level, most = [], 1, window - anchor + 1
    while level < most:
        level = min(2 * level, most)
        crowded = distinct(occurs).groupBy("key").agg(F.count("*").alias("segments")).where(F.col("segments") > segments_per_key).select("key")
        crowded = save(crowded, "crowded")
        if crowded.isEmpty():
            break
        hot = occurs.join(crowded, "key").groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
        settled.append(occurs.join(crowded, "key", "left_anti"))
        occurs = save(repeated_keys(save(_refined(kept_docs.join(hot, "doc_id"), window, anchor, level), "refined")), "occurrences")
    occurs = reduce(DataFrame.unionByName, settled, occurs)
    by_doc = (
        distinct(occurs).select("key", "seg", "of.*").groupBy("doc_id")
        .agg(F.collect_list(F.struct("key", "seg", "at", "n")).alias("spans"))
    )
    segments = save(_texts(kept_docs.join(by_doc, "doc_id"), window), "segments")
    words = segments.agg(F.sum(F.octet_length("words")).alias("n")).first()["n"] or 0
    shards = max(1, -(-words // (6 * words_per_shard)))
    dealt = segments.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    least = save(dealt.groupBy("shard").applyInArrow(_searched(window), "key long, seg long, least array<long>"), "least")
    repeated = (
        occurs.join(least, ["key", "seg"])
        .withColumn("starts", F.filter(F.transform("least", lambda m, i: F.when(m < F.col("doc_id"), F.col("at") + i)), lambda x: x.isNotNull()))
        .where(F.size("starts") > 0)
        .groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))
    )
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    schema += "".join(f", `{c}` {kind}" for c, kind in whole.select(*keep).dtypes)
    return whole.join(repeated, "doc_id", "left").select("doc_id", "text", "starts", *keep).mapInArrow(_kept(window, with_text, keep), schema)
