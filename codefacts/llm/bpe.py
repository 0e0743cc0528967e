"""Byte-level BPE by DuckDB's recursive queries inside each partition.

A partition's texts are cut by the split pattern; its distinct pieces go to DuckDB as rows (word,
position, token), joined again and again with the merge table: each step contracts, in every word,
the leftmost pair of the smallest rank, until no pair of the word is in the table.  Decoding joins
the tokens with the vocabulary and aggregates their bytes in order of position.  Pieces are encoded
once for each batch or found in the worker's bounded memory of earlier ones, and whole texts are put
together from them with numpy.

Two exact short cuts keep long pieces cheap.  A piece is cut first wherever no token of the vocabulary
that occurs in it lies across the place, as no contraction can ever reach over it.  And what is still
long has all occurrences of its smallest rank contracted in one step, up to the first that brings a
pair of a smaller rank beside it: one contraction after the other would do the same.  A query keeps the rows of all its steps, so queries get words of a bounded sum of squares,
and long words a bounded number of steps at a time.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import tempfile
from itertools import chain

import ahocorasick
import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words up to this length are contracted a pair a step; rows of all steps that one query may hold.
SHORT, ROWS = 1_000, 2_000_000
#: Pieces above this length are cut into words where no token reaches across.
CUT = 32
REMEMBERED, REMEMBERED_BYTES = 700_000, 64 << 20
SLICE_BYTES = 4 << 20

_STEPS = """
with recursive step(w, pos, tok, round) as (
    select w, pos, tok, 0 from pieces
    union all
    (
        with pairs as (
            select w, pos, tok, round,
                   lead(tok) over (order by w, pos) as next_tok, lead(pos) over (order by w, pos) as next_pos, lead(w) over (order by w, pos) as next_w
            from step
        ), best as (
            select w, min(m.merged::bigint * 4294967296 + p.pos) as least, arg_min(p.next_pos, m.merged::bigint * 4294967296 + p.pos) as gone
            from pairs p join merges m on p.tok = m.lft and p.next_tok = m.rgt
            where w = next_w
            group by w
        )
        select p.w, p.pos, case when p.pos = b.least % 4294967296 then (b.least // 4294967296)::int else p.tok end, p.round + 1
        from pairs p join best b on p.w = b.w
        where p.pos <> b.gone
    )
), last as (select w, max(round) as round from step group by w)
"""
#: The same for long words: all occurrences of the smallest rank, every other one of a run, in one
#: step, up to the first that brings a pair of a smaller rank beside it.  At most {steps} steps.
_STEPS_OF_LONG = """
with recursive step(w, pos, tok, round) as (
    select w, pos, tok, 0 from pieces
    union all
    (
        with pairs as (
            select w, pos, tok, round, row_number() over word as place, lead(tok) over word as next_tok, lead(tok, 2) over word as third, lag(tok) over word as before
            from step where round < {steps} window word as (partition by w order by pos)
        ), ranked as (
            select p.*, m.merged, min(m.merged) over (partition by p.w) as least
            from pairs p left join merges m on p.tok = m.lft and p.next_tok = m.rgt
        ), runs as (
            select *, max(case when merged is distinct from least then place else 0 end) over (partition by w order by pos) as run_from
            from ranked where least is not null
        ), found as (
            select *, coalesce(merged = least, false) and (place - run_from) % 2 = 1 as hit from runs
        ), beside as (
            select *, case when lag(hit, 2, false) over (partition by w order by pos) then least else before end as left_tok from found
        ), checked as (
            select b.*, min(case when b.hit and (x.merged < b.least or y.merged < b.least) then b.place end) over (partition by b.w) as last_place
            from beside b left join merges x on b.hit and x.lft = b.left_tok and x.rgt = b.least left join merges y on b.hit and y.lft = b.least and y.rgt = b.third
        ), chosen as (
            select *, hit and place <= coalesce(last_place, place) as contracts from checked
        ), after as (
            select *, lag(contracts, 1, false) over (partition by w order by pos) as gone from chosen
        )
        select w, pos, case when contracts then least else tok end, round + 1 from after where not gone
    )
), last as (select w, max(round) as round from step group by w)
"""
_STATE = "select s.w, s.pos, s.tok, s.round from step s join last l on s.w = l.w and s.round = l.round"
_RESULT = """
select s.w, list(s.tok order by s.pos) as ids, string_agg(v.hex, '' order by s.pos) as decoded
from ({state}) s join vocabulary v on v.tok = s.tok
group by s.w order by s.w
"""
_HEX = np.zeros(256, dtype=np.uint8)
_HEX[list(b"0123456789abcdef")] = np.arange(16)


def read_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary of a rank file: lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    """Encodes and decodes distinct pieces; kept by a worker from batch to batch."""

    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        self.pattern = regex.compile(pattern)
        self.ranks = read_ranks(path)
        self.base = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        left, right, merged = [], [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self.tokens = ahocorasick.Automaton()
        for token in self.ranks:
            if len(token) > 1:
                self.tokens.add_word(token.decode("latin-1"), len(token))
        self.tokens.make_automaton()
        self.spill = tempfile.TemporaryDirectory()  # this worker's own; nothing is read from it elsewhere
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "250MB", "temp_directory": self.spill.name})
        int32 = pa.int32()
        self._table("merges", {"lft": pa.array(left, int32), "rgt": pa.array(right, int32), "merged": pa.array(merged, int32)})
        self._table("vocabulary", {"tok": pa.array(list(self.ranks.values()), int32), "hex": pa.array([b.hex() for b in self.ranks])})
        self.forget()

    def close(self) -> None:
        self.db.close()
        self.spill.cleanup()

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("incoming", pa.table(columns))
        self.db.execute(f"create or replace temp table {name} as select * from incoming")
        self.db.unregister("incoming")

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        # Ids and decoded bytes of all pieces one after the other, and where each piece's end.
        self.ids, self.id_ends = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)
        self.raw, self.raw_ends = np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)

    def _words(self, piece: bytes) -> list[bytes]:
        """The piece, cut wherever no token that occurs in it lies across."""
        across = np.zeros(len(piece) + 1, dtype=np.int32)
        ends, lengths = [], []
        for end, length in self.tokens.iter(piece.decode("latin-1")):
            ends.append(end)
            lengths.append(length)
        ends, lengths = np.array(ends, dtype=np.int64), np.array(lengths, dtype=np.int64)
        np.add.at(across, ends - lengths + 2, 1)  # a token over bytes a..e lies across the places a + 1 to e
        np.add.at(across, ends + 1, -1)
        cuts = np.flatnonzero(np.cumsum(across)[:-1] == 0).tolist()  # the place before the first byte is one
        return [piece[a:b] for a, b in zip(cuts, [*cuts[1:], len(piece)], strict=True)]

    def _rows(self, words: list[bytes]) -> dict:
        lengths = np.array([len(p) for p in words])
        w = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        pos = (np.arange(len(w)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        return {"w": pa.array(w), "pos": pa.array(pos), "tok": pa.array(self.base[np.frombuffer(b"".join(words), dtype=np.uint8)])}

    def _contracted(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words of similar length and their ends, decoded bytes and their ends."""
        rows = self._rows(words)
        self._table("pieces", rows)
        if len(words[-1]) <= SHORT:
            found = self.db.sql(_STEPS + _RESULT.format(state=_STATE)).to_arrow_table()
        else:
            self.db.execute("create or replace temp table done as select w, pos, tok from pieces where false")
            while left := self.db.sql("select count(*) from pieces").fetchall()[0][0]:
                steps = max(1, ROWS // left)
                self.db.execute(f"create or replace temp table state as {_STEPS_OF_LONG.format(steps=steps)} {_STATE}")
                self.db.execute(f"insert into done select w, pos, tok from state where round < {steps}")
                self.db.execute(f"create or replace temp table pieces as select w, pos, tok from state where round = {steps}")
            found = self.db.sql(_RESULT.format(state="select * from done")).to_arrow_table()
            self.db.execute("drop table done")
            self.db.execute("drop table state")
        ids, decoded = found.column("ids").combine_chunks(), found.column("decoded").cast(pa.large_string()).combine_chunks()
        _, offsets, digits = decoded.buffers()
        ends = np.frombuffer(offsets, dtype=np.int64)[decoded.offset : decoded.offset + len(words) + 1]
        digits = _HEX[np.frombuffer(digits, dtype=np.uint8)[ends[0] : ends[-1]]]
        raw_ends = (ends - ends[0]) // 2
        id_ends = ids.offsets.to_numpy().astype(np.int64)
        return ids.flatten().to_numpy().astype(np.uint32), id_ends - id_ends[0], digits[::2] << 4 | digits[1::2], raw_ends

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As _contracted, for any words: queries of words of similar length, short ones together."""
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        parts, chunk, rows = [], [], 0
        for k in order:
            n = len(words[k])
            # Rows of all steps; a long word runs a few steps at a time.
            cost = n * n // 2 + n if n <= SHORT else n * 20
            if chunk and (rows + cost > ROWS or len(chunk[-1]) <= SHORT < n):
                parts.append(self._contracted(chunk))
                chunk, rows = [], 0
            chunk.append(words[k])
            rows += cost
        if chunk:
            parts.append(self._contracted(chunk))
        ids, id_ends = _joined([(p[0], p[1]) for p in parts], np.uint32)
        raw, raw_ends = _joined([(p[2], p[3]) for p in parts], np.uint8)
        back = np.empty(len(words), dtype=np.int64)
        back[order] = np.arange(len(words))
        return *_taken(ids, id_ends, back), *_taken(raw, raw_ends, back)

    def learn(self, pieces: list[str]) -> None:
        """Make every piece known."""
        new = [p for p in pieces if p not in self.place]
        if len(self.place) + len(new) > self.remembered or len(self.raw) > REMEMBERED_BYTES:
            self.forget()
            new = pieces
        number: dict[bytes, int] = {}  # distinct words
        of_piece, counts = [], np.ones(len(new), dtype=np.int64)
        for k, piece in enumerate(new):
            b = piece.encode()
            if len(b) <= CUT or b in self.ranks:
                of_piece.append(number.setdefault(b, len(number)))
            else:
                words = self._words(b)
                of_piece.extend(number.setdefault(x, len(number)) for x in words)
                counts[k] = len(words)
        if not new:
            return
        # A word that is a token needs no step.
        rank = np.fromiter((self.ranks.get(b, -1) for b in number), dtype=np.int64, count=len(number))
        whole, rest = np.flatnonzero(rank >= 0), np.flatnonzero(rank < 0)
        words = list(number)
        tokens = [words[k] for k in whole]
        ids, id_ends, raw, raw_ends = self._encoded([words[k] for k in rest])
        ids, id_ends = _joined([(rank[whole].astype(np.uint32), np.arange(len(whole) + 1)), (ids, id_ends)], np.uint32)
        token_ends = np.concatenate(([0], np.cumsum([len(b) for b in tokens], dtype=np.int64)))
        raw, raw_ends = _joined([(np.frombuffer(b"".join(tokens), dtype=np.uint8), token_ends), (raw, raw_ends)], np.uint8)
        at = np.empty(len(words), dtype=np.int64)
        at[np.concatenate((whole, rest))] = np.arange(len(words))
        index, ends = at[np.array(of_piece, dtype=np.int64)], np.concatenate(([0], np.cumsum(counts)))
        n = len(self.place)
        self.place.update(zip(new, range(n, n + len(new)), strict=True))
        for values, bounds, name in ((ids, id_ends, "ids"), (raw, raw_ends, "raw")):
            own, own_ends = _taken(values, bounds, index)
            old, old_ends = getattr(self, name), getattr(self, f"{name.removesuffix('s')}_ends")
            setattr(self, name, np.concatenate((old, own)))
            setattr(self, f"{name.removesuffix('s')}_ends", np.concatenate((old_ends, old_ends[-1] + own_ends[ends[1:]])))

    def texts(self, texts: list[str]):
        """For each text its number of ids, their sha256, and that of the decoded bytes, and the ids."""
        split = [self.pattern.findall(t) for t in texts]
        bounds = np.concatenate(([0], np.cumsum([len(s) for s in split], dtype=np.int64)))
        self.learn(list(dict.fromkeys(chain.from_iterable(split))))
        index = np.fromiter(map(self.place.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=bounds[-1])
        ids, id_ends = _taken(self.ids, self.id_ends, index)
        raw, raw_ends = _taken(self.raw, self.raw_ends, index)
        id_at, raw_at = id_ends[bounds], raw_ends[bounds]
        for k in range(len(texts)):
            own = ids[id_at[k] : id_at[k + 1]]
            yield len(own), hashlib.sha256(own.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(raw[raw_at[k] : raw_at[k + 1]].tobytes()).hexdigest(), own


def _joined(parts: list[tuple[np.ndarray, np.ndarray]], kind) -> tuple[np.ndarray, np.ndarray]:
    """Values of several (values, ends from 0) one after the other, and all their ends."""
    values, ends, last = [np.zeros(0, dtype=kind)], [np.zeros(1, dtype=np.int64)], 0
    for v, e in parts:
        values.append(v)
        ends.append(e[1:] + last)
        last += len(v)
    return np.concatenate(values), np.concatenate(ends)


def _taken(values: np.ndarray, ends: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the items `index`, one after the other, and their ends from 0."""
    length = ends[index + 1] - ends[index]
    total = np.concatenate(([0], np.cumsum(length)))
    return values[np.arange(total[-1]) + np.repeat(ends[index] - total[:-1], length)], total


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = False, remembered: int | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids): a row for each row of docs.

    path names a rank file and pattern its split pattern, both readable by the tasks.  Each match of
    the pattern is encoded by itself: as one id where it is in the vocabulary, else by contracting
    the leftmost pair of the smallest rank.  A worker keeps its encoder and the pieces it has seen for
    the next task; with `remembered` given, it keeps at most so many and lets go of all when the task
    ends, which costs time and saves memory where other stages follow.  Null and empty texts have no ids.  Repeated rows each
    give a row.  Other columns are ignored.  An empty table gives an empty result.
    """

    def run(batches):
        tool = encoder(path, pattern) if remembered is None else Encoder(path, pattern, remembered)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            sizes = np.cumsum([len(t.as_buffer() or b"") if t.is_valid else 0 for t in texts])
            a = 0
            while a < len(texts):
                b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + SLICE_BYTES, side="right")))
                rows = list(tool.texts([t or "" for t in texts.slice(a, b - a).to_pylist()]))
                columns = [ids.slice(a, b - a), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])]
                if with_ids:
                    columns.append(pa.array([r[3].astype(np.int32) for r in rows], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)
                a = b
        if remembered is not None:
            tool.close()
            del tool
            gc.collect()
            pa.default_memory_pool().release_unused()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
