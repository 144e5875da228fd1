"""SentencePiece encoding and decoding by a relational lattice.

A text is cut into units that no piece crosses: a run of spaces with the word after it, and line ends and
tabs by themselves; these are cut again wherever two characters meet that stand side by side in no piece, as
a word and its full stop mostly do, so that a word is one unit whatever follows it. The lattice is built once for each different unit of the corpus: its substrings of at
most the longest piece's length are exploded and met with the piece table in an equality join, the edges
are grouped by unit, and a higher-order aggregate folds them. There are two folds over the same lattice:

BEST_PATH, for unigram models: a Viterbi fold over the end places; the largest sum of piece scores wins.
MERGES, for BPE models, whose scores are ranks of merges and no log-probabilities (their largest sum is
another cut of half of all words): edges come by score and then place, and an edge is taken if the pieces
so far cut it exactly once. One pass gives what merging the best pair again and again does, as long as
each piece is made of two pieces of higher scores (a test goes through all of them). Pieces of spaces only
have one and the same lowest score and no such order: they are left out of the lattice, and units with two
spaces or more in front, which are few, are folded where they stand.

Documents are read in chunks, and units that come again and again are counted first. The ids of the
commonest ones, a bounded table, go to every task; a chunk keeps numbers instead of its units, and asks only
for the ids of its other units, each once. A chunk's ids are gathered from both.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm.anchors import _mix as mix
from siftstone.llm.columns import MIB, chunk_documents, giving_back, id_column, open_chunk, pack, shared_checkpoint, unpack

SPACE = "▁"
#: Added to the smallest score for a character that no piece has.
UNKNOWN_PENALTY = 10.0
BEST_PATH, MERGES = "best_path", "merges"
#: Longer units are folded where they stand: their lattice is no small group, and their cuts are no bits of one number.
UNIT_BYTES = 60
CHUNK_BYTES = 4 * MIB
#: A place of a unit asks for pieces of fewer characters than HEAD, and of those others that begin as it does, in so many characters, for their sizes.
HEAD = 3
#: Units, of up to UNIT_BYTES bytes, that the table of the commonest ones holds at most, whatever the corpus.
COMMON = 1 << 18
#: A unit is common only if one partition has it so many times.
AGAIN = 4
_LEVELS, _COMMON_BLOCKS = 8, 16
#: Bytes of text whose units' keys are worked out at a time, so that they stay in the processor's cache.
_PIECE = 1 << 17
#: Units of more bytes have a cryptographic digest as their key.
_KEY_BYTES = 64
_ROWS, _ANSWER_ROWS, _GATHER, _COUNTED = 1 << 15, 1 << 17, 1 << 18, 1 << 18


@dataclass(frozen=True)
class PieceTable:
    """Pieces with plain spaces, their ids and scores; byte_ids: the ids of the 256 byte pieces, in order; fold: BEST_PATH or MERGES."""

    pieces: tuple[str, ...]
    ids: tuple[int, ...]
    scores: tuple[float, ...]
    byte_ids: tuple[int, ...]
    fold: str = BEST_PATH

    @staticmethod
    def load(path: str, fold: str) -> PieceTable:
        """Reads a .model file; fold says what kind of model it is. It must have byte pieces, so that every text can be written."""
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        byte_ids = {int(model.id_to_piece(i)[3:-1], 16): i for i in every if model.is_byte(i)}
        if len(byte_ids) != 256:
            raise ValueError(f"{path} has {len(byte_ids)} byte pieces of 256")
        plain = [i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        pieces = tuple(model.id_to_piece(i).replace(SPACE, " ") for i in plain)
        crossing = [p for p in pieces if " " in p.lstrip(" ") or "\n" in p or "\t" in p]
        if crossing:
            raise ValueError(f"{path} has pieces that cross words or lines, such as {crossing[0]!r}")
        return PieceTable(pieces, tuple(plain), tuple(float(model.get_score(i)) for i in plain), tuple(byte_ids[b] for b in range(256)), fold)

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.pieces))

    @property
    def unknown_score(self) -> float:
        return min(self.scores) - UNKNOWN_PENALTY

    def merged_run(self, n: int) -> list[int]:
        """Ids of n spaces that are merged by themselves, the first pair that is a piece first."""
        known, out = {len(p): i for p, i in zip(self.pieces, self.ids) if not p.strip(" ")}, []
        for _ in range(n):
            out.append(1)
            while len(out) > 1 and out[-2] + out[-1] in known:
                out[-2:] = [out[-2] + out[-1]]
        return [known[k] for k in out] if 1 in known else []

    def single(self) -> dict[str, list[int]]:
        """Ids of the characters that are pieces."""
        return {p: [i] for p, i in zip(self.pieces, self.ids) if len(p) == 1}

    def lattice(self) -> list[tuple[str, int, float]]:
        """The pieces that edges are made of. MERGES needs none of single characters."""
        every = list(zip(self.pieces, self.ids, self.scores))
        if self.fold == BEST_PATH:
            return every
        runs = [s for p, _, s in every if not p.strip(" ")]
        others = [x for x in every if x[0].strip(" ")]
        if runs and max(runs) >= min(s for p, _, s in others if len(p) > 1):
            raise ValueError("pieces of spaces only must have the lowest scores")
        return [x for x in others if len(x[0]) > 1]

    def joints(self) -> np.ndarray:
        """For two bytes, the first one times 256 and the second one: does a character end and another one begin between them, with no piece across?"""
        cuts = np.ones((256, 256), bool)
        cuts[:, 0x80:0xC0] = False  # the second byte goes on with a character
        for piece in self.pieces:
            raw = np.frombuffer(piece.encode(), np.uint8)
            cuts[raw[:-1], raw[1:]] = False
        return cuts.reshape(-1)

    def texts(self) -> dict[int, bytes]:
        return {i: p.encode() for i, p in zip(self.ids, self.pieces)} | {i: bytes([b]) for b, i in enumerate(self.byte_ids)}


def best_path(unit: str, known: dict[str, tuple[int, float]], longest: int, unknown_score: float) -> list[int | str]:
    """BEST_PATH over one long unit: ids of its pieces, and characters that no piece has."""
    best, back = [0.0], [(0, None)]
    for end in range(1, len(unit) + 1):
        top = None
        for start in range(max(0, end - longest), end):
            hit = known.get(unit[start:end])
            if hit is None and start == end - 1:
                hit = (None, unknown_score)
            if hit is not None and (top is None or best[start] + hit[1] > top[0]):
                top = (best[start] + hit[1], start, hit[0])
        best.append(top[0])
        back.append(top[1:])
    out, end = [], len(unit)
    while end:
        start, piece = back[end]
        out.append(unit[start:end] if piece is None else piece)
        end = start
    return out[::-1]


def merges(unit: str, known: dict[str, tuple[int, float]], longest: int) -> list[int | str]:
    """MERGES over one long unit: ids, and the characters that stay single. known: pieces of two characters or more."""
    edges = []
    for start in range(len(unit) - 1):
        for end in range(start + 2, min(len(unit), start + longest) + 1):
            if hit := known.get(unit[start:end]):
                edges.append((-hit[1], start, end))
    until = list(range(1, len(unit) + 1))  # where the piece that starts at a place ends; 0 within a piece
    for _, start, end in sorted(edges):
        middle = until[start]
        if 0 < middle < end and until[middle] == end:
            until[start], until[middle] = end, 0
    out, at = [], 0
    while at < len(unit):
        part = unit[at : until[at]]
        out.append(known[part][0] if len(part) > 1 else part)
        at = until[at]
    return out


def fold_unit(unit: str, table: PieceTable, known: dict[str, tuple[int, float]]) -> list[int | str]:
    """The table's fold over one unit of any length, in memory that its length bounds: ids, and single characters. known: the table's lattice."""
    if table.fold == BEST_PATH:
        return best_path(unit, known, table.longest, table.unknown_score)
    path = merges(unit, known, table.longest)
    lead = path.count(" ")
    return table.merged_run(lead) + path[lead:] if lead > 1 else path


def encode_units(units: DataFrame, table: PieceTable, unit_col: str = "unit") -> DataFrame:
    """unit and path (array of int) for units, which must be different texts: ids of pieces, -1 - start for single characters (from 0) that are no edge.

    MERGES leaves out units without edges: all their characters are single; its units have one space in front at most. BEST_PATH: of equal sums, the one whose last piece is longest at each place. MERGES takes units of up
    to UNIT_BYTES characters; of equal scores, the first place. If units are dealt by unit already,
    nothing is dealt again. The piece table is broadcast: it has as many rows as the vocabulary, whatever
    the corpus.
    """
    spark = units.sparkSession
    if table.fold == MERGES:
        pieces = F.broadcast(spark.createDataFrame(_edge_codes(table), "piece string, code long"))
    else:
        pieces = F.broadcast(spark.createDataFrame(table.lattice(), "piece string, id int, score double"))
    n, start, size = F.length("unit"), F.col("start"), F.col("size")
    least = 1 if table.fold == BEST_PATH else 2
    starts = units.select(F.col(unit_col).alias("unit"), F.explode(F.when(n >= least, F.sequence(F.lit(1), n - least + 1))).alias("start"))
    if table.fold == MERGES:
        heads = F.broadcast(spark.createDataFrame(_heads(table), "head string, sizes array<int>"))
        sizes = F.concat(F.array(*map(F.lit, range(2, HEAD))), F.coalesce("sizes", F.array().cast("array<int>")))
        spans = starts.withColumn("head", F.substring("unit", start, F.lit(HEAD))).join(heads, "head", "left").select("unit", "start", F.explode(sizes).alias("size")).filter(size <= n - start + 1)
        return _fold_merges(spans.withColumn("piece", F.substring(F.col("unit"), start, size)).join(pieces, "piece"), start, size)
    spans = starts.select("unit", "start", F.explode(F.sequence(F.lit(least), F.least(F.lit(table.longest), n - start + 1))).alias("size"))
    spans = spans.withColumn("piece", F.substring(F.col("unit"), start, size))
    edges = spans.join(pieces, "piece", "left").filter(F.col("id").isNotNull() | (size == 1))
    return _fold_best(edges, start, size, F.coalesce("score", F.lit(table.unknown_score)), F.coalesce("id", -start).cast("int"))


def _fold_best(edges: DataFrame, start: Column, size: Column, score: Column, piece_id: Column) -> DataFrame:
    edge = F.struct((start + size - 1).cast("int").alias("end"), (start - 1).cast("int").alias("start"), score.alias("score"), piece_id.alias("id"))
    grouped = edges.groupBy("unit").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    # state: for each place so far the score of its best path and that path's last edge; edges come by end, then start
    state = "named_struct('score', s[e.start].score + e.score, 'from', e.start, 'id', e.id)"
    fold = f"""aggregate(edges, array(named_struct('score', 0D, 'from', -1, 'id', 0)),
        (s, e) -> if(e.end = size(s), concat(s, array({state})),
            if(s[e.start].score + e.score > s[e.end].score, concat(slice(s, 1, e.end), array({state})), s)))"""
    walk = """aggregate(best, named_struct('at', size(best) - 1, 'path', cast(array() AS array<int>)),
        (s, x) -> if(s.at = 0, s, named_struct('at', best[s.at].from, 'path', concat(array(best[s.at].id), s.path))), s -> s.path)"""
    return grouped.select("unit", F.expr(fold).alias("best")).select("unit", F.expr(walk).alias("path"))


def _heads(table: PieceTable) -> list[tuple[str, list[int]]]:
    """First HEAD characters of the pieces of so many or more, and the sizes of those pieces: other substrings are not asked for."""
    sizes: dict[str, set[int]] = {}
    for piece, _, _ in table.lattice():
        if len(piece) >= HEAD:
            sizes.setdefault(piece[:HEAD], set()).add(len(piece))
    return [(head, sorted(found)) for head, found in sizes.items()]


def _edge_codes(table: PieceTable) -> list[tuple[str, int]]:
    """An edge of MERGES is one number: how many different scores are higher than its piece's, from bit 32 on, six bits each for its start and size, and 20 for the id."""
    every = table.lattice()
    rank = {score: n for n, score in enumerate(sorted({s for _, _, s in every}, reverse=True))}
    if max((i for _, i, _ in every), default=0) >> 20:
        raise ValueError("ids of a piece table have 20 bits at most")
    return [(p, rank[s] << 32 | i) for p, i, s in every]


def _fold_merges(edges: DataFrame, start: Column, size: Column) -> DataFrame:
    """Cuts are bits of one long: bit k is the cut before character k. An edge needs the cuts at its ends (outer) and one of those within (inner)."""
    edge = F.col("code") + (start.cast("long") - 1) * (1 << 26) + size.cast("long") * (1 << 20)
    grouped = edges.groupBy("unit").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    at, wide = "cast(shiftright(e, 26) & 63 AS int)", "cast(shiftright(e, 20) & 63 AS int)"
    marked = f"transform(edges, e -> named_struct('edge', e, 'outer', shiftleft(shiftleft(1L, {wide}) + 1, {at}), 'inner', shiftleft(shiftleft(1L, {wide}) - 2, {at})))"
    fold = """aggregate(edges, shiftleft(1L, length(unit) + 1) - 1,
        (cuts, e) -> if(cuts & e.outer = e.outer AND bit_count(cuts & e.inner) = 1, cuts & ~e.inner, cuts))"""
    path = """transform(sort_array(concat(
        transform(filter(edges, e -> cuts & e.outer = e.outer AND cuts & e.inner = 0), e -> (shiftright(e.edge, 26) & 63) * 4294967296 + (e.edge & 1048575)),
        transform(filter(sequence(0, length(unit) - 1), k -> shiftright(cuts, k) & 3 = 3), k -> k * 4294967297 + 2147483648))),
        x -> cast(if(x & 2147483648 = 0, x & 2147483647, -1 - shiftright(x, 32)) AS int))"""
    marks = grouped.select("unit", F.expr(marked).alias("edges"))
    return marks.select("unit", "edges", F.expr(fold).alias("cuts")).select("unit", F.expr(path).alias("path"))


_ASKED = pa.schema([("ref", pa.int64()), ("unit", pa.string())])
_COUNTS = pa.schema([("unit", pa.string()), ("n", pa.int64())])
_ANSWER = pa.schema([("chunk_id", pa.int64()), ("numbers", pa.binary()), ("lens", pa.binary()), ("ids", pa.binary())])
_STREAM = pa.schema([("chunk_id", pa.int64()), ("doc_ids", pa.binary()), ("counts", pa.binary()), ("stream", pa.binary()), ("n_units", pa.int32()), ("own_units", pa.list_(pa.binary()))])


class ChunkUnits:
    """The units of a chunk's texts, each text with a space before it (an empty one stays empty): a run of spaces with what follows up to the next space, line end or tab; those two by themselves. joints: of a piece table, whose pairs of bytes cut them again.

    number: of each unit, by the first place of its text in the chunk. Units are equal if keys of 64 bits
    are, made of their lengths and bytes (units of one length of up to eight bytes have a key each).
    """

    def __init__(self, texts: list[bytes], joints: np.ndarray | None = None):
        self.raw = b"".join(x for t in texts if t for x in (b" ", t))
        sizes = np.fromiter((len(t) + 1 if t else 0 for t in texts), np.int64, len(texts))
        text = np.frombuffer(self.raw, np.uint8)
        if not len(text):
            self.number, self.counts, self.first, self.lens = np.empty(0, np.int32), np.zeros(len(texts), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
            return
        space, line = text == 32, (text == 10) | (text == 9)
        begins = line | space
        begins[1:] &= ~space[:-1] | line[1:]
        begins[1:] |= line[:-1]
        if joints is not None:
            begins[1:] |= joints[text[:-1].astype(np.uint16) << 8 | text[1:]]
        begins[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        starts = np.flatnonzero(begins)
        lens = np.diff(np.r_[starts, len(text)])
        cuts = np.searchsorted(starts, np.r_[0, np.cumsum(sizes)])
        first, self.number = _first_and_number(self._keys(text, starts, lens))
        self.counts, self.first, self.lens = np.diff(cuts), starts[first], lens[first]

    @staticmethod
    def _keys(text: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        padded = np.concatenate((text, np.zeros(16 - len(text) % 8, np.uint8))).view("<u8")
        masks, odd = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64), np.uint64(0x9E3779B97F4A7C15)

        def words(at: np.ndarray, n: np.ndarray) -> np.ndarray:
            """The eight bytes from each place on, of which n count."""
            shift = (at & 7).astype(np.uint64) << np.uint64(3)
            return (padded[at >> 3] >> shift | padded[(at >> 3) + 1] << np.uint64(1) << (np.uint64(63) - shift)) & masks[np.minimum(n, 8)]

        out, at = np.empty(len(starts), np.uint64), 0
        while at < len(starts):  # whole units of about _PIECE bytes
            stop = max(at + 1, int(np.searchsorted(starts, starts[at] + _PIECE)))
            place, n = starts[at:stop], lens[at:stop]
            key = mix(n.astype(np.uint64) * odd + words(place, n))
            done, more = 8, np.flatnonzero((n > 8) & (n <= _KEY_BYTES))
            while len(more):
                key[more] = mix(key[more] * odd + words(place[more] + done, n[more] - done))
                done += 8
                more = more[n[more] > done]
            for k in np.flatnonzero(n > _KEY_BYTES).tolist():
                key[k] = int.from_bytes(hashlib.blake2b(text[place[k] : place[k] + n[k]], digest_size=8).digest(), "little")
            out[at:stop] = key
            at = stop
        return out

    def texts(self, which: np.ndarray | slice = slice(None)) -> list[bytes]:
        """The different units, or some of them, by number."""
        return [self.raw[a : a + n] for a, n in zip(self.first[which].tolist(), self.lens[which].tolist())]

    def local(self) -> np.ndarray:
        """For each different unit: is it folded where it stands?"""
        text = np.frombuffer(self.raw, np.uint8)
        spaces = (self.lens > 1) & (text[self.first] == 32) & (text[np.minimum(self.first + 1, len(text) - 1)] == 32)
        return spaces | (self.lens > UNIT_BYTES)


def _first_and_number(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each different key, ascending, and the number of each key among them."""
    number = pa.array(keys).dictionary_encode().indices.to_numpy()
    first = np.empty(int(number.max()) + 1, np.int64)
    first[number[::-1]] = np.arange(len(keys) - 1, -1, -1)  # the last one written is the first place
    return first, number


def _count(docs: DataFrame, joints: np.ndarray, *columns) -> DataFrame:
    """unit and n of the units that a partition has AGAIN times or more, but for those to be folded where they stand."""

    def emit(counts: dict[bytes, int]):
        units = [u for u, n in counts.items() if n >= AGAIN]
        n = np.fromiter(map(counts.__getitem__, units), np.int64, len(units))
        for at in range(0, len(units), _ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(units[at : at + _ROWS], pa.binary()).cast(pa.string()), pa.array(n[at : at + _ROWS])], schema=_COUNTS)

    def run(batches):
        counts: dict[bytes, int] = {}
        for batch in batches:
            for row in batch.to_pylist():
                units = ChunkUnits(open_chunk(row)[1], joints)
                which = np.flatnonzero(~units.local())
                for unit, n in zip(units.texts(which), np.bincount(units.number)[which].tolist()):
                    counts[unit] = counts.get(unit, 0) + n
                if len(counts) > _COUNTED:
                    yield from emit(counts)
                    counts = {}
        yield from emit(counts)

    return chunk_documents(docs, *columns, then=run, schema="unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def _resolver(table: PieceTable):
    """Makes a function that gives the ids of units (list of int32), from the units and their paths; a null path has no edges."""
    single, byte_ids = table.single(), table.byte_ids

    def make():
        char_ids = np.full(0x110000, -1, np.int32)
        for char, (number,) in single.items():
            char_ids[ord(char)] = number

        def resolve(unit: pa.Array, path: pa.Array) -> pa.ListArray:
            codes = np.frombuffer("".join(unit.to_pylist()).encode("utf-32-le"), np.uint32)
            chars = pc.utf8_length(unit).to_numpy().astype(np.int64)
            first = np.cumsum(chars) - chars
            none = path.is_null().to_numpy(zero_copy_only=False)  # all characters are single
            lens = np.where(none, chars, pc.fill_null(pc.list_value_length(path), 0).to_numpy(zero_copy_only=False))
            ends = np.cumsum(lens)
            owner = np.repeat(np.arange(len(lens)), lens)
            ids = -1 - (np.arange(len(owner), dtype=np.int64) - (ends - lens)[owner])  # as if all were single
            ids[~none[owner]] = path.drop_null().flatten().to_numpy()
            alone = np.flatnonzero(ids < 0)
            code = codes[first[owner[alone]] - 1 - ids[alone]]
            ids[alone] = char_ids[code]
            odd = alone[char_ids[code] < 0]
            if len(odd):  # characters that no piece has: each is as many ids as it has bytes
                raw = [chr(c).encode() for c in code[char_ids[code] < 0].tolist()]
                times = np.ones(len(ids), np.int64)
                times[odd] = [len(x) for x in raw]
                lens = np.bincount(owner, times, len(lens)).astype(np.int64)
                ids = np.repeat(ids, times)
                ids[ids < 0] = np.array(byte_ids)[np.frombuffer(b"".join(raw), np.uint8)]
            return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lens))), pa.int32()), pa.array(ids, pa.int32()))

        return resolve

    return make


@dataclass(frozen=True)
class CommonUnits:
    """The commonest units, the most frequent one first, and their ids, packed."""

    units: bytes
    sizes: bytes
    lens: bytes
    ids: bytes
    n: int

    @staticmethod
    def of(counted: DataFrame, table: PieceTable, most: int = COMMON) -> CommonUnits:
        """At most so many units of unit and n: those with so many occurrences that they are not too many."""
        counted = shared_checkpoint(counted)
        level = F.floor(_LEVELS * F.log2("n")).cast("int")
        least, total = 0, 0
        for row in counted.groupBy(level.alias("level")).agg(F.count("*").alias("units"), F.min("n").alias("least")).orderBy(F.desc("level")).collect():  # some rows for each power of two
            if total + row.units > most:
                break
            least, total = row.least, total + row.units
        if not total:
            return CommonUnits(pack(b""), pack(b""), pack(b""), pack(b""), 0)
        names = ("units", "sizes", "n", "lens", "ids")
        schema, make = pa.schema([("block", pa.int32()), *((n, pa.binary()) for n in names)]), _resolver(table)

        def blocks(table: pa.Table) -> pa.Table:
            lists = make()(table["unit"].combine_chunks(), table["path"].combine_chunks())
            units = table["unit"].cast(pa.binary()).to_pylist()
            data = [pack(b"".join(units)), pack(np.array([len(u) for u in units], np.int32)), pack(table["n"].to_numpy()), pack(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)), pack(lists.flatten().to_numpy().astype(np.int32))]
            return pa.Table.from_arrays([table["block"][:1].combine_chunks(), *[pa.array([x], pa.binary()) for x in data]], schema=schema)

        common = counted.filter(F.col("n") >= least)
        paths = common.join(encode_units(common.select("unit"), table), "unit", "left").withColumn("block", F.pmod(F.xxhash64("unit"), F.lit(_COMMON_BLOCKS)).cast("int"))
        rows = sorted(paths.groupBy("block").applyInArrow(blocks, "block int, " + ", ".join(f"{n} binary" for n in names)).collect())
        text, sizes, n, lens, ids = (np.concatenate([unpack(r[c], kind) for r in rows]) for c, kind in zip(names, (np.uint8, np.int32, np.int64, np.int32, np.int32)))
        order = np.argsort(-n, kind="stable")
        ordered = lambda values, lens: pack(_gather(values, (np.cumsum(lens, dtype=np.int64) - lens)[order], lens[order]))
        return CommonUnits(ordered(text, sizes), pack(sizes[order]), pack(lens[order]), ordered(ids, lens), len(n))

    def numbers(self) -> dict[bytes, int]:
        raw, sizes = unpack(self.units), unpack(self.sizes, np.int32)
        ends = np.cumsum(sizes)
        return {raw[a:b]: i for i, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist()))}


def _pack_planes(x: np.ndarray) -> bytes:
    """Numbers of 32 bits with their bytes sorted by place, which packs better."""
    return pack(x.astype("<i4").view(np.uint8).reshape(-1, 4).T)


def _unpack_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(unpack(data, np.uint8).reshape(4, -1).T).reshape(-1).view("<i4")


def _reference(chunk_id: int) -> int:
    """A chunk in the upper 33 bits of one number: its partition, and its place there in 13 bits; the lower 30 are for a unit."""
    part, seq = chunk_id >> 24, chunk_id & (1 << 24) - 1
    if part >> 20 or seq >> 13:
        raise ValueError("a partition of over 8192 chunks, or over a million partitions: make partitions smaller or chunk_bytes larger")
    return (part << 13 | seq) << 30


def _ask(docs: DataFrame, common: CommonUnits, joints: np.ndarray, *columns) -> DataFrame:
    """unit, for the units of each chunk that are neither common nor folded where they stand, and ref, the chunk and the unit's number in it."""

    def run(batches):
        numbers = common.numbers()
        for batch in batches:
            for row in batch.to_pylist():
                units = ChunkUnits(open_chunk(row)[1], joints)
                known = np.fromiter(map(numbers.get, units.texts(), repeat(-1)), np.int32, len(units.first))
                which = np.flatnonzero((known < 0) & ~units.local())
                for at in range(0, len(which), _ROWS):
                    some = which[at : at + _ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array(_reference(row["chunk_id"]) + some, pa.int64()), pa.array(units.texts(some), pa.binary()).cast(pa.string())], schema=_ASKED)

    return chunk_documents(docs, *columns, then=run, schema="ref long, unit string")


def _streams(docs: DataFrame, common: CommonUnits, joints: np.ndarray, *columns) -> DataFrame:
    """Each chunk's documents as numbers of units, those of the common ones before its own, and its units to be folded here."""

    def run(batches):
        numbers = common.numbers()
        for batch in batches:
            for row in batch.to_pylist():
                ids, texts = open_chunk(row)
                units = ChunkUnits(texts, joints)
                n, own = len(units.first), np.flatnonzero(units.local())
                number = np.fromiter(map(numbers.get, units.texts(), range(common.n, common.n + n)), np.int32, n)
                folded_here = [x for k, u in zip(own.tolist(), units.texts(own)) for x in (str(k).encode(), u)]
                data = [row["chunk_id"], pack(ids), pack(units.counts), _pack_planes(number[units.number]), n, folded_here]
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(data, _STREAM)], schema=_STREAM)

    return chunk_documents(docs, *columns, then=run, schema="chunk_id long, doc_ids binary, counts binary, stream binary, n_units int, own_units array<binary>")


def _pack_answers(answers: DataFrame, table: PieceTable) -> DataFrame:
    """Ids of each chunk's units, a row for each chunk and run of rows of a partition."""
    make = _resolver(table)

    def emit(batches, resolve):
        table = pa.Table.from_batches(batches).sort_by("ref")
        ref = table["ref"].to_numpy()
        chunk, number = ref >> 43 << 24 | ref >> 30 & (1 << 13) - 1, (ref & (1 << 30) - 1).astype(np.int32)
        lists = resolve(table["unit"].combine_chunks(), table["path"].combine_chunks())
        lens, ids = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32), lists.flatten().to_numpy()
        ends = np.cumsum(lens, dtype=np.int64)
        starts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
        stops = np.r_[starts[1:], len(chunk)]
        rows = [(chunk[a], _pack_planes(np.diff(number[a:b], prepend=0)), pack(lens[a:b]), _pack_planes(ids[ends[a] - lens[a] : ends[b - 1]])) for a, b in zip(starts.tolist(), stops.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _ANSWER)], schema=_ANSWER)

    def run(batches):
        held, size, resolve = [], 0, make()
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= _ANSWER_ROWS:
                yield emit(held, resolve)
                held, size = [], 0
        if held:
            yield emit(held, resolve)

    return answers.select("ref", "unit", "path").mapInArrow(giving_back(run), "chunk_id long, numbers binary, lens binary, ids binary")


def _gather(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The runs of values that start at starts and have lens, one after the other."""
    ends = np.cumsum(lens, dtype=np.int64)
    return values[np.repeat(starts - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)]


def encode(docs: DataFrame, table: PieceTable, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, most_common: int = COMMON, then=None, then_schema: str | None = None) -> DataFrame:
    """doc_id and ids (array of int), one row for each row of docs; then, if given, maps Arrow batches of them to batches of then_schema where they are made.

    Null and empty texts have no ids. Rows that repeat a doc_id, and null ids, keep a row each. decode()
    gives every text back, byte for byte: what no piece has, a literal U+2581 too, is written as bytes. An
    empty table gives an empty table. Documents are read three times, to count units, to ask and to answer.
    """
    columns = table.joints(), id_col, text_col, chunk_bytes
    common = CommonUnits.of(_count(docs, *columns), table, most_common)
    asked = _ask(docs, common, *columns).filter("unit is not null").repartition("unit")
    # units and what asks for them are dealt once: filters that never fail make both sides of the join read one exchange
    units = asked.groupBy("unit").agg(F.min("ref").alias("ref")).filter("ref >= 0").select("unit")
    answers = _pack_answers(asked.join(encode_units(units, table), "unit", "left"), table)
    known, single, byte_ids = {p: (i, s) for p, i, s in table.lattice()}, table.single(), table.byte_ids
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out, said, empty = [], right.to_pylist(), pa.RecordBatch.from_pylist([], schema=schema)
        common_lens, common_ids = unpack(common.lens, np.int32).astype(np.int64), unpack(common.ids, np.int32)
        for row in left.to_pylist():
            doc_ids, counts, stream = unpack(row["doc_ids"], np.int64), unpack(row["counts"], np.int64), _unpack_planes(row["stream"])
            lens, starts = np.zeros((2, common.n + row["n_units"]), np.int64)
            lens[: common.n], starts[: common.n] = common_lens, np.cumsum(common_lens) - common_lens
            parts, at = [common_ids], len(common_ids)
            for answer in said:
                number, n, ids = common.n + np.cumsum(_unpack_planes(answer["numbers"])), unpack(answer["lens"], np.int32), _unpack_planes(answer["ids"])
                lens[number], starts[number] = n, at + np.cumsum(n, dtype=np.int64) - n
                parts.append(ids)
                at += len(ids)
            for k, unit in zip(row["own_units"][::2], row["own_units"][1::2]):
                path = fold_unit(unit.decode(), table, known)
                ids = np.array([i for p in path for i in ([p] if isinstance(p, int) else single.get(p) or [byte_ids[b] for b in p.encode()])], np.int32)
                lens[common.n + int(k)], starts[common.n + int(k)] = len(ids), at
                parts.append(ids)
                at += len(ids)
            flat, ends = np.concatenate(parts), np.cumsum(counts)
            first = 0
            while first < len(counts):  # documents of about _GATHER units at a time
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + _GATHER, side="right")))
                own = stream[ends[first] - counts[first] : ends[last - 1]]
                n = lens[own]
                sums = np.concatenate(([0], np.cumsum(n)))
                cuts = sums[np.concatenate(([0], np.cumsum(counts[first:last])))]
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(_gather(flat, starts[own], n), pa.int32()))
                made = pa.RecordBatch.from_arrays([id_column(doc_ids[first:last]), lists], schema=schema)
                out.append(then(made) if then else made)
                first = last
        return pa.Table.from_batches(out or [then(empty) if then else empty])

    return _streams(docs, common, *columns).groupBy("chunk_id").cogroup(answers.groupBy("chunk_id")).applyInArrow(finish, then_schema if then else "doc_id long, ids array<int>")


def _decoder(table: PieceTable):
    texts = table.texts()

    def run(ids: np.ndarray) -> bytes:
        raw = b"".join(map(texts.__getitem__, ids.tolist()))
        return raw[1:] if raw[:1] == b" " else raw

    return run


def decode(encoded: DataFrame, table: PieceTable, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text, one row for each row of encoded. Null ids give an empty text; bytes that are no character become U+FFFD."""

    def run(batches):
        text_of = _decoder(table)
        for batch in batches:
            texts = [text_of(np.array(x or [], np.int32)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long"), F.col(ids_col).cast("array<int>")).mapInArrow(run, "doc_id long, text string")


DIGESTS = "doc_id long, n_tokens long, ids_crc32 long, text_sha256 string"


def digest(table: PieceTable):
    """Maps a batch of doc_id and ids to doc_id, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers) and text_sha256 of the decoded text."""
    texts = table.texts()
    by_id = pa.array([texts.get(i) for i in range(max(texts) + 1)], pa.binary())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, offsets = batch.column(1).values, batch.column(1).offsets.to_numpy()
        values, written = ids.to_numpy().astype("<u4"), by_id.take(ids)
        if written.null_count:
            raise KeyError("an id that is no piece's")
        cuts = np.frombuffer(written.buffers()[1], np.int32)[offsets].tolist() if len(ids) else [0] * len(offsets)
        raw = memoryview(written.buffers()[2] or b"")
        own = [raw[a + (raw[a:b][:1] == b" ") : b] for a, b in zip(cuts[:-1], cuts[1:])]
        sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        columns = [batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(sums, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in own], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_crc32", "text_sha256"])

    return run


def encode_digests(docs: DataFrame, table: PieceTable, **options) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 and text_sha256 of what decoding the ids gives, one row for each row of docs."""
    return encode(docs, table, then=digest(table), then_schema=DIGESTS, **options)
