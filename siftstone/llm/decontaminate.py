"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick five of seven tokens and ignore the others, so a seed matches in spite of a substituted
token under its holes. Seeds of test items and of documents meet in an equality test on their hashes; each
hit puts an item beside a document at one shift, and the tokens of both are then compared there. An item
is found if a run of SPAN aligned tokens (the whole item if it is shorter) has at least four equal tokens
in five. Any such run with up to two substitutions in 12 tokens has a seed in full; shorter items get
masks of all their tokens for the substitutions that hit every seed (test_decontaminate tries all of them).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.columns import NO_ID, giving_back, pack, shared_checkpoint, text_bytes, unpack

#: The masks: 1 picks a token, 0 ignores it.
MASKS = ("1111001", "1101011")
SPAN, SHARE = 12, 0.8
#: Items are taken in blocks of about so many tokens; every block goes against all documents.
BLOCK_TOKENS = 2_000_000
_SEPARATORS = bytes.maketrans(bytes(range(128)), bytes(c if chr(c).isalnum() else 32 for c in range(128)))
_FILTER_BITS = 22
#: A seed equal to the one so many places before it continues a run; hits are expanded so many at a time.
_LAGS, _HITS = 8, 1 << 20
_MEMO = 1 << 20


def tokens(raw: bytes) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, with A-Z in lower case."""
    return raw.translate(_SEPARATORS).lower().split()


def _token_hash(token: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(token, 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def seed_hashes(hashes: np.ndarray, mask: str) -> np.ndarray:
    """A hash for each position of a mask on a row of token hashes."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, int(mask, 2), np.uint64)
    for i, picked in enumerate(mask):
        if picked == "1":
            out = _mix(out + hashes[i : i + n])
    return out


def repeats(seeds: np.ndarray) -> np.ndarray:
    """For each seed a number whose bit p - 1 is set if the seed p places before it is the same, for p up to _LAGS."""
    out = np.zeros(len(seeds), np.int64)
    for p in range(1, min(_LAGS, len(seeds) - 1) + 1):
        out[p:] |= (seeds[p:] == seeds[:-p]).astype(np.int64) << (p - 1)
    return out


@cache
def short_masks(n: int, masks: tuple[str, ...] = MASKS, span: int = SPAN, share: float = SHARE) -> tuple[str, ...]:
    """Masks of n tokens for an item of n < span tokens, one for each choice of allowed substitutions that leaves no seed of masks in full."""
    if n >= span:
        return ()
    seeds = [{at + i for i, c in enumerate(m) if c == "1"} for m in masks for at in range(n - len(m) + 1)]
    lost = (set(gone) for gone in combinations(range(n), n - math.ceil(share * n)) if all(s & set(gone) for s in seeds))
    return tuple("".join("0" if i in gone else "1" for i in range(n)) for gone in lost)


def _ranges(of: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """of[k] and each number from low[k] to high[k], one after the other."""
    n = high - low
    return np.repeat(of, n), np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


class ItemIndex:
    """Seeds of a bounded block of items. Items with equal tokens are one, named by the smallest id; items without tokens are left out."""

    def __init__(self, items: list[tuple[int, bytes]], masks: tuple[str, ...] = MASKS, span: int = SPAN, share: float = SHARE):
        by_tokens: dict[tuple[bytes, ...], int] = {}
        for item, raw in sorted(items):
            by_tokens.setdefault(tuple(tokens(raw)), item)
        by_tokens.pop((), None)
        self.ids = np.array(list(by_tokens.values()), np.int64)
        self.tokens = [np.array([_token_hash(t) for t in x], np.uint64) for x in by_tokens]
        self.masks = masks
        extra = lambda n: short_masks(n, masks, span, share)
        self.all_masks = list(masks) + [m for n in sorted({len(t) for t in self.tokens}) for m in extra(n)]
        hashes, items_at, places, lags = [], [], [], []
        for number, t in enumerate(self.tokens):
            for mask in masks + extra(len(t)):
                found = seed_hashes(t, mask)
                hashes.append(found)
                items_at.append(np.full(len(found), number))
                places.append(np.arange(len(found)))
                lags.append(repeats(found))
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, kind)
        hashes, lags = join(hashes, np.uint64), join(lags, np.int64)
        order = np.lexsort((lags, hashes))
        self.items, self.places = join(items_at, np.int64)[order], join(places, np.int64)[order]
        hashes, lags = hashes[order], lags[order]
        # groups of entries that have the same seed and the same repeats
        first = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (lags[1:] != lags[:-1])]) if len(hashes) else np.empty(0, np.int64)
        self.hashes, self.lags = hashes[first], lags[first]
        self.starts = np.r_[first, len(hashes)]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def candidates(self, doc: np.ndarray) -> list[tuple[int, int]]:
        """(item, shift) of every seed hit: token i of the item stands beside token i + shift of the document.

        Where both the document and the item repeat the seed they have p places before, the hit there
        has the same shift, so this one is not expanded: two texts of one word each meet in as many
        hits as they have words, not in their product. The others are expanded a bounded number at a time.
        """
        found = [np.empty(0, np.int64)]
        for mask in self.all_masks:
            seeds = seed_hashes(doc, mask)
            at = np.flatnonzero(self.filter[(seeds >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            if not len(at):
                continue
            low, high = (np.searchsorted(self.hashes, seeds[at], side=side) for side in ("left", "right"))
            place, group = _ranges(at, low, high)
            fresh = (repeats(seeds)[place] & self.lags[group]) == 0
            place, group = place[fresh], group[fresh]
            ends = np.cumsum(self.starts[group + 1] - self.starts[group])
            cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(_HITS, ends[-1] if len(ends) else 0, _HITS), side="right"), len(group)])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                i, entry = _ranges(place[a:b], self.starts[group[a:b]], self.starts[group[a:b] + 1])
                found.append(np.unique((self.items[entry] << 32) + (i - self.places[entry] + (1 << 31))))
        keys = np.unique(np.concatenate(found))
        return list(zip((keys >> 32).tolist(), ((keys & ((1 << 32) - 1)) - (1 << 31)).tolist()))

    def verify(self, doc: np.ndarray, item: int, shift: int, span: int, share: float) -> tuple[int, int, int] | None:
        """(first token in the document, tokens, equal tokens) of the aligned stretch whose runs pass, or None."""
        own = self.tokens[item]
        low, high = max(0, -shift), min(len(own), len(doc) - shift)
        width = min(span, len(own))
        if high - low < width:
            return None
        equal = own[low:high] == doc[low + shift : high + shift]
        sums = np.concatenate(([0], np.cumsum(equal)))
        good = np.flatnonzero(sums[width:] - sums[:-width] >= math.ceil(share * width))
        if not len(good):
            return None
        a, b = int(good[0]), int(good[-1]) + width
        return a + low + shift, b - a, int(sums[b] - sums[a])


class LeakFinder:
    """Finds the best item of a block for a text; token hashes are kept in a bounded memo."""

    def __init__(self, items: list[tuple[int, bytes]], span: int, share: float):
        self.index, self.span, self.share = ItemIndex(items, span=span, share=share), span, share
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> tuple:
        """(number of different items found, then item, start, length and equal tokens of the best one or None)."""
        words, known = tokens(text), self.known
        if len(known) > _MEMO:
            known.clear()
        for w in set(words).difference(known):
            known[w] = _token_hash(w)
        doc = np.array([known[w] for w in words], np.uint64)
        found, best = set(), None
        for item, shift in self.index.candidates(doc):
            if hit := self.index.verify(doc, item, shift, self.span, self.share):
                found.add(item)
                start, length, matched = hit
                rank = (-matched, int(self.index.ids[item]), start, length)
                best = rank if best is None else min(best, rank)
        return (len(found), best[1], best[2], best[3], -best[0]) if best else (0, None, None, None, None)


def item_blocks(benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, share: float = SHARE, block_tokens: int = BLOCK_TOKENS) -> tuple[int, Iterator]:
    """The number of blocks of items, and one after the other a maker of a LeakFinder for each.

    A block has about block_tokens tokens, however large the table: its size is summed up before, and
    one block at a time is fetched. Items with equal tokens are one row of it, under their smallest id,
    and those without tokens are left out, so repeated items make no block larger.
    """
    size = F.coalesce(F.octet_length(F.col(item_text_col)) / 2 + 1, F.lit(1))
    n_blocks = max(1, math.ceil((benchmark.agg(F.sum(size)).first()[0] or 0) / block_tokens))

    def deal(batches):
        for batch in batches:
            plain = [b" ".join(tokens(x)) for x in text_bytes(batch.column(1))]
            keys = [_token_hash(x) % n_blocks for x in plain]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(plain, pa.binary()).cast(pa.string()), pa.array(keys, pa.int64())], names=["item", "text", "block"])

    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")).mapInArrow(deal, "item long, text string, block long")

    def fetch(number: int):
        rows = items.filter((F.col("block") == number) & (F.col("text") != "")).groupBy("text").agg(F.min("item").alias("item")).select("item", "text").collect()
        texts = [(t or "").encode() for _, t in rows]
        packed = pack(b"".join(texts)), pack(np.array([len(t) for t in texts], np.int64)), pack(np.array([NO_ID if i is None else i for i, _ in rows], np.int64))

        def make() -> LeakFinder:
            raw, sizes, ids = unpack(packed[0]), unpack(packed[1], np.int64).tolist(), unpack(packed[2], np.int64).tolist()
            ends = np.cumsum(sizes).tolist()
            return LeakFinder([(i, raw[e - n : e]) for i, e, n in zip(ids, ends, sizes)], span, share)

        return make

    return n_blocks, map(fetch, range(n_blocks))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, share: float = SHARE) -> DataFrame:
    """The rows of docs in whose text no item is found, with all their columns. Rows are judged in place: nothing is joined or shuffled. Of several blocks of items, each one's result is checkpointed before the next is fetched."""
    n_blocks, finders = item_blocks(benchmark, span=span, share=share)
    for finder in finders:

        def run(batches, finder=finder):
            find = finder()
            for batch in batches:
                texts = text_bytes(batch.column(batch.schema.get_field_index("text")))
                yield batch.filter(pa.array([find(x)[0] == 0 for x in texts], pa.bool_()))

        docs = docs.mapInArrow(giving_back(run), docs.schema)
        docs = shared_checkpoint(docs) if n_blocks > 1 else docs
    return docs


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, share: float = SHARE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each row of docs: doc_id, contaminated, n_items (different items found), item_id, start, length and matched of the best one.

    The best item has the most equal tokens, then the smallest id. start and length count tokens of the
    document. Null and empty texts and items have no tokens and match nothing. Items come in blocks of
    a bounded size, of which the driver holds one at a time; with several, documents are read once for
    each and results are put together by row: n_items and the best item do not depend on the blocks. An empty table on either side finds nothing.
    """
    n_blocks, finders = item_blocks(benchmark, item_col, item_text_col, span, share, block_tokens)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if n_blocks > 1:
        plain = shared_checkpoint(plain.withColumn("row", F.monotonically_increasing_id()))  # a row keeps its number in every scan
    else:
        plain = plain.withColumn("row", F.lit(0).cast("long"))
    schema = "doc_id long, row long, n_items int, item_id long, start int, length int, matched int"

    def scan(finder):
        def run(batches):
            find = finder()
            for batch in batches:
                kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                columns = list(zip(*map(find, text_bytes(batch.column(1))))) or [()] * 5
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)] + [pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "row", "n_items", "item_id", "start", "length", "matched"])

        return run

    if n_blocks == 1:
        found = plain.mapInArrow(scan(next(finders)), schema)
    else:
        hits = [shared_checkpoint(plain.mapInArrow(scan(finder), schema).filter("n_items > 0")) for finder in finders]
        best = F.max(F.struct("matched", -F.col("item_id"), -F.col("start"), "item_id", "start", "length")).alias("best")
        united = reduce(DataFrame.union, hits).groupBy("row").agg(F.sum("n_items").cast("int").alias("n_items"), best)
        united = united.select("row", "n_items", "best.item_id", "best.start", "best.length", "best.matched")
        found = plain.select("doc_id", "row").join(united, "row", "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)))
    return found.select("doc_id", (F.col("n_items") > 0).alias("contaminated"), "n_items", "item_id", "start", "length", "matched")
