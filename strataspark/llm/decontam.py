"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .names import free_names

SHARE = 0.2  # edits that an item of a leaked passage may have, as a share of its characters
GRAM = 8  # bytes from a letter that propose where a window begins
SLACK = 12  # places that the grams of one window may be out of line
COVER = (6, 0.08)  # bytes of an item that grams in line must cover: so many, and a share of its length
SEEN_BITS = 23  # of the hash of a gram, in the table that tells at once that no item has it
REPEATS = 64  # embeddings, each with its own walk and tables
MEET = 4  # tables in which a window and an item must meet
TOGETHER = 8  # embeddings that are made side by side
HOPE = 24  # embeddings after which a window that has not met its item once is given up
SAMPLED = 4  # letters of an embedding that make a key
STRETCHES = 8  # parts of a walk that have tables of their own, beside the one of the whole walk
CLASS = 1.12  # items whose lengths are within this factor share tables
WALK_BYTES = 500_000  # of the windows that walk together
HITS = 4_000_000  # grams found in items that are looked at together; above, texts are halved
LEAST_PIECE = 4096
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 16_000_000
STRETCH = 2_000_000
SEED = 42

_MARKS = bytes(c for c in range(128) if not chr(c).isalnum())
_PLAIN = bytes(32 if c in _MARKS else ord(chr(c).lower()) if c < 128 else c for c in range(256))


@lru_cache(None)
def _is_mark(c: str) -> bool:
    """Punctuation, symbols, blanks and controls beyond ASCII."""
    return c > "\x7f" and (unicodedata.category(c)[0] in "PSZ" or unicodedata.category(c) in ("Cc", "Cf"))


def plain(text: str | None) -> bytes:
    """Letters in lower case and digits, with one space between words; as UTF-8."""
    raw = text or ""
    if not raw.isascii():
        raw = raw.lower()
        for c in filter(_is_mark, set(raw)):
            raw = raw.replace(c, " ")
    raw = raw.encode("utf-8", "surrogatepass")
    return b" ".join(raw.translate(_PLAIN).split())


def edit_distance_within(item: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``item`` to any part of ``text``, and where the first best part ends; by bit vectors over the item."""
    m = len(item)
    if not m:
        return 0, 0
    full, top = (1 << m) - 1, 1 << (m - 1)
    masks: dict[str, int] = {}
    for k, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << k
    up, down, now, best, end = full, 0, m, m, 0
    for at, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        x = eq | down
        d0 = ((((x & up) + up) ^ up) | x) & full
        plus, minus = down | (full & ~(d0 | up)), d0 & up
        if plus & top:
            now += 1
        elif minus & top:
            now -= 1
        plus, minus = plus << 1 & full, minus << 1 & full  # a part may begin anywhere
        up, down = minus | (full & ~(d0 | plus)), d0 & plus
        if now < best:
            best, end = now, at
    return best, end


def cgk(windows: np.ndarray, lengths: np.ndarray, steps: int, seeds: list[int]) -> np.ndarray:
    """CGK embeddings ``[step, seed, row]``: at every step the letter under the walk goes out, and a random bit of step and letter says if the walk moves on.

    Edits that two strings differ by throw their walks apart only until they meet again, so the edit distance shows
    as a Hamming distance. Behind a string's end the embedding is 0. The walks of all seeds run side by side.
    """
    n, width = windows.shape
    reach = max(width, steps) + 1  # a walk takes no more than one letter a step
    letters = np.zeros((n, reach), np.uint8)
    letters[:, :width] = np.where(np.arange(width) < lengths[:, None], windows, 0)
    letters = letters.reshape(-1)
    moves = np.stack([np.random.default_rng(s).integers(0, 2, (steps, 256), dtype=np.uint8) for s in seeds], 1).reshape(steps, -1)
    at = np.tile(np.arange(n, dtype=np.int64) * reach, len(seeds))
    table = np.repeat(np.arange(len(seeds), dtype=np.int64) * 256, n)
    out = np.zeros((steps, len(at)), np.uint8)
    for t in range(steps):
        out[t] = letters[at]
        at += moves[t][table + out[t]]
    return out.reshape(steps, len(seeds), n)


class Items:
    """A block of benchmark items, with the grams that propose windows and the classes of length that share tables."""

    def __init__(self, rows: list[tuple[int, str]], share: float = SHARE):
        self.share = share
        self.ids = [i for i, _ in rows]
        self.bytes = [plain(t) for _, t in rows]
        self.texts = [b.decode("utf-8", "replace") for b in self.bytes]
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.kind = (np.log(np.maximum(self.sizes, 1)) / np.log(CLASS)).astype(np.int64)
        self.longest = int(self.sizes.max(initial=0))
        keys, items, places = [], [], []
        self.short: dict[int, dict[bytes, list[int]]] = {}  # items under a gram, by their number of words
        # bytes that grams in line must cover: no more than all grams of the item do, and one gram at least
        self.need = np.maximum(GRAM, COVER[0] + COVER[1] * self.sizes)
        for k, b in enumerate(self.bytes):
            if len(b) >= GRAM:
                at, key = grams(np.frombuffer(b + bytes(GRAM), np.uint8), len(b))
                keys.append(key)
                items.append(np.full(len(at), k))
                places.append(at)
                self.need[k] = min(self.need[k], GRAM + np.minimum(np.diff(at), GRAM).sum())
            elif b:
                self.short.setdefault(b.count(b" ") + 1, {}).setdefault(b, []).append(k)
        key = np.concatenate([*keys, np.zeros(0, np.uint64)])
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.item = np.concatenate([*items, np.zeros(0, np.int64)]).astype(np.int64)[order]
        self.place = np.concatenate([*places, np.zeros(0, np.int64)]).astype(np.int64)[order]
        self.seen = np.zeros(1 << SEEN_BITS, bool)
        self.seen[(self.key >> np.uint64(64 - SEEN_BITS)).astype(np.int64)] = True

    def found(self, at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the grams that items have too, with where the items' list of each begins and how many items have it."""
        on = np.flatnonzero(self.seen[(key >> np.uint64(64 - SEEN_BITS)).astype(np.int64)])
        at, key = at[on], key[on]
        low, high = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        return at, low, high - low

    def proposals(self, at: np.ndarray, low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(item, begin, place)`` of each gram of the texts and each item that has it."""
        which = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        place = self.place[which]
        return self.item[which], np.repeat(at, count) - place, place


def grams(b: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Places up to ``end - GRAM`` and a hash of the bytes from each letter or digit; ``b`` is padded."""
    own = b[: max(0, end - GRAM + 1)]
    at = np.flatnonzero((own != 32) & (own & 0xC0 != 0x80))
    return at, _keys(b, at)


def _keys(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    eight = np.ndarray((len(b) - 7,), "<u8", b, strides=(1,)) if len(b) >= 8 else np.zeros(0, "<u8")
    with np.errstate(over="ignore"):
        key = (eight[at] * np.uint64(0x9E3779B97F4A7C15)) ^ (eight[at + GRAM - 8] + np.uint64(0x632BE59BD9B4E019))
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return key ^ (key >> np.uint64(32))


def _windows(items: Items, at, low, count) -> tuple[np.ndarray, np.ndarray]:
    """Item-sized windows ``(item, begin)``: where grams in line with the item's cover enough of its bytes."""
    item, begin, place = items.proposals(at, low, count)
    if not len(item):
        return item, begin
    order = np.argsort(item * (1 << 40) + begin + (1 << 30), kind="stable")  # a text that is looked at at once has under 2 ** 30 bytes
    item, begin, place = item[order], begin[order], place[order]
    new = np.concatenate([[True], (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > SLACK)])
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    in_line = np.sort(group * (1 << 30) + place)
    in_line, place = in_line >> 30, in_line & ((1 << 30) - 1)
    step = np.minimum(np.diff(place, prepend=0), GRAM)
    step[np.flatnonzero(np.diff(in_line, prepend=-1))] = GRAM
    size = np.diff(np.concatenate([first, [len(item)]]))
    on = np.bincount(in_line, weights=step) >= items.need[item[first]]
    return item[first[on]], begin[first[on] + size[on] // 2]


def _sampled(walks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Keys of each walk (column): ``SAMPLED`` letters, for each of the tables of a repeat."""
    return np.ascontiguousarray(walks[at].T).view(np.uint32)


def _meet(mine: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(row of mine, row of known)`` with one key in some table (column)."""
    rows, items = [], []
    for t in range(known.shape[1]):
        order = np.argsort(known[:, t], kind="stable")
        keys = known[order, t]
        low, high = np.searchsorted(keys, mine[:, t], "left"), np.searchsorted(keys, mine[:, t], "right")
        count = high - low
        rows.append(np.repeat(np.arange(len(mine)), count))
        items.append(order[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))])
    return np.concatenate(rows), np.concatenate(items)


def _places(repeat: int, length: int) -> np.ndarray:
    """Steps of the walks of a repeat whose letters are drawn: ``SAMPLED`` for the whole walk, then for each stretch of it."""
    share = np.random.default_rng((SEED, repeat)).random((1 + STRETCHES, SAMPLED))
    share[1:] = (share[1:] + np.arange(STRETCHES)[:, None]) / STRETCHES
    return (share.reshape(-1) * 2 * length).astype(np.int64)


def candidates(items: Items, item: np.ndarray, windows: list[bytes], repeats: int = REPEATS) -> list[tuple[int, int]]:
    """Pairs ``(window, item)`` that have keys in common in the tables.

    Each repeat embeds all items of one class of length and the windows of their size, and has a table of keys for the
    whole walk and one for each stretch of it: walks that edits threw apart have met again in some of them. A key is
    ``SAMPLED`` letters, at places drawn from as many steps as twice the length, since a walk moves about one letter in
    two. The draws follow from repeat and class alone and not from what else is looked at. A pair is a candidate when it has met in
    ``MEET`` tables: of pairs at a fifth of the length in edits 99 % do, of others 3 %. A window asks until
    the item that it was proposed for has, and meets any other item of the tables on the way; one that has not met its
    item in the first ``HOPE`` embeddings asks no more.
    """
    met_all: list[np.ndarray] = []
    kinds, n = items.kind[item], max(1, len(items.ids))
    for kind in np.unique(kinds).tolist():
        used = np.flatnonzero((items.kind == kind) & (items.sizes >= GRAM))
        shortest, width = int(np.ceil(CLASS**kind)), int(items.sizes[used].max())
        known = np.frombuffer(b"".join(items.bytes[k].ljust(width, b"\0") for k in used.tolist()), np.uint8).reshape(len(used), width)
        lot = max(1, WALK_BYTES // width)
        mine = np.flatnonzero(kinds == kind)
        for s in range(0, len(mine), lot):
            left = mine[s : s + lot]
            text = np.frombuffer(b"".join(windows[k].ljust(width, b"\0")[:width] for k in left.tolist()), np.uint8).reshape(len(left), width)
            length, times = items.sizes[item[left]], np.zeros(len(left), np.int64)
            for first in range(0, repeats, TOGETHER):
                drawn = range(first, min(repeats, first + TOGETHER))
                places = [_places(r, shortest) for r in drawn]
                both, sizes = np.concatenate([text, known]), np.concatenate([length, items.sizes[used]])
                walks = cgk(both, sizes, max(int(p.max()) for p in places) + 1, [SEED + r for r in drawn])
                for k, at in enumerate(places):
                    keys = _sampled(walks[:, k], at)
                    row, met = _meet(keys[: len(left)], keys[len(left) :])
                    met_all.append(left[row] * n + used[met])
                    times += np.bincount(row[used[met] == item[left[row]]], minlength=len(left))
                more = (times < MEET) & ((times > 0) | (first + TOGETHER != HOPE))
                if not more.all():
                    left, text, length, times = left[more], text[more], length[more], times[more]
                if not len(left):
                    break
    pairs, count = np.unique(np.concatenate([*met_all, np.zeros(0, np.int64)]), return_counts=True)
    return [divmod(p, n) for p in pairs[count >= MEET].tolist()]


class _Scanner:
    """Windows of the texts of a task; they are kept until there are many, so that the walks run over many at once."""

    def __init__(self, items: Items):
        self.items = items
        self.rows: list[tuple] = []  # doc_id, item, window, text around it

    def propose(self, ids: list, texts: list[bytes]) -> list[tuple]:
        """Take in some texts; pairs with short items come back at once."""
        self._propose(ids, texts)
        items, found = self.items, []
        for n, known in items.short.items():
            for i, t in zip(ids, texts, strict=True):
                words = t.split()
                for phrase in known.keys() & (set(words) if n == 1 else {b" ".join(w) for w in zip(*(words[k:] for k in range(n)), strict=False)}):
                    found += [(i, items.ids[k], 0, len(items.texts[k])) for k in known[phrase]]
        return found

    def _propose(self, ids: list, texts: list[bytes]) -> None:
        items, raw = self.items, b"".join(texts)
        starts = np.cumsum([0, *map(len, texts)])
        at, key = grams(np.frombuffer(raw + bytes(GRAM), np.uint8), len(raw))
        at, low, count = items.found(at, key)
        overlap = 2 * items.longest + 64
        if int(count.sum()) > HITS and (len(texts) > 1 or len(raw) > LEAST_PIECE + 2 * overlap):  # grams that very many items have: in halves, which hold each window whole
            half = len(texts) // 2
            if half:
                parts = [(ids[:half], texts[:half]), (ids[half:], texts[half:])]
            else:
                parts = [(ids, [raw[: len(raw) // 2 + overlap]]), (ids, [raw[len(raw) // 2 - overlap :]])]
            for part in parts:
                self._propose(*part)
            return
        item, begin = _windows(items, at, low, count)
        middle = begin + items.sizes[item] // 2
        own = np.searchsorted(starts, np.clip(middle, 0, len(raw) - 1), side="right") - 1
        for k, first, d in zip(item.tolist(), begin.tolist(), own.tolist(), strict=True):
            length = len(items.bytes[k])
            room = int(items.share * length) + 2 * SLACK
            low, high = max(first - room, int(starts[d])), min(first + length + room, int(starts[d + 1]))
            self.rows.append((ids[d], k, raw[max(first, low) : max(first, low) + length], raw[low:high]))

    def verified(self) -> list[tuple]:
        items, rows, self.rows = self.items, self.rows, []
        if not rows:
            return []
        pairs = candidates(items, np.array([r[1] for r in rows]), [r[2] for r in rows])
        pairs += [(h, r[1]) for h, r in enumerate(rows) if items.bytes[r[1]] in r[3]]
        best: dict[tuple, int] = {}
        for h, k in pairs:
            doc_id, _, _, around = rows[h]
            if best.get((doc_id, k)) == 0:
                continue
            room = int(items.share * len(items.texts[k]))
            edits, _ = edit_distance_within(items.texts[k], around.decode("utf-8", "replace"))
            if edits <= room:
                best[doc_id, k] = min(edits, best.get((doc_id, k), edits))
        return [(d, items.ids[k], e, len(items.texts[k])) for (d, k), e in best.items()]


def _scan(items_sent):
    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], names=["doc_id", "item_id", "edits", "item_chars"])

    def run(batches):
        scanner = _Scanner(items_sent.value)
        texts, ids, size, out = [], [], 0, []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts.append(plain(text) + b" \0 ")
                ids.append(doc_id)
                size += len(texts[-1])
                if size >= STRETCH:
                    out += scanner.propose(ids, texts)
                    texts, ids, size = [], [], 0
                    if len(scanner.rows) >= 20_000:
                        yield batch_of(scanner.verified())
        if texts:
            out += scanner.propose(ids, texts)
        yield batch_of(out + scanner.verified())

    return run


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of a fixed size; each block is a pass over the documents."""
    block, size = [], 0
    for r in benchmark.select(F.col(id_col).cast("long"), F.col(text_col)).filter(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1])
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", share: float = SHARE) -> DataFrame:
    """Pairs of a document and a benchmark item that a passage of it repeats: ``doc_id, item_id, edits, item_chars``.

    Both texts are lower-cased, with one space for what is neither letter nor digit. A leak is a passage within
    ``share`` of the item's length in edits; ``edits`` is the exact distance of the best passage found near a window.

    Windows of an item's size are taken where 8-byte grams, from all letters of the whole text, stand in line with the
    item's and cover six of its bytes and 8 % of its length (or all that its grams cover). Each window asks the tables of up
    to 64 CGK embeddings, whose keys are four sampled letters, for items of about its length;
    what it meets there in four tables is verified exactly. A verbatim passage is always found; recall under edits is measured
    against brute force in the tests. Items of under 8 bytes leak where they stand as whole words.

    Null and empty texts leak nothing, null items and ids of items are left out, repeated rows of documents are one pair
    with the least distance, and an empty side gives no rows. The benchmark is a query set and is sent
    in blocks of at most 20,000 items or 16 MB, whatever its size.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ddl = "doc_id long, item_id long, edits long, item_chars long"
    out = None
    for block in item_blocks(benchmark, item_id_col, item_text_col):
        one = rows.mapInArrow(_scan(spark.sparkContext.broadcast(Items(block, share))), ddl)
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], ddl)
    return out.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"), F.max("item_chars").alias("item_chars"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """The rows of ``docs`` without a leak, with all their columns. Rows are told apart by a hash of id and text, so of rows that share an id, or have none, those go that leak."""
    key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))
    (leak,) = free_names(docs, "__leak")
    found = leaks(docs.select(key.alias("row"), F.col(text_col).alias("own")), benchmark, "row", "own", **names)
    return docs.join(found.select(F.col("doc_id").alias(leak)).distinct(), key == F.col(leak), "left_anti")
