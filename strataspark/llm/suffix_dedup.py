"""Removal of long repeated strings, by sparse suffix arrays sorted deep-shallow."""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, ship_package

WIDTH = 400  # bytes of a string that counts when it repeats
GRAM = 64  # bytes of the gram that anchors a string
STRETCH = 1 << 20
SHALLOW = 24  # bytes behind the gram that multikey quicksort looks at; blind tries order what is still equal
PAIRS = 24  # members of an anchor up to which they are compared pair by pair
DEAL = 256  # distinct surroundings of an anchor above which its windows are dealt by what they must share
RANGES = 8  # ranges of distances that they are dealt in
SPLIT = 50_000  # distinct surroundings of an anchor above which strings are counted one by one


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the 64 bytes from each place, by doubling."""
    h, reach = b.astype(np.uint64) + np.uint64(1), 1
    for mult in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
        h = h[:-reach] * np.uint64(mult) + h[reach:]
        reach *= 2
        h ^= h >> np.uint64(29)
    h *= np.uint64(0x8EBC6AF09C88C6E3)
    h ^= h >> np.uint64(32)
    return h


def _window_min(h: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    rest = width - have
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def anchors(b: np.ndarray, ends: np.ndarray, width: int = WIDTH):
    """``(gram hash, anchor, first, last)``: runs of windows (by their places) with one leftmost least gram.

    ``ends`` are the ends of the texts that ``b`` is joined from; no window crosses them. Equal
    strings have equal anchors at equal distances, so a string repeats only among windows of one gram.
    """
    if len(b) < width:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    with np.errstate(over="ignore"):
        h = _gram_hashes(b)
    keyed = (h & np.uint64(~((1 << 24) - 1) & (2**64 - 1))) | np.arange(len(h), dtype=np.uint64)
    at = (_window_min(keyed, width - GRAM + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    # windows that stay within their text
    step = np.zeros(len(b) + 1, np.int32)
    long = ends - starts >= width
    np.add.at(step, starts[long], 1)
    np.add.at(step, ends[long] - width + 1, -1)
    valid = np.cumsum(step)[: len(at)] > 0
    change = np.flatnonzero((at[1:] != at[:-1]) | (valid[1:] != valid[:-1])) + 1
    first = np.concatenate([[0], change])
    last = np.concatenate([change - 1, [len(at) - 1]])
    on = valid[first]
    first, last = first[on], last[on]
    anchor = at[first]
    return h[anchor], anchor, first, last


_ROWS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("gram", pa.int64()), ("sign", pa.binary()), ("a", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])
_ROWS_DDL = "k1 long, k2 long, gram long, sign binary, a long, lo int, hi int"


def _list_anchors(batches):
    """Rows of all texts: the anchor ``a``, the distances ``lo..hi`` of its windows before it, and a 128-bit sign of the bytes they cover."""
    held, keys, size = [], [], 0

    def listed():
        raw = b"".join(t for t, _ in held)
        offsets = np.array([o for _, o in held], np.int64)
        ends = np.cumsum([len(t) for t, _ in held])
        gram, anchor, first, last = anchors(np.frombuffer(raw, np.uint8), ends)
        own = np.searchsorted(ends, anchor, side="right")
        sign = xxhash.xxh3_128_digest
        signs = [sign(raw[f : e + WIDTH], a - f) for a, f, e in zip(anchor.tolist(), first.tolist(), last.tolist(), strict=True)]
        starts = np.concatenate([[0], ends[:-1]])
        k = np.array(keys, np.int64).reshape(-1, 2)[own]
        columns = [k[:, 0], k[:, 1], gram.view(np.int64), signs, anchor - starts[own] + offsets[own], (anchor - last).astype(np.int32), (anchor - first).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROWS, strict=True)], schema=_ROWS)

    for batch in batches:
        for k1, k2, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if text is None or len(text) < WIDTH:
                continue
            for s in range(0, len(text) - WIDTH + 1, STRETCH):
                part = text[s : s + STRETCH + WIDTH - 1]
                held.append((part, s))
                keys.append((k1, k2))
                size += len(part)
                if size >= STRETCH:
                    yield listed()
                    held, keys, size = [], [], 0
    if held:
        yield listed()


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n - 1
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class BlindTrie:
    """Orders strings with long common prefixes: branches hold a depth and one byte a child, so a new string goes down
    blindly, is compared once with the leaf it reaches, and is hung where the two part."""

    def __init__(self):
        self.root = None

    def add(self, strings, i: int) -> None:
        s = strings[i]
        if self.root is None:
            self.root = [i]
            return
        node = self.root
        while isinstance(node, dict):
            d = node["depth"]
            byte = s[d] if d < len(s) else -1
            node = node["next"].get(byte) or next(iter(node["next"].values()))
        depth = common(s, strings[node[0]])
        other = strings[node[0]]
        if depth == len(s) == len(other):
            node.append(i)
            return
        parent, step, node = None, None, self.root
        while isinstance(node, dict) and node["depth"] < depth:
            d = node["depth"]
            parent, step = node, (s[d] if d < len(s) else -1)
            node = node["next"][step]
        own = s[depth] if depth < len(s) else -1
        if isinstance(node, dict) and node["depth"] == depth:
            node["next"][own] = [i]
            return
        branch = {"depth": depth, "next": {own: [i], (other[depth] if depth < len(other) else -1): node}}
        if parent is None:
            self.root = branch
        else:
            parent["next"][step] = branch

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, dict):
                stack.extend(node["next"][k] for k in sorted(node["next"], reverse=True))
            elif node is not None:
                out.extend(node)
        return out


def deep_shallow(strings: list[bytes], skip: int, shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Sorted order of ``strings`` (equal in their first ``skip`` bytes or not) and the common prefix of each with the one before.

    Multikey quicksort partitions by one byte at a time down to ``skip + shallow``; groups that are still equal
    there have long common prefixes and go to a blind trie.
    """
    order: list[int] = []
    limit = skip + shallow
    stack = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) == 1:
            order += group
            continue
        if depth == 0 and skip:
            head = strings[group[0]][:skip]
            if all(strings[i][:skip] == head for i in group):
                depth = skip
        if depth >= limit:
            trie = BlindTrie()
            for i in group:
                trie.add(strings, i)
            order += trie.order()
            continue
        byte = [strings[i][depth] if depth < len(strings[i]) else -1 for i in group]
        pivot = byte[len(byte) // 2]
        less = [i for i, c in zip(group, byte, strict=True) if c < pivot]
        same = [i for i, c in zip(group, byte, strict=True) if c == pivot]
        more = [i for i, c in zip(group, byte, strict=True) if c > pivot]
        if more:
            stack.append((more, depth))
        stack.append((same, depth + 1 if pivot >= 0 else limit))
        if less:
            stack.append((less, depth))
    return order, [0, *[common(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False)]]


def _ranges(marks: np.ndarray, base: int) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return [(base + int(s), base + int(e) - 1) for s, e in zip(edge[::2], edge[1::2], strict=True)]


def repeated_distances(members: list[tuple[bytes, int, int]], pairs: int = PAIRS) -> list[list[tuple[int, int]]]:
    """For each member of an anchor (its bytes, ``lo``, ``hi``) the ranges of distances whose window another member has too.

    The anchor stands ``hi`` bytes into the member. Windows at one distance ``o`` are equal if the texts
    agree for ``o`` bytes to the left and for ``WIDTH - o`` to the right of the anchor.
    """
    n = len(members)
    right = [b[hi:] for b, _, hi in members]
    order, shared = deep_shallow(right, GRAM)
    marks = [np.zeros(hi - lo + 1, bool) for _, lo, hi in members]
    if n <= pairs:
        left = [b[:hi][::-1] for b, _, hi in members]
        for x in range(n):
            reach = WIDTH
            i = order[x]
            _, lo, hi = members[i]
            for y in range(x + 1, n):
                reach = min(reach, shared[y])
                if reach < GRAM:
                    break
                j = order[y]
                _, lo2, hi2 = members[j]
                a, b = max(lo, lo2, WIDTH - reach), min(hi, hi2)
                if a <= b:
                    b = min(b, common(left[i], left[j]))
                    if a <= b:
                        marks[i][a - lo : b - lo + 1] = True
                        marks[j][a - lo2 : b - lo2 + 1] = True
    else:
        left = [b[:hi][::-1] for b, _, hi in members]
        order_l, shared_l = deep_shallow(left, 0)
        lcp_r, lcp_l = np.array(shared), np.array(shared_l)
        lows, highs = np.array([m[1] for m in members]), np.array([m[2] for m in members])
        rank_r, rank_l = np.empty(n, np.int64), np.empty(n, np.int64)
        for o in range(int(lows.min()), int(highs.max()) + 1):
            rank_r[order] = np.cumsum(lcp_r < WIDTH - o)
            rank_l[order_l] = np.cumsum(lcp_l < o)
            on = np.flatnonzero((lows <= o) & (o <= highs))
            _, back, count = np.unique(rank_r[on] * (n + 1) + rank_l[on], return_inverse=True, return_counts=True)
            for i in on[count[back] > 1].tolist():
                marks[i][o - members[i][1]] = True
    return [_ranges(m, lo) for m, (_, lo, _) in zip(marks, members, strict=True)]


_FOUND = pa.schema([("gram", pa.int64()), ("sign", pa.binary()), ("o1", pa.int32()), ("o2", pa.int32())])
_FOUND_DDL = "gram long, sign binary, o1 int, o2 int"


def _sort_anchors(pairs: int):
    """Partitions come sorted by key; each key's members are ordered and compared by themselves."""

    def batch_of(found):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], f.type) for k, f in enumerate(_FOUND)], schema=_FOUND)

    def run(batches):
        rows = (r for batch in batches for r in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True))
        out = []
        for _, group in itertools.groupby(rows, key=lambda r: r[0]):
            members = list(group)
            if len(members) < 2:
                continue
            found = repeated_distances([(b, lo, hi) for *_, b, lo, hi in members], pairs)
            out += [(m[1], m[2], a, b) for m, spans in zip(members, found, strict=True) for a, b in spans]
            if len(out) > 50_000:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    return run


_DEALT = pa.schema([("key", pa.int64()), ("gram", pa.int64()), ("sign", pa.binary()), ("b", pa.binary()), ("lo", pa.int32()), ("hi", pa.int32())])
_DEALT_DDL = "key long, gram long, sign binary, b binary, lo int, hi int"


def _deal(batches):
    """Members of anchors with very many surroundings, one row for each range of distances, with a key of what its windows share.

    Windows at distances ``a..z`` that are equal agree in the ``a`` bytes before the anchor and the ``WIDTH - z`` from it on.
    So equal windows get one key, and members that differ there are not brought together.
    """
    width = -(-(WIDTH - GRAM + 1) // RANGES)
    for batch in batches:
        out = []
        for gram, sign, b, lo, hi in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            for part in range(lo // width, hi // width + 1):
                a, z = max(lo, part * width), min(hi, part * width + width - 1)
                first, last = part * width, min(part * width + width - 1, WIDTH - GRAM)
                key = xxhash.xxh3_64_intdigest(b[hi - first : hi + WIDTH - last], gram % 2**64) ^ part
                out.append((key - (1 << 64) if key >> 63 else key, gram, sign, b[hi - z : hi - a + WIDTH], a, z))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_DEALT)], schema=_DEALT)


def _list_windows(batches):
    for batch in batches:
        for gram, sign, b, lo, hi in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            o = list(range(lo, hi + 1))
            own = [xxhash.xxh3_128_digest(b[hi - k : hi - k + WIDTH], k) for k in o]
            yield pa.RecordBatch.from_arrays(
                [pa.array([gram] * len(o), pa.int64()), pa.array([sign] * len(o), pa.binary()), pa.array(o, pa.int32()), pa.array(own, pa.binary())], names=["gram", "sign", "o", "own"]
            )


def _cut(batches):
    """Results of each text, from its removed spans."""
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            text = text or b""
            at = removed = runs = 0
            kept = hashlib.sha256()
            for s, e in merged_spans(spans or ()):
                kept.update(text[at:s])
                removed, runs, at = removed + e - s, runs + 1, e
            kept.update(text[at:])
            out.append((len(text), removed, runs, kept.hexdigest()))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in out], t) for k, t in enumerate(types)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def merged_spans(spans) -> list[tuple[int, int]]:
    """Union of half-open spans, in order; touching ones join."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) if isinstance(x, dict) else tuple(x) for x in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def repeated_spans(keyed: DataFrame) -> DataFrame:
    """``k1, k2, spans`` (array of ``struct<s long, e long>``) of the bytes to remove; ``keyed`` has ``k1, k2, bytes``.

    1. Windows of 400 bytes are gathered into runs with one anchor gram (a minimizer), some 170 windows a row.
    2. Rows whose bytes are the same become one member with a count, before the shuffle. Anchors that occur once end here.
    3. Members of an anchor with other surroundings fetch their bytes and are sorted by
       the suffix at the anchor; neighbours in that order show which windows repeat. An anchor with very many
       surroundings is dealt first, by bytes that equal windows share, so that no task gets all of it.
    4. Removed ranges go back to all rows of the member, and to their texts.
    """
    ship_package(keyed.sparkSession)
    rows = materialise(keyed.mapInArrow(_list_anchors, _ROWS_DDL), "anchors")
    members = rows.groupBy("gram", "sign").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "a", "lo", "hi")).alias("at")
    )
    sizes = members.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("total")).filter("total > 1")
    sizes = materialise(sizes, "anchor-sizes")  # both sides of a join are then plain exchanges, which adaptive execution can split
    live = materialise(members.join(sizes, "gram").select("gram", "sign", "n", "kinds", "at.*"), "anchor-members")
    whole = live.filter("n > 1").select("gram", "sign", F.col("lo").alias("o1"), F.col("hi").alias("o2"))
    asked = live.filter("kinds > 1").groupBy("k1", "k2").agg(F.collect_list(F.struct("gram", "sign", "n", "kinds", "a", "lo", "hi")).alias("ms"))
    cut = F.transform("ms", lambda m: F.struct(
        m["gram"].alias("gram"), m["sign"].alias("sign"), m["n"].alias("n"), m["kinds"].alias("kinds"), m["lo"].alias("lo"), m["hi"].alias("hi"),
        F.substring(F.col("bytes"), (m["a"] - m["hi"] + 1).cast("int"), m["hi"] - m["lo"] + WIDTH).alias("b"),
    ))
    fetched = keyed.join(asked, ["k1", "k2"]).select(F.explode(cut).alias("m")).select("m.*")
    fetched = materialise(fetched, "anchor-bytes")
    spark = keyed.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    usual = fetched.filter(F.col("kinds") <= DEAL).select(F.col("gram").alias("key"), "gram", "sign", "b", "lo", "hi")
    many = fetched.filter((F.col("kinds") > DEAL) & (F.col("kinds") <= SPLIT)).select("gram", "sign", "b", "lo", "hi").mapInArrow(_deal, _DEALT_DDL)
    sorted_ = usual.unionByName(many).repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_sort_anchors(PAIRS), _FOUND_DDL)
    windows = fetched.filter(F.col("kinds") > SPLIT).select("gram", "sign", "b", "lo", "hi").distinct().mapInArrow(_list_windows, "gram long, sign binary, o int, own binary")
    common_windows = windows.groupBy("gram", "own").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    counted = windows.join(common_windows, ["gram", "own"]).select("gram", "sign", F.col("o").alias("o1"), F.col("o").alias("o2"))
    ranges = whole.unionByName(sorted_).unionByName(counted).groupBy("gram", "sign").agg(F.collect_set(F.struct("o1", "o2")).alias("rs"))
    ranges = materialise(ranges, "anchor-ranges")
    hits = rows.join(ranges, ["gram", "sign"]).select("k1", "k2", F.explode(F.transform("rs", lambda r: F.struct((F.col("a") - r["o2"]).alias("s"), (F.col("a") - r["o1"] + WIDTH).alias("e")))).alias("x"))
    return hits.groupBy("k1", "k2").agg(F.collect_list("x").alias("spans"))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    Each byte covered by a 400-byte string that also starts elsewhere, in the same or another text, is removed;
    strings are judged on the input. Null and empty texts have no bytes and keep the digest of
    nothing; shorter texts keep all. A repeated row repeats all of its strings. Rows without an id are told apart by
    their text. Other columns are not looked at.

    A text is known by its id and a hash of id and text. Copies are counted before any
    shuffle, so a passage that a third of the texts share is one member.
    """
    keyed = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("k1"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("k2"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("bytes"),
    )
    spans = repeated_spans(keyed.select("k1", "k2", "bytes"))
    ready = keyed.join(spans, ["k1", "k2"], "left").select("doc_id", "bytes", "spans")
    return ready.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
