"""SimHash near-duplicates with pigeonring filtering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..session import materialise, release, ship_package
from .names import free_names

SEED = 42
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_PART = 1 << 15

# Ring of five segments for two differing bits: of five segments at least three are equal, so two neighbours are.
SEGMENTS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
MAX_BITS = 2
BUCKET = 64  # pairs are compared within buckets up to this size; larger ones go by one-bit variants


def shingle_hashes(text: str | None, words: int):
    """XXH64 of each run of ``words`` words, in parts; the whole sequence if there are fewer."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return
    n = len(found) - words + 1
    joined = b" ".join(found)
    if n <= 1:
        yield np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, _PART):
        m = min(n, k + _PART)
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k:m].tolist(), ends[k + words - 1 : m + words - 1].tolist(), strict=True)], np.uint64)


def _ones(h: np.ndarray) -> np.ndarray:
    return np.add.reduce(np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint32)


def _spread(h: np.ndarray, lane: int) -> np.ndarray:
    """Further 64 hash bits for each shingle hash; lane 0 is the hash itself."""
    if lane:
        h = h + np.uint64((0x9E3779B97F4A7C15 * lane) & (2**64 - 1))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(31))
    return h


def fingerprint(text: str | None, words: int, lanes: int = 1, distinct: bool = False) -> np.ndarray:
    """``lanes`` 64-bit words: a bit is one if it is set in over half the (distinct) shingle hashes; zero without words."""
    ones, n = np.zeros((lanes, 64), np.int64), 0
    parts = shingle_hashes(text, words)
    if distinct:
        parts = [np.unique(np.concatenate(found))] if (found := list(parts)) else []
    with np.errstate(over="ignore"):
        for h in parts:
            n += len(h)
            for lane in range(lanes):
                ones[lane] += _ones(_spread(h, lane))
    bits = (2 * ones > n) if n else np.zeros((lanes, 64), bool)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]


def _fingerprints(words: int, lanes: int, distinct: bool):
    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = np.array([fingerprint(t, words, lanes, distinct) for t in texts], np.uint64).reshape(-1, lanes)
            columns = [pa.array(found[:, k].view(np.int64)) for k in range(lanes)]
            rest = range(2, batch.num_columns)
            names = ["doc_id", *[batch.schema.names[k] for k in rest], *[f"f{k}" for k in range(lanes)]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[batch.column(k) for k in rest], *columns], names=names)

    return run


def fingerprints(docs: DataFrame, words: int, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text", distinct: bool = False, hashed: bool = False) -> DataFrame:
    """``doc_id, f0, f1, ..`` (signed longs with the bits of the fingerprint); ``hashed`` adds ``t``, a hash of the text."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.xxhash64(text_col).alias("t")] * hashed)
    ddl = ["doc_id long", *["t long"] * hashed, *[f"f{k} long" for k in range(lanes)]]
    return rows.mapInArrow(_fingerprints(words, lanes, distinct), ", ".join(ddl))


def _segment(fp: Column, i: int) -> Column:
    at, width = SEGMENTS[i % len(SEGMENTS)]
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))


def _ring_key(fp: Column, i: int) -> Column:
    """Chain start ``i`` with the contents of segments ``i`` and ``i + 1``."""
    return F.shiftleft(F.lit(i).cast("long"), 32).bitwiseOR(F.shiftleft(_segment(fp, i), 13)).bitwiseOR(_segment(fp, i + 1))


def _chain_holds(x: Column, start: Column) -> Column:
    """Chain test on the differing bits ``x``: from ``start`` on, any ``l`` segments differ in at most ``l * 2 / 5`` bits."""
    diff = [F.bit_count(_segment(x, i)) for i in range(5)]
    tests = []
    for i in range(5):
        total, ok = F.lit(0), F.lit(True)
        for n in range(1, 6):
            total = total + diff[(i + n - 1) % 5]
            ok = ok & (total <= n * MAX_BITS // 5)
        tests.append((start == i) & ok)
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def fingerprint_links(unique: DataFrame) -> DataFrame:
    """Links ``u, v`` with the components of all pairs of ``fp`` at two bits or fewer; ``unique`` has each ``fp`` once.

    Two fingerprints that link have a place on the ring from where the first two of five segments are
    equal and every longer chain stays within its share of the two bits. So each is
    filed under five pairs of neighbouring segments; within a bucket the chain test
    prunes the pairs before the full Hamming check.

    A bucket of over 64 fingerprints makes no pairs: each is filed under itself and its one-bit
    variants (outside the shared segments), and hung on the least one of each file. Those of a file are at two
    bits or fewer, and two that link always share a file, so no link is lost and rows grow in proportion.
    """
    fp = F.col("fp")
    filed = unique.select("fp", F.explode(F.array(*[_ring_key(fp, i) for i in range(5)])).alias("key"))
    sizes = filed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = materialise(filed.join(sizes, "key"), "simhash-buckets")
    small = shared.filter(F.col("n") <= BUCKET).select("key", "fp")
    other = small.select("key", F.col("fp").alias("other"))
    x = F.col("fp").bitwiseXOR(F.col("other"))
    pairs = small.join(other, "key").filter(F.col("fp") < F.col("other")).filter(_chain_holds(x, F.shiftright("key", 32)))
    near = pairs.filter(F.bit_count(x) <= MAX_BITS).select(F.col("fp").alias("u"), F.col("other").alias("v"))
    flips = [F.lit(0).cast("long"), *[F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long") for b in range(64)]]
    large = shared.filter(F.col("n") > BUCKET).select("key", "fp", F.explode(F.array(*flips)).alias("flip"))
    large = large.filter((F.col("flip") == 0) | (_ring_of(F.col("fp"), F.col("key")) == _ring_of(F.col("fp").bitwiseXOR(F.col("flip")), F.col("key"))))
    large = large.select("key", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("file"))
    least = large.groupBy("key", "file").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    hung = large.join(least, ["key", "file"]).filter("fp <> v").select(F.col("fp").alias("u"), "v")
    return near.unionByName(hung)


def _ring_of(fp: Column, key: Column) -> Column:
    start = F.shiftright(key, 32)
    out = _ring_key(fp, 0)
    for i in range(1, 5):
        out = F.when(start == i, _ring_key(fp, i)).otherwise(out)
    return out


def simhash_components(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id``.

    Words are what white space separates, letters A to Z in lower case. ``fingerprint`` has 16 hex digits;
    texts without words (null and empty ones too) have zero, and link like any other.
    ``component_id`` is the least id that links of two bits or fewer reach. Repeated rows have one fingerprint;
    rows without an id never name a component unless it has no other.

    Equal fingerprints become one row before any pairing, so a group of copies is one
    point of the graph however large it is; only the map back to documents sees it, in a
    join that adaptive execution can split.
    """
    marked = materialise(fingerprints(docs, words, 1, id_col, text_col).withColumnRenamed("f0", "fp"), "simhash")
    unique = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-unique")
    roots = components(fingerprint_links(unique)).withColumnRenamed("node", "fp")
    rooted = unique.join(roots, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    place = rooted.select("fp", "root").join(names, "root").select("fp", "component_id")
    return marked.join(place, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near-duplicates at a similarity: 256 bits, of which pairs of shingle sets with Jaccard 0.8 differ in 0.15.
LANES = 4
TABLES = 128
FIRST = 24  # tables whose links are made before the others, which then only link what is still apart
KEY_BITS = 20
HOT = 50_000  # prints of one key above which its rows are dealt to several tasks
COUNTED = 64  # one print of so many is counted to tell such keys
SMALL = 16  # rows of a bucket up to which all its pairs are candidates
RING = 8  # segments of the ring in the chain test


def bits_for(similarity: float) -> int:
    """Differing bits of 256 that sets of one size with this Jaccard similarity have, and two standard deviations more."""
    cosine = 2 * similarity / (1 + similarity)
    share = np.arccos(cosine) / np.pi
    total = 64 * LANES
    return int(round(total * share + 2 * (total * share * (1 - share)) ** 0.5))


def _samples() -> np.ndarray:
    """For each table the places of its key bits: chains of neighbours on rings of the 256 bits in several fixed orders."""
    total, out = 64 * LANES, []
    per_ring = total // KEY_BITS
    rng = np.random.default_rng(SEED)
    while len(out) < TABLES:
        order = rng.permutation(total)
        out += [order[k * KEY_BITS : (k + 1) * KEY_BITS] for k in range(per_ring)]
    return np.array(out[:TABLES])


def _file_keys(first: int, last: int):
    """Rows ``key, node, label, f0..`` of each print in the tables from ``first`` to ``last``."""

    def run(batches):
        samples = _samples()[first:last]
        n = len(samples)
        weights = 1 << np.arange(KEY_BITS, dtype=np.int64)
        tables = np.arange(first, last, dtype=np.int64) << KEY_BITS
        for batch in batches:
            ids, labels = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            words = np.stack([batch.column(k + 2).to_numpy(zero_copy_only=False) for k in range(LANES)], 1).astype("<i8")
            for k in range(0, len(ids), 2000):
                own = words[k : k + 2000]
                bits = np.unpackbits(own.view(np.uint8).reshape(len(own), -1), axis=1, bitorder="little")
                keys = (bits[:, samples.reshape(-1)].reshape(len(own), n, KEY_BITS) @ weights) + tables
                columns = [np.repeat(c, n) for c in (ids[k : k + 2000], labels[k : k + 2000], *own.T)]
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), *map(pa.array, columns)], names=["key", "node", "label", *[f"f{j}" for j in range(LANES)]])

    return run


def _near(a: np.ndarray, rest: np.ndarray, most: int) -> np.ndarray:
    """Rows of ``rest`` within ``most`` bits of ``a``: the chain test on a ring of segments, then the whole distance."""
    diff = np.bitwise_count((rest ^ a).view(np.uint32))  # eight segments of 32 bits
    total = diff.sum(1, dtype=np.int64)
    holds = np.zeros(len(rest), bool)
    ring = np.concatenate([diff, diff], 1).astype(np.int64)
    for start in range(RING):
        sums = np.cumsum(ring[:, start : start + RING], axis=1)
        holds |= (sums * RING <= most * np.arange(1, RING + 1)).all(1)
    return holds & (total <= most)


def _hot_keys(asked: DataFrame, rows: int, first: int, last: int) -> DataFrame | None:
    """Keys that over ``HOT`` prints share, with the number of shares to deal them in; None if there is none.

    They are told from one print of ``COUNTED`` (by hash): a key of ``HOT`` has some 800 of those, far above the mark of half as many.
    The result is a plan for dealing rows out; every row is dealt.
    """
    if rows <= HOT:
        return None
    keys = _filed(asked.filter(F.pmod(F.xxhash64("node"), F.lit(COUNTED)) == 0), first, last).groupBy("key").agg((F.count(F.lit(1)) * COUNTED).alias("n"))
    hot = materialise(keys.filter(F.col("n") > HOT // 2).select("key", F.ceil(F.col("n") / (HOT // 2)).alias("shares")), "hot-keys")
    return None if hot.isEmpty() else hot


_LANES = [f"f{k}" for k in range(LANES)]


def _filed(asked: DataFrame, first: int, last: int) -> DataFrame:
    return asked.select("node", "label", *_LANES).mapInArrow(_file_keys(first, last), "key long, node long, label long, " + ", ".join(f"{c} long" for c in _LANES))


def _dealt(filed: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows with the block (``salt``) of their key that they are compared in.

    A usual key is one block. The rows of a hot one have a share each, and every two shares are a block, so that all
    its members still meet: a row goes to one block less than there are shares.
    """
    shares = F.coalesce("shares", F.lit(1))
    own = filed.join(hot, "key", "left").withColumn("shares", shares).withColumn("own", F.pmod(F.xxhash64("node"), "shares"))
    pairs = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).filter((F.col("shares") == 1) | (F.col("other") != F.col("own")))
    return pairs.withColumn("salt", F.least("own", "other") * F.col("shares") + F.greatest("own", "other")).drop("shares", "own", "other")


def _bucket_links(most: int, salted: bool = False, mixed: bool = False):
    """Candidate links ``u, v`` of labels in each bucket, with the members ``a, b`` that make them.

    In buckets of up to ``SMALL`` rows these are all near pairs. In larger ones they go from a member to all still unreached
    members near it, to the nearest of each label, until none is left to ask; ``mixed`` asks in another order in each bucket.
    Members of one label are together already and make no link.
    """

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        key = table.column("key").to_numpy()
        if salted:
            key = key * 1_000_003 + table.column("salt").to_numpy()
        node = table.column("node").to_numpy()
        with np.errstate(over="ignore"):
            turn = (node * 0x5851F42D4C957F2D + key) * 0x2545F4914F6CDD1D if mixed else node
        order = np.lexsort((node, turn ^ (turn >> 29) if mixed else turn, key))
        key, node, label = key[order], node[order], table.column("label").to_numpy()[order]
        words = np.stack([table.column(c).to_numpy() for c in _LANES], 1)[order].view(np.uint64)
        edge = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
        us, vs = [], []  # rows of the members of a link
        for apart in range(1, SMALL):
            at = np.arange(len(key) - apart)
            size = np.repeat(ends - starts, ends - starts)
            at = at[(size[at] <= SMALL) & (key[at] == key[at + apart]) & (label[at] != label[at + apart])]
            at = at[np.bitwise_count(words[at] ^ words[at + apart]).sum(1) <= most]
            us.append(at)
            vs.append(at + apart)
        large = ends - starts > SMALL
        for s, e in zip(starts[large].tolist(), ends[large].tolist(), strict=True):
            if (label[s:e] == label[s]).all():
                continue
            left = np.arange(s, e)
            queue: list[int] = []
            while len(left):
                if not queue:
                    queue, left = [int(left[0])], left[1:]
                    if not len(left):
                        break
                at = queue.pop()
                same = label[left] == label[at]
                hit = same | _near(words[at], words[left], most)
                if hit.any():
                    found = left[hit & ~same]
                    found = found[np.argsort(np.bitwise_count(words[found] ^ words[at]).sum(1), kind="stable")]
                    found = found[np.unique(label[found], return_index=True)[1]]
                    us.append(np.full(len(found), at))
                    vs.append(found)
                    queue.extend(left[hit].tolist())
                    left = left[~hit]
        u, v = np.concatenate([*us, np.zeros(0, np.int64)]), np.concatenate([*vs, np.zeros(0, np.int64)])
        if len(u):
            u, v = np.where(node[u] < node[v], u, v), np.where(node[u] < node[v], v, u)
            one = np.unique(np.stack([node[u], node[v]], 1), axis=0, return_index=True)[1]
            u, v = u[one], v[one]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (label[u], label[v], node[u], node[v])], names=["u", "v", "a", "b"])

    return run


def sets_of(words: int):
    """``node, shingles`` of each text: the distinct hashes of its runs of words."""

    def run(batches):
        for batch in batches:
            held, first, size = [], 0, 0
            for k, text in enumerate(batch.column(1).to_pylist(), 1):
                held.append(np.unique(np.concatenate([*shingle_hashes(text, words), np.zeros(0, np.uint64)])).view(np.int64))
                size += len(held[-1])
                if size >= 500_000 or k == batch.num_rows:
                    ends = np.cumsum([0, *map(len, held)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(held)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held)))], names=["node", "shingles"])
                    held, first, size = [], k, 0

    return run


def _asked(links: DataFrame, name: str, known: DataFrame | None = None) -> DataFrame:
    """Each pair of members ``a, b`` once, with its labels; pairs of ``known`` have been answered and are left out."""
    links = links.groupBy("a", "b").agg(F.first("u").alias("u"), F.first("v").alias("v"))
    return materialise(links if known is None else links.join(known.select("a", "b"), ["a", "b"], "left_anti"), name)


def _confirmed(asked: DataFrame, texts: DataFrame, unique: DataFrame, words: int, similarity: float, name: str) -> DataFrame:
    """``u, v`` of the pairs whose members ``a, b`` have shingle sets of this Jaccard similarity, counted exactly."""
    members = asked.select(F.col("a").alias("node")).union(asked.select("b")).distinct().join(unique.select("node", "doc_id", "t"), "node")
    rows = texts.withColumnsRenamed({"doc_id": "__id", "t": "__t"})
    mine = members.join(rows, (members["t"] == rows["__t"]) & members["doc_id"].eqNullSafe(rows["__id"])).select("node", "text")
    sets = mine.mapInArrow(sets_of(words), "node long, shingles array<long>").groupBy("node").agg(F.min("shingles").alias("shingles"))
    sets = materialise(sets, f"{name}-sets")
    one, two = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    both = asked.join(one, "a").join(two, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    found = both.filter(F.col("common") >= (F.size("sa") + F.size("sb") - F.col("common")) * F.lit(similarity) - 1e-9).select("u", "v")
    found = materialise(found, f"{name}-found")
    release(sets)
    return found


def near_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, t, component_id, first`` of every row: groups of texts whose shingle sets are similar.

    The similarity is read off 256-bit fingerprints of runs of ``words`` words. At 0.8 no pigeonhole of whole
    segments is selective, so candidates share a chain of neighbouring bits in one of 128 tables (rings in fixed orders), which
    nearly all pairs of that similarity do; the chain test with proportional budgets and the full distance then prune.
    Within a large bucket candidates are spanning ones, found without making its pairs. Each candidate is confirmed by the
    exact Jaccard similarity of the two shingle sets before it links.

    ``component_id`` is the least id of the group (rows without an id count only where no row has one), and ``first`` marks
    the row that it names; ``t`` is a hash of the text, which tells rows of one id apart. Repeated rows are marked alike.
    Texts without words (null and empty ones too) are not near anything. Equal fingerprints are one point.
    Some pairs at the similarity are never candidates; ``near_sets.similar_groups`` leaves none out.
    """
    marked = materialise(fingerprints(docs, words, LANES, id_col, text_col, distinct=True, hashed=True), "near-prints")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    unique = marked.groupBy(*_LANES).agg(F.min(rank).alias("x")).select(*_LANES, "x.doc_id", "x.t", F.monotonically_increasing_id().alias("node"))
    unique = materialise(unique, "near-unique")
    filled = F.greatest(*[F.col(c) != 0 for c in _LANES])
    asked = unique.filter(filled).select("node", F.col("node").alias("label"), *_LANES)
    spark = docs.sparkSession
    ship_package(spark)
    rows, least, most = unique.count(), int(spark.conf.get("spark.sql.shuffle.partitions")), bits_for(similarity)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"))

    def candidates(prints: DataFrame, first: int, last: int, mixed: bool) -> DataFrame:
        hot, filed, by = _hot_keys(prints, rows, first, last), _filed(prints, first, last), ["key"]
        if hot is not None:
            filed, by = _dealt(filed, hot), ["key", "salt"]
        parts = max(least, rows * (last - first) // 1_000_000 + 1)
        return filed.repartition(parts, *by).mapInArrow(_bucket_links(most, hot is not None, mixed), "u long, v long, a long, b long")

    early = _asked(candidates(asked, 0, FIRST, False), "near-early")
    found = _confirmed(early, texts, unique, words, similarity, "near-early")
    roots = materialise(components(found).withColumnsRenamed({"node": "__node"}), "near-first")
    joined = asked.join(roots, asked["node"] == roots["__node"], "left").select("node", F.coalesce("root", "node").alias("label"), *_LANES)
    joined = materialise(joined, "near-labels")
    late = _asked(candidates(joined, FIRST, TABLES, True), "near-late", early)
    more = _confirmed(late, texts, unique, words, similarity, "near-late")
    roots2 = components(more).withColumnsRenamed({"node": "__label"})
    labelled = joined.join(roots2, joined["label"] == roots2["__label"], "left").select("node", F.coalesce("root", "label").alias("label"))
    named = unique.join(labelled, "node")
    heads = named.groupBy("label").agg(F.min(rank).alias("head"))
    named = materialise(named.select("label", *_LANES).join(heads, "label").select(*_LANES, "head"), "near-groups")
    release(early, late, found, more, roots, joined, unique)
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    head = F.coalesce("head", own)
    return marked.join(named, _LANES, "left").select("doc_id", "t", head["doc_id"].alias("component_id"), head.eqNullSafe(own).alias("first"))


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, component_id`` of every row, as ``near_groups`` finds them."""
    return near_groups(docs, words, similarity, id_col, text_col).select("doc_id", "component_id")


def keep_first_of_near(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", groups=near_groups) -> DataFrame:
    """The first row of each group of ``groups``, with all columns of ``docs``; of repeated rows one stays."""
    first = groups(docs, words, similarity, id_col, text_col).filter("first").groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("n"))
    head, mark, n, own, text = free_names(docs, "__first", "__hash", "__n", "__id", "__t")
    first = materialise(first.select(F.col("doc_id").alias(head), F.col("t").alias(mark), F.col("n").alias(n)), "near-kept")
    rows = docs.withColumns({own: F.col(id_col).cast("long"), text: F.xxhash64(text_col)})
    out = rows.join(first.select(head, mark), (F.col(text) == F.col(mark)) & F.col(own).eqNullSafe(F.col(head)), "left_semi")
    if not first.filter(F.col(n) > 1).isEmpty():
        out = out.dropDuplicates([own, text])
    return out.drop(own, text)
