"""SimHash fingerprints and near-duplicate groups, with the pigeonring filter.

A fingerprint of 64 bits is a ring of m segments. If two differ in at most t bits, then from some segment on,
clockwise, the first l segments together differ in at most floor(l * t / m) bits, for every l (the pigeonring
principle). With t = 3 and m = 8: two segments are equal, and the next three differ in one bit at most, so one half of
those is equal too. Each start and half is thus an index key of 28 exact bits (16 keys a fingerprint), rows that share
a key are candidates, and a candidate is dropped at the first chain of segments over its budget, before the
full check. Nothing is lost: a pair within t bits keeps its whole chain from some start.

Equal fingerprints are one node first. Buckets of a key over ``BLOCK`` nodes are dealt out as pairs of blocks, so no
task holds an unbounded group. A bucket gives a spanning forest of its links, never all pairs.

Defined results: null and empty texts have the fingerprint zero and link like any other; texts of fewer words
than a shingle are one shingle; rows with a null doc_id take part and never name a component unless it has no other
row (then null); a bit set in exactly half of the shingles is 0; repeated rows are rows of their own; a text of any length is hashed
whole, in blocks of shingles; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spidex.llm.common import components, cut, free_names, mix, shuffle_partitions, text_or_empty

BLOCK, MANY = 4096, 1 << 14


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    from xxhash import xxh64_intdigest as h

    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w))) + np.arange(len(w))
    starts = np.append(0, ends[:-1] + 1)[:n].tolist()
    ends = ends[words - 1 :].tolist() or [int(ends[-1])]
    joined = b" ".join(w)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, MANY):
        counts += _bit_counts(np.array([h(joined[a:b], seed) for a, b in zip(starts[k : k + MANY], ends[k : k + MANY])], np.uint64))
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of some hashes have each bit, the highest first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches_):
        for batch in batches_:
            found = np.array([fingerprint(t.as_py(), words, seed) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, fp long")


def ring(distance: int, segments: int) -> tuple[int, int, int]:
    """Bits of the exact part of a chain, of the part with one difference, and of a segment."""
    if not 0 <= distance < segments or 64 % segments:
        raise ValueError("the distance must be below the number of segments, and that must divide 64")
    if distance == 0:
        return 64, 0, 64 // segments
    exact = -(-segments // distance) - 1
    one = min(segments, -(-2 * segments // distance) - 1)
    return exact * (64 // segments), (one - exact) * (64 // segments), 64 // segments


def _keys(distance: int, segments: int):
    """Column of an array of keys: start, half and exact bits of each chain, hashed into a long."""
    exact, one, step = ring(distance, segments)
    fp, out = F.col("fp"), []
    for i in range(segments):
        turned = F.shiftleft(fp, i * step).bitwiseOR(F.shiftrightunsigned(fp, 64 - i * step)) if i else fp
        head = F.shiftrightunsigned(turned, 64 - exact) if exact < 64 else turned
        half = one // 2
        for k, (shift, width) in enumerate([(64 - exact - half, half), (64 - exact - one, one - half)] if one else [(0, 0)]):
            part = F.shiftrightunsigned(turned, shift).bitwiseAND(F.lit((1 << width) - 1)) if width else F.lit(0)
            out.append(F.struct(F.lit(2 * i + k).cast("int").alias("slot"), head.alias("head"), part.cast("long").alias("part")))
    return F.array(*out)


def _links(distance: int, segments: int):
    """Links within groups: over rows sorted by group, (a, b) of a spanning forest of each group's nodes within the distance."""
    step = 64 // segments

    def join(group, side, slot, fp, node):
        """All rows of some groups. Row k meets row k + s of its group for every s; a pair is checked chain by chain."""
        n = len(fp)
        size = np.diff(np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), n))
        last = np.repeat(np.cumsum(size), size)
        across = side >= 0  # of two blocks: only pairs with one row from each
        label = np.arange(n)
        turned = (fp << (slot // 2 * step).astype(np.uint64)) | np.where(slot // 2 > 0, fp >> ((64 - slot // 2 * step) % 64).astype(np.uint64), np.uint64(0))
        live = np.arange(n)
        for s in range(1, int(size.max(initial=1))):
            live = live[live + s < last[live]]
            a = live[~across[live] | (side[live] != side[live + s])]
            x = turned[a] ^ turned[a + s]
            for l in (*range(ring(distance, segments)[0] // step, segments), segments):
                ok = np.bitwise_count(x >> np.uint64(64 - l * step)) <= l * distance // segments
                a, x = a[ok], x[ok]
            p, q = label[a], label[a + s]
            while (differ := p != q).any():
                p, q = p[differ], q[differ]
                np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
                while (label[label] != label).any():
                    label = label[label]
                p, q = label[p], label[q]
        return [(int(node[k]), int(node[label[k]])) for k in np.flatnonzero(label != np.arange(n))]

    def run(batches_):
        held: list[np.ndarray] = []
        columns = ("slot", "head", "part", "lo", "hi", "side", "fp", "node")

        def emit(rows):
            key = rows[:, :5]
            group = np.cumsum(np.append(False, (key[1:] != key[:-1]).any(axis=1)))
            found = join(group, rows[:, 5], rows[:, 0], rows[:, 6].view(np.uint64), rows[:, 7])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

        for batch in batches_:
            rows = np.stack([batch.column(batch.schema.get_field_index(c)).cast(pa.int64()).to_numpy() for c in columns], axis=1)
            rows = np.concatenate([*held, rows])
            if not len(rows):
                continue
            opened = len(rows) - int(np.argmax((rows[::-1, :5] != rows[-1, :5]).any(axis=1))) if (rows[:, :5] != rows[-1, :5]).any() else 0
            if opened:
                yield from emit(np.ascontiguousarray(rows[:opened]))
            held = [rows[opened:]]
        if held and len(held[0]):
            yield from emit(np.ascontiguousarray(held[0]))

    return run


def links(nodes: DataFrame, distance: int = 3, segments: int = 8) -> DataFrame:
    """nodes (fp, node), fingerprints distinct: (a, b) that connect all nodes which chains of links connect."""
    keyed = nodes.select("fp", "node", F.explode(_keys(distance, segments)).alias("k")).select("k.*", "fp", "node")
    key = ["slot", "head", "part"]
    crowded = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = (
        keyed.join(crowded, key)
        .withColumn("blocks", blocks)
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(*key, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"), "fp", "node")
    )
    group = [*key, "lo", "hi"]
    # a block meets itself in the group (b, b) and each other block in (lo, hi)
    sorted_ = dealt.repartition(shuffle_partitions(nodes.sparkSession), *group).sortWithinPartitions(*group)
    return sorted_.mapInArrow(_links(distance, segments), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3, segments: int = 8, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that chains of links reach."""
    prints = cut(fingerprints(docs, words, seed))
    named = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))
    nodes = cut(prints.groupBy("fp").agg(F.min(named).alias("node")))
    found = components(links(nodes, distance, segments)) if distance else None
    labelled = nodes.join(found, "node", "left").select("fp", F.coalesce("label", "node").alias("component_id")) if found is not None else nodes.select("fp", F.col("node").alias("component_id"))
    return prints.join(labelled, "fp").select("doc_id", "fp", F.nullif("component_id", F.lit((1 << 63) - 1)).alias("component_id"))


def hex_digits(column: str = "fp"):
    return F.lpad(F.lower(F.hex(column)), 16, "0")


WIDE = 4  # words of a wide fingerprint
KEYS = 8  # least shingle hashes of a text, by which candidates meet
MARGIN = 5  # standard errors that the filter allows over the distance expected
FEW = 16  # sets of fewer shingles go past the filter: its estimate is off for them
SHINGLES = 1 << 20  # in a block, by their mean size
_SEEDS = mix(np.arange(1, WIDE + KEYS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(text: str, words: int = 5) -> np.ndarray:
    """Hashes of the distinct word shingles, ascending; no words: none."""
    from xxhash import xxh64_intdigest as h

    w = text.encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(w) - words + 1) if w else 0
    return np.sort(np.fromiter({h(b" ".join(w[i : i + words]), 42) for i in range(n)}, np.uint64))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """256 bits of SimHash over shingle hashes, then the least of them under eight seeds; none: zeros."""
    out = np.zeros(WIDE + KEYS, np.uint64)
    if not len(hashes):
        return out
    for k in range(WIDE):
        counts = sum(_bit_counts(mix(hashes[a : a + MANY] ^ _SEEDS[k])) for a in range(0, len(hashes), MANY))
        out[k] = int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")
    for k in range(WIDE, WIDE + KEYS):
        out[k] = mix(hashes ^ _SEEDS[k]).min()
    return out


def alike(x: frozenset, y: frozenset, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sets reaches ``similarity``."""
    both = len(x & y)
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


class _Sets:
    """The shingle sets of one group, as rows of a table that is sorted by how many of the group's sets have a shingle.

    Two sets with a similarity of s share one of the first n - ceil(s n) + 1 shingles of either (n: its size), in any order that is the
    same for both. With rare ones first few sets share any, and no pair is lost.
    """

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
        of = np.repeat(np.arange(len(sets)), sizes)
        _, token, times = np.unique(flat, return_inverse=True, return_counts=True)
        by_set = np.lexsort((token, times[token], of))
        self.tokens, self.starts = token[by_set], np.append(0, np.cumsum(sizes))
        by_token = np.argsort(token, kind="stable")
        self.rows, self.places = of[by_token], np.append(0, np.cumsum(times))
        self.sizes = sizes
        self._known: dict[int, frozenset] = {}

    def sharing(self, k: int, similarity: float) -> np.ndarray:
        """Rows that share one of the first shingles of row k: all that can be as similar to it are among them."""
        n = int(self.sizes[k])
        if not n:
            return np.flatnonzero(self.sizes == 0)
        first = n - int(np.ceil(similarity * n - 1e-9)) + 1
        tokens = self.tokens[self.starts[k] : self.starts[k] + first]
        return np.unique(np.concatenate([self.rows[self.places[t] : self.places[t + 1]] for t in tokens.tolist()]))

    def set(self, k: int) -> frozenset:
        if k not in self._known:
            self._known[k] = frozenset(self.tokens[self.starts[k] : self.starts[k + 1]].tolist())
        return self._known[k]


def _wide_links(distance: int, similarity: float):
    """As _links(), for rows (slot, key, lo, hi, side, 4 words, size, node, set): the sets' similarity reaches ``similarity``.

    Each row in turn meets the later ones of other components that share one of its first shingles. Sizes too far apart rule a pair
    out, and so do words that differ in more than ``distance`` bits of 256: before the sum is looked at, some start on the ring of words
    must have every chain within its part of the distance. Sets decide about the rest.
    """
    budget = np.array([l * distance // WIDE for l in range(1, WIDE + 1)])
    turns = np.arange(WIDE)[:, None] + np.arange(WIDE)

    def close(k, others, words, size_of):
        """Those of ``others`` that sizes and fingerprints don't rule out."""
        least, most = np.minimum(size_of[k], size_of[others]), np.maximum(size_of[k], size_of[others])
        ok = least >= similarity * most - 1e-9
        others, few = others[ok], least[ok] < FEW
        diff = np.bitwise_count(words[k] ^ words[others]).astype(np.int64)
        chains = np.cumsum(np.concatenate([diff, diff], axis=1)[:, turns], axis=2)
        return others[few | (chains <= budget).all(axis=2).any(axis=1) & (diff.sum(axis=1) <= distance)]

    def join(side, words, size_of, node, sets):
        """(a, b) of a spanning forest of one group."""
        n, found = len(node), []
        label, parts = np.arange(n), n
        table = _Sets([np.frombuffer(s.as_buffer(), np.uint64) for s in sets])
        for k in range(n):
            if parts == 1:
                break
            others = table.sharing(k, similarity) if n > 8 else np.arange(n)
            others = others[(others > k) & (label[others] != label[k])]
            if side[k] >= 0:  # of two blocks: only pairs with one row from each
                others = others[side[others] != side[k]]
            for other in close(k, others, words, size_of).tolist() if len(others) else ():
                if label[other] != label[k] and alike(table.set(k), table.set(other), similarity):
                    found.append((int(node[other]), int(node[k])))
                    label[label == label[other]] = label[k]
                    parts -= 1
        return found

    def run(batches_):
        held: list[tuple[np.ndarray, pa.Array]] = []

        def emit(rows, sets):
            edges = np.flatnonzero(np.append(True, (rows[1:, :4] != rows[:-1, :4]).any(axis=1)))
            found = []
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(rows)]):
                if b - a > 1:
                    found += join(rows[a:b, 4], np.ascontiguousarray(rows[a:b, 5 : 5 + WIDE]).view(np.uint64), rows[a:b, 5 + WIDE], rows[a:b, 6 + WIDE], sets[a:b])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

        for batch in batches_:
            if not batch.num_rows:
                continue
            held.append((np.stack([c.cast(pa.int64()).to_numpy() for c in batch.columns[:-1]], axis=1), batch.column(batch.num_columns - 1).cast(pa.large_binary())))
            if (held[0][0][0, :4] == held[-1][0][-1, :4]).all():
                continue  # one group so far
            rows, sets = np.concatenate([r for r, _ in held]), pa.chunked_array([x for _, x in held])
            opened = len(rows) - int(np.argmax((rows[::-1, :4] != rows[-1, :4]).any(axis=1)))
            yield from emit(rows[:opened], pa.concat_arrays(sets[:opened].chunks))
            held = [(rows[opened:], pa.concat_arrays(sets[opened:].chunks))]
        if held:
            yield from emit(np.concatenate([r for r, _ in held]), pa.concat_arrays([x for _, x in held]))

    return run


def labelled(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, row, label) of every row of ``docs``: rows with one label are linked where their sets of word shingles have a Jaccard similarity of ``similarity``.

    ``row`` is a hash of doc_id and text, ``label`` the smallest hash of a set that is linked. Rows without a word are linked.

    Equal sets are one node. Candidates are nodes that agree in one of eight least shingle hashes (at a similarity of s they do with a
    chance of 1 - (1 - s) ** 8), dealt out and linked as in links(). Sets with Jaccard similarity s have a cosine of about
    2 s / (1 + s) and differ in acos(cosine) / pi of their SimHash bits; that distance of 256 bits plus five standard errors is a
    filter, which loses fewer than one pair in a million. What passes is settled by the sets themselves, before links
    are thinned to a forest. Shingles are read again from the texts of nodes that have a candidate, and move with those alone.
    """
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    distance = int(256 * share + MARGIN * (256 * share * (1 - share)) ** 0.5)
    names = ["node", "size", *(f"w{k}" for k in range(WIDE)), *(f"k{k}" for k in range(KEYS))]
    wide = names[2 : 2 + WIDE]

    def prints_(batches_):
        from xxhash import xxh64_intdigest as h

        for batch in batches_:
            found = np.empty((batch.num_rows, len(names)), np.uint64)
            for k, t in enumerate(batch.column(2)):
                hashes = shingles(t.as_py(), words)
                found[k, 0], found[k, 1], found[k, 2:] = h(hashes.tobytes(), 42), len(hashes), wide_fingerprint(hashes)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(c)) for c in found.view(np.int64).T)], names=["doc_id", "row", *names])

    def sets_(batches_):
        for batch in batches_:
            at = batch.schema.get_field_index("text")
            found = pa.array([shingles(t.as_py(), words).tobytes() for t in batch.column(at)], pa.binary())
            yield batch.set_column(at, "hashes", found)

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("doc_id").cast("long"), text_or_empty()).alias("row"), text_or_empty().alias("text"))
    prints = cut(rows.mapInArrow(prints_, "doc_id long, row long, " + ", ".join(f"{n} long" for n in names)))
    nodes = cut(prints.groupBy("node").agg(*(F.min(k).alias(k) for k in ["row", *names[1:]])))
    keys = F.array(*(F.struct(F.lit(k).alias("slot"), F.col(f"k{k}").alias("key")) for k in range(KEYS)))
    keyed = nodes.select("node", "size", F.explode(keys).alias("k")).select("k.*", "node", "size")
    crowded = keyed.groupBy("slot", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight")).filter("n > 1")
    places = (
        keyed.drop("size").join(crowded, ["slot", "key"])
        .withColumn("blocks", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("weight") / SHINGLES, F.lit(1))).cast("int"))
        .groupBy("node")
        .agg(F.collect_list(F.struct("slot", "key", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own"))).alias("places"))
        .join(nodes.select("node", "row", "size", *wide), "node")
    )
    # a row's hash names one text; repeated rows of a document are one
    texts = rows.select("row", "text").join(places, "row").dropDuplicates(["row"]).select("node", "size", *wide, "places", "text")
    schema = texts.select("node", "size", *wide, "places", F.lit(b"").alias("hashes")).schema
    dealt = (
        texts.mapInArrow(sets_, schema)
        .withColumn("p", F.explode("places"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("p.blocks") - 1)))
        .withColumn("own", F.col("p.own"))
        .select("p.slot", "p.key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"), *wide, "size", "node", "hashes")
    )
    group = ["slot", "key", "lo", "hi"]
    found = dealt.repartition(shuffle_partitions(docs.sparkSession), *group).sortWithinPartitions(*group).mapInArrow(_wide_links(distance, similarity), "a long, b long")
    return cut(prints.select("doc_id", "row", "node").join(components(found), "node", "left").select("doc_id", "row", F.coalesce("label", "node").alias("label")))


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of every row: the smallest doc_id of its group (null: none has any)."""
    rows = labelled(docs, words, similarity)
    return rows.join(rows.groupBy("label").agg(F.min("doc_id").alias("component_id")), "label").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group, all columns: that of the smallest doc_id, null last.

    Of different texts under that doc_id one stays, by a hash; of repeated rows (one doc_id and text) any one. Documents without a word are
    copies of each other.
    """
    id_, row, kept = free_names(docs, "id", "row", "kept")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    first = labelled(docs, words, similarity).groupBy("label").agg(best.alias("best")).select(F.col("best.doc_id").alias(id_), F.col("best.row").alias(kept))
    keyed = docs.withColumn(row, F.xxhash64(F.col("doc_id").cast("long"), text_or_empty()))
    return keyed.join(first, (F.col(row) == F.col(kept)) & F.col("doc_id").cast("long").eqNullSafe(F.col(id_)), "left_semi").dropDuplicates([row]).select(*docs.columns)
