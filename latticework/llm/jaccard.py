"""N-gram Jaccard join through a token-group matrix.

Texts become sets of hashed word shingles; equal sets are one node. A global order of tokens, rare ones first, gives
every set a short prefix that must meet the prefix of any set similar enough. Nodes with the same smallest hash (which
similar sets share as often as they are similar) form groups of bounded size. Three steps then find every link:

1. Inside a group all members are compared, except pairs that are connected already. A large key is cut into several
   groups which share one member, so near-copies end up connected whatever group they fell into; groups by the
   largest hash connect most of those whose smallest hash differs.
2. The token-group matrix, as (token, group) rows over prefixes, meets the prefixes of all nodes on the token. Pairs
   of one component are left out: of a huge cluster of near-copies nothing remains.
3. For each pair of node and group the overlap with the group's token union bounds the overlap with any member. Only
   groups whose bound reaches the threshold are opened, member by member.

Components follow from the links. Every comparison is exact on token sets; prefixes and bounds lose no pair.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_type

from ..session import staged
from .graph import components
from .words import Words, distinct, mix64, shingles, slices

WIDTH, SIMILAR = 4, (85, 100)
# Members of a group, and queries that meet a group at once; their tokens count too, so that long texts make small groups.
GROUP, QUERIES, TOKENS = 256, 1024, 1 << 18
# The order of tokens rests on counts in a sketch of fixed width; any order is exact, a good one is fast.
SKETCH, SKETCH_SLICES = 1 << 22, 64
# Removed documents up to which their ids are broadcast (16 bytes each); beyond, texts are shuffled to them.
BROADCAST_ROWS = 1_000_000
# Bits of a set's parity signature, per token and at least: sets that differ in d tokens differ in at most d bits.
PARITY, LEAST_PARITY = 1, 64
# Bits of the filter that spares texts of no interest from being cut again; its size is fixed.
FILTER_BITS = 26
def _least(n: np.ndarray | int, similar: tuple[int, int]):
    """Smallest overlap of a set of n with any set it links to: a share of n, rounded up."""
    return -(-n * similar[0] // similar[1])


class _Sets:
    """Sorted distinct tokens of each text of a batch, and their digests."""

    def __init__(self, texts: pa.Array, width: int):
        words = Words(texts)
        doc, token = shingles(words, width)
        self.tokens, self.first = distinct(doc, token, len(texts))
        self.n = np.diff(self.first)
        sums = np.zeros(len(self.tokens) + 1, np.uint64)
        np.cumsum(mix64(self.tokens + np.uint64(0x1234567)), out=sums[1:])
        total = sums[self.first[1:]] - sums[self.first[:-1]]
        self.node = mix64(total + self.n.astype(np.uint64)).view(np.int64)


def _measure(batches: Iterator[pa.RecordBatch], width: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """A row per text (id, key, body, node, n), and at the end of the task its sketch of token counts in slices."""
    counts = np.zeros(SKETCH, np.int32)
    names = ["slice", "counts", "id", "key", "body", "node", "n"]
    for batch in batches:
        for part in slices(batch, "_text"):
            sets = _Sets(part.column("_text"), width)
            if len(sets.tokens):
                np.add.at(counts, (sets.tokens & np.uint64(SKETCH - 1)).astype(np.int64), 1)
            rows = part.num_rows
            yield pa.RecordBatch.from_arrays([pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary()),
                                              part.column("_id"), part.column("_key"), part.column("_body"),
                                              pa.array(sets.node), pa.array(sets.n.astype(np.int64))], names)
    cut = counts.reshape(SKETCH_SLICES, -1)
    used = np.flatnonzero(cut.any(axis=1))
    none = pa.nulls(len(used), pa.int64())
    yield pa.RecordBatch.from_arrays(
        [pa.array(used.astype(np.int32)), pa.array([zlib.compress(cut[i].tobytes(), 1) for i in used], pa.binary()),
         pa.nulls(len(used), id_type), none, none, none, none], names)


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, packed in zip(batch.column("slice").to_pylist(), batch.column("counts")):
            part = np.frombuffer(zlib.decompress(packed.as_py()), np.int32)
            sums[i] = sums.get(i, 0) + part.astype(np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["slice", "counts"])


def _levels(measured: DataFrame) -> np.ndarray:
    """Commonness of the tokens of each sketch cell: its count over the mean in steps of an eighth of a doubling."""
    parts = (measured.where(F.col("slice").isNotNull()).select("slice", "counts")
             .repartition(SKETCH_SLICES, "slice").mapInArrow(_add_counts, "slice int, counts binary"))
    counts = np.zeros((SKETCH_SLICES, SKETCH // SKETCH_SLICES), np.int64)
    for r in parts.collect():  # 64 rows of fixed size
        counts[r.slice] = np.frombuffer(r.counts, np.int64)
    over = np.log2(np.maximum(counts.ravel(), 1) / max(counts.mean(), 1.0))
    return np.clip(8 * over + 64, 0, 255).astype(np.uint8)


def _parities(sets: _Sets) -> pa.ListArray:
    """Parity of the count of tokens in each cell, as 64-bit integers; the number of cells is a power of two.

    A signature of twice the cells folds onto a smaller one by XOR of its halves.
    """
    cells = np.maximum(LEAST_PARITY, 1 << np.ceil(np.log2(np.maximum(PARITY * sets.n, 1))).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(cells)])
    own = np.repeat(np.arange(len(cells)), sets.n)
    cell = ((sets.tokens >> np.uint64(20)).astype(np.int64) & (cells[own] - 1)) + first[own]
    odd = np.zeros(first[-1], bool)
    at, counts = np.unique(cell, return_counts=True)
    odd[at[counts & 1 == 1]] = True
    return pa.ListArray.from_arrays(pa.array((first // 64).astype(np.int32)), pa.array(np.packbits(odd).view(np.int64)))


def _bits_apart(a: Column, b: Column) -> Column:
    """Bits in which two signatures differ, the longer one folded to the length of the other."""
    def fold(x: Column, size: Column) -> Column:
        return F.when(F.size(x) <= size, x).otherwise(F.zip_with(
            F.slice(x, F.lit(1), size), F.slice(x, size + 1, size), lambda p, q: p.bitwiseXOR(q)))

    apart = F.zip_with(fold(a, F.size(b)), fold(b, F.size(a)), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(apart, F.lit(0), lambda t, n: t + n)


def _prefixes(batches: Iterator[pa.RecordBatch], width: int, similar: tuple[int, int],
              levels: np.ndarray) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        for part in slices(batch, "_text"):
            sets = _Sets(part.column("_text"), width)
            doc = np.repeat(np.arange(part.num_rows), sets.n)
            level = levels[(sets.tokens & np.uint64(SKETCH - 1)).astype(np.int64)]
            order = np.argsort(doc * 256 + level, kind="stable")  # inside a level tokens stay sorted
            rank = np.arange(len(doc)) - np.repeat(sets.first[:-1], sets.n)
            keep = rank < np.repeat(sets.n - _least(sets.n, similar) + 1, sets.n)
            fresh = np.array([n > 0 and not (x in seen or seen.add(x)) for n, x in zip(sets.n, sets.node.tolist())], bool)
            if len(seen) > 1_000_000:
                seen.clear()
            keep &= np.repeat(fresh, sets.n)
            sizes = np.bincount(doc[keep], minlength=part.num_rows)[fresh]
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sets.tokens[order][keep].view(np.int64)))
            marks = _parities(sets).filter(pa.array(fresh))
            head, tail = (sets.tokens[at[fresh]].view(np.int64) for at in (sets.first[:-1], sets.first[1:] - 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(sets.node[fresh]), pa.array(sets.n[fresh].astype(np.int64)), pa.array(head), pa.array(tail),
                 tokens, marks], ["node", "n", "head", "tail", "prefix", "marks"])


def _tokens(batches: Iterator[pa.RecordBatch], width: int, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(key, node, tokens) of the rows whose key passes the filter."""
    for batch in batches:
        key = batch.column("_key").to_numpy() & ((1 << FILTER_BITS) - 1)
        batch = batch.filter(pa.array((bits[key >> 6] >> (key & 63).astype(np.uint64)) & np.uint64(1) == 1))
        for part in slices(batch, "_text"):
            sets = _Sets(part.column("_text"), width)
            tokens = pa.ListArray.from_arrays(pa.array(sets.first.astype(np.int32)), pa.array(sets.tokens.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("_key"), pa.array(sets.node), tokens], ["key", "node", "tokens"])


def _with_tokens(docs: DataFrame, roles: DataFrame, keys: DataFrame, width: int) -> DataFrame:
    """The rows of `roles` (node, ...) with the tokens of their nodes, cut again from one text of each node.

    A fixed-size filter over keys spares most other texts; the join on node and key is what decides. A text that is
    repeated under one id comes more than once, which the comparisons bear.
    """
    named = staged(roles.join(keys, "node"), "roles")
    slot = F.col("key").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    rows = (named.select(F.shiftright(slot, 6).cast("int").alias("w"), slot.bitwiseAND(F.lit(63)).cast("int").alias("b"))
                 .groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("m")).toArrow())  # at most 2^20 rows
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bits[rows.column("w").to_numpy()] = rows.column("m").to_numpy().view(np.uint64)
    found = docs.mapInArrow(lambda batches: _tokens(batches, width, bits), "key long, node long, tokens array<long>")
    return found.join(named, ["node", "key"])


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of one group after another from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            now = tuple(int(c[a]) for c in cols)
            if held and now != last:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class _Group:
    """Members of a group, their token union, and each member's tokens as places in the union."""

    def __init__(self, tokens: pa.ListArray, similar: tuple[int, int]):
        self.num, self.den = similar
        offsets = tokens.offsets.to_numpy().astype(np.int64)
        values = tokens.values.to_numpy()[offsets[0]: offsets[-1]]
        self.first = offsets - offsets[0]
        self.n = np.diff(self.first)
        self.union, self.place = np.unique(values, return_inverse=True)

    def links(self, inside: np.ndarray, n: int) -> np.ndarray:
        """Members linked with a set of n tokens, given which tokens of the union it holds."""
        both = np.add.reduceat(inside[self.place], self.first[:-1], dtype=np.int64)
        return self.den * both >= self.num * (self.n + n - both)


def _link_members(batches: Iterator[pa.RecordBatch], similar: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    for rows in _grouped(batches, ["unit"]):
        node, pivot = rows.column("node").to_numpy(), int(rows.column("pivot")[0].as_py())
        group = _Group(rows.column("tokens"), similar)
        label = np.arange(len(node))
        for i in sorted(range(len(node)), key=lambda k: (node[k] != pivot, k)):
            apart = label != label[i]
            apart &= similar[1] * np.minimum(group.n, group.n[i]) >= similar[0] * np.maximum(group.n, group.n[i])
            if not apart.any():
                continue
            inside = np.zeros(len(group.union), bool)
            inside[group.place[group.first[i]: group.first[i + 1]]] = True
            for other in np.unique(label[group.links(inside, int(group.n[i])) & apart]):
                label[label == other] = label[i]
        part = np.empty(len(node), np.int64)
        for k in np.unique(label):
            own = label == k
            part[own] = pivot if (node[own] == pivot).any() else node[own].min()
        yield pa.RecordBatch.from_arrays([rows.column("node"), rows.column("unit"), pa.array(part), rows.column("once")],
                                         ["node", "unit", "part", "once"])


def _open_groups(batches: Iterator[pa.RecordBatch], similar: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    for rows in _grouped(batches, ["unit", "block"]):
        asks, part = rows.column("asks").to_numpy(zero_copy_only=False), rows.column("part").to_numpy()
        members = np.flatnonzero(~asks)
        queries = np.flatnonzero(asks)
        if not len(members) or not len(queries):
            continue
        group = _Group(rows.column("tokens").take(pa.array(members)), similar)
        links = set()
        tokens = rows.column("tokens")
        for q in queries.tolist():
            own = tokens[q].values.to_numpy()
            at = np.searchsorted(group.union, own)
            at = at[(at < len(group.union)) & (group.union[np.minimum(at, len(group.union) - 1)] == own)]
            if len(at) < _least(len(own), similar):  # the bound: no member can be similar
                continue
            inside = np.zeros(len(group.union), bool)
            inside[at] = True
            found = part[members][group.links(inside, len(own))]
            links.update((int(part[q]), int(p)) for p in np.unique(found) if p != part[q])
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])


def _rooted(docs: DataFrame, width: int, similar: tuple[int, int], text: str, ident: str) -> tuple[DataFrame, DataFrame]:
    """((id, key, body, node, n) of every row, (node, root) of every set): all links found, components named by a node."""
    num, den = similar
    source = docs.select(F.xxhash64(F.col(ident)).alias("_key"), F.col(text).alias("_text"))
    id_type = docs.schema[ident].dataType
    arrow_type = to_arrow_type(id_type)
    measured = staged(
        docs.select(F.col(ident).alias("_id"), F.xxhash64(F.col(ident)).alias("_key"), F.xxhash64(F.col(text)).alias("_body"),
                    F.col(text).alias("_text")).mapInArrow(
            lambda b: _measure(b, width, arrow_type),
            f"slice int, counts binary, id {id_type.simpleString()}, key long, body long, node long, n long"), "sets")
    levels = _levels(measured)
    sized = measured.where(F.col("slice").isNull()).select("id", "key", "body", "node", "n")
    keys = staged(sized.where(F.col("n") > 0).groupBy("node").agg(F.min("key").alias("key")), "nodes")
    found = source.mapInArrow(lambda b: _prefixes(b, width, similar, levels),
                              "node long, n long, head long, tail long, prefix array<long>, marks array<long>")
    found = staged(found.withColumn("row", F.monotonically_increasing_id()), "prefixes")
    # tasks that saw the same set each wrote it; one row of a node counts from here on
    heads = staged(found.groupBy("node").agg(F.min("row").alias("row"), *[F.min(c).alias(c) for c in ("head", "tail", "n")]), "heads")

    def pieces(size: Column, tokens: Column, most: int) -> Column:
        return F.ceil(F.greatest(size / most, tokens / TOKENS)).cast("int")

    # groups: nodes with the same key, cut to GROUP members or TOKENS tokens, each cut with the key's pivot
    def groups(rows: DataFrame, key: str) -> DataFrame:
        sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"), F.min("node").alias("pivot"))
        rows = rows.join(sizes.where(F.col("size") > 1), key).withColumn("cuts", pieces(F.col("size"), F.col("weight"), GROUP))
        own_cut = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
        rows = rows.select("node", key, "pivot", F.explode(F.when(
            F.col("node") == F.col("pivot"), F.sequence(F.lit(0), F.col("cuts") - 1)).otherwise(F.array(own_cut))).alias("cut"))
        first = (F.col("node") != F.col("pivot")) | (F.col("cut") == 0)  # true once for every node
        return rows.select("node", "pivot", F.xxhash64(F.lit(key), key, "cut").alias("unit"), first.alias("once"))

    def link(grouped: DataFrame) -> DataFrame:
        opened = _with_tokens(source, grouped, keys, width).repartition("unit").sortWithinPartitions("unit", "node")
        return staged(opened.mapInArrow(lambda b: _link_members(b, similar), "node long, unit long, part long, once boolean").distinct(), "linked")

    # a second grouping, by the largest token, only connects: it gathers near-copies whose smallest token differs
    linked = link(staged(groups(heads, "head").unionByName(
        groups(heads, "tail").withColumn("once", F.lit(None).cast("boolean"))), "groups"))
    parts = components(linked.select(F.col("node").alias("a"), F.col("part").alias("b")))
    parts = staged(heads.select("node").join(parts, "node", "left").select("node", F.coalesce("root", "node").alias("part")), "parts")
    # a node alone under its smallest token is its own group
    inside = linked.where(F.col("once").isNotNull()).select("node", "unit", "once")
    members = (heads.join(inside.select("node").distinct(), "node", "left_anti")
               .select("node", F.col("node").alias("unit"), F.lit(True).alias("once")).unionByName(inside))
    members = members.join(parts, "node").join(heads.select("node", "row"), "node")
    members = staged(members.join(found.drop("head", "tail"), ["node", "row"]).drop("row"), "members")

    # the matrix over index prefixes, asked by query prefixes; the smaller set of a pair is the member. In the row of the
    # first token that both hold, all they share lies from there on: `rest` counts the tokens from an entry's on
    short = F.col("n") - F.ceil(2 * num * F.col("n") / (num + den)).cast("int") + 1
    size = F.col("n").cast("int")
    entries = members.select("unit", "part", size.alias("n"), (F.col("unit") == F.col("node")).alias("alone"),
                             F.posexplode(F.slice("prefix", 1, short)).alias("at", "token"))
    entries = entries.withColumn("rest", F.col("n") - F.col("at"))
    names = ["token", "unit", "part"]
    matrix = (entries.where("alone").select(*names, F.col("n").alias("lo"), F.col("n").alias("hi"), "rest")
              .unionByName(entries.where(~F.col("alone")).groupBy(*names).agg(
                  F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("rest").alias("rest"))))
    # a pivot asks once, for whichever of its groups; its part is the same in all
    asks = members.where("once").select(F.posexplode("prefix").alias("q_at", "token"), F.col("node").alias("q"),
                                      F.col("part").alias("q_part"), size.alias("q_n"))
    shared = F.least(F.col("q_n") - F.col("q_at"), F.col("rest"))
    near = ((F.col("part") != F.col("q_part")) & (F.col("lo") <= F.col("q_n")) & (den * F.col("hi") >= num * F.col("q_n"))
            & ((num + den) * shared >= num * (F.col("q_n") + F.col("lo"))))
    pairs = staged(asks.join(matrix, (asks["token"] == matrix["token"]) & near).select("q", "q_part", "unit").distinct(), "pairs")
    # a group of one is dismissed where parity signatures differ in more bits than a link may differ in tokens
    signed = members.where("once").select("node", "n", "marks")
    alone = pairs.join(signed.select(F.col("node").alias("unit"), F.col("n").alias("n_m"), F.col("marks").alias("marks_m")), "unit")
    alone = alone.join(signed.select(F.col("node").alias("q"), "n", "marks"), "q")
    alone = alone.where(_bits_apart(F.col("marks"), F.col("marks_m")) * (den + num) <= (den - num) * (F.col("n") + F.col("n_m")))
    alone = alone.select("q", "q_part", "unit")
    many = pairs.join(members.where(F.col("unit") != F.col("node")).select("unit").distinct(), "unit", "left_semi")
    pairs = staged(alone.unionByName(many.select("q", "q_part", "unit")), "open")

    weighed = pairs.join(heads.select(F.col("node").alias("q"), "n"), "q")
    blocks = weighed.groupBy("unit").agg(pieces(F.count(F.lit(1)), F.sum("n"), QUERIES).alias("blocks"))
    asked = (members.select("node", "part", "unit").join(blocks, "unit")
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("node", "part", "unit", "block", F.lit(False).alias("asks")))
    asking = (pairs.join(blocks, "unit")
              .select(F.col("q").alias("node"), F.col("q_part").alias("part"), "unit",
                      F.pmod(F.xxhash64("q"), F.col("blocks")).cast("int").alias("block"), F.lit(True).alias("asks")))
    links = (_with_tokens(source, asked.unionByName(asking), keys, width).repartition("unit", "block")
             .sortWithinPartitions("unit", "block", "asks", "node")
             .mapInArrow(lambda b: _open_groups(b, similar), "a long, b long"))
    roots = components(links.distinct())

    placed = (parts.join(roots.select(F.col("node").alias("at"), "root"), F.col("part") == F.col("at"),
                                                "left").select("node", F.coalesce("root", "part").alias("root")))
    return sized, placed


def jaccard_components(docs: DataFrame, width: int = WIDTH, similar: tuple[int, int] = SIMILAR, text: str = "text",
                       ident: str = "doc_id") -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id, component_size).

    Words are runs of characters other than space and U+0009 to U+000D, A-Z lower-cased; a set holds the distinct
    shingles of `width` words, or the whole sequence of a shorter text. Documents link where the intersection is at
    least the share `similar` of the union. Null and blank texts have no shingles and stand alone. component_id is
    the smallest doc_id reachable; null ids count as larger than all others and a component of nulls has a null id. Repeated rows, and
    rows that share an id but not a text, are documents of their own. No rows give no rows; other columns are not
    read. Sets are told apart by 64-bit digests: two of 10^9 unlike sets share one with a chance of 3 %.
    """
    sized, placed = _rooted(docs, width, similar, text, ident)
    nodes = sized.where(F.col("n") > 0).groupBy("node").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    rooted = nodes.join(placed, "node")
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("copies").alias("component_size"))
    named = rooted.select("node", "root").join(named, "root").select("node", "component_id", "component_size")
    some = sized.where(F.col("n") > 0).join(named, "node").select("id", "n", "component_id", "component_size")
    empty = sized.where(F.col("n") == 0).select("id", "n", F.col("id").alias("component_id"),
                                                F.lit(1).cast("long").alias("component_size"))
    return some.unionByName(empty).withColumnsRenamed({"id": "doc_id", "n": "n_shingles"})


def keep_one(docs: DataFrame, width: int = WIDTH, similar: tuple[int, int] = SIMILAR, text: str = "text",
             ident: str = "doc_id") -> DataFrame:
    """The documents, all columns, with one of each component: the row with the smallest id, then text hash.

    Null ids come last. Rows without shingles are in no component and stay, all of them. Of rows alike in id and text
    one stays, whichever.
    """
    sized, placed = _rooted(docs, width, similar, text, ident)
    some = sized.where(F.col("n") > 0).select("id", "body", "node")
    row = F.struct(F.col("id").isNull().alias("last"), "id", "body")
    # equal sets are reduced before the shuffle
    first = some.groupBy("node").agg(F.min(row).alias("f")).join(placed, "node")
    kept = first.groupBy("root").agg(F.min("f").alias("f"))
    kept = first.select("node", "root").join(kept, "root").select("node", "f")
    other = ~(row.eqNullSafe(F.col("f")))
    gone = staged(some.join(kept, "node").where(other).select(F.col("id").alias("_id"), F.col("body").alias("_body")).distinct(), "gone")
    again = staged(some.groupBy("id", "body").count().where(F.col("count") > 1).select(
        F.col("id").alias("_id"), F.col("body").alias("_body")), "again")

    def among(rows: DataFrame, listed: DataFrame, how: str) -> DataFrame:
        small = F.broadcast(listed) if listed.count() <= BROADCAST_ROWS else listed
        return rows.join(small, rows[ident].eqNullSafe(small["_id"]) & (F.xxhash64(rows[text]) == small["_body"]), how)

    left = among(docs, gone, "left_anti")
    if again.isEmpty():
        return left
    return among(left, again, "left_anti").unionByName(among(left, again, "left_semi").dropDuplicates([ident, text]))
