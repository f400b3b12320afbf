"""Exact n-gram Jaccard join with token-combination prefixes.

A document is the set of its distinct word shingles. Sets are ordered by how many sets
hold a shingle (equal sets counted once), unique ones first, then rare, then frequent ones. If two sets of sizes a
and b share at least ``o`` shingles, their first ``a - o + k`` and ``b - o + k`` share at
least ``k`` (extended prefix). A rare shingle of the prefix is indexed by itself; frequent
ones only in combinations of two. Frequent shingles are spread over ``G`` groups and the
prefix is extended by ``G``: either the first shared shingle is rare, or all ``G + 1`` are
frequent and two of them fall into the same group. ``G`` follows the size class, and a set is indexed under its own class and
the next smaller one, as partners are at most one class apart.

Unique shingles can be shared with nobody: a set in which they outweigh the threshold has
no partner and is done; in all others only the shared shingles are kept.

Sets that are equal are one node. Links are verified before anything is connected: in a few rounds every
node is compared with one node it shares an index entry with, and linked nodes get a common
label. An entry whose nodes have one label is done with, so a group of near copies costs little
more than one pass over it. Only nodes of entries with several labels are then compared
pair by pair, where they share such an entry and are not connected yet; large groups of them are cut
into blocks, and every two blocks meet in a task of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.functions.columns import quotient
from duelframe.indexing import index_rows
from duelframe.llm.bytewise import BLANK_WORDS, LOWER, blocks, mix, run_hashes, text_buffer, word_hashes, word_spans
from duelframe.llm.exchange import answer, ask, ask_again, by_shard, corpus_bytes, deal, finish, shard_count, shard_of
from duelframe.llm.names import unused
from duelframe.session import materialize, small_side

SHINGLE_WORDS = 5
# The threshold as a fraction of whole numbers: 75 / 100.
SHARE = (75, 100)
# A shingle in more sets than this is frequent.
FREQUENT = 32
# Sets up to this size index every shingle by itself as well.
SMALL_SET = 32
# The smallest set for which combinations are indexed; a partner of a smaller one is small.
COMBINED_SET = 24
UNIQUE, RARE, COMMON = 0, 1, 2
_PAIR = np.uint64(0xE7037ED1A0B428DB)
_SEED = np.uint64(0x8EBC6AF09C88C6E3)


def shingle_sets(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every document of a batch, sorted, one document after the other."""
    sets, counts = [], []
    data, offsets = text_buffer(table.column("_text"))
    for first, last in blocks(offsets):
        part = LOWER[data[offsets[first] : offsets[last]]]
        starts, ends, firsts = word_spans(part, offsets[first : last + 1] - offsets[first], BLANK_WORDS)
        words = word_hashes(part, starts, ends)
        shingles = run_hashes(words, SHINGLE_WORDS)
        sizes = np.diff(firsts)
        for low, size in zip(firsts[:-1].tolist(), sizes.tolist()):
            if size >= SHINGLE_WORDS:
                own = np.unique(shingles[low : low + size - SHINGLE_WORDS + 1])
            elif size:
                own = run_hashes(words[low : low + size], size) ^ np.uint64(size)
            else:
                own = words[:0]
            sets.append(own)
            counts.append(len(own))
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.array(counts, dtype=np.int64)


_NODES, _SHINGLES = 0, 1  # kinds of questions


class _Sets:
    """Sets of a batch; of equal ones the first speaks for all."""

    def __init__(self, table: pa.Table):
        self.sets, self.counts = shingle_sets(table)
        firsts = np.cumsum(self.counts) - self.counts
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.sets ^ _SEED), dtype=np.uint64)])
        self.node = mix(sums[firsts + self.counts] - sums[firsts] + self.counts.astype(np.uint64))
        self.names, self.speaker = np.unique(self.node[self.counts > 0], return_index=True)
        self.speaker = np.flatnonzero(self.counts > 0)[self.speaker]

    def question(self, shards: int) -> list[tuple]:
        """Sets by name; names are sorted, and shards follow their leading bits."""
        return by_shard(_NODES, shard_of(self.names, shards).astype(np.int64), self.names, np.zeros(len(self.names), np.uint8))

    def owned(self, known: dict[int, bytes]) -> np.ndarray:
        """Which documents speak for their set in the whole corpus."""
        out = np.zeros(len(self.counts), dtype=bool)
        out[self.speaker] = np.frombuffer(known.get(_NODES, b""), np.uint8) > 0
        return out


class _Tokens:
    """Shingles of the owned sets of a batch by shard and short name, with the number of sets."""

    def __init__(self, sets: _Sets, owned: np.ndarray, shards: int):
        tokens = sets.sets[np.repeat(owned, sets.counts)]
        # Short names: two shingles that share one count together, which only overestimates.
        name = (shard_of(tokens, shards) << np.uint64(32)) | (mix(tokens.copy()) & np.uint64(0xFFFFFFFF))
        self.names, self.kind, holders = np.unique(name, return_inverse=True, return_counts=True)
        self.holders = np.minimum(holders, 255).astype(np.uint8)

    def question(self) -> list[tuple]:
        shards = (self.names >> np.uint64(32)).astype(np.int64)
        return by_shard(_SHINGLES, shards, self.names.astype(np.uint32), self.holders)


def _owners(kind: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The first batch that holds a set owns it."""
    names = np.concatenate([n for n, _ in parts])
    first = np.zeros(len(names), dtype=np.uint8)
    first[np.unique(names, return_index=True)[1]] = 1
    return np.split(first, np.cumsum([len(n) for n, _ in parts])[:-1])


def _classes(kind: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    names = np.concatenate([n for n, _ in parts])
    documents = np.concatenate([d for _, d in parts]).astype(np.int64)
    order = np.argsort(names, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], np.diff(names[order]) != 0]))
    total = np.add.reduceat(documents[order], new)
    classes = np.where(total == 1, UNIQUE, np.where(total <= FREQUENT, RARE, COMMON)).astype(np.uint8)
    out = np.empty(len(names), dtype=np.uint8)
    out[order] = np.repeat(classes, np.diff([*new, len(names)]))
    return np.split(out, np.cumsum([len(n) for n, _ in parts])[:-1])


def required(size: int) -> int:
    """Shingles that a set of this size shares with any partner, at least."""
    return -(-SHARE[0] * size // SHARE[1])


def groups(size_class: int) -> int:
    return max(1, (1 << size_class) // 16)


def signatures(shared: np.ndarray, classes: np.ndarray, size: int) -> np.ndarray:
    """Index entries of a set from its shingles with a partner, in the global order.

    ``shared`` is the set without unique shingles, which fill the prefix first.
    """
    room = size - required(size) - (size - len(shared))  # places of the prefix left, without extension
    size_class = size.bit_length()
    out = []
    first = max(0, room + 1)
    # The first shared shingle lies in this prefix. If it is common, so are all behind it.
    out.append(shared[:first] if size <= SMALL_SET else shared[:first][classes[:first] == RARE])
    if size >= COMBINED_SET:
        for c in (size_class, size_class - 1):
            count = groups(c)
            prefix = max(0, room + count + 1)
            common = shared[:prefix][classes[:prefix] == COMMON]
            group = mix(common ^ _SEED) % np.uint64(count)
            order = np.lexsort((common, group))
            common, group = common[order], group[order]
            for step in range(1, len(common)):
                same = group[step:] == group[:-step]
                if not same.any():
                    break
                one, two = common[:-step][same], common[step:][same]
                out.append(mix(one * _PAIR + two + np.uint64(c)))
    return np.unique(np.concatenate(out)) if out else shared[:0]


_SETS = "doc_id long, n_shingles long, node long, shared binary, entries array<long>"
_SETS_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("shared", pa.binary()), ("entries", pa.list_(pa.int64()))]
)


def _indexed(table: pa.Table, known: dict[int, bytes], shards: int) -> pa.Table:
    """Size and node of every document; shared shingles and index entries of owned sets that can have a partner."""
    sets = _Sets(table)
    owned = sets.owned(known)
    tokens = _Tokens(sets, owned, shards)
    classes = np.frombuffer(known.get(_SHINGLES, b""), np.uint8)[tokens.kind]
    shared: list[bytes | None] = []
    entries: list[np.ndarray | None] = []
    at = of_class = 0
    for size, own in zip(sets.counts.tolist(), owned.tolist()):
        common = kind = None
        if own:
            kind = classes[of_class : of_class + size]
            common = sets.sets[at : at + size][kind > UNIQUE]
            of_class += size
        at += size
        if common is None or len(common) < required(size):
            shared.append(None)
            entries.append(None)
            continue
        kind = kind[kind > UNIQUE]
        order = np.lexsort((common, kind))
        shared.append(common.tobytes())
        entries.append(signatures(common[order], kind[order], size).view(np.int64))
    nodes = pa.array(sets.node.view(np.int64), pa.int64(), mask=sets.counts == 0)
    return pa.table(
        [table.column("_id"), pa.array(sets.counts, pa.int64()), nodes, pa.array(shared, pa.binary()), pa.array(entries, pa.list_(pa.int64()))],
        schema=_SETS_ARROW,
    )


def index_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    total = corpus_bytes(docs, text_col)
    texts = deal(docs, total, id_col, text_col)
    shards = shard_count(total)
    # Answers are written, so that the questions of one pass are gone before the next; texts are dealt again in each.
    owners = materialize(answer(ask(texts, lambda table: _Sets(table).question(shards)), _owners, "<u8"), "owners", release=True)

    def shingles(table: pa.Table, known: dict[int, bytes]) -> list[tuple]:
        sets = _Sets(table)
        return _Tokens(sets, sets.owned(known), shards).question()

    classes = materialize(answer(ask_again(texts, owners, shingles), _classes, "<u4"), "classes", release=True)
    return finish(texts, owners.unionByName(classes), lambda table, known: _indexed(table, known, shards), _SETS)


# Nodes of a block of a large group of open candidates, and bytes of shingles in a task of small ones.
BLOCK_NODES = 2000
PACK_BYTES = 8 << 20
# Slices of the index. Each gives a round in which every node is compared with one other, before the rest is searched.
SLICES = 4
# A round that finds fewer links than one in so many of those before is the last of them.
FEW = 10
# Bytes of sets sent to tasks at once, unless a quarter of all sets is more.
ROUND_BYTES = 256 << 20


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, label)`` for the nodes of ``edges (a, b)``: the least node reachable.

    Large stars and small stars by turns: a node hands its larger neighbours to its least one, then
    its smaller neighbours and itself to the least of these. Edges never become more, and
    end as one edge from each node to its label.
    """
    ends = F.greatest("a", "b").alias("node"), F.least("a", "b").alias("label")
    stars = materialize(edges.filter("a != b").select(*ends).distinct(), "edges", release=True)
    state = _checksum(stars)
    for _ in range(rounds if state[0] else 0):
        both = stars.unionByName(stars.select(F.col("label").alias("node"), F.col("node").alias("label")))
        near = both.groupBy("node").agg(F.min("label").alias("_near")).select(F.col("node").alias("_node"), F.least("node", "_near").alias("_near"))
        large = both.join(near, both["node"] == near["_node"]).filter("label > node").select(F.col("label").alias("node"), F.col("_near").alias("label")).distinct()
        low = large.groupBy("node").agg(F.min("label").alias("_low")).withColumnRenamed("node", "_node")
        handed = F.array(F.struct("node", F.col("_low").alias("label")), F.struct(F.col("label").alias("node"), F.col("_low").alias("label")))
        stars = materialize(large.join(low, large["node"] == low["_node"]).select(F.inline(handed)).filter("node != label").distinct(), "stars", release=True)
        before, state = state, _checksum(stars)
        if before == state:
            break
    else:
        if state[0]:
            raise RuntimeError(f"components are not settled after {rounds} rounds")
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "label").cast("decimal(38,0)"))).first())


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of all rows, and their number in each."""
    data, offsets = text_buffer(column)
    return np.frombuffer(data.tobytes(), "<u8"), np.diff(offsets) // 8


def _linked(common: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return SHARE[1] * common >= SHARE[0] * (one + other - common)


def _near(one: Column, other: Column) -> Column:
    """Whether sets of these sizes can be linked."""
    return SHARE[1] * F.least(one, other) >= SHARE[0] * F.greatest(one, other)


def verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of nodes whose sets are linked."""

    def side(name: str) -> DataFrame:
        named = held.select(F.col("node").alias(name), F.col("n_shingles").alias(f"_n{name}"), F.col("shared").alias(f"_s{name}"))
        return named.join(pairs.select(name), name, "left_semi")

    rows = pairs.join(side("a"), "a").join(side("b"), "b").filter(_near(F.col("_na"), F.col("_nb")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            (one, sizes), (other, others) = _flat(batch.column("_sa")), _flat(batch.column("_sb"))
            row = np.concatenate([np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.arange(len(sizes)), others)])
            tokens = np.concatenate([one, other])
            order = np.lexsort((tokens, row))
            row, tokens = row[order], tokens[order]
            twice = (tokens[1:] == tokens[:-1]) & (row[1:] == row[:-1])  # a set holds a shingle once
            common = np.bincount(row[1:][twice], minlength=len(sizes))
            found = _linked(common, batch.column("_na").to_numpy(), batch.column("_nb").to_numpy())
            yield batch.filter(pa.array(found)).select(["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _search(
    node: np.ndarray, label: np.ndarray, size: np.ndarray, block: np.ndarray, sets: list[np.ndarray], entries: list[np.ndarray]
) -> list[tuple[int, int]]:
    """Links between nodes that share an entry and are not connected by labels or links found before.

    Of two blocks, only nodes of different ones are compared; within a block they are in another task.
    """
    two = block.min() != block.max()
    lengths = np.array([len(s) for s in sets], dtype=np.int64)
    _, tokens = np.unique(np.concatenate(sets), return_inverse=True)
    begins = np.cumsum(lengths) - lengths
    marked = np.zeros(int(tokens.max(initial=0)) + 1, dtype=np.int32)
    _, label = np.unique(label, return_inverse=True)
    held = np.array([len(e) for e in entries])
    _, entry = np.unique(np.concatenate(entries), return_inverse=True)
    of_entry = np.argsort(entry, kind="stable")
    holders = np.repeat(np.arange(len(node)), held)[of_entry]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(entry))])
    own_entries = np.split(entry, np.cumsum(held)[:-1])
    links: list[tuple[int, int]] = []
    for x in range(len(node)):
        among = np.unique(np.concatenate([holders[bounds[e] : bounds[e + 1]] for e in own_entries[x]]))
        among = among[(among > x) & (label[among] != label[x])]
        among = among[block[among] != block[x]] if two else among
        among = among[SHARE[1] * np.minimum(size[among], size[x]) >= SHARE[0] * np.maximum(size[among], size[x])]
        if not len(among):
            continue
        own = tokens[begins[x] : begins[x] + lengths[x]]
        marked[own] = 1
        ends = np.cumsum(lengths[among])
        place = np.arange(ends[-1]) + np.repeat(begins[among] - (ends - lengths[among]), lengths[among])
        common = np.add.reduceat(marked[tokens[place]], ends - lengths[among])
        marked[own] = 0
        found = among[_linked(common, size[among], size[x])]
        for y in found.tolist():
            if label[y] != label[x]:
                links.append((int(node[x]), int(node[y])))
                label[label == label[y]] = label[x]
    return links


def _search_task(table: pa.Table) -> pa.Table:
    """Links of a task from rows with the set of a node and rows with its entries, group and label."""
    is_set = pc.is_valid(table.column("shared"))
    sets, table = table.filter(is_set), table.filter(pc.invert(is_set))
    shared = dict(zip(sets.column("node").to_pylist(), sets.column("shared").combine_chunks()))
    node, group, label, size, block = (table.column(c).to_numpy() for c in ("node", "group", "label", "n_shingles", "block"))
    entries = table.column("entries").combine_chunks()
    links: list[tuple[int, int]] = []
    order = np.lexsort((node, group))
    for part in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        if len(part) > 1:
            own = [entries[int(i)].values.to_numpy() for i in part]
            links += _search(node[part], label[part], size[part], block[part], [np.frombuffer(shared[i].as_buffer(), np.uint64) for i in node[part].tolist()], own)
    columns = list(zip(*links)) if links else [(), ()]
    return pa.table([pa.array(c, pa.int64()) for c in columns], schema=_LINKS)


def _slice(sets: DataFrame, number: int) -> DataFrame:
    """``(entry, node, n_shingles)`` of one slice of the index."""
    rows = sets.filter("entries IS NOT NULL").select("node", "n_shingles", F.explode("entries").alias("entry"))
    return rows.filter(F.pmod(F.xxhash64("entry"), F.lit(SLICES)) == number)


def _open_entries(held_by: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows ``(entry, node, n_shingles)`` of entries whose nodes are not all connected yet, with their label and the least of ``(label, node, n_shingles)`` as ``pivot``.

    In order of size, an entry is cut where the next set is too large to be linked with the one before it;
    each ``part`` is then an entry of its own. Without ``n_shingles`` nothing is cut.
    """
    if "n_shingles" not in held_by.columns:
        held_by = held_by.withColumn("n_shingles", F.lit(1))
    if labels is None:
        rows = held_by.withColumn("label", F.col("node"))
    else:
        known = labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
        joined = held_by.join(known, held_by["node"] == known["_node"], "left")
        rows = joined.select("entry", "node", "n_shingles", F.coalesce("_label", "node").alias("label"))
    by_size = Window.partitionBy("entry").orderBy("n_shingles", "node")
    cut = F.coalesce((~_near(F.lag("n_shingles").over(by_size), F.col("n_shingles"))).cast("int"), F.lit(0))
    parts = rows.withColumn("_cut", cut).withColumn("part", F.sum("_cut").over(by_size.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("entry", "part")
    ends = {"pivot": F.min(F.struct("label", "node", "n_shingles")).over(whole), "_most": F.max("label").over(whole)}
    return parts.withColumns(ends).filter("pivot.label < _most").drop("_cut", "_most")


def _proposed(opened: DataFrame) -> DataFrame:
    """For each node ``a`` the pivot ``b`` that it meets in the most entries, of those it is not connected with."""
    met = opened.filter((F.col("label") != F.col("pivot.label")) & _near(F.col("n_shingles"), F.col("pivot.n_shingles")))
    met = met.groupBy("node", "n_shingles", "pivot").agg(F.count(F.lit(1)).alias("_met"))
    best = met.groupBy("node", "n_shingles").agg(F.max(F.struct("_met", "pivot")).alias("_best"))
    return best.select(F.col("node").alias("a"), F.col("_best.pivot.node").alias("b"), (8 * (F.col("n_shingles") + F.col("_best.pivot.n_shingles"))).alias("_bytes"))


def _rounds(sent: int, total: int) -> int:
    """Rounds in which so many bytes are sent, of sets that have ``total`` together."""
    return max(1, -(-sent // max(ROUND_BYTES, total // 4)))


def _verified_in_rounds(pairs: DataFrame, held: DataFrame, total: int) -> DataFrame:
    rounds = _rounds(pairs.agg(F.coalesce(F.sum("_bytes"), F.lit(0))).first()[0], total)
    found = []
    for number in range(rounds):
        own = pairs.filter(F.pmod(F.xxhash64("b"), F.lit(rounds)) == number).select("a", "b")
        found.append(materialize(verified(small_side(own, "pairs"), held), "links", release=True))
    return _union(found)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def find_links(sets: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between nodes of ``index_sets`` that connect what all links connect.

    A few rounds, at most one for each slice of the index, compare every node with one other at most: of the
    least nodes of its entries, as connected so far, the one that is least in most. Near copies are
    connected by then, and entries all of whose nodes are connected are done with. Candidates of the
    entries still open are compared one by one, unless they are connected meanwhile.
    """
    held = sets.filter("shared IS NOT NULL").select("node", "n_shingles", "shared")
    total = held.agg(F.coalesce(F.sum(F.octet_length("shared")), F.lit(0))).first()[0]
    links: list[DataFrame] = []
    labels, linked = None, 0
    for number in range(SLICES):
        proposed = materialize(_proposed(_open_entries(_slice(sets, number), labels)), "proposed", release=True)
        found = _verified_in_rounds(proposed, held, total)
        count = found.count()
        if not count:
            break
        links.append(found)
        labels = components(_union(links))
        if count < linked // FEW:
            break
        linked += count
    opened = [
        materialize(
            _open_entries(_slice(sets, number), labels).select("entry", "part", "node", "n_shingles", "label", F.col("pivot.label").alias("least")), "open-entries", release=True
        )
        for number in range(SLICES)
    ]
    return _union([*links, _search_open(_union(opened), held, total)])


def _search_open(opened: DataFrame, held: DataFrame, total: int) -> DataFrame:
    """Links among the candidates of open entries, group by group of labels that share entries.

    The nodes of a large group are cut into blocks in order of size, and two blocks meet if they have
    sets near enough in size. What is sent to such tasks at once is bounded, so there may be several rounds.
    """
    if not opened.limit(1).count():
        return opened.select(F.col("node").alias("a"), F.col("node").alias("b"))
    groups_of = components(opened.filter("label != least").select(F.col("label").alias("a"), F.col("least").alias("b")).distinct())
    # Parts of an entry are held by other nodes, so each gets a name of its own.
    name = F.when(F.col("part") == 0, F.col("entry")).otherwise(F.xxhash64("entry", "part"))
    nodes = opened.groupBy("node", "label", "n_shingles").agg(F.collect_list(name).alias("entries"))  # entries of one set
    grouped = nodes.join(groups_of.select(F.col("node").alias("label"), F.col("label").alias("group")), "label")
    placed = materialize(grouped, "candidates", release=True)
    size = 8 * (F.col("n_shingles") + F.size("entries"))
    order = index_rows(placed.select("group", "n_shingles", "node", size.cast("long").alias("_bytes")), ["group", "n_shingles", "node"], "_place")
    firsts = order.groupBy(F.col("group").alias("_group")).agg(F.min("_place").alias("_first"))
    block = quotient(F.col("_place") - F.col("_first"), BLOCK_NODES)
    order = materialize(order.join(firsts, order["group"] == firsts["_group"]).select("group", "node", "n_shingles", "_bytes", block.alias("block")), "blocks", release=True)
    pairs = _block_pairs(order)
    rounds = _rounds(pairs.agg(F.sum("_bytes")).first()[0], total)
    packs = max(1, -(-order.agg(F.sum("_bytes")).first()[0] // PACK_BYTES))
    ends = F.explode(F.when(F.col("i") == F.col("j"), F.array("i")).otherwise(F.array("i", "j"))).alias("_block")
    places = order.select(F.col("node").alias("_node"), F.col("group").alias("_group"), "block")
    found = []
    for number in range(rounds):
        own = pairs.filter(F.pmod(F.xxhash64("group", "i", "j"), F.lit(rounds)) == number)
        # Groups of one block share tasks.
        task = F.when(F.col("_alone"), F.pmod(F.xxhash64("group"), F.lit(packs))).otherwise(F.col("group")).alias("task")
        met = own.select(F.col("group").alias("_of"), task, F.when(F.col("_alone"), -1).otherwise(F.col("i")).alias("i"), F.when(F.col("_alone"), -1).otherwise(F.col("j")).alias("j"), ends)
        sent = places.join(met, (places["_group"] == met["_of"]) & (places["block"] == met["_block"])).select("_node", "task", "i", "j", "block")
        sent = small_side(sent, "sent")
        # A node's set and its entries come to a task as two rows.
        rows = placed.join(sent, F.col("node") == F.col("_node")).withColumn("shared", F.lit(None).cast("binary"))
        own_sets = held.join(sent, F.col("node") == F.col("_node")).withColumn("entries", F.lit(None).cast("array<long>"))
        for column in ("group", "label"):
            own_sets = own_sets.withColumn(column, F.lit(None).cast("long"))
        columns = ["task", "i", "j", "group", "node", "label", "n_shingles", "block", "shared", "entries"]
        rows = rows.select(*columns).unionByName(own_sets.select(*columns))
        found.append(materialize(rows.groupBy("task", "i", "j").applyInArrow(_search_task, "a long, b long"), "links", release=True))
    return _union(found)


def _block_pairs(order: DataFrame) -> DataFrame:
    """``(group, i, j)`` of blocks that have sets near enough in size, ``_bytes`` of both, and whether there is no other block."""
    blocks = order.groupBy("group", "block").agg(F.min("n_shingles").alias("_least"), F.max("n_shingles").alias("_most"), F.sum("_bytes").alias("_bytes"))
    blocks = materialize(blocks, "block-sizes", release=True)
    counts = blocks.groupBy(F.col("group").alias("_counted")).agg((F.count(F.lit(1)) == 1).alias("_alone"))
    one = blocks.select("group", F.col("block").alias("i"), F.col("_most").alias("_to"), F.col("_bytes").alias("_own"))
    other = blocks.select(F.col("group").alias("_group"), F.col("block").alias("j"), F.col("_least").alias("_from"), F.col("_bytes").alias("_others"))
    met = one.join(other, (F.col("group") == F.col("_group")) & (F.col("i") <= F.col("j")))
    # In order of size, the nearest sets are the largest of one block and the least of the next.
    met = met.filter((F.col("i") == F.col("j")) | (SHARE[1] * F.col("_to") >= SHARE[0] * F.col("_from")))
    named = met.join(counts, F.col("group") == F.col("_counted"))
    total = F.when(F.col("i") == F.col("j"), F.col("_own")).otherwise(F.col("_own") + F.col("_others"))
    return materialize(named.select("group", "i", "j", "_alone", total.alias("_bytes")), "block-pairs", release=True)


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row.

    Two documents link when 100 times their common shingles is at least 75 times all their
    shingles; ``component_id`` is the least id reachable by links. Null and blank texts
    have no shingle and no link. Rows that share an id are documents of their own; a null
    id takes part, but is never the least of others. Every row gives a row.
    """
    sets = materialize(index_sets(docs, id_col, text_col), "shingle-sets", release=True)
    nodes = components(find_links(sets))
    alone = sets.filter("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    held = sets.filter("node IS NOT NULL").select("doc_id", "n_shingles", F.col("node").alias("_node"))
    placed = held.join(nodes, held["_node"] == nodes["node"], "left").select("doc_id", "n_shingles", F.coalesce("label", "_node").alias("_component"))
    least = placed.groupBy("_component").agg(F.min("doc_id").alias("component_id"))
    return alone.unionByName(placed.join(least, "_component").select("doc_id", "n_shingles", "component_id"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The document with the least id of every component, all columns kept.

    Of rows that share an id, the one with the least hash of its text stays. Rows without
    an id all stay, as nothing names them.
    """
    found = link_documents(docs).select("doc_id", "component_id")
    leader, copy = unused(docs, "_leader"), unused(docs, "_copy")
    leaders = found.filter("doc_id = component_id").select(F.col("doc_id").alias(leader))
    kept = docs.join(leaders, F.col("doc_id") == F.col(leader), "left_semi")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    one = kept.withColumn(copy, F.row_number().over(first)).filter(F.col(copy) == 1).select(*docs.columns)
    return one.unionByName(docs.filter("doc_id IS NULL"))
