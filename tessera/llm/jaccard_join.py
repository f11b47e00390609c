"""N-gram Jaccard join by a token-group matrix: every link between different texts is found, and none is guessed.

1. Documents with equal shingle sets become one set.
2. Shards count in how many sets each shingle occurs. A set can only link if enough of its shingles occur elsewhere;
   all others leave here. Shingles are ordered rarest first, and two sets that link share one of the first
   ``n - ceil(threshold * n) + 1`` (the prefix) of either.
3. Similar sets are put into groups by their most frequent shingle, bounded in shingles and sets; a hot shingle is split
   over several groups. Each group links its own sets exactly, and one set of each cluster goes to the next round, so
   that the parts of a hot value meet; later rounds group by the smallest hashes of the shared shingles.
4. The token-group matrix holds the union of the prefixes of each of the first round's groups. Only pairs of groups with
   a shingle and compatible sizes in common qualify, unless both lie in one cluster. An opened pair first bounds each
   set's overlap by the other group's union of shingles, then compares what is left exactly.

So a family of near copies costs what its groups cost, and no pairs within a cluster are listed. What meets in one
task is a chunk, a shard or two groups, all of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import chunk_blocks, chunk_table, open_chunk, pack_keys, pack_small, unpack_keys, unpack_small
from .common import join_keyed, parts_for, stage_table
from .components import components, roots_of
from .words import distinct_per_row, lower_ascii, mix, row_shingles, word_hashes, word_spans

WIDTH, PERCENT = 5, 80
#: Bits of a shingle's hash under which its sets are counted; a collision only makes a shingle look less rare.
KEY_BITS = 48
SHARD_BYTES = 8 << 20
#: Bounds of a group.
GROUP_SETS, GROUP_SHINGLES = 128, 1 << 20
_ONE, _TWO = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949D7C7509E6557)
_SALTS = (_ONE, _TWO)


def need_of(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The least overlap of a set of ``n`` with one that it links to."""
    return (percent * n + 99) // 100


def chunk_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text of a chunk, one text after the other, and how many each has."""
    values, sizes = [], []
    for _, _, part, edges in chunk_blocks(data, offsets):
        low = lower_ascii(part)
        starts, ends, counts = word_spans(low, edges)
        v, n = distinct_per_row(*row_shingles(word_hashes(low, starts, ends), counts, width))
        values.append(v)
        sizes.append(n)
    return np.concatenate(values), np.concatenate(sizes).astype(np.int64)


def _per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])[bounds])


def set_table(chunks: DataFrame, width: int) -> DataFrame:
    """``doc_id, chunk, pos, n, h1, h2`` of every document; ``h1, h2`` is a digest of its set."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                number, ids, data, offsets = open_chunk(batch, i)
                values, n = chunk_sets(data, offsets, width)
                bounds = np.concatenate([[0], np.cumsum(n)])
                digests = [_per_row(mix(values ^ c), bounds).view(np.int64) for c in (_ONE, _TWO)]
                columns = [ids, pa.array(np.full(len(n), number)), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n), *map(pa.array, digests)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "chunk", "pos", "n", "h1", "h2"])

    return chunks.mapInArrow(run, "doc_id long, chunk long, pos int, n long, h1 long, h2 long")


def _open_sets(chunk: pa.Table, others: pa.Table, width: int):
    """The chosen sets of a chunk: nodes, shingles, sizes, distinct keys, and the key of each shingle."""
    _, _, data, offsets = open_chunk(chunk)
    values, n = chunk_sets(data, offsets, width)
    mine = others.filter(pa.compute.is_valid(others.column("pos")))
    pos = mine.column("pos")[0].values.to_numpy() if mine.num_rows else np.zeros(0, np.int32)
    nodes = mine.column("nodes")[0].values.to_numpy() if mine.num_rows else np.zeros(0, np.int64)
    chosen = np.zeros(len(n), dtype=bool)
    chosen[pos] = True
    order = np.argsort(pos)
    values, n = values[np.repeat(chosen, n)], n[chosen]
    keys, of = np.unique(values >> np.uint64(64 - KEY_BITS), return_inverse=True)
    return nodes[order], values, n, keys, of


def _shard_bounds(keys: np.ndarray, shards: int) -> np.ndarray:
    """Places where each shard's range of keys begins."""
    edge = [(s << KEY_BITS) // shards for s in range(shards + 1)]
    return np.searchsorted(keys, np.array(edge, dtype=np.uint64))


def rarities(chunks: DataFrame, chosen: DataFrame, shards: int, width: int) -> DataFrame:
    """``chunk, shard, codes``: for each key of a chunk, a code of how many sets hold it; 0 stands for one set."""

    def ask(key, chunk, others):
        rows = []
        if chunk.num_rows and others.num_rows:
            number = key[0].as_py()
            _, _, _, keys, of = _open_sets(chunk, others, width)
            counts, at = np.bincount(of, minlength=len(keys)), _shard_bounds(keys, shards)
            rows = [
                (number, s, pack_keys(keys[at[s] : at[s + 1]]), pack_small(counts[at[s] : at[s + 1]], "<u4"))
                for s in np.flatnonzero(np.diff(at)).tolist()
            ]
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
        columns = list(zip(*rows)) or [[]] * 4
        return pa.table([pa.array(x, t) for x, t in zip(columns, kinds)], names=["chunk", "shard", "keys", "counts"])

    def answer(table):
        keys = [unpack_keys(x.as_py()) for x in table.column("keys")]
        counts = np.concatenate([unpack_small(x.as_py(), "<u4") for x in table.column("counts")])
        at = np.cumsum([0] + [len(k) for k in keys])
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, weights=counts)
        codes = np.where(total > 1, np.minimum(1 + np.floor(2 * np.log2(np.maximum(total, 1))), 255), 0)[place]
        out = [pack_small(codes[at[i] : at[i + 1]], "u1") for i in range(len(keys))]
        return pa.table({"chunk": table.column("chunk"), "shard": table.column("shard"), "codes": pa.array(out, pa.binary())})

    asked = chunks.groupBy("chunk").cogroup(chosen.groupBy("chunk")).applyInArrow(ask, "chunk long, shard int, keys binary, counts binary")
    asked = asked.repartition(parts_for(chunks.sparkSession, shards, 1), "shard")
    return asked.groupBy("shard").applyInArrow(answer, "chunk long, shard int, codes binary")


#: What sets are grouped by: their most frequent shingle, and two smallest hashes.
KEYS = ("common", "k1", "k2")
SETS = "node long, n long, " + ", ".join(f"{k} long" for k in KEYS) + ", tokens binary, prefix array<long>"


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values.view(np.int64)))


def shared_sets(chunks: DataFrame, answers: DataFrame, chosen: DataFrame, shards: int, width: int, percent: int) -> DataFrame:
    """Sets of which enough shingles occur in other sets: all shingles, the prefix, and what to group by."""

    def run(chunk, others):
        names = [x.split(" ")[0] for x in SETS.split(", ")]
        kinds = [pa.int64()] * (2 + len(KEYS)) + [pa.binary(), pa.list_(pa.int64())]
        nothing = pa.table([pa.array([], t) for t in kinds], names=names)
        if not chunk.num_rows or not others.num_rows:
            return nothing
        nodes, values, n, keys, of = _open_sets(chunk, others, width)
        code, at = np.zeros(len(keys), np.uint8), _shard_bounds(keys, shards)
        replies = others.filter(pa.compute.is_valid(others.column("codes")))
        for s, raw in zip(replies.column("shard").to_pylist(), replies.column("codes").to_pylist()):
            code[at[s] : at[s + 1]] = unpack_small(raw, "u1")
        code = code[of]
        bounds = np.concatenate([[0], np.cumsum(n)])
        shared = _per_row((code > 0).astype(np.int64), bounds)
        stay = shared >= need_of(n, percent)
        if not stay.any():
            return nothing
        inside = np.repeat(stay, n)
        values, code, nodes, n = values[inside], code[inside], nodes[stay], n[stay]
        row = np.repeat(np.arange(len(n)), n)
        bounds = np.concatenate([[0], np.cumsum(n)])
        order = np.lexsort((values, code, row))
        place = np.arange(len(values)) - bounds[row]
        first = (place < (n - need_of(n, percent) + 1)[row]) & (code[order] > 0)
        least = [np.minimum.reduceat(np.where(code > 0, mix(values ^ c), np.uint64(2**64 - 1)), bounds[:-1]).view(np.int64) for c in _SALTS]
        common = values[order][bounds[1:] - 1].view(np.int64)
        raw = values.astype("<u8").tobytes()
        packed = pa.array([raw[8 * a : 8 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary())
        prefix = _lists(values[order][first], np.bincount(row[first], minlength=len(n)))
        return pa.table([pa.array(nodes), pa.array(n), pa.array(common), *map(pa.array, least), packed, prefix], names=names)

    said = answers.select("chunk", "shard", "codes", F.lit(None).cast("array<int>").alias("pos"), F.lit(None).cast("array<long>").alias("nodes"))
    known = chosen.select("chunk", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("binary").alias("codes"), "pos", "nodes")
    return chunks.groupBy("chunk").cogroup(said.unionByName(known).groupBy("chunk")).applyInArrow(run, SETS)


def overlaps(a: list[np.ndarray], b: list[np.ndarray] | None = None, width: int = 1 << 14) -> np.ndarray:
    """Sizes of the intersections of every set of ``a`` with every set of ``b`` (``None``: of ``a`` itself)."""
    sets = a if b is None else a + b
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, local, times = np.unique(values, return_inverse=True, return_counts=True)
    out = np.zeros((len(a), len(a) if b is None else len(b)), dtype=np.float32)
    keep = times > 1  # a shingle of one set is in no intersection
    column = np.cumsum(keep) - 1
    row, column = row[keep[local]], column[local[keep[local]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [begin, begin + width])
        dense = np.zeros((len(sets), int(column[hi - 1]) - begin + 1), dtype=np.float32)
        dense[row[lo:hi], column[lo:hi] - begin] = 1
        out += dense[: len(a)] @ (dense if b is None else dense[len(a) :]).T
    if b is None:
        out[np.arange(len(a)), np.arange(len(a))] = [len(x) for x in a]
    return out.astype(np.int64)


def links(a: list[np.ndarray], b: list[np.ndarray] | None, percent: int) -> np.ndarray:
    """Which sets of ``a`` link to which of ``b``."""
    both = overlaps(a, b)
    na = np.array([len(x) for x in a], dtype=np.int64)
    nb = na if b is None else np.array([len(x) for x in b], dtype=np.int64)
    return 100 * both >= percent * (na[:, None] + nb[None, :] - both)


def clusters_of(linked: np.ndarray) -> np.ndarray:
    """The smallest member's place for each member, of the components of a symmetric link matrix."""
    label = np.arange(len(linked))
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label)))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _sets_of(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype="<u8") for x in table.column("tokens")]


def salted(sets: DataFrame, key: str) -> DataFrame:
    """``sets`` with ``salt``, so that ``(key, salt)`` bounds a group; keys with one set are left out."""
    size = sets.groupBy(key).agg(F.count("*").alias("__sets"), F.sum("n").alias("__shingles")).where("__sets > 1")
    salts = F.ceil(F.greatest(F.col("__sets") / GROUP_SETS, F.col("__shingles") / GROUP_SHINGLES))
    size = size.select(key, "__sets", salts.alias("__salts"))
    named = join_keyed(sets, size, key, "__sets", sets.count())
    return named.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(11)), F.col("__salts")).cast("int")).drop("__salts", "__sets")


def link_round(sets: DataFrame, key: str, percent: int) -> DataFrame:
    """``node, root``: sets that link within their group; ``root`` is the group's smallest node of the cluster."""

    def run(table):
        table = table.sort_by("node")
        node = table.column("node").to_numpy()
        root = node[clusters_of(links(_sets_of(table), None, percent))]
        moved = root != node
        return pa.table({"node": pa.array(node[moved]), "root": pa.array(root[moved])})

    return salted(sets.select("node", "n", "tokens", key), key).repartition(key, "salt").groupBy(key, "salt").applyInArrow(run, "node long, root long")


GROUPS = "low long, high long, only long, clusters array<long>, prefix array<long>, sizes array<long>, tokens binary"


def group_table(sets: DataFrame, key: str) -> DataFrame:
    """The groups: range of set sizes, union of prefixes (a row of the matrix), the one cluster if all sets are in one,
    and all sets with their clusters."""

    def run(table):
        n, cluster = table.column("n").to_numpy(), table.column("cluster").to_numpy()
        union = np.unique(table.column("prefix").combine_chunks().flatten().to_numpy())
        only = int(cluster[0]) if (cluster == cluster[0]).all() else None
        row = {
            "low": int(n.min()), "high": int(n.max()), "only": only, "clusters": cluster, "prefix": union, "sizes": n,
            "tokens": b"".join(table.column("tokens").to_pylist()),
        }
        kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 3 + [pa.binary()]
        return pa.table([pa.array([v], t) for v, t in zip(row.values(), kinds)], names=list(row))

    alone = sets.join(sets.groupBy(key).agg(F.count("*").alias("__sets")).where("__sets = 1"), key).select(
        F.col("n").alias("low"), F.col("n").alias("high"), F.col("cluster").alias("only"), F.array("cluster").alias("clusters"), "prefix", F.array("n").alias("sizes"), "tokens"
    )
    several = salted(sets, key)
    return several.repartition(key, "salt").groupBy(key, "salt").applyInArrow(run, GROUPS).unionByName(alone)


def open_groups(groups: DataFrame, percent: int) -> DataFrame:
    """``a, b``: clusters that a link joins, found by opening the qualifying pairs of groups; ``groups`` has a number each."""
    matrix = groups.select("number", "only", "low", "high", F.explode("prefix").alias("token"))
    # A shingle that only groups of one cluster hold can join nothing; a family's own shingles leave here.
    apart = matrix.groupBy("token").agg(F.min("only").alias("a"), F.max("only").alias("b"), F.count("only").alias("k"), F.count("*").alias("n"))
    apart = apart.where("n > 1 and (a <> b or k < n)").select("token")
    matrix = matrix.join(apart, "token", "left_semi")
    x, y = matrix.alias("x"), matrix.alias("y")
    fits = (F.col("x.high") * 100 >= F.col("y.low") * percent) & (F.col("y.high") * 100 >= F.col("x.low") * percent)
    other = F.coalesce(F.col("x.only") != F.col("y.only"), F.lit(True))
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.number") < F.col("y.number")) & other & fits)
    pairs = met.select(F.col("x.number").alias("a"), F.col("y.number").alias("b")).distinct()
    side = lambda s: groups.select(F.col("number").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("clusters", "sizes", "tokens")])
    opened = pairs.join(side("a"), "a").join(side("b"), "b").drop("a", "b")

    def bounded(mine: list[np.ndarray], union: np.ndarray) -> np.ndarray:
        """Places of the sets whose overlap with the other group's union reaches what a link needs."""
        n = np.array([len(x) for x in mine], dtype=np.int64)
        hit = np.isin(np.concatenate(mine), union)
        upper = _per_row(hit.astype(np.int64), np.concatenate([[0], np.cumsum(n)]))
        return np.flatnonzero(upper >= need_of(n, percent))

    def run(batches):
        for batch in batches:
            found_a, found_b = [], []
            for i in range(batch.num_rows):
                sets, clusters = [], []
                for s in ("a", "b"):
                    values = np.frombuffer(batch.column(f"{s}_tokens")[i].as_buffer(), dtype="<u8")
                    sets.append(np.split(values, np.cumsum(batch.column(f"{s}_sizes")[i].values.to_numpy())[:-1]))
                    clusters.append(batch.column(f"{s}_clusters")[i].values.to_numpy())
                a = bounded(sets[0], np.concatenate(sets[1]))
                b = bounded(sets[1], np.concatenate([sets[0][k] for k in a])) if len(a) else a
                if not len(b):
                    continue
                linked = links([sets[0][k] for k in a], [sets[1][k] for k in b], percent)
                ca, cb = clusters[0][a], clusters[1][b]
                u, v = np.nonzero(linked & (ca[:, None] != cb[None, :]))
                names, place = np.unique(np.concatenate([ca[u], cb[v]]), return_inverse=True)
                root = roots_of(len(names), place[: len(u)], place[len(u) :])
                moved = root != np.arange(len(names))
                found_a.append(names[moved])
                found_b.append(names[root[moved]])
            joined = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (found_a, found_b)]
            yield pa.RecordBatch.from_arrays(joined, names=["a", "b"])

    return opened.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document.

    A text's set holds its distinct runs of ``width`` words (A-Z lower-cased); with fewer words, its whole sequence.
    Documents link when ``100 * |intersection| >= percent * |union|``; ``component_id`` is the smallest id that links
    reach, the document's own included. Null and empty texts, and texts without words, have an empty set and link with
    nothing. A null id takes part in no link and has a null component. Rows with one id are one document: what any of
    them links to, the id links to. An empty table gives no rows.
    """
    spark = docs.sparkSession
    chunks = chunk_table(docs)
    size = chunks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    shards = max(1, -(-int(size) // SHARD_BYTES))
    rows = stage_table(set_table(chunks, width), "sets")
    usable = rows.where("n > 0 and doc_id is not null")
    distinct = usable.groupBy("h1", "h2", "n").agg(F.min(F.struct("doc_id", "chunk", "pos")).alias("r"))
    distinct = stage_table(distinct.select("h1", "h2", "n", F.col("r.doc_id").alias("node"), F.col("r.chunk").alias("chunk"), F.col("r.pos").alias("pos")), "distinct-sets")
    listed = distinct.groupBy("chunk").agg(F.collect_list(F.struct("pos", "node")).alias("l"))
    chosen = stage_table(listed.select("chunk", F.col("l.pos").alias("pos"), F.col("l.node").alias("nodes")), "chosen")
    answers = stage_table(rarities(chunks, chosen, shards, width), "rarities", compression="none")
    sets = stage_table(shared_sets(chunks, answers, chosen, shards, width, percent), "shared-sets")
    # Rows that share an id, but not a set, are joined through it.
    edges = usable.join(distinct.select("h1", "h2", "n", "node"), ["h1", "h2", "n"]).where("doc_id <> node").select(F.col("doc_id").alias("node"), F.col("node").alias("root"))
    twice = usable.groupBy("doc_id").agg(F.countDistinct("h1", "h2", "n").alias("k")).where("k > 1").select(F.col("doc_id").alias("node"))
    edges = edges.join(twice, "node", "left_semi")
    left = sets
    for key in (KEYS[0], *KEYS):
        moved = stage_table(link_round(left, key, percent), "round")
        edges = edges.unionByName(moved)
        left = left.join(moved.select("node"), "node", "left_anti")
    first = stage_table(components(edges, "node", "root"), "clusters")
    clustered = sets.join(first, "node", "left").withColumn("cluster", F.coalesce("root", "node")).drop("root")
    groups = group_table(clustered.select("node", "cluster", "n", KEYS[0], "tokens", "prefix"), KEYS[0])
    groups = stage_table(groups.withColumn("number", F.monotonically_increasing_id()), "groups")
    second = components(open_groups(groups, percent)).select(F.col("node").alias("root"), F.col("root").alias("top"))
    whole = first.join(second, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    lone = second.join(first.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))
    final = distinct.join(whole.unionByName(lone), "node", "left").select("h1", "h2", "n", F.coalesce("root", "node").alias("root"))
    named = rows.join(final, ["h1", "h2", "n"], "left")
    mine = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), mine.alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One document of each class of near-duplicates, the one with the smallest id, with the columns of ``docs``.

    Rows of that id are one document: each of its distinct texts stays once, in the row whose other columns
    as JSON come first. Rows with a null id are kept as they are; an empty table gives no rows.
    """
    found = near_duplicates(docs.select("doc_id", "text"), **options)
    stay = found.where("doc_id = component_id").select(F.col("doc_id").alias("__stay")).distinct()
    named = docs.join(stay, docs["doc_id"].cast("long") == F.col("__stay"), "left_semi")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(F.lit(0).alias("__"), *[named[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(others)])
    one = named.groupBy(named["doc_id"].alias("__id"), named["text"].alias("__text")).agg(F.min_by(rest, F.to_json(rest)).alias("__row"))
    back = {"doc_id": F.col("__id"), "text": F.col("__text"), **{c: F.col(f"__row.c{i}") for i, c in enumerate(others)}}
    named = one.select(*[back[c].alias(c) for c in docs.columns])
    return named.unionByName(docs.where(docs["doc_id"].isNull()))
