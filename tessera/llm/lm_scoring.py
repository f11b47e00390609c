"""Language-model scoring by an Elias-Fano n-gram trie that is sharded over the cluster.

A trigram model. Chunks of documents send each shard the distinct n-grams of its contexts, with their training counts;
the shard adds the counts, smooths them, writes the quantised probabilities and context weights into the levels of its
trie, maps that file into memory, looks up every n-gram it was asked for, and answers chunk by chunk. The chunks then
score their documents. All successors of a context lie in one shard, so a look-up is a search within the context's
range of successors. A context that holds more than a shard's share of all tokens is split by its successors over
several shards (:func:`heavy_contexts`), so no context gathers in one task.

Smoothing is interpolation after Witten and Bell: a context ``h`` with ``c`` training tokens and ``t`` distinct
successors gives ``d(w | h) = c(h, w) / (c + t)``, and ``p(w | h) = d(w | h) + b(h) p(w | h')`` with ``h'`` the context
without its first word; below is the base probability of single words, whose counts are exact. ``d`` is kept in 8
bits, rounded down, and ``b(h) = 1 - sum of the rounded d(w | h)`` in 16 bits, rounded down. So every probability is
at most 1, and a context's probabilities sum to 1 less at most 0.06 % of ``b(h)``. The parts of a split context are
put together by their exact sizes.

Words are told apart by 63-bit hashes where they are counted and as first words, and by 52 bits of these as successors of a
context, so a word that was never seen is taken for another with a chance of the context's successors in 2**52. A chunk and a
shard number words by their places among those hashes. A bigram is the place of its first word (its root) and of its second, and
a trigram's context is the place of its bigram, so a trigram goes to its first word's shard.

There is a row for each chunk and shard. Both grow with the input until a row holds one n-gram, so there are never more
rows than there are distinct n-grams in all chunks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import chunk_blocks, chunk_table, open_chunk
from .common import parts_for, stage_table
from .elias_fano import build_trie, dequantise, dequantise_weight, mapped_trie, quantise, quantise_weight
from .number_planes import pack_keys, pack_small, unpack_keys, unpack_small
from .words import combine, lower_ascii, mix, word_hashes, word_spans

#: UTF-8 bytes of text for which there is one shard.
SHARD_BYTES = 8 << 20
#: One chunk in so many is read to find heavy contexts; all are while there are fewer than that many.
HEAVY_SAMPLE = 16
START, END = np.uint64(0x0DC39AC9E64F16A8), np.uint64(0x1C59A572D0F1C5C9)
ORDERS = (2, 3)
#: Bits that a successor's hash loses on its way to a shard.
SHORTER = np.uint64(11)
_ONE, _PLACE = np.uint64(1), np.uint64(32)
_LOW = np.uint64((1 << 32) - 1)

ASKED = "shard int, chunk long, words binary, word_counts binary, roots binary, vocabulary binary, keys2 binary, counts2 binary, fan3 binary, keys3 binary, counts3 binary"
ANSWERED = (
    "shard int, chunk long, counts binary, values2 binary, weights2 binary, values3 binary, weights3 binary, tokens long, distinct_words long, "
    "part_order array<int>, part_key array<long>, part_mass array<double>, part_weight array<double>"
)


@dataclass
class Heavy:
    """Hashes of the contexts that are split, ascending, and into how many parts each."""

    contexts: np.ndarray
    parts: np.ndarray

    def __post_init__(self):
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.contexts & np.uint64(0xFFFF)).astype(np.int64)] = True

    def find(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``context`` of the heavy ones, and which each is."""
        near = np.flatnonzero(self.maybe[(context & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.contexts, context[near]), max(len(self.contexts) - 1, 0))
        hit = self.contexts[at] == context[near] if len(self.contexts) else np.zeros(len(near), bool)
        return near[hit], at[hit]

    def part_of(self, which: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The number, among all parts, of the part that holds these successors of heavy contexts."""
        first = np.cumsum(self.parts) - self.parts
        return first[which] + (mix(words ^ START) % self.parts[which].astype(np.uint64)).astype(np.int64)

    def part_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each part, and which context it belongs to."""
        of = np.repeat(np.arange(len(self.parts)), self.parts)
        number = np.arange(len(of)) - np.repeat(np.cumsum(self.parts) - self.parts, self.parts)
        return mix(self.contexts[of] + (number + 1).astype(np.uint64)), of


NO_HEAVY = Heavy(np.zeros(0, np.uint64), np.zeros(0, np.int64))


class ChunkTokens:
    """Tokens of a chunk (63-bit hashes) with the hashes of the contexts before them."""

    def __init__(self, ids: pa.Array, data: np.ndarray, offsets: np.ndarray):
        hashes, counts = [], []
        for _, _, part, edges in chunk_blocks(data, offsets):
            low = lower_ascii(part)
            starts, ends, n = word_spans(low, edges)
            stops = np.cumsum(n)
            hashes.append(np.insert(word_hashes(low, starts, ends) >> _ONE, stops, END))
            counts.append(n + 1)
        self.tokens = np.concatenate(hashes)
        self.n_tokens = np.concatenate(counts)
        self.held_out = np.array([zlib.crc32(str(i).encode()) % 10 == 0 for i in ids.to_pylist()], dtype=bool)
        self.training = np.repeat(~self.held_out, self.n_tokens)
        self.first = np.cumsum(self.n_tokens) - self.n_tokens

    def before(self, values: np.ndarray, start) -> np.ndarray:
        """What stands before each token in its document."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.first] = start
        return out

    def contexts(self) -> dict[int, np.ndarray]:
        """Hashes of the one and the two words before each token."""
        one = self.before(self.tokens, START)
        return {2: mix(one), 3: combine(mix(self.before(one, START) ^ END), one)}


class Grams:
    """A chunk's n-grams by places: ``words`` and ``roots`` are ascending hashes, ``pairs`` are ``root place << 32 | word place``
    and ``triples`` are ``pair place << 32 | word place``, ascending and distinct; ``word``, ``pair``, ``context`` and
    ``triple`` say which of them each token has.

    A root is a first word, or a part of a heavy context; ``split`` has, by order, the tokens whose context is heavy,
    which context it is, and the number of the part.
    """

    def __init__(self, c: ChunkTokens, heavy: Heavy):
        n = len(c.tokens)
        self.words, word = ranks(np.append(c.tokens, START))
        start = word[-1]
        self.word = word = word[:-1]
        one = c.before(word, start)
        two = c.before(one, start)
        parts, _ = heavy.part_hashes()
        hashes = np.concatenate([mix(self.words), parts]) >> _ONE
        order = np.argsort(hashes)
        self.roots = hashes[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))

        at, which = heavy.find(mix(self.words))
        of_word = np.full(len(self.words), -1, np.int64)
        of_word[at] = which

        def roots_of(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            root, heavy_first = first.copy(), of_word[first]
            at = np.flatnonzero(heavy_first >= 0)
            part = heavy.part_of(heavy_first[at], self.words[second[at]])
            root[at] = len(self.words) + part
            return root, at, heavy_first[at], part

        root, *split2 = roots_of(one, word)
        at3, which3 = heavy.find(c.contexts()[3]) if len(heavy.contexts) else (np.zeros(0, np.int64),) * 2
        part3 = heavy.part_of(which3, c.tokens[at3])
        self.split = {2: split2, 3: (at3, which3, part3)}
        # A context is the pair before, but at the beginning of a text and where it is split by its successors.
        own = np.concatenate([c.first, at3])
        own_root, *_ = roots_of(two[own], one[own])
        own_root[len(c.first) :] = len(self.words) + part3
        keys = np.concatenate([rank[root] << 32 | word, rank[own_root] << 32 | one[own]]).astype(np.uint64)
        self.pairs, place = ranks(keys)
        self.pair = place[:n]
        self.context = c.before(self.pair, 0)
        self.context[own] = place[n:]
        self.triples, self.triple = ranks((self.context << 32 | word).astype(np.uint64))


def ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and which of them each is."""
    order = np.argsort(keys)
    ordered = keys[order]
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(fresh) - 1
    return ordered[fresh], place


def shard_edges(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's hashes begin among ascending 63-bit ones: shards take even ranges of them."""
    edge = [(s << 63) // shards for s in range(1, shards)]
    return np.concatenate([[0], np.searchsorted(hashes, np.array(edge, dtype=np.uint64)), [len(hashes)]]).astype(np.int64)


def contexts_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct context begins among ascending keys, and the place of each key's context among them."""
    context = keys >> _PLACE
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = context[1:] != context[:-1]
    return np.flatnonzero(fresh), np.cumsum(fresh) - 1


def split_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two places of keys."""
    return (keys >> _PLACE).astype(np.int64), (keys & _LOW).astype(np.int64)


def joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first.astype(np.uint64) << _PLACE | second.astype(np.uint64)


def heavy_contexts(chunks: DataFrame, shards: int) -> Heavy:
    """Contexts with more than a shard's share of the tokens of a sample of chunks.

    This settles where n-grams go, not how they are scored. A chunk reports contexts with half of that share at
    least, so reports, and the parts of all contexts together, have a bound of a few times the number of shards.
    """
    sample = chunks.where(F.pmod(F.xxhash64("chunk"), F.lit(HEAVY_SAMPLE)) == 0) if chunks.count() >= 4 * HEAVY_SAMPLE else chunks

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                _, ids, data, offsets = open_chunk(batch, i)
                for context in ChunkTokens(ids, data, offsets).contexts().values():
                    ordered = np.sort(context)
                    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
                    n = np.diff(np.append(first, len(ordered)))
                    big = n * 2 * shards >= len(ordered)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ordered[first][big].view(np.int64)), pa.array(n[big].astype(np.int64)), pa.array(np.where(np.arange(big.sum()) == 0, len(ordered), 0))],
                        names=["context", "n", "tokens"],
                    )

    if shards == 1:
        return NO_HEAVY
    found = stage_table(sample.mapInArrow(run, "context long, n long, tokens long"), "heavy")
    total = (found.agg(F.sum("tokens")).first()[0] or 0) / len(ORDERS)
    rows = found.groupBy("context").agg(F.sum("n").alias("n")).where(F.col("n") * shards >= F.lit(float(total))).toArrow()
    contexts = rows.column("context").to_numpy().view(np.uint64)
    parts = np.ceil(2 * rows.column("n").to_numpy() * shards / max(total, 1)).astype(np.int64)
    order = np.argsort(contexts)
    return Heavy(contexts[order], parts[order])


def ask(chunks: DataFrame, shards: int, heavy: Heavy) -> DataFrame:
    """What each chunk asks of each shard."""
    shared = chunks.sparkSession.sparkContext.broadcast(heavy)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                number, ids, data, offsets = open_chunk(batch, i)
                c = ChunkTokens(ids, data, offsets)
                g = Grams(c, shared.value)
                yield pa.RecordBatch.from_pylist([{"chunk": number, **row} for row in questions(c, g, shards)], schema=schema)

    names = [x.split(" ") for x in ASKED.split(", ")]
    schema = pa.schema([(n, {"int": pa.int32(), "long": pa.int64()}.get(t, pa.binary())) for n, t in names])
    return chunks.mapInArrow(run, ASKED)


def questions(c: ChunkTokens, g: Grams, shards: int) -> Iterator[dict]:
    """What a chunk asks of each shard: words by their own hashes, pairs and triples by their roots'."""
    training = c.training.astype(np.float64)
    counts1, counts2, counts3 = (
        np.bincount(place, weights=training, minlength=len(table)).astype(np.int64) for place, table in ((g.word, g.words), (g.pair, g.pairs), (g.triple, g.triples))
    )
    at1, at_root = shard_edges(g.words, shards), shard_edges(g.roots, shards)
    at2 = np.searchsorted(g.pairs, at_root.astype(np.uint64) << _PLACE)
    at3 = np.searchsorted(g.triples, at2.astype(np.uint64) << _PLACE)
    some = (np.diff(at1) > 0) | (np.diff(at2) > 0)
    for s in np.flatnonzero(some).tolist():
        a, b = at2[s], at2[s + 1]
        root, second = split_keys(g.pairs[a:b])
        pair, third = split_keys(g.triples[at3[s] : at3[s + 1]])
        roots, root = np.unique(root, return_inverse=True)
        words, place = np.unique(np.concatenate([second, third]), return_inverse=True)
        yield {
            "shard": s,
            "words": pack_keys(g.words[at1[s] : at1[s + 1]]), "word_counts": pack_small(counts1[at1[s] : at1[s + 1]], "<u8"),
            "roots": pack_keys(g.roots[roots]), "vocabulary": pack_keys(g.words[words] >> SHORTER),
            "keys2": pack_keys(joined(root, place[: b - a])), "counts2": pack_small(counts2[a:b], "<u8"),
            "fan3": pack_small(np.bincount(pair - a, minlength=b - a), "<u4"), "keys3": pack_small(place[b - a :], "<u4"), "counts3": pack_small(counts3[at3[s] : at3[s + 1]], "<u8"),
        }


def smoothed(counts: np.ndarray, first: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the probabilities of seen n-grams, codes of their contexts' weights, and the size of each context.

    ``first`` says where each context begins, ``of`` which context an n-gram has.
    """
    distinct = np.diff(np.append(first, len(counts)))
    mass = (np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)) + distinct
    values = quantise(counts / mass[of])
    kept = np.add.reduceat(dequantise(values), first) if len(first) else np.zeros(0)
    return values, quantise_weight(1.0 - kept), mass.astype(np.float64)


def _stacked(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Distinct values of all lists, ascending, the place of each value, and where each list begins."""
    return *ranks(np.concatenate(lists)), np.cumsum([0] + [len(x) for x in lists]).tolist()


def _totals(table: pa.Table, name: str, place: np.ndarray, n: int) -> np.ndarray:
    """Counts of all chunks added up, in whole numbers."""
    out = np.zeros(n, np.int64)
    np.add.at(out, place, np.concatenate([unpack_small(x.as_py(), "<u8") for x in table.column(name)]).astype(np.int64))
    return out


def shard_answers(table: pa.Table, heavy: Heavy) -> pa.Table:
    """One shard: build its trie from all chunks' counts, and answer each chunk in the order it asked."""
    n = table.num_rows
    out: dict[str, pa.Array] = {"shard": table.column("shard"), "chunk": table.column("chunk")}
    said = lambda values, at, kind: pa.array([pack_small(values[a:b], kind) for a, b in zip(at, at[1:])], pa.binary())
    lists = {c: [unpack_keys(x.as_py()) for x in table.column(c)] for c in ("words", "roots", "vocabulary", "keys2")}

    words, place, at = _stacked(lists["words"])
    total = _totals(table, "word_counts", place, len(words))
    tokens, distinct = [0] * n, [0] * n
    tokens[0], distinct[0] = int(total.sum()), int((total > 0).sum())
    out["counts"] = said(total[place], at, "<u8")

    # Chunks' places become the shard's: of roots and words, then of pairs, then of triples.
    roots, root_place, root_at = _stacked(lists["roots"])
    words, word_place, word_at = _stacked(lists["vocabulary"])
    keys = []
    for i, x in enumerate(lists["keys2"]):
        first, second = split_keys(x)
        keys.append(joined(root_place[root_at[i] + first], word_place[word_at[i] + second]))
    pairs, pair_place, pair_at = _stacked(keys)
    keys = []
    for i, (fan, x) in enumerate(zip(table.column("fan3"), table.column("keys3"))):
        first, second = pair_place[pair_at[i] : pair_at[i + 1]], unpack_small(x.as_py(), "<u4").astype(np.int64)
        keys.append(joined(np.repeat(first, unpack_small(fan.as_py(), "<u4")), word_place[word_at[i] + second]))
    triples, triple_place, triple_at = _stacked(keys)
    del keys, lists
    counts2, counts3 = _totals(table, "counts2", pair_place, len(pairs)), _totals(table, "counts3", triple_place, len(triples))

    # The trie holds what training text has: triples, the pairs before them, and other pairs that were counted.
    pairs, triples = split_keys(pairs), split_keys(triples)
    held3 = np.flatnonzero(counts3)
    mask2 = counts2 > 0
    mask2[triples[0][held3]] = True
    held2 = np.flatnonzero(mask2)
    root_ids, root_of = np.unique(pairs[0][held2], return_inverse=True)
    word_ids = np.unique(np.concatenate([pairs[1][held2], triples[1][held3]]))
    word_of = lambda w: np.searchsorted(word_ids, w)
    pair_of = np.searchsorted(held2, triples[0][held3])

    counted = counts2[held2] > 0
    of2 = root_of[counted]
    begin2 = np.flatnonzero(np.diff(of2, prepend=-1))
    codes, weight, mass2 = smoothed(counts2[held2][counted], begin2, np.cumsum(np.diff(of2, prepend=-1) != 0) - 1)
    values2, weights2 = np.zeros(len(held2), np.uint8), np.zeros(len(root_ids), np.uint16)
    values2[counted], weights2[of2[begin2]] = codes, weight
    begin3 = np.flatnonzero(np.diff(pair_of, prepend=-1))
    values3, weight, mass3 = smoothed(counts3[held3], begin3, np.cumsum(np.diff(pair_of, prepend=-1) != 0) - 1)
    weights3 = np.zeros(len(held2), np.uint16)
    weights3[pair_of[begin3]] = weight
    trie = mapped_trie(build_trie(roots[root_ids], words[word_ids], (root_of, word_of(pairs[1][held2])), values2, weights2, (pair_of, word_of(triples[1][held3])), values3, weights3))
    w2, v2, w3, v3 = trie.look_up(roots, words, pairs, triples)
    out["weights2"], out["values2"] = said(w2[root_place], root_at, "<u2"), said(v2[pair_place], pair_at, "u1")
    out["weights3"], out["values3"] = said(w3[pair_place], pair_at, "<u2"), said(v3[triple_place], triple_at, "u1")

    parts: list[tuple[int, int, float, float]] = []
    if len(heavy.contexts):
        # A root that is a part of a one-word context has counted pairs; a part of a two-word one has its pair as a context.
        hashes = heavy.part_hashes()[0] >> _ONE
        is_part = np.isin(roots[root_ids], hashes)
        for order, root, mass, weight in ((2, of2[begin2], mass2, weights2[of2[begin2]]), (3, root_of[pair_of[begin3]], mass3, weights3[pair_of[begin3]])):
            keep = is_part[root] if order == 2 else is_part[root] & ~np.isin(root, of2)
            parts += [(order, int(roots[root_ids[r]]), float(m), float(dequantise_weight(w))) for r, m, w in zip(root[keep], mass[keep], weight[keep])]
    out["tokens"], out["distinct_words"] = pa.array(tokens, pa.int64()), pa.array(distinct, pa.int64())
    kinds = {"part_order": pa.int32(), "part_key": pa.int64(), "part_mass": pa.float64(), "part_weight": pa.float64()}
    for (name, kind), column in zip(kinds.items(), list(zip(*parts)) or [()] * 4):
        out[name] = pa.array([list(column)] + [[]] * (n - 1), pa.list_(kind))
    return pa.table({x.split(" ")[0]: out[x.split(" ")[0]] for x in ANSWERED.split(", ")})


@dataclass
class Parts:
    """What the parts of heavy contexts have in common: each part's share of its context, and the context's weight."""

    share: dict[int, np.ndarray]
    weight: dict[int, np.ndarray]


def joined_parts(heavy: Heavy, rows: list[tuple[int, int, float, float]]) -> Parts:
    """Shares and weights by order and part, in the order of :meth:`Heavy.part_hashes`; parts not reported were not seen."""
    hashes, of = heavy.part_hashes()
    share, weight = {}, {}
    for order in ORDERS:
        known = {key: (mass, w) for o, key, mass, w in rows if o == order}
        found = [known.get(k, (0.0, 1.0)) for k in (hashes >> _ONE).tolist()]
        mass, w = (np.array(x, dtype=np.float64) for x in (zip(*found) if found else ((), ())))
        whole = np.bincount(of, weights=mass, minlength=len(heavy.contexts))
        share[order] = mass / np.maximum(whole, 1e-300)[of]
        mixed = np.bincount(of, weights=mass * w, minlength=len(heavy.contexts)) / np.maximum(whole, 1e-300)
        weight[order] = np.where(whole > 0, mixed, 1.0)
    return Parts(share, weight)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score_chunk(chunk: pa.Table, answers: pa.Table, total: int, vocabulary: int, heavy: Heavy, parts: Parts) -> pa.Table:
    _, ids, data, offsets = open_chunk(chunk)
    c = ChunkTokens(ids, data, offsets)
    answers = answers.sort_by("shard")

    def said(name: str, kind: str) -> np.ndarray:
        return np.concatenate([unpack_small(x.as_py(), kind) for x in answers.column(name)])

    g = Grams(c, heavy)
    count = said("counts", "<u8").astype(np.float64)[g.word]
    base = (count + 0.1) / (total + 0.1 * (vocabulary + 1))
    p = base
    _, root = contexts_of(g.pairs)
    for order, place, context in ((2, g.pair, root[g.pair]), (3, g.triple, g.context)):
        d = dequantise(said(f"values{order}", "u1"))[place]
        b = dequantise_weight(said(f"weights{order}", "<u2"))[context]
        at, which, part = g.split[order]
        if len(at):
            d[at] *= parts.share[order][part]
            b[at] = parts.weight[order][which]
        p = d + b * p
    stops = np.cumsum(c.n_tokens) - c.n_tokens

    def per_doc(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, stops)

    columns = [
        ids, pa.array(c.held_out), pa.array(c.n_tokens.astype(np.int64)), pa.array(per_doc((count > 0).astype(np.int64))),
        pa.array(per_doc(np.log10(base))), pa.array(per_doc(np.log10(p))),
    ]
    return pa.table(dict(zip([x.split(" ")[0] for x in SCORED.split(", ")], columns)))


def lm_scores(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document.

    Documents whose ``crc32(doc_id as text) mod 10`` is 0 are held out; the model learns from all others. Null
    texts are empty and have the end token alone; a null id counts as the text ``None``; repeated rows are
    rows of their own; an empty table gives no rows. Only ``doc_id`` and ``text`` are read.
    """
    spark = docs.sparkSession
    chunks = chunk_table(docs)
    size = chunks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    shards = max(1, -(-int(size) // shard_bytes))
    heavy = heavy_contexts(chunks, shards)
    shared = spark.sparkContext.broadcast(heavy)
    asked = ask(chunks, shards, heavy).repartition(parts_for(spark, shards, 1), "shard")
    answers = asked.groupBy("shard").applyInArrow(lambda table: shard_answers(table, shared.value), ANSWERED)
    answers = stage_table(answers, "answers", compression="none")
    total, vocabulary = (int(x or 0) for x in answers.agg(F.sum("tokens"), F.sum("distinct_words")).first())
    each = answers.where(F.size("part_key") > 0).select(F.explode(F.arrays_zip("part_order", "part_key", "part_mass", "part_weight")).alias("p"))
    parts = spark.sparkContext.broadcast(joined_parts(heavy, [tuple(r) for r in each.select("p.*").collect()]))

    def score(key, chunk, mine):
        return _score_chunk(chunk, mine, total, vocabulary, shared.value, parts.value)

    slim = answers.select("shard", "chunk", "counts", "values2", "weights2", "values3", "weights3")
    scored = chunks.groupBy("chunk").cogroup(slim.groupBy("chunk")).applyInArrow(score, SCORED)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
