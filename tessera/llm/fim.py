"""Fill-in-middle transformation by a parallel automaton scan.

A text's units are its runs of ASCII letters and its other code points. An automaton of four states reads it, and counts
units and sentinels. A piece of a text is summed up without knowing what stands before it: for each state that it may
begin in, the state it ends in and its counts. Such summaries compose associatively, so pieces of one document are read in
any order by any task; composing them from the first on gives each piece its entry state and the units before it. A
cut at a given unit then lies in one piece, which finds it among its own units.

Texts of up to ``PIECE_BYTES`` are one piece and are read and written in place. Longer ones are written to the shared
folder in pieces that are dealt over the cluster, and meet again as one output row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, stage_table, texts_of
from .words import text_blocks

PIECE_BYTES = 1 << 20
BLOCK_BYTES = 1 << 20
#: Share of texts that are transformed, and of those the share with the suffix first, in percent.
FIM_SHARE, SUFFIX_FIRST = 90, 20
SENTINELS = ("<P>", "<S>", "<M>")

#: States: after no letter, in a run of letters, after ``<``, and after ``<`` with a sentinel's letter.
BREAK, RUN, OPENED, NAMED = range(4)
#: Kinds of code points: other, letter, sentinel's letter, ``<``, ``>``.
OTHER, LETTER, NAME, LESS, MORE = range(5)
KIND = np.zeros(256, np.uint8)
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
KIND[[ord(s[1]) for s in SENTINELS]] = NAME
KIND[60], KIND[62] = LESS, MORE
CONTINUES = (np.arange(256) & 0xC0) == 0x80
IS_LETTER = (KIND == LETTER) | (KIND == NAME)


def step(state: int, kind: int) -> tuple[int, int, int]:
    """The automaton: the next state, whether a unit begins, and whether a sentinel ends."""
    letter = kind in (LETTER, NAME)
    if kind == NAME and state == OPENED:
        after = NAMED
    else:
        after = RUN if letter else OPENED if kind == LESS else BREAK
    return after, int(not (letter and state in (RUN, NAMED))), int(kind == MORE and state == NAMED)


def run_from(state: int, kinds: list[int]) -> tuple[int, int, int]:
    units = marks = 0
    for kind in kinds:
        state, unit, mark = step(state, kind)
        units, marks = units + unit, marks + mark
    return state, units, marks


@dataclass
class Summary:
    """What a piece does, by the state that it begins in: the state it ends in, its units and its sentinels."""

    end: np.ndarray
    units: np.ndarray
    marks: np.ndarray

    def then(self, after: Summary) -> Summary:
        return Summary(after.end[self.end], self.units + after.units[self.end], self.marks + after.marks[self.end])


NOTHING = Summary(np.arange(4), np.zeros(4, np.int64), np.zeros(4, np.int64))


def unit_starts(data: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where units begin in texts that lie one after the other and begin at ``firsts``, in state ``BREAK``."""
    starts = ~CONTINUES[data]
    letter = IS_LETTER[data]
    starts[1:] &= ~(letter[1:] & letter[:-1])
    starts[firsts[firsts < len(data)]] = True
    return starts


def mark_places(data: np.ndarray) -> np.ndarray:
    """Where sentinels begin."""
    at = np.flatnonzero(data[:-2] == 60) if len(data) > 2 else np.zeros(0, np.int64)
    return at[(KIND[data[at + 1]] == NAME) & (data[at + 2] == 62)]


def summary(data: np.ndarray) -> Summary:
    """The summary of a piece that begins and ends between code points.

    After two code points the automaton's state is the same whatever it was before, so only the first two are read
    from every state.
    """
    if not len(data):
        return NOTHING
    kinds = KIND[data[:8][~CONTINUES[data[:8]]]].tolist()[:2]
    last = KIND[data[-8:][~CONTINUES[data[-8:]]]].tolist()[-2:]
    head = [run_from(s, kinds) for s in range(4)]
    units = int(np.count_nonzero(unit_starts(data, np.zeros(1, np.int64))))
    marks = len(mark_places(data))
    return Summary(
        np.array([run_from(s, last)[0] for s in range(4)]),
        np.array([units + u - head[BREAK][1] for _, u, _ in head], dtype=np.int64),
        np.array([marks + m - head[BREAK][2] for _, _, m in head], dtype=np.int64),
    )


def starts_from(data: np.ndarray, state: int) -> np.ndarray:
    """Byte offsets at which units begin in a piece that begins in ``state``."""
    starts = unit_starts(data, np.zeros(1, np.int64))
    if len(data) and state in (RUN, NAMED) and IS_LETTER[data[0]]:
        starts[0] = False
    return np.flatnonzero(starts)


def form_of(empty: bool, marks: int, h3: int, h4: int) -> str:
    if empty or marks or h3 % 100 >= FIM_SHARE:
        return "plain"
    return "spm" if h4 % 100 < SUFFIX_FIRST else "psm"


def cuts_of(n: int, h1: int, h2: int) -> tuple[int, int]:
    """Units before the middle and before the suffix."""
    a, b = h1 % (n + 1), h2 % (n + 1)
    return min(a, b), max(a, b)


def layout(form: str) -> list[tuple[str, int]]:
    """Sentinels, and which of prefix, middle and suffix stands after each."""
    p, s, m = SENTINELS
    return [(p, 0), (s, 2), (m, 1)] if form == "psm" else [(s, 2), (p, 0), (m, 1)]


HASHES = ["h1", "h2", "h3", "h4"]
OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def with_hashes(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and four numbers drawn from the id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(h) for k, h in enumerate(HASHES)]
    return texts_of(docs).select("doc_id", "text", *numbers)


def transform_block(data: np.ndarray, offsets: np.ndarray, hashes: list[tuple[int, int, int, int]]) -> tuple[list, ...]:
    """Units, form, lengths and output of whole texts."""
    firsts, ends = offsets[:-1], offsets[1:]
    starts = unit_starts(data, firsts)
    at = np.flatnonzero(starts)
    begin = np.searchsorted(at, offsets)
    marks = mark_places(data)
    holder = np.searchsorted(offsets, marks, side="right") - 1
    holder = holder[marks + 3 <= offsets[holder + 1]]
    marked = np.bincount(holder, minlength=len(firsts))
    points = np.concatenate([[0], np.cumsum(~CONTINUES[data], dtype=np.int64)])
    raw = data.tobytes()
    units, forms, prefixes, middles, outputs = [], [], [], [], []
    for i, (h1, h2, h3, h4) in enumerate(hashes):
        n = int(begin[i + 1] - begin[i])
        form = form_of(n == 0, int(marked[i]), h3, h4)
        units.append(n)
        forms.append(form)
        if form == "plain":
            prefixes.append(None)
            middles.append(None)
            outputs.append(raw[firsts[i] : ends[i]])
            continue
        a, b = (int(at[begin[i] + c]) if c < n else int(ends[i]) for c in cuts_of(n, h1, h2))
        prefixes.append(int(points[a] - points[firsts[i]]))
        middles.append(int(points[b] - points[a]))
        segment = (raw[firsts[i] : a], raw[a:b], raw[b : ends[i]])
        outputs.append(b"".join(x for mark, k in layout(form) for x in (mark.encode(), segment[k])))
    return units, forms, prefixes, middles, outputs


def transform_short(rows: DataFrame) -> DataFrame:
    """Texts of one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_blocks(batch.column("text"), BLOCK_BYTES):
                some = batch.slice(row, end - row)
                hashes = list(zip(*(some.column(h).to_pylist() for h in HASHES)))
                units, forms, prefixes, middles, outputs = transform_block(data, offsets, hashes)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("doc_id"), pa.array(units, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()),
                        pa.array(middles, pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string()),
                    ],
                    names=[x.split(" ")[0] for x in OUT.split(", ")],
                )

    return rows.mapInArrow(run, OUT)


PIECES = "doc long, no int, doc_id long, h1 long, h2 long, h3 long, h4 long, piece string"


def pieces_of(rows: DataFrame, piece_bytes: int) -> DataFrame:
    """A written table of pieces, cut between code points and dealt over the cluster; ``doc`` numbers the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc = TaskContext.get().partitionId() << 32
        for batch in batches:
            for row, _, data, _ in text_blocks(batch.column("text"), 1):
                own = [batch.column(c)[row].as_py() for c in ("doc_id", *HASHES)]
                at = no = 0
                while at < len(data):
                    end = min(at + piece_bytes, len(data))
                    while end < len(data) and CONTINUES[data[end]]:
                        end += 1
                    values = [doc, no, *own, data[at:end].tobytes().decode()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)
                    at, no = end, no + 1
                doc += 1

    schema = pa.schema([("doc", pa.int64()), ("no", pa.int32()), *((c, pa.int64()) for c in ("doc_id", *HASHES)), ("piece", pa.string())])
    cut = rows.mapInArrow(run, PIECES)
    # A text's pieces lie in one task's output; they are dealt out before anything is computed from them.
    return stage_table(cut.repartition("doc", "no"), "pieces")


SUMMARIES = "doc long, no int, doc_id long, h1 long, h2 long, h3 long, h4 long, end array<int>, units array<long>, marks array<long>"
PLANS = "doc long, no int, doc_id long, n long, form string, state int, first long, second long"


def summaries_of(pieces: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [summary(data) for _, _, data, _ in text_blocks(batch.column("piece"), 1)]
            columns = [batch.column(c) for c in ("doc", "no", "doc_id", *HASHES)]
            columns += [pa.array([s.end.tolist() for s in found], pa.list_(pa.int32()))]
            columns += [pa.array([getattr(s, c).tolist() for s in found], pa.list_(pa.int64())) for c in ("units", "marks")]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split(" ")[0] for x in SUMMARIES.split(", ")])

    return pieces.mapInArrow(run, SUMMARIES)


def plan_cuts(table: pa.Table) -> pa.Table:
    """Of one document's summaries: each piece's entry state, and the numbers of its own units at which the cuts would be.

    A document has no more pieces than a row has room for.
    """
    rows = table.sort_by("no").to_pylist()
    before = [NOTHING]
    for r in rows:
        before.append(before[-1].then(Summary(*(np.array(r[c], np.int64) for c in ("end", "units", "marks")))))
    n, marks = int(before[-1].units[BREAK]), int(before[-1].marks[BREAK])
    first = rows[0]
    form = form_of(n == 0, marks, first["h3"], first["h4"])
    a, b = cuts_of(n, first["h1"], first["h2"])
    out = [(r["doc"], r["no"], r["doc_id"], n, form, int(s.end[BREAK]), a - int(s.units[BREAK]), b - int(s.units[BREAK])) for r, s in zip(rows, before)]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[x.split(" ")[0] for x in PLANS.split(", ")])


SEGMENTS = "doc long, doc_id long, n long, form string, place int, no int, segment int, chars long, piece string"


def segments_of(planned: DataFrame) -> DataFrame:
    """Each piece cut into what belongs to prefix, middle and suffix; ``place`` and ``no`` are the order in the output."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()]

    def of(row: dict, data: np.ndarray) -> Iterator[tuple]:
        head = (row["doc"], row["doc_id"], row["n"], row["form"])
        if row["form"] == "plain":
            yield (*head, 0, row["no"], -1, 0, data.tobytes().decode())
            return
        starts = starts_from(data, row["state"])
        a, b = (0 if k < 0 else int(starts[k]) if k < len(starts) else len(data) for k in (row["first"], row["second"]))
        cut = (data[:a], data[a:b], data[b:])
        for place, (mark, segment) in enumerate(layout(row["form"])):
            if row["no"] == 0:
                yield (*head, place, -1, -1, 0, mark)
            if len(cut[segment]):
                yield (*head, place, row["no"], segment, int(np.count_nonzero(~CONTINUES[cut[segment]])), cut[segment].tobytes().decode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = batch.drop_columns(["piece"]).to_pylist()
            for row, _, data, _ in text_blocks(batch.column("piece"), 1):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*of(plain[row], data)), kinds)], names=[x.split(" ")[0] for x in SEGMENTS.split(", ")])

    return planned.mapInArrow(run, SEGMENTS)


def transform_long(rows: DataFrame, piece_bytes: int) -> DataFrame:
    """Texts of several pieces."""
    pieces = pieces_of(rows, piece_bytes)
    plans = summaries_of(pieces).groupBy("doc").applyInArrow(plan_cuts, PLANS)
    planned = pieces.select("doc", "no", "piece").join(plans, ["doc", "no"])
    parts = F.transform(F.sort_array(F.collect_list(F.struct("place", "no", "piece"))), lambda x: x["piece"])
    chars = lambda k: F.when(F.first("form") != "plain", F.coalesce(F.sum(F.when(F.col("segment") == k, F.col("chars"))), F.lit(0)))
    whole = segments_of(planned).groupBy("doc").agg(
        F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("form").alias("form"),
        chars(0).alias("prefix_chars"), chars(1).alias("middle_chars"), F.array_join(parts, "").alias("output"),
    )
    return whole.drop("doc")


def fill_in_middle(docs: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every document.

    ``n`` counts units. The form is ``plain`` (the text as it is) for an empty text, one that contains a sentinel, and a
    tenth of all others, by the id; else ``psm`` or ``spm``, with the cuts drawn from the id. Null texts are empty; a null
    id draws as an empty one does; rows with equal ids are cut alike, each for itself; an empty table gives no rows. Only
    ``doc_id`` and ``text`` are read. The output of a long text is one row, as the text was.
    """
    bound_batches(docs.sparkSession)
    rows = with_hashes(docs)
    size = F.octet_length("text")
    return transform_short(rows.where(size <= piece_bytes)).unionByName(transform_long(rows.where(size > piece_bytes), piece_bytes))


def restored(output: F.Column, form: F.Column) -> F.Column:
    """The text of an output."""
    parts = F.split(output, "<[PSM]>")
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def fim_report(docs: DataFrame) -> DataFrame:
    """Lengths, and digests of each output and of the text that is rebuilt from it."""
    out = fill_in_middle(docs)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


def oracle_sql() -> str:
    """The same report in DuckDB SQL; the text itself stands for the rebuilt one."""
    number = lambda k: f"('0x' || substr(digest, {8 * k + 1}, 8))::BIGINT"
    piece = lambda a, b: f"array_to_string(list_slice(units, {a} + 1, {b}), '')"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id::VARCHAR) AS digest FROM documents),
cut AS (
  SELECT doc_id, text, {number(0)} AS h1, {number(1)} AS h2, {number(2)} AS h3, {number(3)} AS h4,
    regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units FROM docs),
sized AS (
  SELECT *, len(units)::BIGINT AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {FIM_SHARE} THEN 'plain'
      WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (SELECT *, {piece("0", "a")} AS prefix, {piece("a", "b")} AS middle, {piece("b", "n")} AS suffix FROM sized)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
