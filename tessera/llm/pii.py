"""Personal data by candidate generation, boosted trees and calibrated thresholds, all in SQL functions.

High-recall patterns propose spans that may overlap. Spans of the base rules (see :data:`BASE`) always count. The
other candidates are scored by gradient boosted trees over format and context features. The trees are fitted by
Spark on candidates of a bounded sample of documents, into each of which one made-up string is written at a place
between words: personal data in a form that the base rules miss (:data:`PLANTED`), or a string that only looks like
it (:data:`DECOYS`). A candidate that is the string is true or false by what was written there, not by its pattern.
Of the others, base matches are labelled by the base check, and wide ones are false where normalising them gives
nothing of their kind (:func:`becomes`); wide ones of which that is unclear, and those inside a base span, train
nothing. The features leave out what decides the base verdicts (the plus sign and its country's code, the check digit,
the range of an address part). Held-out documents calibrate the scores, and each kind's threshold is the lowest score
whose calibrated precision reaches ``precision``. The fitted trees are turned into SQL expressions, so scoring stays in
one narrow stage.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
# A match starts where no earlier start could have matched: \G is where the match before ended. Possessive
# quantifiers keep the matcher from going back; they change no match, as no later part could use what they took.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidates beyond the base patterns: kind, pattern, and what a text must hold to be searched at all.
WIDER = (
    (
        "email",
        r"(?i)\b[a-z0-9._%+-]{1,64}\x20?(?:\[at\]|\(at\)|\x20at\x20|@)\x20?[a-z0-9-]{1,63}(?:\x20?(?:\[dot\]|\(dot\)|\x20dot\x20|\.)\x20?[a-z0-9-]{1,63}){1,8}",
        r"(?i)[\[(\x20](?:at|dot)[\])\x20]",
    ),
    ("phone", r"(?<![0-9+])\(?[0-9]{2,4}\)?[\x20.-][0-9(][\x20().0-9-]{4,20}[0-9]", r"[0-9][)\x20.-]"),
)
# What is written into sampled documents. `D` stands for a digit, `N` for a name, `H` for a host's name; the span is what
# stands between the brackets ⟦ and ⟧.
PLANTED = {
    "email": (
        "write to ⟦N [at] H [dot] org⟧", "mail ⟦N(at)H(dot)net⟧", "contact ⟦N at H dot com⟧", "⟦N [at] H.com⟧", "reach ⟦N.N (at) H.co [dot] uk⟧", "address: ⟦N @ H . org⟧",
    ),
    "phone": (
        "call ⟦(DDD) DDD-DDDD⟧", "phone: ⟦DDD-DDD-DDDD⟧", "tel ⟦DDD.DDD.DDDD⟧", "⟦(DDD) DDD-DDDD⟧", "mobile ⟦0DDD DDD DDDD⟧", "reach me at ⟦DDD DDD DDDD⟧", "fax ⟦(0DD) DDDD DDDD⟧",
    ),
}
DECOYS = {
    "email": ("they look at home dot dot and rest", "back [at] noon.then out", "(at) dawn . dusk came", "at H dot matrix prints"),
    "phone": (
        "on 20DD-0D-1D DD it was", "order id DDD DDD DDDD", "ref DDDD-DDDD-DDDD", "isbn 978-D-DD-DDDDDD-D", "host 9DD.DD.DD.DD fell", "lines DDD-DDD of DDDD",
        "version DD.DDDD.DDDD.D", "in 19DD-19DD and 20DD-20DD", "item no DDD-DDD-DDDD", "0.DDDDDD 0.DDDDDD",
    ),
}
NAMES = ("ann", "bob", "j.doe", "maria", "kim77", "info", "sales", "lee_r")
HOSTS = ("example", "mail", "corp-site", "uni", "postbox", "web9")
CONTEXT = 24
#: Digits below which a run of digits is no candidate; the base rules ask for more.
LEAST_DIGITS = {"card": 8, "phone": 7}
KEYWORDS = r"(?i)\b(?:e-?mail|mail|contact|call|phone|tel|mobile|fax|card|visa|pay|account|ip|host|server|address|write|reach)\b"

#: What marks a number as one to call, and what marks it as something else.
CALLS = r"(?i)\b(?:contact|call|phone|tel|telephone|mobile|cell|fax|reach|dial|ring)\b"
OTHERS = r"(?i)\b(?:id|ids|no|nr|order|invoice|ref|reference|isbn|issn|sku|serial|ticket|case|version|account|item)\b[^A-Za-z0-9]*$"
DATES = r"(?:(?<![0-9])(?:19|20)[0-9]{2}[\x20./-][01]?[0-9][\x20./-][0-3]?[0-9](?![0-9])|(?<![0-9])[0-3]?[0-9][\x20./-][0-3]?[0-9][\x20./-](?:19|20)[0-9]{2}(?![0-9]))"
QUADS = r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"
#: A country's code or none, an area part and two to four further groups; dotted quads and a card's groups of four are none.
GROUPED = (
    r"^(?![0-9]{4}(?:[\x20-][0-9]{4}){2})(?![0-9]+(?:\.[0-9]+){3}$)(?:[0-9]{1,3}[\x20.-])?"
    r"(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[\x20.-]{1,2}\(?[0-9]{2,4}\)?){2,4}$"
)


def found_spans(text: Column, pattern: str, least_digits: int = 0) -> Column:
    """All matches of a pattern as ``array<struct<start, end, hit, before, after>>``, in code points, end exclusive.

    The pieces between the matches give the places, so no function with positions is needed. Matches with fewer than
    ``least_digits`` digits are no candidates; a long text full of short numbers thus keeps a short list.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    # Zipped, not looked up by place: what stands inside a lambda is evaluated for every element.
    first = F.zip_with(hits, gaps, lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    parts = F.zip_with(
        first,
        F.slice(gaps, 2, F.size(gaps)),
        lambda s, after: F.struct(
            s["hit"].alias("hit"), F.length(s["gap"]).alias("gap"), F.right(s["gap"], F.lit(CONTEXT)).alias("before"), F.left(after, F.lit(CONTEXT)).alias("after")
        ),
    )
    parts = F.filter(parts, lambda p: p["hit"].isNotNull())
    none = F.array().cast("array<struct<start:int,end:int,hit:string,before:string,after:string>>")

    def step(state, p):
        start = state["at"] + p["gap"]
        end = start + F.length(p["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), p["hit"].alias("hit"), p["before"].alias("before"), p["after"].alias("after"))
        more = F.concat(state["spans"], F.array(span))
        more = F.when(F.length(digits_of(p["hit"])) >= least_digits, more).otherwise(state["spans"]) if least_digits else more
        return F.struct(end.alias("at"), more.alias("spans"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda s: s["spans"])


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def passes(kind: str, hit: Column) -> Column:
    """The base rule's check of a match."""
    digits = digits_of(hit)
    n = F.length(digits)
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("decimal(38,0)"), F.lit(999)) <= 255)
    if kind == "card":
        return F.when(n.between(14, 19), F.call_function("luhn_check", digits)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def becomes(kind: int, hit: Column, before: Column, after: Column) -> Column:
    """Whether a wider match, normalised, is what its kind names: the weak label of a wider candidate.

    An e-mail has both marks spelt out or as signs, and no end of a sentence for a dot. A phone number has 10 to 15
    digits, and groups as such or a word before that names it; dates, ids, dotted quads and parts of longer numbers
    are none.
    """
    if KINDS[kind] == "email":
        plain = F.regexp_replace(hit, r"(?i)\x20?(?:\[at\]|\(at\)|\x20at\x20|@)\x20?", "@")
        plain = F.regexp_replace(plain, r"(?i)\x20?(?:\[dot\]|\(dot\)|\x20dot\x20)\x20?", ".")
        marked = hit.rlike(r"(?i)[\[(]at[\])]|@|\x20at\x20.*(?:[\[(]dot[\])]|\x20dot\x20)")
        return marked & plain.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}$")
    whole = ~before.rlike(r"[A-Za-z0-9_]$|\+[\x20().0-9-]*$") & ~after.rlike(r"^(?:[A-Za-z_]|[\x20.-]?[0-9])")
    called = before.rlike(CALLS) | hit.rlike(GROUPED)
    other = before.rlike(OTHERS) | hit.rlike(DATES) | hit.rlike(QUADS)
    return passes("phone", hit) & whole & called & ~other


def candidates(rows: DataFrame) -> DataFrame:
    """``rows`` with ``__base`` and ``__wide``: arrays of ``struct<start, kind, end, hit, before, after, base>``.

    ``kind`` is the place in :data:`KINDS`. ``__base`` holds every match of a base pattern, passed or not.
    """
    needs = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+"))}
    empty = F.array().cast("array<struct<start:int,end:int,hit:string,before:string,after:string>>")

    def typed(spans: Column, kind: str, base: bool) -> Column:
        return F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"), s["hit"].alias("hit"),
                s["before"].alias("before"), s["after"].alias("after"), (passes(kind, s["hit"]) if base else F.lit(False)).alias("base"),
            ),
        )

    out = rows
    for kind in KINDS:
        spans = found_spans(F.col("text"), BASE[kind], LEAST_DIGITS.get(kind, 0))
        if kind in needs:
            spans = F.when(needs[kind], spans).otherwise(empty)
        elif kind == "ip":
            spans = F.when(F.col("text").rlike(r"[0-9]\.[0-9]"), spans).otherwise(empty)
        out = out.withColumn(f"__{kind}", typed(spans, kind, True))
    for i, (kind, pattern, gate) in enumerate(WIDER):
        spans = F.when(F.col("text").rlike(gate), found_spans(F.col("text"), pattern)).otherwise(empty)
        out = out.withColumn(f"__wide{i}", typed(spans, kind, False))
    base = F.concat(*[F.col(f"__{k}") for k in KINDS])
    wide = F.concat(*[F.col(f"__wide{i}") for i in range(len(WIDER))])
    out = out.withColumn("__base", base).withColumn("__wide", wide)
    return out.drop(*[f"__{k}" for k in KINDS], *[f"__wide{i}" for i in range(len(WIDER))])


def _wide_label(c: Column) -> Column:
    label = F.lit(False)
    for kind in {KINDS.index(k) for k, _, _ in WIDER}:
        label = F.when(c["kind"] == kind, becomes(kind, c["hit"], c["before"], c["after"])).otherwise(label)
    return label


def features(c: Column) -> list[Column]:
    """Format and context of a candidate."""
    hit, before, after = c["hit"], c["before"], c["after"]
    # The plus sign goes with its country's code, so that a number has the same features with and without them.
    bare = F.regexp_replace(hit, r"^\+(?:[0-9]{1,3}[\x20.-])?", "")
    digits = F.length(digits_of(bare))
    groups = F.split(F.regexp_replace(bare, "[^0-9]+", " "), " ")
    return [
        c["kind"].cast("double"),
        F.length(bare).cast("double"),
        digits.cast("double"),
        F.size(F.filter(groups, lambda g: g != "")).cast("double"),
        F.length(F.regexp_extract(bare, r"[0-9]+", 0)).cast("double"),
        F.length(F.regexp_extract(bare, r"[0-9]+$", 0)).cast("double"),
        F.regexp_count(bare, F.lit(r"[.]")).cast("double"),
        F.regexp_count(bare, F.lit(r"[-]")).cast("double"),
        F.regexp_count(bare, F.lit(r"\x20")).cast("double"),
        F.regexp_count(bare, F.lit(r"[()\[\]]")).cast("double"),
        F.regexp_count(bare, F.lit(r"[A-Za-z]")).cast("double"),
        F.length(F.regexp_extract(bare, r"[A-Za-z]+$", 0)).cast("double"),
        before.rlike(KEYWORDS).cast("double"),
        after.rlike(r"^[A-Za-z0-9_]").cast("double"),
        before.rlike(r"[A-Za-z0-9_]$").cast("double"),
        before.rlike(r"[0-9][^A-Za-z]{0,3}$").cast("double"),
        after.rlike(r"^[^A-Za-z]{0,3}[0-9]").cast("double"),
        F.regexp_count(bare, F.lit(r"@|(?i:[\[(](?:at|dot)[\])]|\x20dot\x20)")).cast("double"),
        F.regexp_count(bare, F.lit(r"\x20\.|\.\x20")).cast("double"),
        bare.rlike(DATES).cast("double"),
        bare.rlike(GROUPED).cast("double"),
        before.rlike(OTHERS).cast("double"),
    ]


def tree_sql(debug: str) -> str:
    """A fitted regression tree's printed form as a SQL expression over ``x``, an array of its features."""
    lines = [line.strip() for line in debug.splitlines() if re.match(r"\s*(If|Else|Predict)", line)]

    def read(i: int) -> tuple[str, int]:
        if lines[i].startswith("Predict:"):
            return f"({float(lines[i].split(':')[1])!r}D)", i + 1
        test = re.match(r"If \(feature (\d+) <= ([-\d.Ee]+)\)", lines[i])
        yes, i = read(i + 1)
        no, i = read(i + 1)  # past the Else line
        return f"(CASE WHEN x[{test[1]}] <= {float(test[2])!r}D THEN {yes} ELSE {no} END)", i

    return read(0)[0]


@dataclass
class Detector:
    """SQL of the trees' margin over ``x``, and each kind's threshold on it; no trees: no span is added."""

    margin: str | None = None
    thresholds: dict[int, float] = field(default_factory=dict)


def calibrate(counts: list[tuple[float, int, int]], precision: float, least: int = 20) -> float | None:
    """The lowest score from which the isotonic estimate of precision reaches ``precision``.

    ``counts``: score, rows, true rows, in ascending order of score.
    """
    blocks: list[list[float]] = []
    for score, n, true in counts:
        blocks.append([score, n, true])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1][1] += last[1]
            blocks[-1][2] += last[2]
    for score, n, true in blocks:
        if n >= least and true >= precision * n:
            return score
    return None


def with_planted(rows: DataFrame) -> DataFrame:
    """``rows`` (``doc_id, text``) with one string of :data:`PLANTED` or :data:`DECOYS` written into each text.

    ``__kind`` is the string's kind, ``__true`` whether it is personal data, ``__from`` and ``__to`` its place (of a
    decoy: all of it). What is written, and after which blank, follow from a hash of the document.
    """
    templates = [(KINDS.index(k), True, t) for k, ts in PLANTED.items() for t in ts] + [(KINDS.index(k), False, t) for k, ts in DECOYS.items() for t in ts]
    seed = lambda n: F.xxhash64("doc_id", "text", F.lit(n))
    pick = lambda items, n: F.get(F.array(*[F.lit(x) for x in items]), F.pmod(seed(n), F.lit(len(items))).cast("int"))
    table = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(true).alias("true"), F.lit(t).alias("form")) for k, true, t in templates])
    made = rows.withColumn("__t", F.get(table, F.pmod(seed(1), F.lit(len(templates))).cast("int")))
    # Digits in the order of a hash's own digits, 2 to 9, as many as a form can have.
    digits = F.translate(F.concat(*[F.lpad(F.pmod(seed(10 + i), F.lit(10**9)).cast("string"), 9, "7") for i in range(3)]), "01", "58")
    form = F.replace(F.replace(F.col("__t.form"), F.lit("N"), pick(NAMES, 2)), F.lit("H"), pick(HOSTS, 3))
    parts = F.split(form, "D", -1)
    filled = F.aggregate(
        F.slice(parts, 2, F.size(parts)),
        F.struct(F.lit(1).alias("i"), F.get(parts, 0).alias("s")),
        lambda a, p: F.struct((a["i"] + 1).alias("i"), F.concat(a["s"], F.substring(F.col("__digits"), a["i"], 1), p).alias("s")),
        lambda a: a["s"],
    )
    made = made.withColumn("__digits", digits).withColumn("__made", filled)
    blank = F.locate(" ", F.col("text"), 1)
    at = F.expr("locate(' ', text, 1 + CAST(pmod(xxhash64(doc_id, text, 4), greatest(length(text), 1)) AS INT))")
    made = made.withColumn("__at", F.when(at > 0, at).when(blank > 0, blank).otherwise(F.length("text")))
    lead = F.concat(F.expr("left(text, __at)"), F.lit(" "))
    head = F.when(F.contains("__made", F.lit("⟦")), F.substring_index("__made", "⟦", 1)).otherwise(F.lit(""))
    plain = F.translate("__made", "⟦⟧", "")
    body = F.when(F.contains("__made", F.lit("⟦")), F.regexp_extract("__made", "⟦(.*)⟧", 1)).otherwise(plain)
    start = F.length(lead) + F.length(head)
    return made.select(
        "doc_id", F.concat(lead, plain, F.lit(" , "), F.expr("substring(text, __at + 1)")).alias("text"),
        F.col("__t.kind").alias("__kind"), F.col("__t.true").alias("__true"), start.alias("__from"), (start + F.length(body)).alias("__to"),
    )


def labelled_candidates(rows: DataFrame) -> DataFrame:
    """``doc_id, c, label``: the candidates of documents with planted strings that are known to be true or false."""
    clear = F.filter("__wide", lambda c: ~F.exists("__base", lambda b: b["base"] & (b["start"] < c["end"]) & (c["start"] < b["end"])))
    sided = [
        F.transform("__base", lambda c: F.struct(c.alias("c"), F.lit(False).alias("wide"))),
        F.transform(clear, lambda c: F.struct(c.alias("c"), F.lit(True).alias("wide"))),
    ]
    each = candidates(with_planted(rows)).select("doc_id", "__kind", "__true", "__from", "__to", F.explode(F.concat(*sided)).alias("v")).select("*", "v.c", "v.wide")
    touches = (F.col("c.start") < F.col("__to")) & (F.col("__from") < F.col("c.end"))
    # The span itself, give or take a sign at its ends; a candidate that takes in more, or only a part, is false.
    equal = (F.abs(F.col("c.start") - F.col("__from")) <= 2) & (F.abs(F.col("c.end") - F.col("__to")) <= 2) & (F.col("c.kind") == F.col("__kind"))
    other = F.when(~_wide_label(F.col("c")), F.lit(0.0))
    label = F.when(~F.col("wide"), F.col("c.base").cast("double")).when(touches, (equal & F.col("__true")).cast("double")).otherwise(other)
    return each.select("doc_id", "c", label.alias("label")).where("label is not null")


def fit_detector(docs: DataFrame, sample_docs: int = 6000, precision: float = 0.98, trees: int = 12, depth: int = 4) -> Detector:
    """Fit and calibrate on the candidates of at most ``sample_docs`` documents, taken by a hash of their ids.

    Rows with a null id are not in the sample. Without true and false candidates, as of an empty table, no span is added.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    ids = docs.select(docs["doc_id"].alias("__pick")).where("__pick is not null").distinct()
    ids = ids.orderBy(F.xxhash64("__pick"), "__pick").limit(sample_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), docs["doc_id"] == F.col("__pick"), "left_semi")
    data = labelled_candidates(rows).select(
        F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)).alias("fold"), F.col("c.kind").alias("kind"), "label", F.array(*features(F.col("c"))).alias("x")
    )
    from .common import stage_table

    data = stage_table(data, "pii-sample")
    train = data.where("fold > 0").select("label", array_to_vector("x").alias("features"))
    if train.select("label").distinct().limit(2).count() < 2:
        return Detector()
    gbt = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, checkpointInterval=-1, seed=7, maxBins=64)
    model = gbt.fit(train)
    parts = [f"{float(w)!r}D * {tree_sql(t.toDebugString)}" for w, t in zip(model.treeWeights, model.trees)]
    margin = " + ".join(parts)
    held = data.where("fold = 0").select("kind", "label", (F.floor(F.expr(margin) * 100) / 100).alias("score"))  # down, so that what is calibrated reaches its own threshold
    rows = held.groupBy("kind", "score").agg(F.count("*").alias("n"), F.sum("label").alias("true")).orderBy("kind", "score").collect()
    thresholds = {}
    for k in sorted(KINDS.index(name) for name in PLANTED):  # of the other kinds, the check digit or the range decides
        mine = [(r["score"], r["n"], int(r["true"])) for r in rows if r["kind"] == k]
        got = calibrate(mine, precision)
        if got is not None and any(n > true for _, n, true in mine):  # without a false one, no score is tested
            thresholds[k] = got
    return Detector(margin, thresholds)


def with_spans(docs: DataFrame, detector: Detector) -> DataFrame:
    """``docs`` with ``__spans``: the selected spans, ``array<struct<start, kind, end, base>>`` in ascending order."""
    out = candidates(docs)
    slim = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), c["base"].alias("base"))
    sure = F.transform(F.filter("__base", lambda c: c["base"]), slim)
    out = out.withColumn("__sure", sure)
    if detector.margin and detector.thresholds:
        enough = F.lit(False)
        scored = F.transform(
            F.concat(F.filter("__base", lambda c: ~c["base"]), F.col("__wide")),
            lambda c: F.struct(slim(c).alias("s"), F.array(*features(c)).alias("x")),
        )
        out = out.withColumn("__scored", scored)
        limit = F.create_map(*[v for k, t in detector.thresholds.items() for v in (F.lit(k), F.lit(float(t)))])
        picked = F.expr(f"filter(transform(__scored, v -> struct(v.s AS s, aggregate(array(v.x), 0D, (a, x) -> a + {detector.margin}) AS m)), v -> v.m IS NOT NULL)")
        out = out.withColumn("__margins", picked)
        enough = F.filter("__margins", lambda v: v["m"] >= F.coalesce(F.try_element_at(limit, v["s"]["kind"]), F.lit(float("inf"))))
        more = F.transform(enough, lambda v: v["s"])
        clear = F.filter(more, lambda s: ~F.exists("__sure", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        spans = F.array_sort(F.concat("__sure", F.array_distinct(clear)))
        out = out.withColumn("__spans", spans).drop("__scored", "__margins")
    else:
        out = out.withColumn("__spans", F.array_sort("__sure"))
    return out.drop("__sure", "__base", "__wide")


def kind_name(kind: Column) -> Column:
    return F.get(F.array(*[F.lit(k) for k in KINDS]), kind)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind_name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count_of(kind: int) -> Column:
    return F.size(F.filter("__b", lambda s: s["kind"] == kind)).cast("long")


def pii_report(docs: DataFrame, **options) -> DataFrame:
    """``doc_id``, the base counts, ``base_sha256``, ``spans`` and ``n_spans`` of each document.

    Null texts are empty and have no spans; null ids are kept, but train nothing; repeated rows are rows of
    their own; an empty table gives no rows. Of the columns, only ``doc_id`` and ``text`` are read.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    out = with_spans(rows, fit_detector(rows, **options))
    out = out.select("doc_id", "__spans", F.filter("__spans", lambda s: s["base"]).alias("__b"))
    counts = [_count_of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(_joined(F.col("__b")), 256).alias("base_sha256"), _joined(F.col("__spans")).alias("spans"), F.size("__spans").cast("long").alias("n_spans"))


def redact(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every selected span of ``text`` replaced by its kind in brackets; all columns are kept.

    Of spans that overlap, the first names the replacement and all are covered.
    """
    names = docs.columns
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    detector = fit_detector(plain, **options)
    marked = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in names]).alias("__row"),
        F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"),
    )
    marked = with_spans(marked, detector)

    def step(state, s):
        fresh = s["start"] >= state["at"]
        added = F.concat(state["out"], F.substring(F.col("text"), state["at"] + 1, s["start"] - state["at"]), F.lit("["), F.upper(kind_name(s["kind"])), F.lit("]"))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(fresh, added).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate("__spans", start, step, lambda s: F.concat(s["out"], F.expr("substring(text, 1)").substr(s["at"] + 1, F.length("text"))))
    text = F.when(F.size("__spans") > 0, done).otherwise(F.col("__row.text"))
    return marked.select(*[text.alias(c) if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in names])
