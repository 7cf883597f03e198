"""Personal data by pattern, and by bootstrapped contexts.

The base patterns find e-mail addresses, IP addresses, payment cards and phone numbers. They are written so that the
regular-expression engine needs time linear in the text: runs are possessive, and a match may only begin where a run
begins or where the last match ended, which is where the plain pattern would find it too.

The method adds what the patterns miss. Every mention, a token with a digit or an at sign and the digit groups that
follow it, has lexical patterns: the two words before it, the word on either side, the word before it, the word after
it, a label such as ``mail:`` before it. Words are taken whole, however far away; another mention among them stands as one
sign, whatever it is, and a word of more than ``LONG`` characters as its hash. Mentions and patterns form a bipartite
graph over the whole corpus. Mentions that a base pattern accepts are
seeds of their kind. In each round, a pattern's trust in a kind is the Wilson lower bound of the share of its distinct
mentions that are of this kind, and a mention that isn't one yet becomes one if the patterns around it, taken
together, are trusted enough and it has the kind's rough shape, one of the fixed ``SHAPES``: a gate that no context
opens for other strings. After the last round those mentions are added, unless they overlap a
base span. Everything runs as DataFrame functions; nothing is capped or sampled.

Defined cases: null text is empty; rows with a null doc_id and repeated rows are treated like others; an empty table
gives an empty result; other columns pass through :func:`redact` whatever their names are.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, table, text_or_empty

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_HOST}]++(?:\.[{_HOST}]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Longer context words stand as their hash, so that a pattern is short whatever the text.
LONG = 64
_OTHER = "\u0001"
#: A text without these can't have a match.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_SP = r"\x20\x09-\x0D"
#: The words around a mention, in the text up to its neighbours.
TWO_BEFORE = rf"(?:^|[{_SP}])([^{_SP}]++)[{_SP}]++[^{_SP}]++[{_SP}]*+$"
ONE_BEFORE = rf"(?:^|[{_SP}])([^{_SP}]++)[{_SP}]*+$"
ONE_AFTER = rf"^[{_SP}]*+([^{_SP}]++)"
#: An at sign spelled out inside a token.
_AT = rf"(?<=[^{_SP}])[\[(]at[\])](?=[^{_SP}])"
#: Its first token has a digit or an at sign, spelled out or not; tokens of digits and phone punctuation may follow.
MENTION = rf"(?:\G|(?<![^{_SP}]))[^{_SP}0-9@\[(]*+(?:(?!{_AT})[\[(][^{_SP}0-9@\[(]*+)*+(?:[0-9@]|{_AT})[^{_SP}]*+(?:\x20[(0-9+][0-9().+-]*+(?=[{_SP}]|\z))*+"
#: What a mention must look like to be added as a kind that its base pattern didn't see.
SHAPES = {
    "email": r"^[^@\x20]+(?:@[^@\x20]+|[\[(]at[\])][^@\x20]+)$",
    "ip": r"^(?=(?:[^:]*:){2})[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}$",
    "card": r"^[0-9]{4}(?:[./_-]?[0-9]{4}){3}$",
    "phone": r"^[(]?[0-9](?:[\x20().-]*[0-9]){6,14}$",
}


@dataclass(frozen=True)
class PiiParams:
    z: float = 2.58
    trust: float = 0.5
    accept: float = 0.5


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(acc, i):
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def holds(kind: str, x: Column) -> Column:
    """Whether a match of the kind's pattern passes its test."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        bare = lambda part: F.ltrim(part, F.lit("0"))
        return F.forall(F.split(x, r"\."), lambda part: (F.length(bare(part)) <= 3) & F.coalesce(bare(part).try_cast("int") <= 255, F.lit(True)))
    n = F.length(_digits(x))
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), _luhn(_digits(x))).otherwise(False)
    return (n >= 10) & (n <= 15)


def _hits(docs: DataFrame, text: Column, patterns: dict[str, str]) -> DataFrame:
    """Per pattern k, columns m_k (matches) and p_k (the pieces between them; null without a match)."""
    def matches(k: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(patterns[k]), F.lit(0))
        return F.when(F.contains(text, F.lit(NEEDS[k])), found) if NEEDS.get(k) else found

    one = docs.select("*", *[matches(k).alias(f"_m_{k}") for k in patterns])
    return one.select("*", *[F.when(F.size(F.coalesce(f"_m_{k}", F.array())) > 0, F.split(text, patterns[k], -1)).alias(f"_p_{k}") for k in patterns])


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` with ``_rid`` and ``_hits``: kind, position among its pattern's, lengths, match, context words of mentions."""
    every = {**PATTERNS, "mention": MENTION}
    found = _hits(docs.select(*[F.col(f"`{c}`").alias(f"_in_{i}") for i, c in enumerate(keep)], text_or_empty().alias("_text")), F.col("_text"), every)

    def word(context: Column, pattern: str, group: int) -> Column:
        w = F.lower(F.regexp_extract(context, pattern, group))
        return F.when(F.length(w) > LONG, F.sha2(w, 256)).otherwise(w)

    def of(k: str) -> Column:
        m, p = F.col(f"_m_{k}"), F.col(f"_p_{k}")
        none = F.lit(None).cast("string")
        words = {"l2": lambda i: none, "l1": lambda i: none, "r1": lambda i: none}
        if k == "mention":
            left = lambda i: F.concat(F.when(i > 0, _OTHER).otherwise(""), F.get(p, i))
            right = lambda i: F.concat(F.get(p, i + 1), F.when(i + 1 < F.size(m), _OTHER).otherwise(""))
            words = {"l2": lambda i: word(left(i), TWO_BEFORE, 1), "l1": lambda i: word(left(i), ONE_BEFORE, 1), "r1": lambda i: word(right(i), ONE_AFTER, 1)}
        return F.transform(F.coalesce(m, F.array().cast("array<string>")), lambda x, i: F.struct(F.lit(k).alias("kind"), i.alias("i"), F.length(F.get(p, i)).alias("gap"), F.length(x).alias("len"), x.alias("match"), *[of_i(i).alias(n) for n, of_i in words.items()]))

    return found.select(F.monotonically_increasing_id().alias("_rid"), *[f"_in_{i}" for i in range(len(keep))], F.concat(*[of(k) for k in every]).alias("_hits"))


def spans_of(scanned: DataFrame) -> DataFrame:
    """(rid, kind, start, end, match, l2, l1, r1) of every match, in code points, before any test."""
    each = scanned.select(F.col("_rid").alias("rid"), F.inline("_hits"))
    w = Window.partitionBy("rid", "kind").orderBy("i")
    end = F.sum(F.col("gap").cast("long") + F.col("len")).over(w)
    return each.select("rid", "kind", (end - F.col("len")).alias("start"), end.alias("end"), "match", "l2", "l1", "r1")


def base_spans(spans: DataFrame) -> DataFrame:
    ok = reduce(lambda acc, k: acc.when(F.col("kind") == k, holds(k, F.col("match"))), KINDS, F.when(F.lit(False), F.lit(False)))
    return spans.filter(F.col("kind") != "mention").filter(ok.otherwise(F.lit(False))).select("rid", "kind", "start", "end")


def mentions_of(spans: DataFrame) -> DataFrame:
    """(rid, start, end, inst, seed, patterns): mentions without the punctuation around them."""
    m = spans.filter(F.col("kind") == "mention")
    lead = F.length(F.regexp_extract("match", r"^[\"'<\[{]*", 0))
    tail = F.length(F.regexp_extract("match", r"[.,;:!?\"'>\]}]*$", 0))
    n = F.length("match")
    core = F.substr(F.col("match"), (lead + 1).cast("int"), F.greatest(n - lead - tail, F.lit(0)).cast("int"))
    m = m.filter(n > lead + tail).select("rid", (F.col("start") + lead).alias("start"), (F.col("end") - tail).alias("end"), core.alias("inst"), "l2", "l1", "r1")
    any_of = lambda k: F.exists(F.regexp_extract_all("inst", F.lit(PATTERNS[k]), F.lit(0)), lambda x: holds(k, x))
    seed = reduce(lambda acc, k: acc.when(any_of(k), F.lit(k)), KINDS[1:], F.when(any_of("email"), F.lit("email")))
    m = m.select("rid", "start", "end", "inst", seed.alias("seed"), "l2", "l1", "r1")
    patterns = F.array_compact(F.array(
        F.when((F.col("l2") != "") & (F.col("l1") != ""), F.concat_ws(" ", "l2", "l1", F.lit("_"))),
        F.when((F.col("l1") != "") & (F.col("r1") != ""), F.concat_ws(" ", "l1", F.lit("_"), "r1")),
        F.when(F.col("l1") != "", F.concat_ws(" ", F.lit("one"), "l1", F.lit("_"))),
        F.when(F.col("r1") != "", F.concat_ws(" ", F.lit("one"), F.lit("_"), "r1")),
        F.when(F.col("l1").rlike("[:=]$"), F.concat_ws(" ", F.lit("label"), "l1", F.lit("_"))),
    ))
    return m.select("rid", "start", "end", "inst", "seed", patterns.alias("patterns"))


def discover(mentions: DataFrame, work: Workspace, params: PiiParams = PiiParams()) -> DataFrame:
    """(inst, kind): mentions that the contexts make identifiers."""
    graph = work.save(mentions.select("inst", "seed", F.explode("patterns").alias("pattern")).distinct(), "graph")
    shape = F.array_compact(F.array(*[F.when(F.col("inst").rlike(SHAPES[k]), F.lit(k)) for k in KINDS]))
    open_ = work.save(graph.filter("seed is null").select("inst", "pattern", F.explode(shape).alias("kind")), "open")
    sizes = work.save(graph.groupBy("pattern").agg(F.countDistinct("inst").alias("n")), "patterns")
    labelled = graph.filter("seed is not null").select("pattern", "inst", F.col("seed").alias("kind"))
    won = None
    for k in count():
        known = labelled if won is None else labelled.unionByName(open_.join(won, ["inst", "kind"]).select("pattern", "inst", "kind"))
        votes = known.groupBy("pattern", "kind").agg(F.countDistinct("inst").alias("x")).join(sizes, "pattern")
        p, n, z2 = F.col("x") / F.col("n"), F.col("n"), params.z**2
        wilson = (p + z2 / (2 * n) - params.z * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n)
        trusted = votes.select("pattern", "kind", wilson.alias("trust")).filter(F.col("trust") >= params.trust)
        # noisy-or over the trusted patterns of a mention
        score = 1 - F.exp(F.sum(F.log(1 - F.col("trust"))))
        scored = open_.join(trusted, ["pattern", "kind"]).groupBy("inst", "kind").agg(score.alias("score")).filter(F.col("score") >= params.accept)
        best = scored.groupBy("inst").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
        before = 0 if won is None else won.count()
        won = work.save(best, f"won{k}")
        if won.count() <= before:
            return won


def find(docs: DataFrame, work: Workspace, keep: list[str], params: PiiParams = PiiParams()) -> tuple[DataFrame, DataFrame]:
    """The scanned rows (``_rid``, ``_in_<i>`` for ``keep``) and all spans (rid, kind, start, end, added)."""
    scanned = work.save(scan(docs, keep), "scanned")
    spans = work.save(spans_of(scanned), "spans")
    base = base_spans(spans)
    mentions = work.save(mentions_of(spans), "mentions")
    won = discover(mentions.select("inst", "seed", "patterns"), work, params)
    more = mentions.filter("seed is null").join(won, "inst").select("rid", "kind", "start", "end")
    clash = more.join(base.select("rid", F.col("start").alias("bs"), F.col("end").alias("be")), "rid").filter("bs < end and start < be").select("rid", "start").distinct()
    more = more.join(clash, ["rid", "start"], "left_anti")
    return scanned, work.save(base.withColumn("added", F.lit(False)).unionByName(more.withColumn("added", F.lit(True))), "found")


def _order(kind: Column) -> Column:
    return reduce(lambda acc, k: acc.when(kind == k, KINDS.index(k)), KINDS, F.when(F.lit(False), -1))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned, spans = find(table(spark, sf_dir, "documents").select("doc_id", "text"), Workspace(spark, "op1"), ["doc_id"])
    listed = lambda only: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(only, F.struct("start", _order(F.col("kind")).alias("k"), "end", "kind")))), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    by = spans.groupBy("rid").agg(*[F.count_if((F.col("kind") == k) & ~F.col("added")).alias(f"n_{k}") for k in KINDS], F.count_if("added").alias("n_added"), listed(~F.col("added")).alias("base"), listed(F.lit(True)).alias("spans"))
    out = scanned.select("_rid", F.col("_in_0").alias("doc_id")).join(by, F.col("_rid") == F.col("rid"), "left")
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_added", F.lit(0)).cast("long").alias("n_added"))


def redact(docs: DataFrame, work: Workspace, params: PiiParams = PiiParams()) -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in brackets, and ``n_chars``, if there is one, counted again."""
    keep = docs.columns
    at = keep.index("text")
    scanned, spans = find(docs, work, keep, params)
    # spans that overlap give up what an earlier one covers
    w = Window.partitionBy("rid").orderBy("start", _order(F.col("kind")), "end")
    past = F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = spans.select("rid", "kind", F.greatest("start", past).alias("start"), "end").filter("start < end")
    cuts = cut.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("_cuts"))
    # only rows with something found are shuffled with their texts
    found = F.size("_hits") > 0
    plain = scanned.filter(~found).drop("_hits").select("*", F.lit(None).cast(cuts.schema["_cuts"].dataType).alias("_cuts"))
    joined = scanned.filter(found).drop("_hits").join(cuts, F.col("_rid") == F.col("rid"), "left").drop("rid").unionByName(plain)
    chars = joined.select("*", F.when(F.col("_cuts").isNotNull(), F.split(F.col(f"_in_{at}"), "")).alias("_chars"))
    piece = lambda a, b: F.array_join(F.slice("_chars", (a + 1).cast("int"), (b - a).cast("int")), "")
    done = F.transform("_cuts", lambda x, i: F.concat(piece(F.coalesce(F.get("_cuts", i - 1)["end"], F.lit(0)), x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))
    last = F.get("_cuts", F.size("_cuts") - 1)["end"]
    text = F.when(F.col("_cuts").isNull(), F.col(f"_in_{at}")).otherwise(F.concat(F.array_join(done, ""), piece(last, F.size("_chars").cast("long"))))
    out = chars.select(*[(text if i == at else F.col(f"_in_{i}")).alias(c) for i, c in enumerate(keep)])
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in keep else out
