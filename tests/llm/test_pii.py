"""Base spans against the plain patterns, planted contexts, redaction."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.llm import pii
from strandloom.workspace import Workspace

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")), "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}[kind]()


def brute(text):
    return sorted((m.start(), pii.KINDS.index(k), m.end(), k) for k in PLAIN for m in re.finditer(PLAIN[k], text or "") if passes(k, m.group()))


def base(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scanned, spans = pii.find(df, Workspace(spark, "pii"), ["doc_id"])
    out = {i: [] for i in range(len(texts))}
    for r in spans.filter("not added").join(scanned, F.col("rid") == F.col("_rid")).collect():
        out[r["_in_0"]].append((r["start"], pii.KINDS.index(r["kind"]), r["end"], r["kind"]))
    return {i: sorted(x) for i, x in out.items()}


ODD = [
    None, "", "a@b.c", "x.a@b.c_d@e.f", "a@b c@d.e", "a@b..c a@b.c.", "@b.c", "a@b@c.d", "😀 a@b.c é 1.2.3.4 😀", "1.2.3.4.5.6.7.8", "256.1.1.1 0000255.1.1.1", "12.3.4",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "41111111111111112222222222", "+1 (743) 555-3824", "+1(743", "+123456789 +1234567890 ", "+1 743 555 3824 4111111111111111", "+++1234567890...", "a.b.c@d-e.f-g.h",
    "%@x.y +@x.y", "1 2 3 4 5 6 7 8 9 0 1 2 3 4", "a@b.c,d@e.f;g@h.i", "x" * 5000 + "@" + ".a" * 3000, "9" * 4000, "+1" + "(" * 3000,
]


def test_odd_texts(spark):
    assert base(spark, ODD) == {i: brute(t) for i, t in enumerate(ODD)}


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="a1@.+- (_)é\n", max_size=50), min_size=1, max_size=25))
def test_random_texts(spark, texts):
    assert base(spark, texts) == {i: brute(t) for i, t in enumerate(texts)}


def corpus():
    rows = [(i, f"words before it contact email: user{i}@mail.example.com and after") for i in range(30)]
    rows += [(100, "please contact email: someone@localhost soon"), (101, "they contact email: 12345 today"), (102, "the price was 12345 and rose@dawn came")]
    rows += [(200 + i, f"call us at phone +1 (555) 010-{1000 + i} any time") for i in range(30)]
    rows += [(300, "call us at phone 555-010-2222 any time"), (301, "about 555-010-3333 items"), (302, "call us at phone later"), (303, None)]
    return rows


def test_contexts_find_what_patterns_miss(spark, work):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    scanned, spans = pii.find(df, work, ["doc_id"])
    got = {(r["_in_0"], r["kind"], r["start"], r["end"]) for r in spans.filter("added").join(scanned, F.col("rid") == F.col("_rid")).collect()}
    t = dict(corpus())
    at = lambda d, x: (t[d].index(x), t[d].index(x) + len(x))
    assert got == {(100, "email", *at(100, "someone@localhost")), (300, "phone", *at(300, "555-010-2222"))}


def test_redaction_and_other_columns(spark, work):
    schema = "doc_id long, text string, n_chars long, rid int, `_in_0` string, `a.b` int"
    rows = [(1, "mail a@b.c or +1 (743) 555-3824, 4111 1111 1111 1111.", 0, 5, "x", 1), (2, "nothing", 7, 6, "y", 2), (3, None, None, 7, None, 3), (1, "nothing", 7, 6, "y", 2)]
    out = {(r["doc_id"], r["rid"]): r.asDict() for r in pii.redact(spark.createDataFrame(rows, schema), work).collect()}
    assert out[1, 5]["text"] == "mail [EMAIL] or [PHONE], [CARD]." and out[1, 5]["n_chars"] == len(out[1, 5]["text"])
    assert out[2, 6]["text"] == "nothing" and out[3, 7]["text"] is None and out[2, 6]["_in_0"] == "y"
    empty = pii.redact(spark.createDataFrame([], schema), work)
    assert empty.columns == ["doc_id", "text", "n_chars", "rid", "_in_0", "a.b"] and empty.count() == 0


def test_very_long_text(spark, work):
    text = "w " * 100_000 + " ".join(f"u{i}@x.org" for i in range(3000))
    out = pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string"), work).first()["text"]
    assert out.count("[EMAIL]") == 3000 and "@" not in out and out.startswith("w w w ")


def test_spelled_out_addresses_are_mentions(spark, work):
    texts = [f"write to mail: u{i}@x.example.org today" for i in range(30)] + ["write to mail: jane[at]example.org today", "write to mail: joe(at)example.org today", "meet (at) noon"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["text"] for r in pii.redact(df, work).orderBy("doc_id").collect()] == ["write to mail: [EMAIL] today"] * 32 + ["meet (at) noon"]


def test_rounds_go_on_while_something_is_found(spark, work):
    """Every level's context becomes trusted only by the level before it; the last is found in the fourth round."""
    rows, sizes = [], (1200, 300, 75, 20, 5)
    for level, n in enumerate(sizes):
        rows += [(f"555-{level}{k:06d}", None if level else "phone", [f"p{level}", f"p{level + 1}"] if level else ["p1"]) for k in range(n)]
    won = pii.discover(spark.createDataFrame(rows, "inst string, seed string, patterns array<string>"), work)
    assert won.count() == sum(sizes[1:])


def planted(n=4000, seed=3):
    """Prose with identifiers of every kind in contexts that vary, some of which no base pattern sees, and look-alikes elsewhere."""
    import random

    r = random.Random(seed)
    filler = [f"{a}{b}" for a in ("ba", "do", "ki", "lu", "me", "no", "ra", "su") for b in ("lan", "mer", "tis", "von", "ghe", "pod")]
    prose = lambda k: " ".join(r.choice(filler) for _ in range(k))
    known = {
        "email": lambda: f"u{r.randrange(10**6)}@mail{r.randrange(50)}.example.org",
        "phone": lambda: f"+1 ({r.randrange(200, 999)}) 555-{r.randrange(10**4):04d}",
        "ip": lambda: ".".join(str(r.randrange(1, 255)) for _ in range(4)),
    }
    unseen = {
        "email": lambda: f"v{r.randrange(10**6)}@intranet{r.randrange(50)}",
        "phone": lambda: f"({r.randrange(200, 999)}) 555-{r.randrange(10**4):04d}",
        "ip": lambda: f"fe80::{r.randrange(1, 16**4):x}:{r.randrange(1, 16**4):x}",
    }
    before = {"email": ["please write to", "send it to", "e-mail:", "reach them at"], "phone": ["call us on", "phone:", "dial the number"], "ip": ["logged from", "request from host", "address:"]}
    rows, added = [], {}
    for i in range(n):
        text, kind = prose(r.randrange(5, 40)) + " ", r.choice(sorted(known))
        roll = r.random()
        if roll < 0.6:
            text += f"{r.choice(before[kind])} {known[kind]()} {prose(8)}"
        elif roll < 0.7:
            text += f"{r.choice(before[kind])} "
            x = unseen[kind]()
            added[i] = (kind, len(text), len(text) + len(x))
            text += f"{x} {prose(8)}"
        elif roll < 0.8:  # the same shapes where nothing speaks for them
            text += f"{prose(3)} {unseen[kind]()} {prose(8)}"
        rows.append((i, text))
    return rows, added


def test_precision_and_recall_on_planted_contexts(spark, work):
    rows, want = planted()
    scanned, spans = pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), work, ["doc_id"])
    got = {(r["_in_0"], r["kind"], r["start"], r["end"]) for r in spans.filter("added").join(scanned, F.col("rid") == F.col("_rid")).collect()}
    want = {(i, *x) for i, x in want.items()}
    assert len(want) > 300
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)


def test_context_words_are_whole_and_neighbours_stand_as_one_sign(spark):
    far = "label" + " " * 300 + "u1@x.org and 12345 or u2@x.org " + "y" * 5000 + " u3@x.org"
    df = spark.createDataFrame([(1, far)], "doc_id long, text string")
    m = {r["inst"]: r["patterns"] for r in pii.mentions_of(pii.spans_of(pii.scan(df, ["doc_id"]))).collect()}
    assert "one label _" in m["u1@x.org"] and "label _ and" in m["u1@x.org"]
    assert "\x01 and _" in m["12345"] and "\x01 or _" in m["u2@x.org"]
    assert all(len(p) < 200 for p in m["u3@x.org"]) and len(m["u3@x.org"]) == 2
