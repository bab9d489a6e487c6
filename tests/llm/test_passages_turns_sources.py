"""Substring dedup, conversation repair and the source audit against plain versions on small tables."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

from fleetsift.llm import conversation_repair, source_audit, substring_dedup

# --- Substring dedup -----------------------------------------------------------------


def plain_dedup(rows, length):
    words = [(-(1 << 63) if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for doc, w in words:
        for s in range(len(w) - length + 1):
            key = tuple(w[s:s + length])
            first[key] = min(first.get(key, (doc, s)), (doc, s))
    out = []
    for (given, _), (doc, w) in zip(rows, words, strict=True):
        gone = {k for s in range(len(w) - length + 1) if first[tuple(w[s:s + length])] < (doc, s) for k in range(s, s + length)}
        out.append((given, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


def dedup_rows(spark, rows, length, **more):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sorted((tuple(r) for r in substring_dedup.deduplicate(docs, length=length, **more).collect()), key=str)


@pytest.mark.parametrize("length", [2, 5, 8, 20])
def test_windows_that_repeat(spark, monkeypatch, length):
    draw = random.Random(length)
    passage = [draw.choice("abcdefgh") * draw.randint(1, 3) for _ in range(60)]
    rows = []
    for k in range(60):
        own = [f"{draw.choice('abcdefghij')}{draw.randint(0, 30)}" for _ in range(draw.randint(0, 40))]
        start = draw.randint(0, 50)
        cut = passage[start:start + draw.randint(0, 40)]
        rows.append((k, " \n\t"[k % 3].join(own[:10] + cut + own[10:])))
    rows += [(70, None), (71, ""), (72, " \n "), (None, rows[3][1]), (None, "one more " * 30), (5, rows[5][1]), (5, rows[6][1]), (80, "x " * 300), (81, "é ü " * 50)]
    assert dedup_rows(spark, rows, length) == plain_dedup(rows, length)
    # Small holdings, long texts in pieces, and every anchor a common one.
    monkeypatch.setattr(substring_dedup, "HELD_WORDS", 50)
    monkeypatch.setattr(substring_dedup, "HELD_BYTES", 40)
    monkeypatch.setattr(substring_dedup, "BUCKET_WORDS", 30)
    assert dedup_rows(spark, rows, length) == plain_dedup(rows, length)
    monkeypatch.setattr(substring_dedup, "_plan", lambda rows, length, sample: (list(range(5)), 7))
    assert dedup_rows(spark, rows, length) == plain_dedup(rows, length)


def test_common_anchors_change_nothing(spark, monkeypatch):
    line = [f"shared{k}" for k in range(15)]
    draw = random.Random(1)
    rows = [(k, " ".join([f"w{draw.randint(0, 9)}" for _ in range(12)] + line + [f"w{draw.randint(0, 9)}" for _ in range(12)])) for k in range(150)]
    rows += [(200 + k, rows[k][1]) for k in range(10)]
    given = spark.createDataFrame(rows, "doc bigint, text string").selectExpr("doc", "xxhash64(text) & 4294967295L mark", "encode(text, 'UTF-8') text")
    common, _ = substring_dedup._plan(given, 20, 2_000)
    assert common
    assert dedup_rows(spark, rows, 20) == plain_dedup(rows, 20)


def test_dedup_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d", "x", 7), (2, "b c d", "y", 8)], "doc_id bigint, text string, kept_text string, start int")
    out = substring_dedup.deduplicate(docs, length=3, keep_columns=True)
    assert out.columns == ["doc_id", "text", "kept_text", "start", "n_words", "n_removed", "kept_text"]
    assert sorted(map(tuple, out.collect())) == [(1, "a b c d", "x", 7, 4, 0, "a b c d"), (2, "b c d", "y", 8, 3, 3, "")]
    assert substring_dedup.deduplicate(docs.where("false")).collect() == []
    with pytest.raises(ValueError):
        substring_dedup.deduplicate(docs, length=1)


# --- Conversation repair ---------------------------------------------------------------


def plain_repair(rows):
    """Cheapest edits by trying the states one after another, whole strings kept: (audit, cost, repaired)."""
    ways = {"": (0, "", ())}
    seen = set()

    def fits(roles):
        return re.fullmatch(r"s?(ua)*u?", roles)

    def filled(ways):
        ways = dict(ways)
        for _ in range(2):
            for state, (cost, audit, out) in list(ways.items()):
                for role in ("user", "assistant"):
                    add(ways, out + ((role, ""),), cost + 2, audit + "I")
        return ways

    def add(ways, out, cost, audit):
        roles = "".join(r[:1] for r, _ in out)
        if not fits(roles):
            return
        state = "" if not roles else "s" if roles == "s" else roles[-1]
        if state not in ways or (cost, audit) < ways[state][:2]:
            ways[state] = cost, audit, out

    for role, text in rows:
        bare = text.strip(" \t\n\x0b\f\r")
        must = not bare or (role, text) in seen
        seen.add((role, text))
        dearer = int(bool(bare) and bare[-1] not in ".!?")
        after = {}
        every = [(w, n) for n, w in _inserted(ways, add)]
        for (cost, audit, out), n in every:
            add(after, out, cost + 3, audit + "D")
            if not must:
                if role:
                    add(after, out + ((role, text),), cost + dearer, audit + "K")
                for new in ("user", "assistant"):
                    add(after, out + ((new, text),), cost + 2 + dearer, audit + "R")
        ways = after
    ends = [w for _, w in _inserted(ways, add) if not w[2] or w[2][-1][0][:1] == "a"]
    return min(ends, key=lambda w: w[:2])


def _inserted(ways, add):
    """Every way, with up to two insertions, not only the best of each state."""
    now = list(ways.values())
    out = [(0, w) for w in now]
    for n in (1, 2):
        more = []
        for cost, audit, done in now:
            for role in ("user", "assistant"):
                one = {}
                add(one, done + ((role, ""),), cost + 2, audit + "I")
                more += one.values()
        out += [(n, w) for w in more]
        now = more
    return out


@pytest.mark.parametrize("small", [False, True])
def test_cheapest_edits(spark, monkeypatch, small):
    draw = random.Random(3)
    rows, talks = [], {}
    for conv in range(150):
        n = draw.choice([1, 2, 3, 5, 9, 30])
        talks[conv] = [(turn, draw.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), draw.choice(["a.", "b!", "c?", "d", " \n", "e, f", "g. \n", ""]) + "." * (turn % 3)) for turn in range(n)]
        rows += [(conv, *t) for t in talks[conv]]
    draw.shuffle(rows)
    if small:
        monkeypatch.setattr(conversation_repair, "HELD_ROWS", 4)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        turns = conversation_repair.repair(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
        found = {r.conv_id: r for r in conversation_repair.summaries(turns).collect()}
        texts = defaultdict(list)
        for r in turns.collect():
            if r.edit != "delete":
                texts[r.conv_id].append((r.position, r.role, r.text))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    for conv, talk in talks.items():
        cost, audit, out = plain_repair([(r, t) for _, r, t in talk])
        assert (found[conv].cost, found[conv].audit) == (cost, audit), talk
        whole = "\n".join(f"{r}:{t}" for r, t in out)
        assert found[conv].repaired_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert [(r, t) for _, r, t in sorted(texts[conv])] == list(out)
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(talk)]
        assert found[conv].illegal == sum(p not in ("su", "ua", "au") for p in pairs) and found[conv].gaps == 0


def test_faults_gaps_and_nulls(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, edit string, fault int"
    rows = [(1, 5, "user", "Hi.", "x", 1), (1, 9, "user", "Hi.", "x", 1), (1, None, None, None, "x", 1), (1, 9, "assistant", "Well", "x", 1),
            (None, None, "user", "a.", "x", 1), (None, None, "assistant", "b.", "x", 1), (2, 3, "system", "s.", "x", 1)]
    given = spark.createDataFrame(rows, schema)
    found = {r.conv_id: tuple(r)[1:-1] for r in conversation_repair.summaries(conversation_repair.repair(given)).collect()}
    # A null text is blank and goes; turns 5 and 9 leave three out; the second "Hi." stands after "Well" and is a duplicate.
    assert found[1] == (3, 1, 1, 1, 1 + 0, 3 + 3 + 1, "DKKD")
    assert found[None][0] == 0 and found[None][-1] in ("KK", "RK", "DD", "IKKI") and found[2] == (0, 0, 0, 0, 0, 3, "D")
    assert conversation_repair.repair(given.where("false")).count() == 0
    whole = conversation_repair.all_conversations(given, conversation_repair.summaries(conversation_repair.repair(given.where("conv_id = 2"))))
    assert {r.conv_id: (r.cost, r.audit, r.repaired_sha256) for r in whole.collect()}[None] == (0, "", hashlib.sha256().hexdigest())


def test_a_giant_conversation_is_spilled(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "HELD_ROWS", 500)
    rows = spark.range(20_000).selectExpr("0L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat('t', id, if(id % 10 = 7, '', '.')) text")
    found = conversation_repair.summaries(conversation_repair.repair(rows)).collect()
    assert len(found) == 1 and found[0].audit == "K" * 20_000 and found[0].cost == found[0].truncated == 2_000


# --- Source audit --------------------------------------------------------------------


def plain_audit(rows, least_docs, top):
    terms = [(l or "", s or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", x or "")]) for l, s, x in rows]
    out = []
    for lang in {l for l, _, _ in terms}:
        docs, n = Counter(), defaultdict(Counter)
        for l, s, t in terms:
            if l == lang:
                docs.update(set(t))
                n[s].update(t)
        kept = [t for t, k in docs.items() if k >= least_docs]
        total = {s: sum(c[t] for t in kept) for s, c in n.items()}
        share = lambda count, whole: 1 + 1_000_000_000 * (count + 5) // (whole + 5 * len(kept))
        p = {s: {t: share(c[t], total[s]) for t in kept} for s, c in n.items()}
        q = {t: share(sum(c[t] for c in n.values()), sum(total.values())) for t in kept}
        for s in n:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in n if o != s)
            out += [(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(pairs)]
            ahead = sorted((q[t] - p[s][t], t.encode()) for t in kept if n[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(ahead)]
    return sorted(out)


@pytest.mark.parametrize("bits", [64, 5])
def test_sources_apart(spark, monkeypatch, bits):
    draw = random.Random(8)
    rows = [(draw.choice(["en", "de", None, ""]), draw.choice(["a", "b", "é", None, "z"]),
             " ".join(draw.choice(["Été", "the", "The", "straße", "x1y", "ÄB", f"t{chr(97 + draw.randint(0, 25))}{chr(97 + draw.randint(0, 6))}"]) for _ in range(draw.randint(0, 30)))) for _ in range(300)]
    rows += [("en", "only null", None), ("fr", "few", "un deux"), ("fr", "none", ""), ("en", "a", "the-" * 9000)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, source string, text string, term string, p int")
    monkeypatch.setattr(source_audit, "ENTRIES", 40)
    monkeypatch.setattr(source_audit, "CELLS", 50)
    monkeypatch.setattr(source_audit, "HELD_BYTES", 100)
    found = source_audit.audit(docs, least_docs=6, top_terms=7, digest_bits=bits)
    assert sorted(map(tuple, found.collect())) == plain_audit(rows, 6, 7)


def test_audit_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, source string, text string")
    assert source_audit.audit(empty).collect() == []
