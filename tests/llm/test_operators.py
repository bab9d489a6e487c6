"""Each operator on small tables: nulls, empty texts, ties, repeated rows, clashing columns, against brute force."""

import hashlib
import random
import re
import zlib
from io import BytesIO

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetsift.llm import licenses, ngram_join, quality_classifier, quality_rules, sentencepiece_codec
from fleetsift.llm.components import connected_components
from fleetsift.llm.mixing import mix
from fleetsift.llm.ngram_join import jaccard_join, one_of_each
from fleetsift.llm.sharding import assign_shards
from fleetsift.llm.url_filters import judge_urls
from fleetsift.llm.vector_join import vector_join
from fleetsift.llm.warc_archive import frames, parsed, read_archives, write_archives

DOCS = "doc_id bigint, text string, lang string, source string, block long, rep string"
SPACE = "[\x20\x09-\x0d]+"


def corpus(seed=1, n=60):
    """Texts with copies, near copies, nulls and empties; `block` and `rep` clash with inner names."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 5, 40, 120])))
        rows.append((k, text, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "b", None]), k, "x"))
        if k % 5 == 0:
            near = text.split(" ")
            near[len(near) // 2] = "changed"
            rows.append((1000 + k, " ".join(near), "en", "a", k, "x"))
            rows.append((2000 + k, text, "en", "a", k, "x"))
    rows += [(None, rows[0][1], None, None, 1, "x"), (5000, None, "en", "b", 1, "x"), (5001, "", None, "a", 1, "x"), rows[3], rows[3]]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).cache()


def shingles(text):
    w = [x for x in re.split(SPACE, text or "") if x]
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (2, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)}


def test_jaccard_join(spark, docs):
    rows = docs.collect()
    sets = [shingles(r.text) for r in rows]

    def linked(i, j):
        return bool(sets[i]) and bool(sets[j]) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    root = groups(len(rows), linked)
    want = []
    for i, r in enumerate(rows):
        ids = [rows[j].doc_id for j in range(len(rows)) if root[j] == root[i] and rows[j].doc_id is not None]
        links = sum(linked(i, j) for j in range(len(rows)) if j != i)
        want.append((r.doc_id, links, min(ids, default=None)))
    joined = jaccard_join(docs)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.doc_id, r.n_links, r.class_id) for r in joined.collect()), key=key) == sorted(want, key=key)
    kept = one_of_each(docs, joined).collect()
    classes = {root[i] for i in range(len(rows)) if sets[i]}
    assert len(kept) == len(classes) + sum(not s for s in sets)
    assert jaccard_join(docs.limit(0)).count() == 0


def test_dense_group_of_near_copies(spark):
    """A bucket larger than those compared by brute force, and clusters of several blocks."""
    base = [f"t{k}" for k in range(200)]
    rows = [(k, " ".join(base[:20] + [f"own{k}"] + base[20:])) for k in range(700)]
    got = jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r.n_links, r.class_id) for r in got} == {(699, 0)}


def test_links_beside_a_large_group_of_near_copies(spark):
    """Chains group - X - Y: X is near the group without a link to it, Y is linked to X and not near the group."""
    base, rows, chains = [f"t{k}" for k in range(204)], [], 600
    rng = random.Random(5)
    for k in range(1000):
        at = rng.randrange(200)
        rows.append((k, " ".join(base[:at] + [f"own{k}"] + base[at + 1:])))
    for k in range(chains):
        x = base.copy()
        at = rng.randrange(0, 90)
        x[at:at + 25] = [f"x{k}-{i}" for i in range(25)]
        y = x.copy()
        at = rng.randrange(120, 180)
        y[at:at + 17] = [f"y{k}-{i}" for i in range(17)]
        rows += [(10_000 + k, " ".join(x)), (20_000 + k, " ".join(y))]
    one, two, group = (shingles(dict(rows)[k]) for k in (10_000, 20_000, 0))
    assert 0.8 <= len(one & two) / len(one | two) < 0.82 and len(one & group) / len(one | group) < 0.77
    got = {r.doc_id: r for r in jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [k for k in range(chains) if got[20_000 + k].class_id != got[10_000 + k].class_id or not got[20_000 + k].n_links] == []


def _rows_at_pivots(monkeypatch):
    """Fills a list with the rows that meet a pivot, a number for each level of the join."""
    met, real = [], ngram_join.written

    def counted(df, purpose):
        out = real(df, purpose)
        if purpose == "compared":
            met.append(out.count())
        return out
    monkeypatch.setattr(ngram_join, "written", counted)
    return met


def test_texts_that_share_a_passage(spark, monkeypatch):
    """Unlike texts do not go down together by what all of them hold, and links between them are found."""
    passage, rows = [f"p{k}" for k in range(40)], []
    for k in range(1500):
        own = [f"o{k}-{i}" for i in range(60)]
        rows.append((k, " ".join(passage + own)))
        if k < 200:
            rows.append((10_000 + k, " ".join(passage + own[:52] + [f"n{k}-{i}" for i in range(8)])))
    met = _rows_at_pivots(monkeypatch)
    got = {r.doc_id: (r.n_links, r.class_id) for r in jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {k: (int(k % 10_000 < 200), k % 10_000) for k, _ in rows}
    assert sum(met) < len(rows)


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.9])
def test_frequent_tokens_cost_no_pair_its_chance(threshold):
    """Texts that share as few tokens as links are looked for with draw as many of them as without frequent tokens, whichever are frequent."""
    n, factor = ngram_join.TOKENS, 1.5
    least = int(n * threshold - 4 * (n * threshold * (1 - threshold)) ** 0.5)
    for shared in range(least, n + 1):
        one = np.arange(n, dtype=np.uint64) + ngram_join._PLACES
        two = one.copy()
        two[shared:] += np.uint64(1000)
        for times in range(shared + 1):
            for more in (0, n - shared):  # frequent tokens that one text alone has
                frequent = np.sort(np.concatenate([one[:times], one[n - more:]]))
                cuts, _ = ngram_join._cuts(np.stack([one, two]), threshold, factor, frequent)
                drawn = cuts[:, :shared].min(axis=0) / 2.0 ** 64
                assert drawn.sum() >= factor * shared / (threshold * n) - 1e-9, (shared, times, more)


def test_copies_altered_to_various_degrees(spark, monkeypatch):
    """The pivot is a text from the middle of the group: most are near it, and one level is enough."""
    base, rng = [f"t{k}" for k in range(150)], random.Random(8)
    texts = []
    for k in range(1200):
        words = base.copy()
        for at in rng.sample(range(150), rng.randrange(1, 12)):
            words[at] = f"own{k}-{at}"
        texts.append(" ".join(words))
    met = _rows_at_pivots(monkeypatch)
    got = {r.doc_id: r.n_links for r in jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    sets = [shingles(t) for t in texts]
    for k in range(0, 1200, 25):
        assert got[k] == sum(5 * len(sets[k] & s) >= 4 * len(sets[k] | s) for s in sets) - 1
    assert len(met) <= 2


def test_one_id_on_two_texts(spark):
    """Each class keeps one text, also where the same id is the lowest of two classes."""
    one, two = ([f"{x}{k}" for k in range(60)] for x in "ab")
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, " ".join(one + ["more"])), (3, " ".join(two)), (1, " ".join(one)), (None, "alone with no id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    joined = jaccard_join(docs)
    assert {(r.doc_id, r.class_id) for r in joined.collect()} == {(1, 1), (2, 1), (3, 1), (None, None)}
    assert sorted(r.text for r in one_of_each(docs, joined).collect()) == sorted([rows[0][1], rows[1][1], rows[5][1]])


def test_vector_join(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 8))
    rows = [(k, [float(x) for x in base[k % 12] + 0.12 * rng.normal(size=8)], k % 3) for k in range(150)]
    rows += [(500, rows[0][1], 0), (501, rows[0][1], None), (502, None, 1), (503, [0.0] * 8, 1), (504, [float("nan")] * 8, 1),
             (505, [None] + [1.0] * 7, 1), (506, [1.0], 1), (507, [float("inf")] * 8, 2), (508, [], 1), (None, rows[1][1], 1), rows[4]]

    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        return np.array(v) / np.linalg.norm(v)
    units = [unit(r[1]) if r[2] is not None else None for r in rows]

    def linked(i, j):
        a, b = units[i], units[j]
        return a is not None and b is not None and len(a) == len(b) and rows[i][2] == rows[j][2] and float(a @ b) >= 0.93
    root = groups(len(rows), linked)
    want = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        c = min(ids, default=None)
        want.append((r[0], sum(linked(i, j) for j in range(len(rows)) if j != i), c, r[0] == c))
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("unit", F.lit(1)).withColumn("node", F.lit("x"))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, vector_join(df).collect()), key=key) == sorted(want, key=key)
    assert sum(r[1] for r in want) > 100
    assert vector_join(df.limit(0)).count() == 0


def test_shards(spark, docs):
    rows = assign_shards(docs).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in rows) == sorted((d.doc_id or -1, size(d.text), zlib.crc32((d.text or "").encode())) for d in docs.collect())
    held, largest = {}, max(r["size"] for r in rows)
    for r in rows:
        held.setdefault(r["shard"], []).append(r)
    mean = sum(r["size"] for r in rows) / 16
    assert set(held) == set(range(16))
    for part in held.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
        assert abs(sum(r["size"] for r in part) - mean) <= largest + 1
    assert assign_shards(docs.limit(0)).count() == 0


def test_mix_meets_targets(spark, docs):
    aims = {"source": [("a", 0.3), ("b", 0.7)], "lang": [("en", 0.5), ("fr", 0.25), (None, 0.25)], "topic": [("short prose", 1.0)]}
    targets = {m: spark.createDataFrame(v, "value string, target double") for m, v in aims.items()}
    rows = mix(docs, targets=targets).collect()
    assert len(rows) == docs.count()
    cells = {(r["source"], r["lang"], r["topic"]): r["weight"] for r in rows if r["tokens"]}
    for at, m in enumerate(("source", "lang")):
        for value, target in aims[m]:
            assert sum(w for c, w in cells.items() if c[at] == value) == pytest.approx(target, abs=1e-6)
    assert all(0 <= r["probability"] <= 1 for r in rows)
    assert max(r["probability"] for r in rows) == pytest.approx(1)
    assert not any(r["kept"] for r in rows if r["source"] is None)
    assert mix(docs.limit(0)).count() == 0


RULES = [("org/", "org", "/", "allow"), ("example.org/es/", "example.org", "/es/", "block"), ("example.org/es/a", "example.org", "/es/a", "allow"),
         ("com/fr/", "com", "/fr/", "allow"), ("Shop.COM", "Shop.COM", "", "block"), (None, "net", "/", "block")]


def test_an_id_in_two_cells_has_one_draw(spark):
    rows = [(k % 200, "one two three", "ab"[k // 200], "en") for k in range(400)] + [(900 + k, "one two three", "b", "en") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    chance, kept = {}, {}
    for r in mix(docs).collect():
        chance[r.doc_id, r.source], kept[r.doc_id, r.source] = r.probability, r.kept
    twice = [(kept[k, "a"], kept[k, "b"]) for k in range(200)]
    assert chance[0, "a"] > chance[0, "b"] and all(a or not b for a, b in twice) and any(a != b for a, b in twice)


def test_urls(spark):
    rng = random.Random(2)
    urls = [None, "", "no scheme", "x://", "http://ORG", "http://a.org/", "https://example.org/es/abc?x://y", "http://notexample.org/es/", "http://www.example.org/es/b#c",
            "http://shop.com?q", "http://a.shop.com/fr/x", "http://shop.com\n/x", "http://..org/a", "http://été.example.org/es/a\x01"]
    urls += [f"http://{rng.choice(['', 'www.', 'a.b.'])}{rng.choice(['example.org', 'shop.com', 'org', 'x.net'])}/{rng.choice(['es/', 'es/a', 'fr/', ''])}{rng.randrange(9)}" for _ in range(300)]
    pages = spark.createDataFrame([(k if k % 50 else None, u, "x") for k, u in enumerate(urls)] + [(7, urls[7], "x")] * 2, "page_id bigint, url string, rule string")
    rules = spark.createDataFrame(RULES, "rule string, host string, path string, verdict string")
    want = []
    for r in pages.collect():
        rest = r.url.split("://", 1)[1] if r.url and "://" in r.url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [x for x in RULES if None not in x and (host == x[1].lower() or host.endswith("." + x[1].lower())) and path.startswith(x[2])]
        best = max(fits, key=lambda x: len(x[1] + x[2]), default=(None, "", "", "allow"))
        want.append((r.page_id or -1, host, path, best[0] or "", best[3]))
    got = [(r.page_id or -1, r.host, r.path, r.rule or "", r.verdict) for r in judge_urls(pages, rules, ranges=8).collect()]
    assert sorted(got) == sorted(want)
    assert judge_urls(pages.limit(0), rules).count() == 0


def test_warc(spark, tmp_path):
    long = "<p>é" * 600
    rows = [(k, f"http://h/{k}", long if k % 3 == 0 else f"{k} " * k) for k in range(1, 60)]
    rows += [(90, None, None), (91, "http://h/ a\r\nb", ""), (None, "u", long), (92, "u", "x" * 999), (93, "u", "x" * 999), (60, "u", long), (60, "u", long)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash"))
    manifest = write_archives(pages, str(tmp_path / "w"))
    got = read_archives(manifest).collect()
    assert all(r.error is None for r in got)
    want = []
    for k, _, html in rows:
        data = (html or "").encode()
        same = [x[0] for x in rows if (x[2] or "") == (html or "") and x[0] is not None]
        revisit = len(data) >= 1000 and k != max(same)
        want.append((k or -1, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else -1))
        if not revisit:
            assert data in {r.payload and bytes(r.payload) or b"" for r in got if r.page_id == k}
    assert sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in got) == sorted(want)
    data = open(manifest.first()["archive"].removeprefix("file://"), "rb").read()
    assert data[:4] == bytes.fromhex("5d2a4d18")
    assert list(frames(BytesIO(data[:-3])))[-1] == (None, "the last frame is cut off")
    good = next(iter(frames(BytesIO(data))))[0]
    for broken in (good[:-1], good.replace(b"Content-Length: ", b"Content-Length: 1", 1), good.replace(b"WARC/1.1", b"WORC/1.1"), good.replace(b"WARC-Date", b"WARC-Dote"), b""):
        assert parsed(broken)["error"]
    assert read_archives(write_archives(pages.limit(0), str(tmp_path / "e"))).count() == 0


def test_quality_measures(spark, docs):
    extra = [(1, "a b c d e\n \na b c d e\r\nx#y |é\u00a0z"), (2, "one two three four five " * 30), (3, "\n\n"), (4, None), (5, "A " * 3)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id bigint, text string")).withColumn("n_lines", F.lit("clash"))
    for r in quality_rules.measured(df.drop("n_lines")).collect():
        w = [x for x in re.split(SPACE, r.text or "") if x]
        seen = {}
        for i in range(len(w) - 4):
            seen.setdefault(tuple(w[i:i + 5]), []).append(i)
        covered = {k for at in seen.values() if len(at) > 1 for i in at for k in range(i, i + 5)}
        lines = [x for x in (r.text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r.text or ""), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))


def test_quality_rules_keep_the_callers_columns(spark):
    rows = [(1, "keep", "r", "a b c d e f g h i j k l", True, "w"), (2, "me", None, None, False, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_lines string, rule string, text string, kept boolean, _words string")
    judged = quality_rules.judge(df, [])
    assert judged.columns == [*df.columns, *quality_rules.MEASURED, "base_failed", "rule", "kept"]
    got = sorted(map(tuple, judged.collect()))
    assert [r[:6] for r in got] == rows and [r[6] for r in got] == [12, 0] and [r[-1] for r in got] == [True, False]


def test_quality_rules_learn_thresholds(spark):
    rng = random.Random(4)
    plain = lambda k: " ".join(f"word{rng.randrange(900)}" for _ in range(30 + k % 9))
    rows = [(k, plain(k) + ("".join(f" s{rng.randrange(900)}#$" for _ in range(9)) if k % 3 == 0 else "")) for k in range(300)]
    docs = spark.createDataFrame(rows + [(400, None), (401, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(300)] + [(None, 1), (7, None)], "doc_id bigint, quality int")
    rules = quality_rules.train(docs, labels)
    assert rules
    kept = {r.doc_id for r in quality_rules.judge(docs, rules).where("kept").collect()}
    assert kept == {k for k in range(300) if k % 3}
    assert quality_rules.train(docs, labels.limit(0)) == []


def test_quality_classifier_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    ratings = quality_classifier.grades(labels)
    fit, held = ratings.where("doc_id % 3 <> 0"), ratings.where("doc_id % 3 = 0")
    model = quality_classifier.train(docs, fit)
    rows = quality_classifier.score(docs, model, 2).join(held, "doc_id").collect()
    clean, junk = [r.kept for r in rows if r.grade == 2], [r.kept for r in rows if r.grade == 0]
    assert np.mean(clean) > 0.9 and np.mean(junk) < 0.3
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id bigint, text string")
    assert [r.kept for r in quality_classifier.score(odd, model, 2).collect()] == [False] * 3
    assert quality_classifier.score(odd, None, 2).where("kept").count() == 3
    assert quality_classifier.score(odd.limit(0), model, 2).count() == 0


def test_quality_classifier_rare_composed_words(spark):
    """A rare language whose toxic texts share only how their words begin; each word is in too few texts to be learned."""
    rng = random.Random(9)
    syllables = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in "lnrs"]
    word = lambda start="": start + "".join(rng.choice(syllables) for _ in range(2))
    common = [word() for _ in range(300)]
    rows = [(k, " ".join(rng.choices(common, k=60)), 2) for k in range(1_500)]
    rows += [(2_000 + k, " ".join(rng.choices(common, k=60) + ["scum"]), 1) for k in range(100)]
    rows += [(3_000 + k, " ".join(word() for _ in range(60)), 2) for k in range(60)]
    rows += [(4_000 + k, " ".join([word() for _ in range(57)] + [word("zuchten") for _ in range(3)]), 1) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, grade int")
    model = quality_classifier.train(docs, docs.where("doc_id % 2 = 0").select("doc_id", "grade"))
    kept = {r.doc_id: r.kept for r in quality_classifier.score(docs.where("doc_id % 2 = 1"), model, 2).collect()}
    assert sum(not kept[k] for k in range(4_001, 4_030, 2)) > 12
    assert np.mean([kept[k] for k, _, grade in rows if k % 2 and grade == 2]) > 0.99


PATH = "/opt/tokenizers/piece_bpe_32k.model"


def best_sum(model, text):
    """Plain dynamic programme over all pieces that match at each place."""
    score = {p: s for p, (_, s, _) in ((p, model.automaton.get(p)) for p in model.automaton)}
    best = [0.0] + [-1e18] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 48), end):
            if text[start:end] in score:
                best[end] = max(best[end], best[start] + score[text[start:end]])
        if text[end - 1] not in score:
            best[end] = max(best[end], best[end - 1] + model.uncovered)
    return best[-1]


def test_sentencepiece(spark, docs):
    model = sentencepiece_codec.load_model(spark, PATH)
    own = sentencepiece_codec.Model(model.data).prepare()
    texts = ["", " ", "  two  spaces ", "a\nb\r\n\tc", "été 𐍈 \x00", "thonanntion of the", "\n", "x" * 300, "<unk></s><0x41>", "日本語 text", "é" * 40]
    for text in texts:
        marked = sentencepiece_codec.MARK + text.replace(" ", sentencepiece_codec.MARK)
        ids = own.encode(text)
        assert own.decode(ids) == text
        if text:
            scores = {i: s for _, s, i in own.automaton.values()}
            total = sum(scores[i] for i in ids.tolist() if i in scores) + own.uncovered * sum(c not in own.alphabet for c in marked if c not in "".join(own.pieces[i] for i in ids.tolist() if i in scores))
            assert total == pytest.approx(best_sum(own, marked))
    rows = sentencepiece_codec.encode(docs.withColumn("piece_ids", F.lit("clash")), model, checked_col="ok")
    assert rows.columns == ["doc_id", "text", "lang", "source", "block", "rep", "piece_ids", "ok"] or set(rows.columns) >= {"piece_ids", "ok"}
    for r in rows.collect():
        assert (r.piece_ids is None) == (r.text is None) and r.ok is not False
    back = rows.select("text", sentencepiece_codec.decode(F.col("piece_ids"), model, spark).alias("back")).collect()
    assert all(r.text == r.back for r in back)
    assert own.decode(own.encode("a▁b")) == "a b"


def test_licenses(spark):
    plain = [(k, " ".join(f"w{(k * 7 + j) % 300}" for j in range(30)) + "\nthe other line of it") for k in range(120)]
    stated = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.",
              "This work is licensed under the GNU General Public License, version 3.", "Licensed under the CC BY-SA 4.0 license"]
    want = ["Apache-2.0", "MIT", "CC-BY-NC-4.0", "GPL-3.0", "CC-BY-SA-4.0"]
    rows = plain + [(1000 + k, f"some words first\n{s}\nlast") for k, s in enumerate(stated)] + [(2000, "All rights reserved."), (2001, None), (2002, ""), (None, stated[1]), (1001, plain[0][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("family", F.lit("clash"))
    model = licenses.train(docs)
    got = licenses.scan(docs, model).collect()
    found = {r.doc_id: (r.family, r.confirmed, r.paragraph) for r in got}
    assert found == {1000 + k: (f, True, 1) for k, f in enumerate(want)} | {2000: ("unknown", False, 0), None: ("MIT", True, 0)}
    assert licenses.scan(docs.limit(0), model).count() == 0


def test_wrapped_licence_notices(spark):
    """A notice wrapped over lines is one row, under its first line; notices in lines of their own stay apart."""
    prose = "\n".join(f"The river {k} was calm and the boats of the town went out early" for k in range(40))
    mit = ["Permission is hereby granted, free of charge, to any person", "obtaining a copy of this software and associated", "documentation files"]
    two = ["Released under the MIT License", "Licensed under the Apache License, Version 2.0"]
    rows = [(k, prose) for k in range(30)] + [(100, "\n".join(["Story", "", *mit, "", "End"])), (None, "\n".join(mit)), (101, "\n".join(two)), (102, " ".join(mit)), (103, "\n\n")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = licenses.train(docs)
    got = sorted((r.doc_id or 0, r.paragraph, r.family, r.confirmed) for r in licenses.scan(docs, model).collect())
    assert got == [(0, 0, "MIT", True), (100, 2, "MIT", True), (101, 0, "MIT", True), (101, 1, "Apache-2.0", True), (102, 0, "MIT", True)]
