"""Each operator against a brute-force version on a small table of awkward rows, and on an empty one."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.llm import attention_mil, common, components, context_tree, decontaminate, license_scan, minhash, packing, quality_rules, substring_dedup, suffix_dedup, url_filter

UP = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
RNG = np.random.default_rng(0)
WORDS = ["w" + "".join(RNG.choice(list("aeioukß"), 4)) for _ in range(300)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def rows():
    base, passage = prose(120, 1), prose(60, 2)
    near = base.split()
    near[5] = "CHANGED"
    long = prose(9000, 3)
    return [
        (1, base), (2, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "one"), (7, " \n\t"), (8, prose(80, 4) + "\n" + passage),
        (9, passage + "\nReleased under the MIT License. " + prose(30, 5)), (10, long), (11, passage[:70]), (12, "é" * 60 + " ü " + "é" * 60), (13, "é" * 60 + " ö " + "é" * 60),
        (14, "same line here now\n" * 6 + "Tail of it ### $$"), (15, prose(40, 6).upper() + "!!"), (None, base), (16, "a b c a b c a b c"), (17, "x"), (18, "x"),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    extra = {"lang": "en", "key": "k", "row": 1, "id": 2, "label": 0, "bucket": 3, "h": 4, "n": 5, "words": "w", "block": 6, "source": None, "_text": "t"}
    return df.withColumns({k: F.lit(v) for k, v in extra.items()}).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def brute(rows_, unit, window):
    first = {}
    key = lambda d: -(1 << 63) if d is None else d
    texts = [(d, unit(t)) for d, t in rows_]
    for d, u in texts:
        for j in range(len(u) - window + 1):
            w = u[j : j + window]
            first[w] = min(first.get(w, 1 << 62), key(d))
    out = []
    for d, u in texts:
        gone = [False] * len(u)
        for j in range(len(u) - window + 1):
            if first[u[j : j + window]] < key(d):
                gone[j : j + window] = [True] * window
        out.append((d, u, gone))
    return out


def test_suffix_dedup(docs, none):
    got = suffix_dedup.remove_repeats(docs).collect()
    want = brute(rows(), lambda t: (t or "").encode(), 50)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == Counter(
        (d, len(u), sum(g), sum(1 for i in range(len(g)) if g[i] and not (i and g[i - 1])), bytes(b for b, x in zip(u, g) if not x)) for d, u, g in want
    )
    assert {r["_text"] for r in got} == {"t"} and sum(r["text"] is None for r in got) == 1
    whole = suffix_dedup.remove_repeats(docs, whole_characters=True).filter("doc_id = 13").first()
    assert whole["n_removed"] % 2 == 0 and bytes(whole["kept"]).decode()
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_substring_dedup(docs, none):
    got = substring_dedup.remove_passages(docs).collect()
    want = brute(rows(), lambda t: tuple((t or "").encode().split()), 13)
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"])) for r in got) == Counter((d, len(u), sum(g), b" ".join(w for w, x in zip(u, g) if not x)) for d, u, g in want)
    assert substring_dedup.remove_passages(none).count() == 0


def sets(size):
    out = []
    for d, t in rows():
        w = (t or "").encode().translate(UP).split()
        out.append((d, {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()))
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, none, size):
    own = sets(size)
    key = lambda d: -(1 << 63) if d is None else d
    part = list(range(len(own)))
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(own):
            for j, (_, b) in enumerate(own):
                if a and b and 100 * len(a & b) >= 80 * len(a | b) or i != j and own[i][0] == own[j][0]:
                    if part[i] != part[j]:
                        part[i] = part[j] = min(part[i], part[j])
                        changed = True
    low = {p: min((key(own[i][0]) for i in range(len(own)) if part[i] == p)) for p in set(part)}
    want = Counter((d, len(s), None if low[part[i]] == key(None) else low[part[i]], low[part[i]] == key(d)) for i, (d, s) in enumerate(own))
    got = minhash.near_duplicates(docs, size).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == want
    assert minhash.near_duplicates(none, size).count() == 0


def test_near_duplicates_store_what_is_read_again(spark, tmp_path, monkeypatch):
    """Each table written starts processes for its files and folders: none is written but those read more than once and the groups' smallest rows."""
    monkeypatch.setattr(common, "shared_dir", lambda spark, what: f"file://{tmp_path}/{what}-{next(number)}")
    number, written = itertools.count(), Counter()

    def stored(df, what):
        written[what] += 1
        return common.stored(df, what)

    monkeypatch.setattr(minhash, "stored", stored)
    monkeypatch.setattr(components, "stored", stored)
    texts = [prose(50, 300 + i % 12) + " one more" * (i // 12) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in minhash.one_of_each(df, 2).collect()) == list(range(12))
    rounds = written.pop("labels")
    assert rounds <= 6
    assert written == Counter(signatures=1, classes=1, members=1, sets=1, links=2, placed=1, named=1, least=1, kept=1)
    left = [f for f in tmp_path.rglob("*") if f.is_file()]
    assert not [f for f in left if f.name == "_SUCCESS"]
    assert {f.parent.name.rpartition("-")[0] for f in left} == {"signatures", "named", "least", "kept"}


def test_clusters_lose_no_link(spark):
    """A chain of texts in which neighbours are similar enough and others aren't, and a star around a text of no link."""
    words = prose(400, 9).split()
    chain = []
    for i in range(30):
        words[7 * i : 7 * i + 7] = prose(7, 100 + i).split()
        chain.append((i, " ".join(words)))
    loose = [(100 + i, " ".join(prose(200, 11).split()[: 160 - i] + prose(40 + i, 200 + i).split())) for i in range(25)]
    df = spark.createDataFrame(chain + loose, "doc_id long, text string")
    own = {d: {tuple(w) for w in zip(t.split(), t.split()[1:])} for d, t in chain + loose}
    label = {d: d for d in own}
    for _ in own:
        for a in own:
            for b in own:
                if 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, 2).collect()}
    assert got == label


def test_quality_rules(docs, none):
    got = quality_rules.judge_quality(docs).collect()
    want = []
    for d, t in rows():
        words = [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]
        count = Counter(zip(words, words[1:], words[2:]))
        hit = set()
        for i, w in enumerate(zip(words, words[1:], words[2:])):
            if count[w] > 1:
                hit |= {i, i + 1, i + 2}
        lines = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
        want.append((d, len(words), sum(map(len, words)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert Counter(tuple(r[n] for n in names) for r in got) == Counter(want)
    assert all(not (r["kept"] and r["base_failed"]) and 0 <= r["quality"] <= 1 for r in got)
    assert quality_rules.judge_quality(none).count() == 0


def test_estimate_separates_good_from_bad():
    rng = np.random.default_rng(4)
    votes = []
    for _ in range(3000):
        good = rng.random() < 0.7
        votes.append((good, tuple(0 if rng.random() < 0.3 else (1 if (rng.random() < 0.85) == good else -1) for _ in range(7))))
    posterior = quality_rules.estimate(sorted(Counter(v for _, v in votes).items()))
    right = np.mean([(posterior[v] > 0.5) == good for good, v in votes])
    assert right > 0.93


def test_context_tree(docs, none):
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    from loomframe.llm.common import fold

    got = context_tree.score_texts(docs.withColumn("train", fold() != 1), F.col("train")).collect()
    tokens = [(d, (t or "").encode().translate(UP).split() + [None]) for d, t in rows()]
    count = Counter(w for d, own in tokens if not held(d) for w in own)
    n, v = sum(count.values()), len(count)
    want = sorted((str(d), len(own), sum(count[w] > 0 for w in own), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), 5)) for d, own in tokens)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert {r["doc_id"]: r["n_coded"] for r in got}[12] == len(("é" * 60 + " ü " + "é" * 60).encode()) + 1
    assert context_tree.score_texts(none, F.lit(True)).count() == 0


def plain_tree(train, text, depth):
    """Context-tree weighting by the definition, over lists of (context, bit path) counts."""
    edge = bytes([context_tree.EDGE])
    counts = Counter()
    for t in train:
        wide = edge * depth + t + edge
        for i in range(depth, len(wide)):
            for d in range(depth + 1):
                for b in range(8):
                    counts[wide[i - d : i], b, wide[i] >> (8 - b), (wide[i] >> (7 - b)) & 1] += 1
    contexts = {k[0] for k in counts}

    def kt(s, b, q):
        a, c = counts[s, b, q, 0], counts[s, b, q, 1]
        return math.lgamma(a + 0.5) + math.lgamma(c + 0.5) - math.log(math.pi) - math.lgamma(a + c + 1), (c + 0.5) / (a + c + 1)

    def weighted(s, b, q):
        e = kt(s, b, q)[0]
        return e if len(s) == depth else np.logaddexp(e, below(s, b, q)) - math.log(2)

    def below(s, b, q):
        return sum(weighted(c, b, q) for c in contexts if len(c) == len(s) + 1 and c.endswith(s))

    def one(s, rest, b, q):
        e, p = kt(s, b, q)
        if len(s) == depth:
            return p
        share = 1 / (1 + math.exp(below(s, b, q) - e))
        return share * p + (1 - share) * one(rest[len(rest) - len(s) - 1 :], rest, b, q)

    wide, out = edge * depth + text + edge, 0.0
    for i in range(depth, len(wide)):
        for b in range(8):
            p = one(b"", wide[i - depth : i], b, wide[i] >> (8 - b))
            out += math.log10(p if (wide[i] >> (7 - b)) & 1 else 1 - p)
    return out


def test_context_tree_is_the_definition(spark):
    train, texts = ["abab ba", "abba"], ["abab", "zé", ""]
    df = spark.createDataFrame([(i, t, i < 2) for i, t in enumerate(train + texts)], "doc_id long, text string, train boolean")
    got = {r["doc_id"]: r["score"] for r in context_tree.score_texts(df, F.col("train")).collect()}
    for i, t in enumerate(texts):
        want = plain_tree([x.encode() for x in train], t.encode(), context_tree.DEPTH)
        assert got[i + 2] == pytest.approx(want, abs=1e-5)


def test_url_filter(spark, tmp_path):
    urls = ["http://a.example.com/en/71?x", "https://example.com/en/8", "http://NET/de/1", "x://m.example.net/de/8#t", "http://example.org/es/", "nothing", None, "http://com/en", "http://xcom/en/", "://example.com/en/7", "http://org?/es/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("r")).withColumn("key", F.lit(1))
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.filter_urls(df).collect()}
    want = {}
    for i, u in enumerate(urls):
        rest = u.partition("://")[2] if u and "://" in u else ""
        rest = re.split("[?#]", rest)[0]
        host, slash, path = rest.partition("/")
        host, path = host.lower(), slash + path
        fit = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fit, key=lambda x: len(x[0]), default=(None, "allow"))
        want[i] = (host, path, rule, verdict)
    assert got == want
    many = [(f"h{i}.example", f"/p{i}", "block" if i % 2 else "allow") for i in range(5000)]
    array = url_filter.DigestArray(url_filter.build(many, str(tmp_path)))
    assert array.find(["h7.example/p7", "h8.example/p8", "h9.example/p"]) == ["block", "allow", None]
    same = url_filter.DigestArray(url_filter.build(many[:2], str(tmp_path)))
    assert url_filter.judge(same, ["deep.h1.example"], ["/p1/x"]) == [("h1.example/p1", "block")]
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_license_scan(docs, none):
    got = license_scan.scan_licenses(docs).collect()
    for r in got:
        texts = [t or "" for d, t in rows() if d == r["doc_id"]]
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", texts[0].encode().translate(UP).decode())
        at = [i for p, _ in license_scan.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(at), min(at, default=None), max(at, default=None))
    nine = next(r for r in got if r["doc_id"] == 9)
    assert nine["base_labels"] == "mit" and "mit" in nine["labels"].split(",") and 0.9 < nine["score"] <= 1
    assert license_scan.scan_licenses(none).count() == 0
    assert len(license_scan.rules()) > 300
    found = license_scan.detect("licensed under the apache license version 2 0 or the mit license")
    assert [r.label for _, _, r in found] == ["apache", "mit"]
    assert license_scan.scan(b"SPDX-License-Identifier: MPL-2.0")[5] == "mpl"


def test_packing(docs, none):
    tokens = packing.Tokens()
    texts = ["Hello, the world's café 42x!", "<|endoftext|> a <|b", "ªº½ don't\x85stop\u2028now", "ÀÉ ΣΑΣ İ\n\ttab", "中文 字 e\u0301 x\x1cy"]
    for t, ids in zip(texts, tokens.of(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tokens.chunks.model.encode(t, add_special_tokens=False).ids
    got = packing.pack_documents(docs).collect()
    want = []
    for d, t in rows():
        ids = np.array(tokens.chunks.model.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(d, p, 4096 * p, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for p, a in enumerate(range(0, len(ids), 4096))]
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == Counter(want)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 4096
    assert len(by) <= math.ceil(sum(w[3] for w in want) / 4096) + 1
    assert packing.pack_documents(none).count() == 0
    # The rule itself: of all choices the one with the smallest sum of squares.
    lengths = np.random.default_rng(5).integers(1, 21, 200)
    bins, offsets, n = packing.sum_of_squares(lengths, 20)
    level = {}
    for s, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist()):
        gaps = Counter(20 - x for x in level.values() if x < 20)
        costs = {}
        for x in {v for v in level.values() if v + s <= 20} | {0}:
            after = gaps.copy()
            if x:
                after[20 - x] -= 1
            if x + s < 20:
                after[20 - x - s] += 1
            costs[x] = sum(c * c for c in after.values())
        assert o == level.get(b, 0) and costs[o] == min(costs.values())
        level[b] = o + s


def test_decontamination(spark, docs):
    item = "If Anna buys 12 apples and sells 5 km of rope to Bob then how many apples will Anna hold at the end of the day"
    benchmark = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny little item of words"), (5, prose(30, 70))], "item_id long, text string").withColumn("key", F.lit(0))
    changed = item.replace("Anna", "Maria").replace("12", "7")
    broken = item.replace("Anna", "Maria", 1)
    texts = [(1, f"{prose(30, 71)} {item} {prose(20, 72)}"), (2, f"{prose(30, 73)}. {changed}."), (3, prose(200, 74)), (4, None), (5, ""), (6, "a tiny little item of words here"), (7, broken), (8, prose(30, 70).replace(" ", "\n")), (9, "12 13 14 Anna Bob " * 30)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("row", F.lit(3))
    got = {r["doc_id"]: r["items"] for r in decontaminate.decontaminate(df, benchmark).collect()}
    assert got == {1: "1", 2: "1", 6: "4", 8: "5"}
    left = decontaminate.without_contaminated(df, benchmark)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == [3, 4, 5, 7, 9]
    assert decontaminate.decontaminate(df.limit(0), benchmark).count() == 0 == decontaminate.decontaminate(df, benchmark.limit(0)).count()


def test_attention_classifier(spark, docs, none):
    good = [(i, prose(int(RNG.integers(5, 300)), 1000 + i)) for i in range(150)]
    bad = [(1000 + i, " ".join(w + "%%%" for w in prose(int(RNG.integers(5, 300)), 3000 + i).split())) for i in range(50)]
    df = spark.createDataFrame(good + bad + [(5000, None), (5001, "")], "doc_id long, text string").withColumn("label", F.lit("x"))
    labels = spark.createDataFrame([(d, int(d < 1000), 0) for d, _ in good + bad] + [(77777, 1, 0), (5001, None, 0)], "doc_id long, quality int, toxic int")
    model = attention_mil.train(df, labels, F.col("doc_id") % 5 != 0)
    scored = attention_mil.score(df, model)
    assert scored.columns == [*df.columns, "_score"]
    own = {r["doc_id"]: r["_score"] for r in scored.collect()}
    assert len(own) == 202 and all(0 <= s <= 1 for s in own.values())
    assert np.mean([(own[d] >= 0.3) == (d < 1000) for d, _ in good + bad if d % 5 == 0]) > 0.95
    assert attention_mil.train(df, labels.limit(0), F.lit(True)) is None
    assert {r["_score"] for r in attention_mil.score(df, None).collect()} == {0.5}
    assert attention_mil.score(none, model).count() == 0


def test_attention_gradient():
    rng = np.random.default_rng(3)
    x, bag, y = rng.normal(size=(9, attention_mil.FEATURES)), np.array([0, 2, 5, 9]), np.array([0.0, 1, 1])
    m = attention_mil.Model(0, 1)
    loss = lambda: float(-(y * np.log(p := m.forward(x, bag)[0]) + (1 - y) * np.log(1 - p)).mean() + attention_mil.DECAY / 2 * sum((m.w[i] ** 2).sum() for i in (0, 2, 3, 5)))
    for i, g in enumerate(m.gradient(x, bag, y)):
        at = (0,) * m.w[i].ndim
        keep = m.w[i][at]
        m.w[i][at] = keep + 1e-5
        up = loss()
        m.w[i][at] = keep - 1e-5
        down = loss()
        m.w[i][at] = keep
        assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)



def test_decontamination_of_other_cases(spark):
    items = [(1, prose(20, 80)), (2, "Then Anna Lee buys 12 apples and sells 5 km of rope to Bob who asks how many apples she now has left")]
    texts = [(10 * i + k, f"{prose(30, 90 + i)}. {f(t)}. {prose(30, 95 + i)}") for i, t in items for k, f in enumerate((str.upper, str.title, str.lower, str))]
    minor = " ".join(w if w in ("and", "of", "to") else w[0].upper() + w[1:] for w in items[1][1].split())
    df = spark.createDataFrame([*texts, (30, minor), (40, prose(60, 99).upper()), (41, prose(60, 99).title())], "doc_id long, text string")
    for benchmark in (items, [(i, t.upper()) for i, t in items]):
        got = {r["doc_id"]: r["items"] for r in decontaminate.decontaminate(df, spark.createDataFrame(benchmark, "item_id long, text string")).collect()}
        assert got == {d: str(d // 10) for d, _ in texts} | {30: "2"}


def examples(pattern, rng, n=40):
    """Random strings that a regular expression matches."""
    parse = re._parser.parse(pattern)

    def one(items):
        out = []
        for op, arg in items:
            kind = str(op)
            if kind == "LITERAL":
                out.append(chr(arg))
            elif kind == "BRANCH":
                out.append(one(arg[1][rng.integers(len(arg[1]))]))
            elif kind == "SUBPATTERN":
                out.append(one(arg[3]))
            elif kind == "MAX_REPEAT":
                out += [one(arg[2]) for _ in range(rng.integers(arg[0], min(int(arg[1]), arg[0] + 2) + 1))]
            elif kind == "IN":
                c = next((c for c in "2xs" if re.fullmatch(pattern_of(arg), c)), "c")
                out.append(c)
            else:
                assert kind == "AT", kind
        return "".join(out)

    def pattern_of(arg):
        return "|".join({"CATEGORY_DIGIT": r"\d", "CATEGORY_NOT_SPACE": r"\S"}[str(a)] if str(o) == "CATEGORY" else re.escape(chr(a)) if str(o) == "LITERAL" else f"[{chr(a[0])}-{chr(a[1])}]" for o, a in arg)

    return {one(parse) for _ in range(n)}


def test_license_prefilters_lose_no_signature():
    rng = np.random.default_rng(9)
    for r in license_scan.rules():
        for text in examples(r.pattern.pattern, rng):
            assert r.pattern.search(text), text
            assert r.keyword in text and any(stem in f" {text} ".encode() for stem in license_scan.STEMS), text
            assert license_scan.scan(text.encode())[5], text
    for text, label in (("released under the GNU GPL version 3", "gpl"), ("distributed under the terms of the MPL 2.0", "mpl"), ("available under Apache 2.0", "apache"), ("Zero Clause BSD License", "0bsd"), ("licensed under an MIT license", "mit")):
        assert license_scan.scan(text.encode())[5] == label
    assert license_scan.scan(b"he lived under the bridge, available with MIT people")[5] == ""


def test_license_short_names():
    lines = {
        "Licensed under CC BY-NC 4.0.": "cc-by-nc", "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache", "All rights reserved.": "proprietary",
        "This work is licensed under the GNU General Public License, version 3.": "gpl",
    }
    short = {
        "CC BY 4.0": "cc-by", "Text: CC BY-SA 3.0": "cc-by-sa", "licensed under a CC BY-ND 4.0 license": "cc-by-nd", "(CC BY-NC-SA 4.0)": "cc-by-nc-sa", "released under CC-BY-NC-ND": "cc-by-nc-nd", "CC0 1.0": "cc0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": "cc-by-nc-sa", "SPDX-License-Identifier: CC-BY-SA-4.0": "cc-by-sa",
        "SPDX-License-Identifier: EPL-2.0": "epl", "licensed under CDDL 1.0": "cddl", "SPDX-License-Identifier: BSL-1.0": "boost", "under the EUPL license": "eupl", "licensed under the ODbL": "odbl", "MS-PL license": "ms-pl",
    }
    for text, label in (lines | short).items():
        assert license_scan.scan(text.encode())[5] == label, text


def test_decontamination_counts_windows_whose_slots_agree(spark):
    item = f"we pack red boxes for 3 coins each {prose(12, 110)} and blue boxes for 3 coins each {prose(4, 111)}"
    named = f"when Anna goes {prose(16, 112)} then Anna returns with Bob and {prose(6, 113)}"
    benchmark = spark.createDataFrame([(1, item), (2, named)], "item_id long, text string")
    apart = item.replace("3", "5", 1).replace("3", "8")
    texts = [(1, f"{prose(9, 114)} {apart} {prose(9, 115)}"), (2, f"{prose(9, 116)} {named.replace('Anna', 'Maria', 1)} {prose(9, 117)}"), (3, prose(60, 118))]
    got = {r["doc_id"]: (r["items"], r["coverage"]) for r in decontaminate.decontaminate(spark.createDataFrame(texts, "doc_id long, text string"), benchmark).collect()}
    assert {d: i for d, (i, _) in got.items()} == {1: "1", 2: "2"}
    assert got[1][1] == 1.0 and 0.3 <= got[2][1] < 1


def test_decontamination_of_long_and_short_items(spark):
    long = prose(500, 120)
    items = [(1, long), (2, "What is 12 + 35?"), (3, "12 + 35"), (4, "Did Anna Lee meet Bob Ray in Rome, Oslo?")]
    texts = [(1, f"{prose(9, 121)} {' '.join(long.split()[200:300])} {prose(9, 122)}"), (2, f"{prose(9, 123)}. What is 12 + 35? {prose(9, 124)}"), (3, f"{prose(9, 125)}. What is 12 + 36? {prose(9, 126)}")]
    texts += [(4, f"{prose(9, 127)}. {items[3][1]} {prose(9, 128)}"), (5, f"{prose(9, 129)}. Did Anna Lee meet Jim Ray in Rome, Oslo?"), (6, " ".join(long.split()[100:140])), (7, "12 + 35")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r["items"] for r in decontaminate.decontaminate(spark.createDataFrame(texts, "doc_id long, text string"), benchmark).collect()}
    assert got == {1: "1", 2: "2", 4: "4"}


def test_attention_trains_on_every_passage(spark, monkeypatch):
    lengths = [3, 64, 65, 3000, 5129]
    seen = []
    monkeypatch.setattr(attention_mil.Model, "fit", lambda self, x, bag, y: seen.append(np.diff(bag).tolist()))
    df = spark.createDataFrame([(i, prose(n, 130 + i)) for i, n in enumerate(lengths)], "doc_id long, text string")
    attention_mil.train(df, df.select("doc_id", F.lit(1).alias("quality")), F.lit(True))
    assert seen == [[-(-n // attention_mil.PASSAGE) for n in lengths]]


def test_near_duplicates_of_null_and_repeated_ids(spark):
    """Two texts of one id, and two texts without an id that touch the same buckets, keep all their links."""
    a, b, c = prose(200, 140).split(), prose(200, 141).split(), prose(200, 142).split()
    near = lambda w, k: " ".join([*w[:k], "CHANGED", *w[k + 1 :]])
    rows_ = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a, 9)), (3, near(b, 9)), (None, " ".join(c)), (None, near(c, 5)), (7, near(c, 50)), (8, prose(50, 143)), (8, prose(50, 143)), (9, None), (9, None)]
    df = spark.createDataFrame(rows_, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("digest", F.lit("y"))
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, 2).collect())
    assert got == Counter([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (None, None, True), (None, None, True), (7, None, False), (8, 8, True), (8, 8, True), (9, 9, True), (9, 9, True)])
    kept = minhash.one_of_each(df, 2)
    assert kept.columns == df.columns
    left = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert left[8, prose(50, 143)] == 1 and left[9, None] == 2 and sum(left.values()) == 6 and {d for d, _ in left} == {1, None, 8, 9}
    with pytest.raises(ValueError):
        minhash.near_duplicates(df.withColumn("doc_id", F.lit("a")), 2)


def test_hashes_tell_thue_morse_words_apart():
    from loomframe.llm import common, shared_windows

    bits = np.array([bin(i).count("1") % 2 for i in range(2048)])
    data = np.where(np.concatenate([bits, 1 - bits]) > 0, 0x61, 0x62).astype(np.uint8)
    starts, ends = np.array([0, 2048]), np.array([2048, 4096])
    weak = common.Rolling(common.BYTE_CODES[data]).of(starts, ends)
    assert weak[0] == weak[1]  # why such hashes only route
    strong = common.word_hashes(data, starts, ends)
    assert strong[0] != strong[1]
    first, which = shared_windows.content_classes(weak, data, starts, ends - starts)
    assert which.tolist() == [0, 1] and first.tolist() == [0, 1]
    short = [b"a", b"a\0", b"abcdefg", b"abcdefgh", b"x" * 56, b"x" * 57, b"abcdefg", b"x" * 57]
    data = np.frombuffer(b" ".join(short), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in short]) - 1
    own = common.word_hashes(data, ends - [len(w) for w in short], ends)
    assert len(set(own.tolist())) == 6 and own[6] == own[2] and own[7] == own[5]
    a, b = (np.random.default_rng(i).integers(0, common.PRIME, 100, dtype=np.uint64) for i in (1, 2))
    assert [int(x) for x in common.times(a, b)] == [int(x) * int(y) % common.PRIME for x, y in zip(a, b)]


def test_substring_dedup_of_thue_morse_words(spark):
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, two = ("".join("ab"[x ^ y] for x in bits) for y in (0, 1))
    rest = prose(20, 150)
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_passages(spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest}")], "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 20}


def test_passages_keep_clashing_columns_out(spark):
    df = spark.createDataFrame([(1, prose(40, 151), "a", 2), (2, prose(40, 151), "b", 3)], "doc_id long, text string, kept string, n_removed int")
    for remove in (suffix_dedup.remove_repeats, substring_dedup.remove_passages):
        out = remove(df)
        assert len(set(out.columns)) == len(out.columns) and {r["doc_id"]: r["n_removed"] > 0 for r in out.collect()} == {1: False, 2: True}
    assert {r["row"]["kept"] for r in suffix_dedup.repeats(df).collect()} == {"a", "b"}


def test_estimate_is_expectation_maximisation():
    """Against a version that goes over documents one by one, with rules in conflict and one that is mostly wrong."""
    rng = np.random.default_rng(14)
    right = [0.95, 0.9, 0.85, 0.8, 0.8, 0.15, 0.5]
    truth = rng.random(4000) < 0.75
    votes = np.stack([np.where(rng.random(4000) < 0.25, 0, np.where((rng.random(4000) < a) == truth, 1, -1)) for a in right], 1)
    posterior = quality_rules.estimate(sorted(Counter(map(tuple, votes.tolist())).items()))
    own = 1 / (1 + np.exp(-votes.sum(1).astype(float)))
    for _ in range(quality_rules.ROUNDS):
        prior = (own.sum() + 2) / (4000 + 4)
        odds = np.full(4000, math.log(prior / (1 - prior)))
        for j in range(len(right)):
            chance = [((w * (votes[:, j] == 1)).sum() + 2) / ((w * (votes[:, j] != 0)).sum() + 4) for w in (own, 1 - own)]
            odds += np.where(votes[:, j] == 1, math.log(chance[0] / chance[1]), np.where(votes[:, j] == -1, math.log((1 - chance[0]) / (1 - chance[1])), 0))
        own = 1 / (1 + np.exp(-odds))
    got = np.array([posterior[tuple(v)] for v in votes.tolist()])
    assert np.abs(got - own).max() < 1e-6
    accuracy, majority = ((x > 0.5) == truth for x in (got, 1 / (1 + np.exp(-votes.sum(1)))))
    assert accuracy.mean() > 0.95 and accuracy.mean() > majority.mean()
    against = [i for i, v in enumerate(votes) if -1 in v]
    assert (got[against] > 0.5).mean() > 0.5  # one vote against doesn't reject
    assert quality_rules.estimate([]) == {}


def test_decontamination_of_null_and_repeated_rows(spark):
    one, two, three = prose(30, 160), prose(30, 161), prose(30, 162)
    benchmark = spark.createDataFrame([(None, one), (5, two), (5, three), (5, three)], "item_id long, text string")
    wrap = lambda t, i: f"{prose(9, 163 + i)} {t} {prose(9, 173 + i)}"
    texts = [(1, wrap(one, 0)), (2, wrap(two, 1)), (3, wrap(three, 2)), (3, wrap(three, 2)), (3, wrap(three, 2)), (None, wrap(two, 3)), (4, prose(50, 190))]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("number", F.lit(1))
    got = Counter((r["doc_id"], r["items"], r["coverage"]) for r in decontaminate.decontaminate(df, benchmark).collect())
    assert got == Counter([(1, "null", 1.0), (2, "5", 1.0), *[(3, "5", 1.0)] * 3, (None, "5", 1.0)])
    assert [r["doc_id"] for r in decontaminate.without_contaminated(df, benchmark).collect()] == [4]


def test_decontamination_is_the_definition(spark):
    """Lower-case prose has no slots, so that coverage is the share of an item's 8-word windows found on any place."""
    items = [(i, prose(20 + i, 200 + i)) for i in range(6)]
    texts = []
    for d in range(30):
        parts = prose(40, 230 + d).split()
        own = items[d % 6][1].split()
        at, n = int(RNG.integers(0, 8)), int(RNG.integers(8, 22))
        texts.append((d, " ".join(parts[:20] + own[at : at + n] + parts[20:])))
    want = {}
    for d, t in texts:
        w = t.split()
        windows = {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
        cover = {i: np.mean([tuple(x.split()[k : k + 8]) in windows for k in range(len(x.split()) - 7)]) for i, x in items}
        best = max(cover.values())
        if best >= decontaminate.COVERAGE:
            want[d] = (",".join(str(i) for i in sorted(cover) if cover[i] >= decontaminate.COVERAGE), best)
    frames = (spark.createDataFrame(x, f"{k} long, text string") for x, k in ((texts, "doc_id"), (items, "item_id")))
    got = {r["doc_id"]: (r["items"], pytest.approx(r["coverage"])) for r in decontaminate.decontaminate(*frames).collect()}
    assert len(want) > 10 and got == want


def test_url_rules_beyond_one_array(spark):
    rules = [(f"h{i % 50}.example", f"/p{i}", "block" if i % 2 else "allow") for i in range(400)]
    urls = [f"http://www.h{i % 60}.example/p{i}/x?y" for i in range(300)] + [None, "", "http://h1.example/p1", "http://h1.example/p1", "http://h1.example/" + "p" * 100_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    frame = spark.createDataFrame(rules, "host string, prefix string, verdict string")
    want = sorted(map(str, url_filter.filter_urls(df, rules).collect()))
    for own in (rules, frame):
        assert sorted(map(str, url_filter.filter_urls(df, own, max_rules=64).collect())) == want
    assert sorted(map(str, url_filter.filter_urls(df, frame).collect())) == want
    twice = df.unionAll(df)
    assert url_filter.filter_urls(twice, rules, max_rules=64).count() == 2 * len(urls)


def test_license_texts():
    texts = {
        "Licensed under MIT": "mit", "GPL v3": "gpl", "CC0 1.0 Universal": "cc0", "SPDX-License-Identifier: CC-BY-4.0": "cc-by", "released under the Unlicense": "unlicense",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the 'Software'), to deal in the Software without restriction, including without limitation the rights to use": "mit",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "bsd",
        "You may not use this file except in compliance with the License.": "apache", "The origin of this software must not be misrepresented": "zlib", "This is free and unencumbered software released into the public domain.": "unlicense",
    }
    for text, label in texts.items():
        assert license_scan.scan(text.encode())[5] == label, text


def test_license_suppression_is_the_rule():
    """Against the rule taken literally: by priority, length and place, no place inside a kept one or over a higher one."""
    rng = np.random.default_rng(31)
    parts = ["released under the mit license", "gpl v3", "licensed under the apache license version 2 0", "mit", "gnu general public license", "all rights reserved", "licensed under cc by nc 4 0", "copyright 2020", "license"]
    for _ in range(60):
        text = " ".join(rng.choice(parts, 12))
        found = [(r.priority, m.end() - m.start(), -m.start(), -i, r, m) for i, r in enumerate(license_scan.rules()) if r.keyword in text for m in r.pattern.finditer(text)]
        kept = []
        for priority, _, _, _, r, m in sorted(found, key=lambda x: x[:4], reverse=True):
            s, e = m.span()
            if not any((a <= s and e <= b and k.priority == priority) or (s < b and a < e and priority < k.priority) for a, b, k in kept):
                kept.append((s, e, r))
        assert license_scan.detect(text) == sorted(kept, key=lambda x: x[:2])
    long = b"Released under the MIT License. " * 20_000
    n, base, first, last, *_ = license_scan.scan(long)
    assert (n, base, first, last) == (100_000, 20_000, 3, 99_998)


def test_attention_is_the_definition():
    """The forward pass against sums written out passage by passage."""
    rng = np.random.default_rng(5)
    x, bag = rng.normal(size=(7, attention_mil.FEATURES)), np.array([0, 1, 4, 7])
    m = attention_mil.Model(0, 1)
    w, b, v, u, g, o, c = m.w
    want = []
    for i in range(3):
        hidden = [np.tanh(row @ w + b) for row in x[bag[i] : bag[i + 1]]]
        energy = [math.exp(sum(g[k] * math.tanh(h @ v[:, k]) / (1 + math.exp(-(h @ u[:, k]))) for k in range(len(g)))) for h in hidden]
        z = sum(e / sum(energy) * h for e, h in zip(energy, hidden))
        want.append(1 / (1 + math.exp(-(z @ o + c[0]))))
    assert m.forward(x, bag)[0] == pytest.approx(want)


def test_attention_learns_words(spark):
    """Labels that no count of characters gives away: bad texts use other words of the same letters."""
    vocabulary = np.array(WORDS)
    text = lambda own, n, seed: " ".join(np.random.default_rng(seed).choice(own, n))
    rows_ = [(i, text(vocabulary[:150] if i % 3 else vocabulary[150:], 40 + 97 * i % 400, 400 + i)) for i in range(360)] + [(5000, prose(20_000, 7))]
    df = spark.createDataFrame(rows_, "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(d % 3 > 0)) for d, _ in rows_[:-1]] + [(1, 0)], "doc_id long, quality int")
    model = attention_mil.train(df, labels, F.col("doc_id") % 5 != 0)
    own = {r["doc_id"]: r["_score"] for r in attention_mil.score(df, model).collect()}
    assert np.mean([(own[d] >= 0.5) == (d % 3 > 0) for d, _ in rows_[:-1] if d % 5 == 0]) > 0.9
    with pytest.raises(ValueError):
        attention_mil.score(df.withColumn("_score", F.lit(0)), model)


def test_packing_deals_out_rows_without_an_id(spark):
    df = spark.createDataFrame([(None, prose(30, 300 + i)) for i in range(200)], "doc_id long, text string")
    pieces = packing.token_pieces(df)
    packed_ = packing.pack(pieces, 8).collect()
    assert len(packed_) == 200 and len({r["sequence_id"] % 8 for r in packed_}) == 8
