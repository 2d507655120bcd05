"""Rules, fingerprints, near duplicates, shards, licences and classifiers on small tables."""

from __future__ import annotations

import hashlib
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from skuflow.llm import (
    components, document_prints, licenses, line_quality, near_dedup, quality_rules, sharding, toxicity,
)
from skuflow.llm.license_texts import SPELLINGS, TITLES
from skuflow.llm.license_texts import TEXTS as LICENSES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _base(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)), len(covered),
    )


def test_rules_base_counts(docs, none):
    features = quality_rules.measured(docs, ["doc_id", "lang", "text"])
    rows = quality_rules.judged(features, quality_rules.references(features)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        n, chars, symbols, dup, rep = _base(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            n, chars, symbols, dup, rep)
        assert r["base_failed"] == (n < 50 or 100 * rep > 50 * n)
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.passing(docs).columns == docs.columns
    assert quality_rules.passing(none).count() == 0


def _votes(terms):
    total, sums = 0, [0] * 64
    for term, weight in terms:
        h = xxhash.xxh64_intdigest(term.encode(), seed=42)
        total += weight
        for k in range(64):
            sums[k] += weight * (h >> k & 1)
    return sum(1 << k for k in range(64) if 2 * sums[k] > total)


def _fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if len(words) < 3:
        shingles = [" ".join(words)] if words else []
    else:
        shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)]
    return _votes([(s, 1) for s in shingles]) if shingles else 0


def test_near_duplicates(docs, none):
    rows = near_dedup.near_duplicates(docs).collect()
    want = sorted(_fingerprint(r["text"]) for r in docs.collect())
    assert sorted(r["fp"] & (1 << 64) - 1 for r in rows) == want
    groups: dict[int, list] = {}
    for r in rows:
        groups.setdefault(r["component_id"], []).append(r["doc_id"])
    assert min(i for i in groups[0] if i is not None) == 0 and groups[0].count(0) == 2
    kept = near_dedup.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert near_dedup.near_duplicates(none).count() == 0


def test_links_connect_as_all_pairs_do(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 64)
    pick = random.Random(1)
    prints = set()
    for _ in range(60):  # chains and balls of near fingerprints, and single ones
        x = pick.getrandbits(64)
        prints.add(x)
        for _ in range(pick.choice([0, 0, 3, 40])):
            for _ in range(pick.randint(1, 3)):
                x ^= 1 << pick.randrange(64)
            prints.add(x)
    hub = pick.getrandbits(64)
    prints |= {hub ^ (1 << a) ^ (1 << b) for a in range(24) for b in range(24)}
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = components.components(near_dedup.links(df)).collect()
    root = {r["node"]: r["root"] for r in found}
    got: dict[int, set] = {}
    for x in signed:
        got.setdefault(root.get(x, x), set()).add(x)
    a = np.array(signed, np.int64).view(np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 3
    label = np.arange(len(a))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(a))])
        if (new == label).all():
            break
        label = new
    want: dict[int, set] = {}
    for x, k in zip(signed, label.tolist(), strict=True):
        want.setdefault(k, set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_fingerprints_and_edits(docs, none):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    unique = [r for r in rows if rows.count(r) == 1 and sum(x[0] == r[0] for x in rows) == 1]
    only = docs.sparkSession.createDataFrame(unique, "doc_id long, text string")
    got = {r["doc_id"]: r for r in document_prints.fingerprint_documents(only).collect()}
    order = sorted(unique, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for i, (key, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        k = len(text) // 2
        edited = text[:len(text) - k] + after[:k]
        r = got[key]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()

        def own(t):
            w = WORD.findall(t)
            terms = w if len(w) == 1 else [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
            return _votes([(x, len(x)) for x in terms]) if w else 0

        full = (1 << 64) - 1
        assert (r["fp"] & full, r["edited_fp"] & full, r["next_fp"] & full) == (
            own(text), own(edited), own(after))
    assert document_prints.fingerprint_documents(docs).count() == docs.count()
    assert document_prints.fingerprint_documents(none).count() == 0


def test_search_finds_all_near(spark):
    pick = random.Random(5)
    base = [pick.getrandbits(63) for _ in range(40)]
    prints = {x ^ (1 << pick.randrange(63)) ^ (1 << pick.randrange(63)) for x in base for _ in range(6)} | set(base)
    prints |= {x ^ 0b11111 for x in base}
    df = spark.createDataFrame([(x,) for x in sorted(prints)], "fp long")
    queries = spark.createDataFrame([(x,) for x in base], "fp long")
    got = {(r["q"], r["fp"]) for r in document_prints.near_fingerprints(queries, df).collect()}
    assert got == {(q, x) for q in base for x in prints if (q ^ x).bit_count() <= 3}


def test_shards(docs, none, spark):
    many = spark.range(20_000).selectExpr("id as doc_id", "cast(id as string) as text")
    rows = sharding.place(many).collect()
    moved = [r for r in rows if r["shard"] != r["grown_shard"]]
    assert {r["grown_shard"] for r in moved} == {40} and 300 < len(moved) < 700
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) == set(range(40)) and 380 < min(sizes.values()) and max(sizes.values()) < 620
    for shard in range(40):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sizes[shard]))
    for r in sharding.place(docs).collect():
        assert r["size"] >= 16 and (r["size"] > 16 or r["text_crc32"] == 0)
    texts = sorted(zlib.crc32((r["text"] or "").encode()) for r in docs.collect())
    assert sorted(r["text_crc32"] for r in sharding.place(docs).collect()) == texts
    assert sharding.place(none).count() == 0


def test_changed_weight_moves_only_its_subtree(spark):
    tree = {"r0": {"k0": {0: 1.0, 1: 1.0}}, "r1": {"k1": {2: 1.0}, "k2": {3: 1.0}}}
    changed = {"r0": {"k0": {0: 1.0, 1: 1.0}}, "r1": {"k1": {2: 1.0}, "k2": {3: 3.0}}}
    df = spark.range(4000).selectExpr("cast(id as string) as k")
    rows = df.select(
        sharding.shard_of(df["k"], tree).alias("a"), sharding.shard_of(df["k"], changed).alias("b")
    ).collect()
    assert all(r["b"] in (2, 3) for r in rows if r["a"] != r["b"])


def test_licenses(spark, docs, none):
    mit = LICENSES["MIT"]
    rows = [
        (1, mit), (2, mit.upper().replace(",", " ;").replace("\n\n", "\n\nCopyright (c) 2020 Someone\n", 1)),
        (3, mit + " and more"), (4, "Some prose.\nReleased under the MIT Licence!\nreleased under the mit license"),
        (5, LICENSES["Zlib"].replace("acknowledgment", "acknowledgement")), (6, ""), (7, None),
    ]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["license"] for i in range(1, 8)] == ["MIT", "MIT", None, None, "Zlib", None, None]
    assert (got[4]["notices"], got[4]["n_notices"]) == ("MIT", 2) and got[7]["canonical_sha256"] is None
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(none).count() == 0


def _wrapped(text, width, leader=""):
    lines = [line for part in text.split("\n") for line in textwrap.wrap(part, width) or [""]]
    return "\n".join(f"{leader}{line}" for line in lines)


def test_licenses_in_other_forms(spark):
    mit, bsd = LICENSES["MIT"], LICENSES["BSD-3-Clause"]
    body = mit.split("\n\n", 1)[1]
    head = "Copyright (c) 2019-2021, A. Holder <a@b.c>\nAll rights reserved.\n\n"
    texts = [mit, body, f"The MIT License (MIT)\n\n{head}{body}", *[_wrapped(mit, n) for n in range(20, 90)],
             _wrapped(head + body, 60, " * "), f"/*\n{_wrapped(body, 70, '// ')}\n*/"]
    other = [bsd, *[_wrapped(bsd, n, "# ") for n in range(20, 90)], f"BSD 3-Clause License\n\n(c) 2020 X\n{bsd}"]
    none = [body[:-30], "copyright notice " + body, "MIT License", mit * 2, "x " * 200_000 + body]
    rows = list(enumerate([*texts, *other, *none]))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {r["doc_id"]: r["license"] for r in got.collect()}
    want = ["MIT"] * len(texts) + ["BSD-3-Clause"] * len(other) + [None] * len(none)
    assert [found[i] for i in range(len(rows))] == want


def test_licenses_of_equal_form_and_notices_of_any_words(spark):
    known = {"B": "One, two licence.", "A": "one two LICENSE", "C": "MIT License\none two license", "D": "!"}
    rows = [(1, "One two licence"), (1, "One two licence"), (2, "x\n -- In the public domain.\ny"), (3, "!")]
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, license string, _lines int")
    got = licenses.scan(docs, known, {"In the public domain.": "PD", "...": "no"}).collect()
    assert sorted((r["doc_id"], r["license"] or "", r["notices"], r["n_notices"]) for r in got) == [
        (1, "A", "", 0), (1, "A", "", 0), (2, "", "PD", 1), (3, "", "", 0)
    ]
    assert licenses.scan(docs, known, {}).where("n_notices = 0").count() == 4


def _canonical(text, title):
    """The canonical form word by word."""
    kept = []
    for line in text.lower().split("\n"):
        front = re.sub(r"^(?:[^\w(©]|_)*", "", line)  # signs in front do not count
        year = r"[\[<{]?((19|20)\d\d|year|yyyy)"
        stated = (
            re.match(rf"copyright\s*(\(c\)|©|{year})", front) or re.match(rf"\(c\)\s*(copyright|{year})", front)
            or front.startswith("©") or re.fullmatch(r"all rights reserved[\W_]*", front)
        )
        if not stated:
            kept += re.findall(r"[^\W_]+", line)
    words = [w for word in kept for w in SPELLINGS.get(word, word).split()]
    form = " ".join(words)
    titles = [t for t in TITLES if form.startswith(t + " ")]
    return form[len(max(titles, key=len)) + 1:] if title and titles else form


def test_canonical_forms_equal_word_by_word(spark):
    rng = random.Random(5)
    bits = ["licence", "Licences", "Copyright", "(c)", "©", "2020", "holder", "All rights reserved", ".", "\n", "\n", " * ",
            "noncommercial", "MIT License", "The", "favour", "--", "# ", "[year]", "Zlib license"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(30))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    form = licenses.canonical(licenses.canonical_lines(F.col("text")))
    for r in df.select("text", form.alias("form"), licenses.untitled(form).alias("untitled")).collect():
        assert (r["form"], r["untitled"]) == (_canonical(r["text"], False), _canonical(r["text"], True)), r["text"]


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    scores, moves = rng.normal(size=5), rng.normal(size=(2, 2))
    text = np.array([0, 0, 0, 1, 1])
    good, joint = line_quality.marginals(scores, moves, text)
    for first, last in ((0, 3), (3, 5)):
        n = last - first
        total, ones = 0.0, np.zeros(n)
        for bits in np.ndindex(*[2] * n):
            w = np.exp(sum(scores[first + i] for i in range(n) if bits[i]) + sum(
                moves[bits[i], bits[i + 1]] for i in range(n - 1)))
            total += w
            ones += w * np.array(bits)
        assert np.allclose(good[first:last], ones / total)


def _made_up(spark):
    pick = random.Random(7)
    plain = [f"{a}{b}" for a in "tion ing er an the re".split() for b in "st nd ly ou he ea".split()]
    docs, marks = [], []
    for i in range(300):
        words = [pick.choice(plain) for _ in range(pick.randint(60, 200))]
        toxic, bad = i % 5 == 0, i % 3 == 0
        if toxic:
            for _ in range(4):
                words.insert(pick.randrange(len(words)), pick.choice(["grumblefink", "snotwhistle"]))
        text = " ".join(words[:40]) + "\n" + " ".join(words[40:])
        docs.append((i, text.upper().replace(" ", "!! ") if bad else text))
        marks.append((i, int(not bad), int(toxic)))
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))


def _found(scored, truth, fold, held):
    rows = [r for r in scored.collect() if zlib.crc32(str(r["doc_id"]).encode()) % fold == held]
    right = sum((r["_score"] >= 0.3) == truth(r["doc_id"]) for r in rows)
    return right / len(rows)


def test_scores_below_the_lowest_filled_bin_are_finite():
    x, y = np.array([6.0, 6.0, 9.0, 12.0]), np.array([0.0, 0.0, 1.0, 1.0])
    table = toxicity._isotonic(x, y, np.ones(4))
    assert np.isfinite(table).all() and (np.diff(table) > 0).all()
    assert table[0] < 0.3 < table[12] and 0 <= table[0] and table[-1] <= 1


def test_toxic_filter_keeps_clashing_columns(spark):
    texts, marks = _made_up(spark)
    docs = texts.selectExpr("*", "doc_id as _score", "text as score", "1 as row")
    kept = toxicity.without_toxic(docs, marks)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert all(r["_score"] == r["doc_id"] and r["score"] == r["text"] for r in rows)
    assert 200 < len(rows) < 280


def test_classifiers_learn(spark, docs, none):
    texts, marks = _made_up(spark)
    model = toxicity.train(texts, marks)
    assert _found(toxicity.scored(texts, model), lambda i: i % 5 == 0, 4, 2) > 0.9
    field = line_quality.train(texts, marks)
    assert _found(line_quality.scored(texts, field), lambda i: i % 3 != 0, 5, 0) > 0.9
    for scored in (toxicity.scored(docs, model), line_quality.scored(docs, field)):
        rows = scored.collect()
        assert len(rows) == 14 and all(0 <= r["_score"] <= 1 for r in rows)
    assert toxicity.scored(none, model).count() == 0
    assert line_quality.scored(none, field).count() == 0
    assert toxicity.without_toxic(docs, marks).columns == docs.columns
    nothing = marks.where("false")
    assert toxicity.train(texts, nothing).table[0] == 0.0
    assert line_quality.score_texts(line_quality.train(texts, nothing), pa.array(["a"]))[0] == 1.0
