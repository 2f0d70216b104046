"""Operators against brute force, planted cases and odd tables."""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import annsearch, licenses, mixing, nearcopies, packing, pii, quality, secrets, substring, urls
from sparkloom.llm.components import connected_components, hub_join
from sparkloom.llm.pieces import PieceTokenizer
from sparkloom.llm.words import normal, words_of

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kind string, pack string"


def table(spark, texts):
    """Documents with extra columns whose names operators might use themselves."""
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or ""), "k", "p") for i, t in enumerate(texts)], SCHEMA)


def corpus(seed=1, n=60):
    """Random texts with exact and near copies, shared passages, odd spaces, empty and null texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6))) for _ in range(400)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, base = text(60), text(200)
    out = [None, "", "  \t\n ", "one", "one", " two words  here\n", text(5000)]
    out += [text(rng.randrange(20, 120)) for _ in range(n)]
    out += [text(30) + " " + passage + "\t" + text(30) for _ in range(6)]
    for _ in range(8):
        w = base.split()
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(99))
        out.append("\n".join(w))
    out += [base, base, base + " " + base]
    return out


def test_repeats_against_brute_force(spark):
    texts = corpus()
    rows = {r["doc_id"]: r for r in substring.remove_repeats(table(spark, texts)).collect()}
    import hashlib

    for d, want in brute.repeats(list(enumerate(texts))).items():
        r = rows[d]
        assert (r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) == want
        assert sum(e - s for s, e in r["removed"]) == r["n_removed"]
    with pytest.raises(ValueError):
        substring.remove_repeats(table(spark, texts), span=20)


def test_repeats_by_relays(spark, monkeypatch):
    """Many buckets and small relays give the same."""
    monkeypatch.setattr(substring, "FAN", 3)
    monkeypatch.setattr(substring, "GATHER", 2)
    monkeypatch.setattr(substring, "parts_for", lambda docs, each: 14)
    assert substring.Ranges.of(14) == substring.Ranges(14, 5) and substring.Ranges.of(14).count == 3
    texts = corpus(31, 30)
    docs = table(spark, texts).repartition(9)  # a pack each
    rows = {r["doc_id"]: r for r in substring.remove_repeats(docs).collect()}
    for d, (n_words, n_removed, _) in brute.repeats(list(enumerate(texts))).items():
        assert (rows[d]["n_words"], rows[d]["n_removed"]) == (n_words, n_removed)
    assert sum(r["n_removed"] for r in rows.values()) > 500


def test_repeats_match_sql(spark, tmp_path):
    import duckdb

    table(spark, [*corpus(4), None, "", "one", "x " * 35, "x " * 36]).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in substring.op1_query(spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(db.sql(substring.OP1_SQL).fetchall()) and sum(r[2] for r in got) > 0


def test_links_against_brute_force(spark, monkeypatch):
    texts = corpus(2)
    want = brute.links([(i, t) for i, t in enumerate(texts)])
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in nearcopies.link_documents(table(spark, texts)).collect()}
    assert got == want
    kept = {r["doc_id"] for r in nearcopies.keep_one_of_each(table(spark, texts)).collect()}
    assert kept == {d for d, (c, _) in want.items() if c == d}
    again = table(spark, texts).unionByName(table(spark, texts))
    blank = sum(not brute.words(t) for t in texts)
    assert nearcopies.keep_one_of_each(again).count() == len(kept) + blank


def test_links_of_repeated_and_missing_ids(spark):
    """Rows are told apart by text and id: brute force over row numbers, then ids put in their place."""
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(10**6)}"
    a, b, c = (" ".join(word() for _ in range(60)) for _ in range(3))
    near = lambda t: t + " " + word()
    rows = [(5, a), (5, b), (7, near(a)), (8, near(b)), (9, near(b)), (None, c), (None, near(c)), (None, near(a)), (None, None), (None, " "), (5, a), (11, near(c)), (None, near(c)), (12, "x"), (None, "x")]
    rows += [(None, c)] * 5
    df = spark.createDataFrame([(i, t, "u", 1, 2) for i, t in rows], "doc_id long, text string, `__id` string, `__raw` int, `__blank` int")
    want = brute.links([(k, t) for k, (_, t) in enumerate(rows)])
    members = defaultdict(list)
    for k, (cls, _) in want.items():
        members[cls].append(k)
    smallest = {cls: min((rows[k][0] for k in ks if rows[k][0] is not None), default=None) for cls, ks in members.items()}
    expected = sorted(((rows[k][0], smallest[cls], n) for k, (cls, n) in want.items()), key=str)
    assert sorted((tuple(r) for r in nearcopies.link_documents(df).collect()), key=str) == expected
    kept = nearcopies.keep_one_of_each(df)
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    firsts = {cls: min((rows[k][0] is None, rows[k][0] or 0) for k in ks) for cls, ks in members.items()}
    assert sorted(i is None for i, _ in got) == sorted(f[0] for f in firsts.values()) and sorted(str(i) for i, _ in got) == sorted(str(None if f[0] else f[1]) for f in firsts.values())
    assert all(t in [rows[k][1] for k in range(len(rows))] for _, t in got)


def test_hubs_are_dealt_out(spark):
    left = spark.range(5000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 1700).alias("k"), "id")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("m")).where("k % 7 != 0")
    got = hub_join(left, right, ["k"], "n", 5000)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "k").select("k", "id", "n", "m").collect()))


def test_groups_in_blocks_and_spanning_edges():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 60000, nearcopies.VALUES, dtype=np.uint16)
    sig = np.stack([np.where(rng.random(nearcopies.VALUES) < 0.05 * (i % 3), 1, base) for i in range(40)] + [rng.integers(0, 60000, nearcopies.VALUES) for _ in range(20)]).astype(np.uint16)
    edges = nearcopies.spanning(sig)
    assert len(edges) == 39 and max(max(e) for e in edges) < 40
    sets = [np.unique(rng.integers(0, 300, 100)).astype(np.uint64) for _ in range(30)]
    shared = nearcopies.overlaps(sets)
    assert all(shared[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(30) for j in range(30))


def test_large_clusters_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "CLUSTER_BLOCK", 4)
    monkeypatch.setattr(nearcopies, "BAND_BLOCK", 4)
    texts = corpus(3, 5)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in nearcopies.link_documents(table(spark, texts)).collect()}
    assert got == brute.links(list(enumerate(texts)))


def test_secrets_against_brute_force(spark):
    rng = random.Random(4)
    parts = ["password", "Secret", "API_key", "token", "=", ":", '"', "'", " ", "AKIA", "ABCDEFGH12345678", "abcdef0123456789", "abc123", "é", "\n", ".", "x" * 5, "Zq8fK2mP0sLw7Xc4Vb9N"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(400)] + [None, "", "token=abcdefgh " * 2000]
    rows = secrets.digest(secrets.scan_secrets(table(spark, texts)), "secrets", secrets.BASE_KINDS).collect()
    for r in rows:
        want = brute.secrets(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == brute.digest(want) and r["n_assign"] == sum(s[3] == "assign" for s in want)
    entropy = "key Zq8fK2mP0sLw7Xc4Vb9N but 123e4567-e89b-12d3-a456-426614174000 and internationalizationofwords1 stay"
    got = secrets.scan_secrets(table(spark, [entropy])).first()["secrets"]
    assert [(s["kind"], s["start"], s["end"]) for s in got] == [("entropy", 4, 24)]
    key = "Zq8fK2mP0sLw7Xc4Vb9N"
    cases = [(f"/samples/{key}", 1), (f"your_{key}", 0), (f"{key}example", 0), ("src/main/java/util/Example-12-Test_file", 0), ("a-1-" * 500, 0), ("a-1-" * 100_000, 0), (key * 3000 + " " + f"{key}, " * 3000, 3001)]
    found = {r["doc_id"]: r["secrets"] for r in secrets.scan_secrets(table(spark, [c[0] for c in cases])).collect()}
    assert [len(found[i]) for i in range(len(cases))] == [c[1] for c in cases]
    mixed = f"token={key} {key} " * 1500
    got = secrets.scan_secrets(table(spark, [mixed])).first()["secrets"]
    assert [s["kind"] for s in got] == ["assign", "entropy"] * 1500 and all(mixed[s["start"] : s["end"]] == s["value"] for s in got)
    bits = spark.createDataFrame([("aabb" * 5 + "abcdefghij" * 2,)], "v string").select(secrets.window_entropy(F.col("v"))).first()[0]
    assert bits == pytest.approx(np.log2(10))


def test_pii_against_brute_force(spark):
    rng = random.Random(5)
    parts = ["a.b", "@", "x-1.com", "_", "+", "49", " ", "-", "(", ")", ".", "192.168.0.1", "4111 1111 1111 1111", "255", "0", "é", "12", "79927398713", "\n", "5500-0000-0000-0004"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(600)] + [None, "", "1" * 30000, "a" * 30000 + "@", "1.1.1.1 " * 1500]
    rows = pii.digest(pii.find_pii(table(spark, texts)), "pii", pii.BASE_KINDS).collect()
    for r in rows:
        assert r["base_sha256"] == brute.digest(brute.pii(texts[r["doc_id"]] or "")), texts[r["doc_id"]]
    text = "IBAN GB82 WEST 1234 5698 7654 32 ok, GB82 WEST 1234 5698 7654 33 no; ssn 078-05-1120, id 078-05-1121"
    found = pii.find_pii(table(spark, [text, text[80:]])).orderBy("doc_id").collect()
    assert [s["kind"] for s in found[0]["pii"]][0] == "iban" and "ssn" in [s["kind"] for s in found[0]["pii"]]
    clean = pii.mask_pii(table(spark, ["mail é a@b.com or 192.168.0.1!", "none", None])).orderBy("doc_id").collect()
    assert [r["text"] for r in clean] == ["mail é <EMAIL> or <IP>!", "none", None] and clean[0]["n_chars"] == len(clean[0]["text"])


def test_context_decides_added_kinds(spark):
    odd = next(f"QQ{c:02d}123456789012" for c in range(100) if int("".join(str(int(x, 36)) for x in f"123456789012QQ{c:02d}")) % 97 == 1)
    cases = [("call me: 030 1234567", ["tel"]), ("room 030 1234567", []), (f"bank {odd} ok", ["iban"]), (f"code {odd} ok", []), ("ssn 078-05-1120", ["ssn"]), ("x 078-05-1120", []), ("ssn 000-05-1120", [])]
    cases += [("tel +49 30 1234567", ["phone"]), ("phone 4111 1111 1111 1111", ["card"])]
    rows = {r["doc_id"]: r["pii"] for r in pii.find_pii(table(spark, [t for t, _ in cases])).collect()}
    assert [[s["kind"] for s in rows[i]] for i in range(len(cases))] == [k for _, k in cases]
    assert rows[7][0]["score"] > pii.PRIOR["phone"]
    rng = random.Random(15)
    parts = ["mail ", "a@b.cc", " 1.1.1.1 ", "é", "call ", "030 1234567 ", "+49 30 1234567 ", "x" * 30, "\n", "4111 1111 1111 1111 "]
    texts = ["".join(rng.choice(parts) for _ in range(n)) for n in (5, 40, 400, 9000)]
    for r in pii.find_pii(table(spark, texts)).collect():
        t, near = texts[r["doc_id"]], 40
        for s in r["pii"]:
            around = t[max(0, s["start"] - near) : s["start"]] + " " + t[s["end"] : s["end"] + near]
            want = pii.PRIOR[s["kind"]] + (pii.BONUS if re.search(pii.CONTEXT[s["kind"]], around) else 0)
            assert t[s["start"] : s["end"]] == s["value"] and s["score"] == pytest.approx(min(1, want))
    clean = {r["doc_id"]: r["text"] for r in pii.mask_pii(table(spark, texts)).collect()}
    for r in pii.find_pii(table(spark, texts)).collect():
        out, at = [], 0
        for s in r["pii"]:
            if s["start"] >= at:
                out += [texts[r["doc_id"]][at : s["start"]], f"<{s['kind'].upper()}>"]
            at = max(at, s["end"])
        assert clean[r["doc_id"]] == "".join(out) + texts[r["doc_id"]][at:]


def test_ibans_before_capitals_and_digits(spark):
    de, gb, no = "DE89370400440532013000", "GB82WEST12345698765432", "NO9386011117947"
    spaced = "DE89 3704 0044 0532 0130 00"
    cases = [
        (f"IBAN {de} Thanks", [de]), (f"{gb} 12 May", [gb]), (f"{spaced} BIC COBADEFF", [spaced]), (f"{de} {gb}", [de, gb]), (f"{spaced} {no} {de}.", [spaced, no, de]),
        (f"REF AB12 {spaced} OK", [spaced]), (f"{de}x {gb}y", []), (f"x{de} {gb}", [gb]), ("DE89370400440532013001 Thanks", []), ("A1 " * 20000 + f"AB12 CD {gb} " + "AB12 " * 3000, [gb]),
        (f"é𝄞 {de} A {gb} B", [de, gb]), (f"{de} " * 300, [de] * 300), (f"GB82 WEST 1234 5698 7654 32\n{no}", ["GB82 WEST 1234 5698 7654 32", no]),
    ]
    rows = {r["doc_id"]: r for r in pii.find_pii(table(spark, [t for t, _ in cases])).collect()}
    for i, (text, want) in enumerate(cases):
        found = [s for s in rows[i]["pii"] if s["kind"] == "iban"]
        assert [s["value"] for s in found] == want and all(text[s["start"] : s["end"]] == s["value"] for s in found), text[:80]
    assert pii.mask_pii(table(spark, [f"To {de} Thanks"])).first()["text"] == "To <IBAN> Thanks"


def test_quality(spark):
    rng = random.Random(6)
    texts = corpus(7, 300) + ["\n".join(rng.choice(["a b c", "x", " ", "##"]) for _ in range(rng.randrange(60))) for _ in range(100)]
    texts += [" ".join(w + "###" for w in t.split()) for t in corpus(8, 40) if t] + ["spam me now " * 40] * 10
    rows = {r["doc_id"]: r for r in quality.score_quality(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r, want = rows[i], brute.measures(t)
        assert tuple(r[c] for c in quality.BASE) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        if r["base_failed"]:
            assert not r["kept"]
    assert sum(r["kept"] for r in rows.values()) > 100
    kept = quality.filter_quality(table(spark, texts))
    assert kept.columns == table(spark, []).columns and kept.count() == sum(r["kept"] for r in rows.values())
    odd = table(spark, texts).selectExpr("doc_id", "text", "1 as `__m`", "2 as n_words", "'x' as votes", "3 as `a.b`")
    assert quality.filter_quality(odd).count() == kept.count() and quality.filter_quality(odd.unionByName(odd)).count() >= 2 * kept.count() - 2


def test_quality_learns_planted_accuracies(spark):
    """Two kinds of junk that several rules see, one rule that calls good documents junk as often, and one at chance."""
    rng = np.random.default_rng(16)
    n = 40_000
    kind = rng.choice(3, n, p=[0.8, 0.15, 0.05])
    junk = np.array([[0.01, 0.01, 0.01, 0.01, 0.08, 0.2], [0.95, 0.9, 0.01, 0.02, 0.1, 0.2], [0.01, 0.02, 0.95, 0.9, 0.05, 0.2]])
    none = 0.2
    votes = np.where(rng.random((n, 6)) < junk[kind], -1, np.where(rng.random((n, 6)) < none, 0, 1))
    patterns = {tuple(v): int(c) for v, c in zip(*(x.tolist() for x in np.unique(votes, axis=0, return_counts=True)), strict=True)}
    model = quality.fit_votes(patterns, 6)
    assert model.shares[0] == pytest.approx(0.8, abs=0.02)
    assert model.chances[0, :, 0] == pytest.approx(junk[0], abs=0.02)  # how often each rule calls good documents junk
    post = dict(zip(patterns, model.posteriors(np.array(list(patterns)))[0], strict=True))
    assert post[1, 1, 1, 1, -1, 1] > 0.9 and post[1, 1, 1, 1, 1, -1] > 0.9 and post[1, 1, 1, 1, -1, -1] > 0.5  # weak junk votes alone
    assert post[-1, -1, 1, 1, 1, 1] < 0.1 and post[1, 1, -1, -1, 1, 1] < 0.1
    right = np.mean([(post[tuple(v)] >= 0.5) == (k == 0) for v, k in zip(votes.tolist(), kind.tolist(), strict=True)])
    assert right > np.mean((votes[:, :4] == -1).any(axis=1) == (kind > 0)) - 0.005 and right > np.mean((votes == -1).any(axis=1) == (kind > 0)) + 0.15
    few = spark.createDataFrame([(list(p),) for p in list(patterns)[:200]], "votes array<int>")
    for r in few.select("votes", model.posterior(F.col("votes")).alias("p")).collect():
        assert r["p"] == pytest.approx(post[tuple(r["votes"])], abs=1e-9)
    assert quality.fit_votes({}, 6).shares[0] == quality.PRIOR_GOOD


def test_quality_of_labelled_documents(spark):
    folder = "/root/testdata/sf0.01"
    judged = quality.score_quality(spark.read.parquet(f"{folder}/documents.parquet")).where("not base_failed")
    rows = judged.join(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col("quality").alias("label")), "doc_id", "left").collect()
    kept = lambda label: np.mean([r["kept"] for r in rows if r["label"] == label])
    assert kept(1) > 0.99 and kept(0) < 0.05
    # Not all must pass: some documents stay in spite of a junk vote.
    assert any(r["kept"] and -1 in r["votes"] for r in rows) and all(r["kept"] for r in rows if -1 not in r["votes"])


def test_mixing_matches_sql(spark):
    import duckdb

    docs = table(spark, corpus(9)).select("doc_id", "text", "lang", F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("source"), "n_chars")
    got = mixing.mix_sources(docs).collect()
    documents = docs.toPandas()  # noqa: F841
    want = duckdb.sql(mixing.OP2_SQL).fetchall()
    assert sorted((r["doc_id"], r["copy"], r["shuffle_key"]) for r in got) == sorted((r[0], r[5], r[6]) for r in want)
    assert [r["shuffle_key"] for r in got] == sorted(r["shuffle_key"] for r in got)
    with pytest.MonkeyPatch.context() as patch:  # rates too large to be broadcast
        patch.setattr(mixing, "BROADCAST_STEPS", 0)
        assert mixing.mix_sources(docs).collect() == got
    odd = docs.selectExpr("if(doc_id % 3 = 0, null, doc_id) as doc_id", "text", "source", "'u' as copy", "5 as __n", "6 as __Part", "7 as `__source`", "8 as `a.b`")
    mixed = mixing.mix_sources(odd).collect()
    assert {(r["copy"], r["__n"], r["__Part"], r["__source"], r["a.b"]) for r in mixed} == {("u", 5, 6, 7, 8)} and {r["copy_"] for r in mixed} >= {0, 1}
    documents = odd.selectExpr("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"})  # noqa: F841
    keys = sorted(r["shuffle_key"] for r in mixed)
    assert keys == sorted(r[-1] for r in duckdb.sql(mixing.OP2_SQL).fetchall()) and len(set(keys[: len(keys) // 2])) > 10
    only = mixing.mix_sources(docs, {"s1": 1.0}, volume=2.0).collect()
    assert {r["source"] for r in only} == {"s1"}
    big = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"), F.lit("s").alias("source"))
    counts = mixing.mix_sources(big, volume=3.0).groupBy("doc_id").count().agg(F.sum("count"), F.sum(F.col("count") * F.col("count"))).first()
    assert counts[0] / 20000 == pytest.approx(3, abs=0.05) and counts[1] / 20000 - 9 == pytest.approx(3, abs=0.15)


def test_licenses(spark):
    mit = " ".join(licenses.TEMPLATES["MIT"].split())
    broken = mit.replace("free of charge", "gratis").replace("persons to whom", "people whom")
    texts = [f"Words before. {mit} Words after.", broken, f"{mit}\n\nsome text\n\n{mit}", "Licensed under CC BY-NC 4.0.\nText", "a licensed driver under oath by the 4.0 litre car", None, "", "x " * 30000 + "Released under the MIT License."]
    got = {r["doc_id"]: [(x["license"], x["start"], x["end"]) for x in r["licenses"]] for r in licenses.scan_licenses(table(spark, texts)).collect()}
    assert got[0] == [("MIT", 14, 14 + len(mit) - 1)] and [x[0] for x in got[1]] == ["MIT"] and [x[0] for x in got[2]] == ["MIT", "MIT"]
    assert got[3] == [("CC-BY-NC-4.0", 0, 27)] and got[4] == got[5] == got[6] == [] and got[7][0][:2] == ("MIT-notice", 60000)
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randrange(20))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert len(licenses._common(a, b)) == brute.common(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))


def test_large_gaps_are_aligned(monkeypatch):
    for n in (400, 600, 3000):
        assert len(licenses.align(["x"] * n, ["x"] * (n + 1) + ["y"] * n)) == n and len(licenses.align(["z", "z", *["x"] * n], [*["x"] * n, "z", "z"])) == n
    rng = random.Random(2)
    monkeypatch.setattr(licenses, "MOST_BITS", 40)
    for _ in range(100):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(30))] for _ in range(2))
        pairs = licenses._common(a, b)
        assert len(pairs) == brute.common(a, b) and all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))


def test_licenses_against_brute_force(spark):
    """Edited copies of small templates between other words: found exactly where some stretch aligns enough."""
    rng = random.Random(22)
    names = ["license", "grant", "terms", "notice", *(a + b for a in "abcdefg" for b in "abcdefg")]
    templates = {f"T{i}": " ".join(rng.choice(names) for _ in range(n)) + f" word{i}" for i, n in enumerate((9, 14, 24, 40))}
    texts = []
    for _ in range(120):
        t = rng.choice(list(templates.values())).split()
        for _ in range(rng.randrange(len(t) // 3 + 1)):
            i = rng.randrange(len(t))
            t[i : i + 1] = rng.choice([[], ["zz"], [t[i], "yy"], [rng.choice(names)]])
        texts.append(" ".join([*(rng.choice([*names, "qq"]) for _ in range(rng.randrange(8))), *t, *(rng.choice(["rr", "ss"]) for _ in range(rng.randrange(8)))]))
    texts += [texts[0] + " " + texts[1], texts[0], texts[0], None, ""]
    found = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(table(spark, texts), templates).collect()}
    hits = 0
    for i, text in enumerate(texts):
        words, spans = licenses.words_in(text or "")
        at = {s: k for k, (s, _) in enumerate(spans)}
        ends = {e: k + 1 for k, (_, e) in enumerate(spans)}
        for x in found[i]:
            t = templates[x["license"]].split()
            stretch = words[at[x["start"]] : ends[x["end"]]]
            assert x["coverage"] >= licenses.COVERAGE and len(stretch) <= 1.25 * len(t) + 1
            assert x["coverage"] * len(t) <= brute.common(stretch, t) + 1e-9
        assert all(x["end"] <= y["start"] for x, y in zip(found[i], found[i][1:], strict=False))
        for name, t in templates.items():
            t = t.split()
            slack = max(licenses.LEAST_SLACK, int(licenses.SLACK * len(t)))
            want = brute.licensed(words, t, licenses.COVERAGE, 0)
            got = any(x["license"] == name for x in found[i])
            hits += got
            taken = any(len(templates[x["license"]].split()) >= len(t) for x in found[i])
            assert got or taken or not want, (name, text)
            assert not got or brute.licensed(words, t, licenses.COVERAGE, 2 * slack)
    assert hits > 80 and found[121] == found[122] == found[0] and found[123] == found[124] == []


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1200, 16)).astype(np.float32)
    x[300:700] = x[300]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(5000, None, 0), (5020, [0.0] * 16, 0), (5040, [float("nan")] * 16, 0), (5060, [None] * 16, 0), (None, [1.0] * 16, 0)]
    got = annsearch.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>, leaf int"), F.col("vec_id") % 20 == 0).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(by) == set(range(0, 1200, 20))
    y, hits = x.astype(float), 0
    for q, found in by.items():
        s = np.zeros(len(y))
        for d in range(16):
            s += y[q, d] * y[:, d]
        order = [i for i in np.lexsort((np.arange(len(y)), -s)) if i != q][:20]
        assert len(found) == 20 and all(s[v] == score for v, score in found)
        assert [v for v, _ in found] == sorted([v for v, _ in found], key=lambda v: (-s[v], v))
        hits += len(set(order) & {v for v, _ in found})
    assert hits / (20 * len(by)) >= annsearch.PROMISED
    assert annsearch.nearest_neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_neighbours_of_small_clusters(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(412, 8))
    x[:400, 0] += 30
    x[400:, 1] += 30
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, x[400].tolist())] * 15  # one id many times over
    got = annsearch.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    by = defaultdict(list)
    for r in got:
        by[r["query_id"]].append(r["vec_id"])
    assert set(by) == set(range(0, 412, 20))
    assert all(len(found) == 20 and q not in found for q, found in by.items())
    other = annsearch.nearest_neighbours(spark.createDataFrame([*rows[:60], (1000, [1.0] * 7), (1001, [1.0] * 9)], "vec_id long, embedding array<double>"))
    assert {r["query_id"] for r in other.collect()} == set(range(60)) >= {r["vec_id"] for r in other.collect()}  # vectors of another length take no part
    few = annsearch.nearest_neighbours(spark.createDataFrame(rows[395:], "vec_id long, embedding array<double>")).groupBy("query_id").count()
    assert {r["query_id"]: r["count"] for r in few.collect()} == {i: 16 if i == 400 else 20 for i in range(395, 412)}


def test_clustered_vectors_are_searched_in_few_leaves(spark, monkeypatch):
    monkeypatch.setattr(annsearch, "LEAF", 40)
    monkeypatch.setattr(annsearch, "BLOCK", 100)
    monkeypatch.setattr(annsearch, "ASKING", 7)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 12)) * 8
    x = centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 12)) * 0.3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = annsearch.nearest_neighbours(df, F.col("vec_id") % 20 == 0).collect()
    got = defaultdict(dict)
    for r in rows:
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    hits = 0
    for q in range(0, 3000, 20):
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(3000), -s)) if i != q][:20]
        assert sorted(got[q]) == list(range(1, 21))
        hits += len(set(order) & {v for v, _ in got[q].values()})
    assert hits / (20 * 150) >= annsearch.PROMISED and rows[0]["recall"] >= annsearch.AIM
    sample = x[::3]
    tree = annsearch.fit_tree(sample, 75)
    leaf = tree.file(x)
    off = np.linalg.norm(x - tree.centres[tree.ends()[leaf]], axis=1)
    farthest = np.array([off[leaf == i].max(initial=0) for i in range(tree.n_leaves)])
    sizes = np.bincount(leaf, minlength=tree.n_leaves)
    tree.widen(farthest, 1.0)
    seen = []
    for q in range(0, 3000, 60):  # the whole reach finds all, among few leaves
        enough = annsearch.offered(np.array([q]), x[q : q + 1], np.arange(0, 3000, 3), sample, 20)[0]
        visits = tree.visits(x[q], enough, sizes, 21)
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(3000), -s)) if i != q][:20]
        assert {int(leaf[i]) for i in order} <= set(visits)
        seen.append(len(visits))
    assert np.mean(seen) < tree.n_leaves / 4


def test_urls(spark):
    html = '<link href="{}" rel=canonical>'
    pages = [
        (0, "http://a.example.com/en/x", None), (1, "https://www.example.com/en/x", ""), (2, "http://b.org/1", html.format("http://c.example.com/en/y")),
        (3, "http://c.org/2", '<META http-equiv="refresh" content="0; url=//b.org/1">'), (4, None, None), (5, "no scheme", ""), (6, "http://X.net/es/?q#f", ""),
        (7, "http://q.org/a", html.format("http://e.com/free")), (8, "http://example.com", ""), (9, "http://d.org/z", html.format("/2")), (9, "http://d.org/z", html.format("/2")),
    ]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[0] == ("a.example.com", "/en/x", "example.com/en/", "block") and got[1][2:] == ("www.example.com/en/", "allow")
    assert got[2][2:] == (None, "block") and got[3][2:] == (None, "block") and got[4] == ("", "", None, "allow") and got[5] == ("", "", None, "allow")
    assert got[6] == ("x.net", "/es/", "net/es/", "block") and got[7][2:] == (None, "allow") and got[8] == ("example.com", "", None, "allow")
    log = spark.createDataFrame([("http://q.org/a", "http://u.net/fr/1")], "source string, target string")
    again = {r["page_id"]: r["verdict"] for r in urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), redirects=log).collect()}
    assert again[7] == "allow"  # a block and an explicit allow in one component


def test_urls_match_sql(spark, tmp_path):
    import duckdb

    link, refresh = "<head><link rel='canonical' href={}></head>", '<meta content="3;URL=\'{}\'" http-equiv=Refresh>'
    heads = [link.format('"http://c.example.com/en/y?a=1&amp;b=2"'), link.format("/a/b"), refresh.format("c?x"), link.format("#top"), refresh.format("//N.net/fr/"), None, "", link.format("mailto:x@y.z")]
    hosts = ["a.org", "B.org:80", "n.net", "www.example.com", "x.example.com", "e.com"]
    urls_ = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/en/1?q=/", "/fr/", "/a/b", "/a/c?x")] + [None, "", "a/b", "://x/en/"]
    pages = [(i, u, heads[(5 * i + i // 7) % len(heads)]) for i, u in enumerate(urls_ * 3)]
    pages += [(900, "http://z.org/1", link.format("http://y.example.com/en/q")), (901, "https://z.org/d/2", refresh.format("/1")), (901, "https://z.org/d/2", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((tuple(r) for r in urls.op6_query(spark, str(tmp_path)).collect()), key=str)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(db.sql(urls.OP6_SQL).fetchall(), key=str) and {r[5] for r in got} == {"rule", "alias", "default"}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000, 1000 + i) for i in range(1, 300)] + [(i, i + 1) for i in range(2000, 2100)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert connected_components(spark.createDataFrame([], "a long, b long")) is None


@pytest.fixture(scope="module")
def tokenizer():
    return PieceTokenizer(packing.vocabulary())


def test_pieces_are_exact(tokenizer):
    rng = random.Random(8)
    signs = ["a", "b", "'", "s", "t", "re", "ll", " ", "  ", "\n", "\t", " ", "1", "²", "é", "漢", "🎉", "!", "​", "\0", "\x1c", "\x85", "'S", "Ⅷ", "<|endoftext|>"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(1500)] + ["", "'s", " "]
    ids, counts = tokenizer.encode(texts)
    at = 0
    for t, n, e in zip(texts, counts.tolist(), tokenizer.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids[at : at + n].tolist() == e.ids, t
        at += n


def test_added_tokens_are_exact():
    tokenizer = PieceTokenizer(packing.vocabulary())
    rng = random.Random(9)
    signs = ["a", "'s", " ", "  ", "\n", "1", "é", "!", "<|endoftext|>", "<|endoftext", "|>"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(12))) for _ in range(500)] + ["a <|endoftext|> b", "", "<|endoftext|>", "<|endoftext|>"]
    ids, counts = tokenizer.encode(texts)
    want = [e.ids for e in tokenizer.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert tokenizer.encode(["a <|endoftext|> b"])[1].tolist() == [4]


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        PieceTokenizer(public_tokenizers.path("word_bpe_49k.json"))


def test_packing(spark, tokenizer):
    texts = corpus(11) + ["word " * 9000]
    rows = packing.pack_documents(table(spark, texts)).collect()
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert set(sequences) == set(range(len(sequences)))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= packing.MAX_TOKENS
    alike = packing.pack_documents(spark.createDataFrame([(None, "same words", 1)] * 300 + [(7, None, 2), (7, "", 3)], "doc_id long, text string, salt int")).collect()
    assert len(alike) == 302 and len({(r["sequence_id"], r["offset"]) for r in alike}) == 302 and len({r["sequence_id"] for r in alike}) == 1
    patterns = packing.pack_histogram({5: 7, 3: 10, 1: 4}, 8)
    assert sum(n * sum(p) for p, n in patterns) == 69 and sum(n for _, n in patterns) <= 10


def test_empty_tables(spark):
    none = table(spark, [])
    for f in (substring.remove_repeats, nearcopies.link_documents, secrets.scan_secrets, pii.find_pii, quality.score_quality, mixing.mix_sources, licenses.scan_licenses, packing.pack_documents):
        assert f(none).count() == 0, f
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    texts = corpus(13, 120) + ["mail me at some.one@mail.example.com now " + " ".join(f"w{rng.randrange(9999)}" for _ in range(80))]
    folder = tmp_path / "sf"
    table(spark, texts).drop("kind", "pack").write.parquet(str(folder / "documents.parquet"))
    docs = spark.read.parquet(str(folder / "documents.parquet"))
    good = corpus_pipeline.quality(spark, docs, str(folder))
    assert good.columns == docs.columns and all(len(brute.words(r["text"])) >= 50 for r in good.collect())
    one = corpus_pipeline.near_copies(spark, good, str(folder))
    classes = brute.links([(r["doc_id"], r["text"]) for r in good.collect()])
    assert {r["doc_id"] for r in one.collect()} == {d for d, (c, _) in classes.items() if d == c}
    clean = corpus_pipeline.personal_data(spark, one, str(folder))
    assert clean.count() == one.count() and not clean.where("text like '%@mail%'").count()
    mixed = corpus_pipeline.mix(spark, clean, str(folder))
    assert mixed.columns == docs.columns
    counts = {(r["doc_id"], r["text"]): r["n"] for r in mixed.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(counts) <= {(r["doc_id"], r["text"]) for r in clean.collect()}
    rows = corpus_pipeline.run(spark, str(folder)).collect()
    tokenizer = PieceTokenizer(packing.vocabulary()).tokenizer
    want = sorted((d, zlib.crc32(np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], dtype="<u4").tobytes())) for (d, text), n in counts.items() for _ in range(n) if len(text) < 2000)
    got = sorted((r["doc_id"], r["ids_crc32"]) for r in rows if r["doc_tokens"] == r["length"])
    assert set(want) <= set(got) and len(got) >= len(want) and {r["doc_id"] for r in rows} == {d for d, _ in counts}
    assert sum(r["length"] for r in rows if r["start"] == 0) + sum(r["length"] for r in rows if r["start"]) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)


def test_repeated_and_odd_rows(spark):
    """Rows that repeat, without id, with very long texts and clashing columns are judged like any other, one result row each."""
    secret, mail = "token=abcdefgh1", "write to a.b@c.example now"
    texts = [secret, secret, mail, mail, None, None, "", "word " * 200_000, "x" * 300_000, "a-1-" * 50_000, "\n" * 100_000, "# " * 50_000]
    ids = [1, 1, 2, None, None, 3, 3, 4, 5, 6, 7, 8]
    df = spark.createDataFrame([(i, t, "s", 0, "u", 1, 2, 3) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, source string, n_chars int, spans string, pii int, `__m` int, `a.b` int")
    for f in (secrets.scan_secrets, pii.find_pii, quality.score_quality, licenses.scan_licenses, nearcopies.link_documents, substring.remove_repeats):
        assert sorted(str(r["doc_id"]) for r in f(df).select("doc_id").collect()) == sorted(map(str, ids)), f
    found = secrets.scan_secrets(df).collect()
    assert [len(r["secrets"]) for r in found if r["doc_id"] == 1] == [1, 1]
    found = pii.find_pii(df).collect()
    assert [len(r["pii"]) for r in found if r["text"] == mail] == [1, 1]
    clean = pii.mask_pii(df)
    assert clean.columns == df.columns and sorted(r["n_chars"] for r in clean.where("text like '%<EMAIL>%'").collect()) == [len(mail) - len("a.b@c.example") + 7] * 2
    assert mixing.mix_sources(df).columns == [*df.columns, "copy", "shuffle_key"] and mixing.mix_sources(df, volume=3.0).count() > 0
    assert quality.filter_quality(df).columns == nearcopies.keep_one_of_each(df).columns == df.columns
    gone = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in substring.remove_repeats(df).collect()}
    assert gone[4, 200_000] == 200_000 and gone[8, 50_000] == 50_000 and gone[1, 1] == 0
    packed = packing.pack_documents(df).collect()
    assert sum(r["length"] for r in packed) == sum(r["doc_tokens"] for r in packed if r["start"] == 0)


def test_entry_without_llm(tmp_path):
    """With this subpackage, its tests and the pipeline gone, the entry module still gives the other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "sparkloom", tmp_path / "sparkloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(root / name, tmp_path / name)
    ask = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), any(n.startswith('op') or n == 'pipeline' for n in q))"
    out = subprocess.run([sys.executable, "-c", ask], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 90 and int(out[1]) > 90 and out[2] == "False"


def test_words():
    w = words_of([normal(t.encode()) for t in ["a  b\ta", "", "b", " a b "]])
    assert w.doc_first.tolist() == [0, 3, 3, 4, 6] and w.hashes[0] == w.hashes[2] == w.hashes[4] and w.hashes[1] == w.hashes[3] == w.hashes[5]
    at, hashes = w.windows(2)
    assert at.tolist() == [0, 1, 4] and hashes[0] == hashes[2]
