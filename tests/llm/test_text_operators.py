"""Quality rules, personal data, secrets, licences and benchmark leaks."""

from __future__ import annotations

import hashlib
import math

import brute
import numpy as np
import pytest
from cinefold.llm import contamination, licences, outliers, personal, queries, secret_scan
from prose import PROSE
from pyspark.sql import functions as F


def test_base_statistics(spark, sf_dir, texts):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = {r.doc_id: tuple(r[n] for n in names) for r in queries.op2_covariance_outliers(spark, sf_dir).collect()}
    assert got == {d: brute.statistics(t) for d, t in texts}


def test_statistics_of_odd_texts(make, odd):
    odd = [*odd, (20, "a b c d e a b c d e f"), (21, "x x x x x x"), (22, "l\nl\n \n \nl\n"), (23, "#a |b <c>\n\n")]
    rows = outliers.verdicts(make(odd)).collect()
    assert len(rows) == len(odd)
    want = sorted(str((d, *brute.statistics(t))) for d, t in odd)
    assert sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in rows) == want
    assert all(r.kept is not r.base_failed for r in rows)  # too few for any estimate
    kept = outliers.keep(make(odd))
    assert kept.columns == make(odd).columns and sorted(r.doc_id or 0 for r in kept.collect()) == sorted(r.doc_id or 0 for r in rows if r.kept)
    assert outliers.verdicts(make([])).collect() == [] and outliers.keep(make([])).collect() == []


def test_chi_squared():
    assert abs(outliers.chi2_quantile(0.95, 1) - 3.841459) < 1e-5 and abs(outliers.chi2_quantile(0.95, 5) - 11.070498) < 1e-5


def _robust_rows(n=400, bad=80):
    rng = np.random.default_rng(2)
    cov = 0.02 * (np.eye(outliers.D) + 0.5)
    good = rng.multivariate_normal(np.full(outliers.D, 1.0), cov, n)
    far = rng.multivariate_normal(np.full(outliers.D, 6.0), cov, bad)
    return np.concatenate([good, far]), n, cov


def test_estimate_withstands_outliers(spark):
    rows, n, cov = _robust_rows()
    frame = spark.createDataFrame([("=en", "=s", *map(float, r)) for r in rows], "lang_key string, source_key string, " + ", ".join(f"{f} double" for f in outliers.FEATURES))
    est = [r for r in outliers.estimates(frame).collect() if r.level == 0][0]
    centre = np.array([est[f"m{i}"] for i in range(outliers.D)])
    root = np.zeros((outliers.D, outliers.D))
    for i, j in outliers.PAIRS:
        root[i, j] = est[f"r{i}{j}"]
    assert np.abs(centre - rows[:n].mean(axis=0)).max() < 0.05
    floor = np.diag([outliers.FLOOR[f] ** 2 for f in outliers.FEATURES])
    got = root @ root.T - floor
    assert np.abs(got - cov).max() < 0.02
    away = lambda r: ((np.linalg.solve(root, r - centre)) ** 2).sum()
    cutoff = outliers.chi2_quantile(1 - outliers.TAIL, outliers.D)
    assert all(away(r) <= cutoff for r in rows[:n]) and all(away(r) > cutoff for r in rows[n:])


def test_odd_ones_out_are_rejected(make):
    rng = np.random.default_rng(4)
    vocabulary = np.array(PROSE.split())
    clean = [(i, " ".join(rng.choice(vocabulary, 120)) + ".\n", "abc"[i % 3]) for i in range(300)]
    junk = [(1000 + i, " ".join(w.upper() + "###" for w in rng.choice(vocabulary, 120)), "abc"[i % 3]) for i in range(12)]
    copies = [(2000 + i, clean[0][1], "a") for i in range(400)]
    kept = {r.doc_id for r in outliers.keep(make(clean + junk + copies)).collect()}
    assert kept == {r[0] for r in clean + copies}


def test_personal_base_spans(texts):
    for _, text in texts:
        assert personal.base_spans(text or "") == brute.personal(text)


@pytest.mark.parametrize("text", [
    "a@b.c@d.e x@@y.z @a.b a@b a@b. .@.. a+b@c-d.e-f", "1.2.3.4.5.6.7.8 1.2.3 999.1.1.1 0001.2.3.4 256.1.1.1 01.02.03.04",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 1111 4", "+1 (755) 555-9729 +1+23456789 +123-- +12345678901234567 +1 2",
    "x" * 5000 + "@" + "9" * 5000, "+" * 3000 + "1 2", "é@é.é ü+1 234 5678 ñ 1.1.1.1é", "5500 0000 0000 0004", ""])
def test_personal_odd_texts(text):
    assert personal.base_spans(text) == brute.personal(text)


def test_contexts_discover_identifiers(make):
    rng = np.random.default_rng(6)
    fill = lambda n: " ".join(rng.choice(PROSE.split(), n))
    rows = [(i, f"{fill(12)} Please call: +1 (755) 555-{1000 + i} {fill(9)}") for i in range(40)]
    rows += [(100 + i, f"{fill(12)} the +1 (755) 555-{3000 + i} {fill(9)}") for i in range(10)]
    unseen = [(200, f"{fill(5)} Please call: 755/5559729, {fill(5)}"), (201, f"{fill(5)} the 755/5559729 {fill(5)}")]
    got = {r.doc_id: r for r in personal.find(make(rows + unseen)).collect()}
    text = unseen[0][1]
    at = text.index("755/")
    assert [tuple(s) for s in got[200].discovered] == [("context", at, at + 11)] and got[201].discovered == []
    assert all(len(got[d].base) == 1 and not got[d].discovered for d, _ in rows)


@pytest.mark.parametrize("others", [100, 20_000])
def test_contexts_count_beside_any_number_of_seeds(make, others):
    rng = np.random.default_rng(8)
    fill = lambda n: " ".join(rng.choice(PROSE.split(), n))
    rows = [(i, f"{fill(9)} Please call: +1 (755) 555-{1000 + i} {fill(9)}") for i in range(8)]
    rows += [(100 + k, " ".join(f"w{k}x +1 (755) {k:03} {i:04}" for i in range(100))) for k in range(others // 100)]
    unseen = [(9000, "0171 234 5678", ""), (9001, "jane(at)example(dot)org", ","), (9002, "77/12", "."), (9003, "0171 234 5678", ", 99 of them")]
    docs = rows + [(d, f"{fill(5)} Please call: {told}{end} {fill(4)}") for d, told, end in unseen]
    got = {r.doc_id: [dict(docs)[r.doc_id][s.start:s.end] for s in r.discovered] for r in personal.find(make(docs)).collect()}
    assert {d: got[d] for d, *_ in unseen} == {d: [told] for d, told, _ in unseen}
    assert not any(got[d] for d, _ in rows if d < 100)


@pytest.mark.parametrize("text, want", [
    ("a 0171 234 5678. b", ["0171 234 5678"]), ("(12) 34", ["12) 34"]), ("1 2 3x 4", ["1 2", "3x", "4"]), ("x@y _z a_b", ["x@y", "a_b"]), ("", []),
    (" ".join(["123"] * 9), ["123"] * 3 + ["123 123 123 123 123 123"]), ("5, 6 7,8", ["5", "6", "7,8"])])
def test_candidate_words(text, want):
    assert [text[a:run] for a, _, run in personal.marked_words(text)] == want


def test_occurrences_by_brute_force(spark, make, texts):
    words = [t.lower().split() for _, t in texts if t]
    single = {w for t in words for w in t[:40]}
    wanted = sorted(single) + sorted({f"{a} {b}" for t in words for a, b in zip(t[:9], t[1:9])})
    want = {}
    for t in words:
        for c in [*t, *map(" ".join, zip(t, t[1:]))]:
            want[c] = want.get(c, 0) + 1
    contexts = spark.createDataFrame([("email", c) for c in wanted], "kind string, context string")
    got = {r.context: r.times for r in personal._occurrences(make(texts), contexts).collect()}
    assert got == {c: want[c] for c in wanted}


def test_personal_odd_rows(spark, sf_dir, make, odd, texts):
    rows = personal.find(make(odd)).collect()
    assert len(rows) == len(odd) and all(r.base == [] and r.discovered == [] for r in rows)
    assert personal.find(make([])).collect() == []
    for r in queries.op3_bootstrapped_pii(spark, sf_dir).collect():
        base = brute.personal(dict(texts)[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in personal.KINDS]
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest() and r.spans.startswith(told)


def test_secrets_on_held_out_findings(make):
    rng = np.random.default_rng(9)
    hexed = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    upper = lambda n: "".join(rng.choice(list("ABCDEFGHJKLMNPQRSTUVWXYZ23456789"), n))
    long_word = lambda: "".join(rng.choice(PROSE.split(), 9))
    rows = []
    for i in range(150):
        rows += [(4 * i, f"{PROSE} password={hexed(18)} {PROSE}"), (4 * i + 1, f"{PROSE} AKIA{upper(16)} then"),
                 (4 * i + 2, f"{PROSE} {long_word()} then"), (4 * i + 3, f"card {''.join(map(str, rng.integers(0, 10, 16)))} {PROSE}")]
    docs = make(rows)
    train_rows = lambda found: secret_scan.labelled_by_format(found).filter("doc_id < 400")
    scanned = [r for r in secret_scan.scan(docs, train_rows).collect() if r.doc_id >= 400]
    right = [r.kept == (r.doc_id % 4 < 2) for r in scanned]
    assert len(scanned) == 200 and sum(right) >= 0.97 * len(right)


def test_secret_candidates_of_a_word(make):
    key, aws, hub = "wJalrXUtnFEMIK7MDENGbPxRfiCYz3KEY0abcdef", "AKIA" + "Q2" * 8, "ghp_" + "a1B2" * 9
    rows = [(1, f'set aws_secret_access_key="{key}" now'), (2, f'{{"a":"{aws}","b":"{hub}"}}'), (3, "at postgres://admin:h4nter22@host/db then"),
            (4, "password=hunter2secret token: short=1"), (5, f"{aws}:{key},{hub}"), (6, "see https://example.org/a-page-of-many-words mail someone.with.name@example.org"),
            (7, "pass=c2VjcmV0LXZhbHVlLTE=="), (8, "api_key: k9Qm2Zx81LpWq7Tn password = hunter2secret99x"), (8, "api_key: k9Qm2Zx81LpWq7Tn password = hunter2secret99x")]
    got = secret_scan.candidates(make(rows)).collect()
    told = sorted((r.doc_id, r.position, r.part, r.before, r.token) for r in got if r.doc_id != 8)
    assert told == [(1, 1, 0, "aws_secret_access_key", key), (2, 0, 0, "a", aws), (2, 0, 1, "b", hub), (3, 1, 0, "admin", "h4nter22"), (4, 0, 0, "password", "hunter2secret"),
                    (5, 0, 0, "", aws), (5, 0, 1, "", key), (5, 0, 2, "", hub), (6, 1, 0, "see", "org/a-page-of-many-words"), (7, 0, 0, "pass", "c2VjcmV0LXZhbHVlLTE==")]
    assert sorted(r.token for r in got if r.doc_id == 8) == ["hunter2secret99x"] * 2 + ["k9Qm2Zx81LpWq7Tn"] * 2
    label = {(r.doc_id, r.token): r.secret for r in secret_scan.labelled_by_format(secret_scan.candidates(make(rows))).collect()}
    assert label[3, "h4nter22"] == label[2, aws] == label[2, hub] == label[4, "hunter2secret"] == label[8, "hunter2secret99x"] == 1.0
    assert label[6, "org/a-page-of-many-words"] == 0.0 and (1, key) not in label


def test_secrets_of_a_format_not_trained_on(make):
    rng = np.random.default_rng(10)
    drawn = lambda n, of: "".join(rng.choice(list(of), n))
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = []
    for i in range(120):
        rows += [(4 * i, f"{PROSE} key AKIA{drawn(16, mixed[:26] + '0123456789')} then"), (4 * i + 1, f"{PROSE} key xoxb-{drawn(30, mixed)} then"),
                 (4 * i + 2, f"{PROSE} key {''.join(rng.choice(PROSE.split(), 9))} then"), (4 * i + 3, f"{PROSE} key ghp_{drawn(36, mixed)} then")]
    unseen = lambda found: secret_scan.labelled_by_format(found).filter("doc_id % 4 != 3")
    kept = [r.kept for r in secret_scan.scan(make(rows), unseen).collect() if r.doc_id % 4 == 3]
    assert len(kept) == 120 and sum(kept) >= 0.9 * len(kept)


def test_secrets_odd_rows(make, odd):
    rows = secret_scan.scan(make([*odd, (30, "a" * 5000), (30, "a" * 5000), (None, "9" * 16)])).collect()
    assert sorted((r.doc_id or 0, len(r.token)) for r in rows) == [(0, 16), (30, 5000), (30, 5000)] and all(r.score is None and r.kept for r in rows)
    assert secret_scan.scan(make([])).collect() == []


def test_licence_headers_files_and_inheritance(spark):
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/b/c/x", PROSE), ("a/b/LICENSE", "Licensed under CC BY-NC 4.0."),
            ("a/b/y", f"{PROSE}\nLicensed under the Apache License, Version 2.0.\n{PROSE}"), ("a/z", PROSE), ("q/z", PROSE), ("top", PROSE),
            (None, PROSE), (None, None), ("a/e", ""), ("a/b/y", f"{PROSE}\nLicensed under the Apache License, Version 2.0.\n{PROSE}")]
    rows += [(f"w/{i}", PROSE + f" more words {i}") for i in range(40)]
    frame = spark.createDataFrame([(i, p, t, "x") for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string, directory string")
    got = {r.doc_id: (r.licence, r.origin, r.line, r.from_directory) for r in licences.licences(frame).collect()}
    assert got[0] == ("MIT", "file", None, None) and got[1] == ("CC-BY-NC-4.0", "inherited", None, "a/b")
    assert got[3] == got[10] == ("Apache-2.0", "header", 1, None) and got[4] == ("MIT", "inherited", None, "a")
    assert got[5] == got[6] == got[7] == got[8] == (None, "none", None, None) and got[9] == ("MIT", "inherited", None, "a")
    assert len(got) == len(rows)
    assert licences.licences(frame.filter("doc_id < 0")).collect() == []


@pytest.mark.parametrize("n", [3, 90])
def test_licences_that_many_documents_carry(spark, n):
    """Two thirds of the rows have one notice, whether there are three rows or many."""
    notice = "Released under the MIT License."
    rows = [(i, f"{i % 3}/{i}", (notice, f"{PROSE}\nThe work is free to use\n{notice}\n{PROSE}", PROSE)[i % 3 if i != 3 else 1]) for i in range(n)]
    got = {r.doc_id: (r.licence, r.origin, r.line) for r in licences.licences(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert len(got) == n and got[0] == ("MIT", "file", None) and got[2] == (None, "none", None)
    assert all(got[i] == ("MIT", "header", 2) for i in range(1, n, 3))


def test_cosine_by_hand():
    matcher = licences.Matcher({"A": ("x y",), "B": ("x z z",)}, 9, {"x": 8, "y": 0, "z": 1})
    weigh = lambda df: math.log(10 / (1 + df)) + 1
    x, y, z, other = weigh(8), weigh(0), weigh(1), weigh(1)
    cosine = (x * x + y * y) / math.sqrt((x * x + y * y) * (x * x + y * y + other * other))
    assert matcher.best(["x", "y", "q"]) == (pytest.approx(cosine), "A")


def _items(rng, n):
    words = ["".join(rng.choice(list("bcdfgaeiou"), 6)) for _ in range(400)]
    return [(i, " ".join(rng.choice(words, 14)) + "\n" + " ".join(rng.choice(words, 6))) for i in range(n)]


@pytest.mark.parametrize("shard, passing", [(512, 2_000_000), (16, 2_000_000), (32, 300)])
def test_leaks_are_those_that_brute_force_finds(spark, make, monkeypatch, shard, passing):
    monkeypatch.setattr(contamination, "SHARD", shard)
    monkeypatch.setattr(contamination, "PASS_POSTINGS", passing)
    rng = np.random.default_rng(11)
    items = [*_items(rng, 60), (900, None), (901, ""), (902, "?!"), (7, "dup of seven is another part of it with nine words")]
    docs = []
    for i in range(80):
        noise = " ".join(rng.choice(PROSE.split() + items[i % 60][1].split()[:6], int(rng.integers(0, 500))))
        item = items[int(rng.integers(0, 60))][1].split()
        if i % 4 == 1:
            item[int(rng.integers(0, 20))] = "changed"
        if i % 4 == 2:
            item = item[:8]
        docs.append((i, noise + " " + " ".join(item).upper() + "; " + noise))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contamination.matches(make(docs), benchmark).collect()}

    def shingles(words):
        return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}

    want = set()
    for d, text in docs:
        have = shingles(contamination._terms(text))
        for item, told in items:
            question, _, answer = (told or "").rpartition("\n")
            parts = [p for p in (contamination._terms(question), contamination._terms(answer)) if p]
            whole = [p for p in [*parts, sum(parts, [])] if len(p) >= 5]
            if parts and all(sum(s in have for s in [tuple(p[i:i + 5]) for i in range(len(p) - 4)]) >= 0.8 * (len(p) - 4) for p in whole):
                want.add((d, item))
    assert got == want and len(want) > 20
    kept = contamination.drop_contaminated(make(docs), benchmark)
    assert kept.columns == make(docs).columns and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_leaks_odd_rows(spark, make, odd):
    items = spark.createDataFrame([(1, PROSE), (2, PROSE), (None, "x y"), (3, None)], "item_id long, text string")
    got = contamination.matches(make(odd), items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, i) for d in (5, 6, None, 7, 8) for i in (1, 2)}
    assert len(contamination.drop_contaminated(make(odd), items).collect()) == 7
    assert contamination.matches(make([]), items).collect() == [] and contamination.matches(make(odd), items.limit(0)).collect() == []
    assert contamination.drop_contaminated(make(odd), items.limit(0)).count() == len(odd)


def test_item_longer_than_a_part(spark, make):
    rng = np.random.default_rng(12)
    words = ["".join(rng.choice(list("bcdfgaeiou"), 6)) for _ in range(400)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    got = contamination.matches(make([(1, "so " + " ".join(words) + " it is"), (2, " ".join(words[:100]))]), items).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 1)]  # one row per document and item, whatever its number of parts


@pytest.mark.parametrize("n", [129, 130, 256, 300])
def test_long_items_are_judged_whole(spark, make, n):
    rng = np.random.default_rng(n)
    words = ["".join(rng.choice(list("bcdfgaeiou"), 6)) for _ in range(n)]
    fill = lambda k: " ".join(rng.choice(PROSE.split(), k))
    item = " ".join(words[:n - 6]) + "\n" + " ".join(words[n - 6:])
    cut = n // 2
    docs = [(1, f"{fill(300)} {' '.join(words)} {fill(300)}"), (2, f"{fill(90)} {words[-1]} {fill(90)}"), (3, f"{fill(50)} {' '.join(words[-5:])} {fill(50)}"),
            (4, " ".join(words[:cut]) + fill(5)), (5, f"{' '.join(words[:cut + 4])} {fill(700)} {' '.join(words[cut:])}"),
            (6, " ".join(words[:n - 6])), (7, " ".join(words[n // 8:]))]
    benchmark = spark.createDataFrame([(1, item), (2, item.split("\n")[0])], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.overlap for r in contamination.matches(make(docs), benchmark).collect()}
    apart = {(5, 2)} if n - 6 > contamination.PART else set()  # an item of one part must lie in one passage
    assert set(got) == {(1, 1), (1, 2), (5, 1), (6, 2), (7, 1), (7, 2)} | apart and got[1, 1] == got[5, 1] == 1.0
    assert {r.doc_id for r in contamination.drop_contaminated(make(docs), benchmark).collect()} == {2, 3, 4}


def test_parts_cover_an_item_and_are_full():
    for n in range(1, 700):
        starts = contamination.part_starts(n)
        assert {i for k in starts for i in range(k, min(n, k + contamination.PART))} == set(range(n))
        assert len(set(starts)) == len(starts) and (n <= contamination.PART or all(k + contamination.PART <= n for k in starts))


def test_bounds_never_pass_over_a_match():
    rng = np.random.default_rng(13)
    items = [{"item_id": i, "part": 0, "terms": list(rng.choice(list("abcdefghijklmnop"), 9)), "asked": 9, "mean": 9.0} for i in range(40)]
    for item in items:
        item["weights"] = [1.0 + (ord(t) - 97) / 4 for t in item["terms"]]
    searcher = contamination.Searcher(items, 0.5, 0.8)
    shard = searcher.shards[0]
    flat = rng.integers(0, len(searcher.vocabulary) + 1, 600)
    starts = np.arange(0, 590, 6)
    ends = np.minimum(starts + 10, 600)
    got = {(p, j) for p, j, _ in shard.search(flat, starts, ends)}
    want = set()
    for p, (a, b) in enumerate(zip(starts, ends)):
        columns = np.unique(shard.column[flat[a:b]])
        scores = shard.impact[columns[columns > 0]].sum(axis=0, dtype=np.float64)
        want |= {(p, int(j)) for j in np.flatnonzero(scores >= 0.5)}
    assert got == want and want


def test_columns_of_the_queries(spark, sf_dir):
    rows = queries.op9_bm25_decontamination(spark, sf_dir)
    assert rows.filter(F.col("overlap") < contamination.OVERLAP).count() == 0
