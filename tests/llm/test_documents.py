"""Operators over documents, against brute force, SQL, round trips and held-out accuracy."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import plain_llm as plain
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegauge.llm import decontaminate, host_rules, langid, license_scan, near_dedup, packing, pseudo_likelihood, secrets, substring_dedup
from tidegauge.llm.common import read_table


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def nth(rows):
    return sorted(rows, key=str)


# --- near duplicates


def test_near_dedup_equals_brute_force(spark, small):
    docs = read_table(spark, small, "documents")
    rows = pairs(docs)
    want = plain.near_classes(rows)
    got = near_dedup.near_duplicates(docs).drop("rid").collect()
    assert len(got) == len(rows)
    text = dict(rows)
    assert {r.doc_id: r.class_id for r in got} == {d: want[t or ""] for d, t in text.items()}
    assert sorted(r.doc_id for r in got if r.stays) == sorted(set(want.values()))


def test_near_dedup_planted_edits_and_order(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(3000)]
    base = [list(rng.choice(words, 300)) for _ in range(12)]
    rows = []
    for k, b in enumerate(base):
        for c in range(6):
            edited = list(b)
            edited[40 * c + 5] = f"edit{k}x{c}"
            rows.append((len(rows), " ".join(edited)))
        rows.append((len(rows), " ".join(b[150:] + b[:150])))  # same shingles, other order
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    want = plain.near_classes(rows)
    assert got == {d: want[t] for d, t in rows}
    assert got[6] == 6


def test_near_dedup_large_group(spark):
    rng = np.random.default_rng(4)
    base = [f"v{x}" for x in rng.integers(0, 5000, 200)]
    rows = [(i, " ".join(base[: 5 + i % 190] + [f"e{i}"] + base[6 + i % 190 :])) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.class_id for r in near_dedup.near_duplicates(df).collect()} == {0}


def test_near_dedup_edited_copies_of_a_few_texts_equal_brute_force(spark):
    """Copies of four texts with up to 8 % of their words changed, many of them more apart from each other than
    from their original."""
    rng = np.random.default_rng(6)
    base = [[f"v{x}" for x in rng.integers(0, 5000, 160)] for _ in range(4)]
    rows = []
    for i in range(260):
        w = list(base[i % 4])
        for at in sorted(rng.choice(150, rng.integers(3, 13), replace=False), reverse=True):
            if rng.random() < 0.3:
                del w[at]
            else:
                w[at] = f"e{i}x{at}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = plain.near_classes(rows)
    assert len(set(want.values())) == 4
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    assert got == {d: want[t] for d, t in rows}


def test_near_dedup_recall_by_edit_rate(spark):
    """Copies of texts of 300 words with so many words replaced: all within the threshold are caught."""
    rng = np.random.default_rng(12)
    rows, rate = [], {}
    for k in range(200):
        base = [f"b{k}w{x}" for x in rng.integers(0, 2000, 300)]
        rows.append((2 * k, " ".join(base)))
        rate[2 * k] = k % 5
        for at in rng.choice(300, (1, 3, 6, 9, 24)[k % 5], replace=False):
            base[at] = f"e{k}x{at}"
        rows.append((2 * k + 1, " ".join(base)))
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    caught = Counter(rate[d] for d in rate if got[d + 1] == d)
    assert sum(caught.values()) >= 198 and min(caught.values()) >= 38  # up to 8 words in 100
    want = plain.near_classes(rows)
    assert sum(got[d] != want[t] for d, t in rows) <= 2


def test_near_dedup_recall_at_the_threshold(spark):
    """Pairs of texts of 300 words by similarity: a measured curve, and nothing under the threshold."""
    rng = np.random.default_rng(14)
    rows, rate = [], {}
    for k in range(400):
        base = [f"b{k}w{x}" for x in rng.integers(0, 2000, 300)]
        rows.append((2 * k, " ".join(base)))
        rate[2 * k] = (24, 36, 48, 60, 75)[k % 5]  # similarities of 0.92, 0.88, 0.84, 0.80 and 0.75
        for at in rng.choice(300, rate[2 * k], replace=False):
            base[at] = f"e{k}x{at}"
        rows.append((2 * k + 1, " ".join(base)))
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    caught = {n: sum(got[d + 1] == d for d in rate if rate[d] == n) / 80 for n in set(rate.values())}
    print(caught)
    assert caught[75] == 0 and caught[24] >= 0.95 and caught[36] >= 0.8


def test_prefixes_of_similar_texts_meet_early_enough(spark):
    """Texts of a split bucket with the asked share of common shingles have a token row in common, at places from
    where enough can still follow; tokens of a single text have no row."""
    rng = np.random.default_rng(17)
    base = rng.integers(0, 1 << 62, 120)
    rows, own = [], {}
    for i in range(60):
        w = base.copy() if i % 3 else rng.integers(0, 1 << 62, 120)
        w[rng.choice(120, int(rng.integers(0, 4)), replace=False)] = rng.integers(0, 1 << 62)
        w = w[: int(rng.integers(100, 121))]
        node = bytes([i])
        g = near_dedup.labelled(w.astype(np.uint64), 5)
        own[node] = g
        rows.append((node, len(g), node, i % 2 == 0, w.tolist()))
    rest = spark.createDataFrame(rows, "node binary, n int, class binary, outside boolean, words array<long>").repartition(3)
    shared = 0.8
    filed = near_dedup.prefixes(rest, 5, shared).collect()
    place = {(bytes(r.node), r.token): r.place for r in filed}
    texts = Counter(t for g in own.values() for t in g.view(np.int64).tolist())
    assert filed and all(r.texts >= 2 and r.texts >= texts[r.token] for r in filed)
    met = 0
    for a in own:
        for b in own:
            common = len(set(own[a].tolist()) & set(own[b].tolist()))
            if a < b and common >= shared / (1 + shared) * (len(own[a]) + len(own[b])):
                reach = [min(len(own[a]) - place[a, t], len(own[b]) - place[b, t]) for (x, t) in place if x == a and (b, t) in place]
                assert max(reach) >= shared / (1 + shared) * (len(own[a]) + len(own[b])) - 1e-9
                met += 1
    assert met > 50


def test_near_dedup_knows_words_without_case_and_punctuation(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (2, base.replace("w7 w8", "w7. W8").replace("w20", "«W20»")), (3, base + " " + base), (4, "?! ?!"), (5, "?!"), (6, "?! ?!")]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 4}


def test_near_dedup_links_texts_with_and_without_repeats(spark):
    """One text repeats a shingle, its copy doesn't."""
    words = [f"w{i}" for i in range(200)]
    again = words[:150] + words[:8] + words[158:]
    rows = [(1, " ".join(words)), (2, " ".join(again))]
    assert {r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()} == {1}


def test_alignment_equals_plain_subsequences():
    rng = np.random.default_rng(15)
    for _ in range(300):
        a = rng.integers(0, 12, int(rng.integers(1, 40)))
        b = np.array([x for x in a if rng.random() > 0.1] + list(rng.integers(0, 12, int(rng.integers(0, 4)))))
        want = plain.aligned(a.tolist(), b.tolist()) / max(len(a), len(b))
        for threshold in (0.5, 0.8, 0.95):
            assert near_dedup.alignment(a.astype(np.uint64), b.astype(np.uint64), threshold) == (want if want >= threshold - 1e-9 else 0.0)


def test_keep_one_row_of_equal_ids_and_texts_does_not_depend_on_order(spark):
    rows = [(1, "one text", s, n) for s, n in (("b", 2), ("a", 9), ("a", 3))]
    kept = [near_dedup.keep_one(spark.createDataFrame(x, "doc_id bigint, text string, source string, n bigint").repartition(3)).collect() for x in (rows, rows[::-1], rows[1:] + rows[:1])]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 1


def test_components_of_chains_and_stars(spark):
    from tidegauge.llm.components import components

    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(60)] + [(5, 5)]
    parent = list(range(3000))
    for a, b in links:
        parent[plain.find(parent, max(a, b))] = plain.find(parent, min(a, b))
    least = {}
    for x in {x for a, b in links if a != b for x in (a, b)}:
        least.setdefault(plain.find(parent, x), []).append(x)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {x: min(own) for own in least.values() for x in own}


def test_near_dedup_edges(spark, odd_docs, no_docs):
    got = near_dedup.near_duplicates(odd_docs).collect()
    assert len(got) == 11 and {r.class_id for r in got if r.doc_id in (4, 5)} == {4} and {r.class_id for r in got if r.doc_id in (1, 2)} == {1}
    kept = near_dedup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 6, 7, 8]
    assert near_dedup.near_duplicates(no_docs).count() == 0 and near_dedup.keep_one(no_docs).count() == 0


# --- secrets


def test_secrets_base_equals_plain(spark, small):
    docs = read_table(spark, small, "documents")
    text = dict(pairs(docs))
    for r in secrets.scan(docs).collect():
        base = plain.base_spans(text[r.doc_id])
        kinds = Counter(k for _, k, _ in base)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds[0], kinds[1], kinds[2])
        want = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(want.split(",")) - {""} <= set(r.spans.split(","))
        assert all(text[r.doc_id][f.start : f.end] == f.text for f in r.findings)


def test_secrets_models_on_held_out_strings():
    ratios = secrets.train(secrets.labelled_samples(seed=11))
    right = Counter()
    for text, label in secrets.labelled_samples(n=1000, seed=77):
        if len(text) >= 20:
            right[label, bool(secrets.model_spans(text, ratios, [], 12.0, 0.4)) == bool(label)] += 1
    assert right[1, True] > 0.85 * (right[1, True] + right[1, False])
    assert right[0, True] > 0.97 * (right[0, True] + right[0, False])


def test_secrets_edges(spark, odd_docs, no_docs):
    assert secrets.scan(odd_docs, mask="#").count() == 11 and secrets.scan(no_docs).count() == 0
    done = secrets.redact(odd_docs)
    assert done.columns == odd_docs.columns and {r.text for r in done.where("doc_id = 1").collect()} == {None}
    rows = [(1, "password = abcdef12; tail", 25), (2, "pass\U0001f600 token: 'abc", 1)]
    got = secrets.redact(spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")).collect()
    assert got[0].text == "[secret]; tail" and got[0].n_chars == 14 and got[1].text == rows[1][1]


# --- decontamination


def test_decontaminate_equals_brute_force(spark, small):
    docs, bench = read_table(spark, small, "documents"), read_table(spark, small, "benchmark")
    text = dict(pairs(docs))
    items = [(r.item_id, r.text) for r in bench.collect()]
    for blocks in (2_000_000, 500):
        got = decontaminate.decontaminate(docs, bench, block_words=blocks).collect()
        assert len(got) == len(text)
        assert any(r.contaminated for r in got)
        for r in got[:: 3 if blocks > 500 else 7]:
            n, hit, found = plain.contamination(text[r.doc_id], items)
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated, r["items"]) == (n, hit, len(found), hit > 0, found)
            assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_decontaminate_near_and_short(spark):
    item = [f"q{i}" for i in range(12)]
    docs = [(1, "pre " + " ".join(item).upper() + " post"), (2, " ".join(item[:6] + ["extra"] + item[6:])), (3, "a b q0 q1"), (4, "Tiny Item"), (5, None)]
    bench = [("x", " ".join(item)), (None, "a b"), ("t", "tiny-item"), ("e", ""), ("n", None)]
    got = {r.doc_id: r for r in decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id string, text string")).collect()}
    assert got[1].n_hit == 12 and got[1]["items"] == ["x"]
    assert not got[2].contaminated and got[2].near_items == ["x"]
    # The words of an item without an id are hit, but add no item.
    assert (got[3].n_hit, got[3]["items"], got[3].contaminated) == (2, [], True) and got[4]["items"] == ["t"] and got[5].n_words == 0


def test_decontaminate_null_item_ids(spark):
    docs = spark.createDataFrame([(1, "a b q0 q1"), (2, "c d a b"), (3, "x y")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(None, "a b"), ("i", "c d")], "item_id string, text string")
    for blocks in (2_000_000, 2):
        got = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench, block_words=blocks).collect()}
        assert [(got[k].n_hit, got[k]["items"], got[k].contaminated) for k in (1, 2, 3)] == [(2, [], True), (4, ["i"], True), (0, [], False)]
    assert [r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()] == [3]


def test_decontaminate_near_matches_do_not_depend_on_other_documents(spark):
    item = [f"q{i}" for i in range(10)]
    docs = [(1, " ".join(item[:4] + ["other"] + item[5:])), (2, " ".join(f"z{i}" for i in range(30))), (3, "q4 q3")]
    bench = spark.createDataFrame([("x", " ".join(item))], "item_id string, text string")
    for own in (docs, docs[:1]):
        got = {r.doc_id: r for r in decontaminate.decontaminate(spark.createDataFrame(own, "doc_id bigint, text string"), bench).collect()}
        assert got[1].near_items == ["x"] and not got[1].contaminated


def test_decontaminate_common_words_and_candidates_in_portions(spark, monkeypatch):
    rng = np.random.default_rng(2)
    docs = [(d, " ".join(rng.choice(["to", "be", "or"], 400))) for d in range(6)] + [(9, None), (None, "to be or")]
    bench = [(f"i{k}", " ".join(rng.choice(["to", "be", "or"], 5 + k))) for k in range(12)] + [("i0", "to be or to be or")]
    monkeypatch.setattr(decontaminate, "CANDIDATES", 50)
    frames = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id string, text string")
    for blocks in (500_000, 20):
        got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontaminate.decontaminate(*frames, block_words=blocks).collect()), key=str)
        assert got == sorted(((d, *plain.contamination(t, bench)) for d, t in docs), key=str)
        clean = {(r.doc_id, r.text) for r in decontaminate.keep_clean(*frames, block_words=blocks).collect()}
        assert clean == {(d, t) for d, t in docs if not plain.contamination(t, bench)[1]}


def test_decontaminate_equal_items_are_one_and_blocks_stay_small(spark, monkeypatch):
    item = " ".join(f"q{i}" for i in range(11))
    bench = [(7, item)] * 3000 + [(k, " ".join(f"i{k}x{j}" for j in range(12))) for k in range(40)]
    docs = [(1, f"a {item} b"), (2, " ".join(f"i3x{j}" for j in range(12))), (2, " ".join(f"i3x{j}" for j in range(12))), (3, "q4 z q5 q6 and no more")]
    sizes = []
    windows = decontaminate.windows_of
    monkeypatch.setattr(decontaminate, "windows_of", lambda items, *a: sizes.append(sum(len(decontaminate.words(t)) for _, t in items)) or windows(items, *a))
    frames = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string")
    one = {(r.doc_id, r.n_hit, tuple(r["items"]), tuple(r.near_items)) for r in decontaminate.decontaminate(*frames).collect()}
    many = decontaminate.decontaminate(*frames, block_words=100).collect()
    assert {(r.doc_id, r.n_hit, tuple(r["items"]), tuple(r.near_items)) for r in many} == one and len(many) == 4
    assert sizes[0] == 491 and max(sizes[1:]) <= 200 and sum(sizes[1:]) == 491
    assert (1, 11, ("7",), ()) in one and (2, 12, ("3",), ()) in one


def test_decontaminate_near_match_at_the_start_of_a_document(spark):
    item = [f"q{i}" for i in range(10)]
    docs = spark.createDataFrame([(1, "some other text"), (2, " ".join(item[2:]))], "doc_id bigint, text string").coalesce(1)
    bench = spark.createDataFrame([("x", " ".join(item)), ("y", "q0 q1 q0 q1")], "item_id string, text string")
    got = {r.doc_id: r.near_items for r in decontaminate.decontaminate(docs, bench).collect()}
    assert got == {1: [], 2: ["x"]}


def test_decontaminate_edges(spark, odd_docs, no_docs, small):
    bench = read_table(spark, small, "benchmark")
    assert decontaminate.decontaminate(odd_docs, bench).count() == 11
    assert decontaminate.keep_clean(odd_docs, bench).columns == odd_docs.columns
    assert decontaminate.decontaminate(no_docs, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.decontaminate(odd_docs, bench.limit(0)).collect())


# --- substrings


def test_substring_dedup_equals_brute_force(spark, small):
    docs = read_table(spark, small, "documents")
    got = substring_dedup.remove_repeats(docs).drop("kept").collect()
    assert nth(tuple(r) for r in got) == nth(plain.repeats(pairs(docs)))


def test_substring_dedup_planted(spark):
    rng = np.random.default_rng(8)
    words = [f"s{i}" for i in range(400)]
    shared = [list(rng.choice(words, 70)) for _ in range(4)]
    rows = []
    for d in range(120):
        own = list(rng.choice(words, 60))
        part = shared[d % 4][d % 9 : 70 - d % 7]
        rows.append((d // 2 * 2 if d % 11 == 0 else d, " ".join(own[: d % 60] + part + own[d % 60 :] + (part if d % 5 == 0 else []))))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = nth(plain.repeats(rows))
    for limit in (256, 8):  # 8: crowded shards are cut
        got = substring_dedup.remove_repeats(df, max_snippets=limit).drop("kept").collect()
        assert nth(tuple(r) for r in got) == want


def test_substring_dedup_constant_runs_in_a_crowded_shard(spark):
    rows = []
    for d in range(24):
        own = [f"d{d}w{i}" for i in range(20)]
        rows.append((d, " ".join(own[:10] + ["-"] * (56 + (d * 7) % 24) + own[10:])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = substring_dedup.remove_repeats(df, max_snippets=4).drop("kept").collect()
    assert nth(tuple(r) for r in got) == nth(plain.repeats(rows))


def test_substring_dedup_common_line_in_new_surroundings(spark):
    """A line that every document holds counts as common: windows over its ends are filed elsewhere."""
    rng = np.random.default_rng(15)
    line = [f"c{i}" for i in range(58)]
    rows = []
    for d in range(150):
        own = [f"u{x}" for x in rng.integers(0, 900, 40)]
        at = int(rng.integers(0, 40))
        rows.append((int(d % 140), " ".join(own[:at] + line[: 58 - d % 5] + own[at:])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert substring_dedup.common_files(df, 8).sum() >= 40
    for limit in (256, 4):
        got = substring_dedup.remove_repeats(df, max_snippets=limit).drop("kept").collect()
        assert nth(tuple(r) for r in got) == nth(plain.repeats(rows))


def test_substring_dedup_edges(spark, odd_docs, no_docs):
    got = substring_dedup.remove_repeats(odd_docs).drop("kept").collect()
    assert nth(tuple(r) for r in got) == nth(plain.repeats(pairs(odd_docs)))
    assert substring_dedup.remove_repeats(no_docs).count() == 0
    known = substring_dedup.remove_known(odd_docs, odd_docs.where("doc_id = 4"))
    assert {r.n_removed for r in known.where("doc_id in (4, 5)").collect()} == {80}


# --- language


def test_language_held_out_accuracy_and_spans(spark, small):
    docs = read_table(spark, small, "documents")
    model = langid.train(langid.train_split(docs))
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    held = [r for r in docs.where(langid.held_out()).collect() if r.lang and re.search(r"[^\W\d_]{3}", r.text or "")]
    right = sum(got[r.doc_id].lang_pred == r.lang for r in held)
    assert right >= 0.95 * len(held)
    # Two languages one after the other: two spans.
    longest = {}
    for r in docs.collect():
        if r.lang and len(r.text or "") > len(longest.get(r.lang, "")):
            longest[r.lang] = r.text
    a, b = sorted(longest)[:2]
    mixed = longest[a][:1500] + "\n" + longest[b][:600]
    _, _, spans = langid.label(mixed, model, 20.0)
    assert [s[2] for s in spans] == [a, b] and abs(spans[1][0] - 1501) < 40


def test_viterbi_equals_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    for _ in range(30):
        s = rng.normal(size=(6, 3)) * 3
        best = max(itertools.product(range(3), repeat=6), key=lambda p: sum(s[i, x] for i, x in enumerate(p)) - 2.0 * sum(x != y for x, y in zip(p, p[1:])))
        assert tuple(langid.viterbi(s, 2.0)) == best


def test_viterbi_of_many_documents_equals_one_at_a_time():
    rng = np.random.default_rng(4)
    parts = [rng.normal(size=(int(n), 4)) * 4 for n in rng.integers(1, 60, 40)]
    together = langid.viterbi_many(parts, 6.0)
    for s, path in zip(parts, together):
        value, back = s[0].copy(), []
        for row in s[1:]:
            came = [max(range(4), key=lambda a: (value[a] - 6.0 * (a != b), a == b)) for b in range(4)]
            back.append(came)
            value = np.array([value[came[b]] - 6.0 * (came[b] != b) for b in range(4)]) + row
        want = [int(value.argmax())]
        for came in reversed(back):
            want.append(came[want[-1]])
        assert path.tolist() == want[::-1]


def test_language_scores_equal_plain_counts(spark):
    """Word scores from trigram counts made by hand."""
    rows = [(1, "Abba abc", "x"), (2, "zebra zoo", "y"), (3, None, "x"), (4, "abc", None)]
    model = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    counts = {}
    for _, text, lang in rows:
        for w in (text or "").lower().split() if lang else ():
            g = f"\0{w}\0"
            counts.setdefault(lang, Counter()).update(g[i : i + 3] for i in range(len(w)))
    assert sorted(counts) == sorted(model["langs"])
    total = {x: sum(c.values()) + 0.2 * langid.BUCKETS for x, c in counts.items()}
    _, _, got = langid.word_scores("abba zoo cab", model, floor=1e9)
    for w, row in zip("abba zoo cab".split(), got):
        g = f"\0{w}\0"
        logs = [sum(np.log((counts[x][g[i : i + 3]] + 0.2) / total[x]) for i in range(len(w))) for x in model["langs"]]
        assert np.allclose(row, np.array(logs) - max(logs), atol=1e-3)
    assert langid.label("\U00031350 \U00031351", model, 20.0)[0] in ("x", "y")  # letters of the third ideographic plane


def test_viterbi_two_halves_against_a_third_label():
    s = np.array([[0, -10, -0.6]] * 3 + [[-10, 0, -0.6]] * 3)
    assert langid.viterbi(s, 2.0).tolist() == [0, 0, 0, 1, 1, 1]


def test_language_edges(spark, odd_docs, no_docs):
    model = langid.train(odd_docs)
    got = {r.doc_id: r for r in langid.identify(odd_docs, model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[1].score == 0
    assert langid.keep_known(odd_docs, model).columns == odd_docs.columns
    empty = langid.train(no_docs)
    assert {r.lang_pred for r in langid.identify(odd_docs, empty).collect()} == {"und"} and langid.identify(no_docs, model).count() == 0


# --- quality


def test_quality_equals_plain(spark, small, odd_docs, no_docs):
    for docs in (read_table(spark, small, "documents"), odd_docs):
        out = host_rules.judge(docs)
        rows = docs.select("doc_id", "text", "source").collect()
        want = [(r.doc_id, *plain.rule_counts(r.text)) for r in rows]
        got = out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
        assert nth(tuple(r)[:6] for r in got) == nth(want)
        assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert host_rules.judge(no_docs).count() == 0


def test_quality_hosts(spark):
    good = " ".join(f"g{i}" for i in range(60))
    rows = [(i, good if i % 10 else "bad", "clean") for i in range(100)] + [(200 + i, "bad" if i % 10 else good, "junk") for i in range(100)] + [(400, good, None)]
    out = {r.doc_id: r for r in host_rules.judge(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert out[1].kept and not out[0].kept and not out[200].kept and out[200].host_rejected and not out[1].host_rejected
    assert out[400].host_docs == 1


def test_quality_hosts_by_rule(spark):
    """Each rule has its own rates: a host goes for symbols, doubled lines or long words alone, and a
    few such documents on a clean host stay."""
    words = [f"{a}{b}" for a in ("north", "river", "stone", "cloud", "plain", "grass", "early", "light") for b in ("ward", "side", "field", "fall", "land", "less", "ness", "line")]
    clean = " ".join(words)
    odd = {"symbols": " ".join(w + "##" for w in words), "lines": clean + "\nthe end of it\nthe end of it\nthe end of it", "length": " ".join(w * 3 for w in words)}
    rows = [(k, clean, "clean") for k in range(100)]
    for n, (host, text) in enumerate(odd.items(), 1):
        rows += [(1000 * n + k, text, host) for k in range(40)] + [(1000 * n + 500, text, "clean")]
    out = {r.doc_id: r for r in host_rules.judge(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    for n, host in enumerate(odd, 1):
        failed = {r: out[1000 * n][f"failed_{r}"] for r in host_rules.RULES}
        assert failed == {r: 40 * (r == host) for r in host_rules.RULES}
        assert out[1000 * n].host_rejected and not out[1000 * n].kept and not out[1000 * n].base_failed
        assert out[1000 * n + 500].kept and out[1000 * n + 500][f"failed_{host}"] == 1
    assert all(out[k].kept for k in range(100))


# --- packing


def check_pieces(pieces, docs):
    """Every id of every document lies in one piece, and sequences have no gaps."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    want = Counter()
    for d, t in docs:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        want[d, len(ids)] += 1
        own = sorted((p for p in by_doc[d] if p.doc_tokens == len(ids)), key=lambda p: p.start)
        assert sum(p.length for p in own) % len(ids) == 0
        assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in own)
    for (d, n), times in want.items():
        assert sum(p.length for p in by_doc[d] if p.doc_tokens == n) == n * times
    padding = 0
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding


def test_packing_round_trip(spark, small, odd_docs, no_docs):
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = read_table(spark, small, "documents")
    assert check_pieces(packing.pack(docs, *paths).collect(), pairs(docs)) == 0
    assert check_pieces(packing.pack(odd_docs, *paths).collect(), pairs(odd_docs)) == 0
    few = docs.limit(20)
    assert check_pieces(packing.pack(few, paths[0]).collect(), pairs(few)) == 0
    assert packing.pack(no_docs, *paths).count() == 0


def test_packing_of_very_long_runs(spark):
    rows = [(1, " " * 1_000_000), (2, "\n" * 1_200_000 + "x"), (3, "a" * 1_000_000), (4, "word \t" * 300_000), (5, "-" * 199_999), (6, " " * 199_999 + "b"), (7, "7" * 150_000)]
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert check_pieces(packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), *paths).collect(), rows) == 0


def test_packing_ids_on_odd_texts():
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = np.random.default_rng(2)
    alphabet = list("aB1 \n\t'.,-_<|>é漢\U0001f600 \u2003\u0301\u00a0\u3000\x85\x1c\u200b") + ["'s", "'LL", "<|endoftext|>", "  ", "\r\n", "١", "Ⅳ", "\x00", "\ufeff"]
    for _ in range(1000):
        text = "".join(rng.choice(alphabet, rng.integers(0, 40)))
        assert encoder.quick.encode_to_numpy(text, allowed_special="all").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_ids_of_every_code_point():
    """Each code point between a letter, a number, a blank and a sign: both encoders split there alike."""
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000 and (p < 0x32000 or p % 1009 == 0 or p >= 0xE0000 and p < 0xE0200)]
    for k in range(0, len(points), 500):
        texts = [f"a{c}a 1{c}1 {c} {c}{c}.{c}'s{c}\n" for c in map(chr, points[k : k + 500])]
        want = encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        assert [encoder.quick.encode_to_numpy(t).tolist() for t in texts] == [w.ids for w in want]


def test_placement_balances_cost():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 1024, 400)
    placed = packing.place(lengths, 1024, 1.0, 1 / 1024)
    got = np.zeros(len(lengths), dtype=int)
    cost = defaultdict(float)
    for item, _, n, seq, _ in placed:
        got[item] += n
        cost[seq] += n + n * n / 1024
    assert (got == lengths).all()
    full = [c for s, c in cost.items() if s < lengths.sum() // 1024]
    assert max(full) <= 2.0 * min(full)


# --- licences


def test_license_scan(spark, odd_docs, no_docs):
    rows = [
        (1, "Some text here.\nReleased under the MIT License.\nMore text."),
        (2, "We talk about a driving license and permission to park, at length."),
        (3, "Licensed under the Apache License, Version 2.0.\n\n\U0001f600\n\nAll rights reserved."),
        (4, "This work is licensed under the GNU General Public License, version 3."),
        (5, "This work is licensed under the GNU General Public License, version 2."),
    ]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[k].licenses for k in (1, 2, 3, 4, 5)] == [["MIT"], [], ["Apache-2.0", "proprietary"], ["GPL-3.0"], ["GPL-2.0"]]
    f = got[3].findings[1]
    assert rows[2][1][f.start : f.end] == "All rights reserved." and not f.missing and not f.added
    assert license_scan.scan(odd_docs).count() == 11 and license_scan.scan(no_docs).count() == 0
    assert {r.n_licenses for r in license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), []).collect()} == {0}


def test_license_wording_is_compared_in_order(spark):
    rows = [
        (1, "License MIT the under Released."),
        (2, "Released now under the MIT License."),
        (3, "Our own terms: every gadget remains the property of Acme Ltd and must be returned."),
        (4, "MIT license, MIT License! Released under the MIT License. " * 3),
        (5, "nothing here " * 2000 + "Every gadget stays the property of Acme Ltd and must be returned."),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert got[1].licenses == [] and got[2].licenses == ["MIT"] and got[2].findings[0].added == ["now"] and got[2].findings[0].missing == []
    assert got[4].n_licenses >= 3
    own = {r.doc_id: r for r in license_scan.scan(df, [("acme", "Every gadget remains the property of Acme Ltd and must be returned."), ("none", "...")]).collect()}
    assert [own[k].licenses for k in (1, 2, 3, 4, 5)] == [[], [], ["acme"], [], ["acme"]]
    assert own[5].findings[0].missing == ["remains"] and own[5].findings[0].added == ["stays"]


def test_license_scan_equals_trying_everything():
    """Against every window of every template's length, whatever its words: the same licenses."""
    rng = np.random.default_rng(3)
    matcher = license_scan.Matcher(license_scan.TEMPLATES)
    for _ in range(60):
        name, template = license_scan.TEMPLATES[rng.integers(len(license_scan.TEMPLATES))]
        w = template.split()
        for _ in range(int(rng.integers(0, max(1, len(w) // 12) + 1))):
            at = int(rng.integers(len(w)))
            w[at : at + 1] = [] if rng.random() < 0.4 and len(w) > 4 else ["changed"]
        text = " ".join(["plain"] * int(rng.integers(0, 30)) + w + ["talk"] * int(rng.integers(0, 30)))
        listed = license_scan.WORD.findall(text.lower())
        every = []
        for k, (_, wanted, _, _) in enumerate(matcher.templates):
            anchors = {w for w, own in matcher.anchors.items() if k in {o[0] for o in own}}
            for first in range(len(listed)):
                window = listed[first : first + len(wanted)]
                if anchors & set(window) and (m := matcher.confirm(k, window, Counter(window))):
                    every.append(m)
        found = license_scan.scan_text(text, matcher)
        # A sentence or paragraph may have more in common than any window.
        assert max((f["common"] for f in found), default=0) >= max((m["common"] for m in every), default=0)
        assert not found or every or len(listed) < len(template.split())


def test_whole_license_texts_wrapped_and_on_one_line(spark):
    import textwrap

    whole = {n: max((t for k, t in license_scan.TEMPLATES if k == n), key=len) for n in ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC")}
    rows, want = [], []
    for name, text in whole.items():
        for body in (text, textwrap.fill(text, 76), "word " * 1500 + "\n" + textwrap.fill(text, 60) + "\nmore " * 3, "word " * 1500 + text):
            rows.append((len(rows), "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + body if name == "MIT" else body))
            want.append([name])
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [r.licenses for r in got] == want


# --- pseudo-likelihood


def test_scores_equal_brute_force_and_training_helps(spark, small, odd_docs, no_docs):
    docs = read_table(spark, small, "documents").limit(60)
    encoded = pseudo_likelihood.encode(docs).cache()
    start = pseudo_likelihood.pack(pseudo_likelihood.start_model())
    trained = pseudo_likelihood.train(encoded, shard_tokens=20_000)
    before, after = ({r.doc_id: r for r in pseudo_likelihood.score(encoded, p).collect()} for p in (start, trained))
    assert sum(r.log_likelihood for r in after.values()) > sum(r.log_likelihood for r in before.values())
    m = pseudo_likelihood.unpack(trained)
    C, R = pseudo_likelihood.CLASSES, pseudo_likelihood.RADIUS
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    for row in encoded.where("n between 1 and 60").limit(3).collect():
        ids = np.frombuffer(row.ids, np.uint16).astype(int)
        padded = [pseudo_likelihood.PAD] * R + ids.tolist() + [pseudo_likelihood.PAD] * R
        total = 0.0
        for i, t in enumerate(ids):
            around = [padded[i + R + d] for d in range(-R, R + 1) if d]
            h = np.tanh(sum(m["embed"][x] * w for x, w in zip(around, m["place"])) @ m["hidden"] + m["hidden_bias"])
            for k, (g, x) in enumerate(((0, t // C**2), (t // C**2, t // C % C), (t // C, t % C))):
                total += np.log(soft(h @ m[f"level{k}"][g] + m[f"level{k}_bias"][g])[x])
        assert abs(total - after[row.doc_id].log_likelihood) < 1e-3 * max(1, abs(total))
    got = pseudo_likelihood.pseudo_likelihood(odd_docs).collect()
    assert len(got) == 11 and all(r.log_likelihood == 0 and r.mean_log_likelihood is None for r in got if r.n_tokens == 0)
    assert pseudo_likelihood.pseudo_likelihood(no_docs).count() == 0


def test_more_shards_give_a_better_model(spark):
    """Held-out log-likelihood a token rises with the number of shards of one size."""
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    encoded = pseudo_likelihood.encode(docs).cache()
    held = encoded.where("doc_id % 5 = 0")
    part = "pmod(xxhash64(doc_id, 3), 8)"

    def mean(shards):
        rows = encoded.where(f"doc_id % 5 <> 0 and {part} < {shards}")
        tokens = rows.selectExpr("sum(n)").first()[0]
        model = pseudo_likelihood.train(rows, shard_tokens=-(-tokens // shards), batch=2048)
        return pseudo_likelihood.score(held, model).selectExpr("sum(log_likelihood) / sum(n_tokens)").first()[0]

    start = pseudo_likelihood.pack(pseudo_likelihood.start_model())
    untrained = pseudo_likelihood.score(held, start).selectExpr("sum(log_likelihood) / sum(n_tokens)").first()[0]
    found = [untrained, mean(1), mean(2), mean(4), mean(8)]
    print(found)
    assert found == sorted(found) and found[4] > found[1] + 0.05


def test_learning_step_follows_the_gradient():
    rng = np.random.default_rng(9)
    ids = np.concatenate([[pseudo_likelihood.PAD] * 2, rng.integers(0, 40, 300), [pseudo_likelihood.PAD] * 2]).astype(np.int32)
    at = np.arange(2, 302)
    net = pseudo_likelihood.Network(pseudo_likelihood.start_model())
    first = net.log_probs(ids, at).sum()
    for _ in range(20):
        net.learn(ids, at)
    assert net.log_probs(ids, at).sum() > first + 100


def test_vocabulary_grows_and_rare_tokens_share_no_frequent_number(spark):
    words = [f"v{i}" for i in range(3000)]
    rows = [(d, " ".join(words[d * 300 : d * 300 + 300] * (1 + d)) + ", end.") for d in range(10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    whole = pseudo_likelihood.build_vocabulary(docs)
    assert len(set(whole.known.values())) == 3003 and (whole.sizes == 1).all() and whole.counts.sum() == sum(300 * (1 + d) + 3 for d in range(10))
    part = pseudo_likelihood.build_vocabulary(docs, least=1000)
    number = {w: part.number(pseudo_likelihood.token_hash(w)) for w in [*words, ",", "end", "."]}
    shared = Counter(number.values())
    assert 600 <= len(part.known) <= 1000 and {shared[number[w]] for w in words[2700:]} == {1}
    assert all(part.sizes[k] == n for k, n in shared.items()) and part.sizes.max() > 1
    encoded = pseudo_likelihood.encode(docs, part)
    assert [r.n for r in encoded.orderBy("doc_id").collect()] == [300 * (1 + d) + 3 for d in range(10)]
    flat = pseudo_likelihood.pack(pseudo_likelihood.start_model(side=part.side, counts=part.counts))
    with_sizes, without = ({r.doc_id: r.log_likelihood for r in pseudo_likelihood.score(encoded, flat, v).collect()} for v in (part, None))
    want = sum(np.log(part.sizes[number[w]]) for w in words[:300])
    assert abs(without[0] - with_sizes[0] - want) < 1e-6 * want and abs(without[9] - with_sizes[9]) < 1e-6
    assert pseudo_likelihood.pseudo_likelihood(docs).count() == 10


def test_texts_are_read_once_and_tokens_are_those_of_the_pattern(spark):
    pattern = re.compile(r"\w+|[^\w\s]")
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    assert pseudo_likelihood.split(every)[0].tolist() == [m.start() for m in pattern.finditer(every)]
    texts = ["", None, " ", "a_1\u0301b  x-y\x1c\x85\u3000q.", "x" * 300_000 + " y." * 100_000 + "z", "the the"]
    n, hashes = pseudo_likelihood.hashed(texts)
    found = [pattern.findall(t or "") for t in texts]
    assert n.tolist() == [len(x) for x in found]
    assert hashes.tolist() == [h for x in found for h in map({w: pseudo_likelihood.token_hash(w) for w in {*sum(found, [])}}.get, x)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    docs = spark.createDataFrame([(d, f"word{d} and other words. " * 5) for d in range(40)], "doc_id long, text string").mapInArrow(counted, "doc_id long, text string")
    assert pseudo_likelihood.pseudo_likelihood(docs).count() == 40
    assert read.value == 40


def test_a_step_of_learning_is_the_plain_one():
    """Many groups of any size, with and without empty places in their chunks, against Adagrad token by token."""
    p = pseudo_likelihood
    rng = np.random.default_rng(4)
    ids = np.concatenate([[p.PAD] * 2, rng.zipf(1.3, 1500) % p.PAD, rng.permutation(np.repeat([7, 8, 250, 990], [512, 64, 4, 8])), [p.PAD] * 2]).astype(np.int32)
    at = rng.permutation(np.arange(2, len(ids) - 2))
    start = p.start_model()
    net = p.Network({k: v.copy() for k, v in start.items()})
    before = net.log_probs(ids, at)
    net.learn(ids, at)
    m = {k: v.astype(np.float64) for k, v in start.items()}
    grads = {k: np.zeros_like(v) for k, v in m.items()}
    for i, was in zip(at, before):
        near = ids[[i - 2, i - 1, i + 1, i + 2]]
        context = (m["embed"][near] * m["place"]).sum(axis=0)
        h = np.tanh(context @ m["hidden"] + m["hidden_bias"])
        t, C, dh, total = int(ids[i]), p.CLASSES, 0, 0
        for k, (g, x) in enumerate(((0, t // C**2), (t // C**2, t // C % C), (t // C, t % C))):
            e = np.exp(h @ m[f"level{k}"][g] + m[f"level{k}_bias"][g])
            total += np.log(e[x] / e.sum())
            d = e / e.sum() - np.eye(C)[x]
            grads[f"level{k}"][g] += np.outer(h, d)
            grads[f"level{k}_bias"][g] += d
            dh = dh + m[f"level{k}"][g] @ d
        assert abs(total - was) < 1e-4
        du = dh * (1 - h * h)
        grads["hidden"] += np.outer(context, du)
        grads["hidden_bias"] += du
        back = m["hidden"] @ du
        grads["place"] += m["embed"][near] * back
        np.add.at(grads["embed"], near, m["place"] * back)
    for k, g in grads.items():
        g /= len(at)
        assert np.abs(m[k] - net.rate * g / np.sqrt(p.FIRST_SUM + g * g) - net.m[k]).max() < 1e-5, k


def test_near_dedup_a_crowded_bucket_keeps_all_its_texts(spark):
    """Ten texts that agree in a band's key and in no deeper one still meet."""
    sigs = spark.createDataFrame([(i, bytes([i]) * 16, 20, [5, 100 + i]) for i in range(10)], "doc_id long, rid binary, n int, keys array<long>")
    assert {(r.key, r["size"]) for r in near_dedup.bucketed(sigs, 8).collect()} == {(5, 10)}
    assert near_dedup.bucketed(sigs, 8).count() == 10


def test_near_dedup_moves_only_the_texts_that_are_wanted(spark):
    rows = spark.range(20_000).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("rid"), F.concat(F.lit("text"), "id").alias("text"), "id")
    wanted = rows.where("id % 100 = 0").select("rid")
    got = {r.id for r in near_dedup.marked(rows, wanted).select("id").collect()}
    assert got >= set(range(0, 20_000, 100)) and len(got) <= 205
    assert near_dedup.marked(rows, wanted.limit(0)).count() == 0
