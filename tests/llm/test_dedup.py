"""Exact and near dedup against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from astrolabe.llm import common, exact_dedup, mixing, near_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_id string, Copies int"


def table(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    rows = [(i, t, "en", "s", len(t or ""), "x", k) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def corpus(seed=3):
    """Unrelated texts, copies, edited copies in chains, short ones, shared passages."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = text(60)
    out = [None, "", " \n", "one", "One", "a b c d", "a b c d e", "A  b c d e"]
    for _ in range(12):
        base = text(r.randrange(8, 300)).split()
        out.append(" ".join(base))
        for _ in range(r.randrange(0, 6)):
            at = r.randrange(len(base))
            base = [*base[:at], r.choice(words), *base[at + r.randrange(2) :]]
            out.append(("  " if r.random() < 0.5 else " ").join(base))
    out += [text(40) + " " + passage + " " + text(40) for _ in range(15)]
    out += [out[9], out[9].upper(), out[12] + " ", out[12]]
    return out


def shingles(text):
    w = WORD.findall((text or "").encode().lower().decode())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_components(ids, texts, percent=85):
    sets = [shingles(t) for t in texts]
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {x: min(ids[k] for k in range(len(ids)) if label[k] == x) for x in set(label)}
    return [(i, len(s), least[x]) for i, s, x in zip(ids, sets, label, strict=True)]


def test_near_duplicates_match_brute_force(spark):
    texts = corpus()
    got = near_dedup.near_duplicates(table(spark, texts)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(list(range(len(texts))), texts)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_one_row_of_each_component_stays(spark):
    texts = corpus(4)
    kept = near_dedup.drop_near_duplicates(table(spark, texts))
    assert kept.columns == [f.split()[0] for f in SCHEMA.split(", ")]
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute_components(list(range(len(texts))), texts)})


def test_near_repeated_and_null_ids(spark):
    ids, texts = [7, 7, None, None, 3], ["a b c d e f", "A b c d e f", "q r s t u", "v w x y z", "a b c d e f"]
    docs = table(spark, texts, ids)
    assert sorted((str(r.doc_id), str(r.component_id)) for r in near_dedup.near_duplicates(docs).collect()) == [("3", "3"), ("7", "3"), ("7", "3"), ("None", "None"), ("None", "None")]
    assert sorted(str(r.doc_id) for r in near_dedup.drop_near_duplicates(docs).collect()) == ["3", "None", "None"]


def test_empty_tables(spark):
    docs = table(spark, ["x"]).limit(0)
    assert near_dedup.near_duplicates(docs).collect() == [] == exact_dedup.duplicates(docs).collect()
    assert near_dedup.drop_near_duplicates(docs).collect() == [] == exact_dedup.drop_duplicates(docs).collect()


def test_components_of_chains_and_stars(spark):
    r = random.Random(1)
    pairs = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)]
    label = {x: x for p in pairs for x in p}
    for _ in range(len(label)):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = near_dedup.components(spark.createDataFrame(pairs, "a long, b long"))
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert {(x.id, x.root) for x in got.collect()} == {(k, v) for k, v in label.items() if k in linked}


def test_components_of_many_edges(spark, monkeypatch):
    """The driver's components of few edges are those of the alternating stars."""
    r = random.Random(9)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(500 + k, 501 + k) for k in range(50)]
    links = spark.createDataFrame(pairs, "a long, b long")
    few = {(x.id, x.root) for x in near_dedup.components(links).collect()}
    monkeypatch.setattr(near_dedup, "FEW_EDGES", 0)
    assert few == {(x.id, x.root) for x in near_dedup.components(links).collect()} and {500, 550} <= {x for x, root in few if root == 500}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("drop", [exact_dedup.drop_duplicates, near_dedup.drop_near_duplicates, mixing.mix_documents])
def test_whole_rows_stay_where_they_are(spark, drop):
    """What a stage hands on is found by bit maps, not by a shuffle of all columns, at any size."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(drop(table(spark, corpus(7)[:40])))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"\w+Join", plan)[0] == "BroadcastHashJoin"  # the outermost, of whole rows


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot", [2, 1000])
def test_skew_joins(spark, monkeypatch, hot, how):
    """One join of all rows where no key is hot; with and without hot keys the rows of a plain join."""
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rows = spark.createDataFrame([(k % 7 if k % 5 else None, k) for k in range(50)], "key int, v long")
    sizes = spark.createDataFrame([(k, 10 if k < 2 else 1) for k in range(5)], "key long, n long")
    got = common.skew_join(rows, sizes, ["key"], "n", 50, how)
    want = rows.join(sizes, "key", how)
    assert sorted(map(str, got.select("key", "v", "n").collect())) == sorted(map(str, want.select("key", "v", "n").collect()))
    assert plan_of(got).count("LeftOuter") == (0 if how == "inner" else 1 if hot == 1000 else 2)


def test_bands_and_estimates_of_known_similarity():
    r = np.random.default_rng(5)
    missed, errors = 0, []
    for _ in range(300):
        n = int(r.integers(30, 3000))
        pool = r.integers(0, 2**64, size=n, dtype=np.uint64)
        cut = int(0.07 * n)  # similarity a little over 0.85
        a, b = np.unique(pool[: n - cut]), np.unique(pool[cut:])
        x, y = near_dedup.sketch(a), near_dedup.sketch(b)
        missed += not (near_dedup.band_keys(x)[0] == near_dedup.band_keys(y)[0]).any()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        errors.append(float(near_dedup.estimates(x[None], y[None], np.array([len(a)]), np.array([len(b)]))[0]) - true)
    assert missed == 0
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


@pytest.mark.parametrize("percent", [80, 85])
def test_similarity_is_a_parameter(spark, percent):
    r = random.Random(percent)
    texts, linked = [], []
    for _ in range(25):
        base = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(60, 400))]
        n = len(base) - 4
        more = round(n / 0.825) - n  # similarity n / (n + more), between 0.80 and 0.85
        texts += [" ".join(base), " ".join(base + [f"v{r.randrange(10**6)}" for _ in range(more)])]
        linked.append(100 * n >= percent * (n + more))
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(table(spark, texts), percent).collect()}
    assert [got[2 * k + 1] == 2 * k for k in range(25)] == linked == [percent == 80] * 25
    kept = near_dedup.drop_near_duplicates(table(spark, texts), percent).count()
    assert kept == (25 if percent == 80 else 50)


def test_shapes_and_estimates_of_similarities():
    assert near_dedup.band_shape(85) == (25, 5) and near_dedup.band_shape(80) == (32, 4)
    assert [near_dedup.least_estimate(p, n, d) for p in (85, 80) for n, d in ((128, 2), (1024, 3))] == [0.69, 0.794, 0.62, 0.737]


@pytest.mark.parametrize("block", [2, 512])
def test_families_in_blocks(spark, monkeypatch, block):
    """Families and buckets larger than a block give the same components."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    texts = corpus(6)[:60]
    got = near_dedup.near_duplicates(table(spark, texts)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(list(range(len(texts))), texts)


def test_a_forest_joins_what_is_linked_and_hands_on_no_more():
    r = random.Random(2)
    linked = {(i, j) for i in range(30) for j in range(i) if r.random() < 0.1}
    labels = np.arange(30)
    both = np.arange(30)
    got = near_dedup._forest(labels, both, both, True, lambda i, js: [j for j in js.tolist() if (max(i, j), min(i, j)) in linked])
    parent = list(range(30))
    for i, j in linked:
        old, new = parent[i], parent[j]
        parent = [new if p == old else p for p in parent]
    assert len({(int(a), b) for a, b in zip(labels, parent, strict=True)}) == len(set(parent)) == 30 - len(got)


def test_hot_keys_change_nothing(spark, monkeypatch):
    """Sets, buckets and hubs that count as hot go by the broadcast of their keys."""
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    texts = corpus(8)[:50] + ["one two three four five six"] * 9
    got = near_dedup.near_duplicates(table(spark, texts)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(list(range(len(texts))), texts)


def test_blocks_of_a_large_group(spark, monkeypatch):
    """Members of one block meet in it; across, all of unlike pieces do, and rows grow with those outside the largest."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    members = spark.createDataFrame([(1, k, 0 if k < 40 else k) for k in range(43)] + [(2, k, 9) for k in range(20)], "key long, cid long, piece long")
    rows = near_dedup._across(members, 63).collect()
    assert {r.key for r in rows} == {1} and len(rows) == 40 + 3 * 11
    together = {(a.cid, b.cid) for a in rows for b in rows if (a.low, a.high) == (b.low, b.high) and a.piece != b.piece}
    assert together == {(a, b) for a in range(43) for b in range(43) if a != b and (a >= 40 or b >= 40)}


@pytest.fixture
def shifting(spark, monkeypatch, tmp_path):
    """A table of many files whose splits, and so the rows' places, differ from one stored table to the next."""
    texts = corpus(5) + ["w " * k for k in range(30)] + ["same text"] * 5
    table(spark, texts).repartition(12).write.parquet(str(tmp_path / "documents.parquet"))
    count, real = [0], common.staged

    def staged(*args, **named):
        out = real(*args, **named)
        count[0] += 1
        spark.conf.set("spark.sql.files.minPartitionNum", [2, 12, 5][count[0] % 3])
        spark.conf.set("spark.sql.files.maxPartitionBytes", ["128m", "2k", "1m"][count[0] % 3])
        return out

    for module in (common, exact_dedup, near_dedup, mixing):
        monkeypatch.setattr(module, "staged", staged)
    yield spark.read.parquet(str(tmp_path / "documents.parquet")), texts
    for name in ("minPartitionNum", "maxPartitionBytes"):
        spark.conf.unset(f"spark.sql.files.{name}")


def test_splits_may_change_between_passes(shifting):
    docs, texts = shifting
    groups = exact_groups(texts)
    assert sorted(r.doc_id for r in exact_dedup.drop_duplicates(docs).collect()) == sorted(g[0] for g in groups.values())
    want = brute_components(list(range(len(texts))), texts)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect()) == want
    assert sorted(r.doc_id for r in near_dedup.drop_near_duplicates(docs).collect()) == sorted({c for _, _, c in want})
    copies = {r.doc_id: r.copies for r in mixing.mix_sizes(docs).collect()}
    mixed = [r.doc_id for r in mixing.mix_documents(docs).collect()]
    assert sorted(mixed) == sorted(k for k, n in copies.items() for _ in range(n))


def exact_groups(texts):
    groups = defaultdict(list)
    for k, t in enumerate(texts):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(k)
    return groups


@pytest.mark.parametrize("hot", [False, True])
def test_exact_duplicates_match_brute_force(spark, monkeypatch, hot):
    if hot:  # every repeated text goes the way of hot ones
        monkeypatch.setattr(common, "HOT_ROWS", 2)
    texts = corpus() + ["hot text"] * 40 + ["hot\ttext"] * 3
    got = {r.doc_id: r for r in exact_dedup.duplicates(table(spark, texts)).collect()}
    assert len(got) == len(texts)
    for members in exact_groups(texts).values():
        for k in members:
            assert (got[k].keep_id, got[k].group_size, got[k].kept) == (members[0], len(members), k == members[0])


@pytest.mark.parametrize("hot", [False, True])
def test_texts_of_one_digest_never_merge(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(common, "HOT_ROWS", 2)
    lit = exact_dedup.F.lit
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda *_: lit("ab" * 32))
    monkeypatch.setattr(exact_dedup.F, "md5", lambda *_: lit("cd" * 16))
    assert {r.group_size for r in exact_dedup.duplicates(table(spark, ["a", "a"])).collect()} == {2}
    got = exact_dedup.duplicates(table(spark, ["a", "b", "a", "c", "b", "a"], [7, 3, 5, None, 4, 5])).collect()
    want = [("3", "3", 2, True), ("4", "3", 2, False), ("5", "5", 3, False), ("5", "5", 3, True), ("7", "5", 3, False), ("None", "None", 1, True)]
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got) == want


def test_exact_repeated_and_null_ids(spark):
    ids, texts = [5, 5, 5, None, None, None, 2], ["a", "a", "b", "a", "c", "c", "d"]
    docs = table(spark, texts, ids)
    got = sorted((str(r.doc_id), r.group_size, str(r.keep_id), r.kept) for r in exact_dedup.duplicates(docs).collect())
    assert got == sorted([("5", 3, "5", True), ("5", 3, "5", False), ("5", 1, "5", True), ("None", 3, "5", False), ("None", 2, "None", True), ("None", 2, "None", False), ("2", 1, "2", True)])
    assert sorted((str(r.doc_id), r.text) for r in exact_dedup.drop_duplicates(docs).collect()) == [("2", "d"), ("5", "a"), ("5", "b"), ("None", "c")]
