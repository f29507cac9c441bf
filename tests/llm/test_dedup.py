import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from eventloom.llm import exact, near, substring

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, n_words string, kept string"


def corpus(seed=1, n=60):
    """Random texts with copies, blank changes, near copies and shared passages, nulls and empties."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdé", k=rng.randint(1, 6))) for _ in range(400)]
    passage = rng.choices(words, k=30)
    texts = []
    for i in range(n):
        kind = rng.random()
        base = (texts and rng.choice([t for t in texts if t] or [""])) or " ".join(rng.choices(words, k=60))
        if kind < 0.35:
            text = " ".join(rng.choices(words, k=rng.choice([1, 3, 5, 12, 13, 14, 40, 90])))
        elif kind < 0.5:
            text = base
        elif kind < 0.6:
            text = re.sub(" ", lambda m: rng.choice([" ", "\n", "  ", "\t"]), base)
        elif kind < 0.8:
            own = base.split()
            for _ in range(max(1, len(own) // 30)):
                own[rng.randrange(len(own))] = rng.choice(words)
            text = " ".join(own)
        else:
            text = " ".join(rng.choices(words, k=rng.randint(0, 20)) + passage[rng.randint(0, 15) :] + rng.choices(words, k=rng.randint(0, 20)))
        texts.append(text)
    texts += [None, "", " \n", "A B c", "a b C", "é" * 30, "x y z"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(3)


# exact


def plain_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i is None, i))
    out = {}
    for bare, members in groups.items():
        keep = min(members, key=lambda m: (m[0], m[1], m[2] or 0))[2]
        for _, _, i in members:
            out[i] = (keep, len(members), i == keep, hashlib.sha256(bare.encode()).hexdigest())
    return out


@pytest.mark.parametrize("block", [7, 8192])
def test_exact(spark, block):
    rows = corpus()
    got = exact.exact_groups(frame(spark, rows), "doc_id", "text", block).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == plain_exact(rows) and len(got) == len(rows)


def test_exact_edge_cases(spark):
    df = frame(spark, [(None, "a b"), (3, "ab"), (3, "ab"), (None, None), (4, "c")])
    got = exact.exact_groups(df, "doc_id", "text").collect()
    assert sorted((r.keep_id is None, r.group_size, r.kept) for r in got) == [(False, 1, True), (True, 1, True), (True, 3, False), (True, 3, False), (True, 3, True)]
    kept = exact.drop_exact_duplicates(df, "doc_id", "text").collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in kept) == [(-1, ""), (-1, "a b"), (4, "c")]
    assert kept[0].n_words == "x"
    assert exact.exact_groups(df.limit(0), "doc_id", "text").count() == 0


def test_dropping_exact_copies(spark):
    """Rows of one key with different texts, equal rows, no keys, and a column that can't be compared."""
    rows = [(1, "x"), (2, "y"), (2, "x"), (2, "y"), (None, "x "), (None, "z"), (None, "z"), (3, None), (4, " ")]
    df = frame(spark, rows).withColumn("extra", F.create_map(F.lit("k"), F.col("doc_id")))
    got = exact.drop_exact_duplicates(df, "doc_id", "text")
    assert got.columns == df.columns
    # x: the null key's text is the longest; nothing and " ": the latter is longer
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, "x "), (0, "z"), (2, "y"), (4, " ")]
    assert exact.drop_exact_duplicates(df.limit(0), "doc_id", "text").count() == 0
    with pytest.raises(ValueError):
        exact.exact_groups(df.withColumnRenamed("doc_id", "keep_id"), "keep_id", "text")


# substrings


def plain_substring(rows, n=13):
    first = {}
    split = {i: WORD.findall(t or "") for i, t in rows}
    for i, w in split.items():
        for p in range(len(w) - n + 1):
            key = tuple(w[p : p + n])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in split.items():
        gone = {q for p in range(len(w) - n + 1) if first[tuple(w[p : p + n])] < i for q in range(p, p + n)}
        kept = " ".join(x for q, x in enumerate(w) if q not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("window,parts", [(13, 3), (4, 1)])
def test_substring(spark, window, parts):
    rows = corpus(2)
    got = substring.substring_duplicates(frame(spark, rows), "doc_id", "text", window, parts, with_spans=True).collect()
    want = plain_substring(rows, window)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)
    assert sum(w[1] for w in want.values()) > 100


def test_substring_edge_cases(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(5, text), (5, text), (None, text), (-7, "x " + text), (9, f"{text}  {text}\n"), (1 << 40, text)]
    got = substring.substring_duplicates(frame(spark, rows), "doc_id", "text").collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(-7, 0), (0, 20), (5, 20), (5, 20), (9, 40 - 0), (1 << 40, 20)]
    assert substring.substring_duplicates(frame(spark, rows).limit(0), "doc_id", "text").count() == 0
    for wrong in (frame(spark, rows).withColumn("doc_id", F.col("doc_id").cast("string")), frame(spark, rows).drop("n_words").withColumnRenamed("doc_id", "n_words")):
        with pytest.raises(ValueError):
            substring.substring_duplicates(wrong, wrong.columns[0], "text")


def test_packed_hashes_come_back():
    import numpy as np

    rng = np.random.default_rng(3)
    for values in ([], [5], [0, 1 << 31], [2**32 - 1], rng.integers(0, 1 << 32, 5000), np.arange(70_000) * 9 + 2**31):
        own = np.unique(np.array(values, np.uint64)).astype(np.uint32)
        assert substring._unpacked(substring._packed(own)).tolist() == own.tolist()
    dense = np.arange(4000, dtype=np.uint32) * 1_000_000
    assert len(substring._packed(dense)) < 3.1 * len(dense)


def test_batches_follow_the_bytes(spark):
    rows = corpus(7)
    got = substring.substring_duplicates(frame(spark, rows), "doc_id", "text", batch_bytes=900).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == plain_substring(rows)


# near


def plain_near(rows, size=5):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[p : p + size]) for p in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and label[a] != label[b] and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


def test_near(spark):
    rows = corpus(3, 80)
    got = near.near_groups(frame(spark, rows), "doc_id", "text", partitions=3).collect()
    want = plain_near(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want
    assert sum(not k for _, _, k in want.values()) > 10


def test_near_in_a_large_region(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(9999)}" for _ in range(120)]
    rows = []
    for i in range(90):
        own = list(base)
        own[rng.randrange(120)] = f"new{i}"
        rows.append((i, " ".join(own)))
    rows.append((500, " ".join(f"z{i}" for i in range(50))))
    got = {r.doc_id: r.component_id for r in near.near_groups(frame(spark, rows), "doc_id", "text", partitions=2).collect()}
    assert got == {i: 0 for i in range(90)} | {500: 500}


def family(n, size, template, pair):
    """n texts of `size` shingles, `template` of which all have; texts 2k and 2k + 1 share `pair`."""
    base = [f"w{i}" for i in range(template + 4)]
    return [
        (i, " ".join([*base, *(f"p{i // 2}-{x}" for x in range(pair - template)), *(f"s{i}-{x}" for x in range(size - pair))]))
        for i in range(n)
    ]


def mutants(n, size, changes, seed=8):
    """n texts of `size` shingles, `changes` words of which, anywhere, are their own."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        own = [f"w{x}" for x in range(size + 4)]
        for at in rng.sample(range(size + 4), changes):
            own[at] = f"new{i}-{at}"
        rows.append((i, " ".join(own)))
    return rows


def all_pairs(rows):
    """The groups by all pairs, and the mean similarity, from a matrix of shared shingles."""
    import numpy as np

    sets = [{" ".join(w[p : p + 5]) for p in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    number = {s: k for k, s in enumerate(sorted(set().union(*sets)))}
    has = np.zeros((len(sets), len(number)), np.float32)
    for i, own in enumerate(sets):
        has[i, [number[s] for s in own]] = 1
    shared = has @ has.T
    n = has.sum(1)
    united = n[:, None] + n - shared
    linked = 100 * shared >= 75 * united
    label = np.arange(len(rows))
    while True:
        lower = np.where(linked, label, len(rows)).min(1)
        if (lower == label).all():
            return dict(enumerate(label.tolist())), float((shared / united)[np.triu_indices(len(rows), 1)].mean())
        label = lower


def test_near_among_mutants_of_one_text(spark):
    """1000 sets of a mean similarity below the threshold, of which few are linked, against all pairs."""
    rows = mutants(1000, 200, 4)
    want, mean = all_pairs(rows)
    assert 0.6 < mean < 0.7 and 1 < len(set(want.values())) < 1000
    got = {r.doc_id: r.component_id for r in near.near_groups(frame(spark, rows), "doc_id", "text", partitions=4).collect()}
    assert got == want


@pytest.mark.parametrize("template", [300, 329, 338])
def test_near_partners_in_a_family(spark, template):
    """Partners at 0.762; the similarity to all others is 0.6, 0.70 or 0.73, so that nothing stands in for a link."""
    n = 2000 if template == 338 else 600
    got = {r.doc_id: r.component_id for r in near.near_groups(frame(spark, family(n, 400, template, 346)), "doc_id", "text", partitions=4).collect()}
    assert got == {i: i - i % 2 for i in range(n)}


def test_near_where_partitions_cut_regions(spark):
    """Small regions and large ones over many partitions: 40 pairs, a group of 300 near copies, a family of few links."""
    rng = random.Random(9)
    rows = family(400, 200, 160, 173)
    for k in range(40):
        words = [f"q{k}-{i}" for i in range(100)]
        rows += [(1000 + 2 * k, " ".join(words)), (1001 + 2 * k, " ".join([*words[:-1], "end"]))]
    base = [f"g{i}" for i in range(150)]
    for k in range(300):
        own = list(base)
        own[rng.randrange(150)] = f"g-{k}"
        rows.append((2000 + k, " ".join(own)))
    want = plain_near(rows[400:]) | {i: (200, i - i % 2, i % 2 == 0) for i in range(400)}
    got = near.near_groups(frame(spark, rows), "doc_id", "text", partitions=60).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want


def test_near_edge_cases(spark):
    rows = [(None, "a b c d e f"), (2, "A B C D E F"), (2, "a b c d e f"), (3, None), (4, "one"), (1, "ONE"), (None, ""), (6, "two")]
    df = frame(spark, rows)
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near.near_groups(df, "doc_id", "text", partitions=2).collect())
    assert got == [(0, 0, 0, True), (0, 2, 2, False), (1, 1, 1, True), (2, 2, 2, True), (2, 2, 2, True), (3, 0, 3, True), (4, 1, 1, False), (6, 1, 6, True)]
    assert near.near_groups(df.limit(0), "doc_id", "text").count() == 0
    assert near.near_groups(df.where("doc_id = 6"), "doc_id", "text").first().component_id == 6
    assert sorted(r.doc_id or 0 for r in near.drop_near_duplicates(df, "doc_id", "text").collect()) == [0, 1, 2, 3, 6]
    bare = frame(spark, [(None, "a b c d e f"), (None, "A b c d e f"), (None, None), (None, "other words")])
    assert len(near.drop_near_duplicates(bare, "doc_id", "text").collect()) == 3
    assert near.drop_near_duplicates(df.limit(0), "doc_id", "text").columns == df.columns
    with pytest.raises(ValueError):
        near.near_groups(df.withColumnRenamed("doc_id", "kept"), "kept", "text")


def test_recall_of_the_forest():
    import numpy as np

    rng = np.random.default_rng(2)
    hit = 0
    for _ in range(150):
        common = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        own = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        a, b = np.unique(np.concatenate([common, own[:50]])), np.unique(np.concatenate([common, own[50:]]))  # 300 of 400 shared
        x, y = near.signatures([a, b]).reshape(2, near.TREES, near.DEPTH)
        hit += bool((x[:, : near.LEAST] == y[:, : near.LEAST]).all(1).any())
    assert hit >= 148


def test_words_are_hashed_as_split():
    from eventloom.llm.words import Words

    raws = [b"", b" a  b\x0bc ", b"a", b"\x1ca \xc2\xa0 b", b"long" * 300_000 + b" b"]
    words = Words(raws)
    assert words.counts.tolist() == [len(r.split()) for r in raws]
    flat = [w for r in raws for w in r.split()]
    named = {}
    for w, *h in zip(flat, words.half(0).tolist(), words.half(1).tolist(), strict=True):
        assert named.setdefault(w, h) == h
    for half in (0, 1):
        assert len({h[half] for h in named.values()}) == len(named)
    assert len(Words([])) == 0 and Words([b"Ab \xc3\x89"], lower=True).half(0).tolist() == Words([b"ab \xc3\x89"]).half(0).tolist()


def test_windows_are_told_apart():
    from eventloom.llm.words import Words

    rng = random.Random(4)
    for size in (1, 2, 3, 5, 7, 13):
        raws = [" ".join(rng.choices(["a", "b", "word", "longer-than-fifteen-bytes"], k=size)).encode() for _ in range(300)]
        words = Words(raws)
        for half in (0, 1):
            found = words.windows(size, half)[words.first[:-1]].tolist()
            assert len(dict(zip(raws, found, strict=True))) == len(set(found)) == len(set(raws))
            assert all(x == y for r, x in zip(raws, found, strict=True) for s, y in zip(raws, found, strict=True) if r == s)


def thue_morse(bits=10):
    """Two words of 2 ** bits bytes whose difference any polynomial in an odd number modulo 2 ** 64 sends to zero."""
    one = [bin(i).count("1") % 2 for i in range(1 << bits)]
    return ("".join("ab"[x] for x in one), "".join("ba"[x] for x in one))


def test_words_that_a_plain_polynomial_confuses(spark):
    x, y = thue_morse()
    rows = [(1, x), (2, y), (3, " ".join([x] * 13)), (4, " ".join([y] * 13))]
    got = {r.doc_id: r.n_removed for r in substring.substring_duplicates(frame(spark, rows), "doc_id", "text").collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 0}
    assert {r.doc_id: r.component_id for r in near.near_groups(frame(spark, rows), "doc_id", "text").collect()} == {i: i for i in range(1, 5)}
