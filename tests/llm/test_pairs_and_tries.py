"""Near pairs of words and fingerprints, tries of conversations and the pipeline against brute force on small tables."""
import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from shelfmetrics.llm import jaccard_join, language, simhash_pivots
from shelfmetrics.llm.common import stored
from shelfmetrics.llm.components import components
from shelfmetrics.llm.exact_dedup import exact_dedup
from shelfmetrics.llm.jaccard_join import drop_near, shingles, similar_components
from shelfmetrics.llm.prefix_trie import Inner, Leaf, Tree, keys, share_beginnings, trie
from shelfmetrics.llm.simhash_pivots import PIVOTS, simhash_components
from shelfmetrics.llm.spelling_grams import Grams, spelling_forms

CLASH = "word bigint, n bigint, fp string, key bigint, slice bigint, node string, label string"


def groups(n, linked):
    """The smallest member of each one's component."""
    up = list(range(n))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "f", 3, 4, "n", "l") for r in rows], f"doc_id bigint, text string, {CLASH}")


def near_copies(seed, n, words=60, changed=2):
    r = random.Random(seed)
    names = [f"{a}{b}" for a in "kltmrs" for b in ("ano", "eri", "ilu", "otha", "umbe", "yre", "eno")]
    base = [r.choice(names) for _ in range(words)]
    out = []
    for _ in range(n):
        x = list(base)
        for _ in range(r.randint(0, changed)):
            x[r.randrange(words)] = r.choice(names)
        out.append(" ".join(x))
    return out


# --- spelling variants

def edits(word, letters):
    n = len(word)
    return ({word[:i] + word[i + 1:] for i in range(n)} | {word[:i] + c + word[i + 1:] for i in range(n) for c in letters}
            | {word[:i] + c + word[i:] for i in range(n + 1) for c in letters}) - {word}


@pytest.mark.parametrize("seed", range(4))
def test_an_edit_leaves_the_grams_that_are_not_affected(seed):
    r = random.Random(seed)
    grams = Grams({"".join(r.choice("ab^$"[:2 + 2 * (k < 2)]) for _ in range(r.randint(2, 5))): r.randint(1, 9) for k in range(25)})
    for _ in range(150):
        word = "".join(r.choice("abc") for _ in range(r.randint(3, 9)))
        whole = f"^{word}$"
        cut = grams.cut(whole)
        assert max(b for _, b in cut) == len(whole) and cut[0][0] == 0
        own = collections.Counter(whole[a:b] for a, b in cut)
        for other in edits(word, "abc"):
            other = f"^{other}$"
            both = own & collections.Counter(other[a:b] for a, b in grams.cut(other))
            assert sum(both.values()) >= len(cut) - grams.affected(whole, cut)


def plain_forms(rows):
    n = collections.Counter()
    for d, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        run = ""
        for c in low + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
                n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
            run = ""
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    letters = {c for w in n for c in w}
    near = {w: edits(w, letters) & set(n) for w in n}
    form = {w: next((x for x in sorted(near[w], key=lambda x: (-n[x], x))[:1] if n[x] >= 2 * n[w]), None) for w in n}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


def test_spelling_forms(spark):
    r = random.Random(7)
    base = ["".join(r.choice("aeéstn") for _ in range(r.randint(5, 9))) for _ in range(40)]
    base += ["aaaaa", "aaaaaa", "aaaaab", "ÀÉÎÕü×÷", "straße", "strasse", "Straßen"]
    said = []
    for w in base:
        said += [w] * r.randint(1, 30)
        for v in r.sample(sorted(edits(w, "aeést")), 4):
            said += [v] * r.randint(1, 6)
    r.shuffle(said)
    rows = [(i, " ".join(said[i * 20:i * 20 + 20]).upper() if i % 5 == 0 else ", ".join(said[i * 20:i * 20 + 20])) for i in range(len(said) // 20)]
    rows += [(1, None), (2, ""), (None, "straße straße aaaaa aaaaa"), rows[0], rows[0], (99, "longer text " * 20_000), (98, "日本語 123 _")]
    want = plain_forms(rows)
    for options in ({}, {"often": 3, "seldom": 1, "longest": 5}):
        got = sorted((x.word, x.form or "", x.root, x.n, x.n_near, x.form_n or 0) for x in spelling_forms(table(spark, rows), **options).collect())
        assert got == want
    assert sum(x[1] != "" for x in want) > 20
    assert spelling_forms(table(spark, rows).limit(0)).collect() == []
    with pytest.raises(ValueError):
        spelling_forms(table(spark, rows), least_letters=2)


# --- fingerprints

def test_pivots_discard_all_that_is_far():
    r = random.Random(1)
    for d in (17, 20, 40):
        x, y = r.getrandbits(64), 0
        y = x ^ sum(1 << b for b in r.sample(range(64), d))
        own, other = [np.bitwise_count(np.uint64(z) ^ PIVOTS).astype(int) for z in (x, y)]
        assert np.abs(own - other).max() > 4


def test_links_of_fingerprints(spark, monkeypatch):
    r = random.Random(3)
    found = {r.getrandbits(64) for _ in range(100)}
    for n, x in itertools.product(range(12), list(found)[:20]):
        found.add(x ^ sum({1 << r.randrange(64) for _ in range(r.randint(1, 6))}))
    x = r.getrandbits(64)
    found |= {x ^ sum({1 << r.randrange(64) for _ in range(r.randint(1, 9))}) for _ in range(400)}
    fp = np.array(sorted(found), np.uint64).view(np.int64)
    fp.sort()
    near = np.bitwise_count(fp.view(np.uint64)[:, None] ^ fp.view(np.uint64)[None, :]) <= 4
    top = groups(len(fp), np.argwhere(near))
    want = {int(fp[i]): int(fp[top[i]]) for i in range(len(fp)) if near[i].sum() > 1}
    df = stored(spark.createDataFrame([(int(v),) for v in fp], "fp bigint"))
    for equal, limit in ((1, 4096), (3, 4096), (1, 50)):
        monkeypatch.setattr(simhash_pivots, "equal_blocks", lambda n, radius, equal=equal: equal)
        got = simhash_pivots.links(df, 4, limit)
        assert got.count() <= len(masks := simhash_pivots.parts(4, equal)) * len(fp) * (1 if limit > 50 else 20)
        assert {c.node: c.component for c in components(got).collect()} == want
        assert len(masks) == len(list(itertools.combinations(range(4 + equal), equal)))


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split(" ")
    words = [w for x in words for w in x.replace("\t", "\n").split("\n") if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def test_simhash_components(spark):
    rows = [(i, t) for i, t in enumerate(near_copies(2, 60, 120) + near_copies(3, 30, 40, 1))]
    rows += [(200, None), (201, ""), (202, " \t"), (203, "one"), (204, "ONE"), (205, "a b c d"), (206, "x y z w " * 20_000), (None, rows[0][1]), (None, "alone here"), rows[5]]
    prints = [plain_fingerprint(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    top = groups(len(rows), near)
    low = {}
    for (d, _), c in zip(rows, top):
        low[c] = min((x for x in (low.get(c), d) if x is not None), default=None)
    want = sorted((str(d), f"{p:016x}", str(low[c])) for (d, _), p, c in zip(rows, prints, top))
    assert sorted((str(x.doc_id), x.fingerprint, str(x.component_id)) for x in simhash_components(table(spark, rows)).collect()) == want
    assert simhash_components(table(spark, rows).limit(0)).collect() == []


# --- tries

def test_radix_tree_keeps_keys_in_order_through_all_layouts():
    r = random.Random(4)
    said = {bytes([k % 251, *(r.randrange(k) for _ in range(15 + 16 * r.randint(0, 2)))]) for k in (2, 6, 30, 256) for _ in range(400)} | {b""}
    tree, layouts = Tree(), set()
    for n, key in enumerate(sorted(said)):
        tree.insert(key, np.zeros(3), n)
    tree.insert(min(said), np.zeros(3), -1)
    out, todo = [], [tree.root]
    while todo:
        x = todo.pop()
        if isinstance(x, Leaf):
            out.append(x.key)
        else:
            layouts.add(x.room)
            assert isinstance(x, Inner) and len(x.ordered()) + (x.own is not None) > 1
            todo += [*reversed(x.ordered()), *([x.own] if x.own else [])]
    assert out == sorted(said) and layouts == {4, 16, 48, 256}


def plain_trie(turns, every=5, most=3):
    own = collections.defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: (x[:2], hashlib.sha256(f"{len(x[2])}:{x[2]}{x[3]}".encode()).digest()[:16]))] for c, v in own.items()}
    built = {c: tuple(own.get(c - c % every, [])[:c % (most + 1)] + own[c][c % (most + 1):]) for c in own}
    nodes = collections.defaultdict(list)
    for c, t in sorted(built.items()):
        for d in range(len(t) + 1):
            nodes[t[:d]].append(c)
    out = []
    for t, members in nodes.items():
        below = [x for x in nodes if x[:len(t)] == t]
        kids = [x for x in below if len(x) == len(t) + 1]
        leaves = [x for x in below if not any(y[:len(x)] == x and len(y) > len(x) for y in below)]
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(str(c) for c in members if built[c] == t)
        out.append((members[0], len(t), str(min(nodes[t[:-1]])) if t else "None", len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def test_trie_of_conversations(spark):
    r = random.Random(6)
    turns = []
    for c in range(-3, 70):
        for turn in range(r.choice([1, 2, 4, 7])):
            turns.append((c, None if r.random() < .1 else turn, r.choice(["user", "assistant", None]), r.choice(["hi", "", None, "ok 👍", "a\nb"])))
    turns += [(100 + c, k, "user", "same") for c in range(60) for k in range(4)] + [(201, 0, "user", "x"), (None, 0, "user", "x"), (300, 0, "u", "long " * 50_000), (300, 1, "u", "b"), (300, 1, "u", "b")]
    turns += [(400, k, "user", f"turn {k}") for k in range(800)]
    schema = f"conv_id bigint, turn bigint, role string, text string, {CLASH}"
    df = spark.createDataFrame([(*t, 1, 2, "f", 3, 4, "n", "l") for t in turns], schema)
    from pyspark.sql import functions as F
    for size in (8 << 20, 2000, 100):
        built = share_beginnings(stored(keys(df)), every=5, begins=F.pmod("conv_id", F.lit(5)), most=4)
        got = trie(stored(built), slice_bytes=size)
        want = plain_trie(turns, 5, 4) if size == 8 << 20 else want
        assert sorted((x.conv_id, x.depth, str(x.parent_conv_id), x.n_convs, x.n_children, x.n_leaves, x.saved_tokens, x.ends_sha256) for x in got.collect()) == want
    assert trie(stored(keys(df.limit(0)))).collect() == []


# --- near copies in linear size

def test_links_grow_with_the_group(spark, monkeypatch):
    rows = near_copies(9, 240, 120)
    sizes = []

    def counted(df):
        out = stored(df)
        sizes[-1][tuple(out.columns)] = max(sizes[-1].get(tuple(out.columns), 0), out.count())
        return out

    monkeypatch.setattr(jaccard_join, "stored", counted)
    monkeypatch.setattr(jaccard_join, "BLOCK", 64)
    for n in (120, 240):
        sizes.append({})
        got = {x.node: x.component for x in similar_components(table(spark, enumerate(rows[:n])), 5, 80, 100).collect()}
        sets = [set(shingles(t, 5).tolist()) for t in rows[:n]]
        top = groups(n, [(i, j) for i in range(n) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
        assert [got.get(i, i) for i in range(n)] == top
    for columns, k in sizes[1].items():
        assert k <= 3 * sizes[0][columns] + 100, columns
    with pytest.raises(ValueError):
        similar_components(table(spark, []), 5, 40, 100)


def test_filter_fills_alike(spark):
    from pyspark.sql import functions as F
    df = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 59_000).cast("string")).alias("text"))
    want = sorted((i, max(i % 59_000, i if i >= 59_000 else i + 59_000 if i < 1000 else i)) for i in range(60_000))
    for most in (1 << 24, 0):  # the filter broadcast, and joined
        assert sorted((x.doc_id, x.keep_id) for x in exact_dedup(df, most_words=most).collect()) == want


# --- pipeline

def test_letters():
    assert not any(map(language.lettered, ["", "½ ² 12", "Ⅷ", "①", "_ 7 :)"])) and all(map(language.lettered, ["a", "1é", "日", "ª"]))


def through(spark, docs, sf_dir):
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        out[name] = docs
    return out


def test_pipeline_keeps_one_of_each(spark, sf_dir):
    """Null, repeated and text ids, equal texts, near copies and benchmark passages; against what each stage is to leave."""
    r = random.Random(8)
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    first, second, third = (near_copies(s, 3, 200, 1) for s in (11, 12, 13))
    first[1:], second[1:] = [first[0] + " and more"] * 2, [second[0] + " besides"] * 2
    rows = [("a", first[0]), ("b", first[1]), ("b", second[0]), ("c", second[1]), (None, third[0]), (None, third[0]), ("d", None), ("e", f"{third[2][:300]} {item}"), (None, item), ("f", "")]
    r.shuffle(rows)
    docs = spark.createDataFrame([(i, t, None, "s", 1, 2, "n") for i, t in rows], "doc_id string, text string, lang string, source string, n_chars bigint, row bigint, maybe string")
    got = through(spark, docs, sf_dir)
    assert got["language"].count() == len(rows)  # nothing to learn from
    texts = sorted({t or "" for _, t in rows})
    assert sorted(x.text or "" for x in got["exact_dedup"].collect()) == texts
    left = {x.text or "" for x in got["near_dedup"].collect()}
    assert len(left & {first[0], first[1]}) == 1 and len(left & {second[0], second[1]}) == 1
    assert left | {first[0], first[1], second[0], second[1]} == set(texts)
    clean = [x.text or "" for x in got["decontamination"].collect()]
    assert sorted(clean) == sorted(t for t in left if item not in t)
    assert got["decontamination"].columns == docs.columns
    packed = got["packing"].collect()
    assert sum(x.start == 0 for x in packed) == len(clean)
    assert through(spark, docs.limit(0), sf_dir)["packing"].collect() == []


def test_near_copies_without_ids_stay_once(spark):
    rows = [(None, t) for t in near_copies(21, 6, 300, 1)] + [(5, None), (5, "")]
    kept = drop_near(table(spark, rows)).collect()
    assert sorted(x.text or "" for x in kept)[:2] == ["", ""] and len(kept) == 3
