"""The operators against brute force, with null, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""
import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfmetrics.llm import decontamination, language, substring_dedup, toxicity
from shelfmetrics.llm.bpe_count import count_tokens
from shelfmetrics.llm.chat_format import escape, expand, parse, unescape
from shelfmetrics.llm.components import components
from shelfmetrics.llm.exact_dedup import drop_copies, exact_dedup
from shelfmetrics.llm.jaccard_join import Plan, drop_near, near_duplicates, shingles, signatures
from shelfmetrics.llm.packing import pack
from shelfmetrics.llm.queries import read_back
from shelfmetrics.llm.sharding import lookup_table, place
from shelfmetrics.llm.suffix_array import common_prefixes, suffix_array

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, slot bigint, word bigint, bits bigint, maybe boolean, score double, row string, n_bytes string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


ODD = ["", None, " \t\n ", "x", "ÉCOLE été — naïve 日本語 👍🏽", "don't'll IT'S", "<|endoftext|>a<|startoftext|> b", "a\x1cb \x1dc", "a\0b \0 c", "$$$ 123", "ΑΣ ΣΑΣ. İ",
       "that " * 400, prose(1, 9000), "y" * 5000]
TEXTS = [*ODD, prose(2, 120), prose(2, 120), prose(2, 119) + " changed", prose(3, 300), prose(3, 150) + " " + prose(4, 40)]


def table(spark, texts, first=0):
    rows = [(first + i, t, "en", 7, 8, 9, True, 0.5, "r", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    repeated = [(3, "x", None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None), (None, "x", "en", 1, 1, 1, False, 1.0, "", "")]
    return table(spark, TEXTS).union(spark.createDataFrame(repeated, SCHEMA)).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(text):
    return Tokenizer.from_file(VOCABULARY).encode(text, add_special_tokens=False).ids


def test_packing_holds_each_id_once(docs, rows):
    got = pack(docs, VOCABULARY).collect()
    want = sorted(((d is None, d or 0), tuple([*ids_of(t), 1])) for d, t in rows)
    whole, windows = [], {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append(r)
        assert r.length * 4 == len(r.ids)
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0 and at == w[0].tier
    for key, pieces in itertools.groupby(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.doc_tokens, r.start)), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.doc_tokens)):
        by_start = {}
        for p in pieces:
            by_start.setdefault(p.start, []).append(p)
        copies = max(len(v) for v in by_start.values())
        ids = np.concatenate([np.frombuffer(bytes(by_start[s][0].ids), "<u4") for s in sorted(by_start)])
        assert len(ids) == key[2]
        whole += [(key[:2], tuple(ids.tolist()))] * copies
    assert sorted(whole) == want


def test_step_groups_cost_alike(spark):
    docs = table(spark, [prose(i, 40 + 37 * i % 900) for i in range(300)]).coalesce(1)
    cost = {}
    for r in pack(docs, VOCABULARY).collect():
        cost.setdefault((r.tier, r.step_group), 0)
        cost[r.tier, r.step_group] += r.length ** 2
    most = [c for (tier, _), c in cost.items() if tier == 2048]
    assert max(most) < 1.5 * min(sorted(most)[1:])  # but for one group that is not full


def test_counts_equal_the_library(docs, rows):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs, VOCABULARY, 2048).collect())
    n = [(d, len(t.encode()), len(ids_of(t))) for d, t in rows]
    assert got == sorted((d is None, d or 0, b, c, c > 2048) for d, b, c in n)


def test_exact_dedup(docs, rows):
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact_dedup(docs, bits=128).collect())
    groups = {}
    for d, t in rows:
        groups.setdefault(t, []).append(d)
    want = []
    for t, members in groups.items():
        keep = max((m for m in members if m is not None), default=None)
        want += [(str(m), str(keep), len(members), m == keep, hashlib.sha256(t.encode()).hexdigest()) for m in members]
    assert got == sorted(want)
    kept = drop_copies(docs).collect()
    assert sorted(r.text or "" for r in kept) == sorted(groups)
    assert {r.doc_id for r in kept} == {max((m for m in g if m is not None), default=None) for g in groups.values()}


def test_lookup_table_is_even_and_steady():
    names = [f"s{i}" for i in range(17)]
    table_ = lookup_table(names, 2003)
    share = np.bincount(table_)
    assert share.max() - share.min() <= 1
    fewer = lookup_table(names[:-1], 2003)
    moved = sum(a != b for a, b in zip(table_, fewer) if a != 16)
    assert moved < 0.2 * 2003
    with pytest.raises(ValueError):
        lookup_table(names, 2000)
    with pytest.raises(ValueError):
        lookup_table([], 7)


def test_placement(docs, rows):
    names = ["a", "b", "c"]
    owner = lookup_table(names, 101)
    got = place(docs, names, size=101)
    assert got.columns == [c for c in docs.columns if c != "slot"] + ["slot", "shard"]
    for r in got.collect():
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:8], 16) % 101
        assert (r.slot, r.shard) == (slot, names[owner[slot]])
    assert got.count() == len(rows)


def test_chat_round_trip(spark):
    odd = ["", "\\### Assistant: </turn> ok", "### user: x </turn>\n", "a\\", "\\\\n", ":#<", "日本\n\n"]
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", t, "z", 5) for i, t in enumerate(odd)]
    turns += [(2, 0, "user", "only", "z", 5), (3, None, None, None, None, None), (None, 1, "assistant", "n", "", 0), (4, 1, "assistant", "b", "", 0), (4, 1, "assistant", "a", "", 0),
              (4, 1, "assistant", "a", "", 0), (5, 0, "odd: role <#", "long " * 40000, "", 0), (5, 1, "assistant", "", "", 0)]
    frame = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string, example string, loss_start int")
    out = {}
    for r in expand(frame).collect():
        out.setdefault(r.conv_id, []).append(r)
    for conv in {t[0] for t in turns}:
        own = sorted([(t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in turns if t[0] == conv])
        found = sorted(out[conv], key=lambda r: r.example)
        assert parse(found[-1].text) == [(o[2], o[3]) for o in own]
        replies = [o[3] for o in own if o[2] == "assistant"]
        assert [unescape(r.text[r.loss_start:r.loss_end]) for r in found if r.target_turn is not None] == replies
        for r in found:
            assert found[-1].text.startswith(r.text)
    assert all(unescape(escape(t)) == t for t in odd)
    assert expand(frame.limit(0)).collect() == []


def test_blocks_of_one_conversation_are_built_in_different_tasks(spark):
    turns = [(None if i % 2 else 9, i // 2, ["user", "assistant", "tool: #"][i // 2 * 7 % 3], f"{i} said <#: " + "x" * (i % 50)) for i in range(600)]
    turns += [(9, 299, "user", "last"), (9, 299, "user", "last"), (10, 0, "user", "none"), (11, 0, "assistant", "one")]
    frame = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    blocks = expand(frame, block_chars=100_000)
    whole = sorted(((str(r.conv_id), r.example, r.target_turn, r.text, r.loss_start, r.loss_end) for r in expand(frame).collect()), key=str)
    assert sorted(((str(r.conv_id), r.example, r.target_turn, r.text, r.loss_start, r.loss_end) for r in blocks.collect()), key=str) == whole
    for conv in {t[0] for t in turns}:
        own = sorted((t[1], t[2], t[3]) for t in turns if t[0] == conv)
        texts_, said = [], ""
        for _, role, text in own:
            said += f"### {escape(role)}: {escape(text)} </turn>\n"
            texts_ += [said] if role == "assistant" else []
        texts_ += [said] if own[-1][1] != "assistant" else []
        found = sorted((r for r in whole if r[0] == str(conv)), key=lambda r: r[1])
        assert [r[3] for r in found] == texts_ and [r[1] for r in found] == list(range(len(texts_)))
        digest = next(r for r in read_back(blocks).collect() if r.conv_id == conv)
        assert (digest.n_turns, digest.formatted_chars) == (len(own), sum(map(len, texts_)))
        assert digest.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        replies = "".join(t for _, r, t in own if r == "assistant")
        assert (digest.loss_chars, digest.loss_sha256) == (len(replies), hashlib.sha256(replies.encode()).hexdigest())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert blocks.filter("conv_id = 9").select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_language_of_held_out_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    apart = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = language.fit(docs.filter(~apart))
    got = language.predict(docs.filter(apart), model).join(docs, "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(spark, docs, rows, empty, sf_dir):
    model = language.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    got = language.predict(docs, model).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or -1) for r in got if r.lang_pred == "und") == sorted((d or -1) for d, t in rows if not any(c.isalpha() for c in t))
    kept = language.keep_known(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r.rejected for r in got)
    nothing = language.fit(empty)
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}
    assert language.predict(empty, model).collect() == []


def test_rows_without_an_id_are_sampled_too(spark):
    labelled = spark.createDataFrame([(None, prose(i, 20) + f" word{i}", "en") for i in range(1000)], "doc_id bigint, text string, lang string")
    model = language.fit(labelled, most=100)
    drawn = round(float(np.exp(model.idf.max() - 1))) - 1  # a trigram in no text has the largest weight, the log of 1 + the rows
    assert 60 < drawn < 140


def test_a_language_far_from_all_is_rejected(spark, sf_dir):
    model = language.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    r = random.Random(5)
    noise = " ".join("".join(r.choice("qxzjkvw") for _ in range(7)) for _ in range(400))
    assert language.predict(table(spark, [noise]), model).first().rejected


def test_chain_learns_and_feeds_on(spark):
    texts_, labels = [], []
    for i in range(400):
        bad, worse = i % 4 == 0, i % 8 == 0
        texts_.append(prose(i, 60) + (" slurone slurtwo" if bad else "") + (" slurthree" if worse and i % 16 else ""))
        labels.append((i, int(bad), int(worse), "z"))
    frame = spark.createDataFrame(labels + [(0, None, 1, "z"), (0, 1, 1, "z")], "doc_id bigint, mild int, severe int, text string")
    got = {r.doc_id: r for r in toxicity.classify(table(spark, texts_), frame.filter("doc_id % 3 > 0"), ["mild", "severe"]).collect()}
    held = [i for i in range(400) if i % 3 == 0]
    assert np.mean([(got[i].p_mild >= 0.5) == (i % 4 == 0) for i in held]) > 0.97
    assert np.mean([got[i].p_severe for i in held if i % 8 == 0]) > 3 * np.mean([got[i].p_severe for i in held if i % 4])


def test_later_models_use_the_earlier_probability():
    bins = [toxicity.features("one bad" if i % 2 else "one good") for i in range(40)]
    y = np.array([[i % 2, i % 2] for i in range(40)], float)
    models = toxicity.fit_chain(bins, y, 3)
    assert len(models[1]) == len(models[0]) + 1 and models[1][toxicity.BINS] > 0


def test_toxicity_of_odd_rows(spark, docs, rows, empty):
    labels = spark.createDataFrame([(3, 1), (14, 0), (None, 1)], "doc_id bigint, toxic int")
    assert toxicity.classify(docs, labels, ["toxic"]).count() == len(rows)
    assert {r.p_toxic for r in toxicity.classify(docs, labels.limit(0), ["toxic"]).collect()} == {None}
    assert toxicity.classify(empty, labels, ["toxic"]).collect() == []


def brute_tiles(doc, item, least):
    """Longest common stretch of unmarked places first, one at a time."""
    used_d, used_i, total = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                k = 0
                while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k] and i + k not in used_d and j + k not in used_i:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return sorted(total)
        total.append(best[0])
        used_d |= set(range(best[1], best[1] + best[0]))
        used_i |= set(range(best[2], best[2] + best[0]))


def test_tiles_are_valid_and_cover_as_much():
    r = random.Random(3)
    for _ in range(300):
        item = [r.randrange(6) for _ in range(r.randrange(1, 24))]
        doc = [r.randrange(6) for _ in range(r.randrange(0, 40))]
        if r.random() < 0.7 and len(item) > 6:
            doc += item[len(item) // 2:] + [9] + item[:len(item) // 2]
        found = decontamination.tiles(doc, item, 3)
        for i, j, k in found:
            assert k >= 3 and doc[i:i + k] == item[j:j + k]
        for at, k in ((0, 2), (1, 2)):
            spans = sorted((t[at], t[at] + t[k]) for t in found)
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        want = brute_tiles(doc, item, 3)
        assert max((t[2] for t in found), default=0) == max(want, default=0)
        assert sum(t[2] for t in found) == sum(want)


def test_reordered_passages_are_found_in_both_ways(spark, docs):
    item = prose(77, 30).split()
    turned = " ".join([*prose(5, 50).split(), *item[20:], *item[10:20], *prose(6, 5).split(), *item[:10], *prose(7, 3000).split()])
    bench = spark.createDataFrame([(1, " ".join(item), "z"), (2, "", "z"), (3, None, None), (4, "short one", "z"), (None, prose(88, 20), "")], "item_id bigint, text string, doc_id string")
    frame = docs.union(table(spark, [turned, turned.upper(), " ".join(item[:9]), prose(88, 20)], 100))
    for most in (32 << 20, 1):
        got = sorted(((r.doc_id, r.item_id, round(r.coverage, 6), r.n_tiles, r.longest) for r in decontamination.contamination(frame, bench, most_bytes=most).collect()), key=str)
        assert got == [(100, 1, 1.0, 3, 10), (101, 1, 1.0, 3, 10), (103, None, 1.0, 1, 20)]
    kept = decontamination.drop_contaminated(frame, bench)
    assert kept.columns == frame.columns and kept.count() == frame.count() - 3
    assert decontamination.contamination(frame, bench.limit(0)).collect() == []
    assert decontamination.contamination(frame.limit(0), bench).collect() == []


def test_short_items_and_unspaced_scripts_are_found(spark):
    """Items below five words stand whole, in both ways; a script without spaces is cut into characters; one word proves nothing."""
    bench = spark.createDataFrame([(1, "Purple monkey dishwasher"), (2, "word"), (3, "北京是中国的首都和政治中心"), (4, "กรุงเทพมหานครเป็นเมืองหลวง"), (5, "日本"), (6, None), (7, "Purple monkey dishwasher")],
                                  "item_id bigint, text string")
    rows_ = [(10, "a purple MONKEY, dishwasher and a word"), (11, "monkey purple dishwasher word"), (12, "据说北京是中国的首都和政治中心。"), (13, "x กรุงเทพมหานครเป็นเมืองหลวง y"),
             (14, "日本語と日本"), (15, "日 x 本"), (16, None), (17, ""), (18, "purple monkey"), (19, "北京"), (None, "purple monkey dishwasher")]
    frame = spark.createDataFrame(rows_, "doc_id bigint, text string")
    for most in (32 << 20, 1):
        found = decontamination.contamination(frame, bench, most_bytes=most).collect()
        assert sorted(((r.doc_id, r.item_id) for r in found), key=str) == [(10, 1), (10, 7), (12, 3), (13, 4), (14, 5), (None, 1), (None, 7)]
        assert {r.coverage for r in found} == {1.0}
        kept = decontamination.drop_contaminated(frame, bench, most_bytes=most)
        assert sorted((r.doc_id for r in kept.collect()), key=str) == [11, 15, 16, 17, 18, 19]


def test_contaminated_rows_go_by_their_own_text(spark):
    item = prose(77, 30)
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    rows_ = [(None, "before " + item), (None, "clean"), (None, None), (7, item + " after"), (7, "clean too"), (8, item), (8, item), (9, "")]
    frame = spark.createDataFrame(rows_, "doc_id bigint, text string")
    for most in (32 << 20, 1):
        kept = decontamination.drop_contaminated(frame, bench, most_bytes=most)
        assert kept.columns == frame.columns
        assert sorted(map(tuple, kept.collect()), key=str) == sorted([(None, "clean"), (None, None), (7, "clean too"), (9, "")], key=str)


def test_suffix_arrays():
    r = random.Random(1)
    for _ in range(400):
        k = r.choice([1, 2, 4, 30])
        s = [r.randint(1, k) for _ in range(r.randrange(50))]
        s = ((s[:4] * 9)[:len(s)] if r.random() < 0.3 else s) + [0]
        want = sorted(range(len(s)), key=lambda i: s[i:])
        for symbols in (k + 1, 1000):  # by buckets and by entries
            order = suffix_array(np.array(s), symbols)
            assert order.tolist() == want
        before, length = common_prefixes(np.array(s), order, 1)
        for i, j in enumerate(before):
            if j >= 0:
                n = 0
                while s[i + n] == s[j + n] and s[i + n] > 1:
                    n += 1
                assert length[i] == n


def brute_repeats(texts_, least):
    where = {}
    data = [t.encode() for t in texts_]
    for d, x in enumerate(data):
        for i in range(len(x) - least + 1):
            where.setdefault(x[i:i + least], []).append((d, i))
    gone = [np.zeros(len(x), bool) for x in data]
    for places in where.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i:i + least] = True
    return gone


@pytest.mark.parametrize("group_bytes", [1 << 18, 600])
def test_repeats(spark, docs, rows, monkeypatch, group_bytes):
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", group_bytes)
    shared = prose(50, 30)
    more = [prose(60 + i, 25) + " " + shared + " " + prose(90 + i, 25) for i in range(12)]
    frame = docs.union(table(spark, more, 200))
    own = [*rows, *[(200 + i, t) for i, t in enumerate(more)]]
    gone = brute_repeats([t for _, t in own], 200)
    want = []
    for (d, t), g in zip(own, gone):
        x = np.frombuffer(t.encode(), np.uint8)
        want.append((str(d), len(x), int((np.diff(np.r_[0, g.astype(int)]) == 1).sum()), bytes(x[~g])))
    got = [(str(r.doc_id), r.n_bytes, len(r.spans), bytes(r.kept)) for r in substring_dedup.remove_repeats(frame).collect()]
    assert sorted(got) == sorted(want)


def test_rows_that_repeat_id_and_text_are_cut_once(spark):
    """Contexts of a row that stands very often are cut once in a task, and a shard sorts them once."""
    import pyarrow as pa
    wanted = [{"shard": 0, "anchor": 5, "context": 6, "copies": 1, "cut": False, "start": 0, "count": 51}]
    batch = pa.RecordBatch.from_pydict({"key": [1, 1, 2, 1], "print": [9, 9, 9, 9], "text": ["t" * 250] * 4, "wanted": [wanted] * 4})
    cut = list(substring_dedup._cut(200)(iter([batch, batch])))
    assert sum(b.num_rows for b in cut) == 2
    text = " ".join(prose(3, 120).split())
    one = pa.table({"anchor": [5, 5, 8], "context": [6, 6, 7], "copies": [1, 1, 1], "cut": [False] * 3, "count": [51, 51, 51],
                    "data": [text[:250].encode(), text[:250].encode(), text[300:550].encode()]})
    done = substring_dedup._sort_shard(200)(one)
    assert done.column("context").to_pylist() == [6, 7] and done.column("runs").to_pylist() == [[], []]
    shared = prose(50, 40)
    own = [(1, shared + " " + prose(1, 30))] * 60 + [(2, prose(2, 30) + " " + shared), (2, prose(2, 30) + " " + shared), (3, prose(4, 60))]
    frame = spark.createDataFrame(own, "doc_id bigint, text string").repartition(6)
    gone = brute_repeats([t for _, t in own], 200)
    want = sorted((d, bytes(np.frombuffer(t.encode(), np.uint8)[~g])) for (d, t), g in zip(own, gone))
    assert sorted((r.doc_id, bytes(r.kept)) for r in substring_dedup.remove_repeats(frame).collect()) == want


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


@pytest.mark.parametrize("num", [60, 80, 85, 95])
@pytest.mark.parametrize("parts, spare", [(2, 1), (3, 1), (1, 0)])
def test_similar_sets_share_a_signature(num, parts, spare):
    plan, r = Plan(num, 100, parts, spare), np.random.default_rng(num + parts)
    for _ in range(300):
        n = int(r.integers(1, 200))
        a = r.integers(0, 1 << 63, n, dtype=np.uint64)
        cut = a[int(r.integers(0, n)):] if r.random() < 0.2 else a[:n - int(r.integers(0, n * (100 - num) // 100 + 1))]
        b = np.concatenate([cut, r.integers(0, 1 << 63, int(r.integers(0, n * (100 - num) // 100 + 1)), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= num * (len(a) + len(b) - both):
            assert len(np.intersect1d(signatures(a, plan), signatures(b, plan)))


def brute_components(own, width, num):
    sets = {}
    for d, t in own:
        w = t.encode().lower().split()
        sets.setdefault(d, []).append({tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    ids = sorted(d for d in sets if d is not None)
    root = {d: d for d in ids}
    for a, b in itertools.combinations(ids, 2):
        if any(x and 100 * len(x & y) >= num * len(x | y) for x in sets[a] for y in sets[b]):
            low, high = sorted((root[a], root[b]))
            root = {k: low if v == high else v for k, v in root.items()}
    return root, sets


def edited(text, seed, n):
    r, words = random.Random(seed), text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.random()}"
    return " ".join(words)


@pytest.mark.parametrize("block", [512, 5])
def test_near_duplicates(spark, docs, rows, monkeypatch, block):
    from shelfmetrics.llm import jaccard_join
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    # Chains around the bound: every copy is an edit of the one before, so ends are not similar.
    more = [prose(40, 150)]
    for i in range(20):
        more.append(edited(more[-1] if i % 3 else more[0], i, 2 if i % 4 else 3))
    more += ["One two three", "one TWO three", "one two three four", "one two"]
    own = [*rows, *[(300 + i, t) for i, t in enumerate(more)]]
    root, sets = brute_components(own, 4, 85)
    got = near_duplicates(docs.union(table(spark, more, 300)), 4, 85, 100).collect()
    assert len(got) == len(own)
    for r in got:
        assert r.component_id == root.get(r.doc_id)
        assert r.n_shingles in {len(s) for s in sets[r.doc_id]}
    assert len(set(root.values())) < len(root) - 8


def test_drop_near_keeps_one_of_each(spark, docs, empty):
    more = table(spark, [prose(40, 150), edited(prose(40, 150), 1, 1), edited(prose(40, 150), 2, 1)], 300)
    kept = drop_near(docs.union(more))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} & {300, 301, 302} == {300}
    assert drop_near(empty).collect() == []


def test_empty_tables(empty):
    for out in (pack(empty, VOCABULARY), count_tokens(empty, VOCABULARY, 1), exact_dedup(empty), drop_copies(empty), place(empty, ["a"], size=7),
                substring_dedup.remove_repeats(empty), near_duplicates(empty)):
        assert out.collect() == []


def test_shingles_follow_the_definition():
    assert len(shingles("a b\tc\x0bd e", 4)) == 2 and len(shingles("A b", 4)) == 1 and len(shingles(" ", 4)) == 0
    assert (shingles("A B C D", 4) == shingles("a b c d", 4)).all() and (shingles("É b c d", 4) != shingles("é b c d", 4)).all()
    assert len(shingles("a\xa0b c d e", 4)) == 1


def test_checksums_of_pieces(docs, rows):
    got = pack(docs, VOCABULARY).select("doc_id", "length", "ids", F.crc32("ids").alias("crc")).collect()
    assert all(zlib.crc32(bytes(r.ids)) == r.crc for r in got)
