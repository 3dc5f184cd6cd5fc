"""Every operator against its plain version, on generated rows with all odd inputs."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanforge.llm import chat, common, components, embedding, masked_lm, minhash, mixing, packing, quality, running, spans, substring, suffix_merge, warc

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, __x int, n_words int"


def corpus(seed=5, n=120):
    """Documents with copies, near copies, shared passages and lines, nulls, repeated ids and rows."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["Ärger", "naïve", "日本", "x\x1cy"]
    words = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passage, line = " ".join(words(60)), "Shared LINE of all"
    rows, texts = [], []
    for k in range(n):
        kind = r.random()
        if kind < 0.15 and texts:
            text = r.choice(texts)
        elif kind < 0.4 and texts:
            w = r.choice(texts).split(" ")
            for _ in range(max(1, len(w) // 40)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            text = " ".join(w)
        else:
            text = "\n".join(" ".join(words(r.choice((3, 12, 40)))) for _ in range(r.choice((1, 3, 6))))
            if r.random() < 0.3:
                text += "\n" + passage
            if r.random() < 0.5:
                text = line + "\n" + text
        texts.append(text)
        rows.append((k, text, "en", r.choice(["a", "b", None]), len(text)))
    rows += [(1000, None, None, None, None), (1001, "", "en", "a", 0), (1002, " \n\t ", "en", "a", 4), (1003, "one", "en", "b", 3), (1004, "One", "en", "b", 3), (None, texts[0], "en", "a", 1), (None, None, None, None, None)]
    rows += [rows[3], rows[3], (3, texts[5] + " tail", "en", "a", 9), (1005, "a " * 700, "en", "b", 1400), (1006, "ab" * 900, "en", "b", 1800), (1007, (texts[7] + " ") * 400, "en", "b", 1)]
    return [(*x, "clash", 1, 2) for x in rows]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return spark.createDataFrame(rows, SCHEMA).repartition(3), rows


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def same(got, want):
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))


def test_substring_against_plain(docs, nothing):
    df, rows = docs
    same(substring.substring_digest(df).collect(), brute.substring([r[:2] for r in rows]))
    assert substring.substring_digest(nothing).count() == 0


def test_substring_segments_and_buckets(docs, monkeypatch):
    df, rows = docs
    for name, value in (("SEGMENT_WORDS", 37), ("HASH_BYTES", 900), ("CHUNK_BYTES", 2500), ("BUCKET_BYTES", 4000)):
        monkeypatch.setattr(substring, name, value)
    same(substring.substring_digest(df).collect(), brute.substring([r[:2] for r in rows]))


@pytest.mark.parametrize("hot", [1, 3])
def test_hot_minimisers_are_split_exactly(docs, monkeypatch, hot):
    df, rows = docs
    monkeypatch.setattr(spans, "HOT_FRAGMENTS", hot)
    monkeypatch.setattr(spans, "REPORTED", hot)
    same(substring.substring_digest(df).collect(), brute.substring([r[:2] for r in rows]))
    same(suffix_merge.suffix_digest(df).collect(), brute.suffix([r[:2] for r in rows]))


def test_substring_dedup_cuts_text(docs):
    df, rows = docs
    out = substring.substring_dedup(df)
    assert out.columns == df.columns and out.count() == len(rows)
    digests = Counter((i, s) for i, _, _, s in brute.substring([r[:2] for r in rows]))
    same(((r.doc_id, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in out.collect()), digests.elements())
    assert all(r.n_chars == len(r.text) for r in out.collect() if r.text and r.doc_id is not None and r.doc_id < 3)


def test_suffix_against_plain(docs, nothing):
    df, rows = docs
    same(suffix_merge.suffix_digest(df).collect(), brute.suffix([r[:2] for r in rows]))
    assert suffix_merge.suffix_digest(nothing).count() == 0


def test_suffix_small_pieces(docs, monkeypatch):
    df, rows = docs
    for name, value in (("SEGMENT_BYTES", 300), ("HASH_BYTES", 800), ("CHUNK_BYTES", 2500), ("BUCKET_BYTES", 20000), ("MERGE_BYTES", 1000), ("SHARDS", 3)):
        monkeypatch.setattr(suffix_merge, name, value)
    same(suffix_merge.suffix_digest(df).collect(), brute.suffix([r[:2] for r in rows]))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", min_size=16, max_size=60), min_size=1, max_size=6, unique=True), st.integers(1, 4))
def test_merge_finds_repeats(frags, shards):
    """The merged interleave finds exactly the repeated strings, within and across shards."""
    frags = [f.encode() for f in frags]
    count = Counter(f[k : k + 16] for f in frags for k in range(len(f) - 15))
    got = suffix_merge.repeated_starts(frags, [k % shards for k in range(len(frags))], 16)
    for f, flags in zip(frags, got):
        assert flags.tolist() == [count[f[k : k + 16]] > 1 for k in range(len(f) - 15)]


def test_merge_of_many_places():
    """Past 16-bit ranks."""
    r = random.Random(6)
    shared = [bytes(r.choice(b"abcd ") for _ in range(260)) for _ in range(20)]
    frags = list({r.choice(shared)[r.randrange(50) :] + bytes(r.choice(b"xyz") for _ in range(80)) for _ in range(400)})
    assert sum(map(len, frags)) > 1 << 16
    count = Counter(f[k : k + 200] for f in frags for k in range(len(f) - 199))
    for f, flags in zip(frags, suffix_merge.repeated_starts(frags, [k % 8 for k in range(len(frags))])):
        assert flags.tolist() == [count[f[k : k + 200]] > 1 for k in range(len(f) - 199)]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_against_plain(docs, nothing, size):
    df, rows = docs
    want = brute.near([(k, r[0], r[1]) for k, r in enumerate(rows)], size)
    same(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicate_digest(df, size).collect()), ((r[0], *want[k]) for k, r in enumerate(rows)))
    assert minhash.near_duplicate_digest(nothing, size).count() == 0


def test_near_duplicates_in_parts(docs, monkeypatch):
    """Small leaves and parts exercise branching, hubs and the comparison of what hubs leave."""
    df, rows = docs
    for name, value in (("LEAF", 3), ("PART", 7), ("HUBS", 2), ("DEPTH", 1), ("MAX_DEPTH", 2), ("HELD_PAIRS", 10)):
        monkeypatch.setattr(minhash, name, value)
    want = brute.near([(k, r[0], r[1]) for k, r in enumerate(rows)], 2)
    same(((r.doc_id, r.component_id) for r in minhash.near_duplicate_digest(df, 2).collect()), ((r[0], want[k][1]) for k, r in enumerate(rows)))


def test_drop_near_duplicates_keeps_one_of_each_group(docs, nothing):
    df, rows = docs
    out = minhash.drop_near_duplicates(df, 5)
    assert out.columns == df.columns and minhash.drop_near_duplicates(nothing).count() == 0
    want = brute.near([(k, r[0], r[1]) for k, r in enumerate(rows)], 5)
    groups = {want[k][1] for k, r in enumerate(rows) if r[0] is not None}
    ids = [r.doc_id for r in out.collect() if r.doc_id is not None]
    assert set(ids) == groups
    assert sum(r.doc_id is None for r in out.collect()) == 2


def test_near_duplicates_recall_at_the_threshold(spark):
    """Pairs at similarity just over 0.8, in a group without any closer ones."""
    r = random.Random(3)
    rows = []
    for k in range(150):
        base = [f"q{r.randrange(10**6)}" for _ in range(100)]
        other = list(base)
        for p in (10, 40, 70, 90, 55):  # ten of 99 pairs differ
            other[p] = "z"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    got = {x.doc_id: x.component_id for x in minhash.near_duplicate_digest(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(150)) >= 149


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(4)
    base = r.standard_normal((30, 16)).astype(np.float32)
    rows = [(k, (base[k % 30] + r.standard_normal(16) * r.choice([0.02, 0.1, 0.3])).astype(np.float32).tolist()) for k in range(160)]
    rows += [(200, rows[3][1]), (3, rows[3][1]), (201, [2 * x for x in rows[3][1]]), (202, None), (203, []), (204, [0.0] * 16), (205, [float("nan")] * 16), (206, [float("inf")] + [1.0] * 15), (207, [None] + [1.0] * 15), (208, rows[3][1][:8]), (None, rows[3][1]), (None, None), (209, [1e-30] * 16), (210, [1e30] * 16)]
    return rows


def test_embeddings_against_plain(spark, vectors, monkeypatch):
    df = spark.createDataFrame([(*r, 1, "x") for r in vectors], "vec_id long, embedding array<float>, label int, component_id string")
    for tile, window in ((1024, 64), (3, 2)):
        monkeypatch.setattr(embedding, "TILE", tile)
        monkeypatch.setattr(embedding, "WINDOW", window)
        same(embedding.embedding_near_duplicates(df).select("vec_id", "n_links", "component_id", "kept").collect(), brute.vectors(vectors))
    assert embedding.embedding_near_duplicates(df.limit(0)).count() == 0


def test_embeddings_link_no_sample_tells_of(spark, monkeypatch):
    """Many links that every pass finds, and a few in a cluster of close vectors that most passes miss: all of them are united."""
    r = np.random.default_rng(9)
    unit = lambda x: x / np.sqrt((x * x).sum(-1, keepdims=True))
    centre = unit(r.standard_normal(48))
    off = r.standard_normal((1500, 48))
    off = unit(off - np.outer(off @ centre, centre))
    off = off[[not (off[i] @ off[:i].T >= 0.45).any() for i in range(len(off))]]
    off[1:4:2] = unit(off[0:4:2] + 1.5 * off[1:4:2])  # two pairs in the cluster, at 0.95 and a little; the others are at 0.9
    close = np.sqrt(0.9) * centre + np.sqrt(0.1) * off
    near = np.argwhere(np.triu(close @ close.T >= 0.95 * np.sqrt(np.outer((close**2).sum(1), (close**2).sum(1))), 1)).tolist()
    assert [0, 1] in near and [2, 3] in near
    easy = unit(r.standard_normal((4000, 48)))
    rows = [(k, x.tolist()) for k, x in enumerate(np.concatenate((close, easy, easy + 1e-4 * r.standard_normal(easy.shape))))]
    monkeypatch.setattr(embedding, "WINDOW", 1)
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {x.vec_id: x.component_id for x in embedding.embedding_near_duplicates(vectors).select("vec_id", "component_id").collect()}
    assert all(got[i] == got[j] for i, j in near)


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1300)] + [(2000, k) for k in range(2001, 2100)]
    f = brute.Forest()
    for a, b in edges:
        f.join(a, b)
    got = {x.id: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: f.root(v) for e in edges if e[0] != e[1] for v in e}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality_against_plain(docs, nothing):
    df, rows = docs
    want = brute.quality([(r[0], r[1], r[3]) for r in rows])
    same(quality.quality_digest(df).collect(), want)
    assert quality.quality_digest(nothing).count() == 0 and quality.quality_filter(nothing).count() == 0
    out = quality.quality_filter(df)
    assert out.columns == df.columns and out.count() == sum(w[-1] for w in want)


def test_quality_removes_frequent_lines(spark):
    rows = [(k, "Read  OUR licence now\n" + " ".join(f"t{k}w{j}" for j in range(30)), "h") for k in range(40)]
    rows += [(100, "read our licence NOW\nread our licence now\nsome few own words of it stand here", "h"), (101, "Read our licence now\n" + " ".join(f"v{j}" for j in range(20)), "other")]
    out = {r.doc_id: r.text for r in quality.quality_filter(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert 100 not in out and "licence" in out[101] and out[5] == rows[5][1].split("\n")[1]


def conversations():
    awkward = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", "b\\"), (1, 0, "user", "a"), (2, 0, None, None), (2, 1, "odd\nrole\\", "<|end|>\n<|turn|>\\<|end|>"), (2, None, "assistant", "first"), (3, 0, "system", "s"), (3, 1, "user", awkward), (3, 2, "assistant", awkward), (4, 0, "user", "x"), (4, 0, "user", "x"), (None, 0, "assistant", "n")]
    return rows


def test_chat_round_trip(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, record string")
    got = {r.conv_id: r for r in chat.format_digest(df).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        turns = sorted(((t if t is not None else -1, ro or "", x or "") for c, t, ro, x in rows if c == conv))
        learnt = "".join(x for _, ro, x in turns if ro == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert chat.format_digest(df.limit(0)).count() == 0


def test_chat_layouts(spark):
    records = [
        ({"instruction": "i", "input": "n", "output": "o"}, "instruction", [("user", "i\n\nn"), ("assistant", "o")]),
        ({"system": "s", "prompt": "p", "response": None}, "prompt_response", [("system", "s"), ("user", "p"), ("assistant", "")]),
        ({"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, "conversations", [("user", "h"), ("assistant", "g")]),
        ({"messages": []}, "messages", []),
        ({"question": "q", "answer": "a"}, "question", [("user", "q"), ("assistant", "a")]),
        ({"something": 1}, "unknown", None),
    ]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, (r, _, _) in enumerate(records)] + [(90, "no json"), (91, None)], "conv_id long, record string")
    got = {r.conv_id: r for r in chat.format_records(df).collect()}
    for k, (_, layout, turns) in enumerate(records):
        assert got[k].layout == layout and (chat.parse(got[k].formatted) if got[k].formatted is not None else None) == turns
    assert got[90].layout == got[91].layout == "unknown"


@given(st.lists(st.tuples(st.text(), st.text(alphabet=st.sampled_from(list("<|>/s[]INST\\\nend turn")), max_size=30) | st.sampled_from(chat.CONTROLS)), max_size=5))
def test_chat_escape_is_reversible(turns):
    text, loss = chat.render(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in loss] == [t for r, t in turns if r == "assistant"]


def pages():
    rows = [(k, f"http://h/{k}", f"<p>{k}</p>" * (40 + k)) for k in range(60)]
    same_html = "s" * 1000
    return rows + [(100, "u", same_html), (101, None, same_html), (102, "a\r\nb", same_html), (102, "again", same_html), (103, "short", "s" * 999), (104, "short", "s" * 999), (105, None, None), (106, "e", ""), (None, "n", same_html), (None, "n", "alone" * 300), (107, "ü", "Ü" * 700)]


def test_warc_round_trip(spark, monkeypatch):
    rows = pages()
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").repartition(3)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    most = {}
    for i, _, html in rows:
        b = (html or "").encode()
        if len(b) >= 1000 and i is not None:
            most[b] = max(most.get(b, i), i)
    want = []
    for i, url, html in rows:
        b = (html or "").encode()
        m = most.get(b) if len(b) >= 1000 else None
        again = m is not None and (i is None or i < m)
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", m if again else None))
    same((tuple(r)[:5] for r in warc.archive_digest(df).collect()), want)
    assert warc.archive_digest(df.limit(0)).count() == 0


def test_warc_selection_and_payloads(spark):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string")
    folder = common.new_path(spark, "warc")
    index = warc.write_archives(df, folder)
    got = warc.read_records(index.filter("page_id in (3, 50, 102)"), folder).collect()
    assert sorted((r.page_id, len(r.payload)) for r in got if r.payload) == [(3, 43 * 8), (50, 90 * 9), (102, 1000), (102, 1000)]


@given(st.lists(st.tuples(st.integers(0, 50), st.integers(1, 30)), max_size=20))
def test_ranges_cover_all_records(parts):
    rows, at = [], 0
    for gap, size in parts:
        rows.append((at + gap, size))
        at += gap + size
    reads = list(warc.ranges(rows, gap=10, most=60))
    assert [k for a, b, _, _ in reads for k in range(a, b)] == list(range(len(rows)))
    for a, b, start, stop in reads:
        assert start == rows[a][0] and stop == sum(rows[b - 1]) and (stop - start <= 60 or b - a == 1)


def test_running_total(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "a", None, "b"]), r.randrange(50) if r.random() < 0.9 else None, k) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, o int, v long")
    got = {x.v: x.t for x in running.running_total(df, ["g"], ["o", "v"], "v", "t").collect()}
    want, sums = {}, Counter()
    for g, o, v in sorted(rows, key=lambda x: (x[1] is None, x[1] or 0, x[2])):
        sums[g] += v
        want[v] = sums[g]
    assert got == want


def check_mix(rows, weights=(5, 2, 1)):
    """rows (doc_id, size, source_size, target, taken) with source: contract of the mix."""
    sizes = Counter()
    for source, r in rows:
        sizes[source] += r.size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    total, target, left = 1.5 * sum(sizes.values()), {}, set(order)
    while left:  # share, cap, reshare
        rest, w = total - sum(target.values()), sum(weight[s] for s in left)
        over = {s for s in left if rest * weight[s] / w > 2 * sizes[s]}
        if not over:
            target |= {s: rest * weight[s] / w for s in left}
            break
        target |= {s: 2 * sizes[s] for s in over}
        left -= over
    taken, largest = Counter(), Counter()
    for source, r in rows:
        assert r.taken in (0, r.size, 2 * r.size) and r.source_size == sizes[source]
        assert r.target == pytest.approx(target[source])
        taken[source] += r.taken
        largest[source] = max(largest[source], r.size)
    for s in order:
        assert abs(taken[s] - target[s]) <= 2 * largest[s]


def test_mixing_contract(docs, nothing):
    df, rows = docs
    sizes = df.select("doc_id", "source", mixing.word_count().alias("size"))
    got = mixing.mix(sizes).withColumn("taken", mixing.F.col("passes") * mixing.F.col("size")).collect()
    assert len(got) == len(rows)
    check_mix([(r.source, r) for r in got])
    a, b = (Counter(map(tuple, mixing.mix_counts(df.repartition(n)).collect())) for n in (2, 7))
    assert a == b
    assert mixing.mix_counts(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0
    only_empty = df.filter("doc_id in (1000, 1001)")
    assert [r.taken for r in mixing.mix_counts(only_empty).collect()] == [0, 0]


def test_mixed_documents_repeat_rows(docs):
    df, rows = docs
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    taken = mixing.mix_counts(df).collect()
    assert sum(len(brute.words(r.text)) for r in out.collect()) == sum(r.taken for r in taken)
    assert max(Counter((r.doc_id, r.text) for r in out.collect() if r.doc_id != 3).values()) <= 2


def test_packing(docs, nothing):
    df, rows = docs
    got = packing.pack_documents(df, buckets=4, budget=200).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((r[0], len(brute.words(r[1]))) for r in rows)
    slots = Counter((r.bucket, r.batch, r.slot) for r in got)
    assert max(slots.values()) == 1
    for (bucket, batch), members in {(r.bucket, r.batch): [x for x in got if (x.bucket, x.batch) == (r.bucket, r.batch)] for r in got}.items():
        assert all(r.n_tokens <= r.padded_tokens for r in members)
        assert len(members) == 1 or sum(r.padded_tokens for r in members) <= 200
        assert sorted(r.slot for r in members) == list(range(len(members)))
    assert packing.pack_documents(nothing).count() == 0


@settings(deadline=None)
@given(st.dictionaries(st.integers(0, 40), st.integers(1, 9), min_size=1, max_size=8), st.integers(1, 5))
def test_best_edges_are_optimal(histogram, buckets):
    from itertools import combinations

    lengths = sorted(histogram)
    cost = lambda edges: sum(n * min(e for e in edges if e >= x) for x, n in histogram.items())
    best = min(cost((*c, lengths[-1])) for k in range(min(buckets, len(lengths))) for c in combinations(lengths[:-1], k))
    got = packing.best_edges(lengths, [histogram[x] for x in lengths], buckets)
    assert cost(got) == best and len(got) <= buckets


def test_packing_keeps_the_budget(spark):
    """Lengths near and over the budget: no padded batch passes it but that of one longer document."""
    lengths = list(range(1, 60)) + [75, 80, 85, 99, 100, 101, 250, 250]
    rows = [(k, " ".join(["w"] * n)) for k, n in enumerate(lengths)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), buckets=3, budget=100).collect()
    sizes = Counter()
    for r in got:
        sizes[r.bucket, r.batch] += r.padded_tokens
        assert r.padded_tokens >= r.n_tokens and (r.padded_tokens <= 100 or r.padded_tokens == r.n_tokens)
    assert all(n <= 100 or (r := [x for x in got if (x.bucket, x.batch) == at]) and len(r) == 1 and r[0].n_tokens == n for at, n in sizes.items())
    edges = {r.bucket: r.padded_tokens for r in got if r.n_tokens <= 100}
    assert all(e == max(r.n_tokens for r in got if r.bucket == b) for b, e in edges.items())


def test_masked_lm_learns_held_out_text(spark, nothing):
    """Held-out score: sentences of a small grammar rise over their shuffled words, and training helps."""
    r = random.Random(8)
    sentence = lambda: " ".join(x for _ in range(12) for x in (r.choice(["the", "a"]), r.choice(["cat", "dog", "cow"]), r.choice(["eats", "sees"]), r.choice(["grass", "milk"])))
    train = spark.createDataFrame([(k, sentence()) for k in range(600)] + [(None, None), (901, "")], "doc_id long, text string").repartition(2)
    held = [sentence() for _ in range(40)]
    mixed = [" ".join(r.sample(x.split(), 48)) for x in held]
    test = spark.createDataFrame([(k, x) for k, x in enumerate(held + mixed)] + [(500, None), (501, " ")], "doc_id long, text string")
    words, flat = masked_lm.fit(train, rounds=8)
    start = masked_lm.fit(train, rounds=0)[1]
    mean = lambda weights: {x.doc_id: x.mean_log_probability for x in masked_lm.score(test, words, weights).collect()}
    after, before = mean(flat), mean(start)
    assert after[500] is None and after[501] is None
    assert sum(after[k] > after[40 + k] for k in range(40)) >= 38
    assert np.mean([after[k] for k in range(40)]) > np.mean([before[k] for k in range(40)]) + 0.5
    assert masked_lm.pseudo_likelihood(nothing).count() == 0


def test_masked_lm_gradients():
    """A step's direction agrees with numeric derivatives of the loss."""
    rng = np.random.default_rng(0)
    ids = np.concatenate(([0, 0], rng.integers(1, masked_lm.SIZE, 60), [0, 0])).astype(np.int64)
    at = np.arange(2, 62)
    w = masked_lm.unpack(masked_lm.initial().astype(np.float64))
    loss = lambda: -masked_lm.log_probabilities(w, ids, at).mean()
    before = {k: v.copy() for k, v in w.items()}
    base = loss()
    masked_lm.train_step(w, {k: np.full_like(v, 1e9) for k, v in w.items()}, ids, at)
    steps = {k: (before[k] - w[k]) * np.sqrt(1e9) / masked_lm.RATE for k in w}
    for name in w:
        w[name][...] = before[name]
    for name in w:
        place = np.unravel_index(np.abs(steps[name]).argmax(), steps[name].shape)
        w[name][place] += 1e-5
        assert (loss() - base) / 1e-5 == pytest.approx(steps[name][place], rel=2e-2), name
        w[name][place] = before[name][place]


def test_masked_lm_counts_travel_packed(monkeypatch):
    """A task sends a row for each bucket, not one for each word; merged, these are the counts."""
    monkeypatch.setattr(masked_lm, "HELD_COUNTS", 3000)
    r = random.Random(3)
    texts = [[" ".join(f"w{min(r.randrange(9000), r.randrange(9000))}" for _ in range(400)) for _ in range(20)] + [None, " "] for _ in range(4)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.string())], names=["text"]) for x in texts]
    parts = pa.Table.from_batches([b for x in (batches[:2], batches[2:]) for b in masked_lm._count_words(x)])
    want = Counter(w for x in texts for t in x if t for w in t.encode().split())
    assert 0 < len(parts) <= masked_lm.COUNT_BUCKETS * 4 < len(want)
    rows = [r for b in masked_lm._merge_counts(parts.sort_by("bucket").to_batches()) for r in b.to_pylist()]
    assert len(rows) == len(want) and {r["word"]: r["n"] for r in rows} == want
    assert [r["hash"] for r in rows] == masked_lm.word_hashes(pa.array([r["word"].decode() for r in rows])).tolist()


@pytest.mark.parametrize("sizes", [masked_lm.SIZES, (2175, 200)])
def test_masked_lm_step_equals_plain(sizes):
    """A step in double precision against one written out position by position, with words that repeat."""
    rng = np.random.default_rng(1)
    ids = np.concatenate(([0, 0], rng.integers(1, 40, 60), rng.integers(1, 1 + sum(sizes), 60), [0, 0])).astype(np.int64)
    at = np.arange(2, 122)
    w = masked_lm.unpack(masked_lm.initial(sizes).astype(np.float64), sizes)
    start = {k: v.copy() for k, v in w.items()}
    squares = {k: np.full_like(v, 0.01) for k, v in w.items()}
    masked_lm.train_step(w, squares, ids, at)
    g = {k: np.zeros_like(v) for k, v in start.items()}
    softmax = lambda x: np.exp(x) / np.exp(x).sum()
    for k in at:
        c, m = divmod(ids[k], start["to_member"].shape[1])
        near = [(p, ids[k + d]) for p, d in enumerate((-2, -1, 1, 2))]
        h = np.tanh(start["bias"] + sum(start["embed"][x] for x in near))
        state = h + start["class_embed"][c]
        x, y = softmax(h @ start["to_class"] + start["class_bias"]), softmax(state @ start["to_member"] + start["member_bias"][c])
        x[c] -= 1
        y[m] -= 1
        of_member = start["to_member"] @ y
        dh = (start["to_class"] @ x + of_member) * (1 - h * h)
        for name, place, value in [("to_class", ..., np.outer(h, x)), ("class_bias", ..., x), ("to_member", ..., np.outer(state, y)), ("member_bias", c, y), ("class_embed", c, of_member), ("bias", ..., dh), *(("embed", x, dh) for x in near)]:
            g[name][place] += value / len(at)
    for name in w:
        assert np.allclose(squares[name], 0.01 + g[name] ** 2, atol=1e-12), name
        assert np.allclose(w[name], start[name] - masked_lm.RATE * g[name] / np.sqrt(0.01 + g[name] ** 2), atol=1e-9), name


def test_masked_lm_large_logits():
    """Logits beyond what can be exponentiated give the logarithms that double precision gives."""
    w = masked_lm.unpack(masked_lm.initial() * np.float32(300))
    ids, at = np.random.default_rng(2).integers(0, masked_lm.SIZE, 64), np.arange(2, 62)
    got, want = masked_lm.log_probabilities(w, ids, at), masked_lm.log_probabilities({k: v.astype(np.float64) for k, v in w.items()}, ids, at)
    assert np.isfinite(got[want > -80]).all() and np.allclose(got, want, rtol=1e-3, atol=0.1)


def test_functions_travel_by_value(tmp_path):
    """Workers need no copy of the package."""
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    functions = [substring._pack, substring._solve, suffix_merge._pack, suffix_merge._solve, minhash._sign, minhash._pairs, minhash._confirm, embedding._windows, embedding._count, quality._measure, chat._format, warc._write, warc._read, masked_lm._train, masked_lm._score, components._forests]
    (tmp_path / "f").write_bytes(cloudpickle.dumps(functions))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = f"import pickle, sys; assert len(pickle.load(open({str(tmp_path / 'f')!r}, 'rb'))) == {len(functions)}; assert 'spanforge' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], cwd="/", env=env, check=True)


def test_tables_are_dropped_on_demand(spark, monkeypatch):
    import os

    monkeypatch.setattr(common, "_PATHS", [])
    df = common.materialise(spark.range(3), "some")
    path = common._PATHS[0].removeprefix("file://")
    assert df.count() == 3 and os.path.isdir(path)
    common.drop_tables(spark)
    assert not os.path.exists(path) and common._PATHS == []


def test_masked_lm_scores_unknown_words_by_their_share(spark, monkeypatch):
    """Words outside the vocabulary: a rare one scores below one often seen, and the shares of a bucket sum to one."""
    monkeypatch.setattr(masked_lm, "VOCAB", 1)
    monkeypatch.setattr(masked_lm, "BUCKETS", 1)
    monkeypatch.setattr(masked_lm, "OFTEN", 1)
    df = spark.createDataFrame([(k, "the " * 200 + "real " * 4 + ("gibberish" if k == 0 else "")) for k in range(5)], "doc_id long, text string")
    known, flat = masked_lm.fit(df, rounds=0)
    assert known.words[0] == b"the"
    score = {r.doc_id: r.pseudo_log_likelihood for r in masked_lm.score(spark.createDataFrame([(0, "real"), (1, "gibberish"), (2, "never")], "doc_id long, text string"), known, flat).collect()}
    assert b"real" not in known.words
    assert score[0] - score[1] == pytest.approx(np.log(20)) and score[1] == pytest.approx(score[2])


def test_masked_lm_vocabulary_grows(spark):
    """Every word over the minimum count is in the vocabulary, however many there are; the buckets follow."""
    words = [f"w{k}" for k in range(5000)]
    df = spark.createDataFrame([(k, " ".join(words)) for k in range(80)], "doc_id long, text string")
    known, flat = masked_lm.fit(df, rounds=0)
    assert len(known.words) == 5000 and known.sizes == (5000, 5000 // masked_lm.SPREAD)
    assert flat.size == masked_lm.n_parameters(known.sizes) and known.rest.sum() == 0
    got = masked_lm.score(df, known, flat).collect()
    assert all(r.n_in_vocabulary == r.n_words == 5000 for r in got)


@pytest.mark.parametrize("rounds", [1, 2, 3, 8])
def test_masked_lm_trains_on_every_word(monkeypatch, rounds):
    """Over the rounds each word is a target once, also where a text is cut, with its own neighbours."""
    seen = []

    def step(w, squares, ids, at):
        seen.extend(tuple(ids[k - masked_lm.SIDE : k + masked_lm.SIDE + 1].tolist()) for k in at)

    monkeypatch.setattr(masked_lm, "train_step", step)
    monkeypatch.setattr(masked_lm, "PIECE", 7)
    words = [f"w{k}".encode() for k in range(50)]
    texts = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([1, 2]), pa.array([b" ".join(words).decode(), "w3"])], names=["doc_id", "key", "text"])
    (batch,) = masked_lm._tokenise([texts], words, masked_lm.SIZES)  # every word is in the vocabulary
    batch = batch.append_column("shard", pa.array([0, 1]))
    start = masked_lm.initial().tobytes()
    for turn in range(rounds):
        list(masked_lm._train([batch], masked_lm.SIZES, start, turn, rounds))
    ids = [0, 0, *range(1, 51), 0, 0]
    assert sorted(seen) == sorted([tuple(ids[k : k + 5]) for k in range(50)] + [(0, 0, 4, 0, 0)])


def test_masked_lm_pieces_keep_their_neighbours(spark, monkeypatch):
    df = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 7}" for j in range(40))) for k in range(1, 6)], "doc_id long, text string")
    known, flat = masked_lm.fit(df)
    whole = {r.doc_id: r.pseudo_log_likelihood for r in masked_lm.score(df, known, flat).collect()}
    monkeypatch.setattr(masked_lm, "PIECE", 3)
    cut = {r.doc_id: r.pseudo_log_likelihood for r in masked_lm.score(df, known, flat).collect()}
    assert all(cut[k] == pytest.approx(whole[k], rel=1e-6) for k in whole)


def test_embedding_windows_cross_partitions(spark):
    """Each vector is compared with the window that follows it, over the ends of partitions and runs."""
    vec = np.array([1.0, 2.0]).tobytes()
    rows = spark.createDataFrame([(0, 2, bytes([k]), k, vec) for k in range(40)], "turn int, dim int, key binary, uid long, vec binary")
    placed = rows.drop("vec").repartitionByRange(7, "key").sortWithinPartitions("key")
    spans_of = {}
    for r in embedding._runs(placed, rows, 3).collect():
        spans_of.setdefault(r.span, []).append(r.uid)
    each = 3 * embedding.SPAN
    assert all({k, k + j} <= set(spans_of[k // each]) for k in range(40) for j in range(1, 4) if k + j < 40)
    links = embedding._runs(placed, rows, 3).mapInArrow(lambda it: embedding._windows(it, 0.95, 3, np.float64), "a long, b long")
    roots = {x.component for x in components.components(links).collect()}
    assert roots == {0}


def test_quality_counts_documents_not_texts(spark):
    """Copies count; a line in a few per cent of a large host goes, one in a few documents stays."""
    own = lambda k, n: " ".join(f"t{k}w{j}" for j in range(n))
    rows = [(k, own(k, 30), "big") for k in range(2000)]
    rows += [(3000 + k, "seen by few per cent of the host\n" + own(3000 + k, 30), "big") for k in range(60)]
    rows += [(4000 + k, "seen by fifty at most\n" + own(4000 + k, 30), "big") for k in range(50)]
    rows += [(5000 + k, own(5000, 30), "big") for k in range(60)] + [(6000 + k, own(6000, 30), "big") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r.text for r in quality.quality_filter(df).collect()}
    assert out[3000] == own(3000, 30) and out[4000].startswith("seen by fifty")
    assert not any(5000 <= k < 5060 for k in out) and all(6000 + k in out for k in range(40))
    got = {r.doc_id: r.kept for r in quality.quality_digest(df).collect()}
    assert {w[0]: w[-1] for w in brute.quality(rows)} == got


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "B b", "b  B", "ü|", " \t", "\x0b", "#", "a b c d e f", ""]), max_size=60))
def test_quality_of_long_texts(lines):
    """Very long texts are counted from hashes, in parts, with the same results."""
    text = "\n".join(lines).encode()
    counts, hashes = quality.base_counts(text), quality.line_hashes(text)
    assert quality._long_counts(text) == counts
    long = quality.LONG
    quality.LONG = 1
    try:
        assert quality.line_hashes(text) == hashes and quality.base_counts(text) == counts
    finally:
        quality.LONG = long
    assert [x for part in common.word_parts(text, 5) for x in part] == text.split()


@pytest.mark.parametrize("call", ["quality.base_counts(t)", "quality.line_hashes(t)", "minhash.shingle_hashes([t], 5)"])
def test_memory_of_a_very_long_text(call):
    """100 MB in less than 1 GB."""
    import subprocess
    import sys

    code = f"""import resource, numpy as np
from spanforge.llm import minhash, quality
r = np.random.default_rng(1)
t = b" ".join(b"%d" % x for x in r.integers(0, 10**6, 1 << 18).tolist())
t = (t + b"\\n") * (100_000_000 // len(t))
{call}
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"""
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 1000


@pytest.mark.parametrize("common_part", [0.0, 1.0])
def test_embedding_recall_at_scale(spark, common_part):
    """Isolated pairs just over the threshold among 50,000 vectors, spread evenly or about a common direction."""
    r = np.random.default_rng(8)
    n, pairs, dim = 50_000, 1000, 32
    x = r.standard_normal((n, dim)) + common_part
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    step = r.standard_normal((pairs, dim))
    step -= (step * x[:pairs]).sum(1, keepdims=True) * x[:pairs]
    step /= np.linalg.norm(step, axis=1, keepdims=True)
    x[pairs : 2 * pairs] = 0.951 * x[:pairs] + np.sqrt(1 - 0.951**2) * step
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {row.vec_id: row.component_id for row in embedding.embedding_near_duplicates(frame).collect()}
    assert sum(got[k] == got[pairs + k] for k in range(pairs)) >= 0.99 * pairs


@pytest.mark.parametrize("clusters", [4, 40, 400])
def test_embedding_recall_in_clusters(spark, clusters):
    """1,000 pairs just over the threshold among 40,000 vectors in dense clusters."""
    r = np.random.default_rng(clusters)
    n, pairs, dim = 40_000, 1000, 64
    centres = r.standard_normal((clusters, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = np.sqrt(0.9) * centres[np.arange(n) % clusters]
    off = r.standard_normal((n, dim))
    x += np.sqrt(0.1) * off / np.linalg.norm(off, axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    step = r.standard_normal((pairs, dim))
    step -= (step * x[:pairs]).sum(1, keepdims=True) * x[:pairs]
    step /= np.linalg.norm(step, axis=1, keepdims=True)
    x[-pairs:] = 0.951 * x[:pairs] + np.sqrt(1 - 0.951**2) * step
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {row.vec_id: row.component_id for row in embedding.embedding_near_duplicates(frame).collect()}
    assert sum(got[k] == got[n - pairs + k] for k in range(pairs)) >= 0.99 * pairs


@pytest.mark.parametrize("shared", [0.98, 0.99, 1.0])
def test_embedding_one_direction(spark, shared):
    """Vectors about one direction, copies of one vector among them."""
    r = np.random.default_rng(2)
    base = r.standard_normal(16)
    x = [(base / np.linalg.norm(base) * np.sqrt(shared) + np.sqrt(1 - shared) * v / np.linalg.norm(v)).tolist() for v in r.standard_normal((200, 16))] + [base.tolist()] * 100
    rows = list(enumerate(x))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    same(embedding.embedding_near_duplicates(frame).select("vec_id", "n_links", "component_id", "kept").collect(), brute.vectors(rows))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "cc", "dd", " ", "\n"]), max_size=50), st.integers(1, 4))
def test_shingles_of_long_texts(words, size):
    """Very long texts are hashed in parts, to the same set."""
    text = " ".join(words).encode()
    want = minhash.shingle_hashes([b"x y z", text, b""], size)
    old = minhash.LONG, minhash.SLICE_BYTES
    minhash.LONG, minhash.SLICE_BYTES = 1, 3
    try:
        got = minhash.shingle_hashes([b"x y z", text, b""], size)
    finally:
        minhash.LONG, minhash.SLICE_BYTES = old
    assert [x.tolist() for x in got] == [x.tolist() for x in want]


def test_templates_in_tiles(spark, monkeypatch):
    """A dense node of sets that don't link, but for some: compared whole, in tiles, from which a forest of links comes."""
    for name, value in (("TILE", 40), ("COLUMNS", 64), ("LEAF", 16), ("PART", 32)):
        monkeypatch.setattr(minhash, name, value)
    base = " ".join(f"q{k}" for k in range(170))
    rows = [(k, base + " " + " ".join(f"u{k}x{j}" for j in range(29))) for k in range(200)]
    rows += [(1000 + k, f"{rows[k][1]} {rows[k + 1][1][-30:]} v{k}") for k in range(0, 200, 9)]
    seen: list = []
    rest = minhash._Join._rest
    monkeypatch.setattr(minhash._Join, "_rest", lambda *a: seen.append(out := rest(*a)) or out)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicate_digest(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    want = brute.near([(k, k, t) for k, t in rows], 2)
    assert got == {k: c for k, (_, c) in want.items()}
    assert seen and seen[0] is not None


def test_chat_layouts_with_other_fields(spark):
    """Fields that no layout names don't hide a layout; fields of another kind do."""
    records = [
        ({"id": 3, "meta": {"source": "x"}, "messages": [{"role": "user", "content": "u", "name": "n"}, {"role": "assistant", "content": None}]}, "messages", [("user", "u"), ("assistant", "")]),
        ({"instruction": "i", "output": "o", "tags": ["a"], "score": 1.5}, "instruction", [("user", "i"), ("assistant", "o")]),
        ({"prompt": "p", "completion": "c", "system": "s", "question": "q"}, "prompt", [("system", "s"), ("user", "p"), ("assistant", "c")]),
        ({"id": 1, "messages": []}, "messages", []),
        ({"messages": [{"role": "user", "content": [{"type": "text"}]}]}, "unknown", None),
        ({"messages": ["plain", {"role": "user", "content": "u"}]}, "unknown", None),
        ({"instruction": 5, "output": "o"}, "unknown", None),
        ({"prompt": "p", "id": 1}, "unknown", None),
    ]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, (r, _, _) in enumerate(records)], "conv_id long, record string")
    got = {r.conv_id: r for r in chat.format_records(df).collect()}
    for k, (_, layout, turns) in enumerate(records):
        assert got[k].layout == layout and (chat.parse(got[k].formatted) if got[k].formatted is not None else None) == turns


@given(st.lists(st.text(alphabet=st.sampled_from(list("ab\t\n\x0b \x1c\x85\u00a0é日")), max_size=12) | st.none(), max_size=6))
def test_words_of_a_batch(texts):
    words, ends = masked_lm.split_words(pa.array(texts, pa.string()))
    got = [x.encode() for x in words.to_pylist()]
    assert [got[a:b] for a, b in zip(ends, ends[1:])] == [(x or "").encode().split() for x in texts]
    assert len(set(zip(got, masked_lm.word_hashes(words).tolist()))) == len(set(got)) == len(set(masked_lm.word_hashes(words).tolist()))


def test_masked_lm_scores_again_plainly(spark, monkeypatch):
    """Every score again from the parameters, a word at a time; the same for any partitioning."""
    monkeypatch.setattr(masked_lm, "VOCAB", 20)
    monkeypatch.setattr(masked_lm, "BUCKETS", 4)
    monkeypatch.setattr(masked_lm, "SHARD_WORDS", 300)
    monkeypatch.setattr(masked_lm, "BUCKET_WORDS", 7)
    monkeypatch.setattr(masked_lm, "SLICE_BYTES", 200)
    monkeypatch.setattr(masked_lm, "HELD_COUNTS", 10)
    r = random.Random(4)
    rows = [(k, " ".join(f"w{min(r.randrange(60), r.randrange(60))}" for _ in range(r.randrange(1, 40)))) for k in range(60)] + [(100, None), (101, " \n"), (102, "never_seen w0 w1"), (102, "never_seen w0 w1")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known, flat = masked_lm.fit(df.repartition(1))
    assert np.array_equal(flat, masked_lm.fit(df.repartition(5))[1])
    counts = Counter(x for _, t in rows for x in brute.words(t))
    w, ids = masked_lm.unpack(flat.astype(np.float64), known.sizes), {x.decode(): k + 1 for k, x in enumerate(known.words)}
    bucket = lambda x: int(masked_lm.word_hashes(pa.array([x]))[0] % known.sizes[1])
    members = w["to_member"].shape[1]
    softmax = lambda x: np.exp(x) / np.exp(x).sum()
    for row in masked_lm.score(df, known, flat).collect():
        text = next(t for k, t in rows if k == row.doc_id)
        tokens = brute.words(text)
        number = lambda x: ids[x] if x in ids else 1 + known.sizes[0] + bucket(x)
        near = [0, 0, *map(number, tokens), 0, 0]
        want = 0.0
        for k, x in enumerate(tokens):
            h = np.tanh(w["bias"] + sum(w["embed"][p][near[k + 2 + d]] for p, d in enumerate((-2, -1, 1, 2))))
            c, m = divmod(near[k + 2], members)
            want += np.log(softmax(h @ w["to_class"] + w["class_bias"])[c]) + np.log(softmax((h + w["class_embed"][c]) @ w["to_member"] + w["member_bias"][c])[m])
            if x not in ids:
                inside = sum(n for y, n in counts.items() if y not in ids and bucket(y) == bucket(x))
                want += np.log(counts[x]) - np.log(inside + 1)
        assert row.n_words == len(tokens) and row.pseudo_log_likelihood == pytest.approx(want, rel=1e-4, abs=1e-6)


def test_masked_lm_unknown_words_lower_the_score(spark):
    r = random.Random(9)
    common_words = [f"c{k}" for k in range(300)]
    rows = [(k, " ".join(r.choice(common_words) for _ in range(80))) for k in range(400)]
    rare = [(1000 + k, " ".join(f"z{k}x{j}" if j % 2 else x for j, x in enumerate(rows[k][1].split()))) for k in range(20)]
    known, flat = masked_lm.fit(spark.createDataFrame(rows + [(5000 + k, " ".join(f"u{k}y{j}" for j in range(80))) for k in range(200)], "doc_id long, text string"))
    got = {x.doc_id: x.mean_log_probability for x in masked_lm.score(spark.createDataFrame(rows[:20] + rare, "doc_id long, text string"), known, flat).collect()}
    assert sum(known.sizes) < 16_500 and all(got[1000 + k] < got[k] for k in range(20))


def test_thin_hot_minimisers_are_found(docs, monkeypatch):
    """A minimiser that no chunk sees often is found by its reported share; results stay the same."""
    df, rows = docs
    monkeypatch.setattr(spans, "HOT_FRAGMENTS", 2)
    monkeypatch.setattr(spans, "REPORTED", 10**6)
    monkeypatch.setattr(spans, "THIN", 2)
    monkeypatch.setattr(spans, "MOST_PARTITIONS", 2)
    monkeypatch.setattr(substring, "BUCKET_BYTES", 4000)
    assert len(spans.hot_minimisers(spans.prepared(df.select("doc_id", "text")), lambda it: substring._hashes(it, 13)))
    same(substring.substring_digest(df).collect(), brute.substring([r[:2] for r in rows]))
