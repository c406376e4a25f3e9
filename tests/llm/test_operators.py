"""Each operator against a brute-force statement of its result, on odd rows: nulls, empty and long texts, ties, repeats."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from razonete.llm import block_anchors, bpe_matrix, mil_quality, multiset_fingerprint, odd_sketch, reply_trees, source_mix, text_rules, token_orc, warc_index
from razonete.session import scratch_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PASSAGE = " ".join(f"passage{i}" for i in range(60))
BODY = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(8)]
TEXTS = {
    0: BODY[0], 1: BODY[0], 2: BODY[0] + " tail", 3: None, 4: "", 5: "  \n\t ", 6: "one", 7: "One", 8: "a b c d",
    9: BODY[1] + "\n" + PASSAGE, 10: "x y\n" + PASSAGE + "\n" + BODY[2], 11: PASSAGE + " end", 12: "a  b   c \x0b\x85 é日本 don't <s>",
    13: "z" * 5000, 14: "the cat\n" * 400, 15: BODY[3].upper(), 16: BODY[3], 17: "spam!! " * 90, 18: "* " + BODY[4], 19: "|".join(BODY[5:]),
}
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, bucket int, cls string, windows string, label int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", None if t is None else len(t), i, "c", None, 0) for i, t in TEXTS.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def by_id(df):
    rows = {r.doc_id: r for r in df.collect()}
    assert set(rows) == set(TEXTS)
    return rows


def test_token_orc(spark, docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    path = scratch_path(spark, "t-orc")
    token_orc.write_token_ids(docs, path, P.path("byte_bpe_50k.json"), partitions=3)
    got, start = by_id(token_orc.token_digests(spark, path)), 0
    for i, t in TEXTS.items():
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        assert tuple(got[i])[1:] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        start += len(ids)
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,3)]" in token_orc.read_token_ids(spark, path).where("doc_id = 3")._jdf.queryExecution().toString()
    path = scratch_path(spark, "t-orc")
    token_orc.write_token_ids(empty, path, P.path("byte_bpe_50k.json"), partitions=2)
    assert token_orc.token_digests(spark, path).count() == 0


def test_bpe_matrix(docs, empty):
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    args = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    got, ids, back = by_id(bpe_matrix.round_trip(docs, *args)), by_id(bpe_matrix.encode(docs, *args)), by_id(bpe_matrix.decode(bpe_matrix.encode(docs, *args), *args))
    for i, t in TEXTS.items():
        want = enc.encode_ordinary(t or "")
        assert ids[i].ids == want and bytes(back[i].bytes) == (t or "").encode()
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    assert bpe_matrix.round_trip(empty, *args).count() == 0


def test_rules(docs, empty, spark):
    got = by_id(text_rules.apply_rules(docs, None))
    for i, t in TEXTS.items():
        w, seen, dup = words(t), set(), 0
        for line in (t or "").split("\n"):
            dup += bool(WORD.search(line)) and line in seen
            seen.add(line)
        c = Counter(zip(w, w[1:], w[2:]))
        rep = sum(any(0 <= s <= len(w) - 3 and c[tuple(w[s:s + 3])] > 1 for s in (k - 2, k - 1, k)) for k in range(len(w)))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum((t or "").count(s) for s in "#*$%&|<>"), dup, rep), i
        assert r.base_failed == (len(w) < 50 or 100 * rep > 50 * len(w)) and (not r.base_failed or not r.kept)
    assert text_rules.apply_rules(empty, None).count() == 0


def test_trees_are_monotone_and_learn():
    rng = np.random.default_rng(3)
    x = rng.random((3000, 7))
    y = (x[:, 0] + 0.2 * rng.random(3000) < 0.6).astype(float)
    trees = text_rules.fit_trees(x, y, text_rules.MONOTONE)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.9
    for f in np.flatnonzero(text_rules.MONOTONE):
        line = np.repeat(x[:20], 50, axis=0)
        line[:, f] = np.tile(np.linspace(0, 1, 50), 20)
        assert (np.diff(trees.score(line).reshape(20, 50), axis=1) <= 1e-12).all()


def test_quality_held_out(spark):
    from conftest import SF01

    docs, labels = spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")
    rows = mil_quality.score(docs, mil_quality.fit(docs, labels)).join(labels, "doc_id").where(mil_quality.held_out(F.col("doc_id"))).collect()
    right = sum((r.score >= mil_quality.THRESHOLD) == (r.quality == 1) for r in rows)
    assert len(rows) > 50 and right / len(rows) > 0.93


def test_quality_odd_rows(docs, empty, spark):
    labels = spark.createDataFrame([(0, 1, 0), (17, 0, 0), (9, 1, 0), (14, 0, 0), (3, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = by_id(mil_quality.score(docs, mil_quality.fit(docs, labels)))
    assert all(0 <= r.score <= 1 for r in got.values())
    model = mil_quality.fit(empty, labels)
    assert mil_quality.score(empty, model).count() == 0 and model.prior == 0.5
    assert mil_quality.keep_good(docs, model).count() == 0 and mil_quality.keep_good(docs, model).columns == docs.columns


def test_fingerprint(docs, empty, spark):
    got, order = by_id(multiset_fingerprint.edited_fingerprints(docs)), sorted(TEXTS)
    for k, i in enumerate(order):
        t, n = TEXTS[i] or "", TEXTS[order[(k + 1) % len(order)]] or ""
        q = len(t) // 4
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256((t[:len(t) - q] + n[:q]).encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[0].fingerprint == got[1].fingerprint != got[2].fingerprint and got[0].near_next == 1.0
    assert multiset_fingerprint.edited_fingerprints(empty).count() == 0
    one = multiset_fingerprint.edited_fingerprints(spark.createDataFrame([(5, "abcd")], "doc_id bigint, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abca").hexdigest()


def test_fingerprint_is_homomorphic():
    f = lambda *t: multiset_fingerprint.sums(pa.array(["\n".join(t)], pa.large_string()))
    same = lambda a, b: (a[0] == b[0]).all() and (a[1] == b[1]).all()
    a, b, c = BODY[0], BODY[1], "short"
    assert same(f(a, b, c), f(c, a, b)) and same(multiset_fingerprint.combine(f(a, b), f(c)), f(a, b, c))
    assert same(multiset_fingerprint.combine(f(a, b, c), f(b), remove=True), f(a, c)) and not same(f(a, a, b), f(a, b))


def test_near_duplicates(docs, empty):
    got = by_id(odd_sketch.near_duplicates(docs))
    sets = {}
    for i, t in TEXTS.items():
        w = words((t or "").translate(LOWER))
        sets[i] = set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else {tuple(w)} if w else set()
    low = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    for i, r in got.items():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[i]), low[i], low[i] == i), i
    assert odd_sketch.near_duplicates(empty).count() == 0


def test_near_duplicates_chain(spark):
    """A group whose ends are linked only through the middle, more members than a bucket's first one links."""
    base = [f"t{i}" for i in range(200)]
    rows = [(k, " ".join(base[k * 6:k * 6 + 60])) for k in range(20)] + [(100 + k, " ".join(base[:60])) for k in range(30)] + [(None, " ".join(base[:60]))]
    got = odd_sketch.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.component_id for r in got if r.doc_id is not None} == {0} and sum(r.kept for r in got) == 2


def test_block_anchors(docs, empty):
    got, first = by_id(block_anchors.removal_digests(docs, bits=1 << 20)), {}
    for i, t in sorted(TEXTS.items()):
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first.setdefault(tuple(w[k:k + 13]), i) < i:
                gone[k:k + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert tuple(got[i])[1:] == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()), i
    assert block_anchors.removal_digests(empty, bits=1 << 20).count() == 0
    out = block_anchors.drop_repeats(docs, bits=1 << 20)
    assert out.columns == docs.columns and out.count() == len(TEXTS)
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[0] == TEXTS[0] and texts[3] is None and texts[11] == "end" and texts[12] == TEXTS[12]


def test_mix(docs, empty):
    got = by_id(source_mix.mix_table(docs))
    assert sorted(map(tuple, got.values())) == sorted(map(tuple, source_mix.mix_table(docs.repartition(7)).collect()))
    sizes, taken = Counter(), Counter()
    for i, r in got.items():
        key = None if i % 7 == 0 else f"s{i % 3}"
        assert r.size == len(words(TEXTS[i])) and r.taken <= 2 * r.size
        sizes[key] += r.size
        taken[key] += r.taken
    order = sorted((k for k in sizes if k is not None)) + [None]
    weight, target, total = dict(zip(order, (3, 1, 2, 3))), {}, 1.5 * sum(sizes.values())
    while len(target) < len(order):
        free = [k for k in order if k not in target]
        share = (total - sum(target.values())) / sum(weight[k] for k in free)
        capped = [k for k in free if share * weight[k] > 2 * sizes[k]]
        target |= {k: 2.0 * sizes[k] for k in capped} if capped else {k: share * weight[k] for k in free}
    for i, r in got.items():
        key = None if i % 7 == 0 else f"s{i % 3}"
        assert r.source_size == sizes[key] and r.target == pytest.approx(target[key])
    for k in order:
        assert abs(taken[k] - target[k]) <= max(len(words(TEXTS[i])) for i in TEXTS if (None if i % 7 == 0 else f"s{i % 3}") == k)
    assert source_mix.mix_table(empty).count() == 0
    mix = source_mix.mixed(docs)
    assert mix.columns == docs.columns
    n = Counter(r.doc_id for r in mix.collect())
    assert all(n[i] == (r.taken // r.size if r.size else 1) for i, r in got.items())


def test_warc(spark):
    pages = spark.createDataFrame([(3, "http://a/ b", "<p>x</p>", 1), (1, None, "<p>x</p>", 2), (2, "u\r\nX: y", None, 3), (5, "u", "", 4), (None, "u", "é" * 9, 5),
                                   (1, "again", "<p>x</p>", 6)], "page_id bigint, url string, html string, digest int")
    path = scratch_path(spark, "t-warc")
    warc_index.write_archive(pages, path)
    rows = warc_index.read_records(warc_index.read_index(spark, path), path).collect()
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows)
    d = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    assert got == Counter([(3, 8, d("<p>x</p>"), "revisit", 1), (1, 8, d("<p>x</p>"), "response", None), (1, 8, d("<p>x</p>"), "response", None),
                           (2, 0, d(""), "response", None), (5, 0, d(""), "revisit", 2), (None, 18, d("é" * 9), "response", None)])
    some = warc_index.read_records(warc_index.read_index(spark, path).where("url = 'again'"), path).collect()
    assert [bytes(r.payload) for r in some] == [b"<p>x</p>"]
    path = scratch_path(spark, "t-warc")
    warc_index.write_archive(pages.limit(0), path)
    assert warc_index.read_records(warc_index.read_index(spark, path), path).count() == 0


def test_chat(spark):
    table = spark.createDataFrame([(1, 0, "user", "</s>[INST] &lt; ok", 1), (1, 1, "assistant", "<|user|>\n", 2), (2, 0, None, None, 3), (None, 4, "assistant", "b", 4),
                                   (None, 4, "assistant", "a", 5)], "conv_id bigint, turn bigint, role string, text string, tree int")
    path = scratch_path(spark, "t-chat")
    reply_trees.write_formatted(reply_trees.format_paths(reply_trees.conversation_messages(table)), path)
    got = {r.tree: ([tuple(t) for t in r.turns], r.learned) for r in reply_trees.read_turns(spark, path).collect()}
    assert got == {1: ([("user", "</s>[INST] &lt; ok"), ("assistant", "<|user|>\n")], "<|user|>\n"), 2: ([("", "")], ""),
                   None: ([("assistant", "a"), ("assistant", "b")], "ab")}


def test_reply_trees(spark):
    m = spark.createDataFrame([(1, 1, None, 0.0), (1, 2, 1, 1.0), (1, 3, 1, 5.0), (1, 4, 2, 9.0), (1, 5, 3, 1.0), (1, 6, 99, 0.5), (2, 1, 2, 1.0), (2, 2, 1, 1.0), (2, 3, 2, 1.0)],
                              "tree bigint, node bigint, parent bigint, score double")
    rows = reply_trees.best_paths(m, branches=2).orderBy("tree", "branch", "pos").collect()
    assert [(r.tree, r.branch, r.pos, r.node) for r in rows] == [(1, 1, 1, 1), (1, 1, 2, 2), (1, 1, 3, 4), (1, 2, 1, 1), (1, 2, 2, 3), (1, 2, 3, 5)]


def test_pipeline(spark):
    import corpus_pipeline
    from conftest import SF001

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "mix", "tokenize"]
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    out = corpus_pipeline.run(spark, SF001)
    rows = out.collect()
    assert rows and {r.doc_id for r in rows} <= ids and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_token_orc_marker(spark):
    """A special token's string in a text is that token, as in an unmodified Tokenizer."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["plain text", "hello <|endoftext|> there", "a\n <|endoftext|>\n b<|endoftext|>", "", "after it", None]
    path = scratch_path(spark, "t-orc")
    token_orc.write_token_ids(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1), path, P.path("byte_bpe_50k.json"), partitions=2)
    got = {r.doc_id: list(r.ids) for r in token_orc.read_token_ids(spark, path).collect()}
    assert got == {i: tok.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    assert 50256 in got[1]


def test_quality_fitting_sample_is_bounded(spark, monkeypatch):
    """Documents are learned from whole; those that do not fit the passages' bound are passed over."""
    seen = []
    monkeypatch.setattr(mil_quality, "fit_model", lambda x, first, y: seen.append(sorted(np.diff(first).tolist())))
    docs = spark.createDataFrame([(0, " ".join(f"w{i}" for i in range(64_000))), (1, "one"), (4, "two")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (4, 1)], "doc_id bigint, quality int")
    mil_quality.fit(docs, labels)
    mil_quality.fit(docs, labels, max_passages=500)
    assert seen == [[1, 1, 1000], [1, 1]]


def test_words_do_not_collide(spark):
    """Words that a polynomial hash modulo 2**64 cannot tell apart."""
    from razonete.llm.textscan import span_hash

    t = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    a, b = f"xxx{t}yyy", f"xxx{t.translate(str.maketrans('ab', 'ba'))}yyy"
    docs = spark.createDataFrame([(0, a), (1, b), (2, f"{a}\n{b}")], "doc_id bigint, text string").coalesce(1)
    got = {r.doc_id: r for r in bpe_matrix.round_trip(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    assert [got[i].decoded_sha256 for i in range(3)] == [hashlib.sha256(x.encode()).hexdigest() for x in (a, b, f"{a}\n{b}")]
    assert len({r.fingerprint for r in multiset_fingerprint.edited_fingerprints(docs).collect()}) == 3
    assert {r.component_id for r in odd_sketch.near_duplicates(docs).collect()} == {0, 1, 2}
    assert {r.n_dup_lines for r in text_rules.apply_rules(docs, None).collect()} == {0}
    rng, data = np.random.default_rng(1), np.frombuffer((t * 20).encode(), np.uint8)
    start = rng.integers(0, 20_000, 30_000)
    end = start + rng.integers(0, 300, 30_000)
    spans = [data[x:y].tobytes() for x, y in zip(start, end)]
    h = span_hash(data, start, end)
    assert len(set(h.tolist())) == len(set(spans)) == len(set(zip(h.tolist(), spans)))


def test_near_dedup_rows_of_one_id(spark):
    """Rows that share an id: only the duplicate goes; rows that repeat id and text: one stays."""
    import corpus_pipeline

    a, b, c, d = BODY[:4]
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "x"), (2, None, "x"), (3, c, "x"), (3, c, "x"), (3, c.upper(), "y"), (4, c, "x"),
            (5, d, "x"), (5, d + " tail", "x"), (None, a, "x"), (None, a, "x"), (6, "", "x"), (6, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    out = corpus_pipeline.near_dedup(spark, docs, "")
    got = Counter(map(tuple, out.collect()))
    fives = [r for r in got.elements() if r[0] == 5]
    assert out.columns == docs.columns and len(fives) == 1 and fives[0] in rows
    assert got - Counter(fives) == Counter([(1, a, "x"), (2, b, "x"), (2, None, "x"), (3, c.upper(), "y"), (None, a, "x"), (None, a, "x"), (6, "", "x"), (6, "", "x")])


def test_pipeline_rows(spark, tmpdir_path):
    """run() against a plain-Python chain of the stages, row for row; scores and shares are the operators' own."""
    import corpus_pipeline
    import tiktoken

    from razonete.llm.textscan import words as scan

    rng = np.random.default_rng(5)
    good = [" ".join(f"word{k}" for k in rng.integers(0, 4000, 60 + 3 * i)) for i in range(24)]
    texts = {i: t for i, t in enumerate(good)} | {100 + i: "spam!! buy $$$ " * (30 + i) for i in range(16)}
    texts |= {24: good[0], 25: good[1] + " end", 26: good[2] + "\n" + PASSAGE, 27: PASSAGE + " " + good[3][::-1]}
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in texts.items()]
    rows += [(5, " ".join(f"other{k}" for k in range(90)), "en", "s1", 1), (24, " ".join(f"else{k}" for k in range(70)), "en", "s0", 1), (6, good[6], "en", "s0", len(good[6]))]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmpdir_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100)) for i in texts], "doc_id bigint, quality int").write.parquet(f"{tmpdir_path}/labels.parquet")
    model = mil_quality.fit(*(spark.read.parquet(f"{tmpdir_path}/{t}.parquet") for t in ("documents", "labels")))
    score = lambda t: model.score(*mil_quality.passages(scan(pa.array([t], pa.large_string()))))[0]
    kept = sorted(r for r in rows if score(r[1]) >= mil_quality.THRESHOLD)
    assert 20 < len(kept) < len(rows)

    sets, group = [set(zip(*[words(r[1].translate(LOWER))[k:] for k in range(5)])) for r in kept], list(range(len(kept)))
    for a in range(len(kept)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    near = [kept[k] for k in range(len(kept)) if k == min(j for j in range(len(kept)) if group[j] == group[k])]
    assert len(near) < len(kept)

    first, cut = {}, []
    for i, t, lang, source, n in near:
        for k in range(len(words(t)) - 12):
            first[tuple(words(t)[k:k + 13])] = min(i, first.get(tuple(words(t)[k:k + 13]), i))
    for i, t, lang, source, n in near:
        w, gone = words(t), set()
        for k in range(len(w) - 12):
            if first[tuple(w[k:k + 13])] < i:
                gone |= set(range(k, k + 13))
        t = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t
        cut.append((i, t, lang, source, len(t)))
    assert cut != near

    share = {(r.doc_id, r.size): r.taken for r in source_mix.mix_table(spark.createDataFrame(cut, schema)).collect()}
    mixed = [r for r in cut for _ in range(share[r[0], len(words(r[1]))] // len(words(r[1])))]
    docs = spark.read.parquet(f"{tmpdir_path}/documents.parquet")
    for (name, stage), want in zip(corpus_pipeline.STAGES, (kept, near, cut, mixed)):
        docs = spark.createDataFrame(stage(spark, docs, tmpdir_path).collect(), schema)
        assert Counter(map(tuple, docs.collect())) == Counter(want), name

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter((i, len(e := enc.encode_ordinary(t)), sha(" ".join(map(str, e))), sha(t)) for i, t, *_ in mixed)
    assert Counter(map(tuple, corpus_pipeline.run(spark, tmpdir_path).collect())) == want


def test_joined_components_equal_a_full_closure(spark):
    """New links over old labels: two components, a component and a single, two singles, a link inside one."""
    from razonete.llm.common import Workspace
    from razonete.llm.odd_sketch import components, joined_components

    ws = Workspace(spark, "joined")
    old = spark.createDataFrame([(2, 1), (3, 2), (6, 5), (9, 8)], "x long, y long")
    new = spark.createDataFrame([(6, 3), (9, 7), (12, 11), (3, 1)], "x long, y long")
    got = {tuple(r) for r in joined_components(components(old, "a", ws), new, "b", ws).collect()}
    ws.close()
    assert got == {(1, 1), (2, 1), (3, 1), (5, 1), (6, 1), (7, 7), (8, 7), (9, 7), (11, 11), (12, 11)}
